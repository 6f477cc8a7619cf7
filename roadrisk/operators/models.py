"""Small models over frame features: a source router and a threshold tree.

Rows never leave the executors. Models of the router are rows of a table, one per fold; each level
of the tree sends back one split per node.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadrisk.functions.ttc import inverse_ttc, is_danger, is_finite
from roadrisk.operators.lineage import cut
from roadrisk.operators.quality import leakage_guard
from roadrisk.operators.quantiles import value_bucket
from roadrisk.operators.scoring import danger_confusion, ttc_score

# --- router ------------------------------------------------------------------

# fixed values: feature names of the router, in their order
ROUTER_FEATURES = leakage_guard((
    "detector_is_danger", "detector_minus_classical_confidence", "classical_minus_detector_residual",
    "detector_minus_classical_quality", "detector_minus_classical_lr_support", "detector_minus_classical_history",
    "detector_depth_confidence", "detector_minus_classical_proposal_count", "detector_risk_track_count",
    "detector_minus_classical_ground_confidence", "ego_speed_normalized", "inverse_ttc_disagreement"))


def router_features(df: DataFrame) -> DataFrame:
    """Add the router's features; missing inputs take fixed defaults.

    Inputs c_* (classical) and d_* (detector): ttc, confidence, residual, quality, lr_support,
    history, components, ground; d_depth_confidence, d_risk_tracks, speed_mps.
    """
    def num(c, default=0.0):
        return F.when(is_finite(c), F.col(c)).otherwise(default)

    def clip(x, r):
        return F.least(F.greatest(x, F.lit(-r)), F.lit(r)) / r

    def gain(c):
        return num(f"d_{c}") - num(f"c_{c}")
    values = [
        F.when(is_danger("d_ttc"), 1.0).otherwise(0.0), gain("confidence"),
        clip(num("c_residual", 5.0) - num("d_residual", 5.0), 5.0), gain("quality"), gain("lr_support"), gain("history") / 11.0,
        num("d_depth_confidence"), clip(gain("components"), 5.0), F.least(F.lit(5.0), num("d_risk_tracks")) / 5.0, gain("ground"),
        F.least(F.lit(40.0), num("speed_mps")) / 40.0, F.abs(inverse_ttc("d_ttc") - inverse_ttc("c_ttc"))]
    return df.withColumns(dict(zip(ROUTER_FEATURES, values)))


def training_rows(df: DataFrame) -> DataFrame:
    """Frames where the sources disagree on danger; label: the detector is right."""
    c, d = is_danger("c_ttc"), is_danger("d_ttc")
    x = F.array(*[F.col(f).cast("double") for f in ROUTER_FEATURES])
    return df.filter(c != d).select("fold", x.alias("x"), (d == is_danger("truth_ttc")).cast("int").alias("y"))


_X = len(ROUTER_FEATURES)
MODEL = "fold int, mean array<double>, scale array<double>, class_weights array<double>, weights array<double>, open boolean"
ROUNDS_AT_ONCE = 64   #: folds of which a task holds the sums at once


def _sums_by_fold(parts: DataFrame) -> DataFrame:
    """(fold, v) of any number of tasks -> one vector per fold: (fold, v), added up entry by entry."""
    return parts.select("fold", F.posexplode("v").alias("i", "v")).groupBy("fold", "i").agg(F.sum("v").alias("v")).groupBy("fold").agg(
        F.array_sort(F.collect_list(F.struct("i", "v"))).alias("r")).select("fold", F.col("r.v").alias("v"))


def _fold_moments(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Count, positives, sums and sums of squares of the rows of the other folds: all rows less the own ones."""
    def moments(batches):
        for pdf in batches:
            x, y = np.stack(pdf["x"]) if len(pdf) else np.empty((0, _X)), pdf["y"].to_numpy(float)
            f = pdf["fold"].to_numpy()
            out = [(int(k), np.concatenate([[m.sum(), y[m].sum()], x[m].sum(0), (x[m] ** 2).sum(0)])) for k in np.unique(f) for m in [f == k]]
            yield pd.DataFrame(out, columns=["fold", "v"])

    own = _sums_by_fold(rows.mapInPandas(moments, "fold int, v array<double>"))
    total = _sums_by_fold(own.select(F.lit(-1).alias("fold"), "v")).select(F.col("v").alias("all"))
    # one row of totals beside each fold; a fold without rows has nothing to take off
    j = folds.join(own, "fold", "left").join(total, F.lit(True))
    return j.select("fold", F.when(F.col("v").isNull(), F.col("all")).otherwise(F.zip_with("all", "v", lambda a, o: a - o)).alias("v"))


def _start(batches):
    for pdf in batches:
        out = []
        for fold, v in zip(pdf["fold"], pdf["v"]):
            v = np.asarray(v, float)
            n, pos = round(v[0]), round(v[1])
            if not 0 < pos < n:
                raise ValueError(f"fold {fold}: training needs both classes")
            mean = v[2:2 + _X] / n
            sd = np.sqrt(np.maximum(v[2 + _X:] / n - mean ** 2, 0.0))
            out.append((int(fold), mean, np.where(sd < 1e-6, 1.0, sd), np.array([n / (2 * (n - pos)), n / (2 * pos)]), np.zeros(_X + 1), True))
        yield pd.DataFrame(out, columns=["fold", "mean", "scale", "class_weights", "weights", "open"])


def _newton(l2: float):
    ridge = np.diag([0.0] + [l2] * _X)

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                v, w = np.asarray(r["v"], float), np.asarray(r["weights"], float)
                h = v[_X + 1:].reshape(_X + 1, _X + 1) + ridge + 1e-8 * np.eye(_X + 1)
                delta = np.linalg.solve(h, v[:_X + 1] + ridge @ w)
                out.append((int(r["fold"]), r["mean"], r["scale"], r["class_weights"], w - delta, bool(np.abs(delta).max() >= 1e-8)))
            yield pd.DataFrame(out, columns=["fold", "mean", "scale", "class_weights", "weights", "open"])

    return solve


def _steps(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Gradient and curvature of each open fold over the rows of the others: (fold, v). Rows meet the
    models in blocks of folds, so that a task holds ROUNDS_AT_ONCE models, however many there are."""
    rest = [m.asDict() for m in models.filter("open").select("fold", "mean", "scale", "class_weights", "weights").orderBy("fold").collect()]
    small = [rest[i:i + ROUNDS_AT_ONCE] for i in range(0, len(rest), ROUNDS_AT_ONCE)]
    parts = None
    for group in small:
        shared = rows.sparkSession.sparkContext.broadcast(group)  # ROUNDS_AT_ONCE short vectors

        def step(batches, shared=shared):
            ms = [(m["fold"], np.array(m["mean"]), np.array(m["scale"]), m["class_weights"], np.array(m["weights"])) for m in shared.value]
            for pdf in batches:
                x, y, f = np.stack(pdf["x"]) if len(pdf) else np.empty((0, _X)), pdf["y"].to_numpy(float), pdf["fold"].to_numpy()
                out = []
                for fold, mean, scale, cw, w in ms:
                    use = f != fold
                    z = np.column_stack([np.ones(use.sum()), (x[use] - mean) / scale])
                    p = 1.0 / (1.0 + np.exp(-np.clip(z @ w, -30, 30)))
                    c = np.where(y[use] == 1, cw[1], cw[0])
                    h = z.T @ (z * (c * p * (1 - p))[:, None])
                    out.append((int(fold), np.concatenate([z.T @ (c * (p - y[use])), h.ravel()])))
                yield pd.DataFrame(out, columns=["fold", "v"])

        one = rows.mapInPandas(step, "fold int, v array<double>")
        parts = one if parts is None else parts.unionByName(one)
    return _sums_by_fold(parts)


def fit_routers(rows: DataFrame, folds: DataFrame, l2=2.0, iterations=40) -> DataFrame:
    """Class-balanced logistic regression per fold, trained on the rows of the other folds.

    ``rows`` (from ``training_rows``; cut it first), ``folds`` (fold: int, one row each) -> one model a
    row: fold, mean, scale, class_weights, weights (intercept first, on standardised features), open
    (not converged). Moments are those of all rows less the own ones. Newton steps are solved on
    the executors, a row each; the driver passes the open models (40 numbers each) on to the tasks in
    blocks. The intercept is not penalised. A fold whose training rows have one class only is an error.
    """
    models = cut(_fold_moments(rows, folds.select(F.col("fold").cast("int"))).mapInPandas(_start, MODEL))
    for _ in range(iterations):
        if models.filter("open").isEmpty():
            break
        j = models.filter("open").join(_steps(rows, models), "fold")
        models = cut(j.mapInPandas(_newton(l2), MODEL).unionByName(models.filter("NOT open")))
    return models


def linear_form(models: DataFrame) -> DataFrame:
    """(fold, bias, slopes): the models with the standardisation folded into the weights."""
    slopes = F.zip_with(F.slice("weights", 2, _X), "scale", lambda w, s: w / s)
    d = models.select("fold", F.col("weights")[0].alias("_w0"), slopes.alias("slopes"), "mean")
    shift = F.aggregate(F.zip_with("slopes", "mean", lambda a, m: a * m), F.lit(0.0), lambda s, v: s + v)
    return d.select("fold", (F.col("_w0") - shift).alias("bias"), "slopes")


def route(df: DataFrame, linear: DataFrame) -> DataFrame:
    """Where the sources disagree on danger, take the detector if the fold's model says so.

    linear: fold, bias, slopes (of ``linear_form``), joined by fold; frames of a fold without a model
    keep the classical source. Adds detector_probability, chose_detector, routed_ttc.
    """
    j = df.join(linear.select("fold", F.col("bias").alias("_bias"), F.col("slopes").alias("_slopes")), "fold", "left")
    dot = F.col("_bias")
    for i, name in enumerate(ROUTER_FEATURES):
        dot = dot + F.col("_slopes")[i] * F.col(name)
    p = 1.0 / (1.0 + F.exp(-F.least(F.greatest(dot, F.lit(-30.0)), F.lit(30.0))))
    j = j.withColumn("detector_probability", F.when(F.col("_bias").isNotNull(), p)).drop("_bias", "_slopes")
    chose = (is_danger("c_ttc") != is_danger("d_ttc")) & F.coalesce(F.col("detector_probability") >= 0.5, F.lit(False))
    return j.withColumn("chose_detector", chose).withColumn(
        "routed_ttc", F.when(F.col("chose_detector"), F.col("d_ttc")).otherwise(F.col("c_ttc")))


def cv_router(df: DataFrame, linear: DataFrame) -> DataFrame:
    """Held-out scores per trip of the router, both sources and their union."""
    r = route(df, linear)
    alone = is_danger("d_ttc") & ~is_danger("c_ttc")
    r = r.withColumn("union_ttc", F.when(alone, F.col("d_ttc")).otherwise(F.col("c_ttc")))
    v = F.array(*[F.struct(F.lit(n).alias("source"), F.col(c).alias("predicted_ttc")) for n, c in (
        ("router", "routed_ttc"), ("classical", "c_ttc"), ("detector", "d_ttc"), ("union", "union_ttc"))])
    long = r.select("trip_id", "truth_ttc", F.explode(v).alias("v")).select("trip_id", "truth_ttc", "v.*")
    return ttc_score(long, ["source", "trip_id"])


# --- tree --------------------------------------------------------------------


def tree_split(rows: DataFrame, features, node="node", min_leaf=5, max_thresholds=64) -> DataFrame:
    """Best Gini split of every node: feature number, threshold, costs and counts.

    rows: ``node``, label (0/1) and the features. Equal values are counted first; their order
    is a prefix sum in two steps, so no task holds all values of a feature.
    """
    long = rows.select(node, "label", F.posexplode(F.array(*[F.col(f).cast("double") for f in features])).alias("feature", "value"))
    k = [node, "feature"]
    c = long.groupBy(*k, "value").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).withColumn("_b", value_bucket("value"))
    b = c.groupBy(*k, "_b").agg(F.sum("n").alias("_n"), F.sum("p").alias("_p"), F.count(F.lit(1)).alias("_v"), F.min("value").alias("_lo"))
    past = Window.partitionBy(*k).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*k)
    zero = F.lit(0)
    b = b.select(
        *k, "_b", *[F.coalesce(F.sum(s).over(past), zero).alias(f"{s}0") for s in ("_n", "_p", "_v")],
        *[F.sum(s).over(whole).alias(f"{s}t") for s in ("_n", "_p", "_v")],
        F.lead("_lo").over(Window.partitionBy(*k).orderBy("_b")).alias("_next"))
    w = Window.partitionBy(*k, "_b").orderBy("value")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    j = c.withColumns({"_cn": F.sum("n").over(run), "_cp": F.sum("p").over(run), "_i": F.row_number().over(w) - 1,
                       "_up": F.lead("value").over(w)}).join(b, [*k, "_b"])
    j = j.withColumns({"ln": F.col("_cn") + F.col("_n0"), "lp": F.col("_cp") + F.col("_p0"), "_i": F.col("_i") + F.col("_v0"),
                       "_up": F.coalesce("_up", "_next")}).filter("_up is not null")
    m = F.col("_vt") - 1  # number of thresholds
    at = F.floor(F.col("_i") * (max_thresholds - 1) / F.greatest(m - 1, F.lit(1)))
    on_grid = F.lit(False)
    for d in (0, 1):
        on_grid = on_grid | (F.floor((at + d) * (m - 1) / F.lit(max_thresholds - 1)) == F.col("_i"))
    ln, lp, n, p = F.col("ln"), F.col("lp"), F.col("_nt"), F.col("_pt")

    def cost(size, pos):
        return 2.0 * pos * (size - pos) / size
    j = j.filter(((m <= max_thresholds) | on_grid) & (ln >= min_leaf) & (n - ln >= min_leaf))
    best = F.min(F.struct(
        F.round(cost(ln, lp) + cost(n - ln, p - lp), 9).alias("cost"), "feature", ((F.col("value") + F.col("_up")) / 2.0).alias("threshold"),
        cost(n, p).alias("parent_cost"), n.alias("rows"), p.alias("positives"), ln.alias("left_rows"), lp.alias("left_positives")))
    s = j.groupBy(node).agg(best.alias("s")).select(node, "s.*")
    return s.withColumn("accepted", F.col("cost") < F.col("parent_cost") - 1e-9)


def _descend(at: DataFrame, features, splits: dict) -> DataFrame:
    """Move every row one level down: to a child where (tree, node) was split, else it stays. The
    table of splits has a row per node, so Spark joins it without moving the rows."""
    if not splits:
        return at
    table = at.sparkSession.createDataFrame(
        [(int(tree), int(node), int(s["feature"]), float(s["threshold"])) for (tree, node), s in splits.items()],
        "tree int, node int, _feature int, _threshold double")
    value = F.get(F.array(*[F.col(f).cast("double") for f in features]), F.col("_feature"))
    down = F.when(F.col("_feature").isNull(), F.col("node")).when(value <= F.col("_threshold"), 2 * F.col("node")).otherwise(2 * F.col("node") + 1)
    return at.withColumn("tree", F.col("tree").cast("int")).join(table, ["tree", "node"], "left").withColumn("node", down).drop("_feature", "_threshold")


def fit_trees(rows: DataFrame, features, depth=3, min_leaf=5) -> tuple[dict, dict]:
    """Trees for all values of ``tree`` at once, level by level.

    rows: tree (small number of folds), label and features. Returns the splits by (tree, node)
    and the majority of every leaf. Only one split per node comes back per level.
    """
    features, splits = leakage_guard(features), {}
    at = rows.withColumn("node", F.lit(1))
    for _ in range(depth):
        found = tree_split(at.withColumn("_tn", F.struct("tree", "node")), features, "_tn", min_leaf).filter("accepted").collect()
        level = {(r["_tn"]["tree"], r["_tn"]["node"]): r.asDict() for r in found}
        fresh = {key: s for key, s in level.items() if key not in splits}
        if not fresh:
            break
        splits |= fresh
        at = _descend(at, features, fresh)
    leaves = at.groupBy("tree", "node").agg((F.sum("label") * 2 >= F.count(F.lit(1))).alias("yes")).collect()
    return splits, {(r["tree"], r["node"]): bool(r["yes"]) for r in leaves}


def predict_trees(rows: DataFrame, features, splits: dict, leaves: dict) -> DataFrame:
    """Add ``prediction`` by the tree named in column ``tree``."""
    at = rows.withColumn("node", F.lit(1))
    for level in range(max((int(np.log2(n)) for _, n in splits), default=-1) + 1):
        now = {key: s for key, s in splits.items() if int(np.log2(key[1])) == level}
        at = _descend(at, features, now)
    yes = at.sparkSession.createDataFrame([(int(t), int(n), bool(v)) for (t, n), v in leaves.items()], "tree int, node int, prediction boolean")
    found = at.withColumn("tree", F.col("tree").cast("int")).join(yes, ["tree", "node"], "left")
    return found.withColumn("prediction", F.coalesce("prediction", F.lit(False))).drop("node")


def capacity_report(rows: DataFrame, features, in_depth=8, cv_depth=3, folds=4) -> DataFrame:
    """Can the features separate danger at all, and does that carry over to unseen blocks?

    rows: fold (1..folds), label, features. One row per protocol: in_sample (tree 0, all rows,
    leaves of any size) and blocked (tree f, trained without fold f), with the diagnosis: in
    sample under 0.80 F1, else blocked under 0.60, else promising.
    """
    whole, leaves0 = fit_trees(rows.withColumn("tree", F.lit(0)), features, in_depth, 1)
    others = F.filter(F.sequence(F.lit(1), F.lit(folds)), lambda f: f != F.col("fold"))
    part, leaves = fit_trees(rows.withColumn("tree", F.explode(others)), features, cv_depth)
    a = predict_trees(rows.withColumn("tree", F.lit(0)), features, whole, leaves0).withColumn("protocol", F.lit("in_sample"))
    b = predict_trees(rows.withColumn("tree", F.col("fold").cast("int")), features, part, leaves).withColumn("protocol", F.lit("blocked"))
    both = a.unionByName(b).withColumns({
        "p": F.when(F.col("prediction"), 1.0).otherwise(9.0), "t": F.when(F.col("label") == 1, 1.0).otherwise(9.0)})
    c = danger_confusion(both, ["protocol"], "p", "t")
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    used = {"in_sample": len({s["feature"] for s in whole.values()}), "blocked": len({s["feature"] for s in part.values()})}
    c = c.withColumns({
        "f1": F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0)), "accuracy": (tp + tn) / (tp + fp + fn + tn),
        "features_used": F.when(F.col("protocol") == "blocked", used["blocked"]).otherwise(used["in_sample"])})
    f1 = c.agg(F.max(F.when(F.col("protocol") == "in_sample", F.col("f1"))).alias("_i"), F.max(F.when(F.col("protocol") == "blocked", F.col("f1"))).alias("_b"))
    # fixed values: wording and limits of the diagnosis
    text = (F.when(F.col("_i") < 0.80, "feature-capacity failure").when(F.col("_b") < 0.60, "local signal, poor blocked generalization")
            .otherwise("promising signal; proceed to causal ablation"))
    # two rows of results joined to one row of F1 values
    return c.join(f1, F.lit(True)).withColumn("diagnosis", text).drop("_i", "_b")
