"""Counts that explain where danger decisions come from, and labels that check them."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadrisk.constants import DANGER_TTC
from roadrisk.functions.ttc import is_danger, is_finite
from roadrisk.operators.association import KEYS, classical_danger, path_gate
from roadrisk.operators.quantiles import exact_quantiles


def danger_coverage(evidence: DataFrame) -> DataFrame:
    """Danger frames by truth, and how many have a match and an occupancy; per trip and ALL.

    evidence: trip_id, predicted_ttc, truth_ttc, matched_iou, occupancy.
    """
    d, tp = is_danger("predicted_ttc"), is_danger("truth_ttc")
    e = d & (F.col("matched_iou") >= 0.30) & F.col("occupancy").isNotNull()
    r = evidence.rollup("trip_id").agg(
        F.grouping("trip_id").alias("_all"), F.count_if(d).alias("danger"), F.count_if(d & tp).alias("danger_tp"),
        F.count_if(d & ~tp).alias("danger_fp"), F.count_if(e).alias("eligible"),
        F.count_if(e & tp).alias("eligible_tp"), F.count_if(e & ~tp).alias("eligible_fp"))
    return r.withColumn("trip_id", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("trip_id"))).drop("_all")


def veto_coverage(pred: DataFrame) -> DataFrame:
    """Does the detector support or veto classical danger, by truth, per trip?"""
    tp, support = is_danger("truth_ttc"), is_danger("detector_ttc")
    return pred.filter(is_danger("classical_ttc")).groupBy("trip_id").agg(
        F.count_if(support & tp).alias("supports_tp"), F.count_if(support & ~tp).alias("supports_fp"),
        F.count_if(~support & tp).alias("vetoes_tp"), F.count_if(~support & ~tp).alias("vetoes_fp"))


def fp_taxonomy(evidence: DataFrame) -> DataFrame:
    """First reason why a false danger was not removed.

    evidence adds road_users (number of detections of a kept class), matched_iou, occupancy.
    """
    # fixed values: names of the reasons
    reason = (
        F.when(~F.col("union_source").startswith("classical"), "not_classical_candidate")
        .when(F.col("road_users") == 0, "no_yolo_road_user")
        .when(F.col("matched_iou") < 0.30, "no_classical_yolo_iou_match")
        .when(F.col("occupancy").isNull(), "matched_occupancy_unavailable")
        .when(F.col("occupancy") < 0.50, "eligible_low_occupancy").otherwise("eligible_not_low_occupancy"))
    false = is_danger("predicted_ttc") & ~is_danger("truth_ttc")
    return evidence.filter(false).groupBy("trip_id", reason.alias("reason")).agg(F.count(F.lit(1)).alias("frames"))


def path_taxonomy(evidence: DataFrame, updates: DataFrame, half=1.75) -> DataFrame:
    """False-danger frames by path geometry of the best match (classical danger frames)."""
    g = path_gate(evidence, updates).filter(classical_danger() & ~is_danger("truth_ttc"))
    kind = (
        F.when(F.col("match").isNull(), "unassociated").when(F.col("path_offset_m").isNull(), "geometry_unavailable")
        .when(F.abs("path_offset_m") > half, "off_path").otherwise("on_path_nonclosing"))
    return g.groupBy("trip_id", kind.alias("category")).agg(F.count(F.lit(1)).alias("frames"))


def label_winner(labels: DataFrame, allowed, threshold=0.40) -> DataFrame:
    """Counts, coverage and decision of reviewer labels. One row.

    labels: label, is_danger (stratum S1), order (first seen wins ties). The decision is
    DECISIVE when one label holds ``threshold`` of all labelled rows and of S1.
    """
    good = F.col("label").isin(*allowed)
    counts = labels.filter(good).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_danger").alias("n1"), F.min("order").alias("first"),
        F.min(F.when(F.col("is_danger"), F.col("order"))).alias("first1"))

    def top(n, first):
        return F.min(F.when(F.col(n) > 0, F.struct((-F.col(n)).alias("n"), F.col(first).alias("o"), "label")))

    w = counts.agg(top("n", "first").alias("a"), top("n1", "first1").alias("b"), F.sum("n").alias("labelled"),
                   F.sum("n1").alias("s1"))
    total = labels.agg(F.count(F.lit(1)).alias("rows_total"))
    share = F.try_divide(-F.col("a.n"), "labelled")
    share1 = F.try_divide(-F.col("b.n"), "s1")
    clear = F.coalesce((share >= threshold) & (share1 >= threshold) & (F.col("a.label") == F.col("b.label")), F.lit(False))
    return total.join(w, F.lit(True)).select(
        "rows_total", F.coalesce("labelled", F.lit(0)).alias("rows_labelled"),
        F.coalesce(F.try_divide("labelled", "rows_total"), F.lit(0.0)).alias("coverage"),
        F.col("a.label").alias("winner_all"), share.alias("share_all"), F.col("b.label").alias("winner_s1"),
        share1.alias("share_s1"), F.when(clear, "DECISIVE").otherwise("MIXED").alias("decision"))


# fixed values: path relations a reviewer may enter
RELATIONS = ("on_path", "adjacent", "diverging")


def relation_means(labels: DataFrame, value: str, on_path_is_lower=True, ready=24) -> DataFrame:
    """Mean of a value per path relation, and whether on_path lies on the expected side of the
    pooled others; ready when ``ready`` complete rows exist and none is invalid."""
    rel, v = F.col("path_relation"), F.col(value)
    done = rel.isin(*RELATIONS) & is_finite(value)
    off = done & (rel != "on_path")
    s = labels.agg(
        F.count(F.lit(1)).alias("rows_total"), F.count_if(done).alias("complete"),
        F.count_if(~F.coalesce(rel.isin(*RELATIONS), F.lit(True))).alias("invalid"),
        *[F.avg(F.when(done & (rel == r), v)).alias(f"mean_{r}") for r in RELATIONS],
        F.avg(F.when(off, v)).alias("mean_off_path"))
    on, other = F.col("mean_on_path"), F.col("mean_off_path")
    side = F.coalesce(on < other if on_path_is_lower else on > other, F.lit(False))
    return s.withColumns({
        "direction_consistent": side, "ready": (F.col("complete") >= ready) & (F.col("invalid") == 0) & side})


def top_one_precision(pairs: DataFrame, by=()) -> DataFrame:
    """yes / (yes + no) among rank-1 pairs. pairs: rank, same_object (yes, no, uncertain)."""
    s, first = F.col("same_object"), F.col("rank") == 1
    yes, no = F.count_if(first & (s == "yes")), F.count_if(first & (s == "no"))
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(s.isin("yes", "no", "uncertain")).alias("complete"),
        yes.alias("top_yes"), no.alias("top_no"), F.try_divide(yes, yes + no).alias("top_one_precision"))


def stratum_medians(df: DataFrame, stratum: str, cols) -> DataFrame:
    """Median per stratum of each column, NaN and NULL left out."""
    long = df.unpivot([stratum], list(cols), "metric", "value").withColumn(
        "value", F.when(~F.isnan("value"), F.col("value")))
    return exact_quantiles(long, [stratum, "metric"], "value", {"median": 0.5}, [F.sum("_n").alias("samples")])


def class_counts(detections: DataFrame) -> DataFrame:
    """Detections and distinct frames per class."""
    frames = detections.select("class_id", *KEYS).distinct().groupBy("class_id").agg(F.count(F.lit(1)).alias("frames"))
    return detections.groupBy("class_id").agg(F.count(F.lit(1)).alias("detections")).join(frames, "class_id")


# fixed values: value of each feature in a frame without candidates
_EMPTY = {"min_ttc": 99.0, "min_depth": 99.0, "min_residual": 20.0, "min_mad_ratio": 10.0, "urgent_ttc": 99.0, "urgent_depth": 99.0,
          "urgent_residual": 20.0, "urgent_offset": 1.0, "urgent_mad_ratio": 10.0}


def _clamped(c, lo, hi, default):
    c = F.col(c)
    return F.least(F.greatest(F.when(is_finite(c), c).otherwise(default), F.lit(lo)), F.lit(hi))


def frame_features(candidates: DataFrame, frames: DataFrame) -> DataFrame:
    """The 31 causal features of a frame: counts, extremes over candidates, and the most urgent one.

    candidates: KEYS, ordinal, candidate_ttc, depth_m, closing_mps, residual_m, confidence, center_x,
    bottom_y, width, height, and of the track hits, history, quality, mad_ratio, lr_support and
    corridor; where one of those six is not there, or NULL, it counts as 0 (mad_ratio: 10). Only
    candidate columns enter, no identifiers and no truth. Frames without candidates get fixed values.
    """
    def kept(c):
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in candidates.columns else F.lit(0.0).alias(c)

    ratio = _clamped("mad_ratio", 0.0, 10.0, 10.0) if "mad_ratio" in candidates.columns else F.lit(10.0)
    c = candidates.select(
        *KEYS, "ordinal",
        F.when(is_finite("candidate_ttc"), F.col("candidate_ttc")).otherwise(99.0).alias("ttc"),
        _clamped("depth_m", 0.0, 99.0, 99.0).alias("depth"), _clamped("closing_mps", -200.0, 200.0, 0.0).alias("closing"),
        _clamped("residual_m", 0.0, 20.0, 20.0).alias("residual"), "confidence",
        F.abs(F.col("center_x") - 0.5).alias("offset"), F.col("bottom_y").alias("bottom"), "width", "height",
        *map(kept, ("hits", "history", "quality", "lr_support", "corridor")), ratio.alias("mad_ratio"))
    # fixed order of the features
    extremes = [(F.min, x, f"min_{x}") for x in ("ttc", "depth")] + [(F.max, "closing", "max_closing"), (F.min, "residual", "min_residual")] + [
        (F.max, x, f"max_{x}") for x in ("confidence", "bottom", "width", "height", "hits", "history", "quality")] + [
        (F.min, "mad_ratio", "min_mad_ratio"), (F.max, "lr_support", "max_lr_support"), (F.max, "corridor", "max_corridor")]
    urgent = ["ttc", "depth", "closing", "residual", "confidence", "offset", "bottom", "width", "height",
              "hits", "history", "quality", "mad_ratio", "lr_support", "corridor"]
    a = c.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("ttc") < 99.0).alias("finite_candidates"),
        *[fn(x).alias(name) for fn, x, name in extremes], F.min(F.struct("ttc", "ordinal", *urgent[1:])).alias("_u"))
    a = a.select("*", *[F.col(f"_u.{x}").alias(f"urgent_{x}") for x in urgent]).drop("_u")
    j = frames.join(a, KEYS, "left")
    cols = [x for x in a.columns if x not in KEYS]
    return j.withColumns({x: F.coalesce(F.col(x), F.lit(_EMPTY.get(x, 0.0)).cast(a.schema[x].dataType)) for x in cols})


def review_outcome(pred="predicted_ttc", truth="truth_ttc"):
    return F.when(F.col(pred) < DANGER_TTC, F.when(is_danger(truth), "danger").otherwise("non_danger"))
