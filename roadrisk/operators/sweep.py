"""Sweeps over decision rules and their cross-validation over trips.

A sweep never builds (frame x rule) rows for the whole fleet. A frame without an accepted
candidate scores the same under every rule, so each trip has one base score, and only frames
with accepted candidates add differences. For the threshold grid, acceptance is monotone in
every threshold: per frame the candidates fall into grid cells, and running minima along the
axes give the least TTC under all rules at once.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadrisk.constants import (
    CRITICAL_ZONE_TTC, CURRENT_GUARD, DANGER_TTC, GUARD_AXES, GUARD_SCALE, INF_AS_SECONDS, MINIMUM_COMPOSITE,
    MIN_TTC_FOR_INVERSE, SEMANTIC_MINIMUM_COMPOSITE,
)
from roadrisk.functions.geometry import corridor_member
from roadrisk.functions.ttc import is_finite
from roadrisk.operators.lineage import spread
from roadrisk.operators.scoring import score_sums, scores_from_sums

AXES = list(GUARD_AXES)
SHAPE = tuple(len(v) for v in GUARD_AXES.values())
GRID_SIZE = math.prod(SHAPE)
_COLUMN = {
    "minimum_bottom": "bottom_y", "minimum_height": "height", "minimum_confidence": "confidence",
    "maximum_closing_speed_mps": "closing_mps", "maximum_depth_m": "depth_m",
    "maximum_motion_residual_m": "residual_m",
}
SUMS = ("tp", "fp", "fn", "tn", "critical_error", "inverse_error")


def guard_grid(spark) -> DataFrame:
    """The 2,916 guards: config_id, their thresholds, and the distance from the one in use."""
    df = spark.range(GRID_SIZE).withColumnRenamed("id", "config_id")
    step = GRID_SIZE
    for axis, values in GUARD_AXES.items():
        step //= len(values)
        i = F.expr(f"CAST(config_id DIV {step} % {len(values)} AS INT)")
        if axis == "corridor":
            df = df.withColumn("corridor_top_width", F.array(*[F.lit(v[0]) for v in values])[i])
            df = df.withColumn("corridor_bottom_width", F.array(*[F.lit(v[1]) for v in values])[i])
        else:
            df = df.withColumn(axis, F.array(*[F.lit(v) for v in values])[i])
    return df.withColumn("distance", config_distance())


def config_distance() -> Column:
    """Sum over thresholds of steps away from the guard in use."""
    total = F.lit(0.0)
    for name, scale in GUARD_SCALE.items():
        total = total + F.abs(F.col(name) - CURRENT_GUARD[name]) / scale
    return total


def current_guard_id() -> int:
    """Grid position of the guard in use."""
    where = [
        values.index((CURRENT_GUARD["corridor_top_width"], CURRENT_GUARD["corridor_bottom_width"]))
        if axis == "corridor" else values.index(CURRENT_GUARD[axis])
        for axis, values in GUARD_AXES.items()
    ]
    return int(np.ravel_multi_index(where, SHAPE))


def grid_cell() -> Column:
    """Cell of a candidate: per axis how many steps must be loosened; NULL if no guard takes it.

    Every axis counts from its strictest value, so a guard takes all cells at or below its own.
    """
    code, alive = F.lit(0), is_finite("candidate_ttc")
    for axis, values in GUARD_AXES.items():
        if axis == "corridor":
            tests = [corridor_member("center_x", "bottom_y", F.lit(a), F.lit(b)) for a, b in values]
        else:
            c = F.col(_COLUMN[axis])
            tests = [c >= v if axis.startswith("minimum") else c <= v for v in values]
        passed = sum((F.when(x, 1).otherwise(0) for x in tests[1:]), F.when(tests[0], 1).otherwise(0))
        alive = alive & (passed > 0)
        code = code * len(values) + (len(values) - passed)
    return F.when(alive, code).cast("int")


_CELLS = np.arange(GRID_SIZE).reshape(SHAPE)
# cell (counted from the strictest value of each axis) of every guard in grid order
_GRID_ORDER = np.flip(_CELLS, [i for i, axis in enumerate(AXES) if axis.startswith("minimum")]).ravel()


def _accumulate(cells: np.ndarray, combine) -> np.ndarray:
    """Combine every cell with all cells at or below it; cells are the first axis, in place."""
    a = cells.reshape((*SHAPE, -1))
    for axis, n in enumerate(SHAPE):
        for k in range(1, n):
            here = (slice(None),) * axis
            combine(a[(*here, k)], a[(*here, k - 1)], out=a[(*here, k)])
    return cells


def grid_candidates(candidates: DataFrame) -> DataFrame:
    """Number of candidates each guard takes, per trip."""
    cells = candidates.select("trip_id", grid_cell().alias("cell")).filter("cell is not null")
    counts = cells.groupBy("trip_id", "cell").agg(F.count(F.lit(1)).alias("n"))

    def spread(pdf):  # at most one row per cell of the grid
        dense = np.zeros((GRID_SIZE, 1))
        dense[pdf["cell"], 0] = pdf["n"]
        return pd.DataFrame({
            "trip_id": pdf["trip_id"].iloc[0], "config_id": np.arange(GRID_SIZE),
            "accepted": _accumulate(dense, np.add)[_GRID_ORDER, 0].astype("int64")})

    return counts.groupBy("trip_id").applyInPandas(spread, "trip_id string, config_id bigint, accepted bigint")


def _contributions(p, t):
    """Summed over frames (columns of ``p``) per cell: score sums minus those of an infinite
    prediction, in the order of SUMS. ``t`` holds the truth per frame."""
    hot = (p < DANGER_TTC).astype(np.float32)
    true = (t < DANGER_TTC).astype(np.float32)
    tp, fp = (hot @ true).astype(float), (hot @ (1 - true)).astype(float)
    near = t < CRITICAL_ZONE_TTC
    q = p[:, near]
    q[np.isinf(q)] = INF_AS_SECONDS
    critical = np.abs(q - t[near]).sum(axis=1) - (INF_AS_SECONDS - t[near]).sum()
    inv_t = np.where(np.isfinite(t), 1.0 / np.maximum(t, MIN_TTC_FOR_INVERSE), 0.0)
    inv_p = 1.0 / np.maximum(p, MIN_TTC_FOR_INVERSE)  # 1 / inf is 0
    inverse = np.abs(inv_p - inv_t).sum(axis=1) - inv_t.sum()
    return np.stack([tp, fp, -tp, -fp, critical, inverse])


def grid_sweep(candidates: DataFrame, frames: DataFrame, truth="truth_ttc") -> DataFrame:
    """Scores of all guards on all trips: (config_id, trip_id) with the columns of ``ttc_score``."""
    keys = ["trip_id", "frame_id"]
    cells = (
        candidates.select(*keys, grid_cell().alias("cell"), "candidate_ttc").filter("cell is not null")
        .groupBy(*keys, "cell").agg(F.min("candidate_ttc").alias("ttc"))
    )
    # at most one entry per grid cell, whatever the number of candidates
    per_frame = cells.groupBy(*keys).agg(
        F.collect_list("cell").alias("cells"), F.collect_list("ttc").alias("ttcs"))
    rows = per_frame.join(frames.select(*keys, truth), keys).withColumn("_part", F.floor(F.col("frame_id") / 1024))
    rows = spread(rows, "trip_id", "_part").sortWithinPartitions("trip_id", "_part")

    def add_up(batches):
        trip, acc = None, None

        def flush():
            return pd.DataFrame({"trip_id": trip, "config_id": np.arange(GRID_SIZE),
                                 **{n: acc[i][_GRID_ORDER] for i, n in enumerate(SUMS)}})

        for batch in batches:
            for start in range(0, len(batch), 128):
                part = batch.iloc[start:start + 128]
                dense = np.full((GRID_SIZE, len(part)), np.inf)
                for i, (c, v) in enumerate(zip(part["cells"], part["ttcs"])):
                    dense[c, i] = v
                least = _accumulate(dense, np.minimum)
                t = part[truth].to_numpy(dtype=float)
                names = part["trip_id"].to_numpy()
                for name in pd.unique(names):
                    mine = names == name
                    one = least if mine.all() else least[:, mine]
                    if name != trip:
                        if trip is not None:
                            yield flush()
                        trip, acc = name, np.zeros((len(SUMS), GRID_SIZE))
                    acc += _contributions(one, t[mine])
        if trip is not None:
            yield flush()

    schema = "trip_id string, config_id bigint, " + ", ".join(f"{s} double" for s in SUMS)
    deltas = rows.select("trip_id", "cells", "ttcs", truth).mapInPandas(add_up, schema)
    deltas = deltas.groupBy("trip_id", "config_id").agg(*[F.sum(s).alias(f"d_{s}") for s in SUMS])
    return add_to_base(frames, deltas, GRID_SIZE, truth)


def sweep_deltas(frame_min: DataFrame, frames: DataFrame, truth="truth_ttc") -> DataFrame:
    """Score differences per (config_id, trip_id) from least TTCs per (config_id, frame)."""
    keys = ["trip_id", "frame_id"]
    j = frame_min.join(frames.select(*keys, truth), keys).withColumn("_none", F.lit(float("inf")))
    names = [*SUMS]
    a = j.groupBy("trip_id", "config_id").agg(
        *_renamed(score_sums("predicted_ttc", truth), "p_"), *_renamed(score_sums("_none", truth), "q_"))
    return a.select("trip_id", "config_id", *[(F.col(f"p_{n}") - F.col(f"q_{n}")).alias(f"d_{n}") for n in names])


def _renamed(cols, prefix):
    names = ("frames", "tp", "fp", "fn", "tn", "critical_frames", "critical_error", "inverse_error")
    return [c.alias(prefix + n) for c, n in zip(cols, names)]


def add_to_base(frames: DataFrame, deltas: DataFrame, configs: int, truth="truth_ttc") -> DataFrame:
    """Every (config, trip): the trip's score without any prediction, plus the differences."""
    base = frames.withColumn("_none", F.lit(float("inf"))).groupBy("trip_id").agg(*score_sums("_none", truth))
    every = base.withColumn("config_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(configs - 1).cast("bigint"))))
    j = every.join(deltas, ["trip_id", "config_id"], "left")
    total = {n: F.col(n) + F.coalesce(F.col(f"d_{n}"), F.lit(0.0)) for n in SUMS}
    whole = ("tp", "fp", "fn", "tn")
    j = j.select("trip_id", "config_id", "frames", "critical_frames",
                 *[(F.round(c).cast("bigint") if n in whole else F.coalesce(c, F.lit(0.0))).alias(n)
                   for n, c in total.items()])
    return scores_from_sums(j)


def semantic_sweep(least: DataFrame, frames: DataFrame, configs: int, truth="truth_ttc") -> DataFrame:
    """Scores per (config_id, trip_id) of the least TTCs (config_id, trip_id, frame_id, predicted_ttc)."""
    return add_to_base(frames, sweep_deltas(least, frames, truth), configs, truth)


def _training(scores: DataFrame, metrics=("f1", "composite", "mae_critical")) -> DataFrame:
    """Per (config, trip): mean of each metric over the other trips (``t_...``), all trips (``a_...``)."""
    totals = scores.groupBy("config_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count("mae_critical").alias("_k"),
        *[F.sum(m).alias(f"_s_{m}") for m in metrics])
    j = scores.join(totals, "config_id")
    n = F.col("_n")
    j = j.withColumns({f"t_{m}": F.when(n > 1, (F.col(f"_s_{m}") - F.coalesce(F.col(m), F.lit(0.0))) / (n - 1))
                       for m in metrics})
    j = j.withColumns({f"a_{m}": F.col(f"_s_{m}") / n for m in metrics})
    # one trip without critical frames leaves the mean undefined
    holes = n - F.col("_k")
    own = F.when(F.col("mae_critical").isNull(), 1).otherwise(0)
    j = j.withColumn("t_mae_critical", F.when(holes - own == 0, F.col("t_mae_critical")))
    j = j.withColumn("a_mae_critical", F.when(holes == 0, F.col("a_mae_critical")))
    return j.drop("_n", "_k", *[f"_s_{m}" for m in metrics])


def _r(c):
    return F.round(c, 9)


def loto_select(scores: DataFrame, grid: DataFrame, current_id: int, min_composite=MINIMUM_COMPOSITE) -> DataFrame:
    """Leave-one-trip-out choice of a guard, one row per held-out trip and one for all trips.

    Feasible guards keep the mean composite at ``min_composite`` and the mean critical MAE at
    that of the guard in use; the best has the highest F1, then composite, lower MAE, smaller
    distance, lower number. config_id is NULL where no guard is feasible.
    """
    j = _training(scores)
    per = j.select(
        F.col("trip_id").alias("held_out"), "config_id", *[F.col(f"t_{m}").alias(f"train_{m}") for m in
                                                          ("f1", "composite", "mae_critical")],
        F.col("f1").alias("held_f1"), F.col("composite").alias("held_composite"))
    all_trips = j.select("config_id", "a_f1", "a_composite", "a_mae_critical").distinct().select(
        F.lit("ALL").alias("held_out"), "config_id", F.col("a_f1").alias("train_f1"),
        F.col("a_composite").alias("train_composite"), F.col("a_mae_critical").alias("train_mae_critical"),
        F.lit(None).cast("double").alias("held_f1"), F.lit(None).cast("double").alias("held_composite"))
    rows = per.unionByName(all_trips)
    limit = rows.filter(F.col("config_id") == current_id).select(
        "held_out", F.col("train_mae_critical").alias("_limit"))
    rows = rows.join(limit, "held_out").join(grid.select("config_id", "distance"), "config_id")
    ok = (F.col("train_composite") >= min_composite) & (F.col("train_mae_critical") <= F.col("_limit") + 1e-9)
    best = F.min(F.when(ok, F.struct(
        (-_r("train_f1")).alias("_1"), (-_r("train_composite")).alias("_2"), _r("train_mae_critical").alias("_3"),
        _r("distance").alias("_4"), "config_id", "train_f1", "train_composite", "train_mae_critical", "held_f1",
        "held_composite")))
    out = rows.groupBy("held_out").agg(best.alias("b"), F.count_if(ok).alias("feasible_configs"))
    return out.select(
        "held_out", "feasible_configs", "b.config_id", "b.train_f1", "b.train_composite", "b.train_mae_critical",
        "b.held_f1", "b.held_composite", (F.col("b.train_f1") - F.col("b.held_f1")).alias("gap"))


def loto_semantic(scores: DataFrame, min_composite=SEMANTIC_MINIMUM_COMPOSITE, mae_tolerance=1e-4) -> DataFrame:
    """Leave-one-trip-out choice among semantic settings (config_id >= 1; 0 is the guard alone).

    The highest mean training F1 wins, first in grid order on a tie; feasible settings keep
    ``min_composite`` and the guard's mean MAE (+``mae_tolerance``). Folds without one are kept, marked.
    """
    j = _training(scores)
    limit = j.filter("config_id = 0").select("trip_id", F.col("t_mae_critical").alias("_limit"))
    rows = j.filter("config_id > 0").join(limit, "trip_id")
    ok = (F.col("t_composite") >= min_composite) & (F.col("t_mae_critical") <= F.col("_limit") + mae_tolerance)
    best = F.min(F.when(ok, F.struct(
        (-_r("t_f1")).alias("_1"), "config_id", "t_f1", "t_composite", "t_mae_critical", "f1", "composite",
        "mae_critical", "recall", "fp")))
    out = rows.groupBy("trip_id").agg(best.alias("b"))
    return out.select(
        "trip_id", F.col("b").isNull().alias("infeasible"), "b.config_id", F.col("b.t_f1").alias("train_f1"),
        F.col("b.t_composite").alias("train_composite"), F.col("b.t_mae_critical").alias("train_mae_critical"),
        F.col("b.f1").alias("held_f1"), F.col("b.composite").alias("held_composite"),
        F.col("b.mae_critical").alias("held_mae_critical"), F.col("b.recall").alias("held_recall"),
        F.col("b.fp").alias("held_fp"))


def selection_modes(scores: DataFrame, min_composite=SEMANTIC_MINIMUM_COMPOSITE, mae_tolerance=1e-4,
                    target_f1=0.60) -> DataFrame:
    """Macro scores of four ways to choose: baseline, global_best, loto, oracle (upper bound)."""
    macro = scores.groupBy("config_id").agg(
        F.avg("f1").alias("macro_f1"), F.avg("composite").alias("macro_composite"),
        F.avg("mae_critical").alias("macro_mae"), F.sum("fp").alias("total_fp"), F.avg("recall").alias("macro_recall"),
        F.count(F.lit(1)).alias("trips"))
    base = macro.filter("config_id = 0")
    limit = base.select(F.col("macro_mae").alias("_limit"))
    cols = ["macro_f1", "macro_composite", "macro_mae", "total_fp", "macro_recall", "trips"]

    def row(df, mode, config="config_id"):
        return df.select(F.lit(mode).alias("mode"), F.col(config).cast("bigint").alias("config_id"), *cols)

    # one row of limits joined to at most 28 rows
    m = macro.filter("config_id > 0").join(limit, F.lit(True))
    ok = (F.col("macro_composite") >= min_composite) & (F.col("macro_mae") <= F.col("_limit") + mae_tolerance)
    order = F.struct((~ok).alias("_0"), (-_r("macro_f1")).alias("_1"), "config_id", *cols)
    best = m.agg(F.min(order).alias("b")).select("b.*")
    folds = loto_semantic(scores, min_composite, mae_tolerance).filter("not infeasible").agg(
        F.avg("held_f1").alias("macro_f1"), F.avg("held_composite").alias("macro_composite"),
        F.avg("held_mae_critical").alias("macro_mae"), F.sum("held_fp").alias("total_fp"),
        F.avg("held_recall").alias("macro_recall"), F.count(F.lit(1)).alias("trips")).withColumn("config_id", F.lit(None))
    top = scores.groupBy("trip_id").agg(F.min(F.struct(
        (-_r("f1")).alias("_1"), "config_id", "f1", "composite", "mae_critical", "fp", "recall")).alias("b"))
    oracle = top.agg(
        F.avg("b.f1").alias("macro_f1"), F.avg("b.composite").alias("macro_composite"),
        F.avg("b.mae_critical").alias("macro_mae"), F.sum("b.fp").alias("total_fp"),
        F.avg("b.recall").alias("macro_recall"), F.count(F.lit(1)).alias("trips")).withColumn("config_id", F.lit(None))
    out = (row(base, "baseline").unionByName(row(best, "global_best"))
           .unionByName(row(folds, "loto")).unionByName(row(oracle, "oracle")))
    out = out.join(limit, F.lit(True))
    return out.withColumns({
        "passes_composite": F.coalesce(F.col("macro_composite") >= min_composite, F.lit(False)),
        "passes_mae": F.coalesce(F.col("macro_mae") <= F.col("_limit") + mae_tolerance, F.lit(False)),
        "reaches_target": F.coalesce(F.col("macro_f1") >= target_f1, F.lit(False))}).drop("_limit")
