"""Semantic support of tracks over time, and the guard that uses it."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadrisk.constants import CURRENT_GUARD, SEMANTIC_AXES
from roadrisk.functions.geometry import guard_predicate
from roadrisk.operators.scan import Monoid, scan
from roadrisk.operators.sequence import SEG, by_track, seg_window, with_position

KEEP = 0.6  # fixed value: weight of the past score
_ROWS = 512  # keeps 0.6 ** -rows within the range of a double


def _support() -> Monoid:
    """Score and misses over a stretch: (weight of the score before, score gained, whether there was
    a match, rows since the last match or since the start)."""

    def combine(p, q):
        return np.column_stack([p[:, 0] * q[:, 0], q[:, 0] * p[:, 1] + q[:, 1], np.maximum(p[:, 2], q[:, 2]),
                                np.where(q[:, 2] > 0, q[:, 3], p[:, 3] + q[:, 3])])

    return Monoid((1.0, 0.0, 0.0, 0.0), combine)


def semantic_state(associations: DataFrame, rows: int = _ROWS) -> DataFrame:
    """Score (0.4 * confidence + 0.6 * previous score) and consecutive misses per track.

    Input: trip_id, track_id, frame_id, ordinal, matched, det_confidence; rows of a track are
    taken in (frame_id, ordinal) order, in segments by frame. Within a segment the recursion is a
    running sum with weights 0.6 ** age; what a segment starts from comes from a scan over one row
    per segment, so the result is that of the recursion from the track's first row on. A segment
    holds at most ``rows`` frames (or is that of rows of ``by_track``, which stay); should it hold more than 512 rows (several a frame), every 512 make
    a stretch of their own, because 0.6 ** -age must stay within the range of a double.
    """
    keys, order = ["trip_id", "track_id"], ["frame_id", "ordinal"]
    # moved once: the ends of the stretches and the rows themselves are read from the same shuffle
    s = associations if SEG in associations.columns else by_track(associations, keys, rows=rows)
    at = F.row_number().over(seg_window(keys, order))
    # a stretch: rows of one segment in runs of ``_ROWS``
    part = F.floor((at - 1) / F.lit(_ROWS))
    s = s.withColumns({"_at": F.pmod(at - 1, F.lit(_ROWS)) + 1, "_part": part})
    w = Window.partitionBy(*keys, SEG, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(F.col("matched"), F.col("det_confidence")).otherwise(0.0) * F.pow(F.lit(1.0 / KEEP), F.col("_at"))
    s = s.withColumns({
        "_score": 0.4 * F.sum(value).over(w) * F.pow(F.lit(KEEP), F.col("_at")),
        "_hit": F.max(F.when(F.col("matched"), F.col("_at"))).over(w)})
    last = F.max(F.struct("_at", "_score", "_hit"))
    ends = s.groupBy(*keys, SEG, "_part").agg(last.alias("_l"))
    element = F.array(F.pow(F.lit(KEEP), F.col("_l._at")), F.col("_l._score"), F.col("_l._hit").isNotNull().cast("double"),
                      (F.col("_l._at") - F.coalesce("_l._hit", F.lit(0))).cast("double"))
    # segments and stretches in one order: a segment has fewer than 2^20 stretches
    place = F.col(SEG) * F.lit(1 << 20) + F.col("_part")
    many = ends.select(*keys, SEG, "_part", place.alias("_place"), element.alias("element"))
    dense = many.withColumn("_no", F.row_number().over(Window.partitionBy(*keys).orderBy("_place")).cast("long"))
    # up to 2^24 stretches of a track
    entry = scan(dense.select(*keys, "_no", "element"), keys, "_no", _support(), fan=256, levels=3)
    # the stretches of a segment as one list: the join then has the keys of the windows, and no row moves again
    entries = dense.join(entry, [*keys, "_no"]).groupBy(*keys, SEG).agg(F.collect_list(F.struct("_part", "entry")).alias("_entries"))
    own = F.filter("_entries", lambda e: e["_part"] == F.col("_part"))[0]["entry"]
    j = s.join(entries, [*keys, SEG]).withColumn("entry", own).drop("_entries")
    score = F.col("_score") + F.pow(F.lit(KEEP), F.col("_at")) * F.col("entry")[1]
    misses = F.col("_at") - F.coalesce("_hit", F.lit(0)) + F.when(F.col("_hit").isNull(), F.col("entry")[3]).otherwise(0.0)
    return j.withColumns({"score": score, "misses": misses.cast("long")}).select(*associations.columns, "score", "misses")


def suppressed(score_threshold, misses, fallback_depth_m) -> Column:
    """No support, enough misses in a row, and not close."""
    return (
        (F.col("depth_m") > fallback_depth_m) & (F.col("score") < score_threshold)
        & (F.col("misses") >= misses)
    )


def semantic_configs() -> list[tuple[str, float, int, float]]:
    """The 27 semantic settings in grid order, with their labels."""
    return [
        (f"s{s}_m{m}_d{d}", s, m, d)
        for s in SEMANTIC_AXES["score_threshold"] for m in SEMANTIC_AXES["misses"]
        for d in SEMANTIC_AXES["fallback_depth_m"]
    ]


def config_minima(states: DataFrame, guard=CURRENT_GUARD) -> DataFrame:
    """(trip_id, frame_id, minima): per frame the least TTC of guard-accepted candidates under the guard
    alone (first) and under each semantic setting; NULL where a setting keeps none.

    One pass over the candidates with partial minima; no candidate is multiplied by the settings.
    """
    ttc = F.col("candidate_ttc")
    least = [F.min(ttc)] + [F.min(F.when(~suppressed(s, m, d), ttc)) for _, s, m, d in semantic_configs()]
    kept = states.filter(guard_predicate(guard)).groupBy("trip_id", "frame_id").agg(*[c.alias(f"_{i}") for i, c in enumerate(least)])
    return kept.select("trip_id", "frame_id", F.array(*[f"_{i}" for i in range(len(least))]).alias("minima"))


def by_config(minima: DataFrame) -> DataFrame:
    """(config_id, trip_id, frame_id, predicted_ttc) of the settings that keep a candidate of a frame."""
    return minima.select("trip_id", "frame_id", F.posexplode("minima").alias("config_id", "predicted_ttc")).filter("predicted_ttc IS NOT NULL")


def fused_predictions(minima: DataFrame, frames: DataFrame) -> DataFrame:
    """(config_id, trip_id, frame_id, predicted_ttc) for every frame and setting: the least TTC of the
    accepted candidates, infinite where there is none."""
    none = F.array_repeat(F.lit(float("inf")), 1 + len(semantic_configs()))
    every = frames.select("trip_id", "frame_id").join(minima, ["trip_id", "frame_id"], "left")
    filled = F.coalesce(F.transform("minima", lambda x: F.coalesce(x, F.lit(float("inf")))), none)
    return every.select("trip_id", "frame_id", F.posexplode(filled).alias("config_id", "predicted_ttc"))


def candidate_diagnostics(states: DataFrame, score_threshold, misses, fallback_depth_m, guard=CURRENT_GUARD) -> DataFrame:
    """Why each candidate counts or not under one setting: its number in the trip (by frame, then
    order), match, score, misses, whether semantics suppress it, and whether guard and semantics accept it."""
    gone = suppressed(score_threshold, misses, fallback_depth_m)
    n = with_position(states, ["trip_id"], ["frame_id", "ordinal"], name="candidate_idx")
    return n.select("trip_id", "frame_id", "ordinal", "track_id", "candidate_idx", "depth_m", "matched", "score", "misses",
                    gone.alias("suppressed"), (guard_predicate(guard) & ~gone).alias("accepted"))
