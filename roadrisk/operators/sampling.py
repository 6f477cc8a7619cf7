"""Deterministic samples for review. Row numbers come from ``with_position``; no sample reads
a whole trip in one task."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadrisk.constants import DANGER_TTC
from roadrisk.functions.ttc import danger_outcome, is_finite
from roadrisk.operators.association import KEYS
from roadrisk.operators.sequence import with_group_size, with_position


def pick_cases(df: DataFrame, by=("trip_id",), pred="predicted_ttc", truth="truth_ttc") -> DataFrame:
    """The case that shows each outcome best, per trip.

    FN: missing prediction first, then the least truth. FP: truth infinite first, then the
    least prediction. TP: least error. The lowest frame wins ties.
    """
    p, t = F.col(pred), F.col(truth)
    o = danger_outcome(pred, truth)
    lead = F.when(o == "FN", is_finite(p).cast("int")).when(o == "FP", is_finite(t).cast("int")).otherwise(0)
    then = F.when(o == "FN", t).when(o == "FP", p).otherwise(F.abs(p - t))
    d = df.withColumn("outcome", o).filter("outcome <> 'TN'")
    best = d.groupBy(*by, "outcome").agg(F.min(F.struct(
        lead.alias("_1"), then.alias("_2"), "frame_id", F.col(pred).alias("p"), F.col(truth).alias("t"))).alias("b"))
    return best.select(*by, "outcome", "b.frame_id", F.col("b.p").alias(pred), F.col("b.t").alias(truth))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows in an order (kept per task before they meet)."""
    return df.orderBy(*order).limit(k)


def _numbered(df, keys, order):
    return with_group_size(with_position(df, keys, order, order[0]), keys, "_n")


def evenly_spaced(df: DataFrame, k: int, keys=("trip_id",), order=("frame_id",)) -> DataFrame:
    """k rows spread over each group, ends included; all rows of smaller groups.

    Row i * (n - 1) / (k - 1), rounded half to even; k = 1 takes the first row.
    """
    p = _numbered(df, list(keys), list(order))
    n, i = F.col("_n"), F.col("position")
    # a row is chosen if one of the (at most two) steps around it rounds to it
    step = (n - 1) / F.lit(max(k - 1, 1))
    near = F.floor(i / F.when(n > 1, step).otherwise(1.0))
    hit = F.lit(False)
    for d in (-1, 0, 1, 2):
        j = near + d
        hit = hit | ((j >= 0) & (j < k) & (F.bround(j * (n - 1) / F.lit(max(k - 1, 1)), 0) == i))
    return p.filter((n <= k) | hit).drop("_n", "position")


def bin_midpoints(df: DataFrame, k: int, keys=("trip_id",), order=("frame_id",)) -> DataFrame:
    """Row ((2i + 1) * n) div (2k) of each group, i = 0 .. k-1, numbered ``sample_no``."""
    p = _numbered(df, list(keys), list(order))
    n, i = F.col("_n"), F.col("position")
    # the i-th midpoint falls on position p when floor inverts: try the two candidates
    near = F.floor(i * F.lit(k) / n).cast("bigint")
    pick = F.lit(None).cast("bigint")
    for d in (-1, 0, 1):
        j = near + d
        pick = F.coalesce(pick, F.when((j >= 0) & (j < k) & (F.floor((2 * j + 1) * n / F.lit(2 * k)) == i), j))
    return p.withColumn("sample_no", pick).filter("sample_no is not null").drop("_n", "position")


def stride_sample(df: DataFrame, stride: int, keys=("trip_id",), order=("frame_id",)) -> DataFrame:
    """Every ``stride``-th row of each group, beginning with the first."""
    return with_position(df, list(keys), list(order), order[0]).filter(
        F.col("position") % stride == 0).drop("position")


def exclude(df: DataFrame, chosen: DataFrame, keys=KEYS) -> DataFrame:
    return df.join(chosen.select(*keys), list(keys), "left_anti")


def interleave(samples: DataFrame) -> DataFrame:
    """Order: sample number first, trip second."""
    return samples.orderBy("sample_no", "trip_id")


def budget_sample(danger: DataFrame, other: DataFrame, budget: int, keys=("trip_id",)) -> DataFrame:
    """All danger rows (S1), and strided other rows (S2) cut off where ``budget`` is reached."""
    keys = list(keys)
    n1 = danger.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n1"))
    p = with_group_size(with_position(other, keys, ["frame_id"]), keys, "_n2").join(n1, keys, "left")
    left = F.greatest(F.lit(budget) - F.coalesce("_n1", F.lit(0)), F.lit(0))
    stride = F.greatest(F.lit(1), F.floor(F.col("_n2") / F.greatest(left, F.lit(1))))
    s2 = p.filter((F.col("position") % stride == 0) & (F.floor(F.col("position") / stride) < left)).select(*other.columns, F.lit("S2").alias("stratum"))
    return danger.withColumn("stratum", F.lit("S1")).unionByName(s2)


def review_sample(df: DataFrame, per_stratum: int, stratum: Column) -> DataFrame:
    """``per_stratum`` evenly spaced rows of each trip and stratum."""
    return evenly_spaced(df.withColumn("stratum", stratum).filter("stratum is not null"), per_stratum,
                         ("trip_id", "stratum"))


def anchored_sample(df: DataFrame, k: int, anchor: Column) -> DataFrame:
    """k rows per trip: anchors first, filled from the rest when there are too few."""
    anchors = evenly_spaced(df.filter(anchor), k)
    have = anchors.groupBy("trip_id").agg(F.count(F.lit(1)).alias("_have"))
    rest = exclude(df, anchors).join(have, "trip_id", "left")
    # the number still missing differs per trip, so the spacing is computed per row
    p = _numbered(rest, ["trip_id"], ["frame_id"])
    m = F.greatest(F.lit(k) - F.coalesce("_have", F.lit(0)), F.lit(0))
    n, i = F.col("_n"), F.col("position")
    div = F.greatest(m - 1, F.lit(1))
    near = F.floor(i * div / F.greatest(n - 1, F.lit(1)))
    hit = F.lit(False)
    for d in (-1, 0, 1, 2):
        j = near + d
        hit = hit | ((j >= 0) & (j < m) & (F.bround(j * (n - 1) / div, 0) == i))
    fill = p.filter((m > 0) & ((n <= m) | hit)).select(*df.columns, F.lit("fill").alias("stratum"))
    return anchors.withColumn("stratum", F.lit("anchor")).unionByName(fill)


def leakage_sample(df: DataFrame, pred="predicted_ttc", truth="truth_ttc") -> DataFrame:
    """All reported dangers, marked as false alert or true-danger anchor."""
    d = df.filter(F.col(pred) < DANGER_TTC)
    return d.withColumn("stratum", F.when(F.col(truth) < DANGER_TTC, "true_danger_anchor").otherwise("false_alert"))


def with_box_index(df: DataFrame, keys=KEYS, order=("ordinal",)) -> DataFrame:
    """Number the boxes of each frame from 1."""
    from pyspark.sql import Window

    return df.withColumn("box_index", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def blocked_folds(df: DataFrame, n=4, keys=("trip_id",), order=("frame_id",)) -> DataFrame:
    """Number 1..n of n contiguous blocks per group; the first blocks are longer by one."""
    p = _numbered(df, list(keys), list(order))
    size, extra = F.floor(F.col("_n") / n), F.col("_n") % n
    long_rows = extra * (size + 1)
    i = F.col("position")
    fold = F.when(i < long_rows, F.floor(i / (size + 1))).otherwise(
        extra + F.floor((i - long_rows) / F.greatest(size, F.lit(1))))
    return p.withColumn("fold", (fold + 1).cast("bigint")).drop("_n", "position")


def screening_frames(df: DataFrame, truth="truth_ttc", near_s=3.0, every=15) -> DataFrame:
    """Frames worth a look: those with a true TTC below ``near_s``, and a regular grid of the others."""
    return df.filter(F.coalesce(F.col(truth) < near_s, F.lit(False)) | (F.col("frame_id") % every == 0))
