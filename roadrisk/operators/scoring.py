"""Scores of predicted against true time-to-collision. All are one-pass sums per group."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadrisk.constants import CRITICAL_ZONE_TTC, DANGER_TTC, INF, SEVERE_TTC
from roadrisk.functions.ttc import (
    clipped_ttc, danger_outcome, finite, inverse_ttc, is_danger, is_finite,
)
from roadrisk.operators.fusion import suppressed
from roadrisk.operators.quantiles import exact_quantiles
from roadrisk.operators.sequence import run_starts


def outcome_counts(pred="predicted_ttc", truth="truth_ttc"):
    o = danger_outcome(pred, truth)
    return [F.count_if(o == name.upper()).alias(name) for name in ("tp", "fp", "fn", "tn")]


def danger_confusion(df: DataFrame, by, pred="predicted_ttc", truth="truth_ttc") -> DataFrame:
    return df.groupBy(*by).agg(*outcome_counts(pred, truth))


def score_sums(pred="predicted_ttc", truth="truth_ttc"):
    """The sums from which every score follows; they add up over any partition of frames."""
    p, t = F.col(pred), F.col(truth)
    critical = t < CRITICAL_ZONE_TTC
    return [
        F.count(F.lit(1)).alias("frames"), *outcome_counts(pred, truth),
        F.count_if(critical).alias("critical_frames"),
        F.sum(F.when(critical, F.abs(clipped_ttc(p) - t))).alias("critical_error"),
        F.sum(F.abs(inverse_ttc(p) - inverse_ttc(t))).alias("inverse_error"),
    ]


def scores_from_sums(df: DataFrame) -> DataFrame:
    """Add precision, recall, F1, critical MAE, inverse MAE and composite; drop the sums.

    Without a critical frame the MAE is NULL and adds nothing to the composite.
    """
    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(0.0)

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    zero = F.lit(0.0)
    df = df.withColumns({
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
        "mae_critical": F.try_divide("critical_error", "critical_frames"),
        "inverse_mae": F.try_divide("inverse_error", "frames"),
    })
    p, r = F.col("precision"), F.col("recall")
    df = df.withColumn("f1", ratio(2.0 * p * r, p + r))
    composite = (
        0.40 * F.coalesce(F.greatest(zero, 100.0 - 20.0 * F.col("mae_critical")), zero)
        + 30.0 * F.col("f1")
        + 0.30 * F.coalesce(F.greatest(zero, 100.0 - 200.0 * F.col("inverse_mae")), zero)
    )
    return df.withColumn("composite", composite).drop("critical_error", "inverse_error")


def ttc_score(df: DataFrame, by, pred="predicted_ttc", truth="truth_ttc") -> DataFrame:
    return scores_from_sums(df.groupBy(*by).agg(*score_sums(pred, truth)))


def pooled_score(df: DataFrame, by: str, label="ALL", pred="predicted_ttc", truth="truth_ttc") -> DataFrame:
    """Score per value of ``by`` and, in the same pass, over all frames together."""
    s = df.rollup(by).agg(F.grouping(by).alias("_all"), *score_sums(pred, truth))
    s = s.withColumn(by, F.when(F.col("_all") == 1, F.lit(label)).otherwise(F.col(by))).drop("_all")
    return scores_from_sums(s)


METRICS = ("f1", "composite", "mae_critical", "precision", "recall")


def macro_summary(scores: DataFrame, by=(), unit="trip_id") -> DataFrame:
    """Mean of per-trip scores, summed counts, best and worst trip by F1 (then by name)."""
    return scores.groupBy(*by).agg(
        *[F.avg(m).alias(m) for m in METRICS],
        *[F.sum(c).alias(f"{c}_sum") for c in ("tp", "fp", "fn")],
        F.min(F.struct("f1", unit))[unit].alias("worst_trip"),
        F.min(F.struct(-F.col("f1"), unit))[unit].alias("best_trip"),
    )


def confusion_rollup(df: DataFrame, variant="variant", unit="trip_id",
                     pred="predicted_ttc", truth="truth_ttc") -> DataFrame:
    """Counts per variant and trip plus one OVERALL row per variant."""
    r = df.groupBy(variant, unit).agg(
        *outcome_counts(pred, truth), F.count_if(is_finite(pred)).alias("finite_predictions"))
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn", "finite_predictions")]
    r = r.groupingSets([[variant, unit], [variant]], variant, unit).agg(F.grouping(unit).alias("_all"), *sums)
    r = r.withColumn(unit, F.when(F.col("_all") == 1, F.lit("OVERALL")).otherwise(F.col(unit))).drop("_all")
    p, q = F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")
    return r.withColumns({
        "precision": F.when(p > 0, F.col("tp") / p).otherwise(0.0),
        "recall": F.when(q > 0, F.col("tp") / q).otherwise(0.0),
        "f1": F.when(p + q > 0, 2.0 * F.col("tp") / (p + q)).otherwise(0.0),
    })


def gt_distribution(frames: DataFrame, truth="min_ttc", unit="trip_id") -> DataFrame:
    """Frames by severity and danger episodes, per trip and in total."""
    t = F.col(truth)
    counts = frames.groupBy(unit).agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(is_finite(truth)).alias("finite"),
        F.count_if(t < CRITICAL_ZONE_TTC).alias("below_3s"), F.count_if(t < DANGER_TTC).alias("below_2s"),
        F.count_if(t < SEVERE_TTC).alias("below_1_5s"), F.min(finite(truth)).alias("lowest_ttc"),
    )
    starts = run_starts(frames.filter(is_danger(truth)).select(unit, "frame_id"), [unit], "frame_id")
    episodes = starts.filter(F.col("run_start") == F.col("frame_id")).groupBy(unit).agg(
        F.count(F.lit(1)).alias("episodes"))
    per = counts.join(episodes, unit, "left").na.fill(0, ["episodes"])
    sums = [F.sum(c).alias(c) for c in ("frames", "finite", "below_3s", "below_2s", "below_1_5s", "episodes")]
    out = per.rollup(unit).agg(F.grouping(unit).alias("_all"), *sums, F.min("lowest_ttc").alias("lowest_ttc"))
    return out.withColumn(unit, F.when(F.col("_all") == 1, F.lit("TOTAL")).otherwise(F.col(unit))).drop("_all")


def latency_summary(runtime: DataFrame, by=(), suffix="_ms") -> DataFrame:
    """p50, p95, p99, mean, min, max of every column ending in ``suffix``.

    Negative or non-finite times are counted as rejected and left out.
    """
    stages = [c for c in runtime.columns if c.endswith(suffix)]
    long = runtime.unpivot(list(by), stages, "stage", "ms").withColumn("ms", F.col("ms").cast("double"))
    good = is_finite("ms") & (F.col("ms") >= 0)
    n, v = F.col("_n"), F.col("ms")
    stats = exact_quantiles(
        long.filter(good), [*by, "stage"], "ms", {"p50": 0.50, "p95": 0.95, "p99": 0.99},
        extra=[(F.sum(v * n) / F.sum(n)).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"),
               F.sum(n).alias("samples")],
    )
    bad = long.groupBy(*by, "stage").agg(F.count_if(~F.coalesce(good, F.lit(False))).alias("rejected"))
    return bad.join(stats, [*by, "stage"], "left").na.fill(0, ["samples"])


def frame_min_ttc(accepted: DataFrame, frames: DataFrame, ttc="candidate_ttc", name="predicted_ttc") -> DataFrame:
    """Least accepted TTC per frame; infinity for frames without one."""
    keys = ["trip_id", "frame_id"]
    least = accepted.groupBy(*keys).agg(F.min(ttc).alias(name))
    return frames.join(least, keys, "left").withColumn(name, F.coalesce(name, F.lit(INF)))


def select_min_ttc(tracks: DataFrame, min_confidence=0.55, min_closing=0.3, max_closing=40.0,
                   max_depth=INF, max_residual=INF, min_depth_confidence=None, semantic=None) -> DataFrame:
    """Per frame the accepted track with the least TTC; the first in order wins a tie.

    With ``min_depth_confidence`` the column depth_confidence is looked at, too; ``semantic`` (score
    threshold, misses, fallback depth) leaves out tracks (columns score, misses) without semantic support.
    """
    ok = (
        (F.col("confidence") >= min_confidence)
        & F.col("closing_mps").between(min_closing, max_closing)
        & (F.col("depth_m") <= max_depth) & (F.col("residual_m") <= max_residual)
        & is_finite("candidate_ttc")
    )
    if min_depth_confidence is not None:
        ok = ok & (F.col("depth_confidence") >= min_depth_confidence)
    if semantic is not None:
        ok = ok & ~suppressed(*semantic)
    best = F.min(F.struct("candidate_ttc", "ordinal", "track_id", "confidence", "closing_mps"))
    return (
        tracks.filter(ok).groupBy("trip_id", "frame_id").agg(best.alias("b"))
        .select("trip_id", "frame_id", F.col("b.candidate_ttc").alias("ttc"), "b.track_id",
                "b.confidence", F.col("b.closing_mps").alias("closing_mps"))
    )


def pair_predictions(a: DataFrame, b: DataFrame, truth: DataFrame) -> DataFrame:
    """Two sources and the truth per frame, with the parts that are missing named.

    Inputs have (trip_id, frame_id) and one value: a_ttc, b_ttc, truth_ttc.
    """
    keys = ["trip_id", "frame_id"]
    joined = (
        a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), keys, "full_outer")
        .join(truth.withColumn("_t", F.lit(True)), keys, "full_outer")
    )
    gaps = F.array_compact(F.array(*[
        F.when(F.col(c).isNull(), F.lit(n)) for c, n in (("_a", "a"), ("_b", "b"), ("_t", "truth"))]))
    return joined.withColumn("missing", F.array_join(gaps, ",")).drop("_a", "_b", "_t")


def compare_runs(ref: DataFrame, cand: DataFrame, value="ttc", atol=1e-6, by=("trip_id",)) -> DataFrame:
    """Do two runs agree: same frames, same infinities, values within ``atol``?"""
    keys = ["trip_id", "frame_id"]
    j = (
        ref.select(*keys, F.col(value).alias("_r")).withColumn("_in_r", F.lit(True))
        .join(cand.select(*keys, F.col(value).alias("_c")).withColumn("_in_c", F.lit(True)), keys, "full_outer")
    )
    both = F.col("_in_r").isNotNull() & F.col("_in_c").isNotNull()
    rf, cf = is_finite("_r"), is_finite("_c")
    gap = F.when(both & rf & cf, F.abs(F.col("_r") - F.col("_c")))
    return j.groupBy(*by).agg(
        F.count_if(both).alias("compared"), F.count_if(~both).alias("unpaired"),
        F.count_if(both & (rf != cf)).alias("finite_mismatch"),
        F.count_if(gap > atol).alias("value_mismatch"),
        F.max(gap).alias("largest_gap"),
    ).withColumn("equal", F.col("unpaired") + F.col("finite_mismatch") + F.col("value_mismatch") == 0)


def repeat_determinism(runs: DataFrame, value: str, by=("trip_id",)) -> DataFrame:
    """Repeats 2..n against repeat 1 of the same frame and item; infinity equals infinity."""
    keys = [c for c in runs.columns if c not in ("repeat", value)]
    first = runs.filter("repeat = 1").select(*keys, F.col(value).alias("_first"))
    j = runs.filter("repeat > 1").join(first, keys, "left")
    same = F.coalesce(F.col(value) == F.col("_first"), F.lit(False))
    return j.groupBy(*by).agg(F.count(F.lit(1)).alias("compared"), F.count_if(~same).alias("mismatches"))
