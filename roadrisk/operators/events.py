"""Runs of true rows, and events built from them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadrisk.constants import FRAME_PERIOD_S, RISK_PRESETS, SEVERE_TTC
from roadrisk.functions.ttc import finite, is_danger
from roadrisk.operators.intervals import BUCKET, points_in_runs
from roadrisk.operators.scoring import score_sums, scores_from_sums
from roadrisk.operators.sequence import previous, run_starts, with_position


def count_episodes(df: DataFrame, active: Column, keys=("trip_id",), order="frame_id") -> DataFrame:
    """Number of rising edges of a condition; NULL counts as false."""
    f = df.select(*keys, order, F.coalesce(active, F.lit(False)).alias("_on"))
    f = previous(f, list(keys), [order], {"_was": "_on"}, order)
    edge = F.col("_on") & ~F.coalesce("_was", F.lit(False))
    return f.groupBy(*keys).agg(F.count_if(edge).alias("episodes"))


def runs(df: DataFrame, active: Column, merge_gap=0, keys=("trip_id",), order="frame_id", aggs=()) -> DataFrame:
    """Runs of active rows, merged over at most ``merge_gap`` inactive rows (row positions)."""
    p = with_position(df, list(keys), [order], order)
    on = p.filter(F.coalesce(active, F.lit(False)))
    on = run_starts(on, list(keys), "position", merge_gap)
    return on.groupBy(*keys, "run_start").agg(
        F.max("position").alias("run_end"), F.count(F.lit(1)).alias("active_rows"),
        F.min(order).alias(f"first_{order}"), F.max(order).alias(f"last_{order}"), *aggs)


def frame_runs(on: DataFrame, merge_gap, keys=("trip_id",), aggs=()) -> DataFrame:
    """Runs over frame numbers instead of row positions; ``on`` holds active rows only."""
    r = run_starts(on, list(keys), "frame_id", merge_gap)
    return r.groupBy(*keys, F.col("run_start").alias("start_frame")).agg(
        F.max("frame_id").alias("end_frame"), F.count(F.lit(1)).alias("frames"), *aggs)


def error_episodes(df: DataFrame) -> DataFrame:
    """False-alarm and missed-danger episodes with the frame that shows each best.

    Neighbouring error frames at most two apart belong together. Input: trip_id, frame_id,
    predicted_ttc, truth_ttc, union_source; with selected_track_id also the track selected then.
    """
    extra = [c for c in ("selected_track_id",) if c in df.columns]
    p, t = is_danger("predicted_ttc"), is_danger("truth_ttc")
    err = df.withColumn("error_type", F.when(p & ~t, "FP").when(~p & t, "FN")).filter("error_type is not null")
    err = run_starts(err, ["trip_id", "error_type"], "frame_id", 1, "start_frame")
    keys = ["trip_id", "error_type", "start_frame"]
    lead = F.when(F.col("error_type") == "FP", F.col("predicted_ttc")).otherwise(F.col("truth_ttc"))
    shown = F.min(F.struct(lead.alias("v"), F.col("frame_id").alias("f"), "predicted_ttc", "truth_ttc", *extra))
    sources = err.groupBy(*keys, "union_source").agg(
        F.count(F.lit(1)).alias("n"), F.min("frame_id").alias("first"), F.max("frame_id").alias("last"),
        shown.alias("s"))
    return sources.groupBy(*keys).agg(
        F.max("last").alias("end_frame"), F.sum("n").alias("error_frames"),
        F.round(F.sum("n") * FRAME_PERIOD_S, 2).alias("duration_s"), F.min("s").alias("s"),
        F.min(F.struct(-F.col("n"), "first", "union_source"))["union_source"].alias("dominant_source"),
    ).select(*keys, "end_frame", "error_frames", "duration_s", F.col("s.f").alias("representative_frame"),
             F.col("s.predicted_ttc").alias("predicted_ttc"), F.col("s.truth_ttc").alias("truth_ttc"),
             "dominant_source", *[F.col(f"s.{c}").alias(c) for c in extra])


def lost_danger_episodes(df: DataFrame, kept="a_ttc", lost="b_ttc", truth="truth_ttc") -> DataFrame:
    """Runs of true danger that source ``kept`` reports and source ``lost`` does not."""
    gone = is_danger(truth) & is_danger(kept) & ~is_danger(lost)
    return runs(df, gone, 0, aggs=[F.min(kept).alias("kept_ttc_min"), F.min(lost).alias("lost_ttc_min")])


def collapse_ranges(ids: DataFrame, keys=("trip_id",), col="frame_id") -> DataFrame:
    """Whole numbers as text such as ``1-3;7;9-10``, one row per key."""
    r = frame_runs(ids.select(*keys, F.col(col).alias("frame_id")).distinct(), 0, keys)
    a, b = F.col("start_frame"), F.col("end_frame")
    text = F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a, b))
    parts = F.array_sort(F.collect_list(F.struct(a.alias("a"), text.alias("t"))))
    return r.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["t"]), ";").alias("ranges"))


def risk_events(states: DataFrame, merge_gap=None, keys=("trip_id", "preset")) -> DataFrame:
    """Runs of HIGH_RISK frames, merged over short gaps, as numbered events.

    ``merge_gap`` is a number or None: then each preset's own gap applies. Gap frames count
    for the least TTC and the length. ``states`` is read several times: cut it first.
    """
    keys = list(keys)
    on = states.filter("state = 'HIGH_RISK'").select(*keys, "position")
    gap = F.lit(merge_gap) if merge_gap is not None else F.create_map(
        *[F.lit(x) for n, v in RISK_PRESETS.items() for x in (n, v[5])])[F.col("preset")]
    spans = run_starts(on, keys, "position", gap).groupBy(*keys, "run_start").agg(
        F.max("position").alias("run_end"))
    inside = points_in_runs(states, spans, keys, "position", ("run_start", "run_end"))
    ev = inside.groupBy(*keys, "run_start", "run_end").agg(
        F.min("frame_id").alias("start_frame"), F.max("frame_id").alias("end_frame"),
        F.min(finite("ttc")).alias("_least"))
    ev = with_position(ev, keys, ["run_start"], "run_start", "event_no")
    n = F.col("run_end") - F.col("run_start") + 1
    least = F.coalesce(F.col("_least"), F.lit(3.0))
    return ev.select(
        *keys, (F.col("event_no") + 1).alias("event_no"), "start_frame", "end_frame",
        F.col("run_start").alias("start_pos"), F.col("run_end").alias("end_pos"),
        F.greatest(F.lit(0.0), least).alias("min_ttc_sec"),
        F.when(least < SEVERE_TTC, "CRITICAL").otherwise("DANGER").alias("severity"),
        F.least(F.lit(1.0), n / 7.0).alias("event_quality"),
        F.when(n >= 7, "HIGH").when(n >= 3, "MEDIUM").otherwise("LOW").alias("confidence_level"),
    )


def event_overlap(truth_runs: DataFrame, pred_runs: DataFrame, keys=("trip_id",)) -> DataFrame:
    """Both kinds of runs with what overlaps them.

    Inputs carry ``keys``, start_pos, end_pos; runs of one kind and key are disjoint. Output: kind
    (truth or predicted), span, overlaps, and for truth the onset delay in frames and the extra
    fragments. Each input is read once: runs meet in buckets of positions, which hold at most
    BUCKET runs of a kind, and an overlap counts in the first bucket that both reach.
    """
    keys = list(keys)

    def spans(df, kind):
        r = F.struct(F.lit(kind).alias("kind"), F.col("start_pos").cast("long").alias("s"), F.col("end_pos").cast("long").alias("e"))
        at = F.sequence(F.floor(F.col("start_pos") / BUCKET), F.floor(F.col("end_pos") / BUCKET))
        return df.select(*keys, r.alias("r"), F.explode(at).alias("_bk"))

    met = spans(truth_runs, "truth").unionByName(spans(pred_runs, "predicted")).groupBy(*keys, "_bk").agg(F.collect_list("r").alias("_all"))
    x = F.col("x")
    others = F.filter("_all", lambda y: (y["kind"] != x["kind"]) & (y["s"] <= x["e"]) & (x["s"] <= y["e"])
                      & (F.floor(F.greatest(y["s"], x["s"]) / BUCKET) == F.col("_bk")))
    each = met.select(*keys, "_bk", "_all", F.explode("_all").alias("x")).select(*keys, "x.*", others.alias("_o"))
    out = each.groupBy(*keys, "kind", "s", "e").agg(
        F.sum(F.size("_o")).alias("overlaps"), F.min(F.array_min(F.transform("_o", lambda y: y["s"]))).alias("_first"))
    is_truth = F.col("kind") == "truth"
    return out.select(
        *keys, "kind", F.col("s").alias("start_pos"), F.col("e").alias("end_pos"), "overlaps",
        F.when(is_truth & (F.col("overlaps") > 0), F.greatest(F.lit(0), F.col("_first") - F.col("s"))).alias("onset_delay"),
        F.when(is_truth, F.greatest(F.lit(0), F.col("overlaps") - 1)).otherwise(F.lit(0)).alias("fragments"))


def event_metrics(states: DataFrame, truth: DataFrame, keys=("trip_id", "preset"), events=None) -> DataFrame:
    """Event and alert scores per key. ``truth`` has trip_id, frame_id, truth_ttc."""
    keys = list(keys)
    events = risk_events(states) if events is None else events
    unit = [k for k in keys if k != "preset"]
    true_runs = runs(truth, is_danger("truth_ttc"), 2, unit).select(
        *unit, F.col("run_start").alias("start_pos"), F.col("run_end").alias("end_pos"))
    high = F.col("state") == "HIGH_RISK"
    alert = states.join(truth.select(*unit, "frame_id", "truth_ttc"), [*unit, "frame_id"]).withColumn(
        "alert_ttc", F.when(high, F.lit(1.0)).otherwise(F.lit(float("inf"))))
    sums = alert.groupBy(*keys).agg(*score_sums("alert_ttc", "truth_ttc"))
    s = scores_from_sums(sums).select(
        *keys, F.col("fp").alias("false_high_frames"), (F.col("tp") + F.col("fp")).alias("high_risk_frames"),
        F.col("f1").alias("alert_f1"), F.col("precision").alias("alert_precision"),
        F.col("recall").alias("alert_recall"))
    # the keys are those of the sums, so the states are not read again for their names
    o = event_overlap(sums.select(*keys).join(true_runs, unit), events, keys)
    is_t, hit = F.col("kind") == "truth", F.col("overlaps") > 0
    counts = o.groupBy(*keys).agg(
        F.count_if(is_t).alias("truth_events"), F.count_if(~is_t).alias("predicted_events"),
        F.count_if(is_t & hit).alias("event_tp"), F.count_if(~is_t & hit).alias("_pred_hit"),
        F.sum("fragments").alias("fragmentation"), F.avg("onset_delay").alias("_delay"))
    out = s.join(counts, keys, "left").na.fill(
        0, ["truth_events", "predicted_events", "event_tp", "_pred_hit", "fragmentation"])
    tn, pn = F.col("truth_events"), F.col("predicted_events")
    return out.select(
        *keys, "truth_events", "predicted_events", "event_tp", (pn - F.col("_pred_hit")).alias("event_fp"),
        (tn - F.col("event_tp")).alias("event_fn"),
        F.when(tn > 0, F.col("event_tp") / tn).otherwise(1.0).alias("event_recall"),
        F.when(pn > 0, F.col("_pred_hit") / pn).when(tn > 0, 0.0).otherwise(1.0).alias("event_precision"),
        "fragmentation", F.coalesce("_delay", F.lit(0.0)).alias("mean_onset_delay_frames"),
        "false_high_frames", (F.col("false_high_frames") * FRAME_PERIOD_S).alias("false_event_duration_sec"),
        "high_risk_frames", "alert_f1", "alert_precision", "alert_recall")


def hysteresis_compare(metrics: DataFrame) -> DataFrame:
    """One row per preset: macro averages and totals over trips."""
    return metrics.groupBy("preset").agg(
        F.avg("event_recall").alias("macro_event_recall"), F.avg("event_precision").alias("macro_event_precision"),
        F.avg("alert_f1").alias("macro_alert_f1"),
        F.sum("false_event_duration_sec").alias("total_false_event_duration_sec"),
        F.sum("predicted_events").alias("total_predicted_events"),
        F.sum("fragmentation").alias("total_fragmentation"))
