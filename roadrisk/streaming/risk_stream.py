"""Streaming forms of the stateful operators; results equal the batch operators' rows."""
from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadrisk.constants import DEFAULT_PRESET, SEVERE_TTC
from roadrisk.functions import geometry as G
from roadrisk.functions.ttc import conservative_union, is_finite, ttc_band
from roadrisk.operators.motion import filter_step, motion_of
from roadrisk.operators.risk_states import REASONS, SYMBOLS, automaton, preset_of, symbol
from roadrisk.operators.scoring import score_sums, scores_from_sums
from roadrisk.operators.tracking import PLANAR_FIELDS, frame_tracks, planar_row, planar_step
from roadrisk.streaming.state import IDLE_MS, ordered_state


def risk_states_stream(stream: DataFrame, preset=DEFAULT_PRESET, delay="2 seconds", late=False, idle_ms=IDLE_MS) -> DataFrame:
    """Debounced states of a frame stream: trip_id, frame_id, event_time, ttc, reliable."""
    states, nxt, why = automaton(preset_of(preset))

    def step(s, row):
        x = int(row["sym"])
        t = int(nxt[x, s[0]])
        ttc = row["ttc"]
        return (t,), (math.inf if ttc is None else float(ttc), SYMBOLS[x], states[t][0], REASONS[int(why[x, s[0]])])

    s = stream.withColumns({"sym": symbol("ttc", "reliable"), "ttc": F.col("ttc")})
    return ordered_state(s, ["trip_id"], ["sym", "ttc"], (0,), "s int", step, "ttc double, raw_band string, state string, reason string", delay,
                         late=late, idle_ms=idle_ms)


_EVENT = ("at", "no", "start_pos", "start_frame", "end_pos", "end_frame", "low", "gap")


def risk_events_stream(states: DataFrame, merge_gap=4, delay="2 seconds", idle_ms=IDLE_MS) -> DataFrame:
    """Events of a stream of states (trip_id, frame_id, event_time, ttc, state), with the columns of the
    batch operator. An event is given out when more than ``merge_gap`` frames have followed it, or
    when its trip has been silent for ``idle_ms``; the gap frames inside it count for its least TTC."""
    def least(*values):
        known = [v for v in values if v is not None and math.isfinite(v)]
        return min(known) if known else None

    def told(s):
        n, low = s["end_pos"] - s["start_pos"] + 1, 3.0 if s["low"] is None else s["low"]
        return (s["no"], s["start_frame"], s["end_frame"], s["start_pos"], s["end_pos"], max(0.0, low), "CRITICAL" if low < SEVERE_TTC else "DANGER",
                min(1.0, n / 7.0), "HIGH" if n >= 7 else "MEDIUM" if n >= 3 else "LOW")

    def step(state, row):
        s = dict(zip(_EVENT, state))
        at, frame, ttc, out = s["at"], row["frame_id"], row["ttc"], None
        s["at"] = at + 1
        if row["state"] == "HIGH_RISK":
            if s["start_pos"] is not None:
                s.update(end_pos=at, end_frame=frame, low=least(s["low"], s["gap"], ttc))
            else:
                s.update(start_pos=at, start_frame=frame, end_pos=at, end_frame=frame, low=least(ttc), no=s["no"] + 1)
            s["gap"] = None
        elif s["start_pos"] is not None:
            if at - s["end_pos"] > merge_gap:
                out = told(s)
                s.update(dict.fromkeys(_EVENT[2:]))
            else:
                s["gap"] = least(s["gap"], ttc)
        return tuple(s.values()), out

    e = ordered_state(
        states, ["trip_id"], ["ttc", "state"], (0, 0, *[None] * 6), ", ".join(f"{c} {'double' if c in ('low', 'gap') else 'bigint'}" for c in _EVENT), step,
        "event_no bigint, start_frame bigint, end_frame bigint, start_pos bigint, end_pos bigint, min_ttc_sec double, severity string, "
        "event_quality double, confidence_level string", delay,
        finish=lambda s: told(dict(zip(_EVENT, s))) if s[2] is not None else None, idle_ms=idle_ms)
    return e.drop("frame_id")


def kalman_stream(stream: DataFrame, delay="2 seconds", idle_ms=IDLE_MS) -> DataFrame:
    """Depth filter per track of a stream: trip_id, track_id, frame_id, event_time, t_sec, depth_m, sigma_m."""
    def step(s, row):
        s = filter_step(s, row["t_sec"], row["depth_m"], row["sigma_m"])
        return tuple(s), (float(s[1]), *[float(v) for v in motion_of(s, row["t_sec"])])

    return ordered_state(stream, ["trip_id", "track_id"], ["t_sec", "depth_m", "sigma_m"], None,
                         ", ".join(f"{c} double" for c in ("t", "x", "v", "pxx", "pxv", "pvv", "ema")) + ", n bigint", step,
                         "distance_m double, closing_mps double, ttc double, residual_m double", delay, idle_ms=idle_ms)


def planar_stream(stream: DataFrame, delay="2 seconds", idle_ms=IDLE_MS) -> DataFrame:
    """Planar filter per track of a stream: trip_id, track_id, frame_id, event_time, t_sec, forward_m,
    lateral_m, speed_mps, yaw. Observations without a distance have no noise and are left out."""
    noise = G.box_depth_sigmas("forward_m")
    s = stream.withColumns({"s0": noise["forward"], "s1": noise["lateral"]}).filter("s0 IS NOT NULL")

    def step(state, row):
        before = None if state is None else (state[0], np.array(state[1]), np.array(state[2]).reshape(4, 4))
        (t, x, p), ok, d2 = planar_step(before, row["t_sec"], (row["forward_m"], row["lateral_m"]), row["speed_mps"], row["yaw"], (row["s0"], row["s1"]))
        return (float(t), [float(v) for v in x], [float(v) for v in p.ravel()]), planar_row(x, p, ok, d2)

    fields = "accepted boolean, " + ", ".join(f"{n} double" for n in PLANAR_FIELDS[1:])
    return ordered_state(s, ["trip_id", "track_id"], ["t_sec", "forward_m", "lateral_m", "speed_mps", "yaw", "s0", "s1"], None,
                         "t double, x array<double>, p array<double>", step, fields, delay, idle_ms=idle_ms)


def tracks_stream(components: DataFrame, max_missed=3, delay="2 seconds", idle_ms=IDLE_MS) -> DataFrame:
    """Tracks of a stream of components (trip_id, frame_id, ordinal, event_time, box, depth_m): ordinal,
    track_id, hits of every component, numbered as by ``track_components``."""
    s = components.select("trip_id", "frame_id", "ordinal", "event_time", F.col("depth_m").cast("double").alias("depth_m"), "box.*",
                          *[x.alias(n) for x, n in zip(G.centre("box"), ("cx", "cy"))])

    def step(state, rows):
        tracks, made, last = (json.loads(state[0]), state[1], state[2]) if state else ([], 0, None)
        frame = rows[0]["frame_id"]
        tracks, made, found = frame_tracks(tracks, made, rows, 0 if last is None else frame - last - 1, max_missed)
        return (json.dumps(tracks), made, frame), [(c["ordinal"], k, hits) for c, k, hits in found]

    return ordered_state(s, ["trip_id"], ["x0", "y0", "x1", "y1", "cx", "cy", "depth_m"], None, "tracks string, made bigint, last bigint", step,
                         "ordinal bigint, track_id bigint, hits bigint", delay, order=("frame_id", "ordinal"), idle_ms=idle_ms, whole_frames=True)


def semantic_stream(stream: DataFrame, delay="2 seconds", idle_ms=IDLE_MS) -> DataFrame:
    """Semantic score and misses per track of a stream: ..., matched, det_confidence."""
    def step(s, row):
        hit = bool(row["matched"])
        score = 0.4 * (float(row["det_confidence"]) if hit else 0.0) + 0.6 * s[0]
        misses = 0 if hit else s[1] + 1
        return (score, misses), (score, misses)

    return ordered_state(stream, ["trip_id", "track_id"], ["matched", "det_confidence"], (0.0, 0), "score double, misses bigint", step,
                         "score double, misses bigint", delay, idle_ms=idle_ms)


def paired_stream(classical: DataFrame, detector: DataFrame, delay="2 seconds", apart="5 seconds") -> DataFrame:
    """The conservative union of two live sources: a stream-stream join on trip and frame.

    classical, detector: trip_id, frame_id, event_time, classical_ttc or detector_ttc. Both are
    watermarked, and rows of one frame lie at most ``apart``, so that the waiting rows of either side are
    bounded. A frame of one source alone comes out once the watermark has passed it, with the
    source that is missing named; its ttc is that of the other source. Repeated frames count once.
    """
    a = classical.select("trip_id", "frame_id", F.col("event_time").alias("a_time"), "classical_ttc").withWatermark("a_time", delay)
    b = detector.select(F.col("trip_id").alias("b_trip"), F.col("frame_id").alias("b_frame"), F.col("event_time").alias("b_time"), "detector_ttc").withWatermark("b_time", delay)
    a, b = a.dropDuplicatesWithinWatermark(["trip_id", "frame_id"]), b.dropDuplicatesWithinWatermark(["b_trip", "b_frame"])
    near = F.expr(f"b_trip = trip_id AND b_frame = frame_id AND b_time BETWEEN a_time - INTERVAL {apart} AND a_time + INTERVAL {apart}")
    j = a.join(b, near, "fullOuter")
    u = conservative_union("classical_ttc", "detector_ttc")
    only = F.when(F.col("b_trip").isNull(), "detector").when(F.col("trip_id").isNull(), "classical")
    return j.select(
        F.coalesce("trip_id", "b_trip").alias("trip_id"), F.coalesce("frame_id", "b_frame").alias("frame_id"), F.coalesce("a_time", "b_time").alias("event_time"),
        F.when(only == "detector", F.col("classical_ttc")).when(only == "classical", F.col("detector_ttc")).otherwise(u["ttc"]).alias("ttc"),
        F.when(only == "detector", "classical").when(only == "classical", "detector").otherwise(u["source"]).alias("union_source"), only.alias("missing_source"))


def latency_stream(stream: DataFrame, value="compute_ms", width="10 seconds", delay="2 seconds", k=400) -> DataFrame:
    """p50, p95 and p99 of ``value`` per trip and time window from mergeable quantile sketches.

    At the default size ``k`` a KLL sketch gives a quantile whose rank is within about 0.7 % of the
    window's rows (99 % of the time), whatever their number; NULL and non-finite values are left out. The sketch itself is given out as well, so that windows can be merged
    (``merged_latency``).
    """
    v = F.when(is_finite(value), F.col(value).cast("double"))
    w = stream.withWatermark("event_time", delay).groupBy("trip_id", F.window("event_time", width)).agg(
        F.count(v).alias("samples"), F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"))
    return w.select("*", *_quantiles("sketch"))


def _quantiles(sketch: str):
    ranks = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
    known = F.col("samples") > 0
    return [F.when(known, F.kll_sketch_get_quantile_double(sketch, F.lit(r))).alias(n) for n, r in ranks.items()]


def merged_latency(windows: DataFrame, by=("trip_id",)) -> DataFrame:
    """Quantiles over all windows of each key, from the sketches that ``latency_stream`` gave out."""
    m = windows.filter("samples > 0").groupBy(*by).agg(F.sum("samples").alias("samples"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return m.select(*by, "samples", *_quantiles("sketch"))


def live_scores(stream: DataFrame, width="10 seconds", delay="2 seconds", pred="predicted_ttc", truth="truth_ttc") -> DataFrame:
    """The one-pass scores per trip and time window of a stream."""
    w = stream.withWatermark("event_time", delay).groupBy("trip_id", F.window("event_time", width)).agg(*score_sums(pred, truth))
    return scores_from_sums(w)


def bands_stream(stream: DataFrame) -> DataFrame:
    """Severity band of each frame; needs no state."""
    return stream.withColumn("raw_band", ttc_band("ttc"))
