"""Tracks with memory against a plain simulation, frame by frame."""
import math
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadrisk.operators import memory as K
from roadrisk.operators import motion as M
from roadrisk.operators import scoring as S
from roadrisk.operators import tracking as R

SCHEMA = ("trip_id string, frame_id long, ordinal long, t_sec double, box struct<x0: double, y0: double, x1: double, y1: double>, depth_m double, quality double, "
          "depth_mad_m double, lr_support double, corridor_overlap double, depth_confidence double, matched boolean, det_confidence double")


def scene(seed, frames=60):
    """Two objects that drift and drop out now and then; frame 40 is empty."""
    rnd = random.Random(seed)
    rows = []
    for f in range(frames):
        for k in range(2):
            if rnd.random() < 0.2 or f == 40 or (k == 1 and 20 <= f < 26):
                continue
            x = 100.0 + 300 * k + f
            rows.append(("t", f, k + 1, f * 0.05, (x, 100.0, x + 60, 200.0), 30 - 0.3 * f + rnd.gauss(0, 0.2), rnd.random(), rnd.random(), rnd.random(), rnd.random(),
                         rnd.random(), rnd.random() < 0.6, rnd.random()))
    return rows


def motion(points):
    if len(points) < 3:
        return 0.0, math.inf, math.inf
    t, v = np.array(points).T
    slope = np.median([(v[j] - v[i]) / (t[j] - t[i]) for i in range(len(t)) for j in range(i + 1, len(t))])
    base = np.median(v - slope * t)
    return -slope, v[-1] / -slope if -slope > 0.3 else math.inf, float(np.median(np.abs(v - slope * t - base)))


def weigh(closing, residual, ring, depth, ground):
    calm = math.exp(-residual / max(0.5, depth * 0.1)) if math.isfinite(residual) else 0.0
    return 0.25 * min(1, len(ring) / 7) + 0.3 * np.mean([r[6] for r in ring]) + 0.2 * calm + 0.15 * ground + 0.1 * (1.0 if closing > 0.3 else 0.5)


def simulate(rows, owner, frames, ground):
    """State of every track after every frame, kept for three frames without a match."""
    live, out = {}, {}
    for f in range(frames):
        seen = {owner[r[1], r[2]]: r for r in rows if r[1] == f}
        for k in list(live):
            if k not in seen:
                live[k]["missed"] += 1
                if live[k]["missed"] > 3:
                    del live[k]
        for k, r in seen.items():
            t = live.setdefault(k, {"ring": deque(maxlen=11), "hits": 0, "filter": None, "score": 0.0, "misses": 0})
            sigma = min(max(max(0.15, r[7]) * (1.35 - 0.55 * r[8]) / math.sqrt(max(0.15, r[10])), 0.15), 12.0)
            t["ring"].append(r)
            t["filter"] = M.filter_step(t["filter"], r[3], r[5], sigma)
            t.update(hits=t["hits"] + 1, missed=0)
        for k, t in live.items():
            hit = t["missed"] == 0 and t["ring"][-1][11]
            t["score"] = 0.4 * (t["ring"][-1][12] if hit else 0.0) + 0.6 * t["score"]
            t["misses"] = 0 if hit else t["misses"] + 1
            depth = t["ring"][-1][5]
            closing, ttc, residual = motion([(r[3], r[5]) for r in t["ring"]])
            fc, ft, fr = M.motion_of(t["filter"], f * 0.05, t["missed"])
            sure = (0.8 * weigh(fc, fr, t["ring"], depth, ground) + 0.2 * np.mean([r[10] for r in t["ring"]])) * 0.82 ** t["missed"]
            if t["missed"] <= 2:
                out[k, f] = (t["missed"], t["hits"], len(t["ring"]), closing, ttc, residual, fc, ft, fr, weigh(closing, residual, t["ring"], depth, ground), sure,
                             t["score"], t["misses"])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_memory_equals_simulation(spark, seed):
    rows = scene(seed)
    c = spark.createDataFrame(rows, SCHEMA)
    tracks = R.track_components(c).select("trip_id", "frame_id", "ordinal", "track_id")
    owner = {(r.frame_id, r.ordinal): r.track_id for r in tracks.collect()}
    assert len(set(owner.values())) >= 3  # the long gap ends a track
    frames = spark.range(60).select(F.lit("t").alias("trip_id"), F.col("id").alias("frame_id"), (F.col("id") * 0.05).alias("t_sec"))
    got = K.track_memory(c.join(tracks, ["trip_id", "frame_id", "ordinal"]), frames, 0.7, with_semantics=True)
    want = simulate(rows, owner, 60, 0.7)
    names = ["missed", "hits", "history", "closing_mps", "ttc", "residual_m", "filter_closing_mps", "filter_ttc", "filter_residual_m", "confidence", "filter_confidence", "score", "misses"]
    found = {(r.track_id, r.frame_id): tuple(r[n] for n in names) for r in got.collect()}
    assert found.keys() == want.keys() and {v[0] for v in want.values()} == {0, 1, 2}
    for at, values in want.items():
        assert found[at] == pytest.approx(values, rel=1e-6, abs=1e-8), at
    seen = K.track_memory(c.join(tracks, ["trip_id", "frame_id", "ordinal"]), frames, 0.7, include_predicted=False)
    assert {(r.track_id, r.frame_id) for r in seen.collect()} == {k for k, v in want.items() if v[0] == 0}


def test_the_past_does_not_depend_on_the_future(spark):
    rows = scene(3)
    c = spark.createDataFrame(rows, SCHEMA).withColumn("track_id", F.col("ordinal"))
    frames = spark.range(60).select(F.lit("t").alias("trip_id"), F.col("id").alias("frame_id"), (F.col("id") * 0.05).alias("t_sec"))
    whole = {(r.track_id, r.frame_id): r for r in K.track_memory(c, frames).collect() if r.frame_id < 30}
    part = {(r.track_id, r.frame_id): r for r in K.track_memory(c.filter("frame_id < 30"), frames).collect() if r.frame_id < 30}
    assert whole.keys() == part.keys()
    for k, r in part.items():
        for n in ("closing_mps", "filter_distance_m", "filter_ttc", "filter_confidence", "confidence"):
            assert r[n] == pytest.approx(whole[k][n], rel=1e-9, abs=1e-9)


def test_gates_of_the_choice(spark):
    rows = [("t", 1, o, o, 0.9, 5.0, 10.0, 0.1, ttc, d, s, m) for o, ttc, d, s, m in ((1, 1.0, 0.1, 0.9, 0), (2, 1.2, 0.9, 0.1, 5), (3, 1.5, 0.9, 0.9, 0))]
    df = spark.createDataFrame(rows, "trip_id string, frame_id long, ordinal int, track_id int, confidence double, closing_mps double, depth_m double, residual_m double, "
                                     "candidate_ttc double, depth_confidence double, score double, misses int")
    pick = lambda **k: S.select_min_ttc(df, **k).first().track_id
    assert pick() == 1 and pick(min_depth_confidence=0.5) == 2 and pick(min_depth_confidence=0.5, semantic=(0.25, 3, 5.0)) == 3
    assert pick(semantic=(0.25, 3, 50.0)) == 1


def test_evidence_of_frames_without_a_track(spark):
    rows = scene(4, 12)
    known = K.remembered(spark.createDataFrame(rows, SCHEMA).withColumn("track_id", F.col("ordinal")))
    frames = spark.range(14).select(F.lit("t").alias("trip_id"), F.col("id").alias("frame_id"))
    chosen = spark.createDataFrame([("t", 5, rows[-1][2]), ("t", rows[-1][1], rows[-1][2])], "trip_id string, frame_id long, track_id long").distinct()
    e = {r.frame_id: r for r in K.selected_evidence(frames, chosen, known).collect()}
    d = {r.frame_id: r for r in K.selected_diagnostics(frames, chosen, known).collect()}
    assert len(e) == len(d) == 14
    assert (e[13].selected_track_id, e[13].selected_history_length, e[13].selected_observations_json) == (None, 0, "[]")
    assert (d[13].selected_hits, d[13].selected_history, d[13].selected_center_x_norm) == (0, 0, None)
    last = e[rows[-1][1]]
    assert last.selected_observations_json.count("timestamp") == last.selected_history_length > 3


def test_chosen_rows_look_back_at_all_observations(spark):
    c = spark.createDataFrame(scene(4), SCHEMA).withColumn("track_id", F.col("ordinal"))
    chosen = c.filter("frame_id % 7 = 3").select("trip_id", "track_id", "frame_id")
    names = ["hits", "history", "observations", "closing_mps", "residual_m", "mean_quality"]
    whole = {(r.track_id, r.frame_id): r for r in K.remembered(c).collect()}
    some = K.robust(c, chosen).collect()
    assert {(r.track_id, r.frame_id) for r in some} == {k for k in whole if k[1] % 7 == 3} and some
    for r in some:
        assert [r[n] for n in names] == [whole[r.track_id, r.frame_id][n] for n in names]


def test_diagnostics_do_not_run_the_filter(spark):
    c = spark.createDataFrame(scene(4), SCHEMA).withColumn("track_id", F.col("ordinal"))
    frames = spark.range(60).select(F.lit("t").alias("trip_id"), F.col("id").alias("frame_id"))
    chosen = c.filter("frame_id % 7 = 3").dropDuplicates(["trip_id", "frame_id"]).select("trip_id", "track_id", "frame_id")
    for of in (K.selected_evidence, K.selected_diagnostics):
        new, old = of(frames, chosen, K.robust(c, chosen)), of(frames, chosen, K.remembered(c))
        assert sorted(map(str, new.collect())) == sorted(map(str, old.collect()))
        assert "filter_distance_m" not in new._jdf.queryExecution().toString()


def test_next_observation_across_segments(spark):
    n = 2 * 1024 + 3
    d = spark.range(n).select(F.lit("t").alias("trip_id"), F.lit(1).alias("track_id"), F.col("id").alias("position"), (F.col("id") * 2).alias("frame_id"))
    got = {r.position: (r.next_frame, len(r.recent)) for r in M.recent(d, ["trip_id", "track_id"], 3, {"f": "frame_id"}, following={"next_frame": "frame_id"}).collect()}
    assert got == {i: (2 * i + 2 if i < n - 1 else None, min(i + 1, 3)) for i in range(n)}


def test_rows_are_multiplied_after_the_join_with_frames(spark):
    c = spark.createDataFrame(scene(1), SCHEMA).withColumn("track_id", F.col("ordinal"))
    frames = spark.range(60).select(F.lit("t").alias("trip_id"), F.col("id").alias("frame_id"), (F.col("id") * 0.05).alias("t_sec"))
    m = K.track_memory(c, frames)
    assert "min(struct(missed" not in m._jdf.queryExecution().optimizedPlan().toString()
    assert m.groupBy("trip_id", "track_id", "frame_id").count().filter("count > 1").count() == 0
