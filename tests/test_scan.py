"""Scans over segments against plain sequential recursions."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadrisk.operators import motion as M
from roadrisk.operators import scan as S


@pytest.mark.parametrize("fan", [2, 3, 64])
def test_affine_entries(spark, fan):
    rnd = random.Random(fan)
    rows = [(k, i, [rnd.uniform(-1, 1), rnd.uniform(-5, 5)]) for k in ("a", "b", None) for i in sorted(rnd.sample(range(-20, 200), 70))]
    df = spark.createDataFrame(rows, "k string, i long, element array<double>")
    got = {(r.k, r.i): r.entry for r in S.scan(df.repartition(3), ["k"], "i", S.affine(), fan=fan).collect()}
    assert len(got) == len(rows)
    for k in ("a", "b", None):
        a, b = 1.0, 0.0
        for _, i, (c, d) in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            assert got[k, i] == pytest.approx([a, b], abs=1e-12)
            a, b = c * a, c * b + d


def test_no_elements(spark):
    assert S.scan(spark.createDataFrame([], "k string, i long, element array<double>"), ["k"], "i", S.affine()).count() == 0


def test_linear_filter_is_associative():
    rng = np.random.default_rng(4)
    r = S.linear_filter()
    dt, z, s = rng.uniform(0.01, 0.4, 30), rng.uniform(0, 50, 30), rng.uniform(0.1, 9, 30)
    e = M._distance_elements(dt, z, s, np.arange(30) % 11 == 0)
    p, q, t = e[:10], e[10:20], e[20:]
    one = np.tile(np.array(r.identity), (10, 1))
    assert np.allclose(r.combine(r.combine(p, q), t), r.combine(p, r.combine(q, t)), rtol=1e-9, atol=1e-9)
    assert np.allclose(r.combine(one, p), p) and np.allclose(r.combine(p, one), p)


def sequential(rows):
    """The filter as it runs on a stream, row by row."""
    out, state = {}, None
    for _, f, o, t, z, sigma in rows:
        state = M.filter_step(state, t, z, sigma)
        out[f, o] = (state[1], *M.motion_of(state, t))
    return out


@pytest.mark.parametrize("size", [2, 5, 1024])
def test_kalman_equals_sequential(spark, size):
    rnd = random.Random(size)
    rows = []
    for track in ("x", "y"):
        t = 0.0
        for f in range(330):
            t += rnd.choice([0.05, 0.05, 0.05, 0.3, 0.5, 0.6])
            for o in range(1, 3 if rnd.random() < 0.05 else 2):  # a repeated frame has no time step and starts afresh
                rows.append((track, f, o, t, 30 + 10 * math.sin(t) + rnd.gauss(0, 1), rnd.choice([0.01, 0.5, 2.0, 99.0])))
    df = spark.createDataFrame(rows, "track_id string, frame_id long, ordinal long, t_sec double, depth_m double, sigma_m double")
    got = {(r.track_id, r.frame_id, r.ordinal): r for r in M.kalman_distance(df.repartition(3), ["track_id"], rows=size).collect()}
    assert len(got) == len(rows)
    for track in ("x", "y"):
        for (f, o), want in sequential([r for r in rows if r[0] == track]).items():
            g = got[track, f, o]
            assert (g.distance_m, g.closing_mps, g.ttc, g.residual_m) == pytest.approx(want, rel=1e-8, abs=1e-8)


def test_one_long_track_is_spread(spark):
    n = 200_000
    df = spark.range(n).select(F.lit("t").alias("track_id"), F.col("id").alias("frame_id"), F.lit(1).alias("ordinal"),
                               (F.col("id") * 0.05).alias("t_sec"), (40 - (F.col("id") % 600) * 0.05).alias("depth_m"), F.lit(0.5).alias("sigma_m"))
    got = M.kalman_distance(df, ["track_id"])
    assert got.rdd.getNumPartitions() >= 4
    assert got.agg(F.count(F.lit(1)), F.max("frame_id")).first()[:] == (n, n - 1)


@pytest.mark.parametrize("size", [1, 4, 5000])
def test_semantic_state_is_the_recursion(spark, size):
    from roadrisk.operators.fusion import semantic_state

    rnd = random.Random(size)
    rows = [("t", k, f, o, rnd.random() < 0.1, rnd.random()) for k in (1, 2) for f in range(0, 1500 if size > 4 else 300, 2) for o in range(2)]
    df = spark.createDataFrame(rows, "trip_id string, track_id long, frame_id long, ordinal long, matched boolean, det_confidence double")
    got = {(r.track_id, r.frame_id, r.ordinal): r for r in semantic_state(df.repartition(3), size).collect()}
    assert len(got) == len(rows)
    for k in (1, 2):
        score, misses = 0.0, 0
        for _, _, f, o, hit, c in (r for r in rows if r[1] == k):
            score, misses = 0.4 * (c if hit else 0.0) + 0.6 * score, 0 if hit else misses + 1
            assert got[k, f, o].score == pytest.approx(score, abs=1e-12) and got[k, f, o].misses == misses


def test_states_over_many_segments(spark):
    from roadrisk.constants import RISK_PRESETS
    from roadrisk.operators import risk_states as R

    rnd = random.Random(1)
    ttcs = [rnd.choice([1.0, 1.7, 1.7, 2.5, math.inf]) for _ in range(500)]
    df = spark.createDataFrame([("t", i, v) for i, v in enumerate(ttcs)], "trip_id string, frame_id long, ttc double")
    got = {(r.preset, r.frame_id): (r.state, r.position) for r in R.risk_states(df, list(RISK_PRESETS), rows=3).collect()}
    for name, preset in RISK_PRESETS.items():
        state = R.START
        for i, v in enumerate(ttcs):
            state, _ = R.step(state, "SAFE" if v >= 3 else "WARNING" if v >= 2 else "DANGER" if v >= 1.5 else "CRITICAL", preset)
            assert got[name, i] == (state[0], i)


def test_a_batch_of_the_filter_is_bounded(spark):
    """Python gets 10,000 rows at a time: a row of the filter may not hold more than a short segment."""
    df = spark.range(4000).select(F.lit("t").alias("trip_id"), F.lit(1).alias("track_id"), F.col("id").alias("frame_id"), F.lit(1).alias("ordinal"),
                                  (F.col("id") * 0.05).alias("t_sec"), F.lit(20.0).alias("depth_m"), F.lit(1.0).alias("sigma_m"))
    seen, cut = [], M.cut
    try:
        M.cut = lambda d: seen.append(d) or cut(d)
        assert M.kalman_distance(df).count() == 4000
    finally:
        M.cut = cut
    sizes = [r.n for r in seen[0].select(F.size("_rows").alias("n")).collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 128
