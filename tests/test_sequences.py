"""Segment helpers with tiny segments against plain Python."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadrisk.operators import events as E
from roadrisk.operators import sequence as S
from roadrisk.operators.quantiles import exact_quantiles, value_bucket


def frames(spark, n=60, seed=3):
    rnd = random.Random(seed)
    rows = [(t, i, rnd.random()) for t in ("a", "b") for i in sorted(rnd.sample(range(200), n))]
    return rows, spark.createDataFrame(rows, "trip_id string, frame_id long, v double")


def by_trip(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_position_and_lag(spark):
    rows, df = frames(spark)
    got = {(r.trip_id, r.frame_id): r for r in S.previous(
        S.with_position(df, ["trip_id"], ["frame_id"], rows=7), ["trip_id"], ["frame_id"], {"before": "v"}, rows=7).collect()}
    for trip, rs in by_trip(rows).items():
        for i, r in enumerate(rs):
            g = got[trip, r[1]]
            assert g.position == i and g.before == (rs[i - 1][2] if i else None)


def test_halo_reaches_over_sparse_segments(spark):
    rows, df = frames(spark)
    h = S.with_halo(df, ["trip_id"], ["frame_id"], 4, rows=3)
    w = S.seg_window(["trip_id"], ["frame_id"]).rowsBetween(-4, 0)
    got = {(r.trip_id, r.frame_id): r.s for r in S.drop_halo(h.withColumn("s", F.sum("v").over(w))).collect()}
    for trip, rs in by_trip(rows).items():
        for i, r in enumerate(rs):
            assert abs(got[trip, r[1]] - sum(x[2] for x in rs[max(0, i - 4):i + 1])) < 1e-12


def test_run_starts(spark):
    rows, df = frames(spark)
    for gap in (0, 2):
        got = {(r.trip_id, r.frame_id): r.run_start for r in S.run_starts(df, ["trip_id"], "frame_id", gap, rows=5).collect()}
        for trip, rs in by_trip(rows).items():
            start = last = None
            for r in rs:
                if last is None or r[1] - last > gap + 1:
                    start = r[1]
                last = r[1]
                assert got[trip, r[1]] == start


def test_running_total_and_max(spark):
    rows, df = frames(spark)
    d = S.running_total(df, ["trip_id"], ["frame_id"], F.lit(2), "s", rows=6)
    d = S.running_max(d, ["trip_id"], ["frame_id"], F.when(F.col("v") > 0.7, F.col("frame_id")), "m", rows=6)
    got = {(r.trip_id, r.frame_id): r for r in d.collect()}
    for trip, rs in by_trip(rows).items():
        best = None
        for i, r in enumerate(rs):
            best = r[1] if r[2] > 0.7 else best
            assert got[trip, r[1]].s == 2 * (i + 1) and got[trip, r[1]].m == best


def test_quantiles_are_exact(spark):
    import numpy as np

    rnd = random.Random(1)
    vals = [rnd.choice([-3.5, 0.0, 1.0, 1.0, rnd.random() * 100]) for _ in range(500)]
    df = spark.createDataFrame([("k", v) for v in vals], "k string, v double")
    r = exact_quantiles(df, ["k"], "v", {"a": 0.5, "b": 0.95, "c": 0.0}).first()
    assert np.allclose([r.a, r.b, r.c], np.quantile(vals, [0.5, 0.95, 0.0]))


def test_episodes_and_ranges(spark):
    v = [None, 2.5, 2.0, 3.5, 1.0, 0.5, None]
    df = spark.createDataFrame([("t", i, x) for i, x in enumerate(v)], "trip_id string, frame_id long, v double")
    assert E.count_episodes(df, F.col("v") < 3.0).first().episodes == 2
    assert E.count_episodes(df, F.col("v") < 2.0).first().episodes == 1
    ids = spark.createDataFrame([("t", i) for i in (1, 2, 3, 7, 9, 10)], "trip_id string, frame_id long")
    assert E.collapse_ranges(ids).first().ranges == "1-3;7;9-10"


def test_quantiles_of_values_of_one_magnitude(spark):
    import numpy as np


    d = spark.range(200_000).select(F.lit("k").alias("k"), (50.0 + (F.xxhash64("id") % 1_000_003) / 1e5).alias("v"))
    got = exact_quantiles(d, ["k"], "v", {"p50": 0.5, "p95": 0.95}).first()
    v = np.array([r["v"] for r in d.select("v").collect()])
    assert abs(got["p50"] - np.quantile(v, 0.5)) < 1e-9 and abs(got["p95"] - np.quantile(v, 0.95)) < 1e-9
    most = d.select(value_bucket("v").alias("b")).groupBy("b").count().agg(F.max("count")).first()[0]
    assert most < 2000


def test_rates_are_computed_once_for_all_quantiles(spark):
    from roadrisk.operators import motion

    rows = [("t", 1, i, i * 0.05, 20.0 - 0.03 * i + (i * 7 % 5) * 0.2, 300.0 + (i * 13 % 11)) for i in range(40)]
    o = spark.createDataFrame(rows, "trip_id string, track_id long, frame_id long, t_sec double, depth_m double, centre_x double")
    rates = motion.window_rates(o, ["trip_id", "track_id"])
    for r in rates.collect():
        w = rows[max(0, r.frame_id - 10):r.frame_id + 1]
        if len(w) < 3:
            assert r.residual_mad_m is None
            continue
        t, v = np.array([x[3] for x in w]), np.array([x[4] for x in w])
        left = v - v.mean() - r.linear_rate_mps * (t - t.mean())
        assert r.residual_mad_m == pytest.approx(np.median(np.abs(left - np.median(left))), abs=1e-9)
    q = motion.depth_rate_metrics(rates.withColumn("truth_group", F.lit("g")))
    assert "collect_list" not in q._jdf.queryExecution().optimizedPlan().toString()


def test_queries_load_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=Path(__file__).parents[1], check=True)
