"""Streaming operators against their batch forms, with disorder, repeats, gaps and late rows."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadrisk.operators import fusion, motion, tracking
from roadrisk.operators import risk_states as R
from roadrisk.streaming import risk_stream as L
from roadrisk.streaming.state import ROCKSDB, rows_behind_watermark

START = 1_700_000_000_000
FAR = 900_000  # rows this many ms later push the watermark past everything


@pytest.fixture(autouse=True)
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def at(ms):
    return F.timestamp_millis((F.lit(START) + ms).cast("long"))


def source(spark, path, schema, parts):
    for p in parts:
        p.select(*[f.name for f in schema.fields]).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def run(stream, path, name="out"):
    q = (stream.writeStream.format("parquet").option("path", str(path / name)).option("checkpointLocation", str(path / f"cp-{name}"))
         .trigger(availableNow=True).start())
    q.awaitTermination(240)
    assert q.exception() is None
    return q, stream.sparkSession.read.parquet(str(path / name))


def in_pieces(df, key="trip_id"):
    """Odd and even frames of the first half apart, with repeats, then the rest, then two rows of another key far later."""
    half = df.agg(F.max("frame_id")).first()[0] // 2
    far = df.limit(1).withColumns({key: F.lit("z"), "event_time": at(F.lit(FAR))})
    return [df.filter(f"frame_id % 2 = 1 AND frame_id < {half}"), df.filter(f"frame_id % 2 = 0 AND frame_id < {half}").unionByName(df.filter("frame_id % 7 = 1 AND frame_id < 20")),
            df.filter(f"frame_id >= {half}"), far, far.withColumns({"frame_id": F.col("frame_id") + 1, "event_time": at(F.lit(2 * FAR))})]


def equal(got, want, keys, cols):
    a = {tuple(r[k] for k in keys): r for r in got.collect() if r["trip_id"] != "z"}
    rows = want.collect()
    assert len(a) == len(rows) > 0
    for r in rows:
        for c in cols:
            x, y = a[tuple(r[k] for k in keys)][c], r[c]
            assert x == y or x == pytest.approx(y, rel=1e-7, abs=1e-9), (c, x, y)


def observations(spark):
    rnd = random.Random(6)
    rows = []
    for trip in ("a", "b"):
        for track in (1, 2):
            for f in range(70):
                if f % 11 == 5 or 30 <= f < 43 and track == 2:  # single gaps, and one that starts the filters afresh
                    continue
                rows.append((trip, track, f, 1, f * 0.05, 30 - 0.2 * f + rnd.gauss(0, 0.3), 0.5 + rnd.random(), rnd.gauss(0, 1), 5.0 + rnd.random(),
                             rnd.choice([None, 0.1, -0.2]), rnd.random() < 0.5, rnd.random()))
    return spark.createDataFrame(rows, "trip_id string, track_id long, frame_id long, ordinal long, t_sec double, depth_m double, sigma_m double, lateral_m double, "
                                       "speed_mps double, yaw double, matched boolean, det_confidence double").withColumns(
        {"event_time": at(F.col("frame_id") * 50), "forward_m": F.col("depth_m")})


def test_filters_equal_batch(spark, tmp_path):
    df = observations(spark)
    s = source(spark, tmp_path / "in", df.schema, in_pieces(df))
    keys = ["trip_id", "track_id", "frame_id"]
    equal(run(L.kalman_stream(s, "30 seconds"), tmp_path, "k")[1], motion.kalman_distance(df), keys, ["distance_m", "closing_mps", "ttc", "residual_m"])
    equal(run(L.planar_stream(s, "30 seconds"), tmp_path, "p")[1], tracking.planar_filter(df), keys, list(tracking.PLANAR_FIELDS))
    equal(run(L.semantic_stream(s, "30 seconds"), tmp_path, "s")[1], fusion.semantic_state(df), keys, ["score", "misses"])


def test_tracks_equal_batch(spark, tmp_path):
    rnd = random.Random(2)
    rows = []
    for f in range(60):
        for o in range(3):
            if rnd.random() < 0.25 or f in (20, 21, 22, 23, 24):
                continue
            x = 60.0 + 190 * o + rnd.gauss(0, 15)
            rows.append(("a", f, o + 1, (x, 100.0, x + 50, 160.0), 10.0 + o + rnd.random()))
    df = spark.createDataFrame(rows, "trip_id string, frame_id long, ordinal long, box struct<x0: double, y0: double, x1: double, y1: double>, depth_m double").withColumn(
        "event_time", at(F.col("frame_id") * 50))
    s = source(spark, tmp_path / "in", df.schema, in_pieces(df))
    want = tracking.track_components(df)
    assert want.agg(F.max("track_id")).first()[0] > 4
    equal(run(L.tracks_stream(s, delay="30 seconds"), tmp_path)[1], want, ["trip_id", "frame_id", "ordinal"], ["track_id", "hits"])


def test_late_rows_come_out_marked(spark, tmp_path):
    schema = "trip_id string, frame_id long, ttc double, reliable boolean"

    def rows(frames, ms=None):
        return spark.createDataFrame([("a", f, 1.7, True) for f in frames], schema).withColumn("event_time", at(F.col("frame_id") * 50 if ms is None else F.lit(ms)))

    # frames 0-9 are decided by frame 200; then frame 4 comes again with a time the watermark has not passed, and one that it has
    parts = [rows(range(10)), rows([200]), rows([201]), rows([4], ms=12_000), rows([5], ms=100), rows([900]), rows([901])]
    s = source(spark, tmp_path / "in", parts[0].schema, parts)
    q, got = run(L.risk_states_stream(s, delay="1 second", late=True), tmp_path)
    by = {(r.frame_id, r.late): r for r in got.collect()}
    assert (4, True) in by and by[4, True].state is None and by[4, False].state == "HIGH_RISK"
    assert (5, True) not in by and rows_behind_watermark(q) == 1
    assert sum(r.late for r in got.collect()) == 1


def test_state_ends(spark, tmp_path):
    schema = "trip_id string, frame_id long, ttc double, reliable boolean"
    first = spark.createDataFrame([("a", f, 1.7, True) for f in range(5)], schema).withColumn("event_time", at(F.col("frame_id") * 50))
    far = [spark.createDataFrame([("z", k, 9.0, True)], schema).withColumn("event_time", at(F.lit(FAR * (k + 1)))) for k in range(3)]
    # after its end the trip starts anew: frame 0 is not late then, and the state is that of a first frame
    again = spark.createDataFrame([("a", 0, 1.7, True)], schema).withColumn("event_time", at(F.lit(FAR * 3)))
    last = spark.createDataFrame([("z", 9, 9.0, True)], schema).withColumn("event_time", at(F.lit(FAR * 5)))
    s = source(spark, tmp_path / "in", first.schema, [first, *far, again, last, last.withColumn("event_time", at(F.lit(FAR * 6)))])
    q, got = run(L.risk_states_stream(s, delay="1 second", late=True), tmp_path)
    mine = sorted((r.event_time, r.frame_id, r.state, r.late) for r in got.collect() if r.trip_id == "a")
    assert [m[1:] for m in mine] == [(0, "NORMAL", False), (1, "ATTENTIVE", False), (2, "HIGH_RISK", False), (3, "HIGH_RISK", False), (4, "HIGH_RISK", False), (0, "NORMAL", False)]


def test_live_pairing_feeds_the_states(spark, tmp_path):
    rnd = random.Random(1)
    a = [("a", f, rnd.choice([1.0, 1.8, 5.0, math.inf])) for f in range(60) if f % 9 != 4]
    b = [("a", f, rnd.choice([1.0, 1.8, 5.0, math.inf])) for f in range(60) if f % 13 != 6]
    one = spark.createDataFrame(a, "trip_id string, frame_id long, classical_ttc double").withColumn("event_time", at(F.col("frame_id") * 50))
    two = spark.createDataFrame(b, "trip_id string, frame_id long, detector_ttc double").withColumn("event_time", at(F.col("frame_id") * 50 + 120))
    s1 = source(spark, tmp_path / "a", one.schema, in_pieces(one))
    s2 = source(spark, tmp_path / "b", two.schema, in_pieces(two))
    q, got = run(L.paired_stream(s1, s2, "30 seconds"), tmp_path)
    found = {r.frame_id: (r.ttc, r.union_source, r.missing_source) for r in got.filter("trip_id = 'a'").collect()}
    da, db = {f: v for _, f, v in a}, {f: v for _, f, v in b}
    want = {}
    for f in range(60):
        if f in da and f in db:
            own = db[f] < 2 and not da[f] < 2
            want[f] = (db[f], "detector", None) if own else (da[f], "classical", None)
        elif f in da:
            want[f] = (da[f], "classical", "detector")
        elif f in db:
            want[f] = (db[f], "detector", "classical")
    assert found == want and got.filter("trip_id = 'a'").count() == len(want)
    # and on into the risk states, as from a table
    frames = got.filter("trip_id = 'a'").select("trip_id", "frame_id", "ttc", F.col("missing_source").isNull().alias("reliable"), "event_time")
    s = source(spark, tmp_path / "c", frames.schema, in_pieces(frames))
    equal(run(L.risk_states_stream(s, delay="30 seconds"), tmp_path, "r")[1], R.risk_states(frames, reliable="reliable"), ["trip_id", "frame_id"], ["state", "reason", "ttc"])


def test_latency_quantiles_within_the_rank_error(spark, tmp_path):
    rng = np.random.default_rng(3)
    values = [*rng.gamma(2.0, 10.0, 20_000).tolist(), None, float("nan"), float("inf")]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "trip_id string, frame_id long, compute_ms double").withColumn("event_time", at(F.col("frame_id") * 2))
    far = df.limit(1).withColumn("event_time", at(F.lit(FAR)))
    s = source(spark, tmp_path / "in", df.schema, [df.filter("frame_id < 9000"), df.filter("frame_id >= 9000"), far, far.withColumn("event_time", at(F.lit(2 * FAR)))])
    got = run(L.latency_stream(s), tmp_path)[1]
    clean = [(i * 2 // 10_000, v) for i, v in enumerate(values[:20_000])]
    windows = sorted((r for r in got.collect() if r.samples > 1), key=lambda r: r.window.start)
    assert sum(r.samples for r in windows) == 20_000 and len(windows) >= 4
    offset = windows[0].samples
    start = 0
    for r in windows:
        part = np.sort([v for _, v in clean[start:start + r.samples]])
        for q, v in ((0.5, r.p50), (0.95, r.p95), (0.99, r.p99)):
            assert abs(np.searchsorted(part, v) / len(part) - q) < 0.01
        start += r.samples
    whole = L.merged_latency(got.filter("samples > 1")).first()
    every = np.sort(values[:20_000])
    assert whole.samples == 20_000 and offset > 0
    for q, v in ((0.5, whole.p50), (0.95, whole.p95), (0.99, whole.p99)):
        assert abs(np.searchsorted(every, v) / len(every) - q) < 0.015
    empty = L.latency_stream(df.filter("compute_ms IS NULL")).first()
    assert (empty.samples, empty.p50) == (0, None)


def test_live_scores_equal_batch(spark, tmp_path):
    from roadrisk.operators.scoring import score_sums, scores_from_sums

    rnd = random.Random(4)
    rows = [("a", f, rnd.choice([1.0, 1.8, 2.5, math.inf]), rnd.choice([1.0, 1.8, 2.5, math.inf])) for f in range(400)]
    df = spark.createDataFrame(rows, "trip_id string, frame_id long, predicted_ttc double, truth_ttc double").withColumn("event_time", at(F.col("frame_id") * 50))
    s = source(spark, tmp_path / "in", df.schema, in_pieces(df)[0:1] + [df.filter("frame_id % 2 = 0 OR frame_id >= 199")] + in_pieces(df)[3:])
    got = {r.window.start: r for r in run(L.live_scores(s, delay="30 seconds"), tmp_path)[1].filter("trip_id = 'a'").collect()}
    want = {r.window.start: r for r in scores_from_sums(df.groupBy("trip_id", F.window("event_time", "10 seconds")).agg(*score_sums("predicted_ttc", "truth_ttc"))).collect()}
    assert got.keys() == want.keys() and all(got[k][c] == pytest.approx(want[k][c]) for k in want for c in ("frames", "tp", "fp", "fn", "composite"))
