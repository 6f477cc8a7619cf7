"""Rows that queries move and write on their way, against the rows they read."""
import os

import pytest
from pyspark.sql import functions as F

from roadrisk.operators.scan import Monoid, scan
from roadrisk.operators.sequence import by_track, last_rows
from roadrisk.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


def moved(spark, df) -> int:
    """Rows that go through shuffles when ``df`` is run."""
    jvm = spark.sparkContext._gateway.jvm

    def total():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(
            jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    df().write.format("noop").mode("overwrite").save()
    return total() - before


@pytest.mark.parametrize("name, times", [("semantic_state", 2.3), ("semantic_fusion", 2.8), ("semantic_sweep", 2.8), ("candidate_diagnostics", 3.3),
                                         ("selected_diagnostics", 2.6), ("selected_evidence", 2.6), ("closing_reliability", 2.6), ("union_gates", 6.5)])
def test_rows_move_seldom(spark, name, times):
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()
    assert moved(spark, lambda: QUERIES[name](spark, FOLDER)) < times * lines


def test_scan_without_a_look_ahead(spark):
    summed = Monoid((0.0,), lambda p, q: p + q)
    e = spark.range(60).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 2).alias("i"), F.array(F.col("id").cast("double")).alias("element"))
    plain = {(r.k, r.i): r.entry for r in scan(e, ["k"], "i", summed).collect()}
    assert {(r.k, r.i): r.entry for r in scan(e, ["k"], "i", summed, fan=4, levels=3).collect()} == plain
    with pytest.raises(Exception, match="is not below"):
        scan(e, ["k"], "i", summed, fan=4, levels=2).collect()


def test_last_rows(spark):
    """Segments with few rows, with many and with none between; two tracks."""
    frames = {1: [*range(0, 40, 3), 41, 42, 43, 90, 91, 130, 200], 2: [5, 17, 18]}
    rows = [("t", k, f, float(f * f)) for k, fs in frames.items() for f in fs]
    d = spark.createDataFrame(rows, "trip_id string, track_id long, frame_id long, v double")
    keys = ["trip_id", "track_id"]
    got = last_rows(by_track(d, keys, rows=8), keys, 5, {"f": "frame_id", "v": "v"}, following={"next_frame": "frame_id"}).collect()
    assert len(got) == len(rows)
    for r in got:
        fs = frames[r.track_id]
        at = fs.index(r.frame_id)
        assert r.position == at and r.v == r.frame_id ** 2
        assert [(x.f, x.v) for x in r.recent] == [(f, float(f * f)) for f in fs[max(0, at - 4):at + 1]]
        assert r.next_frame == (fs[at + 1] if at + 1 < len(fs) else None)


def test_sessions_of_planar_rows(spark):
    """Sessions by the least time of a frame, several rows a frame, across segments."""
    from roadrisk.operators.motion import distance_filter_sessions
    from roadrisk.operators.tracking import _with_sessions

    frames = [0, 1, 2, 20, 21, 1023, 1024, 1025, 1031, 1050, 5000]
    rows = [("t", k, f, n, f * 0.05 + 0.01 * n) for k in (1, 2) for f in frames for n in range(1, 2 + (f + k) % 3)]
    o = spark.createDataFrame(rows, "trip_id string, track_id long, frame_id long, ordinal long, t_sec double")
    keys = ["trip_id", "track_id"]
    s = distance_filter_sessions(o.groupBy(*keys, "frame_id").agg(F.min("t_sec").alias("t_sec")), keys)
    want = {(r.track_id, r.frame_id): r.session for r in s.collect()}
    got = _with_sessions(o, keys).collect()
    assert len(got) == len(rows) and all(r.session == want[r.track_id, r.frame_id] for r in got)
