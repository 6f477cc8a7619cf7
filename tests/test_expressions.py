"""Column functions against values worked out by hand."""
import math

import pytest
from pyspark.sql import functions as F

from roadrisk.constants import CURRENT_GUARD
from roadrisk.functions import geometry as G
from roadrisk.functions import ttc as X
from roadrisk.functions.catalog import register_functions
from roadrisk.operators.association import rank_candidates

INF = float("inf")


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_bands(spark):
    d = spark.createDataFrame([(v,) for v in (INF, 3.0, 2.0, 1.5, 1.499)], "ttc double")
    assert [r.b for r in d.select(X.ttc_band("ttc").alias("b")).collect()] == ["SAFE", "SAFE", "WARNING", "DANGER", "CRITICAL"]


@pytest.mark.parametrize("text,mode,value,error", [
    (" +Inf ", "strict", INF, None), ("1.5", "strict", 1.5, None), ("nan", "strict", None, "not numeric"),
    ("-inf", "strict", None, "not numeric"), ("-1", "strict", None, "out of range"), ("", "strict", None, "not numeric"),
    ("0", "strict", 0.0, None), ("0", "positive", None, "out of range"), ("x", "lenient", INF, None), ("inf", "sentinel99", 99.0, None)])
def test_parse(spark, text, mode, value, error):
    r = one(spark, X.parse_ttc(F.lit(text), mode))
    assert (r.value, r.error) == (value, error)


def test_union(spark):
    rows = [(INF, 1.5), (1.2, INF), (1.0, 0.8), (INF, INF)]
    d = spark.createDataFrame(rows, "c double, d double").select(X.conservative_union("c", "d").alias("u"))
    assert [r.u.ttc for r in d.collect()] == [1.5, 1.2, 1.0, INF]


def test_corridor(spark):
    d = spark.createDataFrame([(0.7, 0.36), (0.7, 1.0)], "x double, y double")
    got = d.select(G.corridor_member("x", "y", F.lit(0.10), F.lit(0.50)).alias("m")).collect()
    assert [r.m for r in got] == [False, True]


def test_planar_geometry(spark):
    p = one(spark, G.camera_to_planar(F.lit(10.0), F.lit(420.0), 500.0, 320.0))
    assert (p.forward, p.lateral) == (10.0, 2.0)
    m = one(spark, G.compensate_ego_motion(F.lit(20.0), F.lit(2.0), F.lit(10.0), F.lit(None).cast("double"), F.lit(0.1)))
    assert (round(m.forward, 9), round(m.lateral, 9)) == (19.0, 2.0)
    b = G.box(F.lit(90.0), F.lit(0.0), F.lit(110.0), F.lit(10.0))
    off = one(spark, G.path_offset(b, F.lit(10.0), F.lit(10.0), F.lit(0.0), 320.0, 320.0))
    assert off == pytest.approx(-6.875)


def test_cpa(spark):
    r = one(spark, G.cpa_path_risk(F.lit(10.0), F.lit(3.0), F.lit(-10.0), F.lit(0.0)))
    assert r.enters is False
    assert one(spark, G.cpa_path_risk(F.lit(10.0), F.lit(0.0), F.lit(-10.0), F.lit(0.0))).enters is True


def test_occupancy_matches_erf(spark):
    for mean, var in ((0.0, 1.0), (1.7, 0.3), (-4.0, 2.0)):
        s = math.sqrt(var)
        cdf = lambda v: 0.5 * (1 + math.erf(v / math.sqrt(2)))
        want = cdf((1.75 - mean) / s) - cdf((-1.75 - mean) / s)
        assert one(spark, G.corridor_occupancy(F.lit(mean), F.lit(var))) == pytest.approx(want, abs=1e-6)


def test_iou_floors_and_empty_boxes(spark):
    a = G.box(*[F.lit(v) for v in (0.0, 0.0, 0.5, 0.5)])
    assert one(spark, G.bbox_iou(a, a, 1.0)) == pytest.approx(0.25)
    assert one(spark, G.bbox_iou(a, a)) == pytest.approx(1.0)
    flat = G.box(*[F.lit(v) for v in (0.0, 0.0, 0.0, 0.5)])
    assert one(spark, G.bbox_iou(flat, flat)) == 0.0


def test_equal_distances_keep_the_order_of_sql(spark):
    # two centres at the same distance but for rounding: the root of squares puts the second one first
    item = (284.0, 270.00000000000006, 356.0, 306.00000000000006)
    boxes = [(3, 4.7, 361.0, 187.0, 469.0, 219.0), (4, 10.7, 375.0, 215.0, 495.0, 251.0)]
    want = [math.sqrt(((x0 + x1) / 2 - 320.0) ** 2 + ((y0 + y1) / 2 - (item[1] + item[3]) / 2) ** 2) for _, _, x0, y0, x1, y1 in boxes]
    assert want[1] < want[0]
    d = spark.createDataFrame(boxes, "ordinal long, depth_m double, x0 double, y0 double, x1 double, y1 double")
    c = d.select(F.lit("T").alias("trip_id"), F.lit(1).alias("frame_id"), "ordinal", F.col("ordinal").alias("track_id"), "depth_m", G.box("x0", "y0", "x1", "y1").alias("box"))
    i = spark.range(1).select(F.lit("T").alias("trip_id"), F.lit(1).alias("frame_id"), G.box(*[F.lit(v) for v in item]).alias("box"), F.lit(10.0).alias("item_depth_m"))
    r = {r.ordinal: r for r in rank_candidates(i, c).collect()}
    assert [r[n].centre_distance_px for n in (3, 4)] == want
    assert (r[3]["rank"], r[4]["rank"]) == (2, 1)


def test_squares_round_as_the_power_of_sql(spark):
    # two centres 145.24 px away: the C library's pow, which SQL uses, puts the second one first, x * x ties them
    item = (353.2, 148.00000000000003, 453.2, 198.00000000000003)
    boxes = [(3, 14.7, 214.0, 116.0, 310.0, 162.0), (4, 23.7, 224.0, 191.0, 300.0, 223.0)]
    want = [math.sqrt(math.pow((item[0] + item[2]) / 2 - (x0 + x1) / 2, 2.0) + math.pow((item[1] + item[3]) / 2 - (y0 + y1) / 2, 2.0)) for _, _, x0, y0, x1, y1 in boxes]
    assert want[1] < want[0]
    d = spark.createDataFrame(boxes, "ordinal long, depth_m double, x0 double, y0 double, x1 double, y1 double")
    c = d.select(F.lit("T").alias("trip_id"), F.lit(1).alias("frame_id"), "ordinal", F.col("ordinal").alias("track_id"), "depth_m", G.box("x0", "y0", "x1", "y1").alias("box"))
    i = spark.range(1).select(F.lit("T").alias("trip_id"), F.lit(1).alias("frame_id"), G.box(*[F.lit(v) for v in item]).alias("box"), F.lit(10.0).alias("item_depth_m"))
    r = {r.ordinal: r for r in rank_candidates(i, c).collect()}
    assert [r[n].centre_distance_px for n in (3, 4)] == want
    assert (r[3]["rank"], r[4]["rank"]) == (2, 1)


def test_distances_of_odd_boxes(spark):
    far, none = G.box(*[F.lit(v) for v in (1e200, 0.0, 1e200, 0.0)]), F.lit(None).cast("struct<x0: double, y0: double, x1: double, y1: double>")
    zero = G.box(*[F.lit(0.0)] * 4)
    assert one(spark, G.centre_distance(far, zero)) == INF
    assert one(spark, G.centre_distance(none, zero)) is None
    assert math.isnan(one(spark, G.centre_distance(G.box(*[F.lit(v) for v in (float("nan"), 0.0, 0.0, 0.0)]), zero)))


def test_guard_names():
    assert len(CURRENT_GUARD) == 8


def test_sql_functions(spark):
    assert "theil_sen" in register_functions(spark)
    r = spark.sql("SELECT ttc_band(1.2D) b, parse_ttc(' inf') p, theil_sen(array(0D, 1D, 2D), array(5D, 4D, 3D)).slope s").first()
    assert (r.b, r.p, r.s) == ("CRITICAL", INF, -1.0)
