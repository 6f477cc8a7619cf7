"""Inputs shared by several registered queries, built with the library's own operators."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadrisk.functions import geometry as G
from roadrisk.functions.ttc import conservative_union
from roadrisk.plans.sqltext import EVIDENCE_OF, FEATURE_OF

TRIP, FRAME = "trip_id", "frame_id"


def union_predictions(t) -> DataFrame:
    """Frames with both sources, the conservative union and the truth."""
    u = conservative_union("classical_ttc", "detector_ttc")
    return t.predictions.select(
        TRIP, FRAME, "t_sec", F.col("min_ttc").alias("truth_ttc"), "classical_ttc", "detector_ttc",
        u["ttc"].alias("predicted_ttc"), u["source"].alias("union_source"),
    )


def variant_predictions(t) -> DataFrame:
    """One row per frame and prediction source: classical, detector, union."""
    u = union_predictions(t)
    rows = F.array(*[
        F.struct(F.lit(n).alias("variant"), F.col(c).alias("predicted_ttc"))
        for n, c in (("classical", "classical_ttc"), ("detector", "detector_ttc"), ("union", "predicted_ttc"))
    ])
    return u.select(TRIP, FRAME, "truth_ttc", F.explode(rows).alias("v")).select(
        TRIP, FRAME, "truth_ttc", "v.variant", "v.predicted_ttc")


def truth(t) -> DataFrame:
    return t.frames.select(TRIP, FRAME, F.col("min_ttc").alias("truth_ttc"))


def boxes(t) -> DataFrame:
    """Candidates with the pixel box rebuilt from normalised geometry."""
    return t.candidates.withColumn("box", G.bbox_from_norm("center_x", "bottom_y", "width", "height"))


def detections(t) -> DataFrame:
    return t.detections.withColumn("box", G.box("x0", "y0", "x1", "y1")).drop("x0", "y0", "x1", "y1")


def components(t) -> DataFrame:
    """One component per frame: the most confident detection."""
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "ordinal", "box"))
    return detections(t).groupBy(TRIP, FRAME).agg(best.alias("b")).select(
        TRIP, FRAME, F.col("b.box").alias("box"))


def evidence(t) -> DataFrame:
    """Per frame: union TTC and source, truth, own motion, and the selected component's box."""
    f = t.frames.select(TRIP, FRAME, "speed_mps", "lateral_accel")
    return union_predictions(t).join(f, [TRIP, FRAME]).join(components(t), [TRIP, FRAME], "left")


def updates(t) -> DataFrame:
    """Track measurements of a frame: the candidates with their boxes."""
    return boxes(t).select(TRIP, FRAME, "ordinal", "track_id", "depth_m", "confidence", "closing_mps",
                           "residual_m", "candidate_ttc", "box")


def observations(t) -> DataFrame:
    """One measurement per (trip, track, frame): the first candidate, with time and own motion."""
    cx = (F.col("box.x0") + F.col("box.x1")) / 2.0
    area = (F.col("box.x1") - F.col("box.x0")) * (F.col("box.y1") - F.col("box.y0"))
    # a window, not the least struct: columns that no one needs are left out on the way
    first = F.row_number().over(Window.partitionBy(TRIP, FRAME, "track_id").orderBy("ordinal"))
    one = boxes(t).withColumn("_first", first).filter("_first = 1").select(
        TRIP, FRAME, "track_id", "ordinal", "depth_m", cx.alias("centre_x"), area.alias("area"), (0.5 + F.col("residual_m")).alias("sigma_m"),
        ((cx - 320.0) * F.col("depth_m") / 500.0).alias("lateral_m"), F.col("candidate_ttc").alias("ttc"), "confidence",
        "closing_mps", "box")
    f = t.frames.select(TRIP, FRAME, "t_sec", "speed_mps", "lateral_accel", F.col("min_ttc").alias("truth_ttc"))
    return one.join(f, [TRIP, FRAME])


def measured(t) -> DataFrame:
    """``observations`` with the evidence that a track's memory looks at."""
    return observations(t).withColumns({n: F.expr(e) for n, e in EVIDENCE_OF.items()})


def featured(t) -> DataFrame:
    """Candidates with the columns of their tracks that features look at."""
    return t.candidates.withColumns({n: F.expr(e) for n, e in FEATURE_OF.items()})
