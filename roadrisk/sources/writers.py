"""Writers, and the text forms that they write."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F, types as T

from roadrisk.functions.ttc import ttc_text
from roadrisk.operators.sequence import with_position


def prediction_columns(df: DataFrame) -> DataFrame:
    seconds = F.when(F.col("t_sec").isNotNull(), F.format_string("%.6f", F.col("t_sec")))
    return df.select("trip_id", "frame_id", seconds.alias("timestamp"), ttc_text("predicted_ttc").alias("predicted_ttc"))


def write_predictions(df: DataFrame, path: str) -> None:
    """Three columns below trip folders: frame_id, timestamp (6 decimals), predicted_ttc (6 decimals or inf)."""
    rows = prediction_columns(df)
    # a trip may span several files; ranges keep them in frame order and of even size
    rows.repartitionByRange("trip_id", "frame_id").sortWithinPartitions("trip_id", "frame_id").write.mode(
        "overwrite").partitionBy("trip_id").option("header", True).csv(path)


def normalize_predictions(df: DataFrame) -> DataFrame:
    """Drop a byte-order mark from column names and all columns but the three of a submission."""
    clean = {c: c.replace("\ufeff", "").strip() for c in df.columns}
    keep = [c for c in ("trip_id", "frame_id", "timestamp", "predicted_ttc") if c in clean.values()]
    return df.withColumnsRenamed(clean).select(*keep)


def _sorted_keys(c: Column, kind: T.DataType) -> Column:
    """The value with the fields of all structs inside in name order."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(c.isNotNull(), F.struct(*[_sorted_keys(c[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _sorted_keys(x, kind.elementType))
    return c


def document_text(df: DataFrame) -> Column:
    """The row as JSON with sorted keys; NULL fields are written as null."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    return F.to_json(F.struct(*[_sorted_keys(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields]), {"ignoreNullFields": "false"})


def write_documents(df: DataFrame, path: str, order="frame_id", span=4096) -> None:
    """JSON lines with sorted keys below trip folders, in order of ``order`` within each file
    (``span`` frames or events)."""
    rows = df.select("trip_id", F.col(order).alias("_order"), document_text(df).alias("value"))
    rows = rows.repartition("trip_id", F.floor(F.col("_order") / span)).sortWithinPartitions("trip_id", "_order")
    rows.drop("_order").write.mode("overwrite").partitionBy("trip_id").text(path)


def event_documents(events: DataFrame, frames: DataFrame, run_id: str) -> DataFrame:
    """risk_event.v1 documents. events: trip_id, start_frame, end_frame, min_ttc_sec, severity,
    event_quality, confidence_level; frames: trip_id, frame_id, t_sec. Events are numbered in
    each trip by their start; object and track are not known at this stage."""
    t = frames.select("trip_id", "frame_id", "t_sec")
    start = t.select("trip_id", F.col("frame_id").alias("start_frame"), F.col("t_sec").alias("start_time"))
    end = t.select("trip_id", F.col("frame_id").alias("end_frame"), F.col("t_sec").alias("end_time"))
    n = with_position(events, ["trip_id"], ["start_frame"], "start_frame")
    d = n.join(start, ["trip_id", "start_frame"], "left").join(end, ["trip_id", "end_frame"], "left")
    return d.select(
        F.lit("risk_event.v1").alias("schema_version"), F.lit(run_id).alias("run_id"),
        F.concat(F.lit(f"{run_id}-E"), (F.col("position") + 1).cast("string")).alias("event_id"), "trip_id", "start_frame", "end_frame",
        "start_time", "end_time", F.greatest(F.lit(0.0), "min_ttc_sec").alias("min_ttc_sec"), F.lit("unknown").alias("object_type"),
        F.lit(0).cast("bigint").alias("track_id"), "severity", "event_quality", "confidence_level", F.lit(None).cast("string").alias("clip_path"))


def write_events(documents: DataFrame, path: str) -> None:
    write_documents(documents, path, "start_frame")


def detection_evidence_json(dets: DataFrame, keys=("trip_id", "frame_id")) -> DataFrame:
    """JSON array of a frame's detections: boxes with 3 decimals, confidence with 6."""
    b = F.col("box")
    o = F.struct(
        F.col("ordinal").alias("_o"), F.array(*[F.round(b[c], 3) for c in ("x0", "y0", "x1", "y1")]).alias("bbox_xyxy"),
        F.col("class_id").alias("class_id"), F.col("class_name"), F.round("confidence", 6).alias("confidence"))
    rows = F.array_sort(F.collect_list(o))
    return dets.groupBy(*keys).agg(F.to_json(F.transform(rows, lambda r: r.dropFields("_o"))).alias("raw_detections_json"))


def track_measurements_json(obs: DataFrame, keys=("trip_id", "frame_id")) -> DataFrame:
    """JSON array of the latest measurement of each track of a frame, in track order; with its depth
    noise where ``obs`` has a column depth_sigma_m."""
    sigma = [F.round("depth_sigma_m", 6).alias("depth_sigma_m")] if "depth_sigma_m" in obs.columns else []
    one = obs.groupBy(*keys, "track_id").agg(F.max(F.struct(
        "ordinal", F.struct(F.col("track_id"), F.round("t_sec", 6).alias("timestamp"), F.round("depth_m", 6).alias("depth_m"),
                            F.round("centre_x", 3).alias("center_x"), *sigma).alias("m"))).alias("b"))
    return one.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list("b.m"))).alias("track_measurements_json"))
