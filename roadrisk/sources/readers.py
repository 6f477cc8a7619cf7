"""Readers of the file formats. Schemas are fixed; trip ids come from file or folder names."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadrisk import schemas
from roadrisk.constants import ANNOTATION_HEADER
from roadrisk.functions.geometry import box
from roadrisk.functions.ttc import parse_ttc

PREDICTION_HEADER = ("frame_id", "timestamp", "predicted_ttc")
PREDICTION_ALLOWED = (*PREDICTION_HEADER, "ground_truth_ttc")


def _csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """CSV files by column name: the fields of ``schema`` in its order, NULL where the files have
    none, and ``row_no``, which rises in file order. All files must have the same header (a file
    with another one fails the job); a byte-order mark is dropped. Texts are read as they are and
    cast afterwards, so that no column is ever taken by its position."""
    d = spark.read.option("header", True).option("enforceSchema", False).option("escape", '"').csv(path)
    there = {c.replace("\ufeff", "").strip(): c for c in d.columns}
    cols = [F.col(f"`{there[f.name]}`").cast(f.dataType).alias(f.name) if f.name in there else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema.fields]
    return d.select(*cols, F.monotonically_increasing_id().alias("row_no"), _stem().alias("trip_id"))


def _with_ordinal(d: DataFrame) -> DataFrame:
    """Number the rows of a frame from 0 in file order (the rows of one image at most)."""
    w = Window.partitionBy("trip_id", "frame_id").orderBy("row_no")
    return d.withColumn("ordinal", F.row_number().over(w) - 1).drop("row_no")


def check_headers(spark: SparkSession, path: str, needed=PREDICTION_HEADER, allowed=PREDICTION_ALLOWED) -> DataFrame:
    """(trip_id, header, errors) per CSV file: byte-order mark, missing, repeated and other columns."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/]+?)(\.[A-Za-z]+)+$", 1)
    # text readers take the mark away, so the bytes are read; a header ends within 64 KB
    first = F.regexp_extract(F.decode(F.substring("content", 1, 65536), "utf-8"), r"^([^\r\n]*)", 1)
    h = files.select(name.alias("trip_id"), first.alias("header"))
    names = F.transform(F.split(F.regexp_replace("header", "^\ufeff", ""), ","), lambda c: F.trim(F.regexp_replace(c, '"', "")))
    h = h.withColumn("_c", names)
    checks = [
        F.when(F.col("header").startswith("\ufeff"), F.lit("bom")),
        *[F.when(~F.array_contains("_c", n), F.lit(f"missing:{n}")) for n in needed],
        F.when(F.size("_c") != F.size(F.array_distinct("_c")), F.lit("repeated")),
        F.when(F.size(F.array_except("_c", F.array(*map(F.lit, allowed)))) > 0,
               F.concat(F.lit("extra:"), F.array_join(F.array_sort(F.array_except("_c", F.array(*map(F.lit, allowed)))), "|")))]
    return h.select("trip_id", "header", F.array_compact(F.array(*checks)).alias("errors"))


def check_annotation_headers(spark: SparkSession, path: str) -> DataFrame:
    """(trip_id, header, errors) per annotation CSV: the header must be ANNOTATION_HEADER, in its order."""
    d = check_headers(spark, path, ANNOTATION_HEADER, ANNOTATION_HEADER)
    same = F.col("header") == ",".join(ANNOTATION_HEADER)
    return d.withColumn("errors", F.when(same, F.col("errors")).when(F.size("errors") == 0, F.array(F.lit("order"))).otherwise(F.col("errors")))


def _stem():
    """File name without folders and endings such as .csv or .json.gz."""
    return F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[A-Za-z]+)+$", 1)


def read_trips(spark: SparkSession, path: str) -> DataFrame:
    """Trip documents; where both exist, ``x.json.gz`` is taken before ``x.json``."""
    d = spark.read.schema(schemas.TRIP).option("multiLine", True).json(path)
    d = d.select("*", F.input_file_name().alias("_file")).withColumn(
        "trip_id", F.regexp_extract("_file", r"([^/]+?)\.json(\.gz)?$", 1))
    plain = (~F.col("_file").endswith(".gz")).cast("int")
    # at most two files per trip
    w = Window.partitionBy("trip_id").orderBy(plain)
    return d.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_file")


def explode_frames(trips: DataFrame) -> DataFrame:
    e = trips.select("trip_id", F.explode("frames").alias("f")).select("trip_id", "f.*")
    return e.withColumnRenamed("timestamp", "t_sec")


def explode_targets(trips: DataFrame) -> DataFrame:
    f = trips.select("trip_id", F.explode("frames").alias("f"))
    return f.select("trip_id", F.col("f.frame_id").alias("frame_id"), F.posexplode("f.targets").alias("target_no", "t")).select(
        "trip_id", "frame_id", "target_no", "t.*")


def explode_events(trips: DataFrame) -> DataFrame:
    return trips.select("trip_id", F.posexplode("events_log").alias("event_no", "e")).select("trip_id", "event_no", "e.*")


def read_predictions(spark: SparkSession, path: str, mode="lenient") -> DataFrame:
    """Prediction CSVs, one per trip. TTC is read as text: the CSV reader would lose 'inf'."""
    d = _csv(spark, path, schemas.PREDICTIONS_CSV)
    p, t = parse_ttc("predicted_ttc", mode), parse_ttc("ground_truth_ttc", "lenient")
    return d.select("trip_id", "row_no", "frame_id", F.col("timestamp").alias("t_sec"), F.col("predicted_ttc").alias("ttc_text"),
                    p["value"].alias("predicted_ttc"), p["error"].alias("ttc_error"), t["value"].alias("truth_ttc"))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    d = _with_ordinal(_csv(spark, path, schemas.CANDIDATES_CSV))
    names = {"selected_center_x_norm": "center_x", "selected_bottom_y_norm": "bottom_y", "selected_width_norm": "width",
             "selected_height_norm": "height", "closing_speed_mps": "closing_mps", "motion_residual_m": "residual_m", "timestamp": "t_sec"}
    d = d.withColumnsRenamed(names)
    return d.withColumns({"candidate_ttc": parse_ttc("candidate_ttc", "lenient")["value"],
                          "truth_ttc": parse_ttc("ground_truth_ttc", "lenient")["value"]}).drop("ground_truth_ttc")


def read_detections(spark: SparkSession, path: str, frame_offset: int = 0) -> DataFrame:
    """Detection CSVs; ``frame_offset`` 1 aligns files whose frames count from 1."""
    d = _with_ordinal(_csv(spark, path, schemas.DETECTIONS_CSV))
    return d.select("trip_id", "ordinal", (F.col("frame_id") - frame_offset).alias("frame_id"), F.col("timestamp").alias("t_sec"),
                    "class_id", "class_name", "confidence", box("x0", "y0", "x1", "y1").alias("box"))


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Evidence CSVs by column name with a fixed schema, NULL where a file has no such column: JSON
    columns become arrays (NULL if not valid), TTC columns numbers (infinite where empty)."""
    d = _csv(spark, path, schemas.EVIDENCE_CSV).drop("row_no")
    out = {c: F.from_json(c, t) for c, t in schemas.EVIDENCE_JSON.items()}
    out |= {c: parse_ttc(c, "lenient")["value"] for c in schemas.EVIDENCE_TTC}
    return d.withColumns(out).withColumnRenamed("timestamp", "t_sec")


def read_perception(spark: SparkSession, path: str) -> DataFrame:
    """Perception JSON lines with the box of the first object of each frame."""
    d = spark.read.schema(schemas.PERCEPTION).json(path)
    b = F.get(F.col("objects.bbox_xyxy"), F.lit(0))
    return d.withColumn("box", F.when(b.isNotNull(), box(b[0], b[1], b[2], b[3])))


def list_modality_files(spark: SparkSession, root: str, suffix: str, prefix: str = "") -> DataFrame:
    """Frame ids from file names below ``root``; names without a number are left out. Contents
    are not read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root)
    number = F.regexp_extract("path", rf"/{re.escape(prefix)}(\d+)\.[A-Za-z0-9]+$", 1)
    return d.select("path", number.alias("n")).filter("n <> ''").select("path", F.col("n").cast("bigint").alias("frame_id"))
