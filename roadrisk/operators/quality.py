"""Checks of data sets, submissions and contract documents. Errors are rows or arrays of codes,
never exceptions, so one pass reports everything."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadrisk.constants import CRITICAL_ZONE_TTC, DANGER_TTC, FRAME_PERIOD_S, IMAGE_HEIGHT, IMAGE_WIDTH, SEVERE_TTC
from roadrisk.functions.ttc import finite, is_danger, is_finite, parse_ttc
from roadrisk.operators.events import count_episodes
from roadrisk.operators.quantiles import exact_quantiles
from roadrisk.operators.sequence import previous, segmented, with_position


def codes(checks: dict[str, Column]) -> Column:
    """Array of the names of the checks that are true (NULL counts as false)."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))


def validate_predictions(preds: DataFrame, frames: DataFrame, tol=1e-6) -> DataFrame:
    """Rows of a prediction file that differ from the source, with error codes.

    preds: trip_id, row_no (file order), frame_id, timestamp, predicted_ttc (text). frames:
    trip_id, frame_id, t_sec. Row i of a file must be frame i of the trip.
    """
    p = with_position(preds, ["trip_id"], ["row_no"], "row_no")
    f = with_position(frames.select("trip_id", "frame_id", "t_sec"), ["trip_id"], ["frame_id"]).select(
        "trip_id", "position", F.col("frame_id").alias("_id"), F.col("t_sec").alias("_t"))
    j = p.withColumn("_ttc", parse_ttc("predicted_ttc")).join(f, ["trip_id", "position"], "full_outer")
    have, want = F.col("row_no").isNotNull(), F.col("_id").isNotNull()
    both = have & want
    e = codes({
        "missing_row": ~have, "extra_row": ~want, "frame_id": both & ~F.col("frame_id").eqNullSafe(F.col("_id")),
        "timestamp": both & ~F.coalesce(F.abs(F.col("timestamp") - F.col("_t")) <= tol, F.lit(False)),
        "ttc": have & F.col("_ttc.error").isNotNull()})
    return j.select("trip_id", "position", F.array_join(e, ",").alias("errors"), is_finite("_ttc.value").alias("finite"))


def validation_summary(checked: DataFrame) -> DataFrame:
    bad = F.col("errors") != ""
    return checked.groupBy("trip_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("error_rows"),
        F.count_if(~bad & F.coalesce("finite", F.lit(False))).alias("finite_predictions"),
        F.count_if(~bad & ~F.coalesce("finite", F.lit(False))).alias("infinite_predictions"))


def trip_set_check(preds: DataFrame, source: DataFrame) -> DataFrame:
    a, b = preds.select("trip_id").distinct(), source.select("trip_id").distinct()
    return b.join(a, "trip_id", "left_anti").withColumn("problem", F.lit("missing")).unionByName(
        a.join(b, "trip_id", "left_anti").withColumn("problem", F.lit("extra")))


def validate_submission(preds: DataFrame, expected_rows: int) -> DataFrame:
    """Per trip: row count, ids 0..n-1, rising finite times, TTC above zero or infinite."""
    p = with_position(preds, ["trip_id"], ["row_no"], "row_no")
    p = previous(p, ["trip_id"], ["row_no"], {"_t": "timestamp"}, "row_no")
    ttc = parse_ttc("predicted_ttc", "positive")
    rising = F.coalesce(is_finite("timestamp") & (F.col("_t").isNull() | (F.col("timestamp") > F.col("_t"))), F.lit(False))
    s = p.withColumn("_v", ttc).groupBy("trip_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("frame_id") != F.col("position")).alias("bad_ids"),
        F.count_if(~rising).alias("bad_times"), F.count_if(F.col("_v.error").isNotNull()).alias("bad_ttc"),
        F.count_if(is_danger("_v.value")).alias("danger_frames"))
    return s.withColumn("valid", (F.col("rows") == expected_rows) & (F.col("bad_ids") + F.col("bad_times") + F.col("bad_ttc") == 0))


TREE_FAN = 64        #: nodes of a hash tree under one parent
TREE_LEVELS = 3      #: levels over the segments: trips of up to TREE_FAN ** (TREE_LEVELS + 1) segments have a bounded root
NAME_DIGITS = 4      #: levels of the tree over units, by leading hex digits of the hash of their names


def segment_hashes(df: DataFrame, text: Column, order="frame_id", unit="trip_id") -> DataFrame:
    """One hash per segment: at most SEGMENT_ROWS rows are ever joined into one text."""
    s = segmented(df.withColumn("_text", text), order)
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_text").alias("t"))))
    return s.groupBy(unit, "_seg").agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["t"]), "\n"), 256).alias("h"))


def _joined(order, h="h"):
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(h).alias("h"))))
    return F.sha2(F.array_join(F.transform(rows, lambda r: r["h"]), "\n"), 256)


def hash_tree(df: DataFrame, text: Column, order="frame_id", unit="trip_id") -> list[DataFrame]:
    """The hash tree of each unit, level by level from its segments: (unit, node, h).

    A node is the hash of its at most TREE_FAN children in order; the last table has one node (0) per
    unit. No row ever holds the hashes of all segments of a unit.
    """
    levels = [segment_hashes(df, text, order, unit).withColumnRenamed("_seg", "node")]
    for k in range(TREE_LEVELS):
        levels.append(levels[-1].groupBy(unit, F.floor(F.col("node") / TREE_FAN).alias("up")).agg(_joined("node").alias("h")).withColumnRenamed("up", "node"))
    levels.append(levels[-1].groupBy(unit).agg(_joined("node").alias("h")).select(unit, F.lit(0).cast("bigint").alias("node"), "h"))
    return levels


def root_of_units(units: DataFrame, unit="trip_id", h="h") -> DataFrame:
    """One hash over all units, by a tree over the leading digits of the hashes of their names."""
    d = units.select(F.sha2(unit, 256).alias("at"), unit, h)
    d = d.groupBy(F.substring("at", 1, NAME_DIGITS).alias("at")).agg(_joined(unit, h).alias("h"))
    for k in range(NAME_DIGITS - 1, -1, -1):
        d = d.groupBy(F.substring("at", 1, k).alias("up")).agg(_joined("at").alias("h")).withColumnRenamed("up", "at")
    return d.select("h")


def differing_segments(a: DataFrame, b: DataFrame, text: Column, order="frame_id", unit="trip_id") -> DataFrame:
    """Segments whose rows differ between two runs, or that one run lacks: (unit, segment, in_a, in_b).

    The trees are compared from the roots down; only children of nodes that differ are looked at.
    """
    ta, tb = hash_tree(a, text, order, unit), hash_tree(b, text, order, unit)
    open_ = None
    for k, (x, y) in enumerate(zip(reversed(ta), reversed(tb))):
        if open_ is not None:
            parents = open_.select(F.col(unit).alias("_u"), F.col("node").alias("_p"))
            up = F.lit(0) if k == 1 else F.floor(F.col("node") / TREE_FAN)
            x, y = (d.join(parents, (F.col(unit) == F.col("_u")) & (up == F.col("_p")), "left_semi") for d in (x, y))
        j = x.withColumnRenamed("h", "_a").join(y.withColumnRenamed("h", "_b"), [unit, "node"], "full")
        open_ = j.filter(~F.col("_a").eqNullSafe(F.col("_b")))
    return open_.select(unit, F.col("node").alias("segment"), F.col("_a").isNotNull().alias("in_a"), F.col("_b").isNotNull().alias("in_b"))


def dataset_fingerprint(frames: DataFrame, text: Column, expected: int | None = None) -> DataFrame:
    """Hash per trip and for all trips (ALL), the roots of hash trees; flags duplicates, disorder
    (t_sec not rising with frame_id) and unexpected counts."""
    per = hash_tree(frames, text)[-1].drop("node")
    f = previous(frames.select("trip_id", "frame_id", "t_sec"), ["trip_id"], ["frame_id"], {"_t": "t_sec", "_f": "frame_id"})
    flags = f.groupBy("trip_id").agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(F.col("_f") == F.col("frame_id")).alias("duplicates"),
        F.count_if(F.col("t_sec") <= F.col("_t")).alias("disorder"))
    out = per.join(flags, "trip_id")
    total = out.agg(F.sum("frames").alias("frames"), F.sum("duplicates").alias("duplicates"), F.sum("disorder").alias("disorder")).join(
        root_of_units(per)).select(F.lit("ALL").alias("trip_id"), "h", "frames", "duplicates", "disorder")  # one row beside one row
    out = out.unionByName(total)
    wrong = F.lit(False) if expected is None else (F.col("trip_id") != "ALL") & (F.col("frames") != expected)
    return out.withColumnRenamed("h", "fingerprint").withColumn("wrong_count", wrong)


def submission_manifest(preds: DataFrame, line: Column) -> DataFrame:
    """Rows, danger frames and content hash (root of the hash tree) per trip."""
    h = hash_tree(preds, line)[-1].select("trip_id", F.col("h").alias("content_hash"))
    return preds.groupBy("trip_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(is_danger("predicted_ttc")).alias("danger_frames")).join(h, "trip_id")


def trip_inventory(frames: DataFrame, classes: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """One row per trip: size, continuity, time steps, duration, severity counts, class counts, events.

    frames: trip_id, frame_id, t_sec, min_ttc. classes: trip_id, class_name per target. events: trip_id,
    event_no, type (NULL: unknown) per entry of the trip's event log, listed in its order.
    """
    p = previous(frames.select("trip_id", "frame_id", "t_sec", "min_ttc"), ["trip_id"], ["frame_id"], {"_t": "t_sec"})
    p = p.withColumn("step", F.col("t_sec") - F.col("_t"))
    m = F.col("min_ttc")
    s = p.groupBy("trip_id").agg(
        F.count(F.lit(1)).alias("n_frames"), F.min("frame_id").alias("first_id"), F.max("frame_id").alias("last_id"),
        F.count_distinct("frame_id").alias("_ids"), F.count_if(F.col("step") <= 0).alias("_back"),
        F.min("step").alias("step_min"), F.max("step").alias("step_max"), F.min("t_sec").alias("_t0"), F.max("t_sec").alias("_t1"),
        F.count_if(is_finite("min_ttc")).alias("finite_truth"), F.count_if(m < CRITICAL_ZONE_TTC).alias("below_3s"),
        F.count_if(m < DANGER_TTC).alias("below_2s"), F.count_if(m < SEVERE_TTC).alias("below_1_5s"))
    s = s.join(exact_quantiles(p, ["trip_id"], "step", {"step_median": 0.5}), "trip_id", "left")
    s = s.join(count_episodes(frames, is_danger("min_ttc")).withColumnRenamed("episodes", "danger_episodes"), "trip_id")
    out = s.select(
        "trip_id", "n_frames", "first_id", "last_id",
        ((F.col("first_id") == 0) & (F.col("last_id") == F.col("n_frames") - 1) & (F.col("_ids") == F.col("n_frames"))).alias("contiguous"),
        (F.col("_back") == 0).alias("monotonic"), "step_median", "step_min", "step_max",
        (F.col("_t1") - F.col("_t0") + F.coalesce("step_median", F.lit(0.0))).alias("duration_s"),
        "finite_truth", "below_3s", "below_2s", "below_1_5s", "danger_episodes")
    if classes is not None:
        n = classes.groupBy("trip_id", "class_name").agg(F.count(F.lit(1)).alias("n"))
        parts = F.array_sort(F.collect_list(F.concat_ws(":", "class_name", "n")))
        out = out.join(n.groupBy("trip_id").agg(F.array_join(parts, ";").alias("target_classes")), "trip_id", "left")
    if events is not None:  # an event log is one array of a trip document
        e = F.array_sort(F.collect_list(F.struct("event_no", F.coalesce("type", F.lit("unknown")).alias("type"))))
        log = events.groupBy("trip_id").agg(F.count(F.lit(1)).alias("n_events"), F.array_join(F.transform(e, lambda x: x["type"]), ";").alias("event_types"))
        out = out.join(log, "trip_id", "left").na.fill(0, ["n_events"]).na.fill("", ["event_types"])
    return out


def audit_anomalies(inv: DataFrame, expected_trips: DataFrame | None = None) -> DataFrame:
    """ERROR and WARN rows from an inventory.

    Optional columns widen the checks: modality counts ``*_count``, description_s, split,
    all_zero_images, invalid_images, image_size (expected 640x360; NULL or empty: not known), fx,
    baseline_m (expected 320.0 and 0.3).
    """
    def row(sev, cat, cond, detail):
        return F.when(F.coalesce(cond, F.lit(False)), F.struct(
            F.lit(sev).alias("severity"), F.lit(cat).alias("category"), detail.cast("string").alias("detail")))
    has = set(inv.columns)
    rows = [
        row("ERROR", "timeline", ~(F.col("contiguous") & F.col("monotonic")), F.lit("ids or times not contiguous and rising")),
        row("WARN", "timestamp_step", (F.abs(F.col("step_min") - FRAME_PERIOD_S) > 1e-6) | (F.abs(F.col("step_max") - FRAME_PERIOD_S) > 1e-6),
            F.format_string("%.3f-%.3f", "step_min", "step_max"))]
    for c in sorted(x for x in has if x.endswith("_count")):
        rows.append(row("ERROR", "modality_count", F.col(c) != F.col("n_frames"), F.concat_ws("", F.lit(f"{c}="), F.col(c))))
    if "description_s" in has:
        rows.append(row("WARN", "metadata_description", F.abs(F.col("description_s") - F.col("duration_s")) > 1.0, F.col("description_s")))
    if "split" in has:
        rows.append(row("ERROR", "redaction", (F.col("split") == "scored") & (F.col("finite_truth") > 0), F.col("finite_truth")))
    if "all_zero_images" in has:
        rows.append(row("WARN", "depth_all_zero", F.col("all_zero_images") > 0, F.col("all_zero_images")))
    if "invalid_images" in has:
        rows.append(row("ERROR", "image_decode", F.col("invalid_images") > 0, F.col("invalid_images")))
    if "image_size" in has:
        rows.append(row("ERROR", "image_size", (F.col("image_size") != "") & (F.col("image_size") != f"{IMAGE_WIDTH}x{IMAGE_HEIGHT}"), F.col("image_size")))
    for c, want in (("fx", 320.0), ("baseline_m", 0.3)):
        if c in has:
            rows.append(row("ERROR", "calibration", F.col(c).isNull() | (F.abs(F.col(c) - want) > abs(want) * 1e-6), F.col(c)))
    out = inv.select("trip_id", F.explode(F.array_compact(F.array(*rows))).alias("r")).select("trip_id", "r.*")
    if expected_trips is not None:
        gone = expected_trips.select("trip_id").distinct().join(inv, "trip_id", "left_anti").select(
            "trip_id", F.lit("ERROR").alias("severity"), F.lit("missing_trip").alias("category"), F.lit("").alias("detail"))
        out = out.unionByName(gone)
    return out


# fixed values: words of the document contracts
STATUS = ("valid", "degraded", "unknown")
LEVELS = ("SAFE", "WARNING", "DANGER", "CRITICAL", "UNKNOWN")
OBJECT_TYPES = ("vehicle", "car", "truck", "bus", "two_wheeler", "motorcycle", "bicycle", "pedestrian", "obstacle", "unknown")
SEVERITIES, CONFIDENCES = ("WARNING", "DANGER", "CRITICAL"), ("LOW", "MEDIUM", "HIGH")
MODES = ("causal_online", "offline_post_trip")
POLICIES = ("none", "validation_only", "calibration", "direct_inference", "interpolation")
FAULT_REASONS = (
    "missing_left_camera", "missing_right_camera", "corrupt_stereo_pair", "invalid_calibration",
    "detector_exception", "tracker_exception", "frame_drop", "irregular_timestamp")


def _unit(c):
    return (c < 0) | (c > 1)


def validate_perception(docs: DataFrame) -> DataFrame:
    """Add ``violations``: bounds, words, status rules, and the least TTC in the corridor."""
    o, d = F.col("objects"), F.col("degraded_reasons")
    low = F.array_min(F.transform(F.filter(o, lambda x: x["in_collision_corridor"] & x["ttc_sec"].isNotNull()), lambda x: x["ttc_sec"]))
    m, unknown = F.col("min_ttc_sec"), F.col("status") == "unknown"

    def some(fn):
        return F.exists(o, fn)

    def bad_box(x):
        b = x["bbox_xyxy"]
        ok = (F.size(b) == 4) & (b[0] >= 0) & (b[1] >= 0) & (b[0] < b[2]) & (b[1] < b[3]) & (b[2] <= F.col("image_width")) & (b[3] <= F.col("image_height"))
        return ~F.coalesce(ok, F.lit(False))
    near = F.abs(m - low) <= F.greatest(1e-6 * F.greatest(F.abs(m), F.abs(low)), F.lit(1e-6))
    return docs.withColumn("violations", codes({
        "frame_id": F.col("frame_id") < 0, "timestamp": F.col("timestamp") < 0, "status": ~F.col("status").isin(*STATUS),
        "risk_level": ~F.col("risk_level").isin(*LEVELS), "perception_quality": _unit(F.col("perception_quality")),
        "latency_ms": F.col("latency_ms") < 0, "min_ttc_range": m < 0, "bbox": some(bad_box),
        "object_type": some(lambda x: ~x["object_type"].isin(*OBJECT_TYPES)),
        "object_score": some(lambda x: _unit(x["detection_confidence"]) | _unit(x["ttc_quality"])),
        "object_range": some(lambda x: (x["distance_m"] < 0) | (x["ttc_sec"] < 0)),
        "reasons_repeat": F.size(F.array_distinct(d)) < F.size(d),
        "valid_with_reasons": (F.col("status") == "valid") & (F.size(d) > 0),
        "reason_missing": F.col("status").isin("degraded", "unknown") & (F.size(d) == 0),
        "unknown_not_empty": unknown & ((F.size(o) > 0) | m.isNotNull() | (F.col("risk_level") != "UNKNOWN") | (F.col("perception_quality") != 0)),
        "min_ttc": (low.isNull() & m.isNotNull()) | (low.isNotNull() & (m.isNull() | ~near)),
    }))


def validate_risk_event(events: DataFrame) -> DataFrame:
    return events.withColumn("violations", codes({
        "event_id": ~F.col("event_id").rlike("^[A-Za-z0-9_-]+-E[0-9]+$"), "frames": F.col("start_frame") > F.col("end_frame"),
        "times": F.col("start_time") > F.col("end_time"), "negative": (F.col("start_frame") < 0) | (F.col("start_time") < 0) | (F.col("min_ttc_sec") < 0),
        "severity": ~F.col("severity").isin(*SEVERITIES), "quality": _unit(F.col("event_quality")),
        "confidence": ~F.col("confidence_level").isin(*CONFIDENCES)}))


def validate_run_manifest(m: DataFrame) -> DataFrame:
    """Causal runs may not look ahead, know the event schedule, or interpolate depth."""
    causal = F.col("processing_mode") == "causal_online"
    return m.withColumn("violations", codes({
        "code_commit": ~F.col("code_commit").rlike("^[0-9a-f]{7,40}$"), "config_sha256": ~F.col("config_sha256").rlike("^[0-9a-f]{64}$"),
        "processing_mode": ~F.col("processing_mode").isin(*MODES), "depth_policy": ~F.col("depth_keyframe_policy").isin(*POLICIES),
        "future_frames": causal & F.col("uses_future_frames"), "event_schedule": causal & F.col("uses_full_event_schedule"),
        "interpolation": causal & (F.col("depth_keyframe_policy") == "interpolation")}))


def emit_perception(frames: DataFrame, run_id="run") -> DataFrame:
    """Documents from frames with a selected track. frames: trip_id, frame_id, t_sec, ttc, level,
    track_id (NULL: none), box, depth_m, closing_mps, confidence, latency_ms."""
    ttc = finite("ttc")
    b = F.col("box")
    quality = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence")))
    o = F.struct(
        "track_id", F.lit("unknown").alias("object_type"), F.array(b["x0"], b["y0"], b["x1"], b["y1"]).alias("bbox_xyxy"),
        F.lit(0.0).alias("detection_confidence"), F.col("depth_m").cast("double").alias("distance_m"),
        finite("closing_mps").alias("closing_speed_mps"), ttc.alias("ttc_sec"), F.lit(True).alias("in_collision_corridor"),
        quality.alias("ttc_quality"))
    none = F.array().cast(F_array_of(frames, o))
    has = F.col("track_id").isNotNull()
    return frames.select(
        F.lit("perception.v1").alias("schema_version"), F.lit(run_id).alias("run_id"), "trip_id", "frame_id",
        F.col("t_sec").alias("timestamp"), F.lit(IMAGE_WIDTH).cast("bigint").alias("image_width"),
        F.lit(IMAGE_HEIGHT).cast("bigint").alias("image_height"), F.lit("valid").alias("status"),
        F.when(has, F.array(o)).otherwise(none).alias("objects"), ttc.alias("min_ttc_sec"), F.col("level").alias("risk_level"),
        F.when(has, quality).otherwise(0.5).alias("perception_quality"), F.col("latency_ms").cast("double").alias("latency_ms"),
        F.array().cast("array<string>").alias("degraded_reasons"))


def F_array_of(df: DataFrame, c: Column):
    """Type of an array of ``c`` as evaluated on ``df``."""
    from pyspark.sql import types as T

    return T.ArrayType(df.select(c.alias("x")).schema["x"].dataType)


def unknown_document(faults: DataFrame, run_id="run") -> DataFrame:
    """Documents for frames that could not be processed. faults: trip_id, frame_id, t_sec, reason."""
    from roadrisk import schemas

    faults = faults.filter(F.col("reason").isin(*FAULT_REASONS))
    none = F.lit(None).cast("double")
    return faults.select(
        F.lit("perception.v1").alias("schema_version"), F.lit(run_id).alias("run_id"), "trip_id", "frame_id",
        F.col("t_sec").alias("timestamp"), F.lit(IMAGE_WIDTH).cast("bigint").alias("image_width"),
        F.lit(IMAGE_HEIGHT).cast("bigint").alias("image_height"), F.lit("unknown").alias("status"),
        F.array().cast(schemas.PERCEPTION["objects"].dataType).alias("objects"), none.alias("min_ttc_sec"),
        F.lit("UNKNOWN").alias("risk_level"), F.lit(0.0).alias("perception_quality"), F.lit(0.0).alias("latency_ms"),
        F.array("reason").alias("degraded_reasons"))


def validate_annotations(rows: DataFrame, allowed, finite_columns=()) -> DataFrame:
    """Error codes per annotation row. rows: trip_id, frame_id, box_index, label, columns."""
    n = rows.groupBy("trip_id", "frame_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_distinct("box_index").alias("_d"), F.max("box_index").alias("_m"))
    same = rows.groupBy("trip_id", "frame_id", "box_index").agg(F.count(F.lit(1)).alias("_same"))
    j = rows.join(n, ["trip_id", "frame_id"]).join(same, ["trip_id", "frame_id", "box_index"])
    label = F.trim(F.coalesce("label", F.lit("")))
    e = codes({
        "box_index": F.col("box_index") < 1, "duplicate_index": F.col("_same") > 1,
        "gap_in_index": (F.col("_d") != F.col("_m")) , "label": (label != "") & ~label.isin(*allowed),
        **{f"not_finite_{c}": F.col(c).isNotNull() & ~is_finite(c) for c in finite_columns}})
    return j.withColumn("errors", F.array_join(e, ",")).withColumn("unlabelled", label == "").drop("_n", "_d", "_m", "_same")


# fixed values: words a reviewer may enter per column of an object label
OBJECT_LABEL_WORDS = {
    "event_owner": ("yes", "no", "uncertain"),
    "path_relation": ("on_path", "adjacent", "crossing", "diverging", "uncertain"),
    "relative_motion": ("closing", "steady", "opening", "uncertain"), "occluded": ("yes", "no", "unknown"),
    "candidate_type": (
        "road_user", "static_structure", "shadow_reflection", "stereo_artifact", "mixed_unknown", "unknown"),
    "review_confidence": ("high", "medium", "low")}


def validate_object_labels(rows: DataFrame, ready=30) -> DataFrame:
    """One row: complete, invalid and provisional label rows, and whether review may begin.

    Every word must come from its list, the distance be positive or 'unknown'; a review needs
    ``ready`` complete rows, as many of high or medium confidence, and a known distance.
    """
    def word(c):
        return F.trim(F.coalesce(F.col(c), F.lit("")))
    cpa = word("cpa_distance_m")
    good = (cpa == "unknown") | F.coalesce(cpa.try_cast("double") > 0, F.lit(False))
    for c, allowed in OBJECT_LABEL_WORDS.items():
        good = good & word(c).isin(*allowed)
    mark = F.coalesce(F.col("notes").contains("PROVISIONAL"), F.lit(False))
    s = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(good).alias("complete"), F.count_if(~good).alias("invalid"),
        F.count_if(mark).alias("provisional"), F.count_if(good & word("review_confidence").isin("high", "medium")).alias("confident"),
        F.count_if(good & (cpa != "unknown")).alias("with_distance"))
    return s.withColumn("ready", (F.col("complete") >= ready) & (F.col("invalid") == 0) & (F.col("provisional") == 0)
                        & (F.col("confident") >= ready) & (F.col("with_distance") > 0))


# fixed values: parts of a name that betray identity or truth
BANNED_TOKENS = ("trip", "frame", "timestamp", "truth", "target")


def leakage_guard(columns) -> list[str]:
    """The feature names, unless one contains a banned word."""
    bad = [c for c in columns if any(t in c.lower() for t in BANNED_TOKENS)]
    if bad:
        raise ValueError(f"features leak identity or truth: {bad}")
    return list(columns)


def metric_regression(actual: DataFrame, expected: DataFrame, keys, metrics, tol: float) -> DataFrame:
    """One row per key and metric: both values, their distance, and whether it is within ``tol``."""
    a = actual.unpivot(list(keys), list(metrics), "metric", "actual")
    b = expected.unpivot(list(keys), list(metrics), "metric", "expected")
    j = a.join(b, [*keys, "metric"], "full_outer").withColumn("distance", F.abs(F.col("actual") - F.col("expected")))
    return j.withColumn("ok", F.coalesce(F.col("distance") <= tol, F.col("actual").isNull() & F.col("expected").isNull()))


def non_finite_paths(df: DataFrame, columns) -> DataFrame:
    """Names of the numeric fields of a row that are NaN or infinite; rows without any are dropped."""
    e = codes({c: F.isnan(c) | (F.abs(c) == float("inf")) for c in columns})
    return df.withColumn("paths", F.array_join(e, ",")).filter("paths <> ''")


def acceptance(gates: DataFrame, names) -> DataFrame:
    """Add ``accepted`` and the failed gates of boolean columns ``names`` (NULL fails)."""
    e = codes({n: ~F.coalesce(F.col(n), F.lit(False)) for n in names})
    return gates.withColumn("failures", F.array_join(e, ",")).withColumn("accepted", F.col("failures") == "")
