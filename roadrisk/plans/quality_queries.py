"""Queries over data quality, contracts, text forms and gates."""
from pyspark.sql import functions as F

from roadrisk.functions import geometry as G
from roadrisk.functions import ttc as X
from roadrisk.operators import association as A
from roadrisk.operators import audits as D
from roadrisk.operators import memory as K
from roadrisk.operators import quality as C
from roadrisk.operators import scoring as S
from roadrisk.operators import sampling as P
from roadrisk.plans import event_queries as EQ
from roadrisk.plans import sqltext as Q
from roadrisk.plans.inputs import detections, measured, observations, union_predictions, variant_predictions
from roadrisk.plans.registry import query
from roadrisk.sources import readers as SR
from roadrisk.sources import writers as W

T, FR = "trip_id", "frame_id"

# a prediction file with flaws: rows lost, repeated, shifted in time, and bad TTC texts
FLAWED_TEXT = """SELECT trip_id, frame_id * 2 + copy AS row_no, frame_id, t_sec + CASE WHEN k % 89 = 0 THEN 2e-3 ELSE 0e0 END AS "timestamp",
 CASE WHEN k % 53 = 0 THEN 'nan' WHEN k % 59 = 0 THEN '-1.5' WHEN k % 61 = 0 THEN ' Infinity ' WHEN k % 67 = 0 THEN 'n/a' WHEN k % 71 = 0 THEN '0' WHEN k % 73 = 0 THEN '' ELSE '2.5' END AS predicted_ttc
FROM {frames}, {copies} WHERE (copy = 0 OR frame_id % 503 = 7) AND frame_id % 907 <> 11"""
FLAWED = "(" + FLAWED_TEXT.format(frames="frames", copies="(SELECT 0 AS copy UNION ALL SELECT 1) c") + ")"


def flawed(t):
    f = t.frames.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    k = F.col("k")
    text = (F.when(k % 53 == 0, "nan").when(k % 59 == 0, "-1.5").when(k % 61 == 0, " Infinity ").when(k % 67 == 0, "n/a")
            .when(k % 71 == 0, "0").when(k % 73 == 0, "").otherwise("2.5"))
    return f.filter("(copy = 0 OR frame_id % 503 = 7) AND frame_id % 907 <> 11").select(
        T, (F.col(FR) * 2 + F.col("copy")).alias("row_no"), FR,
        (F.col("t_sec") + F.when(k % 89 == 0, 0.002).otherwise(0.0)).alias("timestamp"), text.alias("predicted_ttc"))


PARSED = """SELECT trip_id, row_no, CASE WHEN w THEN NULL WHEN d IS NULL OR NOT isfinite(d) THEN 'not numeric' WHEN d < 0 THEN 'out of range' END AS error,
 CASE WHEN NOT w AND isfinite(d) AND d >= 0 THEN d END AS value, CASE WHEN NOT w AND d IS NOT NULL AND isfinite(d) THEN d END AS lenient, CASE WHEN NOT w AND d IS NOT NULL AND isfinite(d) THEN d ELSE 99 END AS sentinel99,
 CASE WHEN w THEN NULL WHEN d IS NULL OR NOT isfinite(d) THEN 'not numeric' WHEN d <= 0 THEN 'out of range' END AS positive_error
FROM (SELECT *, x IN ('inf', '+inf', 'infinity', '+infinity') AS w, try_cast(x AS DOUBLE) AS d FROM (SELECT *, lower(trim(predicted_ttc)) AS x FROM {f}))""".format(f=FLAWED)


@query("parse_ttc", PARSED, "value lenient sentinel99")
def _(t):
    p = {m: X.parse_ttc("predicted_ttc", m) for m in ("strict", "lenient", "sentinel99", "positive")}
    return flawed(t).select(T, "row_no", p["strict"]["error"].alias("error"), p["strict"]["value"].alias("value"),
                            p["lenient"]["value"].alias("lenient"), p["sentinel99"]["value"].alias("sentinel99"), p["positive"]["error"].alias("positive_error"))


CHECKED = f"""(SELECT coalesce(p.trip_id, f.trip_id) AS trip_id, coalesce(p.position, f.position) AS position, concat_ws(',', CASE WHEN p.trip_id IS NULL THEN 'missing_row' END, CASE WHEN f.trip_id IS NULL THEN 'extra_row' END,
  CASE WHEN p.frame_id <> f.id THEN 'frame_id' END, CASE WHEN abs(p."timestamp" - f.t) > 1e-6 THEN 'timestamp' END, CASE WHEN p.error IS NOT NULL THEN 'ttc' END) AS errors, p.value IS NOT NULL AS fin
 FROM (SELECT a.*, b.error, b.value, row_number() OVER (PARTITION BY a.trip_id ORDER BY a.row_no) - 1 AS position FROM {FLAWED} a JOIN ({PARSED}) b ON b.trip_id = a.trip_id AND b.row_no = a.row_no) p
 FULL JOIN (SELECT trip_id, frame_id AS id, t_sec AS t, row_number() OVER (PARTITION BY trip_id ORDER BY frame_id) - 1 AS position FROM frames) f ON f.trip_id = p.trip_id AND f.position = p.position)"""


@query("validate_predictions", f"SELECT trip_id, position, errors FROM {CHECKED} WHERE errors <> ''")
def _(t):
    return C.validate_predictions(flawed(t), t.frames).filter("errors <> ''").select(T, "position", "errors")


@query("validation_summary", f"""SELECT trip_id, count(*) AS "rows", count(*) FILTER (WHERE errors <> '') AS error_rows, count(*) FILTER (WHERE errors = '' AND fin) AS finite_predictions, count(*) FILTER (WHERE errors = '' AND NOT fin) AS infinite_predictions
FROM {CHECKED} GROUP BY trip_id""")
def _(t):
    return C.validation_summary(C.validate_predictions(flawed(t), t.frames))


@query("validate_submission", f"""SELECT trip_id, count(*) AS "rows", count(*) FILTER (WHERE frame_id <> pos) AS bad_ids, count(*) FILTER (WHERE NOT coalesce("timestamp" > before, true)) AS bad_times,
 count(*) FILTER (WHERE positive_error IS NOT NULL) AS bad_ttc, count(*) FILTER (WHERE value < 2 AND positive_error IS NULL) AS danger_frames, false AS valid
FROM (SELECT a.*, b.positive_error, b.value, row_number() OVER w - 1 AS pos, lag(a."timestamp") OVER w AS before FROM {FLAWED} a JOIN ({PARSED}) b ON b.trip_id = a.trip_id AND b.row_no = a.row_no WINDOW w AS (PARTITION BY a.trip_id ORDER BY a.row_no)) GROUP BY trip_id""")
def _(t):
    return C.validate_submission(flawed(t), 1800)


@query("trip_set_check", """SELECT trip_id, 'missing' AS problem FROM (SELECT trip_id FROM frames EXCEPT SELECT trip_id FROM stream_frames)
UNION ALL SELECT trip_id, 'extra' FROM (SELECT trip_id FROM stream_frames EXCEPT SELECT trip_id FROM frames)""")
def _(t):
    return C.trip_set_check(t.stream_frames, t.frames)


LINE = "concat_ws(',', frame_id, printf('%.3f', t_sec), CASE WHEN isfinite(predicted_ttc) THEN printf('%.6f', predicted_ttc) ELSE 'inf' END)"


def seg_sql(src, line, p=""):
    def up(name, below, node, at):
        return f"{p}{name} AS (SELECT trip_id, {node} AS s, sha256(string_agg(h, chr(10) ORDER BY s)) AS h FROM {p}{below} GROUP BY {at})"

    levels = [up(f"l{k + 1}", "seg" if k == 0 else f"l{k}", "s // 64", "trip_id, s // 64") for k in range(3)] + [up("th", "l3", "0", "trip_id")]
    return f"""{p}seg AS (SELECT trip_id, frame_id // 1024 AS s, sha256(string_agg({line}, chr(10) ORDER BY frame_id)) AS h FROM {src} GROUP BY trip_id, frame_id // 1024),
 {', '.join(levels)}"""


ROOT = """d4 AS (SELECT substr(sha256(trip_id), 1, 4) AS g, sha256(string_agg(h, chr(10) ORDER BY trip_id)) AS h FROM th GROUP BY 1),
 """ + ", ".join(f"d{k} AS (SELECT substr(g, 1, {k}) AS g, sha256(string_agg(h, chr(10) ORDER BY g)) AS h FROM d{k + 1} GROUP BY 1)" for k in (3, 2, 1, 0))


@query("dataset_fingerprint", f"""WITH {seg_sql("(SELECT *, min_ttc AS predicted_ttc FROM frames)", LINE)}, {ROOT},
 c AS (SELECT trip_id, count(*) AS frames, count(*) FILTER (WHERE f = frame_id) AS duplicates, count(*) FILTER (WHERE t_sec <= t) AS disorder FROM (SELECT *, lag(frame_id) OVER w AS f, lag(t_sec) OVER w AS t FROM frames WINDOW w AS (PARTITION BY trip_id ORDER BY frame_id)) GROUP BY trip_id)
SELECT_FINAL c.trip_id, h AS fingerprint, frames, duplicates, disorder, frames <> 1800 AS wrong_count FROM c JOIN th ON th.trip_id = c.trip_id
UNION ALL SELECT 'ALL', (SELECT h FROM d0), CAST(sum(frames) AS BIGINT), CAST(sum(duplicates) AS BIGINT), CAST(sum(disorder) AS BIGINT), false FROM c""")
def _(t):
    text = F.concat_ws(",", FR, F.format_string("%.3f", "t_sec"), X.ttc_text("min_ttc"))
    return C.dataset_fingerprint(t.frames, text, 1800)


# two runs: the second has other TTCs in some frames and lacks the frames from 900 on in some trips
RUN_A = "(SELECT trip_id, frame_id, t_sec, min_ttc AS predicted_ttc FROM frames)"
RUN_B = """(SELECT trip_id, frame_id, t_sec, CASE WHEN k % 1999 = 5 THEN 125e-2 ELSE min_ttc END AS predicted_ttc FROM frames WHERE NOT (trip_id IN ('T1', 'T4') AND frame_id >= 900))"""


@query("differing_segments", f"""WITH {seg_sql(RUN_A, LINE, 'a')}, {seg_sql(RUN_B, LINE, 'b')}
SELECT_FINAL coalesce(a.trip_id, b.trip_id) AS trip_id, coalesce(a.s, b.s) AS segment, a.h IS NOT NULL AS in_a, b.h IS NOT NULL AS in_b FROM aseg a FULL JOIN bseg b ON a.trip_id = b.trip_id AND a.s = b.s WHERE a.h IS DISTINCT FROM b.h""")
def _(t):
    line = F.concat_ws(",", FR, F.format_string("%.3f", "t_sec"), X.ttc_text("predicted_ttc"))
    a = t.frames.withColumnRenamed("min_ttc", "predicted_ttc")
    b = a.withColumn("predicted_ttc", F.when(F.col("k") % 1999 == 5, 1.25).otherwise(F.col("predicted_ttc"))).filter("NOT (trip_id IN ('T1', 'T4') AND frame_id >= 900)")
    return C.differing_segments(a, b, line)


@query("submission_manifest", f"""WITH {seg_sql(Q.UNION, LINE)}
SELECT_FINAL u.trip_id, count(*) AS "rows", count(*) FILTER (WHERE predicted_ttc < 2) AS danger_frames, any_value(h) AS content_hash FROM {Q.UNION} u JOIN th ON th.trip_id = u.trip_id GROUP BY u.trip_id""")
def _(t):
    line = F.concat_ws(",", FR, F.format_string("%.3f", "t_sec"), X.ttc_text("predicted_ttc"))
    return C.submission_manifest(union_predictions(t), line)


@query("prediction_text", f"""SELECT trip_id, frame_id, printf('%.6f', t_sec) AS "timestamp", CASE WHEN isfinite(predicted_ttc) THEN printf('%.6f', predicted_ttc) ELSE 'inf' END AS predicted_ttc FROM {Q.UNION}""")
def _(t):
    return W.prediction_columns(union_predictions(t))


@query("normalize_predictions", """SELECT trip_id, frame_id, "timestamp", predicted_ttc FROM """ + FLAWED, '"timestamp"')
def _(t):
    raw = flawed(t).withColumnRenamed("frame_id", "\ufeffframe_id")
    return W.normalize_predictions(raw.withColumn("ground_truth_ttc", F.lit("1")))


@query("detection_evidence_json", """SELECT trip_id, frame_id, '[' || string_agg('{"bbox_xyxy":[' || round(x0, 3) || ',' || round(y0, 3) || ',' || round(x1, 3) || ',' || round(y1, 3) || '],"class_id":' || class_id || ',"class_name":"'
 || CASE class_id WHEN 0 THEN 'person' WHEN 1 THEN 'bicycle' WHEN 2 THEN 'car' WHEN 3 THEN 'motorcycle' WHEN 5 THEN 'bus' WHEN 7 THEN 'truck' ELSE 'other' END || '","confidence":' || round(confidence, 6) || '}', ',' ORDER BY ordinal) || ']' AS raw_detections_json FROM detections GROUP BY trip_id, frame_id""")
def _(t):
    return W.detection_evidence_json(detections(t).withColumn("class_name", F.coalesce(A.class_name(), F.lit("other"))))


@query("track_measurements_json", f"""SELECT trip_id, frame_id, '[' || string_agg('{{"track_id":' || track_id || ',"timestamp":' || round(t_sec, 6) || ',"depth_m":' || round(depth_m, 6) || ',"center_x":' || round(centre_x, 3) || ',"depth_sigma_m":' || round(depth_sigma_m, 6) || '}}', ',' ORDER BY track_id) || ']' AS track_measurements_json FROM {Q.MEASURED} GROUP BY trip_id, frame_id""")
def _(t):
    m = measured(t).withColumn("depth_sigma_m", G.depth_sigma("depth_mad_m", "lr_support", "depth_confidence"))
    return W.track_measurements_json(m.select(T, FR, "track_id", "ordinal", "t_sec", "depth_m", "centre_x", "depth_sigma_m"))


@query("explode_frames", """SELECT trip_id, frame_id, target_no, track_id, depth_m FROM (SELECT *, row_number() OVER (PARTITION BY trip_id, frame_id ORDER BY ordinal) - 1 AS target_no FROM candidates)""", "depth_m")
def _(t):
    # documents hold one segment of a trip each, frames with nested targets in order
    c = t.candidates.groupBy(T, FR).agg(F.array_sort(F.collect_list(F.struct("ordinal", "track_id", "depth_m"))).alias("targets"))
    frame = F.struct(FR, F.transform("targets", lambda x: F.struct(x["track_id"].alias("track_id"), x["depth_m"].alias("depth_m"))).alias("targets"))
    docs = c.groupBy(T, F.floor(F.col(FR) / 64).alias("part")).agg(F.collect_list(frame).alias("frames"))
    return SR.explode_targets(docs)


INV = """SELECT f.trip_id, n_frames, first_id, last_id, contiguous, monotonic, step_median, step_min, step_max, duration_s, finite_truth, below_3s, below_2s, below_1_5s, danger_episodes, target_classes FROM (
 SELECT trip_id, count(*) AS n_frames, min(frame_id) AS first_id, max(frame_id) AS last_id, min(frame_id) = 0 AND max(frame_id) = count(*) - 1 AND count(DISTINCT frame_id) = count(*) AS contiguous, count(*) FILTER (WHERE step <= 0) = 0 AS monotonic,
  median(step) AS step_median, min(step) AS step_min, max(step) AS step_max, max(t_sec) - min(t_sec) + median(step) AS duration_s, count(*) FILTER (WHERE isfinite(min_ttc)) AS finite_truth, count(*) FILTER (WHERE min_ttc < 3) AS below_3s,
  count(*) FILTER (WHERE min_ttc < 2) AS below_2s, count(*) FILTER (WHERE min_ttc < 15e-1) AS below_1_5s, count(*) FILTER (WHERE min_ttc < 2 AND NOT coalesce(m < 2, false)) AS danger_episodes
 FROM (SELECT *, t_sec - lag(t_sec) OVER w AS step, lag(min_ttc) OVER w AS m FROM frames WINDOW w AS (PARTITION BY trip_id ORDER BY frame_id)) GROUP BY trip_id) f
LEFT JOIN (SELECT trip_id, string_agg(c || ':' || n, ';' ORDER BY c) AS target_classes FROM (SELECT trip_id, CASE class_id WHEN 0 THEN 'person' WHEN 1 THEN 'bicycle' WHEN 2 THEN 'car' WHEN 3 THEN 'motorcycle' WHEN 5 THEN 'bus' WHEN 7 THEN 'truck' ELSE 'other' END AS c, count(*) AS n FROM detections GROUP BY 1, 2) GROUP BY trip_id) d ON d.trip_id = f.trip_id"""


def inventory(t):
    cls = detections(t).select(T, F.coalesce(A.class_name(), F.lit("other")).alias("class_name"))
    return C.trip_inventory(t.frames, cls)


@query("trip_inventory", INV, "step_median step_min step_max duration_s")
def _(t):
    return inventory(t)


@query("audit_anomalies", f"""WITH i AS (SELECT *, CASE WHEN trip_id = 'T1' THEN n_frames - 3 ELSE n_frames END AS left_count, CASE WHEN trip_id >= 'T4' THEN 'scored' ELSE 'practice' END AS split, 300e0 AS fx, CAST(30 AS BIGINT) AS description_s, CASE trip_id WHEN 'T2' THEN '320x180' WHEN 'T3' THEN '' ELSE '640x360' END AS image_size FROM ({INV}))
SELECT_FINAL trip_id, 'ERROR' AS severity, 'timeline' AS category, 'ids or times not contiguous and rising' AS detail FROM i WHERE NOT (contiguous AND monotonic)
UNION ALL SELECT trip_id, 'WARN', 'timestamp_step', printf('%.3f-%.3f', step_min, step_max) FROM i WHERE abs(step_min - 5e-2) > 1e-6 OR abs(step_max - 5e-2) > 1e-6
UNION ALL SELECT trip_id, 'ERROR', 'modality_count', 'left_count=' || left_count FROM i WHERE left_count <> n_frames
UNION ALL SELECT trip_id, 'WARN', 'metadata_description', CAST(description_s AS VARCHAR) FROM i WHERE abs(description_s - duration_s) > 1
UNION ALL SELECT trip_id, 'ERROR', 'redaction', CAST(finite_truth AS VARCHAR) FROM i WHERE split = 'scored' AND finite_truth > 0
UNION ALL SELECT trip_id, 'ERROR', 'image_size', image_size FROM i WHERE trip_id = 'T2'
UNION ALL SELECT trip_id, 'ERROR', 'calibration', '300.0' FROM i
UNION ALL SELECT DISTINCT trip_id, 'ERROR', 'missing_trip', '' FROM stream_frames""")
def _(t):
    desc = X.description_seconds(F.lit("about 30s of road"))
    i = inventory(t).withColumns({
        "left_count": F.when(F.col(T) == "T1", F.col("n_frames") - 3).otherwise(F.col("n_frames")),
        "split": F.when(F.col(T) >= "T4", "scored").otherwise("practice"), "fx": F.lit(300.0), "description_s": desc,
        "image_size": F.when(F.col(T) == "T2", "320x180").when(F.col(T) == "T3", "").otherwise("640x360")})
    return C.audit_anomalies(i, t.stream_frames)


@query("description_seconds", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 40 END AS seconds FROM customer")
def _(t):
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, F.concat_ws("", F.lit("clip "), k % 40, F.lit(" seconds"))).otherwise(F.concat_ws("", F.lit("a clip of "), k % 40, F.lit("s, city")))
    return t.customer.select("c_custkey", X.description_seconds(text).alias("seconds"))


# which measured fields each split of trips has
@query("field_availability", """WITH v AS (SELECT trip_id, CASE WHEN trip_id >= 'T3' THEN 'scored' ELSE 'practice' END AS split, count(min_ttc) FILTER (WHERE isfinite(min_ttc) AND trip_id < 'T5') > 0 AS min_ttc, count(*) FILTER (WHERE speed_mps > 24) > 0 AS speed, count(*) FILTER (WHERE lateral_accel > 9e-1 AND trip_id <> 'T2') > 0 AS accel FROM frames GROUP BY trip_id)
SELECT_FINAL field, count(*) FILTER (WHERE p AND split = 'practice') AS practice, count(*) FILTER (WHERE p AND split = 'scored') AS scored FROM (SELECT split, 'min_ttc' AS field, min_ttc AS p FROM v UNION ALL SELECT split, 'speed', speed FROM v UNION ALL SELECT split, 'accel', accel FROM v) GROUP BY field""")
def _(t):
    from roadrisk.operators.availability import field_availability
    f = t.frames.select(
        T, F.when(F.col(T) >= "T3", "scored").otherwise("practice").alias("split"),
        F.when(X.is_finite("min_ttc") & (F.col(T) < "T5"), F.col("min_ttc")).alias("min_ttc"),
        F.when(F.col("speed_mps") > 24, F.col("speed_mps")).alias("speed"), F.when((F.col("lateral_accel") > 0.9) & (F.col(T) != "T2"), F.col("lateral_accel")).alias("accel"))
    return field_availability(f, ["min_ttc", "speed", "accel"])


# which fields raw documents mention
@query("json_path_exists", """SELECT event_id, list_contains(p, 'k') AS has_k, list_contains(p, 'none') AS has_none FROM (SELECT event_id, json_keys(props) AS p FROM events)""")
def _(t):
    from roadrisk.operators.availability import json_path_exists
    return t.events.select("event_id", json_path_exists("props", "k").alias("has_k"), json_path_exists("props", "none").alias("has_none"))


DOCS = f"""docs AS (SELECT u.trip_id, u.frame_id, u.t_sec, s.state, s.raw_band, c.track_id, c.x0, c.y0, c.x1, c.y1, c.confidence, CASE WHEN isfinite(u.predicted_ttc) THEN u.predicted_ttc END AS ttc, b.k FROM {Q.UNION} u JOIN states s ON s.trip_id = u.trip_id AND s.frame_id = u.frame_id AND s.preset = 'recommended'
 JOIN frames b ON b.trip_id = u.trip_id AND b.frame_id = u.frame_id LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trip_id, frame_id ORDER BY candidate_ttc, ordinal) AS rn FROM {Q.BOX} WHERE confidence >= 55e-2 AND closing_mps BETWEEN 3e-1 AND 40 AND isfinite(candidate_ttc)) WHERE rn = 1) c ON c.trip_id = u.trip_id AND c.frame_id = u.frame_id)"""


def documents(t):
    """Perception documents of union predictions under the recommended preset."""
    from roadrisk.operators import risk_states as R
    from roadrisk.plans.inputs import updates
    u = union_predictions(t)
    s = R.risk_states(u, ttc="predicted_ttc").select(T, FR, X.risk_level("state", "raw_band").alias("level"))
    chosen = S.select_min_ttc(t.candidates).select(T, FR, "track_id", "confidence", "closing_mps", F.col("ttc").alias("_ttc"))
    first = F.min(F.struct("candidate_ttc", "ordinal", "box", "depth_m"))
    ok = (F.col("confidence") >= 0.55) & F.col("closing_mps").between(0.3, 40.0) & X.is_finite("candidate_ttc")
    b = updates(t).filter(ok).groupBy(T, FR).agg(first.alias("b")).select(T, FR, "b.box", "b.depth_m")
    j = u.select(T, FR, "t_sec", F.col("predicted_ttc").alias("ttc")).join(s, [T, FR]).join(chosen, [T, FR], "left").join(b, [T, FR], "left")
    return C.emit_perception(j.join(t.frames.select(T, FR, F.col("k").alias("latency_ms")), [T, FR]).drop("_ttc"))


@query("emit_perception", f"""WITH {EQ.UNION_FSM}, {DOCS}
SELECT_FINAL trip_id, frame_id, CASE WHEN track_id IS NULL THEN 0 ELSE 1 END AS n_objects, ttc AS min_ttc_sec, CASE state WHEN 'HIGH_RISK' THEN CASE WHEN raw_band IN ('DANGER', 'CRITICAL') THEN raw_band ELSE 'DANGER' END WHEN 'ATTENTIVE' THEN 'WARNING' ELSE 'SAFE' END AS risk_level,
 CASE WHEN track_id IS NULL THEN 5e-1 ELSE least(1, greatest(0, confidence)) END AS perception_quality FROM docs""", "min_ttc_sec perception_quality")
def _(t):
    return documents(t).select(T, FR, F.size("objects").alias("n_objects"), "min_ttc_sec", "risk_level", "perception_quality")


@query("validate_perception", f"""WITH {EQ.UNION_FSM}, {DOCS}
SELECT_FINAL trip_id, frame_id, concat_ws(',', CASE WHEN track_id IS NOT NULL AND NOT (x0 < x1 AND y0 < y1 AND x1 <= 640 AND y1 <= 300) THEN 'bbox' END, CASE WHEN k % 13 = 0 THEN 'reason_missing' END, CASE WHEN k % 13 = 0 AND k % 2 = 0 THEN 'unknown_not_empty' END,
  CASE WHEN track_id IS NULL AND ttc IS NOT NULL THEN 'min_ttc' WHEN track_id IS NOT NULL AND k % 17 = 0 AND ttc > 0 THEN 'min_ttc' END) AS violations FROM docs""")
def _(t):
    k = F.col("latency_ms").cast("bigint")
    d = documents(t).withColumns({
        "status": F.when(k % 13 == 0, F.when(k % 2 == 0, "unknown").otherwise("degraded")).otherwise("valid"),
        "min_ttc_sec": F.when((F.size("objects") > 0) & (k % 17 == 0), F.col("min_ttc_sec") * 2).otherwise(F.col("min_ttc_sec")),
        "image_height": F.lit(300).cast("bigint")})
    return C.validate_perception(d).select(T, FR, F.array_join("violations", ",").alias("violations"))


@query("non_finite_paths", """SELECT trip_id, frame_id, concat_ws(',', CASE WHEN NOT isfinite(classical_ttc) THEN 'classical_ttc' END, CASE WHEN NOT isfinite(min_ttc) THEN 'min_ttc' END) AS paths FROM predictions WHERE NOT isfinite(classical_ttc) OR NOT isfinite(min_ttc)""")
def _(t):
    return C.non_finite_paths(t.predictions, ["classical_ttc", "min_ttc"]).select(T, FR, "paths")


@query("validate_risk_event", f"""WITH {EQ.STREAM_FSM}, {EQ.EVENTS}
SELECT_FINAL trip_id, start_frame, concat_ws(',', CASE WHEN trip_id LIKE '%7' THEN 'event_id' END, CASE WHEN end_frame - 3 < start_frame THEN 'frames' END) AS violations FROM ev""")
def _(t):
    from roadrisk.operators import events as E
    from roadrisk.operators.lineage import cut
    e = E.risk_events(cut(EQ.stream_states(t)))
    e = e.withColumns({
        "event_id": F.concat_ws("", T, F.when(F.col(T).endswith("7"), " E").otherwise("-E"), "event_no"), "end_frame": F.col("end_frame") - 3,
        "start_time": F.col("start_frame") * 0.05, "end_time": F.col("start_frame") * 0.05 + 1})
    return C.validate_risk_event(e).select(T, "start_frame", F.array_join("violations", ",").alias("violations"))


@query("validate_run_manifest", """SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 10 = 3 THEN 'code_commit' END, CASE WHEN c_nationkey % 2 = 0 AND c_custkey % 5 = 0 THEN 'future_frames' END, CASE WHEN c_nationkey % 2 = 0 AND c_custkey % 7 = 0 THEN 'event_schedule' END,
 CASE WHEN c_nationkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'interpolation' END) AS violations FROM customer""")
def _(t):
    k = F.col("c_custkey")
    m = t.customer.select(
        "c_custkey", F.when(k % 10 == 3, "not a commit").otherwise(F.substring(F.sha2(k.cast("string"), 256), 1, 12)).alias("code_commit"),
        F.sha2(F.col("c_name"), 256).alias("config_sha256"), F.when(F.col("c_nationkey") % 2 == 0, "causal_online").otherwise("offline_post_trip").alias("processing_mode"),
        (k % 5 == 0).alias("uses_future_frames"), (k % 7 == 0).alias("uses_full_event_schedule"), F.when(k % 3 == 0, "interpolation").otherwise("none").alias("depth_keyframe_policy"))
    return C.validate_run_manifest(m).select("c_custkey", F.array_join("violations", ",").alias("violations"))


@query("unknown_document", """SELECT trip_id, frame_id, 'unknown' AS status, ['missing_left_camera', 'missing_right_camera', 'corrupt_stereo_pair', 'invalid_calibration', 'detector_exception', 'tracker_exception', 'frame_drop', 'irregular_timestamp'][k % 8 + 1] AS reason, '' AS violations FROM frames""")
def _(t):
    words = F.array(*[F.lit(r) for r in C.FAULT_REASONS])
    f = t.frames.select(T, FR, "t_sec", words[(F.col("k") % 8).cast("int")].alias("reason"))
    d = C.validate_perception(C.unknown_document(f))
    return d.select(T, FR, "status", F.col("degraded_reasons")[0].alias("reason"), F.array_join("violations", ",").alias("violations"))


@query("validate_annotations", """SELECT trip_id, frame_id, ordinal, concat_ws(',', CASE WHEN bi < 1 THEN 'box_index' END, CASE WHEN count(*) OVER (PARTITION BY trip_id, frame_id, bi) > 1 THEN 'duplicate_index' END, CASE WHEN d <> m THEN 'gap_in_index' END, CASE WHEN lab = 'wrong' THEN 'label' END, CASE WHEN NOT isfinite(candidate_ttc) THEN 'not_finite_candidate_ttc' END) AS errors, lab = '' AS unlabelled
FROM (SELECT *, count(DISTINCT bi) OVER (PARTITION BY trip_id, frame_id) AS d, max(bi) OVER (PARTITION BY trip_id, frame_id) AS m FROM (SELECT *, CASE WHEN track_id = 7 THEN ordinal - 1 ELSE ordinal END AS bi, CASE track_id WHEN 1 THEN 'genuine_miss' WHEN 2 THEN 'wrong' WHEN 3 THEN '' ELSE 'unsure' END AS lab FROM candidates))""")
def _(t):
    k = F.col("track_id")
    r = t.candidates.select(T, FR, "ordinal", F.when(k == 7, F.col("ordinal") - 1).otherwise(F.col("ordinal")).alias("box_index"),
                            F.when(k == 1, "genuine_miss").when(k == 2, "wrong").when(k == 3, "").otherwise("unsure").alias("label"), "candidate_ttc")
    v = C.validate_annotations(r, ["genuine_miss", "stereo_noise", "association_failure", "unsure"], ["candidate_ttc"])
    return v.select(T, FR, "ordinal", "errors", "unlabelled")


@query("validate_object_labels", """SELECT count(*) AS "rows", count(*) FILTER (WHERE track_id <> 5) AS complete, count(*) FILTER (WHERE track_id = 5) AS invalid, count(*) FILTER (WHERE track_id = 2) AS provisional, count(*) FILTER (WHERE track_id <> 5 AND track_id <> 3) AS confident, count(*) FILTER (WHERE track_id <> 5 AND track_id <> 4) AS with_distance, false AS ready FROM track_labels""")
def _(t):
    k = F.col("track_id")
    r = t.track_labels.select(
        F.lit("yes").alias("event_owner"), "path_relation", F.when(k == 5, "sideways").otherwise("closing").alias("relative_motion"), F.lit("no").alias("occluded"), F.lit("road_user").alias("candidate_type"),
        F.when(k == 3, "low").otherwise("high").alias("review_confidence"), F.when(k == 4, "unknown").otherwise(F.col("cpa_distance_m").cast("string")).alias("cpa_distance_m"), F.when(k == 2, A.PROVISIONAL_MARK).alias("notes"))
    return C.validate_object_labels(r)


SC = f"({Q.score(Q.VARIANTS, 'variant, trip_id')})"


@query("metric_regression", f"""SELECT trip_id, metric, actual, expected, abs(actual - expected) AS distance, abs(actual - expected) <= 5e-2 AS ok FROM (
 {' UNION ALL '.join(f"SELECT a.trip_id, '{m}' AS metric, a.{m} AS actual, b.{m} AS expected FROM {SC} a JOIN {SC} b ON b.trip_id = a.trip_id AND b.variant = 'classical' WHERE a.variant = 'union'" for m in ('f1', 'composite', 'recall'))})""", "actual expected distance")
def _(t):
    s = S.ttc_score(variant_predictions(t), ["variant", T])
    return C.metric_regression(s.filter("variant = 'union'"), s.filter("variant = 'classical'"), [T], ["f1", "composite", "recall"], 0.05)


DIAG = "centre_x / 640 AS center_x_norm, y1 / 360 AS bottom_y_norm, (x1 - x0) / 640 AS width_norm, (y1 - y0) / 360 AS height_norm"
DIAG_DOUBLES = "center_x_norm bottom_y_norm width_norm height_norm residual_m quality depth_mad_m depth_mad_ratio lr_support corridor_overlap"
KNOWN = "CASE WHEN n >= 3 THEN residual END"


@query("track_diagnostics", f"""WITH {Q.remembered()}
SELECT_FINAL trip_id, track_id, frame_id, {DIAG}, rn AS hits, n AS history, {KNOWN} AS residual_m, quality, depth_mad_m, depth_mad_m / depth_m AS depth_mad_ratio, lr_support, corridor_overlap FROM rs""", DIAG_DOUBLES)
def _(t):
    m = measured(t.framed).select(T, "track_id", FR, "t_sec", "box", "depth_m", "quality", "depth_mad_m", "lr_support", "corridor_overlap", "depth_confidence")
    return K.track_diagnostics(K.robust(m))


CHOSEN = """s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trip_id, frame_id ORDER BY candidate_ttc, ordinal) AS pick FROM candidates WHERE confidence >= 55e-2 AND closing_mps BETWEEN 3e-1 AND 40 AND isfinite(candidate_ttc)) WHERE pick = 1)"""
OF_FRAME = """FROM (SELECT trip_id, frame_id FROM frames) f LEFT JOIN (SELECT rs.* FROM rs JOIN s ON s.trip_id = rs.trip_id AND s.frame_id = rs.frame_id AND s.track_id = rs.track_id) c ON c.trip_id = f.trip_id AND c.frame_id = f.frame_id"""


def chosen_rows(t, *more):
    """What is remembered of the chosen track of each frame; the choice is made where the frame lies."""
    t = t.framed
    chosen = S.select_min_ttc(t.candidates).select(T, FR, F.col("track_id").alias("_chosen"))
    m = measured(t).join(chosen, [T, FR], "left")
    m = m.select(T, "track_id", FR, "t_sec", "box", "depth_m", "quality", "depth_mad_m", "lr_support", "depth_confidence", "_chosen", *more)
    return K.robust(m.withColumn("_only", F.col("_chosen") == F.col("track_id")).drop("_chosen"), F.col("_only"))


@query("selected_diagnostics", f"""WITH {Q.remembered()}, {CHOSEN}
SELECT_FINAL f.trip_id, f.frame_id, track_id AS selected_track_id, {', '.join(f'{x} AS selected_{n}' for n, x in (
    ('center_x_norm', 'centre_x / 640'), ('bottom_y_norm', 'y1 / 360'), ('width_norm', '(x1 - x0) / 640'), ('height_norm', '(y1 - y0) / 360'), ('hits', 'coalesce(rn, 0)'), ('history', 'coalesce(n, 0)'), ('residual_m', KNOWN),
    ('quality', 'quality'), ('depth_mad_m', 'depth_mad_m'), ('depth_mad_ratio', 'depth_mad_m / depth_m'), ('lr_support', 'lr_support'), ('corridor_overlap', 'corridor_overlap')))} {OF_FRAME}""",
       " ".join(f"selected_{c}" for c in DIAG_DOUBLES.split()))
def _(t):
    return K.selected_diagnostics(t.frames.select(T, FR), None, chosen_rows(t, "corridor_overlap"))


@query("selected_evidence", f"""WITH {Q.remembered()}, {CHOSEN}
SELECT_FINAL f.trip_id, f.frame_id, track_id AS selected_track_id, depth_m AS selected_depth_m, {KNOWN} AS selected_motion_residual_m, quality AS selected_observation_quality, depth_confidence AS selected_depth_confidence,
 lr_support AS selected_lr_support, coalesce(n, 0) AS selected_history_length, '[' || CAST(x0 AS INTEGER) || ',' || CAST(y0 AS INTEGER) || ',' || CAST(x1 AS INTEGER) || ',' || CAST(y1 AS INTEGER) || ']' AS selected_bbox_xyxy,
 coalesce('[' || array_to_string({Q.each("'{\"timestamp\":' || round(q.t, 6) || ',\"depth_m\":' || round(q.v, 6) || ',\"center_x\":' || round(q.x, 3) || ',\"depth_sigma_m\":' || round(q.s, 6) || '}'")}, ',') || ']', '[]') AS selected_observations_json {OF_FRAME}""",
       "selected_depth_m selected_motion_residual_m selected_observation_quality selected_depth_confidence selected_lr_support")
def _(t):
    return K.selected_evidence(t.frames.select(T, FR), None, chosen_rows(t))


FC = "CASE WHEN kn >= 3 THEN -kv ELSE 0 END"
FR_M = "CASE WHEN kn >= 3 THEN ema + 1e-1 * sqrt(greatest(0, pxx)) + 2e-1 * missed END"
GONE = "greatest(0, now - t_sec)"


@query("track_memory", f"""WITH {Q.remembered()}, {Q.kalman(Q.MEASURED)},
 z AS (SELECT rs.*, k.x AS kx, k.v AS kv, k.pxx, k.ema, k.n AS kn, {Q.total('q.q')} / rs.n AS mq, {Q.total('q.c')} / rs.n AS mc FROM rs JOIN k ON k.trip_id = rs.trip_id AND k.track_id = rs.track_id AND k.rn = rs.rn),
 al AS (SELECT z.*, m AS missed, frame_id + m AS at_frame FROM z, (SELECT unnest(generate_series(0, 3)) AS m) g),
 nw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trip_id, track_id, at_frame ORDER BY missed) AS pick FROM al) WHERE pick = 1),
 mm AS (SELECT nw.*, f.t_sec AS now, row_number() OVER (PARTITION BY nw.trip_id, nw.track_id ORDER BY at_frame) AS i FROM nw JOIN frames f ON f.trip_id = nw.trip_id AND f.frame_id = nw.at_frame),
 ss AS (SELECT *, list(CASE WHEN matched AND missed = 0 THEN det_confidence ELSE 0e0 END) OVER (PARTITION BY trip_id, track_id ORDER BY i ROWS BETWEEN 95 PRECEDING AND CURRENT ROW) AS seen,
  i - coalesce(max(CASE WHEN matched AND missed = 0 THEN i END) OVER (PARTITION BY trip_id, track_id ORDER BY i), 0) AS misses, kx + CASE WHEN kn >= 3 THEN {GONE} * kv ELSE 0 END AS distance FROM mm)
SELECT_FINAL trip_id, track_id, at_frame AS frame_id, missed, rn AS hits, n AS history, depth_m, depth_sigma_m, CASE WHEN n >= 3 THEN -slope ELSE 0 END AS closing_mps, distance AS filter_distance_m, {FC} AS filter_closing_mps,
 CASE WHEN kn >= 3 AND distance > 0 AND -kv > 3e-1 THEN distance / -kv END AS filter_ttc, {FR_M} AS filter_residual_m, rn >= 3 AS confirmed,
 25e-2 * least(1, n / 7) + 3e-1 * mq + 2e-1 * CASE WHEN n >= 3 THEN exp(-residual / greatest(5e-1, depth_m / 10)) ELSE 0 END + 15e-2 + CASE WHEN n >= 3 AND -slope > 3e-1 THEN 1e-1 ELSE 5e-2 END AS confidence,
 (8e-1 * (25e-2 * least(1, n / 7) + 3e-1 * mq + 2e-1 * coalesce(exp(-({FR_M}) / greatest(5e-1, depth_m / 10)), 0) + 15e-2 + CASE WHEN {FC} > 3e-1 THEN 1e-1 ELSE 5e-2 END) + 2e-1 * mc) * 82e-2 ** missed AS filter_confidence,
 4e-1 * list_sum(list_transform(generate_series(1, len(seen)), lambda j: seen[j] * 6e-1 ** (len(seen) - j))) AS score, misses
FROM ss WHERE missed <= 2""", "depth_m depth_sigma_m closing_mps filter_distance_m filter_closing_mps filter_ttc filter_residual_m confidence filter_confidence score")
def _(t):
    t = t.framed
    o = measured(t).select(T, "track_id", FR, "ordinal", "t_sec", "box", "depth_m", "quality", "depth_mad_m", "lr_support", "depth_confidence", "matched", "det_confidence")
    m = K.track_memory(o, t.frames.select(T, FR, "t_sec"), with_semantics=True)
    return m.select(T, "track_id", FR, "missed", "hits", F.col("history").cast("bigint").alias("history"), "depth_m", "depth_sigma_m", "closing_mps", "filter_distance_m",
                    "filter_closing_mps", "filter_ttc", "filter_residual_m", "confirmed", "confidence", "filter_confidence", "score", "misses")


@query("prefix_columns", "SELECT trip_id, frame_id, classical_ttc AS base_classical_ttc, detector_ttc AS base_detector_ttc FROM predictions", "base_classical_ttc base_detector_ttc")
def _(t):
    from roadrisk.operators.evidence import prefix_columns
    return prefix_columns(t.predictions.select(T, FR, "classical_ttc", "detector_ttc"), "base")


@query("blind_projection", "SELECT trip_id, frame_id, track_id, path_relation FROM track_labels")
def _(t):
    from roadrisk.operators.evidence import blind_projection
    return blind_projection(t.track_labels, [T, FR, "track_id", "path_relation"])


# gates of a run: latency of each repeat and quality against the classical source
LAT = """(SELECT "repeat", quantile_cont(compute_ms, 95e-2) AS p95 FROM runtime GROUP BY "repeat")"""


@query("latency_gate", f"SELECT \"repeat\", p95, p95 <= 48 AS passed, p95 < 48 AS passed_strict FROM {LAT}", "p95")
def _(t):
    from roadrisk.operators.gates import latency_gate
    return latency_gate(S.latency_summary(t.runtime, ["repeat"]), "compute_ms", 48.0)


@query("acceptance", f"""SELECT variant, trip_id, concat_ws(',', CASE WHEN NOT f1 >= 5e-1 THEN 'f1' END, CASE WHEN NOT composite >= 22 THEN 'composite' END, CASE WHEN NOT fp <= 250 THEN 'false_alarms' END) AS failures, f1 >= 5e-1 AND composite >= 22 AND fp <= 250 AS accepted FROM {SC}""")
def _(t):
    s = S.ttc_score(variant_predictions(t), ["variant", T])
    g = s.withColumns({"f1": F.col("f1") >= 0.5, "composite": F.col("composite") >= 22, "false_alarms": F.col("fp") <= 250})
    return C.acceptance(g, ["f1", "composite", "false_alarms"]).select("variant", T, "failures", "accepted")


@query("robustness_delta", f"""WITH s AS (SELECT variant, avg(f1) AS f1, avg(composite) AS composite, avg(recall) AS recall FROM {SC} GROUP BY variant)
SELECT_FINAL a.variant, a.f1 - b.f1 AS delta_f1, a.composite - b.composite AS delta_composite, a.recall - b.recall AS delta_recall FROM s a JOIN s b ON b.variant = 'classical' WHERE a.variant <> 'classical'""", "delta_f1 delta_composite delta_recall")
def _(t):
    from roadrisk.operators.gates import robustness_delta
    m = S.macro_summary(S.ttc_score(variant_predictions(t), ["variant", T]), ["variant"])
    return robustness_delta(m, "variant", "classical", ["f1", "composite", "recall"])


@query("select_benchmark", f"""WITH s AS (SELECT variant || '-' || "repeat" AS name, p95, f1, composite FROM (SELECT * FROM {LAT} WHERE "repeat" % 3 <> 1) l, (SELECT variant, avg(f1) AS f1, avg(composite) AS composite FROM {SC} GROUP BY variant) v)
SELECT_FINAL name, p95, f1, composite FROM s WHERE (p95 - (SELECT min(p95) FROM s)) / (SELECT min(p95) FROM s) < 5e-2 ORDER BY round(f1, 9) DESC, round(composite, 9) DESC, p95, name DESC LIMIT 1""", "p95 f1 composite")
def _(t):
    from roadrisk.operators.gates import select_benchmark
    lat = S.latency_summary(t.runtime, ["repeat"]).filter("stage = 'compute_ms'").select("repeat", "p95")
    m = S.macro_summary(S.ttc_score(variant_predictions(t), ["variant", T]), ["variant"]).select("variant", "f1", "composite")
    # seven repeats by three variants: both sides are summaries
    runs = m.join(lat, F.lit(True)).select(F.concat_ws("-", "variant", "repeat").alias("name"), "p95", "f1", "composite", (F.col("repeat") % 3 != 1).alias("eligible"))
    return select_benchmark(runs)
