"""Queries over box geometry and association."""
from pyspark.sql import functions as F

from roadrisk.constants import CURRENT_GUARD
from roadrisk.functions import geometry as G
from roadrisk.functions import ttc as X
from roadrisk.operators import association as A
from roadrisk.plans import boxsql as B
from roadrisk.plans import sqltext as Q
from roadrisk.plans.inputs import boxes, components, detections, evidence, truth, updates
from roadrisk.plans.registry import query

PAIRS = f"""(SELECT b.trip_id, b.frame_id, b.ordinal, c.x0 AS ax0, c.y0 AS ay0, c.x1 AS ax1, c.y1 AS ay1,
 b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1 FROM {Q.BOX} b JOIN {Q.COMPONENT} c ON c.trip_id = b.trip_id AND c.frame_id = b.frame_id)"""
PK = ["trip_id", "frame_id", "ordinal"]


def pairs(t):
    return boxes(t).select(*PK, F.col("box").alias("b")).join(
        components(t).withColumnRenamed("box", "a"), ["trip_id", "frame_id"])


def pair_query(name, sql, doubles, cols):
    @query(name, f"SELECT trip_id, frame_id, ordinal, {sql} FROM {PAIRS}", doubles)
    def _(t):
        return pairs(t).select(*PK, *cols())


pair_query("bbox_iou", f"{B.iou('a', 'b', 1)} AS iou_px, {B.iou('a', 'b')} AS iou, {B.iou('a', 'b', '1e-9')} AS iou_tiny",
           "iou_px iou iou_tiny",
           lambda: [G.bbox_iou("a", "b", 1.0).alias("iou_px"), G.bbox_iou("a", "b").alias("iou"),
                    G.bbox_iou("a", "b", 1e-9).alias("iou_tiny")])
pair_query("vertical_overlap", f"{B.vov('a', 'b')} AS overlap", "overlap",
           lambda: [G.vertical_overlap("a", "b").alias("overlap")])
pair_query("intersection_over_box", f"{B.iob('a', 'b')} AS share", "share",
           lambda: [G.intersection_over_box("a", "b").alias("share")])
pair_query("point_in_box", f"{B.contains('a', 'b')} AS contains, ax0 >= bx0 AND ax0 <= bx1 AND ay0 >= by0 AND ay0 <= by1 AS corner_inside", "",
           lambda: [G.contains_centre("a", "b").alias("contains"),
                    G.point_in_box(F.col("a.x0"), F.col("a.y0"), "b").alias("corner_inside")])
pair_query("centre_distance", f"{B.dist('a', 'b')} AS px, {B.ndist('a', 'b')} AS boxes", "px boxes",
           lambda: [G.centre_distance("a", "b").alias("px"), G.normalised_centre_distance("a", "b").alias("boxes")])


@query("expand_and_clip", """SELECT trip_id, frame_id, ordinal, greatest(0, x0 - (x1 - x0) * 5e-2) AS ex0, greatest(0, y0 - (y1 - y0) * 5e-2) AS ey0,
 least(640, x1 + (x1 - x0) * 5e-2) AS ex1, least(360, y1 + (y1 - y0) * 5e-2) AS ey1,
 CASE WHEN r - l >= 3 AND b - u >= 3 THEN l END AS cx0, CASE WHEN r - l >= 3 AND b - u >= 3 THEN u END AS cy0,
 CASE WHEN r - l >= 3 AND b - u >= 3 THEN r END AS cx1, CASE WHEN r - l >= 3 AND b - u >= 3 THEN b END AS cy1
FROM (SELECT *, least(greatest(ceil(x1), l + 1), 640) AS r, least(greatest(ceil(y1), u + 1), 360) AS b
 FROM (SELECT *, least(greatest(floor(x0), 0), 639) AS l, least(greatest(floor(y0), 0), 359) AS u FROM detections))""",
       "ex0 ey0 ex1 ey1 cx0 cy0 cx1 cy1")
def _(t):
    d = detections(t).select(*PK, G.expand_and_clip("box").alias("e"), G.clip_bbox("box").alias("c"))
    return d.select(*PK, *[F.col(f"{p}.{s}").alias(f"{p}{s}") for p in "ec" for s in ("x0", "y0", "x1", "y1")])


@query("bbox_from_norm", f"SELECT trip_id, frame_id, ordinal, x0, y0, x1, y1 FROM {Q.BOX}", "x0 y0 x1 y1")
def _(t):
    return boxes(t).select(*PK, "box.*")


CORRIDOR = """(bottom_y >= 36e-2 AND abs(center_x - 5e-1) <= ({top} + least(greatest((bottom_y - 36e-2) / 64e-2, 0e0), 1e0) * ({bottom} - {top})) / 2)"""


@query("corridor_member", f"SELECT trip_id, frame_id, ordinal, {CORRIDOR.format(top='1e-1', bottom='5e-1')} AS narrow, {CORRIDOR.format(top='16e-2', bottom='55e-2')} AS wide FROM candidates")
def _(t):
    return t.candidates.select(*PK, G.corridor_member("center_x", "bottom_y", F.lit(0.10), F.lit(0.50)).alias("narrow"),
                               G.corridor_member("center_x", "bottom_y", F.lit(0.16), F.lit(0.55)).alias("wide"))


@query("guard_predicate", f"""SELECT trip_id, frame_id, ordinal, {CORRIDOR.format(top='1e-1', bottom='5e-1')} AND bottom_y >= 5e-1 AND height >= 5e-2
 AND confidence >= 75e-2 AND closing_mps <= 20 AND depth_m <= 20 AND residual_m <= 8e-1 AND isfinite(candidate_ttc) AS accepted FROM candidates""")
def _(t):
    return t.candidates.select(*PK, G.guard_predicate(CURRENT_GUARD).alias("accepted"))


@query("disparity_to_depth", """SELECT frame_id, row_no, col_no, CASE WHEN d BETWEEN 15e-1 AND 80 THEN d END AS depth_m
FROM (SELECT *, CASE WHEN disparity > 5e-1 THEN 500 * 12e-2 / disparity END AS d FROM pixels)""", "depth_m")
def _(t):
    return t.pixels.select("frame_id", "row_no", "col_no", G.disparity_to_depth("disparity", 500.0, 0.12).alias("depth_m"))


GEO = f"""(SELECT b.*, f.speed_mps, f.lateral_accel, CASE WHEN speed_mps >= 1 THEN lateral_accel / speed_mps END AS yaw
 FROM {Q.BOX} b JOIN frames f ON f.trip_id = b.trip_id AND f.frame_id = b.frame_id)"""


def geo(t):
    f = t.frames.select("trip_id", "frame_id", "speed_mps", "lateral_accel")
    return boxes(t).join(f, ["trip_id", "frame_id"]).withColumn("yaw", G.yaw_rate("speed_mps", "lateral_accel"))


def geo_query(name, sql, doubles, cols):
    @query(name, f"SELECT trip_id, frame_id, ordinal, {sql} FROM {GEO}", doubles)
    def _(t):
        return geo(t).select(*PK, *cols())


def _planar():
    p = G.camera_to_planar("depth_m", G.centre("box")[0], 500.0, 320.0)
    return [p["forward"].alias("forward"), p["lateral"].alias("lateral")]


geo_query("camera_to_planar", "depth_m AS forward, ((x0 + x1) / 2 - 320) * depth_m / 500 AS \"lateral\"", "forward \"lateral\"", _planar)
geo_query("yaw_rate", "yaw", "yaw", lambda: ["yaw"])
geo_query("host_lateral", "CASE WHEN abs(yaw) >= 1e-4 THEN speed_mps / yaw * (1 - cos(yaw * 15e-1)) ELSE 0 END AS host", "host",
          lambda: [G.host_lateral("speed_mps", "yaw", F.lit(1.5)).alias("host")])


def _moved():
    m = G.compensate_ego_motion("depth_m", F.col("center_x") * 4 - 2, "speed_mps", "yaw", F.lit(0.1))
    return [m["forward"].alias("forward"), m["lateral"].alias("lateral")]


TURN = "(CASE WHEN abs(yaw) >= 1e-4 THEN yaw * 1e-1 ELSE 0 END)"
MOVED_X = "(depth_m - CASE WHEN abs(yaw) >= 1e-4 THEN speed_mps / yaw * sin(yaw * 1e-1) ELSE speed_mps * 1e-1 END)"
MOVED_Y = "(center_x * 4 - 2 - CASE WHEN abs(yaw) >= 1e-4 THEN speed_mps / yaw * (1 - cos(yaw * 1e-1)) ELSE 0 END)"
geo_query("compensate_ego_motion", f"cos({TURN}) * {MOVED_X} + sin({TURN}) * {MOVED_Y} AS forward, cos({TURN}) * {MOVED_Y} - sin({TURN}) * {MOVED_X} AS \"lateral\"",
          "forward \"lateral\"", _moved)
ERF = """(sign({x}) * (1 - ((((1061405429e-9 / (1 + 3275911e-7 * abs({x})) - 1453152027e-9) / (1 + 3275911e-7 * abs({x})) + 1421413741e-9)
 / (1 + 3275911e-7 * abs({x})) - 284496736e-9) / (1 + 3275911e-7 * abs({x})) + 254829592e-9) / (1 + 3275911e-7 * abs({x})) * exp(-{x} * {x})))"""
_up, _lo = ("(({s}175e-2 - (center_x * 4 - 2)) / (sqrt(greatest(residual_m, 1e-9)) * sqrt(2e0)))".format(s=s) for s in ("", "-"))
geo_query("corridor_occupancy", f"least(greatest(({ERF.format(x=_up)} - {ERF.format(x=_lo)}) / 2, 0), 1) AS occupancy", "occupancy",
          lambda: [G.corridor_occupancy(F.col("center_x") * 4 - 2, "residual_m").alias("occupancy")])
geo_query("path_offset", f"{B.offset('', 'depth_m')} AS path_offset_m", "path_offset_m",
          lambda: [G.path_offset("box", "depth_m", "speed_mps", "lateral_accel", 500.0, 320.0).alias("path_offset_m")])


def _cpa():
    r = G.cpa_path_risk("depth_m", F.col("center_x") * 4 - 2, -F.col("closing_mps"), (F.col("track_id") - 4) * 0.5)
    return [r["enters"].alias("enters"), r["time"].alias("time")]


geo_query("cpa_path_risk", """CASE WHEN -closing_mps < -3e-1 AND depth_m / closing_mps <= 2 THEN abs(center_x * 4 - 2 + (track_id - 4) * 5e-1 * (depth_m / closing_mps)) <= 175e-2
 ELSE false END AS enters, CASE WHEN -closing_mps < -3e-1 THEN depth_m / closing_mps END AS "time\"""", '"time"', _cpa)
geo_query("cues_agree", """CASE WHEN isfinite(candidate_ttc) AND speed_mps > 0 THEN
 greatest(candidate_ttc, depth_m / speed_mps) / greatest(1e-1, least(candidate_ttc, depth_m / speed_mps)) <= 2 ELSE false END AS agree""", "",
          lambda: [G.cues_agree("candidate_ttc", F.when(F.col("speed_mps") > 0, F.col("depth_m") / F.col("speed_mps")).otherwise(F.lit(float("inf")))).alias("agree")])
geo_query("box_depth_sigmas", """CASE WHEN depth_m < 20 THEN 2e0 ELSE 4e0 END AS forward, CASE WHEN depth_m < 10 THEN 5e-1 WHEN depth_m < 20 THEN 1 ELSE 2 END AS \"lateral\"""",
          "forward \"lateral\"", lambda: [G.box_depth_sigmas("depth_m")["forward"].alias("forward"), G.box_depth_sigmas("depth_m")["lateral"].alias("lateral")])
geo_query("ego_cap", "least(20, greatest(3, speed_mps + 3)) AS cap", "cap", lambda: [X.ego_cap("speed_mps").alias("cap")])
geo_query("scenario", "CASE WHEN abs(lateral_accel) >= 3e-1 THEN 'turn' ELSE 'straight' END AS scenario, round(speed_mps, 3) AS speed", "speed",
          lambda: [X.scenario("lateral_accel").alias("scenario"), F.round("speed_mps", 3).alias("speed")])


@query("retained_class", """SELECT trip_id, frame_id, ordinal, class_id IN (0, 1, 2, 3, 5, 7) AS retained,
 CASE class_id WHEN 0 THEN 'person' WHEN 1 THEN 'bicycle' WHEN 2 THEN 'car' WHEN 3 THEN 'motorcycle' WHEN 5 THEN 'bus' WHEN 7 THEN 'truck' END AS class_name FROM detections""")
def _(t):
    return detections(t).select(*PK, A.retained().alias("retained"), A.class_name().alias("class_name"))


ASSOC = f"""(SELECT c.trip_id, c.frame_id, c.ordinal, c.track_id, d.class_id AS det_class, d.confidence AS det_confidence, d.iou AS det_iou, d.trip_id IS NOT NULL AS matched
FROM {Q.BOX} c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY trip_id, frame_id, ordinal ORDER BY 6e-1 * confidence + 4e-1 * iou DESC, d_ordinal) AS rn
 FROM (SELECT *, {B.iou('c', 'd')} AS iou FROM (SELECT b.trip_id, b.frame_id, b.ordinal, e.ordinal AS d_ordinal, e.class_id, e.confidence, b.x0 AS cx0, b.y0 AS cy0, b.x1 AS cx1, b.y1 AS cy1,
   greatest(0, e.x0 - (e.x1 - e.x0) * 5e-2) AS dx0, greatest(0, e.y0 - (e.y1 - e.y0) * 5e-2) AS dy0, least(640, e.x1 + (e.x1 - e.x0) * 5e-2) AS dx1, least(360, e.y1 + (e.y1 - e.y0) * 5e-2) AS dy1
   FROM {Q.BOX} b JOIN detections e ON e.trip_id = b.trip_id AND e.frame_id = b.frame_id WHERE e.class_id IN (0, 1, 2, 3, 5, 7)) q)
 WHERE iou >= 15e-2 OR ({B.contains('d', 'c')} AND {B.vov('c', 'd')} >= 5e-1) OR ({B.contains('c', 'd')} AND {B.iob('c', 'd')} >= 5e-1 AND {B.vov('c', 'd')} >= 5e-1)) d
 ON d.trip_id = c.trip_id AND d.frame_id = c.frame_id AND d.ordinal = c.ordinal AND d.rn = 1)"""


@query("associate_detections", f"SELECT trip_id, frame_id, ordinal, matched, det_class, coalesce(det_confidence, 0) AS det_confidence, coalesce(det_iou, 0) AS det_iou FROM {ASSOC}", "det_confidence det_iou")
def _(t):
    return A.associate_detections(boxes(t), detections(t)).select(*PK, "matched", "det_class", "det_confidence", "det_iou")


# component of the frame against every track measurement of the frame
EU = f"""(SELECT e.*, u.ordinal, u.track_id, u.depth_m, u.x0 AS ux0, u.y0 AS uy0, u.x1 AS ux1, u.y1 AS uy1 FROM {Q.EVIDENCE} e
 JOIN {Q.BOX} u ON u.trip_id = e.trip_id AND u.frame_id = e.frame_id WHERE ex0 IS NOT NULL)"""
BEST = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trip_id, frame_id ORDER BY iou DESC, ordinal) AS rn
 FROM (SELECT *, {B.iou('e', 'u', '1e-9')} AS iou FROM {EU})) WHERE rn = 1 AND iou > 0)"""


@query("best_iou_match", f"""SELECT e.trip_id, e.frame_id, coalesce(iou, 0) AS matched_iou, CASE WHEN iou >= 3e-1 THEN track_id END AS track_id
FROM {Q.EVIDENCE} e LEFT JOIN {BEST} b ON b.trip_id = e.trip_id AND b.frame_id = e.frame_id""", "matched_iou")
def _(t):
    m = A.best_iou_match(evidence(t), updates(t), 0.30)
    return m.select("trip_id", "frame_id", "matched_iou", "match.track_id")


CONT = f"""(SELECT trip_id, frame_id, count(*) AS n, min(track_id) AS track_id, min(depth_m) AS depth_m, min(ux0) AS ux0, min(ux1) AS ux1
 FROM {EU} WHERE {B.contains('e', 'u')} GROUP BY trip_id, frame_id)"""


@query("containment_match", f"""SELECT e.trip_id, e.frame_id, coalesce(n, 0) AS contained,
 CASE WHEN n = 1 THEN 'unique' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS containment, CASE WHEN n = 1 THEN track_id END AS track_id
FROM {Q.EVIDENCE} e LEFT JOIN {CONT} c ON c.trip_id = e.trip_id AND c.frame_id = e.frame_id""")
def _(t):
    return A.containment_match(evidence(t), updates(t)).select(
        "trip_id", "frame_id", "contained", "containment", "match.track_id")


GATE = f"""(SELECT e.trip_id, e.frame_id, e.predicted_ttc, e.truth_ttc, {Q.DANGER.replace('union_source', 'e.union_source').replace('predicted_ttc', 'e.predicted_ttc')} AS danger,
 CASE WHEN {Q.DANGER.replace('union_source', 'e.union_source').replace('predicted_ttc', 'e.predicted_ttc')} THEN coalesce(iou, 0) ELSE 0 END AS matched_iou, b.track_id,
 CASE WHEN {Q.DANGER.replace('union_source', 'e.union_source').replace('predicted_ttc', 'e.predicted_ttc')} AND iou >= 3e-1 THEN
  {B.offset('u', 'depth_m', 'b.speed_mps', 'b.lateral_accel')} END AS path_offset_m
 FROM {Q.EVIDENCE} e LEFT JOIN {BEST} b ON b.trip_id = e.trip_id AND b.frame_id = e.frame_id)"""


@query("path_gate", f"""SELECT trip_id, frame_id, matched_iou, path_offset_m, path_offset_m IS NOT NULL AS eligible, coalesce(abs(path_offset_m) > 175e-2, false) AS suppressed,
 CASE WHEN abs(path_offset_m) > 175e-2 THEN 2 ELSE predicted_ttc END AS gated_ttc FROM {GATE}""", "matched_iou path_offset_m gated_ttc")
def _(t):
    return A.path_gate(evidence(t), updates(t)).select(
        "trip_id", "frame_id", "matched_iou", "path_offset_m", "eligible", "suppressed", "gated_ttc")


@query("contained_path_gate", f"""WITH e AS (SELECT v.*, {Q.DANGER} AS danger, CASE WHEN {Q.DANGER} AND n = 1 THEN c.track_id END AS tid, c.depth_m, c.ux0, c.ux1
  FROM {Q.EVIDENCE} v LEFT JOIN {CONT} c ON c.trip_id = v.trip_id AND c.frame_id = v.frame_id),
 h AS (SELECT *, coalesce(lag(frame_id) OVER w = frame_id - 1 AND lag(tid) OVER w = tid, false) AS held FROM e WINDOW w AS (PARTITION BY trip_id ORDER BY frame_id)),
 o AS (SELECT *, CASE WHEN held THEN {B.offset('u', 'depth_m')} END AS off FROM h)
SELECT_FINAL trip_id, frame_id, CASE WHEN NOT danger THEN 'not_classical_danger' WHEN tid IS NULL THEN 'ambiguous_or_missing_containment'
  WHEN NOT held THEN 'episode_start_or_no_continuity' WHEN off IS NULL THEN 'continuous_geometry_unavailable'
  WHEN abs(off) > 175e-2 THEN 'continuous_off_path' ELSE 'continuous_on_path' END AS association_status,
 off AS path_offset_m, coalesce(abs(off) > 175e-2, false) AS suppressed, CASE WHEN abs(off) > 175e-2 THEN 2 ELSE predicted_ttc END AS gated_ttc FROM o""", "path_offset_m gated_ttc")
def _(t):
    return A.contained_path_gate(evidence(t), updates(t)).select(
        "trip_id", "frame_id", "association_status", "path_offset_m", "suppressed", "gated_ttc")


RANKED = f"""(SELECT *, row_number() OVER (PARTITION BY trip_id, frame_id ORDER BY iou DESC, px, dd, ordinal) AS "rank"
 FROM (SELECT *, {B.iou('e', 'u')} AS iou, {B.dist('e', 'u')} AS px, abs(10 - depth_m) AS dd FROM {EU}))"""


def ranked(t):
    return A.rank_candidates(evidence(t).withColumn("item_depth_m", F.lit(10.0)), updates(t))


@query("rank_candidates", f'SELECT trip_id, frame_id, ordinal, track_id, iou AS bbox_iou, px AS centre_distance_px, dd AS depth_delta_m, "rank" FROM {RANKED}',
       "bbox_iou centre_distance_px depth_delta_m")
def _(t):
    return ranked(t).select(*PK, "track_id", "bbox_iou", "centre_distance_px", "depth_delta_m", "rank")


@query("detection_parity", f"""SELECT trip_id, count(*) AS reference_boxes, count(*) FILTER (WHERE iou >= 5e-1) AS matched,
 count(*) FILTER (WHERE iou >= 5e-1 AND class_id = ucls) AS class_agreed, count(*) FILTER (WHERE iou >= 5e-1 AND class_id <> ucls) AS class_swaps,
 count(*) FILTER (WHERE iou >= 95e-2 AND class_id <> ucls) AS same_box_swaps,
 avg(CASE WHEN iou >= 5e-1 THEN abs(confidence - uconf) END) AS mean_confidence_gap, max(CASE WHEN iou >= 5e-1 THEN abs(confidence - uconf) END) AS max_confidence_gap,
 quantile_cont(CASE WHEN iou >= 5e-1 THEN iou END, 5e-1) AS median_iou
FROM (SELECT *, row_number() OVER (PARTITION BY trip_id, frame_id, ordinal ORDER BY iou DESC, u_ord) AS rn FROM (SELECT *, {B.iou('e', 'u')} AS iou FROM (
  SELECT d.trip_id, d.frame_id, d.ordinal, d.class_id, d.confidence, d.x0 AS ex0, d.y0 AS ey0, d.x1 AS ex1, d.y1 AS ey1,
   b.ordinal AS u_ord, b.confidence AS uconf, b.track_id AS ucls, b.x0 AS ux0, b.y0 AS uy0, b.x1 AS ux1, b.y1 AS uy1
  FROM detections d LEFT JOIN {Q.BOX} b ON b.trip_id = d.trip_id AND b.frame_id = d.frame_id)))
WHERE rn = 1 GROUP BY trip_id""", "mean_confidence_gap max_confidence_gap median_iou")
def _(t):
    b = boxes(t).select(*PK, F.col("track_id").cast("int").alias("class_id"), "confidence", "box")
    return A.detection_parity(detections(t), b)


@query("label_evidence", f"""SELECT l.trip_id, l.frame_id, l.track_id, l.path_relation, u.depth_m,
 CASE WHEN f.trip_id IS NOT NULL AND u.trip_id IS NOT NULL THEN {B.offset('u.', 'u.depth_m')} END AS path_offset_m,
 CASE WHEN f.trip_id IS NULL THEN 'missing_evidence' WHEN u.trip_id IS NULL THEN 'no_update' WHEN {B.offset('u.', 'u.depth_m')} IS NULL THEN 'no_geometry' ELSE 'available' END AS status
FROM track_labels l LEFT JOIN frames f ON f.trip_id = l.trip_id AND f.frame_id = l.frame_id
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trip_id, frame_id, track_id ORDER BY ordinal) AS rn FROM {Q.BOX}) WHERE rn = 1) u
 ON u.trip_id = l.trip_id AND u.frame_id = l.frame_id AND u.track_id = l.track_id""", "depth_m path_offset_m")
def _(t):
    labels = t.track_labels.select("trip_id", "frame_id", "track_id", "path_relation")
    return A.label_evidence(labels, evidence(t), updates(t)).select(
        "trip_id", "frame_id", "track_id", "path_relation", "depth_m", "path_offset_m", "status")


@query("track_window_coverage", """SELECT trip_id, frame_id, track_id, count(hit) AS visible_frames, count(*) AS window_frames, count(hit) / count(*) AS visible_fraction
FROM (SELECT l.trip_id, l.frame_id, l.track_id, u.track_id AS hit FROM (SELECT trip_id, frame_id, track_id, unnest(generate_series(greatest(0, frame_id - 5), frame_id + 5)) AS f FROM track_labels) l
 LEFT JOIN (SELECT DISTINCT trip_id, frame_id, track_id FROM candidates) u ON u.trip_id = l.trip_id AND u.frame_id = l.f AND u.track_id = l.track_id)
GROUP BY trip_id, frame_id, track_id""", "visible_fraction")
def _(t):
    return A.track_window_coverage(t.track_labels.select("trip_id", "frame_id", "track_id"), updates(t))


@query("danger_suppressed_frames", """SELECT trip_id, frame_id FROM frames WHERE min_ttc < 2 INTERSECT SELECT trip_id, frame_id FROM candidates WHERE residual_m > 11e-1""")
def _(t):
    danger = truth(t).filter(X.is_danger("truth_ttc")).select("trip_id", "frame_id")
    return danger.intersect(t.candidates.filter("residual_m > 1.1").select("trip_id", "frame_id"))


@query("candidate_geometry", """SELECT s.trip_id, s.frame_id, s.track_id, s.label, c.depth_m, c.candidate_ttc, c.center_x FROM track_labels s
JOIN (SELECT *, row_number() OVER (PARTITION BY trip_id, frame_id, track_id ORDER BY ordinal DESC) AS rn FROM candidates) c
 ON c.trip_id = s.trip_id AND c.frame_id = s.frame_id AND c.track_id = s.track_id AND c.rn = 1""", "depth_m candidate_ttc center_x")
def _(t):
    s = t.track_labels.select("trip_id", "frame_id", "track_id", "label")
    return A.candidate_geometry(s, t.candidates).select(
        "trip_id", "frame_id", "track_id", "label", "depth_m", "candidate_ttc", "center_x")


@query("provisional_labels", f"""SELECT l.trip_id, l.frame_id, l.track_id, CASE WHEN coalesce((c.x0 + c.x1) / 2, 0) BETWEEN 256 AND 384 THEN 'on_path' ELSE 'adjacent' END AS path_relation,
 CASE WHEN coalesce((c.x0 + c.x1) / 2, 0) BETWEEN 256 AND 384 THEN 'yes' ELSE 'no' END AS event_owner, 'closing' AS relative_motion, 'low' AS review_confidence,
 'ai-' || l.trip_id || '-' || CAST(coalesce(l.track_id, l.frame_id) AS VARCHAR) AS object_id_window, 'unknown' AS cpa_distance_m, 'unknown' AS occluded, 'unknown' AS candidate_type, '{A.PROVISIONAL_MARK}' AS notes FROM track_labels l LEFT JOIN {Q.COMPONENT} c ON c.trip_id = l.trip_id AND c.frame_id = l.frame_id""")
def _(t):
    labels = t.track_labels.select("trip_id", "frame_id", "track_id")
    return A.provisional_labels(labels, evidence(t))


@query("association_cost", f"""SELECT trip_id, frame_id, ordinal, CASE WHEN (iou >= 2e-2 OR shift <= 12e-2) AND stretch <= 65e-2 THEN
 45e-2 * (1 - iou) + 35e-2 * least(1, shift / 12e-2) + 2e-1 * least(1, stretch / 65e-2) END AS cost
FROM (SELECT trip_id, frame_id, ordinal, {B.iou('e', 'u', 1)} AS iou, {B.dist('e', 'u')} / sqrt(640 * 640 + 360 * 360) AS shift, abs(10 - depth_m) / greatest(1, 10, depth_m) AS stretch FROM {EU})""", "cost")
def _(t):
    p = pairs(t).join(t.candidates.select(*PK, "depth_m"), PK)
    (ax, ay), (bx, by) = G.centre("a"), G.centre("b")
    return p.select(*PK, G.association_cost("a", ax, ay, F.lit(10.0), "b", bx, by, "depth_m").alias("cost"))


@query("ttc_floor", f"""SELECT trip_id, frame_id, CASE WHEN predicted_ttc < 2 AND NOT detector_ttc < 2 THEN 21e-1 ELSE detector_ttc END AS floored,
 predicted_ttc < 2 AND NOT detector_ttc < 2 AS applied FROM {Q.UNION}""", "floored")
def _(t):
    r = X.apply_ttc_floor("predicted_ttc", "detector_ttc", F.lit(2.1))
    return evidence(t).select("trip_id", "frame_id", r["ttc"].alias("floored"), r["applied"].alias("applied"))


@query("occupancy_suppress", f"""SELECT e.trip_id, e.frame_id, CASE WHEN hit THEN 2 ELSE e.predicted_ttc END AS ttc, hit AS suppressed
FROM (SELECT v.*, coalesce({Q.DANGER} AND iou >= 3e-1 AND b.depth_m < 30 AND (((b.ux0 + b.ux1) / 2 - 320) / 200) ** 2 > 5e-1, false) AS hit
 FROM {Q.EVIDENCE} v LEFT JOIN (SELECT trip_id, frame_id, iou, depth_m, ux0, ux1 FROM {BEST}) b ON b.trip_id = v.trip_id AND b.frame_id = v.frame_id) e""", "ttc")
def _(t):
    m = A.best_iou_match(evidence(t), updates(t), 0.30)
    x = (G.centre("match.box")[0] - 320.0) / 200.0
    r = X.occupancy_suppress("predicted_ttc", "union_source", "matched_iou", F.col("match.depth_m") < 30.0, 1.0 - x * x)
    return m.select("trip_id", "frame_id", r["ttc"].alias("ttc"), r["suppressed"].alias("suppressed"))
