"""Queries over audits, labels and samples."""
from pyspark.sql import functions as F

from roadrisk.functions import ttc as X
from roadrisk.operators import association as A
from roadrisk.operators import audits as D
from roadrisk.operators import memory as K
from roadrisk.operators import sampling as P
from roadrisk.plans import boxsql as B
from roadrisk.plans import sqltext as Q
from roadrisk.plans.geometry_queries import BEST, GATE, RANKED, ranked
from roadrisk.plans.inputs import detections, evidence, featured, truth, union_predictions, updates
from roadrisk.plans.registry import query

# the match of a frame; its occupancy stands in as 1 - (lateral offset / 4 m)^2, NULL without geometry
MATCH = f"""(SELECT e.*, coalesce(b.iou, 0) AS matched_iou, CASE WHEN b.iou >= 3e-1 THEN 1 - pow({B.offset('b.u', 'b.depth_m', 'e.speed_mps', 'e.lateral_accel')} / 4, 2) END AS occupancy
 FROM {Q.EVIDENCE} e LEFT JOIN {BEST} b ON b.trip_id = e.trip_id AND b.frame_id = e.frame_id)"""


def matched(t):
    m = A.best_iou_match(evidence(t), updates(t), 0.30)
    off = A._offset(F.col("match")) / 4.0
    return m.withColumn("occupancy", 1.0 - off * off)


@query("danger_coverage", f"""SELECT coalesce(trip_id, 'ALL') AS trip_id, count(*) FILTER (WHERE d) AS danger, count(*) FILTER (WHERE d AND tp) AS danger_tp, count(*) FILTER (WHERE d AND NOT tp) AS danger_fp,
 count(*) FILTER (WHERE e) AS eligible, count(*) FILTER (WHERE e AND tp) AS eligible_tp, count(*) FILTER (WHERE e AND NOT tp) AS eligible_fp
FROM (SELECT trip_id, predicted_ttc < 2 AS d, truth_ttc < 2 AS tp, predicted_ttc < 2 AND matched_iou >= 3e-1 AND occupancy IS NOT NULL AS e FROM {MATCH}) GROUP BY GROUPING SETS ((trip_id), ())""")
def _(t):
    return D.danger_coverage(matched(t))


@query("veto_coverage", f"""SELECT trip_id, count(*) FILTER (WHERE detector_ttc < 2 AND truth_ttc < 2) AS supports_tp, count(*) FILTER (WHERE detector_ttc < 2 AND NOT truth_ttc < 2) AS supports_fp,
 count(*) FILTER (WHERE NOT detector_ttc < 2 AND truth_ttc < 2) AS vetoes_tp, count(*) FILTER (WHERE NOT detector_ttc < 2 AND NOT truth_ttc < 2) AS vetoes_fp FROM {Q.UNION} WHERE classical_ttc < 2 GROUP BY trip_id""")
def _(t):
    return D.veto_coverage(union_predictions(t))


@query("fp_taxonomy", f"""SELECT m.trip_id, CASE WHEN union_source NOT LIKE 'classical%' THEN 'not_classical_candidate' WHEN coalesce(r.n, 0) = 0 THEN 'no_yolo_road_user' WHEN matched_iou < 3e-1 THEN 'no_classical_yolo_iou_match'
  WHEN occupancy IS NULL THEN 'matched_occupancy_unavailable' WHEN occupancy < 5e-1 THEN 'eligible_low_occupancy' ELSE 'eligible_not_low_occupancy' END AS reason, count(*) AS frames
FROM {MATCH} m LEFT JOIN (SELECT trip_id, frame_id, count(*) AS n FROM detections WHERE class_id IN (0, 1, 2, 3, 5, 7) GROUP BY trip_id, frame_id) r ON r.trip_id = m.trip_id AND r.frame_id = m.frame_id
WHERE predicted_ttc < 2 AND NOT truth_ttc < 2 GROUP BY 1, 2""")
def _(t):
    users = detections(t).filter(A.retained()).groupBy("trip_id", "frame_id").agg(F.count(F.lit(1)).alias("road_users"))
    return D.fp_taxonomy(matched(t).join(users, ["trip_id", "frame_id"], "left").na.fill(0, ["road_users"]))


@query("path_taxonomy", f"""SELECT trip_id, CASE WHEN matched_iou < 3e-1 THEN 'unassociated' WHEN path_offset_m IS NULL THEN 'geometry_unavailable' WHEN abs(path_offset_m) > 175e-2 THEN 'off_path' ELSE 'on_path_nonclosing' END AS category, count(*) AS frames
FROM {GATE} WHERE danger AND NOT truth_ttc < 2 GROUP BY 1, 2""")
def _(t):
    return D.path_taxonomy(evidence(t), updates(t))


@query("label_winner", """WITH l AS (SELECT label, f.min_ttc < 2 AS is_danger, l.frame_id * 10 + CAST(right(l.trip_id, 1) AS BIGINT) AS o FROM track_labels l JOIN frames f ON f.trip_id = l.trip_id AND f.frame_id = l.frame_id),
 c AS (SELECT label, count(*) AS n, count(*) FILTER (WHERE is_danger) AS n1, min(o) AS f, min(CASE WHEN is_danger THEN o END) AS f1 FROM l GROUP BY label),
 w AS (SELECT arg_min(label, (-n, f)) AS winner_all, max(n) / sum(n) AS share_all, arg_min(label, (-n1, f1)) FILTER (WHERE n1 > 0) AS winner_s1, max(n1) / nullif(sum(n1), 0) AS share_s1, CAST(sum(n) AS BIGINT) AS rows_labelled FROM c)
SELECT_FINAL (SELECT count(*) FROM l) AS rows_total, rows_labelled, rows_labelled / (SELECT count(*) FROM l) AS coverage, winner_all, share_all, winner_s1, share_s1,
 CASE WHEN share_all >= 4e-1 AND share_s1 >= 4e-1 AND winner_all = winner_s1 THEN 'DECISIVE' ELSE 'MIXED' END AS decision FROM w""", "coverage share_all share_s1")
def _(t):
    j = t.track_labels.join(truth(t), ["trip_id", "frame_id"]).select(
        "label", X.is_danger("truth_ttc").alias("is_danger"),
        (F.col("frame_id") * 10 + F.substring("trip_id", 2, 1).cast("bigint")).alias("order"))
    return D.label_winner(j, ["genuine_miss", "stereo_noise", "association_failure", "unsure"])


@query("relation_means", """SELECT *, coalesce(mean_on_path < mean_off_path, false) AS direction_consistent, complete >= 24 AND invalid = 0 AND coalesce(mean_on_path < mean_off_path, false) AS ready FROM (
 SELECT count(*) AS rows_total, count(*) AS complete, CAST(0 AS BIGINT) AS invalid, avg(CASE WHEN path_relation = 'on_path' THEN cpa_distance_m END) AS mean_on_path, avg(CASE WHEN path_relation = 'adjacent' THEN cpa_distance_m END) AS mean_adjacent,
  avg(CASE WHEN path_relation = 'diverging' THEN cpa_distance_m END) AS mean_diverging, avg(CASE WHEN path_relation <> 'on_path' THEN cpa_distance_m END) AS mean_off_path FROM track_labels)""", "mean_on_path mean_adjacent mean_diverging mean_off_path")
def _(t):
    return D.relation_means(t.track_labels, "cpa_distance_m")


@query("top_one_precision", f"""SELECT trip_id, count(*) AS pairs, count(*) AS complete, count(*) FILTER (WHERE "rank" = 1 AND s = 'yes') AS top_yes, count(*) FILTER (WHERE "rank" = 1 AND s = 'no') AS top_no,
 count(*) FILTER (WHERE "rank" = 1 AND s = 'yes') / nullif(count(*) FILTER (WHERE "rank" = 1 AND s <> 'uncertain'), 0) AS top_one_precision
FROM (SELECT *, CASE WHEN iou >= 4e-1 THEN 'yes' WHEN iou > 0 THEN 'uncertain' ELSE 'no' END AS s FROM {RANKED}) GROUP BY trip_id""", "top_one_precision")
def _(t):
    s = F.when(F.col("bbox_iou") >= 0.4, "yes").when(F.col("bbox_iou") > 0, "uncertain").otherwise("no")
    return D.top_one_precision(ranked(t).withColumn("same_object", s), ["trip_id"])


@query("stratum_medians", """SELECT stratum, metric, median(value) AS median, count(value) AS samples FROM (
 SELECT CASE WHEN f.min_ttc < 2 THEN 'danger' ELSE 'other' END AS stratum, m.metric, CASE m.metric WHEN 'depth_m' THEN depth_m WHEN 'residual_m' THEN residual_m ELSE confidence END AS value
 FROM candidates c JOIN frames f ON f.trip_id = c.trip_id AND f.frame_id = c.frame_id JOIN (VALUES ('depth_m'), ('residual_m'), ('confidence')) m(metric) ON true) GROUP BY stratum, metric""", "median")
def _(t):
    j = t.candidates.join(truth(t), ["trip_id", "frame_id"])
    j = j.withColumn("stratum", F.when(X.is_danger("truth_ttc"), "danger").otherwise("other"))
    cols = ["depth_m", "residual_m", "confidence"]
    return D.stratum_medians(j.select("stratum", *[F.col(c).cast("double").alias(c) for c in cols]), "stratum", cols)


@query("class_counts", "SELECT class_id, count(*) AS detections, count(DISTINCT (trip_id, frame_id)) AS frames FROM detections GROUP BY class_id")
def _(t):
    return D.class_counts(t.detections)


@query("frame_features", f"SELECT * EXCLUDE (truth_ttc) FROM {Q.FEATURES}", " ".join(Q.FEATURE_NAMES[2:]))
def _(t):
    return D.frame_features(featured(t), t.frames.select("trip_id", "frame_id"))


@query("pick_cases", f"""SELECT trip_id, outcome, frame_id, predicted_ttc, truth_ttc FROM (SELECT *, row_number() OVER (PARTITION BY trip_id, outcome ORDER BY lead, k, frame_id) AS rn FROM (
 SELECT *, CASE outcome WHEN 'FN' THEN isfinite(predicted_ttc) WHEN 'FP' THEN isfinite(truth_ttc) ELSE false END AS lead, CASE outcome WHEN 'FN' THEN truth_ttc WHEN 'FP' THEN predicted_ttc ELSE abs(predicted_ttc - truth_ttc) END AS k
 FROM (SELECT *, CASE WHEN predicted_ttc < 2 AND truth_ttc < 2 THEN 'TP' WHEN predicted_ttc < 2 THEN 'FP' WHEN truth_ttc < 2 THEN 'FN' END AS outcome FROM {Q.UNION}) WHERE outcome IS NOT NULL)) WHERE rn = 1""", "predicted_ttc truth_ttc")
def _(t):
    return P.pick_cases(union_predictions(t))


@query("top_k", f"SELECT trip_id, frame_id, abs(predicted_ttc - truth_ttc) AS gap FROM {Q.UNION} WHERE isfinite(predicted_ttc) AND isfinite(truth_ttc) ORDER BY gap DESC, trip_id, frame_id LIMIT 12", "gap")
def _(t):
    u = union_predictions(t).filter(X.is_finite("predicted_ttc") & X.is_finite("truth_ttc"))
    u = u.select("trip_id", "frame_id", F.abs(F.col("predicted_ttc") - F.col("truth_ttc")).alias("gap"))
    return P.top_k(u, 12, F.desc("gap"), F.col("trip_id"), F.col("frame_id"))


NUM = "(SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY frame_id) - 1 AS i, count(*) OVER (PARTITION BY {k}) AS n FROM {s})"
DANGERS = "(SELECT trip_id, frame_id, min_ttc FROM frames WHERE min_ttc < 2)"


def spaced_sql(src, keys, k):
    num = NUM.format(k=keys, s=src)
    return f"""SELECT * EXCLUDE (i, n) FROM {num} q WHERE n <= {k} OR EXISTS (SELECT 1 FROM (SELECT unnest(generate_series(0, {k - 1})) AS j) WHERE round_even(j * (q.n - 1) / {max(k - 1, 1)}, 0) = q.i)"""


def dangers(t):
    return t.frames.filter(X.is_danger("min_ttc")).select("trip_id", "frame_id", "min_ttc")


@query("evenly_spaced", spaced_sql(DANGERS, "trip_id", 24), "min_ttc")
def _(t):
    return P.evenly_spaced(dangers(t), 24)


MID = f"""SELECT q.trip_id, q.frame_id, j AS sample_no FROM (SELECT unnest(generate_series(0, 49)) AS j) s JOIN {NUM.format(k='trip_id', s=DANGERS)} q ON q.i = (2 * j + 1) * q.n // 100"""


@query("bin_midpoints", MID)
def _(t):
    return P.bin_midpoints(dangers(t), 50).select("trip_id", "frame_id", "sample_no")


@query("interleave", MID)
def _(t):
    return P.interleave(P.bin_midpoints(dangers(t), 50)).select("trip_id", "frame_id", "sample_no")


@query("stride_sample", f"SELECT trip_id, frame_id FROM {NUM.format(k='trip_id', s=DANGERS)} WHERE i % 7 = 0")
def _(t):
    return P.stride_sample(dangers(t), 7).select("trip_id", "frame_id")


@query("exclude", f"SELECT trip_id, frame_id FROM {NUM.format(k='trip_id', s=DANGERS)} WHERE i % 7 <> 0")
def _(t):
    d = dangers(t)
    return P.exclude(d, P.stride_sample(d, 7)).select("trip_id", "frame_id")


OTHERS = "(SELECT trip_id, frame_id, min_ttc FROM frames WHERE NOT min_ttc < 2)"


@query("budget_sample", f"""SELECT trip_id, frame_id, 'S1' AS stratum FROM {DANGERS}
UNION ALL SELECT q.trip_id, q.frame_id, 'S2' FROM {NUM.format(k='trip_id', s=OTHERS)} q LEFT JOIN (SELECT trip_id, count(*) AS n1 FROM {DANGERS} GROUP BY trip_id) d ON d.trip_id = q.trip_id
 WHERE i % greatest(1, CAST(floor(n / greatest(600 - coalesce(n1, 0), 1)) AS BIGINT)) = 0
  AND i // greatest(1, CAST(floor(n / greatest(600 - coalesce(n1, 0), 1)) AS BIGINT)) < greatest(600 - coalesce(n1, 0), 0)""")
def _(t):
    f = t.frames.select("trip_id", "frame_id", "min_ttc")
    danger = X.is_danger("min_ttc")
    return P.budget_sample(f.filter(danger), f.filter(~danger), 600).select("trip_id", "frame_id", "stratum")


@query("review_sample", spaced_sql(f"(SELECT trip_id, frame_id, CASE WHEN truth_ttc < 2 THEN 'danger' ELSE 'non_danger' END AS stratum FROM {Q.UNION} WHERE predicted_ttc < 2)", "trip_id, stratum", 12))
def _(t):
    u = union_predictions(t).select("trip_id", "frame_id", "predicted_ttc", "truth_ttc")
    return P.review_sample(u, 12, D.review_outcome()).select("trip_id", "frame_id", "stratum")


ANCHORS = spaced_sql("(SELECT trip_id, frame_id FROM frames WHERE min_ttc < 2e-1)", "trip_id", 40)


@query("anchored_sample", f"""WITH a AS ({ANCHORS}), rest AS (SELECT f.trip_id, f.frame_id FROM frames f ANTI JOIN a ON a.trip_id = f.trip_id AND a.frame_id = f.frame_id),
 q AS (SELECT r.*, greatest(40 - coalesce(h, 0), 0) AS m FROM {NUM.format(k='trip_id', s='rest')} r LEFT JOIN (SELECT trip_id, count(*) AS h FROM a GROUP BY trip_id) c ON c.trip_id = r.trip_id)
SELECT_FINAL trip_id, frame_id, 'anchor' AS stratum FROM a UNION ALL SELECT trip_id, frame_id, 'fill' FROM q WHERE m > 0 AND (n <= m OR EXISTS (SELECT 1 FROM (SELECT unnest(generate_series(0, 39)) AS j) WHERE j < q.m AND round_even(j * (q.n - 1) / greatest(q.m - 1, 1), 0) = q.i))""")
def _(t):
    f = t.frames.select("trip_id", "frame_id", "min_ttc")
    return P.anchored_sample(f, 40, F.col("min_ttc") < 0.2).select("trip_id", "frame_id", "stratum")


@query("leakage_sample", f"SELECT trip_id, frame_id, CASE WHEN truth_ttc < 2 THEN 'true_danger_anchor' ELSE 'false_alert' END AS stratum FROM {Q.UNION} WHERE predicted_ttc < 2")
def _(t):
    return P.leakage_sample(union_predictions(t)).select("trip_id", "frame_id", "stratum")


# danger frames without an IoU match: their ranked candidates, or one row when there are none
@query("association_audit_sample", f"""WITH g AS (SELECT trip_id, frame_id FROM {GATE} WHERE danger AND matched_iou < 3e-1)
SELECT_FINAL g.trip_id, g.frame_id, r.track_id, r."rank", r.iou AS bbox_iou, r.trip_id IS NULL AS no_candidate FROM g LEFT JOIN {RANKED} r ON r.trip_id = g.trip_id AND r.frame_id = g.frame_id""", "bbox_iou")
def _(t):
    g = A.path_gate(evidence(t), updates(t)).filter(A.classical_danger() & F.col("match").isNull()).select("trip_id", "frame_id")
    r = ranked(t).select("trip_id", "frame_id", "track_id", "rank", "bbox_iou")
    return g.join(r, ["trip_id", "frame_id"], "left").withColumn("no_candidate", F.col("rank").isNull())


@query("order_components", "SELECT trip_id, frame_id, ordinal, depth_m, row_number() OVER (PARTITION BY trip_id, frame_id ORDER BY depth_m, width * height DESC, ordinal) AS place FROM candidates", "depth_m")
def _(t):
    c = t.candidates.withColumn("_area", -F.col("width") * F.col("height"))
    return P.with_box_index(c, order=("depth_m", "_area", "ordinal")).select(
        "trip_id", "frame_id", "ordinal", "depth_m", F.col("box_index").alias("place"))


@query("box_index", """SELECT trip_id, frame_id, ordinal, box_index, count(*) OVER (PARTITION BY trip_id, frame_id) = max(box_index) OVER (PARTITION BY trip_id, frame_id) AS contiguous
FROM (SELECT *, row_number() OVER (PARTITION BY trip_id, frame_id ORDER BY ordinal) AS box_index FROM detections)""")
def _(t):
    d = P.with_box_index(t.detections).select("trip_id", "frame_id", "ordinal", "box_index")
    n = d.groupBy("trip_id", "frame_id").agg((F.max("box_index") == F.count(F.lit(1))).alias("contiguous"))
    return d.join(n, ["trip_id", "frame_id"])


@query("blocked_folds", "SELECT trip_id, frame_id, ntile(4) OVER (PARTITION BY trip_id ORDER BY frame_id) AS fold FROM frames")
def _(t):
    return P.blocked_folds(t.frames.select("trip_id", "frame_id"))


@query("latest_observation", "SELECT trip_id, track_id, arg_max(frame_id, (frame_id, ordinal)) AS frame_id, arg_max(depth_m, (frame_id, ordinal)) AS depth_m, arg_max(confidence, (frame_id, ordinal)) AS confidence FROM candidates GROUP BY trip_id, track_id", "depth_m confidence")
def _(t):
    return K.latest_observation(t.candidates, ["depth_m", "confidence"])


@query("risk_tracks", """SELECT trip_id, frame_id, ordinal, track_id FROM candidates WHERE hits >= 3 AND bottom_y >= 5e-1 AND height >= 5e-2 AND bottom_y >= 36e-2
 AND abs(center_x - 5e-1) <= (16e-2 + least(greatest((bottom_y - 36e-2) / 64e-2, 0e0), 1e0) * (55e-2 - 16e-2)) / 2""".replace(
    "FROM candidates WHERE", "FROM (SELECT *, row_number() OVER (PARTITION BY trip_id, track_id ORDER BY frame_id, ordinal) AS hits FROM candidates) WHERE"))
def _(t):
    from roadrisk.operators.sequence import with_position
    c = with_position(t.candidates, ["trip_id", "track_id"], ["frame_id", "ordinal"]).withColumn("confirmed", F.col("position") >= 2)
    return K.risk_tracks(c, 0.5, 0.05).select("trip_id", "frame_id", "ordinal", "track_id")


@query("frame_sets", """SELECT 'both' AS side, trip_id, frame_id FROM (SELECT trip_id, frame_id FROM predictions WHERE classical_ttc < 2 INTERSECT SELECT trip_id, frame_id FROM predictions WHERE detector_ttc < 2)
UNION ALL SELECT 'classical_only', trip_id, frame_id FROM (SELECT trip_id, frame_id FROM predictions WHERE classical_ttc < 2 EXCEPT SELECT trip_id, frame_id FROM predictions WHERE detector_ttc < 2)
UNION ALL SELECT 'detector_only', trip_id, frame_id FROM (SELECT trip_id, frame_id FROM predictions WHERE detector_ttc < 2 EXCEPT SELECT trip_id, frame_id FROM predictions WHERE classical_ttc < 2)""")
def _(t):
    c = t.predictions.filter(X.is_danger("classical_ttc")).select("trip_id", "frame_id")
    d = t.predictions.filter(X.is_danger("detector_ttc")).select("trip_id", "frame_id")

    def side(df, name):
        return df.select(F.lit(name).alias("side"), "trip_id", "frame_id")
    return side(c.intersect(d), "both").unionByName(side(c.subtract(d), "classical_only")).unionByName(
        side(d.subtract(c), "detector_only"))


@query("screening_filter", "SELECT trip_id, frame_id, min_ttc AS truth_ttc FROM frames WHERE min_ttc < 3 OR frame_id % 15 = 0", "truth_ttc")
def _(t):
    return P.screening_frames(truth(t))
