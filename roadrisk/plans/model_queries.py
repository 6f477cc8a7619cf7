"""Queries over models, tracking and gates that need running state."""
from pyspark.sql import functions as F

from roadrisk.functions import geometry as G
from roadrisk.functions import ttc as X
from roadrisk.operators import association as A
from roadrisk.operators import audits as D
from roadrisk.operators import models as V
from roadrisk.operators import motion as M
from roadrisk.operators import sampling as P
from roadrisk.operators import scoring as S
from roadrisk.operators import tracking as R
from roadrisk.operators.lineage import cut
from roadrisk.plans import sqltext as Q
from roadrisk.plans.inputs import boxes, components, evidence, featured, observations, union_predictions, updates
from roadrisk.plans.registry import query

T, FR = "trip_id", "frame_id"


def paired(t):
    """Both sources per frame with the inputs of the router; the fold is the trip."""
    c = S.select_min_ttc(t.candidates).select(T, FR, F.col("confidence").alias("c_confidence"))
    n = t.candidates.groupBy(T, FR).agg(
        F.count(F.lit(1)).cast("double").alias("c_components"), F.min("residual_m").alias("c_residual"),
        F.max("width").alias("c_quality"), F.max("height").alias("c_lr_support"))
    d = t.detections.groupBy(T, FR).agg(
        F.max("confidence").alias("d_confidence"), F.count_if(A.retained()).cast("double").alias("d_components"),
        F.count_if(F.col("confidence") > 0.6).cast("double").alias("d_risk_tracks"))
    k = F.col("k")
    f = t.frames.select(
        T, FR, "speed_mps", ((k % 11) / 10.0).alias("d_residual"), ((k % 7) / 7.0).alias("d_quality"), ((k % 5) / 5.0).alias("d_lr_support"),
        (k % 12).cast("double").alias("c_history"), (k % 10).cast("double").alias("d_history"), ((k % 9) / 9.0).alias("d_depth_confidence"),
        ((k % 4) / 4.0).alias("c_ground"), ((k % 6) / 6.0).alias("d_ground"))
    p = t.predictions.select(T, FR, F.col("classical_ttc").alias("c_ttc"), F.col("detector_ttc").alias("d_ttc"), F.col("min_ttc").alias("truth_ttc"))
    j = p.join(f, [T, FR]).join(c, [T, FR], "left").join(n, [T, FR], "left").join(d, [T, FR], "left")
    return V.router_features(j.withColumn("fold", F.substring(T, 2, 1).cast("int")))


PAIRED = """(SELECT p.trip_id, p.frame_id, p.classical_ttc AS c, p.detector_ttc AS d, f.speed_mps, f.k, s.confidence AS cc, n.*, e.* FROM predictions p JOIN frames f ON f.trip_id = p.trip_id AND f.frame_id = p.frame_id
 LEFT JOIN (SELECT trip_id AS a1, frame_id AS a2, confidence FROM (SELECT *, row_number() OVER (PARTITION BY trip_id, frame_id ORDER BY candidate_ttc, ordinal) AS rn FROM candidates WHERE confidence >= 55e-2 AND closing_mps BETWEEN 3e-1 AND 40 AND isfinite(candidate_ttc)) WHERE rn = 1) s ON a1 = p.trip_id AND a2 = p.frame_id
 LEFT JOIN (SELECT trip_id AS b1, frame_id AS b2, count(*) AS cn, min(residual_m) AS cres, max(width) AS cq, max(height) AS cl FROM candidates GROUP BY trip_id, frame_id) n ON b1 = p.trip_id AND b2 = p.frame_id
 LEFT JOIN (SELECT trip_id AS d1, frame_id AS d2, max(confidence) AS dc, count(*) FILTER (WHERE class_id IN (0, 1, 2, 3, 5, 7)) AS dn, count(*) FILTER (WHERE confidence > 6e-1) AS dr FROM detections GROUP BY trip_id, frame_id) e ON d1 = p.trip_id AND d2 = p.frame_id)"""
_inv = "(CASE WHEN isfinite({x}) THEN 1 / greatest(1e-1, {x}) ELSE 0 END)"


FEATURE_SQL = f"""SELECT trip_id, frame_id, CASE WHEN d < 2 THEN 1 ELSE 0 END AS detector_is_danger, coalesce(dc, 0) - coalesce(cc, 0) AS detector_minus_classical_confidence, least(greatest(coalesce(cres, 5) - (k % 11) / 10, -5), 5) / 5 AS classical_minus_detector_residual,
 (k % 7) / 7 - coalesce(cq, 0) AS detector_minus_classical_quality, (k % 5) / 5 - coalesce(cl, 0) AS detector_minus_classical_lr_support, (k % 10 - k % 12) / 11 AS detector_minus_classical_history, (k % 9) / 9 AS detector_depth_confidence, least(greatest(coalesce(dn, 0) - coalesce(cn, 0), -5), 5) / 5 AS detector_minus_classical_proposal_count,
 least(5, coalesce(dr, 0)) / 5 AS detector_risk_track_count, (k % 6) / 6 - (k % 4) / 4 AS detector_minus_classical_ground_confidence, least(40, speed_mps) / 40 AS ego_speed_normalized, abs({_inv.format(x='d')} - {_inv.format(x='c')}) AS inverse_ttc_disagreement FROM {PAIRED}"""


@query("router_features", FEATURE_SQL, " ".join(V.ROUTER_FEATURES))
def _(t):
    return paired(t).select(T, FR, *V.ROUTER_FEATURES)


def routers(t, p):
    return V.fit_routers(cut(V.training_rows(p)), t.spark.range(6).select(F.col("id").cast("int").alias("fold")))


@query("fit_router")
def _(t):
    m = routers(t, paired(t)).select("fold", F.posexplode("weights").alias("_i", "weight"))
    names = F.array(*[F.lit(n) for n in ("intercept", *V.ROUTER_FEATURES)])
    return m.select("fold", names[F.col("_i")].alias("feature"), "weight")


@query("route")
def _(t):
    p = paired(t)
    return V.route(p, V.linear_form(routers(t, p))).select(T, FR, "detector_probability", "chose_detector", "routed_ttc")


@query("cv_router")
def _(t):
    p = paired(t)
    return V.cv_router(p, V.linear_form(routers(t, p)))


# fixed models: fold f has the bias (f - 2) / 2 and slopes that fall off with the feature's number; fold 5 has none
SLOPES = [(5 - i) / 4 for i in range(len(V.ROUTER_FEATURES))]


def fixed_models(t):
    f = t.spark.range(5).select(F.col("id").cast("int").alias("fold"))
    return f.select("fold", ((F.col("fold") - 2) / 2.0).alias("bias"), F.array(*[F.lit(v) for v in SLOPES]).alias("slopes"))


ROUTED = f"""(SELECT x.*, c < 2 AS cd, d < 2 AS dd, truth_ttc, CASE WHEN fold < 5 THEN 1 / (1 + exp(-least(greatest((fold - 2) / 2 + {' + '.join(f'{v!r}e0 * {n}' if v >= 0 else f'({v!r}e0) * {n}' for v, n in zip(SLOPES, V.ROUTER_FEATURES))}, -30), 30))) END AS prob
 FROM (SELECT r.*, p.classical_ttc AS c, p.detector_ttc AS d, p.min_ttc AS truth_ttc, CAST(substr(r.trip_id, 2, 1) AS INTEGER) AS fold FROM ({FEATURE_SQL}) r JOIN predictions p ON p.trip_id = r.trip_id AND p.frame_id = r.frame_id) x)"""
CHOICE = f"(SELECT *, cd <> dd AND coalesce(prob >= 5e-1, false) AS chose, CASE WHEN cd <> dd AND coalesce(prob >= 5e-1, false) THEN d ELSE c END AS routed, CASE WHEN dd AND NOT cd THEN d ELSE c END AS united FROM {ROUTED})"


@query("route_fixed", f"SELECT trip_id, frame_id, prob AS detector_probability, chose AS chose_detector, routed AS routed_ttc FROM {CHOICE}", "detector_probability routed_ttc")
def _(t):
    return V.route(paired(t), fixed_models(t)).select(T, FR, "detector_probability", "chose_detector", "routed_ttc")


@query("cv_router_fixed", Q.score("(" + " UNION ALL ".join(f"SELECT trip_id, truth_ttc, '{n}' AS source, {c} AS predicted_ttc FROM {CHOICE}" for n, c in (
    ("router", "routed"), ("classical", "c"), ("detector", "d"), ("union", "united"))) + ")", "source, trip_id"), Q.SCORE_DOUBLES)
def _(t):
    return V.cv_router(paired(t), fixed_models(t))


def tree_rows(t):
    f = D.frame_features(featured(t), t.frames.select(T, FR, X.is_danger("min_ttc").cast("int").alias("label")))
    names = [c for c in f.columns if c not in (T, FR, "label")]
    return P.blocked_folds(f), names


TREE_F = Q.FEATURE_NAMES
TREE_SQL = f"(SELECT *, CASE WHEN truth_ttc < 2 THEN 1 ELSE 0 END AS label FROM {Q.FEATURES})"


@query("tree_split", f"""WITH l AS ({' UNION ALL '.join(f"SELECT trip_id AS node, label, {i} AS feature, CAST({c} AS DOUBLE) AS value FROM {TREE_SQL}" for i, c in enumerate(TREE_F))}),
 c AS (SELECT node, feature, value, count(*) AS n, sum(label) AS p FROM l GROUP BY node, feature, value),
 w AS (SELECT *, sum(n) OVER o AS ln, sum(p) OVER o AS lp, row_number() OVER o - 1 AS i, lead(value) OVER o AS up, sum(n) OVER q AS tn, sum(p) OVER q AS tp, count(*) OVER q - 1 AS m FROM c WINDOW o AS (PARTITION BY node, feature ORDER BY value), q AS (PARTITION BY node, feature)),
 s AS (SELECT node, feature, (value + up) / 2 AS threshold, round(2 * lp * (ln - lp) / ln + 2 * (tp - lp) * (tn - ln - tp + lp) / (tn - ln), 9) AS cost, tn, tp, ln, lp, 2 * tp * (tn - tp) / tn AS parent_cost FROM w
  WHERE up IS NOT NULL AND ln >= 5 AND tn - ln >= 5 AND (m <= 64 OR EXISTS (SELECT 1 FROM (SELECT unnest(generate_series(0, 63)) AS j) WHERE CAST(floor(j * (w.m - 1) / 63) AS BIGINT) = w.i)))
SELECT_FINAL node, cost, feature, threshold, parent_cost, CAST(tn AS BIGINT) AS "rows", CAST(tp AS BIGINT) AS positives, CAST(ln AS BIGINT) AS left_rows, CAST(lp AS BIGINT) AS left_positives, cost < parent_cost - 1e-9 AS accepted
 FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY cost, feature, threshold) AS rn FROM s) WHERE rn = 1""", "cost threshold parent_cost")
def _(t):
    rows, _names = tree_rows(t)
    return V.tree_split(rows.withColumnRenamed(T, "node"), list(TREE_F))


@query("capacity_report")
def _(t):
    rows, names = tree_rows(t)
    return V.capacity_report(cut(rows.drop(T, FR)), names)


@query("track_components")
def _(t):
    return R.track_components(boxes(t))


def planar(t):
    o = observations(t)
    return R.planar_filter(o.select(
        T, "track_id", FR, "ordinal", "t_sec", F.col("depth_m").alias("forward_m"), "lateral_m", "speed_mps",
        G.yaw_rate("speed_mps", "lateral_accel").alias("yaw")))


@query("planar_filter")
def _(t):
    return planar(t)


@query("track_occupancy")
def _(t):
    return R.track_occupancy(planar(t), "candidate_depth").select(
        T, FR, "track_id", "ordinal", "accepted", "horizon_s", "measurement_source", "corridor_occupancy_probability")


@query("multicue_rank")
def _(t):
    e = evidence(t).filter(A.classical_danger())
    return R.multicue_rank(e, updates(t))


@query("reset_groups", "SELECT trip_id, frame_id, sum(CASE WHEN k % 101 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY trip_id ORDER BY frame_id) AS reset_group FROM frames".replace("sum(", "CAST(sum(").replace("ORDER BY frame_id)", "ORDER BY frame_id) AS BIGINT)"))
def _(t):
    return R.reset_groups(t.frames.select(T, FR, "k"), F.col("k") % 101 == 0).select(T, FR, "reset_group")


@query("fail_closed", """SELECT trip_id, frame_id, k % 101 = 0 AS degraded, CASE WHEN k % 101 <> 0 THEN min_ttc END AS ttc, CAST(sum(CASE WHEN k % 101 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY trip_id ORDER BY frame_id) AS BIGINT) AS reset_group FROM frames""", "ttc")
def _(t):
    f = t.frames.select(T, FR, "k", F.col("min_ttc").alias("ttc"))
    return R.fail_closed(f, F.col("k") % 101 == 0).select(T, FR, "degraded", "ttc", "reset_group")


_LIMITS = "confidence >= 75e-2 AND closing_mps <= 20 AND depth_m <= 20 AND residual_m <= 8e-1 AND isfinite(candidate_ttc)"
_LEAST = "CASE WHEN speed_mps <= 6 THEN 45e-1 ELSE 3e-1 END"


@query("classical_choice", f"""WITH c AS (SELECT c.*, f.speed_mps FROM candidates c JOIN frames f ON f.trip_id = c.trip_id AND f.frame_id = c.frame_id WHERE {_LIMITS}),
 a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trip_id, frame_id ORDER BY candidate_ttc, ordinal) AS rn FROM c WHERE closing_mps >= {_LEAST}) WHERE rn = 1),
 r AS (SELECT trip_id, frame_id, min(candidate_ttc) AS raw_ttc FROM c WHERE closing_mps >= 3e-1 GROUP BY trip_id, frame_id)
SELECT_FINAL f.trip_id, f.frame_id, a.candidate_ttc AS ttc, a.track_id, a.confidence, a.closing_mps, r.raw_ttc, f.speed_mps <= 6 AS low_ego FROM frames f LEFT JOIN a ON a.trip_id = f.trip_id AND a.frame_id = f.frame_id
LEFT JOIN r ON r.trip_id = f.trip_id AND r.frame_id = f.frame_id""", "ttc confidence closing_mps raw_ttc")
def _(t):
    return R.classical_choice(t.candidates, t.frames, 6.0, 4.5)


@query("union_gates")
def _(t):
    t = t.framed
    e = A.best_iou_match(evidence(t), updates(t), 0.30).select(
        T, FR, "predicted_ttc", "union_source", "classical_ttc", "detector_ttc", "speed_mps", "lateral_accel", "matched_iou", F.col("match.track_id").alias("track_id"))
    path = M.path_intersection(observations(t).select(T, "track_id", FR, "t_sec", "depth_m", "centre_x", "ttc", "lateral_accel")).select(T, FR, "track_id", "intersects")
    v = F.col("forward_mps")
    filt = planar(t).select(T, FR, "track_id", F.when(F.col("accepted") & (v < -0.3), F.col("forward_m") / -v).alias("filter_ttc"))
    j = e.join(path, [T, FR, "track_id"], "left").join(filt, [T, FR, "track_id"], "left")
    # the classical TTC before any gate
    j = j.withColumnRenamed("classical_ttc", "raw_classical_ttc")
    g = R.union_gates(j, low_ego_floor=2.1, filter_gate=True, path_gate=True, turn_accel=0.6, turn_min_iou=0.1)
    return g.select(T, FR, "predicted_ttc", "union_source")


@query("track_confidence", f"""WITH {Q.recent_rows(Q.OBS, 11, 'trip_id, track_id', "'t': t_sec, 'v': depth_m, 'q': confidence")}, {Q.slopes()}
SELECT_FINAL trip_id, track_id, frame_id, 25e-2 * least(1, n / 7) + 3e-1 * {Q.total('q.q')} / n + 2e-1 * CASE WHEN n >= 3 THEN exp(-residual / greatest(5e-1, depth_m / 10)) ELSE 0 END + 15e-2 * 8e-1 + 1e-1 * CASE WHEN n >= 3 AND -slope > 3e-1 THEN 1 ELSE 5e-1 END AS track_confidence
FROM rs""", "track_confidence")
def _(t):
    o = observations(t).select(T, "track_id", FR, "t_sec", "depth_m", F.col("confidence").alias("quality"))
    return M.track_confidence(o, ["trip_id", "track_id"], 0.8).select(T, "track_id", FR, "track_confidence")
