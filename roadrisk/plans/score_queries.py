"""Queries over scores: one pass of sums per group."""
from pyspark.sql import functions as F

from roadrisk.constants import CURRENT_GUARD
from roadrisk.functions import ttc as X
from roadrisk.functions.geometry import guard_predicate
from roadrisk.operators import scoring as S
from roadrisk.plans import sqltext as Q
from roadrisk.plans.inputs import truth, union_predictions, variant_predictions
from roadrisk.plans.registry import query


@query("ttc_score", Q.score(Q.UNION, "trip_id"), Q.SCORE_DOUBLES)
def _(t):
    return S.ttc_score(union_predictions(t), ["trip_id"])


@query("danger_confusion", f"SELECT trip_id, variant, {Q.outcomes()} FROM {Q.VARIANTS} GROUP BY trip_id, variant")
def _(t):
    return S.danger_confusion(variant_predictions(t), ["trip_id", "variant"])


MACRO = f"""WITH s AS ({Q.score(Q.VARIANTS, "variant, trip_id")})
SELECT_FINAL variant, avg(f1) AS f1, avg(composite) AS composite, avg(mae_critical) AS mae_critical,
 avg("precision") AS "precision", avg(recall) AS recall, CAST(sum(tp) AS BIGINT) AS tp_sum,
 CAST(sum(fp) AS BIGINT) AS fp_sum, CAST(sum(fn) AS BIGINT) AS fn_sum,
 arg_min(trip_id, (f1, trip_id)) AS worst_trip, arg_min(trip_id, (-f1, trip_id)) AS best_trip
FROM s GROUP BY variant"""


@query("macro_summary", MACRO, "f1 composite mae_critical precision recall")
def _(t):
    return S.macro_summary(S.ttc_score(variant_predictions(t), ["variant", "trip_id"]), ["variant"])


@query("pooled_score", f"""{Q.score(Q.UNION, "trip_id")}
UNION ALL SELECT 'ALL', * FROM ({Q.score(Q.UNION, "")}) p""", Q.SCORE_DOUBLES)
def _(t):
    return S.pooled_score(union_predictions(t), "trip_id")


@query("confusion_rollup", f"""SELECT variant, coalesce(trip_id, 'OVERALL') AS trip_id, tp, fp, fn, tn,
 finite_predictions,
 CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0e0 END AS "precision",
 CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0e0 END AS recall,
 CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0e0 END AS f1
FROM (SELECT variant, trip_id, {Q.outcomes()}, count(*) FILTER (WHERE isfinite(predicted_ttc)) AS finite_predictions
 FROM {Q.VARIANTS} GROUP BY GROUPING SETS ((variant, trip_id), (variant)))""", "precision recall f1")
def _(t):
    return S.confusion_rollup(variant_predictions(t))


@query("gt_distribution", """SELECT coalesce(trip_id, 'TOTAL') AS trip_id, count(*) AS frames,
 count(*) FILTER (WHERE isfinite(min_ttc)) AS finite, count(*) FILTER (WHERE min_ttc < 3) AS below_3s,
 count(*) FILTER (WHERE min_ttc < 2) AS below_2s, count(*) FILTER (WHERE min_ttc < 15e-1) AS below_1_5s,
 min(min_ttc) FILTER (WHERE isfinite(min_ttc)) AS lowest_ttc,
 count(*) FILTER (WHERE min_ttc < 2 AND NOT coalesce(before < 2, false)) AS episodes
FROM (SELECT trip_id, min_ttc, lag(min_ttc) OVER (PARTITION BY trip_id ORDER BY frame_id) AS before FROM frames)
GROUP BY GROUPING SETS ((trip_id), ())""", "lowest_ttc")
def _(t):
    return S.gt_distribution(t.frames)


@query("latency_summary", """SELECT "repeat", stage, quantile_cont(ms, 5e-1) AS p50, quantile_cont(ms, 95e-2) AS p95,
 quantile_cont(ms, 99e-2) AS p99, avg(ms) AS mean, min(ms) AS min, max(ms) AS max, count(*) AS samples,
 CAST(0 AS BIGINT) AS rejected
FROM (SELECT "repeat", 'compute_ms' AS stage, compute_ms AS ms FROM runtime
 UNION ALL SELECT "repeat", 'tracking_ms', tracking_ms FROM runtime
 UNION ALL SELECT "repeat", 'read_ms', read_ms FROM runtime) GROUP BY "repeat", stage""",
       "p50 p95 p99 mean min max")
def _(t):
    return S.latency_summary(t.runtime, ["repeat"])


GUARD_SQL = """bottom_y >= 36e-2 AND abs(center_x - 5e-1) <= (1e-1 + least(greatest((bottom_y - 36e-2) / 64e-2, 0e0), 1e0)
 * (5e-1 - 1e-1)) / 2 AND bottom_y >= 5e-1 AND height >= 5e-2 AND confidence >= 75e-2 AND closing_mps <= 20
 AND depth_m <= 20 AND residual_m <= 8e-1 AND isfinite(candidate_ttc)"""


@query("frame_min_ttc", f"""SELECT f.trip_id, f.frame_id, coalesce(m, CAST('inf' AS DOUBLE)) AS predicted_ttc,
 coalesce(m, 99) < 2 AS danger
FROM frames f LEFT JOIN (SELECT trip_id, frame_id, min(candidate_ttc) AS m FROM candidates WHERE {GUARD_SQL}
 GROUP BY trip_id, frame_id) a ON f.trip_id = a.trip_id AND f.frame_id = a.frame_id""", "predicted_ttc")
def _(t):
    accepted = t.candidates.filter(guard_predicate(CURRENT_GUARD))
    out = S.frame_min_ttc(accepted, t.frames.select("trip_id", "frame_id"))
    return out.withColumn("danger", X.is_danger("predicted_ttc"))


@query("select_min_ttc", """SELECT trip_id, frame_id, candidate_ttc AS ttc, track_id, confidence, closing_mps
FROM (SELECT *, row_number() OVER (PARTITION BY trip_id, frame_id ORDER BY candidate_ttc, ordinal) AS rn FROM candidates
 WHERE confidence >= 55e-2 AND closing_mps BETWEEN 3e-1 AND 40 AND depth_m <= 25 AND residual_m <= 11e-1
 AND isfinite(candidate_ttc)) WHERE rn = 1""", "ttc confidence closing_mps")
def _(t):
    return S.select_min_ttc(t.candidates, max_depth=25.0, max_residual=1.1)


@query("pair_predictions", """SELECT trip_id, frame_id, a_ttc, b_ttc, truth_ttc,
 concat_ws(',', CASE WHEN a_in IS NULL THEN 'a' END, CASE WHEN b_in IS NULL THEN 'b' END,
  CASE WHEN t_in IS NULL THEN 'truth' END) AS missing
FROM (SELECT trip_id, frame_id, min(candidate_ttc) AS a_ttc, true AS a_in FROM candidates WHERE isfinite(candidate_ttc)
  GROUP BY trip_id, frame_id) a
FULL JOIN (SELECT trip_id, frame_id, classical_ttc AS b_ttc, true AS b_in FROM predictions) b USING (trip_id, frame_id)
FULL JOIN (SELECT trip_id, frame_id, min_ttc AS truth_ttc, true AS t_in FROM frames) t USING (trip_id, frame_id)""",
       "a_ttc b_ttc truth_ttc")
def _(t):
    a = t.candidates.filter(X.is_finite("candidate_ttc")).groupBy("trip_id", "frame_id").agg(
        F.min("candidate_ttc").alias("a_ttc"))
    b = t.predictions.select("trip_id", "frame_id", F.col("classical_ttc").alias("b_ttc"))
    return S.pair_predictions(a, b, truth(t))


@query("join_frames", """SELECT f.trip_id, f.frame_id, c.ordinal, c.track_id, c.candidate_ttc, f.min_ttc AS truth_ttc, f.speed_mps
FROM candidates c JOIN frames f ON c.trip_id = f.trip_id AND c.frame_id = f.frame_id""", "candidate_ttc truth_ttc speed_mps")
def _(t):
    f = t.frames.select("trip_id", "frame_id", F.col("min_ttc").alias("truth_ttc"), "speed_mps")
    c = t.candidates.select("trip_id", "frame_id", "ordinal", "track_id", "candidate_ttc")
    return c.join(f, ["trip_id", "frame_id"])


@query("conservative_union", f"SELECT trip_id, frame_id, predicted_ttc, union_source FROM {Q.UNION}", "predicted_ttc")
def _(t):
    return union_predictions(t).select("trip_id", "frame_id", "predicted_ttc", "union_source")


@query("compare_runs", """SELECT *, unpaired + finite_mismatch + value_mismatch = 0 AS equal FROM (
SELECT trip_id, count(*) FILTER (WHERE rin AND cin) AS compared,
 count(*) FILTER (WHERE NOT (coalesce(rin, false) AND coalesce(cin, false))) AS unpaired,
 count(*) FILTER (WHERE rin AND cin AND isfinite(r) <> isfinite(c)) AS finite_mismatch,
 count(*) FILTER (WHERE rin AND cin AND isfinite(r) AND isfinite(c) AND abs(r - c) > 25e-2) AS value_mismatch,
 max(CASE WHEN isfinite(r) AND isfinite(c) THEN abs(r - c) END) AS largest_gap
FROM (SELECT trip_id, frame_id, classical_ttc AS r, true AS rin FROM predictions) a
FULL JOIN (SELECT trip_id, frame_id, detector_ttc AS c, true AS cin FROM predictions) b USING (trip_id, frame_id)
GROUP BY trip_id)""", "largest_gap")
def _(t):
    p = t.predictions
    a = p.select("trip_id", "frame_id", F.col("classical_ttc").alias("ttc"))
    b = p.select("trip_id", "frame_id", F.col("detector_ttc").alias("ttc"))
    return S.compare_runs(a, b, atol=0.25)


@query("repeat_determinism", """SELECT trip_id, CAST(count(*) * 2 AS BIGINT) AS compared,
 count(*) FILTER (WHERE classical_ttc IS DISTINCT FROM detector_ttc) AS mismatches FROM predictions GROUP BY trip_id""")
def _(t):
    runs = F.array(*[
        F.struct(F.lit(i).alias("repeat"), F.col(c).alias("ttc"))
        for i, c in ((1, "classical_ttc"), (2, "detector_ttc"), (3, "classical_ttc"))])
    r = t.predictions.select("trip_id", "frame_id", F.explode(runs).alias("r")).select(
        "trip_id", "frame_id", "r.repeat", "r.ttc")
    return S.repeat_determinism(r, "ttc")


@query("variant_compare", f"""WITH s AS ({Q.score(Q.VARIANTS, "variant, trip_id")})
SELECT_FINAL variant, avg(f1) AS mean_f1, min(f1) AS worst_f1, max(f1) AS best_f1,
 {", ".join(f"max(CASE WHEN trip_id = 'T{i}' THEN f1 END) AS f1_T{i}" for i in range(6))}
FROM s GROUP BY variant""", "mean_f1 worst_f1 best_f1 " + " ".join(f"f1_T{i}" for i in range(6)))
def _(t):
    s = S.ttc_score(variant_predictions(t), ["variant", "trip_id"])
    trips = [f"T{i}" for i in range(6)]
    wide = s.groupBy("variant").pivot("trip_id", trips).agg(F.max("f1"))
    wide = wide.select("variant", *[F.col(c).alias(f"f1_{c}") for c in trips])
    stats = s.groupBy("variant").agg(
        F.avg("f1").alias("mean_f1"), F.min("f1").alias("worst_f1"), F.max("f1").alias("best_f1"))
    return stats.join(wide, "variant")


@query("ttc_columns", """SELECT trip_id, frame_id,
 CASE WHEN isfinite(classical_ttc) THEN 1 / greatest(1e-1, classical_ttc) ELSE 0 END AS inverse,
 CASE WHEN isfinite(classical_ttc) THEN least(classical_ttc, 10) ELSE 10 END AS shown,
 CASE WHEN isfinite(classical_ttc) THEN classical_ttc END AS finite_ttc,
 CASE WHEN classical_ttc < 15e-1 THEN 'CRITICAL' WHEN classical_ttc < 2 THEN 'DANGER'
      WHEN classical_ttc < 3 THEN 'WARNING' ELSE 'SAFE' END AS band,
 CASE WHEN classical_ttc < 2 AND min_ttc < 2 THEN 'TP' WHEN classical_ttc < 2 THEN 'FP'
      WHEN min_ttc < 2 THEN 'FN' ELSE 'TN' END AS outcome
FROM predictions""", "inverse shown finite_ttc")
def _(t):
    c = "classical_ttc"
    return t.predictions.select(
        "trip_id", "frame_id", X.inverse_ttc(c).alias("inverse"), X.display_ttc(c).alias("shown"),
        X.finite(c).alias("finite_ttc"), X.ttc_band(c).alias("band"),
        X.danger_outcome(c, "min_ttc").alias("outcome"))
