"""Queries over rule sweeps, cross-validation and semantic fusion."""
from pyspark.sql import functions as F

from roadrisk.constants import CURRENT_GUARD, GUARD_AXES, GUARD_SCALE
from roadrisk.operators import association as A
from roadrisk.operators import fusion as M
from roadrisk.operators import sweep as V
from roadrisk.operators.lineage import cut
from roadrisk.plans import sqltext as Q
from roadrisk.plans.geometry_queries import ASSOC, CORRIDOR
from roadrisk.plans.inputs import boxes, detections, truth
from roadrisk.plans.registry import query

# limits the synthetic tables can meet; the published 28.7, 38.4 and 1e-4 are the defaults
GUARD_COMPOSITE, SEMANTIC_COMPOSITE, MAE_TOLERANCE = 6.0, 5.0, 5.0


def _grid_sql():
    step, cols = V.GRID_SIZE, []
    for axis, values in GUARD_AXES.items():
        step //= len(values)
        i = f"i // {step} % {len(values)} + 1"
        if axis == "corridor":
            cols += [f"[{', '.join(f'{v[0]}e0' for v in values)}][{i}] AS corridor_top_width",
                     f"[{', '.join(f'{v[1]}e0' for v in values)}][{i}] AS corridor_bottom_width"]
        else:
            cols.append(f"[{', '.join(f'{v}e0' for v in values)}][{i}] AS {axis}")
    dist = " + ".join(f"abs({n} - {CURRENT_GUARD[n]}e0) / {s}e0" for n, s in GUARD_SCALE.items())
    return f"""cfg AS (SELECT *, {dist} AS distance FROM (SELECT i AS config_id, {', '.join(cols)} FROM (SELECT unnest(generate_series(0, {V.GRID_SIZE - 1})) AS i)))"""


GRID = _grid_sql()
PASSED = f"""pre AS (SELECT * FROM candidates WHERE isfinite(candidate_ttc) AND bottom_y >= 45e-2 AND height >= 3e-2 AND confidence >= 7e-1
  AND closing_mps <= 25 AND depth_m <= 25 AND residual_m <= 11e-1),
 hit AS (SELECT g.config_id, c.trip_id, c.frame_id, c.candidate_ttc FROM pre c JOIN cfg g ON {CORRIDOR.format(top='corridor_top_width', bottom='corridor_bottom_width')}
  AND bottom_y >= minimum_bottom AND height >= minimum_height AND confidence >= minimum_confidence AND closing_mps <= maximum_closing_speed_mps
  AND depth_m <= maximum_depth_m AND residual_m <= maximum_motion_residual_m)"""


@query("guard_grid", f"""WITH {GRID}, {PASSED}
SELECT_FINAL cfg.*, coalesce(n, 0) AS accepted FROM cfg LEFT JOIN (SELECT config_id, count(*) AS n FROM hit GROUP BY config_id) h ON h.config_id = cfg.config_id""",
       "corridor_top_width corridor_bottom_width minimum_bottom minimum_height minimum_confidence maximum_closing_speed_mps maximum_depth_m maximum_motion_residual_m distance")
def _(t):
    n = V.grid_candidates(t.candidates).groupBy("config_id").agg(F.sum("accepted").alias("accepted"))
    return V.guard_grid(t.spark).join(n, "config_id", "left").na.fill(0, ["accepted"])


@query("grid_candidates", f"""WITH {GRID}, {PASSED}
SELECT_FINAL c.config_id, tr.trip_id, coalesce(n, 0) AS accepted FROM cfg c JOIN (SELECT DISTINCT trip_id FROM pre) tr ON true
 LEFT JOIN (SELECT config_id, trip_id, count(*) AS n FROM hit GROUP BY config_id, trip_id) h ON h.config_id = c.config_id AND h.trip_id = tr.trip_id""")
def _(t):
    return V.grid_candidates(t.candidates)


def sweep_sums(least: str, configs: str) -> str:
    """Sums per (config_id, trip_id) from least TTC rows: trip base plus differences."""
    inv = "(CASE WHEN isfinite(t) THEN 1 / greatest(1e-1, t) ELSE 0 END)"
    return f"""SELECT c.config_id, b.trip_id, b.frames, b.critical_frames, coalesce(d.tp, 0) AS tp, coalesce(d.fp, 0) AS fp,
  b.fn - coalesce(d.tp, 0) AS fn, b.tn - coalesce(d.fp, 0) AS tn, b.critical_error + coalesce(d.ce, 0) AS critical_error, b.inverse_error + coalesce(d.ie, 0) AS inverse_error
 FROM (SELECT trip_id, {Q.sums("CAST('inf' AS DOUBLE)", "min_ttc")} FROM frames GROUP BY trip_id) b JOIN (SELECT DISTINCT config_id FROM {configs}) c ON true
 LEFT JOIN (SELECT config_id, trip_id, count(*) FILTER (WHERE p < 2 AND t < 2) AS tp, count(*) FILTER (WHERE p < 2 AND NOT t < 2) AS fp,
   sum(CASE WHEN t < 3 THEN abs(p - t) - (99 - t) END) AS ce, sum(abs(1 / greatest(1e-1, p) - {inv}) - {inv}) AS ie
  FROM (SELECT l.config_id, l.trip_id, l.p, f.min_ttc AS t FROM {least} l JOIN frames f ON f.trip_id = l.trip_id AND f.frame_id = l.frame_id) x GROUP BY config_id, trip_id) d
  ON d.config_id = c.config_id AND d.trip_id = b.trip_id"""


LEAST = "least_ttc AS (SELECT config_id, trip_id, frame_id, min(candidate_ttc) AS p FROM hit GROUP BY config_id, trip_id, frame_id)"
GRID_SCORES = f"{GRID}, {PASSED}, {LEAST}, sc AS ({Q.scores(sweep_sums('least_ttc', 'cfg'), 'config_id, trip_id')})"


def grid_scores(t):
    return V.grid_sweep(t.candidates, truth(t))


@query("guard_sweep", f"WITH {GRID_SCORES}\nSELECT_FINAL * FROM sc", Q.SCORE_DOUBLES)
def _(t):
    return grid_scores(t)


TRAIN = """tot AS (SELECT config_id, count(*) AS n, sum(f1) AS f1, sum(composite) AS composite, sum(mae_critical) AS mae FROM sc GROUP BY config_id),
 tr AS (SELECT sc.*, (tot.f1 - sc.f1) / (n - 1) AS t_f1, (tot.composite - sc.composite) / (n - 1) AS t_comp, (tot.mae - sc.mae_critical) / (n - 1) AS t_mae,
  tot.f1 / n AS a_f1, tot.composite / n AS a_comp, tot.mae / n AS a_mae FROM sc JOIN tot ON tot.config_id = sc.config_id)"""


@query("loto_select", f"""WITH {GRID_SCORES}, {TRAIN},
 r AS (SELECT trip_id AS held_out, config_id, t_f1, t_comp, t_mae, f1, composite FROM tr
  UNION ALL SELECT DISTINCT 'ALL', config_id, a_f1, a_comp, a_mae, NULL, NULL FROM tr),
 ok AS (SELECT r.*, distance FROM r JOIN cfg ON cfg.config_id = r.config_id JOIN (SELECT held_out, t_mae AS lim FROM r WHERE config_id = {V.current_guard_id()}) l ON l.held_out = r.held_out
  WHERE t_comp >= {GUARD_COMPOSITE} AND t_mae <= lim + 1e-9),
 b AS (SELECT *, row_number() OVER (PARTITION BY held_out ORDER BY round(t_f1, 9) DESC, round(t_comp, 9) DESC, round(t_mae, 9), round(distance, 9), config_id) AS rn,
  count(*) OVER (PARTITION BY held_out) AS n FROM ok)
SELECT_FINAL h.held_out, coalesce(n, 0) AS feasible_configs, config_id, t_f1 AS train_f1, t_comp AS train_composite, t_mae AS train_mae_critical, f1 AS held_f1, composite AS held_composite, t_f1 - f1 AS gap FROM (SELECT DISTINCT held_out FROM r) h LEFT JOIN b ON b.held_out = h.held_out AND rn = 1""",
       "train_f1 train_composite train_mae_critical held_f1 held_composite gap")
def _(t):
    return V.loto_select(cut(grid_scores(t)), V.guard_grid(t.spark), V.current_guard_id(), GUARD_COMPOSITE)


def semantic(t):
    t = t.framed
    return M.semantic_state(A.associate_detections(boxes(t), detections(t)).drop("box", "width", "det_class", "det_iou"))


# EMA by recursion over each track's rows
SEM = f"""a AS (SELECT s.*, c.depth_m, c.candidate_ttc, c.center_x, c.bottom_y, c.width, c.height, c.confidence, c.closing_mps, c.residual_m,
   row_number() OVER (PARTITION BY s.trip_id, s.track_id ORDER BY s.frame_id, s.ordinal) AS rn FROM {ASSOC} s JOIN candidates c ON c.trip_id = s.trip_id AND c.frame_id = s.frame_id AND c.ordinal = s.ordinal),
 w AS (SELECT trip_id, track_id, rn, CASE WHEN matched THEN 4e-1 * det_confidence ELSE 0e0 END AS score, CAST(CASE WHEN matched THEN 0 ELSE 1 END AS BIGINT) AS misses FROM a WHERE rn = 1
  UNION ALL SELECT a.trip_id, a.track_id, a.rn, CASE WHEN a.matched THEN 4e-1 * a.det_confidence ELSE 0e0 END + 6e-1 * w.score, CASE WHEN a.matched THEN 0 ELSE w.misses + 1 END
  FROM w JOIN a ON a.trip_id = w.trip_id AND a.track_id = w.track_id AND a.rn = w.rn + 1),
 st AS (SELECT a.*, w.score, w.misses FROM a JOIN w ON w.trip_id = a.trip_id AND w.track_id = a.track_id AND w.rn = a.rn)"""


@query("semantic_state", f"""WITH {SEM}
SELECT_FINAL trip_id, frame_id, ordinal, track_id, matched, score, misses, depth_m > 5 AND score < 25e-2 AND misses >= 3 AS suppressed FROM st""", "score")
def _(t):
    s = semantic(t)
    return s.select("trip_id", "frame_id", "ordinal", "track_id", "matched", "score", "misses",
                    M.suppressed(0.25, 3, 5.0).alias("suppressed"))


SEM_CFG = "scfg AS (SELECT 0 AS config_id, -1e0 AS s, 0 AS m, 0e0 AS d UNION ALL SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {s}e0, {m}, {d}e0)" for i, (_, s, m, d) in enumerate(M.semantic_configs(), 1)) + "))"
SEM_HIT = f"""sh AS (SELECT config_id, trip_id, frame_id, candidate_ttc FROM st JOIN scfg ON NOT (depth_m > d AND score < s AND misses >= m)
  WHERE {CORRIDOR.format(top='1e-1', bottom='5e-1')} AND bottom_y >= 5e-1 AND height >= 5e-2 AND confidence >= 75e-2 AND closing_mps <= 20 AND depth_m <= 20
  AND residual_m <= 8e-1 AND isfinite(candidate_ttc)),
 sl AS (SELECT config_id, trip_id, frame_id, min(candidate_ttc) AS p FROM sh GROUP BY config_id, trip_id, frame_id)"""
SEM_SCORES = f"{SEM}, {SEM_CFG}, {SEM_HIT}, sc AS ({Q.scores(sweep_sums('sl', 'scfg'), 'config_id, trip_id')})"


@query("semantic_fusion", f"""WITH {SEM}, {SEM_CFG}, {SEM_HIT}
SELECT_FINAL c.config_id, f.trip_id, f.frame_id, p AS predicted_ttc FROM scfg c CROSS JOIN frames f LEFT JOIN sl ON sl.config_id = c.config_id AND f.trip_id = sl.trip_id AND f.frame_id = sl.frame_id""", "predicted_ttc")
def _(t):
    return M.fused_predictions(M.config_minima(semantic(t)), t.frames)


GUARD_SQL = f"""{CORRIDOR.format(top='1e-1', bottom='5e-1')} AND bottom_y >= 5e-1 AND height >= 5e-2 AND confidence >= 75e-2 AND closing_mps <= 20 AND depth_m <= 20
  AND residual_m <= 8e-1 AND isfinite(candidate_ttc)"""


@query("candidate_diagnostics", f"""WITH {SEM}
SELECT_FINAL trip_id, frame_id, ordinal, track_id, row_number() OVER (PARTITION BY trip_id ORDER BY frame_id, ordinal) - 1 AS candidate_idx, depth_m, matched, score, misses, suppressed, {GUARD_SQL} AND NOT suppressed AS accepted
FROM (SELECT *, depth_m > 5 AND score < 25e-2 AND misses >= 3 AS suppressed FROM st)""", "depth_m score")
def _(t):
    return M.candidate_diagnostics(semantic(t), 0.25, 3, 5.0)


def semantic_scores(t):
    return V.semantic_sweep(M.by_config(M.config_minima(semantic(t))), truth(t), 1 + len(M.semantic_configs()))


@query("semantic_sweep", f"WITH {SEM_SCORES}\nSELECT_FINAL * FROM sc", Q.SCORE_DOUBLES)
def _(t):
    return semantic_scores(t)


LOTO_SEM = f"""{SEM_SCORES}, {TRAIN},
 ok AS (SELECT tr.* FROM tr JOIN (SELECT trip_id, t_mae AS lim FROM tr WHERE config_id = 0) l ON l.trip_id = tr.trip_id WHERE config_id > 0 AND t_comp >= {SEMANTIC_COMPOSITE} AND t_mae <= lim + {MAE_TOLERANCE}),
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY round(t_f1, 9) DESC, config_id) AS rn FROM ok) WHERE rn = 1)"""


@query("loto_semantic", f"""WITH {LOTO_SEM}
SELECT_FINAL tt.trip_id, b.trip_id IS NULL AS infeasible, b.config_id, t_f1 AS train_f1, t_comp AS train_composite, t_mae AS train_mae_critical, f1 AS held_f1,
 composite AS held_composite, mae_critical AS held_mae_critical, recall AS held_recall, fp AS held_fp FROM (SELECT DISTINCT trip_id FROM sc) tt LEFT JOIN b ON b.trip_id = tt.trip_id""",
       "train_f1 train_composite train_mae_critical held_f1 held_composite held_mae_critical held_recall")
def _(t):
    return V.loto_semantic(cut(semantic_scores(t)), SEMANTIC_COMPOSITE, MAE_TOLERANCE)


_macro = "avg(f1) AS macro_f1, avg(composite) AS macro_composite, avg(mae_critical) AS macro_mae, CAST(sum(fp) AS BIGINT) AS total_fp, avg(recall) AS macro_recall, count(*) AS trips"


@query("selection_modes", f"""WITH {LOTO_SEM}, mac AS (SELECT config_id, {_macro} FROM sc GROUP BY config_id), lim AS (SELECT macro_mae AS x FROM mac WHERE config_id = 0),
 gl AS (SELECT mac.*, row_number() OVER (ORDER BY (macro_composite >= {SEMANTIC_COMPOSITE} AND macro_mae <= x + {MAE_TOLERANCE}) DESC, round(macro_f1, 9) DESC, config_id) AS rn FROM mac, lim WHERE config_id > 0),
 orc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY round(f1, 9) DESC, config_id) AS rn FROM sc) WHERE rn = 1),
 u AS (SELECT 'baseline' AS mode, * FROM mac WHERE config_id = 0 UNION ALL SELECT 'global_best', * EXCLUDE (rn) FROM gl WHERE rn = 1
  UNION ALL SELECT 'loto', NULL, {_macro} FROM b UNION ALL SELECT 'oracle', NULL, {_macro} FROM orc)
SELECT_FINAL u.*, coalesce(macro_composite >= {SEMANTIC_COMPOSITE}, false) AS passes_composite, coalesce(macro_mae <= x + {MAE_TOLERANCE}, false) AS passes_mae, coalesce(macro_f1 >= 6e-1, false) AS reaches_target FROM u, lim""",
       "macro_f1 macro_composite macro_mae macro_recall")
def _(t):
    return V.selection_modes(cut(semantic_scores(t)), SEMANTIC_COMPOSITE, MAE_TOLERANCE)
