"""Pieces of oracle SQL that several queries share."""

OUTCOMES = """
  count(*) FILTER (WHERE {p} < 2 AND {t} < 2) AS tp,
  count(*) FILTER (WHERE {p} < 2 AND NOT {t} < 2) AS fp,
  count(*) FILTER (WHERE NOT {p} < 2 AND {t} < 2) AS fn,
  count(*) FILTER (WHERE NOT {p} < 2 AND NOT {t} < 2) AS tn"""


def outcomes(p="predicted_ttc", t="truth_ttc"):
    return OUTCOMES.format(p=p, t=t)


def sums(p="predicted_ttc", t="truth_ttc"):
    inv = "(CASE WHEN isfinite({x}) THEN 1 / greatest(1e-1, {x}) ELSE 0 END)"
    return f"""count(*) AS frames, {outcomes(p, t)},
  count(*) FILTER (WHERE {t} < 3) AS critical_frames,
  sum(CASE WHEN {t} < 3 THEN abs((CASE WHEN isfinite({p}) THEN {p} ELSE 99 END) - {t}) END) AS critical_error,
  sum(abs({inv.format(x=p)} - {inv.format(x=t)})) AS inverse_error"""


def scores(sums_sql: str, keys: str) -> str:
    """Scores from a SELECT of keys and sums; columns as ``scores_from_sums`` leaves them."""
    k = keys + ", " if keys else ""
    return f"""SELECT {k}frames, tp, fp, fn, tn, critical_frames, "precision", recall, mae_critical, inverse_mae, f1,
  4e-1 * coalesce(greatest(0, 100 - 20 * mae_critical), 0) + 30 * f1
  + 3e-1 * coalesce(greatest(0, 100 - 200 * inverse_mae), 0) AS composite
FROM (SELECT *, CASE WHEN "precision" + recall > 0 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0e0 END AS f1
 FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0e0 END AS "precision",
   CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0e0 END AS recall,
   critical_error / nullif(critical_frames, 0) AS mae_critical,
   inverse_error / nullif(frames, 0) AS inverse_mae
  FROM ({sums_sql}) s0) s1) s2"""


def score(source: str, keys: str, p="predicted_ttc", t="truth_ttc") -> str:
    k = keys + ", " if keys else ""
    g = f" GROUP BY {keys}" if keys else ""
    return scores(f"SELECT {k}{sums(p, t)} FROM {source}{g}", keys)


SCORE_DOUBLES = 'precision recall f1 mae_critical inverse_mae composite'
SCORE_INTS = ('frames', 'tp', 'fp', 'fn', 'tn', 'critical_frames')

UNION = """(SELECT trip_id, frame_id, t_sec, min_ttc AS truth_ttc, classical_ttc, detector_ttc,
  CASE WHEN detector_ttc < 2 AND NOT classical_ttc < 2 THEN detector_ttc ELSE classical_ttc END AS predicted_ttc,
  CASE WHEN detector_ttc < 2 AND NOT classical_ttc < 2 THEN 'detector' ELSE 'classical' END AS union_source
  FROM predictions)"""

VARIANTS = """(SELECT trip_id, frame_id, min_ttc AS truth_ttc, variant, predicted_ttc FROM (
  SELECT trip_id, frame_id, min_ttc, 'classical' AS variant, classical_ttc AS predicted_ttc FROM predictions
  UNION ALL SELECT trip_id, frame_id, min_ttc, 'detector', detector_ttc FROM predictions
  UNION ALL SELECT trip_id, frame_id, min_ttc, 'union', CASE WHEN detector_ttc < 2 AND NOT classical_ttc < 2
    THEN detector_ttc ELSE classical_ttc END FROM predictions) v)"""

LATERAL = "CAST(floor({f} / 64) AS BIGINT)"
BOX = """(SELECT *,
  greatest(0, floor(center_x * 640) - floor(greatest(5, floor(width * 640)) / 2)) AS x0,
  greatest(0, floor(bottom_y * 360) - greatest(5, floor(height * 360))) AS y0,
  least(640, floor(center_x * 640) + floor(greatest(5, floor(width * 640)) / 2)) AS x1,
  least(360, floor(bottom_y * 360)) AS y1
  FROM candidates)"""

# selected component of a frame: the most confident detection
COMPONENT = """(SELECT trip_id, frame_id, x0, y0, x1, y1, confidence FROM (SELECT *, row_number() OVER (PARTITION BY trip_id, frame_id
  ORDER BY confidence DESC, ordinal) AS rn FROM detections) WHERE rn = 1)"""
EVIDENCE = f"""(SELECT u.trip_id, u.frame_id, u.t_sec, u.truth_ttc, u.predicted_ttc, u.union_source, u.classical_ttc, u.detector_ttc,
  f.speed_mps, f.lateral_accel, c.x0 AS ex0, c.y0 AS ey0, c.x1 AS ex1, c.y1 AS ey1
  FROM {UNION} u JOIN frames f ON f.trip_id = u.trip_id AND f.frame_id = u.frame_id
  LEFT JOIN {COMPONENT} c ON c.trip_id = u.trip_id AND c.frame_id = u.frame_id)"""
DANGER = "(union_source LIKE 'classical%' AND predicted_ttc < 2)"

# one measurement per (trip, track, frame)
OBS = f"""(SELECT b.trip_id, b.frame_id, b.track_id, b.ordinal, b.depth_m, (x0 + x1) / 2 AS centre_x, (x1 - x0) * (y1 - y0) AS area, 5e-1 + residual_m AS sigma_m,
  ((x0 + x1) / 2 - 320) * depth_m / 500 AS lateral_m, candidate_ttc AS ttc, confidence, closing_mps, x0, y0, x1, y1, f.t_sec, f.speed_mps, f.lateral_accel, f.min_ttc AS truth_ttc
  FROM (SELECT *, row_number() OVER (PARTITION BY trip_id, frame_id, track_id ORDER BY ordinal) AS first FROM {BOX}) b
  JOIN frames f ON f.trip_id = b.trip_id AND f.frame_id = b.frame_id WHERE b.first = 1)"""


def recent_rows(src: str, n: int, keys: str, cols: str) -> str:
    """CTE o: rows numbered by key (rn), each with the list ``win`` of its last n rows as structs ``cols``."""
    over = f"OVER (PARTITION BY {keys} ORDER BY frame_id"
    return f"""o AS (SELECT *, row_number() {over}) AS rn, list({{{cols}}}) {over} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS win FROM {src})"""


def each(expr: str, rows: str = "win") -> str:
    """List of ``expr`` over the structs q of ``rows``."""
    return f"list_transform({rows}, lambda q: {expr})"


def mid(rows: str) -> str:
    return f"list_aggregate({rows}, 'median')"


def total(expr: str, rows: str = "win") -> str:
    return f"list_sum({each(expr, rows)})"


def slopes() -> str:
    """CTEs on o: sl (median slope of all pairs), ic (median intercept, count n, span), rs (median residual)."""
    pairs = """flatten(list_transform(generate_series(1, len(win) - 1), lambda i: list_transform(generate_series(i + 1, len(win)), lambda j:
  CASE WHEN win[j].t > win[i].t THEN (win[j].v - win[i].v) / (win[j].t - win[i].t) END)))"""
    return f"""sl AS (SELECT *, {mid(pairs)} AS slope FROM o),
 ic AS (SELECT *, {mid(each('q.v - slope * q.t'))} AS intercept, len(win) AS n, win[len(win)].t - win[1].t AS span FROM sl),
 rs AS (SELECT *, {mid(each('abs(q.v - (slope * q.t + intercept))'))} AS residual FROM ic)"""


def kalman(src: str) -> str:
    """CTEs ko (numbered rows of ``src``, which has t_sec, depth_m, sigma_m) and k (filter state after each row)."""
    return f"""ko AS (SELECT *, row_number() OVER (PARTITION BY trip_id, track_id ORDER BY frame_id) AS rn, least(greatest(sigma_m, 15e-2), 12) ** 2 AS r FROM {src}),
 k AS (SELECT trip_id, track_id, rn, t_sec AS t, CAST(depth_m AS DOUBLE) AS x, 0e0 AS v, r AS pxx, 0e0 AS pxv, 16e0 AS pvv, 0e0 AS ema, 1 AS n FROM ko WHERE rn = 1
  UNION ALL
  SELECT trip_id, track_id, rn, t, CASE WHEN fresh THEN z ELSE x + pxx / (pxx + r) * (z - x) END, CASE WHEN fresh THEN 0e0 ELSE v + pxv / (pxx + r) * (z - x) END,
   CASE WHEN fresh THEN r ELSE pxx - pxx / (pxx + r) * pxx END, CASE WHEN fresh THEN 0e0 ELSE pxv - pxx / (pxx + r) * pxv END, CASE WHEN fresh THEN 16e0 ELSE pvv - pxv / (pxx + r) * pxv END,
   CASE WHEN fresh THEN 0e0 WHEN n > 1 THEN 75e-2 * ema + 25e-2 * abs(z - x) ELSE abs(z - x) END, CASE WHEN fresh THEN 1 ELSE n + 1 END
  FROM (SELECT o.trip_id, o.track_id, o.rn, o.t_sec AS t, CAST(o.depth_m AS DOUBLE) AS z, o.r, NOT (o.t_sec - k.t > 0 AND o.t_sec - k.t <= 5e-1) AS fresh, k.x + (o.t_sec - k.t) * k.v AS x, k.v,
    k.pxx + (o.t_sec - k.t) * (2 * k.pxv + (o.t_sec - k.t) * k.pvv) + 625e-2 * (o.t_sec - k.t) ** 4 AS pxx, k.pxv + (o.t_sec - k.t) * k.pvv + 125e-1 * (o.t_sec - k.t) ** 3 AS pxv, k.pvv + 25 * (o.t_sec - k.t) ** 2 AS pvv, k.ema, k.n
   FROM k JOIN ko o ON o.trip_id = k.trip_id AND o.track_id = k.track_id AND o.rn = k.rn + 1) q)"""


# measurements with the evidence of a track; the texts stand in both engines
EVIDENCE_OF = {
    "quality": "confidence", "depth_mad_m": "sigma_m / 4", "lr_support": "(frame_id % 5) / 5e0", "corridor_overlap": "(track_id % 4) / 4e0",
    "depth_confidence": "((frame_id + track_id) % 6) / 5e0", "matched": "(frame_id * 7 + track_id) % 3 = 0", "det_confidence": "confidence"}
_SIGMA = "least(greatest(greatest(15e-2, depth_mad_m) * (135e-2 - 55e-2 * lr_support) / sqrt(greatest(15e-2, depth_confidence)), 15e-2), 12e0)"
MEASURED = f"""(SELECT * EXCLUDE (sigma_m), {_SIGMA} AS depth_sigma_m, {_SIGMA} AS sigma_m FROM (SELECT *, {', '.join(f'{e} AS {n}' for n, e in EVIDENCE_OF.items())} FROM {OBS}))"""


def remembered(src: str = MEASURED) -> str:
    """CTEs rs (robust motion with history) on ``src``, as slopes() gives them over eleven rows."""
    return recent_rows(src, 11, "trip_id, track_id", "'t': t_sec, 'v': depth_m, 'x': centre_x, 's': depth_sigma_m, 'q': quality, 'c': depth_confidence") + ", " + slopes()


FEATURE_OF = {
    "hits": "(frame_id + ordinal) % 9", "history": "least(11, (frame_id + ordinal) % 13)", "quality": "confidence / 2", "mad_ratio": "residual_m / depth_m",
    "lr_support": "(track_id % 5) / 5e0", "corridor": "(frame_id % 4) / 4e0"}
_EXT = [("min", "ttc", 99), ("min", "depth", 99), ("max", "closing", 0), ("min", "residual", 20), *[("max", x, 0) for x in ("confidence", "bottom", "width", "height", "hits", "history", "quality")],
        ("min", "mad_ratio", 10), ("max", "lr_support", 0), ("max", "corridor", 0)]
_URG = {"ttc": 99, "depth": 99, "closing": 0, "residual": 20, "confidence": 0, "offset": 1, "bottom": 0, "width": 0, "height": 0,
        "hits": 0, "history": 0, "quality": 0, "mad_ratio": 10, "lr_support": 0, "corridor": 0}
FEATURE_NAMES = ["candidates", "finite_candidates", *[f"{f}_{x}" for f, x, _ in _EXT], *[f"urgent_{x}" for x in _URG]]
FEATURES = f"""(SELECT f.trip_id, f.frame_id, f.min_ttc AS truth_ttc, coalesce(n, 0) AS candidates, coalesce(nf, 0) AS finite_candidates, {', '.join(f'coalesce(a.{f}_{x}, {d}) AS {f}_{x}' for f, x, d in _EXT)},
 {', '.join(f'coalesce(a.urgent_{x}, {d}) AS urgent_{x}' for x, d in _URG.items())} FROM frames f LEFT JOIN
 (SELECT trip_id, frame_id, count(*) AS n, count(*) FILTER (WHERE ttc < 99) AS nf, {', '.join(f'{f}({x}) AS {f}_{x}' for f, x, _ in _EXT)}, {', '.join(f'arg_min("{x}", (ttc, ordinal)) AS urgent_{x}' for x in _URG)}
  FROM (SELECT trip_id, frame_id, ordinal, CASE WHEN isfinite(candidate_ttc) THEN candidate_ttc ELSE 99 END AS ttc, least(greatest(depth_m, 0), 99) AS depth, least(greatest(closing_mps, -200), 200) AS closing,
   least(greatest(residual_m, 0), 20) AS residual, confidence, abs(center_x - 5e-1) AS "offset", bottom_y AS bottom, width, height, {', '.join(f'{e} AS {n}' for n, e in FEATURE_OF.items() if n != 'mad_ratio')}, least(greatest({FEATURE_OF['mad_ratio']}, 0), 10) AS mad_ratio FROM candidates)
  GROUP BY trip_id, frame_id) a ON a.trip_id = f.trip_id AND a.frame_id = f.frame_id)"""
