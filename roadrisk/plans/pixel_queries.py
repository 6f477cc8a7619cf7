"""Queries over pixel tables (images of 50 x 64 pixels)."""
from pyspark.sql import functions as F

from roadrisk.operators import pixels as X
from roadrisk.plans.registry import query

K, H, W, FOCAL, BASE = ["frame_id"], 50, 64, 100.0, 0.3
DEPTH = "CASE WHEN disparity > 5e-1 AND 30 / disparity BETWEEN 15e-1 AND 80 THEN 30 / disparity END"
ROI = f"col_no >= {int(W * .35)} AND col_no < {int(W * .65)} AND row_no >= {int(H * .5)} AND row_no < {int(H * .85)}"


@query("depth_quality", """WITH p AS (SELECT frame_id % 2 AS unit, frame_id, CASE WHEN disparity < 1 THEN 0 WHEN disparity > 20 THEN 999 ELSE disparity END AS v FROM pixels),
 f AS (SELECT unit, frame_id, count(*) AS n, count(*) FILTER (WHERE v = 0) AS z, count(*) FILTER (WHERE v >= 999) AS far, count(*) FILTER (WHERE v > 0 AND v < 999) AS ok, median(CASE WHEN v > 0 AND v < 999 THEN v END) AS med,
  min(CASE WHEN v > 0 AND v < 999 THEN v END) AS lo, max(CASE WHEN v > 0 AND v < 999 THEN v END) AS hi FROM p GROUP BY unit, frame_id)
SELECT_FINAL unit, count(*) AS images, count(*) FILTER (WHERE z = n) AS all_zero, count(*) FILTER (WHERE far = n) AS all_sentinel, sum(z) / sum(n) AS zero_ratio, sum(far) / sum(n) AS sentinel_ratio, 0e0 AS nonfinite_ratio,
 sum(ok) / sum(n) AS valid_ratio, min(lo) AS valid_min, max(hi) AS valid_max, median(med) AS median_of_medians FROM f GROUP BY unit""",
       "zero_ratio sentinel_ratio nonfinite_ratio valid_ratio valid_min valid_max median_of_medians")
def _(t):
    v = F.when(F.col("disparity") < 1, 0.0).when(F.col("disparity") > 20, 999.0).otherwise(F.col("disparity"))
    p = t.pixels.select((F.col("frame_id") % 2).alias("unit"), "frame_id", v.alias("depth_m"))
    return X.depth_quality(p, ("unit", "frame_id"), ("unit",))


@query("roi_depth", f"SELECT frame_id, count(d) AS valid_pixels, CASE WHEN count(d) >= 100 THEN quantile_cont(d, 35e-2) END AS depth_m FROM (SELECT frame_id, {DEPTH} AS d FROM pixels WHERE {ROI}) GROUP BY frame_id", "depth_m")
def _(t):
    return X.roi_depth(t.pixels, K, X.OFFICIAL_ROI, 0.35, H, W, FOCAL, BASE)


HIST = f"""(SELECT frame_id, row_no, CAST(floor(disparity / 5e-1) AS BIGINT) AS bin, count(*) AS pixels FROM (SELECT * FROM pixels) WHERE disparity > 5e-1 AND disparity < 96 AND col_no >= {int(W * .1)} AND col_no < {int(W * .9)} GROUP BY ALL)""".replace(
    "FROM (SELECT * FROM pixels)", "FROM pixels").replace("count(*) AS pixels", "count(*) AS n_pixels")


@query("v_disparity", f"SELECT frame_id, row_no, bin, n_pixels AS pixels FROM {HIST}")
def _(t):
    return X.v_disparity(t.pixels, K, W)


MODES = f"""(SELECT frame_id, row_no, (bin + 5e-1) * 5e-1 AS disparity, n_pixels AS weight FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, row_no ORDER BY n_pixels DESC, bin) AS rn FROM {HIST} WHERE row_no >= {int(H * .48)}) WHERE rn = 1 AND n_pixels >= 2 AND bin > 0)"""


def modes(t):
    return X.row_modes(X.v_disparity(t.pixels, K, W), K, H, min_count=2)


@query("row_modes", f"SELECT * FROM {MODES}", "disparity")
def _(t):
    return modes(t)


# thresholds that suit 50-row images
LINE = dict(low=-0.4, need=4, apart=4)


@query("ground_line_core", f"""WITH m AS (SELECT * FROM {MODES}),
 c AS (SELECT a.frame_id, a.row_no AS r1, b.row_no AS r2, (b.disparity - a.disparity) / (b.row_no - a.row_no) AS s, a.disparity - (b.disparity - a.disparity) / (b.row_no - a.row_no) * a.row_no AS i FROM m a JOIN m b ON b.frame_id = a.frame_id AND b.row_no - a.row_no >= 4),
 sc AS (SELECT c.frame_id, r1, r2, s, i, count(*) AS support, sum(weight - 25e-2 * abs(disparity - (s * row_no + i)) * weight) AS score FROM c JOIN m ON m.frame_id = c.frame_id AND abs(disparity - (s * row_no + i)) <= 15e-1 WHERE s BETWEEN -4e-1 AND 4e-1 GROUP BY ALL)
SELECT_FINAL frame_id, max(score) AS core_score FROM sc WHERE support >= 4 GROUP BY frame_id""", "core_score")
def _(t):
    return X.fit_ground_line(modes(t), K, **LINE).select("frame_id", "core_score").filter("core_score is not null")


@query("fit_ground_line")
def _(t):
    return X.fit_ground_line(modes(t), K, **LINE)


@query("ground_obstacle_masks", f"""WITH l AS (SELECT frame_id, regr_slope(disparity, row_no) AS s, regr_intercept(disparity, row_no) AS i FROM {MODES} GROUP BY frame_id)
SELECT_FINAL p.frame_id, row_no, col_no, disparity > 5e-1 AND abs(disparity - (s * row_no + i)) <= 15e-1 AS ground, disparity > 5e-1 AND disparity >= s * row_no + i + 1 AS obstacle
FROM pixels p JOIN l ON l.frame_id = p.frame_id WHERE row_no >= 17""")
def _(t):
    model = modes(t).groupBy("frame_id").agg(F.regr_slope("disparity", "row_no").alias("slope"), F.regr_intercept("disparity", "row_no").alias("intercept"))
    return X.ground_obstacle_masks(t.pixels, model, K, H).select("frame_id", "row_no", "col_no", "ground", "obstacle")


LAB = "(SELECT *, CASE WHEN label IS NULL THEN 0 ELSE row_no // 10 * 4 + col_no // 16 + 1 END AS lab, disparity > 2 AS evidence, (row_no + col_no) % 3 <> 0 AS lr_ok, abs(col_no - 32) < 14 AS corridor FROM pixels)"


def labelled(t):
    # components stand in as 10 x 16 tiles of the image
    tile = F.floor(F.col("row_no") / 10) * 4 + F.floor(F.col("col_no") / 16) + 1
    return t.pixels.select("frame_id", "row_no", "col_no", "disparity", tile.alias("label"), (F.col("disparity") > 2).alias("evidence"),
                           ((F.col("row_no") + F.col("col_no")) % 3 != 0).alias("lr_ok"), (F.abs(F.col("col_no") - 32) < 14).alias("corridor"))


@query("component_stats", f"""WITH p AS (SELECT *, CASE WHEN evidence THEN {DEPTH} END AS d FROM {LAB}),
 m AS (SELECT *, median(d) OVER (PARTITION BY frame_id, lab) AS med FROM p),
 s AS (SELECT frame_id, lab AS label, count(*) AS area, min(col_no) AS x0, max(col_no) + 1 AS x1, min(row_no) AS y0, max(row_no) + 1 AS y1, avg(col_no) AS center_x, avg(row_no) AS center_y, count(*) FILTER (WHERE evidence) AS seen, count(d) AS nd,
  median(d) AS depth_m, quantile_cont(d, 2e-1) AS depth_p20_m, quantile_cont(d, 35e-2) AS depth_p35_m, median(abs(d - med)) AS depth_mad_m, count(*) FILTER (WHERE evidence AND lr_ok) / greatest(count(*) FILTER (WHERE evidence), 1) AS lr_support,
  count(*) FILTER (WHERE corridor) / count(*) AS corridor_overlap FROM m GROUP BY frame_id, lab)
SELECT_FINAL * EXCLUDE (nd), 4e-1 * least(1, seen / area) + 25e-2 * lr_support + 2e-1 * corridor_overlap + 15e-2 * exp(-depth_mad_m / greatest(1, depth_m * 15e-2)) AS quality FROM s WHERE area >= 60 AND y1 - y0 >= 6 AND seen >= 30 AND nd >= 30""",
       "center_x center_y depth_m depth_p20_m depth_p35_m depth_mad_m lr_support corridor_overlap quality")
def _(t):
    return X.component_stats(labelled(t), K, H, W, FOCAL, BASE)


LR = f"""(SELECT l.*, CASE WHEN rx BETWEEN 0 AND {W - 1} THEN abs(disparity + r.d) END AS residual, coalesce(rx BETWEEN 0 AND {W - 1} AND abs(disparity + r.d) <= 1, false) AS consistent
 FROM (SELECT *, disparity > 5e-1 AS valid, CASE WHEN disparity > 5e-1 THEN CAST(round_even(col_no - disparity, 0) AS BIGINT) END AS rx FROM pixels) l
 LEFT JOIN (SELECT frame_id AS f, row_no AS rr, col_no AS rc, -9e-1 * disparity AS d FROM pixels WHERE -9e-1 * disparity < -5e-1) r ON r.f = l.frame_id AND r.rr = l.row_no AND r.rc = l.rx)"""


def lr(t):
    right = t.pixels.select("frame_id", "row_no", "col_no", (-0.9 * F.col("disparity")).alias("disparity"))
    return X.lr_consistency(t.pixels.drop("label"), right, K, W)


@query("lr_consistency", f"SELECT frame_id, row_no, col_no, valid, residual, consistent FROM {LR}", "residual")
def _(t):
    return lr(t).select("frame_id", "row_no", "col_no", "valid", "residual", "consistent")


@query("stereo_frame_metrics", f"""SELECT frame_id, count(*) FILTER (WHERE valid) / count(*) AS valid_fraction, count(*) FILTER (WHERE consistent) / count(*) AS consistent_fraction, count(*) FILTER (WHERE consistent) / count(*) FILTER (WHERE valid) AS consistent_of_valid,
 count(*) FILTER (WHERE roi AND valid) / count(*) FILTER (WHERE roi) AS roi_valid_fraction, count(*) FILTER (WHERE roi AND consistent) / nullif(count(*) FILTER (WHERE roi AND valid), 0) AS roi_consistent_of_valid,
 median(CASE WHEN roi THEN d END) AS roi_depth_median_m, median(CASE WHEN roi AND consistent THEN d END) AS roi_consistent_depth_median_m, median(CASE WHEN roi THEN residual END) AS roi_residual_median_px, quantile_cont(CASE WHEN roi THEN residual END, 95e-2) AS roi_residual_p95_px
FROM (SELECT *, {ROI} AS roi, {DEPTH} AS d FROM {LR}) GROUP BY frame_id""",
       "valid_fraction consistent_fraction consistent_of_valid roi_valid_fraction roi_consistent_of_valid roi_depth_median_m roi_consistent_depth_median_m roi_residual_median_px roi_residual_p95_px")
def _(t):
    return X.stereo_frame_metrics(lr(t), K, H, W, FOCAL, BASE)


REF = "(SELECT *, disparity > 1 AS valid FROM pixels)"
CAND = "(SELECT frame_id, row_no, col_no, disparity * (1 + (col_no % 7 - 3) / 5e0) AS disparity, disparity > 15e-1 OR col_no % 9 = 0 AS valid FROM pixels)"


def ref_cand(t):
    d = F.col("disparity")
    ref = t.pixels.select("frame_id", "row_no", "col_no", "disparity", (d > 1).alias("valid"))
    cand = t.pixels.select("frame_id", "row_no", "col_no", (d * (1 + (F.col("col_no") % 7 - 3) / 5.0)).alias("disparity"), ((d > 1.5) | (F.col("col_no") % 9 == 0)).alias("valid"))
    return ref, cand


BOTH = f"(SELECT a.frame_id, a.disparity AS da, b.disparity AS db, a.valid AS va, b.valid AS vb FROM {REF} a JOIN {CAND} b ON a.frame_id = b.frame_id AND a.row_no = b.row_no AND a.col_no = b.col_no)"


@query("disparity_parity", f"""SELECT frame_id, count(e) AS compared_pixels, avg(e) AS mean_error_px, quantile_cont(e, 95e-2) AS p95_error_px, max(e) AS max_error_px, count(*) FILTER (WHERE e > 1) / count(e) AS bad_1px, count(*) FILTER (WHERE e > 3) / count(e) AS bad_3px,
 count(*) FILTER (WHERE va AND NOT vb) / count(*) FILTER (WHERE va) AS missing_fraction, count(*) FILTER (WHERE vb AND NOT va) / count(*) AS added_fraction FROM (SELECT *, CASE WHEN va AND vb THEN abs(da - db) END AS e FROM {BOTH}) GROUP BY frame_id""",
       "mean_error_px p95_error_px max_error_px bad_1px bad_3px missing_fraction added_fraction")
def _(t):
    return X.disparity_parity(*ref_cand(t), K)


@query("depth_abs_rel", f"""SELECT frame_id, count(e) AS pixels, median(e) AS abs_rel FROM (SELECT frame_id, abs(da - db) / db AS e0, CASE WHEN da IS NOT NULL AND db BETWEEN 15e-1 AND 80 THEN abs(da - db) / db END AS e
 FROM (SELECT a.frame_id, {DEPTH.replace('disparity', 'a.disparity')} AS da, {DEPTH.replace('disparity', 'b.disparity')} AS db FROM {REF} a JOIN {CAND} b ON a.frame_id = b.frame_id AND a.row_no = b.row_no AND a.col_no = b.col_no)) GROUP BY frame_id""", "abs_rel")
def _(t):
    from roadrisk.functions.geometry import disparity_to_depth
    a, b = (x.withColumn("depth_m", disparity_to_depth("disparity", FOCAL, BASE)) for x in ref_cand(t))
    return X.depth_abs_rel(a, b, K)


def _side(src, p):
    d = "CASE WHEN valid AND disparity > 5e-1 THEN disparity END"
    return f"(SELECT frame_id, count({d}) / count(*) AS {p}_valid_fraction, quantile_cont({d}, 1e-1) AS {p}_p10_px, quantile_cont({d}, 5e-1) AS {p}_median_px, quantile_cont({d}, 9e-1) AS {p}_p90_px FROM {src} GROUP BY frame_id)"


@query("backend_geometry_diff", f"""SELECT a.*, b.* EXCLUDE (frame_id), m.median_ratio FROM {_side(REF, 'ref')} a JOIN {_side(CAND, 'cand')} b ON b.frame_id = a.frame_id
LEFT JOIN (SELECT frame_id, median(CASE WHEN va AND vb THEN db END) / median(CASE WHEN va AND vb THEN da END) AS median_ratio FROM {BOTH} GROUP BY frame_id) m ON m.frame_id = a.frame_id
ORDER BY round(cand_valid_fraction - ref_valid_fraction, 9) DESC, a.frame_id LIMIT 12""",
       "ref_valid_fraction ref_p10_px ref_median_px ref_p90_px cand_valid_fraction cand_p10_px cand_median_px cand_p90_px median_ratio")
def _(t):
    return X.backend_geometry_diff(*ref_cand(t), K)


@query("object_depth")
def _(t):
    p = labelled(t)
    b = p.groupBy("frame_id", F.col("label").alias("box_id")).agg(
        F.min("col_no").alias("x0"), F.min("row_no").alias("y0"), (F.max("col_no") + 1).alias("x1"), (F.max("row_no") + 1).alias("y1"))
    return X.object_depth(p, b, K, FOCAL, BASE)
