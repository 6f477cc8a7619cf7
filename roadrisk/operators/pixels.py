"""Statistics over disparity and depth pixels.

A pixel table has ``keys`` (the image), row_no, col_no and a value. Groups are at most one
image (height x width pixels), so exact percentiles per image stay small; anything above
the image level is computed from per-image rows.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F, types as T

from roadrisk.constants import DEPTH_SENTINEL_M, MAX_DEPTH_M, MIN_DEPTH_M
from roadrisk.functions.geometry import disparity_to_depth
from roadrisk.functions.ttc import is_finite
from roadrisk.operators.quantiles import exact_quantiles


def _share(part, whole):
    return F.try_divide(part, whole)


def depth_quality(pixels: DataFrame, image=("trip_id", "frame_id"), unit=("trip_id",), value="depth_m") -> DataFrame:
    """Ratios of zero, sentinel, non-finite and valid pixels per trip; blank images; ranges."""
    v = F.col(value)
    fin = F.coalesce(is_finite(value), F.lit(False))
    ok = fin & (v > 0) & (v < DEPTH_SENTINEL_M)
    f = pixels.groupBy(*image).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(v == 0).alias("zero"),
        F.count_if(F.coalesce(v >= DEPTH_SENTINEL_M, F.lit(False)) & ~F.isnan(v)).alias("far"),
        F.count_if(~fin).alias("odd"), F.count_if(ok).alias("ok"), F.percentile(F.when(ok, v), F.lit(0.5)).alias("med"),
        F.min(F.when(ok, v)).alias("lo"), F.max(F.when(ok, v)).alias("hi"))
    n = F.sum("n")
    t = f.groupBy(*unit).agg(
        F.count(F.lit(1)).alias("images"), F.count_if(F.col("zero") == F.col("n")).alias("all_zero"),
        F.count_if(F.col("far") == F.col("n")).alias("all_sentinel"), (F.sum("zero") / n).alias("zero_ratio"),
        (F.sum("far") / n).alias("sentinel_ratio"), (F.sum("odd") / n).alias("nonfinite_ratio"),
        (F.sum("ok") / n).alias("valid_ratio"), F.min("lo").alias("valid_min"), F.max("hi").alias("valid_max"))
    return t.join(exact_quantiles(f, list(unit), "med", {"median_of_medians": 0.5}), list(unit), "left")


def in_roi(bounds, height, width) -> Column:
    """Fractional bounds (x0, x1, y0, y1) as a row and column test."""
    x0, x1, y0, y1 = bounds
    return (
        (F.col("col_no") >= int(width * x0)) & (F.col("col_no") < int(width * x1))
        & (F.col("row_no") >= int(height * y0)) & (F.col("row_no") < int(height * y1)))


# fixed values: the two regions of the single-region baselines
OFFICIAL_ROI = (0.35, 0.65, 0.50, 0.85)
CORRIDOR_ROI = (0.30, 0.70, 0.42, 0.75)


def roi_depth(pixels: DataFrame, keys, bounds, percentile: float, height, width, focal, baseline, min_valid=100) -> DataFrame:
    """Percentile (0..1) of depth in a region; NULL below ``min_valid`` valid pixels."""
    d = disparity_to_depth("disparity", focal, baseline)
    p = pixels.filter(in_roi(bounds, height, width)).withColumn("_d", d)
    return p.groupBy(*keys).agg(
        F.count("_d").alias("valid_pixels"),
        F.when(F.count("_d") >= min_valid, F.percentile("_d", F.lit(percentile))).alias("depth_m"))


def v_disparity(pixels: DataFrame, keys, width, bin_px=0.5, limit=96.0, margin=0.10) -> DataFrame:
    """Histogram of disparity per image row, side margins left out."""
    d = F.col("disparity")
    ok = is_finite("disparity") & (d > 0.5) & (d < limit)
    side = (F.col("col_no") >= int(width * margin)) & (F.col("col_no") < int(width * (1.0 - margin)))
    return pixels.filter(ok & side).groupBy(*keys, "row_no", F.floor(d / bin_px).alias("bin")).agg(
        F.count(F.lit(1)).alias("pixels"))


def row_modes(hist: DataFrame, keys, height, bin_px=0.5, start=0.48, min_count=12) -> DataFrame:
    """Most frequent bin of each row (the first on ties), from ``start`` of the height down."""
    top = F.min(F.struct((-F.col("pixels")).alias("n"), "bin"))
    m = hist.filter(F.col("row_no") >= int(height * start)).groupBy(*keys, "row_no").agg(top.alias("t"))
    return m.select(*keys, "row_no", ((F.col("t.bin") + 0.5) * bin_px).alias("disparity"), (-F.col("t.n")).alias("weight"),
                    F.col("t.bin").alias("bin")).filter((F.col("weight") >= min_count) & (F.col("bin") > 0)).drop("bin")


_FIT = ("core_slope", "core_intercept", "core_score", "slope", "intercept", "confidence", "median_residual_px")
_FIT_TYPE = T.StructType([T.StructField(n, T.DoubleType()) for n in _FIT] + [
    T.StructField("core_support", T.LongType()), T.StructField("support", T.LongType())])


def _line(x, y, w, tol, low, high, need, apart):
    """Best line through two anchors by weighted inliers, then three weighted refits."""
    empty = dict.fromkeys([f.name for f in _FIT_TYPE])
    if len(x) < need:
        return empty
    anchor = np.linspace(0, len(x) - 1, min(len(x), 48)).astype(int)
    i, j = (anchor[k] for k in np.triu_indices(len(anchor), 1))
    far = x[j] - x[i] >= apart
    i, j = i[far], j[far]
    a = (y[j] - y[i]) / (x[j] - x[i])
    good = (a >= low) & (a <= high)
    if not good.any():
        return empty
    a, b = a[good], (y[i] - a * x[i])[good]
    miss = np.abs(y - (a[:, None] * x + b[:, None]))
    near = miss <= tol
    score = ((w * near) - 0.25 * miss * w * near).sum(axis=1)
    score[near.sum(axis=1) < need] = -np.inf
    k = int(score.argmax())
    if not np.isfinite(score[k]):
        return empty
    out = empty | {"core_slope": a[k], "core_intercept": b[k], "core_score": score[k], "core_support": int(near[k].sum())}
    keep = near[k]
    for _ in range(3):
        ws = w[keep]
        mx, my = np.average(x[keep], weights=ws), np.average(y[keep], weights=ws)
        spread = (ws * (x[keep] - mx) ** 2).sum()
        slope = (ws * (x[keep] - mx) * (y[keep] - my)).sum() / spread if spread > 0 else np.nan
        if not low <= slope <= high:
            return out
        icpt = my - slope * mx
        res = np.abs(y - (slope * x + icpt))
        keep = res <= tol
        if keep.sum() < need:
            return out
    n, med = int(keep.sum()), float(np.median(res[keep]))
    conf = n / len(x) * min(1.0, n / max(1.0, 2.0 * need)) * float(np.exp(-med / tol))
    return out | {"slope": slope, "intercept": icpt, "confidence": conf, "median_residual_px": med, "support": n}


def fit_ground_line(modes: DataFrame, keys, tol=1.5, low=0.025, high=0.40, need=30, apart=24) -> DataFrame:
    """Ground line (disparity over row) of each image from its row modes.

    An image has at most one mode per row and 48 anchors, so each fit is small; images are
    spread over tasks.
    """
    @F.pandas_udf(_FIT_TYPE)
    def fit(x: pd.Series, y: pd.Series, w: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            [_line(np.asarray(a, float), np.asarray(b, float), np.maximum(np.asarray(c, float), 1.0),
                   tol, low, high, need, apart) for a, b, c in zip(x, y, w)],
            columns=[f.name for f in _FIT_TYPE]).astype({"core_support": "Int64", "support": "Int64"})

    rows = F.array_sort(F.collect_list(F.struct(F.col("row_no").cast("double").alias("x"), F.col("disparity").alias("y"),
                                                F.col("weight").cast("double").alias("w"))))
    g = modes.groupBy(*keys).agg(rows.alias("_m"), F.count(F.lit(1)).alias("total_rows"))
    return g.withColumn("_f", fit("_m.x", "_m.y", "_m.w")).select(*keys, "total_rows", "_f.*")


def ground_obstacle_masks(pixels: DataFrame, model: DataFrame, keys, height, tol=1.5, margin=1.0) -> DataFrame:
    """Pixels on the ground line and pixels clearly nearer than it, below 34 % of the height."""
    p = pixels.filter(F.col("row_no") >= height * 0.34).join(model.select(*keys, "slope", "intercept"), keys)
    line = F.col("slope") * F.col("row_no") + F.col("intercept")
    d = F.col("disparity")
    ok = is_finite("disparity") & (d > 0.5) & F.col("slope").isNotNull()
    return p.withColumns({
        "ground": F.coalesce(ok & (F.abs(d - line) <= tol), F.lit(False)),
        "obstacle": F.coalesce(ok & (d >= line + margin), F.lit(False))}).drop("slope", "intercept")


def component_stats(pixels: DataFrame, keys, height, width, focal, baseline, min_area=60, min_height=6) -> DataFrame:
    """Shape, depth and quality of labelled components. pixels: label > 0, disparity, evidence,
    lr_ok, corridor. Components outside the area and shape gates are left out."""
    k = [*keys, "label"]
    ev = F.col("evidence") & is_finite("disparity") & (F.col("disparity") > 0.5)
    d = F.when(ev, disparity_to_depth("disparity", focal, baseline))
    p = pixels.filter("label > 0").withColumns({"_d": d, "_seen": ev})
    s = p.groupBy(*k).agg(
        F.count(F.lit(1)).alias("area"), F.min("col_no").alias("x0"), (F.max("col_no") + 1).alias("x1"),
        F.min("row_no").alias("y0"), (F.max("row_no") + 1).alias("y1"), F.avg("col_no").alias("center_x"),
        F.avg("row_no").alias("center_y"), F.count_if("_seen").alias("seen"), F.count("_d").alias("depths"),
        F.percentile("_d", F.lit(0.50)).alias("depth_m"), F.percentile("_d", F.lit(0.20)).alias("depth_p20_m"),
        F.percentile("_d", F.lit(0.35)).alias("depth_p35_m"), F.count_if("evidence").alias("_ev"),
        F.count_if(F.col("evidence") & F.col("lr_ok")).alias("_lr"), F.count_if("corridor").alias("_in"))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    s = s.filter(
        (F.col("area") >= min_area) & (h >= min_height) & (w / h <= 6.0) & (w <= width * 0.75) & (h <= height * 0.75)
        & (F.col("seen") >= min_area // 2) & (F.col("depths") >= min_area // 2))
    mad = p.join(s.select(*k, F.col("depth_m").alias("_m")), k).groupBy(*k).agg(
        F.percentile(F.abs(F.col("_d") - F.col("_m")), F.lit(0.5)).alias("depth_mad_m"))
    s = s.join(mad, k)
    lr = F.col("_lr") / F.greatest(F.col("_ev"), F.lit(1))
    inside = F.col("_in") / F.col("area")
    density = F.least(F.lit(1.0), F.col("_ev") / F.col("area"))
    calm = F.exp(-F.col("depth_mad_m") / F.greatest(F.lit(1.0), F.col("depth_m") * 0.15))
    return s.withColumns({
        "lr_support": lr, "corridor_overlap": inside,
        "quality": 0.40 * density + 0.25 * lr + 0.20 * inside + 0.15 * calm}).drop("_ev", "_lr", "_in", "depths")


def lr_consistency(left: DataFrame, right: DataFrame, keys, width, tol=1.0) -> DataFrame:
    """Left pixels with the right pixel they point at: residual |dl + dr|, consistent if <= tol.

    Right disparities are negative; the right column is col - d, rounded half to even.
    """
    d = F.col("disparity")
    valid = F.coalesce(is_finite("disparity") & (d > 0.5), F.lit(False))
    l = left.withColumn("valid", valid).withColumn("_x", F.when(F.col("valid"), F.bround(F.col("col_no") - d, 0).cast("bigint")))
    r = right.filter(is_finite("disparity") & (F.col("disparity") < -0.5)).select(
        *keys, "row_no", F.col("col_no").alias("_x"), F.col("disparity").alias("_r"))
    j = l.join(r, [*keys, "row_no", "_x"], "left")
    j = j.withColumn("residual", F.when(F.col("_x").between(0, width - 1), F.abs(d + F.col("_r"))))
    return j.withColumn("consistent", F.coalesce(F.col("residual") <= tol, F.lit(False))).drop("_x", "_r")


def disparity_parity(ref: DataFrame, cand: DataFrame, keys) -> DataFrame:
    """Error of a second disparity map on pixels valid in both, and coverage changes, per image."""
    k = [*keys, "row_no", "col_no"]
    j = ref.select(*k, F.col("disparity").alias("_a"), F.col("valid").alias("_va")).join(
        cand.select(*k, F.col("disparity").alias("_b"), F.col("valid").alias("_vb")), k, "full_outer")
    va, vb = F.coalesce("_va", F.lit(False)), F.coalesce("_vb", F.lit(False))
    e = F.when(va & vb, F.abs(F.col("_a") - F.col("_b")))
    n = F.count(e)
    return j.groupBy(*keys).agg(
        n.alias("compared_pixels"), F.avg(e).alias("mean_error_px"), F.percentile(e, F.lit(0.95)).alias("p95_error_px"),
        F.max(e).alias("max_error_px"), _share(F.count_if(e > 1.0), n).alias("bad_1px"),
        _share(F.count_if(e > 3.0), n).alias("bad_3px"),
        (F.count_if(va & ~vb) / F.greatest(F.count_if(va), F.lit(1))).alias("missing_fraction"),
        (F.count_if(vb & ~va) / F.greatest(F.count("_va"), F.lit(1))).alias("added_fraction"))


def depth_abs_rel(est: DataFrame, ref: DataFrame, keys) -> DataFrame:
    """Median relative depth error per image. est and ref: keys, row_no, col_no, depth_m."""
    k = [*keys, "row_no", "col_no"]
    j = est.select(*k, F.col("depth_m").alias("_e")).join(ref.select(*k, F.col("depth_m").alias("_t")), k)
    ok = is_finite("_e") & is_finite("_t") & F.col("_t").between(MIN_DEPTH_M, MAX_DEPTH_M)
    e = F.when(ok, F.abs(F.col("_e") - F.col("_t")) / F.col("_t"))
    return j.groupBy(*keys).agg(F.count(e).alias("pixels"), F.percentile(e, F.lit(0.5)).alias("abs_rel"))


def stereo_frame_metrics(lr: DataFrame, keys, height, width, focal, baseline, roi=OFFICIAL_ROI) -> DataFrame:
    """Valid and consistent fractions, region medians and residuals from ``lr_consistency``."""
    d, inside = disparity_to_depth("disparity", focal, baseline), in_roi(roi, height, width)
    p = lr.withColumns({"_d": d, "_in": inside})
    n, v, c = F.count(F.lit(1)), F.count_if("valid"), F.count_if("consistent")
    iv, ic = F.count_if(F.col("_in") & F.col("valid")), F.count_if(F.col("_in") & F.col("consistent"))

    def pct(col, q):
        return F.percentile(col, F.lit(q))
    return p.groupBy(*keys).agg(
        (v / n).alias("valid_fraction"), (c / n).alias("consistent_fraction"), _share(c, v).alias("consistent_of_valid"),
        _share(iv, F.count_if("_in")).alias("roi_valid_fraction"), _share(ic, iv).alias("roi_consistent_of_valid"),
        pct(F.when(F.col("_in"), F.col("_d")), 0.5).alias("roi_depth_median_m"),
        pct(F.when(F.col("_in") & F.col("consistent"), F.col("_d")), 0.5).alias("roi_consistent_depth_median_m"),
        pct(F.when(F.col("_in"), F.col("residual")), 0.5).alias("roi_residual_median_px"),
        pct(F.when(F.col("_in"), F.col("residual")), 0.95).alias("roi_residual_p95_px"))


def backend_geometry_diff(ref: DataFrame, cand: DataFrame, keys, top=12) -> DataFrame:
    """Images whose second disparity map differs most: quantiles of both and the median ratio."""
    def side(df, p):
        d = F.when(F.col("valid") & (F.col("disparity") > 0.5), F.col("disparity"))
        return df.groupBy(*keys).agg(
            (F.count(d) / F.count(F.lit(1))).alias(f"{p}_valid_fraction"),
            *[F.percentile(d, F.lit(q)).alias(f"{p}_{n}_px") for n, q in (("p10", 0.1), ("median", 0.5), ("p90", 0.9))])
    k = [*keys, "row_no", "col_no"]
    both = ref.filter("valid").select(*k, F.col("disparity").alias("_a")).join(
        cand.filter("valid").select(*k, F.col("disparity").alias("_b")), k)
    ratio = both.groupBy(*keys).agg(F.try_divide(F.percentile("_b", F.lit(0.5)), F.percentile("_a", F.lit(0.5))).alias("median_ratio"))
    j = side(ref, "ref").join(side(cand, "cand"), keys).join(ratio, keys, "left")
    return j.orderBy(F.desc(F.round(F.col("cand_valid_fraction") - F.col("ref_valid_fraction"), 9)), *keys).limit(top)


def object_depth(pixels: DataFrame, boxes: DataFrame, keys, focal, baseline, bin_px=0.5, limit=96.0) -> DataFrame:
    """Depth of each box from the nearer of its (at most two) main disparity modes.

    pixels: keys, row_no, col_no, disparity, evidence, lr_ok. boxes: keys, box_id, x0, y0, x1, y1
    (whole pixels). A pixel meets only the boxes of its image; all later steps are histograms
    and aggregates per box. Boxes without enough support are left out.
    """
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    kw = F.least(w, F.greatest(F.lit(3), F.bround(w * 0.64, 0)))
    kh = F.least(h, F.greatest(F.lit(3), F.bround(h * 0.76, 0)))
    left, top = F.col("x0") + F.floor((w - kw) / 2), F.col("y0") + F.greatest(F.lit(0), F.bround(h * 0.10, 0))
    b = boxes.filter((w >= 3) & (h >= 3)).select(
        *keys, "box_id", left.alias("_l"), (left + kw).alias("_r"), top.alias("_t"),
        F.least(F.col("y1"), top + kh).alias("_b"), F.greatest(F.lit(18), F.floor(0.03 * kw * kh)).alias("_need"))
    # rows of the core are listed, so the join is an equi-join on (image, row)
    b = b.withColumn("row_no", F.explode(F.sequence(F.col("_t").cast("bigint"), F.col("_b").cast("bigint") - 1)))
    d = F.col("disparity")
    p = pixels.filter(F.col("evidence") & is_finite("disparity") & (d > 0.5) & (d < limit)).join(
        b, [*keys, "row_no"]).filter((F.col("col_no") >= F.col("_l")) & (F.col("col_no") < F.col("_r")))
    k = [*keys, "box_id"]
    p = p.select(*k, "disparity", "lr_ok", "_need")
    # smoothed histogram: each pixel adds a half to its bin and a quarter to both neighbours
    last = int(np.ceil(limit / bin_px)) - 1
    near = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.lit(x).alias("x")) for o, x in ((-1, .25), (0, .5), (1, .25))]))
    hist = p.groupBy(*k, F.floor(d / bin_px).alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn("_s", near)
    hist = hist.groupBy(*k, (F.col("bin") + F.col("_s.o")).alias("bin")).agg(F.sum(F.col("n") * F.col("_s.x")).alias("v"))
    hist = hist.filter(F.col("bin").between(0, last))
    seq = Window.partitionBy(*k).orderBy("bin")  # at most limit / bin_px rows per box
    before = F.when(F.lag("bin").over(seq) == F.col("bin") - 1, F.lag("v").over(seq)).otherwise(0.0)
    after = F.when(F.lead("bin").over(seq) == F.col("bin") + 1, F.lead("v").over(seq)).otherwise(0.0)
    most = F.max("v").over(Window.partitionBy(*k))
    peaks = hist.withColumns({"_p": before, "_n": after, "_m": most}).filter(
        (F.col("v") >= F.col("_p")) & (F.col("v") >= F.col("_n")) & (F.col("bin") > 0) & (F.col("bin") < last)
        & (F.col("v") >= F.greatest(F.lit(4.0), 0.18 * F.col("_m"))))
    apart = max(2, round(2.0 / bin_px))
    first = peaks.groupBy(*k).agg(F.max(F.struct("v", "bin")).alias("a"))
    second = peaks.join(first, k).filter(F.abs(F.col("bin") - F.col("a.bin")) >= apart).groupBy(*k).agg(
        F.max(F.struct("v", "bin")).alias("b"))
    mode = first.join(second, k, "left").select(
        *k, F.greatest(F.col("a.bin"), F.coalesce("b.bin", F.lit(-1))).alias("_bin"),
        F.when(F.col("b").isNull(), 1).otherwise(2).alias("mode_count"))
    q = p.join(mode, k)
    hit = F.abs(d - (F.col("_bin") + 0.5) * bin_px) <= 1.25
    q = q.withColumn("_d", F.when(hit, disparity_to_depth("disparity", focal, baseline))).withColumn("_hit", hit)
    s = q.groupBy(*k, "mode_count", "_need").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("_hit").alias("_h"), F.count("_d").alias("_k"), F.count_if("lr_ok").alias("_lr"),
        F.percentile("_d", F.lit(0.5)).alias("depth_m"))
    s = s.filter((F.col("_n") >= F.col("_need")) & (F.col("_h") >= F.floor(F.col("_need") / 2)) & (F.col("_k") >= F.floor(F.col("_need") / 2)))
    mad = q.join(s.select(*k, "depth_m"), k).groupBy(*k).agg(
        F.percentile(F.abs(F.col("_d") - F.col("depth_m")), F.lit(0.5)).alias("depth_mad_m"))
    s = s.join(mad, k)
    calm = F.exp(-F.col("depth_mad_m") / F.greatest(F.lit(0.25), F.col("depth_m") * 0.08))
    conf = 0.45 * F.col("_h") / F.col("_n") + 0.30 * F.col("_lr") / F.col("_n") + 0.25 * calm
    return s.select(*k, "depth_m", "depth_mad_m", F.least(F.lit(1.0), F.greatest(F.lit(0.0), conf)).alias("confidence"), "mode_count")
