"""Closing motion from short causal windows of depth, position and box size."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F, types as T

from roadrisk.constants import INF, MIN_CLOSING_MPS
from roadrisk.functions.ttc import is_finite
from roadrisk.operators.lineage import cut, spread
from roadrisk.operators.quantiles import exact_quantiles
from roadrisk.operators.scan import affine, linear_filter, padded, ragged, scan
from roadrisk.operators.sequence import SEG, by_track, drop_halo, last_rows, previous, running_max, seg_window, segmented, with_position, with_position_halo


def median_of(a) -> Column:
    """Median of a short array of numbers; NULL for an empty one."""
    s = F.array_sort(a)
    n = F.size(s)
    lo, hi = ((n - 1) / 2).cast("int"), (n / 2).cast("int")
    return F.when(n > 0, (s[lo] + s[hi]) / 2.0)


_LINE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("slope", "intercept", "residual")])


@F.pandas_udf(_LINE)
def _theil_sen(t: pd.Series, v: pd.Series) -> pd.DataFrame:
    out = np.full((len(t), 3), np.nan)
    sizes = t.map(len).to_numpy()
    for n in np.unique(sizes[sizes > 1]):
        rows = np.flatnonzero(sizes == n)
        x, y = np.stack(t.iloc[rows].to_numpy()), np.stack(v.iloc[rows].to_numpy())
        i, j = np.triu_indices(n, k=1)
        run = x[:, j] - x[:, i]
        rise = y[:, j] - y[:, i]
        pairs = np.ma.masked_array(rise / np.where(run > 0, run, 1.0), mask=~(run > 0))
        slope = np.ma.median(pairs, axis=1).filled(np.nan)
        base = y - slope[:, None] * x
        intercept = np.median(base, axis=1)
        out[rows] = np.column_stack([slope, intercept, np.median(np.abs(base - intercept[:, None]), axis=1)])
    return pd.DataFrame(out, columns=["slope", "intercept", "residual"])


def line_of(t, v) -> Column:
    """``theil_sen`` of times and values in two arrays of doubles."""
    return _theil_sen(t, v)


def theil_sen(points) -> Column:
    """``struct<slope, intercept, residual>`` of an array of struct<t, v> (a short window).

    Median of pairwise slopes, median intercept, median absolute residual; NULLs without a
    pair of rising t. A whole batch of windows is solved at once: as nested higher-order
    functions Catalyst would inline the slopes into every later step.
    """
    points = F.col(points) if isinstance(points, str) else points
    return _theil_sen(F.transform(points, lambda q: q["t"].cast("double")),
                      F.transform(points, lambda q: q["v"].cast("double")))


def recent(df: DataFrame, keys, n: int, cols: dict[str, str], name="recent", following: dict[str, str] | None = None):
    """Add the array of the last ``n`` rows by ``position`` (itself included) as struct of ``cols``;
    ``following`` maps new names to columns of the next row (NULL at the last one)."""
    h = with_position_halo(df, keys, n - 1, ahead=bool(following))
    w = seg_window(keys, ["position"])
    rows = F.collect_list(F.struct(*[F.col(c).alias(a) for a, c in cols.items()])).over(w.rowsBetween(-(n - 1), 0))
    return drop_halo(h.withColumns({name: rows, **{new: F.lead(old).over(w) for new, old in (following or {}).items()}}))


def theil_sen_windows(obs: DataFrame, keys, n=11, value="depth_m", time="t_sec", order=("frame_id",)) -> DataFrame:
    """Robust line through the last ``n`` finite observations, at every one of them."""
    f = obs.filter(F.coalesce(is_finite(value), F.lit(False)))
    f = recent(with_position(f, list(keys), list(order)), keys, n, {"t": time, "v": value})
    f = f.withColumn("_fit", theil_sen("recent"))
    return f.withColumns({
        "observations": F.size("recent"), "slope": F.col("_fit.slope"), "intercept": F.col("_fit.intercept"),
        "residual": F.col("_fit.residual")}).drop("recent", "_fit", "position")


def causal_ttc(frames: DataFrame, feature: str, n=11, estimator="theil_sen", max_speed=None, min_obs=2,
               keys=("trip_id",), time="t_sec") -> DataFrame:
    """TTC at each frame from the last ``n`` frames that have a depth; infinity where unknown."""
    keys = list(keys)
    f = frames.filter(F.coalesce(is_finite(feature), F.lit(False))).select(*keys, "frame_id", time, feature)
    f = recent(with_position(f, keys, ["frame_id"]), keys, n, {"t": time, "v": feature})
    ts = F.transform("recent", lambda q: q["t"])
    if estimator == "ols":
        m = F.size("recent")

        def total(fn):
            return F.aggregate("recent", F.lit(0.0), lambda a, q: a + fn(q))
        mt, mv = total(lambda q: q["t"]) / m, total(lambda q: q["v"]) / m
        f = f.withColumns({"_mt": mt, "_mv": mv})
        sxy = total(lambda q: (q["t"] - F.col("_mt")) * (q["v"] - F.col("_mv")))
        sxx = total(lambda q: (q["t"] - F.col("_mt")) * (q["t"] - F.col("_mt")))
        slope = F.try_divide(sxy, sxx)
    elif estimator == "theil_sen":
        slope = theil_sen("recent")["slope"]
    else:
        raise ValueError(f"unknown estimator {estimator}")
    f = f.withColumn("closing_mps", -slope)
    ok = (
        (F.size("recent") >= min_obs) & (F.array_max(ts) - F.array_min(ts) >= 1e-3)
        & (F.col("closing_mps") > MIN_CLOSING_MPS)
    )
    if max_speed is not None:
        ok = ok & (F.col("closing_mps") <= max_speed)
    ttc = F.when(F.coalesce(ok, F.lit(False)), F.col(feature) / F.col("closing_mps"))
    out = f.select(*keys, "frame_id", ttc.alias("_ttc"))
    return frames.join(out, [*keys, "frame_id"], "left").withColumn(
        "predicted_ttc", F.coalesce("_ttc", F.lit(INF))).drop("_ttc")


def looming_tau(obs: DataFrame, keys=("trip_id", "track_id"), area="area", max_gap_s=0.11, n=5,
                order=("frame_id",)) -> DataFrame:
    """TTC from box growth: 2 / (d ln area / dt) over the last ``n`` samples of one sighting.

    A gap over ``max_gap_s`` starts a new sighting; fewer than three samples give infinity.
    """
    keys = list(keys)
    f = with_position(obs.filter(F.col(area) > 0), keys, list(order))
    f = recent(f, keys, n, {"t": "t_sec", "a": area})
    # cut the window at its last gap: a start is kept when no later step is too long
    size = F.size("recent")
    r = F.col("recent")
    first = F.array_max(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.when(
        (i == 0) | (r[i]["t"] - r[F.greatest(i - 1, F.lit(0))]["t"] > max_gap_s), i).otherwise(0)))
    f = f.withColumn("_first", first)
    a0, a1 = r[F.col("_first")], r[size - 1]
    samples = size - F.col("_first")
    rate = F.when((samples >= 3) & (a1["t"] > a0["t"]), (F.log(a1["a"]) - F.log(a0["a"])) / (a1["t"] - a0["t"]))
    f = f.withColumns({"samples": samples, "_rate": rate})
    return f.withColumn("looming_ttc", F.when(F.col("_rate") > 0, 2.0 / F.col("_rate")).otherwise(F.lit(INF))).drop(
        "recent", "_first", "_rate", "position")


def path_intersection(obs: DataFrame, keys=("trip_id", "track_id"), focal_px=500.0, principal_px=320.0,
                      half=1.75, n=5, order=("frame_id",)) -> DataFrame:
    """Will the track be in the own path at its TTC? Unknown history or geometry means yes.

    obs: keys, frame_id, t_sec, depth_m, centre_x, ttc, lateral_accel.
    """
    keys = list(keys)
    lateral = (F.col("centre_x") - principal_px) * F.col("depth_m") / focal_px
    f = last_rows(by_track(obs, keys).withColumn("_lat", lateral), keys, n, {"t": "t_sec", "v": "_lat", "d": "depth_m"}, order=order)
    r, ttc = F.col("recent"), F.col("ttc")
    good = (
        (F.size(r) >= n) & (r[n - 1]["t"] - r[0]["t"] >= 0.15) & F.forall(r, lambda q: q["d"] > 0)
        & (ttc > 0) & (ttc <= 2.0)
    )
    f = f.withColumn("_slope", theil_sen("recent")["slope"])
    gap = F.abs(F.col("_lat") + F.col("_slope") * ttc - 0.5 * F.col("lateral_accel") * ttc * ttc)
    f = f.withColumn("separation_m", F.when(F.coalesce(good, F.lit(False)), gap))
    inside = F.coalesce(F.col("separation_m") <= half, F.lit(True))
    return f.withColumn("intersects", inside).drop("recent", "_lat", "_slope", "position")


def track_switches(selected: DataFrame, by=("trip_id",), extra=("confidence",)) -> DataFrame:
    """Changes of the selected track between neighbouring finite predictions.

    selected: by, frame_id, ttc, track_id and the columns whose medians are reported.
    """
    by = list(by)
    f = selected.filter(is_finite("ttc"))
    f = previous(f, by, ["frame_id"], {"_was": "track_id"})
    n = F.count(F.lit(1))
    s = F.count_if(F.col("_was").isNotNull() & (F.col("_was") != F.col("track_id")))
    out = f.groupBy(*by).agg(n.alias("finite_predictions"), s.alias("switches"), (100.0 * s / n).alias("switches_per_100"))
    for c in extra:
        out = out.join(exact_quantiles(f, by, c, {f"median_{c}": 0.5}), by, "left")
    return out


def _resid(x, y, name):
    return F.col(y) - (F.col(f"_a_{name}") + F.col(f"_b_{name}") * F.col(x))


def residual_sigmas(obs: DataFrame, keys=("trip_id", "track_id"), min_obs=4) -> DataFrame:
    """Robust noise of depth and lateral position around a straight line, per track: 1.4826 times the
    median distance of the residuals from their median.

    obs: keys, t_sec, depth_m, lateral_m, one row per time. The observations are written once, and the
    three medians of a round are taken together, as values of three kinds.
    """
    keys = list(keys)
    obs = cut(obs.select(*keys, "t_sec", "depth_m", "lateral_m"))
    fits = [f(y, "t_sec").alias(f"{p}_{name}") for y, name in (("depth_m", "d"), ("lateral_m", "l"))
            for f, p in ((F.regr_slope, "_b"), (F.regr_intercept, "_a"))]
    n = obs.groupBy(*keys).agg(F.count(F.lit(1)).alias("observations"), F.min("depth_m").alias("_low"),
                               F.min("t_sec").alias("_t0"), F.max("t_sec").alias("_t1"), *fits)
    n = cut(n.filter((F.col("observations") >= min_obs) & (F.col("_low") > 0) & (F.col("_t1") > F.col("_t0"))))
    r = obs.join(n, keys)
    values = {"median_depth_m": F.col("depth_m"), "depth_sigma_m": _resid("t_sec", "depth_m", "d"), "lateral_sigma_m": _resid("t_sec", "lateral_m", "l")}
    long = r.select(*keys, F.inline(F.array(*[F.struct(F.lit(name).alias("_of"), v.alias("_v")) for name, v in values.items()])))
    kinds = [*keys, "_of"]
    med = cut(exact_quantiles(long, kinds, "_v", {"_med": 0.5}))
    away = long.join(med.filter("_of <> 'median_depth_m'"), kinds).withColumn("_dist", F.abs(F.col("_v") - F.col("_med")))
    mad = exact_quantiles(away, kinds, "_dist", {"_mad": 0.5}).select(*kinds, (F.col("_mad") * 1.4826).alias("_med"))
    found = med.filter("_of = 'median_depth_m'").select(*kinds, "_med").unionByName(mad)
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_of") == name, F.col("_med"))).alias(name) for name in values])
    return wide.join(n.select(*keys, "observations"), keys).select(
        *keys, "median_depth_m", "observations", "depth_sigma_m", "lateral_sigma_m")


def depth_range(depth) -> Column:
    d = F.col(depth)
    return F.when(d < 10, "near_0_10m").when(d < 20, "mid_10_20m").otherwise("far_20m_plus")


def range_summary(df: DataFrame, depth: str, value: str) -> DataFrame:
    """p50, p90, p95 of a value by depth range."""
    return exact_quantiles(df.withColumn("range", depth_range(depth)), ["range"], value,
                           {"p50": 0.50, "p90": 0.90, "p95": 0.95}, [F.sum("_n").alias("tracks")])


def _exact_slope(points, known: str) -> dict[str, Column]:
    """``_num`` and ``_den`` of the least-squares slope of the array ``points`` (t, v): whole numbers but
    for the unit ``_unit`` of the slope.

    Times are taken to a microsecond (to a millisecond if the window spans 100 s, to a second from
    10^5 s on), values to a ten-thousandth, so that sums and products of up to 11 points below 10^4
    fit 64 bits: the sign of the slope does not hang on rounding. NULL where ``known`` is not true.
    """
    span = F.element_at(points, -1)["t"] - points[0]["t"]
    scale = F.when(span < 100, 1e6).when(span < 1e5, 1e3).otherwise(1.0)
    whole = F.transform(points, lambda q: F.struct(
        (F.round(q["t"] * scale) - F.round(points[0]["t"] * scale)).cast("long").alias("t"), F.round(q["v"] * 1e4).cast("long").alias("v")))
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("n", "t", "v", "tv", "tt")])
    sums = F.aggregate(F.when(F.col(known), whole), zero, lambda a, q: F.struct(
        (a["n"] + 1).alias("n"), (a["t"] + q["t"]).alias("t"), (a["v"] + q["v"]).alias("v"),
        (a["tv"] + q["t"] * q["v"]).alias("tv"), (a["tt"] + q["t"] * q["t"]).alias("tt")))
    return {"_sums": sums, "_unit": scale / 1e4}


@F.pandas_udf(T.DoubleType())
def _residual_mad(t: pd.Series, v: pd.Series, rate: pd.Series) -> pd.Series:
    """Median distance from the median of what a line with slope ``rate`` leaves of a short window. A
    batch at once: as nested higher-order functions the median would be sorted anew for every point."""
    out = np.full(len(t), np.nan)
    sizes, rates = t.map(len).to_numpy(), rate.to_numpy(float)
    for n in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == n)
        x, y = np.stack(t.iloc[rows].to_numpy()).astype(float), np.stack(v.iloc[rows].to_numpy()).astype(float)
        left = y - y.mean(axis=1)[:, None] - rates[rows, None] * (x - x.mean(axis=1)[:, None])
        out[rows] = np.median(np.abs(left - np.median(left, axis=1)[:, None]), axis=1)
    return pd.Series(out)


def window_rates(obs: DataFrame, keys, n=11, order=("frame_id",)) -> DataFrame:
    """Depth-rate figures of the last ``n`` observations of a track, at every one of them.

    obs: keys, t_sec, depth_m, centre_x. Fewer than three observations, or a depth in the window
    that is not finite and above zero, give NULLs.
    """
    keys = list(keys)
    f = recent(with_position(obs, keys, list(order)), keys, n, {"t": "t_sec", "v": "depth_m", "x": "centre_x"})
    r, m = F.col("recent"), F.size("recent")

    sound = F.forall(r, lambda q: (q["v"] > 0) & is_finite(q["v"]))
    ok = (m >= 3) & (r[m - 1]["t"] > r[0]["t"]) & F.coalesce(sound, F.lit(False))
    f = f.withColumns({"_ok": ok})
    f = f.withColumns(_exact_slope(r, "_ok"))
    ok, k = F.col("_ok"), F.col("_sums")
    f = f.withColumns({"_num": k["n"] * k["tv"] - k["t"] * k["v"], "_den": k["n"] * k["tt"] - k["t"] * k["t"]})
    f = f.withColumn("linear_rate_mps", F.when(ok, F.try_divide(F.col("_num").cast("double"), F.col("_den").cast("double")) * F.col("_unit")))
    f = f.withColumn("_mad", _residual_mad(F.transform(r, lambda q: q["t"]), F.transform(r, lambda q: q["v"].cast("double")), F.col("linear_rate_mps")))
    last, prior = r[m - 1], r[F.greatest(m - 2, F.lit(0))]
    steps = F.transform(F.sequence(F.lit(1), F.greatest(m - 1, F.lit(1))), lambda i: F.abs(
        r[F.least(i, m - 1)]["x"] - r[i - 1]["x"]))
    return f.withColumns({
        "raw_rate_mps": F.when(ok, F.try_divide(last["v"] - prior["v"], last["t"] - prior["t"])),
        "residual_mad_m": F.when(ok & F.col("linear_rate_mps").isNotNull(), F.col("_mad")),
        "tail_step_px": F.when(ok, F.abs(last["x"] - prior["x"])), "max_step_px": F.when(ok, F.array_max(steps)),
        "linear_ttc": F.when(ok & (F.col("_num") < 0), last["v"] / -F.col("linear_rate_mps")),
    }).drop("recent", "position", "_mad", "_num", "_den", "_ok", "_sums", "_unit")


def depth_rate_metrics(rates: DataFrame, by="truth_group") -> DataFrame:
    """p50, p90, p95 of each depth-rate figure by group."""
    cols = ["raw_rate_mps", "linear_rate_mps", "residual_mad_m", "tail_step_px", "max_step_px", "linear_ttc"]
    # written once: the quantiles read their values twice, and the windows behind them cost much
    long = cut(rates.select(by, *cols)).unpivot([by], cols, "metric", "value")
    return exact_quantiles(long, [by, "metric"], "value", {"p50": 0.50, "p90": 0.90, "p95": 0.95},
                           [F.sum("_n").alias("samples")])


def weighted_depth_ttc(obs: DataFrame, keys, n=11, min_obs=5, order=("frame_id",)) -> DataFrame:
    """TTC from a straight depth line with rows weighted by 1 / sigma; NULL below ``min_obs``.

    obs: keys, t_sec, depth_m, sigma_m.
    """
    keys = list(keys)
    s = F.when((F.col("sigma_m") > 0) & is_finite("sigma_m"), F.col("sigma_m")).otherwise(1.0)
    f = obs.withColumn("_w", 1.0 / (s * s))
    f = recent(with_position(f, keys, list(order)), keys, n, {"t": "t_sec", "v": "depth_m", "w": "_w"})
    r, m = F.col("recent"), F.size("recent")

    def total(fn):
        return F.aggregate(r, F.lit(0.0), lambda a, q: a + fn(q))
    f = f.withColumn("_sw", total(lambda q: q["w"]))
    f = f.withColumns({"_mt": total(lambda q: q["w"] * q["t"]) / F.col("_sw"),
                       "_mv": total(lambda q: q["w"] * q["v"]) / F.col("_sw")})
    rate = F.try_divide(total(lambda q: q["w"] * (q["t"] - F.col("_mt")) * (q["v"] - F.col("_mv"))),
                        total(lambda q: q["w"] * (q["t"] - F.col("_mt")) * (q["t"] - F.col("_mt"))))
    ok = (m >= min_obs) & (r[m - 1]["t"] > r[0]["t"]) & F.coalesce(F.forall(r, lambda q: (q["v"] > 0) & is_finite(q["v"])), F.lit(False))
    f = f.withColumn("_rate", rate)
    ttc = F.when(F.col("_rate") < 0, r[m - 1]["v"] / -F.col("_rate")).otherwise(F.lit(INF))
    return f.withColumn("regression_ttc", F.when(ok, ttc)).drop("recent", "position", "_w", "_sw", "_mt", "_mv", "_rate")


def closing_reliability(obs: DataFrame, keys=("trip_id", "track_id"), n=5, order=("frame_id",), asked: DataFrame | None = None,
                        only: Column | None = None) -> DataFrame:
    """Robust closing speed of the last ``n`` observations; NULL under 3 rows or 0.15 s.

    ``asked`` (keys, ``order`` and further columns): only these observations are fitted and returned,
    with its columns; ``only``: those for which the condition holds. Their windows still reach over all observations.
    """
    keys = list(keys)
    f = last_rows(by_track(obs, keys), keys, n, {"t": "t_sec", "v": "depth_m"}, order=order)
    if only is not None:
        f = f.filter(only)
    if asked is not None:
        f = f.join(asked, [*keys, *order])
    r, m = F.col("recent"), F.size("recent")
    ok = (m >= 3) & (r[m - 1]["t"] - r[0]["t"] >= 0.15)
    f = f.withColumn("_fit", theil_sen("recent"))
    return f.withColumns({
        "closing_mps": F.when(ok, -F.col("_fit.slope")), "residual_mad_m": F.when(ok, F.col("_fit.residual")),
    }).drop("recent", "_fit", "position")


def motion_consistency(obs: DataFrame, by="truth_group", keys=("trip_id", "track_id")) -> DataFrame:
    """Do depth and box size change together? |ln(d1/d0) + ln(a1/a0)/2| between frames in a row.

    obs: by, keys, frame_id (one row per frame and track), depth_m, area, iou.
    """
    keys = [by, *keys]
    f = previous(obs, keys, ["frame_id"], {"_f": "frame_id", "_d": "depth_m", "_a": "area"})
    ok = (F.col("frame_id") == F.col("_f") + 1) & (F.col("area") > 0) & (F.col("_a") > 0)
    f = f.withColumn("gap", F.when(ok, F.abs(
        F.log(F.col("depth_m") / F.col("_d")) + 0.5 * F.log(F.col("area") / F.col("_a")))))
    base = f.groupBy(by).agg(
        F.count(F.lit(1)).alias("frames"), F.avg(F.when(F.col("iou") > 0.05, 1.0).otherwise(0.0)).alias("matched_fraction"),
        F.avg("iou").alias("mean_iou"), F.count("gap").alias("steps"), F.avg("gap").alias("mean_gap"))
    q = exact_quantiles(f, [by], "gap", {"median_gap": 0.5, "p95_gap": 0.95})
    return base.join(q, by, "left")


def distance_filter_sessions(obs: DataFrame, keys=("trip_id", "track_id"), max_gap_s=0.5, frame="frame_id") -> DataFrame:
    """Number the sightings of a track: a filter starts afresh after more than ``max_gap_s`` seconds.

    obs: keys, t_sec, ``frame``. Sightings are independent of each other, so they are the unit that
    tasks work on.
    """
    keys = list(keys)
    d = previous(obs, keys, [frame], {"_t": "t_sec"}, frame)
    fresh = F.when(F.col("_t").isNull() | ~((F.col("t_sec") - F.col("_t") > 0) & (F.col("t_sec") - F.col("_t") <= max_gap_s)), F.col(frame))
    return running_max(d, keys, [frame], fresh, "session", frame).drop("_t")


# fixed values of the depth filter: noise of the acceleration, limits of sigma, start variance
_ACCEL, _SIGMA, _SPEED_VAR = 5.0, (0.15, 12.0), 16.0
# frames of a segment of the filter: Python takes up to 10,000 segments at once, each with all its rows
FILTER_ROWS = 128


def filter_step(state, t, z, sigma):
    """One update of (t, x, v, pxx, pxv, pvv, innovation mean, count); None starts afresh."""
    sigma = min(max(sigma, _SIGMA[0]), _SIGMA[1])
    r = sigma * sigma
    if state is None or not 0.0 < t - state[0] <= 0.5:
        return (t, z, 0.0, r, 0.0, _SPEED_VAR, 0.0, 1)
    t0, x, v, pxx, pxv, pvv, ema, n = state
    dt = t - t0
    q = _ACCEL * _ACCEL
    x += dt * v
    pxx += dt * (2.0 * pxv + dt * pvv) + 0.25 * q * dt ** 4
    pxv += dt * pvv + 0.5 * q * dt ** 3
    pvv += q * dt * dt
    e, s = z - x, pxx + r
    kx, kv = pxx / s, pxv / s
    ema = 0.75 * ema + 0.25 * abs(e) if n > 1 else abs(e)
    return (t, x + kx * e, v + kv * e, pxx - kx * pxx, pxv - kx * pxv, pvv - kv * pxv, ema, n + 1)


def motion_of(state, t, missed=0):
    """(closing speed, TTC, residual) of a filter state at time ``t``."""
    if state is None or state[7] < 3:
        return 0.0, math.inf, math.inf
    t0, x, v, pxx, _, _, ema, _ = state
    x += max(0.0, t - t0) * v
    residual = ema + 0.20 * missed + 0.10 * math.sqrt(max(0.0, pxx))
    return -v, (x / -v if x > 0 and -v > MIN_CLOSING_MPS else math.inf), residual


def _distance_elements(dt, z, r, fresh):
    """Elements of ``linear_filter`` for one row of many tracks."""
    q = _ACCEL * _ACCEL
    q00, q01, q11 = 0.25 * q * dt ** 4, 0.5 * q * dt ** 3, q * dt * dt
    s = q00 + r
    k0, k1 = q00 / s, q01 / s
    out = np.column_stack([
        1 - k0, (1 - k0) * dt, -k1, 1 - k1 * dt, k0 * z, k1 * z, q00 - k0 * q00, q01 - k0 * q01, q11 - k1 * q01,
        z / s, dt * z / s, 1 / s, dt / s, dt * dt / s])
    start = np.zeros((len(z), 14))
    start[:, 4], start[:, 6], start[:, 8] = z, r, _SPEED_VAR
    return np.where(fresh[:, None], start, out)


def _steps(times: pd.Series, before: pd.Series, max_gap_s: float):
    """Time since the row before, 0 where a sighting starts, and whether a row is the first, second
    or a later one of its sighting; ``before`` holds the last two times before the segment."""
    t, ahead = padded(times), padded(before.map(lambda b: [np.nan if v is None else v for v in b]), np.nan)
    dt = np.diff(np.column_stack([ahead, t]))
    with np.errstate(invalid="ignore"):
        goes_on = (dt > 0) & (dt <= max_gap_s)
    return np.where(goes_on, dt, 0.0)[:, 1:], np.where(goes_on[:, 1:], np.where(goes_on[:, :-1], 3.0, 2.0), 1.0)


def _summed_up(rule, max_gap_s):
    @F.pandas_udf("array<double>")
    def element(t: pd.Series, z: pd.Series, r: pd.Series, before: pd.Series) -> pd.Series:
        size = t.map(len).to_numpy()
        if not len(size):
            return pd.Series([], dtype=object)
        (dts, ages), zs, rs = _steps(t, before, max_gap_s), padded(z), padded(r, 1.0)
        acc = np.tile(np.array(rule.identity), (len(t), 1))
        for i in range(dts.shape[1]):
            live = i < size
            acc[live] = rule.combine(acc[live], _distance_elements(dts[live, i], zs[live, i], rs[live, i], ages[live, i] == 1))
        return pd.Series(list(acc))

    return element


_WALK = T.StructType([T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("x", "v", "pxx", "gap", "age", "decay")])


def _filtered(max_gap_s):
    @F.pandas_udf(_WALK)
    def walk(t: pd.Series, z: pd.Series, r: pd.Series, before: pd.Series, entry: pd.Series) -> pd.DataFrame:
        """Estimates at every row, |innovation|, and the segment's mean innovation as an affine map."""
        size = t.map(len).to_numpy()
        if not len(size):
            return pd.DataFrame({f.name: [] for f in _WALK.fields})
        (dts, ages), zs, rs = _steps(t, before, max_gap_s), padded(z), padded(r, 1.0)
        x, v, pxx, pxv, pvv = np.stack([np.asarray(e, float) for e in entry]).T[4:9]
        out = {n: np.zeros_like(zs) for n in ("x", "v", "pxx", "gap")}
        a, b = np.ones(len(t)), np.zeros(len(t))
        q = _ACCEL * _ACCEL
        for i in range(zs.shape[1]):
            d, m, s, n = dts[:, i], zs[:, i], rs[:, i], ages[:, i]
            fresh, live = n == 1, i < size
            x1 = x + d * v
            p00 = pxx + d * (2.0 * pxv + d * pvv) + 0.25 * q * d ** 4
            p01 = pxv + d * pvv + 0.5 * q * d ** 3
            p11 = pvv + q * d * d
            e, c = m - x1, p00 + s
            kx, kv = p00 / c, p01 / c
            x, v = np.where(fresh, m, x1 + kx * e), np.where(fresh, 0.0, v + kv * e)
            pxx, pxv, pvv = np.where(fresh, s, p00 - kx * p00), np.where(fresh, 0.0, p01 - kx * p01), np.where(fresh, _SPEED_VAR, p11 - kv * p01)
            gap = np.where(fresh, 0.0, np.abs(e))
            keep, add = _innovation_step(n, gap)
            a, b = np.where(live, keep * a, a), np.where(live, keep * b + add, b)
            for name, value in (("x", x), ("v", v), ("pxx", pxx), ("gap", gap)):
                out[name][:, i] = value
        done = {n: ragged(w, size) for n, w in {**out, "age": ages}.items()}
        return pd.DataFrame({**done, "decay": list(np.column_stack([a, b]))})

    return walk


def _innovation_step(age, gap):
    """Mean innovation: 0 on a first sighting, the gap itself on the second, then a decaying mean."""
    return np.where(age > 2, 0.75, 0.0), np.where(age > 2, 0.25 * gap, np.where(age == 2, gap, 0.0))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _mean_innovation(gap: pd.Series, age: pd.Series, entry: pd.Series) -> pd.Series:
    size = gap.map(len).to_numpy()
    gaps, ages = padded(gap), padded(age)
    now, out = np.array([e[1] for e in entry], float), np.zeros_like(gaps)
    for i in range(gaps.shape[1]):
        keep, add = _innovation_step(ages[:, i], gaps[:, i])
        out[:, i] = now = keep * now + add
    return pd.Series(ragged(out, size))


def kalman_distance(obs: DataFrame, keys=("trip_id", "track_id"), max_gap_s=0.5, rows=FILTER_ROWS) -> DataFrame:
    """Constant-velocity filter over each track: distance, closing speed, TTC, residual.

    obs: keys, frame_id, ordinal, t_sec, depth_m, sigma_m. The filter starts afresh where the time
    does not rise by at most ``max_gap_s``. One track of any length is spread over tasks: its segments
    are summed up and combined (``scan.linear_filter``), then filtered at once from their entries;
    the mean innovation, which needs all estimates, follows as a second, affine recursion.
    """
    keys = list(keys)
    order = ["frame_id", "ordinal"]
    # written once: all steps read the segments
    s = cut(filter_rows(by_track(obs.select(*keys, *order, "t_sec", "depth_m", "sigma_m"), keys, rows=rows), keys))
    f = filter_segments(s, keys, max_gap_s)
    zipped = F.arrays_zip(*[F.col(c) for c in ("_rows", *FILTERED)])
    return filtered_values(f.select(*keys, F.explode(zipped).alias("z")).select(
        *keys, *[F.col(f"z._rows.{c}").alias(c) for c in order], *[F.col(f"z.{c}").alias(c) for c in FILTERED])).drop(*FILTERED)


FILTERED = ("_age", "_x", "_v", "_pxx", "_ema")


def filtered_values(df: DataFrame, prefix="") -> DataFrame:
    """Distance, closing speed, TTC and residual of filter states (columns ``FILTERED``)."""
    known, x, closing = F.col("_age") > 2, F.col("_x"), -F.col("_v")
    return df.withColumns({
        f"{prefix}distance_m": x, f"{prefix}closing_mps": F.when(known, closing).otherwise(0.0),
        f"{prefix}ttc": F.when(known & (x > 0) & (closing > MIN_CLOSING_MPS), x / closing).otherwise(F.lit(INF)),
        f"{prefix}residual_m": F.when(known, F.col("_ema") + 0.10 * F.sqrt(F.greatest(F.col("_pxx"), F.lit(0.0)))).otherwise(F.lit(INF))})


def filter_rows(o: DataFrame, keys) -> DataFrame:
    """Rows of ``by_track`` as one list (``_rows``) per segment, in order."""
    order = ["frame_id", "ordinal"]
    sigma = F.least(F.greatest(F.col("sigma_m"), F.lit(_SIGMA[0])), F.lit(_SIGMA[1]))
    row = F.struct(*order, F.col("t_sec").cast("double").alias("t"), F.col("depth_m").cast("double").alias("z"), (sigma * sigma).cast("double").alias("r"))
    return o.groupBy(*keys, SEG).agg(F.array_sort(F.collect_list(row)).alias("_rows"))


def filter_segments(s: DataFrame, keys, max_gap_s=0.5) -> DataFrame:
    """The filter of ``kalman_distance`` over segments of ``filter_rows``, with the states after each row as
    arrays beside them (``FILTERED``). ``s`` is read several times."""
    # the last two times before each segment and its number, from one row per segment
    before = Window.partitionBy(*keys).orderBy(SEG)
    last, other = F.element_at("_rows.t", -1), F.when(F.size("_rows") > 1, F.element_at("_rows.t", -2))
    ends = s.select(*keys, SEG, last.alias("_t1"), other.alias("_t2")).withColumn("_t2", F.coalesce("_t2", F.lag("_t1").over(before)))
    ends = ends.select(*keys, SEG, F.lag("_t1").over(before).alias("_t1"), F.lag("_t2").over(before).alias("_t2"), F.row_number().over(before).cast("long").alias("_no"))
    given = [F.col("_rows.t"), F.col("_rows.z"), F.col("_rows.r"), F.array("_t2", "_t1")]
    rule = linear_filter()
    # up to 2^24 segments of a track
    elements = s.join(ends, [*keys, SEG]).select(*keys, "_no", _summed_up(rule, max_gap_s)(*given).alias("element"))
    entry = ends.join(scan(elements, keys, "_no", rule, fan=256, levels=3), [*keys, "_no"])
    s = s.join(entry, [*keys, SEG]).withColumn("_f", _filtered(max_gap_s)(*given, F.col("entry"))).drop("entry", "_t1", "_t2")
    means = scan(s.select(*keys, "_no", F.col("_f.decay").alias("element")), keys, "_no", affine(), fan=256, levels=3)
    means = ends.select(*keys, SEG, "_no").join(means, [*keys, "_no"]).drop("_no")
    s = s.join(means, [*keys, SEG])
    return s.select(*keys, SEG, "_rows", *[F.col(f"_f.{c}").alias(f"_{c}") for c in ("age", "x", "v", "pxx")],
                    _mean_innovation(F.col("_f.gap"), F.col("_f.age"), F.col("entry")).alias("_ema"))


def track_confidence(obs: DataFrame, keys, ground_confidence, n=11) -> DataFrame:
    """Confidence of a track at each observation: history, quality, fit residual, ground, motion.

    obs: keys, frame_id, t_sec, depth_m, quality. Fewer than three observations have no fit.
    """
    keys = list(keys)
    f = recent(with_position(obs, keys, ["frame_id"]), keys, n, {"t": "t_sec", "v": "depth_m", "q": "quality"})
    f = f.withColumns({"_fit": theil_sen("recent"), "observations": F.size("recent")})
    fitted = (F.col("observations") >= 3) & F.col("_fit.residual").isNotNull()
    quality = F.aggregate("recent", F.lit(0.0), lambda a, x: a + x["q"]) / F.col("observations")
    calm = F.when(fitted, F.exp(-F.col("_fit.residual") / F.greatest(F.lit(0.5), F.col("depth_m") * 0.10))).otherwise(0.0)
    moving = F.when(fitted & (-F.col("_fit.slope") > MIN_CLOSING_MPS), 1.0).otherwise(0.5)
    history = F.least(F.lit(1.0), F.col("observations") / 7.0)
    score = 0.25 * history + 0.30 * quality + 0.20 * calm + 0.15 * F.lit(ground_confidence) + 0.10 * moving
    return f.withColumn("track_confidence", score).drop("recent", "_fit", "position")
