"""Column functions over time-to-collision values. Infinity means "no collision"."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadrisk.constants import (
    CRITICAL_ZONE_TTC, DANGER_TTC, INF, INF_AS_SECONDS, MIN_TTC_FOR_INVERSE, SEVERE_TTC,
)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x) -> Column:
    """The number, or NULL when it is NaN or infinite."""
    x = _c(x)
    return F.when(~F.isnan(x) & (F.abs(x) < INF), x)


def is_finite(x) -> Column:
    x = _c(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INF)


def is_danger(ttc) -> Column:
    return _c(ttc) < DANGER_TTC


# fixed values: spellings of infinity accepted as text
_INF_WORDS = ("inf", "+inf", "infinity", "+infinity")


def parse_ttc(text, mode: str = "strict") -> Column:
    """TTC text as ``struct<value double, error string>``.

    strict: infinity words are inf; empty, nan, negative, other text are errors.
    lenient: whatever is not a finite number is inf. sentinel99: likewise, but 99.
    positive: like strict, and zero is an error too.
    """
    raw = F.lower(F.trim(_c(text)))
    number = raw.try_cast("double")
    good = F.coalesce(is_finite(number), F.lit(False))
    word = F.coalesce(raw.isin(*_INF_WORDS), F.lit(False))
    if mode in ("lenient", "sentinel99"):
        other = F.lit(INF if mode == "lenient" else INF_AS_SECONDS)
        return F.struct(
            F.when(good, number).otherwise(other).alias("value"), F.lit(None).cast("string").alias("error")
        )
    allowed = number > 0 if mode == "positive" else number >= 0
    error = (
        F.when(word, F.lit(None).cast("string"))
        .when(raw.isNull(), F.lit("missing"))
        .when(~good, F.lit("not numeric"))
        .when(~allowed, F.lit("out of range"))
    )
    value = F.when(word, F.lit(INF)).when(error.isNull(), number)
    return F.struct(value.alias("value"), error.alias("error"))


def ttc_band(ttc) -> Column:
    t = _c(ttc)
    return (
        F.when(F.isnan(t) | (t >= CRITICAL_ZONE_TTC), F.lit("SAFE"))
        .when(t >= DANGER_TTC, F.lit("WARNING"))
        .when(t >= SEVERE_TTC, F.lit("DANGER"))
        .when(t == -INF, F.lit("SAFE"))
        .otherwise(F.lit("CRITICAL"))
    )


def inverse_ttc(ttc) -> Column:
    t = _c(ttc)
    return F.when(is_finite(t), 1.0 / F.greatest(F.lit(MIN_TTC_FOR_INVERSE), t)).otherwise(0.0)


def display_ttc(ttc, cap: float = 10.0) -> Column:
    t = _c(ttc)
    return F.when(is_finite(t), F.least(t, F.lit(cap))).otherwise(F.lit(cap))


def clipped_ttc(ttc) -> Column:
    t = _c(ttc)
    return F.when(is_finite(t), t).otherwise(F.lit(INF_AS_SECONDS))


def danger_outcome(pred, truth) -> Column:
    p, t = is_danger(pred), is_danger(truth)
    return F.when(p & t, "TP").when(p & ~t, "FP").when(~p & t, "FN").otherwise("TN")


def risk_level(state, band) -> Column:
    s, b = _c(state), _c(band)
    return (
        F.when(s == "UNKNOWN", F.lit("UNKNOWN"))
        .when(s == "HIGH_RISK", F.when(b.isin("DANGER", "CRITICAL"), b).otherwise("DANGER"))
        .when(s == "ATTENTIVE", F.lit("WARNING"))
        .otherwise("SAFE")
    )


def apply_ttc_floor(raw, gated, floor) -> Column:
    """``struct<ttc, applied>``: a finite floor where a gate took danger away."""
    raw, gated, floor = _c(raw), _c(gated), _c(floor)
    applied = F.coalesce(floor.isNotNull() & is_danger(raw) & ~is_danger(gated), F.lit(False))
    return F.struct(F.when(applied, floor).otherwise(gated).alias("ttc"), applied.alias("applied"))


def occupancy_suppress(ttc, source, iou, accepted, occupancy) -> Column:
    """``struct<ttc, suppressed>``: classical danger becomes 2.0 s when a matched, accepted
    track (IoU >= 0.3) probably lies outside the corridor (occupancy < 0.5)."""
    ttc, occupancy = _c(ttc), _c(occupancy)
    hit = F.coalesce(
        _c(source).startswith("classical") & is_danger(ttc) & (_c(iou) >= 0.30) & _c(accepted)
        & (occupancy < 0.50), F.lit(False))
    return F.struct(F.when(hit, F.lit(DANGER_TTC)).otherwise(ttc).alias("ttc"), hit.alias("suppressed"))


def conservative_union(classical, detector) -> Column:
    """``struct<ttc, source>``: the detector only where it alone reports danger."""
    c, d = _c(classical), _c(detector)
    alone = is_danger(d) & ~is_danger(c)
    source = F.when(alone, F.lit("detector")).otherwise(F.lit("classical"))
    return F.struct(F.when(alone, d).otherwise(c).alias("ttc"), source.alias("source"))


def description_seconds(text) -> Column:
    found = F.regexp_extract(_c(text), r"\b(\d+)s\b", 1)
    return F.when(found != "", found.cast("bigint"))


def ttc_text(ttc) -> Column:
    """Six decimals, or ``inf``."""
    t = _c(ttc)
    return F.when(is_finite(t), F.format_string("%.6f", t)).otherwise(F.lit("inf"))


def scenario(lateral_accel) -> Column:
    return F.when(F.abs(_c(lateral_accel)) >= 0.3, F.lit("turn")).otherwise(F.lit("straight"))


def ego_cap(speed) -> Column:
    """Largest closing speed believed at this own speed: v + 3, within 3 to 20 m/s."""
    return F.least(F.lit(20.0), F.greatest(F.lit(3.0), _c(speed) + 3.0))
