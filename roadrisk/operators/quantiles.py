"""Exact quantiles that no single task has to hold.

Spark's ``percentile`` keeps every distinct value of a group in one buffer. Here equal values
are counted first (combined before the shuffle), the counts are ranked by a prefix sum in
two steps (within a value bucket, then over the buckets), and only the rows at the wanted
ranks are kept. Interpolation is linear between neighbouring ranks.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadrisk.functions.ttc import _c

#: fine enough that values of one magnitude spread over thousands of buckets, and few enough that
#: the buckets of a key (some ten thousand) can be summed up by one window
STEPS = 4096


def value_bucket(v):
    """A non-decreasing whole number of the value: STEPS per doubling of 1 + |v|."""
    v = _c(v)
    return (F.signum(v) * F.floor(F.log2(1.0 + F.abs(v)) * STEPS)).cast("int")


def exact_quantiles(df: DataFrame, keys, value: str, probs: dict[str, float], extra=()) -> DataFrame:
    """One row per key with a column per entry of ``probs``; ``extra`` are further aggregates
    over columns ``value`` (named by ``value``) and ``_n`` (its multiplicity)."""
    keys = list(keys)
    c = (
        df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_b", value_bucket(value))
    )
    part = keys or [F.lit(1)]
    before = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    b = c.groupBy(*keys, "_b").agg(F.sum("_n").alias("_m"))
    b = b.select(
        *keys, "_b", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"),
        F.sum("_m").over(Window.partitionBy(*part)).alias("_total"),
    )
    local = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    r = (
        c.withColumn("_upto", F.sum("_n").over(local)).join(b, [*keys, "_b"])
        .withColumn("_hi", F.col("_before") + F.col("_upto")).withColumn("_lo", F.col("_hi") - F.col("_n"))
    )

    def at(rank):
        return F.max(F.when((F.col("_lo") <= rank) & (rank < F.col("_hi")), F.col(value)))

    aggs = []
    for name, p in probs.items():
        h = F.lit(p) * (F.col("_total") - 1)
        low, high = F.floor(h), F.ceil(h)
        frac = F.max(h - low)
        lower, upper = at(low), at(high)
        aggs.append((lower + (upper - lower) * frac).alias(name))
    return r.groupBy(*keys).agg(*aggs, *extra)
