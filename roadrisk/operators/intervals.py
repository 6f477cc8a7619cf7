"""Points and the runs that cover them. Runs are cut into fixed buckets and joined on (keys, bucket), so
a long trip spreads over many tasks and no all-pairs join is made."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET = 64


def _bucket(c):
    return F.floor(F.col(c) / F.lit(BUCKET))


def _spread(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.withColumn("_bk", F.explode(F.sequence(_bucket(start), _bucket(end))))


def points_in_runs(points: DataFrame, runs: DataFrame, keys, point: str, span) -> DataFrame:
    """Points with the run that covers them. Runs of one key must be disjoint."""
    r0, r1 = span
    j = points.withColumn("_bk", _bucket(point)).join(_spread(runs, r0, r1), [*keys, "_bk"])
    return j.filter((F.col(r0) <= F.col(point)) & (F.col(point) <= F.col(r1))).drop("_bk")
