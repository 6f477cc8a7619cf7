"""Register of runnable queries: a Spark plan and, where SQL can say it, an oracle text."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F, types as T

from roadrisk.plans.bindings import Tables, with_bindings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def presentable(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places; infinite and NaN values become NULL."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.round(c, 6) + F.lit(0.0))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _oracle(sql: str, doubles: str) -> str:
    body = sql.strip()
    ctes, body = with_bindings(body)
    if body[:5].upper() == "WITH ":
        # the query's own CTEs follow the derived tables
        head, body = body[5:].rsplit("\nSELECT_FINAL", 1) if "\nSELECT_FINAL" in body else (None, body)
        if head is None:
            raise ValueError("mark the last SELECT of a WITH query as SELECT_FINAL")
        ctes = ctes + [head.strip()]
        body = "SELECT" + body
    names = doubles.split()
    if names:
        fixed = ", ".join(
            f"CASE WHEN isfinite(CAST({n} AS DOUBLE)) THEN round(CAST({n} AS DOUBLE), 6) + 0e0 END AS {n}" for n in names
        )
        body = f"SELECT * REPLACE ({fixed}) FROM (\n{body}\n) AS answer"
    return (f"WITH RECURSIVE {', '.join(ctes)}\n" if ctes else "") + body


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register ``fn(tables) -> DataFrame`` under ``name``, with an optional oracle."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: presentable(fn(Tables(spark, folder)))
        if sql is not None:
            ORACLES[name] = _oracle(sql, doubles)
        return fn

    return add
