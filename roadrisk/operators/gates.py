"""Gates on summaries of runs."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latency_gate(summary: DataFrame, stage: str, limit_ms: float) -> DataFrame:
    """p95 of one stage against a limit, inclusive and strict."""
    s = summary.filter(F.col("stage") == stage)
    keep = [c for c in s.columns if c not in ("stage", "p50", "p99", "mean", "min", "max", "samples", "rejected")]
    return s.select(*keep, (F.col("p95") <= limit_ms).alias("passed"), (F.col("p95") < limit_ms).alias("passed_strict"))


def robustness_delta(scores: DataFrame, by: str, clean: str, metrics) -> DataFrame:
    """Each condition minus the clean one."""
    base = scores.filter(F.col(by) == clean).select(*[F.col(m).alias(f"_{m}") for m in metrics])
    # the right side is a single row
    j = scores.filter(F.col(by) != clean).join(base, F.lit(True))
    return j.select(by, *[(F.col(m) - F.col(f"_{m}")).alias(f"delta_{m}") for m in metrics])


def select_benchmark(runs: DataFrame, slack=0.05) -> DataFrame:
    """Among eligible runs less than ``slack`` slower than the fastest p95: best F1, composite, p95,
    and of equal ones the greatest name."""
    ok = runs.filter("eligible").drop("eligible")
    # one row of the least p95
    near = ok.join(ok.agg(F.min("p95").alias("_best")), F.lit(True)).filter((F.col("p95") - F.col("_best")) / F.col("_best") < slack).drop("_best")
    return near.orderBy(F.desc(F.round("f1", 9)), F.desc(F.round("composite", 9)), "p95", F.desc("name")).limit(1)
