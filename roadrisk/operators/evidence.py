"""Columns of several sources side by side, and what a reviewer may see of them."""
from __future__ import annotations

from pyspark.sql import DataFrame

def prefix_columns(df: DataFrame, prefix: str, keys=("trip_id", "frame_id")) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}_{c}" for c in df.columns if c not in keys})


def blind_projection(labels: DataFrame, reviewer_columns) -> DataFrame:
    """Only what a reviewer may see."""
    return labels.select(*reviewer_columns)
