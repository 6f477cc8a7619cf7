"""Cutting lineage for tables that several later steps, or many rounds, read again."""
from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read on from there.

    The folder is the session's ``spark.checkpoint.dir`` (shared storage, so the rows survive
    lost executors). Only a local session without that setting gets a folder of its own.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="spark-roadrisk-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def shared(df: DataFrame, *keys) -> DataFrame:
    """``df`` hash-partitioned by ``keys``, moved once for all who read it.

    Several readers of one shuffle mostly need different columns, and each would get a shuffle of its
    own. The filter holds for every row, but is not known to, so all readers ask for all columns
    and share one. ``df`` should have no column that no one needs.
    """
    return df.repartition(*keys).filter((F.monotonically_increasing_id() >= 0) | (F.hash(*df.columns) == 0))


def spread(df: DataFrame, *keys) -> DataFrame:
    """Hash-partition by ``keys`` into the session's number of shuffle partitions.

    For steps that compute much on few bytes: adaptive execution would merge their partitions
    by size, and leave them to a few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
