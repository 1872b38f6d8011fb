"""Shared storage of a session: lineage cuts, stream state and stream output."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a folder of the warehouse where none is set.

    Both are seen by every executor.  No machine-local temporary folder is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    return (root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work").rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write and read again, so a lost executor costs no long replay."""
    path = fresh_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Most keys that are sent to all tasks (numbers or URLs, some 100 bytes each); with more, both
#: sides are shuffled.
MOST_KEYS = 200_000


def only_keys(rows: DataFrame, keys: DataFrame, key: str, name: str | None = None) -> DataFrame:
    """The rows whose ``key`` is among ``keys`` (its column ``name``, by default ``key`` too).  The
    distinct keys are written once and counted; few of them leave the other rows where they are."""
    wanted = cut_lineage(keys.select(keys[name or key].alias(key)).where(f"`{key}` IS NOT NULL").distinct())
    few = wanted.count() <= MOST_KEYS
    return rows.join(F.broadcast(wanted) if few else wanted, key, "left_semi")
