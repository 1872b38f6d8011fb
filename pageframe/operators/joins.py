"""Joins whose left key may be missing for many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPREAD = 1024


def left_join_spread(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on ``key`` that does not send all null keys to one task.

    Rows without a key can match nothing, so a second key deals them out by the
    hash of the row.  It is 0 for every other row and on the right side (there
    written as a row expression, so that it is not folded out of the join).
    """
    hashed = [c for c, kind in left.dtypes if "map<" not in kind and "variant" not in kind]
    spread = F.when(
        F.col(key).isNull(), F.pmod(F.xxhash64(*hashed), F.lit(SPREAD))
    ).otherwise(F.lit(0).cast("bigint"))
    zero = F.pmod(F.xxhash64(key), F.lit(1))
    return (
        left.withColumn("_spread", spread)
        .join(right.withColumn("_spread", zero), [key, "_spread"], "left")
        .drop("_spread")
    )
