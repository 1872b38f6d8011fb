"""Request metrics and batch bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe import constants as K


def bucket_label(bound: float) -> str:
    return "le_" + f"{bound:g}".replace(".", "_")


def duration_histogram(log: DataFrame, *extra_keys: str | Column) -> DataFrame:
    """Cumulative bucket counts, sum and count per method, route and code.

    Fixed-width buffers: every task sends one row per label set to the shuffle.
    """
    seconds = F.col("duration_s")
    return log.groupBy(*extra_keys, "method", "route", "code").agg(
        *[F.count_if(seconds <= b).alias(bucket_label(b)) for b in K.DURATION_BUCKETS],
        F.sum(seconds).alias("duration_sum"),
        F.count(seconds).alias("duration_count"),
    )


def run_summary(log: DataFrame) -> DataFrame:
    """Totals of a run: requests, successes, failures, seconds, rate."""
    ok = F.count_if(F.col("code") == 200)
    span = (F.max("ts_ms") - F.min("ts_ms")) / 1000.0
    return log.agg(
        F.count("*").alias("total"),
        ok.alias("ok"),
        (F.count("*") - ok).alias("failed"),
        span.alias("elapsed_s"),
        F.when(span > 0, F.count("*") / span).alias("rate"),
    )


def health_rollup(checks: DataFrame, run: str = "run_id") -> DataFrame:
    """A run is healthy when every check says ``ok``."""
    all_ok = F.bool_and(F.col("status") == "ok")
    return checks.groupBy(run).agg(
        F.when(all_ok, "healthy").otherwise("degraded").alias("status"),
        F.when(all_ok, 200).otherwise(503).cast("int").alias("code"),
        F.count("*").alias("checks"),
    )


def round_robin(df: DataFrame, targets: list[str], index: str) -> DataFrame:
    """Item ``i`` gets target ``i mod n``; ``index`` is the item number.

    The item number is data, so no global ordering step is needed.
    """
    listed = F.array(*[F.lit(t) for t in targets])
    slot = F.pmod(F.col(index), F.lit(len(targets))).cast("int")
    return df.withColumn("target", F.get(listed, slot))
