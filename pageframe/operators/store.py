"""Extraction store: upsert, freshness, retention.

The store is a table ``(cache_key, url, formats, omc, value, ts, last_access)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageframe import constants as K
from pageframe.functions import urls as U
from pageframe.sources import shared


def latest_per_key(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """First row per key in the given order; losers go before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")


def upsert_store(store: DataFrame, new: DataFrame) -> DataFrame:
    """A set replaces value and time; on equal times the new row wins."""
    tagged = store.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest_per_key(tagged, "cache_key", F.col("ts").desc(), F.col("_new").desc()).drop("_new")


def fresh_entries(store: DataFrame, now: Column, ttl_ms: int = K.STORE_TTL_MS) -> DataFrame:
    """Entries not older than the time to live; exactly as old still counts."""
    return store.where(F.unix_millis(now) - F.unix_millis("ts") <= ttl_ms)


def retain(store: DataFrame, max_items: int = K.STORE_MAX_ITEMS) -> DataFrame:
    """The ``max_items`` most recently used entries (ties by key, no time last).

    The order is found on the two narrow columns: sorted by range, counted per range, and
    numbered inside the one range that holds the cut.  The store's values never move; its rows
    are compared with the one row at the cut.
    """
    order = [F.col("last_access").desc_nulls_last(), F.col("cache_key")]
    width = int(store.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = store.select("last_access", "cache_key").repartitionByRange(width, *order)
    ranged = shared.cut_lineage(ranged.withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # one row per range
    before = F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")
    holds = counts.withColumn("_before", before).where(
        (F.col("_before") < max_items) & (F.col("_before") + F.col("_n") >= max_items)
    )
    inside = ranged.join(F.broadcast(holds), "_range")  # one row at most
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    cut = inside.withColumn("_place", place).where(F.col("_place") == max_items)
    cut = cut.select(F.col("last_access").alias("_at"), F.col("cache_key").alias("_key"), F.lit(1).alias("_one"))
    later = (F.col("_at").isNull() & F.col("last_access").isNotNull()) | (F.col("last_access") > F.col("_at"))
    same = F.col("last_access").eqNullSafe(F.col("_at")) & (F.col("cache_key") <= F.col("_key"))
    kept = store.withColumn("_one", F.lit(1)).join(F.broadcast(cut), "_one", "left")
    within = F.col("_key").isNull() | F.coalesce(later, F.lit(False)) | same
    return kept.where(within & F.lit(max_items > 0)).select(*store.columns)


def store_rows(extracted: DataFrame, formats: list[str], only_main: bool, now: Column) -> DataFrame:
    """Successful extractions in store form."""
    names = F.array(*[F.lit(f) for f in formats])
    value = F.to_json(F.struct(*[c for c in extracted.columns if c not in ("page_id", "url")]))
    return extracted.select(
        U.extraction_key(F.col("url"), names, F.lit(only_main)).alias("cache_key"),
        "url",
        F.array_join(names, ",").alias("formats"),
        F.lit(only_main).alias("omc"),
        value.alias("value"),
        now.alias("ts"),
        now.alias("last_access"),
    )


def write_store(store: DataFrame, path: str) -> None:
    """A new version of the store in a directory of its own."""
    store.write.mode("errorifexists").parquet(path)
