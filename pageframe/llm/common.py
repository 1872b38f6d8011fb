"""Helpers that several operators of this folder share."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageframe.sources.shared import fresh_path

#: White space of every contract here: the blank and 0x09-0x0D.
SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\f\r"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and is computed once."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def words_of(text: Column) -> Column:
    """Array of the words of a non-null text, by built-in functions."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, SPACE + "+")
    )


def width(df: DataFrame, least: int = 1) -> int:
    """Number of shuffle partitions to use: the session's setting."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Memo(dict):
    """Values by text, made when first asked for.  ``trim`` forgets them once they hold more than
    ``most`` bytes; a task that ends forgets all (``freed``), as its worker goes on to other stages."""

    ROW = 150  # bytes of an entry besides its key

    def __init__(self, make: Callable, most: int = 60_000_000):
        self.make, self.most, self.held = make, most, 0

    def __missing__(self, key):
        self.held += sys.getsizeof(key) + self.ROW
        out = self[key] = self.make(key)
        return out

    def clear(self) -> None:
        super().clear()
        self.held = 0

    def trim(self) -> None:
        if self.held > self.most:
            self.clear()


#: What ends the memories that modules keep from task to task.
KEPT: list[Callable[[], None]] = []


def give_back() -> None:
    """Memory that nothing holds goes back to the system: workers of all cores share an executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def forget_kept() -> None:
    """A worker that starts another kind of task drops what the one before left to its like."""
    for forget in KEPT:
        forget()
    give_back()


def freed(run: Callable[[Iterator], Iterator], forget: Callable[[], None]) -> Callable[[Iterator], Iterator]:
    """The task function ``run``, with ``forget`` called at its end.  ``forget`` is a function of a
    module, so that it reaches what the worker's module remembers."""

    def task(batches: Iterator) -> Iterator:
        forget_kept()
        try:
            yield from run(batches)
        finally:
            forget()
            give_back()

    return task


def components(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """Connected components of (a, b) pairs of ids: rows (id, component), component the
    smallest id reachable.  Every round each node takes the smallest label around it and
    then the label of that label, so the number of rounds is about the logarithm of the
    longest chain.  Rounds are written to the shared folder; only a count reaches the driver.
    """
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("other"))
    both = stored(both.union(both.select("other", "id")).where("id <> other").distinct(), "edges")
    labels = both.groupBy("id").agg(F.least("id", F.min("other")).alias("component"))
    labels = stored(labels, "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("id", "other"), "other")
        best = seen.groupBy("id").agg(F.min("component").alias("near"))
        step = labels.join(best, "id").select(
            "id", F.col("component").alias("was"), F.least("component", "near").alias("now")
        )
        # The label is itself a node: take the label that it has reached.
        jump = labels.select(F.col("id").alias("now"), F.col("component").alias("far"))
        new = step.join(jump, "now", "left").select(
            "id", "was", F.least("now", "far").alias("component")
        )
        new = stored(new, "labels")
        if new.where("component < was").limit(1).count() == 0:
            return new.select("id", "component")
        labels = new.select("id", "component")


#: Most ids (8 bytes each) that are sent to all tasks; with more, both sides are shuffled.
MOST_IDS = 1_000_000


def without(docs: DataFrame, gone: DataFrame, condition: Column) -> DataFrame:
    """The rows of ``docs`` that ``condition`` matches with no row of ``gone``, a written table
    of single ids.  Few ids leave the texts where they are."""
    few = gone.count() <= MOST_IDS
    return docs.join(F.broadcast(gone) if few else gone, condition, "left_anti")
