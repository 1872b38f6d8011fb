"""Request durations per window, label set and bucket, complete at any time.

Every micro-batch writes its partial counts under its batch number, so a repeated batch writes
over itself.  A run then merges the last version with the partials behind it into the next
version and commits it.  Counts are sums, so partials merge in any order; windows still open
are there like others.

Late rows: a row counts in the window of its own time, however late it comes, as a partial of
that window that the next merge adds.  Nothing waits for a watermark and nothing is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageframe import constants as K
from pageframe.operators import metrics as X
from pageframe.sources import log

_LABELS = ["window", "method", "route", "code"]
_COUNTS = [*map(X.bucket_label, K.DURATION_BUCKETS), "duration_sum", "duration_count"]
_SCHEMA = (
    "window struct<start:timestamp,end:timestamp>, method string, route string, code int, "
    + ", ".join(f"{c} {'double' if c == 'duration_sum' else 'long'}" for c in _COUNTS)
    + ", upto long"
)


def partial(rows: DataFrame, ts: str = "ts", width: str = "1 hour") -> DataFrame:
    """Counts of some rows: (window, method, route, code, buckets, sum, count)."""
    counts = X.duration_histogram(rows, F.window(ts, width).alias("window"))
    return counts.select(*_LABELS[:3], F.col("code").cast("int").alias("code"), *_COUNTS)


def merged(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*_LABELS).agg(*[F.sum(c).alias(c) for c in _COUNTS])


class WindowTable:
    """Versions of the histogram and the partials behind the last one, under ``root``."""

    def __init__(self, spark: SparkSession, root: str, ts: str = "ts", width: str = "1 hour"):
        self.spark, self.root, self.ts, self.width = spark, root, ts, width
        self.commits = log.Commits(spark, root)

    def run(self, stream: DataFrame) -> None:
        """Take in what has arrived and write the next version."""

        def write(batch: DataFrame, number: int) -> None:
            partial(batch, self.ts, self.width).write.mode("overwrite").parquet(f"{self.root}/partials/upto={number}")

        query = (
            stream.writeStream.foreachBatch(write)
            .option("checkpointLocation", f"{self.root}/state")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        self.merge()

    def version(self) -> DataFrame:
        """Rows of the last version, ``upto`` the last batch in it."""
        rows = log.table(self.spark, f"{self.root}/data", f"{_SCHEMA}, version long")
        return rows.where(F.col("version") == self.commits.last()).drop("version")

    def _parts(self) -> DataFrame:
        """The last version and the partials behind it."""
        last = self.version()
        upto = last.agg(F.coalesce(F.max("upto"), F.lit(-1))).head()[0]
        parts = log.table(self.spark, f"{self.root}/partials", _SCHEMA)
        return last.unionByName(parts.where(F.col("upto") > upto))

    def merge(self) -> None:
        parts = self._parts()
        upto = parts.agg(F.max("upto")).head()[0]
        if upto is None:
            return
        version = self.commits.last() + 1
        rows = merged(parts).withColumn("upto", F.lit(upto).cast("long"))
        rows.write.mode("overwrite").parquet(self.commits.data_path(version))
        self.commits.add(version)

    def read(self) -> DataFrame:
        """The histogram of all rows so far, open windows included."""
        return merged(self._parts())
