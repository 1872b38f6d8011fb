"""Small append-only tables on shared storage that tell which versions of something count.

A version's rows are written to a folder of their own, then its number is appended to the
table of commits.  Readers keep rows whose version is committed, so what a run that died has
left behind is never read, and a repeated run writes over it.  One writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a table that may not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append(rows: DataFrame, path: str) -> None:
    """One job, one file: the rows are there all or not at all."""
    rows.coalesce(1).write.mode("append").parquet(path)


class Commits:
    """The versions under ``root`` that count."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def frame(self) -> DataFrame:
        return table(self.spark, f"{self.root}/commits", "version long")

    def last(self) -> int:
        """0 before the first."""
        return self.frame().agg(F.coalesce(F.max("version"), F.lit(0))).head()[0]

    def add(self, version: int) -> None:
        append(self.spark.range(version, version + 1).select(F.col("id").alias("version")), f"{self.root}/commits")

    def data_path(self, version: int) -> str:
        return f"{self.root}/data/version={version}"

    def data(self, schema: str) -> DataFrame:
        """Rows of the committed versions, with their ``version``."""
        rows = table(self.spark, f"{self.root}/data", f"{schema}, version long")
        return rows.join(F.broadcast(self.frame()), "version", "left_semi")  # 8 bytes a run
