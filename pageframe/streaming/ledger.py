"""Files that land in a folder, each worked on once: the full page plan over arriving pages.

The ledger has a row per landed file that a version has claimed.  A run lists the folder,
leaves out what is claimed (an anti-join), claims the oldest files that are left, writes what the
plan gives for them as that version and commits it.  A run that finds a claim without a commit
goes on with that very claim and writes over what the dead run has left.  So a repeated run adds
nothing, and several runs over a growing folder give what one batch over all of it would.

A file is written once under its name, as for file streams.  Listing reads names only; the
names of one version reach the driver, as for any read of a list of files, and
``files_per_version`` bounds them: more files make more versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageframe.plans.pages import extract_pages
from pageframe.sources import log

Plan = Callable[[DataFrame], DataFrame]
FILES_PER_VERSION = 1000
_CLAIM = "version long, path string, length long, landed timestamp"


def landed(spark: SparkSession, folder: str, file_glob: str = "*.parquet") -> DataFrame:
    """(path, length, landed) of the files of a folder; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", file_glob).option("recursiveFileLookup", "true")
    return files.load(folder).select("path", "length", F.col("modificationTime").alias("landed"))


class Ledger:
    """What has been done with a folder's files; all of it lies under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.commits = log.Commits(spark, root)

    def claims(self) -> DataFrame:
        return log.table(self.spark, f"{self.root}/claims", _CLAIM)

    def claim(self, files: DataFrame, most: int) -> int | None:
        """The version to work on: one that was claimed and not committed, else a new one."""
        open_ = self.claims().join(F.broadcast(self.commits.frame()), "version", "left_anti")
        version = open_.agg(F.min("version")).head()[0]
        if version is not None:
            return version
        fresh = files.join(self.claims(), "path", "left_anti").orderBy("landed", "path").limit(most)
        version = self.commits.last() + 1
        rows = fresh.select(F.lit(version).cast("long").alias("version"), "path", "length", "landed")
        if rows.isEmpty():
            return None
        log.append(rows, f"{self.root}/claims")
        return version

    def run(self, folder: str, plan: Plan, read: Callable[[list[str]], DataFrame] | None = None,
            file_glob: str = "*.parquet", files_per_version: int = FILES_PER_VERSION) -> int:
        """Work on all that has landed; gives the number of versions written."""
        read = read or (lambda paths: self.spark.read.parquet(*paths))
        written = 0
        while (version := self.claim(landed(self.spark, folder, file_glob), files_per_version)) is not None:
            paths = [r["path"] for r in self.claims().where(F.col("version") == version).collect()]
            plan(read(paths)).write.mode("overwrite").parquet(self.commits.data_path(version))
            self.commits.add(version)
            written += 1
        return written

    def rows(self, schema: str) -> DataFrame:
        """All committed rows, with their ``version``."""
        return self.commits.data(schema)


def extract_arrivals(spark: SparkSession, folder: str, root: str, file_glob: str = "*.parquet", **options) -> DataFrame:
    """Extract the pages that have landed since the last run; gives all pages extracted so far.
    ``options`` go to :func:`extract_pages`."""
    ledger = Ledger(spark, root)
    ledger.run(folder, lambda pages: extract_pages(pages, **options), file_glob=file_glob)
    shape = extract_pages(spark.createDataFrame([], "page_id long, url string, html string"), **options).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape)
    return ledger.rows(fields).drop("version")
