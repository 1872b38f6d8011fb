"""The extraction store in buckets of keys, with a manifest for each version.

A version's manifest names, for every bucket, the version whose folder holds its rows.  An
upsert reads and writes only the buckets that its keys fall into; all others stay where they
are and the next manifest points to them.  Nothing is changed in place, so who reads version
n sees the same rows whatever comes later, and what a run that died has left behind is in no
manifest that counts.

Stored rows are never shuffled: the upsert's keys and times go to the tasks that read the
buckets, at most ``MOST_KEYS`` of them at once.  A larger upsert is worked off bucket by bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageframe.operators.store import latest_per_key
from pageframe.sources import log, shared

BUCKETS = 64
KEY, TIME = "cache_key", "ts"


class VersionedStore:
    """All versions of a store under ``root``.  One writer at a time."""

    def __init__(self, spark: SparkSession, root: str, schema: str, buckets: int = BUCKETS, most_keys: int = shared.MOST_KEYS):
        self.spark, self.root, self.schema = spark, root, schema
        self.buckets, self.most_keys = buckets, most_keys
        self.commits = log.Commits(spark, root)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(KEY), F.lit(self.buckets)).cast("int")

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """Bucket to the version that holds its rows; at most one entry per bucket."""
        version = self.commits.last() if version is None else version
        rows = log.table(self.spark, f"{self.root}/manifests/version={version}", "bucket int, owner long")
        return {r["bucket"]: r["owner"] for r in rows.collect()}

    def _rows(self, owners: dict[int, int]) -> DataFrame:
        if not owners:
            return self.spark.createDataFrame([], f"{self.schema}, bucket int")
        data = f"{self.root}/data"
        paths = [f"{data}/version={v}/bucket={b}" for b, v in sorted(owners.items())]
        read = self.spark.read.schema(f"{self.schema}, version long, bucket int").option("basePath", data)
        return read.parquet(*paths).drop("version")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the last."""
        return self._rows(self.manifest(version)).drop("bucket")

    def merged(self, owners: dict[int, int], new: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(stored rows that stay, new rows that count) of some buckets.  A new row counts if none is
        stored that is later, and then replaces what is."""
        old = self._rows(owners)
        keys = F.broadcast(new.select(KEY, F.col(TIME).alias("_new")))  # counted by the caller
        later = F.col("_new") >= F.col(TIME)
        stays = old.join(keys.withColumnRenamed(KEY, "_key"), (F.col(KEY) == F.col("_key")) & later, "left_anti")
        known = old.join(keys, KEY).where(~later).select(KEY)  # one row per new key at most
        return stays, new.join(known, KEY, "left_anti")

    def upsert(self, rows: DataFrame) -> int:
        """Take in rows and give the new version's number; of rows of one key the latest counts."""
        version, owners = self.commits.last() + 1, self.manifest()
        fields = self.spark.createDataFrame([], self.schema).columns
        new = latest_per_key(rows.select(*fields), KEY, F.col(TIME).desc())
        new = shared.cut_lineage(new.withColumn("bucket", self.bucket()))
        counts = {r["bucket"]: r["count"] for r in new.groupBy("bucket").count().collect()}
        written, mode = f"{self.root}/data/version={version}", "overwrite"
        group: list[int] = []
        for k, bucket in enumerate(sorted(counts)):
            group.append(bucket)
            following = sorted(counts)[k + 1 :][:1]
            if following and sum(counts[b] for b in [*group, *following]) <= self.most_keys:
                continue
            part = new.where(F.col("bucket").isin(group))
            stays, counted = self.merged({b: owners[b] for b in group if b in owners}, part)
            stays.unionByName(counted).write.mode(mode).partitionBy("bucket").parquet(written)
            mode, group = "append", []
        owners = owners | dict.fromkeys(counts, version)
        listed = self.spark.createDataFrame(list(owners.items()), "bucket int, owner long")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifests/version={version}")
        self.commits.add(version)
        return version
