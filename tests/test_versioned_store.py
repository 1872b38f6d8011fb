"""The versioned store: equal to the plain upsert, old versions untouched, no stored row shuffled."""

import os
import random

import pytest
from pyspark.sql import functions as F

from pageframe.operators import store as ST
from pageframe.operators import versioned_store as V

SCHEMA = "cache_key string, value string, ts timestamp"


def rows(spark, seed, n, keys):
    rng = random.Random(seed)
    data = [(f"k{rng.randrange(keys)}", f"v{seed}-{i}", f"2024-01-01 00:{rng.randrange(60):02d}:{i % 60:02d}") for i in range(n)]
    return spark.createDataFrame(data, "cache_key string, value string, ts string").withColumn("ts", F.to_timestamp("ts"))


def content(df):
    return sorted(map(tuple, df.select("cache_key", "value", "ts").collect()))


@pytest.mark.parametrize("most", [V.shared.MOST_KEYS, 5])
def test_equals_the_plain_upsert(spark, tmp_path, most):
    store = V.VersionedStore(spark, str(tmp_path / "s"), SCHEMA, buckets=8, most_keys=most)
    assert store.read().count() == 0
    plain, seen = spark.createDataFrame([], SCHEMA), {}
    for k, n in enumerate([60, 1, 25]):
        new = rows(spark, k, n, 40)
        assert store.upsert(new) == k + 1
        plain = spark.createDataFrame(ST.upsert_store(plain, new).collect(), SCHEMA)
        seen[k + 1] = content(store.read())
        assert seen[k + 1] == content(plain)
    for version, was in seen.items():  # a reader of version n is untouched by n + 1
        assert content(store.read(version)) == was


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = V.VersionedStore(spark, str(tmp_path / "s"), SCHEMA, buckets=8)
    store.upsert(rows(spark, 1, 200, 100))
    assert store.upsert(rows(spark, 2, 1, 100)) == 2
    assert len([f for f in os.listdir(tmp_path / "s/data/version=2") if f.startswith("bucket=")]) == 1
    assert sorted(set(store.manifest().values())) == [1, 2]


def test_stored_rows_are_not_shuffled(spark, tmp_path):
    store = V.VersionedStore(spark, str(tmp_path / "s"), SCHEMA, buckets=8)
    store.upsert(rows(spark, 1, 200, 100))
    new = rows(spark, 2, 3, 100).withColumn("bucket", store.bucket())
    stays, _ = store.merged(store.manifest(), new)
    plan = stays._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SinglePartition" not in plan


def test_a_run_that_dies_leaves_no_trace(spark, tmp_path):
    store = V.VersionedStore(spark, str(tmp_path / "s"), SCHEMA, buckets=4)
    store.upsert(rows(spark, 1, 20, 10))
    was, add = content(store.read()), store.commits.add
    store.commits.add = lambda version: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        store.upsert(rows(spark, 3, 8, 10))  # into other buckets, too, than the repeated run
    assert content(store.read()) == was
    store.commits.add = add
    store.upsert(rows(spark, 2, 5, 10))
    again = V.VersionedStore(spark, str(tmp_path / "t"), SCHEMA, buckets=4)
    again.upsert(rows(spark, 1, 20, 10))
    again.upsert(rows(spark, 2, 5, 10))
    assert content(store.read()) == content(again.read())


def test_empty_upsert_and_equal_times(spark, tmp_path):
    store = V.VersionedStore(spark, str(tmp_path / "s"), SCHEMA, buckets=4)
    assert store.upsert(spark.createDataFrame([], SCHEMA)) == 1 and store.read().count() == 0
    one = rows(spark, 1, 1, 1)
    store.upsert(one)
    store.upsert(one.withColumn("value", F.lit("newer")))
    store.upsert(one.withColumn("value", F.lit("older")).withColumn("ts", F.col("ts") - F.expr("INTERVAL 1 HOUR")))
    assert [r["value"] for r in store.read().collect()] == ["newer"]
