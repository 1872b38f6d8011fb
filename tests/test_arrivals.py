"""The ledger of landed files and the complete histogram: repeated, broken and late runs."""

import pytest
from pyspark.sql import functions as F

from pageframe import constants as K
from pageframe.operators import metrics as X
from pageframe.plans.pages import extract_pages
from pageframe.streaming import histogram as H
from pageframe.streaming import ledger as L

SCHEMA = "page_id long, url string, html string"


def land(spark, folder, *numbers):
    for n in numbers:
        rows = [(10 * n + k, f"https://ex.com/{n}/{k}", f"<title>t{n}</title><p>page {n} {k}<p>end") for k in range(3)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def texts(df):
    return sorted((r["page_id"], r["markdown"], r["metadata"]["title"]) for r in df.collect())


def test_runs_over_a_growing_folder_equal_one_batch(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, folder, 1, 2)
    first = L.extract_arrivals(spark, folder, root)
    assert len(first.collect()) == 6
    land(spark, folder, 3)
    for _ in range(2):  # the second run finds nothing new
        got = L.extract_arrivals(spark, folder, root)
        assert texts(got) == texts(extract_pages(spark.read.parquet(folder)))
    assert got.schema.simpleString() == extract_pages(spark.read.parquet(folder)).schema.simpleString()
    assert L.Ledger(spark, root).commits.last() == 2


@pytest.mark.parametrize("when", ["before", "half", "after"])
def test_a_run_that_dies_is_repeated_without_a_trace(spark, tmp_path, when):
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, folder, 1)
    ledger = L.Ledger(spark, root)

    def dies(pages):
        if when == "half":  # some rows of the version are written, then the run ends
            pages.limit(1).select("page_id", "url").write.mode("overwrite").parquet(ledger.commits.data_path(1))
        if when == "after":
            extract_pages(pages).write.mode("overwrite").parquet(ledger.commits.data_path(1))
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        ledger.run(folder, dies)
    land(spark, folder, 2)  # more files land; the claim of the dead run stays as it was
    claimed = [r["version"] for r in ledger.claims().collect()]
    got = L.extract_arrivals(spark, folder, root)
    assert claimed == [1] and texts(got) == texts(extract_pages(spark.read.parquet(folder)))
    assert {r["version"] for r in ledger.claims().collect()} == {1, 2}


def test_versions_have_a_bounded_number_of_files(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, folder, 1, 2, 3)
    ledger = L.Ledger(spark, root)
    assert ledger.run(folder, lambda p: p.select("page_id"), files_per_version=2) == 2
    rows = ledger.rows("page_id long").collect()
    assert sorted(r["page_id"] for r in rows) == [10, 11, 12, 20, 21, 22, 30, 31, 32]
    assert {r["version"] for r in rows} == {1, 2}


def test_empty_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert L.extract_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out")).count() == 0


LOG = "ts timestamp, method string, route string, code int, duration_s double"


def requests(spark, folder, *rows):
    data = spark.createDataFrame([(t, "GET", "/r", c, d) for t, c, d in rows], "ts string, " + LOG.partition(", ")[2])
    data.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(folder)


def test_windows_are_complete_open_or_late(spark, tmp_path):
    folder, root = str(tmp_path / "log"), str(tmp_path / "hist")
    table = H.WindowTable(spark, root)

    def check():
        table.run(spark.readStream.schema(LOG).parquet(folder))
        want = X.duration_histogram(spark.read.parquet(folder), F.window("ts", "1 hour").alias("window"))
        columns = ["window", "method", "route", "code", *[c for c in want.columns if c.startswith(("le_", "duration"))]]
        key = lambda r: str(r[:4])
        got = sorted((tuple(r) for r in table.read().select(columns).collect()), key=key)
        assert got == sorted((tuple(r) for r in want.select(columns).collect()), key=key)
        return got

    requests(spark, folder, ("2024-01-01 10:10:00", 200, 0.05), ("2024-01-01 10:20:00", 200, 40.0), ("2024-01-01 11:59:00", 500, 2.0))
    assert len(check()) == 2  # both windows are still open
    assert len(K.DURATION_BUCKETS) == 10
    # far later, then far too late for any watermark
    requests(spark, folder, ("2024-03-01 00:00:00", 200, 1.0))
    requests(spark, folder, ("2024-01-01 10:30:00", 200, None), ("2024-01-01 10:40:00", 200, 0.25))
    rows = check()
    assert len(rows) == 3 and rows[0][-1] == 3
    assert check() == rows  # nothing new
    assert table.commits.last() == 3


def test_a_merge_that_was_not_committed_counts_once(spark, tmp_path):
    folder, root = str(tmp_path / "log"), str(tmp_path / "hist")
    requests(spark, folder, ("2024-01-01 10:10:00", 200, 0.05))
    table = H.WindowTable(spark, root)
    table.commits.add = lambda version: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        table.run(spark.readStream.schema(LOG).parquet(folder))
    table = H.WindowTable(spark, root)
    assert [r["duration_count"] for r in table.read().collect()] == [1]
    table.run(spark.readStream.schema(LOG).parquet(folder))
    assert [r["duration_count"] for r in table.read().collect()] == [1]
