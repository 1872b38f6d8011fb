"""The mix against a plain version; targets, budgets, copies and odd input."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from pageframe.llm import source_mix as M
from pageframe.llm.queries import op13_source_mix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, taken int, key string"


def fair(sizes, weights, share):
    """Targets by resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, full = dict.fromkeys(names, 0.0), set()
    left = share * sum(sizes.values())
    while left > 1e-9:
        rest = sum(weight[s] for s in names if s not in full)
        for s in names:
            if s not in full:
                target[s] += left * weight[s] / rest
        left = 0.0
        for s in names:
            if s not in full and target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s], _ = 2.0 * sizes[s], full.add(s)
    return target


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, 5, 6, "k") for i, t, s in rows], SCHEMA)


def make_rows(seed=4):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(["word", "x9#", "über", "it's"]) for _ in range(n))
    rows = [(i, text(rng.randint(0, 60)), rng.choice(["a", "a", "a", "a", "b", "Z", "é", None])) for i in range(300)]
    return rows + [(900, text(20_000), "long"), (901, None, "none"), (902, "", "b"), (None, text(9), "b"), rows[0], rows[0]]


@pytest.mark.parametrize("weights, share", [((3, 1, 2), 1.5), ((1,), 2.0), ((1, 50), 0.4)])
def test_targets_and_budgets(spark, weights, share):
    rows = make_rows()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want = fair(sizes, weights, share)
    got = M.mixed(docs(spark, rows), weights, share).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, size(t)) for i, t, _ in rows)
    source = {(i, size(t)): s for i, t, s in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s], abs=1e-6)
        assert 0 <= r["taken"] <= 2 * r["size"]
        epochs = math.floor(r["target"] / sizes[s] + 1e-12) if sizes[s] else 0
        assert r["taken"] >= epochs * r["size"]  # complete epochs come first
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    partial = [r for r in got if r["size"] and r["taken"] % r["size"]]
    assert len(partial) <= len(sizes)  # one document a source is cut


def test_good_documents_come_first_more_often(spark):
    rows = [(i, "plain words here " * 5 if i % 2 else "1 # 2 $ 3 @ 4 % 5 ^ 6 & 7 * " * 1, "a") for i in range(2000)]
    got = M.mixed(docs(spark, rows), share=0.3).collect()
    kept = Counter(r["doc_id"] % 2 for r in got if r["taken"])
    assert kept[1] > 3 * kept[0] > 0
    even = M.mixed(docs(spark, rows), share=0.3, weight=F.lit(1)).collect()
    kept = Counter(r["doc_id"] % 2 for r in even if r["taken"])
    assert 0.8 < kept[1] / kept[0] < 1.25


def test_reruns_agree_and_sql_gives_the_same(spark, folder, tmp_path):
    path = "/root/testdata/sf0.001"
    rows = sorted(map(tuple, op13_source_mix(spark, path).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    again = sorted(map(tuple, op13_source_mix(spark, path).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert rows == again
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    assert sorted(con.sql(M.duckdb_sql()).fetchall()) == rows


def test_sql_on_odd_rows(spark, tmp_path):
    docs(spark, make_rows(9)).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in op13_source_mix(spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(M.duckdb_sql()).fetchall()
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_copies_hold_what_is_taken(spark):
    rows = [(i, f" one  two\nthree four{i} ", "a" if i < 7 else "b") for i in range(10)] + [(99, None, "a")]
    table = docs(spark, rows).drop("taken", "size")
    mix = M.mixed(table)
    got = M.copies(table, mix)
    assert got.columns == [*table.columns, "copy"]
    words = Counter()
    for r in got.collect():
        words[r["doc_id"]] += len(r["text"].split())
        assert rows[r["doc_id"]][1].strip().startswith(r["text"].strip())
    assert words == Counter({r["doc_id"]: r["taken"] for r in mix.collect() if r["taken"]})


def test_empty_tables(spark):
    assert M.mixed(docs(spark, [])).count() == 0
    got = M.mixed(docs(spark, [(1, None, None), (2, "", "a")])).collect()
    assert sorted((r["doc_id"], r["target"], r["taken"]) for r in got) == [(1, 0.0, 0), (2, 0.0, 0)]
