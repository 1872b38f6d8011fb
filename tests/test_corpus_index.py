"""Ranked search over a persisted index: equal to the full product, with far fewer rows."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pageframe.operators import corpus_index as X
from pageframe.operators import search as Q


def brute(docs, queries, k):
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    counts = {i: Counter(words(t)) for i, t in docs}
    out = []
    for q, text in queries:
        scores = sorted((-sum(c[w] for w in set(words(text))), i) for i, c in counts.items())
        out += [(q, i, -s) for s, i in scores if s < 0][:k]
    return sorted(out)


def make(seed=3, n=400):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    docs = [(i, " ".join(["The"] * rng.randint(1, 90) + rng.choices(vocabulary, weights, k=rng.randint(0, 200)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "Über über ÜBER x1_y2")]
    queries = [(i, " ".join(["the", *rng.choices(vocabulary, k=4)])) for i in range(30)]
    return docs, queries + [(100, "unknownword"), (101, ""), (102, "über"), (103, "y2 x1 x1"), (104, None), (105, "w199")]


def frames(spark, docs, queries):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, query string")


@pytest.mark.parametrize("block", [3, 512])
def test_equal_to_the_full_product(spark, block):
    docs, queries = make()
    d, q = frames(spark, docs, queries)
    index = X.build_index(d, block_postings=block)
    assert sorted(map(tuple, X.search(index, q, 10).collect())) == brute(docs, queries, 10)
    assert index.blocks.agg(F.max(F.size("postings"))).head()[0] <= 8 * block  # by hash, so not exact


def test_counts_of_a_text(spark):
    texts = ["b a B", "", None, "x" * 100_000 + " y" * 3, "1 1 2"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [[(c["term"], c["n"]) for c in r["c"]] for r in df.select("i", X.term_counts(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got == [[("a", 1), ("b", 2)], [], [], [("x" * 100_000, 1), ("y", 3)], [("1", 2), ("2", 1)]]


@pytest.mark.parametrize("n", [400, 1600])
def test_few_pairs_are_scored(spark, n):
    """Every document has 'the' and every query asks for it: the product is all pairs."""
    docs, queries = make(7, n)
    queries = queries[:30]
    d, q = frames(spark, docs, queries)
    pairs, _ = X.candidates(X.build_index(d), q, 10)
    assert pairs.count() < len(queries) * n / 4


def test_an_index_is_opened_again(spark, tmp_path):
    docs, queries = make(5, 50)
    d, q = frames(spark, docs, queries)
    X.build_index(d, str(tmp_path / "ix"))
    again = X.open_index(spark, str(tmp_path / "ix"))
    hits = Q.corpus_hits(d, q, 3, index=again)
    assert sorted((r["query_id"], r["doc_id"], r["score"]) for r in hits.collect()) == brute(docs, queries, 3)


def test_empty(spark):
    d, q = frames(spark, [], [])
    assert X.search(X.build_index(d), q).count() == 0


def test_scores_meet_words_by_equality(spark):
    """No document's counts are searched for each query's words, and an id that repeats is scored row by row."""
    docs = [(1, "a b b"), (1, "a"), (2, "b " * 50), (3, "c"), (None, "a b")]
    d, q = frames(spark, docs, [(10, "a b"), (11, "c z"), (None, "a")])
    found = X.search(X.build_index(d), q, 10)
    assert "array_contains" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(10, 1, 1), (10, 1, 3), (10, 2, 50), (11, 3, 1)]
