"""Spelling variants against brute force over all pairs of words; odd input."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from pageframe.llm import spelling as S
from pageframe.llm.queries import op12_spelling_variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_words(rows):
    counts = Counter()
    for i, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def make_words(seed, n, alphabet="abcé"):
    rng = random.Random(seed)
    words = {"".join(rng.choices(alphabet, k=rng.randint(5, 8))) for _ in range(n)}
    for w in list(words)[: n // 2]:
        i = rng.randrange(len(w))
        words |= {w[:i] + w[i + 1 :], w[:i] + rng.choice(alphabet) + w[i:], w[:i] + rng.choice(alphabet) + w[i + 1 :]}
    return {w: rng.randint(3, 60) for w in sorted(words) if len(w) >= 5}


@pytest.mark.parametrize("bucket_rows", [7, 24_000])
def test_equals_brute_force(spark, bucket_rows):
    """Few rows a bucket split nearly every half into slices."""
    words = make_words(bucket_rows, 150) | {"abcab" + "c" * k: 100 + k for k in range(60)} | {"z" * 3000: 3, "z" * 3001: 9}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r["word"]: tuple(r) for r in S.grouped(df, bucket_rows).collect()}
    assert got == brute(words)


def test_index_alone():
    words = sorted(make_words(3, 300))
    index = S.OneWayIndex(words)
    q, k = index.near(words)
    got = {(words[a], words[b]) for a, b in zip(q, k)} - {(w, w) for w in words}
    for a in words:
        half = (len(a) + 1) // 2
        for b in words:
            if one_edit(a, b) and b.endswith(a[-half:]):
                assert (a, b) in got
    assert all(one_edit(a, b) for a, b in got)


HAND = [
    (1, "Receive receive receive recieve RECEIVE Ärger ärger ärger ärgern Ärger receives receives receives"),
    (2, None), (3, ""), (None, "receive " * 40 + "größe größe größe"), (4, "x1receive-receiv receiv receiv"),
    (4, "x1receive-receiv receiv receiv"), (5, "ab cd ef " * 3), (6, "longest" * 2000 + " " + "longest" * 2000),
    (7, "longest" * 2000), (8, "\U0001f600hello\U0001f600hello_hello"),
]


def test_texts_and_slips(spark, folder):
    rng = random.Random(8)
    bag = ["letter", "lettre", "better", "bitter", "battle", "cattle", "Kettle", "nettle", "été-été", "naïveté"]
    rows = HAND + [(100 + i, " ".join(rng.choices(bag, k=30))) for i in range(400)]
    want = brute_words(rows)
    assert set(want) - set(Counter(w for _, t in rows for w in re.findall("[a-zÀ-ÿ]+", (t or "").lower())))  # slips
    path = folder(rows)
    got = {r["word"]: tuple(r) for r in op12_spelling_variants(spark, path).collect()}
    assert got == brute(want)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    assert sorted(con.sql(S.duckdb_sql()).fetchall()) == sorted(got.values())


def test_empty_and_clashing_columns(spark, table):
    assert S.grouped(S.vocabulary(table([], "word string, n long, half string"))).count() == 0
    docs = table([(1, "hello hello hello")], "word string, n long, half string")
    assert [tuple(r) for r in S.grouped(S.vocabulary(docs)).collect()] == [("hello", None, "hello", 3, 0, None)]
