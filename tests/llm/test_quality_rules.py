"""The rules against a plain Python version and against DuckDB."""

import random
import re

import duckdb

from pageframe.llm import quality_rules as Q
from pageframe.llm.queries import op9_quality_rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def measure(text):
    text = text or ""
    w = WORDS.findall(text)
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    repeated = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed


def plain(text):
    n, chars, symbols, dups, _, failed = measure(text)
    if failed:
        return False
    text = text or ""
    w, lines = WORDS.findall(text), [x for x in text.split("\n") if WORDS.search(x)]
    stop = set(Q._stop_word_set())
    letters = sum(c.isalpha() for c in text)
    value = {
        "mean_word_chars": chars / n,
        "symbols_per_word": symbols / n,
        "stop_word_share": sum(x in stop for x in w) / n,
        "upper_share": sum(c.isupper() for c in text) / max(letters, 1),
        "shouted_share": text.count("!") / n,
        "dup_line_share": dups / len(lines),
        "echo_share": sum(a == b for a, b in zip(w, w[1:])) / n,
        "mean_line_chars": chars / len(lines),
    }
    return all((r.lower is None or value[r.metric] >= r.lower) and (r.upper is None or value[r.metric] <= r.upper) for r in Q.RULES)


def make_texts():
    rng = random.Random(4)
    out = [None, "", "\n \t\x0b", "x " * 40, "the\n" * 30, "a b c d e f g h " * 3 + "the end of it all is here " * 2, "the wörd " * 4]
    for _ in range(120):
        vocab = rng.choice([["a", "b"], list("abcdefghij"), ["The", "of", "word#", "x|y", "UP!", "éß", "line\n", "\n", "<b>"]])
        out.append(rng.choice(["", " ", "\n"]) + " ".join(rng.choices(vocab, k=rng.randint(0, 90))))
    return out


def test_query_equals_plain_version_and_duckdb(spark, folder):
    texts = make_texts()
    sf = folder(list(enumerate(texts)))
    got = {r["doc_id"]: tuple(r)[1:] for r in op9_quality_rules(spark, sf).collect()}
    assert got == {i: (*measure(t), plain(t)) for i, t in enumerate(texts)}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    assert {r[0]: r[1:] for r in con.sql(Q.duckdb_sql()).fetchall()} == got


def test_kept_rows_keep_columns(table):
    good = "the morning light was seen by all of us in the small green valley near a river that ran on and on to sea"
    docs = table([(1, good), (1, good), (2, None), (None, good + " x")])
    out = Q.kept_rows(docs)
    assert out.columns == docs.columns and out.count() == 3
    assert Q.kept_rows(table([])).count() == 0
