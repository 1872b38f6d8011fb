"""All links of near copies against brute force, and odd input."""

import random

import numpy as np
import pyarrow as pa

from pageframe.llm import ngram_join as J
from pageframe.llm import tokens as T
from pageframe.llm.queries import op1_ngram_jaccard_join


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())


def brute(texts):
    sets = {i: grams(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def family(rng, size, words, edits):
    vocab = [f"w{k}" for k in range(400)]
    base = rng.choices(vocab, k=words)
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if rng.random() < 0.5:
            w = w[: rng.randint(int(0.85 * len(w)), len(w))]
        yield " ".join(w)


def make_texts():
    rng = random.Random(11)
    shared = "this passage of ten words is in very many texts "
    out = [None, "", " \n", "one", "one", "One", "one two", "a b c d e", "A b C d e f", "a b c d e f g"]
    for _ in range(12):
        out += family(rng, 6, rng.choice([12, 40, 90]), 3)
    out += list(family(rng, 60, 60, 4))
    out += [shared + " ".join(rng.choices("xyzuvw", k=8)) for _ in range(60)]
    out += [t.upper() for t in out[12:30] if t]
    rng.shuffle(out)
    return out


def test_query_equals_brute_force(spark, folder):
    texts = {i * 3 + 5: t for i, t in enumerate(make_texts())}
    out = op1_ngram_jaccard_join(spark, folder(list(texts.items())))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()}
    assert got == brute(texts)


def test_blocks_of_a_task_do_not_change_the_result(table, monkeypatch):
    texts = dict(enumerate(make_texts()[:150]))
    docs = table(list(texts.items())).repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in J.linked_documents(docs).collect()}
    assert got == {i: c for i, (_, c) in brute(texts).items()}


def test_odd_rows(table):
    assert J.linked_documents(table([])).count() == 0
    same = "a b c d e f g h i j"
    rows = J.linked_documents(table([(7, same), (7, same), (9, same), (None, same), (None, None), (3, None)])).collect()
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in rows)
    assert got == [("3", 0, "3"), ("7", 6, "7"), ("7", 6, "7"), ("9", 6, "7"), ("None", 0, "None"), ("None", 6, "7")]


def test_links_lose_no_pair_of_different_texts(table):
    texts = dict(enumerate(make_texts()[:120]))
    pairs, members = J.links(table(list(texts.items())))
    rows = members.collect()
    docs_of = {}
    for r in rows:
        docs_of.setdefault(r["class_id"], []).append(r["doc_id"])
    sets = {i: grams(t) for i, t in texts.items()}
    got = {(x, y) for r in pairs.collect() for x in docs_of[r["a"]] for y in docs_of[r["b"]]}
    want = {
        (a, b) for a in texts for b in texts
        if sets[a] != sets[b] and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    }
    assert want and {frozenset(p) for p in got} == {frozenset(p) for p in want}
    for r in rows:
        near = {frozenset(sets[b]) for a, b in want if a == r["doc_id"]}
        assert r["n_links"] == (len(near) if sets[r["doc_id"]] else None)


def test_a_task_ends_what_another_kind_of_task_remembers():
    T.encoder(T.tokenizer_path()).encode(["some words to remember"])
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, None], "text": ["a b c d e f", None, ""]})
    assert list(J._measure(J.gram_rows(5), 4)(iter([batch])))
    assert not T._ENCODERS


def test_every_block_gets_its_own_n_grams():
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 60))) for _ in range(300)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "text": texts})
    every = set(np.concatenate(J.shingle_sets(texts)).tolist())
    for buckets in (1, 3, 7, 64, 211):
        for most in (None, 2000):
            found = set()
            for out in J._measure(J.gram_rows(5), buckets, most)(iter([batch])):
                for row in out.to_pylist():
                    if row["grams"] is not None:
                        grams = np.cumsum(J._unpacked(row["grams"], np.uint64))
                        assert {(int(g) >> 40) * buckets >> 16 for g in grams} == {row["bucket"]}
                        found.update(grams.tolist())
                    elif row["gram"] is not None:
                        assert (row["gram"] >> 40) * buckets >> 16 == row["bucket"] and row["gram"] in every
            assert found == every
