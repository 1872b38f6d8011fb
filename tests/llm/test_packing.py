"""Packing: every token is packed once, gapless, tightly, against plain encoding."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa

from pageframe.llm import packing as P
from pageframe.llm import tokens as T
from pageframe.llm.queries import op3_best_fit_packing

COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def make_texts():
    rng = random.Random(3)
    words = "the of and zoology re-entry ñandú 12,5 déjà 𝔘 x".split()
    sizes = [0, 1, 5, 2000, 9000] + [int(rng.paretovariate(0.9) * 20) for _ in range(200)]
    return [" ".join(rng.choices(words, k=min(n, 9000))) for n in sizes] + [None, "", " \n", "a  b"]


def check(rows, texts, capacity):
    enc = T.Encoder(T.tokenizer_path())
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    total = 0
    for i, text in texts.items():
        ids = enc.whole([text or ""])[0] + b"\0\0\0\0"
        total += len(ids) // 4
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(parts):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + r["length"])])
            assert r["length"] == capacity or k == 0
            at += r["length"]
        assert at == len(ids) // 4
    for rs in by_bin.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_bin), math.ceil(total / capacity)


def test_query_packs_every_token_tightly(spark, folder):
    texts = dict(enumerate(make_texts()))
    out = op3_best_fit_packing(spark, folder(list(texts.items())))
    assert out.columns == COLUMNS
    bins, least = check(out.collect(), texts, P.CAPACITY)
    assert bins <= least + 2


def test_few_open_bins_and_real_ids(table):
    texts = dict(enumerate(make_texts()))
    docs = table(list(texts.items())).repartition(5)
    rows = P.packed(docs, capacity=64, most_open=3, with_ids=True).collect()
    check(rows, texts, 64)
    for r in rows:
        assert len(np.frombuffer(r["ids"], "<u4")) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]


def test_odd_rows(table):
    assert P.packed(table([])).count() == 0
    rows = P.packed(table([(1, "a"), (1, "a"), (None, None)])).collect()
    assert sorted(r["length"] for r in rows) == [1, 2, 2] and len({r["sequence_id"] for r in rows}) == 1


def test_fullest_bin_closes_first():
    fit = P.BestFit(10, 2)
    assert [fit.put(n) for n in (6, 7, 9)] == [(0, 0), (1, 0), (2, 0)]
    assert fit.still_open() == {0: 4, 2: 1}  # bin 1 had less room than bin 0
    assert fit.put(4) == (0, 6) and fit.put(2) == (3, 0)


def test_few_texts_are_encoded_at_once(monkeypatch):
    sizes = []

    class Spy:
        def encode(self, texts):
            sizes.append(len(texts))
            return [bytes(4 * len(t)) for t in texts]

    class Task:
        get = classmethod(lambda cls: cls)
        partitionId = classmethod(lambda cls: 0)

    monkeypatch.setattr(P, "encoder", lambda path: Spy())
    monkeypatch.setattr(P, "TaskContext", Task)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(4100)), "text": ["x" * (k % 50) for k in range(4100)]})
    out = list(P._pack_task("", 64, 8, 0, False, 250)(iter([batch])))
    rows = sorted((r["doc_id"], r["length"]) for b in out for r in b.to_pylist())
    assert rows == [(k, k % 50 + 1) for k in range(4100)]
    assert sum(sizes) == 4100 and max(sizes) <= 250
