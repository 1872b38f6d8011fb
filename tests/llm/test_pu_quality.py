"""Held-out accuracy, the prior, and odd input."""

import random
import zlib

import numpy as np

from pageframe.llm import pu_quality as P
from pageframe.llm.queries import op10_pu_quality


def make(rng, good):
    n = rng.randint(30, 120)
    words = ["".join(rng.choices("aeioutnrsl", k=rng.randint(2, 9))) for _ in range(n)]
    if not good:
        kind = rng.randrange(3)
        words = [w.upper() + "!!" if kind == 0 else w + "###" if kind == 1 else f"| {w}" for w in words]
    return " ".join(words) + "."


def test_query_ranks_held_out_rows(spark, folder):
    rng = random.Random(8)
    truth = {i: int(rng.random() < 0.8) for i in range(1500)}
    rows = [(i, make(rng, g)) for i, g in truth.items()] + [(9000, None), (9001, ""), (5, make(rng, truth[5]))]
    labels = [(i, g, 0) for i, g in truth.items() if i % 2] + [(9000, None, 1), (None, 1, 0)]
    out = op10_pu_quality(spark, folder(rows, labels=(labels, "doc_id long, quality int, toxic int"))).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held)
    assert right > 0.93


def test_prior_and_risk_on_known_shares():
    rng = np.random.default_rng(3)
    p = rng.normal(2, 1, (4000, 5))
    u = np.vstack([rng.normal(2, 1, (2800, 5)), rng.normal(-2, 1, (1200, 5))])[rng.permutation(4000)]
    assert abs(P.estimated_prior(p, u) - 0.7) < 0.06
    w, b = P._descend(p, u, 0.7)
    assert (p @ w + b > 0).mean() > 0.95 and (rng.normal(-2, 1, (999, 5)) @ w + b < 0).mean() > 0.95


def test_nothing_to_learn_from(spark, table):
    docs = table([(1, "some text"), (None, None)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    from pyspark.sql import functions as F

    model = P.trained(docs, none, F.lit(True))
    assert [r["score"] for r in P.scored(docs, model).collect()] == [0.5, 0.5]
    assert P.scored(table([]), model).count() == 0
