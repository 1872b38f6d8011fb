"""The chain: held-out accuracy, use of earlier categories, odd input."""

import random

import numpy as np
from pyspark.sql import functions as F

from pageframe.llm import toxicity as X

BAD = ["dolt", "oaf", "zany"]


def make(rng):
    words = ["".join(rng.choices("abcdefgh", k=3)) for _ in range(60)]
    toxic = rng.random() < 0.2
    if toxic:
        words[rng.randrange(60)] = rng.choice(BAD).upper()
    return " ".join(words), int(toxic)


def test_held_out_rows(spark, table):
    rng = random.Random(3)
    made = {i: make(rng) for i in range(1200)}
    docs = table([(i, t) for i, (t, _) in made.items()] + [(5000, None), (5001, ""), (7, made[7][0])])
    labels = spark.createDataFrame([(i, y, y) for i, (_, y) in made.items()] + [(5000, None, 1)], "doc_id long, insult int, all int")
    chain = X.trained(docs, labels, ["insult", "all"], F.col("id") % 4 != 0)
    out = X.scored(docs, chain).collect()
    assert len(out) == 1203
    held = [r for r in out if r["doc_id"] % 4 == 0 and r["doc_id"] in made]
    assert all((r["p_all"] >= 0.5) == bool(made[r["doc_id"]][1]) for r in held)
    assert all(r["p_all"] < 0.5 for r in out if r["doc_id"] >= 5000)


def test_earlier_categories_feed_later_ones():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2, 400)
    rows = [[1] if x else [2] for x in a]
    chain = X.fit_chain(["first", "second"], rows, np.column_stack([a, a]), np.arange(400) % 4)
    assert chain.models[1].earlier[0] > 0.05
    assert chain.logits([1])[1] > 2 and chain.logits([2])[1] < -2


def test_nothing_to_learn_from(spark, table):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    chain = X.trained(table([(1, "a")]), none, ["toxic"])
    assert X.scored(table([(1, "a"), (None, None)]), chain).where("p_toxic > 0.01").count() == 0
    assert X.scored(table([]), chain).count() == 0
