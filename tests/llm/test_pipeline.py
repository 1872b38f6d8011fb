"""The whole pipeline on a small table against a plain version of its decisions."""

import random


import corpus_pipeline
from pageframe.llm import tokens as T
from tests.llm.test_ngram_join import brute as linked
from tests.llm.test_pii import brute as spans
from tests.llm.test_quality_rules import plain as rules

ITEM = "which river runs past the old mill that stood near seven tall towers in the valley of the kings"


def make_texts():
    rng = random.Random(12)
    words = "the of and river lamp stone green tall walks reads under with for night morning glass".split()
    text = lambda n: " ".join(rng.choices(words, k=n)).capitalize() + "."
    out = [text(rng.randint(25, 300)) for _ in range(40)]
    out += [" ".join(w + "###" for w in text(40).split()), "too short", "", None, "THE END!! " * 30]
    out += [out[3] + " and one more word", out[5], text(30) + " " + ITEM + ". " + text(30)]
    out += [text(30) + " mail me at jo.doe@mail.example.com or +1 (389) 555-5010 " + text(20), text(3000)]
    return dict(enumerate(out))


def test_stages_have_effect_and_lose_nothing(spark, folder):
    texts = make_texts()
    sf = folder(list(texts.items()), benchmark=([(1, ITEM)], "item_id long, text string"))
    kept = {i: t for i, t in texts.items() if rules(t)}
    kept = {i: t for i, t in kept.items() if linked(kept)[i][1] == i}
    kept = {i: t for i, t in kept.items() if ITEM not in t}
    clean = {}
    for i, t in kept.items():
        for kind, a, b in sorted(spans(t), key=lambda s: -s[1]):
            t = t[:a] + f"<{kind.upper()}>" + t[b:]
        clean[i] = t
    assert 38 < len(clean) < len(texts) - 7 and any("<EMAIL>" in t and "<PHONE>" in t for t in clean.values())
    rows = corpus_pipeline.run(spark, sf).collect()
    enc, got = T.Encoder(T.tokenizer_path()), {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        got[r["doc_id"]] = got.get(r["doc_id"], b"") + r["ids"]
    assert got == {i: enc.whole([t])[0] + b"\0\0\0\0" for i, t in clean.items()}


def test_stages_keep_columns_and_stand_empty_input(spark, folder, table):
    sf = folder([], benchmark=([(1, ITEM)], "item_id long, text string"))
    docs = table([])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0
        if name != "best_fit_packing":
            assert out.columns == docs.columns
