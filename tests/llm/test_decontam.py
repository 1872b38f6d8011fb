"""Templates: verbatim and re-parameterised items are found, mixed values and clean texts are not."""

import random

import pytest

from pageframe.llm import decontam as D

ITEM = "a train leaves Paris at 9 km from the old bridge and meets Anna after 9 km of fast travel near the river"
OTHER = "the little brown fox was seen by many hunters in woods that nobody owned before winter came"


@pytest.fixture
def items(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string, id string, slots int")


def found(docs, items, **kw):
    rows = D.matches(docs, items, **kw).where("contaminated").collect()
    return sorted((r["doc_id"], r["item_id"]) for r in rows)


def make(rng, n):
    return " ".join(rng.choices("alpha beta gamma delta of the in on Mary 7 12 cm lamp tree".split(), k=n))


@pytest.mark.parametrize("most", [D.MOST_HASHES, 0])
def test_cases(table, items, most):
    rng = random.Random(2)
    swapped = ITEM.replace("Paris", "Rome").replace("9", "15").replace("Anna", "Bob")
    mixed = ITEM.replace("9", "15", 1)
    docs = table([
        (1, "before it. " + ITEM + ". after"), (2, make(rng, 40) + " " + swapped + " " + make(rng, 9)),
        (3, "x " + mixed + " y"), (4, make(rng, 300)), (5, None), (6, ""), (7, OTHER.upper() + "!\n" + ITEM),
        (8, OTHER), (8, OTHER), (9, " ".join(ITEM.split()[:13])), (10, "short one here"), (None, OTHER),
    ])
    bench = items([(1, ITEM, "", 1), (2, OTHER, "", 1), (2, OTHER, "", 1), (3, None, "", 1), (4, "", "", 1),
                   (5, "Short one here", "", 1), (6, OTHER, "", 1)])
    got = found(docs.where("doc_id is not null"), bench, most_hashes=most)
    assert got == [(1, 1), (2, 1), (7, 1), (7, 2), (7, 6), (8, 2), (8, 6), (10, 5)]
    kept = D.clean_rows(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6, 9]


def test_equals_brute_force_on_verbatim_windows(table, items):
    rng = random.Random(4)
    vocab = [f"word{k}" for k in range(30)]
    texts = {i: rng.choices(vocab, k=rng.randint(15, 30)) for i in range(8)}
    docs = {}
    for i in range(60):
        w, k = rng.choices(vocab, k=rng.randint(0, 30)), rng.randrange(8)
        lo, hi = sorted(rng.sample(range(len(texts[k]) + 1), 2))
        docs[i] = w + texts[k][lo:hi] + rng.choices(vocab, k=5)

    def grams(w):
        return [tuple(w[j : j + D.WINDOW]) for j in range(len(w) - D.WINDOW + 1)]

    want = sorted(
        (i, k)
        for i, w in docs.items()
        for k, t in texts.items()
        if sum(g in set(grams(w)) for g in grams(t)) >= D.LEAST_COVERED * len(grams(t))
    )
    got = found(table([(i, " ".join(w)) for i, w in docs.items()]), items([(k, " ".join(t), "", 1) for k, t in texts.items()]))
    assert got == want and want


def test_empty(table, items):
    assert found(table([]), items([(1, ITEM, "", 1)])) == [] and found(table([(1, ITEM)]), items([])) == []


def test_names_at_sentence_starts_and_copies_in_other_case(table, items):
    tom = "Tom has 5 red apples. Tom buys 3 more apples. Tom gives 2 to Ann. How many apples does Tom have now?"
    bob = tom.replace("Tom", "Bob").replace("Ann", "Eve").replace("5", "7")
    mixed = tom.replace("Tom buys", "Bob buys")
    docs = table([(1, bob), (2, ITEM.lower()), (3, ITEM.upper()), (4, tom.lower()), (5, mixed), (6, tom)])
    bench = items([(1, tom, "", 1), (2, ITEM, "", 1)])
    assert found(docs, bench) == [(1, 1), (2, 2), (3, 2), (4, 1), (6, 1)]


def _plain_token(word):
    """The rules read one after another, by the patterns."""
    core = D._EDGE.sub("", word)
    ends = word.rstrip("\"')]»”")[-1:] in ".!?:;"
    if word == "\0":
        return D.BREAK, True
    if not core:
        return D.NOTHING, ends
    if D._NUMBER.match(core):
        return D.NUMBER, ends
    if core.lower() in D.UNITS:
        return D.UNIT, ends
    if D._NAME.match(core) and core[0].isupper() and not core.isupper():
        return (D.STARTER if core.lower() in D.FUNCTION_WORDS else D.NAME), ends
    return D.LITERAL, ends


def test_words_of_letters_need_no_pattern(monkeypatch):
    rng = random.Random(4)
    parts = ["a", "The", "Zoë", "KM", "km", "3", "5.5", "$", "%", ".", ",", ":", "?", "_", "'", '"', ")", "ª", "²", "ß", "ǅ", "日", "x"]
    words = ["\0", ".", ",", "!", "Is.", "km,", "Rome;"] + ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(4000)]
    for word in words:
        kind, ends = _plain_token(word)
        packed = D._token(word)
        assert (packed >> 1 & 7, packed & 1) == (kind, int(ends)), word
        if core := D._EDGE.sub("", word):
            assert packed >> 4 == D._token(core) >> 4
    before = [D._token(w) for w in ("Paris", "paris,", "ended.")]
    monkeypatch.setattr(D, "_EDGE", None)
    assert [D._token(w) for w in ("Paris", "paris,", "ended.")] == before
