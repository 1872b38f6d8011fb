"""Toxicity categories by a classifier chain.

The categories are predicted one after another; the model of each is linear in the words of
the text (present or not, hashed) and in the log odds of all categories before it.  In
training those come from out-of-fold models: the rows are dealt into folds by their id, and a
row's earlier probabilities come from models that have not seen its fold.  For scoring each
category has one model fitted on all training rows.

Training takes at most ``SAMPLE`` labelled rows (the ids with the smallest hashes), on the
driver, with the ``WORDS`` words that tell most about each category; every row is scored, over
its whole text.

Defined results: null and empty texts have no words and get the models' base rate; null labels
are left out; without labelled rows, or with one class only, a category's probability is the
share of its positives (0 without rows); repeated rows get the same scores; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE, WORDS, FOLDS = 12_000, 1_000, 4
THRESHOLD = 0.5
#: Least standardised difference of a word's shares; less is mostly chance.
TELLING = 4.0
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        digest = hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        self[word] = h = int.from_bytes(digest, "little", signed=True)
        return h


_HASHES = _Hashes()


def word_hashes(text: str | None) -> list[int]:
    """Hashes of the distinct words of a whole text, in lower case."""
    if len(_HASHES) > 400_000:
        _HASHES.clear()
    return [_HASHES[w] for w in set(_WORD.findall((text or "").lower()))]


@dataclass
class LinearModel:
    """Weights of words, then of the log odds of earlier categories; ``base`` if constant."""

    words: dict[int, float] = field(default_factory=dict)
    earlier: list[float] = field(default_factory=list)
    bias: float = -30.0

    def logit(self, words: list[int], earlier: list[float]) -> float:
        get = self.words.get
        return self.bias + sum(get(w, 0.0) for w in words) + sum(a * b for a, b in zip(self.earlier, earlier))


def _p(z: float) -> float:
    return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


def _telling(rows: list[list[int]], y: np.ndarray, most: int) -> list[int]:
    """Words whose share differs most between the classes, by a standardised difference."""
    yes: Counter = Counter()
    no: Counter = Counter()
    for words, label in zip(rows, y):
        (yes if label else no).update(words)
    n1, n0 = max(int(y.sum()), 1), max(int(len(y) - y.sum()), 1)
    score = {}
    for w in yes.keys() | no.keys():
        a, b = yes[w], no[w]
        if a + b >= 3:
            p = (a + b) / (n1 + n0)
            score[w] = abs(a / n1 - b / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-9)
    return sorted((w for w in score if score[w] >= TELLING), key=lambda w: (-score[w], w))[:most]


def fit_linear(rows: list[list[int]], earlier: np.ndarray, y: np.ndarray, most: int = WORDS, rounds: int = 150) -> LinearModel:
    """Logistic regression with a small penalty, by accelerated gradient steps."""
    k = earlier.shape[1]
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return LinearModel({}, [0.0] * k, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    chosen = {w: i for i, w in enumerate(_telling(rows, y, most))}
    at, col = [], []
    for i, words in enumerate(rows):
        hit = [chosen[w] for w in words if w in chosen]
        at += [i] * len(hit)
        col += hit
    at, col, d = np.array(at, np.int64), np.array(col, np.int64), len(chosen)
    extra = np.clip(earlier, -8, 8) / 4
    w, b = np.zeros(d + k), float(np.log(y.mean() / (1 - y.mean())))
    m, v = np.zeros(d + k + 1), np.zeros(d + k + 1)
    for r in range(1, rounds + 1):
        z = b + np.bincount(at, w[:d][col], minlength=len(y)) + extra @ w[d:]
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.concatenate([np.bincount(col, err[at], minlength=d) if d else np.zeros(0), err @ extra, [err.sum()]])
        g[:-1] += 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return LinearModel({h: float(w[i]) for h, i in chosen.items()}, [float(x) / 4 for x in w[d:]], float(b))


@dataclass
class Chain:
    categories: list[str]
    models: list[LinearModel]

    def logits(self, words: list[int]) -> list[float]:
        out: list[float] = []
        for model in self.models:
            out.append(model.logit(words, [max(-8.0, min(8.0, z)) for z in out]))
        return out


def fit_chain(categories: list[str], rows: list[list[int]], labels: np.ndarray, fold: np.ndarray) -> Chain:
    """labels: a column of 0 and 1 per category."""
    models, earlier = [], np.zeros((len(rows), 0))
    for c in range(len(categories)):
        y, logit = labels[:, c].astype(np.float64), np.zeros(len(rows))
        for f in range(FOLDS):
            inside, out = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            part = fit_linear([rows[i] for i in inside], earlier[inside], y[inside])
            logit[out] = [part.logit(rows[i], list(earlier[i])) for i in out]
        models.append(fit_linear(rows, earlier, y))
        earlier = np.column_stack([earlier, np.clip(logit, -8, 8)])
    return Chain(list(categories), models)


def trained(
    docs: DataFrame, labels: DataFrame, categories: list[str], training: Column | None = None,
    sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
) -> Chain:
    """``labels`` has the id and a column of 0 and 1 per category."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), *[F.col(c).cast("int").alias(f"y_{i}") for i, c in enumerate(categories)])
    known = known.dropna().where(F.lit(True) if training is None else training)
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    names = [f"y_{i}" for i in range(len(categories))]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [np.array(word_hashes(t), np.int64).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "words": words} | {n: b.column(n) for n in names})

    # At most ``sample`` ids, so small enough to send to every task.
    rows = source.join(F.broadcast(known), "id").mapInArrow(
        counted, "id long, words binary, " + ", ".join(f"{n} int" for n in names)
    )
    rows = rows.limit(2 * sample).toArrow()
    words = [np.frombuffer(x, np.int64).tolist() for x in rows["words"].to_pylist()]
    y = np.array([rows[n].to_pylist() for n in names], np.int8).T.reshape(-1, len(names))
    fold = np.array([zlib.crc32(str(i).encode()) // 4 % FOLDS for i in rows["id"].to_pylist()], np.int64)
    return fit_chain(categories, words, y, fold)


def scored(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, p_<category>...) of all rows."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # WORDS weights per category at most
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = [[_p(x) for x in shared.value.logits(word_hashes(t))] for t in b.column(1).to_pylist()]
            columns = list(zip(*z)) if z else [[] for _ in names]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, pa.float64()) for c in columns]], names=["doc_id", *names]
            )

    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return source.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names))
