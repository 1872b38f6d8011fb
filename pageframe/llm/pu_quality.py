"""Quality by positive-unlabelled learning.

Trusted positives are rows labelled 1, unlabelled ones are any documents of the training rows.
Two steps: the class prior is estimated (share of unlabelled against share of positives above
the best score of a positive-against-unlabelled model, on rows it was not fitted on), then a
linear model minimises the non-negative unbiased risk
``prior * E_P[l(z)] + max(0, E_U[l(-z)] - prior * E_P[l(-z)])`` with the logistic loss, so its
output is a probability.  Labels 0 are never used.

The model is fitted on bounded samples of ``SAMPLE`` positives and as many unlabelled rows (the
ids with the smallest hashes), on the driver; every row is scored in its task.

Inputs of a score are counts of the whole text only.  Defined results: a null text counts as
an empty one, whose score is the model's for all counts zero; without positives or unlabelled
rows every score is 0.5; repeated rows get the same score; null labels are left out; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe.llm.quality_rules import STOP_WORDS

SAMPLE = 15_000
PAIRS = 256  # hashed byte pairs
_STOP = frozenset(STOP_WORDS)
_MARKS = "#*$%&|<>!?.,;:\"'()=_/@+-"
_DENSE = 13 + len(_MARKS)
WIDTH = _DENSE + PAIRS


def features(text: str | None) -> np.ndarray:
    """Counts and ratios of one text, squeezed to a similar range."""
    text = text or ""
    out = np.zeros(WIDTH, np.float32)
    if not text:
        return out
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, raw = max(len(words), 1), np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    upper = np.count_nonzero((raw >= 65) & (raw <= 90))
    lower = np.count_nonzero((raw >= 97) & (raw <= 122))
    lengths = np.fromiter(map(len, words), np.int32, len(words)) if words else np.zeros(1, np.int32)
    out[:13] = (
        1,
        np.log1p(n) / 3,
        lengths.mean() / 5,
        lengths.std() / 5,
        _squeeze(upper / max(upper + lower, 1)),
        _squeeze(np.count_nonzero((raw >= 48) & (raw <= 57)) / len(raw)),
        np.count_nonzero(raw >= 128) / len(raw),
        _squeeze(sum(map(_STOP.__contains__, words)) / n),
        _squeeze(sum(map(eq, words, words[1:])) / n),
        len(set(words)) / n,
        _squeeze(1 - len(set(lines)) / max(len(lines), 1)),
        np.log1p(len(text) / max(len(lines), 1)) / 3,
        np.log1p(lengths.max()) / 3,
    )
    out[13:_DENSE] = [_squeeze(text.count(c) / n) for c in _MARKS]
    pairs = raw[:-1].astype(np.uint32) * np.uint32(2654435761) + raw[1:].astype(np.uint32) * np.uint32(40503)
    out[_DENSE:] = np.sqrt(np.bincount(pairs >> np.uint32(24), minlength=PAIRS) / max(len(pairs), 1))
    return out


def _squeeze(ratio: float) -> float:
    return float(np.log1p(100 * ratio) / 3)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight + self.bias)


NEUTRAL = QualityModel(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0, 0.5)


def _descend(p: np.ndarray, u: np.ndarray, prior: float | None, rounds: int = 40, l2: float = 1e-4, seed: int = 7):
    """Weights by Adam on blocks; prior None: plain positive-against-unlabelled regression."""
    rng, d = np.random.default_rng(seed), p.shape[1]
    w, m, v, step = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1), 0
    blocks = max(1, min(len(p), len(u)) // 500)
    for r in range(rounds):
        ps, us = np.array_split(rng.permutation(len(p)), blocks), np.array_split(rng.permutation(len(u)), blocks)
        for i, j in zip(ps, us):
            x, y = p[i], u[j]
            a, b = _sigmoid(x @ w[:-1] + w[-1]), _sigmoid(y @ w[:-1] + w[-1])
            # d l(z)/dz = s - 1 and d l(-z)/dz = s, with s the sigmoid of z.
            up, uu = (a - 1) / len(x), b / len(y)
            if prior is None:
                gp, gu = up, uu
            else:
                negative = -np.log1p(-np.minimum(b, 1 - 1e-9)).mean() + prior * np.log1p(-np.minimum(a, 1 - 1e-9)).mean()
                gp, gu = prior * up - prior * a / len(x), uu
                if negative < 0:  # the risk's negative part must not fall below zero: step back
                    gp, gu = prior * a / len(x), -uu
            g = np.append(gp @ x + gu @ y + l2 * w[:-1], gp.sum() + gu.sum())
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            rate = 0.02 * (1 - r / rounds)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], w[-1]


def estimated_prior(p: np.ndarray, u: np.ndarray, least: float = 0.3) -> float:
    """Share of positives among the unlabelled: above a score that keeps at least ``least`` of
    the positives, the smallest ratio of the unlabelled's share to the positives' share."""
    w, b = _descend(p[::2], u[::2], None, rounds=15)
    sp, su = np.sort(p[1::2] @ w + b), np.sort(u[1::2] @ w + b)
    if not len(sp) or not len(su):
        return 0.5
    cut = sp[: max(1, int(len(sp) * (1 - least)))]
    above_p = 1 - np.searchsorted(sp, cut) / len(sp)
    above_u = 1 - np.searchsorted(su, cut) / len(su)
    slack = 1 / np.sqrt(len(su)) + 1 / np.sqrt(len(sp))
    return float(np.clip(((above_u + slack / 4) / above_p).min(), 0.05, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> QualityModel:
    if not len(positive) or not len(unlabelled):
        return NEUTRAL
    mean, scale = unlabelled.mean(0), unlabelled.std(0)
    scale = np.maximum(scale, 0.02)
    p, u = np.clip((positive - mean) / scale, -8, 8), np.clip((unlabelled - mean) / scale, -8, 8)
    prior = prior or estimated_prior(p, u)
    weight, bias = _descend(p, u, prior)
    return QualityModel(mean, scale, weight, float(bias), prior)


def smallest_hashes(ids: DataFrame, k: int) -> DataFrame:
    """At most k rows (id), chosen alike from any table."""
    return ids.select("id").where("id IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(k)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [features(t).tobytes() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_pydict({"is_p": b.column("is_p"), "is_u": b.column("is_u"), "x": x})


def trained(
    docs: DataFrame, labels: DataFrame, training: Column, sample: int = SAMPLE, id_col: str = "doc_id",
    text_col: str = "text", label_col: str = "quality",
) -> QualityModel:
    """``training``: condition on ``id``; only such rows are learned from."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(training)
    positive = labels.where(F.col(label_col) == 1).select(F.col(id_col).cast("long").alias("id")).where(training)
    chosen = smallest_hashes(positive, sample).select("id", F.lit(True).alias("p"), F.lit(False).alias("u"))
    chosen = chosen.union(smallest_hashes(source, sample).select("id", F.lit(False), F.lit(True)))
    chosen = chosen.groupBy("id").agg(F.bool_or("p").alias("is_p"), F.bool_or("u").alias("is_u"))
    # At most 2 * sample ids: small enough to send to every task, whatever the tables' size.
    rows = source.join(F.broadcast(chosen), "id").mapInArrow(_measured, "is_p boolean, is_u boolean, x binary")
    rows = rows.limit(4 * sample).toArrow()  # ids that many rows share must not lift the bound
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(-1, WIDTH)
    is_p, is_u = (np.array(rows[k].to_pylist(), bool) for k in ("is_p", "is_u"))
    return fit(x[is_p], x[is_u]) if len(x) else NEUTRAL


def scored(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, score) of all rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few kilobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in b.column(1).to_pylist()], np.float64).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(shared.value.score(x))], names=["doc_id", "score"]
            )

    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return source.mapInArrow(run, "doc_id long, score double")
