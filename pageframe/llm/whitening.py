"""Whitening of embeddings by the eigenvectors of their covariance.

Entries become whole numbers, so Spark sums them and their centred products without any
rounding: tasks multiply vectors minus the rounded mean by one matrix product a block and send
one row per pair of dimensions, summed as decimals.  The rest of the centring (less than one
half per dimension) is done in whole numbers, which gives the covariance rounded once.

The eigenvectors start in single precision and are corrected by the matrix products of Ogita
and Aishima in extended precision (numpy's long double).  Eigenvalues that the current error
cannot tell apart form a cluster: its vectors are turned by the eigenvectors of the small
matrix that the covariance, shifted by the cluster's mean, has between them, and the
corrections go on.  Only numbers per dimension and per pair of dimensions reach the driver.

Defined results: a row is left out if its vector is null, holds a null, a non-finite entry or
one of 2**39 or more, or has another length than most usable vectors (ties: the longer one).
Repeated rows and null ids count like others.  Fewer dimensions than asked components give as
many components.  A component without variance (a constant dimension, fewer rows than
dimensions) has a null whitened value and explains 0; with no variance at all, null.  A
deviation beyond 64 bits is null.  An empty table gives an empty table.  Only the two named
columns are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
SCALE, SHIFT, TOO_LARGE = 64, 1_000_000, 2.0**39
BLOCK = 4096  # rows that are multiplied at once
_WHOLE = pa.decimal128(38, 0)


def rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(values, first value of each row, length of each row, is the row usable)."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    first = np.concatenate([[0], np.cumsum(lengths)])
    bad = np.concatenate([[0], np.cumsum(~(np.abs(values) < TOO_LARGE))])
    usable = pc.is_valid(column).to_numpy(zero_copy_only=False) & (bad[first[1:]] == bad[first[:-1]])
    return values, first[:-1], lengths, usable


def whole_vectors(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, whole-number vectors) of the usable rows of one length."""
    values, first, lengths, usable = rows_of(column)
    rows = np.flatnonzero(usable & (lengths == length))
    entries = values[first[rows][:, None] + np.arange(length)]
    return rows, np.floor(SCALE * entries).astype(np.int64) + SHIFT


def gram(y: np.ndarray) -> np.ndarray:
    """The product of ``y`` with itself, exact: in doubles where they hold it, else in Python's numbers."""
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < 2**53:
        wide = y.astype(np.float64)
        return (wide.T @ wide).astype(np.int64).astype(object)
    wide = y.astype(object)
    return wide.T @ wide


def _sum_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (length, dimension, sum); dimension -1 has the number of rows."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        _, _, lengths, usable = rows_of(b.column(0))
        for length in map(int, np.unique(lengths[usable])):
            rows, x = whole_vectors(b.column(0), length)
            now = np.append(x.sum(axis=0), len(rows)).astype(object)
            sums[length] = sums[length] + now if length in sums else now
    for length, s in sums.items():
        yield pa.RecordBatch.from_pydict(
            {
                "length": pa.array([length] * len(s), pa.int32()),
                "i": pa.array([*range(length), -1], pa.int32()),
                "s": pa.array([Decimal(int(v)) for v in s], _WHOLE),
            }
        )


def _gram_task(centre: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            _, x = whole_vectors(b.column(0), len(centre))
            for at in range(0, len(x), BLOCK):
                part = gram(x[at : at + BLOCK] - centre)
                total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(len(centre))
            yield pa.RecordBatch.from_pydict(
                {
                    "i": pa.array(i, pa.int32()),
                    "j": pa.array(j, pa.int32()),
                    "g": pa.array([Decimal(int(v)) for v in total[i, j]], _WHOLE),
                }
            )

    return run


def _norm(a: np.ndarray) -> float:
    return float(np.linalg.norm(a.astype(np.float64), 2)) if a.size else 0.0


def eigen(v: np.ndarray, most_rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    a = v.astype(np.longdouble)
    top = np.abs(a).max(initial=0)
    if top == 0:
        return np.zeros(len(a), np.longdouble), np.eye(len(a), dtype=np.longdouble)
    a = a / top
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    one, size, eps = np.eye(len(a), dtype=np.longdouble), _norm(a), float(np.finfo(np.longdouble).eps)
    least, stalled = np.inf, 0
    for _ in range(most_rounds):
        r, s = one - x.T @ x, x.T @ a @ x
        values = np.diag(s) / (1 - np.diag(r))
        off = _norm(s - np.diag(values))
        error = 2 * (off + size * _norm(r))
        gap = values[None, :] - values[:, None]
        close = np.abs(gap) <= error
        e = np.where(close, r / 2, (s + values[None, :] * r) / np.where(close, 1, gap))
        x = x + x @ e
        order = np.argsort(-values)
        x, values = x[:, order], values[order]
        # neighbours within the error form a cluster; a turn inside it is all that is left to find
        cuts = np.flatnonzero(values[:-1] - values[1:] > error) + 1
        for members in np.split(np.arange(len(a)), cuts):
            if len(members) > 1:
                sub = x[:, members]
                small = sub.T @ (a @ sub - values[members].mean() * sub)
                scale = np.abs(small).max()
                if scale > eps * len(a):
                    turn = np.linalg.eigh(((small + small.T) / (2 * scale)).astype(np.float64))[1]
                    x[:, members] = sub @ turn[:, ::-1].astype(np.longdouble)
        stalled = stalled + 1 if error >= least / 2 else 0
        least = min(least, error)
        if least <= 8 * eps * len(a) or stalled == 3:
            break
    x = x @ (3 * one - x.T @ x) / 2  # turns are orthogonal to double precision only
    values = np.diag(x.T @ a @ x)
    order = np.argsort(-values)
    return values[order] * top, x[:, order]


@dataclass(frozen=True)
class Whitening:
    """The fit: ``n`` vectors, their sums by dimension, and components by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: list[float | None]
    identity_error: float | None = None

    @property
    def centre(self) -> np.ndarray:
        """The mean, rounded to whole numbers."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    def rest(self) -> list[int]:
        """``sums - n * centre``."""
        return [s - self.n * int(c) for s, c in zip(self.sums, self.centre)]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """One row per vector, NaN for a component without variance."""
        z = (x - self.centre) - np.array([float(Fraction(d, self.n)) for d in self.rest()])
        flat = self.values <= 0
        out = z @ self.vectors / np.sqrt(np.where(flat, 1.0, self.values))
        out[:, flat] = np.nan
        return out

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Squared distance from the mean, times ``n`` squared: exact, null beyond 64 bits."""
        y, rest = x - self.centre, self.rest()
        most = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if len(rest) * most * most >= 2**63:
            y, rest = y.astype(object), np.array(rest, object)
        sums = ((self.n * y - rest) ** 2).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in sums]


def fit(df: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Two passes for the covariance and one that measures how white the result is.  None if no
    row is usable."""
    vectors = df.select(F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    sums = vectors.mapInArrow(_sum_task, "length int, i int, s decimal(38,0)")
    sums = sums.groupBy("length", "i").agg(F.sum("s").alias("s"))
    lengths = sums.where("i = -1").orderBy(F.desc("s"), F.desc("length")).limit(1).collect()
    if not lengths:
        return None
    length, n = lengths[0]["length"], int(lengths[0]["s"])
    by_dim = {r["i"]: int(r["s"]) for r in sums.where(F.col("length") == length).where("i >= 0").collect()}
    model = Whitening(n, [by_dim[i] for i in range(length)], np.zeros(0), np.zeros((length, 0)), [])
    if not length:
        return model
    products = vectors.mapInArrow(_gram_task(model.centre), "i int, j int, g decimal(38,0)")
    v, rest = np.zeros((length, length), np.longdouble), model.rest()
    for r in products.groupBy("i", "j").agg(F.sum("g").alias("g")).collect():
        i, j = r["i"], r["j"]
        exact = Fraction(n * int(r["g"]) - rest[i] * rest[j], n * n)
        high = float(exact)
        v[i, j] = v[j, i] = np.longdouble(high) + np.longdouble(float(exact - Fraction(high)))
    values, found = eigen(v)
    noise = values.max() * length * 8 * np.finfo(np.longdouble).eps
    values = np.where(values > noise, values, 0)
    trace = np.trace(v)
    k = min(components, length)
    model = Whitening(
        n, model.sums, values[:k].astype(np.float64), found[:, :k].astype(np.float64),
        [float(e / trace) if trace > 0 else None for e in values[:k]],
    )
    return Whitening(**{**model.__dict__, "identity_error": _identity_error(vectors, model)})


def _identity_error(vectors: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the whitened vectors' covariance minus the identity, over all vectors."""
    k = int((model.values > 0).sum())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for b in batches:
            _, x = whole_vectors(b.column(0), len(model.sums))
            w = np.column_stack([model.whitened(x)[:, :k], np.ones(len(x))])  # the last sums the others
            total += w.T @ w
        i, j = np.triu_indices(k + 1)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "g": total[i, j]})

    if not k:
        return None
    cov, n = np.zeros((k + 1, k + 1)), model.n
    for r in vectors.mapInArrow(task, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect():
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["g"] / n
    mean = cov[:k, k]
    return float(np.abs(cov[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())


def transformed(
    df: DataFrame, model: Whitening | None, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """Rows (vec_id, deviation, whitened), the last an array with one entry per component."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if model is None:
                continue
            for part in (b.slice(at, BLOCK) for at in range(0, b.num_rows, BLOCK)):
                rows, x = whole_vectors(part.column(1), len(model.sums))
                w = model.whitened(x)
                flat = pa.array(w.ravel(), pa.float64(), from_pandas=True)  # NaN becomes null
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": part.column(0).take(pa.array(rows)),
                        "deviation": pa.array(model.deviations(x), pa.int64()),
                        "whitened": pa.ListArray.from_arrays(
                            pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32()), flat
                        ),
                    }
                )

    source = df.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v")
    )
    return source.mapInArrow(task, "vec_id long, deviation long, whitened array<double>")


def by_component(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row per vector and component, with the figures of the fit."""
    model = fit(df, vec_col, components)
    shares = F.array(*[F.lit(e).cast("double") for e in model.explained] if model else []).cast("array<double>")
    return transformed(df, model, id_col, vec_col).select(
        "vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")
    ).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n if model else None).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(model.identity_error if model else None).cast("double").alias("identity_error"),
    )
