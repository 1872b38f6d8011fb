"""Whitening against whole numbers and plain double precision; the corrections; odd input."""

from fractions import Fraction

import numpy as np
import pytest

from pageframe.llm import whitening as W
from pageframe.llm.queries import op11_embedding_whitening

SCHEMA = "vec_id long, embedding array<float>, label int, i int, v string"


def plain(rows):
    """(ids, n, deviations, eigenvalues, eigenvectors, z) of the usable rows."""
    ok = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in ok]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    dev = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    z = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums)] for v in x])
    e, u = np.linalg.eigh(z.T @ z / n)
    return [i for i, _ in ok], n, dev, e[::-1], u[:, ::-1], z


def run(spark, rows, k=32):
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA).repartition(3)
    return W.by_component(df, k).collect()


@pytest.mark.parametrize("dims", [3, 40])
def test_equals_plain_version(spark, dims):
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(300, dims)) @ rng.normal(size=(dims, dims)) + 50
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(base)]
    rows += [(900, None), (901, [None] * dims), (902, [float("nan")] * dims), (903, [float("inf")] + [1.0] * (dims - 1))]
    rows += [rows[5], (None, rows[6][1]), (904, [1.0]), (905, [])]
    ids, n, dev, e, u, z = plain([r for r in rows if r[1] is None or len(r[1]) == dims])
    got = run(spark, rows)
    k = min(32, dims)
    assert len(got) == n * k and {r["n"] for r in got} == {n}
    assert sorted((str(r["vec_id"]), r["deviation"]) for r in got if r["component"] == 1) == sorted(zip(map(str, ids), dev))
    assert max(r["identity_error"] for r in got) < 1e-10
    want = {i: v for i, v in zip(ids, z @ u[:, :k] / np.sqrt(e[:k]))}
    table = {(r["vec_id"], r["component"]): r for r in got}
    for c in range(1, k + 1):
        sign = np.sign(table[0, c]["whitened"] * want[0][c - 1])
        assert all(abs(sign * table[i, c]["whitened"] - want[i][c - 1]) < 1e-7 for i in ids)
        assert abs(table[0, c]["explained"] - e[c - 1] / e.sum()) < 1e-12


def test_corrections_tell_clusters_apart():
    rng = np.random.default_rng(1)
    values = np.array([9, 5 + 2e-9, 5 + 1e-9, 5, 5 - 1e-13, 2, 2, 1, 1e-9, 0], np.longdouble)
    q = np.linalg.qr(rng.normal(size=(10, 10)))[0].astype(np.longdouble)
    for _ in range(4):  # orthogonal to extended precision
        q = q @ (3 * np.eye(10, dtype=np.longdouble) - q.T @ q) / 2
    a = q @ np.diag(values) @ q.T
    got, x = W.eigen((a + a.T) / 2)
    assert np.abs(got - values).max() < 1e-16
    assert np.abs(x.T @ x - np.eye(10)).max() < 1e-17
    assert np.abs(a @ x - x * got).max() < 1e-17 * 40
    for k in (0, 1, 2, 7, 8, 9):  # well or barely separate: the very vector
        assert abs(abs(q[:, k] @ x[:, k]) - 1) < 1e-14
        assert min(np.abs(q[:, k] - x[:, k]).max(), np.abs(q[:, k] + x[:, k]).max()) < 1e-7


def test_far_from_the_origin_and_large(spark):
    rows = [(k, [1e6 + k % 3, 4e9 if k % 2 else -4e9]) for k in range(30)]
    ids, n, dev, e, u, z = plain(rows)
    got = run(spark, rows)
    for r in got:
        if r["component"] == 1:
            want = dev[ids.index(r["vec_id"])]
            assert r["deviation"] == (want if want < 2**63 else None)
    assert max(r["identity_error"] for r in got) < 1e-9


def test_no_variance_and_few_rows(spark):
    got = run(spark, [(1, [1.0, 2.0, 3.0]), (2, [1.0, 4.0, 3.0])])
    by = {(r["vec_id"], r["component"]): (r["whitened"], r["explained"], r["identity_error"]) for r in got}
    assert abs(by[1, 1][0]) == 1 and by[1, 1][1] == 1 and by[1, 1][2] == 0
    assert by[2, 2][:2] == by[2, 3][:2] == (None, 0)
    same = run(spark, [(1, [1.0, 2.0])] * 2)
    assert [(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in same] == [(None, None, None, 0)] * 4
    assert run(spark, []) == [] and run(spark, [(1, None)]) == [] and run(spark, [(1, [])]) == []


def test_whole_table(spark):
    got = op11_embedding_whitening(spark, "/root/testdata/sf0.001")
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = got.collect()
    n = rows[0]["n"]
    w = np.zeros((n, 32))
    place = {i: k for k, i in enumerate(sorted({r["vec_id"] for r in rows}))}
    for r in rows:
        w[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
    assert len(rows) == 32 * n and np.abs(np.cov(w.T, bias=True) - np.eye(32)).max() < 1e-9
