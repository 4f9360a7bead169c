"""Whitening against a plain eigen-decomposition and exact integer sums."""

import math

import numpy as np
import pytest

import __spark_entry__ as E
from densitykit.llm import qd, whitening
from tests.conftest import SF

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def plain(vectors, k=32):
    """n, deviations, eigenvalues, trace and whitened rows, by integers and numpy's symmetric solver."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x)]
    y = [[n * a - b for a, b in zip(r, s)] for r in x]
    dev = [sum(a * a for a in r) for r in y]
    z = np.array([[a / n for a in r] for r in y])
    e, w = np.linalg.eigh(z.T @ z / n)
    e, w = e[::-1], w[:, ::-1]
    with np.errstate(invalid="ignore", divide="ignore"):
        return n, dev, e[:k], e.sum(), z @ w[:, :k] / np.sqrt(e[:k])


def table_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.vec_id, {})[r.component] = r
    return out


def hold(got, ids, vectors, k, tol=1e-7):
    n, dev, e, trace, white = plain(vectors, k)
    assert set(got) == set(ids)
    for i, key in enumerate(ids):
        assert sorted(got[key]) == list(range(1, k + 1))
        r = got[key][1]
        assert (r.n, r.deviation) == (n, dev[i])
    for j in range(k):
        col = np.array([got[key][j + 1].whitened for key in ids])
        sign = np.sign(col @ white[:, j])
        assert np.abs(col * sign - white[:, j]).max() < tol * max(1, np.abs(white[:, j]).max()), j
        assert abs(got[ids[0]][j + 1].explained - e[j] / trace) < 1e-9
    assert 0 <= got[ids[0]][1].identity_error < 1e-6


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_against_eigh(spark, sf):
    out = E.queries()["op11_whitening"](spark, SF[sf])
    assert out.columns == COLUMNS
    rows = spark.read.parquet(f"{SF[sf]}/embeddings.parquet").orderBy("vec_id").collect()
    hold(table_of(out), [r.vec_id for r in rows], [r.embedding for r in rows], 32)


def test_bad_rows_ties_and_extra_columns(spark):
    rng = np.random.default_rng(4)
    good = [list(map(float, v)) for v in rng.standard_normal((40, 3))]
    bad = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 0.0], [float("inf"), 0.0, 0.0], [1.0, 2.0], [1e300, 0.0, 0.0]]
    rows = [(i, v, 1, 2.0) for i, v in enumerate(good + good[:5] + bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int, whitened double").repartition(40)
    out = whitening.apply(df, whitening.fit(df, components=32))
    assert out.columns == COLUMNS
    hold(table_of(out), list(range(45)), good + good[:5], 3)
    none = df.where("vec_id >= 45 and vec_id < 50")
    assert whitening.fit(none) is None and whitening.apply(none, None).count() == 0
    assert whitening.fit(df.where("false")) is None


def test_null_and_repeated_keys_and_equal_vectors(spark):
    rows = [(None, [1.0, 2.0, 0.0]), (None, [2.0, 1.0, 0.0]), (7, [0.5, 0.5, 0.0]), (7, [0.5, 0.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    m = whitening.fit(df)
    got = whitening.apply(df, m).collect()
    assert len(got) == 12 and sum(r.vec_id is None for r in got) == 6
    assert all((r.whitened is None) == (r.component == 3) for r in got) and m.identity_error < 1e-12
    same = spark.createDataFrame([(i, [3.0, -1.0]) for i in range(5)], "vec_id long, embedding array<float>")
    got = whitening.apply(same, whitening.fit(same)).collect()
    assert len(got) == 10 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 for r in got)
    wide = spark.createDataFrame([(1, [1e16, 0.0]), (2, [-1e16, 1.0]), (3, [5.0, 2.0])], "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.component): r for r in whitening.apply(wide, whitening.fit(wide)).collect()}
    assert len(got) == 6 and got[1, 1].deviation is None and abs(got[1, 1].whitened) == pytest.approx(math.sqrt(1.5))


@pytest.mark.parametrize("make", [
    lambda r: r.standard_normal((300, 20)) * np.logspace(0, -6, 20),
    lambda r: np.repeat(r.standard_normal((60, 5)), 3, axis=1),
    lambda r: np.vstack([np.eye(12), -np.eye(12)]),
    lambda r: np.hstack([r.standard_normal((50, 4)), np.zeros((50, 3))]),
    lambda r: r.standard_normal((4, 9)),
    lambda r: np.linalg.qr(r.standard_normal((100, 16)))[0] * np.array([3.0] * 8 + [1.0] * 8) @ np.linalg.qr(r.standard_normal((16, 16)))[0],
])
def test_solver(make):
    x = make(np.random.default_rng(8))
    d = x.shape[1]
    r = whitening._triangle(x)
    assert np.allclose(r.T @ r, x.T @ x)
    a, b, w = qd.bidiagonalise(r)
    m = r @ w
    assert np.allclose(w.T @ w, np.eye(d)) and np.allclose(m.T @ m, (lambda q: q.T @ q)(np.diag(a) + np.diag(b, 1)))
    want = np.linalg.svd(x, compute_uv=False)
    want = np.concatenate([want, np.zeros(d - len(want))])
    rank = int((want > want[0] * d * qd.EPS).sum())
    squares, v = qd.principal(r, rank)
    assert np.abs(np.sqrt(squares) - want).max() < 1e-7 * want[0] and np.abs(squares - want**2).max() < 1e-13 * want[0] ** 2
    assert np.abs(v.T @ v - np.eye(rank)).max() < 1e-9
    assert np.abs(x.T @ (x @ v) - v * squares[:rank]).max() < 1e-12 * squares[0]
