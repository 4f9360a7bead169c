"""Minimiser, bounded fit and element-wise statistics of waves against numpy."""

import random

import numpy as np
import pytest

from densitykit.operators import waves as OW


def distance(a, b, s, u, r):
    return float(np.linalg.norm(np.roll(a, r) * s + u - (b / s - u)))


def test_least_shift_scale(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(12):
        n = int(rng.integers(5, 24))
        a = rng.normal(3, 2, n)
        b = np.roll(a, int(rng.integers(0, n))) * rng.uniform(0.3, 4) + rng.normal(0, 0.5, n) if i % 2 else rng.normal(0, 5, n)
        rows.append((i, -i, a.tolist(), b.tolist()))
    rows += [(90, 0, [2.0] * 6, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), (91, 0, [2.0] * 4, [5.0] * 4), (92, 0, [1.0, 4.0, 2.0], [7.0] * 3)]
    df = spark.createDataFrame(rows, "u1 int, u2 int, v1 array<double>, v2 array<double>")
    got = {r.u1: r for r in OW.least_shift_scale(df).collect()}
    grid = {r.u1: r.dist for r in OW.best_shift_scale(df).collect()}
    for i, _, a, b in rows:
        a, b, r = np.array(a), np.array(b), got[i]
        assert r.dist == pytest.approx(distance(a, b, r.s, r.u, r.r), rel=1e-9, abs=1e-9) and r.dist <= grid[i] + 1e-9
        # dense search around and far from it: nothing is lower by more than 1e-6
        n = len(a)
        for s in np.concatenate([np.geomspace(1e-3, 1e3, 121), np.clip(r.s * np.geomspace(0.98, 1.02, 41), 1e-3, 1e3)]):
            for sh in range(n):
                u = (b.sum() / s - s * a.sum()) / (2 * n)
                assert distance(a, b, s, u, sh) >= r.dist - 1e-6
        for u in r.u + np.linspace(-1, 1, 41):
            assert distance(a, b, r.s, u, r.r) >= r.dist - 1e-6
    assert got[91].dist == pytest.approx(0, abs=1e-9)


def test_bounded_fit_of_planted_pulses(spark):
    rng = np.random.default_rng(7)
    x = np.arange(128)
    rows, want = [], {}
    for i in range(60):
        a, b, c, d = rng.uniform(-5, 5), rng.uniform(5, 50), rng.uniform(20, 100), rng.uniform(20, 400)
        noise = 0.0 if i < 20 else 0.3
        rows.append((i, (a + b * np.exp(-(x - c) ** 2 / d) + rng.normal(0, noise, 128) if noise else a + b * np.exp(-(x - c) ** 2 / d)).tolist()))
        want[i] = (a, b, c, d, noise)
    rows += [(100, [1.0] * 40), (101, [float(t) for t in range(30)]), (102, None), (103, []), (104, [3.0]), (105, rng.normal(0, 1, 50).tolist()), (106, (-np.exp(-(x - 60) ** 2 / 50)).tolist())]
    df = spark.createDataFrame(rows, "id int, v array<double>").repartition(3)
    fits = {r.id: r for r in OW.pulse_least_squares(df, ["id"]).collect()}
    closed = {r.id: r for r in OW.pulse_fit(df, ["id"], baseline="min").collect()}
    assert len(fits) == len(rows)
    for i, (a, b, c, d, noise) in want.items():
        f = fits[i]
        tol = 1e-4 if not noise else 0.6
        assert abs(f.a - a) < tol and abs(f.b - b) < 2 * tol and abs(f.c - c) < tol and abs(f.d - d) < (1e-2 if not noise else 0.25 * d), (i, f, want[i])
        assert f.res <= 128 * noise**2 * 1.6 + 1e-6
    for i, f in fits.items():
        if i in (102, 103):
            assert f.res is None
            continue
        v = np.array(dict(rows)[i])
        assert f.b >= 0 and f.d >= 1e-4 and f.res == pytest.approx(float(((v - f.a - f.b * np.exp(-(np.arange(len(v)) - f.c) ** 2 / f.d)) ** 2).sum()), rel=1e-6, abs=1e-9)
        if closed[i].res is not None:
            assert f.res <= closed[i].res * (1 + 1e-9) + 1e-12
    assert fits[106].res <= ((np.array(rows[-1][1]) - np.mean(rows[-1][1])) ** 2).sum() + 1e-9


def test_wave_stats(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 3)), rng.normal(1e6, 3, int(rng.integers(0, 30))).tolist()) for _ in range(400)] + [(5, None), (5, []), (6, [1.0, None, 3.0]), (6, [5.0, 2.0])]
    df = spark.createDataFrame(rows, "channel int, v array<double>").repartition(7)
    got = {(r.channel, r.pos): r for r in OW.wave_stats(df).collect()}
    want = {}
    for c, v in rows:
        for p, t in enumerate(v or []):
            if t is not None:
                want.setdefault((c, p), []).append(t)
    assert set(got) == set(want)
    for key, vals in want.items():
        r = got[key]
        assert r.n == len(vals) and r.mean == pytest.approx(np.mean(vals), rel=1e-12) and r.var == pytest.approx(np.var(vals), rel=1e-9, abs=1e-9)
    assert OW.wave_stats(df.where("false")).count() == 0


def test_shuffle_of_wave_stats_does_not_grow(spark):
    few = spark.range(200, numPartitions=4).selectExpr("0 channel", "transform(sequence(1, 50), i -> cast(i + id as double)) v")
    many = spark.range(20_000, numPartitions=4).selectExpr("0 channel", "transform(sequence(1, 50), i -> cast(i + id as double)) v")
    plan = OW.wave_stats(many)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in plan and "Generate" in plan  # rows of states, read back; no row for a sample
    assert OW.wave_stats(few).count() == OW.wave_stats(many).count() == 50
    r = random.Random(1)
    p = r.randint(0, 49)
    row = OW.wave_stats(many).where(f"pos = {p}").first()
    assert row.n == 20_000 and row.mean == pytest.approx(p + 1 + 9999.5)
