"""Waveform functions: roll round trip, z-score, planted pulses."""

import math

import numpy as np
from pyspark.sql import functions as F

from densitykit.functions import waves as W
from densitykit.operators import waves as OW


def test_roll_round_trip_and_numpy(spark):
    v = [float(i * i % 17) for i in range(40)]
    df = spark.createDataFrame([(v,)], "v array<double>")
    for n in [0, 1, 7, -13, 40, 95, -81]:
        r = df.select(W.roll("v", n).alias("r"), W.roll(W.roll("v", n), -n).alias("rr")).first()
        assert list(r["r"]) == list(np.roll(v, n))
        assert list(r["rr"]) == v


def test_zscore_and_peak(spark):
    v = [1.0, 5.0, 3.0, 5.0, 2.0]
    r = spark.createDataFrame([(v,), ([2.0, 2.0],)], "v array<double>").select(
        W.zscore("v").alias("z"), W.peak_index("v").alias("p")).collect()
    a = np.array(v)
    assert np.allclose(r[0]["z"], (a - a.mean()) / a.std())
    assert r[0]["p"] == 1
    assert list(r[1]["z"]) == [0.0, 0.0]


def test_align_peak(spark):
    v = [0.0] * 40
    v[30] = 9.0
    v[31] = 4.0
    r = spark.createDataFrame([(v,)], "v array<double>").select(W.align_peak("v", 19, 8, 16).alias("a")).first()["a"]
    assert len(r) == 24 and int(np.argmax(r)) == 8


def test_planted_pulses_recovered(spark):
    rows = []
    x = np.arange(128)
    gid = 0
    for a in [0.0, 2.0]:
        for b in [5.0, 50.0]:
            for c in [40.0, 63.5, 90.0]:
                for d in [30.0, 200.0]:
                    y = a + b * np.exp(-(x - c) ** 2 / d)
                    rows += [(gid, int(i), float(val)) for i, val in enumerate(y)]
                    gid += 1
    long = spark.createDataFrame(rows, "g INT, pos INT, v DOUBLE")
    truth = {}
    gid = 0
    for a in [0.0, 2.0]:
        for b in [5.0, 50.0]:
            for c in [40.0, 63.5, 90.0]:
                for d in [30.0, 200.0]:
                    truth[gid] = (a, b, c, d)
                    gid += 1
    outs = []
    for a_val in [0.0, 2.0]:
        gs = [g for g, t in truth.items() if t[0] == a_val]
        fit = OW.pulse_fit(OW.to_wave(long.where(F.col("g").isin(gs)), ["g"]), ["g"], baseline="zero" if a_val == 0 else a_val,
                           threshold=0.01)
        outs += fit.collect()
    assert len(outs) == len(truth)
    for r in outs:
        a, b, c, d = truth[r["g"]]
        assert abs(r["b"] - b) < 1e-6 * max(1, b) and abs(r["c"] - c) < 1e-6 and abs(r["d"] - d) < 1e-6 * d
        assert r["res"] < 1e-12


def test_best_shift_scale_finds_planted(spark):
    v2 = [math.sin(i / 3.0) + 0.1 * i for i in range(40)]
    # v1 such that roll(v1, 2) * 1.5 + 0.5 == v2 / 1.5 - 0.5  ->  v1 = roll((v2/1.5 - 1.0) / 1.5, -2)
    t = (np.array(v2) / 1.5 - 0.5 - 0.5) / 1.5
    v1 = [float(x) for x in np.roll(t, -2)]
    pairs = spark.createDataFrame([(1, 2, v1, v2)], "u1 INT, u2 INT, v1 array<double>, v2 array<double>")
    r = OW.best_shift_scale(pairs).first()
    assert (r["s"], r["u"], r["r"]) == (1.5, 0.5, 2) and r["dist"] < 1e-9


def test_moments_of_empty_and_constant_waves(spark):
    df = spark.createDataFrame([([],), ([2.0],), ([1.0, 3.0],), (None,)], "v array<double>")
    r = \
        df.select(W.zscore("v").alias("z"), W.wave_std("v").alias("s")).collect()
    assert [x["z"] for x in r] == [[], [0.0], [-1.0, 1.0], None] and [x["s"] for x in r] == [None, 0.0, 1.0, None]


def test_best_shift_scale_equals_the_full_grid(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i + 1, rng.normal(0, 3, 12).round(3).tolist(), rng.normal(0, 3, 12).round(3).tolist()) for i in range(12)]
    rows.append((90, 91, [1.0] * 12, [1.0] * 12))  # every roll ties
    got = {r["u1"]: r for r in OW.best_shift_scale(spark.createDataFrame(rows, "u1 INT, u2 INT, v1 array<double>, v2 array<double>")).collect()}
    grid = [(abs(r), r, s, u) for s in np.arange(0.5, 2.01, 0.25) for u in np.arange(-1, 1.01, 0.5) for r in range(-8, 9)]
    for a, _, x, y in rows:
        x, y = np.array(x), np.array(y)
        best = min((np.linalg.norm(np.roll(x, r) * s + u - (y / s - u)), ar, r, s, u) for ar, r, s, u in grid)
        assert abs(got[a]["dist"] - best[0]) < 1e-9 and (got[a]["s"], got[a]["u"], got[a]["r"]) == (best[3], best[4], best[2])
