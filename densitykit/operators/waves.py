"""Table-level waveform operators."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densitykit.functions import waves as W
from densitykit.session import materialize, ship_package


def to_wave(long: DataFrame, keys: Sequence[str], pos: str = "pos", v: str = "v", out: str = "v") -> DataFrame:
    """Long form ``keys, pos, v`` -> ``keys, v ARRAY<DOUBLE>`` in position order (groups are
    single waveforms, bounded by the waveform length)."""
    return long.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(v).alias("v")))),
                    lambda s: s["v"]).alias(out))


def to_long(df: DataFrame, keys: Sequence[str], v: str = "v", pos: str = "pos", out: str = "v") -> DataFrame:
    """``keys, v ARRAY`` -> ``keys, pos, v``."""
    return df.select(*keys, F.posexplode(v).alias(pos, out)).withColumn(pos, F.col(pos).cast("int"))


def channels(df: DataFrame, keys: Sequence[str], signal: str = "signal") -> DataFrame:
    """F2 input: one row per (event, channel) from ``signal ARRAY<ARRAY<..>>``."""
    return df.select(*keys, F.posexplode(signal).alias("channel", "v")) \
        .withColumn("channel", F.col("channel").cast("int")) \
        .withColumn("v", F.transform("v", lambda x: x.cast("double")))


def channel_zscore(df: DataFrame, keys: Sequence[str], signal: str = "signal") -> DataFrame:
    """F2: every channel of every event z-scored, one row per (event, channel)."""
    return channels(df, keys, signal).withColumn("v", W.zscore("v"))


def best_shift_scale(pairs: DataFrame, v1: str = "v1", v2: str = "v2", keys: Sequence[str] = ("u1", "u2"),
                     s_values=None, u_values=None, r_values=None) -> DataFrame:
    """for each pair of equal-length waves the grid point with the smallest shift/scale distance; ties
    go to the smallest ``(|r|, r, s, u)``. The grid is ``s`` 0.5..2.0 step 0.25, ``u`` -1..1 step 0.5, ``r``
    -8..8 (595 points; the reference's start point s=1, u=0, r=0 is on it).

    In the row, without a join: with ``D_r`` the dot product of ``roll(v1, r)`` and v2, the squared distance
    is ``s^2 Q1 + Q2 / s^2 - 2 D_r + 4 u (s S1 - S2 / s) + 4 u^2 n`` (S sums, Q sums of squares), so one dot product for each r
    serves all (s, u). The points within rounding of the least value are then compared by their exact distance.
    """
    s_values = s_values if s_values is not None else [float(x) for x in np.arange(0.5, 2.0001, 0.25)]
    u_values = u_values if u_values is not None else [float(x) for x in np.arange(-1.0, 1.0001, 0.5)]
    r_values = r_values if r_values is not None else list(range(-8, 9))
    su = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(u).alias("u")) for s in s_values for u in u_values])
    add = lambda acc, x: acc + x
    total = lambda a: F.aggregate(a, F.lit(0.0), add)
    x, y = F.col(v1), F.col(v2)
    sums = F.struct(total(x).alias("s1"), total(y).alias("s2"), total(F.transform(x, lambda a: a * a)).alias("q1"),
                    total(F.transform(y, lambda a: a * a)).alias("q2"), F.size(x).alias("n"))
    dots = F.transform(F.array(*[F.lit(int(r)) for r in r_values]),
                       lambda r: F.struct(r.alias("r"), total(F.zip_with(W.roll(x, r), y, lambda a, b: a * b)).alias("d")))

    def points(m):
        return F.flatten(F.transform(dots, lambda d: F.transform(su, lambda g: F.struct(
            d["r"].alias("r"), g["s"].alias("s"), g["u"].alias("u"),
            (g["s"] * g["s"] * m["q1"] + m["q2"] / (g["s"] * g["s"]) - 2 * d["d"] + 4 * g["u"] * (g["s"] * m["s1"] - m["s2"] / g["s"])
             + 4 * g["u"] * g["u"] * m["n"]).alias("e")))))

    def exact(grid, m):
        slack = (m["q1"] * 4 + m["q2"] * 4 + m["n"] + 1) * 1e-9
        return bound_min(grid, lambda least: F.array_min(F.transform(F.filter(grid, lambda c: c["e"] <= least + slack), lambda c: F.struct(
            W.shift_scale_distance(x, y, c["s"], c["u"], c["r"]).alias("dist"), F.abs(c["r"]).alias("ar"), c["r"].alias("r"), c["s"].alias("s"), c["u"].alias("u")))))

    def bound_min(grid, f):
        return W.bound(F.array_min(F.transform(grid, lambda c: c["e"])), f)

    best = W.bound(sums, lambda m: W.bound(points(m), lambda grid: exact(grid, m)))
    return pairs.withColumn("_b", best).select(*keys, F.col("_b.dist").alias("dist"), F.col("_b.s").alias("s"), F.col("_b.u").alias("u"),
                                               F.col("_b.r").alias("r"))


def least_shift_scale(pairs: DataFrame, v1: str = "v1", v2: str = "v2", keys: Sequence[str] = ("u1", "u2"),
                      least_s: float = 1e-3, most_s: float = 1e3) -> DataFrame:
    """the least shift/scale distance of two equal-length waves over all real s > 0 and u and all circular shifts r,
    and where it is: ``keys, dist, s, u, r``.

    For given s and r the best u is ``(S2 / s - s S1) / 2n``; put in, the squared distance is ``A s^2 + B / s^2 + C_r`` with
    ``A = Q1 - S1^2/n``, ``B = Q2 - S2^2/n`` and ``C_r = 2 S1 S2 / n - 2 D_r``, so the best r has the greatest dot product D_r
    (ties: smallest ``|r|``, then r) and ``s = (B / A)^(1/4)``, kept within ``least_s..most_s`` (a constant wave has no best s).
    """
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, t: acc + t)
    x, y = F.col(v1), F.col(v2)
    n = F.size(x)
    sums = F.struct(total(x).alias("s1"), total(y).alias("s2"))
    turn = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i * 2 <= n, i).otherwise(i - n))
    dots = F.transform(turn, lambda r: F.struct(total(F.zip_with(W.roll(x, r), y, lambda a, b: a * b)).alias("d"), (-F.abs(r)).alias("near"), (-r).alias("neg")))

    def rest(m):
        spread = lambda a, t: total(F.transform(a, lambda z: (z - t / n) * (z - t / n)))
        return F.struct(m["s1"].alias("s1"), m["s2"].alias("s2"), spread(x, m["s1"]).alias("a"), spread(y, m["s2"]).alias("b"))

    def place(m):
        s = F.least(F.lit(most_s), F.greatest(F.lit(least_s), F.pow(F.try_divide(m["b"], m["a"]), F.lit(0.25))))
        s = F.when((m["a"] == 0) & (m["b"] == 0), F.lit(1.0)).when(m["a"] == 0, F.lit(most_s)).otherwise(s)
        return W.bound(s, lambda s: F.struct(s.alias("s"), ((m["s2"] / s - s * m["s1"]) / (2 * n)).alias("u")))

    at = W.bound(sums, lambda m: W.bound(rest(m), place))
    put = pairs.select(*keys, v1, v2, at.alias("_p"), (-F.array_max(dots)["neg"]).alias("r"))
    return put.select(*keys, W.shift_scale_distance(v1, v2, F.col("_p.s"), F.col("_p.u"), F.col("r")).alias("dist"), F.col("_p.s").alias("s"), F.col("_p.u").alias("u"), "r")


def pulse_fit(waves: DataFrame, keys: Sequence[str], v: str = "v", baseline="zero", threshold: float = 0.2,
              center: float | None = None, keep_wave: bool = False) -> DataFrame:
    """fit ``a + b exp(-(x-c)^2/d)`` to each row's array in closed form (x is the position).

    With the baseline ``a`` given (``'zero'``, ``'min'`` or a number), ``ln(v - a)`` is a
    quadratic ``q0 + q1 u + q2 u^2`` in ``u = x - center``; eight sums over the samples with
    ``v - a > threshold * (max - a)`` (and ``v - a > 0``) give it by Cramer's rule. Then
    ``d = -1/q2``, ``c = center - q1/(2 q2)``, ``b = exp(q0 - q1^2/(4 q2))`` and ``res`` is the
    squared residual over all samples. Nulls when ``q2 >= 0`` or fewer than three samples.
    ``center`` defaults to the middle of the positions. All folds stay in the row: no join, no shuffle.
    """
    thr = float(threshold or 0.0)
    if baseline == "zero":
        a = F.lit(0.0)
    elif baseline == "min":
        a = F.array_min(v)
    else:
        a = F.lit(float(baseline))
    xbar = F.lit(float(center)) if center is not None else (F.size(v) - 1) / F.lit(2.0)
    names = ("n", "su", "s2", "s3", "s4", "l0", "l1", "l2")
    zero = F.struct(*[F.lit(0.0).alias(k) for k in names])

    def step(acc, t):
        u, lg = t["u"], t["l"]
        more = (F.lit(1.0), u, u * u, u * u * u, u * u * u * u, lg, u * lg, u * u * lg)
        return F.struct(*[(acc[k] + m).alias(k) for k, m in zip(names, more)])

    w = waves.select(*keys, F.col(v).alias("_v"), a.cast("double").alias("a"), xbar.alias("xbar"), F.array_max(v).alias("_mx"))
    y = F.transform("_v", lambda x, i: F.struct((i.cast("double") - F.col("xbar")).alias("u"), (x - F.col("a")).alias("y")))
    kept = F.filter(y, lambda t: (t["y"] > thr * (F.col("_mx") - F.col("a"))) & (t["y"] > 0))
    logs = F.transform(kept, lambda t: F.struct(t["u"].alias("u"), F.log(t["y"]).alias("l")))
    s = w.withColumn("_s", F.aggregate(logs, zero, step)).select(*keys, "_v", "a", "xbar", "_s.*")
    n, su, s2, s3, s4, l0, l1, l2 = (F.col(c) for c in names)

    def det3(a11, a12, a13, a21, a22, a23, a31, a32, a33):
        return a11 * (a22 * a33 - a23 * a32) - a12 * (a21 * a33 - a23 * a31) + a13 * (a21 * a32 - a22 * a31)

    det = det3(n, su, s2, su, s2, s3, s2, s3, s4)
    ok = (n >= 3) & (det != 0)
    q = s.select(*keys, "_v", "a", "xbar", *[F.when(ok, d / det).alias(k) for k, d in (
        ("q0", det3(l0, su, s2, l1, s2, s3, l2, s3, s4)), ("q1", det3(n, l0, s2, su, l1, s3, s2, l2, s4)),
        ("q2", det3(n, su, l0, su, s2, l1, s2, s3, l2)))])
    down = F.col("q2") < 0
    f = q.select(*keys, "_v", "a",
                 F.when(down, F.exp(F.col("q0") - F.col("q1") * F.col("q1") / (4 * F.col("q2")))).alias("b"),
                 F.when(down, F.col("xbar") - F.col("q1") / (2 * F.col("q2"))).alias("c"),
                 F.when(down, -1.0 / F.col("q2")).alias("d"))
    off = F.transform("_v", lambda x, i: F.pow(x - W.pulse(i.cast("double"), F.col("a"), F.col("b"), F.col("c"), F.col("d")), 2))
    wave = [F.col("_v").alias(v)] if keep_wave else []
    return f.select(*keys, *wave, "a", "b", "c", "d", F.when(F.col("b").isNotNull(), F.aggregate(off, F.lit(0.0), lambda acc, x: acc + x)).alias("res"))


#: Least values of b and d in the bounded fit (fixed: the reference's bounds).
LEAST_B, LEAST_D = 0.0, 1e-4


def pulse_least_squares(waves: DataFrame, keys: Sequence[str], v: str = "v", baseline="min", threshold: float = 0.2,
                        rounds: int = 60) -> DataFrame:
    """least-squares fit of ``a + b exp(-(x-c)^2/d)`` with ``b >= 0`` and ``d >= 1e-4``: ``keys, a, b, c, d, res``.

    Damped Gauss-Newton steps, all waves of an Arrow batch at once, from two starts: the closed form (``pulse_fit``) and
    ``(0, max, place of the max, 100)``; the better end counts. A step is kept only if it lowers the residual, so
    ``res`` is never above that of either start (the closed form pushed within the bounds). Null for a null or empty wave.
    """
    ship_package(waves.sparkSession)
    start = pulse_fit(waves, keys, v, baseline, threshold, keep_wave=True).withColumnRenamed(v, "_v")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in waves.select(*keys).schema)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                col = part.column(len(keys))
                got = np.full((5, part.num_rows), np.nan)
                size = np.asarray(col.value_lengths().fill_null(0))
                flat = col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
                first = np.cumsum(size) - size
                first_fit = [part.column(len(keys) + 1 + j).to_numpy(zero_copy_only=False) for j in range(4)]
                for n in np.unique(size[size > 0]):
                    rows = np.flatnonzero(size == n)
                    got[:, rows] = least_squares(flat[first[rows][:, None] + np.arange(n)], np.array([p[rows] for p in first_fit]), rounds)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keys))), *(pa.array(g, from_pandas=True) for g in got)], [*keys, "a", "b", "c", "d", "res"])

    return start.select(*keys, "_v", "a", "b", "c", "d").mapInArrow(run, f"{kinds}, a double, b double, c double, d double, res double")


def least_squares(v: np.ndarray, first: np.ndarray, rounds: int) -> np.ndarray:
    """Parameters and residual (5 x rows) of waves ``v`` (rows x samples) from the better of two starts."""
    x = np.arange(v.shape[1], dtype=float)
    plain = np.array([np.zeros(len(v)), np.maximum(v.max(axis=1), LEAST_B), v.argmax(axis=1).astype(float), np.full(len(v), 100.0)])
    known = np.isfinite(first).all(axis=0)
    first = np.where(known, first, plain)
    first[1], first[3] = np.maximum(first[1], LEAST_B), np.maximum(first[3], LEAST_D)
    ends = [_gauss_newton(v, x, p, rounds) for p in (first, plain)]
    return np.where(ends[0][4] <= ends[1][4], ends[0], ends[1])


def _shape(x, p):
    with np.errstate(over="ignore", under="ignore"):
        off = x - p[2][:, None]
        return off, np.exp(-off * off / p[3][:, None])


def _gauss_newton(v: np.ndarray, x: np.ndarray, p: np.ndarray, rounds: int) -> np.ndarray:
    p, damp = p.copy(), np.full(len(v), 1e-3)
    res = residual_of(v, x, p)
    live = np.ones(len(v), bool)
    for _ in range(rounds):
        rows = np.flatnonzero(live)
        if not len(rows):
            break
        q = p[:, rows]
        off, e = _shape(x, q)
        r = v[rows] - q[0][:, None] - q[1][:, None] * e
        be = q[1][:, None] * e / q[3][:, None]
        j = np.stack([np.ones_like(e), e, 2 * off * be, off * off * be / q[3][:, None]])
        jtj, g = np.einsum("irn,jrn->rij", j, j), np.einsum("irn,rn->ri", j, r)
        diag = np.einsum("rii->ri", jtj)
        held = ((q[1] <= LEAST_B) & (g[:, 1] < 0), (q[3] <= LEAST_D) & (g[:, 3] < 0))  # at a bound and pushed beyond it
        for k, h in zip((1, 3), held):
            jtj[h, k, :] = jtj[h, :, k] = 0
            g[h, k] = 0
        a = jtj + np.einsum("ri,ij->rij", damp[rows, None] * np.maximum(diag, 1e-30) + 1e-300, np.eye(4))
        for k, h in zip((1, 3), held):
            a[h, k, k] = 1
        with np.errstate(all="ignore"):
            try:
                step = np.linalg.solve(a, g[:, :, None])[:, :, 0].T
            except np.linalg.LinAlgError:
                step = np.stack([np.linalg.lstsq(m, y, rcond=None)[0] for m, y in zip(a, g)]).T
            new = q + np.where(np.isfinite(step), step, 0)
            new[1], new[3] = np.maximum(new[1], LEAST_B), np.maximum(new[3], LEAST_D)
            then = residual_of(v[rows], x, new)
        better = then < res[rows]
        gain = res[rows] - then
        p[:, rows[better]] = new[:, better]
        res[rows[better]] = then[better]
        damp[rows] = np.where(better, damp[rows] / 5, damp[rows] * 4)
        live[rows] = np.where(better, gain > 1e-14 * res[rows], damp[rows] < 1e12)
    return np.vstack([p, res])


def residual_of(v: np.ndarray, x: np.ndarray, p: np.ndarray) -> np.ndarray:
    _, e = _shape(x, p)
    return ((v - p[0][:, None] - p[1][:, None] * e) ** 2).sum(axis=1)


def wave_stats(waves: DataFrame, by: str = "channel", v: str = "v") -> DataFrame:
    """``by, pos, n, mean, var`` (population variance) at every position of array rows, whatever their lengths.

    A task folds its rows, Arrow batch by batch, into one count, mean and M2 vector for each value of ``by`` (few: the
    channels), and only these states are shuffled: as many bytes as tasks x channels x samples, however many rows there are.
    States are merged by the pairwise rule ``M2 + n (mean - all)^2``.
    """
    ship_package(waves.sparkSession)
    kind = waves.schema[by].dataType.simpleString()

    def fold(batches):
        held: dict = {}
        for b in batches:
            keys = b.column(0).to_pylist()
            size = np.asarray(b.column(1).value_lengths().fill_null(0)).astype(np.int64)
            flat = b.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            first = np.cumsum(size) - size
            for key in set(keys):
                rows = np.flatnonzero([x == key if key is not None else x is None for x in keys])
                width = int(size[rows].max(initial=0))
                for lo in range(0, len(rows), max(1, (1 << 21) // max(1, width))):
                    some = rows[lo:lo + max(1, (1 << 21) // max(1, width))]
                    at = np.arange(width)
                    there = at < size[some][:, None]
                    vals = flat[np.where(there, first[some][:, None] + at, 0)] if len(flat) else np.zeros(there.shape)
                    there &= ~np.isnan(vals)
                    n = there.sum(axis=0)
                    mean = np.where(there, vals, 0).sum(axis=0) / np.maximum(n, 1)
                    m2 = np.where(there, (vals - mean) ** 2, 0).sum(axis=0)
                    held[key] = _merge(held[key], (n, mean, m2)) if key in held else (n, mean, m2)
        for key, (n, mean, m2) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([key], b.schema.field(0).type), pa.array([n.tolist()], pa.list_(pa.int64())),
                                              pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([m2.tolist()], pa.list_(pa.float64()))], [by, "n", "mean", "m2"])

    states = waves.select(by, v).mapInArrow(fold, f"`{by}` {kind}, n array<long>, mean array<double>, m2 array<double>")
    each = materialize(states, "wave-states").select(by, F.posexplode(F.arrays_zip("n", "mean", "m2")).alias("pos", "s")).where("s.n > 0")
    mid = each.groupBy(by, "pos").agg((F.sum(F.col("s.n") * F.col("s.mean")) / F.sum("s.n")).alias("mean"))
    off = F.col("s.mean") - F.col("mean")
    return each.join(mid, [by, "pos"]).groupBy(by, "pos", "mean").agg(F.sum("s.n").alias("n"), F.sum(F.col("s.m2") + F.col("s.n") * off * off).alias("m2")) \
        .select(by, "pos", "n", "mean", (F.col("m2") / F.col("n")).alias("var"))


def _merge(p, q):
    """Count, mean and M2 vectors of two sets of rows, the shorter ones filled up with nothing."""
    width = max(len(p[0]), len(q[0]))
    p, q = ([np.concatenate([a, np.zeros(width - len(a), a.dtype)]) for a in s] for s in (p, q))
    n = p[0] + q[0]
    some = np.maximum(n, 1)
    gap = q[1] - p[1]
    return n, np.where(p[0] == 0, q[1], p[1] + gap * q[0] / some), p[2] + q[2] + np.where((p[0] > 0) & (q[0] > 0), gap * gap * p[0] * q[0] / some, 0)


def renormalize(waves: DataFrame, stats: DataFrame, keys: Sequence[str], divisor: str = "std", v: str = "v") -> DataFrame:
    """rows ``keys, channel, v ARRAY``: ``(v - mean) / std`` by (channel, pos) population stats, then each
    row z-scored; ``divisor='variance'`` divides by the variance (the reference's formula). The stats are
    folded into one array row for each channel (a size fixed by the file format), which is broadcast; the samples
    are not shuffled."""
    if divisor not in ("std", "variance"):
        raise ValueError("divisor must be 'std' or 'variance'")
    den = F.sqrt("var") if divisor == "std" else F.col("var")
    per = stats.select("channel", "pos", "mean", F.when(den == 0, F.lit(1.0)).otherwise(den).alias("den")) \
        .groupBy("channel").agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "den"))).alias("_st"))
    j = waves.join(F.broadcast(per), "channel")
    scaled = F.zip_with(F.col(v), F.slice("_st", F.lit(1), F.size(v)), lambda x, t: (x - t["mean"]) / t["den"])
    return j.select(*keys, "channel", W.zscore(scaled).alias(v))
