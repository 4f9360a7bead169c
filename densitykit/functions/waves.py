"""Waveform functions on ``ARRAY<DOUBLE>`` columns.

All are built-in higher-order functions (``aggregate``, ``transform``, ``zip_with``,
``slice``), evaluated in the JVM; no Python UDF is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def wave_sum(v) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x)


def wave_mean(v) -> Column:
    v = _c(v)
    return wave_sum(v) / F.size(v)


def bound(v, f) -> Column:
    """``f`` of an array that is evaluated once, however often f uses it."""
    return F.element_at(F.transform(F.array(_c(v)), f), 1)


def _with_moments(v, f) -> Column:
    """``f(array, mean, population std)``, each computed once: linear in the array length."""
    def moments(a):
        n = F.size(a)
        return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x, lambda total: bound(F.try_divide(total, n), lambda m: F.aggregate(
            a, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m), lambda ss: f(a, m, F.sqrt(F.try_divide(ss, n))))))

    return bound(v, moments)


def wave_std(v) -> Column:
    """Population standard deviation (ddof 0)."""
    return _with_moments(v, lambda a, m, sd: sd)


def zscore(v) -> Column:
    """``(v - mean) / std`` with the population std; a zero std divides by 1."""
    return _with_moments(v, lambda a, m, sd: bound(F.when(sd == 0, F.lit(1.0)).otherwise(sd), lambda d: F.transform(a, lambda x: (x - m) / d)))


def wave_window(v, start: int, length: int) -> Column:
    """``v[start : start + length]`` (0-based start, like a Python slice)."""
    return F.slice(_c(v), start + 1, length)


def peak_index(v) -> Column:
    """0-based position of the first maximum."""
    v = _c(v)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def peak_value(v) -> Column:
    return F.array_max(_c(v))


def roll(v, n) -> Column:
    """circular shift like ``np.roll(v, n)``: ``out[i] = v[(i - n) mod size]``. A
    fractional n is truncated towards zero first."""
    n = _lit(n).cast("double").cast("int") if not isinstance(n, int) else F.lit(n)

    def shifted(a):
        size = F.size(a)
        s = F.pmod(n, size)  # last s elements first, then the rest
        return F.when(s == 0, a).otherwise(F.concat(F.slice(a, size - s + 1, s), F.slice(a, 1, size - s)))

    return bound(v, shifted)


def align_peak(v, center: int, before: int, after: int) -> Column:
    """roll the first maximum to ``center``, keep ``[center-before, center+after)`` and
    z-score it (the reference uses center 1023, before 64, after 192)."""
    rolled = bound(v, lambda a: roll(a, F.lit(center) - peak_index(a)))
    return zscore(F.slice(rolled, center - before + 1, before + after))


def euclidean(v1, v2) -> Column:
    """Euclidean distance of two equal-length arrays."""
    return F.sqrt(F.aggregate(F.zip_with(_c(v1), _c(v2), lambda a, b: (a - b) * (a - b)),
                              F.lit(0.0), lambda acc, x: acc + x))


def scaled_distance(v1, v2) -> Column:
    """distance of the z-scored waveforms."""
    return euclidean(zscore(v1), zscore(v2))


def shift_scale_distance(v1, v2, s, u, r) -> Column:
    """F8: ``dist(roll(v1, r) * s + u, v2 / s - u)``."""
    s, u = _lit(s), _lit(u)
    a = F.transform(roll(v1, r), lambda x: x * s + u)
    b = F.transform(_c(v2), lambda x: x / s - u)
    return euclidean(a, b)


def pulse(x, a, b, c, d) -> Column:
    """``a + b * exp(-(x - c)^2 / d)``."""
    x, a, b, c, d = (_lit(t) if not isinstance(t, str) else F.col(t) for t in (x, a, b, c, d))
    return a + b * F.exp(-((x - c) * (x - c)) / d)
