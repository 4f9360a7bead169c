"""Box algebra over ``lo``/``hi`` array columns.

A box is a pair of ``ARRAY<DOUBLE>`` columns; every function returns a Column, so the same
expression applies to one box or to a table of millions of boxes. The empty box of
dimension k is the null result of an aggregate over no rows (see ``stats.bounding_box``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def box_from_point(*axes) -> Column:
    """B2: the degenerate box ``lo = hi = point``."""
    v = F.array(*[_c(a).cast("double") for a in axes])
    return F.struct(v.alias("lo"), v.alias("hi"))


def box_union(lo1, hi1, lo2, hi2) -> Column:
    """Smallest box holding both."""
    return F.struct(F.zip_with(_c(lo1), _c(lo2), lambda a, b: F.least(a, b)).alias("lo"),
                    F.zip_with(_c(hi1), _c(hi2), lambda a, b: F.greatest(a, b)).alias("hi"))


def box_intersection(lo1, hi1, lo2, hi2) -> Column:
    """Per-axis max of lows, min of highs. The result may be inverted; ``is_empty`` says so."""
    lo = F.zip_with(_c(lo1), _c(lo2), lambda a, b: F.greatest(a, b))
    hi = F.zip_with(_c(hi1), _c(hi2), lambda a, b: F.least(a, b))
    return F.struct(lo.alias("lo"), hi.alias("hi"),
                    F.exists(F.zip_with(lo, hi, lambda a, b: a > b), lambda t: t).alias("is_empty"))


def _replace(arr: Column, dim, value) -> Column:
    return F.transform(arr, lambda x, i: F.when(i == _lit(dim), _lit(value).cast("double")).otherwise(x))


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def box_split(lo, hi, dim, value) -> Column:
    """``array(left, right)``: left has ``hi[dim] = value``, right has ``lo[dim] = value``."""
    lo, hi = _c(lo), _c(hi)
    return F.array(F.struct(lo.alias("lo"), _replace(hi, dim, value).alias("hi")),
                   F.struct(_replace(lo, dim, value).alias("lo"), hi.alias("hi")))


def box_expand_add(lo, hi, eps) -> Column:
    """B6 ``how='add'``: move each side out by eps (a number, or a list with one value per axis)."""
    lo, hi = _c(lo), _c(hi)
    if isinstance(eps, (list, tuple)):
        e = F.array(*[F.lit(float(v)) for v in eps])
        return F.struct(F.zip_with(lo, e, lambda a, b: a - b).alias("lo"),
                        F.zip_with(hi, e, lambda a, b: a + b).alias("hi"))
    e = _lit(float(eps) if not isinstance(eps, Column) else eps)
    return F.struct(F.transform(lo, lambda a: a - e).alias("lo"), F.transform(hi, lambda a: a + e).alias("hi"))


def box_expand_multiply(lo, hi, eps) -> Column:
    """B6 ``how='multiply'``: move each side out by eps times the box span on that axis."""
    lo, hi = _c(lo), _c(hi)
    span = F.zip_with(hi, lo, lambda h, l: h - l)
    if isinstance(eps, (list, tuple)):
        e = F.array(*[F.lit(float(v)) for v in eps])
        grow = F.zip_with(span, e, lambda s, v: s * v)
    else:
        ev = _lit(float(eps) if not isinstance(eps, Column) else eps)
        grow = F.transform(span, lambda s: s * ev)
    return F.struct(F.zip_with(lo, grow, lambda a, g: a - g).alias("lo"),
                    F.zip_with(hi, grow, lambda a, g: a + g).alias("hi"))


def box_expand(lo, hi, eps, how: str = "add") -> Column:
    """B6 dispatcher; an unknown ``how`` raises (the reference returned None)."""
    if how == "add":
        return box_expand_add(lo, hi, eps)
    if how == "multiply":
        return box_expand_multiply(lo, hi, eps)
    raise ValueError("how must be 'add' or 'multiply'")


def box_contains(lo, hi, vector) -> Column:
    """``lo <= v <= hi`` on every axis (inclusive on both sides)."""
    lo, hi, v = _c(lo), _c(hi), _c(vector)
    inside = F.zip_with(F.zip_with(lo, v, lambda a, b: a <= b), F.zip_with(v, hi, lambda a, b: a <= b),
                        lambda p, q: p & q)
    return F.forall(inside, lambda t: t)


def box_contains_cols(lo, hi, axes: Sequence[str]) -> Column:
    """B7 on point columns: a plain conjunction of per-axis ``between`` (no arrays on the
    point side, so it stays a simple predicate)."""
    lo, hi = _c(lo), _c(hi)
    cond = None
    for i, a in enumerate(axes):
        t = F.col(a).between(lo[i], hi[i])
        cond = t if cond is None else cond & t
    return cond


def box_in_box(lo_outer, hi_outer, lo_inner, hi_inner) -> Column:
    """The inner box lies in the outer one: ``hi_outer >= hi_inner`` and
    ``lo_outer <= lo_inner`` on every axis."""
    ok = F.zip_with(F.zip_with(_c(hi_outer), _c(hi_inner), lambda a, b: a >= b),
                    F.zip_with(_c(lo_outer), _c(lo_inner), lambda a, b: a <= b),
                    lambda p, q: p & q)
    return F.forall(ok, lambda t: t)
