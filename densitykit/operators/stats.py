"""Statistics, scaling, sorting and sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounding_box(df: DataFrame, axes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """B1: ``lo ARRAY<DOUBLE>, hi ARRAY<DOUBLE>`` of the rows (per group with ``by``).
    Over no rows the box is null (the empty box)."""
    mins = [F.min(F.col(a).cast("double")).alias(f"_lo{i}") for i, a in enumerate(axes)]
    maxs = [F.max(F.col(a).cast("double")).alias(f"_hi{i}") for i, a in enumerate(axes)]
    g = df.groupBy(*by).agg(*mins, *maxs) if by else df.agg(*mins, *maxs)
    lo = F.array(*[F.col(f"_lo{i}") for i in range(len(axes))])
    hi = F.array(*[F.col(f"_hi{i}") for i in range(len(axes))])
    empty = F.col("_lo0").isNull()
    return g.select(*by, F.when(empty, None).otherwise(lo).alias("lo"),
                    F.when(empty, None).otherwise(hi).alias("hi"))


def col_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A1: per column mean and sample variance (n-1), one row."""
    return df.agg(F.count(F.lit(1)).alias("n"),
                  *[F.avg(c).alias(f"mean_{c}") for c in cols],
                  *[F.var_samp(c).alias(f"var_{c}") for c in cols])


def standardize(df: DataFrame, cols: Sequence[str], ddof: int = 1, keep: Sequence[str] = ()) -> DataFrame:
    """A2: ``(x - mean) / std`` per column. The one-row statistics are joined as a broadcast
    single row (no driver round trip). ``ddof=1`` sample std, ``0`` population std; a zero
    std divides by 1."""
    std = F.stddev_samp if ddof == 1 else F.stddev_pop
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[std(c).alias(f"_s_{c}") for c in cols])
    j = df.crossJoin(F.broadcast(stats))
    out = []
    for c in cols:
        s = F.col(f"_s_{c}")
        s = F.when(s.isNull() | (s == 0), F.lit(1.0)).otherwise(s)
        out.append(((F.col(c) - F.col(f"_m_{c}")) / s).alias(c))
    return j.select(*keep, *out)


def moments(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A3: count, mean and population variance in one pass (per group with ``by``)."""
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(c).alias(f"mean_{c}") for c in cols] + \
           [F.var_pop(c).alias(f"var_{c}") for c in cols]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def min_by_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """A5: smallest value per key."""
    return df.groupBy(key).agg(F.min(value).alias(value))


def values_by_key(df: DataFrame, key: str, value: str, sep: str = ";") -> DataFrame:
    """All values of a key, sorted and joined with ``sep``."""
    return df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.col(value).cast("string"))), sep)
                               .alias(value + "s"))


def cluster_sample(df: DataFrame, label: str, order: str, first_n: int = 20, label_value=0) -> DataFrame:
    """The first ``first_n`` rows (by ``order``) of one label and every row of the
    others. The head is a top-k (each task keeps its best ``first_n``, then one merge), so
    the large label never moves as a whole."""
    head = df.where(F.col(label) == F.lit(label_value)).orderBy(order).limit(first_n)
    return head.unionByName(df.where(F.col(label) != F.lit(label_value)))
