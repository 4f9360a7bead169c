"""Point tables.

Internally a point table is ``id, x0 .. x{k-1}`` (all DOUBLE), optionally followed by
payload columns. Keeping the axes as plain columns (not an array) lets Catalyst prune and
push filters and keeps the distance expressions inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def axis_names(k: int, prefix: str = "x") -> list[str]:
    return [f"{prefix}{i}" for i in range(k)]


def point_dim(points: DataFrame) -> int:
    """Number of ``x<i>`` axis columns of a point table."""
    k = 0
    cols = set(points.columns)
    while f"x{k}" in cols:
        k += 1
    if k == 0:
        raise ValueError("not a point table: no x0 column")
    return k


def _guard(c: Column, name: str, nulls: str) -> Column:
    bad = c.isNull() | F.isnan(c)
    if nulls == "error":
        return F.when(bad, F.raise_error(F.lit(f"null or NaN coordinate in {name}"))).otherwise(c)
    return c


def as_points(df: DataFrame, key: str = "id", cols: Sequence[str] | None = None,
              array_col: str | None = None, k: int | None = None, nulls: str = "error",
              keep: Sequence[str] = (), axes: Sequence[int] | None = None) -> DataFrame:
    """Select a key and k coordinates as ``id, x0..x{k-1}`` DOUBLE.

    ``cols`` names one column per axis; ``array_col`` names an array column whose elements are
    the axes; every row must have exactly ``k`` of them (k defaults to the size of the first row's
    array), another size fails the job. ``axes`` picks elements of the array (0-based) as x0, x1, ..
    ``nulls='error'`` fails the job on a null/NaN coordinate,
    lazily (``raise_error`` inside the projection, no extra pass); ``'drop'`` filters them.
    """
    if nulls not in ("error", "drop"):
        raise ValueError("nulls must be 'error' or 'drop'")
    if (cols is None) == (array_col is None):
        raise ValueError("give exactly one of cols or array_col")
    if cols is not None:
        exprs = [F.col(c).cast("double") for c in cols]
        names = list(cols)
    else:
        if k is None:
            first = df.select(F.size(array_col).alias("n")).where("n >= 0").first()
            k = int(first["n"]) if first is not None else 0
            if k == 0:
                raise ValueError(f"cannot infer k from {array_col}")
        arr = F.col(array_col)
        size_ok = F.when(F.size(arr) != F.lit(k),
                         F.raise_error(F.lit(f"{array_col} does not have {k} elements")))
        pick = list(range(k)) if axes is None else [int(i) for i in axes]
        exprs = [F.coalesce(size_ok, arr[i]).cast("double") if n == 0 else arr[i].cast("double")
                 for n, i in enumerate(pick)]
        names = [f"{array_col}[{i}]" for i in pick]
    out = df.select(F.col(key).alias("id"),
                    *[_guard(e, n, nulls).alias(f"x{i}") for i, (e, n) in enumerate(zip(exprs, names))],
                    *[F.col(c) for c in keep])
    if nulls == "drop":
        cond = None
        for i in range(len(exprs)):
            ok = F.col(f"x{i}").isNotNull() & ~F.isnan(F.col(f"x{i}"))
            cond = ok if cond is None else cond & ok
        out = out.where(cond)
    return out


def finite(points: DataFrame, k: int | None = None) -> Column:
    """Whether every coordinate is a finite number."""
    ok = None
    for c in axis_names(k or point_dim(points)):
        t = F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf")))
        ok = t if ok is None else ok & t
    return ok


def points_array(points: DataFrame, k: int | None = None, name: str = "p") -> DataFrame:
    """``id, x0..`` -> ``id, p ARRAY<DOUBLE>`` (the keyed-vector shape)."""
    k = k or point_dim(points)
    return points.select("id", F.array(*axis_names(k)).alias(name))


def check_unique_keys(points: DataFrame, key: str = "id") -> None:
    """Raise if a key occurs twice (one aggregate over the key column only)."""
    dup = points.groupBy(key).count().where("count > 1").limit(1).collect()
    if dup:
        raise ValueError(f"duplicate key {dup[0][key]!r}: keys must be unique")


def parse_vector_text(line: Column) -> Column:
    """``"(1, [2.0, 3.5])"`` -> ``[1.0, 2.0, 3.5]``: strip ``([])``, split on ``,``, cast."""
    cleaned = F.regexp_replace(line, r"[\(\[\]\)]", "")
    return F.transform(F.split(cleaned, ","), lambda s: F.trim(s).cast("double"))


def read_vectors_text(spark, path: str, id_first: bool = False) -> DataFrame:
    """Vectors from text files, one per line. ``id_first`` takes the first value as the key
    (the shape a ``(key, [v..])`` tuple dump has); else ``values`` only."""
    df = spark.read.text(path).select(parse_vector_text(F.col("value")).alias("values"))
    if id_first:
        return df.select(F.col("values")[0].cast("bigint").alias("id"),
                         F.slice("values", 2, F.size("values") - 1).alias("values"))
    return df
