"""Voxel grid (V1-V5): a point's voxel is its lower corner ``floor(x / (2 eps))``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densitykit.operators.points import axis_names, point_dim


def voxel_corners(points: DataFrame, eps: float, k: int | None = None) -> DataFrame:
    """V1: ``id, c0..c{k-1}`` BIGINT with side ``2 eps``."""
    k = k or point_dim(points)
    w = F.lit(2.0 * float(eps))
    return points.select("id", *[F.floor(F.col(c) / w).cast("bigint").alias(f"c{i}")
                                 for i, c in enumerate(axis_names(k))])


def voxel_counts(corners: DataFrame, k: int) -> DataFrame:
    """V2: points per voxel (partial + final aggregate)."""
    return corners.groupBy(*[f"c{i}" for i in range(k)]).agg(F.count(F.lit(1)).alias("cnt"))


def voxel_bounds(counts: DataFrame, k: int) -> DataFrame:
    """V3: lowest and highest corner on every axis (one row: ``lo0.., hi0..``)."""
    return counts.agg(*[F.min(f"c{i}").alias(f"lo{i}") for i in range(k)],
                      *[F.max(f"c{i}").alias(f"hi{i}") for i in range(k)])


def voxel_range_count(counts: DataFrame, bounds: DataFrame, k: int) -> DataFrame:
    """V4: for each row of ``bounds`` (``lo0.., hi0..``; usually the one row of ``voxel_bounds``), the points in voxels
    lying inside that voxel range (B8 per axis): ``lo.., hi.., n``. A range without points has no row."""
    cond = None
    for i in range(k):
        t = (F.col(f"c{i}") >= F.col(f"lo{i}")) & (F.col(f"c{i}") <= F.col(f"hi{i}"))
        cond = t if cond is None else cond & t
    ends = [f"{e}{i}" for i in range(k) for e in ("lo", "hi")]
    return counts.join(bounds, cond).groupBy(*ends).agg(F.sum("cnt").cast("bigint").alias("n"))


def voxel_range_counts(counts: DataFrame, ranges: DataFrame, k: int, name: str = "n") -> DataFrame:
    """V4 for many ranges: every row of ``ranges`` (``lo0.., hi0..`` inclusive, any other columns) with the points in the
    voxels inside it, 0 if there are none or an end is null or inverted.

    Counts are summed over the blocks of a binary hierarchy on every axis (block j has the voxels whose corners agree but
    for the last j bits), and a range is the sum of the at most two blocks a level that tile it on each axis.
    So a range looks up a number of sums that depends on the logarithm of the extent, and no voxel is compared with a range.
    """
    ext = counts.agg(*[F.min(f"c{i}").alias(f"lo{i}") for i in range(k)], *[F.max(f"c{i}").alias(f"hi{i}") for i in range(k)]).first()
    ends = [f"{e}{i}" for i in range(k) for e in ("lo", "hi")]
    ids = ranges.select(*ends).distinct()
    if ext["lo0"] is None:
        return ranges.withColumn(name, F.lit(0).cast("bigint"))
    nodes, wanted = counts, ids
    for i in range(k):
        low, top = ext[f"lo{i}"], ext[f"hi{i}"] - ext[f"lo{i}"]
        bits = max(1, int(top).bit_length())
        place = F.col(f"c{i}") - F.lit(low)
        nodes = nodes.withColumn(f"_n{i}", F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.shiftright(place, j).alias("m")) for j in range(bits + 1)])))
        first = F.greatest(F.col(f"lo{i}") - F.lit(low), F.lit(0).cast("bigint"))
        last = F.least(F.col(f"hi{i}") - F.lit(low), F.lit(top).cast("bigint")) + 1
        wanted = wanted.withColumn(f"_n{i}", F.explode(F.when(F.col(f"lo{i}").isNotNull() & F.col(f"hi{i}").isNotNull() & (first < last), _tiles(first, last, bits))))
    at = [f"_n{i}" for i in range(k)]
    sums = nodes.groupBy(*at).agg(F.sum("cnt").alias("_s"))
    found = wanted.join(sums, at).groupBy(*ends).agg(F.sum("_s").cast("bigint").alias(name))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ends]
    return ranges.alias("r").join(found.alias("f"), same, "left").select("r.*", F.coalesce(F.col(f"f.{name}"), F.lit(0)).cast("bigint").alias(name))


def _tiles(first, last, bits: int):
    """Blocks ``(j, m)`` that tile ``[first, last)``: at most two a level."""
    node = lambda j, m: F.struct(j.cast("int").alias("j"), m.alias("m"))
    none = F.array().cast("array<struct<j:int,m:bigint>>")

    def up(s, j):
        l, r = s["l"], s["r"]
        live = l < r
        odd_l, odd_r = live & (F.pmod(l, F.lit(2)) == 1), live & (F.pmod(r, F.lit(2)) == 1)
        l2, r2 = l + odd_l.cast("bigint"), r - odd_r.cast("bigint")
        here = F.filter(F.array(F.when(odd_l, node(j, l)), F.when(odd_r & (r2 >= l2), node(j, r2))), lambda x: x.isNotNull())
        return F.struct(F.when(live, F.shiftright(l2, 1)).otherwise(l).alias("l"), F.when(live, F.shiftright(r2, 1)).otherwise(r).alias("r"), F.concat(s["out"], here).alias("out"))

    start = F.struct(first.cast("bigint").alias("l"), last.cast("bigint").alias("r"), none.alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(bits)), start, up, lambda s: s["out"])


def voxel_key_counts(df: DataFrame, p1: str = "p1", p2: str = "p2", weight: str | None = None) -> DataFrame:
    """V5: a voxel ``(p1, p2)`` (two corner arrays) used as a grouping key; sums ``weight``
    (or counts rows) per voxel."""
    agg = F.sum(weight).cast("bigint") if weight else F.count(F.lit(1))
    return df.groupBy(F.struct(F.col(p1).alias("p1"), F.col(p2).alias("p2")).alias("voxel")) \
        .agg(agg.alias("cnt")).select("voxel.p1", "voxel.p2", "cnt")
