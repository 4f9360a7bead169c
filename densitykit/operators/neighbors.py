"""eps-neighbour joins (D1) and neighbour counts.

Spark plans a range predicate between two tables as a nested-loop join, so the eps-join is
rewritten into an equi-join:

* ``grid`` (k <= 3): the key is a cell ``floor(x / side)`` with ``side >= eps``; a pair within
  eps lies in the same or an adjacent cell. For a self-join only half of the 3^k neighbour
  offsets are replicated (the lexicographically positive ones plus the cell itself) and the
  cross-cell pairs are mirrored, so each unordered pair is compared once.
* ``kd``: every row of the left side has one home part; the right side is copied into each
  part whose box grown by eps contains it (a join against the broadcast box table, whose size
  is bounded by the part count). The equi-join is on the part label.

Both end in the exact distance filter, written exactly as the SQL oracle writes it (squared
differences summed left to right, compared with eps*eps, all in DOUBLE).
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from densitykit.operators.points import axis_names, finite, point_dim
from densitykit.session import materialize

METRICS = ("euclidean", "manhattan", "chebyshev")


def _check_metric(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, got {metric!r}")


def distance_expr(a: Sequence[str], b: Sequence[str], metric: str = "euclidean") -> Column:
    """Distance between two points given as column-name lists."""
    _check_metric(metric)
    diffs = [F.col(x) - F.col(y) for x, y in zip(a, b)]
    if metric == "euclidean":
        return F.sqrt(_sum([d * d for d in diffs]))
    if metric == "manhattan":
        return _sum([F.abs(d) for d in diffs])
    return F.greatest(*[F.abs(d) for d in diffs]) if len(diffs) > 1 else F.abs(diffs[0])


def within_diffs(diffs: Sequence[Column], eps: float, metric: str = "euclidean") -> Column:
    """Whether a distance with these differences along the axes is within eps (euclidean compares squared
    distance with eps*eps)."""
    _check_metric(metric)
    e = F.lit(float(eps))
    if metric == "euclidean":
        return _sum([d * d for d in diffs]) <= e * e
    if metric == "manhattan":
        return _sum([F.abs(d) for d in diffs]) <= e
    return (F.greatest(*[F.abs(d) for d in diffs]) if len(diffs) > 1 else F.abs(diffs[0])) <= e


def within_expr(a: Sequence[str], b: Sequence[str], eps: float, metric: str = "euclidean") -> Column:
    """``dist(a, b) <= eps`` of two points given as column-name lists."""
    return within_diffs([F.col(x) - F.col(y) for x, y in zip(a, b)], eps, metric)


def _sum(cs: list[Column]) -> Column:
    out = cs[0]
    for c in cs[1:]:
        out = out + c
    return out


@dataclass
class Bounds:
    """Least coordinate and greatest extent of a point table, and the axis that has it."""

    low: list[float]
    width: float
    widest: int = 0


def bounds(points: DataFrame, k: int | None = None, unique: bool = False) -> Bounds:
    """Extent of the points (one job). Raises on a null, NaN or infinite coordinate, which would make every cell number
    meaningless, and with ``unique`` on a key that occurs twice."""
    k = k or point_dim(points)
    axes = axis_names(k)
    some = [F.count(F.lit(1)).alias("n"), F.count_if(~finite(points, k)).alias("bad"), *[F.min(c).alias(f"lo{i}") for i, c in enumerate(axes)],
            *[F.max(c).alias(f"hi{i}") for i, c in enumerate(axes)]]
    if unique:
        each = points.groupBy("id").agg(*some)
        row = each.agg(F.sum("bad").alias("bad"), F.min(F.when(F.col("n") > 1, F.col("id"))).alias("twice"),
                       *[F.min(f"lo{i}").alias(f"lo{i}") for i in range(k)], *[F.max(f"hi{i}").alias(f"hi{i}") for i in range(k)]).first()
        if row["twice"] is not None:
            raise ValueError(f"duplicate key {row['twice']!r}: keys must be unique")
    else:
        row = points.agg(*some).first()
    if row["bad"]:
        raise ValueError(f"{row['bad']} points have a null, NaN or infinite coordinate (nulls='drop' leaves them out)")
    low = [float(row[f"lo{i}"] or 0.0) for i in range(k)]
    extent = [float(row[f"hi{i}"] or 0.0) - low[i] for i in range(k)]
    return Bounds(low, max(extent, default=0.0), extent.index(max(extent)) if extent else 0)


def usable(points: DataFrame, k: int, nulls: str) -> DataFrame:
    """``nulls='drop'`` leaves out points with a null, NaN or infinite coordinate."""
    if nulls not in ("error", "drop"):
        raise ValueError("nulls must be 'error' or 'drop'")
    return points.where(finite(points, k)) if nulls == "drop" else points


def coarse_side(eps: float, width: float) -> float:
    """Cell side for candidate search in a table of this extent: at least eps, widened by a margin that covers the
    rounding of ``(x - low) / side`` and of the distance arithmetic (a pair at computed distance eps
    must never land two cells apart)."""
    return float(eps) * (1 + 1e-9) + 1e-12 * width


def with_cells(df: DataFrame, k: int, side: float, origin: Sequence[float]) -> DataFrame:
    s = F.lit(float(side))
    return df.withColumns({f"c{i}": F.floor((F.col(f"x{i}") - F.lit(float(origin[i]))) / s).cast("long") for i in range(k)})


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def _offsets(k: int, half: bool) -> list[tuple[int, ...]]:
    offs = list(itertools.product((-1, 0, 1), repeat=k))
    if half:
        zero = (0,) * k
        offs = [zero] + [o for o in offs if o > zero]
    return offs


#: Candidate pairs that a task of an eps-join has, about.
TASK_PAIRS, MOST_TASKS = 1 << 23, 1 << 13


def join_tasks(points: DataFrame, keys: Sequence[Column], copies: int) -> int:
    """Tasks for the equi-join of ``points`` with ``copies`` of itself on ``keys``, from the pairs it forms (one job). The rows are
    few and short beside those pairs, so by their bytes (AQE) the join would get too few tasks, or a broadcast side."""
    n = points.groupBy(*[c.alias(f"k{i}") for i, c in enumerate(keys)]).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return pair_tasks(points.sparkSession, (n.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0.0) * copies)


def pair_tasks(spark: SparkSession, pairs: float) -> int:
    """Tasks for a step that forms so many pairs."""
    return int(min(MOST_TASKS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), pairs // TASK_PAIRS)))


def _dealt(left: DataFrame, right: DataFrame, on: list[str], tasks: int | None) -> DataFrame:
    if tasks is None:
        return left.join(right, on=on, how="inner")
    return left.repartition(tasks, *on).hint("merge").join(right.repartition(tasks, *on), on=on, how="inner")


def grid_candidates(left: DataFrame, right: DataFrame, k: int, side: float, origin: Sequence[float],
                    symmetric: bool = False, keys: Sequence[str] = (), tasks: int | None = None) -> DataFrame:
    """Equi-join of ``left`` (home cell) with ``right`` copied into neighbour cells.

    Inputs are point tables (``id, x0.., payload``). Output columns are the left columns
    prefixed ``a_`` and the right ones prefixed ``b_``; with ``symmetric=True`` (left and
    right are the same table) only half the offsets are used and a ``mirror`` flag marks the
    cross-cell rows whose reverse pair must also be emitted. ``keys`` are extra columns of
    both sides that must be equal (a group).
    """
    lc = _prefixed(with_cells(left, k, side, origin), "a_")
    rc = with_cells(right, k, side, origin)
    offs = _offsets(k, symmetric)
    off_arr = F.array(*[F.struct(F.lit(j).alias("o"), *[F.lit(v).alias(f"d{i}") for i, v in enumerate(o)])
                        for j, o in enumerate(offs)])
    rcols = [c for c in right.columns]
    rx = rc.select(*[F.col(c).alias("b_" + c) for c in rcols],
                   *[F.col(f"c{i}").alias(f"_c{i}") for i in range(k)],
                   F.explode(off_arr).alias("_off"))
    rx = rx.select(*[F.col("b_" + c) for c in rcols],
                   *[F.col("b_" + g).alias("a_" + g) for g in keys],
                   *[(F.col(f"_c{i}") - F.col(f"_off.d{i}")).alias(f"a_c{i}") for i in range(k)],
                   *([(F.col("_off.o") > 0).alias("mirror")] if symmetric else []))
    on = [f"a_{g}" for g in keys] + [f"a_c{i}" for i in range(k)]
    return _dealt(lc, rx, on, tasks).drop(*on)


def kd_candidates(left: DataFrame, right: DataFrame, kd, k: int, radius: float,
                  keys: Sequence[str] = (), slices: tuple[int, float, float] | None = None, tasks: int | None = None) -> DataFrame:
    """Equi-join on kd part: ``left`` must carry its home ``part``; ``right`` is copied into
    every part whose box grown by ``radius`` contains it (inclusive), by descending the kd
    tree (``KDPartition.halo``: one broadcast hash join per level, split tables of at most a
    few thousand rows). ``slices`` (axis, low end, width of at least ``radius``) cuts the parts further along an axis: a row of
    ``left`` has one slice, one of ``right`` goes to it and its two neighbours."""
    rcols = [c for c in right.columns if c != "part"]
    halo = kd.halo(right.drop("part") if "part" in right.columns else right, radius)
    rx = halo.select(F.col("part").alias("a_part"), *[F.col(g).alias("a_" + g) for g in keys],
                     *[F.col(c).alias("b_" + c) for c in rcols])
    lc = _prefixed(left, "a_")
    on = ["a_part"] + [f"a_{g}" for g in keys]
    if slices is not None:
        axis, low, width = slices
        at = lambda c: F.floor((F.col(f"{c}_x{axis}") - F.lit(low)) / F.lit(width)).cast("long")
        lc = lc.withColumn("a_slice", at("a"))
        rx = rx.withColumn("a_slice", F.explode(F.array(*[at("b") + d for d in (-1, 0, 1)])))
        on.append("a_slice")
    return _dealt(lc, rx, on, tasks).drop(*on)


def pairs_within(cands: DataFrame, k: int, eps: float, metric: str) -> DataFrame:
    return cands.where(within_expr([f"a_x{i}" for i in range(k)], [f"b_x{i}" for i in range(k)], eps, metric))


def eps_join(points: DataFrame, eps: float, metric: str = "euclidean", strategy: str = "auto",
             k: int | None = None, max_partitions: int | None = None, with_distance: bool = False,
             nulls: str = "error") -> DataFrame:
    """All ordered pairs ``(a, b)`` of a point table with ``dist(a, b) <= eps``, self
    pairs included. Each ordered pair comes out exactly once. A null, NaN or infinite coordinate is an
    error, or with ``nulls='drop'`` its point is left out."""
    _check_metric(metric)
    k = k or point_dim(points)
    pts = usable(points.select("id", *axis_names(k)), k, nulls)
    strategy = choose_strategy(k, strategy)
    span = bounds(pts, k)
    if strategy == "grid":
        side = coarse_side(eps, span.width)
        cells = with_cells(pts, k, side, span.low)
        tasks = join_tasks(cells, [F.col(f"c{i}") for i in range(k)], len(_offsets(k, half=True)))
        cands = pairs_within(grid_candidates(pts, pts, k, side, span.low, symmetric=True, tasks=tasks), k, eps, metric)
        both = F.when(F.col("mirror"),
                      F.array(F.struct(F.col("a_id").alias("a"), F.col("b_id").alias("b")),
                              F.struct(F.col("b_id").alias("a"), F.col("a_id").alias("b")))) \
            .otherwise(F.array(F.struct(F.col("a_id").alias("a"), F.col("b_id").alias("b"))))
        extra = [distance_expr([f"a_x{i}" for i in range(k)], [f"b_x{i}" for i in range(k)], metric).alias("dist")] \
            if with_distance else []
        out = cands.select(F.explode(both).alias("p"), *extra).select("p.a", "p.b", *(["dist"] if with_distance else []))
        return out
    from densitykit.operators.partition import kd_partition

    kd = kd_partition(pts, max_partitions=max_partitions, k=k)
    slices = (span.widest, span.low[span.widest], coarse_side(eps, span.width))
    place = F.floor((F.col(f"x{span.widest}") - F.lit(slices[1])) / F.lit(slices[2]))
    cands = pairs_within(kd_candidates(kd.points, pts, kd, k, eps, slices=slices, tasks=join_tasks(kd.points, [F.col("part"), place], 3)), k, eps, metric)
    extra = [distance_expr([f"a_x{i}" for i in range(k)], [f"b_x{i}" for i in range(k)], metric).alias("dist")] \
        if with_distance else []
    return cands.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), *extra)


def choose_strategy(k: int, strategy: str) -> str:
    if strategy == "auto":
        return "grid" if k <= 3 else "kd"
    if strategy not in ("grid", "kd"):
        raise ValueError("strategy must be 'auto', 'grid' or 'kd'")
    return strategy


def neighbour_counts(points: DataFrame, eps: float, metric: str = "euclidean", strategy: str = "auto",
                     k: int | None = None, max_partitions: int | None = None) -> DataFrame:
    """``id, n``: number of points within eps of each point, itself included (keys must be unique). Cells within eps of
    each other count whole; single points are compared only where the boxes of two cells leave it open."""
    from densitykit.operators.cells import Grid

    k = k or point_dim(points)
    pts, kd = points.select("id", *axis_names(k)), None
    span = bounds(pts, k)
    if choose_strategy(k, strategy) == "kd":
        from densitykit.operators.partition import kd_partition

        kd = kd_partition(pts, max_partitions=max_partitions, k=k)
        pts = kd.points
    grid = Grid(k, float(eps), metric, coarse_side(eps, span.width), span.low, (), kd)
    pts = grid.with_cells(pts)
    cells = materialize(grid.cells(pts), "counts-cells")
    pairs = materialize(grid.pairs(cells), "counts-pairs")
    whole, more = grid.counts(pts, pairs, None)
    n = F.coalesce("whole_n", F.lit(0))
    out = pts.join(whole, "cell", "left")
    if more is not None:
        out, n = out.join(more, "id", "left"), n + F.coalesce("more_n", F.lit(0))
    return out.select("id", n.cast("long").alias("n"))
