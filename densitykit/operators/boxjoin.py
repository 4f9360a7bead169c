"""Points against a table of boxes (B7, C8) as an equi-join.

Boxes differ in size, so each is filed in a grid of its own size class: coordinates are scaled to the extent of all
boxes, the class is the power of two that its longest scaled side fits into, and cells of that side are filed under,
at most two on an axis. A point looks up its one cell in every class that occurs (a handful), and the exact test
``lo <= x <= hi`` decides. Beyond three axes the first three make the cells. No side is broadcast and no pair is
tried that doesn't share a cell of the box's own size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densitykit.functions.boxes import box_contains_cols
from densitykit.operators.points import axis_names, point_dim

#: Axes that make cells, and the smallest class (a side of 2^-40 of the extent: below it, rounding rules).
AXES, SMALLEST = 3, -40


def box_join(points: DataFrame, boxes: DataFrame, k: int | None = None) -> DataFrame:
    """Rows of ``points`` (``x0..``) joined with every row of ``boxes`` (``lo``, ``hi`` arrays and any columns that
    ``points`` doesn't have) whose box holds the point, ends included. Boxes with a null, NaN or inverted side hold
    nothing; an unbounded side is allowed."""
    k = k or point_dim(points)
    axes = axis_names(k)
    used = range(min(k, AXES))
    sound = boxes.where(F.forall(F.zip_with("lo", "hi", lambda a, b: a <= b), lambda t: F.coalesce(t, F.lit(False)))
                        & ~F.exists(F.concat("lo", "hi"), lambda v: F.isnan(v)))
    inf = float("inf")
    ends = {}
    for i in used:  # extent of what is bounded
        ends[f"a{i}"] = F.min(F.when(F.col("lo")[i] > F.lit(-inf), F.col("lo")[i]))
        ends[f"b{i}"] = F.max(F.when(F.col("hi")[i] < F.lit(inf), F.col("hi")[i]))
    ext = sound.agg(*[c.alias(n) for n, c in ends.items()]).first()
    at, span = [], []
    for i in used:
        a, b = ext[f"a{i}"], ext[f"b{i}"]
        at.append(0.0 if a is None else float(a))
        width = float(b) - at[i] if b is not None else 0.0
        span.append(width if 0 < width < inf else 1.0)

    def scaled(c, i):
        return (c - F.lit(at[i])) / F.lit(span[i])

    longest = F.greatest(F.lit(0.0), *[scaled(F.col("hi")[i], i) - scaled(F.col("lo")[i], i) for i in used])
    size = F.when(longest < F.lit(2.0), F.greatest(F.lit(SMALLEST), F.ceil(F.log2(F.greatest(longest, F.lit(2.0 ** SMALLEST)))))).cast("int")
    filed = sound.withColumn("_class", size)  # null: longer than the extent, filed once for all points
    classes = [r[0] for r in filed.select("_class").distinct().collect()]
    if not classes:
        return points.join(boxes.where(F.lit(False)), F.lit(True))

    def cell(c, i, power):
        return F.floor(scaled(c, i) / power).cast("long")

    power = F.pow(F.lit(2.0), F.col("_class"))
    cells = F.when(F.col("_class").isNull(), F.array(F.struct(*[F.lit(0).cast("long").alias(f"c{i}") for i in used])))
    grid = None
    for i in used:
        steps = F.sequence(cell(F.col("lo")[i], i, power), cell(F.col("hi")[i], i, power))
        grid = F.transform(steps, lambda c: F.struct(c.alias("c0"))) if grid is None else _product(grid, steps, i)
    filed = filed.withColumn("_cell", F.explode(cells.otherwise(grid))).withColumn("_class", F.coalesce("_class", F.lit(1 << 20)))
    probes = []
    for c in classes:
        where = [(F.lit(0).cast("long") if c is None else cell(F.col(axes[i]), i, F.lit(2.0 ** c))).alias(f"c{i}") for i in used]
        probes.append(F.struct(F.lit((1 << 20) if c is None else c).alias("class"), F.struct(*where).alias("cell")))
    probing = points.withColumn("_probe", F.explode(F.array(*probes))) \
        .withColumn("_class", F.col("_probe.class")).withColumn("_cell", F.col("_probe.cell")).drop("_probe")
    return probing.join(filed, ["_class", "_cell"]).where(box_contains_cols(F.col("lo"), F.col("hi"), axes)).drop("_class", "_cell")


def _product(grid, steps, i: int):
    """Every cell of ``grid`` with every step of one more axis."""
    return F.flatten(F.transform(grid, lambda g: F.transform(steps, lambda c: F.struct(
        *[g[f"c{j}"].alias(f"c{j}") for j in range(i)], c.alias(f"c{i}")))))
