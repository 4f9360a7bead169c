"""kd partitioning.

The tree is built one *level* per step, all parts of the level at once: one grouped aggregate (count, per-axis spread,
axis of greatest population variance), then the exact upper medians ``sorted[n // 2]`` by histogram refinement
(``selection``): no task holds a part's values, and the driver holds one row a part. The axes of the points are
kept in the cache while the tree grows; the source is read once for that and once for the result.

The tree is a set of arrays (axis, value, children, part of each node). A point's part is found by descending them
inside one expression: no join, no shuffle, however deep the tree is. The same descent with a radius
gives the halo copies of a point or of a box.

Label order follows the reference tree: the parts of a level are split in queue order ``[0]``, ``[0,1]``, ``[0,2,1,3]``,
...; the left half keeps the label and the right half takes the next free one. When ``max_partitions`` is not a power
of two only a prefix of the last level is split. Left is ``x < m``, right ``x >= m``. A part whose chosen axis has no
spread is not split; if the left side would be empty the split moves to the next larger distinct value.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densitykit.operators.points import axis_names, point_dim
from densitykit.operators.selection import bucket_count, narrow, order_statistics

#: Parts at most: the driver holds some 50 bytes for each, and a plan carries the tree.
MAX_PARTS = 1 << 22


def default_max_partitions(k: int, n: int | None = None) -> int:
    """About 1000 rows a part, up to MAX_PARTS parts; ``4**k`` (the reference's number) if the row
    count isn't known."""
    return min(MAX_PARTS, n // 1000 + 1 if n is not None else 4 ** k)


def constants(values, kind: str) -> Column:
    """An array column of constants, folded to one literal by the optimizer."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


class KDTree:
    """Node arrays; ``axis`` is -1 at a leaf, whose ``part`` is its label."""

    def __init__(self):
        self.axis, self.value, self.left, self.right, self.part = [-1], [0.0], [-1], [-1], [0]
        self.depth = 0

    def split(self, node: int, axis: int, value: float, new_part: int) -> None:
        n = len(self.axis)
        self.axis[node], self.value[node], self.left[node], self.right[node] = axis, value, n, n + 1
        for p in (self.part[node], new_part):
            self.axis.append(-1)
            self.value.append(0.0)
            self.left.append(-1)
            self.right.append(-1)
            self.part.append(p)

    def _steps(self) -> Column:
        return F.sequence(F.lit(1), F.lit(self.depth))

    def node(self, x: Column) -> Column:
        """Leaf of a point (an array of its coordinates)."""
        if not self.depth:
            return F.lit(0)
        axis, value = constants(self.axis, "int"), constants(self.value, "double")
        left, right = constants(self.left, "int"), constants(self.right, "int")

        def down(n, _):
            a = F.get(axis, n)
            return F.when(a < 0, n).otherwise(F.when(F.get(x, a) >= F.get(value, n), F.get(right, n)).otherwise(F.get(left, n)))

        return F.aggregate(self._steps(), F.lit(0), down)

    def parts_near(self, lo: Column, hi: Column, radius: float) -> Column:
        """Array of the parts whose box, grown by ``radius``, meets the box ``lo``..``hi`` (arrays; equal for a point)
        as far as the splits tell; the outer bounds are the caller's."""
        if not self.depth:
            return F.array(F.lit(0))
        axis, value = constants(self.axis, "int"), constants(self.value, "double")
        left, right, part = (constants(v, "int") for v in (self.left, self.right, self.part))
        r = F.lit(float(radius))

        def kids(n):
            a, m = F.get(axis, n), F.get(value, n)
            return F.when(a < 0, F.array(n)).otherwise(F.filter(F.array(
                F.when(F.get(lo, a) <= m + r, F.get(left, n)), F.when(F.get(hi, a) >= m - r, F.get(right, n))), lambda c: c.isNotNull()))

        leaves = F.aggregate(self._steps(), F.array(F.lit(0)), lambda acc, _: F.flatten(F.transform(acc, kids)))
        return F.transform(leaves, lambda n: F.get(part, n))


class KDPartition:
    def __init__(self, points: DataFrame, boxes: DataFrame, splits: list[dict], k: int, bbox, tree: KDTree):
        self.points = points      # input columns + part INT
        self.boxes = boxes        # part INT, lo ARRAY<DOUBLE>, hi ARRAY<DOUBLE>
        self.splits = splits      # driver-side split rows: level, part, new_part, axis, value
        self.k = k
        self.bbox = bbox
        self.tree = tree

    def part(self, axes=None) -> Column:
        """Part of a point given by its axis columns."""
        return F.get(constants(self.tree.part, "int"), self.tree.node(F.array(*(axes or axis_names(self.k)))))

    def halo(self, points: DataFrame, radius: float) -> DataFrame:
        """``points`` (without ``part``) copied into every part whose box grown by ``radius`` contains them, by one
        descent of the tree a row: to the left child if ``x <= m + radius`` and to the right one if
        ``x >= m - radius`` (both near the split). Work is about log2(P) steps per copy instead of P box tests per row."""
        axes = axis_names(self.k)
        return self.halo_boxes(points, axes, axes, radius)

    def halo_boxes(self, rows: DataFrame, lo: list[str], hi: list[str], radius: float) -> DataFrame:
        """As ``halo`` for rows that are boxes themselves (columns of the low and high ends)."""
        rows = rows.drop("part") if "part" in rows.columns else rows
        if self.bbox is None:
            return rows.withColumn("part", F.lit(0)).where(F.lit(False))
        r = F.lit(float(radius))
        for a, b, least, most in zip(lo, hi, *self.bbox):
            rows = rows.where((F.col(b) >= F.lit(float(least)) - r) & (F.col(a) <= F.lit(float(most)) + r))
        return rows.withColumn("part", F.explode(self.tree.parts_near(F.array(*lo), F.array(*hi), radius)))

    def split_table(self) -> DataFrame:
        spark = self.points.sparkSession
        cols = ("level", "part", "new_part", "axis", "value")
        if not self.splits:
            return spark.createDataFrame([], "level INT, part INT, new_part INT, axis INT, value DOUBLE")
        return spark.createDataFrame(pa.table({c: pa.array([s[c] for s in self.splits], pa.float64() if c == "value" else pa.int32()) for c in cols}))


def _columns(df: DataFrame, kinds: dict) -> dict[str, np.ndarray]:
    """A small result as numpy columns."""
    got = df.select(*kinds).toArrow()
    return {c: np.asarray(got[c].combine_chunks()).astype(t) if got.num_rows else np.zeros(0, t) for c, t in kinds.items()}


def kd_partition(points: DataFrame, max_partitions: int | None = None, k: int | None = None, axis: str = "variance") -> KDPartition:
    """Split a point table into up to ``max_partitions`` kd parts.

    ``axis='variance'`` (C1) picks the axis of greatest population variance (first wins
    ties); ``axis='cycle'`` (C4) uses axis ``level mod k``.
    """
    if axis not in ("variance", "cycle"):
        raise ValueError("axis must be 'variance' or 'cycle'")
    if max_partitions is not None and max_partitions > MAX_PARTS:
        raise ValueError(f"max_partitions is at most {MAX_PARTS}: the driver holds a row for each part")
    k = k or point_dim(points)
    axes = axis_names(k)
    work = points.select(*axes).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        tree, splits, boxes, bbox = _grow(work, k, max_partitions, axis)
    finally:
        work.unpersist()
    labels = sorted(boxes)
    arrays = [pa.array([boxes[p][side] for p in labels], pa.list_(pa.float64())) for side in (0, 1)]
    box_df = points.sparkSession.createDataFrame(pa.table({"part": pa.array(labels, pa.int32()), "lo": arrays[0], "hi": arrays[1]})) if labels \
        else points.sparkSession.createDataFrame([], "part INT, lo ARRAY<DOUBLE>, hi ARRAY<DOUBLE>")
    kd = KDPartition(points, box_df, splits, k, bbox, tree)
    kd.points = points.withColumn("part", kd.part())
    return kd


def _grow(work: DataFrame, k: int, max_partitions: int | None, axis: str):
    spark, axes = work.sparkSession, axis_names(k)
    root = work.agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(f"mn{i}") for i, c in enumerate(axes)],
                    *[F.max(c).alias(f"mx{i}") for i, c in enumerate(axes)]).first()
    tree, splits = KDTree(), []
    if not root["n"]:
        return tree, splits, {}, None
    limit = max(1, int(max_partitions if max_partitions is not None else default_max_partitions(k, root["n"])))
    bbox = ([float(root[f"mn{i}"]) for i in range(k)], [float(root[f"mx{i}"]) for i in range(k)])
    boxes, leaf = {0: bbox}, {0: 0}
    todo, label, level = deque([0]), 1, 0
    while label < limit:
        wave = []
        while todo and label + len(wave) < limit:
            wave.append(todo.popleft())
        medians = _medians(spark, work, tree, [leaf[p] for p in wave], k, axis, level)
        done, grown = [], False
        for p in wave:
            done.append(p)
            if leaf[p] not in medians:
                continue
            a, m = medians[leaf[p]]
            node, grown = leaf[p], True
            splits.append({"level": level, "part": p, "new_part": label, "axis": a, "value": m})
            tree.split(node, a, m, label)
            leaf[p], leaf[label] = tree.left[node], tree.right[node]
            lo, hi = boxes[p]
            boxes[p] = (lo, [m if i == a else v for i, v in enumerate(hi)])
            boxes[label] = ([m if i == a else v for i, v in enumerate(lo)], hi)
            done.append(label)
            label += 1
        if not grown:
            break
        todo.extend(done)
        level += 1
        tree.depth = level
    return tree, splits, boxes, bbox


def _medians(spark, work: DataFrame, tree: KDTree, nodes: list[int], k: int, axis: str, level: int) -> dict[int, tuple[int, float]]:
    """Axis and split value of each of these leaves that can be split."""
    axes = axis_names(k)
    live = np.zeros(len(tree.axis), np.int32)
    live[nodes] = 1
    here = work.withColumn("node", tree.node(F.array(*axes)))
    if not live.all():
        here = here.where(F.get(constants(live.tolist(), "int"), F.col("node")) == 1)
    spread = F.array(*[F.var_pop(c) for c in axes])
    pick = (F.array_position(F.col("s"), F.array_max("s")) - 1).cast("int") if axis == "variance" else F.lit(level % k)
    stats = here.groupBy("node").agg(F.count(F.lit(1)).alias("n"), spread.alias("s"), F.array(*[F.min(c) for c in axes]).alias("mn"),
                                     F.array(*[F.max(c) for c in axes]).alias("mx")).withColumn("axis", pick) \
        .withColumn("lo", F.get("mn", F.col("axis"))).withColumn("hi", F.get("mx", F.col("axis"))).where("n > 1 and lo < hi")
    st = _columns(stats, {"node": np.int32, "axis": np.int32, "n": np.int64, "lo": float, "hi": float})
    if not len(st["node"]):
        return {}
    chosen = np.zeros(len(tree.axis), np.int32)
    chosen[st["node"]] = st["axis"]
    rows = here.select("node", F.get(F.array(*axes), F.get(constants(chosen.tolist(), "int"), F.col("node"))).alias("v"))
    least = dict(zip(st["node"].tolist(), st["lo"].tolist()))
    state = {"node": st["node"], "lo": st["lo"], "hi": st["hi"], "rank": st["n"] // 2}
    found: dict[int, float] = {}
    while len(state["node"]):
        of = {}
        for c, kind in (("lo", "double"), ("hi", "double"), ("rank", "bigint")):
            whole = np.full(len(tree.axis), 0 if c == "rank" else np.nan, state[c].dtype)
            whole[state["node"]] = state[c]
            of[c] = F.get(constants(whole.tolist(), kind), F.col("node"))
        open_ = rows.withColumns(of).where("lo < hi" if len(state["node"]) == len(tree.axis) else "lo < hi and not isnan(lo)")
        state = _columns(narrow(open_, ["node"], bucket_count(len(state["node"]))), {"node": np.int32, "lo": float, "hi": float, "rank": np.int64})
        same = state["lo"] == state["hi"]
        found |= dict(zip(state["node"][same].tolist(), state["lo"][same].tolist()))
        state = {c: v[~same] for c, v in state.items()}
    low = [n for n, m in found.items() if m <= least[n]]
    if low:  # the left side would be empty: the next larger distinct value
        table = spark.createDataFrame(pa.table({"node": pa.array(low, pa.int32()), "m": pa.array([found[n] for n in low])}))
        up = rows.join(table, "node").where("v > m").groupBy("node").agg(F.min("v").alias("lo"))
        got = _columns(up, {"node": np.int32, "lo": float})
        found |= dict(zip(got["node"].tolist(), got["lo"].tolist()))
    return {n: (int(chosen[n]), float(m)) for n, m in found.items()}


def halo_join(points: DataFrame, boxes: DataFrame, radius: float, k: int | None = None) -> DataFrame:
    """C8 for any box table: every point copied into each part whose box grown by ``radius`` contains it (inclusive),
    through ``boxjoin.box_join``. For the boxes of a ``KDPartition`` its ``halo`` is cheaper."""
    from densitykit.functions.boxes import box_expand_add
    from densitykit.operators.boxjoin import box_join

    k = k or point_dim(points)
    grown = boxes.select("part", box_expand_add(F.col("lo"), F.col("hi"), radius).alias("g")) \
        .select("part", F.col("g.lo").alias("lo"), F.col("g.hi").alias("hi"))
    pts = points.drop("part") if "part" in points.columns else points
    return box_join(pts, grown, k).drop("lo", "hi")


def partition_stats(parted: DataFrame, boxes: DataFrame, k: int | None = None) -> DataFrame:
    """Per part, the row count, the bounding box of its rows and how many rows lie in
    the part's box (inclusive)."""
    from densitykit.functions.boxes import box_contains_cols

    k = k or point_dim(parted)
    axes = axis_names(k)
    j = parted.join(boxes, "part")
    inside = box_contains_cols(F.col("lo"), F.col("hi"), axes)
    return j.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(c).alias(f"lo{i}") for i, c in enumerate(axes)],
        *[F.max(c).alias(f"hi{i}") for i, c in enumerate(axes)],
        F.count_if(inside).alias("n_inside"))


def axis_variance(parted: DataFrame, k: int | None = None) -> DataFrame:
    """Per part, population variance per axis and the chosen axis (first max wins)."""
    k = k or point_dim(parted)
    axes = axis_names(k)
    v = parted.groupBy("part").agg(*[F.var_pop(c).alias(f"var{i}") for i, c in enumerate(axes)])
    arr = F.array(*[F.col(f"var{i}") for i in range(k)])
    return v.withColumn("axis", (F.array_position(arr, F.array_max(arr)) - 1).cast("int"))


def median_split(parted: DataFrame, axis_col: str) -> DataFrame:
    """C2 + B9: per part the upper median ``sorted[n // 2]`` of a column (histogram refinement) and the side of each
    row (``x < m`` left, else right)."""
    med = order_statistics(parted, ["part"], axis_col, lambda n: F.floor(n / 2), "median")
    return parted.join(med, "part").withColumn(
        "side", F.when(F.col(axis_col) < F.col("median"), F.lit("left")).otherwise(F.lit("right")))
