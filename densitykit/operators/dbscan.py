"""Exact DBSCAN as DataFrame joins and a component loop.

Plan (``DensityClusterer.fit``):

1. **Cells**: points are grouped into cells whose points are all within eps of each other; pairs of cells within eps are
   found by an equi-join on coarse cells (or kd parts) and decided by their boxes where possible (``cells``).
2. **Core flags** (D1, D2): a cell of ``min_samples`` points is core as a whole; elsewhere a point's neighbours are the
   counts of whole cells plus those found point by point in the undecided pairs (a point counts itself).
3. **Graph nodes**: the core points of one cell are one node (id = their smallest key). Dense regions cost one node per
   cell, not one per point.
4. **Links**: pairs of nodes, and of border points and nodes, from the same pairs of cells: decided by boxes or by one
   chosen point of each where possible, else by comparing points.
5. **Components** (D4): ``connected_components`` over the node graph.
6. **Labels**: core points take their node's component label, border points the lowest label
   among their core neighbours (D5), the rest are noise ``-1`` (D6). A label is the lowest core
   key of its cluster; ``labels='dense'`` renumbers them 0..m-1 in that order.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from densitykit.operators.cells import Grid, box_aggs, near_boxes, near_reps, open_aggs, prefixed, whole_boxes
from densitykit.operators.components import connected_components
from densitykit.operators.neighbors import _check_metric, bounds, choose_strategy, coarse_side, usable
from densitykit.operators.points import axis_names, point_dim
from densitykit.session import ensure_checkpoint_dir, materialize

RESULT_COLUMNS = ("id", "label", "kind")


class DensityClusterer:
    """``DensityClusterer(eps, min_samples, metric, strategy, max_partitions).fit(points)``.

    ``points`` is a point table ``id, x0..x{k-1}`` (see ``as_points``). ``by`` names a group
    column: clusters are then found inside each group only (D3), and keys need only be
    unique within a group. A null, NaN or infinite coordinate is an error; ``nulls='drop'`` leaves
    those points out. Noise has label -1 where keys are integers, and a null label otherwise. With ``contract=False``
    the cluster map has every core key, not one key for the core points of a cell; the fit is the same.
    """

    def __init__(self, eps: float = 0.5, min_samples: int = 5, metric: str = "euclidean",
                 strategy: str = "auto", max_partitions: int | None = None, labels: str = "min",
                 check_keys: bool = True, contract: bool = True, max_rounds: int = 100, nulls: str = "error"):
        _check_metric(metric)
        if eps <= 0:
            raise ValueError("eps must be positive")
        if labels not in ("min", "dense"):
            raise ValueError("labels must be 'min' or 'dense'")
        self.eps = float(eps)
        self.min_samples = int(min_samples)
        self.metric = metric
        self.strategy = strategy
        self.max_partitions = max_partitions
        self.labels = labels
        self.check_keys = check_keys
        self.contract = contract
        self.max_rounds = max_rounds
        self.nulls = nulls

    def fit(self, points: DataFrame, by: str | None = None, k: int | None = None) -> "DensityModel":
        spark = points.sparkSession
        ensure_checkpoint_dir(spark)
        k = k or point_dim(points)
        axes = axis_names(k)
        strategy = choose_strategy(k, self.strategy)
        keys = ["g"] if by else []
        pts = usable(points.select(*([F.col(by).alias("g")] if by else []), "id", *axes), k, self.nulls)
        key = F.struct("g", "id") if by else F.col("id")
        span = bounds(pts.withColumn("id", key), k, unique=self.check_keys)
        if by:  # the key of a point is (group, id)
            pts = pts.withColumn("id", key)
        kd = None
        if strategy == "kd":
            from densitykit.operators.partition import kd_partition

            kd = kd_partition(pts, max_partitions=self.max_partitions, k=k)
            pts = kd.points
        grid = Grid(k, self.eps, self.metric, coarse_side(self.eps, span.width), span.low, keys, kd)
        pts = grid.with_cells(pts).persist(StorageLevel.MEMORY_AND_DISK)
        # 1: cells and their pairs
        cells = materialize(grid.cells(pts), "dbscan-cells")
        open_ = ~F.col("whole") & ~((F.col("a_n") >= self.min_samples) & (F.col("b_n") >= self.min_samples) & F.col("a_clique") & F.col("b_clique"))
        pairs, st = materialize(grid.pairs(cells), "dbscan-pairs", n=F.count(F.lit(1)), **open_aggs(open_))
        grid.compared["cells"] += st["n"]
        # 2: core flags
        whole, more = grid.counts(pts, pairs, self.min_samples, st)
        dense = F.col("clique") & (F.col("n") >= self.min_samples)
        known = cells.select("cell", "clique", dense.alias("dense")).join(whole, "cell", "left").withColumn("whole_n", F.coalesce("whole_n", F.lit(0)))
        near = F.col("whole_n")
        flagged = pts.join(known, "cell")
        if more is not None:
            flagged, near = flagged.join(more, "id", "left"), near + F.coalesce("more_n", F.lit(0))
        own = ["g"] if by else []
        flagged = materialize(flagged.select("cell", "id", *own, *axes, F.when(F.col("clique"), None).otherwise(F.col("id")).alias("sub"),
                                             (F.col("dense") | (near >= self.min_samples)).alias("is_core")), "dbscan-flagged")
        pts.unpersist()
        # 3: graph nodes
        rep = F.min_by(F.struct(*axes), "id").alias("rep")
        nodes = materialize(flagged.where("is_core").groupBy("cell", "sub").agg(F.min("id").alias("node"), *box_aggs(k), rep), "dbscan-nodes")
        # 4: links of nodes, and of border points and nodes
        noncore = flagged.where("not is_core")
        links = self._links(grid, pairs, flagged, nodes, noncore)
        # 5: components over nodes
        cc = connected_components(nodes.select("node"), links.where("not border").select(
            F.col("u").alias("src"), F.col("v").alias("dst")), max_rounds=self.max_rounds)
        # 6: labels
        named = nodes.select("cell", "sub", "node").join(cc.labels, "node").drop("node")
        core_lab = flagged.where("is_core").alias("p").join(named.alias("n"), [F.col("p.cell") == F.col("n.cell"), F.col("p.sub").eqNullSafe(F.col("n.sub"))]) \
            .select("p.id", "n.label", F.lit("core").alias("kind"))
        border_lab = links.where("border").join(cc.labels.withColumnRenamed("node", "v"), "v") \
            .groupBy(F.col("u").alias("id")).agg(F.min("label").alias("label")) \
            .select("id", "label", F.lit("border").alias("kind"))
        rest = noncore.select("id").join(border_lab, "id", "left") \
            .select("id", "label", F.coalesce("kind", F.lit("noise")).alias("kind"))
        return DensityModel(self, core_lab.unionByName(rest), by=by, k=k, kd=kd, cc=cc, flagged=flagged, nodes=nodes, links=links, compared=grid.compared)

    def _links(self, grid: Grid, pairs: DataFrame, flagged: DataFrame, nodes: DataFrame, noncore: DataFrame) -> DataFrame:
        """``border, u, v``: pairs of linked nodes, and of a border point and a node."""
        k, eps, metric = grid.k, self.eps, self.metric
        axes = axis_names(k)
        a, b = prefixed(nodes, "a_"), prefixed(nodes, "b_")
        of = pairs.select("a_cell", "b_cell", "whole")
        tested = F.col("whole") | near_reps("a_", "b_", k, eps, metric) | whole_boxes("a_", "b_", k, eps, metric)
        core = of.join(a, "a_cell").join(b, "b_cell").where((F.col("a_cell") != F.col("b_cell")) | (F.col("a_node") < F.col("b_node"))) \
            .where(near_boxes("a_", "b_", k, eps, metric)) \
            .select(F.lit(False).alias("border"), F.col("a_node").alias("u"), F.col("b_node").alias("v"), "a_n", "b_n", tested.alias("linked"))
        ends = [F.struct("a_cell", "b_cell", "whole"), F.struct(F.col("b_cell").alias("a_cell"), F.col("a_cell").alias("b_cell"), "whole")]
        both = of.select(F.explode(F.when(F.col("a_cell") == F.col("b_cell"), F.array(ends[0])).otherwise(F.array(*ends))).alias("s")).select("s.*")
        point = noncore.select(F.col("cell").alias("a_cell"), F.col("id").alias("a_id"), F.lit(1).cast("long").alias("a_n"), F.struct(*axes).alias("a_rep"),
                               *[F.col(x).alias(f"a_{e}{i}") for e in ("lo", "hi") for i, x in enumerate(axes)])
        border = both.join(b, "b_cell").join(point, "a_cell").where(near_boxes("a_", "b_", k, eps, metric)) \
            .select(F.lit(True).alias("border"), F.col("a_id").alias("u"), F.col("b_node").alias("v"), "a_n", "b_n", tested.alias("linked"))
        kinds = {"core": ~F.col("linked") & ~F.col("border"), "border": ~F.col("linked") & F.col("border")}
        links, st = materialize(core.unionByName(border), "dbscan-links", **{f"{t}_{n}": c for t, k in kinds.items() for n, c in open_aggs(k).items()})
        st = {t: {n: st[f"{t}_{n}"] for n in ("small", "large", "points")} for t in kinds}
        out = links.where("linked").select("border", "u", "v")
        on = [F.col("p.cell") == F.col("n.cell"), F.col("p.sub").eqNullSafe(F.col("n.sub"))]
        members = flagged.where("is_core").alias("p").join(nodes.alias("n"), on).select(F.col("n.node").alias("root"), "p.id", *[f"p.{c}" for c in axes])
        for kind, left in (("core", members), ("border", noncore.select(F.col("id").alias("root"), "id", *axes))):
            if st[kind]["small"] or st[kind]["large"]:
                rest = links.where(kinds[kind])
                found = grid.links(rest.select(F.col("u").alias("a_root"), F.col("v").alias("b_root"), "a_n", "b_n"), left, members, st[kind])
                out = out.unionByName(found.select(F.lit(kind == "border").alias("border"), F.col("a_root").alias("u"), F.col("b_root").alias("v")))
        return out


class DensityModel:
    """Fitted DBSCAN: lazy DataFrames only (D9, D10). ``compared`` has the pairs of cells and of points that were compared
    and the levels of subcells that took."""

    def __init__(self, params: DensityClusterer, raw: DataFrame, by, k, kd, cc, flagged, nodes, links, compared):
        self.params = params
        self.k = k
        self.by = by
        self.rounds = cc.rounds
        self._kd = kd
        self._raw = raw
        self.flagged = flagged
        self.nodes = nodes
        self.links = links
        self.labels = cc.labels
        self.compared = compared
        local = cc.labels if params.contract else raw.where("kind = 'core'").select(F.col("id").alias("node"), "label")
        self.cluster_map = local.select(F.col("node").alias("local_id"), F.col("label").alias("cluster"))
        self.result = self._finish(raw)

    def _finish(self, raw: DataFrame) -> DataFrame:
        out = raw
        if self.params.labels == "dense":
            out = dense_labels(out).withColumn("label", F.coalesce(F.col("label"), F.lit(-1)))
        label = F.col("label")
        if self.params.labels == "min":
            if self.by:
                label = F.col("label.id")
            if isinstance(out.select(label.alias("l")).schema["l"].dataType, T.IntegralType):
                label = F.coalesce(label, F.lit(-1)).cast("bigint")
        if self.by:
            out = out.select(F.col("id.g").alias(self.by), F.col("id.id").alias("id"), label.alias("label"), "kind")
        else:
            out = out.select("id", label.alias("label"), "kind")
        return out

    def assignments(self) -> DataFrame:
        """``id, label, kind`` sorted by key."""
        keys = ([self.by] if self.by else []) + ["id"]
        return self.result.orderBy(*keys)

    @property
    def boxes(self) -> DataFrame:
        if self._kd is None:
            raise ValueError("boxes exist for strategy='kd' only")
        return self._kd.boxes

    @property
    def expanded_boxes(self) -> DataFrame:
        """Boxes of the kd parts grown by twice eps (``part, lo, hi``)."""
        from densitykit.functions.boxes import box_expand_add

        b = self.boxes.select("part", box_expand_add(F.col("lo"), F.col("hi"), 2 * self.params.eps).alias("e"))
        return b.select("part", F.col("e.lo").alias("lo"), F.col("e.hi").alias("hi"))

    @property
    def neighborhoods(self) -> DataFrame:
        """Every point's copies in the parts whose expanded box contains it (``id, x0.., part``)."""
        if self._kd is None:
            raise ValueError("neighborhoods exist for strategy='kd' only")
        return self._kd.halo(self.flagged.select("id", *axis_names(self.k)), 2 * self.params.eps)

    def cluster_sizes(self) -> DataFrame:
        """``label, n`` (noise included as -1)."""
        return self.result.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def dense_labels(raw: DataFrame) -> DataFrame:
    """Renumber cluster labels 0..m-1 in order of the lowest core key (noise stays null).
    The distinct labels are dealt to ranges; a label's number is the count of the ranges before it (one
    row for each range) plus its place in its own range."""
    parts = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(raw.where(F.col("label").isNotNull()).select("label").distinct().repartitionByRange(parts, "label")
                         .withColumn("_p", F.spark_partition_id()), "dense-labels")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offs = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_c")).select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    numbered = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("label"))).join(offs, "_p") \
        .select("label", (F.col("_o") + F.col("_r") - 1).cast("long").alias("dense"))
    return raw.join(numbered, "label", "left").select("id", F.col("dense").alias("label"), "kind")


def dbscan(points: DataFrame, eps: float, min_samples: int, metric: str = "euclidean",
           strategy: str = "auto", **kw) -> DataFrame:
    """Functional form: ``id, label, kind`` (unsorted)."""
    return DensityClusterer(eps, min_samples, metric, strategy, **kw).fit(points).result
