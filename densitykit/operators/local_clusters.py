"""Clusters inside every kd part, and their merge through shared core points.

Every point is copied into each part whose box grown by twice eps contains it (its neighbourhoods), so that a part sees
all neighbours of every point within eps of its box. One grouped fit clusters all parts at once. A core point that is
core in two parts ties their clusters together; connected components of that overlap graph give the map from local to
global clusters, and each point takes the clusters of its home copy through the map. The result equals a fit of
the whole table: a point's home part sees its whole neighbourhood, and of two core points within eps of each other each
is a core point of the other's home part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densitykit.operators.components import connected_components
from densitykit.operators.dbscan import DensityClusterer
from densitykit.operators.neighbors import bounds, coarse_side
from densitykit.operators.partition import KDPartition, kd_partition
from densitykit.operators.points import axis_names, point_dim
from densitykit.session import materialize


class LocalClusters:
    """Lazy tables: ``neighborhoods`` (id, part, x0..), ``local`` (part, id, cluster, kind; cluster = lowest core key of the
    local cluster, null for noise), ``cluster_map`` (part, cluster, label), ``result`` (id, label, kind)."""

    def __init__(self, kd: KDPartition, neighborhoods: DataFrame, local: DataFrame, cluster_map: DataFrame, result: DataFrame):
        self.kd, self.neighborhoods, self.local, self.cluster_map, self.result = kd, neighborhoods, local, cluster_map, result

    def audit(self) -> DataFrame:
        """``id, clusters``: every copy's ``part:cluster``, ``;``-joined in order; ``*`` marks a copy that is not
        core there, -1 a copy without a cluster. A key has at most as many copies as boxes meet within twice eps."""
        cluster = F.coalesce(F.col("cluster").cast("string"), F.lit("-1"))
        name = F.concat(F.col("part").cast("string"), F.lit(":"), cluster, F.when(F.col("kind") == "core", "").otherwise("*"))
        return self.local.select("id", name.alias("c")).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("c")), ";").alias("clusters"))


def local_clusters(points: DataFrame, eps: float, min_samples: int, metric: str = "euclidean", max_partitions: int | None = None,
                   radius: float | None = None) -> LocalClusters:
    """Cluster part by part and merge. ``radius`` of the neighbourhoods defaults to twice eps and a margin for rounding."""
    k = point_dim(points)
    axes = axis_names(k)
    pts = points.select("id", *axes)
    span = bounds(pts, k, unique=True)
    radius = 2 * coarse_side(eps, span.width) if radius is None else radius
    kd = kd_partition(pts, max_partitions=max_partitions, k=k)
    copies = materialize(kd.halo(pts, radius), "local-copies")
    model = DensityClusterer(eps, min_samples, metric, check_keys=False).fit(copies, by="part", k=k)
    local = model._raw.select(F.col("id.g").alias("part"), F.col("id.id").alias("id"), F.col("label.id").alias("cluster"), "kind")
    local = materialize(local, "local-clusters")
    # overlap graph: local clusters that share a core point
    core = local.where("kind = 'core'")
    shared = core.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("part", "cluster"))).alias("c")).where("size(c) > 1")
    edges = shared.select(F.col("c")[0].alias("src"), F.explode(F.slice("c", 2, F.size("c") - 1)).alias("dst")).distinct()
    nodes = core.select(F.struct("part", "cluster").alias("node")).distinct()
    cc = connected_components(nodes, edges)
    least = cc.labels.groupBy(F.col("label").alias("c")).agg(F.min("node.cluster").alias("label"))
    mapped = materialize(cc.labels.withColumnRenamed("label", "c").join(least, "c").select("node.part", "node.cluster", "label"), "local-map")
    # home copies: core points by their cluster, border points by the clusters of all their core neighbours
    home = kd.points.select("id", "part")
    mine = home.join(local.where("kind = 'core'"), ["id", "part"]).join(mapped, ["part", "cluster"]).select("id", "label", "kind")
    link = model.links.where("border").join(model.labels.select(F.col("node").alias("v"), F.col("label.id").alias("cluster")), "v") \
        .select(F.col("u.g").alias("part"), F.col("u.id").alias("id"), "cluster")
    border = home.join(link, ["id", "part"]).join(mapped, ["part", "cluster"]).groupBy("id").agg(F.min("label").alias("label"))
    rest = home.join(local.where("kind <> 'core'").select("id", "part"), ["id", "part"]).select("id").join(border, "id", "left") \
        .select("id", "label", F.when(F.col("label").isNull(), "noise").otherwise("border").alias("kind"))
    return LocalClusters(kd, copies, local, mapped, mine.unionByName(rest))
