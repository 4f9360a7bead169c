"""Density-clustering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from densitykit.operators.dbscan import DensityClusterer
from densitykit.operators.local_clusters import local_clusters
from densitykit.operators.neighbors import eps_join, neighbour_counts
from densitykit.plans import fixtures as fx
from densitykit.plans import kd_sql
from densitykit.plans import oracles as osql
from densitykit.plans.catalog import register

PT = osql.POINTS_SQL["PT"]


def _fit(spark, sf_dir, name="PT", eps=None, min_samples=None, **kw):
    k, e, m = fx.FIXTURE_PARAMS[name]
    return DensityClusterer(eps or e, min_samples or m, **kw).fit(fx.points(spark, sf_dir, name))


@register("dbscan", osql.fixture_dbscan_sql("PT", 2.0, 6))
def q_dbscan(spark, sf_dir):
    """D7/D9 flagship: exact DBSCAN of PT (eps 2, min 6)."""
    return _fit(spark, sf_dir).result


@register("dbscan_ev", osql.fixture_dbscan_sql("EVT", 3.0, 8))
def q_dbscan_ev(spark, sf_dir):
    """D3: all events, clustered inside each event type."""
    return DensityClusterer(3.0, 8).fit(fx.evt_points(spark, sf_dir), by="event_type").result


@register("dbscan_ev_giant", osql.fixture_dbscan_sql("EVT", 8.0, 4))
def q_dbscan_ev_giant(spark, sf_dir):
    """All events with eps 8, min 4: one giant cluster for each type (long component loop)."""
    return DensityClusterer(8.0, 4).fit(fx.evt_points(spark, sf_dir), by="event_type").result


@register("dbscan_cu", osql.fixture_dbscan_sql("CU", 0.25, 4))
def q_dbscan_cu(spark, sf_dir):
    return _fit(spark, sf_dir, "CU").result


@register("dbscan_e3", osql.fixture_dbscan_sql("E3", 0.4, 5))
def q_dbscan_e3(spark, sf_dir):
    return _fit(spark, sf_dir, "E3").result


@register("dbscan_o3", osql.dbscan_sql(osql.POINTS_SQL["O3"], 3, 1.2, 8))
def q_dbscan_o3(spark, sf_dir):
    """All orders by three natural columns: price, date, priority."""
    return DensityClusterer(1.2, 8).fit(fx.o3_points(spark, sf_dir)).result


@register("dbscan_kd", osql.fixture_dbscan_sql("PT", 2.5, 8))
def q_dbscan_kd(spark, sf_dir):
    """The kd strategy (16 parts, one-eps halo) on PT with eps 2.5, min 8."""
    return _fit(spark, sf_dir, "PT", 2.5, 8, strategy="kd", max_partitions=16).result


@register("dbscan_manhattan", osql.fixture_dbscan_sql("PT", 2.0, 6, "manhattan"))
def q_dbscan_manhattan(spark, sf_dir):
    return _fit(spark, sf_dir, metric="manhattan").result


@register("dbscan_chebyshev", osql.fixture_dbscan_sql("PT", 2.0, 6, "chebyshev"))
def q_dbscan_chebyshev(spark, sf_dir):
    return _fit(spark, sf_dir, metric="chebyshev").result


@register("eps_join", f"""with p as ({PT})
select a.id a, b.id b from p a join p b on {osql.within_sql(2, 2.0)}""")
def q_eps_join(spark, sf_dir):
    """Ordered eps-neighbour pairs of PT, self pairs included."""
    return eps_join(fx.pt_points(spark, sf_dir), 2.0)


@register("eps_join_kd", f"""with p as ({PT})
select a.id a, b.id b from p a join p b on {osql.within_sql(2, 2.0)}""")
def q_eps_join_kd(spark, sf_dir):
    """D1 through the kd strategy (16 parts)."""
    return eps_join(fx.pt_points(spark, sf_dir), 2.0, strategy="kd", max_partitions=16)


@register("core_points", f"""with p as ({PT}),
 e as (select a.id a from p a join p b on {osql.within_sql(2, 2.0)})
select a id, count(*) n, count(*) >= 6 is_core from e group by a""")
def q_core_points(spark, sf_dir):
    """Neighbour count per point and the core flag (min 6)."""
    n = neighbour_counts(fx.pt_points(spark, sf_dir), 2.0)
    return n.select("id", "n", (F.col("n") >= 6).alias("is_core"))


@register("dbscan_components", osql.dbscan_ctes(PT, 2, 2.0, 6) + "\nselect id, l::bigint label from lab")
def q_dbscan_components(spark, sf_dir):
    """Component label of every core point."""
    return _fit(spark, sf_dir).result.where("kind = 'core'").select("id", "label")


@register("dbscan_border", osql.dbscan_ctes(PT, 2, 2.0, 6) + "\nselect id, l::bigint label from bord")
def q_dbscan_border(spark, sf_dir):
    """Border points and the lowest label among their core neighbours."""
    return _fit(spark, sf_dir).result.where("kind = 'border'").select("id", "label")


@register("dbscan_noise", osql.dbscan_ctes(PT, 2, 2.0, 6) + """
select id from p where id not in (select id from lab) and id not in (select id from bord)""")
def q_dbscan_noise(spark, sf_dir):
    """Noise points."""
    return _fit(spark, sf_dir).result.where("label = -1").select("id")


@register("cluster_sizes", f"""with d as ({osql.fixture_dbscan_sql('PT', 2.0, 6)})
select label, count(*) n from d group by label""")
def q_cluster_sizes(spark, sf_dir):
    """Members per cluster label (noise as -1)."""
    return _fit(spark, sf_dir).cluster_sizes()


@register("dbscan_cluster_map", osql.dbscan_ctes(PT, 2, 2.0, 6) + """
select id local_id, l::bigint cluster from lab""")
def q_dbscan_cluster_map(spark, sf_dir):
    """Local id -> global cluster (with contraction off, a local id is a core key)."""
    return _fit(spark, sf_dir, contract=False).cluster_map


@register("dbscan_by_group", osql.dbscan_sql(
    "select p_partkey id, p_brand, p_retailprice::double x0, p_size::double x1 from part",
    2, 5.0, 3, group="p_brand"))
def q_dbscan_by_group(spark, sf_dir):
    """D3: clusters inside each brand (eps 5, min 3)."""
    part = fx.table(spark, sf_dir, "part")
    pts = part.select(F.col("p_partkey").alias("id"), "p_brand",
                      F.col("p_retailprice").cast("double").alias("x0"), F.col("p_size").cast("double").alias("x1"))
    return DensityClusterer(5.0, 3).fit(pts, by="p_brand").result


@register("dbscan_dense", f"""with d as ({osql.fixture_dbscan_sql('PT', 2.0, 6)}),
 l as (select label, (row_number() over (order by label)) - 1 dense from (select distinct label from d where label >= 0))
select d.id, coalesce(l.dense, -1)::bigint label, d.kind from d left join l using (label)""")
def q_dbscan_dense(spark, sf_dir):
    """Labels renumbered 0..m-1 in order of the lowest core key."""
    return _fit(spark, sf_dir, labels="dense").result


# ---- part by part (4 kd parts of PT, eps 2, min 6) ----------------------------------------------

#: A copy's key in the SQL: part * STEP + id.
STEP = 10**9


def _local_sql(tail):
    ctes, last, boxes = kd_sql.kd_sql("pts", 2, 4)
    copies = (f"select b.part * {STEP}::bigint + p.id id, b.part, p.x0, p.x1 from pts p join kdboxes b on {kd_sql.grown_contains(2, 4.0)}")
    return f"with recursive pts as ({PT}), " + ", ".join(ctes) + ", " + kd_sql.boxes_cte(boxes, 2) + f", home as (select id, part from {last}), " + \
        osql.dbscan_ctes(copies, 2, 2.0, 6, group="part").removeprefix("with recursive ") + tail


_LOCAL = f"""
select p.part, p.id % {STEP} id, coalesce(lab.l, bord.l) % {STEP} cluster,
  case when lab.l is not null then 'core' when bord.l is not null then 'border' else 'noise' end kind
from p left join lab using (id) left join bord using (id)"""


@register("local_clusters", _local_sql(_LOCAL))
def q_local_clusters(spark, sf_dir):
    """D3: clusters inside every kd part, over all halo copies."""
    return _local(spark, sf_dir).local.select("part", "id", "cluster", "kind")


@register("local_cluster_map", _local_sql(f""",
 tie as materialized (select distinct a.l a, b.l b from lab a join lab b on a.id % {STEP} = b.id % {STEP}),
 r2(l, root) as (select distinct l, l from lab union select tie.b, r2.root from r2 join tie on tie.a = r2.l)
select l // {STEP} part, l % {STEP} cluster, min(root % {STEP}) "label" from r2 group by l"""))
def q_local_cluster_map(spark, sf_dir):
    """Local cluster -> global cluster, through shared core points."""
    return _local(spark, sf_dir).cluster_map.select(F.col("part").cast("long").alias("part"), "cluster", "label")


@register("cluster_audit", _local_sql(f""", loc as ({_LOCAL})
select id, string_agg(part || ':' || coalesce(cluster, -1) || case kind when 'core' then '' else '*' end, ';'
  order by part || ':' || coalesce(cluster, -1) || case kind when 'core' then '' else '*' end) clusters from loc group by id"""))
def q_cluster_audit(spark, sf_dir):
    """Audit line of every key, e.g. ``0:7;2:7*``."""
    return _local(spark, sf_dir).audit()


@register("dbscan_merged", osql.fixture_dbscan_sql("PT", 2.0, 6))
def q_dbscan_merged(spark, sf_dir):
    """The merged clusters of all parts equal a fit of the whole table."""
    return _local(spark, sf_dir).result.select("id", F.coalesce("label", F.lit(-1)).cast("long").alias("label"), "kind")


def _local(spark, sf_dir):
    return local_clusters(fx.pt_points(spark, sf_dir), 2.0, 6, max_partitions=4, radius=4.0)


def _model_boxes_sql(grow):
    ctes, _, boxes = kd_sql.kd_sql("pts", 2, 4)
    g = osql.lit(grow)
    return f"with pts as ({PT}), " + ", ".join(ctes) + ", " + kd_sql.boxes_cte(boxes, 2) + \
        ", " + f"kdg as (select part, {', '.join(f'round(lo{i} - {g}, 6) lo{i}, round(hi{i} + {g}, 6) hi{i}' for i in range(2))} from kdboxes) "


def _kd_model(spark, sf_dir):
    return _fit(spark, sf_dir, "PT", strategy="kd", max_partitions=4)


@register("model_boxes", _model_boxes_sql(0.0) + "select * from kdg")
def q_model_boxes(spark, sf_dir):
    """Boxes of the parts that a model was fitted by."""
    return _kd_model(spark, sf_dir).boxes.select("part", *_ends())


@register("model_expanded_boxes", _model_boxes_sql(4.0) + "select * from kdg")
def q_model_expanded_boxes(spark, sf_dir):
    """The same boxes grown by twice eps."""
    return _kd_model(spark, sf_dir).expanded_boxes.select("part", *_ends())


@register("model_neighborhoods", _model_boxes_sql(4.0) + f"select p.id, b.part from pts p join kdboxes b on {kd_sql.grown_contains(2, 4.0)}")
def q_model_neighborhoods(spark, sf_dir):
    """Every point in each part whose expanded box contains it."""
    return _kd_model(spark, sf_dir).neighborhoods.select("id", "part")


def _ends():
    return [F.round(F.col(e)[i], 6).alias(f"{e}{i}") for i in range(2) for e in ("lo", "hi")]
