"""Statistics, sorting, sampling and pair queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from densitykit.functions import waves as W
from densitykit.operators import pairs as PR
from densitykit.operators import stats as ST
from densitykit.operators.dbscan import DensityClusterer
from densitykit.operators.partition import kd_partition
from densitykit.plans import fixtures as fx
from densitykit.plans import kd_sql
from densitykit.plans import oracles as osql
from densitykit.plans.catalog import r6, register
from densitykit.plans.q_waves import W40

LI_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _li(spark, sf_dir):
    return fx.table(spark, sf_dir, "lineitem")


@register("col_stats", "select count(*) n, " + ", ".join(
    [f"round(avg({c}), 6) mean_{c}" for c in LI_COLS] + [f"round(var_samp({c}), 2) var_{c}" for c in LI_COLS])
    + " from lineitem")
def q_col_stats(spark, sf_dir):
    """A1: mean and sample variance of the lineitem measures."""
    s = ST.col_stats(_li(spark, sf_dir), LI_COLS)
    return s.select("n", *[r6(f"mean_{c}").alias(f"mean_{c}") for c in LI_COLS],
                    *[F.round(f"var_{c}", 2).alias(f"var_{c}") for c in LI_COLS])


@register("standardize", "select l_orderkey, l_linenumber, " + ", ".join(
    f"round(({c} - (select avg({c}) from lineitem)) / (select stddev_samp({c}) from lineitem), 6) {c}" for c in LI_COLS)
    + " from lineitem")
def q_standardize(spark, sf_dir):
    """A2: lineitem measures standardised with the sample std (stats as a broadcast row)."""
    z = ST.standardize(_li(spark, sf_dir), LI_COLS, ddof=1, keep=["l_orderkey", "l_linenumber"])
    return z.select("l_orderkey", "l_linenumber", *[r6(c).alias(c) for c in LI_COLS])


@register("moments", "select l_returnflag, count(*) n, " + ", ".join(
    [f"round(avg({c}), 6) mean_{c}" for c in LI_COLS] + [f"round(var_pop({c}), 2) var_{c}" for c in LI_COLS])
    + " from lineitem group by l_returnflag")
def q_moments(spark, sf_dir):
    """A3: count, mean and population variance per return flag in one pass."""
    m = ST.moments(_li(spark, sf_dir), LI_COLS, by=["l_returnflag"])
    return m.select("l_returnflag", "n", *[r6(f"mean_{c}").alias(f"mean_{c}") for c in LI_COLS],
                    *[F.round(f"var_{c}", 2).alias(f"var_{c}") for c in LI_COLS])


@register("sorted_features", f"""with {W40} select wave_id, min(pos) filter (where v = mx) peak_pos, max(mx) peak
from w join (select wave_id, max(v) mx from w group by wave_id) using (wave_id) group by wave_id order by wave_id""")
def q_sorted_features(spark, sf_dir):
    """A4: per-wave peak features sorted by key (range exchange + sort)."""
    w = fx.w40(spark, sf_dir)
    return w.select("wave_id", W.peak_index("v").alias("peak_pos"), W.peak_value("v").alias("peak")).orderBy("wave_id")


def _halo(spark, sf_dir):
    kd = kd_partition(fx.pt_points(spark, sf_dir), max_partitions=4)
    return kd.halo(fx.pt_points(spark, sf_dir), 4.0).select("id", "part")


def _halo_sql(tail):
    ctes, last, boxes = kd_sql.kd_sql("pts", 2, 4, "variance")
    return ("with pts as (" + osql.POINTS_SQL["PT"] + "), " + ", ".join(ctes) + ", " + kd_sql.boxes_cte(boxes, 2)
            + f", h as (select p.id, b.part from pts p join kdboxes b on {kd_sql.grown_contains(2, 4.0)}) " + tail)


@register("min_by_key", _halo_sql("select id, min(part) part from h group by id"))
def q_min_by_key(spark, sf_dir):
    """A5: smallest part label among the halo copies of each point."""
    return ST.min_by_key(_halo(spark, sf_dir), "id", "part")


@register("label_audit", _halo_sql("select id, string_agg(part::varchar, ';' order by part::varchar) parts from h group by id"))
def q_label_audit(spark, sf_dir):
    """Every part a point was copied into, sorted and ';'-joined (the audit list)."""
    return ST.values_by_key(_halo(spark, sf_dir), "id", "part")


@register("cluster_sample", f"""with d as ({osql.fixture_dbscan_sql('PT', 2.0, 6)}),
 l as (select label, (row_number() over (order by label)) - 1 dense from (select distinct label from d where label >= 0)),
 dd as (select d.id, coalesce(l.dense, -1)::bigint label from d left join l using (label))
select * from (select * from dd where label = 0 order by id limit 20) union all select * from dd where label <> 0""")
def q_cluster_sample(spark, sf_dir):
    """First 20 members (by key) of cluster 0 and every row of the other labels."""
    r = DensityClusterer(2.0, 6, labels="dense").fit(fx.pt_points(spark, sf_dir)).result
    return ST.cluster_sample(r.select("id", "label"), "label", "id", 20, 0)


# ---- pairs --------------------------------------------------------------------------------

@register("index_blocks", """with b as (select min(event_id) s, max(event_id) + 1 e from events),
 n as (select greatest(1, ceil((e - s) / 512))::bigint n, s, e from b)
select i::int block, s + i * 512 start, least(512, e - (s + i * 512)) len from n, range(n.n) t(i)""")
def q_index_blocks(spark, sf_dir):
    """G1: 512-row index blocks over the event id range."""
    ev = fx.table(spark, sf_dir, "events")
    b = ev.agg(F.min("event_id").alias("s"), (F.max("event_id") + 1).alias("e"))
    return PR.index_blocks(b, "s", "e", 512)


@register("block_pairs", """with b as (select min(event_id) s, max(event_id) + 1 e from events),
 n as (select greatest(1, ceil((e - s) / 512))::bigint n from b)
select a.i::int b1, c.i::int b2 from n, range(n.n) a(i), range(n.n) c(i) where a.i <= c.i""")
def q_block_pairs(spark, sf_dir):
    """Block pairs with self pairs (b1 <= b2)."""
    ev = fx.table(spark, sf_dir, "events")
    b = PR.index_blocks(ev.agg(F.min("event_id").alias("s"), (F.max("event_id") + 1).alias("e")), "s", "e", 512)
    return PR.block_pairs(b).select(F.col("b1").cast("int").alias("b1"), F.col("b2").cast("int").alias("b2"))


@register("all_pairs_blocked", "select a.s_suppkey id1, b.s_suppkey id2 from supplier a join supplier b on a.s_suppkey < b.s_suppkey")
def q_all_pairs_blocked(spark, sf_dir):
    """All unordered supplier pairs, 8 hash blocks."""
    return PR.all_pairs_blocked(fx.table(spark, sf_dir, "supplier"), "s_suppkey", 8)


_FEAT_SQL = f"""{W40},
 f0 as (select wave_id, max(v) peak, avg(v) mean, stddev_pop(v) sd, min(v) lo from w group by wave_id),
 f as (select wave_id, (peak - avg(peak) over ()) / stddev_samp(peak) over () f0, (mean - avg(mean) over ()) / stddev_samp(mean) over () f1,
   (sd - avg(sd) over ()) / stddev_samp(sd) over () f2, (lo - avg(lo) over ()) / stddev_samp(lo) over () f3 from f0)"""


def _features(spark, sf_dir):
    w = fx.w40(spark, sf_dir)
    f0 = w.select("wave_id", F.array_max("v").alias("peak"), W.wave_mean("v").alias("mean"),
                  W.wave_std("v").alias("sd"), F.array_min("v").alias("lo"))
    z = ST.standardize(f0, ["peak", "mean", "sd", "lo"], ddof=1, keep=["wave_id"])
    return z.select("wave_id", F.col("peak").alias("f0"), F.col("mean").alias("f1"), F.col("sd").alias("f2"),
                    F.col("lo").alias("f3"))


@register("rbf_edges", f"""with {_FEAT_SQL}
select src, dst, weight from (select a.wave_id src, b.wave_id dst, round(exp(-((a.f0-b.f0)*(a.f0-b.f0)+(a.f1-b.f1)*(a.f1-b.f1)
  +(a.f2-b.f2)*(a.f2-b.f2)+(a.f3-b.f3)*(a.f3-b.f3))), 6) weight,
  exp(-((a.f0-b.f0)*(a.f0-b.f0)+(a.f1-b.f1)*(a.f1-b.f1)+(a.f2-b.f2)*(a.f2-b.f2)+(a.f3-b.f3)*(a.f3-b.f3))) w
  from f a join f b on a.wave_id < b.wave_id) where w >= 0.05""")
def q_rbf_edges(spark, sf_dir):
    """RBF similarity of standardised per-wave features, edges with weight >= 0.05."""
    e = PR.rbf_edges(_features(spark, sf_dir), ["f0", "f1", "f2", "f3"], key="wave_id", min_weight=0.05)
    return e.select("src", "dst", r6("weight").alias("weight"))


@register("rbf_knn_edges", f"""with {_FEAT_SQL},
 d as (select a.wave_id i, b.wave_id j, (a.f0-b.f0)*(a.f0-b.f0)+(a.f1-b.f1)*(a.f1-b.f1)+(a.f2-b.f2)*(a.f2-b.f2)+(a.f3-b.f3)*(a.f3-b.f3) d2
   from f a join f b on a.wave_id <> b.wave_id),
 o as (select *, row_number() over (partition by i order by d2, j) rn from d)
select least(i, j) src, greatest(i, j) dst, round(exp(-min(d2)), 6) weight from o where rn <= 10 group by all""")
def q_rbf_knn_edges(spark, sf_dir):
    """G4 with bounded degree: RBF edges of each wave and its 10 nearest."""
    e = PR.rbf_edges(_features(spark, sf_dir), ["f0", "f1", "f2", "f3"], key="wave_id", n_neighbors=10)
    return e.select("src", "dst", r6("weight").alias("weight"))


@register("rbf_pairs", f"""with {W40},
 z as (select wave_id, pos, (v - m) / case when s = 0 then 1 else s end z from w
   join (select wave_id, avg(v) m, stddev_pop(v) s from w group by wave_id) using (wave_id)),
 pr as (select distinct a.wave_id u1, b.wave_id u2 from w a join w b on b.wave_id = a.wave_id + 10000000 and b.n = a.n),
 d as (select pr.u1, pr.u2, sum((a.z - b.z) * (a.z - b.z)) d2 from pr join z a on a.wave_id = pr.u1
   join z b on b.wave_id = pr.u2 and b.pos = a.pos group by pr.u1, pr.u2)
select u1, u2, round(-d2, 4) log_weight, round(exp(-d2), 6) weight from d""")
def q_rbf_pairs(spark, sf_dir):
    """RBF similarity of chosen waveform pairs of users u and u+10 after z-scoring."""
    w = fx.w40(spark, sf_dir)
    a = w.select(F.col("wave_id").alias("u1"), F.col("v").alias("v1"))
    b = w.select(F.col("wave_id").alias("u2"), F.col("v").alias("v2"))
    pr = a.join(b, (F.col("u2") == F.col("u1") + 10 * fx.WAVE_STEP) & (F.size("v1") == F.size("v2")))
    d = W.scaled_distance("v1", "v2")
    return pr.select("u1", "u2", F.round(-(d * d), 4).alias("log_weight"), r6(F.exp(-(d * d))).alias("weight"))


@register("labelled_events", f"""with d as ({osql.fixture_dbscan_sql('EVT', 8.0, 4)})
select e.event_id, e.user_id, e.event_type, round(e.value, 6) value, d.label from events e join d on d.id = e.event_id""")
def q_labelled_events(spark, sf_dir):
    """DBSCAN labels (inside each event type) joined back to all events."""
    r = DensityClusterer(8.0, 4).fit(fx.evt_points(spark, sf_dir), by="event_type").result
    ev = fx.table(spark, sf_dir, "events")
    return ev.join(r.select(F.col("id").alias("event_id"), "label"), "event_id") \
        .select("event_id", "user_id", "event_type", r6("value").alias("value"), "label")
