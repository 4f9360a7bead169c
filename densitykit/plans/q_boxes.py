"""Box algebra, voxel and kd-partition queries (B1-B8, V1-V5, C1-C10) over PT."""

from __future__ import annotations

from pyspark.sql import functions as F

from densitykit.functions import boxes as bx
from densitykit.operators import voxel as vx
from densitykit.operators.boxjoin import box_join
from densitykit.operators.partition import axis_variance, halo_join, kd_partition, partition_stats
from densitykit.operators.stats import bounding_box
from densitykit.plans import fixtures as fx
from densitykit.plans import kd_sql
from densitykit.plans.catalog import r6, register
from densitykit.plans.oracles import POINTS_SQL, lit

PTB = "select p_partkey id, p_brand, p_size, p_retailprice::double x0, p_size::double x1 from part"
K = 2


def _ptb(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), "p_brand", "p_size",
        F.col("p_retailprice").cast("double").alias("x0"), F.col("p_size").cast("double").alias("x1"))


def _flat(box_col, k=K, lo="lo", hi="hi"):
    c = F.col(box_col) if isinstance(box_col, str) else box_col
    return [r6(c[lo][i]).alias(f"lo{i}") for i in range(k)] + [r6(c[hi][i]).alias(f"hi{i}") for i in range(k)]


def _flat_cols(lo="lo", hi="hi", k=K):
    return [r6(F.col(lo)[i]).alias(f"lo{i}") for i in range(k)] + [r6(F.col(hi)[i]).alias(f"hi{i}") for i in range(k)]


def _sql_box(alias="", k=K):
    a = f"{alias}." if alias else ""
    return ", ".join([f"round({a}lo{i}, 6) lo{i}" for i in range(k)] + [f"round({a}hi{i}, 6) hi{i}" for i in range(k)])


def _brand_boxes(spark, sf_dir, where=None):
    p = _ptb(spark, sf_dir)
    if where is not None:
        p = p.where(where)
    return bounding_box(p, ["x0", "x1"], by=["p_brand"])


def _sql_brand_boxes(where=""):
    w = f" where {where}" if where else ""
    return (f"select p_brand, min(x0) lo0, min(x1) lo1, max(x0) hi0, max(x1) hi1 from ({PTB}){w} "
            "group by p_brand")


# ---- B1-B8 -----------------------------------------------------------------------------

@register("bbox_agg", f"select p_brand, {_sql_box()} from ({_sql_brand_boxes()})")
def q_bbox_agg(spark, sf_dir):
    """B1: bounding box of (retail price, size) per brand."""
    return _brand_boxes(spark, sf_dir).select("p_brand", *_flat_cols())


@register("bbox_point", f"select id, round(x0, 6) lo0, round(x1, 6) lo1, round(x0, 6) hi0, round(x1, 6) hi1 from ({PTB})")
def q_bbox_point(spark, sf_dir):
    """B2: the degenerate box of each point."""
    return _ptb(spark, sf_dir).select("id", bx.box_from_point("x0", "x1").alias("b")).select("id", *_flat("b"))


_AB_SQL = (f"with a as ({_sql_brand_boxes('p_size <= 30')}), b as ({_sql_brand_boxes('p_size >= 20')}) ")


def _ab(spark, sf_dir):
    a = _brand_boxes(spark, sf_dir, F.col("p_size") <= 30).select("p_brand", F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
    b = _brand_boxes(spark, sf_dir, F.col("p_size") >= 20).select("p_brand", F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    return a.join(b, "p_brand")


@register("bbox_union", _AB_SQL + "select p_brand, " + ", ".join(
    [f"round(least(a.lo{i}, b.lo{i}), 6) lo{i}" for i in range(K)]
    + [f"round(greatest(a.hi{i}, b.hi{i}), 6) hi{i}" for i in range(K)]) + " from a join b using (p_brand)")
def q_bbox_union(spark, sf_dir):
    """Union of the per-brand boxes of small (size <= 30) and large (size >= 20) parts."""
    return _ab(spark, sf_dir).select("p_brand", bx.box_union("alo", "ahi", "blo", "bhi").alias("u")) \
        .select("p_brand", *_flat("u"))


@register("bbox_intersect", _AB_SQL + "select p_brand, " + ", ".join(
    [f"round(greatest(a.lo{i}, b.lo{i}), 6) lo{i}" for i in range(K)]
    + [f"round(least(a.hi{i}, b.hi{i}), 6) hi{i}" for i in range(K)])
    + ", (" + " or ".join(f"greatest(a.lo{i}, b.lo{i}) > least(a.hi{i}, b.hi{i})" for i in range(K))
    + ") is_empty from a join b using (p_brand)")
def q_bbox_intersect(spark, sf_dir):
    """Intersection of the same two boxes, with the inverted flag."""
    return _ab(spark, sf_dir).select("p_brand", bx.box_intersection("alo", "ahi", "blo", "bhi").alias("u")) \
        .select("p_brand", *_flat("u"), F.col("u.is_empty").alias("is_empty"))


@register("bbox_split", f"""with f as ({_sql_brand_boxes()}), m as (select p_brand, avg(x0) v from ({PTB}) group by p_brand)
select p_brand, 0 side, round(lo0, 6) lo0, round(lo1, 6) lo1, round(v, 6) hi0, round(hi1, 6) hi1 from f join m using (p_brand)
union all
select p_brand, 1 side, round(v, 6) lo0, round(lo1, 6) lo1, round(hi0, 6) hi0, round(hi1, 6) hi1 from f join m using (p_brand)""")
def q_bbox_split(spark, sf_dir):
    """Each brand box split on the price axis at the brand's mean price (left, right)."""
    pts = _ptb(spark, sf_dir)
    m = pts.groupBy("p_brand").agg(F.avg("x0").alias("v"))
    f = _brand_boxes(spark, sf_dir).join(m, "p_brand")
    return f.select("p_brand", F.posexplode(bx.box_split("lo", "hi", 0, F.col("v"))).alias("side", "b")) \
        .select("p_brand", F.col("side").cast("int").alias("side"), *_flat("b"))


@register("bbox_expand", f"""with f as ({_sql_brand_boxes()})
select p_brand, 'add' how, {', '.join([f'round(lo{i} - {lit(1.5)}, 6) lo{i}' for i in range(K)] + [f'round(hi{i} + {lit(1.5)}, 6) hi{i}' for i in range(K)])} from f
union all
select p_brand, 'multiply' how, {', '.join([f'round(lo{i} - (hi{i} - lo{i}) * {lit(0.1)}, 6) lo{i}' for i in range(K)] + [f'round(hi{i} + (hi{i} - lo{i}) * {lit(0.1)}, 6) hi{i}' for i in range(K)])} from f""")
def q_bbox_expand(spark, sf_dir):
    """Brand boxes grown by 1.5 (add) and by 10% of their span (multiply)."""
    f = _brand_boxes(spark, sf_dir)
    add = f.select("p_brand", F.lit("add").alias("how"), bx.box_expand("lo", "hi", 1.5, "add").alias("b"))
    mul = f.select("p_brand", F.lit("multiply").alias("how"), bx.box_expand("lo", "hi", 0.1, "multiply").alias("b"))
    return add.unionByName(mul).select("p_brand", "how", *_flat("b"))


@register("bbox_contains", f"""with s as ({_sql_brand_boxes('p_size <= 10')})
select s.p_brand, count(*) n from ({PTB}) p join s on {' and '.join(f'p.x{i} >= s.lo{i} and p.x{i} <= s.hi{i}' for i in range(K))}
group by s.p_brand""")
def q_bbox_contains(spark, sf_dir):
    """Parts (any brand) inside each brand's box of small parts (inclusive)."""
    s = _brand_boxes(spark, sf_dir, F.col("p_size") <= 10)
    return box_join(_ptb(spark, sf_dir).select("id", "x0", "x1"), s).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@register("box_in_box", f"""with f as ({_sql_brand_boxes()}), s as ({_sql_brand_boxes('p_size <= 10')}),
 u as ({_sql_brand_boxes('p_size >= 20')})
select p_brand, ({' and '.join(f'f.hi{i} >= s.hi{i} and f.lo{i} <= s.lo{i}' for i in range(K))}) small_in_full,
 ({' and '.join(f'u.hi{i} >= s.hi{i} and u.lo{i} <= s.lo{i}' for i in range(K))}) small_in_large
from f join s using (p_brand) join u using (p_brand)""")
def q_box_in_box(spark, sf_dir):
    """Is the brand's small-part box inside its full box / its large-part box."""
    f = _brand_boxes(spark, sf_dir).select("p_brand", F.col("lo").alias("flo"), F.col("hi").alias("fhi"))
    s = _brand_boxes(spark, sf_dir, F.col("p_size") <= 10).select("p_brand", F.col("lo").alias("slo"), F.col("hi").alias("shi"))
    u = _brand_boxes(spark, sf_dir, F.col("p_size") >= 20).select("p_brand", F.col("lo").alias("ulo"), F.col("hi").alias("uhi"))
    j = f.join(s, "p_brand").join(u, "p_brand")
    return j.select("p_brand", bx.box_in_box("flo", "fhi", "slo", "shi").alias("small_in_full"),
                    bx.box_in_box("ulo", "uhi", "slo", "shi").alias("small_in_large"))


# ---- V1-V5 (PT, eps 1: voxel side 2) ----------------------------------------------------

PT = POINTS_SQL["PT"]
_V_SQL = f"with v as (select id, floor(x0 / 2.0)::bigint c0, floor(x1 / 2.0)::bigint c1 from ({PT})) "


def _corners(spark, sf_dir):
    return vx.voxel_corners(fx.pt_points(spark, sf_dir), 1.0)


@register("voxel_corner", _V_SQL + "select id, c0, c1 from v")
def q_voxel_corner(spark, sf_dir):
    """V1: voxel corner of each point (side 2 eps, eps 1)."""
    return _corners(spark, sf_dir)


@register("voxel_count", _V_SQL + "select c0, c1, count(*) cnt from v group by c0, c1")
def q_voxel_count(spark, sf_dir):
    """V2: points per voxel."""
    return vx.voxel_counts(_corners(spark, sf_dir), 2)


@register("voxel_bounds", _V_SQL + "select min(c0) lo0, min(c1) lo1, max(c0) hi0, max(c1) hi1 from v")
def q_voxel_bounds(spark, sf_dir):
    """V3: lowest and highest voxel corner."""
    return vx.voxel_bounds(vx.voxel_counts(_corners(spark, sf_dir), 2), 2)


@register("voxel_range_count", f"""with v as (select id, p_size, floor(x0 / 2.0)::bigint c0, floor(x1 / 2.0)::bigint c1 from ({PTB})),
 b as (select min(c0) lo0, min(c1) lo1, max(c0) hi0, max(c1) hi1 from v where p_size <= 10),
 c as (select c0, c1, count(*) cnt from v group by c0, c1)
select sum(cnt)::bigint n from c, b where c0 between lo0 and hi0 and c1 between lo1 and hi1""")
def q_voxel_range_count(spark, sf_dir):
    """V4: points in voxels inside the bounding voxel range of the small parts."""
    p = _ptb(spark, sf_dir)
    v = vx.voxel_corners(p, 1.0).join(p.select("id", "p_size"), "id")
    bounds = vx.voxel_bounds(vx.voxel_counts(v.where("p_size <= 10"), 2), 2)
    return vx.voxel_range_count(vx.voxel_counts(v, 2), bounds, 2).select("n")


@register("voxel_range_counts", f"""with v as (select p_brand, p_size, floor(x0 / 2.0)::bigint c0, floor(x1 / 2.0)::bigint c1 from ({PTB})),
 b as (select p_brand, m.d move, min(c0) + m.d lo0, min(c1) lo1, max(c0) + m.d hi0, max(c1) hi1 from v, (values (0), (7), (1000000)) m(d) where p_size <= 10 group by p_brand, m.d),
 c as (select c0, c1, count(*) cnt from v group by c0, c1)
select p_brand, move, lo0, lo1, hi0, hi1, coalesce(sum(cnt), 0)::bigint n
from b left join c on c0 between lo0 and hi0 and c1 between lo1 and hi1 group by all""")
def q_voxel_range_counts(spark, sf_dir):
    """V4: points in the voxel range of every brand's small parts, as it is, moved a little and moved beyond all points."""
    p = _ptb(spark, sf_dir)
    v = vx.voxel_corners(p, 1.0).join(p.select("id", "p_brand", "p_size"), "id")
    b = v.where("p_size <= 10").withColumn("move", F.explode(F.array(F.lit(0), F.lit(7), F.lit(1_000_000)))).groupBy("p_brand", "move") \
        .agg(*[(getattr(F, f)(f"c{i}") + (F.col("move") if i == 0 else 0)).alias(f"{e}{i}") for e, f in (("lo", "min"), ("hi", "max")) for i in range(K)])
    return vx.voxel_range_counts(vx.voxel_counts(v, 2), b, 2)


@register("voxel_key_count", _V_SQL + """select c0 p1_0, c1 p1_1, c0 + 1 p2_0, c1 + 1 p2_1, count(*) cnt
from v group by c0, c1""")
def q_voxel_key_count(spark, sf_dir):
    """V5: (lower corner, upper corner) as one grouping key."""
    c = _corners(spark, sf_dir).select(F.array("c0", "c1").alias("p1"),
                                       F.array(F.col("c0") + 1, F.col("c1") + 1).alias("p2"))
    out = vx.voxel_key_counts(c)
    return out.select(F.col("p1")[0].alias("p1_0"), F.col("p1")[1].alias("p1_1"),
                      F.col("p2")[0].alias("p2_0"), F.col("p2")[1].alias("p2_1"), "cnt")


# ---- C1-C10 -----------------------------------------------------------------------------

def _kd(spark, sf_dir, p=4, axis="variance"):
    return kd_partition(fx.pt_points(spark, sf_dir), max_partitions=p, axis=axis)


def _kd_sql(p=4, axis="variance", tail=""):
    ctes, last, boxes = kd_sql.kd_sql("pts", K, p, axis)
    return "with pts as (" + PT + "), " + ", ".join(ctes) + ", " + kd_sql.boxes_cte(boxes, K) + \
        f", kdp as (select * from {last}) " + tail


@register("kd_partition", _kd_sql(4, tail="select id, part from kdp"))
def q_kd_partition(spark, sf_dir):
    """Kd part of every PT point, 4 parts."""
    return _kd(spark, sf_dir).points.select("id", "part")


@register("kd_partition_16", _kd_sql(16, tail="select id, part from kdp"))
def q_kd_partition_16(spark, sf_dir):
    """16 parts."""
    return _kd(spark, sf_dir, 16).points.select("id", "part")


@register("kd_partition_cycle", _kd_sql(4, "cycle", tail="select id, part from kdp"))
def q_kd_partition_cycle(spark, sf_dir):
    """C4: round-robin axes."""
    return _kd(spark, sf_dir, 4, "cycle").points.select("id", "part")


@register("kd_partition_p6", _kd_sql(6, tail="select id, part from kdp"))
def q_kd_partition_p6(spark, sf_dir):
    """6 parts (a partial last level)."""
    return _kd(spark, sf_dir, 6).points.select("id", "part")


@register("kd_boxes", _kd_sql(16, tail=f"select part, {_sql_box()} from kdboxes"))
def q_kd_boxes(spark, sf_dir):
    """Box of every part, 16 parts."""
    return _kd(spark, sf_dir, 16).boxes.select("part", *_flat_cols())


@register("axis_variance", _kd_sql(4, tail="""select part, round(var_pop(x0), 4) var0, round(var_pop(x1), 4) var1,
 case when var_pop(x0) >= var_pop(x1) then 0 else 1 end axis from kdp group by part"""))
def q_axis_variance(spark, sf_dir):
    """Per part of a 4-part tree, population variance per axis and the chosen axis."""
    v = axis_variance(_kd(spark, sf_dir).points.select("part", "x0", "x1"), 2)
    return v.select("part", F.round("var0", 4).alias("var0"), F.round("var1", 4).alias("var1"), "axis")


@register("median_split", _kd_sql(4, tail="""select part, m median, count(*) filter (where x0 < m) n_left,
 count(*) filter (where x0 >= m) n_right from kdp join (select part, percentile_disc(0.5) within group (order by x0 desc) m
 from kdp group by part) using (part) group by part, m"""))
def q_median_split(spark, sf_dir):
    """C2 + B9: upper median of price per part and the rows on each side."""
    from densitykit.operators.partition import median_split

    s = median_split(_kd(spark, sf_dir).points.select("part", "x0"), "x0")
    return s.groupBy("part", "median").agg(F.count_if(F.col("side") == "left").alias("n_left"),
                                           F.count_if(F.col("side") == "right").alias("n_right"))


@register("halo_join", _kd_sql(4, tail=f"select p.id, b.part from pts p join kdboxes b on {kd_sql.grown_contains(K, 4.0)}"))
def q_halo_join(spark, sf_dir):
    """Every point into each part whose box grown by 2 eps (eps 2) contains it."""
    kd = _kd(spark, sf_dir)
    return kd.halo(fx.pt_points(spark, sf_dir), 4.0).select("id", "part")


@register("halo_join_boxes", _kd_sql(4, tail=f"select p.id, b.part from pts p join kdboxes b on {kd_sql.grown_contains(K, 4.0)}"))
def q_halo_join_boxes(spark, sf_dir):
    """C8 against an explicit box table."""
    kd = _kd(spark, sf_dir)
    return halo_join(fx.pt_points(spark, sf_dir), kd.boxes, 4.0).select("id", "part")


@register("partition_stats", _kd_sql(4, tail=f"""select d.part, count(*) n, {', '.join([f'round(min(d.x{i}), 6) lo{i}' for i in range(K)] + [f'round(max(d.x{i}), 6) hi{i}' for i in range(K)])},
 count(*) filter (where {' and '.join(f'd.x{i} between b.lo{i} and b.hi{i}' for i in range(K))}) n_inside
 from kdp d join kdboxes b using (part) group by d.part"""))
def q_partition_stats(spark, sf_dir):
    """Rows per part, their bounding box, and how many lie inside the part's box."""
    kd = _kd(spark, sf_dir)
    s = partition_stats(kd.points.select("id", "x0", "x1", "part"), kd.boxes, 2)
    return s.select("part", "n", *[r6(f"lo{i}").alias(f"lo{i}") for i in range(K)],
                    *[r6(f"hi{i}").alias(f"hi{i}") for i in range(K)], "n_inside")
