"""Sharding by best-fit-decreasing bin packing of indivisible groups (operator 1).

Documents with equal text form a group that stays together. Group sizes are rounded up to 11
significant bits, which leaves at most some 55,000 size classes whatever the input, and only
the histogram (class, groups) goes to the driver. There best fit decreasing places runs of equal
groups into the tightest bin through a balanced tree (``densitykit.llm.bins``): with ``capacity``
it opens as few fixed-capacity shards as it can, with ``n_shards`` it is repeated at bisected
capacities until the least one that needs no more shards is found, so sizes come out near equal.
The executors number the groups of a class (hash buckets, no class in one task) and read the
shard off the plan.

A group larger than an even share (``total / n_shards``, or ``capacity``) can't stay whole; it is cut into the
fewest pieces that fit. At most ``n_shards`` groups can be that large.

Edge cases: null text has size 1 and forms one group of its own; empty texts another; null and
repeated ids are kept, one output row for each input row; rows equal in id and text are
interchangeable; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densitykit.llm.bins import best_fit_decreasing, even_bins
from densitykit.llm.common import gapless_rank
from densitykit.session import materialize

#: Significant bits of a size class.
BITS = 11


def _class(size) -> F.Column:
    """``size`` rounded up to BITS significant bits."""
    step = F.expr(f"shiftleft(1L, greatest(0, 64 - {BITS} - cast(_lead as int)))")
    return (F.ceil(size / step) * step).cast("long")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int | None = 8,
          capacity: int | None = None) -> DataFrame:
    """id_col, size, text_crc32, shard, slot, group (of equal texts).

    ``capacity`` (bytes) asks for the fewest shards of that size; otherwise the documents go
    into exactly ``n_shards`` shards of near-equal bytes.
    """
    spark = docs.sparkSession
    t = F.col(text_col).cast("string")
    meta = docs.select(F.col(id_col).alias("id"), (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"),
                       F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("crc"),
                       F.xxhash64(t.isNull(), t, F.octet_length(t), F.crc32(t.cast("binary"))).alias("g"))
    meta, st = materialize(meta, "shard-sizes", n=F.count(F.lit(1)), total=F.sum("size"))
    n, total = st["n"], st["total"] or 0
    if not n:
        return meta.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.col("g").alias("group"))
    share = capacity or -(-total // n_shards)
    groups = meta.groupBy("g").agg(F.count(F.lit(1)).alias("copies"), F.max("size").alias("size"))
    fit = F.greatest(F.lit(1), F.floor(F.lit(share) / F.col("size")))
    groups = groups.withColumn("pieces", F.when(F.col("copies") * F.col("size") > share, F.ceil(F.col("copies") / fit)).otherwise(F.lit(1)).cast("long"))
    groups, gst = materialize(groups, "shard-groups", n=F.count(F.lit(1)), cut=F.count_if(F.col("pieces") > 1))
    items = groups.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))) \
        .withColumn("held", F.expr("(copies * (piece + 1) + pieces - 1) div pieces - (copies * piece + pieces - 1) div pieces")) \
        .withColumn("bytes", F.col("held") * F.col("size")) \
        .withColumn("_lead", F.length(F.regexp_replace(F.lpad(F.bin("bytes"), 64, "0"), "1.*$", ""))) \
        .withColumn("class", _class(F.col("bytes"))).select("g", "piece", "class")
    runs = [(r["class"], r["c"]) for r in items.groupBy("class").agg(F.count(F.lit(1)).alias("c")).collect()]
    if capacity:
        top = max([capacity, *(c for c, _ in runs)])
        placed, _ = best_fit_decreasing(runs, top)
    else:
        placed, _ = even_bins(runs, n_shards)
    # runs of a class take consecutive numbers
    at: dict[int, int] = {}
    plan = []
    for c, b, k in placed:
        plan.append((c, at.get(c, 0), at.get(c, 0) + k, b))
        at[c] = at.get(c, 0) + k
    plan = spark.createDataFrame(plan, "class long, lo long, hi long, shard int")
    ranked = gapless_rank(items, ["class"], ["g", "piece"], "rank", total=gst["n"])
    # the plan holds a row for each class and shard boundary: its size is bounded by the classes
    placed_items = ranked.join(F.broadcast(plan), "class").where("rank >= lo and rank < hi").select("g", "piece", "shard")
    rows = meta.withColumn("piece", F.lit(0).cast("long"))
    if gst["cut"]:
        cut = groups.where("pieces > 1").select("g", "copies", "pieces")  # at most n_shards rows, or as many as fit a shard's bytes
        inside = gapless_rank(meta.join(cut, "g"), ["g"], ["id", "crc"], "r", total=n) \
            .withColumn("piece", F.expr("(r * pieces) div copies"))
        rows = meta.join(cut.select("g"), "g", "left_anti").withColumn("piece", F.lit(0).cast("long")) \
            .unionByName(inside.select("id", "size", "crc", "g", "piece"))
    out = rows.join(placed_items, ["g", "piece"])
    out = gapless_rank(out, ["shard"], ["id", "g"], "slot", total=n)
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot", F.col("g").alias("group"))
