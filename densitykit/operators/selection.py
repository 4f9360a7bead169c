"""Exact order statistics of many groups at once, by histogram refinement.

Every group keeps a bracket of values that holds the wanted one. A round counts the group's values inside its bracket
in a fixed number of equal buckets (partial aggregation, so at most groups x buckets rows leave a task) and takes the
bucket in which the wanted rank falls, shrunk to the least and greatest value in it, as the next bracket. Where those are
equal, that is the value. No task holds the values of a group; two or three rounds do for most data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from densitykit.session import materialize

#: Buckets of all groups together in a round, and the least and greatest number for one group.
TOTAL, LEAST, MOST = 1 << 20, 64, 1 << 16


def bucket_count(groups: int) -> int:
    return int(min(MOST, max(LEAST, TOTAL // max(1, groups))))


def narrow(rows: DataFrame, groups: Sequence[str], buckets: int) -> DataFrame:
    """One round: ``rows(groups, v, lo, hi, rank)``, each with the open bracket lo < hi of its group (rank from 0 among
    the values inside) -> ``groups, lo, hi, rank`` of the smaller brackets."""
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    share = F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2)  # halves, as the difference may overflow
    place = F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.floor(share * buckets)))
    bucket = F.when(v == lo, 0).when(v == hi, buckets - 1).otherwise(F.coalesce(place, F.lit(0))).cast("int")
    counts = rows.where((v >= lo) & (v <= hi)) \
        .groupBy(*groups, "rank", bucket.alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    earlier = Window.partitionBy(*groups).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0))) \
        .where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("c"))) \
        .select(*groups, "lo", "hi", (F.col("rank") - F.col("before")).alias("rank"))


def order_statistics(df: DataFrame, groups: Sequence[str], value: str, rank: Callable[[Column], Column], name: str = "value",
                     buckets: int | None = None) -> DataFrame:
    """``groups, name``: in each group the value of rank ``rank(n)`` (from 0) among its n values in rising order.

    Values are numbers (taken as doubles) without null or NaN; ``lambda n: F.floor(n / 2)`` is the upper median.
    """
    groups = list(groups)
    rows = df.select(*groups, F.col(value).cast("double").alias("v"))
    open_ = F.count_if(F.col("lo") < F.col("hi"))
    start = rows.groupBy(*groups).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")) \
        .select(*groups, "lo", "hi", rank(F.col("n")).cast("long").alias("rank"))
    state, st = materialize(start, "order-statistics", n=F.count(F.lit(1)), open=open_)
    done = [state.where("lo = hi")]
    while st["open"]:
        state, st = materialize(narrow(rows.join(state.where("lo < hi"), groups), groups, buckets or bucket_count(st["open"])), "order-statistics", open=open_)
        done.append(state.where("lo = hi"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*groups, F.col("lo").alias(name))
