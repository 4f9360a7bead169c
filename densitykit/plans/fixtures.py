"""Point and waveform tables derived from the test tables (see FIXTURES.md).

Each loader reads only the columns it needs, so the parquet scan is pruned to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Parameters of the fixtures (fixed values of the test plan): name -> (k, eps, min_samples)
FIXTURE_PARAMS = {
    "PT": (2, 2.0, 6),
    "CU": (2, 0.25, 4),
    "EV": (2, 3.0, 8),
    "E3": (3, 0.4, 5),
}

# Start of the event clock used by the EV fixture: 2024-01-01 00:00:00 UTC in microseconds.
EV_EPOCH_US = 1704067200000000


def epoch_micros(col: str) -> F.Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ column, independent of the session time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {col})")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pt_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PT: parts as (retail price, size)."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_retailprice").cast("double").alias("x0"),
        F.col("p_size").cast("double").alias("x1"))


def cu_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CU: customers as (account balance / 1000, nation)."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_acctbal").cast("double") / 1000.0).alias("x0"),
        F.col("c_nationkey").cast("double").alias("x1"))


def ev_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV: 'error' events as (hours since the epoch start, value / 10)."""
    ev = table(spark, sf_dir, "events").where(F.col("event_type") == "error")
    us = epoch_micros("ts")
    return ev.select(F.col("event_id").alias("id"),
                     ((us - F.lit(EV_EPOCH_US)).cast("double") / 3600000000.0).alias("x0"),
                     (F.col("value").cast("double") / 10.0).alias("x1"))


def evt_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVT: all events as (hours since the epoch start, value / 10), with their type as a group."""
    us = epoch_micros("ts")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "event_type", ((us - F.lit(EV_EPOCH_US)).cast("double") / 3600000000.0).alias("x0"),
        (F.col("value").cast("double") / 10.0).alias("x1"))


def e3_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings, first three coordinates times 10."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), *[(e[i].cast("double") * 10).alias(f"x{i}") for i in range(3)])


def o3_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: orders as (total price / 10,000, days since 1995 / 30, priority 1-5)."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_totalprice").cast("double") / 10000.0).alias("x0"),
        (F.datediff(F.to_date("o_orderdate"), F.to_date(F.lit("1995-01-01"))).cast("double") / 30.0).alias("x1"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("x2"))


def li_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LI (bench): lineitem (quantity, extended price / 1000) keyed by a stored row id.

    lineitem has no unique key, so the id is derived from the file position of each row
    (``monotonically_increasing_id`` is stable for one read of an unchanged parquet file).
    """
    li = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    return li.select(F.monotonically_increasing_id().alias("id"),
                     F.col("l_quantity").cast("double").alias("x0"),
                     (F.col("l_extendedprice").cast("double") / 1000.0).alias("x1"))


POINTS = {"PT": pt_points, "CU": cu_points, "EV": ev_points, "E3": e3_points}


def points(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return POINTS[name](spark, sf_dir)


#: Wave ids are ``user_id * WAVE_STEP + block``.
WAVE_STEP = 1_000_000


def w40_long(spark: SparkSession, sf_dir: str, n: int = 40) -> DataFrame:
    """W40 long form ``wave_id, pos, v``: every user's whole series of event values by (ts, event_id),
    cut into consecutive waves of n values (the last one of a user may be shorter).

    The place of a value in its user's series is the number of the user's events on earlier days plus
    its place within the day, so no task holds the whole series of a user with very many events.
    """
    from pyspark.sql import Window

    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value").withColumn("_d", F.to_date("ts"))
    days = ev.groupBy("user_id", "_d").agg(F.count(F.lit(1)).alias("_c"))
    earlier = Window.partitionBy("user_id").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("user_id", "_d", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_o"))
    day = Window.partitionBy("user_id", "_d").orderBy("ts", "event_id")
    at = ev.withColumn("_r", F.row_number().over(day) - 1).join(days, ["user_id", "_d"]).withColumn("_p", F.col("_o") + F.col("_r"))
    return at.select((F.col("user_id") * WAVE_STEP + F.floor(F.col("_p") / n)).cast("bigint").alias("wave_id"),
                     (F.col("_p") % n).cast("int").alias("pos"), F.col("value").cast("double").alias("v"))


def w40(spark: SparkSession, sf_dir: str, n: int = 40) -> DataFrame:
    """W40 array form ``wave_id, v ARRAY<DOUBLE>`` ordered by position."""
    from densitykit.operators.waves import to_wave

    return to_wave(w40_long(spark, sf_dir, n), ["wave_id"])
