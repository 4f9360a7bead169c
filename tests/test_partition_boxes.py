"""kd partitioner invariants and box algebra laws."""

import random

import pytest
from pyspark.sql import functions as F

from densitykit.functions import boxes as bx
from densitykit.operators.partition import kd_partition
from tests.conftest import points_df


def test_balanced_parts(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.random(), rnd.random() * 5) for i in range(1024)]
    kd = kd_partition(points_df(spark, rows), max_partitions=16)
    sizes = sorted(r["count"] for r in kd.points.groupBy("part").count().collect())
    assert len(sizes) == 16 and sizes[-1] - sizes[0] <= 1
    # every point lies in its part's box
    j = kd.points.join(kd.boxes, "part").where(~bx.box_contains("lo", "hi", F.array("x0", "x1")))
    assert j.count() == 0


def test_label_order_p6(spark):
    rows = [(i, float(i), float(i % 7)) for i in range(600)]
    kd = kd_partition(points_df(spark, rows), max_partitions=6)
    assert [(s["part"], s["new_part"]) for s in kd.splits] == [(0, 1), (0, 2), (1, 3), (0, 4), (2, 5)]


def test_ties_and_few_points(spark):
    rows = [(i, 1.0 if i < 60 else float(i), 0.0) for i in range(100)]  # 60% equal at the median
    kd = kd_partition(points_df(spark, rows), max_partitions=4)
    sizes = {r["part"]: r["count"] for r in kd.points.groupBy("part").count().collect()}
    assert sum(sizes.values()) == 100 and all(v > 0 for v in sizes.values())
    one = kd_partition(points_df(spark, [(1, 0.0, 0.0)]), max_partitions=16)
    assert one.points.count() == 1 and one.boxes.count() == 1
    same = kd_partition(points_df(spark, [(i, 2.0, 2.0) for i in range(20)]), max_partitions=8)
    assert same.points.select("part").distinct().count() == 1


def test_box_laws(spark):
    df = spark.createDataFrame([([0.0, 1.0], [2.0, 3.0], [1.0, -1.0], [4.0, 2.0])], "alo array<double>, ahi array<double>, blo array<double>, bhi array<double>")
    r = df.select(bx.box_union("alo", "ahi", "blo", "bhi").alias("u"), bx.box_intersection("alo", "ahi", "blo", "bhi").alias("i"),
                  bx.box_union("blo", "bhi", "alo", "ahi").alias("u2"),
                  bx.box_split("alo", "ahi", 0, 1.5).alias("s"), bx.box_expand("alo", "ahi", [1.0, 2.0]).alias("e"),
                  bx.box_in_box(F.col("alo"), F.col("ahi"), F.col("alo"), F.col("ahi")).alias("self_in")).first()
    assert r["u"] == r["u2"]
    assert list(r["u"]["lo"]) == [0.0, -1.0] and list(r["u"]["hi"]) == [4.0, 3.0]
    assert list(r["i"]["lo"]) == [1.0, 1.0] and list(r["i"]["hi"]) == [2.0, 2.0] and not r["i"]["is_empty"]
    assert list(r["s"][0]["hi"]) == [1.5, 3.0] and list(r["s"][1]["lo"]) == [1.5, 1.0]
    assert list(r["e"]["lo"]) == [-1.0, -1.0] and list(r["e"]["hi"]) == [3.0, 5.0]
    assert r["self_in"]
    with pytest.raises(ValueError):
        bx.box_expand("alo", "ahi", 1.0, how="other")
