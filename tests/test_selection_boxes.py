"""Order statistics, tree descent and box joins against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from densitykit.operators.boxjoin import box_join
from densitykit.operators.partition import halo_join, kd_partition
from densitykit.operators.selection import order_statistics
from tests.conftest import points_df


def values(kind, n, r):
    if kind == "ties":
        return [float(r.randint(0, 3)) for _ in range(n)]
    if kind == "wide":
        return [r.choice([-1, 1]) * 10.0 ** r.uniform(-300, 300) for _ in range(n)] + [1.7e308, -1.7e308, 0.0, 5e-324]
    return [r.gauss(0, 1) for _ in range(n)]


@pytest.mark.parametrize("buckets", [2, 7, None])
def test_order_statistics(spark, buckets):
    r = random.Random(3)
    groups = {f"{kind}{n}": values(kind, n, r) for kind in ("ties", "wide", "plain") for n in (1, 2, 3, 50)}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for rank, of in ((lambda n: F.floor(n / 2), lambda n: n // 2), (lambda n: F.lit(0), lambda n: 0), (lambda n: n - 1, lambda n: n - 1)):
        if buckets == 2 and of(5) != 2:
            continue
        got = {x.g: x.value for x in order_statistics(df, ["g"], "v", rank, buckets=buckets).collect()}
        assert got == {g: sorted(vs)[of(len(vs))] for g, vs in groups.items()}
    assert order_statistics(df.where("false"), ["g"], "v", lambda n: F.lit(0)).count() == 0


def plain_tree(rows, limit, k, cycle=False):
    """Parts by sorting, in the queue order of the tree."""
    parts, queue, level = {0: rows}, [0], 0
    while len(parts) < limit:
        wave = []
        while queue and len(parts) + len(wave) < limit:
            wave.append(queue.pop(0))
        done, grown = [], False
        for p in wave:
            done.append(p)
            ps = parts[p]
            spread = [sum((x[1 + i] - sum(y[1 + i] for y in ps) / len(ps)) ** 2 for x in ps) / len(ps) for i in range(k)]
            a = level % k if cycle else spread.index(max(spread))
            vs = sorted(x[1 + a] for x in ps)
            if vs[0] == vs[-1]:
                continue
            m = vs[len(vs) // 2]
            if m == vs[0]:
                m = next(v for v in vs if v > m)
            new = len(parts)
            parts[p], parts[new] = [x for x in ps if x[1 + a] < m], [x for x in ps if x[1 + a] >= m]
            done.append(new)
            grown = True
        queue += done
        level += 1
        if not grown:
            break
    return {x[0]: p for p, ps in parts.items() for x in ps}


@pytest.mark.parametrize("limit,cycle", [(1, False), (6, False), (16, True), (33, False)])
def test_tree_against_sorting(spark, limit, cycle):
    r = random.Random(limit)
    rows = [(i, r.gauss(0, 3), r.choice([1.0, 1.0, 1.0, r.random()]), float(r.randint(0, 20))) for i in range(700)]
    kd = kd_partition(points_df(spark, rows, 3), max_partitions=limit, axis="cycle" if cycle else "variance")
    got = {x.id: x.part for x in kd.points.collect()}
    assert got == plain_tree(rows, limit, 3, cycle)
    boxes = {b.part: (b.lo, b.hi) for b in kd.boxes.collect()}
    assert set(boxes) == set(got.values()) and kd.split_table().count() == len(boxes) - 1
    want = {(x[0], p) for x in rows for p, (lo, hi) in boxes.items() if all(a - 0.5 <= v <= b + 0.5 for v, a, b in zip(x[1:], lo, hi))}
    pts = points_df(spark, rows, 3)
    assert {(x.id, x.part) for x in kd.halo(pts, 0.5).collect()} == want
    assert {(x.id, x.part) for x in halo_join(pts, kd.boxes, 0.5).collect()} == want
    plan = kd.points._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("k", [1, 2, 4])
def test_box_join(spark, k):
    r = random.Random(k)
    inf, nan = float("inf"), float("nan")
    pts = [(i, *[r.choice([r.uniform(-5, 5), float(r.randint(-3, 3)), 1e6]) for _ in range(k)]) for i in range(300)] + [(900, *[nan] * k), (901, *[inf] * k)]
    boxes = []
    for b in range(150):
        lo = [r.choice([r.uniform(-6, 5), float(r.randint(-3, 3))]) for _ in range(k)]
        boxes.append((b, lo, [v + r.choice([0.0, 1e-9, 0.01, 1.0, 7.0, r.random()]) for v in lo]))
    boxes += [(200, [-inf] * k, [inf] * k), (201, [-inf] * k, [0.0] * k), (202, [3.0] * k, [2.0] * k), (203, [nan] * k, [1.0] * k), (204, [None] * k, [1.0] * k),
              (205, [0.0] * k, [1e6] * k), (206, list(pts[3][1:]), list(pts[3][1:]))]
    df = spark.createDataFrame(boxes, "part int, lo array<double>, hi array<double>")
    want = {(p[0], b) for p in pts for b, lo, hi in boxes if all(a is not None and a <= v <= c for v, a, c in zip(p[1:], lo, hi))}
    got = box_join(points_df(spark, pts, k), df)
    rows = [(x.id, x.part) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert box_join(points_df(spark, pts, k), df.where("false")).count() == 0
