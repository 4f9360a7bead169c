"""Exact DBSCAN: fixture counts, strategies, metrics and edge cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from densitykit.operators.dbscan import DensityClusterer
from densitykit.operators.neighbors import eps_join, neighbour_counts
from densitykit.plans import fixtures as fx
from tests.conftest import SF, points_df


def summary(result):
    kinds = {r["kind"]: r["count"] for r in result.groupBy("kind").count().collect()}
    clusters = result.where("kind = 'core'").select("label").distinct().count()
    return clusters, kinds.get("core", 0), kinds.get("border", 0), kinds.get("noise", 0)


def brute(points, eps, min_samples, metric="euclidean"):
    """Plain-Python exact DBSCAN (labels = lowest core id; border = lowest neighbouring label)."""
    ids = [p[0] for p in points]
    xs = {p[0]: p[1:] for p in points}

    def d(a, b):
        diffs = [x - y for x, y in zip(xs[a], xs[b])]
        if metric == "euclidean":
            return sum(t * t for t in diffs) <= eps * eps
        if metric == "manhattan":
            return sum(abs(t) for t in diffs) <= eps
        return max(abs(t) for t in diffs) <= eps

    nb = {a: [b for b in ids if d(a, b)] for a in ids}
    core = {a for a in ids if len(nb[a]) >= min_samples}
    label = {}
    for c in sorted(core):
        if c in label:
            continue
        stack, comp = [c], {c}
        while stack:
            u = stack.pop()
            for v in nb[u]:
                if v in core and v not in comp:
                    comp.add(v)
                    stack.append(v)
        for v in comp:
            label[v] = min(comp)
    out = {}
    for a in ids:
        if a in core:
            out[a] = (label[a], "core")
        else:
            ls = [label[b] for b in nb[a] if b in core]
            out[a] = (min(ls), "border") if ls else (-1, "noise")
    return out


def as_dict(result):
    return {r["id"]: (r["label"], r["kind"]) for r in result.collect()}


@pytest.mark.parametrize("sf,name,eps,m,expected", [
    ("0.001", "PT", 2.0, 6, (6, 15, 25, 160)),
    ("0.001", "EV", 8.0, 4, (19, 130, 35, 36)),
    ("0.001", "EV", 3.0, 8, (0, 0, 0, 201)),
    ("0.001", "E3", 0.4, 5, (16, 34, 72, 394)),
    ("0.01", "PT", 2.0, 6, (95, 901, 651, 448)),
])
def test_fixture_counts(spark, sf, name, eps, m, expected):
    r = DensityClusterer(eps, m).fit(fx.points(spark, SF[sf], name)).result
    assert summary(r) == expected


def test_pair_count(spark):
    assert eps_join(fx.pt_points(spark, SF["0.001"]), 2.0).count() == 610
    assert eps_join(fx.pt_points(spark, SF["0.01"]), 2.0).count() == 10704


@pytest.mark.parametrize("p", [1, 4, 6, 16])
def test_kd_equals_grid(spark, p):
    pts = fx.pt_points(spark, SF["0.001"])
    grid = as_dict(DensityClusterer(2.0, 6).fit(pts).result)
    kd = as_dict(DensityClusterer(2.0, 6, strategy="kd", max_partitions=p).fit(pts).result)
    assert kd == grid


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "chebyshev"])
def test_against_brute_force(spark, metric):
    rnd = random.Random(3)
    rows = [(i, rnd.gauss(0, 1) + (i % 3) * 3, rnd.gauss(0, 1)) for i in range(150)]
    r = as_dict(DensityClusterer(0.5, 4, metric=metric).fit(points_df(spark, rows)).result)
    assert r == brute(rows, 0.5, 4, metric)


def test_permutation_and_contraction_invariance(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.uniform(0, 10), rnd.uniform(0, 10)) for i in range(300)]
    a = as_dict(DensityClusterer(0.8, 5).fit(points_df(spark, rows)).result)
    b = as_dict(DensityClusterer(0.8, 5, contract=False).fit(points_df(spark, list(reversed(rows)))).result)
    assert a == b == brute(rows, 0.8, 5)


def test_empty_and_single(spark):
    assert DensityClusterer(1.0, 2).fit(points_df(spark, [])).result.count() == 0
    assert as_dict(DensityClusterer(1.0, 2).fit(points_df(spark, [(7, 0.0, 0.0)])).result) == {7: (-1, "noise")}
    assert as_dict(DensityClusterer(1.0, 1).fit(points_df(spark, [(7, 0.0, 0.0)])).result) == {7: (7, "core")}


def test_duplicates_points_and_negative(spark):
    rows = [(i, -5.0, -7.0) for i in range(50)]
    r = as_dict(DensityClusterer(0.1, 10).fit(points_df(spark, rows)).result)
    assert set(r.values()) == {(0, "core")}


def test_exact_eps_and_rounding_edge(spark):
    rows = [(1, 0.0, 0.0), (2, 2.0, 0.0), (3, 1.9999999999999998, 0.0), (4, 4.0, 0.0)]
    pairs = {(r["a"], r["b"]) for r in eps_join(points_df(spark, rows), 2.0).collect()}
    assert (1, 2) in pairs and (2, 1) in pairs          # exactly eps apart counts
    assert (3, 4) in pairs                              # 4.0 - 1.9999999999999998 == 2.0 in doubles
    xs = {i: x for i, x, _ in rows}
    assert pairs == {(a, b) for a in xs for b in xs if (xs[a] - xs[b]) * (xs[a] - xs[b]) <= 2.0 * 2.0}


def test_border_between_two_clusters(spark):
    left = [(i, -1.0 - 0.1 * (i - 1), 0.0) for i in range(1, 6)]
    right = [(100 + i, 1.0 + 0.1 * (i - 1), 0.0) for i in range(1, 6)]
    mid = [(50, 0.0, 0.0)]
    rows = left + right + mid
    r = as_dict(DensityClusterer(1.0, 4).fit(points_df(spark, rows)).result)
    assert r == brute(rows, 1.0, 4)
    assert r[101] == (101, "core")
    assert r[50] == (1, "border")


def test_chain_across_parts(spark):
    rows = [(i, float(i), 0.0) for i in range(200)]
    for strategy, p in [("grid", None), ("kd", 16)]:
        r = as_dict(DensityClusterer(1.0, 3, strategy=strategy, max_partitions=p).fit(points_df(spark, rows)).result)
        assert all(v[0] == 1 for v in r.values())  # lowest core key; the ends are border points
        assert r[0][1] == r[199][1] == "border" and r[100][1] == "core"


def test_k1_and_k3(spark):
    rnd = random.Random(9)
    rows1 = [(i, rnd.uniform(0, 20)) for i in range(100)]
    r1 = as_dict(DensityClusterer(0.3, 3).fit(points_df(spark, rows1, k=1)).result)
    assert r1 == brute(rows1, 0.3, 3)
    rows3 = [(i, rnd.uniform(0, 3), rnd.uniform(0, 3), rnd.uniform(0, 3)) for i in range(200)]
    r3 = as_dict(DensityClusterer(0.5, 4).fit(points_df(spark, rows3, k=3)).result)
    assert r3 == brute(rows3, 0.5, 4)
    r4 = as_dict(DensityClusterer(0.5, 4, strategy="kd", max_partitions=8).fit(points_df(spark, rows3, k=3)).result)
    assert r4 == r3


def test_duplicate_keys_raise(spark):
    with pytest.raises(ValueError):
        DensityClusterer(1.0, 2).fit(points_df(spark, [(1, 0.0, 0.0), (1, 1.0, 1.0)]))


def test_nan_handling(spark):
    from densitykit.operators.points import as_points

    df = spark.createDataFrame([(1, 0.0, 0.0), (2, float("nan"), 1.0), (3, None, 1.0)], "k BIGINT, a DOUBLE, b DOUBLE")
    assert as_points(df, "k", ["a", "b"], nulls="drop").count() == 1
    with pytest.raises(Exception):
        as_points(df, "k", ["a", "b"]).collect()


def test_dense_labels(spark):
    rows = [(10 + i, 0.0 + 0.01 * i, 0.0) for i in range(5)] + [(i, 5.0 + 0.01 * i, 0.0) for i in range(5)]
    r = as_dict(DensityClusterer(0.1, 3, labels="dense").fit(points_df(spark, rows)).result)
    assert {v[0] for v in r.values()} == {0, 1}
    assert r[0][0] == 0 and r[10][0] == 1


def test_neighbour_counts_match_pairs(spark):
    pts = fx.pt_points(spark, SF["0.001"])
    n = {r["id"]: r["n"] for r in neighbour_counts(pts, 2.0).collect()}
    p = eps_join(pts, 2.0).groupBy("a").count().collect()
    assert n == {r["a"]: r["count"] for r in p}


@pytest.mark.parametrize("strategy", ["grid", "kd"])
@pytest.mark.parametrize("bad", [float("nan"), float("inf"), None])
def test_bad_coordinates_are_an_error_or_left_out(spark, strategy, bad):
    rows = [(i, 0.1 * i, 0.0) for i in range(10)] + [(100 + i, 100 + 0.1 * i, 0.0) for i in range(10)] + [(999, bad, 0.0)]
    pts = points_df(spark, rows)
    with pytest.raises(ValueError):
        DensityClusterer(1.0, 3, strategy=strategy).fit(pts)
    with pytest.raises(ValueError):
        eps_join(pts, 1.0, strategy=strategy).count()
    got = {r["id"]: r["label"] for r in DensityClusterer(1.0, 3, strategy=strategy, nulls="drop").fit(pts).result.collect()}
    assert got == {**{i: 0 for i in range(10)}, **{100 + i: 100 for i in range(10)}}
    assert eps_join(pts, 1.0, strategy=strategy, nulls="drop").where("a = 999 or b = 999").count() == 0


def test_string_keys_and_dense_labels(spark):
    rows = [(f"k{i:02d}", 0.1 * i, 0.0) for i in range(5)] + [(f"m{i}", 50 + 0.1 * i, 0.0) for i in range(5)] + [("zz", 500.0, 0.0)]
    pts = spark.createDataFrame(rows, "id STRING, x0 DOUBLE, x1 DOUBLE")
    got = {r["id"]: r["label"] for r in DensityClusterer(1.0, 3).fit(pts).result.collect()}
    assert got["k04"] == "k00" and got["m3"] == "m0" and got["zz"] is None
    dense = {r["id"]: r["label"] for r in DensityClusterer(1.0, 3, labels="dense").fit(pts).result.collect()}
    assert (dense["k01"], dense["m1"], dense["zz"]) == (0, 1, -1)


def test_arrays_of_another_size_are_an_error(spark):
    from densitykit.operators.points import as_points

    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 50.0])], "id INT, v ARRAY<DOUBLE>")
    with pytest.raises(Exception):
        as_points(df, array_col="v", k=2).collect()
    assert [tuple(r) for r in as_points(df.where("id = 2"), array_col="v", k=3, axes=[2, 0]).collect()] == [(2, 50.0, 1.0)]


def test_too_many_parts_is_an_error(spark):
    from densitykit.operators.partition import MAX_PARTS, kd_partition

    with pytest.raises(ValueError):
        kd_partition(points_df(spark, [(1, 0.0, 0.0)]), max_partitions=MAX_PARTS + 1)
