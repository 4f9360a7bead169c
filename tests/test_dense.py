"""Dense regions, bounded-degree edges, voxel ranges and part-local clusters against plain loops."""

import random

import pytest

from densitykit.operators import cells
from densitykit.operators.dbscan import DensityClusterer
from densitykit.operators.knn import knn_join
from densitykit.operators.local_clusters import local_clusters
from densitykit.operators.neighbors import neighbour_counts
from densitykit.operators.voxel import voxel_range_counts
from tests.conftest import points_df
from tests.test_dbscan import as_dict, brute


def crowd(n, seed, k=2, reach=5.0):
    """60 % of the points in one cell of side eps = 1, some of them equal, the rest spread out around it."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 10 < 6:
            p = [0.3 + 0.9 * r.random() for _ in range(k)] if i % 20 else [0.5] * k
        else:
            p = [r.uniform(1 - reach, 1 + reach) for _ in range(k)]
        rows.append((i, *p))
    return rows


@pytest.mark.parametrize("metric,strategy,k", [("euclidean", "grid", 2), ("manhattan", "grid", 3), ("chebyshev", "grid", 2), ("euclidean", "kd", 4)])
def test_crowd_equals_brute_force(spark, monkeypatch, metric, strategy, k):
    monkeypatch.setattr(cells, "LEAF", 30)  # many levels
    rows = crowd(300, k, k)
    pts = points_df(spark, rows, k)
    model = DensityClusterer(1.0, 7, metric=metric, strategy=strategy, max_partitions=4).fit(pts)
    assert as_dict(model.result) == brute(rows, 1.0, 7, metric)


def test_counts_of_a_crowd(spark, monkeypatch):
    monkeypatch.setattr(cells, "LEAF", 50)
    rows = crowd(400, 9)
    got = {r.id: r.n for r in neighbour_counts(points_df(spark, rows), 0.7).collect()}
    want = {a[0]: sum((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 0.7 * 0.7 for b in rows) for a in rows}
    assert got == want


def test_comparisons_grow_with_the_points(spark):
    seen = []
    for n in (2000, 8000):
        model = DensityClusterer(1.0, 20).fit(points_df(spark, crowd(n, 3, reach=5.0 * (n / 2000) ** 0.5)))
        assert model.result.where("kind = 'core'").count() >= 0.6 * n
        seen.append(model.compared["points"] + model.compared["cells"])
    assert seen[1] <= 6 * seen[0] and seen[1] < 100 * 8000


def test_small_eps_beside_large_coordinates(spark):
    rows = [(i, 1e9 + (i // 4) * 1e-3 + (i % 4) * 1e-6, 5e8) for i in range(40)]
    got = as_dict(DensityClusterer(2e-6, 3).fit(points_df(spark, rows)).result)
    assert got == brute(rows, 2e-6, 3)


@pytest.mark.parametrize("k,n_neighbors", [(1, 3), (3, 5), (5, 2)])
def test_knn_join(spark, k, n_neighbors):
    r = random.Random(k)
    rows = [(i, *[r.choice([r.random(), 0.5, 0.5]) for _ in range(k)]) for i in range(260)] + [(1000 + i, *[0.25] * k) for i in range(40)]
    got = {}
    for x in knn_join(points_df(spark, rows, k), n_neighbors, part_rows=30).collect():
        got.setdefault(x.id, {})[x["rank"]] = (x.d2, x.neighbor)
    for a in rows:
        want = sorted((sum((p - q) * (p - q) for p, q in zip(a[1:], b[1:])), b[0]) for b in rows if b[0] != a[0])[:n_neighbors]
        mine = [got[a[0]][i + 1] for i in range(n_neighbors)]
        assert [m[1] for m in mine] == [w[1] for w in want] and all(abs(m[0] - w[0]) < 1e-12 for m, w in zip(mine, want))
    few = knn_join(points_df(spark, rows[:3], k), 9).collect()
    assert len(few) == 6 and knn_join(points_df(spark, [], k), 2).count() == 0


@pytest.mark.parametrize("k", [1, 2, 3])
def test_voxel_range_counts(spark, k):
    r = random.Random(k)
    vox = {tuple(r.randint(-9, 30) for _ in range(k)): r.randint(1, 5) for _ in range(80)}
    counts = spark.createDataFrame([(*c, n) for c, n in vox.items()], ", ".join([f"c{i} long" for i in range(k)] + ["cnt long"]))
    ranges = []
    for i in range(40):
        lo = [r.randint(-15, 35) for _ in range(k)]
        ranges.append((i, *[v for p in lo for v in (p, p + r.choice([0, 1, 7, 40, -3]))]))
    ranges += [(90, *[v for _ in range(k) for v in (-10**6, 10**6)]), (91, *[None] * (2 * k)), (92, *ranges[0][1:])]
    df = spark.createDataFrame(ranges, "r int, " + ", ".join(f"{e}{i} long" for i in range(k) for e in ("lo", "hi")))
    got = {x.r: x.n for x in voxel_range_counts(counts, df, k).collect()}
    for name, *ends in ranges:
        want = 0 if None in ends else sum(n for c, n in vox.items() if all(ends[2 * i] <= c[i] <= ends[2 * i + 1] for i in range(k)))
        assert got[name] == want, (name, ends)
    assert {x.n for x in voxel_range_counts(counts.where("false"), df, k).collect()} == {0}


@pytest.mark.parametrize("parts", [1, 5, 16])
def test_local_clusters_merge_to_the_whole(spark, parts):
    r = random.Random(parts)
    rows = [(i, r.uniform(0, 20), r.uniform(0, 20)) for i in range(350)] + [(400 + i, 2 + i * 0.4, 10.0) for i in range(40)]  # a chain across the parts
    pts = points_df(spark, rows)
    loc = local_clusters(pts, 0.9, 4, max_partitions=parts)
    want = brute(rows, 0.9, 4)
    got = {x.id: (x.label if x.label is not None else -1, x.kind) for x in loc.result.collect()}
    assert got == want
    homes = {x.id: x.part for x in loc.kd.points.collect()}
    named = {(x.part, x.cluster): x.label for x in loc.cluster_map.collect()}
    local = {(x.part, x.id): x for x in loc.local.collect()}
    for i, (label, kind) in want.items():
        assert local[homes[i], i].kind == kind and (kind != "core" or named[homes[i], local[homes[i], i].cluster] == label)
    audit = {x.id: x.clusters.split(";") for x in loc.audit().collect()}
    assert set(audit) == set(want) and sum(map(len, audit.values())) == len(local)
    assert all(f"{homes[i]}:{local[homes[i], i].cluster}" in audit[i] for i, (_, kind) in want.items() if kind == "core")


@pytest.mark.parametrize("metric,strategy,k", [("euclidean", "grid", 2), ("manhattan", "grid", 2), ("chebyshev", "kd", 3)])
def test_counts_in_arrays(spark, monkeypatch, metric, strategy, k):
    monkeypatch.setattr(cells, "LEAF", 200)  # several levels
    monkeypatch.setattr(cells, "PACK", 8)
    monkeypatch.setattr(cells, "PIECE", 5)  # cells of several arrays
    rows = crowd(300, 4, k)
    far = {"euclidean": lambda d: sum(x * x for x in d) <= 0.49, "manhattan": lambda d: sum(map(abs, d)) <= 0.7, "chebyshev": lambda d: max(map(abs, d)) <= 0.7}[metric]
    got = {r.id: r.n for r in neighbour_counts(points_df(spark, rows, k), 0.7, metric, strategy, max_partitions=4).collect()}
    assert got == {a[0]: sum(far([x - y for x, y in zip(a[1:], b[1:])]) for b in rows) for a in rows}
