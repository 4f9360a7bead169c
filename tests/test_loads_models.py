"""Repeat-safe loads and the power iteration."""

import numpy as np
import pytest

from densitykit.operators import pairs as PR
from densitykit.plans import pipelines as PL
from densitykit.sources import event_file as EF
from densitykit.sources import ledger as LG
from tests.test_event_file import write_file


def ids(spark, table):
    return sorted((r.path.rsplit("/", 1)[1], r.event_pos) for r in LG.loaded_events(spark, table).select("path", "event_pos").collect())


def test_load_ledger(spark, tmp_path):
    src, table = tmp_path / "src", f"file:{tmp_path}/table"
    src.mkdir()
    write_file(str(src), "S1r1b1.dat", 5)
    assert LG.ledger(spark, table).count() == 0 and LG.loaded_events(spark, table).count() == 0
    assert LG.load_events(spark, f"file:{src}", table) == 5
    assert LG.load_events(spark, f"file:{src}", table) == 0
    write_file(str(src), "S1r2b1.dat", 3)
    write_file(str(src), "S1r1b1.dat", 9)  # grown
    assert LG.load_events(spark, f"file:{src}", table) == 7
    assert ids(spark, table) == [("S1r1b1.dat", i) for i in range(9)] + [("S1r2b1.dat", i) for i in range(3)]
    # a load lost between its rows and its ledger entry, and one lost while the entry was written
    EF.read_events(spark, f"file:{src}").write.parquet(f"{table}/data/load=lost")
    (tmp_path / "table/ledger/load=lost").mkdir()
    assert len(ids(spark, table)) == 12 and LG.load_events(spark, f"file:{src}", table) == 0
    spans = sorted((r.file.rsplit("/", 1)[1], r.first, r.last) for r in LG.ledger(spark, table).collect())
    assert spans == [("S1r1b1.dat", 0, 4), ("S1r1b1.dat", 5, 8), ("S1r2b1.dat", 0, 2)]


def test_power_iteration(spark):
    rng = np.random.default_rng(5)
    n = 24
    w = np.zeros((n, n))
    for i in range(n):
        for j in range(i):
            if i // 8 == j // 8 or rng.random() < 0.05:
                w[i, j] = w[j, i] = rng.uniform(0.5, 1) if i // 8 == j // 8 else 0.01
    edges = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(n) for j in range(i) if w[i, j]], "src long, dst long, weight double")
    d = w.sum(axis=1)
    v = d / d.sum()
    for _ in range(6):
        v = (w @ v) / d
        v /= v.sum()
    got = {r.id: r.v for r in PL.power_iteration(edges, 6).collect()}
    assert np.allclose([got[i] for i in range(n)], v, rtol=1e-12)
    a = {r.id: r.cluster for r in PL.power_clusters(edges, 3).collect()}
    b = {r.id: r.cluster for r in PL.power_clusters(edges.repartition(5), 3).collect()}
    assert a == b and set(a.values()) <= {0, 1, 2} and len(set(a.values())) >= 2
    assert PL.power_iteration(edges.where("false")).count() == 0


def _blobs(spark, n, nulls=False):
    rng = np.random.default_rng(3)
    rows = [(i, *(float(x) for x in rng.normal(size=3) * 0.4 + 3.0 * (i % 4))) for i in range(n)]
    return spark.createDataFrame([*rows, *([(None, 0.0, 0.0, 0.0)] if nulls else [])], "id long, a double, b double, c double")


def test_sums_of_edges_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(PR, "LEAST_ROWS", 25)
    monkeypatch.setattr(PR, "TILE", 8)
    pts = _blobs(spark, 130, nulls=True)
    blocks = PR.rbf_edges(pts, ["a", "b", "c"], min_weight=0.05, form="blocks")
    assert blocks.n_blocks == 6
    rows = PR.rbf_edges(pts, ["a", "b", "c"], min_weight=0.05)
    w = np.zeros((130, 130))
    for r in rows.collect():
        w[r.src, r.dst] = w[r.dst, r.src] = r.weight
    got = {r.id: r.y for r in blocks.sums().collect()}
    assert set(got) == {i for i in range(130) if w[i].any()}
    assert np.allclose([got[i] for i in sorted(got)], w.sum(axis=1)[sorted(got)], rtol=1e-12)
    x = np.sin(np.arange(130))
    at = spark.createDataFrame([(i, float(x[i])) for i in range(130)], "id long, x double")
    got = {r.id: r.y for r in blocks.sums(at).collect()}
    assert np.allclose([got[i] for i in range(130)], w @ x, rtol=1e-12, atol=1e-13)
    a, b = ({r.id: r.v for r in PL.power_iteration(e, 4).collect()} for e in (blocks, rows))
    assert a.keys() == b.keys() and np.allclose([a[i] for i in a], [b[i] for i in a], rtol=1e-12)
    assert sorted(r.src for r in blocks.rows().collect()) == sorted(r.src for r in rows.collect())


def test_models_on_blocks_form_no_edge(spark, monkeypatch):
    monkeypatch.setattr(PR, "LEAST_ROWS", 25)
    monkeypatch.setattr(PL, "MOST_PAIRS", 100)
    monkeypatch.setattr(PR.RbfEdges, "rows", lambda self: pytest.fail("edges formed one by one"))
    pts = _blobs(spark, 120)
    edges = PR.rbf_edges(pts, ["a", "b", "c"], min_weight=0.05, form="blocks")
    with_edge = {r.id for r in edges.sums().collect()}
    got = {r.id: r.cluster for r in PL.pic_edges(edges, k=4).collect()}
    assert set(got) == with_edge and 2 <= len(set(got.values())) <= 4
    assert got == {r.id: r.cluster for r in PL.pic_edges(edges, k=4).collect()}
    power = {r.id for r in PL.power_clusters(edges, 3, max_iter=1, rounds=1).collect()}
    assert power == with_edge
    none = PR.rbf_edges(pts.where("id = 0"), ["a", "b", "c"], min_weight=0.05, form="blocks")
    assert PL.power_iteration(none).count() == 0
    labels = PL.gbt_labels(pts, PL.pic_edges(edges, k=4), ["a", "b", "c"], "id", max_iter=1)
    assert {r.id for r in labels.collect()} == with_edge
