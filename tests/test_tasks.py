"""Work goes to as many tasks as it needs, and only what is needed leaves them."""

import numpy as np

from densitykit.sources import event_file as EF


def test_many_small_splits_share_tasks(tmp_path):
    rec = np.zeros(1, EF.event_dtype())
    rec["start_flag"], rec["n_channels"], rec["hp_flag"] = EF.START_FLAG, EF.N_CHANNELS, EF.HP_FLAG
    for i in range(EF.MANY_SPLITS + 8):
        (tmp_path / f"S{i}r1b1.dat").write_bytes(b"h".ljust(EF.HEADER_SIZE, b"\x00") + rec.tobytes() + b"end")
    for mode in ("events", "files"):
        reader = EF.EventFileReader({"path": str(tmp_path), "mode": mode}, None)
        parts = reader.partitions()
        assert len(parts) <= EF.MANY_SPLITS and sum(len(p.splits) for p in parts) == EF.MANY_SPLITS + 8
        got = [r for p in parts for r in reader.read(p)]
        series = [r[2] if mode == "files" else r["series"][0].as_py() for r in got]
        assert sorted(series) == list(range(EF.MANY_SPLITS + 8))
    whole = [EF.EventSplit("f", 512 * i, 512, 1 << 20, 0) for i in range(2000)]
    assert all(sum(s.count for s in p.splits) * EF.EVENT_SIZE <= EF.TASK_BYTES for p in EF.bundled(whole, False))


def test_nearest_of_a_part_with_ties():
    import pyarrow as pa

    from densitykit.operators.knn import _nearest

    rng = np.random.default_rng(4)
    p, c = rng.integers(0, 5, (300, 2)).astype(float), rng.integers(0, 5, (700, 2)).astype(float)
    keys = rng.permutation(700)
    places = pa.table({"part": np.zeros(300, np.int32), "place": np.arange(300), "x0": p[:, 0], "x1": p[:, 1]})
    right = pa.table({"neighbor": keys, "b0": c[:, 0], "b1": c[:, 1], "part": np.zeros(700, np.int32)})
    for row in _nearest(places, right, 2, 6).to_pylist():
        d2 = ((c - p[row["place"]]) ** 2).sum(axis=1)
        want = sorted(zip(d2.tolist(), keys.tolist()))[:6]
        assert [(n["d2"], n["neighbor"]) for n in row["near"]] == want
    assert [r["near"] for r in _nearest(places.slice(0, 2), right.slice(0, 0), 2, 6).to_pylist()] == [[], []]


def test_eps_join_is_never_broadcast_and_is_dealt_by_its_pairs(spark):
    from densitykit.operators import neighbors as N

    from pyspark.sql import functions as F

    pts = spark.range(3000).select("id", (F.col("id") % 60).cast("double").alias("x0"), (F.col("id") % 7).cast("double").alias("x1"))
    for strategy in ("grid", "kd"):
        pairs = N.eps_join(pts, 1.5, strategy=strategy, max_partitions=4)
        plan = pairs._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
        assert pairs.count() == pairs.distinct().count()
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert N.join_tasks(pts, [F.col("x0")], 5) == few
    assert N.join_tasks(pts, [F.lit(0)], 100 * few) > few


def test_cluster_map_of_every_core_key_without_comparing_every_pair(spark):
    from densitykit.operators.dbscan import DensityClusterer

    from pyspark.sql import functions as F

    pts = spark.range(400).select("id", (F.col("id") % 4 * 10).cast("double").alias("x0"), F.lit(0.0).alias("x1"))
    model = DensityClusterer(1.0, 5, contract=False).fit(pts)
    assert sorted((r.local_id, r.cluster) for r in model.cluster_map.collect()) == [(i, i % 4) for i in range(400)]
    assert model.compared["cells"] <= 16
