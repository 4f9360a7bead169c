"""Event-file source: files written with numpy (header, events, footer, truncated tail)."""

import os
import tempfile

import numpy as np
import pytest

from densitykit.sources import event_file as EF


def write_file(folder, name, n, footer=b"FOOTER", tail=b"", bad_flag_at=None, seed=0):
    rng = np.random.default_rng(seed)
    rec = np.zeros(n, dtype=EF.event_dtype("little"))
    rec["start_flag"] = EF.START_FLAG
    rec["index"] = np.arange(n)
    rec["timestamp"] = np.arange(n) * 0.5
    rec["n_channels"] = 8
    rec["hp_flag"] = 0xFF
    rec["signal"] = rng.integers(-3000, 3000, size=(n, 8, 2048), dtype=np.int16)
    if bad_flag_at is not None:
        rec["hp_flag"][bad_flag_at] = 1
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(b"HEADER TEXT".ljust(EF.HEADER_SIZE, b"\x00"))
        f.write(rec.tobytes())
        f.write(tail)
        f.write(footer)
    return path, rec


@pytest.fixture(scope="module")
def folder():
    d = tempfile.mkdtemp(prefix="densitykit-ev-", dir="/tmp")
    a = write_file(d, "S223r10b1.dat", 37, seed=1)
    b = write_file(d, "C5r2b2.dat", 11, tail=b"\x01" * 100, seed=2)  # truncated record before the footer
    return d, {"S223r10b1.dat": a[1], "C5r2b2.dat": b[1]}


@pytest.mark.parametrize("per_split", [1, 4, 512])
def test_round_trip_independent_of_splits(spark, folder, per_split):
    d, recs = folder
    ev = EF.read_events(spark, d, eventsPerSplit=per_split)
    rows = ev.collect()
    assert len(rows) == 48
    for r in rows:
        rec = recs[os.path.basename(r["path"])]
        assert r["index"] == r["event_pos"]
        assert np.array_equal(np.array(r["signal"], dtype=np.int16), rec["signal"][r["event_pos"]])
    s1 = {(r["path"], r["event_pos"]): r["timestamp"] for r in rows}
    assert s1[(os.path.join(d, "S223r10b1.dat"), 36)] == 18.0


def test_name_fields_and_files_mode(spark, folder):
    d, _ = folder
    f = {r["path"].rsplit("/", 1)[1]: r for r in EF.read_event_files(spark, d).collect()}
    a, b = f["S223r10b1.dat"], f["C5r2b2.dat"]
    assert (a["type"], a["series"], a["run"], a["board"], a["n_events"]) == ("S", 223, 10, 1, 37)
    assert (b["type"], b["series"], b["run"], b["board"], b["n_events"]) == ("C", 5, 2, 2, 11)
    assert a["header"] == "HEADER TEXT" and a["footer"] == "FOOTER"
    assert b["footer"].endswith("FOOTER") and len(b["footer"]) == 106


def test_seek_prunes_splits(spark, folder):
    d, _ = folder
    assert EF.read_events(spark, d, eventsPerSplit=4).rdd.getNumPartitions() == 10 + 3
    ev = EF.read_events(spark, d, eventsPerSplit=4, eventFrom=8, eventTo=9)
    assert ev.rdd.getNumPartitions() == 2   # one split per file
    got = sorted((r["series"], r["event_pos"]) for r in ev.collect())  # exact without a filter
    assert got == [(5, 8), (5, 9), (223, 8), (223, 9)]
    assert [r["event_pos"] for r in EF.read_events(spark, d, eventsPerSplit=4, eventFrom=3, eventTo=3).collect()] == [3, 3]


def test_pushed_filters_give_the_same_rows(spark, folder):
    from pyspark.sql import functions as F

    d, _ = folder
    plain = EF.read_events(spark, d, eventsPerSplit=4).where(F.col("event_pos").between(3, 5) & (F.col("run") == 10))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = EF.read_events(spark, d, eventsPerSplit=4).where(F.col("event_pos").between(3, 5) & (F.col("run") == 10))
        assert sorted(r["event_pos"] for r in pushed.collect()) == [3, 4, 5]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert sorted(r["event_pos"] for r in plain.collect()) == [3, 4, 5]


def test_paths(spark, folder):
    d, _ = folder
    for path in (f"file:{d}", f"file://{d}", f"file:{d}/S*.dat,{d}/C*.dat"):
        assert EF.read_events(spark, path).count() == 48, path
    with pytest.raises(ValueError):
        EF.list_files("relative/folder")
    with pytest.raises(Exception):
        EF.list_files("nosuch://bucket/x")


def test_failfast_flags(spark):
    d = tempfile.mkdtemp(prefix="densitykit-ev-", dir="/tmp")
    write_file(d, "D1r1b1.dat", 5, bad_flag_at=3)
    assert EF.read_events(spark, d).count() == 5
    with pytest.raises(Exception):
        EF.read_events(spark, d, parseMode="failfast").collect()


def test_writer_round_trip(spark):
    from pyspark.sql import functions as F
    d = tempfile.mkdtemp(prefix="densitykit-ev-", dir="/tmp")
    rows = [("S", 1, r, 1, i, float(i), [[(i + c) % 100] * 2048 for c in range(8)]) for r in (1, 2) for i in range(3)]
    df = spark.createDataFrame(rows, "type STRING, series INT, run INT, board INT, index INT, timestamp DOUBLE, signal ARRAY<ARRAY<SMALLINT>>")
    EF.write_event_files(df, d + "/out", header="h", footer="f")
    back = EF.read_events(spark, d + "/out")
    assert back.count() == 6
    assert back.agg(F.sum(EF.signal_sum())).first()[0] == sum(sum(sum(ch) for ch in r[6]) for r in rows)


def test_append_keeps_what_is_there_and_overwrite_replaces(spark):
    d = tempfile.mkdtemp(prefix="densitykit-ev-", dir="/tmp")
    schema = "type STRING, series INT, run INT, board INT, index INT, timestamp DOUBLE, signal ARRAY<ARRAY<SMALLINT>>"

    def rows(n, at):
        return spark.createDataFrame([("S", 1, 1, 1, at + i, 0.0, [[c] * 2048 for c in range(8)]) for i in range(n)], schema)

    EF.write_event_files(rows(3, 0), d)
    EF.write_event_files(rows(1, 3), d)
    EF.write_event_files(rows(2, 4), d)
    back = EF.read_events(spark, d)
    assert sorted(r["index"] for r in back.select("index").collect()) == [0, 1, 2, 3, 4, 5]
    assert sorted(os.listdir(d)) == ["S1r1b1.1.dat", "S1r1b1.2.dat", "S1r1b1.dat"]  # no attempt folder is left
    assert {(r["type"], r["series"], r["run"], r["board"]) for r in EF.read_event_files(spark, d).collect()} == {("S", 1, 1, 1)}
    rows(1, 9).coalesce(1).write.format("event_file").mode("overwrite").save(d)
    assert [r["index"] for r in EF.read_events(spark, d).collect()] == [9]


def test_failed_write_leaves_nothing(spark):
    d = tempfile.mkdtemp(prefix="densitykit-ev-", dir="/tmp")
    bad = spark.createDataFrame([("S", 1, 1, 1, 0, 0.0, [[1, 2]])], "type STRING, series INT, run INT, board INT, index INT, timestamp DOUBLE, signal ARRAY<ARRAY<SMALLINT>>")
    with pytest.raises(Exception):
        EF.write_event_files(bad, d)
    assert EF.list_files(d) == []
