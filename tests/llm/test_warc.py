"""WARC archives: round trip, determinism, rolling, commit."""

import gzip
import hashlib
import os

import pytest

import __spark_entry__ as E
from densitykit.llm import warc
from tests.conftest import SF
from tests.harness import compare, duck

SCHEMA = "page_id long, url string, html string, part int, key long, digest string, copies int"


def order(rows):
    return sorted(rows, key=lambda r: [(x is None, x if x is not None else 0) for x in r])


def plain(rows, least=100):
    """Contract columns of ``(page_id, html)`` rows."""
    first, out = {}, []
    for k, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (t or "").encode()
        own = len(raw) < least or raw not in first
        out.append((k, len(raw), hashlib.sha256(raw).hexdigest(), "response" if own else "revisit", None if own else first[raw]))
        first.setdefault(raw, k)
    return out


def got_of(spark, folder, cols=("key", "payload_bytes", "payload_digest", "record_type", "refers_to")):
    return [tuple(r) for r in warc.read_warc(spark, folder).select(*cols).collect()]


def pages(spark):
    big, same = "<p>" + "word " * 400_000, "<html>" + "same page " * 30
    rows = [(3, "http://a/3", same), (1, "http://a/1", same), (2, None, same), (1, "http://a/0", same), (1, "http://a/1", same), (None, "http://n", same),
            (4, "", ""), (5, "http://e", None), (6, "x y\r\nX-Key: 9\né", "short"), (7, "u", "short"), (8, "u", "y" * 99), (9, "u", "y" * 99),
            (10, "u", "y" * 100), (11, "u", "y" * 100), (12, "u", "é" * 50), (13, "u", "é" * 50), (14, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 9),
            (15, "big", big), (16, "big", big), (None, None, None), (None, "n", "only null " * 20), (None, "n", "only null " * 20), (-5, "m", "minus " * 40), (17, "m", "minus " * 40)]
    rows += [(100 + i, f"http://h/{i}", f"<p>page {i % 40} " + "text " * 30) for i in range(200)]
    return spark.createDataFrame([(*r, 1, 2, "c", 3) for r in rows], SCHEMA)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_against_sql(spark, sf):
    q = E.queries()["op12_warc"](spark, SF[sf])
    ok, said = compare(q, duck(SF[sf]), E.oracle_sql()["op12_warc"])
    assert ok, said


@pytest.mark.parametrize("shards", [1, 7])
def test_round_trip_and_standard_form(spark, tmp_path, shards, monkeypatch):
    df = pages(spark).repartition(5)
    want = order(plain([(r.page_id, r.html) for r in df.collect()]))
    a = warc.write_warc(df, folder=f"{tmp_path}/a", shards=shards, file_bytes=4000)
    assert order(got_of(spark, a)) == want
    monkeypatch.setattr(warc, "HOT_ROWS", 1)
    monkeypatch.setattr(warc, "HOT_SHARE", 100)
    b = warc.write_warc(df.coalesce(1), folder=f"{tmp_path}/b", shards=shards, file_bytes=4000)
    files = lambda f: {n: open(f"{f.removeprefix('file:')}/{n}", "rb").read() for n in os.listdir(f.removeprefix("file:")) if n.endswith(".gz")}
    assert files(a) == files(b)  # same rows, other partitions and the path for hot rows
    listed = {r.name: r for r in spark.read.parquet(f"{a}/_manifest").collect()}
    assert set(listed) == set(files(a)) and len(listed) >= 3 and not os.path.exists(f"{tmp_path}/a/_temporary")
    for n, raw in files(a).items():
        assert len(raw) == listed[n].n_bytes and hashlib.sha256(raw).hexdigest() == listed[n].sha256
        text = gzip.decompress(raw)
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and text.count(b"WARC-Record-ID: ") == 1 + listed[n].n_records
    rows = warc.read_warc(spark, a, with_payload=True).collect()
    texts = {}
    for r in df.collect():
        texts.setdefault(r.page_id, set()).add((r.html or "").encode())
    ids = {r.record_id for r in rows}
    assert len(ids) == len(rows) and all((bytes(r.payload) in texts[r.key]) if r.record_type == "response" else r.payload is None for r in rows)
    urls = {r.key: r.url for r in rows if r.key in (2, 4, 6)}
    assert urls == {2: None, 4: "", 6: "x%20y%0D%0AX-Key:%209%0A%C3%A9"}
    assert [r.url for r in rows if r.key == 1 and r.record_type == "response"] == ["http://a/0"]


def test_ranges_are_sorted_and_even(spark, tmp_path):
    df = spark.range(5000).selectExpr("id page_id", "'u' url", "concat('page ', id, repeat(' x', 60)) html") \
        .unionByName(spark.range(2500).selectExpr("7l page_id", "'u' url", "concat('same id ', id, repeat(' x', 60)) html"))
    folder = warc.write_warc(df, folder=f"{tmp_path}/a", shards=8)
    sizes = [r.n_records for r in spark.read.parquet(f"{folder}/_manifest").orderBy("name").collect()]
    assert len(sizes) == 8 and sum(sizes) == 7500 and max(sizes) < 2 * 7500 / 8
    for n in sorted(os.listdir(f"{tmp_path}/a")):
        if n.endswith(".gz"):
            with open(f"{tmp_path}/a/{n}", "rb") as f:
                keys = [int(x["x-key"]) for x, _ in warc.records(f) if "x-key" in x]
            assert keys == sorted(keys)


def test_commit_damage_and_empty(spark, tmp_path):
    df = pages(spark)
    folder = warc.write_warc(df.where("false"), folder=f"{tmp_path}/none")
    assert warc.read_warc(spark, folder).count() == 0
    folder = warc.write_warc(df, folder=f"{tmp_path}/a", shards=2)
    with pytest.raises(FileExistsError):
        warc.write_warc(df, folder=f"{tmp_path}/a")
    one = next(n for n in sorted(os.listdir(f"{tmp_path}/a")) if n.endswith(".gz"))
    whole = open(f"{tmp_path}/a/{one}", "rb").read()
    open(f"{tmp_path}/a/stray.warc.gz", "wb").write(whole)  # not in the manifest
    assert len(got_of(spark, folder)) == df.count()
    open(f"{tmp_path}/a/{one}", "wb").write(whole[:-10])
    with pytest.raises(Exception, match="size|ends inside"):
        got_of(spark, folder)
    text = gzip.decompress(whole)
    at = text.index(b"same page")
    open(f"{tmp_path}/x.gz", "wb").write(gzip.compress(text[:at] + b"S" + text[at + 1:]))
    with open(f"{tmp_path}/x.gz", "rb") as f, pytest.raises(ValueError, match="damaged"):
        list(warc.records(f))


def test_lookups_of_hot_payloads(spark, tmp_path, monkeypatch):
    df = spark.range(3000).selectExpr("id page_id", "'u' url", "concat(if(id % 3 = 0, 'hot', cast(id % 500 as string)), repeat(' y', 80)) html")
    want = order(plain([(r.page_id, r.html) for r in df.collect()]))
    monkeypatch.setattr(warc, "HOT_ROWS", 10)
    monkeypatch.setattr(warc, "HOT_SHARE", 100)
    assert order(got_of(spark, warc.write_warc(df, folder=f"{tmp_path}/a"))) == want
