"""Periodic runs against all-pairs comparison of words."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as E
from densitykit.llm import periodic, suffix_tree
from densitykit.llm.common import span_hashes
from tests.conftest import SF
from tests.llm.edge import edge_docs, empty_docs, prose


def plain(w, exponent=4, least=6):
    """Every maximal stretch whose words equal those q before them, q from 1 up; greater periods of it left out."""
    n, out = len(w), {}
    a = np.array([hash(t) for t in w], np.int64)
    for q in range(1, n // exponent + 1):
        same = np.concatenate([[0], (a[q:] == a[:-q]).astype(int), [0]])
        up, down = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        for s, e in zip(up.tolist(), (down + q).tolist()):
            length = e - s
            if length >= max(least, exponent * q) and not any(x <= s and e <= x + y for x, y, p in out if q % p == 0):
                out[s, length, q] = True
    return sorted(out, key=lambda r: (r[0], r[2]))


def edited(doc_id, text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def digest(doc_id, text):
    w = edited(doc_id, text)
    runs = plain(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(t for i, t in enumerate(w) if i not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_against_plain(spark):
    rows = spark.read.parquet(f"{SF['0.01']}/documents.parquet").collect()
    out = E.queries()["op13_periodic_runs"](spark, SF["0.01"])
    assert out.columns[:8] == COLUMNS
    got = {r.doc_id: tuple(r)[:8] for r in out.collect()}
    assert len(got) == len(rows) and sum(r[1] > 0 for r in got.values()) > 60
    for r in rows:
        assert got[r.doc_id] == digest(r.doc_id, r.text), r.doc_id


def test_edge_cases(spark, tmp_path):
    edge = edge_docs(spark)
    many = [(100 + i, t) for i, t in enumerate([
        "a " * 50_000, "x\ty\x0bx\x0cy x\ry x\ny", "a a a a a", "a a a a a a", "a b a b a b a b", "a b a b a b a", "a b " * 6,
        ("one two three " * 4 + "four ") * 4, " ".join(["p q"] * 5 + ["r"] + ["q p"] * 7), prose(5000, 1) + " " + prose(300, 2) * 2])]
    docs = edge.select("doc_id", "text", "n", "key")
    docs = docs.unionByName(spark.createDataFrame([(i, t, 1, 5) for i, t in many], "doc_id long, text string, n long, key long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = E.queries()["op13_periodic_runs"](spark, str(tmp_path)).collect()
    order = lambda rows: sorted(rows, key=lambda r: [(x is None, x if x is not None else 0) for x in r])
    want = [digest(r.doc_id, r.text) for r in docs.collect()]
    assert order(tuple(r)[:8] for r in got) == order(want)
    none = periodic.periodic_runs(empty_docs(spark))
    assert none.count() == 0 and none.columns == ["doc_id", "n_words", "runs", "collapsed"]
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, min_exponent=3)


def test_repetitions_against_plain():
    r = random.Random(5)
    for _ in range(1500):
        n, k = r.randint(0, 60), r.randint(1, 4)
        w = [r.randint(1, k) for _ in range(n)]
        if n and r.random() < 0.5:
            p, a = r.randint(1, max(1, n // 4)), r.randint(0, n - 1)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        for exponent, least in ((2, 2), (3, 6), (4, 6)):
            got = suffix_tree.repetitions(np.array(w, int), exponent, least)
            assert [tuple(x) for x in got.tolist()] == plain(w, exponent, least), (w, exponent)


def test_extensions_and_rank():
    rng = np.random.default_rng(2)
    for n, k in ((1, 1), (40, 1), (200, 2), (500, 30)):
        w = rng.integers(1, k + 1, n).tolist()
        tree = suffix_tree.SuffixTree(w, k)
        assert sorted(range(n + 1), key=lambda i: w[i:]) == np.argsort(tree.rank).tolist()
        i, j = rng.integers(0, n + 1, (2, 400))
        i, j = i[i != j], j[i != j]
        want = [next((x for x in range(n) if max(a, b) + x >= n or w[a + x] != w[b + x]), 0) for a, b in zip(i.tolist(), j.tolist())]
        assert tree.extension(i, j).tolist() == want


def test_cuts_lose_no_run():
    r = random.Random(9)
    for _ in range(300):
        w = []
        for _ in range(r.randint(1, 8)):
            p = [r.randint(1, r.choice([2, 5, 200])) for _ in range(r.randint(1, 30))]
            w += p * r.randint(1, 6) + p[:r.randint(0, len(p))]
        h = np.array(w, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        begins, ends = periodic.pieces(h, np.array([0]))
        got = [x for b, e in zip(begins.tolist(), ends.tolist()) for x in (suffix_tree.repetitions(np.array(w[b:e]), 4, 6) + [b, 0, 0]).tolist()]
        assert sorted(map(tuple, got), key=lambda x: (x[0], x[2])) == plain(w)
    assert len(span_hashes(np.zeros(0, np.uint8), np.zeros(0, int), np.zeros(0, int))) == 0
