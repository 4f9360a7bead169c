import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from densitykit.llm import near_dup
from densitykit.llm.line_dedup import dedup_lines
from densitykit.llm.near_dup import Sampler, components, greatest_distance, near_duplicates
from tests.conftest import SF
from tests.llm.edge import edge_docs, empty_docs, prose, rows

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(docs, width, percent=80):
    """(id, size, component) of each row by comparing all pairs that share a shingle."""
    ss = [(d, shingles(t, width)) for d, t in docs]
    par, post = list(range(len(ss))), defaultdict(list)

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i, (d, s) in enumerate(ss):
        c = defaultdict(int)
        for x in s:
            for j in post[x]:
                c[j] += 1
            post[x].append(i)
        for j, n in c.items():
            if 100 * n >= percent * (len(s) + len(ss[j][1]) - n):
                par[find(i)] = find(j)
    low = defaultdict(list)
    for i, (d, s) in enumerate(ss):
        low[find(i)].append(d)
    return [(d, len(s), min((x for x in low[find(i)] if x is not None), default=None)) for i, (d, s) in enumerate(ss)]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def check(df, docs, width, **kw):
    got = near_duplicates(df, width=width, **kw).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=key) == sorted(brute(docs, width), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.component_id is not None or not r.n_shingles)
    return got


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_on_documents(spark, width):
    df = spark.read.parquet(f"{SF['0.001']}/documents.parquet")
    check(df, [(r.doc_id, r.text) for r in df.collect()], width)


def test_near_duplicates_edge_rows(spark):
    check(edge_docs(spark), [(r[0], r[1]) for r in rows()], 4)
    assert near_duplicates(empty_docs(spark)).count() == 0


def test_hot_group_with_edits_beyond_the_threshold(spark, monkeypatch):
    """Copies of one text with 1 to 9 edits: those beyond the threshold stay alone, and several blocks and chunks
    resolve what one leader leaves."""
    monkeypatch.setattr(near_dup, "BLOCK_SETS", 16)
    monkeypatch.setattr(near_dup, "PROBES", 25)
    rng, base = np.random.default_rng(4), prose(120, 9).split()
    docs = []
    for i in range(150):
        w = list(base)
        for p in rng.choice(120, int(rng.integers(1, 10)), replace=False):
            w[p] = f"edit{i}x{p}"
        docs.append((i, " ".join(w)))
    docs += [(1000 + i, base_) for i, base_ in enumerate(prose(100, 50 + i) for i in range(30))]
    got = check(spark.createDataFrame(docs, "doc_id long, text string"), docs, 4)
    assert 1 < sum(r.kept for r in got) < 180


def test_sketch_distance_follows_similarity():
    rng, sm = np.random.default_rng(1), Sampler(28, 4)
    for jac in (0.95, 0.9, 0.8):
        d = []
        for _ in range(40):
            n = 400
            both = int(round(2 * n * jac / (1 + jac)))
            x = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
            a, b = sm.sample(np.sort(x[:n])), sm.sample(np.sort(np.append(x[:both], x[n:2 * n - both])))
            d.append(int(np.bitwise_count((sm.sketch(a) ^ sm.sketch(b)).view(np.uint64)).sum()))
        assert abs(np.mean([1 + 512 / (4 * 112) * np.log(1 - 2 * v / 512) for v in d]) - jac) < 0.03
        assert max(d) <= greatest_distance(0.55, 112)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 300), (500, 400)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 200: 100, 300: 100, 400: 400, 500: 400}


def brute_lines(docs, min_words):
    """Cleaned texts by comparing every line with every earlier one."""
    docs = sorted(set(docs), key=lambda r: (r[0] is not None, r[0] or 0))
    seq, index, out = {}, defaultdict(list), {}
    for n, (d, t) in enumerate(docs):
        seq[n] = [(i, s) for i, s in enumerate((t or "").split("\n")) if s.split()]
        for q, (_, s) in enumerate(seq[n]):
            index[s].append((n, q))
    for n, (d, t) in enumerate(docs):
        mine, gone = seq[n], set()
        for q in range(len(mine)):
            best = 0
            for m, p in index[mine[q][1]]:
                if (m, p) >= (n, q):
                    break
                k = 0
                while q + k < len(mine) and p + k < len(seq[m]) and mine[q + k][1] == seq[m][p + k][1]:
                    k += 1
                best = max(best, k)
            if sum(len(mine[q + x][1].split()) for x in range(best)) >= min_words:
                gone |= {mine[q + x][0] for x in range(best)}
        out[d, t] = None if t is None else "\n".join(s for i, s in enumerate(t.split("\n")) if i not in gone)
    return out


@pytest.mark.parametrize("min_words", [3, 20, 50])
def test_line_runs_on_documents(spark, min_words):
    df = spark.read.parquet(f"{SF['0.001']}/documents.parquet")
    want = brute_lines([(r.doc_id, r.text) for r in df.collect()], min_words)
    got = dedup_lines(df, min_words=min_words)
    assert got.columns == [*df.columns, "n_lines", "n_deleted"]
    rows_ = got.collect()
    assert {r.doc_id: r.text for r in rows_} == {d: t for (d, _), t in want.items()}
    assert sum(r.n_deleted for r in rows_) > 0


def test_line_runs_of_small_alphabet(spark):
    """Many overlapping repeats of short lines, with blank lines between."""
    rng = np.random.default_rng(2)
    docs = [(i, "\n".join(rng.choice(["a", "b b", "c", "", "d d d"], 30))) for i in range(25)]
    want = brute_lines(docs, 6)
    got = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_words=6).collect()
    assert {(r.doc_id): r.text for r in got} == {d: t for (d, _), t in want.items()}


def test_line_edge_rows(spark):
    docs = edge_docs(spark).where("doc_id is not null and doc_id <> 16")
    got = dedup_lines(docs, min_words=50)
    want = brute_lines([(r[0], r[1]) for r in rows() if r[0] not in (None, 16)], 50)
    assert {r.doc_id: r.text for r in got.collect()} == {d: t for (d, _), t in want.items()}
    assert got.count() == docs.count() and set(docs.columns) < set(got.columns)
    assert dedup_lines(edge_docs(spark)).count() == len(rows())
    assert dedup_lines(empty_docs(spark)).count() == 0
    gone = {r.doc_id: (r.text, r.n_deleted) for r in got.collect()}
    assert gone[13] == ("other", 3) and gone[14] == ("", 3) and gone[4] == (None, 0)


def test_line_plan_has_no_python(spark):
    plan = dedup_lines(edge_docs(spark).withColumn("text", F.col("text")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan
