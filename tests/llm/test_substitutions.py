"""Substituted benchmark passages, by the plain definition."""

from itertools import combinations

import numpy as np
import pytest

from densitykit.llm import decontaminate
from tests.llm.edge import prose


def plain(h, item, min_overlap=13, percent=80):
    """Any stretch of 13 words (or the whole item) with 80 % equal words, by trying all."""
    k = min(min_overlap, len(item))
    for diag in range(k - len(item), len(h) - k + 1):
        a, b = max(0, -diag), min(len(item), len(h) - diag)
        sums = [0]
        for q in range(a, b):
            sums.append(sums[-1] + (item[q] == h[diag + q]))
        if any(100 * (sums[e] - sums[s]) >= percent * (e - s) for s in range(b - a) for e in range(s + k, b - a + 1)):
            return True
    return False


def test_every_place_of_the_substitutions():
    """Each stretch that just qualifies is found by the seeds and passes the comparison."""
    for n in range(5, 26):
        item = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        block = decontaminate.ItemBlock([7], [item], 5)
        places = list(combinations(range(n), n // 5))
        if len(places) > 400:  # the seeds by all places, the whole way by some
            bad = np.array([sum(1 << p for p in c) for c in places])
            hit = np.zeros(len(bad), bool)
            for mask in decontaminate.MASKS:
                for at in range(n - mask[-1]):
                    hit |= bad & sum(1 << at + o for o in mask) == 0
            assert hit.all(), n
            places = places[::len(places) // 100]
        for c in places:
            h = item.copy()
            h[list(c)] = 5
            found = block.overlaps(np.concatenate([[np.uint64(3)] * 4, h, [np.uint64(4)] * 4]), 13, 0.8)
            assert [f[0] for f in found] == [7] and found[0][2] >= min(13, n) and found[0][1] >= 0.8 * found[0][2], (n, c)
            h[[p for p in range(n) if p not in c][0]] = 5
            h = np.concatenate([[np.uint64(3)] * 4, h, [np.uint64(4)] * 4])
            assert bool(block.overlaps(h, 13, 0.8)) == plain(h.tolist(), item.tolist()), (n, c)


@pytest.mark.parametrize("similarity", [0.5, 0.8, 1.0])
def test_best_stretch_against_all(similarity):
    rng = np.random.default_rng(3)
    for _ in range(300):
        same = rng.random(int(rng.integers(13, 40))) < rng.choice([0.6, 0.8, 0.95])
        able = [same[s:e].sum() for s in range(len(same)) for e in range(s + 13, len(same) + 1) if same[s:e].sum() >= similarity * (e - s)]
        got = decontaminate.best_stretch(same, 13, similarity)
        assert bool(able) == bool(got)
        if got:
            m, s, e = got
            assert e - s >= 13 and m == same[s:e].sum() and m >= similarity * (e - s)


def test_substituted_items_in_documents(spark):
    rng = np.random.default_rng(11)
    items = [(i, prose(n, 700 + i)) for i, n in enumerate([5, 6, 8, 9, 10, 13, 15, 16, 20, 25, 30, 45])]
    docs = []
    for i in range(120):
        w = items[i % 12][1].split()
        k = len(w) // 5 + (i % 3 == 0)  # a third with one too many
        for p in rng.choice(len(w), k, replace=False):
            w[p] = f"sub{i}"
        docs.append((i, f"{prose(20, 800 + i)} {' '.join(w)} {prose(20, 900 + i)}"))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(i, j) for i, t in docs for j, u in items if plain(t.split(), u.split())}
    assert len(want) >= 80
    got = decontaminate.contaminated(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert all(r.similarity >= 0.8 and r.n_overlap >= min(13, r.item_words) for r in got)
    assert {r.doc_id for r in decontaminate.drop_contaminated(d, b).collect()} == {i for i, _ in docs} - {i for i, _ in want}
