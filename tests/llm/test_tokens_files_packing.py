import zlib

import numpy as np
import pytest

from densitykit.llm import cutting_stock
from densitykit.llm.bins import RemainingTree, best_fit_decreasing, even_bins
from densitykit.llm.common import text_bytes
from densitykit.llm.packing import pack
from densitykit.llm.queries import tokenizer_file
from densitykit.llm.shards import shard
from densitykit.llm.token_files import from_planes, read_documents, read_ids, to_planes, write_token_files
from densitykit.llm.tokens import ChunkEncoder
from tests.llm.edge import edge_docs, empty_docs, rows

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


def whole(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_chunked_encoding_equals_whole(name):
    import pyarrow as pa

    odd = ["  a  b", "a  b\n  c", "\n\nx \n y ", "it 's 's don't, x.", "é è  \té.", " ", "", ".,", "é ́x", "a  b  c　 d",
           "a<|endoftext|>b. <|startoftext|>c", "\x85 a\x1c b 1 23 4.5 ,;!", "İstanbul ΣΑΣ", " \n ", "x.,y", "×. ÷, Ⅷ. 5.5", None]
    odd += [r[1] for r in rows()]
    data, off, _ = text_bytes(pa.array(odd, pa.string()))
    ids, n = ChunkEncoder(tokenizer_file(name)).encode(data, off)
    at, enc = np.append(0, np.cumsum(n)), whole(name)
    for i, x in enumerate(odd):
        assert ids[at[i]:at[i + 1]].tolist() == enc(x), (x or "")[:40]


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_planes_round_trip(mode):
    ids = np.random.default_rng(1).integers(0, 2**32, 1003, dtype=np.uint32)
    assert (from_planes(to_planes(ids, mode), len(ids), mode) == ids).all()


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_token_files(spark, mode):
    docs = edge_docs(spark)
    files = write_token_files(docs, "doc_id", "text", tokenizer_file(BYTE), 2, files=3, mode=mode, block_ids=1000)
    got = read_documents(files, with_ids=True).orderBy("start").collect()
    enc = whole(BYTE)
    want = sorted([(-1 if r[0] is None else r[0], enc(r[1]) + [2]) for r in rows()])
    assert sorted((-1 if r.key is None else r.key, list(r.ids)) for r in got) == want
    keys = [-1 if r.key is None else r.key for r in got]
    assert keys == sorted(keys)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    flat = [i for r in got for i in r.ids]
    assert read_ids(files, 5, 4321).tolist() == flat[5:4321]


def test_token_files_empty(spark):
    assert read_documents(write_token_files(empty_docs(spark), "doc_id", "text", tokenizer_file(BYTE), 2, files=2)).count() == 0


def test_tree_and_best_fit_against_plain_lists():
    rng = np.random.default_rng(3)
    tree, plain = RemainingTree(), []
    for _ in range(2000):
        if plain and rng.random() < 0.45:
            k = plain.pop(int(rng.integers(len(plain))))
            tree.delete(k)
        else:
            k = (int(rng.integers(50)), len(plain) + int(rng.integers(10**9)))
            plain.append(k)
            tree.insert(k)
        q = (int(rng.integers(55)), -1)
        assert tree.ceiling(q) == min((x for x in plain if x >= q), default=None)
    sizes = rng.integers(1, 60, 300).tolist()
    placed, bins = best_fit_decreasing([(s, 1) for s in sizes], 100)
    room = []
    for s in sorted(sizes, reverse=True):  # item by item
        fit = [i for i, r in enumerate(room) if r >= s]
        i = min(fit, key=lambda i: (room[i], i)) if fit else len(room)
        if not fit:
            room.append(100)
        room[i] -= s
    assert bins == len(room)
    load = [0] * bins
    for s, b, k in placed:
        load[b] += s * k
    assert sorted(load) == sorted(100 - r for r in room)
    runs = [(s, sizes.count(s)) for s in set(sizes)]
    even, cap = even_bins(runs, 4)
    assert cap <= -(-sum(sizes) // 4) + 2 and sum(k for _, _, k in even) == 300


def test_shards(spark):
    docs = edge_docs(spark)
    got = shard(docs, n_shards=3).collect()
    size = lambda x: len((x or "").encode()) + 1
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in got) == \
        sorted((-1 if r[0] is None else r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows())
    home, slots = {}, {}
    for r in got:
        home.setdefault(r.group, set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(len(s) == 1 for s in home.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard(empty_docs(spark), n_shards=3).count() == 0


def test_hot_group_is_cut_and_shards_stay_even(spark):
    rows_ = [(i, "hot " * 10) for i in range(600)] + [(1000 + i, f"text {i} " * (i % 7 + 1)) for i in range(300)]
    got = shard(spark.createDataFrame(rows_, "doc_id long, text string"), n_shards=8).collect()
    load = [0] * 8
    for r in got:
        load[r.shard] += r.size
    assert len(got) == 900 and max(load) - min(load) <= 0.03 * sum(load) / 8


def test_fixed_capacity_uses_few_shards(spark):
    rows_ = [(i, "x" * (i % 50 + 10)) for i in range(400)]
    got = shard(spark.createDataFrame(rows_, "doc_id long, text string"), n_shards=None, capacity=500).collect()
    load = {}
    for r in got:
        load[r.shard] = load.get(r.shard, 0) + r.size
    assert max(load.values()) <= 500 and len(load) <= -(-sum(load.values()) // 500) + 1


def test_column_generation_reaches_the_known_optimum():
    # 81 + 68 + 68 (24 times), 81 + 81 (10) and 70 + 70 + 70 (1) is the best there is
    p, bound = cutting_stock.plan([81, 70, 68], [44, 3, 48], 218, gap=0)
    used = sum(k for k, _ in p)
    assert used == 35 and 34.9 < bound <= 35 + 1e-6
    got = {}
    for k, held in p:
        assert sum(s * n for s, n in held) <= 218
        for s, n in held:
            got[s] = got.get(s, 0) + k * n
    assert got == {81: 44, 70: 3, 68: 48}


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(20):
        ln = np.unique(rng.integers(1, 12, 4))
        w = rng.random(len(ln))
        best = [0.0] * 31
        for c in range(1, 31):
            best[c] = max([best[c - 1]] + [best[c - x] + y for x, y in zip(ln, w) if x <= c])
        v, k = cutting_stock.knapsack(w, ln, 30)
        assert abs(v - best[30]) < 1e-9 and (k * ln).sum() <= 30 and abs((k * w).sum() - v) < 1e-9


def test_packing(spark):
    got = pack(edge_docs(spark), tokenizer_file(WORD), 1, seq_len=256, with_ids=True).collect()
    enc = whole(WORD)
    want = sorted([(-1 if r[0] is None else r[0], enc(r[1]) + [1]) for r in rows()])
    docs, seqs = {}, {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length <= 256 and zlib.crc32(r.ids) == r.ids_crc32
        docs.setdefault((-1 if r.doc_id is None else r.doc_id, r.doc_tokens), []).append((r.start, ids.tolist()))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for (i, n), parts in docs.items():
        same = [w for k, w in want if k == i and len(w) == n]
        assert sorted(x for _, p in parts for x in p) == sorted(x for w in same for x in w)
    assert sum(r.length for r in got) == sum(len(w) for _, w in want)
    assert sorted(seqs) == list(range(len(seqs)))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 256
    assert pack(empty_docs(spark), tokenizer_file(WORD), 1).count() == 0
