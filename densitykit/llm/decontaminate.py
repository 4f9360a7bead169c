"""Benchmark decontamination by spaced-seed hashing (operator 7).

A *spaced seed* is a fixed mask over token positions; its hash covers only the selected
positions, so a substituted word at an ignored position doesn't lose the hit. Each mask is laid
at every position of every benchmark item and of every document; equal hashes of test and
training side are joined. A hit names a diagonal (document position minus item position). On
each diagonal the words of document and item are then compared one by one. A pair is contaminated
if any ungapped stretch of ``min_overlap`` words or more (or the whole item, if that is shorter) has
``min_similarity`` equal words; the overlap is the best-scoring stretch of at least that many words
(at 80 %: match +1, substitution -4). An inserted or deleted word only splits a stretch in two.

At the default 13 words and 80 % the seeds lose nothing: such a stretch has four equal words on end, or is
``===x===x===x===``, and two masks find both; an item of five words with one changed needs two more.
(A stretch of 26 words or more has a half that qualifies by itself, so the shorter ones prove it.) With a lower
``min_similarity`` pairs without such a seed are missed.

Words: A-Z is lowered and every ASCII byte that is no letter or digit separates. In scripts written without spaces
(Chinese, Japanese, Thai, Lao, Burmese, Khmer) each character is a word.

Scale: the documents are scanned once for each block of the benchmark and nothing of them is
shuffled. A block holds at most ``block_words`` words (its hash tables, about 200 bytes a word,
are what is broadcast); a larger benchmark takes more passes, one for each block.

Edge cases: null or empty text on either side matches nothing; items shorter than a mask are found by a run
of all their words, those of fewer than ``min_words`` words (1 by default) left out; a null item id keeps its null; an item listed twice under two ids gives a
row for each; a null doc_id keeps its null; repeated documents give repeated rows; empty
tables give an empty result; extra columns are ignored; long texts are compared as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densitykit.llm.common import LOWER, NOT_WORD, U, lean, mix, row_blocks, span_hashes, text_bytes, words

#: Selected positions of the spaced seeds for all items, and those that only items of five words need.
MASKS = ((0, 1, 2, 3), (0, 1, 3, 4))
MASKS_5 = ((0, 1, 2, 4), (0, 2, 3, 4))
SPAN = 4
#: Words of hit diagonals compared at once.
COMPARE = 1 << 20


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every loose word, and the index of each row's first word (one entry more)."""
    d = LOWER[data]
    s, e, first = words(d, off, NOT_WORD)
    lead = d >= 0xE0
    if lead.any():
        after = np.append(d[1:], np.uint8(0))
        lead = ((d >= 0xE3) & (d <= 0xE9)) | ((d == 0xE0) & (after >= 0xB8) & (after <= 0xBB)) | ((d == 0xE1) & (after >= 0x80) & (after <= 0x9F))
        at = np.flatnonzero(lead)
        cuts = np.unique(np.concatenate([at, at + 3]))
        w = np.searchsorted(s, cuts, side="right") - 1
        cuts = cuts[(w >= 0) & (cuts > s[w]) & (cuts < e[w])]
        s, e = np.sort(np.concatenate([s, cuts])), np.sort(np.concatenate([e, cuts]))
        first = np.searchsorted(s, off)
    return span_hashes(d, s, e), first


def seeds(h: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Seed hash at every position where the mask fits into ``h``."""
    n = len(h) - mask[-1]
    if n <= 0:
        return h[:0]
    out = np.full(n, len(mask) * 1000 + mask[-1], np.uint64)
    for o in mask:
        out = (out ^ h[o:o + n]) * U(0x9FB21C651E98DF25)
        out ^= out >> U(29)
    return mix(out)


class ItemBlock:
    """Words and seed tables of some benchmark items."""

    def __init__(self, ids: list, hashes: list[np.ndarray], min_words: int):
        keep = [i for i, h in enumerate(hashes) if len(h) >= min_words]
        self.ids = [ids[i] for i in keep]
        self.length = np.array([len(hashes[i]) for i in keep], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.h = np.concatenate([hashes[i] for i in keep]) if keep else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(keep)), self.length)
        place = np.arange(len(self.h)) - self.first[item] if keep else item
        runs = sorted({int(x) for x in self.length if x < SPAN})
        self.tables = []
        for mask, only in [*((m, 0) for m in MASKS), *((m, 5) for m in MASKS_5), *((tuple(range(n)), n) for n in runs)]:
            x = seeds(self.h, mask)
            fits = place[:len(x)] + mask[-1] < self.length[item[:len(x)]]
            if only:
                fits &= self.length[item[:len(x)]] == only
            at = np.flatnonzero(fits)
            if not len(at):
                continue
            order = at[np.argsort(x[at], kind="stable")]
            bits = int(np.clip(np.ceil(np.log2(len(order) + 1)) + 6, 10, 26))
            there = np.zeros(1 << bits, bool)
            there[(x[order] >> U(64 - bits)).astype(np.int64)] = True
            self.tables.append((mask, x[order], item[order], place[order], there, U(64 - bits)))

    def overlaps(self, h: np.ndarray, min_overlap: int, min_similarity: float) -> list[tuple]:
        """Best overlap of one document (its word hashes) with each item that it overlaps."""
        found = []
        for mask, keys, item, place, there, shift in self.tables:
            x = seeds(h, mask)
            at = np.flatnonzero(there[(x >> shift).astype(np.int64)])
            if len(at):
                lo, hi = np.searchsorted(keys, x[at]), np.searchsorted(keys, x[at], side="right")
                n = hi - lo
                if n.any():
                    k = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    found.append((item[k] << 32) + (np.repeat(at, n) - place[k] + (1 << 31)))
        if not found:
            return []
        hits = np.unique(np.concatenate(found))
        best: dict[int, tuple] = {}
        for i, diag in self.likely(h, hits >> 32, (hits & 0xFFFFFFFF) - (1 << 31), min_overlap, min_similarity):
            a, b = max(0, -diag), min(int(self.length[i]), len(h) - diag)
            same = self.h[self.first[i] + a:self.first[i] + b] == h[diag + a:diag + b]
            v = best_stretch(same, min(min_overlap, int(self.length[i])), min_similarity)
            if v and v[0] > best.get(i, (0,))[0]:
                m, s, e = v
                best[i] = (m, e - s, diag + a + s, a + s)
        return [(self.ids[i], *v, int(self.length[i])) for i, v in best.items()]

    def likely(self, h: np.ndarray, item: np.ndarray, diag: np.ndarray, min_overlap: int, min_similarity: float) -> Iterator[tuple[int, int]]:
        """The hit diagonals long enough for an overlap and with enough equal words in all."""
        a, b = np.maximum(0, -diag), np.minimum(self.length[item], len(h) - diag)
        least = np.minimum(min_overlap, self.length[item])
        ok = b - a >= least
        item, diag, a, size, least = item[ok], diag[ok], a[ok], (b - a)[ok], least[ok]
        end = np.cumsum(size)
        i = 0
        while i < len(item):
            j = max(i + 1, int(np.searchsorted(end, end[i] - size[i] + COMPARE, side="right")))
            n, first = size[i:j], end[i:j] - size[i:j] - (end[i] - size[i])
            at = np.arange(int(n.sum())) + np.repeat(a[i:j] - first, n)
            same = self.h[at + np.repeat(self.first[item[i:j]], n)] == h[at + np.repeat(diag[i:j], n)]
            enough = np.add.reduceat(same, first, dtype=np.int64) >= min_similarity * least[i:j] - 1e-9
            yield from zip(item[i:j][enough].tolist(), diag[i:j][enough].tolist())
            i = j


def best_stretch(same: np.ndarray, least: int, min_similarity: float) -> tuple[int, int, int] | None:
    """Equal words, start and end of the best-scoring stretch of ``least`` words or more; None if no such
    stretch has ``min_similarity`` equal words."""
    s = Fraction(min_similarity).limit_denominator(10_000)
    p, q = s.numerator, s.denominator
    gain, loss = (q - p, p) if p < q else (1, len(same) + 1)  # a sum of 0 or more: similar enough
    run = np.append(0, np.cumsum(np.where(same, gain, -loss)))
    score = run[least:] - np.minimum.accumulate(run[:len(run) - least])
    e = int(score.argmax())
    if score[e] < 0:
        return None
    start, end = int(run[:e + 1].argmin()), e + least
    return int(same[start:end].sum()), start, end


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int, min_words: int) -> Iterator[ItemBlock]:
    """The benchmark's items in blocks of at most ``block_words`` words, streamed one after the other."""
    ids, hashes, n = [], [], 0
    for row in benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator():
        raw = np.frombuffer((row[1] or "").encode(), np.uint8)
        h, _ = word_hashes(raw, np.array([0, len(raw)]))
        if ids and n + len(h) > block_words:
            yield ItemBlock(ids, hashes, min_words)
            ids, hashes, n = [], [], 0
        ids.append(row[0])
        hashes.append(h)
        n += len(h)
    yield ItemBlock(ids, hashes, min_words)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id: str = "item_id", item_text: str = "text", min_overlap: int = 13, min_similarity: float = 0.8,
                 min_words: int = 1, block_words: int = 1_000_000) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains, with the best overlap:
    id_col, item_id, n_match, n_overlap, doc_word, item_word (where it starts), item_words,
    similarity (equal words of the overlap)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    schema = f"{id_col} long, item_id long, n_match long, n_overlap long, doc_word long, item_word long, item_words long, similarity double"
    out = None
    for block in item_blocks(benchmark, item_id, item_text, block_words, min_words):
        shared = spark.sparkContext.broadcast(block)

        def scan(batches, shared=shared):
            block = shared.value
            for b in batches:
                data, off, _ = text_bytes(b.column(1))
                got = []
                for i, j in row_blocks(off):
                    h, first = word_hashes(data[off[i]:off[j]], off[i:j + 1] - off[i])
                    for r in block_rows(block, h, first):
                        got += [(i + r, *x) for x in block.overlaps(h[first[r]:first[r + 1]], min_overlap, min_similarity)]
                if got:
                    rows_, item, m, n, dw, iw, size = (list(x) for x in zip(*got))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(rows_)), *(pa.array(x, pa.int64()) for x in (item, m, n, dw, iw, size)),
                         pa.array([x / y for x, y in zip(m, n)])],
                        [id_col, "item_id", "n_match", "n_overlap", "doc_word", "item_word", "item_words", "similarity"])

        part = rows.mapInArrow(lean(scan), schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
                      item_text: str = "text", min_overlap: int = 13, min_similarity: float = 0.8, min_words: int = 1,
                      block_words: int = 1_000_000) -> DataFrame:
    """The rows of ``docs``, all columns, that ``contaminated`` would not list. One filtering scan a block."""
    spark, out = docs.sparkSession, docs
    at = docs.columns.index(text_col)
    for block in item_blocks(benchmark, item_id, item_text, block_words, min_words):
        shared = spark.sparkContext.broadcast(block)

        def keep(batches, shared=shared):
            block = shared.value
            for b in batches:
                data, off, _ = text_bytes(b.column(at))
                ok = np.ones(b.num_rows, bool)
                for i, j in row_blocks(off):
                    h, first = word_hashes(data[off[i]:off[j]], off[i:j + 1] - off[i])
                    for r in block_rows(block, h, first):
                        ok[i + r] = not block.overlaps(h[first[r]:first[r + 1]], min_overlap, min_similarity)
                yield b.filter(pa.array(ok))

        out = out.mapInArrow(lean(keep), docs.schema)
    return out


def block_rows(block: ItemBlock, h: np.ndarray, first: np.ndarray) -> list[int]:
    """Rows of a text block that hold at least one seed of the items (a cheap test of all rows at once)."""
    some = []
    for mask, keys, _, _, there, shift in block.tables:
        x = seeds(h, mask)
        at = np.flatnonzero(there[(x >> shift).astype(np.int64)])
        if len(at) and len(keys):
            p = np.searchsorted(keys, x[at])
            some.append(at[keys[np.minimum(p, len(keys) - 1)] == x[at]])
    at = np.concatenate(some) if some else np.zeros(0, np.int64)
    return np.unique(np.searchsorted(first, at, side="right") - 1).tolist()
