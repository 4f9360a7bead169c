"""Periodic runs of words in documents (operator 13).

A run is a stretch of consecutive words with smallest period q, at least ``max(min_length, min_exponent * q)`` words
long, that neither neighbour extends. ``suffix_tree.repetitions`` finds them: Ukkonen trees of the words and of their
reversal, constant-time longest common extensions, Lyndon roots extended to both sides.

The trees are built over the stretches of a document that can hold a run. In a run of four periods or more, six words
long, each five words in a row come again inside the run (the place q before or q after lies in it too), so where five
words occur once in a stretch, no run passes: the document is cut there, and the pieces again until nothing changes.
Every run lies whole in one piece. Word hashes decide only about cuts (equal hashes cut less); runs compare words.

Edge cases: null text has no words; words are the runs of bytes other than 0x20 and 0x09-0x0D; text of any length is
taken whole; null and repeated keys, repeated rows and extra columns are carried or ignored as any other row; an empty
table gives no rows. Memory: one batch of texts and the two trees of one piece (some 500 bytes a word of it).
Scale: one scan, no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densitykit.llm.common import SPACE, U, mix, row_blocks, span_hashes, text_bytes, words
from densitykit.session import ship_package

#: Words in a row that a run holds twice, and the least exponent and length for which that is so.
GRAM, LEAST_EXPONENT, LEAST_LENGTH = 5, 4, 6


def pieces(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches that can hold a run, for word hashes ``h`` of documents that begin at ``first``."""
    n = len(h) - GRAM + 1
    if n < 1:
        z = np.zeros(0, np.int64)
        return z, z
    gram = np.zeros(n, np.uint64)
    for k in range(GRAM):
        gram = mix(gram + h[k:k + n])
    doc = np.searchsorted(first, np.arange(len(h)), side="right")
    at = np.flatnonzero(doc[:n] == doc[GRAM - 1:])
    piece = doc[at]
    while len(at):
        key = mix(gram[at] + piece.astype(np.uint64) * U(0x9E3779B97F4A7C15))
        sure = np.sort(key)
        twice = np.unique(sure[1:][sure[1:] == sure[:-1]])
        if not len(twice):
            at = at[:0]
            break
        again = twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key
        before = len(at), (piece[1:] != piece[:-1]).sum()
        at, piece = at[again], piece[again]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (np.diff(at) != 1) | (piece[1:] != piece[:-1])
        piece = np.cumsum(fresh)
        long = np.bincount(piece)[piece] > LEAST_LENGTH - GRAM
        at, piece = at[long], piece[long]
        if (len(at), (piece[1:] != piece[:-1]).sum()) == before:
            break
    if not len(at):
        return at, at
    lead = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
    last = np.concatenate([lead[1:], [len(at)]]) - 1
    return at[lead], at[last] + GRAM


def without_repeats(tokens: list[bytes], runs: np.ndarray) -> list[bytes]:
    """Words that no run contains after its first period."""
    gone = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(gone[:-1]) == 0
    return [t for t, k in zip(tokens, keep.tolist()) if k]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_exponent: int = LEAST_EXPONENT,
                  min_length: int = LEAST_LENGTH) -> DataFrame:
    """Per row of ``docs``: key, n_words, runs (``start, length, period`` in words from 0, by start, then period) and
    ``collapsed``: the words, joined by one space, without those that some run holds after its first period.

    ``min_exponent`` is 4 or more and ``min_length`` 6 or more.
    """
    if min_exponent < LEAST_EXPONENT or min_length < LEAST_LENGTH:
        raise ValueError("a run has four periods and six words at least")
    ship_package(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def block(col, lo, hi):
        from densitykit.llm.suffix_tree import repetitions

        data, off, _ = text_bytes(col.slice(lo, hi - lo))
        s, e, first = words(data, off, SPACE)
        begins, ends = pieces(span_hashes(data, s, e), first[:-1])
        owner = np.searchsorted(first, begins, side="right") - 1
        raw, k = data.tobytes(), 0
        for i in range(hi - lo):
            tokens = raw[off[i]:off[i + 1]].split()
            found = []
            while k < len(begins) and owner[k] == i:
                b, c = int(begins[k] - first[i]), int(ends[k] - first[i])
                number: dict[bytes, int] = {}
                ids = np.array([number.setdefault(t, len(number)) for t in tokens[b:c]])
                found.append(repetitions(ids, min_exponent, min_length) + [b, 0, 0])
                k += 1
            runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
            yield len(tokens), runs, b" ".join(without_repeats(tokens, runs) if len(runs) else tokens)

    def find(batches):
        for b in batches:
            _, off, _ = text_bytes(b.column(1))
            for lo, hi in row_blocks(off):
                n, runs, left = zip(*block(b.column(1), lo, hi))
                flat = np.concatenate(runs)
                ends = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, c], pa.int64()) for c in range(3)], fields=list(one)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), lists, pa.array(left, pa.binary()).cast(pa.string())],
                                                 [key, "n_words", "runs", "collapsed"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(find, f"`{key}` {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
