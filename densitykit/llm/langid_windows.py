"""Language ID with the recurrence running over the whole text (a second form of operator 6).

``langid`` starts the network's state anew with each word, so that a worker runs it once for each distinct word. Here the
same network reads the text itself: windows of ``WINDOW`` bytes that begin at code points, each read with up to ``OVERLAP``
bytes of its neighbours on both sides, whose labels don't count, so a position's label depends on the words around it. Every letter
byte of the text is labelled in exactly one window; a document's probabilities are the means over them. The network runs
over every byte, so it costs far more than the word form (README has both forms' figures).

Training takes the same bounded sample as ``langid.fit``: backpropagation through time over the windows of its documents, with the
document's language as the target of every position.

Edge cases as in ``langid``: null text and text without a letter get ``und`` and score 0; without labelled rows every text
gets ``und``; ties go to the first language; an empty table gives an empty result; texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densitykit.llm.common import bounded_sample, lean, row_blocks, text_bytes
from densitykit.llm.langid import _NOT_LETTER, BiGRU, has_letter, train

WINDOW, OVERLAP = 256, 32


def windows(data: np.ndarray, off: np.ndarray, size: int = WINDOW, overlap: int = OVERLAP):
    """Of every window: row, first byte read, first and end byte that count, end of the bytes read. Windows begin at code
    points and together hold every byte once."""
    n = np.diff(off)
    k = np.maximum(-(-n // size), (n > 0).astype(np.int64))
    row = np.repeat(np.arange(len(n)), k)
    at = off[row] + (np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)) * size
    for _ in range(3):  # a code point has at most three further bytes
        inside = at > off[row]
        at -= inside & ((data[np.minimum(at, len(data) - 1)] & 0xC0) == 0x80)
    last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
    stop = np.where(last, off[row + 1], np.append(at[1:], 0)) if len(row) else at
    return row, np.maximum(at - overlap, off[row]), at, stop, np.minimum(stop + overlap, off[row + 1])


def rows_of(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Byte rows ``[lo, hi)``, padded with 0 to the longest."""
    at = lo[:, None] + np.arange(int((hi - lo).max()))[None, :]
    return np.where(at < hi[:, None], data[np.minimum(at, len(data) - 1)], 0)


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = 2000, steps: int = 300) -> BiGRU:
    """Learn from the labelled ``rows``."""
    pick = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).where("t is not null and l is not null")
    got = bounded_sample(pick, "id", "t", sample_rows).orderBy("id", "t").select("t", "l").toArrow()
    langs = sorted(set(got["l"].to_pylist()))
    data, off, _ = text_bytes(got["t"])
    if not langs or not len(data):
        return BiGRU.new([])
    code = np.array([langs.index(x) for x in got["l"].to_pylist()])
    row, _, at, stop, _ = windows(data, off)
    return train(rows_of(data, at, stop), stop - at, np.eye(len(langs), dtype=np.float32)[code[row]], (stop - at).astype(float), langs, steps, batch=32)


def sums(net: BiGRU, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of position probabilities of each row over its letter bytes, and their number."""
    out, positions = np.zeros((len(off) - 1, len(net.langs))), np.zeros(len(off) - 1, np.int64)
    row, lo, at, stop, hi = windows(data, off)
    order = np.argsort(hi - lo, kind="stable")
    for i in range(0, len(order) if net.langs else 0, 512):
        o = order[i:i + 512]
        x = rows_of(data, lo[o], hi[o])
        place = lo[o][:, None] + np.arange(x.shape[1])[None, :]
        p, _, _ = net.forward(x, (place < hi[o][:, None]).astype(np.float32))
        counts = (place >= at[o][:, None]) & (place < stop[o][:, None]) & ~_NOT_LETTER[x]
        np.add.at(out, row[o], np.einsum("tnl,nt->nl", p, counts.astype(np.float32)))
        np.add.at(positions, row[o], counts.sum(axis=1))
    return out, positions


def predict(docs: DataFrame, net: BiGRU, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, and lang_pred, score (mean probability of that language)."""
    langs = np.array([*net.langs, "und"], object)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", text_col)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), "lang_pred string", "score double"])

    def run(batches):
        for b in batches:
            data, off, _ = text_bytes(b.column(len(keep)))
            pred, score = [np.zeros(0, np.int64)], [np.zeros(0)]
            for i, j in row_blocks(off):
                d, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
                total, n = sums(net, d, o)
                mean = total / np.maximum(n, 1)[:, None]
                ok = has_letter(d, o) & (n > 0) & (len(net.langs) > 0)
                pred.append(np.where(ok, mean.argmax(axis=1) if net.langs else 0, len(net.langs)))
                score.append(np.where(ok, mean.max(axis=1, initial=0.0), 0.0))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(langs[np.concatenate(pred)], pa.string()),
                                              pa.array(np.clip(np.concatenate(score), 0, 1), pa.float64())], [*keep, "lang_pred", "score"])

    return docs.select(*keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(lean(run), schema)
