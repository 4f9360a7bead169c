"""The network over whole texts next to the form that reads words."""

import numpy as np
from pyspark.sql import functions as F

from densitykit.llm import langid_windows
from densitykit.llm.langid import _NOT_LETTER, BiGRU
from tests.conftest import SF
from tests.llm.edge import edge_docs, empty_docs, rows


def test_windows_hold_every_byte_once():
    texts = ["", "é" * 300, "a" * 256, "b" * 257, "\U0001f600é x" * 90, "z"]
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    row, lo, at, stop, hi = langid_windows.windows(data, off)
    for r, b in enumerate(raw):
        mine = np.flatnonzero(row == r)
        assert b"".join(data[at[i]:stop[i]].tobytes() for i in mine) == b
        assert all(data[at[i]:stop[i]].tobytes().decode() for i in mine)
        assert all(off[r] <= lo[i] <= at[i] and stop[i] <= hi[i] <= off[r + 1] and hi[i] - lo[i] <= 256 + 2 * 32 + 3 for i in mine)


def test_sums_against_one_window_at_a_time():
    net = BiGRU.new(["a", "b"], hidden=4)
    raw = ["héllo wörld, 12 " * 40, "short", "..."]
    raw = [t.encode() for t in raw]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    got, n = langid_windows.sums(net, data, off)
    want, letters = np.zeros((3, 2)), np.zeros(3, int)
    for r, lo, at, stop, hi in zip(*langid_windows.windows(data, off)):
        p = net.forward(data[None, lo:hi], np.ones((1, hi - lo), np.float32))[0][:, 0]
        for t in range(at, stop):
            if not _NOT_LETTER[data[t]]:
                want[r] += p[t - lo]
                letters[r] += 1
    assert np.allclose(got, want, atol=1e-2) and (n == letters).all() and n[2] == 0


def test_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet(f"{SF['0.01']}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    net = langid_windows.fit(docs.where(~held), sample_rows=300, steps=80)
    got = langid_windows.predict(docs.where(held).select("doc_id", "lang", "text"), net).collect()
    assert np.mean([r.lang == r.lang_pred for r in got if r.lang]) > 0.9
    e = langid_windows.predict(edge_docs(spark).select("doc_id", "score", "text").withColumn("t", F.col("text")), net).collect()
    assert len(e) == len(rows())
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.t or "")) and 0 <= r.score <= 1 for r in e)
    assert langid_windows.predict(empty_docs(spark), net).count() == 0
    assert langid_windows.fit(empty_docs(spark)).langs == []
