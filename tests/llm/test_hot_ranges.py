"""Key ranges where a third of all rows has no key and a third has the same one."""

import zlib
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from densitykit.llm.common import by_key_ranges, range_ends, range_of
from densitykit.llm.fingerprints import edited_fingerprints
from densitykit.llm.queries import tokenizer_file
from densitykit.llm.token_files import read_documents, write_token_files

I64 = np.iinfo(np.int64)


def hot(spark, n):
    key = F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(700)).otherwise(F.col("id"))
    return spark.range(n).select(key.cast("long").alias("doc_id"), F.concat(F.lit("text of row "), F.col("id").cast("string")).alias("text"))


@pytest.mark.parametrize("n", [300, 30_000])
def test_hot_keys_are_divided_in_order(spark, n):
    parts = 12
    rows = by_key_ranges(hot(spark, n).withColumn("h", F.xxhash64("text")), "doc_id", parts, F.col("h")).select("_part", "doc_id", "h").collect()
    order = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    assert [r._part for r in order] == sorted(r._part for r in rows)
    sizes = [sum(r._part == p for r in rows) for p in range(parts)]
    assert max(sizes) <= (3 if n < 1000 else 1.6) * median(sizes)


def test_ranges_against_sorting():
    rng = np.random.default_rng(3)
    for case in range(60):
        n, parts = int(rng.integers(0, 60)), int(rng.integers(1, 9))
        keys = rng.choice([I64.min, -5, 0, 1, 2, I64.max], n).astype(np.int64)
        null, h = rng.random(n) < rng.choice([0, 0.4, 1]), rng.integers(I64.min, I64.max, n)
        ends = range_ends(keys, null, parts)
        assert len(ends[0]) < max(parts, 1)
        got = range_of(ends, np.where(null, 0, keys), null, h)
        for i in range(n):
            me = (int(not null[i]), 0 if null[i] else int(keys[i]), int(h[i]))
            assert got[i] == sum(e < me for e in zip(*(x.tolist() for x in ends))), case
        if (ends[2] == I64.max).all():
            assert (range_of(ends, np.where(null, 0, keys), null, None) == got).all()


def test_files_and_fingerprints_of_hot_keys(spark):
    docs = hot(spark, 600)
    docs = docs.unionByName(docs.where("doc_id = 700").limit(40)).unionByName(docs.where("doc_id is null").limit(40))  # repeated rows
    texts = [(r.doc_id, r.text, r.h) for r in docs.withColumn("h", F.xxhash64("text")).collect()]
    texts.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))

    files = write_token_files(docs, "doc_id", "text", tokenizer_file("byte_bpe_50k.json"), 2, files=9)
    assert max(r.n_docs for r in files.collect()) < 3 * len(texts) / 9
    from tokenizers import Tokenizer

    tok, at, want = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json")), 0, []
    for k, t, _ in texts:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in read_documents(files).orderBy("start").collect()] == want

    down = texts[::-1]
    pairs = sorted((-1 if k is None else k, len(t), t[:len(t) - len(t) // 2] + down[(i + 1) % len(down)][1][:len(t) // 2]) for i, (k, t, _) in enumerate(down))
    import hashlib

    got = edited_fingerprints(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256) for r in got) == \
        sorted((k, n, hashlib.sha256(e.encode()).hexdigest()) for k, n, e in pairs)
