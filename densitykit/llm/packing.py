"""Packing documents into token sequences by cutting-stock column generation (operator 3).

Every document is encoded as a whole and closed with an end id. A document longer than a
sequence is cut into full pieces, which fill sequences of their own, and a rest; rests and short
documents are never cut again. Their lengths, rounded up to ``grain`` tokens, form a histogram
of at most ``seq_len / grain`` classes. Column generation on that histogram
(``densitykit.llm.cutting_stock``) gives patterns and how often each is used; the executors
number the pieces of each class (hash buckets, no class in one task), and piece number r of a
class takes the r-th place that the patterns have for the class.

Text is read and encoded once and not shuffled; piece rows (some 60 bytes, or with their ids
if ``with_ids``) are. The plan on the driver has at most a few thousand rows at any scale.

Edge cases: null text is the empty document (its end id alone); null ids keep their null; equal
ids are separate documents; rows equal in everything are interchangeable; an empty table
gives an empty result; extra columns are ignored; a very long text gives many full pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from densitykit.llm import cutting_stock
from densitykit.llm.common import gapless_rank, give_back, text_bytes
from densitykit.session import materialize


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, seq_len: int, with_ids: bool) -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens and, if asked for, ids (little-endian uint32)."""
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if with_ids else "")

    def cut(batches):
        from densitykit.llm.tokens import encoder

        enc = encoder(tokenizer)
        for b in batches:
            data, off, _ = text_bytes(b.column(1))
            ids, n = enc.encode(data, off)
            ids = np.insert(ids, np.cumsum(n), np.uint32(end_id)).astype("<u4")
            n = n + 1
            k = -(-n // seq_len)
            row = np.repeat(np.arange(len(n)), k)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)) * seq_len
            length = np.minimum(seq_len, n[row] - start)
            at = (np.cumsum(n) - n)[row] + start
            raw = memoryview(ids.view(np.uint8))
            for i in range(0, len(row), 20_000):  # bounded output batches
                s = slice(i, i + 20_000)
                spans = [raw[4 * a:4 * (a + w)] for a, w in zip(at[s].tolist(), length[s].tolist())]
                cols = [b.column(0).take(pa.array(row[s])), pa.array(start[s], pa.int64()), pa.array(length[s], pa.int64()),
                        pa.array(list(map(zlib.crc32, spans)), pa.int64()), pa.array(n[row[s]], pa.int64())]
                if with_ids:
                    cols.append(pa.array(list(map(bytes, spans)), pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, ["id", "start", "length", "ids_crc32", "doc_tokens", "ids"][:len(cols)])
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", seq_len: int = 2048,
         grain: int = 4, gap: float = 0.001, with_ids: bool = False) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    The pieces of a sequence lie one after the other from offset 0 and hold at most ``seq_len``
    ids; what is left of the sequence is padding. Sequence ids run from 0 without a gap.
    """
    spark = docs.sparkSession
    cut = pieces(docs, id_col, text_col, tokenizer, end_id, seq_len, with_ids) \
        .withColumn("class", F.when(F.col("length") == seq_len, F.lit(0)).otherwise(F.ceil(F.col("length") / grain)).cast("int"))
    cut, st = materialize(cut, "pack-pieces", n=F.count(F.lit(1)))
    hist = {r["class"]: r["c"] for r in cut.groupBy("class").agg(F.count(F.lit(1)).alias("c")).collect()}
    full = hist.pop(0, 0)
    sizes = sorted(hist)
    patterns, _ = cutting_stock.plan(sizes, [hist[s] for s in sizes], seq_len // grain, gap)
    rows, taken, first = [], dict.fromkeys(sizes, 0), 0
    for uses, held in patterns:
        for size, each in held:
            lo = taken[size]
            taken[size] = lo + uses * each
            rows.append((size, lo, taken[size], each, first))
        first += uses
    rows.append((0, 0, full, 1, first))
    plan = spark.createDataFrame(rows, "class int, lo long, hi long, each long, first long")
    ranked = gapless_rank(cut, ["class"], ["id", "start", "ids_crc32", "length"], "rank", total=st["n"])
    # a few thousand rows: bounded by the length classes
    placed = ranked.join(F.broadcast(plan), "class").where("rank >= lo and rank < hi") \
        .withColumn("sequence_id", F.expr("first + (rank - lo) div each"))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "id", "start", "ids_crc32", "rank")
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    keep = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    return placed.select(F.col("id").alias(id_col), *keep)
