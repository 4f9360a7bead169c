"""Shared helpers of the corpus operators: numpy views of Arrow text, word hashes, ranks.

Text is handled as the UTF-8 bytes of a whole Arrow batch, so there is no Python object per
word. A 64-bit word hash is ``sum T[byte] * P^i mod 2^64`` over the word's bytes, finished
with a mixing step; the sum over any span comes from one running total, which makes hashing
all words of a block a handful of vector operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

U = np.uint64
#: Bytes of text handled at once inside a task; a longer document is handled in pieces.
BLOCK = 1 << 21
_P = U(0x9E3779B97F4A7C15)
_T = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)

#: Byte classes. White space of the near-duplicate contract: 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators of loose words: every ASCII byte that is no letter or digit.
NOT_WORD = np.zeros(256, bool)
NOT_WORD[:128] = [not chr(c).isalnum() for c in range(128)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of the data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width, the knob that a user sizes to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit values (a bijection)."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n + 1:
        n = max(n, BLOCK + BLOCK // 4)
        a = np.full(n + 1, _P, np.uint64)
        a[0] = 1
        b = np.full(n + 1, U(pow(int(_P), -1, 2**64)), np.uint64)
        b[0] = 1
        _pow, _inv = np.multiply.accumulate(a), np.multiply.accumulate(b)
    return _pow, _inv


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans ``[starts, ends)``, which ascend and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + BLOCK, side="right")))
        hi = int(ends[j - 1])
        p, q = _powers(hi - lo)
        c = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_T[data[lo:hi]] * p[:hi - lo], out=c[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (c[e] - c[s]) * q[s]
        i = j
    return mix(out ^ (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets (one more than rows) and null mask of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    null = np.asarray(col.is_null())
    if null.any():
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, dat = col.buffers()
    o = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(dat, np.uint8) if dat is not None else np.zeros(0, np.uint8)
    return d[o[0]:o[-1]] if len(o) else d, o - (o[0] if len(o) else 0), null


def row_blocks(off: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text (a longer row comes alone)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, off: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of non-separator bytes, never across rows, and the
    index of each row's first word (one entry more than rows)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    w = ~sep[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first = w.copy()
    first[1:] &= ~w[:-1] | edge[1:n]
    last = w.copy()
    last[:-1] &= ~w[1:] | edge[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, off)


#: What this worker process keeps between tasks (functions that drop it).
CACHES: list = []


def lean(run):
    """``run`` (batches to batches) for a worker that may have served other operators: what those keep is dropped first,
    and memory freed here goes back to the system at the end, as the process lives on beside the JVM."""
    def task(batches):
        drop_caches()
        try:
            yield from run(batches)
        finally:
            give_back()
    return task


def drop_caches() -> None:
    for drop in CACHES:
        drop()


def give_back() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def bounded_sample(df: DataFrame, key: str, text: str, rows: int) -> DataFrame:
    """At most ``rows`` rows of ``df``, those of smallest key hash (then text hash): one for each pair of key and
    text, with the least value of every other column. Null keys count as a key."""
    th = F.xxhash64(text)
    ids = df.select(F.col(key).alias("_k"), th.alias("_h")).distinct().orderBy(F.xxhash64("_k"), "_k", "_h").limit(rows)
    mine = df.join(F.broadcast(ids), F.col(key).eqNullSafe(F.col("_k")) & (th == F.col("_h")))  # bounded by rows
    rest = [F.min(c).alias(c) for c in df.columns if c not in (key, text)]
    return mine.groupBy("_k", "_h").agg(F.first(text).alias(text), *rest).withColumnRenamed("_k", key).drop("_h").select(df.columns)


def gapless_rank(df: DataFrame, group: list[str], order: list[str], name: str, total: int | None = None,
                 rows_per_bucket: int = 20_000) -> DataFrame:
    """Number the rows of each group 0, 1, .. without bringing a group into one task.

    Rows fall into hash buckets of about ``rows_per_bucket`` rows (fewer in small tables, where one group
    would fill one task), the bucket counts give each bucket its offset, and a row's number is
    the offset plus its place inside the bucket.
    ``order`` should identify a row (rows equal in it are interchangeable).
    """
    n = df.count() if total is None else total
    b = max(1, n // rows_per_bucket, min(200, n // 500))
    keyed = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(b)))
    counts = keyed.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*group, "_b", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_o"))
    inner = Window.partitionBy(*group, "_b").orderBy(*order)
    return keyed.withColumn("_r", F.row_number().over(inner)) \
        .join(offs, [*group, "_b"]) \
        .withColumn(name, (F.col("_o") + F.col("_r") - 1).cast("long")).drop("_b", "_r", "_o")


#: Sampled keys a range, from which the range ends are taken.
SAMPLED_KEYS = 200


def range_ends(keys: np.ndarray, null: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of at most ``parts`` even ranges in the order (nulls first, key, hash), from sampled keys: three arrays of
    null flag (0 for null), key and hash. A key with more rows than a range holds is cut at even places of the
    hash; other ranges end with a whole key."""
    order = np.lexsort((keys, ~null))
    flag, k = (~null[order]).astype(np.int64), np.where(null[order], 0, keys[order])
    n, ends = len(k), []
    run = np.flatnonzero(np.append(True, (flag[1:] != flag[:-1]) | (k[1:] != k[:-1]))) if n else np.zeros(0, np.int64)
    for i in range(1, parts if n else 0):
        p = i * n // parts
        r = int(np.searchsorted(run, p, side="right")) - 1
        a, b = int(run[r]), int(run[r + 1]) if r + 1 < len(run) else n
        cut = int(-(1 << 63) + (p - a) * (1 << 64) // (b - a)) if (b - a) * parts > n else (1 << 63) - 1
        ends.append((int(flag[p]), int(k[p]), cut))
    got = np.array(sorted(set(ends)), np.int64).reshape(-1, 3)
    return got[:, 0], got[:, 1], got[:, 2]


def range_of(ends: tuple[np.ndarray, np.ndarray, np.ndarray], keys: np.ndarray, null: np.ndarray, hashes: np.ndarray | None) -> np.ndarray:
    """Number of the range of each row: how many ends lie before it."""
    flag, ek, eh = ends
    nulls = int(np.searchsorted(flag, 1))  # ends among the null keys come first
    lo = np.where(null, 0, nulls + np.searchsorted(ek[nulls:], keys, side="left"))
    hi = np.where(null, nulls, nulls + np.searchsorted(ek[nulls:], keys, side="right"))
    out = lo.copy()
    if hashes is None:  # every range ends with a whole key
        return out
    for a in np.unique(lo[hi > lo]):
        rows = np.flatnonzero((lo == a) & (hi > lo))
        out[rows] = a + np.searchsorted(eh[a:hi[rows[0]]], hashes[rows], side="left")
    return out


def by_key_ranges(df: DataFrame, key: str, parts: int, tie) -> DataFrame:
    """Add ``_part``: the number of the range of (key, ``tie``) that holds the row, null keys first.

    ``tie`` is an evenly spread 64-bit hash Column; it divides a key (or the null key) that holds more than a range's
    share of the rows over several ranges and isn't read otherwise. Rows equal in both share a range. The ends come from a
    sample of the key column alone, about ``SAMPLED_KEYS`` keys a range on the driver, drawn once, so every pass over the
    rows gives the same ranges.
    """
    if parts < 2:
        return df.withColumn("_part", F.lit(0))
    k = df.select(F.col(key).cast("long").alias("k"))
    share = SAMPLED_KEYS * parts / max(1, k.count())
    got = (k if share >= 1 else k.sample(False, share, 17)).toArrow()["k"].combine_chunks()
    ends = range_ends(np.asarray(got.fill_null(0)).astype(np.int64), np.asarray(got.is_null()), parts)
    cut = bool((ends[2] < (1 << 63) - 1).any())

    @F.pandas_udf("int")
    def part(k, null, h):
        import pandas as pd

        return pd.Series(range_of(ends, k.to_numpy(np.int64), null.to_numpy(bool), h.to_numpy(np.int64) if cut else None).astype(np.int32))

    place = part(F.coalesce(F.col(key).cast("long"), F.lit(0)), F.col(key).isNull(), tie if cut else F.lit(0).cast("long"))
    return df.withColumn("_part", place if len(ends[0]) else F.lit(0))
