"""Token-ID files with byte- or bit-plane shuffled blocks (operator 2).

``write_token_files`` encodes the texts, ends every document with one end id and writes one
file per key range, in ascending key order; ``read_documents`` and ``read_ids`` read them back.

File layout (little-endian)::

    "PLANE1\\n" + mode byte          mode 'y': four byte planes, 'i': 32 bit planes
    block 0 planes | block 1 planes | ..      each plane is one zstandard frame
    index (zstandard frame of int64): per block: offset, ids, plane lengths
    document index (zstandard frame of int64): key, null flag, ids
    tail: index offset, index length, document index length, blocks, documents   (5 x int64)

A block holds ``block_ids`` ids (the last one fewer). Plane p of a byte-plane block is byte p
of every id; plane p of a bit-plane block is bit p of every id, packed. Ids of one corpus fill
the low planes; the high planes are almost constant and cost nothing after compression.

Edge cases: null text is the empty document (its end id alone); null keys come first and keep
their null; equal keys are ordered by text hash; an empty table gives an empty manifest; extra
columns are ignored; a text of any length spans as many blocks as it needs.

Scale: the text is shuffled once, by key ranges whose ends come from a sample of the key column; a key (or the null
key) with more rows than a file holds goes on over several files, by text hash. A
task holds one batch of texts, one block of ids and its file's document index. Files are written under names of their own
for each attempt and listed in a manifest that Spark writes with its own commit, so a lost or
repeated task never leaves a half file that is read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from densitykit.llm.common import by_key_ranges, partitions, text_bytes
from densitykit.session import materialize, scratch_path

MAGIC = b"PLANE1\n"
PLANES = {"byte": 4, "bit": 32}


def filesystem(uri: str):
    """File system and path of a folder name as Spark gives it (``file:/..``, ``hdfs://..``, ``s3a://..``)."""
    import re

    from pyarrow import fs

    uri = re.sub(r"^s3[an]:", "s3:", uri)
    uri = re.sub(r"^file:/+", "/", uri)
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def to_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    b = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if mode == "byte":
        return [b[:, p].tobytes() for p in range(4)]
    bits = np.unpackbits(b, axis=1, bitorder="little")
    return [np.packbits(bits[:, p], bitorder="little").tobytes() for p in range(32)]


def from_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    if mode == "byte":
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


class PlaneWriter:
    """Streams ids into one file; keeps at most one block of ids."""

    def __init__(self, out, mode: str = "byte", block_ids: int = 1 << 17, level: int = 1):
        import zstandard

        self.out, self.mode, self.block_ids = out, mode, block_ids
        self.zip = zstandard.ZstdCompressor(level=level)
        self.index: list[int] = []
        self.keys: list[np.ndarray] = []
        self.held: list[np.ndarray] = []
        self.n_held = self.blocks = 0
        self.at = out.write(MAGIC + mode[1].encode())

    def documents(self, keys: np.ndarray, null: np.ndarray, counts: np.ndarray, ids: np.ndarray):
        self.keys.append(np.stack([keys, null.astype(np.int64), counts]))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block_ids:
            self._flush(False)

    def _flush(self, last: bool):
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) - len(ids) % self.block_ids
        for i in range(0, whole, self.block_ids):
            part = ids[i:min(whole, i + self.block_ids)]
            planes = [self.zip.compress(p) for p in to_planes(part, self.mode)]
            self.index += [self.at, len(part), *map(len, planes)]
            self.at += sum(map(self.out.write, planes))
            self.blocks += 1
        self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def close(self) -> tuple[int, int, int]:
        """Documents, ids and bytes written."""
        self._flush(True)
        docs = np.concatenate(self.keys, axis=1) if self.keys else np.zeros((3, 0), np.int64)
        a = self.zip.compress(np.array(self.index, "<i8").tobytes())
        b = self.zip.compress(docs.astype("<i8").tobytes())
        tail = np.array([self.at, len(a), len(b), self.blocks, docs.shape[1]], "<i8").tobytes()
        self.out.write(a + b + tail)
        return docs.shape[1], int(docs[2].sum()), self.at + len(a) + len(b) + len(tail)


class PlaneReader:
    """One file: its indexes, any id range, or its documents one after the other."""

    def __init__(self, source):
        import zstandard

        self.source = source
        self.unzip = zstandard.ZstdDecompressor()
        size = source.size()
        head = source.read_at(len(MAGIC) + 1, 0)
        if head[:-1] != MAGIC:
            raise ValueError("not a token-plane file")
        self.mode = {b"y": "byte", b"i": "bit"}[head[-1:]]
        at, a, b, blocks, docs = np.frombuffer(source.read_at(40, size - 40), "<i8").tolist()
        both = source.read_at(a + b, at)
        self.index = np.frombuffer(self.unzip.decompress(both[:a]), "<i8").reshape(blocks, 2 + PLANES[self.mode])
        self.keys, self.null, self.counts = np.frombuffer(self.unzip.decompress(both[a:]), "<i8").reshape(3, docs)
        self.first = np.cumsum(self.index[:, 1]) - self.index[:, 1]

    def block(self, i: int) -> np.ndarray:
        at, n, *lens = self.index[i].tolist()
        raw = self.source.read_at(sum(lens), at)
        ends = np.cumsum([0, *lens])
        return from_planes([self.unzip.decompress(raw[x:y]) for x, y in zip(ends[:-1], ends[1:])], n, self.mode)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids ``[lo, hi)`` of the file; touches only the blocks that hold them."""
        i = int(np.searchsorted(self.first, lo, side="right")) - 1
        got, base = [], lo
        while base < hi:
            b = self.block(i)
            got.append(b[base - self.first[i]:hi - self.first[i]])
            base, i = int(self.first[i] + len(b)), i + 1
        return np.concatenate(got) if got else np.zeros(0, np.uint32)

    def pieces(self) -> Iterator[tuple[int, np.ndarray]]:
        """``(document number, next ids of it)`` in order; a long document comes in several pieces."""
        ends = np.cumsum(self.counts)
        d = 0
        for i in range(len(self.index)):
            b, base = self.block(i), int(self.first[i])
            at = 0
            while at < len(b):
                while d < len(ends) and ends[d] <= base + at:
                    d += 1
                stop = min(len(b), int(ends[d]) - base)
                yield d, b[at:stop]
                at = stop


def write_token_files(docs: DataFrame, key: str, text: str, tokenizer: str, end_id: int, folder: str | None = None,
                      files: int | None = None, mode: str = "byte", block_ids: int = 1 << 17) -> DataFrame:
    """Write the texts of ``docs`` as token files in ascending ``key`` order.

    Returns the manifest: part, path, n_docs, n_ids, n_bytes, start (ids in the files before).
    ``folder`` defaults to a new folder below the session's checkpoint folder, which all
    executors share; ``files`` to the shuffle width.
    """
    spark = docs.sparkSession
    folder = (folder or scratch_path(spark, "token-files")).rstrip("/")
    files = files or partitions(spark)
    rows = by_key_ranges(docs.select(F.col(key).cast("long").alias("_k"), F.col(text).alias("_t")), "_k", files, F.xxhash64("_t"))
    rows = rows.repartitionById(files, "_part").sortWithinPartitions(F.col("_k").asc_nulls_first(), F.xxhash64("_t"))
    schema = "part int, path string, n_docs long, n_ids long, n_bytes long"

    def write(batches):
        from densitykit.llm.tokens import encoder

        enc, fs, out, part = encoder(tokenizer), None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                part = b.column(2)[0].as_py()
                fs, base = filesystem(folder)
                fs.create_dir(base, recursive=True)
                path = f"{base}/part-{part:06d}-{uuid.uuid4().hex[:8]}.plane"
                stream = fs.open_output_stream(path)
                out = PlaneWriter(stream, mode, block_ids)
            data, off, _ = text_bytes(b.column(1))
            null = np.asarray(b.column(0).is_null())
            keys = np.asarray(b.column(0).fill_null(0)).astype(np.int64)
            ids, n = enc.encode(data, off)
            ids = np.insert(ids, np.cumsum(n), np.uint32(end_id))
            out.documents(keys, null, n + 1, ids)
        if out is not None:
            n_docs, n_ids, n_bytes = out.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "n_docs": [n_docs], "n_ids": [n_ids], "n_bytes": [n_bytes]})

    # one small row per file
    manifest = materialize(rows.mapInArrow(write, schema), "token-manifest")
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("folder", F.lit(folder)).withColumn("start", F.coalesce(F.sum("n_ids").over(w), F.lit(0)))


def read_documents(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: key, start (ids before it), n_tokens, ids_crc32 and, if
    asked for, its ids as an array."""
    spark = manifest.sparkSession
    schema = "key long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    listed = manifest.select("folder", "path", "start", "part").repartition(partitions(spark), "part")

    def read(batches):
        for b in batches:
            for folder, path, start in zip(*(b.column(i).to_pylist() for i in range(3))):
                fs, _ = filesystem(folder)
                with fs.open_input_file(path) as source:
                    r = PlaneReader(source)
                    crc = np.zeros(len(r.counts), np.int64)
                    ids: list = [[] for _ in range(len(r.counts) if with_ids else 0)]
                    for d, piece in r.pieces():
                        crc[d] = zlib.crc32(np.ascontiguousarray(piece).view(np.uint8), int(crc[d]))
                        if with_ids:
                            ids[d] += piece.tolist()
                first = start + np.cumsum(r.counts) - r.counts
                for i in range(0, len(crc), 10_000):
                    s = slice(i, i + 10_000)
                    cols = [pa.array(r.keys[s], pa.int64(), mask=r.null[s] != 0), pa.array(first[s], pa.int64()), pa.array(r.counts[s], pa.int64()), pa.array(crc[s], pa.int64())]
                    if with_ids:
                        cols.append(pa.array(ids[s], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(cols, ["key", "start", "n_tokens", "ids_crc32", "ids"][:len(cols)])

    return listed.mapInArrow(read, schema)


def read_ids(manifest: DataFrame, lo: int, hi: int) -> np.ndarray:
    """Ids ``[lo, hi)`` of the corpus, read through the chunk indexes (for spot checks)."""
    rows = manifest.where((F.col("start") < hi) & (F.col("start") + F.col("n_ids") > lo)).orderBy("start").collect()
    got = []
    for m in rows:
        with filesystem(m["folder"])[0].open_input_file(m["path"]) as source:
            got.append(PlaneReader(source).ids(max(lo, m["start"]) - m["start"], min(hi, m["start"] + m["n_ids"]) - m["start"]))
    return np.concatenate(got) if got else np.zeros(0, np.uint32)
