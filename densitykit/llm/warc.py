"""Deterministic sharded WARC archives (operator 12).

``write_warc`` sorts the rows by key and payload digest over ranges, writes one gzip member a record, rolls a file when
its compressed size reaches ``file_bytes`` and commits through temporary names and a manifest; ``read_warc`` reads the
archives back and checks every length and digest. The same rows and settings give the same files, byte for byte.

A record is a ``response`` (HTTP head with a new Content-Length, then the payload) or, if an earlier record has the
same payload of at least ``min_bytes``, a ``revisit`` of it: the HTTP head alone, profile identical-payload-digest, with
``WARC-Refers-To``. Of equal payloads the one with the smallest key is the response. Ids of records are made from key,
digest and the number of the copy; dates are one given constant.

Edge cases: a null payload is empty; null keys come last and are referred to as null; rows equal in key and payload are
copies of each other, one of them (any, they are alike but for the URL, the smallest of which comes first) the response;
a null URL has no target field, control characters, blanks and other bytes beyond ASCII in one are percent-encoded; an
empty table gives a manifest without files; extra columns are ignored; one record is in memory at a time.

Scale: one scan hashes the payloads to a table of distinct (key, digest), from which everything is planned; payloads are
shuffled once, to key-and-digest ranges whose ends come from a sample of that table by hash (the same in every run),
so neither a hot key nor a hot payload lands in one task. Lookups of hot payloads (over a thousandth of the rows, so at most
a thousand) are broadcast, all others shuffled by digest. Rows equal in key and payload, where they
are a thousandth of all, are collapsed to one row and their number on the map side.

Commit: a task writes below ``_temporary`` under names of its attempt and reports them; Spark's own commit of that report
keeps one attempt of each task; a second job renames what it lists (again and again with the same outcome), and the
manifest, written last, makes the archive readable. What lost attempts left is deleted with ``_temporary``.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densitykit.llm.common import partitions
from densitykit.llm.token_files import filesystem
from densitykit.session import materialize, scratch_path, ship_package

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Sampled (key, digest) pairs a range.
SAMPLES = 64
#: Payloads or equal rows above this share of the rows (and this number) count as hot.
HOT_SHARE, HOT_ROWS = 1000, 10_000

MANIFEST = "part int, roll int, name string, n_records long, n_bytes long, sha256 string"


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme that Spark takes for it (its default file system, if none is given)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


# ---- records

def head(first: str, fields: list[tuple[str, object]]) -> bytes:
    return (first + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n").encode()


def record_id(key, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{key}|{digest}|{copy}'.encode()).digest()[:16], version=5)}>"


def target(url: str | None) -> str | None:
    if url is None:
        return None
    return "".join(chr(c) if 32 < c < 127 else f"%{c:02X}" for c in url.encode())


def record(kind: str, rid: str, date: str, block: bytes, fields: list[tuple[str, object]]) -> bytes:
    """One record as a gzip member of its own (no time in the header, so equal records are equal bytes)."""
    top = head("WARC/1.1", [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", date), *fields,
                            ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", len(block))])
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(top) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def page_record(key, url, payload: bytes, digest: str, copy: int, date: str, refers=None) -> bytes:
    """``refers``: None for a response, else a one-element list with the key of the response."""
    http = head("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))])
    fields = [("WARC-Target-URI", target(url)), ("X-Key", key), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers[0], digest, 0)), ("X-Refers-To-Key", refers[0])]
    fields.append(("Content-Type", "application/http;msgtype=response"))
    return record("response" if refers is None else "revisit", record_id(key, digest, copy), date,
                  http if refers is not None else http + payload, fields)


class RollingWriter:
    """Files of one range, one after the other."""

    def __init__(self, folder: str, prefix: str, part: int, file_bytes: int, date: str):
        self.fs, self.base = filesystem(folder)
        self.prefix, self.part, self.limit, self.date = prefix, part, file_bytes, date
        self.attempt = uuid.uuid4().hex
        self.out, self.roll, self.done = None, 0, []

    def name(self) -> str:
        return f"{self.prefix}-{self.part:06d}-{self.roll:05d}.warc.gz"

    def write(self, raw: bytes):
        if self.out is None:
            self.fs.create_dir(f"{self.base}/_temporary", recursive=True)
            self.temp = f"{self.name()}.{self.attempt}"
            self.out = self.fs.open_output_stream(f"{self.base}/_temporary/{self.temp}", compression=None)
            self.n, self.size, self.sha = 0, 0, hashlib.sha256()
            info = f"software: densitykit\r\nformat: WARC File Format 1.1\r\nisPartOf: {self.prefix}\r\n".encode()
            self._put(record("warcinfo", record_id(self.name(), "", 0), self.date, info,
                             [("WARC-Filename", self.name()), ("Content-Type", "application/warc-fields")]))
        self._put(raw)
        self.n += 1
        if self.size >= self.limit:
            self.close()

    def _put(self, raw: bytes):
        self.out.write(raw)
        self.sha.update(raw)
        self.size += len(raw)

    def close(self):
        if self.out is not None:
            self.out.close()
            self.done.append((self.part, self.roll, self.name(), self.n, self.size, self.sha.hexdigest(), self.temp))
            self.out, self.roll = None, self.roll + 1


# ---- plan

def _ranges(distinct: DataFrame, parts: int, total: int):
    """A pandas UDF (key, digest) -> range, with ends from the (key, digest) pairs of lowest hash."""
    share = min(1.0, SAMPLES * parts / max(1, total))
    picked = distinct.where(F.xxhash64("digest", "key") <= F.lit(int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else (1 << 63) - 1))
    top = np.iinfo(np.int64).max
    got = picked.select(F.coalesce("key", F.lit(int(top))).alias("key"), F.expr("conv(substr(digest, 1, 8), 16, 10)").cast("long").alias("d")).toArrow()
    k, d = (np.asarray(got.column(i).combine_chunks()).astype(np.int64) if len(got) else np.zeros(0, np.int64) for i in range(2))
    order = np.lexsort((d, k))
    at = order[(np.arange(1, parts) * len(order)) // parts] if len(order) else order
    ck, cd = k[at], d[at]

    @F.pandas_udf("int")
    def part(key, digest):
        import pandas as pd

        x = key.fillna(top).astype(np.int64).to_numpy() if key.isna().any() else key.to_numpy(np.int64)
        lo, hi = np.searchsorted(ck, x, "left"), np.searchsorted(ck, x, "right")
        for v in np.unique(x[hi > lo]):  # keys at which a range ends: the digest decides
            rows = np.flatnonzero(x == v)
            of = digest.iloc[rows].str.slice(0, 8).map(lambda s: int(s, 16)).to_numpy(np.int64)
            lo[rows] += np.searchsorted(cd[lo[rows[0]]:hi[rows[0]]], of, "left")
        return pd.Series(lo.astype(np.int32))

    return part


def _first_of_each(distinct: DataFrame, total: int, min_bytes: int) -> DataFrame:
    """(key, digest, refers) for every key whose payload other rows have too."""
    groups = materialize(distinct.where(F.col("bytes") >= min_bytes).groupBy("digest")
                         .agg(F.min("key").alias("refers"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("keys")).where("rows > 1"), "warc-groups")
    hot = F.col("rows") > max(HOT_ROWS, total // HOT_SHARE)
    few = F.broadcast(groups.where(hot).select("digest", "refers"))  # at most HOT_SHARE rows
    rest = groups.where(~hot).select("digest", "refers")
    pairs = distinct.where(F.col("bytes") >= min_bytes).select("key", "digest")
    a = pairs.join(few, "digest")
    b = pairs.join(few.select("digest"), "digest", "left_anti").join(rest.hint("merge"), "digest")
    return a.unionByName(b)


def write_warc(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", folder: str | None = None,
               shards: int | None = None, file_bytes: int = 64 << 20, min_bytes: int = 100, prefix: str = "pages",
               date: str = "2000-01-01T00:00:00Z") -> str:
    """Write ``pages`` (integer keys) as WARC files into ``folder`` (a new one below the session's checkpoint folder by
    default) and return the folder. ``shards`` ranges (default: the shuffle width) are written side by side."""
    spark = pages.sparkSession
    ship_package(spark)
    folder = qualified(spark, folder or scratch_path(spark, "warc"))
    fs, base = filesystem(folder)
    if fs.get_file_info(f"{base}/_manifest").type.name != "NotFound":
        raise FileExistsError(f"{folder} holds an archive already")
    shards = shards or partitions(spark)
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), body.alias("body")) \
        .withColumn("digest", F.sha2("body", 256))
    distinct, seen = materialize(rows.groupBy("key", "digest").agg(F.max(F.octet_length("body")).cast("long").alias("bytes"), F.count(F.lit(1)).alias("n")),
                                 "warc-plan", pairs=F.count(F.lit(1)), rows=F.sum("n"), most=F.max("n"))
    total = seen["rows"] or 0
    part = _ranges(distinct, shards, seen["pairs"])
    rows = rows.withColumn("copies", F.lit(1).cast("long"))
    limit = max(HOT_ROWS, total // HOT_SHARE)
    if (seen["most"] or 0) > limit:  # at most HOT_SHARE pairs
        same = F.broadcast(distinct.where(F.col("n") > limit).select(F.col("key").alias("_k"), F.col("digest").alias("_d")))
        on = F.col("key").eqNullSafe(F.col("_k")) & (F.col("digest") == F.col("_d"))
        rows = rows.join(same, on, "left_anti").unionByName(
            rows.join(same, on, "left_semi").groupBy("key", "url", "digest").agg(F.first("body").alias("body"), F.sum("copies").alias("copies")).select(rows.columns))
    looked = _first_of_each(distinct, total, min_bytes).select("key", "digest", "refers", F.lit(None).cast("string").alias("url"),
                                                              F.lit(None).cast("binary").alias("body"), F.lit(0).cast("long").alias("copies"))
    both = looked.unionByName(rows.withColumn("refers", F.lit(None).cast("long")))
    dealt = both.withColumn("part", part("key", "digest")).repartitionById(shards, "part") \
        .sortWithinPartitions(F.col("key").asc_nulls_last(), "digest", F.col("copies") > 0, F.col("url").asc_nulls_first())

    def write(batches):
        out = now = None
        refers, copy = None, 0
        for b in batches:
            cols = {n: b.column(n) for n in b.schema.names}
            for i in range(b.num_rows):
                if out is None:
                    out = RollingWriter(folder, prefix, cols["part"][i].as_py(), file_bytes, date)
                k, digest, copies = cols["key"][i].as_py(), cols["digest"][i].as_py(), cols["copies"][i].as_py()
                if (k, digest) != now:
                    now, refers, copy = (k, digest), None, 0
                if not copies:  # what the rows of this key and payload refer to; comes ahead of them
                    refers = [cols["refers"][i].as_py()]
                    continue
                u, body = cols["url"][i].as_py(), cols["body"][i].as_py()
                for _ in range(copies):
                    own = refers is None or (copy == 0 and refers[0] == k)
                    out.write(page_record(k, u, body, digest, copy, date, None if own else refers))
                    copy += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out.done)], ["part", "roll", "name", "n_records", "n_bytes", "sha256", "temp"]) \
                .cast(pa.schema([("part", pa.int32()), ("roll", pa.int32()), ("name", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string()), ("temp", pa.string())]))

    report = materialize(dealt.select("part", "key", "digest", "refers", "url", "body", "copies").mapInArrow(write, MANIFEST + ", temp string"), "warc-report")

    def rename(batches):
        there, root = filesystem(folder)
        for b in batches:
            for name, size, temp in zip(*(b.column(c).to_pylist() for c in ("name", "n_bytes", "temp"))):
                final = f"{root}/{name}"
                try:
                    there.move(f"{root}/_temporary/{temp}", final)
                except OSError:  # an earlier attempt has done it
                    if there.get_file_info(final).size != size:
                        raise
            yield b.drop_columns(["temp"])

    report.repartition(shards).mapInArrow(rename, MANIFEST).write.parquet(f"{folder}/_manifest")
    if fs.get_file_info(f"{base}/_temporary").type.name != "NotFound":
        fs.delete_dir(f"{base}/_temporary")
    return folder


# ---- reading

def members(stream, step: int = 1 << 20) -> Iterator[bytes]:
    """Contents of the gzip members of a stream."""
    z, held = zlib.decompressobj(31), []
    data = stream.read(step)
    while data:
        held.append(z.decompress(data))
        if z.eof:
            yield b"".join(held)
            data, z, held = z.unused_data, zlib.decompressobj(31), []
            data = data or stream.read(step)
        else:
            data = stream.read(step)
    if held:
        raise ValueError("the file ends inside a record")


def fields_of(raw: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = raw.decode().split("\r\n")
    return first, {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower case) and block of every record, block digests checked."""
    for raw in members(stream):
        at = 0
        while at < len(raw):
            end = raw.index(b"\r\n\r\n", at)
            version, fields = fields_of(raw[at:end])
            if not version.startswith("WARC/"):
                raise ValueError("not a WARC record")
            stop = end + 4 + int(fields["content-length"])
            block = raw[end + 4:stop]
            if raw[stop:stop + 4] != b"\r\n\r\n" or fields.get("warc-block-digest", "sha256:" + hashlib.sha256(block).hexdigest()) != "sha256:" + hashlib.sha256(block).hexdigest():
                raise ValueError(f"damaged record {fields.get('warc-record-id')}")
            yield fields, block
            at = stop + 4


def read_warc(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """One row per page record of a committed archive: key, url, payload_bytes, payload_digest, record_type, refers_to,
    record_id, file and, if asked for, the payload (null for a revisit). Lengths and digests of responses are made anew from
    the payload and must agree with the headers; a file that isn't as the manifest says is an error."""
    ship_package(spark)
    folder = qualified(spark, folder)
    listed = spark.read.parquet(f"{folder}/_manifest").select("name", "n_records", "n_bytes").repartition(partitions(spark), "name")
    names = ["key", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "file"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def whole(v):
        return None if v is None else int(v)

    def read_file(fs, base, name, n_records):
        seen = 0
        with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
            for f, block in records(stream):
                if f["warc-type"] == "warcinfo":
                    continue
                seen += 1
                end = block.index(b"\r\n\r\n") + 4
                size = int(fields_of(block[:end - 4])[1]["content-length"])
                digest = f["warc-payload-digest"].removeprefix("sha256:")
                if f["warc-type"] == "response" and (len(block) - end != size or hashlib.sha256(memoryview(block)[end:]).hexdigest() != digest):
                    raise ValueError(f"{name}: payload of {f['warc-record-id']} is not as its header says")
                yield (whole(f.get("x-key")), f.get("warc-target-uri"), size, digest, f["warc-type"], whole(f.get("x-refers-to-key")), f["warc-record-id"], name,
                       block[end:] if with_payload and f["warc-type"] == "response" else None)
        if seen != n_records:
            raise ValueError(f"{name}: {seen} records, the manifest has {n_records}")

    def read(batches):
        def batch(rows):
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
            return pa.RecordBatch.from_arrays(cols[:len(names) + with_payload], names + ["payload"] * with_payload)

        for b in batches:
            for name, n, size in zip(*(b.column(i).to_pylist() for i in range(3))):
                fs, base = filesystem(folder)
                if fs.get_file_info(f"{base}/{name}").size != size:
                    raise ValueError(f"{name}: not the size that the manifest has")
                held, held_bytes = [], 0
                for row in read_file(fs, base, name, n):
                    held.append(row)
                    held_bytes += len(row[-1] or b"")
                    if len(held) >= 5000 or held_bytes > 16 << 20:
                        yield batch(held)
                        held, held_bytes = [], 0
                if held:
                    yield batch(held)

    schema = "key long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, file string"
    return listed.mapInArrow(read, schema + (", payload binary" if with_payload else ""))
