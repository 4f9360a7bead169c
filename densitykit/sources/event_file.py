"""Binary event files as a Spark data source (S1-S4, S6), ``format("event_file")``.

A file is a 5,000-byte header, then fixed-size event records, then a footer (any bytes after
the last whole record, a truncated record included). A record is
``8 chars, int32 index, float64 timestamp, int32 n_channels, int32 hp_flag,
int16[8][2048] signal``, unpadded (32,796 bytes); byte order is an option (default little).
The file name carries ``type, series, run, board`` (``S223r10b1.dat``).

Reading is split by byte range: every file is cut into splits of ``eventsPerSplit`` records
(default 512), each read with a single ranged read and decoded with a numpy structured dtype into an Arrow
batch. A task reads one split, or where there are very many, several one after the other (``bundled``). Splits from all matched files form one job. The options
``eventFrom``/``eventTo`` (inclusive) read exactly those events of each file. Where the session
sets ``spark.sql.python.filterPushdown.enabled``, ``read_events`` picks a reader that also prunes
splits by pushed filters on ``event_pos`` and the file-name fields (Spark still applies them).
Paths are URIs (``file:``, ``hdfs:``, ``s3:``/``s3a:``, ``gs:``, ..); ``read_events`` and ``write_event_files``
take a path without a scheme on Spark's default file system.

``option("mode", "files")`` returns one row per file instead: name fields, event count,
header and footer text. Writing (``df.write.format("event_file")``) produces the same layout
from rows clustered by file (see ``write_event_files``): a task writes under a hidden folder of its
own, and the driver moves the files into place when the job commits, so a lost or repeated task
leaves nothing behind. A file whose name is taken gets a number (``S223r10b1.1.dat``); appending never
touches existing files.
"""

from __future__ import annotations

import fnmatch
import os
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In,
    InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from densitykit.session import qualified

# Fixed values of the file format (must equal the files' layout):
HEADER_SIZE = 5000
N_CHANNELS = 8
N_SAMPLES = 2048
EVENT_SIZE = 8 + 4 + 8 + 4 + 4 + 2 * N_CHANNELS * N_SAMPLES  # 32,796 bytes
START_FLAG = b"********"
HP_FLAG = 0xFF
FILENAME_PATTERN = r"([SCD])(\d+)r(\d+)b(\d+)"

EVENT_SCHEMA = ("path STRING, type STRING, series INT, run INT, board INT, event_pos BIGINT, start_flag STRING, "
                "index INT, timestamp DOUBLE, n_channels INT, hp_flag INT, signal ARRAY<ARRAY<SMALLINT>>")
FILE_SCHEMA = ("path STRING, type STRING, series INT, run INT, board INT, n_events BIGINT, size BIGINT, "
               "header STRING, footer STRING")


def event_dtype(byte_order: str = "little") -> np.dtype:
    e = {"little": "<", "big": ">", "native": "="}[byte_order]
    return np.dtype([("start_flag", "S8"), ("index", e + "i4"), ("timestamp", e + "f8"), ("n_channels", e + "i4"),
                     ("hp_flag", e + "i4"), ("signal", e + "i2", (N_CHANNELS, N_SAMPLES))])


def name_fields(path: str):
    m = re.search(FILENAME_PATTERN, os.path.basename(path)) or re.search(FILENAME_PATTERN, path)
    if not m:
        return None, None, None, None
    return m.group(1), int(m.group(2)), int(m.group(3)), int(m.group(4))


def _fs(path: str):
    """File system, path in it, and the prefix that makes a listed path a full one again."""
    from pyarrow import fs

    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(.*)", path)
    if not m:
        if not path.startswith("/"):
            raise ValueError(f"a path must be absolute or a URI: {path}")
        return fs.LocalFileSystem(), path, ""
    scheme, rest = m.groups()
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/"), ""
    if scheme in ("s3a", "s3n"):
        scheme = "s3"
    if not rest.startswith("//"):  # hdfs:/folder: the default authority
        rest = "//" + ("default" if scheme == "hdfs" else "") + "/" + rest.lstrip("/")
    f, p = fs.FileSystem.from_uri(f"{scheme}:{rest}")  # raises on a scheme that it doesn't know
    full = f"{scheme}:{rest}"
    return f, p, full[: len(full) - len(p)] if full.endswith(p) else ""


def list_files(paths: str) -> list[tuple[str, int]]:
    """``(path, size)`` of every file matched by a comma-separated list of files, folders or
    glob patterns (metadata only). Hidden files and folders are left out."""
    from pyarrow import fs

    out = []
    for raw in [p.strip() for p in paths.split(",") if p.strip()]:
        f, p, prefix = _fs(raw)
        has_glob = any(ch in p for ch in "*?[")
        base = p
        if has_glob:
            base = p[: min(p.index(ch) for ch in "*?[" if ch in p)]
            base = base.rsplit("/", 1)[0] or "/"
        info = f.get_file_info(base)
        if info.type == fs.FileType.File:
            out.append((prefix + info.path, info.size))
            continue
        for fi in f.get_file_info(fs.FileSelector(base, recursive=True)):
            below = fi.path[len(base):].lstrip("/").split("/")
            if fi.type != fs.FileType.File or any(x.startswith((".", "_")) for x in below):
                continue
            if has_glob and not fnmatch.fnmatch(fi.path, p):
                continue
            out.append((prefix + fi.path, fi.size))
    return sorted(set(out))


#: Splits up to which each has a task of its own, and the bytes that a task of several reads at most.
MANY_SPLITS, TASK_BYTES = 512, 64 << 20


@dataclass
class EventSplit(InputPartition):
    path: str
    start: int
    count: int
    n_events: int
    size: int


@dataclass
class EventSplits(InputPartition):
    """Several splits that one task reads, one after the other."""

    splits: list


def bundled(splits: list[EventSplit], whole: bool) -> list:
    """Many small splits dealt to some ``MANY_SPLITS`` tasks, or more if a task would read over ``TASK_BYTES``; with
    ``whole`` a split counts as no bytes (only file names and ends are read). The splits stay as they are."""
    if len(splits) <= MANY_SPLITS:
        return splits
    most, out, held = -(-len(splits) // MANY_SPLITS), [], 0
    for s in splits:
        size = 0 if whole else s.count * EVENT_SIZE
        if not out or len(out[-1].splits) >= most or held + size > TASK_BYTES:
            out.append(EventSplits([]))
            held = 0
        out[-1].splits.append(s)
        held += size
    return out


class _Pruner:
    """Ranges and sets from pushed filters on ``event_pos`` and the file-name fields."""

    def __init__(self):
        self.lo, self.hi = None, None   # event_pos bounds, inclusive
        self.allowed: dict[str, set] = {}

    def take(self, f) -> None:
        col = f.attribute[0] if isinstance(f.attribute, tuple) else f.attribute
        if col == "event_pos":
            if isinstance(f, EqualTo):
                self._lo(f.value)
                self._hi(f.value)
            elif isinstance(f, GreaterThan):
                self._lo(f.value + 1)
            elif isinstance(f, GreaterThanOrEqual):
                self._lo(f.value)
            elif isinstance(f, LessThan):
                self._hi(f.value - 1)
            elif isinstance(f, LessThanOrEqual):
                self._hi(f.value)
            elif isinstance(f, In):
                self._lo(min(f.value))
                self._hi(max(f.value))
        elif col in ("type", "series", "run", "board"):
            vals = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if vals is not None:
                self.allowed[col] = self.allowed.get(col, vals) & vals

    def _lo(self, v):
        self.lo = v if self.lo is None else max(self.lo, v)

    def _hi(self, v):
        self.hi = v if self.hi is None else min(self.hi, v)

    def file_ok(self, path: str) -> bool:
        t, s, r, b = name_fields(path)
        vals = {"type": t, "series": s, "run": r, "board": b}
        return all(vals[c] in ok for c, ok in self.allowed.items())


class EventFileReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.paths = options.get("path") or options.get("paths")
        if not self.paths:
            raise ValueError("event_file needs a path")
        self.per_split = int(options.get("eventsPerSplit", 512))
        self.byte_order = options.get("byteOrder", "little")
        self.mode = options.get("mode", "events")
        self.failfast = options.get("parseMode", "permissive") == "failfast"
        self.pruner = _Pruner()
        if options.get("eventFrom") is not None:
            self.pruner._lo(int(options["eventFrom"]))
        if options.get("eventTo") is not None:
            self.pruner._hi(int(options["eventTo"]))

    def partitions(self):
        parts = []
        for path, size in list_files(self.paths):
            if not self.pruner.file_ok(path):
                continue
            n = max(0, (size - HEADER_SIZE) // EVENT_SIZE)
            if self.mode == "files":
                parts.append(EventSplit(path, 0, 0, n, size))
                continue
            lo = 0 if self.pruner.lo is None else max(0, self.pruner.lo)
            hi = n - 1 if self.pruner.hi is None else min(n - 1, self.pruner.hi)
            start = lo
            while start <= hi:
                cnt = min(self.per_split, hi + 1 - start)
                parts.append(EventSplit(path, start, cnt, n, size))
                start += self.per_split
        return bundled(parts, self.mode == "files") or [EventSplit("", 0, 0, 0, 0)]

    def read(self, split: EventSplit | EventSplits):
        splits = split.splits if isinstance(split, EventSplits) else [split]
        one = self._file_row if self.mode == "files" else self._events
        return (one(s) for s in splits if s.path)

    def _open(self, path):
        f, p, _ = _fs(path)
        return f.open_input_file(p)

    def _file_row(self, split: EventSplit):
        t, s, r, b = name_fields(split.path)
        with self._open(split.path) as fh:
            header = fh.read_at(min(HEADER_SIZE, split.size), 0)
            foot_at = HEADER_SIZE + split.n_events * EVENT_SIZE
            footer = fh.read_at(max(0, split.size - foot_at), foot_at) if split.size > foot_at else b""
        dec = lambda x: x.rstrip(b"\x00").decode("latin-1")
        return (split.path, t, s, r, b, split.n_events, split.size, dec(header), dec(footer))

    def _events(self, split: EventSplit) -> pa.RecordBatch:
        dt = event_dtype(self.byte_order)
        with self._open(split.path) as fh:
            buf = fh.read_at(split.count * EVENT_SIZE, HEADER_SIZE + split.start * EVENT_SIZE)
        n = len(buf) // EVENT_SIZE
        rec = np.frombuffer(buf, dtype=dt, count=n)
        if self.failfast and n:
            bad = (rec["start_flag"] != START_FLAG) | (rec["n_channels"] != N_CHANNELS) | (rec["hp_flag"] != HP_FLAG)
            if bad.any():
                i = int(np.argmax(bad))
                raise ValueError(f"bad event flags in {split.path} at event {split.start + i}")
        t, s, r, b = name_fields(split.path)
        sig = np.ascontiguousarray(rec["signal"]).astype("<i2", copy=False).reshape(-1)
        inner = pa.ListArray.from_arrays(pa.array(np.arange(0, n * N_CHANNELS + 1, dtype=np.int32) * N_SAMPLES),
                                         pa.array(sig, type=pa.int16()))
        outer = pa.ListArray.from_arrays(pa.array(np.arange(0, n + 1, dtype=np.int32) * N_CHANNELS), inner)
        cols = {
            "path": pa.array([split.path] * n, pa.string()),
            "type": pa.array([t] * n, pa.string()),
            "series": pa.array([s] * n, pa.int32()),
            "run": pa.array([r] * n, pa.int32()),
            "board": pa.array([b] * n, pa.int32()),
            "event_pos": pa.array(np.arange(split.start, split.start + n, dtype=np.int64)),
            "start_flag": pa.array([x.decode("latin-1") for x in rec["start_flag"]], pa.string()),
            "index": pa.array(rec["index"].astype(np.int32)),
            "timestamp": pa.array(rec["timestamp"].astype(np.float64)),
            "n_channels": pa.array(rec["n_channels"].astype(np.int32)),
            "hp_flag": pa.array(rec["hp_flag"].astype(np.int32)),
            "signal": outer,
        }
        return pa.RecordBatch.from_pydict(cols)


class PushingEventFileReader(EventFileReader):
    """For sessions that allow filter pushdown into Python sources."""

    def pushFilters(self, filters):
        for f in filters:
            self.pruner.take(f)
        return filters  # Spark still applies every filter; pushing only prunes splits


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    files: list


class EventFileWriter(DataSourceArrowWriter):
    """Writes rows (``type, series, run, board, index, timestamp, signal``) as event files, whole batches at
    a time. Rows of one file must be in one task and in order (``write_event_files`` arranges that)."""

    def __init__(self, options: dict, overwrite: bool):
        self.path = options.get("path")
        self.byte_order = options.get("byteOrder", "little")
        self.header = options.get("header", "")
        self.footer = options.get("footer", "")
        self.overwrite = overwrite

    def write(self, batches):
        dt = event_dtype(self.byte_order)
        f, base, _ = _fs(self.path)
        folder, names, cur, out = f"{base.rstrip('/')}/_attempt-{uuid.uuid4().hex}", [], None, None

        def close():
            if out is not None:
                out.write(self.footer.encode("latin-1"))
                out.close()

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            col = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            signal = col["signal"].flatten()
            if len(signal) != n * N_CHANNELS or len(signal.flatten()) != n * N_CHANNELS * N_SAMPLES:
                raise ValueError(f"a signal has {N_CHANNELS} channels of {N_SAMPLES} samples")
            rec = np.zeros(n, dtype=dt)
            rec["start_flag"], rec["n_channels"], rec["hp_flag"] = START_FLAG, N_CHANNELS, HP_FLAG
            rec["index"], rec["timestamp"] = col["index"].to_numpy(zero_copy_only=False), col["timestamp"].to_numpy(zero_copy_only=False)
            rec["signal"] = signal.flatten().to_numpy(zero_copy_only=False).reshape(n, N_CHANNELS, N_SAMPLES)
            keys = list(zip(*(col[c].to_pylist() for c in ("type", "series", "run", "board"))))
            starts = [i for i in range(n) if i == 0 or keys[i] != keys[i - 1]]
            for i, j in zip(starts, [*starts[1:], n]):
                if keys[i] != cur:
                    close()
                    cur = keys[i]
                    name = f"{cur[0]}{cur[1]}r{cur[2]}b{cur[3]}"
                    if name in names:
                        raise ValueError(f"the rows of {name} are not together")
                    if not names:
                        f.create_dir(folder, recursive=True)
                    names.append(name)
                    out = f.open_output_stream(f"{folder}/{name}")
                    out.write(self.header.encode("latin-1")[:HEADER_SIZE].ljust(HEADER_SIZE, b"\x00"))
                out.write(rec[i:j].tobytes())
        close()
        return _Written(folder, names)

    def commit(self, messages):
        from pyarrow import fs

        f, base, _ = _fs(self.path)
        base = base.rstrip("/")
        f.create_dir(base, recursive=True)
        taken = {os.path.basename(i.path): i.path for i in f.get_file_info(fs.FileSelector(base)) if i.type == fs.FileType.File}
        if self.overwrite:
            for path in taken.values():
                f.delete_file(path)
            taken = {}
        for m in [m for m in messages if m is not None and m.files]:
            for name in m.files:
                final, k = f"{name}.dat", 0
                while final in taken:
                    k += 1
                    final = f"{name}.{k}.dat"
                taken[final] = final
                f.move(f"{m.folder}/{name}", f"{base}/{final}")
            f.delete_dir(m.folder)

    def abort(self, messages):
        f, _, _ = _fs(self.path)
        for m in messages:
            if m is not None and m.files:
                f.delete_dir(m.folder)


class EventFileDataSource(DataSource):
    @classmethod
    def name(cls):
        return "event_file"

    def schema(self):
        return FILE_SCHEMA if self.options.get("mode", "events") == "files" else EVENT_SCHEMA

    def reader(self, schema):
        pushing = str(self.options.get("pushFilters", "false")).lower() == "true"
        return (PushingEventFileReader if pushing else EventFileReader)(self.options, schema)

    def writer(self, schema, overwrite):
        return EventFileWriter(self.options, overwrite)


def register(spark) -> None:
    """Register ``format("event_file")`` on a session (idempotent)."""
    spark.dataSource.register(EventFileDataSource)


def read_events(spark, path: str, **options):
    register(spark)
    r = spark.read.format("event_file").option("pushFilters", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    for k, v in options.items():
        r = r.option(k, str(v))
    return r.load(qualified(spark, path))


def read_event_files(spark, path: str):
    """One row per file (name fields, event count, header, footer)."""
    return read_events(spark, path, mode="files")


def write_event_files(df, path: str, header: str = "", footer: str = "", partitions: int | None = None,
                      finish: Callable | None = None) -> None:
    """Write rows as event files, one file per (type, series, run, board), events in
    ``index`` order. Rows are hash-partitioned by file, so each file is written by one task.
    ``finish`` turns the arranged rows into those written, row by row (say, makes ``signal``), so that only what it takes is shuffled."""
    spark = df.sparkSession
    register(spark)
    keys = ["type", "series", "run", "board"]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    arranged = df.repartition(n, *keys).sortWithinPartitions(*keys, "index")
    if finish is not None:
        arranged = finish(arranged)
    arranged.write.format("event_file").mode("append").option("header", header).option("footer", footer).save(qualified(spark, path))


def signal_sum(col: str = "signal"):
    """Sum of all samples of an event (a cheap fingerprint of the signal)."""
    from pyspark.sql import functions as F

    return F.aggregate(F.flatten(F.col(col)), F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
