"""Document fingerprints by locally consistent parsing (operator 10).

A text is a string of code points. One level of parsing cuts a string into phrases of 2 to
about 12 symbols and replaces each by a name:

1. *Deterministic coin tossing*: with a symbol x and its left neighbour y, let i be the lowest bit in
   which they differ; the new label is ``2 i + (bit i of x)``. Neighbours that differ keep
   different labels, and three rounds bring 64-bit names down to labels below 8. (A symbol equal
   to its left neighbour starts from a label of its own, so runs stay inside phrases.)
2. A phrase starts where the label is a local maximum. Whether a position is one depends on four
   symbols to its left and one to its right only, so equal substrings are cut alike except near
   their ends, wherever they stand.
3. A phrase's name is a 64-bit hash of its symbols, so equal phrases have equal names in all
   documents, and the names are the string of the next level.

Phrases grow about threefold a level. The fingerprint is the bottom-``size`` sketch of the distinct
names of levels ``LEVELS`` (a level with one phrase ends the parse), written as hexadecimal; likeness
of two fingerprints is the Dice coefficient of the name sets estimated from the sketches (exact
while both are shorter than the sketch).

``edited_pairs`` brings every document together with the next one (descending id, the last with the
first): rows are dealt to ranges of (id, text hash) once, and the first row of each range is dealt to the
preceding range as well, so one shuffle of the text is all, and an id that very many rows share (or lack) is no hot range.

Edge cases: null text counts as empty; an empty text has the empty fingerprint, likeness 1 with
another empty one and 0 with others; equal ids are ordered by text hash; null ids come last; one
row is its own next document; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densitykit.llm.common import U, by_key_ranges, mix, partitions, text_bytes

LEVELS = (2, 3, 4)
SIZE = 128
_T = np.random.default_rng(31).integers(1, 2**63, 2048, dtype=np.uint64)
_K = U(0x9E3779B97F4A7C15)


def _low_bit(d: np.ndarray) -> np.ndarray:
    """Place of the lowest set bit of nonzero 64-bit values."""
    low = d & (~d + U(1))
    return np.bitwise_count(low - U(1)).astype(np.uint64)


def _starts(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Phrase starts of the strings that begin at ``first`` inside ``x`` (one mask for all)."""
    n = len(x)
    head = np.zeros(n, bool)
    head[first] = True
    lab = x
    same = np.zeros(n, bool)
    same[1:] = x[1:] == x[:-1]
    same[head] = False
    for r in range(3):
        d = np.empty(n, np.uint64)
        d[0] = 1
        np.bitwise_xor(lab[1:], lab[:-1], out=d[1:])
        d[head] = lab[head] | U(1 << 63 if r == 0 else 64)  # a string's first symbol meets an end mark
        d[d == 0] = U(1) << U(63 if r == 0 else 6)
        i = _low_bit(d)
        lab = U(2) * i + ((lab >> i) & U(1))
    lab = lab.astype(np.int16)
    lab[same] = -1  # inside a run no phrase starts
    up = np.ones(n, bool)
    up[1:] = lab[1:] > lab[:-1]
    down = np.ones(n, bool)
    down[:-1] = lab[:-1] >= lab[1:]
    down[np.append(first[1:] - 1, n - 1) if n else []] = False  # the last symbol joins the phrase before it
    out = up & down
    # no phrase of one symbol: a start right after a start is dropped (the left one stands)
    out[head] = True
    out[1:] &= ~(out[:-1] & ~head[1:]) if n > 1 else True
    out[head] = True
    return out


def _names(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of each phrase's symbols: sum of place-dependent mixes (runs may be long)."""
    at = np.flatnonzero(starts)
    n = np.diff(at, append=len(x))
    place = np.arange(len(x)) - np.repeat(at, n)
    v = mix(x + _T[place & 2047] * (place >> 11).astype(np.uint64) + _T[place & 2047])
    return mix(np.add.reduceat(v, at) ^ n.astype(np.uint64) * _K)


def parse(x: np.ndarray, first: np.ndarray, levels: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Names and string starts of levels 1 .. ``levels`` of the non-empty strings in ``x``."""
    out = []
    for _ in range(levels):
        s = _starts(x, first)
        names = _names(x, s)
        first = np.searchsorted(np.flatnonzero(s), first)
        x = names
        out.append((names, first))
    return out


def sketches(points: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Sorted bottom-``SIZE`` distinct names of every string of code points."""
    n = np.diff(off)
    full = np.flatnonzero(n)
    empty = np.zeros(0, np.uint64)
    res = [empty] * len(n)
    if not len(full):
        return res
    up = parse(mix(points.astype(np.uint64) + _K), off[full], max(LEVELS))
    # names of the chosen levels; salted, so that levels never meet; short strings use their top level too
    for j, r in enumerate(full.tolist()):
        got = []
        for lv in LEVELS:
            names, first = up[lv - 1]
            a, b = int(first[j]), int(first[j + 1]) if j + 1 < len(full) else len(names)
            got.append(names[a:b] ^ _T[lv])
            if b - a == 1:
                break
        u = np.unique(mix(np.concatenate(got)))
        res[r] = u[:SIZE]
    return res


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Dice coefficient of two name sets, estimated from their bottom sketches."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.intersect1d(a, b, assume_unique=True)
    if len(a) < SIZE and len(b) < SIZE:
        jac = len(both) / (len(a) + len(b) - len(both))
    else:
        k = min(SIZE, max(len(a), len(b)))
        low = np.union1d(a, b)[:k]
        if len(a) < SIZE or len(b) < SIZE:  # a complete set next to a cut one: compare below the cut
            cut = a[-1] if len(a) == SIZE else b[-1]
            low = low[low <= cut]
        jac = len(np.intersect1d(both, low, assume_unique=True)) / len(low)
    return float(2 * jac / (1 + jac))


def text_of(s: np.ndarray) -> str:
    """Fingerprint as text: the sketch's names, 16 hexadecimal digits each."""
    return s.astype(">u8").tobytes().hex()


def code_points(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 rows, and offsets counted in code points."""
    lead = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32), lead[off]


def edited_pairs(docs: DataFrame, id_col: str, text_col: str, files: int | None = None) -> DataFrame:
    """Rows in descending key ranges (``_part``), every range followed by the first row of the next
    one (``_guest``), dealt out with one shuffle."""
    spark = docs.sparkSession
    files = files or partitions(spark)
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), t.alias("t"))
    home = by_key_ranges(rows.withColumn("th", F.xxhash64("t")), "id", files, F.col("th"))
    # first row of each range in the order (id descending, nulls last; text hash): a row for each range
    top = home.groupBy("_part").agg(F.max(F.struct(F.col("id").isNotNull().alias("has"), "id", "th")).alias("m")).collect()
    top.sort(key=lambda r: -r["_part"])
    heads = [(r["_part"], r["m"]["id"], r["m"]["th"]) for r in top]
    to = {heads[i]: heads[i - 1][0] for i in range(len(heads))} if heads else {}  # the first range follows the last
    guests = spark.createDataFrame([(k[1], k[2], int(v)) for k, v in to.items()], "gid long, gth long, to int")
    # one row for each range
    marked = home.join(F.broadcast(guests), F.col("id").eqNullSafe(F.col("gid")) & (F.col("th") == F.col("gth")), "left")
    stay = F.struct(F.col("_part").cast("int").alias("p"), F.lit(False).alias("guest"))
    go = F.struct(F.col("to").alias("p"), F.lit(True).alias("guest"))
    return marked.select("id", "t", "th", F.explode(F.when(F.col("to").isNull(), F.array(stay)).otherwise(F.array(stay, go))).alias("x")) \
        .select(F.col("x.p").alias("_part"), F.col("x.guest").alias("_guest"), "id", "th", "t") \
        .repartitionById(files, "_part").sortWithinPartitions("_guest", F.col("id").desc_nulls_last(), F.desc("th"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_chars, fingerprint of every text."""
    def run(batches):
        for b in batches:
            data, off, _ = text_bytes(b.column(1))
            pts, at = code_points(data, off)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at)), pa.array([text_of(s) for s in sketches(pts, at)])], ["id", "n", "f"])

    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")) \
        .mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n long, f string") \
        .select(F.col("id").alias(id_col), F.col("n").alias("n_chars"), F.col("f").alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text against its edited form (second half replaced by the start of the next
    document) and against the next document: id_col, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next."""
    schema = f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches):
        held, size, last = [], 0, None

        def flush(rows, close):
            """Results of all rows but the last, which waits for its next one (unless it is a guest)."""
            texts = [t for _, t, _ in rows]
            pairs = [(i, i + 1) for i in range(len(rows) - 1) if not rows[i][2]]
            edited = []
            for i, j in pairs:
                t, k = texts[i], len(texts[i]) // 2
                edited.append(t[:len(t) - k] + texts[j][:k])
            raw = [x.encode("utf-32-le") for x in texts + edited]
            pts = np.frombuffer(b"".join(raw), np.uint32)
            sk = sketches(pts, np.cumsum([0, *(len(x) // 4 for x in raw)]))
            own, changed = sk[:len(texts)], sk[len(texts):]
            return pa.RecordBatch.from_arrays([
                pa.array([rows[i][0] for i, _ in pairs], pa.int64()), pa.array([len(texts[i]) for i, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
                pa.array([text_of(own[i]) for i, _ in pairs], pa.string()), pa.array([text_of(x) for x in changed], pa.string()),
                pa.array([likeness(own[i], c) for (i, _), c in zip(pairs, changed)], pa.float64()),
                pa.array([likeness(own[i], own[j]) for i, j in pairs], pa.float64())],
                [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for b in batches:
            for k, guest, t in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), b.column(4).to_pylist()):
                held.append((k, t, guest))
                size += len(t)
                if size > 500_000 and len(held) > 1:
                    yield flush(held, False)
                    held, size = held[-1:], len(t)
        if len(held) > 1:
            yield flush(held, True)

    return edited_pairs(docs, id_col, text_col).mapInArrow(run, schema)
