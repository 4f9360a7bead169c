"""MinHash near-duplicate groups with odd sketches (operator 4).

1. A vectorised pass over the texts gives each document its number of distinct word shingles,
   a 128-bit key of the shingle set, ``bands * rows`` MinHash values folded into band keys, and
   an odd sketch: bit ``hash(i, minhash_i)`` of a bitmap is flipped for every sample i.
2. Documents with one shingle set form a class (copies collapse before anything is paired).
3. Classes that share a band key are candidates. The population count of two sketches' XOR
   estimates the similarity; candidates far below the threshold are dropped (at the default
   sizes a pair at the threshold is dropped with a chance below 1e-8), the others are
   confirmed on the full shingle sets of both texts.
4. Links between classes go through connected components; a class's documents take the
   smallest document id of its component.

Buckets are never expanded into all pairs. A bucket of at most ``small`` classes is compared whole. In
a larger one every class is compared with one *leader* (the class with the most company in its buckets), which joins
most of a group of near copies. What is left of a bucket is compared in blocks: ``BLOCK_SETS`` classes outside the
bucket's largest component meet ``PROBES`` of its members in one bounded task, which counts shared
shingles through the block's postings and returns only links that join two components. Members that can link with nobody are left
out by an exact bound: two sets of sizes m and n share at most as many shingles as the smaller number that either
has in common with *any* set still in a large bucket, and a link needs ``percent (m + n) / (100 + percent)`` of them.
So every pair of a bucket is compared, already connected, or excluded by the bound.

Band misses: with the default 28 bands of 4 rows a pair at similarity 0.8 shares no band with a
chance of 4e-7, less above.

Edge cases: null or empty text and text without words has an empty set and links with nothing;
fewer words than the shingle width give one shingle, the whole sequence; documents with null ids link as
any other but never name a component: one without any id has a null ``component_id``, and of it the rows of the
least text hash are ``kept``;
rows with one id and several texts are separate rows; repeated rows are copies; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from densitykit.llm.common import LOWER, SPACE, U, lean, mix, row_blocks, span_hashes, text_bytes, words
from densitykit.session import materialize

SKETCH_BITS = 512
#: Sets of a block, and members that meet a block in one task.
BLOCK_SETS, PROBES = 256, 500
_SHORT = U(0xA24BAED4963EE407)


def shingle_rows(data: np.ndarray, off: np.ndarray, width: int):
    """Sorted distinct 64-bit shingle hashes of each row, one array per row, in order."""
    for i, j in row_blocks(off):
        d, o = LOWER[data[off[i]:off[j]]], off[i:j + 1] - off[i]
        s, e, first = words(d, o, SPACE)
        h = span_hashes(d, s, e)
        n = len(h) - width + 1
        if n > 0:
            full = h[:n].copy()
            for k in range(1, width):
                full = mix(full * U(0x9FB21C651E98DF25)) + h[k:k + n]
            full = mix(full)
        for r in range(j - i):
            a, b = int(first[r]), int(first[r + 1])
            if b - a >= width:
                yield np.unique(full[a:b - width + 1])
            elif b > a:
                x = np.full(1, b - a, np.uint64) * _SHORT
                for k in range(a, b):
                    x = mix(x) + h[k:k + 1]
                yield mix(x)
            else:
                yield h[:0]


class Sampler:
    """MinHash samples of a shingle set, their band keys and their odd sketch."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(97)
        k = bands * rows
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 2**31, (k, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 2**32, (k, 1), dtype=np.uint32)
        self.salt = mix(np.arange(1, k + 1, dtype=np.uint64))
        self.band_salt = mix(np.arange(10_001, 10_001 + bands, dtype=np.uint64))

    def sample(self, s: np.ndarray) -> np.ndarray:
        x = (s >> U(32)).astype(np.uint32)
        low = None
        for i in range(0, len(x), 2048):
            y = x[i:i + 2048] * self.a
            y += self.b
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            m = y.min(axis=1)
            low = m if low is None else np.minimum(low, m)
        return low.astype(np.uint64)

    def keys(self, m: np.ndarray) -> np.ndarray:
        g = m.reshape(self.bands, self.rows)
        h = self.band_salt.copy()
        for c in range(self.rows):
            h = mix(h + g[:, c])
        return h

    def sketch(self, m: np.ndarray) -> np.ndarray:
        at = (mix(self.salt ^ m) % U(SKETCH_BITS)).astype(np.int64)
        return np.packbits((np.bincount(at, minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """id, hash of the text, n, key (long pair of the set; null if empty), bands, sketch."""
    def run(batches):
        sm = Sampler(bands, rows)
        for b in batches:
            data, off, _ = text_bytes(b.column(1))
            n, k1, k2, bk, sk = [], [], [], [], []
            for s in shingle_rows(data, off, width):
                n.append(len(s))
                if len(s):
                    m = sm.sample(s)
                    x, y = set_keys(s)
                    k1.append(x)
                    k2.append(y)
                    bk.append(sm.keys(m))
                    sk.append(sm.sketch(m))
                else:
                    k1.append(U(0))
                    k2.append(U(0))
            has = np.array([x > 0 for x in n], bool)
            flat = np.concatenate(bk).view(np.int64) if bk else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(2), pa.array(n, pa.int64()),
                pa.array(np.array(k1, np.uint64).view(np.int64), mask=~has), pa.array(np.array(k2, np.uint64).view(np.int64), mask=~has),
                pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(has * bands)), pa.int32()), pa.array(flat)),
                pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(has * (SKETCH_BITS // 64))), pa.int32()), pa.array(np.concatenate(sk) if sk else flat))], ["id", "th", "n", "k1", "k2", "bands", "sketch"])

    t = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), t.alias("t"), F.xxhash64(t).alias("th")) \
        .mapInArrow(lean(run), "id long, th long, n long, k1 long, k2 long, bands array<long>, sketch array<long>")


def set_keys(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two order-free 64-bit keys of a shingle set."""
    return s.sum(dtype=np.uint64), mix(s).sum(dtype=np.uint64)


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, n, k1, k2 as in ``signatures``, and set: the sorted distinct shingle hashes as bytes."""
    def run(batches):
        for b in batches:
            data, off, _ = text_bytes(b.column(1))
            sets = list(shingle_rows(data, off, width))
            k = np.array([set_keys(s) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1]),
                                              pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "n", "k1", "k2", "set"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")) \
        .mapInArrow(lean(run), "id long, n long, k1 long, k2 long, set binary")


def sketch_distance(a: str, b: str) -> F.Column:
    """Bits in which two odd sketches differ."""
    return F.expr(" + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(SKETCH_BITS // 64)))


def greatest_distance(similarity: float, samples: int) -> int:
    """Differing bits at which the odd-sketch estimate ``1 + n / 4k ln(1 - 2 d / n)`` falls to ``similarity``."""
    return int(SKETCH_BITS / 2 * (1 - np.exp((similarity - 1) * 4 * samples / SKETCH_BITS)))


def components(links: DataFrame) -> DataFrame:
    """``node, label`` (least node reachable) of all ends of ``links(a, b)``: hooking to the least neighbouring
    label and pointer jumping, one written table a round."""
    edges = materialize(links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
                        .select("e.a", "e.b").distinct(), "nd-edges")
    f = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).withColumn("label", F.least("node", "label")), "nd-labels")
    while True:
        low = edges.join(f.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").groupBy(F.col("a").alias("node")).agg(F.min("lb").alias("low"))
        hook = f.join(low, "node").select(F.explode(F.array(F.struct("node", "low"), F.struct(F.col("label").alias("node"), "low"))).alias("h")) \
            .select("h.node", "h.low").groupBy("node").agg(F.min("low").alias("low"))
        up = f.join(hook, "node").select("node", F.least("label", "low").alias("label"), F.col("label").alias("old"))
        jump = up.join(up.select(F.col("node").alias("label"), F.col("label").alias("top")), "label") \
            .select("node", F.least("label", "top").alias("label"), "old")
        g, st = materialize(jump, "nd-labels", moved=F.count_if(F.col("label") != F.col("old")))
        f = g.select("node", "label")
        if not st["moved"]:
            return f


def overlap(a, b) -> F.Column:
    """Shingles that two sets share."""
    @F.pandas_udf("long")
    def shared(x, y):
        import pandas as pd

        out = []
        for p, q in zip(x, y):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            if len(p) > len(q):
                p, q = q, p
            at = np.searchsorted(q, p)
            at[at == len(q)] = 0
            out.append(int((q[at] == p).sum()) if len(q) else 0)
        return pd.Series(out, dtype="int64")

    return shared(a, b)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 80,
                    bands: int = 28, rows: int = 4, small: int = 8, sketch_floor: float = 0.55) -> DataFrame:
    """Per row of ``docs``: id_col, n_shingles, component_id, kept, class_id, n_links, text_hash.

    Two documents link if ``100 * shared >= percent * union`` of their distinct shingles.
    ``class_id`` names the shingle set, ``n_links`` counts the confirmed links of its class
    with other classes (for a pair that a component already joined no link is counted).
    """
    sig = materialize(signatures(docs, id_col, text_col, width, bands, rows), "nd-signatures")
    named = sig.withColumn("node", F.when(F.col("n") > 0, F.xxhash64("k1", "k2", "n")))
    classes = materialize(named.where("n > 0").groupBy("node").agg(
        F.min("id").alias("rep"), F.min_by("th", F.coalesce("id", F.lit((1 << 63) - 1))).alias("rep_th"), F.min("th").alias("th"), F.min("n").alias("n"), F.min_by("sketch", "k1").alias("sketch"),
        F.min_by("bands", "k1").alias("bands")), "nd-classes")
    links, labels = _link(docs, id_col, text_col, classes, width, percent, bands * rows, small, sketch_floor)
    comp = classes.select("node", "rep", "th").join(labels, "node", "left") \
        .select("node", "rep", "th", F.coalesce("label", "node").alias("label"))
    first = comp.groupBy("label").agg(F.min("rep").alias("component_id"), F.min("th").alias("first_th"))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    per_class = comp.join(first, "label").join(degree, "node", "left") \
        .select("node", "component_id", "first_th", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = named.select("id", "th", "n", "node").join(per_class, "node", "left")
    cid = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), cid.alias("component_id"),
                      (F.col("id").eqNullSafe(cid) & (cid.isNotNull() | F.coalesce(F.col("th") == F.col("first_th"), F.lit(True)))).alias("kept"), F.col("node").alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("th").alias("text_hash"))


def _link(docs, id_col, text_col, classes, width, percent, samples, small, sketch_floor):
    """Confirmed links ``a, b`` between classes, and ``node, label`` of all classes with links."""
    spark = docs.sparkSession
    # members of buckets with two classes or more
    member = classes.select("node", F.explode("bands").alias("bucket"))
    size = F.count(F.lit(1)).over(Window.partitionBy("bucket"))
    buckets, st = materialize(member.withColumn("size", size).where("size > 1"), "nd-buckets",
                              n=F.count(F.lit(1)))
    light = classes.select("node", "n", "sketch")
    empty = spark.createDataFrame([], "a long, b long")
    none = spark.createDataFrame([], "node long, label long")
    if not st["n"]:
        return empty, none
    wanted = materialize(buckets.select("node").distinct().join(classes.select("node", "rep", "rep_th"), "node"), "nd-wanted")
    # the sets of candidate classes, one text each; the whole text column is shuffled at most once
    text = F.col(text_col).cast("string")
    mine = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("t"), F.xxhash64(text).alias("_th")) \
        .join(wanted.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("rep")) & (F.col("_th") == F.col("rep_th"))).select("node", "t")
    sets = shingle_sets(mine, "node", "t", width).where(F.col("id") == F.xxhash64("k1", "k2", "n"))
    sets = materialize(sets.groupBy("id").agg(F.first("set").alias("set")), "nd-sets")
    # first round: small buckets whole, larger ones against one leader
    hub = buckets.groupBy("node").agg(F.sum("size").alias("hub"))
    order = Window.partitionBy("bucket").orderBy(F.desc("hub"), "node")
    ranked = buckets.join(hub, "node").withColumn("r", F.row_number().over(order)) \
        .withColumn("leads", F.when(F.col("size") <= small, F.col("size")).otherwise(F.lit(1)))
    heads = ranked.where("r <= leads").select("bucket", F.col("node").alias("a"), F.col("r").alias("ra"))
    pairs = ranked.join(heads, "bucket").where("r > ra") \
        .select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    links, _ = materialize(_confirm(pairs, light, sets, percent, samples, sketch_floor), "nd-links", n=F.count(F.lit(1)))
    labels = components(links)
    # what is left of the larger buckets
    group = labels.groupBy("label").agg(F.count(F.lit(1)).alias("weight"))
    b = Window.partitionBy("bucket")

    def unsettled(df):
        return df.withColumn("lo", F.min("label").over(b)).withColumn("hi", F.max("label").over(b)).where("lo <> hi").drop("lo", "hi")

    left = unsettled(buckets.where(F.col("size") > small).drop("size").join(labels.join(group, "label"), "node", "left")
                     .select("node", "bucket", F.coalesce("label", "node").alias("label"), F.coalesce("weight", F.lit(1)).alias("weight")))
    left, st = materialize(left, "nd-left", n=F.count(F.lit(1)))
    if st["n"]:
        more = _blocks(left, unsettled, light, sets, percent)
        links = materialize(links.unionByName(more).distinct(), "nd-links")
        labels = components(links)
    return links, labels


def _blocks(left, unsettled, light, sets, percent):
    """Links ``a, b`` across components among the members of what is left of large buckets."""
    need = (F.col("n") + F.ceil(F.col("n") * percent / 100)) * percent  # with the smallest partner there can be
    live = left.join(_in_common(left, sets), "node").join(light.select("node", "n"), "node").where(F.col("common") * (100 + percent) >= need)
    order = Window.partitionBy("bucket").orderBy(F.desc("weight"), "label", "node")
    live = unsettled(live).withColumn("r", F.row_number().over(order)).withColumn("main", F.first("label").over(order))
    # in that order the largest component comes first, so the others are numbered from its end
    b = Window.partitionBy("bucket")
    live = live.withColumn("mains", F.count_if(F.col("label") == F.col("main")).over(b)).withColumn("size", F.count(F.lit(1)).over(b))
    live = materialize(live, "nd-live")
    last = F.floor((F.col("size") - F.col("mains") - 1) / BLOCK_SETS)
    own = live.where("r > mains").select(F.col("bucket").alias("s_bucket"), F.col("node").alias("s_node"), F.col("label").alias("s_label"), F.floor((F.col("r") - F.col("mains") - 1) / BLOCK_SETS).alias("s_block"),
                                         F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / PROBES))).alias("s_chunk"))
    probe = live.select("bucket", "node", "label", F.floor((F.col("r") - 1) / PROBES).alias("chunk"),
                        F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    own = own.join(sets.select(F.col("id").alias("s_node"), F.col("set").alias("s_set")), "s_node")
    probe = probe.join(sets.select(F.col("id").alias("node"), "set"), "node")

    def compare(s: pa.Table, p: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        if s.num_rows and p.num_rows:
            arr = [np.frombuffer(x.as_buffer(), np.uint64) for x in s["s_set"]]
            size = np.array(list(map(len, arr)))
            flat = np.concatenate(arr)
            by = np.argsort(flat, kind="stable")
            flat, owner = flat[by], np.repeat(np.arange(len(arr)), size)[by]
            node, label = s["s_node"].to_pylist(), np.array(s["s_label"].to_pylist())
            for x, lab, q in zip(p["node"].to_pylist(), p["label"].to_pylist(), p["set"]):
                q = np.frombuffer(q.as_buffer(), np.uint64)
                lo = np.searchsorted(flat, q)
                n = np.searchsorted(flat, q, side="right") - lo
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(arr))
                hit = np.flatnonzero((both * 100 >= (size + len(q) - both) * percent) & (label != lab))
                if len(hit):
                    _, one = np.unique(label[hit], return_index=True)  # one link to each other component
                    out += [(min(x, node[i]), max(x, node[i])) for i in hit[one]]
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return own.groupBy("s_bucket", "s_block", "s_chunk").cogroup(probe.groupBy("bucket", "block", "chunk")) \
        .applyInArrow(compare, "a long, b long").distinct()


def _in_common(left, sets):
    """node, common: how many of its shingles any other set in ``left`` has."""
    def each(batches):
        for b in batches:
            for i in range(b.num_rows):
                s = np.frombuffer(b.column(1)[i].as_buffer(), np.int64)
                for k in range(0, len(s), 50_000):
                    x = s[k:k + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), b.column(0)[i].as_py())), pa.array(x)], ["node", "s"])

    mine = sets.join(left.select(F.col("node").alias("id")).distinct(), "id").select("id", "set")
    shared = mine.mapInArrow(each, "node long, s long").groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node"))
    own = shared.where("c = 1").groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    return mine.select(F.col("id").alias("node"), (F.length("set") / 8).cast("long").alias("m")).join(own, "node", "left") \
        .select("node", (F.col("m") - F.coalesce("own", F.lit(0))).alias("common"))


def _confirm(pairs, light, sets, percent, samples, sketch_floor):
    a = light.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = light.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    near = pairs.join(a, "a").join(b, "b") \
        .where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) \
        .where(sketch_distance("sa", "sb") <= greatest_distance(sketch_floor, samples)).select("a", "b", "na", "nb")
    full = near.join(sets.select(F.col("id").alias("a"), F.col("set").alias("seta")), "a") \
        .join(sets.select(F.col("id").alias("b"), F.col("set").alias("setb")), "b") \
        .withColumn("both", overlap(F.col("seta"), F.col("setb")))
    return full.where(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent).select("a", "b")
