"""Line dedup: repeated line runs from a suffix array over line ids (operator 8).

DataFrame and SQL functions only. A document is the sequence of its lines that hold a word
(blank lines are not counted and stay). A *run* is a stretch of consecutive such lines of one document.
A line is deleted if it lies in a run of at least ``min_words`` words that also occurs
earlier, in order of (doc_id, line). The first copy of every line always stays.

1. Only lines that occur twice or more can lie in a repeated run; the others drop out at once.
2. *Prefix doubling*: the rank of a suffix by its first 2^k lines is the place of the pair
   (rank of its first half, rank of the suffix 2^(k-1) lines on) among all such pairs. Suffixes
   whose prefix is unique drop out. Suffixes with one rank form an LCP interval of depth 2^k.
3. For a suffix, only depths around the threshold matter: the least number m of lines
   with ``min_words`` words, and the depths above m until the lines after the first one
   hold ``min_words`` words by themselves (from there on the next suffix covers the rest, as the
   longest earlier match shrinks by at most one line from one suffix to the next). The LCP interval
   of any depth t is named by two overlapping ranks of level floor(log2 t).
4. The least position in an interval is the first copy; every other suffix in it repeats t
   lines. The greatest such t is the suffix's reach, and a line is deleted if a suffix at or before
   it reaches beyond it.

No level beyond log2(min_words) is needed, whatever the length of the runs, because a line has
at least one word. Ranks and first copies come from pre-aggregated groups joined back, so a line or passage that
a third of all documents share is a join key that Spark can split, not one task's window.
The text is shuffled once, at the end, to the deletions of its document.

Edge cases: null text gives null text and no lines; an empty text has no lines; null ids come
first in the order; rows equal in id and text are one document (none deletes the other); a
document whose lines all go gets an empty text; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from densitykit.session import materialize

DOC = ["doc", "th"]


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, th, line (its number among all lines), q (among those with words), h1, h2, words."""
    t = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(t).alias("th"), F.split(t, "\n").alias("ls")) \
        .where("ls is not null") \
        .select(*DOC, F.posexplode("ls").alias("line", "s")) \
        .select(*DOC, "line", F.xxhash64("s").alias("h1"), F.hash("s").alias("h2"), F.regexp_count("s", F.lit(r"\S+")).alias("words")) \
        .where("words > 0")


def _ranked(groups: DataFrame, bucket: F.Column, order: list[str]) -> DataFrame:
    """Number the groups 0, 1, .. in order; ``bucket`` ascends with the order."""
    g = groups.withColumn("_b", bucket)
    sizes = g.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket of some 50,000 groups
    offs = sizes.select("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    return g.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(*order))) \
        .join(offs, "_b").withColumn("rank", (F.col("_o") + F.col("_r") - 1).cast("long")).drop("_b", "_c", "_r", "_o")


def suffix_ranks(lines: DataFrame, max_lines: int) -> list[DataFrame]:
    """Level k: ``doc, th, q, rank`` of the suffixes whose first 2^k lines occur twice or more,
    ranked by those lines; levels up to 2^k <= max_lines (fewer if none repeats)."""
    groups, st = materialize(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"),
                             "lines-repeated", n=F.count(F.lit(1)))
    n = st["n"]
    bits = max(1, (n // 50_000).bit_length())
    ranks = _ranked(groups, F.shiftright("h1", 64 - bits), ["h1", "h2"])
    level, st = materialize(lines.join(ranks, ["h1", "h2"]).select(*DOC, "line", "q", "words", "rank"), "lines-level-0",
                            n=F.count(F.lit(1)))
    levels, step = [level], 1
    while st["n"] and 2 * step <= max_lines:
        on = Window.partitionBy(*DOC).orderBy("q").rangeBetween(step, step)
        pairs = level.select(*DOC, "q", F.col("rank").alias("a"), F.max("rank").over(on).alias("b")).where("b is not null")
        pairs, _ = materialize(pairs, f"lines-pairs-{step}", n=F.count(F.lit(1)))
        width = max(1, n // max(1, n // 50_000))
        groups, gst = materialize(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"),
                                  f"lines-groups-{step}", n=F.count(F.lit(1)))
        ranks = _ranked(groups, F.floor(F.col("a") / width), ["a", "b"])
        level, st = materialize(pairs.join(ranks, ["a", "b"]).select(*DOC, "q", "rank"), f"lines-level-{2 * step}", n=F.count(F.lit(1)))
        if not st["n"]:
            break
        levels.append(level)
        n, step = gst["n"], 2 * step
    return levels


def _same_place(left: DataFrame, right: DataFrame, q: str) -> DataFrame:
    """``left`` with the other columns of the suffix of ``right`` at its document and ``q``; null ids are equal."""
    r = right.select(*(F.col(c).alias(f"_{c}") for c in (*DOC, "q")), *(c for c in right.columns if c not in (*DOC, "q")))
    return left.join(r, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th")) & (F.col(q) == F.col("_q"))) \
        .drop("_doc", "_th", "_q")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """doc, th (hash of its text), line, q, reach of every repeated line: ``reach`` lines from q on
    occur earlier (null: no run of ``min_words`` words from here does)."""
    order = Window.partitionBy(*DOC).orderBy("line")
    lines = _lines(docs, id_col, text_col).withColumns({"q": F.dense_rank().over(order) - 1, "before": F.lag("line").over(order)}) \
        .where("before is null or before <> line").drop("before")  # rows equal in id and text count once
    lines = materialize(lines, "lines")
    levels = suffix_ranks(lines, min_words + 1)
    base = levels[0]
    # the depths to look at: m, and beyond it while the lines after the first hold too few words
    ahead = Window.partitionBy(*DOC).orderBy("q").rangeBetween(0, min_words)
    # one pass over the lines ahead: n lines joined so far, their words, the depths met
    walk = F.expr(f"""aggregate(nx, struct(0 as n, 0L as total, true as live, array() :: array<int> as depths), (a, x) ->
        case when a.live and x.q - q = a.n then struct(
            a.n + 1 as n, a.total + x.words as total, a.total + x.words - words < {min_words} as live,
            case when a.total + x.words >= {min_words} and (a.total < {min_words} or a.total + x.words - words < {min_words})
                 then array_append(a.depths, a.n + 1) else a.depths end as depths)
        else struct(a.n as n, a.total as total, false as live, a.depths as depths) end, a -> a.depths)""")
    depths = base.withColumn("nx", F.collect_list(F.struct(F.col("q").cast("int").alias("q"), F.col("words").cast("long").alias("words"))).over(ahead)) \
        .withColumn("q", F.col("q").cast("int")).withColumn("depths", walk) \
        .select(*DOC, "q", F.explode("depths").alias("t")).withColumn("k", F.floor(F.log2("t") + 1e-9).cast("int"))
    depths = materialize(depths, "lines-depths")
    named = None
    for k, level in enumerate(levels):
        here = depths.where(F.col("k") == k)
        one = level.select(*DOC, "q", F.col("rank").alias("a"))
        part = _same_place(here, one, "q")
        if k:
            two = level.select(*DOC, "q", F.col("rank").alias("b"))
            part = _same_place(part.withColumn("q2", F.col("q") + F.col("t") - (1 << k)), two, "q2")
        else:
            part = part.withColumn("b", F.col("a"))
        part = part.select(*DOC, "q", "t", "a", "b")
        named = part if named is None else named.unionByName(part)
    named = materialize(named, "lines-intervals")
    first = named.groupBy("t", "a", "b").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(*DOC, "q")).alias("first")).where("c > 1")
    reach = named.join(first, ["t", "a", "b"]).where(~(F.struct(*DOC, "q").eqNullSafe(F.col("first")))) \
        .groupBy(*DOC, "q").agg(F.max("t").alias("reach"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*DOC, "q")]
    return base.alias("l").join(reach.alias("r"), same[0] & same[1] & same[2], "left") \
        .select("l.doc", "l.th", "l.line", "l.q", "r.reach")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """``docs`` with the later copies of repeated runs cut out of the text: all its columns, and
    n_lines (before), n_deleted."""
    runs = repeated_runs(docs, id_col, text_col, min_words)
    so_far = Window.partitionBy(*DOC).orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    gone = runs.withColumn("end", F.max(F.col("q") + F.col("reach")).over(so_far)).where("end > q") \
        .groupBy(F.col("doc").alias("_doc"), F.col("th").alias("_th")).agg(F.sort_array(F.collect_list("line")).alias("_gone"))
    gone = materialize(gone, "lines-gone")
    t = F.col(text_col).cast("string")
    own = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    src = docs.select(*own, F.col(id_col).cast("long").alias("_id"), F.xxhash64(t).alias("_h"))
    # by shuffle at every size: the deletions grow with the documents
    joined = src.join(gone.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_h") == F.col("_th")), "left")
    # the lines between one deleted line and the next
    rest = F.expr("""transform(array(struct(_lines, concat(array(-1), _gone, array(size(_lines))) as cuts)), x ->
        array_join(flatten(transform(sequence(0, size(x.cuts) - 2), i -> slice(x._lines, x.cuts[i] + 2, x.cuts[i + 1] - x.cuts[i] - 1))), '\n'))[0]""")
    out = joined.withColumn("_lines", F.split(t, "\n")).withColumn("_kept", F.when(F.col("_gone").isNull(), t).otherwise(rest))
    n_lines = F.when(t.isNull(), F.lit(0)).otherwise(F.size("_lines"))
    return out.select(*[F.col("_kept").alias(c) if c == text_col else F.col(c) for c in own], n_lines.alias("n_lines"),
                      F.coalesce(F.size("_gone"), F.lit(0)).alias("n_deleted"))
