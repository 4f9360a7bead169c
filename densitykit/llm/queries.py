"""One registered query per operator: each applies it, with production parameters, to the
whole of its table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densitykit.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer file on this machine (the same on every executor)."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-plane token files of all documents, read back."""
    from densitykit.llm.token_files import read_documents, write_token_files

    files = write_token_files(table(spark, sf_dir, "documents"), "doc_id", "text",
                              tokenizer_file("byte_bpe_50k.json"), end_id=2)
    return read_documents(files).withColumnRenamed("key", "doc_id")


@register("op4_near_duplicates")
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: 4-word shingles, similarity 0.8."""
    from densitykit.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


@register("op7_decontaminate")
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item or a passage of one, with the best overlap."""
    from densitykit.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op1_shards")
def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near-equal bytes, equal texts together."""
    from densitykit.llm.shards import shard

    return shard(table(spark, sf_dir, "documents"), n_shards=8) \
        .withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


@register("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    from densitykit.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1, seq_len=2048)


@register("op8_line_dedup")
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the later copies of line runs of 50 words or more."""
    from densitykit.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents"), min_words=50) \
        .select("doc_id", "text", "n_lines", "n_deleted")


@register("op10_fingerprints")
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    from densitykit.llm.fingerprints import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


@register("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents; documents with crc32(doc_id as text) mod 4 = 2 are held out."""
    from densitykit.llm import langid

    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    net = langid.fit(docs.where(~held))
    return langid.predict(docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text"), net)


@register("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of all documents."""
    from densitykit.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.predict(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@register("op5_page_text")
def op5_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    from densitykit.llm import page_text

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return page_text.page_text(pages, page_text.fit(pages))


@register("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable embeddings on their first 32 principal directions, whitened."""
    from densitykit.llm import whitening

    vectors = table(spark, sf_dir, "embeddings")
    return whitening.apply(vectors, whitening.fit(vectors, components=32))


@register("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic word runs of all documents; a tenth of them (by crc32 of the id) have a stretch repeated first."""
    from densitykit.llm.periodic import periodic_runs

    found = periodic_runs(repeated_tails(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.expr("""case when size(runs) > 0 then aggregate(runs, runs[0],
        (a, r) -> if(r.length * a.period > a.length * r.period, r, a)) end""")  # in order of start, then period
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words")


def repeated_tails(docs: DataFrame) -> DataFrame:
    """Documents whose crc32 of the id ends in 0 get, from word ``a`` on, the words from ``a`` again and again with
    period ``p``; a null id leaves its text as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = F.expr("filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')")
    parts = docs.withColumn("_g", F.when(h % 10 == 0, F.floor(h / 10))) \
        .withColumn("_w", F.when(F.col("_g").isNotNull(), split)).withColumn("_n", F.size("_w")) \
        .withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n"))) \
        .withColumn("_p", F.expr("cast(1 + (_n - _a) div (3 + _g % 8) as int)"))
    told = F.expr("concat_ws(' ', slice(_w, 1, cast(_a as int)), transform(sequence(0, cast(_n - _a - 1 as int)), i -> _w[cast(_a as int) + i % _p]))")
    return parts.withColumn("text", F.when(F.col("_a").isNotNull(), told).otherwise(F.col("text"))).select(*docs.columns)


@register("op12_warc", """
    with p as (select page_id, coalesce(html, '') h, strlen(coalesce(html, '')) n from pages),
    o as (select *, row_number() over (partition by h order by page_id nulls last) place,
                 min(page_id) over (partition by h) head from p)
    select page_id, n payload_bytes, sha256(h) payload_digest,
           case when n >= 100 and place > 1 then 'revisit' else 'response' end record_type,
           case when n >= 100 and place > 1 then head end refers_to from o""")
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC archives, read back."""
    from densitykit.llm.warc import read_warc, write_warc

    folder = write_warc(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return read_warc(spark, folder).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
