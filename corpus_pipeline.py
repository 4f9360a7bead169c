"""Corpus pipeline over ``documents``: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of ``documents``; the last returns
the pieces of the packed sequences.

Null or letterless texts go in the first stage. Rows equal in id and text are one document: the line
stage cuts neither for the other, and the near-duplicate stage keeps one of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densitykit.llm import decontaminate, langid, line_dedup, near_dup, packing
from densitykit.llm.common import table
from densitykit.llm.queries import tokenizer_file
from densitykit.session import ensure_checkpoint_dir, materialize, ship_package

#: Documents whose best language has a lower mean probability are rejected.
MIN_SCORE = 0.3


#: Texts that Arrow hands to Python at once, in the JVM, on the way and in the worker each.
BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """At most ``BATCH`` texts in an Arrow batch from here on, if the session allows more."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is told (operator 6); text without letters and text of no
    likely language go."""
    ship_package(spark)
    small_batches(spark)
    named = langid.predict(docs, langid.fit(docs), keep_text=True)
    return named.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut later copies of line runs of 50 words or more (operator 8); documents of which nothing is
    left go."""
    out = line_dedup.dedup_lines(docs, min_words=50)
    out = out.where((F.col("n_deleted") == 0) | (F.length(F.trim("text")) > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group (operator 4): 5-word shingles, similarity 0.8."""
    ship_package(spark)
    small_batches(spark)
    groups = materialize(near_dup.near_duplicates(docs, width=5, percent=80).select("doc_id", "text_hash", "kept"), "pipeline-groups")
    here = docs.withColumn("_h", F.xxhash64("text"))
    gone = groups.where("not kept").select(F.col("doc_id").alias("_id"), "text_hash").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("text_hash"))
    out = here.join(gone, same, "left_anti")
    twice = groups.where("kept").groupBy(F.col("doc_id").alias("_id"), "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    if not twice.isEmpty():  # repeated rows
        out = out.join(twice, same, "left_anti").unionByName(out.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"]))
    return out.select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark passage (operator 7)."""
    ship_package(spark)
    small_batches(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens (operator 3)."""
    ship_package(spark)
    small_batches(spark)
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), end_id=1, seq_len=2048)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("packing", pack)]

#: The network, MinHash and the tokenizer can't be put into SQL; the pipeline is tested stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written below the session's checkpoint folder and read again."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex[:12]}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
