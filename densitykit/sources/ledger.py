"""Repeat-safe load of event files into a table.

The table is a folder: ``data/load=<id>/`` holds the rows of one load and ``ledger/load=<id>/`` its entries ``file, size,
first, last, load`` (event positions, inclusive). Rows are written first and the ledger entry last, by Spark's own commit;
reading takes the loads that have a committed entry. So a load that was lost half-way has no effect, a file already
loaded at its size is skipped, and of a file that has grown only the new events are added. One loader at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densitykit.sources.event_file import EVENT_SCHEMA, read_event_files, read_events

ENTRY = "file STRING, size BIGINT, first BIGINT, last BIGINT"


def _loads(spark, table: str) -> list[str]:
    """Ids of the loads whose ledger entry was committed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/ledger")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    here = [s.getPath() for s in fs.listStatus(path)]
    done = [p for p in here if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(p.getName().removeprefix("load=") for p in done)


def ledger(spark, table: str) -> DataFrame:
    """``file, size, first, last, load`` of everything loaded."""
    loads = _loads(spark, table.rstrip("/"))
    if not loads:
        return spark.createDataFrame([], ENTRY + ", load STRING")
    entries = spark.read.schema(ENTRY + ", load STRING").option("basePath", f"{table.rstrip('/')}/ledger")
    return entries.parquet(*[f"{table.rstrip('/')}/ledger/load={x}" for x in loads])


def loaded_events(spark, table: str) -> DataFrame:
    """The events of all committed loads."""
    loads = _loads(spark, table.rstrip("/"))
    if not loads:
        return spark.createDataFrame([], EVENT_SCHEMA)
    return spark.read.schema(EVENT_SCHEMA).parquet(*[f"{table.rstrip('/')}/data/load={x}" for x in loads])


def load_events(spark, source: str, table: str) -> int:
    """Add what ``source`` (files, folders or patterns) has beyond the ledger of ``table``; the number of events added."""
    table = table.rstrip("/")
    known = ledger(spark, table).groupBy("file").agg(F.max("last").alias("have"), F.max("size").alias("seen"))
    files = read_event_files(spark, source).select(F.col("path").alias("file"), "size", "n_events").join(known, "file", "left")
    new = files.where(F.col("seen").isNull() | (F.col("size") > F.col("seen"))) \
        .select("file", "size", (F.coalesce("have", F.lit(-1)) + 1).alias("first"), (F.col("n_events") - 1).alias("last")).where("first <= last")
    entries = [tuple(r) for r in new.collect()]  # one row a new file
    if not entries:
        return 0
    load = uuid.uuid4().hex
    wanted = spark.createDataFrame(entries, ENTRY)
    rows = read_events(spark, ",".join(e[0] for e in entries))
    if any(e[2] for e in entries):  # files that have grown
        rows = rows.join(wanted.select(F.col("file").alias("path"), "first"), "path").where("event_pos >= first").drop("first")
    rows.write.mode("error").parquet(f"{table}/data/load={load}")
    wanted.coalesce(1).write.mode("error").parquet(f"{table}/ledger/load={load}")
    return sum(e[3] - e[2] + 1 for e in entries)
