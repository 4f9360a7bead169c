"""File-name fields, vector text files, tables and CSV sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densitykit.sources.event_file import FILENAME_PATTERN


def path_fields(path: Column | str) -> list[Column]:
    """``type, series, run, board`` parsed from a file path (``S223r10b1.dat``)."""
    p = F.col(path) if isinstance(path, str) else path
    pat = FILENAME_PATTERN
    return [F.regexp_extract(p, pat, 1).alias("type"), F.regexp_extract(p, pat, 2).cast("int").alias("series"),
            F.regexp_extract(p, pat, 3).cast("int").alias("run"), F.regexp_extract(p, pat, 4).cast("int").alias("board")]


def vector_text(key: str, cols: Sequence[str]) -> Column:
    """A ``(key, [v0, v1, ..])`` line per row (the text a keyed-vector dump has)."""
    vals = F.concat_ws(", ", *[F.col(c).cast("string") for c in cols])
    return F.concat(F.lit("("), F.col(key).cast("string"), F.lit(", ["), vals, F.lit("])"))


def write_vectors_text(df: DataFrame, path: str, key: str, cols: Sequence[str]) -> None:
    """Keyed vectors as text lines."""
    df.select(vector_text(key, cols).alias("value")).write.mode("overwrite").text(path)


def save_table(df: DataFrame, name: str, path: str | None = None, mode: str = "append") -> DataFrame:
    """Create the table if absent and append (``saveAsTable``); ``path`` makes it an
    external table at that location. A JDBC target is the same call on ``df.write.jdbc``."""
    w = df.write.mode(mode)
    if path:
        w = w.option("path", path)
    w.saveAsTable(name)
    return df.sparkSession.table(name)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header line."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)
