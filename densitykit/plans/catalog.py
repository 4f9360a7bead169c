"""Registry of named queries: ``name -> (spark_fn(spark, sf_dir) -> DataFrame, duckdb_sql | None)``.

Every query reads the given tables (or tables Spark derives from them) in full, but for `dbscan_e3`: E3 is a
projection of the embeddings to their first three of 64 coordinates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densitykit.plans import fixtures as fx
from densitykit.plans import oracles as osql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def r6(c) -> F.Column:
    """Doubles are compared rounded to 6 decimals on both sides."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# Import the query modules so that they register themselves.
from densitykit.plans import q_boxes, q_cluster, q_models, q_sources, q_stats, q_waves  # noqa: E402,F401
