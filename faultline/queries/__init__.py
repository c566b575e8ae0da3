"""Registered queries over the standard tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Events as a trace, in SQL: ``t``.
TRACE_SQL = """t AS (
    SELECT epoch_us(ts) AS cycle, event_id AS idx, user_id AS thread, event_type AS kind, value,
           CAST(json_extract_string(props, '$.k') AS BIGINT) AS addr
    FROM events)"""


def query(sql: str | None = None):
    """Register a function of a table reader; ``sql`` gives the same rows."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def trace(read) -> DataFrame:
    """Events as a trace: cycle, idx (a total order), thread, kind, value, addr."""
    return read("events").select(
        F.unix_micros(F.col("ts").cast("timestamp")).alias("cycle"), F.col("event_id").alias("idx"), F.col("user_id").alias("thread"), F.col("event_type").alias("kind"), "value",
        F.get_json_object("props", "$.k").cast("long").alias("addr"),
    )


from . import campaign, influence, readers, scalars, statistics, text, traces  # noqa: E402, F401
