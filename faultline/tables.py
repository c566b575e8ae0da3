"""Intermediate tables in the shared folder, and joins of many rows with one fact per key."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent on a local master (tests on one machine), a temporary folder is made;
    on a cluster, whose executors would not see it, the setting is asked for.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="faultline-"))
    return _own_folder[0]


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``materialize``, with the path of the written table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    It cuts lineage like ``checkpoint()``, survives lost executors, and gives the
    planner file sizes, so that a small result is broadcast only when its size allows it.
    """
    return stored(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that ``stored`` has written and nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: A key is hot if it holds more than this share of all rows: at most 1 / HOT_SHARE keys are.
HOT_SHARE = 0.001


def with_facts(rows: DataFrame, facts: DataFrame, key: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row per value of ``key`` (never null).

    ``n``: the column of facts that counts the rows of the key, ``total``: all rows. Keys with
    over ``HOT_SHARE`` of all rows, at most 1 / HOT_SHARE, are broadcast, so their rows are not
    shuffled; the others meet by hash in a merge join, never by a broadcast of whichever side
    happens to compress well.
    """
    hot = F.col(n) > total * HOT_SHARE
    few = facts.where(hot).select(F.col(key).alias("_hot"), F.struct(*[c for c in facts.columns if c != key]).alias("_fact"))
    marked = rows.join(F.broadcast(few), rows[key] == few["_hot"], "left")
    names = [c for c in facts.columns if c != key]
    met = marked.where("_hot is not null").select(*rows.columns, *[F.col(f"_fact.{c}").alias(c) for c in names])
    others = marked.where("_hot is null").select(*rows.columns).hint("merge").join(facts.where(~hot), key, how)
    return met.unionByName(others.select(*rows.columns, *names))
