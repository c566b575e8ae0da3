"""Lifetimes of values: from accesses to versions (key, version, start, end, last_read)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def byte_accesses(events: DataFrame, addr: str, size: str, line: int | None = None) -> DataFrame:
    """One row per byte of an access; with ``line``, also its line and offset."""
    out = events.withColumn("byte", F.explode(F.sequence(F.col(addr), F.col(addr) + F.col(size) - 1)))
    return out if line is None else out.withColumns({"line": F.floor(F.col("byte") / line), "offset": F.pmod(F.col("byte"), F.lit(line))})


def versions(accesses: DataFrame, keys: list[str], cycle: str, order: str, is_write: Column, domain_start: Column | None = None) -> DataFrame:
    """A write closes the version before it and opens the next; reads belong to the open one.

    In one event reads come before the write. Reads before any write open version 0 at
    ``domain_start``; without it such reads are left out. The last version ends at null.
    """
    w = W.partitionBy(*keys).orderBy(cycle, order, "_w")
    rows = accesses.withColumn("_w", is_write.cast("int"))
    rows = rows.withColumn("version", F.sum("_w").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)).cast("long"))
    opened = F.min(F.when(F.col("_w") == 1, F.col(cycle)))
    made = rows.groupBy(*keys, "version").agg(opened.alias("start"), F.max(F.when(F.col("_w") == 0, F.col(cycle))).alias("last_read"), F.count_if(F.col("_w") == 0).alias("n_reads"))
    if domain_start is None:
        made = made.where("version > 0")
    else:
        made = made.withColumn("start", F.coalesce("start", domain_start))
    return made.withColumn("end", F.lead("start").over(W.partitionBy(*keys).orderBy("version")))


def liveness_class(cycle: Column, last_read: Column) -> Column:
    """dcr while a read is still to come (strictly before the last read), else benign."""
    return F.when(cycle < last_read, "dcr").otherwise("benign")
