"""What the operators of this subpackage share: intermediate tables and text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import HOT_SHARE, materialize, stored, with_facts

__all__ = ["HOT_SHARE", "SPACE", "WORD", "fold", "materialize", "numbered", "ranked", "share_for", "stored", "text_or_empty", "uniform", "with_facts"]

#: The six ASCII white-space characters, and a word, as Java regular expressions.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fold(column: str | Column, divisor: int) -> Column:
    """crc32 of an id written as text, modulo ``divisor``; a null id counts as the text ''."""
    c = F.col(column) if isinstance(column, str) else column
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def uniform(name: str, seed: int) -> Column:
    """A hash of a column as a number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(F.col(name), F.lit(seed)), 11) / float(1 << 53)


def share_for(wanted: int, there: int) -> float:
    """A share of ``there`` rows that holds ``wanted`` of them with room to spare: tasks send no more on."""
    return min(1.0, (3 * wanted + 100) / max(there, 1))


def numbered(df: DataFrame, group: str, order: list[str], rows: int, name: str, per_task: int = 50_000) -> DataFrame:
    """A gapless number from 0 within each ``group`` in the order of ``order``, nulls first.

    Rows are dealt into ranges of about ``per_task`` rows; range counts are summed up before, and
    only a range is sorted at once. Rows that tie in all of ``order`` are dealt apart, too.
    """
    from pyspark.sql import Window as W

    ranges = max(1, -(-rows // per_task))
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    dealt = materialize(tied.repartitionByRange(ranges, group, *order, "_tie").withColumn("_b", F.spark_partition_id()), f"numbered-{name}")
    before = F.sum("_n").over(W.partitionBy("_g").orderBy("_gb").rowsBetween(W.unboundedPreceding, -1))
    starts = dealt.groupBy(F.col(group).alias("_g"), F.col("_b").alias("_gb")).agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("_g", "_gb", F.coalesce(before, F.lit(0)).alias("_start"))
    joined = dealt.join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_gb")))
    rank = F.row_number().over(W.partitionBy("_g", "_gb").orderBy(*order, "_tie"))
    return joined.withColumn(name, (F.col("_start") + rank - 1).cast("long")).drop("_b", "_g", "_gb", "_start", "_tie")


def ranked(df: DataFrame, value: str, name: str) -> DataFrame:
    """The distinct values that are not null with their share of smaller ones in [0, 1), in order."""
    values = df.where(F.col(value).isNotNull()).select(value).distinct().withColumn("_one", F.lit(0))
    values = materialize(values, f"values-{name}")
    n = values.count()
    return numbered(values, "_one", [value], n, name).select(value, (F.col(name) / max(n, 1)).alias(name))
