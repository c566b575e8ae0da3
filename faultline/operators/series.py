"""Ordered series: derivatives, segments, stitching, bins, runs, reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def derivative(df: DataFrame, keys: list[str], x: str, y: str, first_step: bool = True) -> DataFrame:
    """dy / dx of a counter; where it falls, it was reset and counts from 0.

    With ``first_step`` the step is that of the first pair throughout, else each pair's own.
    """
    w = W.partitionBy(*keys).orderBy(x)
    out = df.withColumns({"_y": F.lag(y).over(w), "_x": F.lag(x).over(w)})
    rise = F.when(F.col(y) < F.col("_y"), F.col(y)).otherwise(F.col(y) - F.col("_y"))
    step = F.col(x) - F.col("_x")
    if first_step:
        step = F.first(step, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return out.withColumn("rate", F.try_divide(rise.cast("double"), step.cast("double"))).drop("_y", "_x")


def segments(df: DataFrame, keys: list[str], order: list[str], x: str) -> DataFrame:
    """A new segment starts where x does not increase."""
    w = W.partitionBy(*keys).orderBy(*order)
    fresh = F.when(F.col(x) <= F.lag(x).over(w), 1).otherwise(0)
    return df.withColumn("_new", fresh).withColumn("segment", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)).cast("long")).drop("_new")


def stitched(df: DataFrame, keys: list[str], order: list[str], x: str) -> DataFrame:
    """x continued over segments: each starts where the one before ended.

    Segment ends are aggregated first, so the running sum sees one row per segment.
    """
    cut = segments(df, keys, order, x)
    ends = cut.groupBy(*keys, "segment").agg(F.max(x).alias("_end"))
    before = F.sum("_end").over(W.partitionBy(*keys).orderBy("segment").rowsBetween(W.unboundedPreceding, -1))
    ends = ends.withColumn("_offset", F.coalesce(before, F.lit(0))).drop("_end")
    return cut.join(ends, [*keys, "segment"]).withColumn("stitched", F.col(x) + F.col("_offset")).drop("_offset")


def ranged(df: DataFrame, at: str, ranges: int = 256) -> DataFrame:
    """``df`` with ``_part``: in which of about equally full ranges of ``at`` each row lies.

    The edges, at most ``ranges``, come from an approximate quantile over all rows; they only
    place rows, results do not depend on them. So a window over few keys is cut into ranges.
    """
    edges = df.select(F.percentile_approx(F.col(at).cast("double"), [i / ranges for i in range(1, ranges)], 10_000).alias("e")).first()["e"] or []
    places = F.array(*[F.lit(float(e)) for e in sorted(set(edges))]).cast("array<double>")
    return df.withColumn("_part", F.size(F.filter(places, lambda e: e < F.col(at).cast("double"))))


def running(df: DataFrame, keys: list[str], at: str, value: Column, name: str, order: list[str] = (), ranges: int = 256) -> DataFrame:
    """The sum of ``value`` up to and including each row, in the order of ``at`` and ``order``: totals of
    ranges, at most ``ranges`` a key, are summed up first, then each range by itself."""
    dealt = ranged(df.withColumn("_value", value), at, ranges)
    before = F.sum("_total").over(W.partitionBy(*[f"_of_{k}" for k in keys]).orderBy("_at").rowsBetween(W.unboundedPreceding, -1))
    totals = dealt.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_part").alias("_at")).agg(F.sum("_value").alias("_total"))
    totals = totals.withColumn("_before", F.coalesce(before, F.lit(0)))
    same = F.col("_part") == F.col("_at")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    inside = F.sum("_value").over(W.partitionBy(*keys, "_part").orderBy(at, *order).rowsBetween(W.unboundedPreceding, W.currentRow))
    out = dealt.join(totals, same).withColumn(name, F.col("_before") + inside)
    return out.drop("_value", "_part", "_at", "_total", "_before", *[f"_of_{k}" for k in keys])


def binned(df: DataFrame, keys: list[str], order: list[str], value: str, bins: int = 512) -> DataFrame:
    """At most ``bins`` bins of equally many points in a row, with integer means."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    at = running(df, keys, order[0], F.lit(1), "_i", order[1:]).join(sizes, keys)
    at = at.withColumn("bin", F.floor((F.col("_i") - 1) / F.ceil(F.col("_n") / bins)))
    return at.groupBy(*keys, "bin").agg(F.floor(F.sum(value) / F.count(F.lit(1))).cast("long").alias("mean"), F.count(F.lit(1)).alias("n"))


def runs(df: DataFrame, keys: list[str], value: str, position: str | None = None) -> DataFrame:
    """Run-length code of consecutive integers, in value order or in the order of ``position``."""
    w = W.partitionBy(*keys).orderBy(position or value)
    at = df.withColumn("_island", F.col(value) - F.row_number().over(w))
    if position:  # equal differences may come back later: number the changes
        change = F.when(F.col(value) != F.lag(value).over(w) + 1, 1).otherwise(0)
        at = df.withColumn("_c", change).withColumn("_island", F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return at.groupBy(*keys, "_island").agg(F.min(value).alias("start"), F.count(F.lit(1)).alias("count")).drop("_island")


def blocks(df: DataFrame, keys: list[str], order: list[str], inside: Column, least: int = 2) -> DataFrame:
    """Maximal runs of rows for which ``inside`` holds, at least ``least`` long."""
    w = W.partitionBy(*keys).orderBy(*order)
    at = df.withColumns({"_in": inside.cast("int"), "_i": F.row_number().over(w)})
    at = at.withColumn("_island", F.sum(1 - F.col("_in")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).where("_in = 1")
    return at.groupBy(*keys, "_island").agg(F.min("_i").alias("first"), F.count(F.lit(1)).alias("length")).where(F.col("length") >= least).drop("_island")


def prefix(df: DataFrame, keys: list[str], at: str, weight: str) -> DataFrame:
    """Weight up to and including each row."""
    return running(df, keys, at, F.col(weight), "upto")


def range_weight(weights: DataFrame, ranges: DataFrame, keys: list[str], at: str, weight: str, lo: str, hi: str) -> DataFrame:
    """``ranges`` (keys, lo, hi, ...) with the weight of the rows of the key in [lo, hi): the weight below hi less that below lo.

    Both ends and all rows are summed up in one running total, in which an end comes before the
    rows at its place and weighs nothing.
    """
    named = ranges.withColumn("_range", F.monotonically_increasing_id())
    rest = [c for c in named.columns if c not in keys]
    ends = named.select(*keys, F.struct(*rest).alias("_row"), F.explode(F.array(F.struct(F.col(lo).alias("x"), F.lit(-1).alias("_sign")), F.struct(F.col(hi).alias("x"), F.lit(1).alias("_sign")))).alias("_e"))
    ends = ends.select(*keys, F.col("_e.x").cast("long").alias("_x"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_w"), "_row", F.col("_e._sign").alias("_sign"))
    rows = weights.select(*keys, F.col(at).cast("long").alias("_x"), F.lit(1).alias("_kind"), F.col(weight).cast("long").alias("_w"), F.lit(None).alias("_row"), F.lit(None).alias("_sign"))
    summed = running(ends.unionByName(rows), keys, "_x", F.col("_w"), "_upto", ["_kind"]).where("_kind = 0")
    return summed.groupBy(*keys, "_row").agg(F.sum(F.col("_upto") * F.col("_sign")).alias("range_weight")).select(*keys, "_row.*", "range_weight").drop("_range")


def vector(text: Column, row: str, split_zeros: bool = True) -> list[Column]:
    """Values of a printed vector with their positions, after a leading 0."""
    values = F.filter(F.split(F.trim(text), r"\s+"), lambda v: v != "")
    return [F.posexplode(F.concat(F.array(F.lit("0")), values) if split_zeros else values).alias("position", row)]


def sparse(values: Column) -> Column:
    """Triples (i, j, value) from a flat list of numbers in threes."""
    at = lambda k, i: F.element_at(values, k * 3 + i)
    count = F.floor(F.size(values) / 3).cast("int")
    triples = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda k: F.struct(at(k, 1).alias("i"), at(k, 2).alias("j"), at(k, 3).alias("value")))
    return F.when(count > 0, triples)


def indexed(values: Column, names: list[str]) -> list[Column]:
    """The first numbers of a flat list by ``names``, as keys, and the rest as the vector ``values``; null where there is no rest."""
    keys = [F.get(values, F.lit(i)).alias(n) for i, n in enumerate(names)]
    rest = F.when(F.size(values) > len(names), F.slice(values, len(names) + 1, F.greatest(F.size(values) - len(names), F.lit(1))))
    return [*keys, rest.alias("values")]


def padded_left(df: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """Series of unequal length aligned at their ends, missing starts filled with 0."""
    n = F.max(position)
    sizes = df.groupBy(*keys).agg((n + 1).alias("_n"))
    most = sizes.agg(F.max("_n")).first()[0] or 0
    moved = df.join(sizes, keys).withColumn(position, F.col(position) + most - F.col("_n")).select(*keys, position, value)
    fill = sizes.where(F.col("_n") < most).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), (most - F.col("_n") - 1).cast("long"))).alias(position), F.lit(0).cast(df.schema[value].dataType).alias(value))
    return moved.unionByName(fill)


def with_leading_zero(df: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """The series moved on by one position, with a 0 at the start."""
    zero = df.select(*keys).distinct().select(*keys, F.lit(0).cast(df.schema[position].dataType).alias(position), F.lit(0).cast(df.schema[value].dataType).alias(value))
    return df.select(*keys, (F.col(position) + 1).cast(df.schema[position].dataType).alias(position), value).unionByName(zero)


def is_sorted(df: DataFrame, keys: list[str], position: str, order: list[str]) -> DataFrame:
    """Per key whether rows in the order of ``position`` are sorted by ``order``."""
    w = W.partitionBy(*keys).orderBy(position)
    worse = F.struct(*order) < F.lag(F.struct(*order)).over(w)
    return df.withColumn("_worse", worse).groupBy(*keys).agg((~F.bool_or(F.coalesce("_worse", F.lit(False)))).alias("is_sorted"))


def rotated(df: DataFrame, keys: list[str], slot: str, last: str, slots: int) -> DataFrame:
    """Round robin: the rank of each slot when turns start after the last one served."""
    turn = F.pmod(F.col(slot) - F.col(last) - 1, F.lit(slots))
    return df.withColumn("turn", F.row_number().over(W.partitionBy(*keys).orderBy(turn, slot)))


def oldest_first(df: DataFrame, keys: list[str], slot: str, last: str, age: str) -> DataFrame:
    """Greedy then oldest: the last one served, then by age."""
    return df.withColumn("turn", F.row_number().over(W.partitionBy(*keys).orderBy(F.when(F.col(slot) == F.col(last), 0).otherwise(1), age, slot)))
