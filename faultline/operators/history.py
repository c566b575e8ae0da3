"""What memory held: the value of any byte at any time, and what a flipped address would have met.

Every executed load and store tells the bytes of its place at its time. A flip of an address bit leads an
access to other bytes; what those held then is an as-of lookup by (group, scope, byte), cut into ranges as
``intervals.as_of`` is, over all accesses at once. The answer needs no liveness: it says which bits of a
value would differ, and the backward pass (``liveness``) asks whether those bits matter.

A byte that nothing has touched before is unknown, which counts as all of its bits differing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import as_of


def _byte(value: Column, k: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, (k * 8).cast("int")).bitwiseAND(F.lit(255))


def _bytes(rows: DataFrame, at: Column, *columns: str) -> DataFrame:
    """A row per byte of an access: ``columns``, address, k."""
    return rows.select(*columns, at.alias("_from"), F.explode(F.sequence(F.lit(0), F.least(F.col("size"), F.lit(8)).cast("int") - 1)).alias("k")).withColumn("address", F.col("_from") + F.col("k")).drop("_from")


def history(events: DataFrame, group: str) -> DataFrame:
    """group, scope, address, index, byte: what each executed access tells of each byte.

    events: group, index, kind, held, scope, addr, size, and ``moved``: the value that was loaded or stored.
    """
    told = events.where(F.col("kind").isin("load", "store") & F.col("held") & F.col("moved").isNotNull() & F.col("addr").isNotNull() & (F.col("size") > 0))
    rows = _bytes(told, F.col("addr"), group, "scope", "index", "moved")
    return rows.select(group, "scope", "address", "index", _byte(F.col("moved"), F.col("k")).cast("int").alias("byte"))


def _inside(at: Column, size: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether an access lies in one of the ranges; true where no range is known."""
    if not ranges:
        return F.lit(True)
    known = F.array(*[F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi")) for lo, hi in ranges])
    return F.exists(known, lambda r: (at >= r["lo"]) & (at + size <= r["hi"]))


def flips(events: DataFrame, group: str, ranges: list[tuple[int, int]] = (), bits: int = 32) -> DataFrame:
    """Per access whose address comes from a register (``base``) and per address bit: group, index, bit, outside, known, differs.

    outside: the flipped access lies in none of ``ranges``; known: all of its bytes have a history; differs: the bits
    of the moved value that differ from what is there, at and before a load, before a store.
    """
    return _differences(_targets(events, group, ranges, bits), history(events, group), group)


def _targets(events: DataFrame, group: str, ranges: list[tuple[int, int]], bits: int) -> DataFrame:
    rows = events.where(F.col("kind").isin("load", "store") & F.col("held") & F.col("base").isNotNull() & (F.col("size") > 0))
    flipped = F.col("addr").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit")))
    rows = rows.select(group, "scope", "index", "kind", "size", "moved", "addr", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit")).withColumn("target", flipped)
    return rows.withColumn("outside", ~_inside(F.col("target"), F.col("size").cast("long"), ranges))


def _differences(targets: DataFrame, told: DataFrame, group: str) -> DataFrame:
    asked = _bytes(targets.where(~F.col("outside") & (F.col("size") <= 8)), F.col("target"), group, "scope", "index", "kind", "bit", "moved")
    keys = [group, "scope", "address"]
    met = [as_of(asked.where(F.col("kind") == kind), told, keys, ["index"], "byte", strict=kind == "store") for kind in ("load", "store")]
    gap = F.when(F.col("byte").isNull(), F.lit(255).cast("long")).otherwise(_byte(F.col("moved"), F.col("k")).bitwiseXOR(F.col("byte").cast("long")))
    moved = F.call_function("shiftleft", F.coalesce(gap, F.lit(255).cast("long")), (F.col("k") * 8).cast("int"))
    found = met[0].unionByName(met[1]).groupBy(group, "index", "bit").agg(F.bool_and(F.col("byte").isNotNull() & F.col("moved").isNotNull()).alias("known"), F.bit_or(moved).alias("differs"))
    wide = targets.where(~F.col("outside") & (F.col("size") > 8)).select(group, "index", "bit", F.lit(False).alias("known"), F.lit(-1).cast("long").alias("differs"))
    none = targets.where("outside").select(group, "index", "bit", F.lit(True).alias("outside"), F.lit(False).alias("known"), F.lit(None).cast("long").alias("differs"))
    return none.unionByName(found.unionByName(wide).select(group, "index", "bit", F.lit(False).alias("outside"), "known", "differs"))


def overwritten(events: DataFrame, group: str) -> DataFrame:
    """Per store, executed or not: group, index, before: the bits in which memory differed from the stored value; fresh: the bits without a history."""
    stores = events.where((F.col("kind") == "store") & (F.col("size") > 0) & (F.col("size") <= 8))
    asked = _bytes(stores, F.col("addr"), group, "scope", "index", "moved")
    met = as_of(asked, history(events, group), [group, "scope", "address"], ["index"], "byte", strict=True)
    up = lambda c: F.call_function("shiftleft", c, (F.col("k") * 8).cast("int"))
    gap = F.coalesce(_byte(F.col("moved"), F.col("k")).bitwiseXOR(F.col("byte").cast("long")), F.lit(255).cast("long"))
    fresh = F.when(F.col("byte").isNull() | F.col("moved").isNull(), F.lit(255).cast("long")).otherwise(F.lit(0).cast("long"))
    return met.groupBy(group, "index").agg(F.bit_or(up(gap)).alias("before"), F.bit_or(up(fresh)).alias("fresh"))


def with_history(events: DataFrame, group: str, ranges: list[tuple[int, int]] = (), bits: int = 32) -> DataFrame:
    """``events`` with ``outside`` (mask of address bits), ``flips`` ({bit, known, differs} of the others), ``before`` and ``fresh``."""
    found = flips(events, group, ranges, bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    per = found.groupBy(group, "index").agg(F.bit_or(F.when(F.col("outside"), bit).otherwise(F.lit(0).cast("long"))).alias("outside"), F.array_sort(F.collect_list(F.when(~F.col("outside"), F.struct("bit", "known", "differs")))).alias("flips"))
    return events.join(per, [group, "index"], "left").join(overwritten(events, group), [group, "index"], "left")
