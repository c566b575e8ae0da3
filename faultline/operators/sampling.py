"""Sampling spaces and campaigns: draws are rows, classification is a join."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def python_draws(spark: SparkSession, n: int, bounds: list[int], seed: int = 2026) -> DataFrame:
    """(trial, x0, x1, ...): draws of Python's generator, in its order; ``n`` is a campaign's size."""
    rng = random.Random(seed)
    rows = [(i, *(rng.randrange(b) for b in bounds)) for i in range(n)]
    return spark.createDataFrame(rows, ", ".join(["trial long", *(f"x{k} long" for k in range(len(bounds)))]))


def lcg_draws(spark: SparkSession, n: int, seed: int, a: int = 1103515245, c: int = 12345, m: int = 1 << 31) -> DataFrame:
    """(trial, value) of a linear congruential generator."""
    rows = []
    for i in range(n):
        seed = (a * seed + c) % m
        rows.append((i, seed))
    return spark.createDataFrame(rows, "trial long, value long")


def hash_draws(spark: SparkSession, n: int, bounds: list[int], prime: int = 2654435761) -> DataFrame:
    """Draws that SQL can repeat: a multiplicative hash of the trial's number."""
    draws = [F.pmod(F.pmod(F.col("id") * prime + k * 40503, F.lit(1 << 32)), F.lit(b)).alias(f"x{k}") for k, b in enumerate(bounds)]
    return spark.range(n).select(F.col("id").alias("trial"), *draws)


def weighted_pick(draws: DataFrame, weights: DataFrame, pick: str, at: str, weight: str, ranges: int = 256) -> DataFrame:
    """The row of ``weights`` whose running weight first exceeds each pick (null if none does).

    Rows are cut into ``ranges`` of about equal count. Range totals, a bounded list, are summed
    on the driver and place each pick into its range; only a range is sorted at once, in which
    picks and running weights meet in one as-of pass.
    """
    edges = weights.select(F.percentile_approx(at, [i / ranges for i in range(1, ranges)], 10_000).alias("e")).first()["e"] or []
    edges = sorted(set(edges))
    part = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col(at))) if edges else F.lit(0)
    dealt = weights.withColumn("_part", part.cast("long"))
    totals = {r["_part"]: r["w"] for r in dealt.groupBy("_part").agg(F.sum(weight).alias("w")).collect()}
    starts, run = [], 0
    for k in range(len(edges) + 1):
        starts.append(run)
        run += totals.get(k) or 0
    begin = F.array(*[F.lit(s).cast("double") for s in starts])
    upto = F.sum(weight).over(W.partitionBy("_part").orderBy(at).rowsBetween(W.unboundedPreceding, W.currentRow)) + F.element_at(begin, (F.col("_part") + 1).cast("int"))
    marks = dealt.select("_part", upto.cast("double").alias("_at"), F.lit(0).alias("_draw"), F.struct(F.col(at)).alias("_mark"), *[F.lit(None).alias(c) for c in draws.columns])
    # a range without weight holds no pick: picks go to the last range that starts at or before them
    held = [k for k in range(len(starts)) if totals.get(k)]
    home = F.element_at(F.array(*[F.lit(k).cast("long") for k in held or [0]]), F.greatest(F.lit(1), F.size(F.filter(F.array(*[F.lit(float(starts[k])) for k in held or [0]]), lambda s: s <= F.col(pick)))))
    picks = draws.select(home.alias("_part"), F.col(pick).cast("double").alias("_at"), F.lit(1).alias("_draw"), F.lit(None).alias("_mark"), *draws.columns)
    order = W.partitionBy("_part").orderBy(F.desc("_at"), F.desc("_draw"), F.desc("_mark")).rowsBetween(W.unboundedPreceding, W.currentRow)
    both = marks.unionByName(picks).withColumn("_found", F.last("_mark", ignorenulls=True).over(order))
    return both.where("_draw = 1").select(*draws.columns, F.col(f"_found.{at}").alias(at))


def evenly_spaced(domains: DataFrame, n: str, most: str, block: int = 4096) -> DataFrame:
    """(columns of ``domains``, i, cycle): per domain ``n`` numbers from 0 to ``most``, evenly spaced and cut off.

    Numbers are made block by block, so a domain of any size is dealt into small rows; one that asks for none has none.
    """
    blocks = domains.where(F.col(n) > 0).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / block))))
    numbers = F.sequence(F.col("_b") * block, F.least(F.col("_b") * block + (block - 1), F.col(n) - 1))
    cycle = F.expr(f"i * `{most}` div greatest(`{n}` - 1, 1)")
    return blocks.withColumn("i", F.explode(numbers)).select(*domains.columns, "i", cycle.alias("cycle"))


def domain_bits(cycles: Column, units: Column, bits: Column) -> Column:
    return cycles * units * bits


def cache_bits(sets: int, ways: int, line: int, tag_bits: int = 57) -> int:
    """Bits of a cache with its tags."""
    return sets * ways * (line * 8 + tag_bits)


def _log2(x: Column) -> Column:
    """The floor of log2 of a positive number."""
    return F.length(F.bin(x.cast("long"))) - 1


def derived_tag_bits(cache: Column, address_bits: int = 64) -> Column:
    """Tag bits of a cache {sets, line, ways}: the address less the bits of line offset and set; 0 without a geometry."""
    known = (cache["sets"] > 0) & (cache["line"] > 0)
    return F.when(F.coalesce(known, F.lit(False)), F.greatest(F.lit(0), F.lit(address_bits) - _log2(cache["line"]) - _log2(cache["sets"]))).otherwise(0)


def geometry_bits(cache: Column, tag_bits: Column) -> Column:
    """Bits of a cache {sets, line, ways} with the tags of its lines; 0 without a geometry."""
    known = (cache["sets"] > 0) & (cache["line"] > 0) & (cache["ways"] > 0)
    return F.when(F.coalesce(known, F.lit(False)), cache["sets"].cast("long") * cache["ways"] * (cache["line"] * 8 + tag_bits)).otherwise(F.lit(0).cast("long"))


def component_domains(apps: DataFrame, keys: list[str]) -> DataFrame:
    """The sampling space of each component: keys, component, seeds, bits (of a seed), total (over all cycles and seeds).

    apps: keys, cycles, threads, blocks, shaders, shared_seen, registers, datatype_bits, l1d and l2 ({sets, line, ways}),
    memories, partitions, and what a program states itself, null or 0 where it does not: smem_bits, l1d_bits, l2_bits, tag_bits.
    Registers are drawn per thread, shared memory per block (a program that never touches it has none; one that
    does has a bit at least), the first cache per core, the second once. Stated sizes come before geometry. The tags
    of both caches follow from the first cache's geometry.
    """
    stated = lambda c: F.when(F.col(c) > 0, F.col(c))
    rows = apps.withColumn("_tag", F.coalesce(stated("tag_bits"), derived_tag_bits(F.col("l1d"))))
    l2 = geometry_bits(F.col("l2"), F.col("_tag")) * F.greatest(F.col("memories"), F.lit(1)) * F.greatest(F.col("partitions"), F.lit(1))
    parts = {
        "rf": (F.col("threads"), F.col("registers") * F.coalesce(stated("datatype_bits"), F.lit(32))),
        "smem_rf": (F.col("blocks"), F.when(F.coalesce("shared_seen", F.lit(False)), F.greatest(F.coalesce("smem_bits", F.lit(0)), F.lit(1))).otherwise(0)),
        "l1d": (F.greatest(F.col("shaders"), F.lit(1)), F.coalesce(stated("l1d_bits"), geometry_bits(F.col("l1d"), F.col("_tag")))),
        "l2": (F.lit(1), F.coalesce(stated("l2_bits"), l2)),
    }
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("component"), seeds.cast("long").alias("seeds"), bits.cast("long").alias("bits")) for n, (seeds, bits) in parts.items()]))
    out = rows.select(*keys, "cycles", each.alias("c")).select(*keys, "cycles", "c.*")
    total = F.col("cycles").cast("decimal(19,0)") * F.col("seeds").cast("decimal(12,0)")
    return out.select(*keys, "component", "seeds", "bits", (total.cast("decimal(25,0)") * F.col("bits").cast("decimal(12,0)")).cast("decimal(38,0)").alias("total"))


def decode_tag_first(bit: Column, tag_bits: int = 57) -> tuple[Column, Column]:
    """(is tag, data bit) where a line's tag comes before its data."""
    return bit < tag_bits, F.greatest(bit - tag_bits, F.lit(0))


def decode_data_first(bit: Column, line: int) -> tuple[Column, Column]:
    """(is tag, data bit) where a line's data come before its tag."""
    return bit >= line * 8, bit


def predicted(df: DataFrame, keys: list[str], kind: str, sic: str | None = None) -> DataFrame:
    """Rates of the classes, and masked, sdc and due from them: sdc is dcr, weighted by ``sic`` if given."""
    n = F.count(F.lit(1)).cast("double")
    dcr = F.count_if(F.col(kind) == "dcr") / n
    sdc = F.sum(F.when(F.col(kind) == "dcr", F.col(sic)).otherwise(0.0)) / n if sic else dcr
    rates = [(F.count_if(F.col(kind) == c) / n).alias(f"{c}_rate") for c in ("benign", "dcr", "ebc")]
    return df.groupBy(*keys).agg(*rates, (1 - sdc).alias("masked_rate"), sdc.alias("sdc_rate"), F.lit(0.0).alias("due_rate"))


def expand_ranges(df: DataFrame, ranges: str, name: str = "thread") -> DataFrame:
    """[start, count] pairs to one row per number."""
    one = df.withColumn("_r", F.explode(ranges))
    return one.withColumn(name, F.explode(F.sequence(F.element_at("_r", 1), F.element_at("_r", 1) + F.element_at("_r", 2) - 1))).drop("_r")


def slot_of(ids: Column, draw: Column) -> Column:
    """The id that a draw picks of a list."""
    return F.element_at(ids, (F.pmod(draw, F.size(ids)) + 1).cast("int"))
