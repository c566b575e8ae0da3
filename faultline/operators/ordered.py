"""Merges that need an order: last writers, first occurrences, OR merges, folds, collectives."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_writer(bytes_written: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Per byte the store that wrote last and how many wrote it."""
    return bytes_written.groupBy(*keys).agg(F.max(index).alias("last_index"), F.count(F.lit(1)).alias("n_writes"))


def overwritten_share(writers: DataFrame) -> DataFrame:
    """The share of byte writes that a later one replaced."""
    return writers.agg(F.try_divide(F.sum(F.col("n_writes") - 1).cast("double"), F.sum("n_writes").cast("double")).alias("overwritten"))


def or_merge(df: DataFrame, keys: list[str], index: str, width: str, masks: list[str], label: str) -> DataFrame:
    """Rows of a key as one: least index, greatest width, masks joined by OR, labels ``merged`` if they differ."""
    labels = F.when(F.min(label) == F.max(label), F.min(label)).otherwise(F.lit("merged"))
    return df.groupBy(*keys).agg(F.min(index).alias(index), F.max(width).alias(width), *[F.bit_or(m).alias(m) for m in masks], labels.alias(label))


def live_bits(masks: Column, w: int) -> tuple[Column, Column]:
    """(live, benign): set bits of the mask, and the rest of the width."""
    live = F.bit_count(masks)
    return live, w - live


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: partial aggregates meet, no group is sorted."""
    rest = [c for c in df.columns if c not in keys + order]
    best = F.min(F.struct(*order, *rest)).alias("_first")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_first.{c}") for c in order + rest])


def numeric_first(column: Column) -> list[Column]:
    """Sort keys: numbers by value first, then texts."""
    number = column.try_cast("double")
    return [number.isNull(), number, column]


def site_order(cycle: str, name: str) -> list[Column]:
    """Sort keys of sites: by cycle, none last, then names with numbers first."""
    return [F.col(cycle).isNull(), F.col(cycle), *numeric_first(F.col(name))]


def occurrence(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The how-manieth row of its key each is."""
    return df.withColumn("occurrence", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def vote(df: DataFrame, warp: list[str], lane: str, predicate: Column) -> DataFrame:
    """all, any, uni and ballot over the lanes of a warp."""
    p = predicate.cast("boolean")
    ballot = F.bit_or(F.when(p, F.call_function("shiftleft", F.lit(1).cast("long"), F.col(lane).cast("int"))).otherwise(F.lit(0).cast("long")))
    active = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(lane).cast("int")))
    return df.groupBy(*warp).agg(F.bool_and(p).alias("vote_all"), F.bool_or(p).alias("vote_any"), (F.bool_and(p) | ~F.bool_or(p)).alias("vote_uni"), ballot.alias("ballot"), active.alias("active"))


def barrier_reduce(df: DataFrame, block: list[str], predicate: Column) -> DataFrame:
    """popc, and, or over the threads of a block that arrive at a barrier."""
    p = predicate.cast("boolean")
    return df.groupBy(*block).agg(F.count_if(p).alias("red_popc"), F.bool_and(p).alias("red_and"), F.bool_or(p).alias("red_or"))


def shuffle_lanes(df: DataFrame, warp: list[str], lane: str, value: str, kind: str, amount: int, lanes: int = 32) -> DataFrame:
    """up, down, bfly or idx: outside the warp a lane keeps its own value, an inactive source gives 0."""
    source = {"up": F.col(lane) - amount, "down": F.col(lane) + amount, "bfly": F.col(lane).bitwiseXOR(F.lit(amount)), "idx": F.lit(amount)}[kind]
    rows = df.withColumn("_from", source)
    other = df.select(*[F.col(k).alias(f"_{k}") for k in warp], F.col(lane).alias("_lane"), F.col(value).alias("_value"))
    cond = F.col("_from") == F.col("_lane")
    for k in warp:
        cond &= F.col(k) == F.col(f"_{k}")
    inside = (F.col("_from") >= 0) & (F.col("_from") < lanes)
    out = rows.join(other, cond, "left").withColumn("shuffled", F.when(~inside, F.col(value)).otherwise(F.coalesce("_value", F.lit(0))))
    return out.drop("_from", "_lane", "_value", *[f"_{k}" for k in warp])


def atomic_free(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Atomics that do not depend on order."""
    return df.groupBy(*keys).agg(F.bit_and(value).alias("atom_and"), F.bit_or(value).alias("atom_or"), F.bit_xor(value).alias("atom_xor"), F.sum(value).alias("atom_add"), F.min(value).alias("atom_min"), F.max(value).alias("atom_max"))


def atomic_fold(df: DataFrame, address: list[str], order: list[str], op: str, value: str, compare: str = "compare") -> DataFrame:
    """exch, cas, inc and dec, folded in order per address from 0; one address is in a task at once."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, now = pdf.sort_values(order, kind="stable"), 0
        pairs = zip(pdf[value].tolist(), pdf[compare].tolist() if op == "cas" else pdf[value].tolist(), strict=True)
        for v, c in pairs:
            if op == "exch":
                now = v
            elif op == "cas":
                now = v if now == c else now
            elif op == "inc":
                now = 0 if now >= v else now + 1
            else:
                now = v if now == 0 or now > v else now - 1
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in address}, "atom": [now]})

    return df.groupBy(*address).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in address), "atom long"]))


def elided(df: DataFrame, keys: list[str], masks: list[str], width: str) -> DataFrame:
    """One pass over records: how many have an effect, and the bits of those that have none."""
    none = F.lit(True)
    for m in masks:
        none &= F.col(m) == 0
    return df.groupBy(*keys).agg(F.count_if(~none).alias("kept"), F.sum(F.when(none, F.col(width)).otherwise(0)).cast("long").alias("elided_bits"))


def signatures(df: DataFrame, key: str, order: list[str], parts: list[str]) -> DataFrame:
    """Keys with equal sequences share a signature: (key, signature, representative), the least key of each.

    A key's sequence is hashed position by position and the hashes are added up, so no sequence
    is gathered; ``order`` numbers the positions.
    """
    at = df.withColumn("_i", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    half = lambda seed: F.sum(F.xxhash64(F.lit(seed), "_i", *parts).cast("decimal(38,0)"))
    made = at.groupBy(key).agg(half(1).alias("_a"), half(2).alias("_b"), F.count(F.lit(1)).alias("_n"))
    made = made.withColumn("signature", F.sha2(F.concat_ws(":", "_a", "_b", "_n"), 256)).select(key, "signature")
    least = made.groupBy("signature").agg(F.min(key).alias("representative"))
    return made.join(least, "signature")


def only_match(df: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with the value of their key, and how many it has; other than one is an error for the caller."""
    found = table.groupBy(key).agg(F.min(value).alias(value), F.count_distinct(value).alias("matches"))
    return df.join(found, key, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
