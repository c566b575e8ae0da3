"""Cache residency: least-recently-used sets, an order-dependent state per (seed, set)."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .intervals import point_in_interval
from .lifetimes import versions


def lru_accesses(accesses: DataFrame, keys: list[str], order: list[str], line: str, ways: int, is_store: str | None = None, write_allocate: bool = True) -> DataFrame:
    """Accesses that meet a resident line or bring it in, with way, episode (a number within the set) and hit.

    ``keys`` name a set; ``order`` is a total order within it. Without ``write_allocate`` a
    store to a line that is not resident passes by. A task holds one set's rows at once, and
    ``ways`` lines of state; all other columns come back by the join on the order.
    """
    kinds = {f.name: f.dataType.simpleString() for f in accesses.schema}
    columns = [*keys, line, *order] + ([is_store] if is_store else [])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        resident: OrderedDict = OrderedDict()
        free, made, episode = list(range(ways))[::-1], [], 0
        pdf = pdf.sort_values(order, kind="stable")
        stores = pdf[is_store].to_numpy(bool) if is_store else [False] * len(pdf)
        for tag, store in zip(pdf[line].tolist(), stores, strict=True):
            hit = tag in resident
            if hit:
                resident.move_to_end(tag)
            elif store and not write_allocate:
                made.append((-1, -1, False))
                continue
            else:
                if not free:
                    free.append(resident.popitem(last=False)[1][0])
                resident[tag] = (free.pop(), episode)
                episode += 1
            made.append((*resident[tag], hit))
        way, number, hits = zip(*made, strict=True)
        out = pdf.assign(way=way, episode=number, hit=hits)
        return out[out["way"] >= 0][[*columns, "way", "episode", "hit"]]

    fields = [*(f"{k} {kinds[k]}" for k in columns), "way int", "episode long", "hit boolean"]
    return accesses.select(*columns).groupBy(*keys).applyInPandas(run, ", ".join(fields))


def _episodes(held: DataFrame, keys: list[str], line: str, time: str, is_store: str | None) -> DataFrame:
    stored = F.bool_or(F.col(is_store)) if is_store else F.lit(False)
    made = held.groupBy(*keys, "episode").agg(F.first(line).alias(line), F.first("way").alias("way"), F.min(time).alias("start"), F.count_if("hit").alias("hits"), stored.alias("dirty"))
    # the way passes to the episode that evicts it
    return made.withColumn("end", F.lead("start").over(W.partitionBy(*keys, "way").orderBy("episode")))


def lru_episodes(accesses: DataFrame, keys: list[str], order: list[str], line: str, ways: int, is_store: str | None = None, write_allocate: bool = True) -> DataFrame:
    """Residencies of lines: keys, line, way, start, end (null: still resident), hits, dirty; the first column of ``order`` is the time."""
    held = lru_accesses(accesses, keys, order, line, ways, is_store, write_allocate)
    return _episodes(held, keys, line, order[0], is_store).select(*keys, line, "way", "start", "end", "hits", "dirty")


def byte_versions(accesses: DataFrame, keys: list[str], order: list[str], line: str, ways: int, is_store: str, offsets: Column, domain_end: int, write_allocate: bool = True) -> tuple[DataFrame, DataFrame]:
    """(episodes, versions) of the bytes that accesses touch: ``offsets`` is the array of byte offsets of one.

    A version: keys, episode, offset, start, end, dirty, last_load, reason. The first is clean
    and starts with its episode, a store ends it (``overwrite``) and starts a dirty one; the last
    ends with the episode (``evict``), which at last is at ``domain_end``.
    """
    rows = accesses.withColumn("_offsets", offsets)
    held = lru_accesses(rows, keys, order, line, ways, is_store, write_allocate).join(rows.select(*keys, *order, "_offsets"), [*keys, *order])
    episodes = _episodes(held, keys, line, order[0], is_store).withColumn("end", F.coalesce("end", F.lit(domain_end)))
    touched = held.withColumn("offset", F.explode("_offsets"))
    made = versions(touched, [*keys, "episode", "offset"], order[0], order[1], F.col(is_store), F.lit(None).cast("long"))
    spans = episodes.select(*keys, "episode", F.col("start").alias("_from"), F.col("end").alias("_to"))
    first = made.where("version = 0").select(*keys, "episode", "offset").withColumn("_read", F.lit(True))
    # a byte whose first access is a store still was clean before
    before = made.where("version = 1").join(first, [*keys, "episode", "offset"], "left_anti").select(*keys, "episode", "offset", F.lit(0).cast("long").alias("version"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("last_read"), F.lit(0).cast("long").alias("n_reads"), F.col("start").alias("end"))
    whole = made.unionByName(before).join(spans, [*keys, "episode"])
    return episodes, whole.select(
        *keys, "episode", "offset", F.coalesce("start", "_from").alias("start"), F.coalesce("end", "_to").alias("end"), (F.col("version") > 0).alias("dirty"), F.col("last_read").alias("last_load"),
        F.when(F.col("end").isNull(), "evict").otherwise("overwrite").alias("reason"),
    )


def cache_class(points: DataFrame, episodes: DataFrame, found: DataFrame, keys: list[str], at: str, line_bytes: int) -> DataFrame:
    """Points (keys, way, ``at``, bit) with ``class``: the episode that holds the way, then the version of the byte.

    A bit past the line's data is one of its tag: ebc while a line is resident. A byte is dcr while a load is
    still to come, or, where it is dirty, its write-back at the end; else benign.
    """
    inside = point_in_interval(points, episodes.select(*keys, "way", "episode", "start", "end"), [*keys, "way"], at, "start", "end")
    inside = inside.drop("start", "end").withColumn("offset", F.floor(F.col("bit") / 8))
    until = F.when(F.col("dirty") & (F.col("reason") == "evict"), F.col("end")).otherwise(F.col("last_load"))
    spans = found.select(*keys, "episode", "offset", "start", "end", until.alias("_until"))
    met = point_in_interval(inside, spans, [*keys, "episode", "offset"], at, "start", "end").drop("start", "end")
    kind = F.when(F.col("episode").isNull(), "benign").when(F.col("bit") >= line_bytes * 8, "ebc").when(F.col(at) < F.col("_until"), "dcr").otherwise("benign")
    return met.withColumn("class", kind).drop("_until", "episode", "offset")


def replayed(rows: Iterator[tuple[int, int]], ways: int) -> list[tuple[int, int]]:
    """Misses of one set as (time, line): a plain replay for tests."""
    held: list[int] = []
    out = []
    for now, tag in rows:
        if tag in held:
            held.remove(tag)
        else:
            out.append((now, tag))
            if len(held) == ways:
                held.pop(0)
        held.append(tag)
    return out
