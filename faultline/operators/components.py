"""Connected components by alternating large-star and small-star steps.

Every step groups links by one end and links the others to the least neighbour, so no
component is gathered anywhere; links are written to the shared folder after each round, and
the round before is deleted then. A round is one job. Ends that hold over ``HOT_SHARE`` of all
links are few; their least neighbours are broadcast, so that a hub is not one task's work.

Defined cases: links of a node to itself and links with a null end are left out; repeated
links and both directions count once; no links give an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..tables import discard, stored, with_facts


def _to_least(links: DataFrame, n: int) -> DataFrame:
    """Links (u, v) with the least neighbour of u, or u itself: (u, v, least)."""
    least = links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"), F.count(F.lit(1)).alias("_links"))
    return with_facts(links, least, "u", "_links", n).drop("_links")


def _kept(links: DataFrame) -> tuple[DataFrame, str, tuple]:
    """The written links, their path, and a count and two sums that tell whether they changed."""
    seen = Observation()
    h = F.xxhash64("u", "v")
    sums = (F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("s"))
    table, path = stored(links.observe(seen, *sums), "cc-links")
    return table, path, (seen.get.get("n") or 0, seen.get.get("x"), seen.get.get("s"))


def components(edges: DataFrame) -> DataFrame:
    """From (a, b), any order and repeats, to (node, root) with the least reachable node as root."""
    spark = edges.sparkSession
    now, path, sums = _kept(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while sums[0]:
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        # large star: larger neighbours of u link to u's least neighbour
        large = _to_least(both, 2 * sums[0]).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        # small star: u and its smaller neighbours link to the least of them
        small = _to_least(large, sums[0]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("least").alias("v")), F.struct("u", F.col("least").alias("v")))).alias("e"))
        after, after_path, after_sums = _kept(small.select("e.*").where("u <> v").distinct())
        discard(spark, path)
        settled = after_sums == sums
        now, path, sums = after, after_path, after_sums
        if settled:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
