"""Exact deduplication by skew-safe combining, with DataFrame functions only.

Texts are equal when they agree after white space ``[\\x20\\x09-\\x0D]`` is deleted. Of equal
texts the row with the most code points in the original text stays, then the smallest id.

1. Texts are combined within each task: one row per (digest, content) goes on.
2. These meet by (salt, digest, content). The salt is the task's number modulo ``SALTS`` for hot
   digests (over ``HOT_SHARE`` of all rows, so few; counted over digests alone before), else 0,
   which combines a digest that is not hot completely.
3. The salt winners of hot digests meet by (digest, content).
4. Winners are joined back by digest, which the full comparison has shown to stand for one
   content; digests of several contents, if there ever are any, are combined and joined by content.

Defined cases: a null text counts as empty; a null id sorts after all others; repeated rows
(same id, same text) count each, and one of them stays; an empty table gives an empty table;
columns besides id and text are ignored by ``exact_groups`` and carried by ``keep_exact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import HOT_SHARE, SPACE, materialize, text_or_empty, with_facts

SALTS = 16


def _digest(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def _digested(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = F.regexp_replace(text_or_empty(text_col), SPACE, "")
    out = df.withColumns({"_id": F.col(id_col), "_len": F.length(text_or_empty(text_col)), "_norm": norm})
    return out.withColumn("_sha", _digest(F.col("_norm")))


def _best() -> Column:
    return F.struct((-F.col("_len")).alias("neg_len"), F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"))


def _hot(light: DataFrame) -> tuple[DataFrame, int]:
    """(the few hot digests, the number of rows)."""
    n = light.count()
    hot = light.groupBy("_sha").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(SALTS, n * HOT_SHARE)).select("_sha", F.lit(True).alias("_hot"))
    return materialize(hot, "exact-hot"), n


def _combined(rows: DataFrame, hot: DataFrame, name: str, *values: Column) -> DataFrame:
    """One row per (digest, content): ``_best``, ``_n`` and ``values``; content itself only of hot digests.

    values: aggregates that can be taken again over their own results, by the same name.
    """
    dealt = rows.join(F.broadcast(hot), "_sha", "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    salt = F.when(F.col("_hot"), F.pmod(F.spark_partition_id(), F.lit(SALTS))).otherwise(F.lit(0))
    salted = dealt.withColumn("_salt", salt).groupBy("_salt", "_hot", "_sha", "_norm").agg(F.min(_best()).alias("_best"), F.count(F.lit(1)).alias("_n"), *values)
    kept = materialize(salted.drop("_salt").withColumn("_norm", F.when(F.col("_hot"), F.col("_norm"))), name)
    whole = kept.where("_hot").groupBy("_sha", "_norm").agg(F.min("_best").alias("_best"), F.sum("_n").alias("_n"), *values)
    return kept.where("not _hot").drop("_hot", "_norm").unionByName(whole.drop("_norm"))


def winners(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, int]:
    """(light, won, rows): a narrow row per input row; for each distinct text who stays and how many there are."""
    bare = df.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"))
    light = materialize(_digested(bare, "_i", "_t").select("_id", "_len", "_sha").withColumn("_uid", F.monotonically_increasing_id()), "exact-light")
    hot, n = _hot(light)
    won = _combined(_digested(bare, "_i", "_t").select("_id", "_len", "_sha", "_norm"), hot, "exact-salted")
    won = won.select("_sha", F.col("_best.id").alias("keep_id"), (-F.col("_best.neg_len")).alias("keep_len"), F.col("_n").alias("group_size"))
    return light, materialize(won, "exact-won"), n


def _collided(df: DataFrame, won: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(digests of several contents, their rows joined with their winners by content; None where there are no such digests)."""
    shared = materialize(won.groupBy("_sha").agg(F.count(F.lit(1)).alias("_contents")).where("_contents > 1").select("_sha"), "exact-shared")
    if shared.isEmpty():
        return shared, None
    rows = _digested(df.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t")), "_i", "_t").select("_id", "_len", "_sha", "_norm")
    rows = materialize(rows.join(shared, "_sha", "left_semi").withColumn("_uid", F.monotonically_increasing_id()), "exact-shared-rows")
    salt = F.pmod(F.col("_uid"), F.lit(SALTS))
    best = rows.groupBy(salt.alias("_salt"), "_sha", "_norm").agg(F.min(_best()).alias("_best"), F.count(F.lit(1)).alias("_n"))
    best = best.groupBy("_sha", "_norm").agg(F.min("_best").alias("_best"), F.sum("_n").alias("_n"))
    best = best.select("_sha", "_norm", F.col("_best.id").alias("keep_id"), (-F.col("_best.neg_len")).alias("keep_len"), F.col("_n").alias("group_size"))
    return shared, rows.join(best, ["_sha", "_norm"])


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    light, won, n = winners(df, id_col, text_col)
    shared, apart = _collided(df, won, id_col, text_col)
    if apart is not None:
        light, won = light.join(shared, "_sha", "left_anti"), won.join(shared, "_sha", "left_anti")
    # of repeated rows that all are the best, one stays: the first, of hot digests by an aggregate, of others by rank
    best = F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_len") == F.col("keep_len"))
    hot = F.col("group_size") > n * HOT_SHARE
    first = light.join(F.broadcast(won.where(hot)), "_sha").where(best).groupBy("_sha").agg(F.min("_uid").alias("_first"))
    joined = with_facts(light, won.join(F.broadcast(first), "_sha", "left"), "_sha", "group_size", n)
    joined = joined.withColumn("_norm", F.lit(None).cast("string"))
    if apart is not None:
        joined = joined.unionByName(apart.withColumn("_first", F.lit(None).cast("long")))
    alone = F.when(best & F.col("_first").isNull(), F.lit(-1)).otherwise(F.col("_uid"))
    nth = F.row_number().over(W.partitionBy("_sha", "_norm", alone).orderBy("_uid"))
    out = joined.withColumn("kept", best & F.coalesce(F.col("_first") == F.col("_uid"), nth == 1))
    return out.select(F.col("_id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("_sha").alias("text_sha256"))


def keep_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: each stage carries the best row itself.

    Of repeated rows that all are the best, the one whose JSON has the least hash stays.
    """
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(id_col).alias("_i"), F.col(text_col).alias("_t"))
    hot, _ = _hot(_digested(rows, "_i", "_t").select("_sha"))
    rows = _digested(rows, "_i", "_t").select("_row", "_id", "_len", "_sha", "_norm")
    order = F.struct(_best().alias("best"), F.xxhash64(F.to_json("_row")).alias("hash"))
    kept = _combined(rows.withColumn("_order", order), hot, "exact-salted", F.min_by("_row", "_order").alias("_row"), F.min("_order").alias("_order"))
    return kept.select("_row.*")
