"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Size of a document: its words. Sources in code-point order, null last, weigh 5, 2, 1,
repeating, and share all sizes; a target stops at ``CAP`` times its source's size and the
excess is shared again by weight. A source gives complete epochs first. What remains of its
target is filled in the order of exponential keys ``-ln(u) / quality``, u being a hash of the
id: by prefix sums every document that still fits is taken, one that does not is passed over.
So a source stays below its target by less than the smallest document that it leaves out.

Where the prefix sum of a source first exceeds its room is found by sums over ``BINS`` bins of
keys, refined until the bin holds at most ``PER_RANGE`` documents; only that bin is walked one
by one. Then the same is asked of the later, smaller documents that fit what is left.

Defined cases: a null text has size 0; a null source is a source; a null id is drawn by its
text; repeated rows are drawn alike, each counts; a document without words is never taken, nor
is a source without words, whose target is 0; an empty table gives an empty table; other
columns are ignored by ``mix`` and carried by ``mixed``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize, text_or_empty, with_facts

CYCLE = (5.0, 2.0, 1.0)
CAP = 3.0
#: Bins of keys of one source, and how many documents of one are walked in a task.
BINS, PER_RANGE = 1_000, 200
#: Up to so many sources their goals, each with at most a few PER_RANGE picks, are broadcast.
SOURCES = 1_000
SEED = 11


def quality(text: Column, size: Column) -> Column:
    """A weight in (0, 1]: near 1 where words are about six characters long on average."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    return F.exp(-F.abs(mean - 6.5) / 6.5) * 0.95 + 0.05


def targets(sizes: DataFrame) -> DataFrame:
    """From (source, source_size) to (source, source_size, target) by water filling.

    Ordered by cap / weight, sources below the water line get their cap; the line is where
    caps below it and weight times line above it add up to the whole.
    """
    everywhere = W.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(w) for w in CYCLE]), (F.pmod(F.row_number().over(everywhere) - 1, F.lit(len(CYCLE))) + 1).cast("int"))
    out = sizes.withColumn("w", weight).withColumn("cap", CAP * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    order = W.orderBy("ratio", F.col("source").isNull(), "source")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    whole = F.sum("source_size").over(W.partitionBy(F.lit(1)))
    line = (whole - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    out = out.withColumns({"line": line, "rank": F.row_number().over(order)})
    # the first source whose cap lies above its line fixes the line for all that follow
    final = F.min(F.when(F.col("ratio") >= F.col("line"), F.struct("rank", "line"))).over(W.partitionBy(F.lit(1)))
    out = out.withColumn("final", final["line"])
    return out.withColumn("target", F.coalesce(F.least("cap", F.col("w") * F.col("final")), F.col("cap"))).select("source", "source_size", "target")


#: What tells rows apart; rows that agree in all of these are drawn alike.
UNIT = ["_s", "_id", "_key", "_size", "_tx"]


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """Documents of one bin of keys, in key order, each as often as it still fits."""
    pdf = pdf.sort_values(["_key", "_size", "_tx"], kind="stable").reset_index(drop=True)
    left, picked = float(pdf["_left"].iloc[0]), []
    for size, copies in zip(pdf["_size"].tolist(), pdf["_copies"].tolist(), strict=True):
        n = min(copies, int(left // size))
        picked.append(n)
        left -= n * size
    return pdf.assign(_picked=picked)[[*UNIT, "_copies", "_picked"]]


def _window() -> list[Column]:
    return [F.sum(F.col("_size") * F.col("_copies")).alias("_sum"), F.count(F.lit(1)).alias("_n"), F.min("_key").alias("_lo"), F.max("_key").alias("_hi")]


def _meet(units: DataFrame, facts: DataFrame, cond: Column, total: int, sources: int) -> DataFrame:
    """``units`` with the facts of their source where ``cond`` holds."""
    if sources > SOURCES:
        return with_facts(units, facts, "_s", "_rows", total).where(cond)
    facts = facts.withColumnRenamed("_s", "_of")
    return units.join(F.broadcast(facts), (F.col("_s") == F.col("_of")) & cond).drop("_of")


def _cut(units: DataFrame, state: DataFrame, total: int, sources: int) -> DataFrame:
    """state: (_s, _rows, _from, _room). Adds to it: (_lo, _hi], the bin of keys in which the prefix
    sum of the documents that fit the room exceeds it, the sum ``_before`` of those in front of it,
    and their number ``_n``. Without such a bin _lo is null: all fit. Sources without any that fit are left out."""
    fits = (F.col("_key") > F.col("_from")) & (F.col("_size") <= F.col("_room"))
    met = _meet(units, state, fits, total, sources)
    first = met.groupBy("_s").agg(*_window()).withColumn("_before", F.lit(0).cast("long"))
    now = materialize(state.join(first, "_s"), "mix-cut")
    while True:
        wide = (F.col("_sum") + F.col("_before") > F.col("_room")) & (F.col("_n") > PER_RANGE) & (F.col("_lo") < F.col("_hi"))
        if now.where(wide).isEmpty():
            break
        asked = now.where(wide).select("_s", "_rows", "_from", "_room", F.col("_lo").alias("_least"), F.col("_hi").alias("_most"), F.col("_before").alias("_ahead"))
        met = _meet(units, asked, fits & F.col("_key").between(F.col("_least"), F.col("_most")), total, sources)
        at = F.least(F.floor((F.col("_key") - F.col("_least")) / (F.col("_most") - F.col("_least")) * BINS), F.lit(BINS - 1))
        bins = met.groupBy("_s", at.alias("_bin"), "_ahead", "_room").agg(*_window())
        upto = F.sum("_sum").over(W.partitionBy("_s").orderBy("_bin"))
        bins = bins.withColumn("_before", F.col("_ahead") + upto - F.col("_sum")).where(F.col("_before") + F.col("_sum") > F.col("_room"))
        found = bins.groupBy("_s").agg(F.min_by(F.struct("_sum", "_n", "_lo", "_hi", "_before"), "_bin").alias("c")).select("_s", "c.*")
        narrow = now.where(wide).select("_s", "_rows", "_from", "_room").join(found, "_s")
        now = materialize(now.where(~wide).unionByName(narrow), "mix-cut")
    over = F.col("_sum") + F.col("_before") > F.col("_room")
    return now.withColumns({"_lo": F.when(over, F.col("_lo")), "_hi": F.when(over, F.col("_hi"))})


def _plan(units: DataFrame) -> tuple[DataFrame, int, int, bool]:
    """units: one row per ``UNIT`` with ``_source`` and its ``_copies``.

    (goals, rows, sources, parted): per source its sizes, target, epochs, the ``passes``, each of which took
    all of at most ``room`` words with keys between ``after`` and ``upto``, and asked one by one those
    from ``upto`` to ``end``, and what of these was ``picked``; all rows, the number of sources, and
    whether of rows that are drawn alike only some are taken.
    """
    sums = materialize(units.groupBy("_s").agg(F.first("_source").alias("source"), F.sum(F.col("_size") * F.col("_copies")).alias("source_size"), F.sum("_copies").alias("_rows")), "mix-sums")
    total, sources = sums.agg(F.coalesce(F.sum("_rows"), F.lit(0)), F.count(F.lit(1))).first()
    goals = targets(sums.select("source", "source_size"))
    goals = sums.join(goals.select(F.col("source").alias("_g"), "target"), F.col("source").eqNullSafe(F.col("_g"))).drop("_g")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)) + 1e-9)).otherwise(0)
    goals = goals.withColumn("epochs", epochs).withColumn("room", F.greatest(F.lit(0.0), F.round(F.col("target") - F.col("epochs") * F.col("source_size"), 6)))
    goals = materialize(goals, "mix-goals")
    some = units.where("_size > 0")
    state = goals.where("room >= 1").select("_s", "_rows", F.lit(-1.0).alias("_from"), F.col("room").alias("_room"))
    pass_ = lambda after, upto, end, room: F.struct(after.alias("after"), upto.alias("upto"), end.alias("end"), room.alias("room")).alias("p")
    nil = F.lit(0.0)
    passes, picked = goals.select("_s", pass_(nil, nil, nil, nil)).limit(0), some.select(*UNIT, "_copies", F.lit(0).cast("long").alias("_picked")).limit(0)
    while True:
        cut = materialize(_cut(some, state, total, sources), "mix-pass")
        if cut.isEmpty():
            break
        passes = passes.unionByName(cut.select("_s", pass_(F.col("_from"), F.coalesce("_lo", F.lit(float("inf"))), F.col("_hi"), F.col("_room"))))
        open_ = cut.where("_lo is not null").select("_s", "_rows", "_from", "_room", "_lo", "_hi", (F.col("_room") - F.col("_before")).alias("_left"))
        inside = _meet(some, open_, (F.col("_key") > F.col("_from")) & F.col("_key").between(F.col("_lo"), F.col("_hi")) & (F.col("_size") <= F.col("_room")), total, sources)
        inside = inside.select(*UNIT, "_copies", "_left")
        kinds = {f.name: f.dataType.simpleString() for f in inside.schema}
        taken = inside.groupBy("_s").applyInPandas(_fill, ", ".join(f"{c} {kinds[c]}" for c in [*UNIT, "_copies"]) + ", _picked long")
        taken = materialize(taken, "mix-picked")
        picked = picked.unionByName(taken.where("_picked > 0"))
        used = taken.groupBy("_s").agg(F.sum(F.col("_picked") * F.col("_size")).alias("_used"))
        state = open_.join(used, "_s").select("_s", "_rows", F.col("_hi").alias("_from"), (F.col("_left") - F.col("_used")).alias("_room"))
        state = materialize(state.where("_room >= 1"), "mix-state")
    each = F.struct(*[F.col(c).alias(c[1:]) for c in UNIT[1:]], F.col("_copies").alias("copies"), F.col("_picked").alias("n"))
    # a few passes of at most PER_RANGE picks a source
    goals = goals.join(passes.groupBy("_s").agg(F.collect_list("p").alias("passes")), "_s", "left").join(picked.groupBy("_s").agg(F.collect_list(each).alias("picked")), "_s", "left")
    goals = materialize(goals.drop("room"), "mix-plan")
    parted = not goals.where(F.exists("picked", lambda p: p["n"] < p["copies"])).isEmpty()
    return goals, total, sources, parted


def _keyed(df: DataFrame, id_col: str, text_col: str, source_col: str, weight: Column | None) -> DataFrame:
    size = F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")
    df = df.withColumns({"_id": F.col(id_col), "_source": F.col(source_col), "_size": size, "_tx": F.xxhash64(text_or_empty(text_col))})
    name = F.coalesce(F.col("_id").cast("string"), F.concat(F.lit("null:"), F.col("_tx").cast("string")))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), name).cast("binary")), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    w = quality(text_or_empty(text_col), F.col("_size")) if weight is None else F.greatest(weight, F.lit(1e-9))
    return df.withColumns({"_key": -F.log(u) / w, "_s": F.coalesce(F.concat(F.lit("s"), F.col("_source").cast("string")), F.lit("null"))})


def _decided(rows: DataFrame, light: DataFrame) -> DataFrame:
    """``rows`` (with the columns of ``UNIT``) with their source's goals and how many ``times`` each is taken."""
    units = materialize(light.groupBy(*UNIT).agg(F.first("_source").alias("_source"), F.count(F.lit(1)).alias("_copies")), "mix-units")
    goals, total, sources, parted = _plan(units)
    out = _meet(rows, goals, F.lit(True), total, sources)
    words = F.col("_size") > 0
    whole = F.exists("passes", lambda p: (F.col("_key") > p["after"]) & (F.col("_key") < p["upto"]) & (F.col("_size") <= p["room"]))
    asked = F.exists("passes", lambda p: F.col("_key").between(p["upto"], p["end"]) & (F.col("_size") <= p["room"]))
    mine = lambda p: (p["key"] == F.col("_key")) & (p["size"] == F.col("_size")) & (p["tx"] == F.col("_tx")) & p["id"].eqNullSafe(F.col("_id"))
    pick = F.when(words & asked, F.get(F.filter("picked", mine), F.lit(0)))
    out = out.withColumns({"_whole": F.coalesce(whole, F.lit(False)), "_pick": pick}).drop("passes", "picked")
    more = F.col("_whole") | F.coalesce(F.col("_pick.n") == F.col("_pick.copies"), F.lit(False))
    if parted:  # of rows that are drawn alike some are taken: only such rows are numbered
        some = F.coalesce(F.col("_pick.n") < F.col("_pick.copies"), F.lit(False))
        nth = F.row_number().over(W.partitionBy(*UNIT).orderBy(F.monotonically_increasing_id()))
        out = out.where(~some).withColumn("_nth", F.lit(None).cast("int")).unionByName(out.where(some).withColumn("_nth", nth))
        more |= F.coalesce(F.col("_nth") <= F.col("_pick.n"), F.lit(False))
    return out.withColumn("times", F.when(words, F.col("epochs") + more.cast("int")).otherwise(0))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken."""
    light = materialize(_keyed(df, id_col, text_col, source_col, weight).select(*UNIT, "_source"), "mix-rows")
    out = _decided(light, light)
    return out.select(F.col("_id").alias("doc_id"), "source", F.col("_size").alias("size"), "source_size", "target", (F.col("times") * F.col("_size")).cast("long").alias("taken"))


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None) -> DataFrame:
    """The mixture: each row of ``df`` as often as it is taken."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(id_col).alias("_i"), F.col(text_col).alias("_t"), F.col(source_col).alias("_src"))
    keyed = _keyed(rows, "_i", "_t", "_src", weight).drop("_i", "_t", "_src")
    out = _decided(keyed, keyed.select(*UNIT, "_source")).where("times > 0")
    return out.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("_row.*")
