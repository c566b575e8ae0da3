"""Control taint: which bits of registers, flipped when they are read, turn a later branch.

A branch reads predicates. Whatever wrote such a predicate decides the branch, too, and through that
instruction's sources whatever wrote those. So taint is reachability over def-use edges: from a
read of a predicate to the write that it sees, an as-of lookup. A needed writer passes taint on by its kind:

* ``setp`` (two sources): the bits whose flip turns the comparison, in closed form (``compare.toggles``); a
  predicate source passes whole;
* ``selp`` into a predicate: the bit of the chosen source that is taken, and the selector where the two differ;
* ``and.pred``, ``or.pred``, ``not.pred``: every predicate source passes;
* any other writer of a predicate stops the taint (``blocked`` names it).

Edges and masks are made once for all threads. Branches walk back in rounds, one join a round; a
round's rows are written, so lineage stays short; rounds end when no branch meets a new instruction.
Their number is the longest chain of predicates, not the length of the trace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import compare
from ..tables import discard, stored
from .intervals import as_of

LOGIC = ("and.pred", "or.pred", "not.pred")


def is_predicate(name: Column) -> Column:
    return F.coalesce(F.lower(F.trim(name)).startswith("%p"), F.lit(False))


def _operation(opcode: Column) -> Column:
    return F.regexp_extract(F.lower(F.trim(opcode)), r"^([^\s,%;]*)", 1)


def source_masks(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A row per source that passes taint on: keys, order, writes, source, register, is_pred, mask.

    events: keys, order, opcode, dst, srcs (names), values (patterns), widths. Writers of predicates only.
    """
    op, shape = F.col("_op"), F.col("_shape")
    value = lambda i: F.get("values", F.lit(i))
    left, right = compare.toggles(F.coalesce(shape["comparator"], F.lit("eq")), F.coalesce(shape["kind"], F.lit("u")), F.coalesce(shape["width"], F.lit(32)), F.coalesce(value(0), F.lit(0).cast("long")), F.coalesce(value(1), F.lit(0).cast("long")))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    odd = lambda c: c.bitwiseAND(F.lit(1)) != 0
    toggled = F.when((F.size("values") == 2) & shape.isNotNull(), F.array(left, right))
    chosen = F.when(F.size("values") >= 3, F.array(F.when(odd(value(2)), one).otherwise(none), F.when(odd(value(2)), none).otherwise(one), F.when(odd(value(0)) != odd(value(1)), one).otherwise(none)))
    passes = F.when(op.startswith("setp"), toggled).when(op.startswith("selp"), chosen).when(op.isin(*LOGIC), F.transform("srcs", lambda s: one))

    def source(name: Column, i: Column) -> Column:
        mask, pred = F.coalesce(F.get("_passes", i), none), is_predicate(name)
        fits = (F.get("widths", i) > 0) & F.get("values", i).isNotNull()
        whole = F.when(op.startswith("setp") & pred, one).when(op.isin(*LOGIC), F.when(pred, one).otherwise(none))
        narrow = mask.bitwiseAND(compare.ones(F.when(pred, 1).otherwise(F.least(F.get("widths", i), F.lit(64)))))
        kept = F.when(op.isin(*LOGIC), whole).when(F.coalesce(fits, F.lit(False)), F.coalesce(whole, F.when(F.lower(F.trim(name)).startswith("%"), narrow), none)).otherwise(none)
        return F.struct(i.alias("source"), name.alias("register"), pred.alias("is_pred"), kept.alias("mask"))

    made = events.where(is_predicate(F.col("dst"))).withColumn("_op", _operation(F.col("opcode"))).withColumn("_shape", compare.setp_shape(F.col("opcode"), F.col("widths")))
    made = made.withColumn("_passes", passes).where(F.col("_passes").isNotNull())
    return made.select(*keys, order, F.explode(F.transform("srcs", source)).alias("s")).select(*keys, order, "s.*").where("mask <> 0")


def edges(events: DataFrame, masks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """From each reader of a predicate to the write it sees: keys, reader, writer; reader is a branch or a row of ``masks``."""
    branch = events.where(F.col("kind").isin("branch", "loop_branch")).select(*keys, order, F.explode("srcs").alias("register")).where(is_predicate(F.col("register")))
    reads = branch.unionByName(masks.where("is_pred").select(*keys, order, "register")).distinct()
    writes = events.where(is_predicate(F.col("dst")) & ~F.col("kind").isin("branch", "loop_branch")).select(*keys, order, F.col("dst").alias("register"), F.col(order).alias("writer"))
    seen = as_of(reads, writes, [*keys, "register"], [order], "writer", strict=True)
    return seen.where("writer is not null").select(*keys, F.col(order).alias("reader"), "writer").distinct()


def control_taint(events: DataFrame, keys: list[str] = ("thread",), order: str = "index") -> tuple[DataFrame, DataFrame]:
    """(taint, blocked). taint: keys, branch, decision (the opposite of the one taken), order, source, register, mask.

    events: as in ``source_masks``, and kind, taken (of branches). ``order`` is unique within keys.
    blocked: keys, branch, order of needed writers that no rule passes.
    """
    keys, spark = list(keys), events.sparkSession
    masks, masks_at = stored(source_masks(events, keys, order), "taint-masks")
    use, use_at = stored(edges(events, masks, keys, order), "taint-edges")
    branches = events.where(F.col("kind").isin("branch", "loop_branch")).select(*keys, F.col(order).alias("branch"), (~F.coalesce(F.col("taken"), F.lit(False))).alias("decision"))
    start = branches.withColumn("reader", F.col("branch")).join(use, [*keys, "reader"]).select(*keys, "branch", "decision", F.col("writer").alias("at")).distinct()
    front, path = stored(start, "taint-round")
    met, paths = front, [path]
    while not front.isEmpty():
        step = front.withColumnRenamed("at", "reader").join(use, [*keys, "reader"]).select(*keys, "branch", "decision", F.col("writer").alias("at")).distinct()
        front, path = stored(step.join(met, [*keys, "branch", "at"], "left_anti"), "taint-round")
        paths.append(path)
        met = spark.read.schema(front.schema).parquet(*paths)
    met, _ = stored(met, "taint-met")
    for p in (*paths, use_at):
        discard(spark, p)
    at = met.withColumnRenamed("at", order)
    taint = at.join(masks, [*keys, order]).select(*keys, "branch", "decision", order, "source", "register", "mask")
    rules = events.withColumn("_op", _operation(F.col("opcode"))).where(F.col("_op").startswith("setp") | F.col("_op").startswith("selp") | F.col("_op").isin(*LOGIC))
    return taint, at.join(rules.select(*keys, order), [*keys, order], "left_anti").select(*keys, "branch", order)


def trace_masks(taint: DataFrame, keys: list[str] = ("thread",), order: str = "index") -> DataFrame:
    """Per read the bits that turn some branch, and how many branches: keys, order, source, register, trace, branches."""
    return taint.groupBy(*keys, order, "source", "register").agg(F.bit_or("mask").alias("trace"), F.count(F.lit(1)).alias("branches"))
