"""Joins over intervals and time. Intervals are half open unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import materialize
from .series import ranged

#: Cells up to which an interval is dealt cell by cell; a longer one goes to its dyadic nodes.
CELLS = 4


def cover(lo: Column, hi: Column, grain: int) -> Column:
    """Dyadic nodes (level, node) that make up the cells of 2^grain which [lo, hi) touches; a null end is open.

    Node i of level k holds the cells [i 2^k, (i + 1) 2^k). A level gives at most two nodes: the first
    whole one if its number is odd, the last one if it is even, for these have a parent that is not whole.
    Up to ``CELLS`` cells come as nodes of level 0. So an interval of n cells has at most 2 log2 n + 1 nodes, an
    empty one none.
    """
    shift = lambda x, k: F.call_function("shiftright", x, F.lit(k) if isinstance(k, int) else k)
    lo, hi = lo.cast("long"), hi.cast("long")
    first, last = shift(lo, grain), F.when(hi.isNotNull(), shift(hi - 1, grain))
    top, open_ = 63 - grain, hi.isNull()

    def of_level(k: Column) -> Column:
        left, right = -shift(-first, k), shift(last + 1, k)  # whole nodes: [left, right)
        some = F.when(open_, (k < top) & (left <= shift(F.lit((1 << top) - 1).cast("long"), k))).otherwise(left < right)
        end = F.when(open_, F.when((k == top) & (left <= 0), F.lit(0).cast("long"))).when(some & (right % 2 != 0), right - 1)
        return F.array(F.when(some & (left % 2 != 0), F.struct(k.alias("level"), left.alias("node"))), F.when(end.isNotNull(), F.struct(k.alias("level"), end.alias("node"))))

    nodes = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(top)), of_level)), lambda n: n.isNotNull())
    cells = F.transform(F.sequence(first, F.least(F.greatest(first, last), first + CELLS - 1)), lambda c: F.struct(F.lit(0).alias("level"), c.alias("node")))
    return F.when(hi <= lo, F.slice(cells, 1, 0)).when(last - first < CELLS, cells).otherwise(nodes)


def _hits(points: DataFrame, at: str, right: DataFrame, lo: str, hi: str, same: list[Column], held: Column, grain: int, how: str) -> DataFrame:
    """``points`` joined with the rows of ``right`` whose [lo, hi) holds ``at``: both meet in dyadic nodes.

    A point asks one node of each level that occurs (at most 64, usually few). With several levels the
    points are written once with a number, so that those without a match come out once.
    """
    dealt = right.withColumn("_node", F.explode(cover(F.col(lo), F.col(hi), grain))).select(*right.columns, F.col("_node.level").alias("_level"), F.col("_node.node").alias("_node"))
    levels = sorted(r[0] for r in dealt.select("_level").distinct().collect()) or [0]
    named = points if len(levels) == 1 else materialize(points.withColumn("_uid", F.monotonically_increasing_id()), "interval-points")
    asked = F.array(*[F.struct(F.lit(k).alias("k"), F.call_function("shiftright", F.col(at).cast("long"), F.lit(grain + k)).alias("n")) for k in levels])
    asking = named.withColumn("_asked", F.explode(asked)) if len(levels) > 1 else named.withColumn("_asked", asked[0])
    cond = (F.col("_asked.k") == F.col("_level")) & (F.col("_asked.n") == F.col("_node"))
    for s in same:
        cond &= s
    if len(levels) == 1:
        return asking.join(dealt.hint("merge"), cond & held, how).drop("_asked", "_level", "_node")
    met = asking.join(dealt.hint("merge"), cond & held, "inner")
    if how == "left_semi":
        return named.join(met.select("_uid").hint("merge"), "_uid", "left_semi").drop("_uid")
    return named.join(met.select("_uid", *right.columns).hint("merge"), "_uid", how).drop("_uid")


def point_in_interval(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, how: str = "left", bucket: int | None = None) -> DataFrame:
    """Points with the interval of the same key that holds them; an open end is null. how: left or inner.

    With ``bucket``, rows of a key meet in cells of about that width, long and open intervals in
    dyadic nodes above them: a key with very many intervals is then split.
    """
    right = intervals.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in intervals.columns if c not in keys])
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    held = (F.col(start) <= F.col(at)) & (F.col(end).isNull() | (F.col(at) < F.col(end)))
    if bucket:
        return _hits(points, at, right, start, end, same, held, bucket.bit_length() - 1, how).drop(*[f"_{k}" for k in keys])
    cond = held
    for s in same:
        cond = s & cond
    return points.join(right, cond, how).drop(*[f"_{k}" for k in keys])


def _carried(both: DataFrame, keys: list[str], at: str, closing: Column, later: bool, ranges: int) -> DataFrame:
    """``both`` cut into ranges of ``at``, with ``_carry``: the last ``closing`` (an aggregate of a range) of the ranges before, or the first one of those after."""
    dealt = ranged(materialize(both, "as-of"), at, ranges)  # read three times: for edges, closing values and rows
    order = F.desc("_of_part") if later else F.asc("_of_part")
    before = F.last("_closing", ignorenulls=True).over(W.partitionBy(*[f"_of_{k}" for k in keys]).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    ends = dealt.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_part").alias("_of_part")).agg(closing.alias("_closing")).withColumn("_carry", before).drop("_closing")
    same = F.col("_part") == F.col("_of_part")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return dealt.join(ends.hint("merge"), same).drop("_of_part", *[f"_of_{k}" for k in keys])


def as_of(left: DataFrame, right: DataFrame, keys: list[str], order: list[str], value: str, strict: bool = False, ranges: int = 256) -> DataFrame:
    """Each left row with the latest ``value`` of its key; no side is joined with the other.

    Inclusive, a right row at the same order counts; strict, only earlier ones do. Of right rows at
    one order the greatest value counts. Both sides have the columns ``keys`` and ``order``, whose first
    is a number or a time; left's other columns are kept. A key is cut into up to ``ranges`` ranges of it;
    each range hands its last value to the next, so a task sorts a range and never a whole key.
    """
    more = [c for c in left.columns if c not in keys + order]
    rows = left.select(*keys, *order, F.struct(*more).alias("_row") if more else F.lit(None).cast("int").alias("_row"), F.lit(1).alias("_left"), F.lit(None).alias("_value"))
    facts = right.select(*keys, *order, F.lit(None).alias("_row"), F.lit(0).alias("_left"), F.struct(value).alias("_value"))
    fact = F.col("_left") == 0
    both = _carried(rows.unionByName(facts), keys, order[0], F.max_by(F.when(fact, F.col("_value")), F.when(fact, F.struct(*order, "_value"))), False, ranges)
    # at equal order, facts come first where they count and last where they do not
    tie = F.desc("_left") if strict else F.asc("_left")
    latest = F.last("_value", ignorenulls=True).over(W.partitionBy(*keys, "_part").orderBy(*order, tie, "_value").rowsBetween(W.unboundedPreceding, W.currentRow))
    out = both.withColumn("_latest", F.coalesce(latest, "_carry")).where("_left = 1")
    return out.select(*keys, *order, *[F.col(f"_row.{c}") for c in more], F.col(f"_latest.{value}").alias(value))


def first_after(points: DataFrame, sites: DataFrame, keys: list[str], at: str, site: str, ranges: int = 256) -> DataFrame:
    """Each point with the least site of its key that is later than it; cut into ranges as ``as_of``, from the last to the first."""
    name = f"next_{site}"
    rows = points.select(*points.columns, F.col(at).alias("_t"), F.lit(1).alias("_left"), F.lit(None).cast(sites.schema[site].dataType).alias(name))
    marks = sites.select(*keys, *[F.lit(None).alias(c) for c in points.columns if c not in keys], F.col(site).alias("_t"), F.lit(0).alias("_left"), F.col(site).alias(name))
    both = _carried(rows.unionByName(marks.select(rows.columns)), keys, "_t", F.min(name), True, ranges)
    # later first: a site at the same time comes after the point in this order, so it does not count
    order = W.partitionBy(*keys, "_part").orderBy(F.desc("_t"), F.desc("_left")).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = both.withColumn(name, F.coalesce(F.last(name, ignorenulls=True).over(order), "_carry")).where("_left = 1")
    return found.select(*points.columns, name)


def overlap_semi(a: DataFrame, b: DataFrame, a_lo: str, a_hi: str, b_lo: str, b_hi: str, width: int) -> DataFrame:
    """Rows of a that overlap some row of b: both are dealt into the bins of ``width`` they touch."""
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.greatest(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))))
    left = a.withColumn("_id", F.monotonically_increasing_id()).withColumn("_bin", bins(a_lo, a_hi))
    right = b.select(F.col(b_lo).alias("_lo"), F.col(b_hi).alias("_hi")).where("_lo < _hi").distinct().withColumn("_b", bins("_lo", "_hi"))
    met = left.join(right, (F.col("_bin") == F.col("_b")) & (F.col(a_lo) < F.col("_hi")) & (F.col(a_hi) > F.col("_lo")), "left_semi")
    return met.dropDuplicates(["_id"]).drop("_id", "_bin")


def _reached(access: DataFrame, ranges: DataFrame, lo: Column, hi: Column, once: bool, parts: int = 256) -> DataFrame:
    """Accesses [lo, hi) that lie in a range of their space: those up to whose end the ranges that start at or before lo reach.

    No access meets a range: a running maximum of the ends goes over both in the order of positions. Spaces are cut
    into up to ``parts`` parts, which only place rows; each begins with the farthest end of the parts before it, at
    most ``parts`` rows a space. So an access is shuffled once, whatever the number and size of the ranges that hold it;
    equal accesses lie in one part, so that ``once`` shuffles nothing either.
    """
    points = access.withColumns({"_at": lo.cast("long"), "_to": hi.cast("long")}).where("_at is not null and _to is not null and space is not null")
    facts = ranges.select("space", F.col("base").cast("long").alias("_at"), (F.col("base") + F.col("size")).cast("long").alias("_to")).where("_at < _to and space is not null")
    edges = points.select(F.percentile_approx("_at", [i / parts for i in range(1, parts)], 10_000).alias("e")).first()["e"] or []
    edges = sorted(set(edges))
    step = int(len(edges) ** 0.5) + 1
    count = lambda values: sum(((F.col("_at") > v).cast("int") for v in values), F.lit(0))
    padded = F.array(*[F.lit(e).cast("long") for e in [*edges, *[(1 << 63) - 1] * step]])

    def dealt(df: DataFrame) -> DataFrame:
        """With ``_part``, the number of edges below ``_at``: first among every ``step``-th edge, then among those that follow."""
        some = df.withColumn("_part", count(edges[step - 1 :: step]) * step)
        return some.withColumn("_part", F.col("_part") + count(F.element_at(padded, F.col("_part") + i) for i in range(1, step)))

    facts = dealt(facts)
    order = W.partitionBy("space").orderBy("_part")
    tops = facts.groupBy("space", "_part").agg(F.max("_to").alias("_to"))
    tops = tops.select("space", F.col("_part").alias("_from"), F.max("_to").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("_to"), F.coalesce(F.lead("_part").over(order), F.lit(len(edges))).alias("_last"))
    carried = tops.where("_from < _last").select("space", F.lit(-(1 << 63)).cast("long").alias("_at"), "_to", F.explode(F.sequence(F.col("_from") + 1, F.col("_last"))).alias("_part"))
    names, more = ["space", "_part", "_at", "_to", "_asks"], [c for c in access.columns if c != "space"]
    marks = facts.unionByName(carried).withColumn("_asks", F.lit(0)).select(*names, *[F.lit(None).cast(access.schema[c].dataType).alias(c) for c in more])
    asked = dealt(points).withColumn("_asks", F.lit(1)).select(*names, *more)
    reach = F.max(F.when(F.col("_asks") == 0, F.col("_to"))).over(W.partitionBy("space", "_part").orderBy("_at", "_asks").rowsBetween(W.unboundedPreceding, W.currentRow))
    found = marks.unionByName(asked).withColumn("_reach", reach).where("_asks = 1 and _to <= _reach").select("_part", *access.columns)
    return (found.distinct() if once else found).drop("_part")


def contained(access: DataFrame, ranges: DataFrame, lo: Column, hi: Column, optional: list[tuple[str, str]] = (), bounds: list[tuple[str, str, str]] = (), width: int = 1 << 16, once: bool = False) -> DataFrame:
    """Accesses [lo, hi) inside a range (base, size) of the same space that is valid for them.

    optional: (access column, range column), equal unless the range's is null;
    bounds: (access column, range start, range end), within unless null. With one of these, an access meets ranges in the cell of
    about ``width`` in which it starts and in the dyadic nodes above it, so a range of any size is dealt into few rows.
    Without them, ``_reached`` answers without a join. Empty ranges hold nothing. once: equal accesses come out once.
    """
    if not optional and not bounds:
        return _reached(access, ranges, lo, hi, once)
    right = ranges.withColumnRenamed("space", "_space").withColumn("_end", F.col("base") + F.col("size"))
    held = (F.col("_lo") >= F.col("base")) & (F.col("_hi") <= F.col("_end"))
    for x, y in optional:
        held &= F.col(y).isNull() | (F.col(x) == F.col(y))
    for x, start, end in bounds:
        held &= (F.col(start).isNull() | (F.col(x) >= F.col(start))) & (F.col(end).isNull() | (F.col(x) < F.col(end)))
    found = _hits(access.withColumns({"_lo": lo, "_hi": hi}), "_lo", right, "base", "_end", [F.col("space") == F.col("_space")], held, width.bit_length() - 1, "left_semi").drop("_lo", "_hi")
    return found.distinct() if once else found


def pair_ranges(events: DataFrame, keys: list[str], order: str, kind: str, opens: str, closes: str) -> tuple[DataFrame, DataFrame]:
    """(ranges, errors) from opening and closing events of each key.

    An opening runs to the next event of its key if that closes it, else it stays open (null
    end). An opening that follows an opening, and a closing without one, are errors.
    """
    w = W.partitionBy(*keys).orderBy(order)
    marked = events.where(F.col(kind).isin(opens, closes)).withColumns({"_next": F.lead(kind).over(w), "end": F.lead(order).over(w), "_last": F.lag(kind).over(w)})
    ranges = marked.where(F.col(kind) == opens).select(*keys, F.col(order).alias("start"), F.when(F.col("_next") == closes, F.col("end")).alias("end"))
    wrong = ((F.col(kind) == opens) & (F.col("_last") == opens)) | ((F.col(kind) == closes) & (F.coalesce(F.col("_last"), F.lit(closes)) == closes))
    return ranges, marked.where(wrong).select(*keys, order, kind)


def set_compare(golden: DataFrame, run: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows that only one side has or that differ: keys, golden value, run value, difference."""
    a, b = golden.select(*keys, F.col(value).alias("golden")), run.select(*keys, F.col(value).alias("run"))
    a, b = a.withColumn("_a", F.lit(True)), b.withColumn("_b", F.lit(True))
    kind = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col("golden") == F.col("run"), "same").otherwise("different")
    return a.join(b, keys, "full_outer").withColumn("difference", kind).where("difference <> 'same'").drop("_a", "_b")


def missing_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has, and which."""
    only = lambda x, y, name: x.select(*keys).distinct().join(y.select(*keys).distinct(), keys, "left_anti").withColumn("missing", F.lit(name))
    return only(left, right, "right").unionByName(only(right, left, "left"))
