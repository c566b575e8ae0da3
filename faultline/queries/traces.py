"""Lifetimes, interval and as-of joins, order-dependent merges and series over the event trace.

A purchase writes, a view or click reads; ``(cycle, idx)`` is a total order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs, history, intervals, lifetimes, liveness, ordered, residency, sampling, series
from ..sources import text as T
from ..streaming import snapshots
from . import TRACE_SQL, query, trace

HOUR, DAY = 3_600_000_000, 86_400_000_000

VERSIONS_SQL = f"""{TRACE_SQL}, x AS (SELECT *, sum(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY thread ORDER BY cycle, idx) AS version FROM t WHERE kind IN ('purchase', 'view', 'click')),
v AS (SELECT thread, CAST(version AS BIGINT) AS version, min(cycle) FILTER (kind = 'purchase') AS start, max(cycle) FILTER (kind <> 'purchase') AS last_read, count(*) FILTER (kind <> 'purchase') AS n_reads FROM x GROUP BY 1, 2)"""


def _versions(read, domain_start=None):
    rows = trace(read).where(F.col("kind").isin("purchase", "view", "click"))
    return lifetimes.versions(rows, ["thread"], "cycle", "idx", F.col("kind") == "purchase", domain_start)


def _bounded(read):
    """Versions whose last one ends after all events, so that they can be dealt into buckets."""
    end = trace(read).agg((F.max("cycle") + 1).alias("e")).first()["e"] or 0
    return _versions(read).withColumn("end", F.coalesce("end", F.lit(end)))


@query(f"""WITH {VERSIONS_SQL} SELECT thread, version, coalesce(start, 0) AS start, last_read, n_reads, lead(coalesce(start, 0)) OVER (PARTITION BY thread ORDER BY version) AS "end" FROM v""")
def register_lifetimes(read):
    return _versions(read, F.lit(0).cast("long"))


@query(f"""WITH {TRACE_SQL}, b AS (SELECT cycle, idx, kind, addr * 2 + i AS byte FROM t, range(4) r(i) WHERE kind IN ('purchase', 'view', 'click')),
x AS (SELECT *, sum(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY byte ORDER BY cycle, idx) AS version FROM b),
v AS (SELECT byte, CAST(version AS BIGINT) AS version, min(cycle) FILTER (kind = 'purchase') AS start, max(cycle) FILTER (kind <> 'purchase') AS last_read, count(*) FILTER (kind <> 'purchase') AS n_reads FROM x GROUP BY 1, 2)
SELECT *, lead(start) OVER (PARTITION BY byte ORDER BY version) AS "end" FROM v WHERE version > 0""")
def shared_lifetimes(read):
    rows = trace(read).where(F.col("kind").isin("purchase", "view", "click")).select("cycle", "idx", "kind", (F.col("addr") * 2).alias("at"), F.lit(4).cast("long").alias("size"))
    return lifetimes.versions(lifetimes.byte_accesses(rows, "at", "size"), ["byte"], "cycle", "idx", F.col("kind") == "purchase")


@query(f"""WITH {TRACE_SQL}, a AS (SELECT thread % 10 AS app, count(DISTINCT cycle) AS cycles, count(DISTINCT thread) AS threads, count(DISTINCT thread % 7) AS blocks, count(DISTINCT addr % 5) AS shaders, bool_or(kind = 'purchase' AND thread % 3 = 0) AS seen, count(DISTINCT addr) AS registers FROM t GROUP BY 1),
g AS (SELECT *, [64, 32, 0][app % 3 + 1] AS sets, app + 1 AS ways, CASE WHEN app % 4 = 0 THEN 57 WHEN app % 3 = 2 THEN 0 ELSE 64 - 7 - [6, 5][app % 3 + 1] END AS tag FROM a),
c AS (SELECT app, cycles, unnest(['rf', 'smem_rf', 'l1d', 'l2']) AS component, unnest([threads, blocks, shaders, 1]) AS seeds,
  unnest([registers * CASE WHEN app % 2 = 0 THEN 32 ELSE 64 END, CASE WHEN seen THEN greatest(app * 100, 1) ELSE 0 END, CASE WHEN app = 5 THEN 4096 ELSE sets * ways * CASE WHEN sets > 0 THEN 1024 + tag ELSE 0 END END, 128 * 4 * (1024 + tag) * 2 * 3]) AS bits FROM g)
SELECT app, component, seeds, CAST(bits AS BIGINT) AS bits, CAST(CAST(cycles AS HUGEINT) * seeds * bits AS BIGINT) AS total FROM c""")
def component_domains(read):
    """Sampling spaces of registers, shared memory and both caches of every program."""
    t = trace(read).withColumn("app", F.col("thread") % 10)
    a = t.groupBy("app").agg(
        F.count_distinct("cycle").alias("cycles"), F.count_distinct("thread").alias("threads"), F.count_distinct(F.col("thread") % 7).alias("blocks"), F.count_distinct(F.col("addr") % 5).alias("shaders"),
        F.bool_or((F.col("kind") == "purchase") & (F.col("thread") % 3 == 0)).alias("shared_seen"), F.count_distinct("addr").alias("registers"),
    )
    app = F.col("app")
    sets = F.element_at(F.array(F.lit(64), F.lit(32), F.lit(0)), (app % 3 + 1).cast("int"))
    geometry = lambda s, w: T.cache_geometry(F.concat(F.lit("S:"), s.cast("string"), F.lit(":128:"), w.cast("string")))
    facts = a.withColumns({
        "datatype_bits": F.when(app % 2 == 0, 0).otherwise(64), "smem_bits": app * 100, "l1d": geometry(sets, app + 1), "l2": geometry(F.lit(128), F.lit(4)), "memories": F.lit(2), "partitions": F.lit(3),
        "tag_bits": F.when(app % 4 == 0, 57), "l1d_bits": F.when(app == 5, 4096).otherwise(0), "l2_bits": F.lit(None).cast("long"),
    })
    return sampling.component_domains(facts, ["app"]).withColumn("total", F.col("total").cast("long"))


@query(f"""WITH {VERSIONS_SQL}, w AS (SELECT *, lead(start) OVER (PARTITION BY thread ORDER BY version) AS stop FROM v WHERE version > 0), p AS (SELECT thread, cycle AS moment FROM t WHERE kind = 'signup')
SELECT p.thread, moment, version, CASE WHEN version IS NULL THEN NULL WHEN moment < last_read THEN 'dcr' ELSE 'benign' END AS class
FROM p LEFT JOIN w ON p.thread = w.thread AND start <= moment AND (stop IS NULL OR moment < stop)""")
def point_in_version(read):
    points = trace(read).where("kind = 'signup'").select("thread", F.col("cycle").alias("moment"))
    held = intervals.point_in_interval(points, _bounded(read), ["thread"], "moment", "start", "end", bucket=DAY)
    return held.select("thread", "moment", "version", F.when(F.col("version").isNotNull(), lifetimes.liveness_class(F.col("moment"), F.col("last_read"))).alias("class"))


@query(f"""WITH {TRACE_SQL} SELECT p.thread, p.idx, p.cycle AS at, min(l.cycle) AS next_load FROM t p LEFT JOIN t l ON p.thread = l.thread AND l.kind IN ('view', 'click') AND l.cycle > p.cycle
WHERE p.kind = 'purchase' GROUP BY 1, 2, 3""")
def first_load_after(read):
    t = trace(read)
    points = t.where("kind = 'purchase'").select("thread", "idx", F.col("cycle").alias("at"))
    return intervals.first_after(points, t.where("kind in ('view', 'click')").select("thread", F.col("cycle").alias("load")), ["thread"], "at", "load")


def _asof(read, strict):
    t = trace(read).select((F.col("thread") % 50).alias("key"), F.floor(F.col("cycle") / HOUR).alias("hour"), "idx", "kind", F.col("addr").alias("written"))
    # one write a key and hour, the last, so that an hour names it
    writes = t.where("kind = 'purchase'").groupBy("key", "hour").agg(F.max_by("written", "idx").alias("written"))
    return intervals.as_of(t.where("kind in ('view', 'click')").select("key", "hour", "idx"), writes, ["key"], ["hour"], "written", strict)


ASOF_SQL = f"""WITH {TRACE_SQL}, h AS (SELECT thread % 50 AS key, cycle // {HOUR} AS hour, idx, kind, addr FROM t), w AS (SELECT key, hour, arg_max(addr, idx) AS written FROM h WHERE kind = 'purchase' GROUP BY 1, 2),
r AS (SELECT key, hour, idx FROM h WHERE kind IN ('view', 'click')) SELECT r.key, r.hour, r.idx, w.written FROM r ASOF LEFT JOIN w ON r.key = w.key AND r.hour """


@query(ASOF_SQL + ">= w.hour")
def asof_inclusive(read):
    return _asof(read, False)


@query(ASOF_SQL + "> w.hour")
def asof_strict(read):
    return _asof(read, True)


@query("""WITH b AS (SELECT DISTINCT o_custkey * 40 AS lo, o_custkey * 40 + o_orderkey % 23 AS hi FROM orders WHERE o_orderkey % 23 > 0)
SELECT p_partkey, p_partkey * 31 AS lo, p_partkey * 31 + p_size AS hi FROM part a WHERE p_size > 0 AND EXISTS (SELECT 1 FROM b WHERE a.p_partkey * 31 < b.hi AND a.p_partkey * 31 + a.p_size > b.lo)""")
def overlap_semi(read):
    a = read("part").where("p_size > 0").select("p_partkey", (F.col("p_partkey") * 31).alias("lo"), (F.col("p_partkey") * 31 + F.col("p_size")).alias("hi"))
    b = read("orders").select((F.col("o_custkey") * 40).alias("base"), (F.col("o_custkey") * 40 + F.col("o_orderkey") % 23).alias("top"))
    return intervals.overlap_semi(a, b, "lo", "hi", "base", "top", 256)


@query(f"""WITH {TRACE_SQL}, r AS (SELECT n_nationkey AS base, 6 AS size, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey END AS owner FROM nation)
SELECT idx FROM t WHERE EXISTS (SELECT 1 FROM r WHERE t.addr >= base AND t.addr + 4 <= base + size AND (owner IS NULL OR owner = t.thread % 5))""")
def contained_access(read):
    t = trace(read).select("idx", F.lit("global").alias("space"), "addr", (F.col("thread") % 5).alias("cta"))
    ranges = read("nation").select(F.lit("global").alias("space"), F.col("n_nationkey").alias("base"), F.lit(6).alias("size"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey")).alias("only"))
    return intervals.contained(t, ranges, F.col("addr"), F.col("addr") + 4, [("cta", "only")]).select("idx")


PAIRS_SQL = f"""WITH {TRACE_SQL}, m AS (SELECT thread, idx, kind, lead(kind) OVER w AS nk, lead(idx) OVER w AS ni, lag(kind) OVER w AS lk FROM t WHERE kind IN ('signup', 'error') WINDOW w AS (PARTITION BY thread ORDER BY idx))"""


@query(PAIRS_SQL + """ SELECT thread, idx AS start, CASE WHEN nk = 'error' THEN ni END AS "end" FROM m WHERE kind = 'signup'""")
def paired_ranges(read):
    return intervals.pair_ranges(trace(read), ["thread"], "idx", "kind", "signup", "error")[0]


@query(PAIRS_SQL + " SELECT thread, idx, kind FROM m WHERE (kind = 'signup' AND lk = 'signup') OR (kind = 'error' AND coalesce(lk, 'error') = 'error')")
def pairing_errors(read):
    return intervals.pair_ranges(trace(read), ["thread"], "idx", "kind", "signup", "error")[1]


WRITERS_SQL = f"WITH {TRACE_SQL}, w AS (SELECT addr * 2 + i AS byte, max(idx) AS last_index, count(*) AS n_writes FROM t, range(4) r(i) WHERE kind = 'purchase' GROUP BY 1)"


def _writers(read):
    stores = trace(read).where("kind = 'purchase'").select("idx", (F.col("addr") * 2).alias("at"), F.lit(4).cast("long").alias("size"))
    return ordered.last_writer(lifetimes.byte_accesses(stores, "at", "size"), ["byte"], "idx")


@query(WRITERS_SQL + " SELECT * FROM w")
def last_writer(read):
    return _writers(read)


@query(WRITERS_SQL + " SELECT round(sum(n_writes - 1) / sum(n_writes)::DOUBLE, 6) AS overwritten FROM w")
def overwritten_share(read):
    return ordered.overwritten_share(_writers(read)).select(F.round("overwritten", 6).alias("overwritten"))


@query(f"""WITH {TRACE_SQL} SELECT thread, addr % 10 AS reg, min(idx) AS idx, max(addr % 33) AS width, CAST(bit_or(addr * 2654435761) AS BIGINT) AS observed, CAST(bit_or(idx) AS BIGINT) AS due,
    CASE WHEN min(kind) = max(kind) THEN min(kind) ELSE 'merged' END AS kind, CAST(bit_count(CAST(bit_or(addr * 2654435761) AS BIGINT)) AS INT) AS live, CAST(64 - bit_count(CAST(bit_or(addr * 2654435761) AS BIGINT)) AS INT) AS benign FROM t GROUP BY 1, 2""")
def or_merge(read):
    rows = trace(read).select("thread", (F.col("addr") % 10).alias("reg"), "idx", (F.col("addr") % 33).alias("width"), (F.col("addr") * 2654435761).alias("observed"), F.col("idx").alias("due"), "kind")
    live, benign = ordered.live_bits(F.col("observed"), 64)
    return ordered.or_merge(rows, ["thread", "reg"], "idx", "width", ["observed", "due"], "kind").withColumns({"live": live, "benign": benign})


@query("""SELECT source, lang, n_chars % 50 AS len, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2, 3""")
def dedupe_first(read):
    rows = read("documents").select("source", "lang", (F.col("n_chars") % 50).alias("len"), "doc_id")
    return ordered.first_of(rows, ["source", "lang", "len"], ["doc_id"])


@query(f"""WITH {TRACE_SQL}, h AS (SELECT kind, cycle // {HOUR} AS x, count(*) AS y FROM t GROUP BY 1, 2), d AS (SELECT *, lag(y) OVER w AS py, x - lag(x) OVER w AS step FROM h WINDOW w AS (PARTITION BY kind ORDER BY x)),
f AS (SELECT *, first_value(step IGNORE NULLS) OVER (PARTITION BY kind ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dx FROM d)
SELECT kind, x, y, round((CASE WHEN y < py THEN y ELSE y - py END)::DOUBLE / dx, 6) AS rate FROM f""")
def counter_derivative(read):
    hours = trace(read).groupBy("kind", F.floor(F.col("cycle") / HOUR).alias("x")).agg(F.count(F.lit(1)).alias("y"))
    return series.derivative(hours, ["kind"], "x", "y").withColumn("rate", F.round("rate", 6))


@query(f"""WITH {TRACE_SQL}, s AS (SELECT thread, idx, addr AS x, sum(new) OVER (PARTITION BY thread ORDER BY cycle, idx) AS segment FROM (SELECT *, CASE WHEN addr <= lag(addr) OVER (PARTITION BY thread ORDER BY cycle, idx) THEN 1 ELSE 0 END AS new FROM t)),
e AS (SELECT thread, segment, coalesce(sum(max(x)) OVER (PARTITION BY thread ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM s GROUP BY 1, 2)
SELECT thread, CAST(segment AS BIGINT) AS segment, idx, x, CAST(x + off AS BIGINT) AS stitched FROM s JOIN e USING (thread, segment)""")
def segment_stitch(read):
    rows = trace(read).select("thread", "cycle", "idx", F.col("addr").alias("x"))
    return series.stitched(rows, ["thread"], ["cycle", "idx"], "x").select("thread", "segment", "idx", "x", "stitched")


@query(f"""WITH {TRACE_SQL}, r AS (SELECT kind, addr, row_number() OVER (PARTITION BY kind ORDER BY idx) - 1 AS i, count(*) OVER (PARTITION BY kind) AS n FROM t)
SELECT kind, CAST(i // ((n + 511) // 512) AS BIGINT) AS bin, CAST(sum(addr) // count(*) AS BIGINT) AS mean, count(*) AS n FROM r GROUP BY 1, 2""")
def downsample_512(read):
    return series.binned(trace(read).select("kind", "idx", "addr"), ["kind"], ["idx"], "addr", 512)


@query("""WITH i AS (SELECT o_custkey, o_orderkey, o_orderkey // 3 - row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey // 3) AS island FROM (SELECT DISTINCT o_custkey, o_orderkey // 3 * 3 AS o_orderkey FROM orders))
SELECT o_custkey, min(o_orderkey // 3) AS start, count(*) AS count FROM i GROUP BY o_custkey, island""")
def rle_islands(read):
    ids = read("orders").select("o_custkey", F.floor(F.col("o_orderkey") / 3).alias("id")).distinct()
    return series.runs(ids, ["o_custkey"], "id")


@query(f"""WITH {TRACE_SQL}, r AS (SELECT thread, kind IN ('view', 'click', 'signup') AS inside, row_number() OVER (PARTITION BY thread ORDER BY cycle, idx) AS i FROM t),
g AS (SELECT *, sum(CASE WHEN inside THEN 0 ELSE 1 END) OVER (PARTITION BY thread ORDER BY i) AS island FROM r)
SELECT thread, CAST(min(i) AS INT) AS first, count(*) AS length FROM g WHERE inside GROUP BY thread, island HAVING count(*) >= 2""")
def basic_blocks(read):
    return series.blocks(trace(read), ["thread"], ["cycle", "idx"], F.col("kind").isin("view", "click", "signup"))


@query(f"WITH {TRACE_SQL} SELECT thread, addr, idx, CAST(row_number() OVER (PARTITION BY thread, addr ORDER BY idx) AS INT) AS occurrence FROM t")
def occurrence_number(read):
    return ordered.occurrence(trace(read).select("thread", "addr", "idx"), ["thread", "addr"], ["idx"])


@query(f"""WITH {TRACE_SQL}, l AS (SELECT thread, cycle < lag(cycle) OVER (PARTITION BY thread ORDER BY idx) AS worse FROM t) SELECT thread, NOT bool_or(coalesce(worse, false)) AS is_sorted FROM l GROUP BY 1""")
def sortedness(read):
    return series.is_sorted(trace(read), ["thread"], "idx", ["cycle"])


@query(f"""WITH {TRACE_SQL}, w AS (SELECT DISTINCT addr // 10 AS core, addr % 10 AS slot FROM t)
SELECT core, slot, CAST(row_number() OVER (PARTITION BY core ORDER BY (slot - 3 - 1 + 10) % 10, slot) AS INT) AS turn FROM w""")
def round_robin(read):
    slots = trace(read).select(F.floor(F.col("addr") / 10).alias("core"), (F.col("addr") % 10).alias("slot")).distinct().withColumn("last", F.lit(3))
    return series.rotated(slots, ["core"], "slot", "last", 10).select("core", "slot", "turn")


@query(f"""WITH {TRACE_SQL}, w AS (SELECT addr // 10 AS core, addr % 10 AS slot, min(idx) AS age FROM t GROUP BY 1, 2)
SELECT core, slot, CAST(row_number() OVER (PARTITION BY core ORDER BY CASE WHEN slot = 3 THEN 0 ELSE 1 END, age, slot) AS INT) AS turn FROM w""")
def greedy_then_oldest(read):
    slots = trace(read).groupBy(F.floor(F.col("addr") / 10).alias("core"), (F.col("addr") % 10).alias("slot")).agg(F.min("idx").alias("age")).withColumn("last", F.lit(3))
    return series.oldest_first(slots, ["core"], "slot", "last", "age").select("core", "slot", "turn")


@query(f"""WITH {TRACE_SQL}, d AS (SELECT thread // 32 AS warp, thread % 32 AS lane, bool_or(kind = 'error' AND addr > 50) AS p FROM t GROUP BY 1, 2)
SELECT warp, bool_and(p) AS vote_all, bool_or(p) AS vote_any, bool_and(p) OR NOT bool_or(p) AS vote_uni, CAST(sum(CASE WHEN p THEN 1::BIGINT << CAST(lane AS INT) ELSE 0 END) AS BIGINT) AS ballot, CAST(sum(1::BIGINT << CAST(lane AS INT)) AS BIGINT) AS active FROM d GROUP BY 1""")
def warp_vote_ballot(read):
    lanes = trace(read).groupBy(F.floor(F.col("thread") / 32).alias("warp"), (F.col("thread") % 32).alias("lane")).agg(F.bool_or((F.col("kind") == "error") & (F.col("addr") > 50)).alias("p"))
    return ordered.vote(lanes, ["warp"], "lane", F.col("p"))


@query(f"""WITH {TRACE_SQL}, d AS (SELECT thread // 64 AS block, thread, bool_or(kind = 'error' AND addr > 50) AS p FROM t GROUP BY 1, 2)
SELECT block, CAST(sum(p::INT) AS BIGINT) AS red_popc, bool_and(p) AS red_and, bool_or(p) AS red_or FROM d GROUP BY 1""")
def barrier_reduction(read):
    threads = trace(read).groupBy(F.floor(F.col("thread") / 64).alias("block"), "thread").agg(F.bool_or((F.col("kind") == "error") & (F.col("addr") > 50)).alias("p"))
    return ordered.barrier_reduce(threads, ["block"], F.col("p"))


@query(f"""WITH {TRACE_SQL}, d AS (SELECT thread // 32 AS warp, thread % 32 AS lane, max(addr) AS v FROM t GROUP BY 1, 2)
SELECT a.warp, a.lane, CASE WHEN a.lane + 5 > 31 THEN a.v ELSE coalesce(b.v, 0) END AS down5, CASE WHEN a.lane - 3 < 0 THEN a.v ELSE coalesce(c.v, 0) END AS up3, coalesce(e.v, 0) AS bfly7
FROM d a LEFT JOIN d b ON a.warp = b.warp AND b.lane = a.lane + 5 LEFT JOIN d c ON a.warp = c.warp AND c.lane = a.lane - 3 LEFT JOIN d e ON a.warp = e.warp AND e.lane = xor(a.lane, 7)""")
def warp_shuffle(read):
    lanes = trace(read).groupBy(F.floor(F.col("thread") / 32).alias("warp"), (F.col("thread") % 32).alias("lane")).agg(F.max("addr").alias("v"))
    moved = lambda kind, n, name: ordered.shuffle_lanes(lanes, ["warp"], "lane", "v", kind, n).select("warp", "lane", F.col("shuffled").alias(name))
    return moved("down", 5, "down5").join(moved("up", 3, "up3"), ["warp", "lane"]).join(moved("bfly", 7, "bfly7"), ["warp", "lane"])


@query("""SELECT l_suppkey, bit_and(l_partkey) AS atom_and, bit_or(l_partkey) AS atom_or, bit_xor(l_partkey) AS atom_xor, CAST(sum(l_partkey) AS BIGINT) AS atom_add, min(l_partkey) AS atom_min, max(l_partkey) AS atom_max FROM lineitem GROUP BY 1""")
def atomic_order_free(read):
    return ordered.atomic_free(read("lineitem"), ["l_suppkey"], "l_partkey")


@query(f"WITH {TRACE_SQL} SELECT addr, arg_max(thread, idx) AS atom FROM t GROUP BY addr")
def atomic_exchange(read):
    return ordered.atomic_fold(trace(read).select("addr", "idx", "thread"), ["addr"], ["idx"], "exch", "thread")


@query(f"""WITH RECURSIVE {TRACE_SQL}, r AS (SELECT addr, thread % 7 AS most, row_number() OVER (PARTITION BY addr ORDER BY idx) AS i FROM t),
f(addr, i, atom) AS (SELECT addr, 0::BIGINT, 0::BIGINT FROM (SELECT DISTINCT addr FROM r) UNION ALL SELECT r.addr, r.i, CASE WHEN f.atom >= most THEN 0 ELSE f.atom + 1 END FROM f JOIN r ON r.addr = f.addr AND r.i = f.i + 1)
SELECT addr, arg_max(atom, i) AS atom FROM f GROUP BY addr""")
def atomic_increment(read):
    return ordered.atomic_fold(trace(read).select("addr", "idx", (F.col("thread") % 7).alias("limit")), ["addr"], ["idx"], "inc", "limit")


LRU_SQL = f"""{TRACE_SQL}, a AS (SELECT addr % 8 AS set, addr AS line, cycle, idx, kind = 'purchase' AS store, row_number() OVER (PARTITION BY addr % 8 ORDER BY cycle, idx) AS n FROM t),
p AS (SELECT *, lag(n) OVER (PARTITION BY set, line ORDER BY n) AS prev FROM a),
f AS (SELECT i.set, i.n, j.n AS m, row_number() OVER (PARTITION BY i.set, i.n ORDER BY j.n) AS k FROM p i JOIN p j ON i.set = j.set AND j.n > i.n AND j.line <> i.line AND (j.prev IS NULL OR j.prev < i.n)),
h AS (SELECT p.*, CASE WHEN p.prev IS NULL OR f.m < p.n THEN 1 ELSE 0 END AS miss FROM p LEFT JOIN f ON f.set = p.set AND f.n = p.prev AND f.k = 4),
o AS (SELECT *, sum(miss) OVER (PARTITION BY set, line ORDER BY n) AS nth FROM h),
e AS (SELECT set, line, nth, min(n) AS first_n, max(n) AS last_n, min(cycle) AS start, count(*) - 1 AS hits, bool_or(store) AS dirty FROM o GROUP BY 1, 2, 3),
g AS (SELECT e.*, f.m AS out_n, c.cycle AS "end", row_number() OVER (PARTITION BY e.set ORDER BY first_n) AS born FROM e LEFT JOIN f ON f.set = e.set AND f.n = e.last_n AND f.k = 4 LEFT JOIN a c ON c.set = e.set AND c.n = f.m),
w(set, first_n, way) AS (SELECT set, first_n, CAST(born - 1 AS INT) FROM g WHERE born <= 4 UNION ALL SELECT g.set, g.out_n, w.way FROM w JOIN g ON g.set = w.set AND g.first_n = w.first_n WHERE g.out_n IS NOT NULL),
episodes AS (SELECT g.set, line, nth, g.first_n, way, start, "end", hits, dirty FROM g JOIN w ON w.set = g.set AND w.first_n = g.first_n)"""


def _lines(read):
    return trace(read).select((F.col("addr") % 8).alias("set"), F.col("addr").alias("line"), "cycle", "idx", (F.col("kind") == "purchase").alias("store"))


@query(f"""WITH RECURSIVE {LRU_SQL} SELECT set, line, way, start, "end", hits, dirty FROM episodes""")
def lru_residency(read):
    return residency.lru_episodes(_lines(read), ["set"], ["cycle", "idx"], "line", 4, "store")


@query(f"""WITH RECURSIVE {LRU_SQL}, z AS (SELECT max(cycle) + 1 AS stop, min(cycle) AS lo, max(cycle) - min(cycle) AS span FROM t),
b AS (SELECT o.set, o.line, o.nth, o.idx % 4 AS off, o.n, o.cycle, o.store FROM o),
v AS (SELECT *, sum(store::INT) OVER (PARTITION BY set, line, nth, off ORDER BY n) AS version FROM b),
u AS (SELECT set, line, nth, off, version, min(cycle) FILTER (store) AS start, max(cycle) FILTER (NOT store) AS last_load FROM v GROUP BY 1, 2, 3, 4, 5),
x AS (SELECT * FROM u UNION ALL SELECT set, line, nth, off, 0, NULL, NULL FROM u GROUP BY 1, 2, 3, 4 HAVING min(version) > 0),
y AS (SELECT x.*, lead(x.start) OVER (PARTITION BY x.set, x.line, x.nth, off ORDER BY version) AS next FROM x),
d AS (SELECT i AS trial, (i * 2654435761) % 4294967296 % 100000 AS x0, (i * 2654435761 + 40503) % 4294967296 % 32 AS x1, (i * 2654435761 + 81006) % 4294967296 % 89 AS bit FROM range(2000) r(i)),
q AS (SELECT trial, x1 // 4 AS set, x1 % 4 AS way, bit, lo + x0 * (span // 100000) AS moment FROM d, z)
SELECT q.trial, q.set, CAST(q.way AS INT) AS way, q.bit, q.moment, CASE WHEN e.set IS NULL THEN 'benign' WHEN q.bit >= 32 THEN 'ebc'
  WHEN q.moment < (CASE WHEN y.version > 0 AND y.next IS NULL THEN coalesce(e."end", z.stop) ELSE y.last_load END) THEN 'dcr' ELSE 'benign' END AS class
FROM q CROSS JOIN z LEFT JOIN episodes e ON e.set = q.set AND e.way = q.way AND e.start <= q.moment AND q.moment < coalesce(e."end", z.stop)
LEFT JOIN y ON y.set = e.set AND y.line = e.line AND y.nth = e.nth AND y.off = q.bit // 8 AND coalesce(y.start, e.start) <= q.moment AND q.moment < coalesce(y.next, e."end", z.stop)""")
def cache_campaign(read):
    """Lines of 4 data bytes and a tag of 57 bits; an access touches the byte of its number modulo 4."""
    rows = _lines(read)
    lo, hi = rows.agg(F.min("cycle"), F.max("cycle")).first()
    episodes, found = residency.byte_versions(rows, ["set"], ["cycle", "idx"], "line", 4, "store", F.array(F.col("idx") % 4), hi + 1)
    draws = sampling.hash_draws(rows.sparkSession, 2000, [100_000, 32, 89])
    points = draws.select("trial", F.floor(F.col("x1") / 4).alias("set"), (F.col("x1") % 4).cast("int").alias("way"), F.col("x2").alias("bit"), (lo + F.col("x0") * ((hi - lo) // 100_000)).alias("moment"))
    return residency.cache_class(points, episodes, found, ["set"], "moment", 4)


def _flow(read):
    """Parts as instructions: 40 of them make a program."""
    at = F.col("p_partkey")
    rows = read("part").select(F.floor(at / 40).alias("program"), ((at % 40) * 8).alias("pc"), F.element_at(F.array(*[F.lit(k) for k in ("inst", "branch", "min", "inst", "load")]), (F.col("p_size") % 5 + 1).cast("int")).alias("kind"), ((F.col("p_size") % 40) * 8).alias("target"))
    kind = F.when(F.col("pc") == 312, "exit").otherwise(F.col("kind"))
    rows = rows.withColumn("kind", kind)
    after = F.when(F.col("kind") == "exit", F.array(F.lit(None).cast("long"))).when(F.col("kind") == "branch", F.array_distinct(F.array(F.col("target").cast("long"), F.col("pc") + 8))).otherwise(F.array(F.col("pc") + 8))
    return rows.withColumn("succ", F.explode(after))


FLOW_SQL = """n AS (SELECT p_partkey // 40 AS program, p_partkey % 40 * 8 AS pc, CASE WHEN p_partkey % 40 = 39 THEN 'exit' ELSE ['inst', 'branch', 'min', 'inst', 'load'][p_size % 5 + 1] END AS kind, p_size % 40 * 8 AS target FROM part),
e AS (SELECT program, pc, pc + 8 AS succ FROM n WHERE kind <> 'exit' UNION SELECT program, pc, target FROM n WHERE kind = 'branch'), v0 AS (SELECT program, pc, 1e0 AS p FROM n)"""
#: Survival after 16 steps: the recurrence 15 times.
MASKING_SQL = FLOW_SQL + "".join(
    f""", v{i} AS (SELECT n.program, n.pc, CASE WHEN kind IN ('branch', 'min', 'max') THEN 0.5e0 ELSE 1e0 END * coalesce(avg(v{i - 1}.p), 1) AS p
FROM n LEFT JOIN (e JOIN v{i - 1} ON v{i - 1}.program = e.program AND v{i - 1}.pc = e.succ) ON e.program = n.program AND e.pc = n.pc GROUP BY n.program, n.pc, kind)"""
    for i in range(1, 16)
)
SITE_SQL = MASKING_SQL + ", site AS (SELECT e.program, e.pc, avg(p) AS site_probability FROM e JOIN v15 ON v15.program = e.program AND v15.pc = e.succ GROUP BY 1, 2)"


@query(f"WITH {MASKING_SQL} SELECT program, pc, round(p, 12) AS probability FROM v15")
def masking_probability(read):
    return graphs.masking_probability(_flow(read), "program", "pc", "succ", "kind").withColumn("probability", F.round("probability", 12))


def _sites(read):
    flow = _flow(read)
    p = graphs.masking_probability(flow, "program", "pc", "succ", "kind")
    return graphs.site_probability(p, flow.where("succ is not null").select("program", "pc", "succ"), ["program"], "pc", "succ")


@query(f"WITH {SITE_SQL} SELECT program, pc, round(site_probability, 12) AS site_probability FROM site")
def site_probability(read):
    return _sites(read).withColumn("site_probability", F.round("site_probability", 12))


SHARED_SQL = f"""{SITE_SQL}, {TRACE_SQL}, b AS (SELECT cycle, idx, kind, addr * 2 + i AS byte FROM t, range(4) r(i) WHERE kind IN ('purchase', 'view', 'click')),
y AS (SELECT *, sum(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY byte ORDER BY cycle, idx) AS version FROM b),
u AS (SELECT byte, version, min(cycle) FILTER (kind = 'purchase') AS start, max(cycle) FILTER (kind <> 'purchase') AS last_read FROM y GROUP BY 1, 2),
w AS (SELECT *, lead(start) OVER (PARTITION BY byte ORDER BY version) AS stop FROM u WHERE version > 0),
z AS (SELECT min(cycle) AS lo, max(cycle) - min(cycle) AS span, max(addr) * 2 + 4 AS bytes FROM t),
d AS (SELECT i AS trial, (i * 2654435761 + 40503) % 4294967296 % bytes AS byte, lo + (i * 2654435761) % 4294967296 % 100000 * (span // 100000) AS moment FROM range(2000) r(i), z),
h AS (SELECT d.*, version IS NOT NULL AND moment < last_read AS live FROM d LEFT JOIN w ON w.byte = d.byte AND w.start <= moment AND (w.stop IS NULL OR moment < w.stop)),
m AS (SELECT h.trial, h.byte, h.moment, h.live, arg_min(b.idx, (b.cycle, b.idx)) AS load FROM h LEFT JOIN b ON h.live AND b.byte = h.byte AND b.kind <> 'purchase' AND b.cycle > h.moment GROUP BY 1, 2, 3, 4)"""


@query(f"""WITH {SHARED_SQL} SELECT trial, byte, moment, CASE WHEN live THEN 'dcr' ELSE 'benign' END AS class, CASE WHEN live THEN round(coalesce(site_probability, 1), 12) ELSE 1e0 END AS sic
FROM m CROSS JOIN (SELECT max(p_partkey) + 1 AS parts FROM part) q LEFT JOIN site ON program = load % parts // 40 AND pc = load % parts % 40 * 8""")
def shared_campaign(read):
    """Points in bytes of shared memory; one whose version is read later counts with the survival of that load's site.

    Loads are dealt over the instructions of all programs. Moments are drawn in steps of a 100,000th of the span, so its end is never drawn.
    """
    t = trace(read)
    lo, hi, top = t.agg(F.min("cycle"), F.max("cycle"), F.max("addr")).first()
    rows = t.where(F.col("kind").isin("purchase", "view", "click")).select("cycle", "idx", "kind", (F.col("addr") * 2).alias("at"), F.lit(4).cast("long").alias("size"))
    touched = lifetimes.byte_accesses(rows, "at", "size")
    held = lifetimes.versions(touched, ["byte"], "cycle", "idx", F.col("kind") == "purchase").withColumn("end", F.coalesce("end", F.lit(hi + 1)))
    draws = sampling.hash_draws(t.sparkSession, 2000, [100_000, top * 2 + 4])
    points = draws.select("trial", F.col("x1").alias("byte"), (lo + F.col("x0") * ((hi - lo) // 100_000)).alias("moment"))
    found = intervals.point_in_interval(points, held, ["byte"], "moment", "start", "end", bucket=DAY)
    found = found.select("trial", "byte", "moment", F.coalesce(F.col("moment") < F.col("last_read"), F.lit(False)).alias("live"))
    loads = touched.where("kind <> 'purchase'").groupBy("byte", "cycle").agg(F.min("idx").alias("load"))
    after = intervals.first_after(found, loads.select("byte", "cycle"), ["byte"], "moment", "cycle").join(loads.withColumnRenamed("cycle", "next_cycle"), ["byte", "next_cycle"], "left")
    parts = read("part").agg(F.max("p_partkey") + 1).first()[0] or 1
    sites = _sites(read).select((F.col("program") * 40 + F.col("pc") / 8).cast("long").alias("_slot"), "site_probability")
    out = after.join(sites, F.col("load") % parts == F.col("_slot"), "left")
    sic = F.when(F.col("live"), F.round(F.coalesce("site_probability", F.lit(1.0)), 12)).otherwise(1.0)
    return out.select("trial", "byte", "moment", F.when(F.col("live"), "dcr").otherwise("benign").alias("class"), sic.alias("sic"))


@query(f"""WITH RECURSIVE {FLOW_SQL}, e2 AS (SELECT e.program, e.pc, e.succ FROM e),
reached(program, pc) AS (SELECT DISTINCT program, 0::BIGINT FROM e2 UNION SELECT e2.program, e2.succ FROM reached r JOIN e2 ON e2.program = r.program AND e2.pc = r.pc),
without(program, gone, pc) AS (SELECT program, pc, 0::BIGINT FROM reached WHERE pc <> 0 UNION SELECT e2.program, w.gone, e2.succ FROM without w JOIN e2 ON e2.program = w.program AND e2.pc = w.pc AND e2.succ <> w.gone)
SELECT a.program, a.pc AS node, b.pc AS dominator FROM reached a JOIN reached b ON a.program = b.program
WHERE a.pc = b.pc OR b.pc = 0 OR NOT EXISTS (SELECT 1 FROM without w WHERE w.program = a.program AND w.gone = b.pc AND w.pc = a.pc)""")
def dominators(read):
    edges = _flow(read).where("succ is not null").select("program", "pc", "succ", F.lit(0).cast("long").alias("entry"))
    return graphs.dominators(edges, "program", "pc", "succ", "entry")


@query("""SELECT c_custkey AS node, min(c_custkey) OVER (PARTITION BY c_nationkey) AS root FROM customer
UNION ALL SELECT 100000000 + n, r FROM (SELECT c_nationkey AS n, min(c_custkey) AS r FROM customer GROUP BY 1)""")
def connected_components(read):
    edges = read("customer").select("c_custkey", (F.lit(100_000_000).cast("long") + F.col("c_nationkey")).alias("nation"))
    return graphs.connected(edges, "c_custkey", "nation")


@query(f"""WITH {TRACE_SQL}, p AS (SELECT addr, kind, cycle, sum(thread) OVER (PARTITION BY kind ORDER BY idx) AS upto, idx FROM t) SELECT kind, idx, CAST(upto AS BIGINT) AS upto FROM p""")
def prefix_weight(read):
    return series.prefix(trace(read).select("kind", "idx", "thread"), ["kind"], "idx", "thread").drop("thread")


@query(f"""WITH {TRACE_SQL}, r AS (SELECT p_partkey AS k, ['view', 'click'][p_partkey % 2 + 1] AS kind, p_partkey * 3 AS lo, p_partkey * 3 + p_size * 7 AS hi FROM part)
SELECT k, r.kind, lo, hi, CAST(coalesce(sum(thread), 0) AS BIGINT) AS range_weight FROM r LEFT JOIN t ON t.kind = r.kind AND idx >= lo AND idx < hi GROUP BY 1, 2, 3, 4""")
def range_weight(read):
    k = F.col("p_partkey")
    ranges = read("part").select(k.alias("k"), F.when(k % 2 == 0, "view").otherwise("click").alias("kind"), (k * 3).alias("lo"), (k * 3 + F.col("p_size") * 7).alias("hi"))
    return series.range_weight(trace(read), ranges, ["kind"], "idx", "thread", "lo", "hi")


@query(f"""WITH {TRACE_SQL} SELECT CAST(min(cycle) AS BIGINT) AS first_cycle, CAST(max(cycle) + 1 AS BIGINT) AS end_cycle, count(DISTINCT cycle) AS cycles, count(DISTINCT thread) AS threads, count(DISTINCT cycle) * count(DISTINCT thread) * 32 AS bits FROM t""")
def sampling_space(read):
    out = trace(read).agg(F.min("cycle").alias("first_cycle"), (F.max("cycle") + 1).alias("end_cycle"), F.count_distinct("cycle").alias("cycles"), F.count_distinct("thread").alias("threads"))
    return out.withColumn("bits", sampling.domain_bits(F.col("cycles"), F.col("threads"), F.lit(32)))


@query(f"""WITH {VERSIONS_SQL}, w AS (SELECT *, lead(start) OVER (PARTITION BY thread ORDER BY version) AS stop FROM v WHERE version > 0),
n AS (SELECT min(cycle) AS lo, (max(cycle) - min(cycle)) // 1000000 AS span, min(thread) AS first_thread, max(thread) - min(thread) + 1 AS threads FROM t),
d AS (SELECT i AS trial, first_thread + ((i * 2654435761) % 4294967296) % threads AS thread, lo + (((i * 2654435761 + 40503) % 4294967296) % 100000) * span // 100000 * 1000000 AS moment FROM range(2000) r(i), n)
SELECT trial, d.thread, moment, CASE WHEN version IS NOT NULL AND moment < last_read THEN 'dcr' ELSE 'benign' END AS class FROM d LEFT JOIN w ON d.thread = w.thread AND start <= moment AND (stop IS NULL OR moment < stop)""")
def sampled_campaign(read):
    """2,000 trials over all threads and the whole time that the trace has."""
    t = trace(read)
    lo, hi, first, last = t.agg(F.min("cycle"), F.max("cycle"), F.min("thread"), F.max("thread")).first()
    draws = sampling.hash_draws(t.sparkSession, 2000, [last - first + 1, 100_000])
    points = draws.select("trial", (F.col("x0") + first).alias("thread"), (lo + F.floor(F.col("x1") * ((hi - lo) // 1_000_000) / 100_000) * 1_000_000).alias("moment"))
    held = intervals.point_in_interval(points, _bounded(read), ["thread"], "moment", "start", "end", bucket=DAY)
    return held.select("trial", "thread", "moment", F.coalesce(lifetimes.liveness_class(F.col("moment"), F.col("last_read")), F.lit("benign")).alias("class"))


SNAPSHOT_SQL = "s AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1, 2)"


def _snapshots(read):
    rows = read("events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.floor("value").alias("v"))
    return snapshots.snapshots(rows, "ts", ["event_type"], "1 day", "v")


@query(f"WITH {SNAPSHOT_SQL} SELECT CAST(epoch_us(start) AS BIGINT) AS start, event_type, n, total FROM s")
def snapshot_reset(read):
    return _snapshots(read).withColumn("start", F.unix_micros("start"))


@query(f"WITH {SNAPSHOT_SQL} SELECT CAST(epoch_us(start) AS BIGINT) AS start, event_type, n, total, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY start) AS BIGINT) AS carried FROM s")
def snapshot_carry(read):
    return snapshots.carried(_snapshots(read), ["event_type"]).withColumn("start", F.unix_micros("start"))


@query("""WITH a AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, user_id AS thread, arg_max(event_type, ts) AS pc FROM events GROUP BY 1, 2), l AS (SELECT *, lag(pc) OVER (PARTITION BY thread ORDER BY start) AS was FROM a),
m AS (SELECT start, pc, 1 AS d FROM l UNION ALL SELECT start, was, -1 FROM l WHERE was IS NOT NULL), g AS (SELECT start, pc, sum(d) AS d FROM m GROUP BY 1, 2)
SELECT CAST(epoch_us(start) AS BIGINT) AS start, pc, CAST(sum(d) OVER (PARTITION BY pc ORDER BY start) AS BIGINT) AS threads FROM g""")
def occupancy_snapshot(read):
    rows = read("events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("thread"), F.col("event_type").alias("pc"))
    return snapshots.occupancy(rows, "ts", "1 day", "thread", "pc").withColumn("start", F.unix_micros("start"))


def _program(read):
    """Every thread's events as a small program: loads, register operations and stores over ten registers."""
    t = trace(read)
    op = F.element_at(F.array(*[F.lit(k) for k in ("and", "or", "xor", "add", "shl", "selp")]), (F.col("idx") % 6 + 1).cast("int"))
    kind = F.when(F.col("kind") == "purchase", "store").when(F.col("kind") == "view", "load").when(F.col("kind") == "error", "branch").otherwise("inst")
    reg = lambda c: F.concat(F.lit("r"), (c % 10).cast("string"))
    n = F.when(op == "selp", 3).otherwise(2)
    srcs = F.when(kind == "inst", F.slice(F.array(reg(F.col("addr")), reg(F.col("addr") + 3), reg(F.col("addr") + 5)), F.lit(1), n)).otherwise(F.array(reg(F.col("addr")), reg(F.col("addr") + 1)))
    values = F.transform(srcs, lambda r: F.crc32(F.concat(r, F.col("idx").cast("string")).cast("binary")))
    return t.select(
        "thread", "cycle", F.col("idx").alias("index"), op.alias("op"), kind.alias("kind"), F.lit(32).alias("width"), reg(F.col("addr") + 7).alias("dst"), srcs.alias("srcs"), values.alias("values"),
        (F.col("idx") * 40503 % 4294967296).alias("result"), (F.col("idx") * 9973 % 4294967296).alias("old"), F.when(F.col("idx") % 4 == 0, "p0").otherwise("").alias("pred"), (F.col("idx") % 8 != 0).alias("held"),
        F.concat(F.lit("local"), F.col("thread").cast("string")).alias("scope"), (F.col("addr") * 4).alias("addr"), F.lit(4).alias("size"), F.when(F.col("idx") % 3 == 0, 1).alias("base"), F.lit(0).alias("data"), F.lit(1).alias("turns"),
    ).withColumn("moved", F.when(F.col("kind") == "load", F.col("result")).when(F.col("kind") == "store", F.get("values", F.lit(0))))


@query()
def live_bits(read):
    return _live(read)


def _live(read):
    outputs = [(None, a) for a in range(64)]
    rows = history.with_history(_program(read).withColumn("launch", F.col("thread")), "launch", [(0, 512)])
    return liveness.live_records(rows, "launch", outputs, [(0, 512)])


@query()
def derived_rates(read):
    return liveness.bit_rates(_live(read), ["site"])


@query(f"WITH {TRACE_SQL} SELECT addr % 10 AS reg, list_sort(list(DISTINCT thread)) AS uids FROM t GROUP BY 1")
def register_uids(read):
    return trace(read).groupBy((F.col("addr") % 10).alias("reg")).agg(F.sort_array(F.collect_set("thread")).alias("uids"))


@query("""SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_linestatus = 'O') AND NOT (l_returnflag = 'A' AND l_linestatus = 'F')""")
def invalid_combinations(read):
    rows = read("lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()
    invalid = rows.sparkSession.createDataFrame([("R", "O"), ("A", "F")], "l_returnflag string, l_linestatus string")
    return rows.join(invalid, ["l_returnflag", "l_linestatus"], "left_anti")


@query("""WITH m AS (SELECT key, min(brand) AS brand, count(DISTINCT brand) AS matches FROM (SELECT p_partkey // 7 AS key, p_brand AS brand FROM part) GROUP BY 1)
SELECT s_suppkey * 3 AS key, brand, coalesce(matches, 0) AS matches FROM supplier LEFT JOIN m ON s_suppkey * 3 = key""")
def unique_program(read):
    table = read("part").select(F.floor(F.col("p_partkey") / 7).alias("key"), F.col("p_brand").alias("brand"))
    return ordered.only_match(read("supplier").select((F.col("s_suppkey") * 3).alias("key")), table, "key", "brand")


@query("""SELECT o_custkey, max(o_orderdate) AS latest, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run FROM orders GROUP BY 1""")
def latest_run(read):
    return read("orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("latest"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("run"))


@query(f"""WITH {TRACE_SQL} SELECT thread, count(*) FILTER (addr % 4 <> 0 OR idx % 3 <> 0) AS kept, CAST(coalesce(sum(addr % 33) FILTER (addr % 4 = 0 AND idx % 3 = 0), 0) AS BIGINT) AS elided_bits FROM t GROUP BY thread""")
def zero_effect_elision(read):
    rows = trace(read).select("thread", (F.col("addr") % 4).alias("observed"), (F.col("idx") % 3).alias("due"), (F.col("addr") % 33).alias("width"))
    return ordered.elided(rows, ["thread"], ["observed", "due"], "width")


@query(f"""WITH {TRACE_SQL} SELECT addr AS pc, cycle // {DAY} AS sample, count(*) AS n, CAST(sum(thread) AS BIGINT) AS total FROM t GROUP BY 1, 2""")
def pc_cycle_matrix(read):
    return trace(read).groupBy(F.col("addr").alias("pc"), F.floor(F.col("cycle") / DAY).alias("sample")).agg(F.count(F.lit(1)).alias("n"), F.sum("thread").alias("total"))


@query("""WITH s AS (SELECT l_orderkey AS k, list(l_partkey % 3 ORDER BY l_partkey, l_suppkey, l_linenumber) AS q FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem) GROUP BY 1)
SELECT k, min(k) OVER (PARTITION BY q) AS representative FROM s""")
def thread_signatures(read):
    rows = read("lineitem").select(F.col("l_orderkey").alias("k"), "l_partkey", "l_suppkey", "l_linenumber").distinct().withColumn("v", F.col("l_partkey") % 3)
    return ordered.signatures(rows, "k", ["l_partkey", "l_suppkey", "l_linenumber"], ["v"]).select("k", "representative")


@query("""SELECT l_partkey AS key FROM lineitem WHERE l_linestatus = 'O' EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_linestatus = 'F'""")
def key_difference(read):
    side = lambda s: read("lineitem").where(F.col("l_linestatus") == s).select(F.col("l_partkey").alias("key"))
    return side("O").exceptAll(side("F"))


@query("""WITH a AS (SELECT p_partkey AS k, p_partkey * 7 AS lo, p_partkey * 7 + p_size AS hi, (p_partkey * 7) // 64 * 64 + 16 AS base FROM part)
SELECT k, greatest(lo, base) AS first, least(hi, base + 32) AS "end" FROM a WHERE greatest(lo, base) < least(hi, base + 32)""")
def range_intersection(read):
    at = F.col("p_partkey") * 7
    rows = read("part").select(F.col("p_partkey").alias("k"), at.alias("lo"), (at + F.col("p_size")).alias("hi"), (F.floor(at / 64) * 64 + 16).alias("base"))
    return rows.select("k", F.greatest("lo", "base").alias("first"), F.least(F.col("hi"), F.col("base") + 32).alias("end")).where(F.col("first") < F.col("end"))


@query(f"WITH {TRACE_SQL}, c AS (SELECT cycle // {HOUR} AS cycle, thread % 5 AS core, count(*) AS n FROM t GROUP BY 1, 2) SELECT cycle, CAST(sum(n) AS BIGINT) AS multiplicity FROM c GROUP BY 1")
def merged_multiplicity(read):
    cores = trace(read).groupBy(F.floor(F.col("cycle") / HOUR).alias("cycle"), (F.col("thread") % 5).alias("core")).agg(F.count(F.lit(1)).alias("n"))
    return cores.groupBy("cycle").agg(F.sum("n").alias("multiplicity"))
