"""Counters and histograms. Line items stand for memory accesses, events for samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as S
from ..tables import materialize
from . import TRACE_SQL, query, trace

VALUE_SQL = "v AS (SELECT event_type AS kind, CAST(floor(value * 10) AS BIGINT) AS v FROM events)"


def _values(read):
    return read("events").select(F.col("event_type").alias("kind"), F.floor(F.col("value") * 10).cast("long").alias("v"))


@query(f"WITH {VALUE_SQL} SELECT kind, CASE WHEN v <= 0 THEN 0 ELSE CAST(length(ltrim(bin(v), '0')) AS BIGINT) END AS bin, count(*) AS n FROM v GROUP BY ALL")
def pow2_histogram(read):
    return S.histogram(_values(read), ["kind"], S.pow2_bin(F.col("v")))


@query(f"WITH {VALUE_SQL} SELECT kind, greatest(0, least(CAST(floor(v / 64) AS BIGINT), 15)) AS bin, count(*) AS n FROM v GROUP BY ALL")
def linear_histogram(read):
    return S.histogram(_values(read), ["kind"], S.linear_bin(F.col("v"), 64, 16))


@query(f"""WITH {VALUE_SQL}, b AS (SELECT kind, v, CASE WHEN v > 0 THEN length(ltrim(bin(v), '0')) - 1 ELSE 0 END AS n FROM v)
SELECT kind, CASE WHEN v <= 0 THEN 0 ELSE CAST(2 * n + CASE WHEN n > 0 THEN (v >> (n - 1)) & 1 ELSE 0 END AS BIGINT) END AS bin, count(*) AS n FROM b GROUP BY ALL""".replace("count(*) AS n FROM b GROUP BY ALL", "count(*) AS n FROM b GROUP BY 1, 2"))
def logsqrt2_histogram(read):
    return S.histogram(_values(read), ["kind"], S.log_sqrt2_bin(F.col("v")))


@query("""SELECT l_suppkey AS bank, CASE WHEN p <= 0 THEN 0 ELSE CAST(length(ltrim(bin(p), '0')) AS BIGINT) END AS bin, count(*) AS n, CAST(sum(p) AS BIGINT) AS total, max(p) AS most
FROM (SELECT l_suppkey, CAST(floor(l_extendedprice) AS BIGINT) AS p FROM lineitem) GROUP BY 1, 2""")
def log2_latency(read):
    p = read("lineitem").select(F.col("l_suppkey").alias("bank"), F.floor("l_extendedprice").alias("p"))
    return p.groupBy("bank", S.pow2_bin(F.col("p")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("total"), F.max("p").alias("most"))


@query(f"WITH {VALUE_SQL} SELECT kind, count(DISTINCT CASE WHEN v <= 0 THEN 0 ELSE length(ltrim(bin(v), '0')) END) AS bins, max(v) AS most, round(avg(v), 2) AS mean FROM v GROUP BY kind")
def histogram_summary(read):
    return S.summary(_values(read), ["kind"], "v", S.pow2_bin(F.col("v")))


@query("""WITH c AS (SELECT event_type AS kind, least(greatest(value, 10), 90) AS v FROM events)
SELECT kind, count(v) AS n, min(v) AS least, max(v) AS most, round(avg(v), 6) AS mean, round(var_pop(v), 4) AS variance FROM c GROUP BY kind""")
def clamped_statistics(read):
    out = S.accumulated(read("events").select(F.col("event_type").alias("kind"), "value"), ["kind"], "value", 10.0, 90.0)
    return out.withColumns({"mean": F.round("mean", 6), "variance": F.round("variance", 4)})


@query("""WITH m AS (SELECT user_id, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS t, CAST(sum(CAST(floor(value) AS BIGINT)) AS DOUBLE) / count(*) AS mean FROM events GROUP BY 1, 2)
SELECT user_id, CAST(floor(mean / 10) AS BIGINT) AS bin, count(*) AS n FROM m GROUP BY 1, 2""")
def interval_mean_histogram(read):
    rows = read("events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.floor("value").alias("v"))
    return S.interval_means(rows, ["user_id"], "us", "v", 3_600_000_000, lambda m: F.floor(m / 10))


OUTCOME_SQL = """a AS (SELECT l_shipdate, l_suppkey, l_returnflag AS kind, CASE WHEN l_linestatus = 'O' THEN CASE WHEN l_tax > 0.06 THEN 'HIT_RESERVED' ELSE 'HIT' END
    WHEN l_discount > 0.08 THEN 'RESERVATION_FAIL' WHEN l_tax > 0.04 THEN 'SECTOR_MISS' ELSE 'MISS' END AS outcome FROM lineitem)"""


def _accesses(read):
    outcome = F.when(F.col("l_linestatus") == "O", F.when(F.col("l_tax") > 0.06, "HIT_RESERVED").otherwise("HIT")).when(F.col("l_discount") > 0.08, "RESERVATION_FAIL").when(F.col("l_tax") > 0.04, "SECTOR_MISS").otherwise("MISS")
    return read("lineitem").select("l_shipdate", "l_suppkey", F.col("l_returnflag").alias("kind"), outcome.alias("outcome"))


@query(f"WITH {OUTCOME_SQL} SELECT kind, outcome, count(*) AS n, CAST(grouping(kind, outcome) AS BIGINT) AS level FROM a GROUP BY CUBE (kind, outcome)")
def cache_cube(read):
    return S.counter_cube(_accesses(read), "kind", "outcome")


TOTALS_SQL = """count(*) FILTER (outcome <> 'RESERVATION_FAIL') AS accesses, count(*) FILTER (outcome IN ('MISS', 'SECTOR_MISS')) AS misses,
    count(*) FILTER (outcome = 'HIT_RESERVED') AS pending_hits, count(*) FILTER (outcome = 'RESERVATION_FAIL') AS reservation_fails"""


@query(f"WITH {OUTCOME_SQL} SELECT *, round(coalesce(misses / nullif(accesses, 0)::DOUBLE, 0), 6) AS miss_rate FROM (SELECT kind, {TOTALS_SQL} FROM a GROUP BY kind)")
def cache_totals(read):
    return S.cache_totals(_accesses(read), ["kind"], "outcome").withColumn("miss_rate", F.round("miss_rate", 6))


@query(f"""WITH {OUTCOME_SQL}, w AS (SELECT CAST(year(l_shipdate) AS INT) AS "window", kind, count(*) FILTER (outcome IN ('MISS', 'SECTOR_MISS')) AS misses, count(*) FILTER (outcome <> 'RESERVATION_FAIL') AS accesses,
    count(*) FILTER (outcome = 'SECTOR_MISS') AS again FROM a GROUP BY ALL)
SELECT kind, "window", misses, accesses, round(coalesce(misses / nullif(accesses, 0)::DOUBLE, 0), 6) AS rate, round(coalesce((misses + again) / nullif(accesses, 0)::DOUBLE, 0), 6) AS twice FROM w""")
def windowed_miss_rate(read):
    year = F.year("l_shipdate")
    one = S.windowed_miss_rate(_accesses(read), ["kind"], year, "outcome")
    two = S.windowed_miss_rate(_accesses(read), ["kind"], year, "outcome", True).select("kind", "window", F.round("rate", 6).alias("twice"))
    return one.withColumn("rate", F.round("rate", 6)).join(two, ["kind", "window"])


@query("""SELECT s_nationkey AS chip, s_suppkey AS bank, CAST(sum(q) AS BIGINT) AS total, max(q) AS most, count(*) AS n, CAST(grouping(s_nationkey, s_suppkey) AS BIGINT) AS level
FROM (SELECT l_suppkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey GROUP BY ROLLUP (s_nationkey, s_suppkey)""")
def bank_rollup(read):
    rows = read("lineitem").select("l_suppkey", F.col("l_quantity").cast("long").alias("q")).join(read("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return S.bank_rollup(rows.select(F.col("s_nationkey").alias("chip"), F.col("s_suppkey").alias("bank"), "q"), "chip", "bank", "q")


@query("""WITH p AS (SELECT l_partkey AS line, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, CAST(sum(l_linenumber) AS BIGINT) AS part FROM lineitem GROUP BY 1)
SELECT p_brand AS source, CAST(sum(total) AS BIGINT) AS total, max(total) AS most, round(sum(part) / sum(total)::DOUBLE, 6) AS ratio FROM p JOIN part ON line = p_partkey GROUP BY 1""")
def line_profile_rollup(read):
    rows = read("lineitem").select(F.lit("f").alias("file"), F.col("l_partkey").alias("line"), F.col("l_quantity").cast("long").alias("total"), F.col("l_linenumber").cast("long").alias("part"))
    profile = S.line_profile(rows, "file", "line", ["total", "part"])
    out = S.line_rollup(profile, read("part").select(F.col("p_partkey").alias("line"), F.col("p_brand").alias("source")), "line", "source", "total", "part")
    return out.withColumn("ratio", F.round("ratio", 6))


ADDRESS_SQL = "a AS (SELECT l_orderkey AS warp, l_linenumber AS sub, l_partkey * 12 + l_suppkey % 7 AS addr, CAST([1, 2, 4, 8][1 + l_partkey % 4] AS INT) AS size FROM lineitem)"


def _addresses(read):
    size = F.element_at(F.array(*[F.lit(x) for x in (1, 2, 4, 8)]), (F.col("l_partkey") % 4 + 1).cast("int"))
    return read("lineitem").select(F.col("l_orderkey").alias("warp"), F.col("l_linenumber").alias("sub"), (F.col("l_partkey") * 12 + F.col("l_suppkey") % 7).alias("addr"), size.alias("size"))


@query(f"""WITH {ADDRESS_SQL}, s AS (SELECT *, CASE size WHEN 1 THEN 32 WHEN 2 THEN 64 ELSE 128 END AS seg FROM a),
x AS (SELECT warp, sub, addr, seg, unnest(list_distinct([addr // seg, (addr + size - 1) // seg])) AS segment FROM s)
SELECT warp, sub, segment, count(*) AS n, CAST(bit_or(1::BIGINT << CAST((addr % seg) // 32 AS INT)) AS BIGINT) AS chunk_mask FROM x GROUP BY 1, 2, 3""")
def coalesce_segments(read):
    return S.coalesced(_addresses(read), ["warp", "sub"], "addr", "size")


@query("""WITH a AS (SELECT l_orderkey AS warp, l_partkey % 24 * 8 AS addr, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS lane FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)),
k AS (SELECT *, row_number() OVER (PARTITION BY warp, addr ORDER BY lane) AS transaction FROM a)
SELECT warp, addr // 128 AS segment, CAST(transaction AS INT) AS transaction, count(*) AS n, CAST(bit_or(1::BIGINT << CAST(addr % 128 // 32 AS INT)) AS BIGINT) AS chunk_mask, CAST(bit_or(1::BIGINT << CAST(lane AS INT)) AS BIGINT) AS lane_mask FROM k GROUP BY 1, 2, 3""")
def coalesce_atomics(read):
    from pyspark.sql import Window as W

    rows = read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    lane = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    rows = rows.select(F.col("l_orderkey").alias("warp"), (F.col("l_partkey") % 24 * 8).alias("addr"), F.lit(8).alias("size"), lane.alias("lane"))
    return S.coalesced_atomic(rows, ["warp"], "addr", "size", "lane")


@query(f"""WITH {ADDRESS_SQL}, b AS (SELECT warp, sub, (addr // 4) % 32 AS bank, count(DISTINCT addr // 4) AS n FROM a GROUP BY 1, 2, 3), m AS (SELECT warp, sub, max(n) AS most FROM b GROUP BY 1, 2)
SELECT warp, CAST(sum(most) AS BIGINT) AS cycles, count(*) AS accesses FROM m GROUP BY 1""")
def bank_conflicts(read):
    return S.bank_conflicts(_addresses(read), ["warp", "sub"], "addr")


@query("""SELECT l_returnflag AS chip, CASE WHEN l_linenumber = 1 THEN l_linestatus || '_atomic' ELSE l_linestatus END AS traffic, CAST(l_linenumber * 32 AS INT) AS size, count(*) AS packets, CAST(sum(l_linenumber * 32) AS BIGINT) AS bytes FROM lineitem GROUP BY 1, 2, 3""")
def traffic_breakdown(read):
    rows = read("lineitem").select(F.col("l_returnflag").alias("chip"), F.col("l_linestatus").alias("kind"), (F.col("l_linenumber") * 32).alias("size"), "l_linenumber")
    return S.traffic(rows, ["chip"], "kind", F.col("l_linenumber") == 1, "size")


@query("""SELECT event_type AS cls, CAST(sum(v) AS BIGINT) AS total, round(avg(v), 6) AS mean, min(v) AS least, min(event_id) FILTER (v = lo) AS least_at, max(v) AS most, min(event_id) FILTER (v = hi) AS most_at
FROM (SELECT *, min(v) OVER (PARTITION BY event_type) AS lo, max(v) OVER (PARTITION BY event_type) AS hi FROM (SELECT event_type, event_id, CAST(floor(value) AS BIGINT) AS v FROM events)) GROUP BY 1""")
def network_statistics(read):
    rows = read("events").select(F.col("event_type").alias("cls"), F.floor("value").alias("v"), "event_id")
    return S.network_stats(rows, "cls", "v", "event_id").withColumn("mean", F.round("mean", 6))


@query("""SELECT l_returnflag AS core, round(sum(l_linenumber) / sum(CAST(l_quantity AS BIGINT))::DOUBLE, 6) AS ipc, round(sum(CAST(l_quantity AS BIGINT)) / (count(*) * 50)::DOUBLE, 6) AS occupancy FROM lineitem GROUP BY 1""")
def ratio_metrics(read):
    rows = read("lineitem").select(F.col("l_returnflag").alias("core"), F.col("l_linenumber").cast("long").alias("insn"), F.col("l_quantity").cast("long").alias("cycles"), F.lit(50).cast("long").alias("slots"))
    out = S.ratios(rows, ["core"], {"ipc": ("insn", "cycles"), "occupancy": ("cycles", "slots")})
    return out.select("core", F.round("ipc", 6).alias("ipc"), F.round("occupancy", 6).alias("occupancy"))


@query("""SELECT user_id, round(sum(CASE event_type WHEN 'view' THEN 1e0 WHEN 'click' THEN 2.5e0 WHEN 'purchase' THEN 4e0 END), 4) AS power FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1""")
def weighted_power(read):
    rows = read("events").select("user_id", F.col("event_type").alias("counter"), F.lit(1).alias("count"))
    weights = rows.sparkSession.createDataFrame([("view", 1.0), ("click", 2.5), ("purchase", 4.0)], "counter string, coefficient double")
    return S.weighted_power(rows, ["user_id"], "counter", "count", weights).withColumn("power", F.round("power", 4))


@query("""SELECT user_id, CASE WHEN event_type IN ('view', 'click') THEN 'load' WHEN event_type = 'purchase' THEN 'store' ELSE 'other' END AS class, count(*) AS n FROM events GROUP BY 1, 2""")
def opcode_classes(read):
    table = read("region").sparkSession.createDataFrame([("view", "load"), ("click", "load"), ("purchase", "store"), ("signup", "other"), ("error", "other")], "event_type string, class string")
    return read("events").join(F.broadcast(table), "event_type").groupBy("user_id", "class").agg(F.count(F.lit(1)).alias("n"))  # one row per opcode


@query("""SELECT l_suppkey AS bank, CAST(floor(coalesce(sum(l_linenumber) * 100 / nullif(sum(CAST(l_quantity AS BIGINT)) + count(*), 0)::DOUBLE, 0)) AS BIGINT) AS utilisation,
    CAST(floor(coalesce(sum(l_linenumber) * 100 / nullif(sum(CAST(l_quantity AS BIGINT)), 0)::DOUBLE, 0)) AS BIGINT) AS efficiency FROM lineitem GROUP BY 1""")
def dram_utilisation(read):
    rows = read("lineitem").select(F.col("l_suppkey").alias("bank"), F.col("l_linenumber").cast("long").alias("commands"), F.col("l_quantity").cast("long").alias("active"), F.lit(1).cast("long").alias("idle"))
    return S.dram_utilisation(rows, ["bank"], "commands", "active", "idle")


@query(f"""WITH {TRACE_SQL} SELECT thread AS kernel, min(cycle) AS start, max(cycle) AS "end", list_sort(list(DISTINCT addr % 8)) AS shaders, max(addr) AS max_registers FROM t GROUP BY thread""")
def kernel_spans(read):
    return trace(read).groupBy(F.col("thread").alias("kernel")).agg(F.min("cycle").alias("start"), F.max("cycle").alias("end"), F.array_sort(F.collect_set(F.col("addr") % 8)).alias("shaders"), F.max("addr").alias("max_registers"))


@query(f"""WITH {TRACE_SQL}, s AS (SELECT thread, cycle AS moment FROM t WHERE kind = 'error'), f AS (SELECT thread, addr AS line, cycle AS start, cycle + 86400000000 AS stop FROM t WHERE kind <> 'error')
SELECT line, count(*) AS exposed FROM s JOIN f USING (thread) WHERE start <= moment AND moment < stop GROUP BY line""")
def exposed_latency(read):
    t = trace(read)
    stalls = t.where("kind = 'error'").select("thread", F.col("cycle").alias("at"))
    flights = t.where("kind <> 'error'").select("thread", F.col("addr").alias("line"), F.col("cycle").alias("start"), (F.col("cycle") + 86_400_000_000).alias("stop"))
    return S.exposed_latency(stalls, flights, ["thread"], "at", "start", "stop", "line", bucket=86_400_000_000)


@query(f"""WITH {TRACE_SQL} SELECT max(thread) AS max_thread, max(thread // 32) AS max_warp, bool_or(kind = 'error') AS has_error, list_sort(list(DISTINCT addr % 4)) AS sms, count(DISTINCT cycle) AS cycles FROM t""")
def trace_metrics(read):
    return trace(read).agg(F.max("thread").alias("max_thread"), F.max(F.floor(F.col("thread") / 32)).alias("max_warp"), F.bool_or(F.col("kind") == "error").alias("has_error"), F.array_sort(F.collect_set(F.col("addr") % 4)).alias("sms"), F.count_distinct("cycle").alias("cycles"))


@query("""WITH v AS (SELECT event_type, CAST(floor(value * 100) AS BIGINT) AS v FROM events), b AS (SELECT event_type, CASE WHEN v <= 0 THEN 0 ELSE length(bin(v)) END AS bin, count(*) AS n FROM v GROUP BY 1, 2)
SELECT event_type, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, min(v) AS least, max(v) AS most, round(avg(v), 6) AS mean, round(var_pop(v), 3) AS variance, (SELECT list(bin || ':' || n ORDER BY bin) FROM b WHERE b.event_type = v.event_type) AS bins FROM v GROUP BY 1""")
def merged_accumulators(read):
    """States of every user and day, stored, then merged by user and by type."""
    rows = read("events").select("event_type", "user_id", F.to_date("ts").alias("day"), F.floor(F.col("value") * 100).cast("long").alias("v"))
    parts = materialize(S.accumulators(rows, ["event_type", "user_id", "day"], "v"), "accumulators")
    out = S.read_out(S.merged(S.merged(parts, ["event_type", "user_id"]), ["event_type"]), ["event_type"])
    bins = F.transform("bins", lambda b: F.concat(b["bin"].cast("string"), F.lit(":"), b["count"].cast("string")))
    return out.select("event_type", "n", "total", "least", "most", F.round("mean", 6).alias("mean"), F.round("variance", 3).alias("variance"), bins.alias("bins"))
