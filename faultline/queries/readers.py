"""Readers over logs that are spelled from the tables: what they parse is what was spelled."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..operators import series
from ..sources import splits
from ..sources import text as T
from ..tables import shared_folder
from . import TRACE_SQL, query, trace


def _text(*parts):
    """Columns and strings as one text; numbers in decimal."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


ACTIVE_SQL = f"{TRACE_SQL}, r AS (SELECT idx, [[addr, idx % 4 + 1], [addr + 200, 2]] AS ranges, idx % 4 + 3 + CASE WHEN idx % 9 = 0 THEN 1 ELSE 0 END AS size FROM t)"


def _active(read):
    i, a = F.col("idx"), F.col("addr")
    return T.active_threads(trace(read).select("idx", F.array(F.array(a, i % 4 + 1), F.array(a + 200, F.lit(2).cast("long"))).alias("active"), (i % 4 + 3 + F.when(i % 9 == 0, 1).otherwise(0)).alias("n")), "idx", "active", "n")


@query(f"WITH {ACTIVE_SQL} SELECT idx, p[1] + j AS thread FROM (SELECT idx, unnest(ranges) AS p FROM r), range(10) n(j) WHERE j < p[2]")
def active_threads(read):
    """Threads of run-length ranges."""
    return _active(read)[0]


@query(f"WITH {ACTIVE_SQL} SELECT idx FROM r WHERE ranges[1][2] + ranges[2][2] <> size")
def active_thread_mismatches(read):
    """Cycles whose ranges do not add up to the size they give."""
    return _active(read)[1]


@query("""SELECT o_orderkey, o_orderkey * 16 AS base, o_custkey % 100 AS bytes, CASE WHEN o_custkey % 3 <> 0 THEN o_orderpriority[1:1] || 'out' END AS name FROM orders WHERE o_orderkey % 4 <> 0""")
def output_declarations(read):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    base = F.when(key % 2 == 0, _text("0x", F.lower(F.hex(key * 16)))).otherwise((key * 16).cast("string"))
    name = F.when(cust % 3 != 0, _text(" name=", F.substring("o_orderpriority", 1, 1), "out")).otherwise("")
    line = F.when(key % 4 == 0, _text("INPUT base=", base)).otherwise(_text("log: OUTPUT base=", base, " bytes=", cust % 100, name))
    return T.outputs(read("orders").select("o_orderkey", line.alias("value")))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_nationkey AS VARCHAR) END AS cores, CASE WHEN c_custkey % 3 = 1 THEN c_custkey % 64 END AS sets, CASE WHEN c_custkey % 3 = 1 THEN 128 END AS line, CASE WHEN c_custkey % 3 = 1 THEN c_nationkey END AS ways FROM customer""")
def config_options(read):
    """Options of a configuration, one of which is a cache's geometry."""
    key, n = F.col("c_custkey"), F.col("c_nationkey")
    line = F.when(key % 3 == 0, _text("  -cores ", n)).when(key % 3 == 1, _text("-l1 S:", key % 64, ":128:", n, ",L:R:f")).otherwise("-cores_max 3")
    rows = read("customer").select("c_custkey", line.alias("v"))
    geometry = T.cache_geometry(T.option(F.col("v"), "-l1"))
    return rows.select("c_custkey", T.option(F.col("v"), "-cores").alias("cores"), *[geometry[x].cast("long").alias(x) for x in ("sets", "line", "ways")])


@query("""WITH e AS (SELECT 'log' || user_id % 10 AS file, event_id AS i, user_id AS u FROM events)
SELECT file, list_sort(list(DISTINCT 'k' || u % 3) FILTER (i % 4 = 0)) AS kernels, list_sort(list(DISTINCT CAST(u % 7 AS INT)) FILTER (i % 4 = 1)) AS shaders, CAST(sum(i) FILTER (i % 4 = 2) AS BIGINT) AS cycles,
 list_sort(list(DISTINCT u % 5 || ',' || u % 2 || ',1') FILTER (i % 4 = 3)) AS blocks FROM e GROUP BY 1""")
def kernel_log(read):
    """Kernels, shaders, cycles and block sizes of profile logs."""
    i, u = F.col("event_id"), F.col("user_id")
    line = F.when(i % 4 == 0, _text("kernel_name = k", u % 3, " ")).when(i % 4 == 1, _text("GPU: Shader ", u % 7, " bind to kernel")).when(i % 4 == 2, _text("gpu_sim_cycle = ", i)).otherwise(_text("launch blockDim = (", u % 5, ",", u % 2, ",1)"))
    out = T.kernel_metrics(read("events").select(_text("log", u % 10).alias("file"), i.alias("line"), line.alias("value")))
    return out.select("file", F.sort_array("kernels").alias("kernels"), "shaders", "cycles", F.sort_array("blocks").alias("blocks"))


@query("""SELECT 'run' || p_partkey % 3 AS file, 'f' || p_size || '.x' AS source, CAST(p_partkey AS INT) AS line, unnest(['count', 'latency', 'traffic']) AS counter, unnest([p_size, p_partkey * 2, p_partkey % 9]) AS value FROM part""")
def profile_lines(read):
    """Counters of source lines; the head of each file names them."""
    key, size = F.col("p_partkey"), F.col("p_size")
    rows = read("part").select(_text("run", key % 3).alias("file"), (key + 1).alias("line"), _text("f", size, ".x ", key, " : ", size, " ", key * 2, " ", key % 9).alias("value"))
    heads = rows.select("file").distinct().select("file", F.lit(0).cast("long").alias("line"), F.lit("kernel line : count latency traffic").alias("value"))
    return T.line_profile(heads.unionByName(rows))


@query("""WITH e AS (SELECT 'ptx' || user_id % 8 AS file, event_id AS line, CASE WHEN event_id % 5 = 0 THEN {'f': user_id % 3, 'n': event_id % 100} END AS loc FROM events),
l AS (SELECT file, line, last_value(loc IGNORE NULLS) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS loc FROM e)
SELECT file, line, CAST(loc.f AS INT) AS source_file, CAST(loc.n AS INT) AS source_line FROM l""")
def source_line_map(read):
    """Lines with the source that the last mark before them gives."""
    i, u = F.col("event_id"), F.col("user_id")
    value = F.when(i % 5 == 0, _text("  .loc ", u % 3, " ", i % 100, " 0")).otherwise(_text("add r", i))
    return T.source_lines(read("events").select(_text("ptx", u % 8).alias("file"), i.alias("line"), value.alias("value")))


@query("""WITH r AS (SELECT o_orderkey AS line, o_orderpriority AS label, o_orderkey % 1000 AS seconds FROM orders WHERE o_orderkey % 7 NOT IN (0, 1))
SELECT label, CAST(sum(seconds) AS DOUBLE) AS seconds, min(line) AS first FROM r GROUP BY 1""")
def timing_totals(read):
    """Seconds by label from rows of two or three fields, among heads and rows that are none."""
    key, label = F.col("o_orderkey"), F.col("o_orderpriority")
    line = F.when(key % 7 == 0, "timestamp_iso\tlabel\tseconds").when(key % 7 == 1, _text(label, "\tnone")).when(key % 2 == 0, _text(label, "\t", key % 1000)).otherwise(_text("2024-01-01T00:00:00\t", label, "\t", key % 1000, "\tmore"))
    return T.timings(read("orders").select(key.alias("line"), line.alias("value")))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN value WHEN 1 THEN 1e0 WHEN 2 THEN 0e0 WHEN 3 THEN -7e0 ELSE -1.5e3 END AS number FROM events""")
def tolerant_floats(read):
    i = F.col("event_id")
    text = F.when(i % 5 == 0, F.col("value").cast("string")).when(i % 5 == 1, "true").when(i % 5 == 2, "False").when(i % 5 == 3, "bad").otherwise(" -1.5e3 ")
    return read("events").select("event_id", C.tolerant_float(text, -7.0).alias("number"))


DAILY_SQL = "c AS (SELECT user_id AS k, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY d) - 1 AS i, n FROM c)"


def _daily(read):
    from pyspark.sql import Window as W

    rows = read("events").groupBy(F.col("user_id").alias("k"), F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("k", (F.row_number().over(W.partitionBy("k").orderBy("d")) - 1).cast("long").alias("i"), "n")


@query(f"WITH {DAILY_SQL} SELECT k, i + 1 AS i, n FROM s UNION ALL SELECT DISTINCT k, 0, 0 FROM s")
def leading_zero(read):
    """Daily counts of each user after a 0."""
    return series.with_leading_zero(_daily(read), ["k"], "i", "n")


@query(f"WITH {DAILY_SQL}, m AS (SELECT k, max(i) + 1 AS len, max(max(i) + 1) OVER () AS most FROM s GROUP BY 1) SELECT s.k, i + most - len AS i, n FROM s JOIN m USING (k) UNION ALL SELECT k, j, 0 FROM m, range(100) r(j) WHERE j < most - len")
def padded_left(read):
    """Daily counts of users aligned at their last day."""
    return series.padded_left(_daily(read), ["k"], "i", "n")


@query(f"WITH {TRACE_SQL} SELECT idx, thread, kind || ' \"{{' || addr AS label, [addr, idx] AS list FROM t")
def json_elements(read):
    """Events as elements of JSON lists in files, read in byte ranges."""
    t = trace(read)
    one = F.to_json(F.struct("idx", "thread", F.concat("kind", F.lit(' "{'), F.col("addr").cast("string")).alias("label"), F.array("addr", "idx").alias("list")))
    lists = t.groupBy(F.floor(F.col("idx") / 500)).agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ", "), F.lit("]")).alias("value")).select("value")
    path = f"{shared_folder(t.sparkSession)}/json-{uuid.uuid4().hex}"
    lists.write.text(path)
    found = splits.json_elements(t.sparkSession, path, 1 << 14)
    return found.select(F.from_json("value", "idx long, thread long, label string, list array<long>").alias("j")).select("j.*")
