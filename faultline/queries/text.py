"""Parsing and cleaning of text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..operators import ordered
from ..sources import text as T
from . import query


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(html) AS size FROM pages""")
def log_regex_extract(read):
    return read("pages").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.length("html").cast("long").alias("size"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS tolerant, event_id % 256 AS hexed FROM events""")
def tolerant_numbers(read):
    raw = F.get_json_object("props", "$.k")
    blank = F.when(F.col("event_id") % 3 == 0, F.lit("  ")).otherwise(F.concat(raw, F.lit(".0")))
    return read("events").select("event_id", C.tolerant_int(raw).alias("k"), C.tolerant_int(blank).alias("tolerant"), C.tolerant_int(F.concat(F.lit("0x"), F.hex(F.col("event_id") % 256))).alias("hexed"))


@query("""SELECT o_orderkey, o_orderpriority AS code, CAST(substr(o_orderpriority, 1, 1) AS INT) AS level, CASE WHEN o_orderpriority LIKE '%URGENT%' THEN 'SDC' WHEN o_orderpriority LIKE '%LOW%' THEN 'Masked' ELSE 'Others' END AS label FROM orders""")
def outcome_labels(read):
    name = F.when(F.col("o_orderpriority").contains("URGENT"), "an sdc due to").when(F.col("o_orderpriority").contains("LOW"), "MASKED run").otherwise("nothing")
    code = C.first_text(F.lit(""), F.col("o_orderpriority"))
    return read("orders").select("o_orderkey", code.alias("code"), T.key_values(F.col("o_orderpriority"), "-")[0].cast("int").alias("level"), C.outcome_label(name).alias("label"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'shared' WHEN n_nationkey % 3 = 1 THEN 'global' ELSE 'other' END AS by_substring, CASE WHEN n_nationkey % 3 = 0 THEN NULL WHEN n_nationkey % 3 = 1 THEN 'global' ELSE NULL END AS by_alias,
 greatest(1, CAST(ceil(n_nationkey / 8e0) AS BIGINT)) AS size, n_nationkey % 4 <> 0 AS held FROM nation""")
def memory_spaces(read):
    k = F.col("n_nationkey")
    name = F.when(k % 3 == 0, "my_shared_space").when(k % 3 == 1, "global").otherwise("tex")
    return read("nation").select("n_nationkey", C.space_by_substring(name).alias("by_substring"), C.space_by_alias(name).alias("by_alias"), C.access_size(k, F.lit(0), F.lit(-1)).alias("size"), C.predicate_true(F.when(k % 4 != 1, k % 4)).alias("held"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END AS raw, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS first_text, replace(replace(c_name, 'Customer', 'Client'), '#', '_') AS renamed, trim(regexp_replace(c_name || '   x', '\\s+', ' ', 'g')) AS collapsed FROM customer""")
def name_cleaning(read):
    raw = F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_mktsegment"))
    return read("customer").select("c_custkey", raw.alias("raw"), C.first_text(raw, F.col("c_name")).alias("first_text"), C.new_name(F.col("c_name"), {"Customer": "Client", "#": "_"}).alias("renamed"), C.collapsed(F.concat("c_name", F.lit("   x"))).alias("collapsed"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN '-' ELSE printf('%.3f', s_suppkey / 8e0) END AS fixed, CAST(len(list_distinct([s_suppkey % 5, s_suppkey % 3, s_suppkey % 2])) AS INT) AS ids FROM supplier""")
def number_formats(read):
    k = F.col("s_suppkey")
    text = F.concat_ws(", ", (k % 5).cast("string"), F.concat((k % 3).cast("string"), F.lit(":"), (k % 2).cast("string")))
    return read("supplier").select("s_suppkey", F.replace(C.fixed(F.when(k % 7 != 0, k / 8.0), 3), F.lit(","), F.lit("")).alias("fixed"), F.size(C.id_list(text)).alias("ids"))


@query("""WITH w AS (SELECT p_partkey % 40 AS n, ['r', 'rd', 'R', 'Rd', 'p'][p_size % 5 + 1] AS kind FROM part) SELECT DISTINCT '%' || kind || n AS register, kind AS prefix, n AS number FROM w""")
def register_names(read):
    """Registers of both cases in instruction texts."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ("r", "rd", "R", "Rd", "p")]), (F.col("p_size") % 5 + 1).cast("int"))
    line = F.concat(F.lit("add.u32 %"), kind, (F.col("p_partkey") % 40).cast("string"), F.lit(", 1;"))
    return T.register_names(read("part").select(line.alias("value")))


@query("""SELECT source, CAST(row_number() OVER (ORDER BY CAST(substr(source, 4) AS INT)) AS INT) AS rank FROM (SELECT DISTINCT source FROM documents)""")
def numeric_first_order(read):
    from pyspark.sql import Window as W

    names = read("documents").select("source").distinct()
    return names.withColumn("rank", F.row_number().over(W.orderBy(*ordered.numeric_first(F.substring("source", 4, 9)))))


@query("""SELECT doc_id, CAST(i AS INT) AS position, CAST(v AS DOUBLE) AS value FROM (SELECT doc_id, n_chars, unnest(range(4)) AS i, unnest([n_chars, doc_id % 10, NULL, 7]) AS v FROM documents) WHERE v IS NOT NULL""")
def interval_log_reshape(read):
    line = F.concat(F.lit("metric: "), F.col("n_chars").cast("string"), F.lit(" "), (F.col("doc_id") % 10).cast("string"), F.lit(" - 7"))
    log = read("documents").select(F.col("doc_id").cast("string").alias("file"), F.lit(0).alias("line"), line.alias("value"))
    return T.interval_log(log).select(F.col("file").cast("long").alias("doc_id"), "position", "value")


@query("""SELECT conv_id, max(turn) FILTER (role = 'user') AS last_user, bool_or(role = 'user') AS success, count(*) AS n,
 coalesce(list_transform(list_sort(list(DISTINCT turn * 16) FILTER (role <> 'user')), lambda b: b || ':' || (b // 16 % 3)), []) AS outputs FROM conversations GROUP BY conv_id""")
def run_summary(read):
    log = read("conversations").select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("line"), F.when(F.col("role") == "user", F.concat(F.lit("Success cycle = "), F.col("turn").cast("string"))).otherwise(F.concat(F.lit("OUTPUT base="), (F.col("turn") * 16).cast("string"), F.lit(" bytes="), (F.col("turn") % 3).cast("string"))).alias("value"))
    out = T.run_summaries(log)
    sizes = log.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return out.join(sizes, "file").select(F.col("file").cast("long").alias("conv_id"), F.col("last_cycle").alias("last_user"), "success", "n", F.transform("outputs", lambda o: F.concat(o["base"].cast("string"), F.lit(":"), o["bytes"].cast("string"))).alias("outputs"))


#: Instruction texts with their operator, sources, result width and width of the third source, of 32-bit instructions.
OPCODES = (
    ("add.u32 %r1, %r2, %r3", "ADD", 2, 32, 32), ("add.f32", "ADD_F32", 2, 32, 32), ("mul.lo.s32", "MUL_LO", 2, 32, 32), ("mul.wide.s32", "MUL_WIDE_S32", 2, 64, 32), ("mul.wide.u32", "MUL_WIDE_U32", 2, 64, 32), ("mov.u32", "IDENTITY", 1, 32, 32),
    ("cvta.to.global.u64", "IDENTITY", 1, 32, 32), ("mad.lo.s32", "MAD", 3, 32, 32), ("fma.rn.f32", "FMA_F32", 3, 32, 32), ("not.pred", "NOT_PRED", 1, 1, 32), ("NOT.b32", "NOT", 1, 32, 32), ("shr.s32", "SHR_S", 2, 32, 32), ("shr.u32", "SHR_U", 2, 32, 32),
    ("min.s32", "MIN_S", 2, 32, 32), ("max.u32", "MAX_U", 2, 32, 32), ("max.f32", "MAX_F32", 2, 32, 32), ("popc.b32", "POPC", 1, 32, 32), ("bfe.s32", "BFE_S", 3, 32, 32), ("lop3.b32", "LOP3", 4, 32, 32), ("setp.lt.s32", "SETP_LT_S", 2, 1, 32),
    ("setp.ltu.f32", "SETP_LTU_F32", 2, 1, 32), ("setp.geu.u32", "SETP_GE_U", 2, 1, 32), ("setp.eq.f64", "SETP_EQ_F64", 2, 1, 32), ("setp.ne.and.b32", "SETP_NE", 2, 1, 32), ("cvt.sat.f32.f32", "CVT_SAT_F32_F32", 1, 32, 32), ("cvt.u64.u32", "CVT_U32_U64", 1, 64, 32),
    ("cvt.u32.u64", "CVT_U64_U32", 1, 32, 64), ("selp.b32", "SELP", 3, 32, 1), ("shr_s", "SHR_S", 2, 32, 32), ("rcp.approx.ftz.f32", "RCP_APPROX_FTZ_F32", 1, 32, 32), ("bar.sync", "BAR.SYNC", 2, 32, 32),
    ("add_u32", "ADD", 2, 32, 32), ("mov_b32", "IDENTITY", 1, 32, 32), ("setp_lt_s32", "SETP_LT_U", 2, 1, 32), ("setp_lt_s", "SETP_LT_S", 2, 1, 32), ("mul_wide_s32", "MUL_WIDE_S32", 2, 64, 32), ("foo_bar", "FOO_BAR", 2, 32, 32),
)


@query(f"""WITH o AS (SELECT unnest([{", ".join(str(i) for i in range(len(OPCODES)))}]) AS i, unnest([{", ".join(f"'{o[0]}'" for o in OPCODES)}]) AS text, unnest([{", ".join(f"'{o[1]}'" for o in OPCODES)}]) AS operator,
 unnest([{", ".join(str(o[2]) for o in OPCODES)}]) AS sources, unnest([{", ".join(str(o[3]) for o in OPCODES)}]) AS result_width, unnest([{", ".join(str(o[4]) for o in OPCODES)}]) AS third_width)
SELECT p_partkey, text, operator, sources, result_width, third_width FROM part JOIN o ON i = p_partkey % {len(OPCODES)}""")
def opcode_operators(read):
    from ..functions import opcodes as O

    text = F.element_at(F.array(*[F.lit(o[0]) for o in OPCODES]), (F.col("p_partkey") % len(OPCODES) + 1).cast("int"))
    rows = read("part").select("p_partkey", text.alias("text")).withColumn("operator", O.operator(F.col("text")))
    op, w = F.col("operator"), F.lit(32)
    return rows.select("p_partkey", "text", "operator", O.source_count(op).alias("sources"), O.result_width(op, w).alias("result_width"), O.source_width(op, w, F.lit(2)).alias("third_width"))


@query("""WITH r AS (SELECT conv_id % 7 AS file, conv_id AS run, 'tmp.out' || (conv_id % 3) AS out, count(*) AS turns, min(turn) AS lo FROM conversations GROUP BY ALL)
SELECT file, run, out, 1 AS occurrence, CASE WHEN run % 2 = 0 THEN 'SDC' ELSE 'Masked' END AS outcome, CAST(i AS INT) AS position, CASE WHEN run % 5 = 0 THEN 'invalid' WHEN i = 0 THEN 'L1D' ELSE 'REG' END AS src,
 CASE WHEN run % 5 = 0 THEN 'invalid_summary' ELSE 'k' || run END AS kernel, CASE WHEN run % 5 = 0 THEN -1 ELSE 10 + i END AS inst_line, CASE WHEN run % 5 = 0 THEN '' ELSE 'st.global' END AS inst_text
FROM r, range(2) t(i) WHERE run % 5 <> 0 OR i = 0""")
def injection_records(read):
    """A log with a reader line before the writer line of each run, both twice."""
    runs = read("conversations").select("conv_id").distinct().withColumn("out", F.concat(F.lit("tmp.out"), (F.col("conv_id") % 3).cast("string")))
    run = F.concat(F.lit("[Run "), F.col("conv_id").cast("string"), F.lit("] "))
    record = lambda src, kind, n: F.concat(F.lit(f"[{src}_FI_{kind}] x -> k"), F.col("conv_id").cast("string"), F.lit(f" PC=8 (a.cu:{n}) st.global"))
    said = F.when(F.col("conv_id") % 5 == 0, F.array()).otherwise(F.array(*[record(*x) for x in (("REG", "READER", 11), ("L1D", "WRITER", 10)) * 2]))
    outcome = F.when(F.col("conv_id") % 2 == 0, "an SDC run").otherwise("Masked")
    texts = F.concat(F.array(F.concat(run, F.lit("Effects from logs/"), "out", F.lit(":"))), said, F.array(F.concat(run, "out", F.lit(": "), outcome)))
    log = runs.select((F.col("conv_id") % 7).alias("file"), "conv_id", F.posexplode(texts).alias("at", "value")).select("file", (F.col("conv_id") * 10 + F.col("at")).alias("line"), "value")
    return T.injection_log(log)[0]



#: Definitions of metrics: one of each organization, one that falls and resets, a comment and lines that define nothing.
DEFINED = ["# name, plot, resets, organization, kind", "", "Cycles, scalar, 1, scalar, int", "perCore,vector,0,implicit,float", "dram, vector, 1, index, int", "bank,vector2d,0,index2d,int", "map, sparse, 0, sparse, float", "odd,pie,0,scalar,int", "cores, vector, 0, scalar, int"]


@query("""WITH e AS (SELECT 'run' || user_id % 4 AS file, event_id AS line, event_id % 5 AS m, event_id % 7 AS a, event_id % 11 AS b, event_id % 13 AS c, event_id % 3 = 0 AS short, user_id % 3 AS u FROM events),
w AS (SELECT file, max(CASE WHEN short THEN 2 ELSE 3 END) AS most FROM e WHERE m = 1 GROUP BY 1),
p AS (SELECT file, 'cycles' AS metric, '' AS key, line, 0 AS o, a * 1e0 AS value, TRUE AS resets FROM e WHERE m = 0
  UNION ALL SELECT e.file, 'percore', CAST(j AS VARCHAR), line, 0, CASE WHEN j = 2 AND short THEN 0 ELSE [a + 0.5e0, b, c][j + 1] END, FALSE FROM e JOIN w ON w.file = e.file, range(3) r(j) WHERE m = 1 AND j < most
  UNION ALL SELECT file, 'dram', CAST(u AS VARCHAR), line, j, [b, c][j + 1], TRUE FROM e, range(2) r(j) WHERE m = 2
  UNION ALL SELECT file, 'bank', u || '.' || a, line, 0, c, FALSE FROM e WHERE m = 3
  UNION ALL SELECT file, 'map', CASE j WHEN 0 THEN a || '.' || b ELSE b || '.' || a END, line, j, c + j * 0.25e0, FALSE FROM e, range(2) r(j) WHERE m = 4),
s AS (SELECT file, metric, key, row_number() OVER (PARTITION BY file, metric, key ORDER BY line, o) - CASE WHEN metric = 'map' THEN 1 ELSE 0 END AS n, value, resets FROM p
  UNION ALL SELECT DISTINCT file, metric, key, 0, 0e0, resets FROM p WHERE metric <> 'map'),
l AS (SELECT *, lag(value) OVER (PARTITION BY file, metric, key ORDER BY n) AS was FROM s)
SELECT file, metric, key, CAST(n AS BIGINT) AS position, value, CASE WHEN resets AND value < was THEN value ELSE value - was END AS rate FROM l""")
def metric_series(read):
    """Events as lines of a log, reshaped as the definitions of its metrics say."""
    e = read("events")
    i, u = F.col("event_id"), F.col("user_id")
    text = lambda *xs: F.concat_ws(" ", *[x.cast("string") for x in xs])
    a, b, c = i % 7, i % 11, i % 13
    vector = F.when(i % 3 == 0, text(a + F.lit(0.5), b)).otherwise(text(a + F.lit(0.5), b, c))
    value = (
        F.when(i % 5 == 0, F.concat(F.lit("cycles: "), text(a))).when(i % 5 == 1, F.concat(F.lit("perCore: "), vector)).when(i % 5 == 2, F.concat(F.lit("dram: "), text(u % 3, b, c)))
        .when(i % 5 == 3, F.concat(F.lit("bank: "), text(u % 3, a, c))).otherwise(F.concat(F.lit("map: "), text(a, b, c, b, a, c + F.lit(0.25))))
    )
    log = e.select(F.concat(F.lit("run"), (u % 4).cast("string")).alias("file"), i.alias("line"), value.alias("value"))
    definitions, _ = T.metric_definitions(e.sparkSession.createDataFrame([(d,) for d in DEFINED], "value string"))
    out = T.defined_series(T.interval_log(log), definitions)
    return out.withColumnRenamed("at", "position").withColumn("metric", F.lower("metric"))
