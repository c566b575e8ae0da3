"""Campaign reports. Orders stand for trials: status O, F, P is masked, sdc, due."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify, intervals, sampling
from ..plans import reports as R
from . import TRACE_SQL, query, trace

RATES_SQL = """o AS (
    SELECT o_orderpriority AS app, c_mktsegment AS arch, o_custkey % 2 = 1 AS truth,
           CASE o_orderstatus WHEN 'O' THEN 'masked' WHEN 'F' THEN 'sdc' ELSE 'due' END AS outcome
    FROM orders JOIN customer ON o_custkey = c_custkey
), r AS (
    SELECT arch, app, truth,
           sum(CASE WHEN outcome = 'masked' THEN 1e0 ELSE 0e0 END) / count(*) AS m,
           sum(CASE WHEN outcome = 'sdc' THEN 1e0 ELSE 0e0 END) / count(*) AS s,
           sum(CASE WHEN outcome = 'due' THEN 1e0 ELSE 0e0 END) / count(*) AS d
    FROM o GROUP BY ALL
), e AS (
    SELECT a.arch, a.app, abs(a.m - b.m) AS md, abs(a.s - b.s) AS sd, abs(a.d - b.d) AS dd,
           (abs(a.m - b.m) + abs(a.s - b.s) + abs(a.d - b.d)) / 3 AS error, a.m, a.s, a.d
    FROM r a JOIN r b ON a.arch = b.arch AND a.app = b.app AND NOT a.truth AND b.truth)"""


def _trials(read):
    outcome = F.when(F.col("o_orderstatus") == "O", "masked").when(F.col("o_orderstatus") == "F", "sdc").otherwise("due")
    return read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderpriority").alias("app"), F.col("c_mktsegment").alias("arch"), (F.col("o_custkey") % 2 == 1).alias("truth"), outcome.alias("outcome"))


def _errors(read):
    rates = R.outcome_rates(_trials(read), ["arch", "app", "truth"], "outcome")
    return R.errors(rates.where("not truth"), rates.where("truth"), ["arch", "app"])


@query(f"WITH {RATES_SQL} SELECT arch, round(avg(error), 6) AS error, count(*) AS n FROM e GROUP BY arch")
def rate_error_mean(read):
    return R.overall(_errors(read), ["arch"]).select("arch", F.round("error", 6).alias("error"), "n")


@query(f"""WITH {RATES_SQL} SELECT arch, outcome, round(avg(diff), 6) AS diff FROM (
    SELECT arch, 'masked' AS outcome, md AS diff FROM e UNION ALL SELECT arch, 'sdc', sd FROM e UNION ALL SELECT arch, 'due', dd FROM e) GROUP BY ALL""")
def category_error(read):
    return R.by_category(_errors(read), ["arch"]).select("arch", "outcome", F.round("diff", 6).alias("diff"))


@query(f"""WITH {RATES_SQL}, m AS (SELECT arch, avg(error) AS error FROM e GROUP BY arch)
SELECT arch, round(error, 6) AS error FROM m UNION ALL SELECT 'Combined', round(avg(error), 6) FROM m""")
def combined_avg_of_avg(read):
    means = R.overall(_errors(read), ["arch"])
    return R.combined(means, "arch", [], "error").select("arch", F.round("error", 6).alias("error"))


@query("""SELECT coalesce(l_returnflag, 'Combined') AS arch, round(sum(l_extendedprice), 2) AS truth_time, round(sum(l_quantity), 2) AS time,
    round(sum(l_extendedprice) / sum(l_quantity), 6) AS speedup FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def speedup_ratio_of_sums(read):
    rows = read("lineitem").select(F.col("l_returnflag").alias("arch"), "l_extendedprice", "l_quantity")
    return R.speedups(rows, "arch", "l_extendedprice", "l_quantity").select("arch", F.round("truth_time", 2).alias("truth_time"), F.round("time", 2).alias("time"), F.round("speedup", 6).alias("speedup"))


@query(f"""WITH {RATES_SQL} SELECT arch, round(avg(CASE WHEN app = '1-URGENT' THEN error END), 6) AS urgent_error,
    round(avg(CASE WHEN app = '5-LOW' THEN error END), 6) AS low_error FROM e GROUP BY arch""")
def component_breakdown(read):
    wide = _errors(read).groupBy("arch").pivot("app", ["1-URGENT", "5-LOW"]).agg(F.avg("error"))
    return wide.select("arch", F.round("1-URGENT", 6).alias("urgent_error"), F.round("5-LOW", 6).alias("low_error"))


@query(f"""WITH {RATES_SQL}, m AS (SELECT app, avg(error) AS error, avg(m) AS masked_rate FROM e GROUP BY app)
SELECT app, round(error, 6) AS error, round(masked_rate, 6) AS masked_rate FROM m UNION ALL SELECT 'Avg', round(avg(error), 6), round(avg(masked_rate), 6) FROM m""")
def app_means_with_average(read):
    return R.with_average(_errors(read), "app", ["error", "masked_rate"]).select("app", F.round("error", 6).alias("error"), F.round("masked_rate", 6).alias("masked_rate"))


@query(f"WITH {RATES_SQL} SELECT app, round(avg(greatest(0e0, 1e0 - (m + s))), 6) AS unknown_share FROM e GROUP BY app")
def unknown_share(read):
    return R.unknown_share(_errors(read), ["app"], ["masked_rate", "sdc_rate"]).select("app", F.round("unknown_share", 6).alias("unknown_share"))


@query("""WITH c AS (SELECT c_custkey * 2 AS key FROM customer), o AS (SELECT DISTINCT o_custkey * 3 AS key FROM orders)
SELECT key, 'right' AS missing FROM c WHERE key NOT IN (SELECT key FROM o) UNION ALL SELECT key, 'left' FROM o WHERE key NOT IN (SELECT key FROM c)""")
def missing_pairs(read):
    """Twofold keys of customers and threefold ones of orders, of which each side lacks some."""
    customers = read("customer").select((F.col("c_custkey") * 2).alias("key"))
    return intervals.missing_pairs(customers, read("orders").select((F.col("o_custkey") * 3).alias("key")), ["key"])


@query("""WITH s AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS k FROM events WHERE value > 50 GROUP BY user_id)
SELECT u.user_id, CASE WHEN k IS NULL THEN 'unknown' WHEN len(k) = 1 THEN k[1] ELSE 'mixed' END AS status
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN s USING (user_id)""")
def campaign_status(read):
    from ..functions.cleaning import one_or_mixed

    kinds = F.collect_set(F.when(F.col("value") > 50, F.col("event_type")))
    return read("events").groupBy("user_id").agg(kinds.alias("k")).select("user_id", one_or_mixed(F.col("k")).alias("status"))


@query("""WITH a AS (SELECT l_returnflag AS level, l_linenumber AS source, CAST(sum(CAST(round(l_extendedprice) AS BIGINT)) AS BIGINT) AS amount FROM lineitem GROUP BY ALL),
b AS (SELECT *, CAST(floor(0.6e0 * sum(amount) OVER (PARTITION BY level)) AS BIGINT) AS total, sum(amount) OVER (PARTITION BY level ORDER BY source) AS upto,
  coalesce(sum(amount) OVER (PARTITION BY level ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a)
SELECT level, source, (greatest(0, least(upto, total) - least(before, total)))::DOUBLE AS used, round(greatest(0, least(upto, total) - least(before, total)) / total::DOUBLE, 6) AS share FROM b""")
def source_share_waterfall(read):
    from pyspark.sql import Window as W

    a = read("lineitem").groupBy(F.col("l_returnflag").alias("level"), F.col("l_linenumber").alias("source")).agg(F.sum(F.round("l_extendedprice").cast("long")).alias("amount"))
    a = a.withColumn("total", F.floor(0.6 * F.sum("amount").over(W.partitionBy("level"))))
    return R.waterfall(a, ["level"], "source", "amount", "total").select("level", "source", "used", F.round("share", 6).alias("share"))


@query("""WITH c AS (SELECT o_orderpriority AS app, count(*) - o_p.extra AS den, sum((o_orderstatus = 'O')::INT) AS m, sum((o_orderstatus = 'F')::INT) AS s, sum((o_orderstatus = 'P')::INT) AS d
    FROM orders, (SELECT 40 AS extra) o_p GROUP BY o_orderpriority, o_p.extra)
SELECT app, greatest(0, m - greatest(0, -(den - (m + s + d))))::BIGINT AS masked, s::BIGINT AS sdc, d::BIGINT AS due, greatest(0, den - (m + s + d))::BIGINT AS unknown,
    least(s, den)::BIGINT AS benign, least(d, den - least(s, den))::BIGINT AS ebc, least(m, den - least(s, den) - least(d, den - least(s, den)))::BIGINT AS dcr FROM c""")
def classification_repair(read):
    count = lambda s: F.count_if(F.col("o_orderstatus") == s)
    c = read("orders").groupBy(F.col("o_orderpriority").alias("app")).agg((F.count(F.lit(1)) - 40).alias("den"), count("O").alias("m"), count("F").alias("s"), count("P").alias("d"))
    return c.select("app", *R.repaired(F.col("m"), F.col("s"), F.col("d"), F.lit(0).cast("long"), F.col("den")), *R.clamped(F.col("s"), F.col("d"), F.col("m"), F.col("den")))


@query("""WITH w AS (SELECT p_brand AS app, sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END)::BIGINT AS rf_den, sum(CASE WHEN p_size > 25 THEN p_size ELSE 0 END)::BIGINT AS rf_sdc,
    sum(CASE WHEN p_size > 60 THEN 1 ELSE 0 END)::BIGINT AS l2_den, sum(p_size)::BIGINT AS l2_sdc FROM part GROUP BY p_brand)
SELECT app, 'rf' AS component, CASE WHEN rf_den > 0 THEN rf_den END AS den, CASE WHEN rf_den > 0 THEN rf_sdc END AS sdc FROM w
UNION ALL SELECT app, 'l2', CASE WHEN l2_den > 0 THEN l2_den END, CASE WHEN l2_den > 0 THEN l2_sdc END FROM w""")
def wide_to_long(read):
    big = lambda n: F.col("p_size") > n
    wide = read("part").groupBy(F.col("p_brand").alias("app")).agg(F.count_if(big(25)).alias("rf_den"), F.sum(F.when(big(25), F.col("p_size")).otherwise(0)).alias("rf_sdc"), F.count_if(big(60)).alias("l2_den"), F.sum("p_size").alias("l2_sdc"))
    return R.unpivoted(wide, ["app"], ["rf", "l2"], ["den", "sdc"])


DECISION_SQL = """x AS (SELECT o_orderkey AS run, o_totalprice > 1000 AS golden_ok, o_custkey % 10 <> 3 AS log_ok,
    CASE WHEN o_orderkey % 17 = 0 THEN 124 WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END AS exit_status, o_orderstatus IN ('O', 'P') AS success, o_orderstatus IN ('F', 'P') AS failed,
    (SELECT 1) AS one FROM orders),
l AS (SELECT l_orderkey AS run, sum((l_returnflag = 'N' AND l_discount > 0.09)::INT) AS missing_outputs, bool_and(l_tax < 0.06) AS outputs_equal FROM lineitem GROUP BY l_orderkey)"""


@query(f"""WITH {DECISION_SQL} SELECT run, r.outcome, r.reason FROM (SELECT run, CASE
  WHEN NOT golden_ok THEN {{'outcome': 'due', 'reason': 'invalid_path'}} WHEN exit_status IN (124, 137) THEN {{'outcome': 'due', 'reason': 'timeout_exit_status'}}
  WHEN NOT log_ok THEN {{'outcome': 'due', 'reason': 'missing_log'}} WHEN exit_status <> 0 THEN {{'outcome': 'due', 'reason': 'abnormal_exit_status'}}
  WHEN coalesce(missing_outputs, 0) > 0 THEN {{'outcome': 'due', 'reason': 'missing_expected_output'}}
  WHEN success AND NOT failed THEN {{'outcome': 'masked', 'reason': 'success'}} WHEN failed AND NOT success THEN {{'outcome': 'sdc', 'reason': 'failed'}}
  WHEN NOT success AND NOT failed THEN {{'outcome': 'due', 'reason': 'no_sentinel'}} WHEN coalesce(outputs_equal, false) THEN {{'outcome': 'masked', 'reason': 'outputs_equal'}}
  ELSE {{'outcome': 'sdc', 'reason': 'outputs_differ'}} END AS r FROM x LEFT JOIN l USING (run))""")
def outcome_decision(read):
    key = F.col("o_orderkey")
    runs = read("orders").select(
        key.alias("run"), (F.col("o_totalprice") > 1000).alias("golden_ok"), (F.col("o_custkey") % 10 != 3).alias("log_ok"), F.when(key % 17 == 0, 124).when(key % 19 == 0, 1).otherwise(0).alias("exit_status"),
        F.col("o_orderstatus").isin("O", "P").alias("success"), F.col("o_orderstatus").isin("F", "P").alias("failed"),
    )
    seen = read("lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.count_if((F.col("l_returnflag") == "N") & (F.col("l_discount") > 0.09)).alias("missing_outputs"), F.bool_and(F.col("l_tax") < 0.06).alias("outputs_equal"))
    return classify.classify(runs.join(seen, "run", "left")).select("run", "outcome", "reason")


@query("""WITH g AS (SELECT l_partkey AS key, count(*) AS v FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), r AS (SELECT l_partkey AS key, count(*) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT key, g.v AS golden, r.v AS run, CASE WHEN r.v IS NULL THEN 'missing' WHEN g.v IS NULL THEN 'extra' ELSE 'different' END AS difference FROM g FULL JOIN r USING (key) WHERE g.v IS DISTINCT FROM r.v""")
def set_compare(read):
    side = lambda s: read("lineitem").where(F.col("l_linestatus") == s).groupBy(F.col("l_partkey").alias("key")).agg(F.count(F.lit(1)).alias("v"))
    return intervals.set_compare(side("O"), side("F"), ["key"], "v")


@query("""SELECT o_orderkey AS run, CASE WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 THEN 'masked' WHEN o_orderstatus = 'F' THEN 'performance' WHEN o_orderstatus = 'O' THEN 'sdc' ELSE 'due' END AS code FROM orders""")
def legacy_code(read):
    s = F.col("o_orderstatus")
    return read("orders").select(F.col("o_orderkey").alias("run"), classify.legacy_code(s == "F", F.col("o_custkey") % 2 == 0, s == "O").alias("code"))


#: Last lines of logs.
LOG_LINES = ("done", "Assertion `x' failed", "FATAL: out of memory", "Segmentation Fault (core dumped)", "core dumped", "CUDA Error 700", "an error in a line", "SIMULATOR: internal ERROR 3", "Aborted", "")


@query(f"""WITH l AS (SELECT o_orderkey AS run, [{", ".join("'" + x.replace("'", "''") + "'" for x in LOG_LINES)}][o_orderkey % 10 + 1] AS line, CASE WHEN o_custkey % 11 = 0 THEN 124 WHEN o_custkey % 13 = 0 THEN 137 WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END AS status FROM orders)
SELECT run, CASE WHEN status IN (124, 137) THEN 'timeout' WHEN line = '' THEN 'missing_output' WHEN regexp_matches(line, '(?i)assert|fatal|segmentation fault|core dumped|cuda error|aborted|simulator.*error') THEN 'simulator_error'
  WHEN status <> 0 THEN 'abnormal_exit' ELSE 'other' END AS reason FROM l""")
def due_reasons(read):
    from ..functions.cleaning import due_reason

    line = F.element_at(F.array(*[F.lit(x) for x in LOG_LINES]), (F.col("o_orderkey") % 10 + 1).cast("int"))
    c = F.col("o_custkey")
    status = F.when(c % 11 == 0, 124).when(c % 13 == 0, 137).when(c % 5 == 0, 1).otherwise(0)
    return read("orders").select(F.col("o_orderkey").alias("run"), due_reason(line, status).alias("reason"))


@query("SELECT DISTINCT name FROM (SELECT c_mktsegment AS name FROM customer UNION ALL SELECT n_name FROM nation UNION ALL SELECT r_name FROM region)")
def names_over_roots(read):
    return R.names([read("customer").select(F.col("c_mktsegment").alias("name")), read("nation").select(F.col("n_name").alias("name")), read("region").select(F.col("r_name").alias("name"))], "name")


@query("""SELECT s_suppkey AS site, CAST(row_number() OVER (ORDER BY s_nationkey NULLS LAST, TRY_CAST(substr(s_name, 10) AS DOUBLE) NULLS LAST, s_name, s_suppkey) AS INT) AS rank FROM supplier""")
def site_order(read):
    from pyspark.sql import Window as W

    from ..operators.ordered import site_order as order

    sites = read("supplier").select(F.col("s_suppkey").alias("site"), F.col("s_nationkey").alias("cycle"), F.substring("s_name", 10, 20).alias("register"), "s_name")
    return sites.select("site", F.row_number().over(W.orderBy(*order("cycle", "register"), "s_name", "site")).alias("rank"))


@query("""WITH e AS (SELECT o_orderkey AS run, o_custkey AS base, o_orderkey % 4 AS bytes, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS name FROM orders),
s AS (SELECT o_orderkey AS run, o_custkey AS base, o_orderkey % 4 AS bytes, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE o_orderpriority END AS name FROM orders WHERE o_orderkey % 5 <> 0)
SELECT run, base, bytes, name FROM e WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.run = e.run AND s.base = e.base AND s.bytes = e.bytes AND (e.name IS NULL OR e.name = s.name))""")
def missing_outputs(read):
    k = F.col("o_orderkey")
    base = [k.alias("run"), F.col("o_custkey").alias("base"), (k % 4).alias("bytes")]
    expected = read("orders").select(*base, F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).alias("name"))
    seen = read("orders").where(k % 5 != 0).select(*base, F.when(k % 3 == 0, "x").otherwise(F.col("o_orderpriority")).alias("name"))
    return classify.missing_outputs(expected, seen)


@query(f"""WITH {TRACE_SQL}, d AS (SELECT thread, count(*) AS n, max(cycle) - min(cycle) AS most FROM t GROUP BY thread)
SELECT thread, i, CAST(i * most // greatest(n - 1, 1) AS BIGINT) AS cycle FROM (SELECT *, unnest(range(n)) AS i FROM d)""")
def evenly_spaced(read):
    """Per thread as many cycles, evenly spaced over its span, as it has events."""
    domains = trace(read).groupBy("thread").agg(F.count(F.lit(1)).alias("n"), (F.max("cycle") - F.min("cycle")).alias("most"))
    return sampling.evenly_spaced(domains, "n", "most").select("thread", "i", "cycle")


@query("""WITH w AS (SELECT event_id AS cycle, CAST(floor(value) AS BIGINT) AS weight FROM events), c AS (SELECT cycle, sum(weight) OVER (ORDER BY cycle) AS upto FROM w),
d AS (SELECT i AS trial, ((i * 2654435761) % 4294967296) % (SELECT sum(weight) FROM w) AS x0 FROM range(500) t(i))
SELECT trial, CAST(x0 AS BIGINT) AS x0, min(cycle) AS cycle FROM d LEFT JOIN c ON upto > x0 GROUP BY trial, x0""")
def weighted_cycle_pick(read):
    """500 picks over the sum of all weights."""
    spark = read("region").sparkSession
    weights = read("events").select(F.col("event_id").alias("cycle"), F.floor("value").alias("weight"))
    total = weights.agg(F.sum("weight").alias("w")).first()["w"] or 1
    return sampling.weighted_pick(sampling.hash_draws(spark, 500, [total]), weights, "x0", "cycle", "weight")


@query("""SELECT o_custkey AS cycle, count(*) AS multiplicity, list_sort(list(o_orderkey))[(o_custkey * 7) % count(*) + 1] AS picked FROM orders GROUP BY o_custkey""")
def active_slot_pick(read):
    ids = read("orders").groupBy(F.col("o_custkey").alias("cycle")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("ids"))
    return ids.select("cycle", F.size("ids").cast("long").alias("multiplicity"), sampling.slot_of(F.col("ids"), F.col("cycle") * 7).alias("picked"))


@query("""SELECT o_orderpriority AS app, round(sum((o_orderstatus = 'O')::INT) / count(*)::DOUBLE, 6) AS benign_rate, round(sum((o_orderstatus = 'F')::INT) / count(*)::DOUBLE, 6) AS dcr_rate,
 round(sum((o_orderstatus = 'P')::INT) / count(*)::DOUBLE, 6) AS ebc_rate, round(1 - sum(CASE WHEN o_orderstatus = 'F' THEN 0.5e0 ELSE 0e0 END) / count(*), 6) AS masked_rate,
 round(sum(CASE WHEN o_orderstatus = 'F' THEN 0.5e0 ELSE 0e0 END) / count(*), 6) AS sdc_rate, 0e0 AS due_rate FROM orders GROUP BY 1""")
def predicted_rates(read):
    s = F.col("o_orderstatus")
    rows = read("orders").select(F.col("o_orderpriority").alias("app"), F.when(s == "O", "benign").when(s == "F", "dcr").otherwise("ebc").alias("kind"), F.lit(0.5).alias("sic"))
    out = sampling.predicted(rows, ["app"], "kind", "sic")
    return out.select("app", *[F.round(c, 6).alias(c) for c in out.columns if c != "app"])


@query("""WITH r AS (SELECT o_orderkey, o_orderkey % 5 = 0 AS failed, o_orderkey % 7 = 0 AS missing, ['outofrangememoryaccess', 'maxstepsexceeded', 'uninitializedload', 'missingbytes', 'other', ''][o_custkey % 6 + 1] AS error,
 CASE WHEN o_custkey % 4 <> 0 THEN o_orderstatus END AS golden, CASE WHEN o_custkey % 3 = 0 THEN 'X' WHEN o_custkey % 11 <> 0 THEN o_orderstatus END AS run FROM orders)
SELECT o_orderkey, CASE WHEN failed OR missing OR golden IS NULL OR run IS NULL THEN 'due' WHEN golden = run THEN 'masked' ELSE 'sdc' END AS outcome,
 CASE WHEN failed THEN CASE error WHEN 'outofrangememoryaccess' THEN 'out_of_range_memory_access' WHEN 'maxstepsexceeded' THEN 'max_steps_exceeded' WHEN 'uninitializedload' THEN 'uninitialized_load' WHEN 'missingbytes' THEN 'missing_bytes'
  ELSE CASE WHEN golden IS NULL THEN 'invalid_path' ELSE 'run_failed' END END WHEN missing THEN 'missing_expected_output' WHEN golden IS NULL OR run IS NULL THEN 'nothing_to_compare' WHEN golden = run THEN 'outputs_equal' ELSE 'outputs_differ' END AS reason FROM r""")
def semantic_outcomes(read):
    """Runs with typed errors, missing outputs and signatures."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    error = F.element_at(F.array(*[F.lit(e) for e in ("OutOfRangeMemoryAccess", " MaxStepsExceeded", "uninitializedload", "MissingBytes ", "Other", "")]), (cust % 6 + 1).cast("int"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = read("orders").select(
        "o_orderkey", (key % 5 == 0).alias("run_failed"), (key % 7 == 0).alias("run_missing_output"), error.alias("run_error_type"), none("boolean", "reference"), F.when(cust % 4 != 0, F.col("o_orderstatus")).alias("golden_signature"),
        F.when(cust % 3 == 0, "X").when(cust % 11 != 0, F.col("o_orderstatus")).alias("run_signature"), none("array<double>", "golden_values"), none("array<double>", "run_values"), none("array<string>", "golden_entries"), none("array<string>", "run_entries"),
    )
    return classify.semantic_outcome(rows).select("o_orderkey", "outcome", "reason")
