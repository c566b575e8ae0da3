"""What single-bit flips reach: comparisons, addresses, branches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import addresses, compare
from ..operators import history, intervals, taint
from . import TRACE_SQL, query, trace
from .scalars import INPUT_SQL, U64, _inputs, _s64

#: Every comparator with every type.
SHAPES = [(c, k, w) for k in "us" for w in (8, 16, 32, 64) for c in ("eq", "ne", "lt", "le", "gt", "ge")] + [(c, "f", w) for w in (16, 32, 64) for c in compare.COMPARATORS]
#: Zeros, infinities and their neighbours of the three float widths.
EDGES = [0, 0x8000, 0x80000000, -(1 << 63), 0x7C00, 0x7C01, 0xFC00, 0x7F800000, 0x7F800001, 0xFF800000, 0x7FF0000000000000, 0x7FF0000000000001, -(1 << 52), 1, -1]


def _listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else f"(-9223372036854775807 - 1)" if v == -(1 << 63) else f"{v}::BIGINT" for v in values) + "]"


def _value_sql(x: str) -> str:
    """The number that a pattern stands for, up to a monotone map, as a huge integer."""
    return f"CASE kind WHEN 's' THEN CASE WHEN {x} >= half THEN {x} - 2 * half ELSE {x} END WHEN 'f' THEN CASE WHEN {x} >= half THEN half - {x} ELSE {x} END ELSE {x} END"


def _compare_sql(a: str, b: str) -> str:
    """Whether two values compare so, the unordered ones being null."""
    tests = " ".join(f"WHEN '{n}' THEN {a} {s} {b}" for n, s in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")))
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN cmp IN ('ne', 'ltu', 'leu', 'gtu', 'geu') ELSE CASE rtrim(cmp, 'u') {tests} END END"


TOGGLE_SQL = f"""r AS (SELECT k, p, s, c[1] AS cmp, c[2] AS kind, CAST(c[3] AS INT) AS w, CAST(1 AS HUGEINT) << (CAST(c[3] AS INT) - 1) AS half, a, b FROM (
  SELECT k, p, s, {[list(map(str, x)) for x in SHAPES]}[(k * 7 + p * 3 + s) % {len(SHAPES)} + 1] AS c, CASE WHEN k % 16 = 7 THEN {_listed(EDGES)}[p % {len(EDGES)} + 1] ELSE u END AS a,
    CASE WHEN k % 4 = 1 THEN xor(u, CAST(1 AS BIGINT) << (p % 62)) WHEN k % 4 = 2 THEN u WHEN k % 8 = 7 THEN {_listed(EDGES)}[s % {len(EDGES)} + 1] ELSE v END AS b FROM i)),
x AS (SELECT *, ({U64.format('a')}) % (2 * half) AS x, ({U64.format('b')}) % (2 * half) AS y, CASE w WHEN 16 THEN 31744 WHEN 64 THEN 9218868437227405312 ELSE 2139095040 END AS inf FROM r),
f AS (SELECT *, xor(x, bit) AS x2, xor(y, bit) AS y2 FROM (SELECT x.*, CAST(1 AS HUGEINT) << n AS bit FROM x, range(64) q(n) WHERE n < w)),
g AS (SELECT *, {", ".join(f"CASE WHEN kind = 'f' AND {n} % half > inf THEN NULL ELSE {_value_sql(n)} END AS v{n}" for n in ("x", "y", "x2", "y2"))} FROM f)"""


@query(f"""WITH {INPUT_SQL}, {TOGGLE_SQL} SELECT k, p, s, cmp, kind, w, a, b, any_value({_compare_sql('vx', 'vy')}) AS holds,
{", ".join(f"{_s64(f'sum(CASE WHEN ({_compare_sql(*sides)}) <> ({_compare_sql('vx', 'vy')}) THEN bit ELSE 0 END)')} AS {name}" for name, sides in (('flips_a', ('vx2', 'vy')), ('flips_b', ('vx', 'vy2'))))} FROM g GROUP BY ALL""")
def setp_toggles(read):
    """Closed forms of all comparators and types; the SQL flips every bit."""
    edge = lambda c: F.element_at(F.array(*[F.lit(e).cast("long") for e in EDGES]), (c % len(EDGES) + 1).cast("int"))
    shape = F.element_at(F.array(*[F.struct(F.lit(c).alias("cmp"), F.lit(k).alias("kind"), F.lit(w).alias("w")) for c, k, w in SHAPES]), ((F.col("k") * 7 + F.col("p") * 3 + F.col("s")) % len(SHAPES) + 1).cast("int"))
    a = F.when(F.col("k") % 16 == 7, edge(F.col("p"))).otherwise(F.col("u"))
    near = F.col("u").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 62).cast("int")))
    b = F.when(F.col("k") % 4 == 1, near).when(F.col("k") % 4 == 2, F.col("u")).when(F.col("k") % 8 == 7, edge(F.col("s"))).otherwise(F.col("v"))
    rows = _inputs(read).select("k", "p", "s", shape.alias("shape"), a.alias("a"), b.alias("b")).select("k", "p", "s", "shape.*", "a", "b")
    flips = compare.toggles(F.col("cmp"), F.col("kind"), F.col("w"), F.col("a"), F.col("b"))
    return rows.select("*", compare.holds(F.col("cmp"), F.col("kind"), F.col("w"), F.col("a"), F.col("b")).alias("holds"), flips[0].alias("flips_a"), flips[1].alias("flips_b"))


OPS = ["IDENTITY", "ADDR_SUM", "ADD", "SUB", "AND", "OR", "XOR", "SHL", "SHR_U", "MUL_LO", "MAD", "SELP", "MIN_U", "NEG"]
ADDRESS_SQL = f"""o AS (SELECT k, p, s, {OPS}[(k + p) % {len(OPS)} + 1] AS op, [x, y, n + p % 7] AS vals, CASE WHEN (k + p) % {len(OPS)} IN (0, 13) THEN [1] WHEN (k + p) % {len(OPS)} IN (1, 10, 11) THEN [1, 2, 3] ELSE [1, CASE WHEN (k + p) % {len(OPS)} IN (7, 8) THEN 3 ELSE 2 END] END AS src,
  p % 4096 AS offs, CASE WHEN k % 3 = 0 THEN 4294967295 WHEN k % 3 = 1 THEN 16777215 ELSE 252645120 END AS live FROM i),
t AS (SELECT o.*, place, n.n AS bit, list_transform(list_transform(range(1, len(src) + 1), lambda j: [vals[src[j]], CASE WHEN j = place AND n.n >= 0 THEN CAST(1 AS BIGINT) << n.n ELSE 0 END]), lambda q: CAST(xor(q[1], q[2]) AS HUGEINT)) AS v
  FROM o, range(1, 4) r(place), range(-1, 32) n(n) WHERE place <= len(src)),
e AS (SELECT k, p, s, op, place, bit, live, src, CAST((CASE op WHEN 'IDENTITY' THEN v[1] + offs WHEN 'ADDR_SUM' THEN v[1] + v[2] + v[3] + offs WHEN 'ADD' THEN v[1] + v[2] WHEN 'SUB' THEN v[1] - v[2] + 4294967296 WHEN 'AND' THEN v[1] & v[2] WHEN 'OR' THEN v[1] | v[2] WHEN 'XOR' THEN xor(v[1], v[2])
  WHEN 'SHL' THEN v[1] * (CAST(1 AS HUGEINT) << CAST(v[2] % 32 AS INT)) WHEN 'SHR_U' THEN v[1] // (CAST(1 AS HUGEINT) << CAST(v[2] % 32 AS INT)) WHEN 'MUL_LO' THEN v[1] * v[2] WHEN 'MAD' THEN v[1] * v[2] + v[3] WHEN 'SELP' THEN CASE WHEN v[3] % 2 = 1 THEN v[1] ELSE v[2] END WHEN 'MIN_U' THEN least(v[1], v[2])
  WHEN 'NEG' THEN 4294967296 - v[1] END) % 4294967296 AS BIGINT) AS adr FROM t)"""


@query(f"""WITH {INPUT_SQL}, {ADDRESS_SQL} SELECT k, p, s, op, b.adr AS address, CAST(src[place] - 1 AS INT) AS source, CAST(sum(CASE WHEN xor(e.adr, b.adr) & live <> 0 THEN CAST(1 AS BIGINT) << bit ELSE 0 END) AS BIGINT) AS mask
FROM e JOIN (SELECT k, p, s, place, adr FROM e WHERE bit < 0) b USING (k, p, s, place) WHERE bit >= 0 GROUP BY ALL""")
def address_influence(read):
    """Addresses and the source bits that move them under a mask; the SQL flips every bit."""
    i = _inputs(read)
    which = (F.col("k") + F.col("p")) % len(OPS)
    op = F.element_at(F.array(*[F.lit(o) for o in OPS]), (which + 1).cast("int"))
    ints = lambda *xs: F.array(*[F.lit(x) if isinstance(x, int) else x for x in xs])
    src = F.when(which.isin(0, 13), ints(0)).when(which.isin(1, 10, 11), ints(0, 1, 2)).otherwise(ints(0, F.when(which.isin(7, 8), 2).otherwise(1)))
    live = F.when(F.col("k") % 3 == 0, F.lit(4294967295)).when(F.col("k") % 3 == 1, F.lit(16777215).cast("long")).otherwise(F.lit(252645120).cast("long"))
    expr = F.struct(op.alias("op"), src.alias("sources"), F.lit(32).alias("width"), (F.col("p") % 4096).alias("offset"))
    rows = i.select("k", "p", "s", expr.alias("expr"), F.array("x", "y", F.col("n") + F.col("p") % 7).alias("vals"), live.alias("live"))
    moved = addresses.influence(F.col("expr"), F.col("vals"), ints(32, 32, 32), F.col("live"))
    return rows.select("k", "p", "s", "expr.op", addresses.address(F.col("expr"), F.col("vals")).alias("address"), F.explode(moved).alias("m")).select("k", "p", "s", "op", "address", "m.source", "m.mask")


S32 = "CASE WHEN {0} >= 2147483648 THEN {0} - 4294967296 ELSE {0} END"
#: Every thread's events as comparisons, predicate logic, selections and branches over four predicates and ten registers.
CONTROL_SQL = f"""{TRACE_SQL}, c AS (SELECT thread, idx, addr, idx % 8 AS q, (idx * 40503) % 4294967296 AS a, CASE WHEN idx % 3 = 0 THEN xor((idx * 40503) % 4294967296, CAST(1 AS BIGINT) << (idx % 32)) ELSE (idx * 81006 + 2654435761) % 4294967296 END AS b FROM t),
w AS (SELECT thread, idx, addr % 4 AS reg FROM c WHERE q <= 5 OR (q = 7 AND idx % 5 = 0)),
h AS (SELECT *, CASE q WHEN 0 THEN ({S32.format('a')}) < ({S32.format('b')}) WHEN 1 THEN a >= b ELSE a = b END AS now FROM c),
side AS (SELECT thread, idx, addr, q, now, a, b, [xor(a, CAST(1 AS BIGINT) << k) FOR k IN range(32)] AS fa, [xor(b, CAST(1 AS BIGINT) << k) FOR k IN range(32)] AS fb FROM h WHERE q <= 2),
tog AS (SELECT *, CAST(list_sum([CASE WHEN (CASE q WHEN 0 THEN ({S32.format('fa[k]')}) < ({S32.format('b')}) WHEN 1 THEN fa[k] >= b ELSE fa[k] = b END) <> now THEN CAST(1 AS BIGINT) << (k - 1) ELSE 0 END FOR k IN range(1, 33)]) AS BIGINT) AS ta,
  CAST(list_sum([CASE WHEN (CASE q WHEN 0 THEN ({S32.format('a')}) < ({S32.format('fb[k]')}) WHEN 1 THEN a >= fb[k] ELSE a = fb[k] END) <> now THEN CAST(1 AS BIGINT) << (k - 1) ELSE 0 END FOR k IN range(1, 33)]) AS BIGINT) AS tb FROM side),
m(thread, idx, source, pred, reg, mask) AS (
  SELECT thread, idx, 0, idx % 11 = 0, CASE WHEN idx % 11 = 0 THEN (addr + 1) % 4 ELSE addr % 10 END, CASE WHEN idx % 11 = 0 THEN 1 ELSE ta END FROM tog UNION ALL SELECT thread, idx, 1, FALSE, (addr + 3) % 10, tb FROM tog
  UNION ALL SELECT thread, idx, j, TRUE, (addr + 1 + j) % 4, 1 FROM c, range(2) r(j) WHERE q IN (3, 4)
  UNION ALL SELECT thread, idx, 0, TRUE, (addr + 1) % 4, (idx // 4) % 2 FROM c WHERE q = 5 UNION ALL SELECT thread, idx, 1, TRUE, (addr + 2) % 4, 1 - (idx // 4) % 2 FROM c WHERE q = 5
  UNION ALL SELECT thread, idx, 2, TRUE, (addr + 3) % 4, CASE WHEN idx % 2 <> (idx // 2) % 2 THEN 1 ELSE 0 END FROM c WHERE q = 5),
k AS (SELECT * FROM m WHERE mask <> 0),
rd AS (SELECT thread, idx, addr % 4 AS reg FROM c WHERE q = 6 UNION SELECT thread, idx, reg FROM k WHERE pred),
us AS (SELECT rd.thread, rd.idx AS reader, w.idx AS writer FROM rd ASOF JOIN w ON rd.thread = w.thread AND rd.reg = w.reg AND rd.idx > w.idx),
mt(thread, branch, node) AS (SELECT c.thread, c.idx, writer FROM c JOIN us ON us.thread = c.thread AND us.reader = c.idx WHERE q = 6 UNION SELECT mt.thread, branch, writer FROM mt JOIN us ON us.thread = mt.thread AND us.reader = mt.node)"""


def _control_program(read):
    t = trace(read)
    i, n, q = F.col("idx"), F.col("addr"), F.col("idx") % 8
    p, r = (lambda c, k=0: F.concat(F.lit("%p"), ((c + k) % 4).cast("string"))), (lambda c, k=0: F.concat(F.lit("%r"), ((c + k) % 10).cast("string")))
    op = F.element_at(F.array(*[F.lit(x) for x in ("setp.lt.s32", "setp.ge.u32", "setp.eq.b32", "and.pred", "or.pred", "selp.b32", "bra", "xor.pred")]), (q + 1).cast("int"))
    srcs = F.when(q <= 2, F.array(F.when(i % 11 == 0, p(n, 1)).otherwise(r(n)), r(n, 3))).when(q.isin(3, 4), F.array(p(n, 1), p(n, 2))).when(q == 5, F.array(p(n, 1), p(n, 2), p(n, 3))).when(q == 6, F.array(p(n))).otherwise(F.array(r(n, 1), r(n, 2)))
    a = (i * 40503) % 4294967296
    b = F.when(i % 3 == 0, a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), (i % 32).cast("int")))).otherwise((i * 81006 + 2654435761) % 4294967296)
    bit = lambda k: F.floor(i / k) % 2
    values = F.when(q == 5, F.array(bit(1), bit(2), bit(4))).when(q.isin(3, 4), F.array(bit(1), bit(2))).when(q == 6, F.array(bit(1))).otherwise(F.array(a, b))
    widths = F.transform(srcs, lambda s: F.when(taint.is_predicate(s), 1).otherwise(32))
    dst = F.when((q <= 5) | ((q == 7) & (i % 5 == 0)), p(n)).when(q == 7, r(n))
    return t.select("thread", i.alias("index"), F.when(q == 6, "branch").otherwise("inst").alias("kind"), op.alias("opcode"), dst.alias("dst"), srcs.alias("srcs"), values.alias("values"), widths.alias("widths"), (i % 2 == 0).alias("taken"))


@query(f"""WITH RECURSIVE {CONTROL_SQL} SELECT mt.thread, branch, branch % 2 <> 0 AS decision, node AS index, CAST(source AS INT) AS source, CASE WHEN pred THEN '%p' ELSE '%r' END || CAST(reg AS VARCHAR) AS register, CAST(mask AS BIGINT) AS mask FROM mt JOIN k ON k.thread = mt.thread AND k.idx = mt.node""")
def control_taint(read):
    """Bits of sources that turn a later branch of their thread."""
    return taint.control_taint(_control_program(read))[0]


@query(f"""WITH RECURSIVE {CONTROL_SQL} SELECT mt.thread, branch, node AS index FROM mt JOIN c ON c.thread = mt.thread AND c.idx = mt.node WHERE q = 7""")
def control_taint_blocked(read):
    """Instructions that a branch depends on and no rule passes."""
    return taint.control_taint(_control_program(read))[1]


@query("""WITH r AS (SELECT p_partkey AS range, p_partkey % 5 AS space, p_partkey * 1000003 % 1099511627776 AS base, CAST(1 AS BIGINT) << (p_size % 41) AS size FROM part),
a AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS p, l_partkey % 5 AS space, (l_orderkey * 2654435761 + l_partkey * 7919) % 1099511627776 AS address FROM lineitem)
SELECT k, p, space, address FROM a WHERE EXISTS (SELECT 1 FROM r WHERE r.space = a.space AND base <= address AND address + 4 <= base + size)""")
def contained_wide(read):
    """Accesses inside a range of their space, ranges being of one byte to 2^40 bytes."""
    part = F.col("p_partkey")
    ranges = read("part").select((part % 5).alias("space"), (part * 1000003 % (1 << 40)).alias("base"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p_size") % 41).cast("int")).alias("size"))
    address = (F.col("k") * 2654435761 + F.col("p") * 7919) % (1 << 40)
    rows = read("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"), (F.col("l_partkey") % 5).alias("space"))
    return intervals.contained(rows, ranges, address, address + 4, once=True).withColumn("address", address)


@query(f"""WITH {TRACE_SQL}, a AS (SELECT thread, idx, kind, addr * 4 AS base, addr % 3 * 16843009 + CASE WHEN idx % 5 = 0 THEN 255 ELSE 0 END AS moved FROM t WHERE kind IN ('purchase', 'view') AND idx % 8 <> 0),
h AS (SELECT thread, idx, base + k AS byte, (moved >> (8 * k)) & 255 AS v FROM a, range(4) r(k)),
f AS (SELECT *, target + 4 > 512 AS outside FROM (SELECT thread, idx, kind, moved, bit, xor(base, CAST(1 AS BIGINT) << bit) AS target FROM a, range(16) n(bit) WHERE idx % 3 = 0)),
q AS (SELECT f.*, k, target + k AS byte, idx - CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END AS upto FROM f, range(4) r(k) WHERE NOT outside),
m AS (SELECT q.*, h.v FROM q ASOF LEFT JOIN h ON q.thread = h.thread AND q.byte = h.byte AND q.upto >= h.idx)
SELECT thread AS launch, idx AS index, CAST(bit AS INT) AS bit, FALSE AS outside, bool_and(v IS NOT NULL) AS known, CAST(sum(coalesce(xor(v, (moved >> (8 * k)) & 255), 255) << (8 * k)) AS BIGINT) AS differs FROM m GROUP BY thread, idx, bit
UNION ALL SELECT thread, idx, CAST(bit AS INT), TRUE, FALSE, NULL FROM f WHERE outside""")
def address_flips(read):
    """Where each flipped address bit of a load or store leads, and which bits of the value it would have met differ."""
    t = trace(read)
    kind = F.when(F.col("kind") == "purchase", "store").when(F.col("kind") == "view", "load").otherwise("inst")
    moved = F.col("addr") % 3 * 16843009 + F.when(F.col("idx") % 5 == 0, 255).otherwise(0)
    rows = t.select(
        F.col("thread").alias("launch"), F.col("idx").alias("index"), kind.alias("kind"), (F.col("idx") % 8 != 0).alias("held"), F.concat(F.lit("local"), F.col("thread").cast("string")).alias("scope"),
        (F.col("addr") * 4).alias("addr"), F.lit(4).alias("size"), F.when(F.col("idx") % 3 == 0, 1).alias("base"), moved.alias("moved"),
    )
    return history.flips(rows, "launch", [(0, 512)], 16)
