"""Scalar operators on keys of line items as register values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import convert, floats
from ..functions import scalars as B
from . import query

M = 4294967296
#: 32-bit values x and y, a small amount n, and 64-bit patterns u and v.
INPUT_SQL = """q AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS p, l_suppkey AS s FROM lineitem),
i AS (SELECT k, p, s, (k * 2654435761 + p) % 4294967296 AS x, (p * 40503 + s * 2246822519) % 4294967296 AS y, s % 40 AS n,
  k * 1000003 * 1009 + p AS u, -1 - (p * 999983 * 1013 + s) AS v FROM q)"""
U64 = "CASE WHEN ({0}) < 0 THEN ({0})::HUGEINT + 18446744073709551616 ELSE ({0})::HUGEINT END"


def _s64(expr: str) -> str:
    """A huge integer as the signed 64-bit number of its pattern."""
    m = f"((({expr}) % 18446744073709551616 + 18446744073709551616) % 18446744073709551616)"
    return f"CAST(CASE WHEN {m} >= 9223372036854775808 THEN {m} - 18446744073709551616 ELSE {m} END AS BIGINT)"


def _inputs(read):
    k, p, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    rows = read("lineitem").select(k, p, s).distinct()
    return rows.select(
        k.alias("k"), p.alias("p"), s.alias("s"), ((k * 2654435761 + p) % M).alias("x"), ((p * 40503 + s * 2246822519) % M).alias("y"), (s % 40).alias("n"),
        (k * (1000003 * 1009) + p).alias("u"), (F.lit(-1).cast("long") - (p * (999983 * 1013) + s)).alias("v"),
    )


def _over(read, **columns):
    i = _inputs(read)
    return i.select("k", "p", "s", *[c.alias(name) for name, c in columns.items()])


def _c(name):
    return F.col(name)


@query(f"""WITH {INPUT_SQL} SELECT k, p, s, x & y AS band, x | y AS bor, xor(x, y) AS bxor, 4294967295 - x AS bnot, (x + y) % 4294967296 AS badd, (x - y + 4294967296) % 4294967296 AS bsub, (4294967296 - x) % 4294967296 AS bneg,
 CAST((x::HUGEINT * y) % 4294967296 AS BIGINT) AS bmul, x & (4294967295 - y) AS bandn, 4294967295 - (x & y) AS bnand, 4294967295 - (x | y) AS bnor, CASE WHEN x % 2 = 0 THEN 1::BIGINT ELSE 0::BIGINT END AS bnotp FROM i""")
def bit_scalar_suite(read):
    x, y = _c("x"), _c("y")
    return _over(read, band=B.and_(x, y, 32), bor=B.or_(x, y, 32), bxor=B.xor(x, y, 32), bnot=B.not_(x, 32), badd=B.add(x, y, 32), bsub=B.sub(x, y, 32), bneg=B.neg(x, 32), bmul=B.mul_lo(x, y, 32), bandn=B.and_not(x, y, 32), bnand=B.nand(x, y, 32), bnor=B.nor(x, y, 32), bnotp=B.not_pred(x))


S32 = "(CASE WHEN {0} >= 2147483648 THEN {0} - 4294967296 ELSE {0} END)"


@query(f"""WITH {INPUT_SQL} SELECT k, p, s, {_s64(f"({U64.format('u')}) + ({U64.format('v')})")} AS wadd, {_s64(f"({U64.format('u')}) - ({U64.format('v')})")} AS wsub, {_s64("(" + U64.format('u') + ") * x")} AS wmul,
 {_s64("x::HUGEINT * y")} AS wide_u, CAST({S32.format('x')} * {S32.format('y')} AS BIGINT) AS wide_s, {_s64(f"x::HUGEINT * y + ({U64.format('v')})")} AS wmad, CAST(((x % 16777216) * (y % 16777216)) % 4294967296 AS BIGINT) AS mul24,
 CAST((abs(x - y) + n) % 4294967296 AS BIGINT) AS sad FROM i""")
def wide_arithmetic(read):
    x, y, n, u, v = map(_c, "xynuv")
    return _over(read, wadd=B.add(u, v), wsub=B.sub(u, v), wmul=B.mul_lo(u, x), wide_u=B.mul_wide_u32(x, y), wide_s=B.mul_wide_s32(x, y), wmad=B.mad(x, y, v), mul24=B.mul24(x, y), sad=B.sad(x, y, n, 32))


@query(f"""WITH {INPUT_SQL} SELECT k, p, s, CAST((x::HUGEINT * (1::BIGINT << CAST(n % 32 AS INT))) % 4294967296 AS BIGINT) AS shl, x >> CAST(n % 32 AS INT) AS shr_u,
 CAST(({S32.format('x')} >> CAST(n % 32 AS INT)) & 4294967295 AS BIGINT) AS shr_s, CASE WHEN n >= 32 THEN 0 ELSE CAST((x::HUGEINT * (1::BIGINT << CAST(n % 32 AS INT))) % 4294967296 AS BIGINT) END AS shl_clamped,
 CASE WHEN n >= 32 THEN 0 ELSE x >> CAST(n % 32 AS INT) END AS shr_clamped FROM i""")
def shifts_two_rules(read):
    x, n = _c("x"), _c("n")
    return _over(read, shl=B.shl(x, n, 32), shr_u=B.shr_u(x, n, 32), shr_s=B.shr_s(x, n, 32), shl_clamped=B.shl_clamped(x, n, 32), shr_clamped=B.shr_u_clamped(x, n, 32))


@query(f"""WITH {INPUT_SQL}, b AS (SELECT *, right(repeat('0', 64) || bin(x), 32) AS t FROM i) SELECT k, p, s, CAST(bit_count(x) AS BIGINT) AS popc, CASE WHEN x = 0 THEN 32 ELSE 32 - length(ltrim(bin(x), '0')) END::BIGINT AS clz,
 CASE WHEN x = 0 THEN 4294967295 ELSE length(ltrim(bin(x), '0')) - 1 END::BIGINT AS bfind, CAST(list_sum([CASE WHEN substr(t, j, 1) = '1' THEN 1::BIGINT << (j - 1) ELSE 0 END FOR j IN range(1, 33)]) AS BIGINT) AS brev,
 (x >> CAST(n % 32 AS INT)) & 255 AS bfe, CASE WHEN x = 0 THEN 1 ELSE 0 END::BIGINT AS cnot FROM b""")
def bit_fields(read):
    x, n = _c("x"), _c("n")
    return _over(read, popc=B.popc(x, 32), clz=B.clz(x, 32), bfind=B.bfind(x, 32), brev=B.brev(x, 32), bfe=B.bfe_u(x, n % 32, F.lit(8).cast("long"), 32), cnot=B.is_zero(x, 32))


@query(f"""WITH {INPUT_SQL} SELECT k, p, s, xor(xor(x, y), n) AS lop3_xor, (x & y) | (x & n) | (y & n) AS lop3_majority, least(x, y) AS min_u, greatest(x, y) AS max_u,
 CAST(least({S32.format('x')}, {S32.format('y')}) & 4294967295 AS BIGINT) AS min_s, CAST(greatest({S32.format('x')}, {S32.format('y')}) & 4294967295 AS BIGINT) AS max_s, CAST(x < y AS BIGINT) AS lt_u, CAST({S32.format('x')} < {S32.format('y')} AS BIGINT) AS lt_s,
 CASE WHEN n % 2 = 1 THEN x ELSE y END AS selp, CASE WHEN {S32.format('y')} >= 0 THEN x ELSE n END AS slct, CASE WHEN u < 0 AND v >= 0 THEN u WHEN v < 0 AND u >= 0 THEN v ELSE greatest(u, v) END AS max_u64 FROM i""")
def compare_select(read):
    x, y, n, u, v = map(_c, "xynuv")
    return _over(read, lop3_xor=B.lop3(x, y, n, 0x96, 32), lop3_majority=B.lop3(x, y, n, 0xE8, 32), min_u=B.min_u(x, y), max_u=B.max_u(x, y), min_s=B.min_s(x, y, 32), max_s=B.max_s(x, y, 32), lt_u=B.setp("lt", x, y, 32), lt_s=B.setp("lt", x, y, 32, True), selp=B.selp(x, y, n), slct=B.slct(x, n, y), max_u64=B.max_u(u, v))


@query(f"""WITH {INPUT_SQL} SELECT k, p, s, CAST(CASE WHEN x % 256 >= 128 THEN x % 256 - 256 ELSE x % 256 END AS BIGINT) AS sext8, CAST(CASE WHEN x % 65536 >= 32768 THEN x % 65536 - 65536 ELSE x % 65536 END & 4294967295 AS BIGINT) AS cvt_s16_s32,
 x % 65536 AS cvt_u32_u16, {_s64(S32.format('x') + "::HUGEINT")} AS cvt_s32_s64 FROM i""")
def sign_extend(read):
    x = _c("x")
    return _over(read, sext8=B.signed(B.cut(x, 8), 8), cvt_s16_s32=B.cvt(x, 16, 32, True), cvt_u32_u16=B.cvt(x, 32, 16, False), cvt_s32_s64=B.cvt(x, 32, 64, True))


@query(f"""WITH {INPUT_SQL} SELECT k, p, s, y & x AS i_and, y & (4294967295 - x) AS i_or, y AS i_xor, y >> CAST(n % 32 AS INT) AS i_shl, CAST((y::HUGEINT * (1::BIGINT << CAST(n % 32 AS INT))) % 4294967296 AS BIGINT) AS i_shr,
 CASE WHEN n % 2 = 1 THEN y ELSE 0 END AS i_selp FROM i""")
def backward_influence(read):
    x, y, n = map(_c, "xyn")
    return _over(read, i_and=B.influence("and", y, n, x, 32), i_or=B.influence("or", y, n, x, 32), i_xor=B.influence("xor", y, n, x, 32), i_shl=B.influence("shl", y, x, n, 32), i_shr=B.influence("shr_u", y, x, n, 32), i_selp=B.influence("selp", y, x, n, 32))


@query("""SELECT p_partkey AS k, p_partkey * 37 % 256 & (p_size * 5 % 256) AS by_flips FROM part""")
def influence_brute_force(read):
    live, other = F.col("p_partkey") * 37 % 256, (F.col("p_size") * 5 % 256).cast("long")
    return read("part").select(F.col("p_partkey").alias("k"), B.influence_by_flips(lambda a: B.and_(a, other, 8), F.col("p_partkey") % 256, live, 8).alias("by_flips"))


@query(f"""WITH {INPUT_SQL} SELECT k, p, s, (u >> 7) & 63 AS linear, xor(u >> 7, u >> 13) & 63 AS hashed, ((u >> 4) & 3) | (((u >> 9) & 7) << 2) AS gathered FROM i""")
def address_hash(read):
    u = _c("u")
    return _over(read, linear=B.set_index_linear(u, 128, 64), hashed=B.set_index_xor(u, 128, 64), gathered=B.field(u, 0b11 << 4 | 0b111 << 9))


@query("""SELECT p_partkey AS k, round(sin(p_retailprice), 6) AS sin_x, round(cos(p_retailprice), 6) AS cos_x, round(pow(2, p_size / 10e0), 6) AS ex2_x, round(log2(p_retailprice), 6) AS lg2_x, round(1e0 / p_retailprice, 9) AS rcp_x,
 round(1e0 / sqrt(p_retailprice), 9) AS rsqrt_x, round(sqrt(p_retailprice), 6) AS sqrt_x FROM part""")
def transcendental(read):
    t, price = B.TRANSCENDENTAL, F.col("p_retailprice")
    return read("part").select(F.col("p_partkey").alias("k"), F.round(t["sin"](price), 6).alias("sin_x"), F.round(t["cos"](price), 6).alias("cos_x"), F.round(t["ex2"](F.col("p_size") / 10.0), 6).alias("ex2_x"), F.round(t["lg2"](price), 6).alias("lg2_x"), F.round(t["rcp"](price), 9).alias("rcp_x"), F.round(t["rsqrt"](price), 9).alias("rsqrt_x"), F.round(t["sqrt"](price), 6).alias("sqrt_x"))


@query("""SELECT p_partkey AS k, CAST(CAST(p_retailprice AS FLOAT) + CAST(p_size AS FLOAT) AS DOUBLE) AS fadd, CAST(CAST(p_retailprice AS FLOAT) * CAST(p_size AS FLOAT) AS DOUBLE) AS fmul, CAST(p_retailprice AS FLOAT) < CAST(p_size * 30 AS FLOAT) AS flt FROM part""")
def float_operators(read):
    rows = read("part").select(F.col("p_partkey").alias("k"), floats.to_bits(F.col("p_retailprice")).alias("a"), floats.to_bits(F.col("p_size").cast("double")).alias("b"), floats.to_bits((F.col("p_size") * 30).cast("double")).alias("c"))
    return rows.select("k", floats.from_bits(floats.f32("add", F.col("a"), F.col("b"))).alias("fadd"), floats.from_bits(floats.f32("mul", F.col("a"), F.col("b"))).alias("fmul"), floats.setp("lt", F.col("a"), F.col("c"), 32).alias("flt"))


@query(f"""WITH {INPUT_SQL} SELECT k, p, s, CAST(((x >> 8) & 255) | (((y >> 16) & 255) << 8) | ((x & 255) << 16) | ((CASE WHEN (y >> 24) >= 128 THEN 255 ELSE 0 END)::BIGINT << 24) AS BIGINT) AS prmt,
 CAST(least(greatest({S32.format('x')}, {S32.format('y')}), n) & 4294967295 AS BIGINT) AS vmax_min, CAST(greatest(least({S32.format('x')}, {S32.format('y')}), n) & 4294967295 AS BIGINT) AS vmin_max,
 (y & (4294967295 - 4080)) | ((x & 255) << 4) AS bfi FROM i""")
def byte_and_video(read):
    x, y, n = map(_c, "xyn")
    return _over(read, prmt=B.prmt(x, y, F.lit(0xF061).cast("long")), vmax_min=B.vminmax("max", x, y, n, "min"), vmin_max=B.vminmax("min", x, y, n, "max"), bfi=B.bfi(x, y, F.lit(4).cast("long"), F.lit(8).cast("long"), 32))


@query(f"""WITH {INPUT_SQL} SELECT k, p, s, CASE WHEN n = 0 THEN 4294967295 ELSE x // n END AS div_u, CASE WHEN n = 0 THEN x ELSE x % n END AS rem_u,
 CASE WHEN y = 0 THEN 4294967295 ELSE CAST(trunc({S32.format('x')}::DOUBLE / {S32.format('y')}) AS BIGINT) & 4294967295 END AS div_s, CASE WHEN y = 0 THEN x ELSE {S32.format('x')} % {S32.format('y')} & 4294967295 END AS rem_s,
 (x + y + n % 2) % 4294967296 AS sum_c, (x + y + n % 2) // 4294967296 AS carry, CAST((x::HUGEINT * y % 4294967296 + n + 1) % 4294967296 AS BIGINT) AS mad_lo, CAST((x::HUGEINT * y // 4294967296 + y + 1) // 4294967296 AS BIGINT) AS mad_hi_carry FROM i""")
def division_and_carry(read):
    x, y, n = map(_c, "xyn")
    one = F.lit(1).cast("long")
    total, carry = B.add_carry(x, y, n % 2, 32)
    return _over(read, div_u=B.div_u(x, n, 32), rem_u=B.rem_u(x, n, 32), div_s=B.div_s(x, y, 32), rem_s=B.rem_s(x, y, 32), sum_c=total, carry=carry, mad_lo=B.mad_carry(x, y, n, one, 32)[0], mad_hi_carry=B.mad_carry(x, y, y, one, 32, True)[1])


#: The powers x**5, x**6, ... modulo x**5 + x**2 + 1, as numbers.
POWERS_32 = "[5, 10, 20, 13, 26, 17, 7, 14, 28, 29, 31, 27, 19, 3, 6]"


@query(f"""WITH {INPUT_SQL} SELECT k, p, s, list_reduce(list_prepend(n % 32, [((x >> CAST(b AS INT)) & 1) * {POWERS_32}[b + 1] FOR b IN range(15)]), lambda a, c: xor(a, c)) AS polynomial FROM i""")
def polynomial_set_index(read):
    return _over(read, polynomial=B.set_index_polynomial(_c("x"), _c("n") % 32, 32))


@query(f"""WITH {INPUT_SQL}, b AS (SELECT *, [(x >> CAST(j AS INT)) & 1 FOR j IN range(16)] AS a, [(n >> CAST(j AS INT)) & 1 FOR j IN range(5)] AS c FROM i)
SELECT k, p, s, (a[14] + a[11] + a[10] + a[6] + a[1] + c[4]) % 2 + (a[13] + a[12] + a[7] + a[2] + c[4] + c[3]) % 2 * 2 + (a[15] + a[10] + a[9] + a[8] + a[3] + c[2] + c[3]) % 2 * 4
 + (a[12] + a[11] + a[9] + a[4] + c[3]) % 2 * 8 + (a[13] + a[10] + a[9] + a[6] + a[5] + c[2] + c[1] + c[5]) % 2 * 16 AS page FROM b""")
def page_set_index(read):
    return _over(read, page=B.set_index_page(_c("x"), _c("n") % 32))


@query("""WITH e AS (SELECT event_id, (value - 100) * 0.25e0 AS x, event_id * 1048583 * 977 - 5000000000000 AS i FROM events)
SELECT event_id, CAST(round_even(x, 0) AS BIGINT) & 4294967295 AS rn, CAST(trunc(x) AS BIGINT) & 4294967295 AS rz, CAST(floor(x) AS BIGINT) & 4294967295 AS rm, CAST(ceil(x) AS BIGINT) & 4294967295 AS rp,
 CAST(least(greatest(ceil(x), 0), 255) AS BIGINT) AS clamped, CAST(CAST(x AS FLOAT) AS DOUBLE) AS single, CAST(CAST(i AS FLOAT) AS DOUBLE) AS from_integer, i & 65535 AS narrow, CASE WHEN i < 0 THEN 0 ELSE least(i, 65535) END AS saturated FROM e""")
def rounded_conversions(read):
    """Doubles to integers by all roundings, to floats, and integers to floats and narrower integers."""
    rows = read("events").select("event_id", ((F.col("value") - 100) * 0.25).alias("x"), (F.col("event_id") * (1048583 * 977) - 5000000000000).alias("i"))
    rows = rows.withColumn("bits", floats.to_bits(F.col("x"), 64))
    to = lambda kind, mode="rn", source="f64", of="bits", saturate=False: convert.convert(F.col(of), source, kind, mode, saturate)
    return rows.select(
        "event_id", *[to("s32", m).alias(m) for m in convert.MODES], to("u8", "rp").alias("clamped"), floats.from_bits(to("f32")).alias("single"), floats.from_bits(to("f32", source="s64", of="i")).alias("from_integer"),
        to("u16", source="s64", of="i").alias("narrow"), to("u16", source="s64", of="i", saturate=True).alias("saturated"),
    )
