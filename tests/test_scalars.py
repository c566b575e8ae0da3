"""Scalar functions against plain Python on random and edge values."""

from __future__ import annotations

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from faultline.functions import cleaning as C
from faultline.functions import floats
from faultline.functions import scalars as B
from faultline.operators import liveness

EDGES = [0, 1, 2, 31, 32, 63, 64, 0x7FFFFFFF, 0x80000000, 0xFFFFFFFF, 1 << 62, (1 << 63) - 1, 1 << 63, (1 << 64) - 1]


def long(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def s(x: int, w: int) -> int:
    x &= (1 << w) - 1
    return x - (1 << w) if x >> (w - 1) else x


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(7)
    rows = [(a, b) for a in EDGES for b in EDGES] + [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(300)]
    df = spark.createDataFrame([(i, long(a), long(b), b % 70, a % 70) for i, (a, b) in enumerate(rows)], "i long, a long, b long, n long, m long").cache()
    return rows, df


def bfe(x: int, pos: int, size: int, w: int, signed: bool) -> int:
    x &= (1 << w) - 1
    if size == 0:
        return 0
    field = (x >> pos if pos < w else 0) & ((1 << min(size, 64)) - 1)
    if signed and x >> min(pos + size - 1, w - 1) & 1:
        kept = max(0, min(size, w - pos))
        field |= ~((1 << kept) - 1)
    return field & ((1 << w) - 1)


@pytest.mark.parametrize("w", [8, 16, 32, 64])
def test_integer_operators(values, w):
    rows, df = values
    m = (1 << w) - 1
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    made = {
        "add": (B.add(a, b, w), lambda x, y, k: (x + y) & m), "sub": (B.sub(a, b, w), lambda x, y, k: (x - y) & m), "neg": (B.neg(a, w), lambda x, y, k: -x & m), "mul": (B.mul_lo(a, b, w), lambda x, y, k: x * y & m),
        "mad": (B.mad(a, b, a, w), lambda x, y, k: (x * y + x) & m), "not": (B.not_(a, w), lambda x, y, k: ~x & m), "shl": (B.shl(a, n, w), lambda x, y, k: x << (k & (w - 1)) & m),
        "shr": (B.shr_u(a, n, w), lambda x, y, k: (x & m) >> (k & (w - 1))), "sar": (B.shr_s(a, n, w), lambda x, y, k: s(x, w) >> (k & (w - 1)) & m), "shlc": (B.shl_clamped(a, n, w), lambda x, y, k: x << k & m if k < w else 0),
        "shrc": (B.shr_u_clamped(a, n, w), lambda x, y, k: (x & m) >> k if k < w else 0), "popc": (B.popc(a, w), lambda x, y, k: bin(x & m).count("1")), "clz": (B.clz(a, w), lambda x, y, k: w - (x & m).bit_length()),
        "brev": (B.brev(a, w), lambda x, y, k: int(f"{x & m:0{w}b}"[::-1], 2)), "mins": (B.min_s(a, b, w), lambda x, y, k: min(s(x, w), s(y, w)) & m), "maxs": (B.max_s(a, b, w), lambda x, y, k: max(s(x, w), s(y, w)) & m),
        "ltu": (B.setp("lt", a, b, w), lambda x, y, k: int((x & m) < (y & m))), "ges": (B.setp("ge", a, b, w, True), lambda x, y, k: int(s(x, w) >= s(y, w))),
        "lop3": (B.lop3(a, b, n, 0xCA, w), lambda x, y, k: sum(((0xCA >> ((x >> i & 1) + 2 * (y >> i & 1) + 4 * (k >> i & 1))) & 1) << i for i in range(w))),
        "bfeu": (B.bfe_u(a, n % w, F.lit(5).cast("long"), w), lambda x, y, k: bfe(x, k % w, 5, w, False)), "bfes": (B.bfe_s(a, n % w, F.lit(5).cast("long"), w), lambda x, y, k: bfe(x, k % w, 5, w, True)),
        "bfi": (B.bfi(a, b, F.lit(3).cast("long"), F.lit(4).cast("long"), w), lambda x, y, k: ((y & ~(15 << 3)) | (x & 15) << 3) & m), "sad": (B.sad(B.cut(a, w), B.cut(b, w), n, w), lambda x, y, k: (abs((x & m) - (y & m)) + k) & m),
    }
    got = df.select("i", *[c.alias(k) for k, (c, _) in made.items()]).collect()
    for r in got:
        x, y = rows[r["i"]]
        for k, (_, f) in made.items():
            assert r[k] == long(f(x, y, y % 70)), (k, w, x, y)


def test_32_bit_operators(values):
    rows, df = values
    a, b = F.col("a"), F.col("b")
    got = df.select("i", B.mul_wide_u32(a, b).alias("u"), B.mul_wide_s32(a, b).alias("s"), B.mul24(a, b).alias("m24"), B.prmt(a, b, F.lit(0x7A41).cast("long")).alias("prmt"), B.bfind(a, 32).alias("bfind"), B.vminmax("max", a, b, a, "min").alias("v")).collect()
    m = 0xFFFFFFFF
    for r in got:
        x, y = rows[r["i"]]
        assert r["u"] == long((x & m) * (y & m)) and r["s"] == s(x, 32) * s(y, 32) and r["m24"] == (x & 0xFFFFFF) * (y & 0xFFFFFF) & m
        data = [(x >> 8 * i) & 255 for i in range(4)] + [(y >> 8 * i) & 255 for i in range(4)]
        want = 0
        for i, sel in enumerate((1, 4, 0xA, 7)):
            byte = data[sel & 7]
            want |= ((255 if byte > 127 else 0) if sel & 8 else byte) << 8 * i
        assert r["prmt"] == want
        assert r["bfind"] == ((x & m).bit_length() - 1 if x & m else m)
        assert r["v"] == min(max(s(x, 32), s(y, 32)), s(x, 32)) & m


def test_influence_is_what_flips_show(values):
    rows, df = values
    w, live = 16, F.col("m") * 937 % 65536
    a, b = F.col("a").bitwiseAND(F.lit(65535)), F.col("b").bitwiseAND(F.lit(65535))
    cases = {"and": lambda x: B.and_(x, b, w), "or": lambda x: B.or_(x, b, w), "xor": lambda x: B.xor(x, b, w), "shl": lambda x: B.shl(x, b, w), "shr_u": lambda x: B.shr_u(x, b, w)}
    columns = [f for op, run in cases.items() for f in (B.influence(op, live, a, b, w).alias(op), B.influence_by_flips(run, a, live, w).alias(f"{op}_flips"))]
    for r in df.limit(200).select(*columns).collect():
        for op in cases:
            assert r[op] == r[f"{op}_flips"], op


def test_python_influence_closed_forms():
    rng = random.Random(3)
    for _ in range(500):
        w = rng.choice([1, 8, 32])
        v, live = [rng.getrandbits(w), rng.getrandbits(w)], rng.getrandbits(w)
        for op in ("and", "or", "xor"):
            for which in (0, 1):
                base = liveness.FORWARD[op](v, w)
                want = sum(1 << i for i in range(w) if (liveness.FORWARD[op]([x ^ (1 << i) if k == which else x for k, x in enumerate(v)], w) ^ base) & live)
                assert liveness.influence(op, v, w, live, which) == want


def test_floats(spark):
    bits = lambda x: struct.unpack("<I", struct.pack("<f", x))[0]
    cases = [0.0, -0.0, 1.5, -2.25, 1e-40, 3e38, math.inf, -math.inf, math.nan]
    rows = [(bits(x), bits(y)) for x in cases for y in cases]
    df = spark.createDataFrame(rows, "a long, b long")
    got = df.select("a", "b", floats.f32("add", F.col("a"), F.col("b")).alias("add"), floats.setp("lt", F.col("a"), F.col("b"), 32).alias("lt"), floats.setp("ltu", F.col("a"), F.col("b"), 32).alias("ltu"), floats.setp("eq", F.col("a"), F.col("b"), 32).alias("eq"), floats.saturated(F.col("a")).alias("sat"), floats.f32("rcp", F.col("a")).alias("rcp")).collect()
    un = lambda b: struct.unpack("<f", struct.pack("<I", b & 0xFFFFFFFF))[0]
    for r in got:
        x, y = un(r["a"]), un(r["b"])
        if math.isnan(x + y):
            assert r["add"] == floats.QUIET_NAN
        unordered = math.isnan(x) or math.isnan(y)
        assert r["lt"] == (x < y) and r["ltu"] == (x < y or unordered) and r["eq"] == (x == y)
        assert r["sat"] == (floats.QUIET_NAN if math.isnan(x) else bits(min(max(x, 0.0), 1.0)) if x > 0 else r["sat"])
        if x == bits(1e-40):
            assert math.isinf(un(r["rcp"]))


def test_cleaning(spark):
    df = spark.createDataFrame([(" 12 ",), ("0x1F",), ("0xFFFFFFFFFFFFFFFF",), ("3.9",), ("",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(C.tolerant_int(F.col("t"))).collect()] == [12, 31, -1, 3, None, None, None]
    df = spark.createDataFrame([("true",), ("2.5",), ("bad",)], "t string")
    assert [r[0] for r in df.select(C.tolerant_float(F.col("t"), 9.0)).collect()] == [1.0, 2.5, 9.0]
    df = spark.createDataFrame([(math.nan, math.nan), (math.inf, math.inf), (1.0, 1.0), (0.0, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(C.same_number(F.col("a"), F.col("b"))).collect()] == [False, True, True, False]
    assert C.allowed_runs(5000) == 5000
    with pytest.raises(ValueError):
        C.allowed_runs(7)
