"""Conversions of every pair of types against rational arithmetic."""

from __future__ import annotations

import random
import struct
from fractions import Fraction

import numpy as np
import pytest

from faultline.functions import convert as V

FORM = {"f16": ("<e", "<H", 10, -24), "f32": ("<f", "<I", 23, -149), "f64": ("<d", "<Q", 52, -1074)}
LARGEST = {"f16": Fraction(65504), "f32": (2 - Fraction(1, 2**23)) * 2**127, "f64": (2 - Fraction(1, 2**52)) * 2**1023}


def value(bits, kind):
    if kind in FORM:
        f, w, _, _ = FORM[kind]
        x = struct.unpack(f, struct.pack(w, bits))[0]
        return x if x != x or x in (float("inf"), float("-inf")) else (Fraction(x), bits >> (8 * struct.calcsize(w) - 1))
    w = int(kind[1:])
    return (Fraction(bits - (1 << w) if kind[0] == "s" and bits >> (w - 1) else bits), 0)


def rounded(x, mode):
    low = x.numerator // x.denominator
    if x == low or mode == "rm":
        return low
    if mode == "rz":
        return low if x > 0 else low + 1
    if mode == "rp":
        return low + 1
    return low if x - low < Fraction(1, 2) or (x - low == Fraction(1, 2) and low % 2 == 0) else low + 1


def expected(bits, source, target, mode, saturate):
    x = value(bits, source)
    if target in FORM:
        f, w, _, _ = FORM[target]
        pack = lambda y: struct.unpack(w, struct.pack(f, y))[0]
        if isinstance(x, float):
            if x != x:
                return 0 if saturate else {"f16": 0x7E00, "f32": 0x7FC00000, "f64": 0x7FF8000000000000}[target]
            return pack(min(max(x, 0.0), 1.0)) if saturate else pack(x)
        x, minus = x
        if x == 0:
            return pack(0.0 if saturate or not minus else -0.0)
        least, frac = FORM[target][3], FORM[target][2]
        e = 0
        while abs(x) >= Fraction(2) ** (e + 1):
            e += 1
        while abs(x) < Fraction(2) ** e:
            e -= 1
        unit = Fraction(2) ** max(e - frac, least)
        y = rounded(x / unit, mode) * unit
        if abs(y) > LARGEST[target]:
            y = float("inf") if mode in ("rn", "rp") and x > 0 else float("-inf") if mode in ("rn", "rm") and x < 0 else (1 if x > 0 else -1) * LARGEST[target]
        if saturate:
            return pack(float(min(max(y, 0), 1)))
        return pack(float(y)) if y else pack(0.0 if x > 0 else -0.0)
    w = int(target[1:])
    low, high = (-(1 << (w - 1)), (1 << (w - 1)) - 1) if target[0] == "s" else (0, (1 << w) - 1)
    if isinstance(x, float):
        y = 0 if x != x else high if x > 0 else low
    elif source in FORM:
        y = 0 if source == "f32" and abs(x[0]) < Fraction(2) ** -126 else min(max(rounded(x[0], mode), low), high)
    else:
        y = int(x[0])
        y = min(max(y, low), high) if saturate else y
    return y & ((1 << w) - 1)


def patterns(rng, kind):
    w = int(kind[1:])
    some = {0, 1, 2, 3, (1 << w) - 1, 1 << (w - 1), (1 << (w - 1)) - 1, (1 << (w - 1)) + 1, *(rng.getrandbits(w) for _ in range(30)), *(1 << k for k in range(w)), *((1 << k) - 1 for k in range(w)), *((3 << k) + 1 & ((1 << w) - 1) for k in range(w))}
    if kind in FORM:
        f, word, _, _ = FORM[kind]
        near = [0.5, 1.5, 2.5, -0.5, -1.5, 127.5, 128.5, -128.5, 255.5, 32767.5, 65503.0, 65519.0, 65520.0, 1e-7, 6e-8, 2.0**31, 2.0**32, 2.0**63, 2.0**64, -(2.0**63), 1.0, 0.25, 3.1]
        for x in near:
            if abs(x) < (65504 if kind == "f16" else 3e38):
                some.add(struct.unpack(word, struct.pack(f, x))[0])
        inf = struct.unpack(word, struct.pack(f, float("inf")))[0]
        some |= {inf, inf + 1, inf - 1, inf | 1 << (w - 1), 1 << (w - 1) | 1}
    return sorted(some)


@pytest.mark.parametrize("source", [*V.INTEGERS, *V.FLOATS])
def test_every_pair(source):
    rng = random.Random(source)
    bits = patterns(rng, source)
    for target in (*V.INTEGERS, *V.FLOATS):
        for mode in V.MODES:
            for saturate in (False, True):
                got = V.converted(np.array(bits, np.uint64), source, target, mode, saturate).tolist()
                for b, g in zip(bits, got, strict=True):
                    assert g == expected(b, source, target, mode, saturate), (hex(b), source, target, mode, saturate)


def test_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, None if i == 2 else -i) for i in range(5)], "i long, v long").repartition(2)
    got = {r.i: r.x for r in df.select("i", V.convert(F.col("v"), "s64", "f32", "rz").alias("x")).collect()}
    assert got == {i: None if i == 2 else struct.unpack("<I", struct.pack("<f", -float(i) if i else 0.0))[0] for i in range(5)}
    with pytest.raises(ValueError):
        V.convert(F.col("v"), "s64", "f128")
    with pytest.raises(ValueError):
        V.convert(F.col("v"), "s64", "f32", "up")
