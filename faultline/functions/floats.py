"""Floating-point operators on raw bit patterns, as Arrow-batched numpy functions.

Spark SQL has no bit casts, so values travel as ``LongType`` patterns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

QUIET_NAN = 0x7FFFFFFF


def as_f32(bits: np.ndarray) -> np.ndarray:
    return (bits & 0xFFFFFFFF).astype(np.uint32).view(np.float32)


def bits_f32(x: np.ndarray) -> np.ndarray:
    out = np.asarray(x, np.float32).view(np.uint32).astype(np.int64)
    return np.where(np.isnan(x), QUIET_NAN, out)


def flushed(x: np.ndarray) -> np.ndarray:
    """Subnormal values as zeros of their sign."""
    return np.where((np.abs(x) < np.finfo(np.float32).tiny) & (x != 0), np.copysign(np.float32(0), x), x).astype(np.float32)


BINARY = {"add": np.add, "sub": np.subtract, "mul": np.multiply, "div": np.divide, "min": np.fmin, "max": np.fmax}
UNARY = {"sqrt": np.sqrt, "abs": np.abs, "neg": np.negative, "ex2": lambda x: flushed(np.exp2(flushed(x))), "rcp": lambda x: flushed(np.float32(1) / flushed(x))}


def f32(op: str, a: Column, b: Column | None = None, c: Column | None = None) -> Column:
    """add, sub, mul, div, min, max, fma; sqrt, abs, neg, ex2, rcp (these two flush subnormals)."""

    @F.pandas_udf("long")
    def one(x: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            return pd.Series(bits_f32(UNARY[op](as_f32(x.to_numpy()))))

    @F.pandas_udf("long")
    def two(x: pd.Series, y: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            return pd.Series(bits_f32(BINARY[op](as_f32(x.to_numpy()), as_f32(y.to_numpy()))))

    @F.pandas_udf("long")
    def three(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):  # the product is exact in double
            wide = as_f32(x.to_numpy()).astype(np.float64) * as_f32(y.to_numpy()) + as_f32(z.to_numpy())
            return pd.Series(bits_f32(wide.astype(np.float32)))

    return one(a) if b is None else two(a, b) if c is None else three(a, b, c)


TESTS = {"eq": np.equal, "ne": np.not_equal, "lt": np.less, "le": np.less_equal, "gt": np.greater, "ge": np.greater_equal}


def setp(kind: str, a: Column, b: Column, width: int) -> Column:
    """IEEE comparison at 16, 32 or 64 bits; a name that ends in u (ltu, equ, ...) also holds for unordered values; num and nan test order."""
    as_ = {16: lambda x: (x & 0xFFFF).astype(np.uint16).view(np.float16), 32: as_f32, 64: lambda x: x.view(np.float64)}[width]

    @F.pandas_udf("boolean")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        p, q = as_(x.to_numpy(np.int64)), as_(y.to_numpy(np.int64))
        unordered = np.isnan(p) | np.isnan(q)
        if kind in ("num", "nan"):
            return pd.Series(unordered if kind == "nan" else ~unordered)
        base = kind[:-1] if kind.endswith("u") else kind
        held = TESTS[base](p, q) & ~unordered
        return pd.Series(held | unordered if kind.endswith("u") else held)

    return run(a, b)


def saturated(a: Column) -> Column:
    """Clamp to [0, 1]; NaN gives the quiet NaN pattern."""

    @F.pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        v = as_f32(x.to_numpy())
        return pd.Series(np.where(np.isnan(v), QUIET_NAN, bits_f32(np.clip(v, 0, 1))))

    return run(a)


def to_bits(value: Column, width: int = 32) -> Column:
    """The pattern of a double rounded to the width."""
    kind = {16: (np.float16, np.uint16), 32: (np.float32, np.uint32), 64: (np.float64, np.int64)}[width]

    @F.pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(x.to_numpy(np.float64).astype(kind[0]).view(kind[1]).astype(np.int64))

    return run(value)


def from_bits(bits: Column, width: int = 32) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        raw = x.to_numpy(np.int64)
        v = {16: lambda: (raw & 0xFFFF).astype(np.uint16).view(np.float16), 32: lambda: as_f32(raw), 64: lambda: raw.view(np.float64)}[width]()
        return pd.Series(v.astype(np.float64))

    return run(bits)
