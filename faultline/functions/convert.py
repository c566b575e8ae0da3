"""Conversions between integers and floats of any width on bit patterns, with directed rounding and saturation.

Types: u8 to u64, s8 to s64, f16, f32, f64; a pattern is a long, the upper bits of narrower types are 0. Rounding:
rn to nearest (ties to even), rz toward zero, rm down, rp up.

* integer to integer: cut to the width, or clamped to the type's range if saturated;
* float to integer: rounded to a whole number and always clamped; NaN is 0, and so is a subnormal f32, whatever the rounding;
* integer to float and float to float: rounded to the precision, exactly, too large values going to infinity or to the
  largest number as the rounding says; one NaN per width; saturated results lie in [0, 1], NaN becoming 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("rn", "rz", "rm", "rp")
FLOATS = {"f16": (np.float16, np.uint16, 11), "f32": (np.float32, np.uint32, 24), "f64": (np.float64, np.uint64, 53)}
INTEGERS = tuple(f"{k}{w}" for k in "us" for w in (8, 16, 32, 64))


def _check(kind: str) -> None:
    if kind not in FLOATS and kind not in INTEGERS:
        raise ValueError(f"no type {kind}")


def _floats(bits: np.ndarray, kind: str) -> np.ndarray:
    """Patterns as float64, which holds all narrower floats."""
    form, word, _ = FLOATS[kind]
    return bits.astype(word).view(form).astype(np.float64)


def _split(bits: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(negative, magnitude as uint64) of integer patterns."""
    w = int(kind[1:])
    x = bits.astype(np.uint64) & np.uint64((1 << w) - 1)
    minus = (x >> np.uint64(w - 1)).astype(bool) if kind[0] == "s" else np.zeros(len(x), bool)
    with np.errstate(over="ignore"):
        return minus, np.where(minus, (np.uint64(0) - x) & np.uint64((1 << w) - 1), x)


def _up(minus: np.ndarray, rest: np.ndarray, half: np.ndarray, odd: np.ndarray, mode: str) -> np.ndarray:
    """Whether a magnitude is rounded up: ``rest`` is what is cut off, ``half`` half of its last kept unit (0: nothing is cut off)."""
    if mode == "rn":
        return (rest > half) | ((rest == half) & (half > 0) & odd)
    return (rest > 0) & {"rz": np.zeros(len(rest), bool), "rm": minus, "rp": ~minus}[mode]


def _to_float(minus: np.ndarray, size: np.ndarray, kind: str, mode: str) -> np.ndarray:
    """Integers rounded to a float type, as float64 values that the type holds, or infinity."""
    keep = FLOATS[kind][2]
    length = np.zeros(len(size), np.int64)
    x = size.copy()
    for k in (32, 16, 8, 4, 2, 1):
        more = x >= np.uint64(1 << k)
        length[more] += k
        x[more] >>= np.uint64(k)
    length += x.astype(np.int64)  # bits of the magnitude
    cut = np.maximum(length - keep, 0).astype(np.uint64)
    q, one = size >> cut, np.uint64(1)
    rest = size - (q << cut)
    half = np.where(cut > 0, one << np.maximum(cut, one) - one, np.uint64(0))
    q = q + _up(minus, rest, half, (q & one).astype(bool), mode)
    return _narrowed(np.ldexp(q.astype(np.float64), cut.astype(np.int64)) * np.where(minus, -1.0, 1.0), kind, mode)


def _narrowed(x: np.ndarray, kind: str, mode: str) -> np.ndarray:
    """float64 values rounded to a float type."""
    form = FLOATS[kind][0]
    with np.errstate(over="ignore", invalid="ignore"):
        near = x.astype(form)
        back = near.astype(np.float64)
        low, high = np.nextafter(near, form(-np.inf)), np.nextafter(near, form(np.inf))
        if mode == "rm":
            near = np.where(back > x, low, near)
        elif mode == "rp":
            near = np.where(back < x, high, near)
        elif mode == "rz":
            near = np.where(np.abs(back) > np.abs(x), np.where(x > 0, low, high), near)
    return near


def _pattern(x: np.ndarray, kind: str, saturate: bool) -> np.ndarray:
    form, word, _ = FLOATS[kind]
    if saturate:
        x = np.where(np.isnan(x), 0.0, np.clip(x, 0.0, 1.0)).astype(form) + form(0)
    nan = {"f16": 0x7E00, "f32": 0x7FC00000, "f64": 0x7FF8000000000000}[kind]
    return np.where(np.isnan(x), np.uint64(nan), np.ascontiguousarray(x, form).view(word).astype(np.uint64))


def _to_integer(x: np.ndarray, kind: str, mode: str, flushed: np.ndarray) -> np.ndarray:
    w, signed = int(kind[1:]), kind[0] == "s"
    whole = {"rn": np.rint, "rz": np.trunc, "rm": np.floor, "rp": np.ceil}[mode](np.where(np.isnan(x) | flushed, 0.0, x))
    top, bottom = (1 << (w - signed)) - 1, -(1 << (w - 1)) if signed else 0
    size = np.abs(np.clip(whole, float(bottom), 2.0 ** (w - signed)))
    out = np.where(size >= 2.0**63, np.uint64(1 << 63), np.uint64(0)) + np.where(size >= 2.0**63, size - 2.0**63, size).clip(0, 2.0**63 - 1024).astype(np.uint64)
    out = np.where(whole >= 2.0 ** (w - signed), np.uint64(top), out)
    with np.errstate(over="ignore"):
        return np.where(whole < 0, np.uint64(0) - out, out) & np.uint64((1 << w) - 1)


def converted(bits: np.ndarray, source: str, target: str, mode: str = "rn", saturate: bool = False) -> np.ndarray:
    """Patterns (uint64) of ``target`` from patterns of ``source``."""
    if source in FLOATS:
        x = _floats(bits, source)
        if target in FLOATS:
            return _pattern(_narrowed(x, target, mode), target, saturate)
        return _to_integer(x, target, mode, (np.abs(x) < 2.0**-126) if source == "f32" else np.zeros(len(x), bool))
    minus, size = _split(bits, source)
    if target in FLOATS:
        return _pattern(_to_float(minus, size, target, mode), target, saturate)
    w, signed = int(target[1:]), target[0] == "s"
    if saturate:
        size = np.where(minus, np.minimum(size, np.uint64(1 << (w - 1) if signed else 0)), np.minimum(size, np.uint64((1 << (w - signed)) - 1)))
    with np.errstate(over="ignore"):
        return np.where(minus, np.uint64(0) - size, size) & np.uint64((1 << w) - 1)


def convert(bits: Column, source: str, target: str, mode: str = "rn", saturate: bool = False) -> Column:
    """A column of patterns converted, in Arrow batches; null stays null."""
    _check(source), _check(target)
    if mode not in MODES:
        raise ValueError(f"no rounding {mode}")

    @F.pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        known = x.notna().to_numpy()
        out = converted(x[known].to_numpy(np.int64).view(np.uint64), source, target, mode, saturate).view(np.int64)
        found = pd.Series(pd.array([None] * len(x), "Int64"), index=x.index)
        found[known] = out
        return found

    return run(bits)
