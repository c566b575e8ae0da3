"""Address expressions: an operator over chosen source values plus an offset, and which source bits move the address.

An expression is a struct ``{op, sources, width, offset}``; values and their widths are arrays by source
number. ``address`` evaluates it, ``influence`` gives per source the bits whose flip changes the address under
a mask. Both are Arrow functions: numpy over the rows of a batch, operator by operator, on 64-bit patterns.
Sums need no trial: a flip adds or takes 2^b, which changes bit b and the bits that the carry or the
borrow runs through, ones or zeros of the sum; the runs that reach the mask are found for all b at
once by doubling steps. Bitwise operators, moves, selections, shifted values, minima and maxima are closed forms, too.
Factors are tried bit by bit, by adding the other factor times 2^b, and the few bits of a shift amount by evaluation.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .compare import ones

#: Operators by how many sources they take; ADDR_SUM takes any number.
ARITY = {"IDENTITY": 1, "NOT": 1, "NEG": 1, "ADD": 2, "SUB": 2, "MUL_LO": 2, "AND": 2, "OR": 2, "XOR": 2, "SHL": 2, "SHR_U": 2, "SHR_S": 2, "MIN_U": 2, "MAX_U": 2, "MAD": 3, "SELP": 3}


OPERATORS = ["ADDR_SUM", *ARITY]
_U, _ALL = np.uint64, np.uint64(0xFFFFFFFFFFFFFFFF)


class _Rows:
    """Expressions and values of a batch: values cut to the width, one by one (``own``) and the first three of each row."""

    def __init__(self, expr: pa.StructArray, values: pa.ListArray) -> None:
        field = {f.name: x for f, x in zip(expr.type, expr.flatten(), strict=True)}
        self.op = np.asarray(pc.fill_null(pc.index_in(field["op"], value_set=pa.array(OPERATORS)), -1))
        width = field["width"]
        self.width = np.clip(np.asarray(pc.fill_null(width, 0)).astype(np.int64), 0, 64)
        self.every = np.where(self.width > 0, _ALL >> (64 - np.maximum(self.width, 1)).astype(_U), _U(0))
        self.offset = _patterns(field["offset"]) & self.every
        sources, begin, self.count = _lists(field["sources"])
        known, first, size = _lists(values)
        self.row = np.repeat(np.arange(len(self.count)), self.count)
        self.place = np.arange(len(self.row)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        at = begin[self.row] + self.place
        self.number = np.asarray(pc.fill_null(sources, -1)).astype(np.int64)[at]
        inside = (self.number >= 0) & (self.number < size[self.row])
        where = np.where(inside, first[self.row] + self.number, 0)
        there = np.append(np.asarray(known.is_valid()), False)[np.where(inside, where, -1)]
        self.own = np.where(there, np.append(_patterns(known), _U(0))[np.where(inside, where, -1)], _U(0)) & self.every[self.row]
        self.v = np.zeros((max(3, int(self.count.max(initial=0))), len(self.count)), _U)
        self.v[self.place, self.row] = self.own
        arity = np.array([-1, *ARITY.values()])[self.op]
        self.ok = (self.op >= 0) & np.asarray(width.is_valid()) & np.asarray(field["sources"].is_valid()) & ((self.op == 0) | (self.count == arity))
        self.ok[self.row[~there]] = False

    def of(self, name: str) -> np.ndarray:
        return np.flatnonzero(self.ok & (self.op == OPERATORS.index(name)))

    def address(self) -> np.ndarray:
        out = np.zeros(len(self.op), _U)
        for name in OPERATORS:
            at = self.of(name)
            if len(at):
                out[at] = _result(name, self.v[:, at], self.width[at], self.offset[at]) & self.every[at]
        return out


def _patterns(x: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(x, 0)).astype(np.int64).view(_U)


def _lists(x: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(all elements, where each row begins, how many it has: none if it is null)."""
    edge = np.asarray(x.offsets).astype(np.int64)
    return x.values, edge[:-1], np.where(np.asarray(x.is_valid()), np.diff(edge), 0)


def _amount(v: np.ndarray, width: np.ndarray) -> np.ndarray:
    return v & (np.maximum(width, 1) - 1).astype(_U)


def _result(name: str, v: np.ndarray, width: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """The raw result of an operator over values that are cut to the width, by place and row."""
    a, b, c = v[:3]
    if name in ("SHL", "SHR_U", "SHR_S"):
        n = _amount(b, width)
        if name == "SHR_S":
            by = ((64 - width) % 64).astype(_U)
            return ((a << by).view(np.int64) >> by.view(np.int64) >> n.view(np.int64)).view(_U)
        return a << n if name == "SHL" else a >> n
    return {
        "ADDR_SUM": lambda: v.sum(0, dtype=_U) + offset, "IDENTITY": lambda: a + offset, "NOT": lambda: ~a, "NEG": lambda: _U(0) - a, "ADD": lambda: a + b, "SUB": lambda: a - b, "MUL_LO": lambda: a * b, "MAD": lambda: a * b + c,
        "AND": lambda: a & b, "OR": lambda: a | b, "XOR": lambda: a ^ b, "MIN_U": lambda: np.minimum(a, b), "MAX_U": lambda: np.maximum(a, b), "SELP": lambda: np.where(c & _U(1) != 0, a, b),
    }[name]()


def _address(expr: pa.Array, values: pa.Array) -> pa.Array:
    rows = _Rows(expr, values)
    return pa.array(rows.address().view(np.int64), mask=~rows.ok)


def address(expr: Column, values: Column) -> Column:
    """The address of an expression over source values, cut to its width; null for other operators or a wrong number of sources.

    The offset is added for IDENTITY and ADDR_SUM alone.
    """
    return F.arrow_udf(_address, "long")(expr, values)


def effective_mask(space: Column, mask: Column, bits: Column, width: Column) -> Column:
    """The address bits that memory sees: a given mask, else a given number of bits, else 32 of the shared, local and global spaces, else the width."""
    known = F.lower(F.trim(space)).isin("global", "local", "shared")
    return F.coalesce(mask, F.when(bits > 0, ones(bits)), F.when(known, ones(F.least(width, F.lit(32)))), ones(width))


def _reaching(total: np.ndarray, live: np.ndarray, through_ones: bool) -> np.ndarray:
    """Bits from which a carry (a borrow) that starts there changes a live bit of the sum."""
    got, run = live, total if through_ones else ~total
    for k in (1, 2, 4, 8, 16, 32):
        got = got | ((got >> _U(k)) & run)
        run = run & (run >> _U(k))
    return got


def _by_sum(value: np.ndarray, total: np.ndarray, live: np.ndarray, falls: bool = False) -> np.ndarray:
    """Bits of a summand whose flip changes a live bit; ``falls``: the summand is taken away."""
    up, down = _reaching(total, live, not falls), _reaching(total, live, falls)
    return (~value & up) | (value & down)


def _flips_below(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits k for which a with bit k flipped is below b, as ``compare.flips_below``."""
    gap = a ^ b
    smear = gap
    for k in (1, 2, 4, 8, 16, 32):
        smear = smear | (smear >> _U(k))
    low = smear >> _U(1)
    out = (~smear & a) | np.where((a & low) < (b & low), smear ^ low, _U(0)) | np.where(a < b, low, _U(0))
    return np.where(gap == 0, a, out)


def _of_order(own: np.ndarray, other: np.ndarray, every: np.ndarray, seen: np.ndarray, less_wins: bool) -> np.ndarray:
    """Of the smaller (greater) of two: by the flips after which this source is it."""
    wins, apart = _flips_below(own, other), own ^ other
    if not less_wins:
        wins = every & ~(wins | np.where(apart & (apart - _U(1)) == 0, apart, _U(0)))
    gap = apart & seen
    alone = np.where(gap == 0, seen, np.where(gap & (gap - _U(1)) == 0, ~gap, _ALL))
    now = own < other if less_wins else other < own
    return np.where(now, (wins & seen) | np.where(gap != 0, ~wins, _U(0)), wins & alone)


def _tried(bits: int, base: np.ndarray, seen: np.ndarray, changed: Callable[[np.uint64], np.ndarray]) -> np.ndarray:
    """Bits below ``bits`` whose flip gives another value under the mask."""
    out = np.zeros(len(base), _U)
    for b in range(bits):
        out |= np.where((changed(_U(b)) ^ base) & seen != 0, _U(1) << _U(b), _U(0))
    return out


def _moving(name: str, place: int, v: np.ndarray, width: np.ndarray, every: np.ndarray, base: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Bits of the source in a place whose flip changes a bit of ``seen``, for rows of one operator."""
    own, other = v[place], v[max(1 - place, 0)]
    if name in ("ADDR_SUM", "IDENTITY", "ADD") or (name, place) in (("SUB", 0), ("MAD", 2)):
        return _by_sum(own, base, seen)
    if name in ("SUB", "NEG"):
        return _by_sum(own, base, seen, falls=True)
    if name in ("XOR", "NOT"):
        return seen
    if name in ("AND", "OR"):
        return seen & (other if name == "AND" else ~other)
    if name == "SELP":
        if place < 2:
            return np.where((v[2] & _U(1) != 0) == (place == 0), seen, _U(0))
        return np.where((v[0] ^ v[1]) & seen != 0, _U(1), _U(0))
    if name in ("MIN_U", "MAX_U"):
        return _of_order(own, other, every, seen, name == "MIN_U")
    if name in ("MUL_LO", "MAD"):  # a product changes by the other factor times 2^b
        return _tried(int(width.max()), base, seen, lambda b: np.where(own >> b & _U(1) != 0, base - (other << b), base + (other << b)) & every)
    amount = _amount(v[1], width)
    if place == 1:
        return _tried(6, base, seen, lambda b: _result(name, np.stack([v[0], (own ^ (_U(1) << b)) & every, v[2]]), width, base) & every)
    if name == "SHL":
        return seen >> amount
    back, sign = (seen << amount) & every, every ^ (every >> _U(1))
    if name == "SHR_U":
        return back
    top = (np.maximum(width, 1) - 1).astype(_U) - amount
    return (back & ~sign) | np.where(seen >> top != 0, sign, _U(0))


def _influence(expr: pa.Array, values: pa.Array, widths: pa.Array, live: pa.Array) -> pa.Array:
    rows = _Rows(expr, values)
    base, seen = rows.address(), _patterns(live) & rows.every
    moved = np.zeros(rows.v.shape, _U)
    for name in OPERATORS:
        at = rows.of(name)
        for place in range(int(rows.count[at].max(initial=0))):
            here = at[rows.count[at] > place]
            moved[place, here] = _moving(name, place, rows.v[:, here], rows.width[here], rows.every[here], base[here], seen[here])
    wide, first, size = _lists(widths)
    inside = (rows.number >= 0) & (rows.number < size[rows.row])
    bits = np.append(np.asarray(pc.fill_null(wide, 64)).astype(np.int64), 64)[np.where(inside, first[rows.row] + rows.number, -1)]
    own = np.where(bits > 0, _ALL >> (64 - np.clip(bits, 1, 64)).astype(_U), _U(0)) & rows.every[rows.row]
    kept = rows.ok[rows.row]
    mask = pa.array((moved[rows.place, rows.row] & own)[kept].view(np.int64), mask=~np.asarray(live.is_valid())[rows.row][kept])
    found = pa.StructArray.from_arrays([pa.array(rows.number[kept].astype(np.int32)), mask], ["source", "mask"])
    edge = np.concatenate([[0], np.cumsum(np.where(rows.ok, rows.count, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edge, mask=np.append(~rows.ok, False)), found)


def influence(expr: Column, values: Column, widths: Column, live: Column) -> Column:
    """An array of {source, mask}: per source of the expression the bits whose flip changes the address under ``live``.

    A source that stands twice is flipped in one place at a time. Null where ``address`` is; masks are null where ``live`` is.
    """
    return F.arrow_udf(_influence, "array<struct<source:int,mask:long>>")(expr, values, widths, live)
