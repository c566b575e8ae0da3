"""Backward liveness: which bits of registers and bytes reach a compared output.

Events of one group (a launch, or threads that share no memory) are visited in reverse
(cycle, index) order. Of each register and byte three masks are kept: observed (a flip changes
an output), due (a flip leads out of every valid range), trace (a flip changes the path).
A group's events are in one task at once; choose groups that share no memory.

Address flips ask what other bytes held (``history.with_history``, made for all events before): a load is
masked if the value there agrees on live bits, else it is due, observed or trace as the differing bits
are; unknown bytes are trace. A store is masked only if it is proven byte by byte: its own bytes held its value
before, as far as they live, and so did those that it would hit; else it is observed. Without a history a flip
inside the ranges is observed, and without ranges it is trace.

Derived rules, stated here because the weighting that turns masks into rates is our own:
a bit counts once, as due before sdc before unknown before masked.
"""

from __future__ import annotations

import math
import operator
import struct
from collections import defaultdict
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FULL = (1 << 64) - 1


def _ones(w: int) -> int:
    return (1 << w) - 1


def _signed(x: int, w: int) -> int:
    x &= _ones(w)
    return x - (1 << w) if x >> (w - 1) else x


def _float(x: int, w: int) -> float:
    kind, word = {16: ("<e", "<H"), 32: ("<f", "<I"), 64: ("<d", "<Q")}[w]
    return struct.unpack(kind, struct.pack(word, x & _ones(w)))[0]


def _f32_bits(x: float) -> int:
    """The pattern of a double rounded to 32 bits; one NaN."""
    if math.isnan(x):
        return 0x7FC00000
    try:
        return struct.unpack("<I", struct.pack("<f", x))[0]
    except OverflowError:
        return 0x7F800000 if x > 0 else 0xFF800000


def _setp(name: str, number: Callable[[int, int], float]) -> Callable[[list[int], int], int]:
    order = {"eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge}[name.removesuffix("u") if len(name) > 2 else name]

    def run(v: list[int], w: int) -> int:
        a, b = number(v[0], w), number(v[1], w)
        return int(order(a, b) or (len(name) > 2 and (a != a or b != b)))

    return run


def _field(v: list[int], w: int, signed: bool) -> int:
    """``v[2]`` bits from bit ``v[1]``; nothing past the width."""
    at, n = v[1] & 255, v[2] & 255
    if not n or at >= w:
        return 0
    n = min(n, w - at)
    x = (v[0] & _ones(w)) >> at & _ones(n)
    return _signed(x, n) if signed else x


def _lop3(v: list[int], w: int) -> int:
    a, b, c = v[:3]
    return sum((a if i & 1 else ~a) & (b if i & 2 else ~b) & (c if i & 4 else ~c) & _ones(w) for i in range(8) if v[3] >> i & 1)


#: Forward semantics by name: (source values, width) -> result before it is cut to the width.
FORWARD: dict[str, Callable[[list[int], int], int]] = {
    "mov": lambda v, w: v[0],
    "and": lambda v, w: v[0] & v[1],
    "or": lambda v, w: v[0] | v[1],
    "xor": lambda v, w: v[0] ^ v[1],
    "not": lambda v, w: ~v[0],
    "not.pred": lambda v, w: 1 - (v[0] & 1),
    "add": lambda v, w: v[0] + v[1],
    "sub": lambda v, w: v[0] - v[1],
    "neg": lambda v, w: -v[0],
    "mul": lambda v, w: v[0] * v[1],
    "mul.wide.u": lambda v, w: (v[0] & _ones(32)) * (v[1] & _ones(32)),
    "mul.wide.s": lambda v, w: _signed(v[0], 32) * _signed(v[1], 32),
    "mad": lambda v, w: v[0] * v[1] + v[2],
    "shl": lambda v, w: v[0] << (v[1] & (w - 1)),
    "shr": lambda v, w: (v[0] & _ones(w)) >> (v[1] & (w - 1)),
    "sar": lambda v, w: _signed(v[0], w) >> (v[1] & (w - 1)),
    "min": lambda v, w: min(v[0] & _ones(w), v[1] & _ones(w)),
    "max": lambda v, w: max(v[0] & _ones(w), v[1] & _ones(w)),
    "min.s": lambda v, w: min(_signed(v[0], w), _signed(v[1], w)),
    "max.s": lambda v, w: max(_signed(v[0], w), _signed(v[1], w)),
    "popc": lambda v, w: (v[0] & _ones(w)).bit_count(),
    "clz": lambda v, w: w - (v[0] & _ones(w)).bit_length(),
    "brev": lambda v, w: int(f"{v[0] & _ones(w):0{w}b}"[::-1], 2),
    "bfe": lambda v, w: _field(v, w, False),
    "bfe.s": lambda v, w: _field(v, w, True),
    "lop3": _lop3,
    "cvt.u": lambda v, w: v[0] & _ones(32),
    "cvt.s": lambda v, w: _signed(v[0], 32),
    "selp": lambda v, w: v[0] if v[2] & 1 else v[1],
    "add.f32": lambda v, w: _f32_bits(_float(v[0], 32) + _float(v[1], 32)),
    "sub.f32": lambda v, w: _f32_bits(_float(v[0], 32) - _float(v[1], 32)),
    "mul.f32": lambda v, w: _f32_bits(_float(v[0], 32) * _float(v[1], 32)),
    "abs.f32": lambda v, w: v[0] & 0x7FFFFFFF,
    "neg.f32": lambda v, w: (v[0] ^ 0x80000000) & _ones(32),
    **{f"setp.{c}": _setp(c, lambda x, w: x & _ones(w)) for c in ("eq", "ne")},
    **{f"setp.{c}.u": _setp(c, lambda x, w: x & _ones(w)) for c in ("lt", "le", "gt", "ge")},
    **{f"setp.{c}{k}": _setp(c, _signed) for c in ("lt", "le", "gt", "ge") for k in ("", ".s")},
    **{f"setp.{c}.f{n}": _setp(c, lambda x, w, n=n: _float(x, n)) for c in ("eq", "ne", "lt", "le", "gt", "ge", "ltu", "leu", "gtu", "geu") for n in (16, 32, 64)},
}


def influence(op: str, values: list[int], width: int, live: int, which: int, *more: int) -> int:
    """Bits of source ``which`` whose flip changes a live result bit: closed forms, else each bit is tried.

    ``more`` are other sources that hold the same register and flip with it.
    """
    live &= _ones(width)
    if not live:
        return 0
    if not more:
        other = values[1 - which] if len(values) > 1 and which < 2 else 0
        if op in ("mov", "not", "xor"):
            return live
        if op == "and":
            return live & other
        if op == "or":
            return live & ~other & _ones(width)
    run = FORWARD.get(op)
    if run is None:
        raise ValueError(f"no rule for the live operator {op}")
    base, out = run(values, width) & _ones(width), 0
    for bit in range(width):
        flipped = list(values)
        for k in (which, *more):
            flipped[k] ^= 1 << bit
        if (run(flipped, width) ^ base) & live:
            out |= 1 << bit
    return out


class State:
    """Live masks of registers (thread, name) and bytes (scope, address)."""

    def __init__(self) -> None:
        self.regs: dict = defaultdict(lambda: [0, 0, 0])
        self.bytes: dict = defaultdict(lambda: [0, 0, 0])

    def reg(self, thread: int, name: str, masks: list[int]) -> None:
        if name:
            self.regs[thread, name] = [a | b for a, b in zip(self.regs[thread, name], masks, strict=True)]


def _flipped_address(e: dict, bit: int, ranges: list[tuple[int, int]]) -> int | None:
    """The kind of an address flip: 1 (due) out of every range, 0 (observed) inside one; None if no range is known."""
    at = (e["addr"] ^ (1 << bit)) & FULL
    inside = any(lo <= at and at + e["size"] <= hi for lo, hi in ranges)
    return None if not ranges else 0 if inside else 1


def _first_kind(bits: int, masks: list[int]) -> int | None:
    """The kind of the live bits among ``bits``: due before observed before trace; None if none of them lives."""
    return next((k for k in (1, 0, 2) if bits & masks[k]), None)


def walk(events: list[dict], outputs: set[tuple[str, int]], ranges: list[tuple[int, int]] = (), address_bits: int = 32) -> list[dict]:
    """Records of live reads and sites, from events sorted by (cycle, index).

    event: thread, index, op, kind (inst, load, store, branch), width, dst, srcs (names), values,
    old (destination before), pred (name, value) or None, scope, addr, size, base (address source
    or None), taken changes (mask of predicate bits that turn the branch). With a history also
    outside, flips, before and fresh.
    """
    last = {}
    for e in events:
        if e["kind"] == "store" and e["held"]:
            for k in range(e["size"]):
                last[e["scope"], e["addr"] + k] = e["index"]
    state, out = State(), []

    def emit(e: dict, what: str, name: str, masks: list[int], width: int) -> None:
        if any(masks):
            out.append({"thread": e["thread"], "index": e["index"], "site": what, "name": name, "width": width, "observed": masks[0], "due": masks[1], "trace": masks[2]})

    def read(e: dict, i: int, masks: list[int]) -> None:
        state.reg(e["thread"], e["srcs"][i], masks)
        emit(e, "register", e["srcs"][i], masks, e["width"])

    def predicate(e: dict, masks: list[int]) -> None:
        if e["pred"] and any(masks):
            state.reg(e["thread"], e["pred"], masks)
            emit(e, "predicate", e["pred"], masks, 1)

    def unwritten(e: dict, key: tuple[str, int]) -> bool:
        """Whether an output byte has its final value before this event."""
        return key in outputs and last.get(key, -1) <= e["index"]

    def store_is_masked(e: dict, bit: int, differs: int, own: int) -> bool:
        to = (e["addr"] ^ (1 << bit)) & FULL
        if e["size"] > 8 or abs(to - e["addr"]) < e["size"] or (e["before"] | e["fresh"]) & own:
            return False
        for k in range(e["size"]):
            key = (e["scope"], to + k)
            masks = state.bytes.get(key, (0, 0, 0))
            alive = 255 if unwritten(e, key) else masks[0] | masks[1] | masks[2]
            if differs >> 8 * k & 255 & alive:
                return False
        return True

    def address(e: dict, live: list[int]) -> None:
        """live: of a load the masks of its value, of a store the masks of the bytes it writes."""
        if e["base"] is None:
            return
        masks = [0, 0, 0]
        if e.get("flips") is None:
            for bit in range(address_bits):
                kind = _flipped_address(e, bit, ranges)
                if kind == 1 or e["kind"] == "store" or any(live):
                    masks[2 if kind is None else kind] |= 1 << bit
        else:
            masks[1] |= e["outside"]
            for bit, known, differs in e["flips"]:
                if e["kind"] == "store":
                    kind = None if store_is_masked(e, bit, differs, live[0] | live[1] | live[2]) else 0
                else:
                    kind = _first_kind(differs, live) if known else 2 if any(live) else None
                if kind is not None:
                    masks[kind] |= 1 << bit
        read(e, e["base"], masks)

    for e in reversed(events):
        if e["kind"] == "branch":
            changed = [0, 0, e["turns"]]
            for i in range(len(e["srcs"])):
                read(e, i, changed)
            continue
        if e["kind"] == "store":
            live = [0, 0, 0]
            for k in range(e["size"]):
                key = (e["scope"], e["addr"] + k)
                masks = list(state.bytes.pop(key, (0, 0, 0))) if e["held"] else list(state.bytes.get(key, (0, 0, 0)))
                if key in outputs and last.get(key) == e["index"]:
                    masks[0] = 255
                elif not e["held"] and unwritten(e, key):
                    masks[0] = 255  # were it executed, it would be the last writer
                emit(e, "byte", f"{e['scope']}:{key[1]}", masks, 8)
                live = [a | (b << 8 * k) for a, b in zip(live, masks, strict=True)]
            if e["held"]:
                address(e, live)
                read(e, e["data"], live)
            if e.get("before") is None:
                predicate(e, [int(m != 0) for m in live])
                continue
            differs, fresh = e["before"] & ~e["fresh"], e["fresh"]
            turned = [int(differs & live[0] != 0), int(differs & live[1] != 0), int((differs & live[2] | fresh & (live[0] | live[1] | live[2])) != 0)]
            if not e["held"] and ranges and not any(lo <= e["addr"] and e["addr"] + e["size"] <= hi for lo, hi in ranges):
                turned[1] = 1
            predicate(e, turned)
            continue
        live = list(state.regs[e["thread"], e["dst"]]) if e["dst"] else [0, 0, 0]
        if not any(live):
            if e["kind"] == "load" and e["held"]:
                address(e, live)  # it may still leave every range
            continue  # its destination is not live: nothing else flows
        differs = (e["result"] ^ e["old"]) & _ones(e["width"])
        predicate(e, [int(m & differs != 0) for m in live])
        if not e["held"]:
            continue  # not executed: the destination stays live, no source does
        del state.regs[e["thread"], e["dst"]]
        if e["kind"] == "load":
            address(e, [m & _ones(8 * min(e["size"], 8)) for m in live])
            for k in range(min(e["size"], 8)):
                key = (e["scope"], e["addr"] + k)
                masks = [m >> 8 * k & 255 for m in live]
                state.bytes[key] = [a | b for a, b in zip(state.bytes[key], masks, strict=True)]
                emit(e, "byte", f"{e['scope']}:{key[1]}", masks, 8)
            continue
        places: dict[str, list[int]] = {}
        for i, name in enumerate(e["srcs"]):
            places.setdefault(name, []).append(i)
        for at in places.values():
            read(e, at[0], [influence(e["op"], e["values"], e["width"], m, *at) for m in live])
    return out


RECORD = "thread long, index long, site string, name string, width int, observed long, due long, trace long"


def _as_long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def live_records(events: DataFrame, group: str, outputs: list[tuple[str | None, int]], ranges: list[tuple[int, int]] = (), address_bits: int = 32) -> DataFrame:
    """``walk`` per group; rows: group, then ``RECORD``. Columns of ``events``: as in ``walk``, and cycle.

    An output whose scope is None is one of every scope that the group's events name.
    """
    kind = events.schema[group].dataType.simpleString()
    named, everywhere = {o for o in outputs if o[0] is not None}, [a for scope, a in outputs if scope is None]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["cycle", "index"], kind="stable").to_dict("records")
        for r in rows:
            r["srcs"], r["values"] = list(r["srcs"]), [int(v) & FULL for v in r["values"]]
            r["base"] = None if pd.isna(r["base"]) else int(r["base"])
            for k in ("addr", "size", "data", "result", "old", "turns", "width"):
                r[k] = 0 if pd.isna(r[k]) else int(r[k])
            r["pred"] = r["pred"] or None
            if "flips" in r:
                known = r["flips"] is not None and not isinstance(r["flips"], float)
                r["flips"] = [(f["bit"], f["known"], int(f["differs"]) & FULL) for f in r["flips"]] if known else None
                r["outside"] = 0 if pd.isna(r["outside"]) else int(r["outside"]) & FULL
                r["before"] = None if pd.isna(r["before"]) else int(r["before"]) & FULL
                r["fresh"] = 0 if pd.isna(r["fresh"]) else int(r["fresh"]) & FULL
        wanted = named | {(scope, a) for scope in pdf["scope"].unique() for a in everywhere}
        found = pd.DataFrame(walk(rows, wanted, list(ranges), address_bits), columns=["thread", "index", "site", "name", "width", "observed", "due", "trace"])
        for k in ("observed", "due", "trace"):
            found[k] = found[k].map(_as_long).astype("int64")
        found.insert(0, group, pdf[group].iloc[0])
        return found

    return events.groupBy(group).applyInPandas(run, f"{group} {kind}, {RECORD}")


def bit_rates(records: DataFrame, keys: list[str]) -> DataFrame:
    """Derived rule: of all bits read, how many count as due, sdc, unknown and masked."""
    due, sdc = F.col("due"), F.col("observed").bitwiseAND(F.bitwise_not(F.col("due")))
    unknown = F.col("trace").bitwiseAND(F.bitwise_not(F.col("due").bitwiseOR(F.col("observed"))))
    count: Callable[[Column], Column] = lambda m: F.sum(F.bit_count(m).cast("long"))
    out = records.groupBy(*keys).agg(F.sum(F.col("width").cast("long")).alias("bits"), count(due).alias("due"), count(sdc).alias("sdc"), count(unknown).alias("unknown"))
    return out.withColumn("masked", F.col("bits") - F.col("due") - F.col("sdc") - F.col("unknown"))
