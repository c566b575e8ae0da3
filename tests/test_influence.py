"""Flips of single bits against trying them: comparisons, addresses, branches, memory; and the joins beneath."""

from __future__ import annotations

import math
import random
import struct
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from faultline.functions import addresses, compare, opcodes
from faultline.operators import history, intervals, liveness, taint

FULL = (1 << 64) - 1


def signed64(x):
    x &= FULL
    return x - (1 << 64) if x >> 63 else x


def number(x, kind, w):
    x &= (1 << w) - 1
    if kind == "s":
        return x - (1 << w) if x >> (w - 1) else x
    if kind == "f":
        return struct.unpack({16: "<e", 32: "<f", 64: "<d"}[w], struct.pack({16: "<H", 32: "<I", 64: "<Q"}[w], x))[0]
    return x


def compared(c, a, b):
    if c in ("ltu", "leu", "gtu", "geu"):
        if math.isnan(a) or math.isnan(b):
            return True
        c = c[:2]
    return {"eq": a == b, "ne": a != b, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[c]


def toggled(c, kind, w, a, b):
    now = compared(c, number(a, kind, w), number(b, kind, w))
    flip = lambda x, k: x ^ (1 << k)
    left = sum(1 << k for k in range(w) if compared(c, number(flip(a, k), kind, w), number(b, kind, w)) != now)
    right = sum(1 << k for k in range(w) if compared(c, number(a, kind, w), number(flip(b, k), kind, w)) != now)
    return now, left, right


def patterns(rng, kind, w):
    """Pairs that are equal, one bit apart, random, and at the edges of floats."""
    some = [rng.getrandbits(w) for _ in range(6)] + [0, 1, (1 << w) - 1, 1 << (w - 1), (1 << (w - 1)) - 1]
    if kind == "f":
        inf = {16: 0x7C00, 32: 0x7F800000, 64: 0x7FF0000000000000}[w]
        some += [inf, inf + 1, inf - 1, inf | 1 << (w - 1), (inf + 1) | 1 << (w - 1), 1 << (w - 1), (1 << (w - 1)) | 1, inf >> 1]
    return [(a, b) for a in some for b in [a, a ^ (1 << rng.randrange(w)), rng.choice(some), rng.choice(some), rng.getrandbits(w)]]


def test_toggles_of_every_comparison(spark):
    rng = random.Random(11)
    shapes = [(c, k, w) for k in "us" for w in (8, 16, 32, 64) for c in compare.COMPARATORS[:6]] + [(c, "f", w) for w in (16, 32, 64) for c in compare.COMPARATORS]
    rows = [(c, k, w, signed64(a), signed64(b)) for c, k, w in shapes for a, b in patterns(rng, k, w)]
    df = spark.createDataFrame(rows, "c string, k string, w int, a long, b long")
    left, right = compare.toggles(F.col("c"), F.col("k"), F.col("w"), F.col("a"), F.col("b"))
    got = df.select("*", compare.holds(F.col("c"), F.col("k"), F.col("w"), F.col("a"), F.col("b")).alias("now"), left.alias("left"), right.alias("right")).collect()
    assert len(got) == len(rows)
    for r in got:
        now, l_, r_ = toggled(r.c, r.k, r.w, r.a & FULL, r.b & FULL)
        assert (r.now, r.left & FULL, r.right & FULL) == (now, l_, r_), r


def test_shapes_of_setp_text(spark):
    rows = [("setp.lt.s32 %p1, %r1", [32, 32]), ("SETP.GEU.F64", None), ("setp.eq", [16, 8]), ("setp.ne", None), ("setp.lt.b16;", [64, 64]), ("setp.foo.s32", [32]), ("add.s32", [32]), ("setp.le.and.u64", [32, 32])]
    df = spark.createDataFrame(rows, "op string, w array<int>")
    got = [tuple(r[0]) if r[0] else None for r in df.select(compare.setp_shape(F.col("op"), F.col("w"))).collect()]
    assert got == [("lt", "s", 32), ("geu", "f", 64), ("eq", "u", 16), ("ne", "u", 32), ("lt", "u", 16), None, None, ("le", "u", 64)]


def test_operators_of_names_with_underscores(spark):
    texts = {"add_u32": "ADD", "mov_b32": "IDENTITY", "setp_lt_s32": "SETP_LT_U", "setp_lt_s": "SETP_LT_S", "shr_s": "SHR_S", "setp_geu_f16": "SETP_GEU_F16", "add_f32": "ADD_F32", "addr_sum": "ADDR_SUM", "mul_lo": "MUL_LO", "mul_lo_u32": "MUL_LO_U32", "foo_bar": "FOO_BAR", "and_b32": "AND"}
    df = spark.createDataFrame([(k,) for k in texts], "t string")
    assert {r.t: r.o for r in df.select("t", opcodes.operator(F.col("t")).alias("o")).collect()} == texts


def addressed(op, v, w, offset):
    one = (1 << w) - 1
    sign = lambda x: x - (1 << w) if x >> (w - 1) else x
    v = [x & one for x in v]
    n = (v[1] & (w - 1)) if len(v) > 1 else 0
    out = {
        "IDENTITY": lambda: v[0] + offset, "ADDR_SUM": lambda: sum(v) + offset, "NOT": lambda: ~v[0], "NEG": lambda: -v[0], "ADD": lambda: v[0] + v[1], "SUB": lambda: v[0] - v[1], "MUL_LO": lambda: v[0] * v[1], "MAD": lambda: v[0] * v[1] + v[2],
        "AND": lambda: v[0] & v[1], "OR": lambda: v[0] | v[1], "XOR": lambda: v[0] ^ v[1], "SHL": lambda: v[0] << n, "SHR_U": lambda: v[0] >> n, "SHR_S": lambda: sign(v[0]) >> n, "MIN_U": lambda: min(v[:2]), "MAX_U": lambda: max(v[:2]), "SELP": lambda: v[0] if v[2] & 1 else v[1],
    }[op]()
    return out & one


def test_addresses_and_their_influence(spark):
    rng = random.Random(3)
    rows, want = [], []
    for op in [*addresses.ARITY, "ADDR_SUM"]:
        for w in (8, 16, 32, 64):
            for _ in range(6):
                values = [rng.choice([rng.getrandbits(w), rng.getrandbits(4), (1 << w) - 1 - rng.getrandbits(3), 0]) for _ in range(4)]
                src = rng.sample(range(4), addresses.ARITY.get(op, 3))
                offset, widths, live = rng.getrandbits(12), [rng.choice([w, w // 2]) for _ in range(4)], rng.choice([(1 << w) - 1, rng.getrandbits(w), 1 << rng.randrange(w)])
                rows.append((len(rows), (op, src, w, offset), [signed64(v) for v in values], widths, signed64(live)))
                base = addressed(op, [values[i] for i in src], w, offset)
                flips = [sum(1 << b for b in range(min(w, widths[i])) if (addressed(op, [values[j] ^ (1 << b) if j == i else values[j] for j in src], w, offset) ^ base) & live) for i in src]
                want.append((base, list(zip(src, flips, strict=True))))
    df = spark.createDataFrame(rows, "i long, e struct<op:string,sources:array<int>,width:int,offset:long>, v array<long>, w array<int>, live long")
    for r in df.select("i", "e", addresses.address(F.col("e"), F.col("v")).alias("a"), addresses.influence(F.col("e"), F.col("v"), F.col("w"), F.col("live")).alias("m")).collect():
        assert (r.a & FULL, [(x.source, x.mask & FULL) for x in r.m]) == want[r.i], (r.e, rows[r.i])
    odd = spark.createDataFrame([(("STRANGE", [0], 32, 0),), (("ADD", [0], 32, 0),), (("IDENTITY", [9], 32, 0),), (("ADDR_SUM", [], 32, 7),)], "e struct<op:string,sources:array<int>,width:int,offset:long>")
    one = F.array(F.lit(5).cast("long"))
    assert [r[0] for r in odd.select(addresses.address(F.col("e"), one)).collect()] == [None, None, None, 7]
    seen = spark.createDataFrame([("global", None, None, 64), ("const", None, None, 64), ("local", None, 12, 64), ("shared", 255, 12, 64)], "s string, m long, b int, w int")
    assert [r[0] for r in seen.select(addresses.effective_mask(F.col("s"), F.col("m"), F.col("b"), F.col("w"))).collect()] == [2**32 - 1, -1, 4095, 255]


EVENTS = "thread long, index long, kind string, opcode string, dst string, srcs array<string>, values array<long>, widths array<int>, taken boolean"


def program(rng, thread, n, ops):
    """A thread that runs: predicates hold what was written, registers change at random."""
    preds, rows = {f"%p{i}": rng.getrandbits(1) for i in range(4)}, []
    for i in range(n):
        op = rng.choice(ops)
        p = lambda: rng.choice(list(preds))
        dst, srcs, values = None, [], []
        if op == "bra":
            srcs = [p()]
        elif op.startswith("setp"):
            dst, srcs = p(), [f"%r{rng.randrange(4)}", f"%r{rng.randrange(4)}"]
            a = rng.getrandbits(32)
            values = [a, rng.choice([a, a ^ (1 << rng.randrange(32)), rng.getrandbits(32)])]
        else:
            dst, srcs = p(), [p() for _ in range({"not.pred": 1, "selp.b32": 3}.get(op, 2))]
        values = values or [preds[s] for s in srcs]
        if dst:
            preds[dst] = effect(op, values)
        rows.append((thread, i, "branch" if op == "bra" else "inst", op, dst, srcs, values, [1 if s[1] == "p" else 32 for s in srcs], bool(values[0]) if op == "bra" else None))
    return rows


def effect(op, v):
    if op.startswith("setp"):
        _, c, kind = op.split(".")
        return int(compared(c, number(v[0], kind[0], int(kind[1:])), number(v[1], kind[0], int(kind[1:]))))
    return {"and.pred": lambda: v[0] & v[1], "or.pred": lambda: v[0] | v[1], "not.pred": lambda: 1 - v[0], "selp.b32": lambda: v[0] if v[2] else v[1], "xor.pred": lambda: v[0] ^ v[1]}[op]()


def walked_back(rows):
    """Taint by one pass backward over each thread, its state being the branches that each predicate decides."""
    out, stuck = set(), set()
    for thread in {r[0] for r in rows}:
        need = defaultdict(set)
        for _, i, kind, op, dst, srcs, values, _, taken in reversed([r for r in rows if r[0] == thread]):
            if kind == "branch":
                need[srcs[0]].add((i, not taken))
                continue
            wanted = need.pop(dst, set())
            if not wanted:
                continue
            if op.startswith("setp"):
                _, c, kind = op.split(".")
                masks = toggled(c, kind[0], int(kind[1:]), *values)[1:]
            elif op == "selp.b32":
                masks = [int(values[2] == 1), int(values[2] == 0), int(values[0] != values[1])]
            elif op == "xor.pred":
                stuck |= {(thread, b, i) for b, _ in wanted}
                continue
            else:
                masks = [1] * len(srcs)
            for s, (name, mask) in enumerate(zip(srcs, masks, strict=True)):
                if mask:
                    out |= {(thread, b, d, i, s, name, mask) for b, d in wanted}
                    if name.startswith("%p"):
                        need[name] |= wanted
    return out, stuck


OPS = ["setp.lt.s32", "setp.ge.u32", "setp.eq.b32", "setp.gtu.f32", "bra", "bra"]


def test_control_taint_of_every_thread(spark):
    rng = random.Random(8)
    rows = [r for t in range(12) for r in program(rng, t, 60, [*OPS, "and.pred", "or.pred", "not.pred", "selp.b32", "selp.b32", "xor.pred"])]
    found, blocked = taint.control_taint(spark.createDataFrame(rows, EVENTS).repartition(5))
    want, stuck = walked_back(rows)
    assert {tuple(r) for r in found.collect()} == {(*w[:6], signed64(w[6])) for w in want} and len(want) > 100
    assert {tuple(r) for r in blocked.collect()} == stuck and stuck
    per = taint.trace_masks(found).collect()
    assert len(per) == len({(w[0], w[3], w[4]) for w in want})
    none, _ = taint.control_taint(spark.createDataFrame([], EVENTS))
    assert none.count() == 0


def replayed(rows, at, source, bit):
    """The branches' predicates when bit ``bit`` of what event ``at`` reads from ``source`` is flipped."""
    preds, seen = {}, {}
    for _, i, _, op, dst, srcs, values, _, _ in rows:
        v = [preds.get(s, x) if s[1] == "p" else x for s, x in zip(srcs, values, strict=True)]
        if i == at:
            v[source] ^= 1 << bit
        if op == "bra":
            seen[i] = v[0]
        else:
            preds[dst] = effect(op, v)
    return seen


def test_control_taint_against_replay(spark):
    """Every flip that turns a branch is tainted; where each predicate is read once, nothing else is."""
    rng = random.Random(5)
    rows = [r for t in range(6) for r in program(rng, t, 30, [*OPS, "and.pred", "or.pred", "not.pred"])]
    once = []
    for t in range(6, 10):  # a setp, selections of fresh predicates, a branch
        a = rng.getrandbits(32)
        p1, p2, sel = rng.getrandbits(1), rng.getrandbits(1), rng.getrandbits(1)
        p0 = effect("setp.lt.s32", [a, a ^ 8])
        once += [(t, 0, "inst", "setp.lt.s32", "%p0", ["%r0", "%r1"], [a, a ^ 8], [32, 32], None), (t, 1, "inst", "selp.b32", "%p4", ["%p0", "%p1", "%p2"], [p0, p1, sel], [1, 1, 1], None)]
        p4 = effect("selp.b32", [p0, p1, sel])
        once += [(t, 2, "inst", "selp.b32", "%p5", ["%p3", "%p6", "%p4"], [p2, 1 - p2, p4], [1, 1, 1], None), (t, 3, "branch", "bra", None, ["%p5"], [effect("selp.b32", [p2, 1 - p2, p4])], [1], True)]
    masks = defaultdict(int)
    for r in taint.control_taint(spark.createDataFrame(rows + once, EVENTS))[0].collect():
        masks[r.thread, r.branch, r["index"], r.source] |= r["mask"] & FULL
    turned = 0
    for thread in range(10):
        own = [r for r in rows + once if r[0] == thread]
        golden = replayed(own, None, 0, 0)
        for _, i, kind, _, _, srcs, _, widths, _ in own:
            for s in range(len(srcs) if kind == "inst" else 0):
                for b in range(widths[s]):
                    seen = replayed(own, i, s, b)
                    for branch, v in golden.items():
                        if branch > i:
                            turned += seen[branch] != v
                            assert seen[branch] == v or masks[thread, branch, i, s] >> b & 1
                            assert thread < 6 or seen[branch] != v or not masks[thread, branch, i, s] >> b & 1
    assert turned > 100


def test_covers_are_exact_and_small(spark):
    rng = random.Random(1)
    spans = [(rng.randrange(-1000, 1000), 0, 0) for _ in range(40)] + [(lo, lo + n, g) for g in (0, 3) for _ in range(60) for lo in [rng.randrange(-5000, 5000)] for n in [rng.randrange(0, 3000)]]
    spans = [(lo, hi if hi else lo + rng.randrange(0, 9), g) for lo, hi, g in spans] + [(5, 1 << 40, 0), (-(1 << 50), 1 << 61, 0), (7, (1 << 62) + 3, 12)]
    for g in {s[2] for s in spans}:
        df = spark.createDataFrame([s[:2] for s in spans if s[2] == g], "lo long, hi long")
        for r in df.select("lo", "hi", intervals.cover(F.col("lo"), F.col("hi"), g).alias("c")).collect():
            cells = sorted((n.node << n.level, (n.node + 1) << n.level) for n in r.c)
            assert len(cells) <= 2 * max(1, (r.hi - r.lo).bit_length()) + 1
            if r.hi <= r.lo:
                assert not cells
                continue
            assert all(a[1] == b[0] for a, b in zip(cells, cells[1:], strict=False))
            assert (cells[0][0], cells[-1][1]) == (r.lo >> g, (r.hi - 1 >> g) + 1)
    open_ = spark.createDataFrame([(5,), (-9,), (0,), (1 << 62,)], "lo long").select("lo", intervals.cover(F.col("lo"), F.lit(None).cast("long"), 2).alias("c")).collect()
    for r in open_:
        cells = sorted((n.node << n.level, (n.node + 1) << n.level) for n in r.c)
        assert all(a[1] == b[0] for a, b in zip(cells, cells[1:], strict=False)) and (cells[0][0], cells[-1][1]) == (r.lo >> 2, 1 << 61)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_points_in_intervals_of_any_length(spark, how):
    rng = random.Random(2)
    spans = [(k, lo, lo + 90, f"{k}:{lo}") for k in "ab" for lo in range(0, 5000, 100)] + [("a", 6000, None, "open"), ("c", 0, 1 << 45, "long"), ("c", 1 << 45, None, "rest"), ("d", -500, None, "d"), (None, 0, None, "no key")]
    points = [(i, rng.choice(["a", "b", "c", "d", "e", None]), rng.choice([rng.randrange(-100, 7000), rng.randrange(0, 1 << 62)])) for i in range(800)]
    want = sorted((i, k, x, n) for i, k, x in points for n in [[n for kk, lo, hi, n in spans if kk is not None and kk == k and lo <= x and (hi is None or x < hi)] or [None]][0] if n or how == "left")
    df, right = spark.createDataFrame(points, "i long, k string, x long").repartition(3), spark.createDataFrame(spans, "k string, lo long, hi long, name string")
    for bucket in (None, 100, 1 << 20):
        got = intervals.point_in_interval(df, right, ["k"], "x", "lo", "hi", how, bucket).select("i", "k", "x", "name").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_contained_in_ranges_of_any_size(spark):
    rng = random.Random(6)
    ranges = [(rng.choice("gl"), rng.randrange(0, 1 << 41), 1 << rng.randrange(0, 41)) for _ in range(60)]
    access = [(i, rng.choice("gl"), rng.choice([rng.randrange(0, 1 << 42), rng.choice(ranges)[1] + rng.randrange(0, 3)]), rng.choice([1, 4, 8])) for i in range(400)]
    got = intervals.contained(spark.createDataFrame(access, "i long, space string, at long, n long"), spark.createDataFrame(ranges, "space string, base long, size long"), F.col("at"), F.col("at") + F.col("n"))
    assert sorted(r.i for r in got.collect()) == [i for i, s, x, n in access if any(s == t and b <= x and x + n <= b + z for t, b, z in ranges)]


@pytest.mark.parametrize("ranges", [1, 7, 256])
def test_as_of_over_few_keys(spark, ranges):
    rng = random.Random(ranges)
    left = [(rng.choice([*"abcd", None]), rng.randrange(400), i) for i in range(600)]
    right = [(rng.choice([*"abcd", None]), rng.randrange(400), rng.randrange(1000)) for _ in range(300)]
    a, b = spark.createDataFrame(left, "k string, t long, i long").repartition(3), spark.createDataFrame(right, "k string, t long, v long").repartition(4)
    for strict in (False, True):
        got = intervals.as_of(a, b, ["k"], ["t"], "v", strict, ranges).select("k", "t", "i", "v").collect()
        want = [(k, t, i, max(((u, v) for kk, u, v in right if kk == k and (u < t or (u == t and not strict))), default=(0, None))[1]) for k, t, i in left]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    got = intervals.first_after(a, b.select("k", F.col("t").alias("s")), ["k"], "t", "s", ranges)
    want = [(k, t, i, min((u for kk, u, _ in right if kk == k and u > t), default=None)) for k, t, i in left]
    assert sorted(map(tuple, got.select("k", "t", "i", "next_s").collect()), key=str) == sorted(want, key=str)


def test_as_of_sorts_no_whole_key(spark):
    """A key's rows are dealt into ranges of like size before they are sorted."""
    df = spark.range(20_000).select(F.lit("k").alias("k"), F.col("id").alias("t"), F.col("id").alias("v"))
    dealt = intervals._carried(df, ["k"], "t", F.max("v"), False, 64)
    sizes = [r["n"] for r in dealt.groupBy("k", "_part").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) >= 60 and max(sizes) < 3 * 20_000 / 64


LIVE = "thread long, cycle long, index long, op string, kind string, width int, dst string, srcs array<string>, values array<long>, result long, old long, pred string, held boolean, scope string, addr long, size int, base int, data int, turns long, moved long, launch long"


def machine(rng, thread, n=14, cells=16):
    """A random program over three registers, an address register and bytes; (events, run), run giving outputs after one flip."""
    plan = []
    for _ in range(n):
        plan.append((rng.choice(["load", "load", "store", "store", "inst", "skip"]), rng.choice(["r0", "r1", "r2"]), rng.choice(["r0", "r1", "r2"]), rng.randrange(cells), rng.choice(["add", "xor", "and", "mov"]), rng.getrandbits(8) & rng.choice([0, 255])))

    def run(at=None, bit=0):
        regs, memory, events = {"r0": 5, "r1": 5, "r2": 77}, {}, []
        for i, (kind, a, b, cell, op, value) in enumerate(plan):
            place = cell ^ (1 << bit) if i == at and bit >= 0 else cell
            if place >= cells:
                return None, events
            e = {"thread": thread, "cycle": i, "index": i, "op": op, "kind": kind, "width": 8, "dst": "", "srcs": [], "values": [], "result": 0, "old": 0, "pred": None, "held": True, "scope": f"s{thread}", "addr": cell, "size": 1, "base": None, "data": 0, "turns": 0, "moved": None, "launch": thread}
            if kind == "load":
                old, regs[a] = regs[a], memory.get(place, 0)
                e |= {"dst": a, "srcs": ["addr"], "values": [cell], "result": regs[a], "old": old, "base": 0, "moved": regs[a]}
            elif kind == "store":
                e |= {"srcs": [a, "addr"], "values": [regs[a], cell], "base": 1, "moved": regs[a]}
                memory[place] = regs[a]
            elif kind == "skip":
                e |= {"kind": "store", "held": False, "pred": "p", "srcs": [a, "addr"], "values": [regs[a], cell], "base": 1, "moved": regs[a]}
                if i == at and bit < 0:
                    memory[cell] = regs[a]
            else:
                values = [regs[b], value] if op != "mov" else [regs[b]]
                old, regs[a] = regs[a], liveness.FORWARD[op](values, 8) & 255
                e |= {"dst": a, "srcs": [b, "c"][: len(values)], "values": values, "result": regs[a], "old": old}
            events.append(e)
        return [memory.get(k, 0) for k in range(4)], events

    return run


def test_address_flips_by_injection(spark):
    """With byte history a masked address bit changes no output, a due one leaves the range, an observed load differs."""
    rng = random.Random(21)
    runs = {t: machine(rng, t) for t in range(25)}
    rows = [e for run in runs.values() for e in run()[1]]
    names = [c.split()[0] for c in LIVE.split(", ")]
    df = spark.createDataFrame([tuple(e[c] for c in names) for e in rows], LIVE)
    outputs = [(None, a) for a in range(4)]
    told = history.with_history(df, "launch", [(0, 16)], bits=5)
    got = {(r.launch, r["index"], r.name): (r.observed & FULL, r.due & FULL, r.trace & FULL) for r in liveness.live_records(told, "launch", outputs, [(0, 16)], 5).collect() if r.site in ("register", "predicate")}
    plain = {(r.launch, r["index"], r.name): r.observed & FULL for r in liveness.live_records(df, "launch", outputs, [(0, 16)], 5).collect() if r.site == "register"}
    masked = observed = fewer = 0
    for t, run in runs.items():
        golden, events = run()
        for e in events:
            if e["kind"] == "store" and not e["held"]:
                changed = run(e["index"], -1)[0] != golden
                bits = got.get((t, e["index"], "p"), (0, 0, 0))
                assert not changed or any(bits), (t, e)
            if e["base"] is None or not e["held"]:
                continue
            bits = got.get((t, e["index"], "addr"), (0, 0, 0))
            fewer += (plain.get((t, e["index"], "addr"), 0) & ~(bits[0] | bits[2])).bit_count()
            for b in range(5):
                out = run(e["index"], b)[0]
                assert (bits[1] >> b & 1) == (out is None), (t, e, b)
                if out is not None:
                    live = (bits[0] | bits[2]) >> b & 1
                    assert live or out == golden, (t, e, b)
                    masked, observed = masked + (not live), observed + (out != golden)
    assert masked > 100 and observed > 50 and fewer > 20


def test_bytes_at_a_time(spark):
    rows = [(1, 0, "store", True, "s", 8, 4, 0x04030201), (1, 2, "load", True, "s", 9, 2, 0x0302), (1, 3, "store", False, "s", 8, 4, 0), (1, 4, "store", True, "s", 9, 1, 0xFF), (1, 5, "inst", True, "s", 9, 1, 7), (2, 1, "store", True, "s", 9, 1, 0x77)]
    df = spark.createDataFrame(rows, "g long, index long, kind string, held boolean, scope string, addr long, size int, moved long")
    told = history.history(df, "g")
    asked = spark.createDataFrame([(1, "s", 9, 0), (1, "s", 9, 1), (1, "s", 9, 4), (1, "s", 12, 9), (2, "s", 9, 1), (2, "s", 9, 0)], "g long, scope string, address long, index long")
    key = lambda rows: sorted(map(tuple, rows), key=str)
    found = intervals.as_of(asked, told, ["g", "scope", "address"], ["index"], "byte").select("g", "address", "index", "byte")
    assert key(found.collect()) == key([(1, 9, 0, 2), (1, 9, 1, 2), (1, 9, 4, 255), (1, 12, 9, None), (2, 9, 1, 0x77), (2, 9, 0, None)])
    assert {(r.g, r["index"]): (r.before, r.fresh) for r in history.overwritten(df, "g").collect()} == {(1, 0): (0xFFFFFFFF, 0xFFFFFFFF), (1, 3): (0x04030201, 0), (1, 4): (0xFF ^ 0x02, 0), (2, 1): (255, 255)}
