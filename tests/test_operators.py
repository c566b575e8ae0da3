"""Joins, state machines, series, graphs and streams against plain Python."""

from __future__ import annotations

import bisect
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from faultline.operators import classify, graphs, intervals, lifetimes, liveness, ordered, residency, sampling, series, stats
from faultline.plans import reports
from faultline.streaming import snapshots


def test_point_in_interval_with_and_without_buckets(spark):
    rng = random.Random(1)
    rows = [(k, s, s + rng.randrange(1, 40) if rng.random() < 0.9 else None, i) for i, (k, s) in enumerate((k, 50 * j) for k in range(4) for j in range(20))]
    iv = spark.createDataFrame(rows, "k long, start long, end long, v long")
    points = spark.createDataFrame([(rng.randrange(5), rng.randrange(1200)) for _ in range(300)], "k long, at long")
    want = sorted((k, at, v) for k, at in map(tuple, points.collect()) for kk, s, e, v in rows if kk == k and s <= at and e is not None and at < e)
    closed = iv.where("end is not null")
    for bucket in (None, 64):
        got = intervals.point_in_interval(points, closed, ["k"], "at", "start", "end", "inner", bucket)
        assert sorted((r.k, r.at, r.v) for r in got.collect()) == want
    assert intervals.point_in_interval(points, iv, ["k"], "at", "start", "end").where("v is null").count() > 0


@pytest.mark.parametrize("strict", [False, True])
def test_as_of_and_first_after(spark, strict):
    rng = random.Random(2)
    facts = {(k, t): rng.randrange(99) for k in range(3) for t in rng.sample(range(100), 20)}
    asks = [(i, rng.randrange(4), rng.randrange(100)) for i in range(200)]
    left, right = spark.createDataFrame(asks, "i long, k long, t long"), spark.createDataFrame([(k, t, v) for (k, t), v in facts.items()], "k long, t long, v long")
    at = {k: sorted(t for kk, t in facts if kk == k) for k in range(4)}
    for r in intervals.as_of(left, right, ["k"], ["t"], "v", strict).collect():
        j = (bisect.bisect_left if strict else bisect.bisect_right)(at[r.k], r.t)
        assert r.v == (facts[r.k, at[r.k][j - 1]] if j else None)
    for r in intervals.first_after(left, right.select("k", F.col("t").alias("site")), ["k"], "t", "site").collect():
        j = bisect.bisect_right(at[r.k], r.t)
        assert r.next_site == (at[r.k][j] if j < len(at[r.k]) else None)


def test_overlap_semi(spark):
    rng = random.Random(3)
    a = [(i, x, x + rng.randrange(1, 300)) for i, x in enumerate(rng.randrange(5000) for _ in range(150))]
    b = [(x, x + rng.randrange(0, 90)) for x in (rng.randrange(5000) for _ in range(40))]
    got = intervals.overlap_semi(spark.createDataFrame(a, "i long, lo long, hi long"), spark.createDataFrame(b, "p long, q long"), "lo", "hi", "p", "q", 64)
    assert sorted(r.i for r in got.collect()) == sorted(i for i, lo, hi in a if any(lo < q and hi > p and p < q for p, q in b))


def test_versions_follow_a_state_machine(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(3), rng.randrange(60), rng.random() < 0.4) for i in range(300)]
    got = {(r.k, r.version): (r.start, r.last_read, r.n_reads, r.end) for r in lifetimes.versions(spark.createDataFrame(rows, "i long, k long, c long, w boolean"), ["k"], "c", "i", F.col("w"), F.lit(-1).cast("long")).collect()}
    for k in range(3):
        made, now = [], None
        for i, _, c, w in sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0])):
            if w:
                now = [c, None, 0]
                made.append(now)
            else:
                if now is None:
                    now = [-1, None, 0]
                    made.append(now)
                now[1], now[2] = c, now[2] + 1
        ends = [m[0] for m in made[1:]] + [None]
        mine = [v for (kk, _), v in sorted(got.items()) if kk == k]
        assert mine == [(s, r, n, e) for (s, r, n), e in zip(made, ends, strict=True)]


def test_residency_matches_a_replay(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(4), t, rng.randrange(9), rng.random() < 0.3) for t in range(600)]
    df = spark.createDataFrame(rows, "s long, t long, line long, st boolean").repartition(7)
    got = residency.lru_episodes(df, ["s"], ["t"], "line", 3, "st").collect()
    for s in range(4):
        want = residency.replayed([(t, line) for ss, t, line, _ in rows if ss == s], 3)
        assert sorted((r.start, r.line) for r in got if r.s == s) == want
    assert sum(r.hits for r in got) + len(got) == len(rows)
    passing = residency.lru_episodes(df, ["s"], ["t"], "line", 3, "st", write_allocate=False).collect()
    for s in range(4):  # stores that miss bring nothing in
        want, held = [], []
        for ss, t, line, st in rows:
            if ss == s and (line in held or not st):
                want += [(t, line)] * (line not in held)
                held = [x for x in held if x != line][-2 if line not in held else -3 :] + [line]
        assert sorted((r.start, r.line) for r in passing if r.s == s) == want


def _cache_brute(rows, point, ways, line_bytes, stop):
    """Class of a point by walking one set's accesses (t, line, store, offsets) one by one."""
    s, way, at, bit = point
    slots, order, episodes = [None] * ways, [], []
    for ss, t, line, store, offsets in rows:
        if ss != s:
            continue
        if line in slots:
            w = slots.index(line)
            order.remove(w)
        else:
            w = slots.index(None) if None in slots else order.pop(0)
            for e in episodes:
                if e["way"] == w and e["end"] is None:
                    e["end"] = t
            slots[w] = line
            episodes.append({"way": w, "start": t, "end": None, "at": {}})
        order.append(w)
        e = next(e for e in episodes if e["way"] == w and e["end"] is None)
        for o in offsets:
            versions = e["at"].setdefault(o, [[e["start"], None, False, None]])
            if store:
                versions[-1][1] = t
                versions.append([t, None, True, None])
            else:
                versions[-1][3] = t
    for e in episodes:
        end = stop if e["end"] is None else e["end"]
        if e["way"] == way and e["start"] <= at < end:
            if bit >= line_bytes * 8:
                return "ebc"
            for start, until, dirty, load in e["at"].get(bit // 8, []):
                last = until is None
                if start <= at < (end if last else until):
                    return "dcr" if at < ((end if dirty and last else load) or -1) else "benign"
    return "benign"


def test_cache_points_against_a_walk(spark):
    rng = random.Random(15)
    rows = [(rng.randrange(2), t, rng.randrange(7), rng.random() < 0.3, sorted(rng.sample(range(4), rng.randrange(1, 4)))) for t in range(300)]
    df = spark.createDataFrame([(s, t, t, line, st, o) for s, t, line, st, o in rows], "s long, t long, i long, line long, st boolean, o array<int>")
    episodes, found = residency.byte_versions(df, ["s"], ["t", "i"], "line", 3, "st", F.col("o"), 300)
    points = [(rng.randrange(2), rng.randrange(3), rng.randrange(300), rng.randrange(40)) for _ in range(400)]
    got = residency.cache_class(spark.createDataFrame(points, "s long, way int, at long, bit long"), episodes, found, ["s"], "at", 4).collect()
    assert sorted((r.s, r.way, r.at, r.bit, r["class"]) for r in got) == sorted((*p, _cache_brute(rows, p, 3, 4, 300)) for p in points)


def test_series(spark):
    df = spark.createDataFrame([("a", x, y) for x, y in ((0, 5), (2, 9), (4, 3), (6, 4))], "k string, x long, y long")
    assert [r.rate for r in series.derivative(df, ["k"], "x", "y").orderBy("x").collect()] == [None, 2.0, 1.5, 0.5]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([1, 3, 2, 4, 4, 9])], "i long, x long").withColumn("k", F.lit(1))
    assert [(r.segment, r.stitched) for r in series.stitched(df, ["k"], ["i"], "x").orderBy("i").collect()] == [(0, 1), (0, 3), (1, 5), (1, 7), (2, 11), (2, 16)]
    df = spark.createDataFrame([(1, i) for i in (1, 2, 3, 7, 8, 20)], "k long, id long")
    assert sorted((r.start, r["count"]) for r in series.runs(df, ["k"], "id").collect()) == [(1, 3), (7, 2), (20, 1)]
    df = spark.createDataFrame([(1, p, i) for p, i in enumerate((5, 6, 5, 6, 7))], "k long, p long, id long")
    assert sorted((r.start, r["count"]) for r in series.runs(df, ["k"], "id", "p").collect()) == [(5, 2), (5, 3)]
    df = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("b", 0, 9)], "k string, p long, v long")
    assert sorted((r.k, r.p, r.v) for r in series.padded_left(df, ["k"], "p", "v").collect()) == [("a", 0, 1), ("a", 1, 2), ("b", 0, 0), ("b", 1, 9)]
    assert sorted((r.k, r.p, r.v) for r in series.with_leading_zero(df, ["k"], "p", "v").collect()) == [("a", 0, 0), ("a", 1, 1), ("a", 2, 2), ("b", 0, 0), ("b", 1, 9)]
    df = spark.createDataFrame([("1 2 5 3 4 6",), ("7 8",)], "t string")
    got = df.select(series.sparse(F.split("t", " ")).alias("x")).collect()
    assert [tuple(x) for x in got[0].x] == [("1", "2", "5"), ("3", "4", "6")] and got[1].x is None
    got = df.select(*series.indexed(F.split("t", " "), ["i", "j"])).collect()
    assert [(r.i, r.j, r["values"]) for r in got] == [("1", "2", ["5", "3", "4", "6"]), ("7", "8", None)]
    got = df.limit(1).select(*series.vector(F.col("t"), "v")).collect()
    assert [(r.position, r.v) for r in got][:3] == [(0, "0"), (1, "1"), (2, "2")]
    weights, ranges = spark.createDataFrame([(i, i * i) for i in range(10)], "c long, weight long"), spark.createDataFrame([(2, 5), (8, 99), (20, 30)], "lo long, hi long")
    assert sorted((r.lo, r.range_weight) for r in series.range_weight(weights, ranges, [], "c", "weight", "lo", "hi").collect()) == [(2, 4 + 9 + 16), (8, 64 + 81), (20, 0)]


def test_atomics_and_turns(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(3), rng.randrange(4), rng.randrange(4)) for i in range(100)]
    df = spark.createDataFrame(rows, "i long, a long, v long, compare long")
    for op in ("exch", "cas", "inc", "dec"):
        want = defaultdict(int)
        for _, a, v, c in rows:
            now = want[a]
            want[a] = {"exch": v, "cas": v if now == c else now, "inc": 0 if now >= v else now + 1, "dec": v if now == 0 or now > v else now - 1}[op]
        assert {r.a: r.atom for r in ordered.atomic_fold(df, ["a"], ["i"], op, "v").collect()} == want
    slots = spark.createDataFrame([(1, s, 2, 10 - s) for s in range(4)], "c long, s long, last long, age long")
    assert [r.s for r in series.rotated(slots, ["c"], "s", "last", 4).orderBy("turn").collect()] == [3, 0, 1, 2]
    assert [r.s for r in series.oldest_first(slots, ["c"], "s", "last", "age").orderBy("turn").collect()] == [2, 3, 1, 0]


def test_graphs(spark):
    flow = spark.createDataFrame([("p", 0, "inst", None), ("p", 8, "branch", 32), ("p", 16, "min", None), ("p", 24, "jump", 40), ("p", 32, "inst", None), ("p", 40, "exit", None)], "program string, pc long, kind string, target long")
    edges = graphs.successors(flow, "pc", "kind", "target").join(flow.select("program", "pc", "kind"), "pc")
    assert sorted((r.pc, r.next) for r in edges.collect()) == [(0, 8), (8, 16), (8, 32), (16, 24), (24, 40), (32, 40)]
    last = spark.createDataFrame([(40, None, "p", "exit")], "pc long, next long, program string, kind string")
    masked = lambda rows: {r.pc: r.probability for r in graphs.masking_probability(rows.withColumnRenamed("next", "succ"), "program", "pc", "succ", "kind").collect()}
    assert masked(edges.select(last.columns).unionByName(last)) == pytest.approx({0: 0.375, 8: 0.375, 16: 0.5, 24: 1.0, 32: 1.0, 40: 1.0})
    # a masking terminal keeps its factor; successors outside the program do not share the weight
    ends = spark.createDataFrame([("q", 0, "inst", 8), ("q", 8, "min", None), ("q", 16, "branch", 99), ("q", 16, "branch", 0)], "program string, pc long, kind string, next long")
    assert masked(ends) == pytest.approx({0: 0.5, 8: 0.5, 16: 0.25})
    dom = defaultdict(set)
    for r in graphs.dominators(edges.select("program", "pc", "next", F.lit(0).cast("long").alias("entry")), "program", "pc", "next", "entry").collect():
        dom[r.node].add(r.dominator)
    assert dom == {0: {0}, 8: {0, 8}, 16: {0, 8, 16}, 24: {0, 8, 16, 24}, 32: {0, 8, 32}, 40: {0, 8, 40}}
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501), (600, 600)], "a long, b long")
    assert {r.node: r.root for r in graphs.connected(chain, "a", "b").collect()} == {**{i: 0 for i in range(301)}, 500: 500, 501: 500, 600: 600}


def _event(index, **more):
    return {"thread": 0, "cycle": index, "index": index, "op": "mov", "kind": "inst", "width": 8, "dst": "", "srcs": [], "values": [], "result": 1, "old": 0, "pred": None, "held": True, "scope": "g", "addr": 0, "size": 1, "base": None, "data": 0, "turns": 0} | more


def test_liveness_by_injection():
    """Register bits that the walk calls observed are those whose flip changes the stored output."""
    rng = random.Random(7)
    for _ in range(40):
        steps, names = [], ["r0", "r1", "r2"]
        for _ in range(6):
            steps.append((rng.choice(["and", "or", "xor"]), rng.choice(names), [rng.choice(names) for _ in range(2)]))
        start = {n: rng.getrandbits(8) for n in names}

        def run(at=None, name=None, bit=0, start=start, steps=steps):
            regs, events = dict(start), []
            for i, (op, dst, srcs) in enumerate(steps):
                if at == i:
                    regs[name] ^= 1 << bit
                values = [regs[s] for s in srcs]
                old, regs[dst] = regs[dst], liveness.FORWARD[op](values, 8) & 255
                events.append(_event(i, op=op, dst=dst, srcs=srcs, values=values, result=regs[dst], old=old))
            events.append(_event(len(steps), kind="store", srcs=["r0"], values=[regs["r0"]]))
            return regs["r0"], events

        want, events = run()
        records = liveness.walk(events, {("g", 0)})
        for i, (_, _, srcs) in enumerate(steps):
            for n in {*srcs}:
                live = [r["observed"] for r in records if r["index"] == i and r["name"] == n and r["site"] == "register"]
                if len(live) == 1 and srcs.count(n) == 1 and steps[i][1] != n and not any(n in s[2] for s in steps[i + 1 :]) and n != "r0":
                    flips = sum(1 << b for b in range(8) if run(i, n, b)[0] != want)
                    assert flips == live[0]


def test_liveness_of_memory_and_predicates():
    events = [
        _event(0, dst="a", srcs=["b"], values=[3], result=3),
        _event(1, kind="store", srcs=["a"], values=[3], addr=4),
        _event(2, kind="load", dst="c", addr=4, base=0, srcs=["p"], values=[4], result=3, size=1),
        _event(3, op="and", dst="d", srcs=["c", "m"], values=[3, 6], pred="q", result=2, old=0),
        _event(4, kind="store", srcs=["d"], values=[2], addr=9),
        _event(5, op="mov", dst="e", srcs=["d"], values=[2]),
    ]
    got = {(r["index"], r["site"], r["name"]): r for r in liveness.walk(events, {("g", 9)}, [(0, 16)])}
    assert got[4, "register", "d"]["observed"] == 255 and got[3, "register", "c"]["observed"] == 6 and got[3, "register", "m"]["observed"] == 3
    assert got[3, "predicate", "q"]["observed"] == 1 and got[2, "byte", "g:4"]["observed"] == 6 and got[1, "register", "a"]["observed"] == 6 and got[0, "register", "b"]["observed"] == 6
    assert got[2, "register", "p"]["due"] == 0xFFFFFFF0 and got[2, "register", "p"]["observed"] == 15
    assert not any(i == 5 for i, _, _ in got)
    with pytest.raises(ValueError):
        liveness.walk([_event(0, op="strange", dst="a", srcs=["b"], values=[1]), _event(1, kind="store", srcs=["a"], values=[1])], {("g", 0)})


def test_classification_and_reports(spark):
    rows = [("a", [1.0, math.nan], [1.0, math.nan], None, None), ("b", [1.0], [1.0], None, None), ("c", None, None, ["x", "y"], ["y", "x", "x"]), ("d", None, [1.0], None, ["q"])]
    df = spark.createDataFrame([(True, None, None, *r[1:]) for r in rows], "ok boolean, golden_signature string, run_signature string, golden_values array<double>, run_values array<double>, golden_entries array<string>, run_entries array<string>")
    assert [r[0] for r in df.select(classify.compare_observations(df)).collect()] == ["sdc", "masked", "masked", "due"]
    df = spark.createDataFrame([("m", 1, 10.0, 2.0), ("m", 1, 30.0, 2.0), ("n", 1, 5.0, 5.0)], "arch string, c long, t double, u double")
    got = {r.arch: r.speedup for r in reports.speedups(df, "arch", "t", "u").collect()}
    assert got == {"m": 10.0, "n": 1.0, "Combined": 5.0}
    df = spark.createDataFrame([("m", 1, 10.0, 2.0), (None, 1, 30.0, 2.0), (None, 2, 5.0, 5.0)], "arch string, c long, t double, u double")
    assert sorted(((r.arch or "-", r.speedup) for r in reports.speedups(df, "arch", "t", "u").collect())) == [("-", 5.0), ("Combined", 5.0), ("m", 5.0)]
    assert sorted(((r.arch or "-", r.c, r.speedup) for r in reports.speedups(df, "arch", "t", "u", ["c"]).collect())) == [("-", 1, 15.0), ("-", 2, 1.0), ("Combined", 1, 10.0), ("Combined", 2, 1.0), ("m", 1, 5.0)]


def test_sampling(spark):
    draws = sampling.python_draws(spark, 5, [10, 100]).orderBy("trial").collect()
    rng = random.Random(2026)
    assert [(r.x0, r.x1) for r in draws] == [(rng.randrange(10), rng.randrange(100)) for _ in range(5)]
    weights = spark.createDataFrame([(c, c % 3) for c in range(100)], "c long, w long")
    cumulative, run = [], 0
    for c in range(100):
        run += c % 3
        cumulative.append(run)
    picks = spark.createDataFrame([(i,) for i in range(run + 3)], "x long")
    for ranges in (1, 7, 64):
        for r in sampling.weighted_pick(picks, weights, "x", "c", "w", ranges).collect():
            j = bisect.bisect_right(cumulative, r.x)
            assert r.c == (j if j < 100 else None)
    assert [r.value for r in sampling.lcg_draws(spark, 2, 1).orderBy("trial").collect()] == [1103527590, 377401575]
    df = spark.createDataFrame([(1, [[3, 2], [9, 1]])], "c long, r array<array<int>>")
    assert [r.thread for r in sampling.expand_ranges(df, "r").collect()] == [3, 4, 9]


def test_bank_conflicts_with_broadcast(spark):
    df = spark.createDataFrame([(0, 0, a) for a in (0, 128, 256, 4)] + [(0, 1, a) for a in (0, 4, 8)], "w long, s long, addr long")
    assert stats.bank_conflicts(df, ["w", "s"], "addr").first().cycles == 3 + 1
    assert stats.bank_conflicts(df, ["w", "s"], "addr", broadcast_one=True).first().cycles == 2 + 1


def test_streams(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02}:00", "a" if m % 2 else "b", m) for m in range(60)]
    df = spark.createDataFrame(rows, "ts string, k string, v long").withColumn("ts", F.to_timestamp("ts"))
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = snapshots.read_events(spark, f"{tmp_path}/in", "ts timestamp, k string, v long", 1)
    q = snapshots.snapshots(stream, "ts", ["k"], "10 minutes", "v", "1 hour").writeStream.outputMode("complete").format("memory").queryName("snaps").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.table("snaps").collect()))
    assert got == sorted(map(tuple, snapshots.snapshots(df, "ts", ["k"], "10 minutes", "v").collect())) and len(got) == 12
    q = snapshots.running_totals(stream, "k").writeStream.outputMode("update").format("memory").queryName("totals").start()
    q.processAllAvailable()
    q.stop()
    best = {r.k: r.m for r in spark.table("totals").groupBy("k").agg(F.max("carried").alias("m")).collect()}
    assert best == {"a": 30, "b": 30}


def test_stateful_streams(spark, tmp_path):
    """Occupancy and stitching over triggers agree with a walk over all rows."""
    rng = random.Random(18)
    rows = [(t, rng.randrange(2), rng.randrange(4), f"pc{rng.randrange(3)}", x) for t, x in zip(range(90), [i % 13 for i in range(90)], strict=True)]
    for k in range(3):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], "t long, core long, thread long, pc string, x long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = snapshots.read_events(spark, f"{tmp_path}/in", "t long, core long, thread long, pc string, x long", 1)

    def collected(df, name):
        q = df.writeStream.outputMode("append").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    want = set()
    for core in (0, 1):
        seat, mine = {}, [r for r in rows if r[1] == core]
        for r, after in zip(mine, [*mine[1:], None], strict=True):
            seat[r[2]] = r[3]
            if after and after[0] // 10 > r[0] // 10:
                want |= {(core, r[0] // 10, p, n) for p, n in Counter(seat.values()).items()}
    got = [tuple(r) for r in collected(snapshots.occupancy_stream(stream, "core", "t", "thread", "pc", 10), "seats")]
    assert set(got) == want and len(got) == len(want)
    one = stream.withColumn("k", F.lit("a"))
    got = sorted((r.t, r.stitched) for r in collected(snapshots.stitched_stream(one, "k", "t", "x"), "stitches"))
    batch = series.stitched(spark.createDataFrame([(t, x) for t, *_, x in rows], "t long, x long").withColumn("k", F.lit("a")), ["k"], ["t"], "x")
    assert got == sorted((r.t, r.stitched) for r in batch.collect())


def test_late_rows_move_no_thread_back(spark, tmp_path):
    """A row of an earlier time in a later trigger leaves a thread where it stands."""
    for k, rows in enumerate([[(5, 0, 1, "a"), (12, 0, 1, "b")], [(7, 0, 1, "late"), (13, 0, 2, "c")], [(25, 0, 2, "d")]]):
        spark.createDataFrame(rows, "t long, core long, thread long, pc string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/late")
    stream = snapshots.read_events(spark, f"{tmp_path}/late", "t long, core long, thread long, pc string", 1)
    q = snapshots.occupancy_stream(stream, "core", "t", "thread", "pc", 10).writeStream.outputMode("append").format("memory").queryName("late_seats").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("late_seats").collect())) == [(0, 0, "a", 1), (0, 1, "b", 1), (0, 1, "c", 1)]


def test_results_do_not_depend_on_input_order(spark):
    from faultline import queries

    sf = "/root/testdata/sf0.001"

    def shuffled(name):
        return spark.read.parquet(f"{sf}/{name}.parquet").orderBy(F.rand(3)).repartition(5)

    from faultline.queries import statistics, traces

    for f in (traces.register_lifetimes, traces.lru_residency, traces.segment_stitch, statistics.network_statistics, traces.live_bits):
        want = sorted(map(str, queries.QUERIES[f.__name__](spark, sf).collect()))
        assert sorted(map(str, f(shuffled).collect())) == want


def test_merged_states_equal_the_whole(spark):
    rng = random.Random(4)
    rows = [(i % 3, rng.choice([0, 1, -5, 7, 2**40, rng.getrandbits(62), None])) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, v long")
    parts = [stats.accumulators(df.where(F.pmod(F.hash("v"), F.lit(3)) == i), ["k"], "v") for i in range(3)]
    once = stats.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["k"])
    twice = stats.merged(stats.merged(parts[2].unionByName(parts[0]), ["k"]).unionByName(parts[1]), ["k"])
    whole = stats.accumulators(df, ["k"], "v")
    want = sorted(map(str, whole.collect()))
    assert sorted(map(str, once.collect())) == want == sorted(map(str, twice.collect()))
    for r in whole.collect():
        own = [v for k, v in rows if k == r.k and v is not None]
        low, mixed, high = map(int, r.state.squares)
        assert (r.state.n, int(r.state["sum"]), low + (mixed << 33) + (high << 64), r.state.least, r.state.most) == (len(own), sum(own), sum(v * v for v in own), min(own), max(own))
        assert sum(r.state.bins) == len(own) and r.state.bins[0] == sum(v <= 0 for v in own)
    assert stats.read_out(stats.accumulators(df.limit(0), ["k"], "v"), ["k"]).count() == 0


def test_component_domains(spark):
    """Stated sizes come first, shared memory needs a touch, both caches have the tags of the first."""
    geometry = "struct<sets:int,line:int,ways:int>"
    schema = f"app string, cycles long, threads long, blocks long, shaders long, shared_seen boolean, registers long, datatype_bits long, smem_bits long, l1d {geometry}, l2 {geometry}, memories int, partitions int, l1d_bits long, l2_bits long, tag_bits int"
    rows = [
        ("a", 10, 4, 2, 3, True, 7, None, 0, (64, 128, 6), (64, 128, 16), 8, 2, None, 0, None),
        ("b", 10, 4, 2, 0, False, 7, 64, 500, None, (32, 128, 4), 0, None, 999, 0, 57),
        ("c", 0, 4, 2, 1, None, 7, 8, 500, (0, 128, 6), None, 1, 1, 0, 77, 0),
    ]
    got = {(r.app, r.component): (r.seeds, r.bits, int(r.total)) for r in sampling.component_domains(spark.createDataFrame(rows, schema), ["app"]).collect()}
    tag = 64 - 7 - 6
    assert got["a", "rf"] == (4, 224, 10 * 4 * 224) and got["a", "smem_rf"] == (2, 1, 20)
    assert got["a", "l1d"] == (3, 64 * 6 * (1024 + tag), 30 * 64 * 6 * (1024 + tag)) and got["a", "l2"] == (1, 64 * 16 * (1024 + tag) * 16, 10 * 64 * 16 * (1024 + tag) * 16)
    assert got["b", "rf"][1] == 448 and got["b", "smem_rf"] == (2, 0, 0) and got["b", "l1d"] == (1, 999, 9990) and got["b", "l2"][1] == 32 * 4 * (1024 + 57)
    assert got["c", "l1d"] == (1, 0, 0) and got["c", "l2"] == (1, 77, 0) and got["c", "smem_rf"][1] == 0


def test_semantic_outcomes(spark):
    schema = "i int, run_failed boolean, run_missing_output boolean, run_error_type string, reference boolean, golden_signature string, run_signature string, golden_values array<double>, run_values array<double>, golden_entries array<string>, run_entries array<string>"
    rows = [
        (0, True, True, " OutOfRangeMemoryAccess ", None, None, None, None, None, None, None), (1, True, False, "odd", None, None, None, None, None, None, None), (2, True, None, None, True, None, None, None, None, None, None),
        (3, True, None, "", None, None, None, [1.0], None, None, None), (4, None, True, "MissingBytes", None, "a", "a", None, None, None, None), (5, None, None, None, None, "a", "a", None, None, None, None), (6, False, False, None, None, "a", "b", [1.0], [1.0], None, None),
        (7, False, False, None, None, None, None, [1.0, math.nan], [1.0, math.nan], None, None), (8, False, False, None, None, None, "x", None, None, None, None), (9, False, False, None, None, None, None, None, None, ["x", "x"], ["x"]),
    ]
    got = {r.i: (r.outcome, r.reason) for r in classify.semantic_outcome(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        0: ("due", "out_of_range_memory_access"), 1: ("due", "invalid_path"), 2: ("due", "run_failed"), 3: ("due", "run_failed"), 4: ("due", "missing_expected_output"), 5: ("masked", "outputs_equal"), 6: ("sdc", "outputs_differ"),
        7: ("sdc", "outputs_differ"), 8: ("due", "nothing_to_compare"), 9: ("masked", "outputs_equal"),
    }
