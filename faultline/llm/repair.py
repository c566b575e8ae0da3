"""Conversation structure repair by the cheapest edits.

A conversation's rows, in turn order, must spell roles of the grammar ``(s?(ua)+)?`` by their first
letters. The edit lattice has a node for each (turn index, grammar state) and is never built: Dijkstra
opens nodes by (cost, audit), the audit being the initials of the edits so far, and stops at the
first accepting node behind the last turn that it pops. Equal costs at a node never belong to audits of
which one begins the other (what follows would be inserts, which cost), so the least key is exact.

Edits: Keep 0, Rerole to user or assistant 1, Delete 2 (the only one for blank and duplicate rows),
Insert an empty-text user or assistant 5; an undeleted truncated row adds 5.

Rows of a conversation meet in one task, in order, where a task holds one conversation of up to
``most`` rows and ``most_chars`` characters at a time. Longer ones, of any length, are cut into segments
of ``most`` rows: Dijkstra gives the cheapest crossing from each state to each state of a segment, the
crossings are chained in order with only the audits' differing ends at hand, and the repaired lines
are joined by position and hashed as a stream. Conversations with over ``HOT_SHARE`` of all rows
are known before and never meet in one task as texts, but for the stream that hashes them.

Defined cases: null fields count as one space (so a null text is blank); an empty role fits nowhere; null conversations are one
conversation; rows of one turn follow by role, then the text's SHA-256; repeated rows are duplicates; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, SPACE, materialize, numbered

#: Next states of the grammar: 0 nothing yet, 1 after s, 2 after u, 3 after a.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, ACCEPTING = range(4), (0, 3)
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
NAMES = {"u": "user", "a": "assistant"}


def cheapest(codes: str, start: int = 0, ends: Iterable[int] = ACCEPTING) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest way through the rows from state ``start`` to one of ``ends``; None if there is none.

    codes: a letter per row: s, u, a, x (any other role), capital if truncated, - if it must go.
    """
    n, done = len(codes), set()
    heap = [(0, "", 0, start)]
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if (i, q) in done:
            continue
        if i == n and q in ends:
            return cost, audit
        done.add((i, q))
        ways = [(INSERT, "I", i, STEP[q, r]) for r in NAMES if (q, r) in STEP]
        if i < n:
            code = codes[i]
            ways.append((DELETE, "D", i + 1, q))
            if code != "-":
                extra, role = CUT * code.isupper(), code.lower()
                ways += [(KEEP + extra, "K", i + 1, STEP[q, role])] if (q, role) in STEP else []
                ways += [(REROLE + extra, "R", i + 1, STEP[q, r]) for r in NAMES if (q, r) in STEP]
        for more, letter, j, to in ways:
            if (j, to) not in done:
                heapq.heappush(heap, (cost + more, audit + letter, j, to))
    return None


def edits(audit: str, state: int, codes: str) -> Iterator[tuple[int | None, str | None]]:
    """(row, new role) of each repaired line; no row: an inserted one, no new role: the row keeps its own."""
    i = 0
    for letter in audit:
        if letter == "K":
            state = STEP[state, codes[i].lower()]
            yield i, None
        elif letter != "D":
            role = "a" if state == 2 else "u"
            state = STEP[state, role]
            yield (None if letter == "I" else i), NAMES[role]
        i += letter != "I"


def after(audit: str, state: int, codes: str) -> int:
    """The state behind the edits."""
    for row, role in edits(audit, state, codes):
        state = STEP[state, role[0] if role else codes[row].lower()]
    return state


def damaged(df: DataFrame) -> DataFrame:
    """The rows after damage by crc32('conv_id:turn') % 20: _key (never null), conv_id, turn, role, text, _sha."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")), F.lit(20))
    role, text = F.when(F.col("_hit") == 4, "user").otherwise(spaced("role")), spaced("text")
    text = F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    key = F.when(F.col("conv_id").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    copies = F.when(F.col("_hit") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = df.select("conv_id", "turn", "role", "text").withColumn("_hit", hit).where("_hit <> 0")
    hurt = rows.select(key.alias("_key"), "conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")
    return hurt.withColumn("_sha", F.sha2(F.col("text").cast("binary"), 256))


def own_fault() -> Column:
    """The fault that a row shows by itself: blank, truncated or none."""
    last = F.regexp_extract("text", rf"([^\x20\x09-\x0D]){SPACE}*\z", 1)
    return F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated")


def _initial() -> Column:
    first = F.substring("role", 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("x")


def _code(initial: str, fault: str | None) -> str:
    return "-" if fault in ("blank", "duplicate") else initial.upper() if fault == "truncated" else initial


def broken_pairs(initials: str) -> int:
    return sum(p not in ("su", "ua", "au") for p in map("".join, zip(initials, initials[1:], strict=False)))


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
NOTHING = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def mended(rows: list[tuple]) -> tuple:
    """The result of one conversation: (turn or None, role, text, initial, own fault) in order."""
    seen, faults = set(), []
    for _, role, text, _, fault in rows:
        faults.append("blank" if fault == "blank" else "duplicate" if (role, text) in seen else fault)
        seen.add((role, text))
    codes = "".join(_code(r[3], f) for r, f in zip(rows, faults, strict=True))
    cost, audit = cheapest(codes)
    lines = (f"{role or rows[i][1]}:{'' if i is None else rows[i][2]}" for i, role in edits(audit, 0, codes))
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), broken_pairs("".join(r[3] for r in rows)), cost, audit, digest


def _in_order(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple[str, tuple]]:
    """(key, row) of sorted batches, null turns as None."""
    for pdf in batches:
        yield from zip(pdf["_key"], zip(*[[v and int(v) for v in pdf[c]] if c == "turn" else pdf[c] for c in columns], strict=True), strict=True)


def _short(rows: DataFrame, most: int, most_chars: int) -> DataFrame:
    """Results by ``_key`` of the conversations within bounds; those beyond come with a null cost."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, held, chars, last = [], [], 0, None

        def flush() -> None:
            if last is not None:
                out.append((last, *(mended(held) if chars <= most_chars and len(held) <= most else (None,) * len(NOTHING))))

        for key, row in _in_order(batches, ["turn", "role", "text", "_initial", "_fault"]):
            if key != last:
                flush()
                held, chars, last = [], 0, key
                if len(out) >= 5000:
                    yield pd.DataFrame(out, columns=names).astype(kinds)
                    out = []
            chars += len(row[2])
            if len(held) <= most and chars <= most_chars:
                held.append(row)
        flush()
        if out:
            yield pd.DataFrame(out, columns=names).astype(kinds)

    names = ["_key", *[c.split()[0] for c in RESULT.split(", ")]]
    kinds = {n: "Int64" for n in names[1:7]}
    sorted_ = rows.repartition("_key").sortWithinPartitions("_key", "turn", "role", "_sha")
    return sorted_.select("_key", F.col("turn").cast("string").alias("turn"), "role", "text", "_initial", "_fault").mapInPandas(run, f"_key string, {RESULT}")


def _crossings(segments: DataFrame) -> DataFrame:
    """Per segment and way through it (from, to): cost and audit; columns of ``segments`` stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["ways"] = [[{"a": a, "b": b, "cost": w[0], "audit": w[1]} for a in STATES for b in STATES if (w := cheapest(codes, a, (b,)))] for codes in pdf["codes"]]
            yield pdf

    schema = "_key string, seg long, codes string, initials string, ways array<struct<a:int,b:int,cost:long,audit:string>>"
    return segments.select("_key", "seg", "codes", "initials").mapInPandas(run, schema)


def _chained(crossings: DataFrame, most: int) -> DataFrame:
    """Pieces of each conversation's cheapest audit, in order, and behind them a row with the cost and broken pairs.

    Of the best audits so far to each state only what differs is held; what they share is passed on.
    A piece comes with the row, line and state before it, and the codes of its rows.
    """
    names, kinds = ["_key", "piece", "row", "line", "state", "audit", "codes", "cost", "illegal"], {"cost": "Int64", "illegal": "Int64"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, last = [], None
        best: dict[int, tuple[int, str]] = {}
        codes, edge, illegal, piece, row, line, state = "", "", 0, 0, 0, 0, 0

        def pass_on(shared: str) -> None:
            nonlocal codes, piece, row, line, state
            used = len(shared) - shared.count("I")
            if shared:
                out.append((last, piece, row, line, state, shared, codes[:used], None, None))
                state = after(shared, state, codes)
                piece, row, line, codes = piece + 1, row + used, line + len(shared) - shared.count("D"), codes[used:]

        def close() -> None:
            if last is not None:
                cost, audit = min(best[q] for q in ACCEPTING if q in best)
                pass_on(audit)
                out.append((last, piece, row, line, state, "", "", cost, illegal))

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r[0] != last:
                    close()
                    best, codes, edge, illegal, piece, row, line, state, last = {0: (0, "")}, "", "", 0, 0, 0, 0, 0, r[0]
                illegal, edge = illegal + broken_pairs(edge + r.initials), r.initials[-1:]
                codes += r.codes
                new: dict[int, tuple[int, str]] = {}
                for w in r.ways:
                    if w["a"] in best:
                        way = best[w["a"]][0] + w["cost"], best[w["a"]][1] + w["audit"]
                        new[w["b"]] = min(new.get(w["b"], way), way)
                shared = os.path.commonprefix([a for _, a in new.values()])
                pass_on(shared)
                best = {q: (c, a[len(shared) :]) for q, (c, a) in new.items()}
            if out:
                yield pd.DataFrame(out, columns=names).astype(kinds)
            out = []
        close()
        if out:
            yield pd.DataFrame(out, columns=names).astype(kinds)

    schema = "_key string, piece long, row long, line long, state int, audit string, codes string, cost long, illegal long"
    return crossings.repartition("_key").sortWithinPartitions("_key", "seg").mapInPandas(run, schema)


def _lines(pieces: DataFrame) -> DataFrame:
    """(_key, line, pos or null, new role or null) of every repaired line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                out = [(r[0], r.line + k, None if i is None else r.row + i, role) for k, (i, role) in enumerate(edits(r.audit, r.state, r.codes))]
                if out:
                    yield pd.DataFrame(out, columns=["_key", "line", "pos", "new"]).astype({"pos": "Int64"})

    return pieces.mapInPandas(run, "_key string, line long, pos long, new string")


def _hashed(lines: DataFrame) -> DataFrame:
    """SHA-256 over the lines of each conversation, one after the other, as they come."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, last, digest = [], None, None
        for pdf in batches:
            for key, text in zip(pdf["_key"], pdf["said"], strict=True):
                if key != last:
                    out += [(last, digest.hexdigest())] if digest else []
                    last, digest = key, hashlib.sha256(text.encode())
                else:
                    digest.update(b"\n" + text.encode())
            if out:
                yield pd.DataFrame(out, columns=["_key", "repaired_sha256"])
            out = []
        if digest:
            yield pd.DataFrame([(last, digest.hexdigest())], columns=["_key", "repaired_sha256"])

    return lines.repartition("_key").sortWithinPartitions("_key", "line").select("_key", "said").mapInPandas(run, "_key string, repaired_sha256 string")


def _long(rows: DataFrame, most: int) -> DataFrame:
    """The results, by ``_key``, of conversations of any length."""
    rows = materialize(rows, "repair-long")
    at = materialize(numbered(rows, "_key", ["turn", "role", "_sha"], rows.count(), "pos"), "repair-positions")
    first = at.groupBy("_key", "role", "_sha").agg(F.min("pos").alias("pos")).select("_key", "pos", F.lit(True).alias("_first"))
    narrow = at.select("_key", "pos", "turn", "_initial", "_fault").hint("merge").join(first, ["_key", "pos"], "left")
    fault = F.when(F.col("_fault") == "blank", "blank").when(F.col("_first").isNull(), "duplicate").otherwise(F.col("_fault"))
    code = F.when(fault.isin("blank", "duplicate"), "-").when(fault == "truncated", F.upper("_initial")).otherwise(F.col("_initial"))
    marked = narrow.select("_key", "pos", "turn", fault.alias("fault"), "_initial", code.alias("code"), F.floor(F.col("pos") / most).alias("seg"))
    marked = materialize(marked, "repair-marked")
    held = F.array_sort(F.collect_list(F.struct("pos", "code", "_initial")))
    segments = marked.groupBy("_key", "seg").agg(held.alias("_rows"))
    text = lambda f: F.array_join(F.transform("_rows", f), "")
    segments = segments.select("_key", "seg", text(lambda r: r["code"]).alias("codes"), text(lambda r: r["_initial"]).alias("initials"))
    pieces = materialize(_chained(_crossings(segments), most), "repair-pieces")
    counts = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    facts = marked.groupBy("_key").agg(*counts, F.min("turn").alias("_lo"), F.max("turn").alias("_hi"))
    turns = marked.where("turn is not null").select("_key", "turn").distinct().groupBy("_key").agg(F.count(F.lit(1)).alias("_turns"))
    audits = pieces.groupBy("_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "audit"))), lambda p: p["audit"]), "").alias("audit"), F.max("cost").alias("cost"), F.max("illegal").alias("illegal"))
    lines = _lines(pieces.where("audit <> ''")).withColumn("_at", F.coalesce("pos", -1 - F.col("line")))
    said = lines.hint("merge").join(at.select("_key", F.col("pos").alias("_at"), "role", "text"), ["_key", "_at"], "left")
    said = said.withColumn("said", F.concat(F.coalesce("new", "role"), F.lit(":"), F.coalesce("text", F.lit(""))))
    joined = facts.join(turns, "_key", "left").join(audits, "_key").join(_hashed(said), "_key", "left")
    gaps = F.coalesce(F.col("_hi").cast("long") - F.col("_lo") + 1 - F.col("_turns"), F.lit(0))
    return joined.select("_key", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.lit(NOTHING[-1])).alias("repaired_sha256"))


def repair(df: DataFrame, most: int = 2000, most_chars: int = 32_000_000) -> DataFrame:
    """One row per conversation of ``df``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    key = F.when(F.col("conv_id").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    sizes = materialize(df.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n")).withColumn("_key", key), "repair-sizes")
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    rows = damaged(df).withColumns({"_initial": _initial(), "_fault": own_fault()})
    giant = sizes.where(F.col("_n") > max(most, total * HOT_SHARE)).select("_key")  # at most 1 / HOT_SHARE keys
    short = materialize(_short(rows.join(F.broadcast(giant), "_key", "left_anti"), most, most_chars), "repair-short")
    beyond, found = short.where("cost is null").select("_key"), short.where("cost is not null")
    if not beyond.unionByName(giant).isEmpty():
        long = rows.join(F.broadcast(giant), "_key", "left_semi").unionByName(rows.hint("merge").join(beyond, "_key", "left_semi"))
        found = found.unionByName(_long(long, most))
    out = sizes.select("conv_id", "_key").hint("merge").join(found, "_key", "left")
    names = [c.split()[0] for c in RESULT.split(", ")]
    return out.select("conv_id", *[F.coalesce(F.col(c), F.lit(v)).cast("long" if isinstance(v, int) else "string").alias(c) for c, v in zip(names, NOTHING, strict=True)])
