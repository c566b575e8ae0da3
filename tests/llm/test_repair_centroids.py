"""Conversation repair and centroid clustering against brute force and their SQL."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from faultline.llm import centroids, queries, repair

CONV = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def enumerated(rows):
    """(cost, audit, lines) over all edit sequences with at most one insert; two cost more than deleting up to four rows."""
    found = []
    for letters in itertools.product("KRD", repeat=len(rows)):
        for at in [None, *range(len(rows) + 1)]:
            spots = [x for i, e in enumerate(letters) for x in ([("I", None)] if at == i else []) + [(e, i)]] + ([("I", None)] if at == len(rows) else [])
            open_ = [e in "RI" for e, _ in spots]
            for roles in itertools.product(*[("user", "assistant") if o else (None,) for o in open_]):
                cost, lines, fine = 0, [], True
                for (e, i), new in zip(spots, roles, strict=True):
                    cost += {"K": 0, "R": 1, "D": 2, "I": 5}[e]
                    if e == "D":
                        continue
                    if e != "I":
                        fine &= rows[i][2] not in ("blank", "duplicate")
                        cost += 5 * (rows[i][2] == "truncated")
                    lines.append((new or rows[i][0], "" if e == "I" else rows[i][1]))
                if fine and GRAMMAR.match("".join(r[:1] or "x" for r, _ in lines)):
                    found.append((cost, "".join(e for e, _ in spots), "\n".join(f"{r}:{t}" for r, t in lines)))
    return min(found)


def brute_repair(table):
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        convs[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, rows in convs.items():
        hurt = []
        for turn, role, text in rows:
            hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            hurt += [(turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
        hurt.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, marked = set(), []
        for _, role, text in hurt:
            tail = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")[-1:]
            fault = "blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail not in ".!?" else None
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = {t for t, _, _ in hurt if t is not None}
        faults = [f for _, _, f in marked]
        pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(marked)]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), marked)
    return out


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(3)
    texts = ["Yes.", "No!", "Well", "Why? ", " \t\n", "", None, "one", "Grüße, 漢字.", "x" * 3000 + "."]
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rng.choice(texts)) for c in range(60) for t in range(rng.randint(1, 4)) if rng.random() < 0.9]
    rows += [(100 + c, t, "ua"[t % 2] and ("user", "assistant")[t % 2], f"Turn {t}.") for c in range(5) for t in range(40 + c)]
    return rows + [(None, 3, "user", "No id."), (None, None, "assistant", "No turn."), (7, 1, "user", "Yes."), (7, 1, "user", "Yes."), (2**60, 2**55 + 1, "user", "Far."), (2**60, None, "user", "Far!")]


def test_repair_matches_brute_force(spark, talks):
    got = {r["conv_id"]: r for r in repair.repair(spark.createDataFrame(talks, CONV).repartition(5)).collect()}
    want = brute_repair(talks)
    assert set(got) == set(want)
    for conv, (*counts, marked) in want.items():
        row = got[conv]
        assert [row[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal")] == counts, conv
        if len(marked) <= 4:
            cost, audit, said = enumerated(marked)
            assert (row["cost"], row["audit"], row["repaired_sha256"]) == (cost, audit, hashlib.sha256(said.encode()).hexdigest()), conv


def test_long_conversations_give_the_same(spark, talks):
    df = spark.createDataFrame(talks, CONV).repartition(3).cache()
    want = sorted(map(str, repair.repair(df).collect()))
    assert sorted(map(str, repair.repair(df, most=3).collect())) == want
    assert sorted(map(str, repair.repair(df, most=7, most_chars=20).collect())) == want


def test_repair_odd_tables(spark, talks):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(talks, CONV)
    names = ["_key", "_hit", "_sha", "_n", "cost", "audit", "gaps", "pos", "line", "_initial", "_fault"]
    want = sorted(map(str, repair.repair(df).collect()))
    assert sorted(map(str, repair.repair(df.select("*", *[F.lit(1).alias(n) for n in names])).collect())) == want
    assert repair.repair(spark.createDataFrame([], CONV)).count() == 0
    gone = next(c for c in itertools.count() if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = repair.repair(spark.createDataFrame([(gone, 0, "user", "Hi.")], CONV)).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_search_opens_few_nodes_and_breaks_ties_by_audit():
    assert repair.cheapest("") == (0, "")
    assert repair.cheapest("sua") == (0, "KKK")
    assert repair.cheapest("u") == (2, "D")
    assert repair.cheapest("uu") == (1, "KR")
    assert repair.cheapest("au") == (2, "RR")
    assert repair.cheapest("uUa") == (2, "KDK")
    assert repair.cheapest("ua" * 300) == (0, "KK" * 300)


@pytest.mark.parametrize("name, table", [("op11_conversation_repair", "conversations"), ("op13_centroids", "embeddings")])
def test_sql(spark, name, table):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, sf).toPandas()[list(want.columns)]
    assert len(got) > 0 and sorted(map(str, got.itertuples(index=False))) == sorted(map(str, want.itertuples(index=False)))


def brute_clusters(rows, dims, clusters, rounds):
    """Lloyd's rounds in Python integers."""
    kept = [(i, [Fraction(x) * 1024 // 1 for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:clusters]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for r in range(rounds + 1):
        which = [min(range(len(centres)), key=lambda k: (far(v, centres[k]), k)) for _, v in kept]
        if r < rounds:
            for k in range(len(centres)):
                own = [v for (_, v), w in zip(kept, which, strict=True) if w == k]
                centres[k] = [sum(x) // len(own) for x in zip(*own, strict=True)] if own else centres[k]
    d = [far(v, centres[w]) for (_, v), w in zip(kept, which, strict=True)]
    return [(i, w, min(x, 2**63 - 1), min(sum(y for y, z in zip(d, which, strict=True) if z == w), 2**63 - 1), min(sum(d), 2**63 - 1), hashlib.sha256(",".join(map(str, centres[w])).encode()).hexdigest()) for (i, _), w, x in zip(kept, which, d, strict=True)]


VEC = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("size", [1.0, 3e4, 1e9, 1e200])
def test_clusters_match_brute_force(spark, size):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.integers(-9, 9, 6) * size / 8], 0) for i in range(150)]
    rows += [(500, rows[0][1], 1), (501, rows[0][1], 1), (501, rows[0][1], 1), (None, rows[3][1], 0), (600, None, 0), (601, [1.0] * 5, 0), (602, [1.0] * 7, 0), (603, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (604, [float("nan")] * 6, 0), (605, [float("inf")] * 6, 0), (606, [], 0)]
    df = spark.createDataFrame(rows, VEC).repartition(4)
    got = centroids.cluster(df, dims=6, clusters=5, rounds=4).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_clusters([r[:2] for r in rows], 6, 5, 4)))


def test_cluster_odd_tables(spark):
    from pyspark.sql import functions as F

    rows = [(i, [float(i % 3), 0.0], 1) for i in range(5)]
    df = spark.createDataFrame(rows, VEC)
    want = sorted(map(str, brute_clusters([r[:2] for r in rows], 2, 8, 10)))
    assert sorted(map(str, map(tuple, centroids.cluster(df.select("*", *[F.lit(1).alias(c) for c in ("_id", "_v", "k", "cluster", "inertia")]), dims=2).collect()))) == want
    assert centroids.cluster(spark.createDataFrame([], VEC)).count() == 0


def test_screening_keeps_the_nearest():
    rng = np.random.default_rng(9)
    for size in (3, 1000, 1 << 23, 1 << 27):
        points, centres = rng.integers(-size, size, (300, 64)), rng.integers(-size, size, (8, 64))
        points[:20] = centres[rng.integers(0, 8, 20)]
        centres[7] = centres[2]  # ties
        can = centroids.screened(points, centres)
        exact = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(p, c, strict=True)) for c in centres] for p in points], dtype=object)
        least = exact.min(axis=1)
        assert all(can[i, k] for i in range(300) for k in range(8) if exact[i, k] == least[i])
        assert can.sum() < 300 * 3
        assert (centroids.nearest(points, centres.tolist()) == np.array([min(range(8), key=lambda k: (r[k], k)) for r in exact])).all()
