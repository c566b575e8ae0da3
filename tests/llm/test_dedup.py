"""Exact and near deduplication and repeated passages against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from faultline import tables
from faultline.llm import exact_dedup, simhash, substring, textnum
from faultline.operators.components import components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall((text or "").encode().translate(LOWER))


def exact_brute(rows):
    groups = defaultdict(list)
    for i, (doc_id, text, *_) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id, i))
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda m: (m[0], m[1], m[2] if m[2] is not None else 0))
        kept = False
        for m in sorted(members, key=lambda m: m[3]):
            mine = not kept and m[:3] == best[:3]
            kept |= mine
            out.append((m[2], best[2], len(members), mine, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_groups(odd, odd_rows):
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(odd).collect()]
    assert sorted(got, key=str) == exact_brute(odd_rows)


@pytest.mark.parametrize("share", [0.0, 0.5])
def test_exact_groups_hot_and_not(odd, odd_rows, monkeypatch, share):
    """Hot digests are salted, the others are not; either way the result is the same."""
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", share)
    monkeypatch.setattr(tables, "HOT_SHARE", share)
    monkeypatch.setattr(exact_dedup, "SALTS", 2)
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(odd).collect()]
    assert sorted(got, key=str) == exact_brute(odd_rows)


def test_exact_groups_where_digests_collide(odd, odd_rows, monkeypatch):
    """Texts of one digest but different content are kept apart, by full comparison."""
    weak = lambda norm: F.concat(F.lit("x"), (F.length(norm) % 7).cast("string"))
    monkeypatch.setattr(exact_dedup, "_digest", weak)
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(odd).collect()]
    assert sorted(got, key=str) == sorted([x[:4] for x in exact_brute(odd_rows)], key=str)
    kept = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in exact_dedup.keep_exact(odd).collect()]
    assert len(kept) == len(set(kept)) == len({re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in odd_rows})


def test_exact_odd_tables(empty, clashing):
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.keep_exact(empty).count() == 0
    kept = exact_dedup.keep_exact(clashing)
    assert kept.columns == clashing.columns
    norms = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept.collect()]
    assert len(norms) == len(set(norms)) == clashing.select("text").rdd.map(lambda r: re.sub(r"[\x20\x09-\x0D]", "", r.text or "")).distinct().count()


def test_exact_plan_is_native(odd):
    plan = exact_dedup.exact_groups(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_words_and_hashes():
    texts = [b"", b"  A bC\t\nd  ", "Ünï cödé".encode(), b"x" * 100 + b" y", b"a  b"]
    w = textnum.words(texts)
    data = w.buf.tobytes()
    got = [[data[a:b] for a, b in zip(w.start[i:j], w.end[i:j], strict=True)] for i, j in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == [WORD.findall(t.translate(LOWER)) for t in texts]
    rng = random.Random(1)
    blob = bytes(rng.randrange(256) for _ in range(600))
    start = np.array([rng.randrange(500) for _ in range(400)])
    end = start + np.array([rng.randrange(60) for _ in range(400)])
    want = [xxhash.xxh64_intdigest(blob[a:b], 42) for a, b in zip(start, end, strict=True)]
    assert textnum.xxh64(np.frombuffer(blob, np.uint8), start, end).tolist() == want


def fingerprint_brute(text):
    w = words_of(text)
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def test_fingerprints():
    rng = random.Random(2)
    texts = [None, "", " ", "a", "a b", "a b c", "A B C d"] + [" ".join(rng.choice("abcdefg") * rng.randrange(1, 15) for _ in range(rng.randrange(1, 900))) for _ in range(40)]
    got = simhash.fingerprints([(t or "").encode() for t in texts])
    assert got.tolist() == [fingerprint_brute(t) for t in texts]


def test_links_against_all_pairs(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = set(base)
    for b in base:
        for d in (1, 2, 3, 4):
            flipped = b
            for i in rng.sample(range(64), d):
                flipped ^= 1 << i
            prints.add(flipped)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    df = spark.createDataFrame([(x,) for x in signed], "_fp long")
    got = {(r.a, r.b) for r in simhash.links(df).collect()}
    want = {(x, y) for i, x in enumerate(signed) for y in signed[i + 1 :] if ((x ^ y) & (1 << 64) - 1).bit_count() <= 3}
    assert got == want and want


def connected(nodes, edges):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = defaultdict(set)
    for x in nodes:
        groups[find(x)].add(x)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_dense_segments_connect_the_same(spark, monkeypatch, radius):
    """Where many fingerprints share a segment, fewer links connect what all pairs connect."""
    rng = random.Random(radius)
    monkeypatch.setattr(simhash, "DENSE", 4)
    prints = set()
    for _ in range(12):
        high, low = rng.getrandbits(32), rng.getrandbits(32)
        for _ in range(25):
            flips = rng.sample(range(32), rng.randrange(0, 5))
            x = low
            for i in flips:
                x ^= 1 << i
            y = high ^ (1 << rng.randrange(32) if rng.random() < 0.4 else 0)
            prints |= {y << 32 | x, x << 32 | y}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "_fp long"), radius).collect()]
    close = lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count() <= radius
    assert all(a < b and close(a, b) for a, b in got)
    assert connected(signed, got) == connected(signed, [(x, y) for i, x in enumerate(signed) for y in signed[i + 1 :] if close(x, y)])


def near_brute(rows):
    prints = [fingerprint_brute(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], f"{prints[i]:016x}", least.get(find(i))) for i, r in enumerate(rows)), key=str)


def test_near_groups(odd, odd_rows):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_groups(odd).collect()]
    assert sorted(got, key=str) == near_brute(odd_rows)


def test_near_odd_tables(empty, clashing):
    assert simhash.near_groups(empty).count() == 0 and simhash.keep_near(empty).count() == 0
    kept = simhash.keep_near(clashing)
    rows = kept.collect()
    assert kept.columns == clashing.columns and sum(r.doc_id is None for r in rows) == 1
    want = {c for _, _, c in near_brute([tuple(r)[:5] for r in clashing.collect() if r.doc_id is not None])}
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(want)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {n: find(n) for n in parent if any(n in e and e[0] != e[1] for e in edges)}


def test_centres_are_run_minima():
    rng = np.random.default_rng(1)
    for n, least in ((5, 3), (60, 7), (200, 46), (46, 46), (45, 46)):
        order = rng.permutation(n).astype(np.uint64) + np.uint64(1)
        first = np.array([0, n // 3, n])
        doc = np.repeat([0, 1], np.diff(first))
        c = substring.centres(order, doc, first, least)
        want = {first[d] + int(order[first[d] + i : first[d] + i + least].argmin()) + i for d in (0, 1) for i in range(first[d + 1] - first[d] - least + 1)}
        assert set(c.tolist()) == want
        lo, hi = substring.windows(order, doc, first, c)
        for x, a, b in zip(c, lo, hi, strict=True):
            assert order[a : b + 1].min() == order[x] and b - a + 1 >= least
            assert a == first[doc[x]] or order[a - 1] < order[x]
            assert b == first[doc[x] + 1] - 1 or order[b + 1] < order[x]


def test_blobs_keep_rows():
    rng = np.random.default_rng(2)
    rows = np.zeros(300, substring.ROW)
    for k in substring.ROW.names:
        rows[k] = rng.integers(0, 200, 300)
    back = substring.unpacked(memoryview(substring.packed(rows)))
    assert sorted(back.tolist()) == sorted(rows.tolist())


def exact_passages(rows, n=51):
    seen = defaultdict(set)
    for doc_id, text, *_ in rows:
        w = words_of(text)
        for i in range(len(w) - n + 1):
            seen[tuple(w[i : i + n])].add(doc_id)
    return [d for d in seen.values() if len(d) > 1]


def test_repeats(odd, odd_rows):
    got = substring.repeats(odd).collect()
    found = {r.doc_id for r in got} | {r.match_doc_id for r in got}
    assert {d for s in exact_passages(odd_rows) for d in s} <= found
    text = {r[0]: words_of(r[1]) for r in odd_rows}
    for r in got:
        a, b = text[r.match_doc_id][r.match_start : r.match_end], text[r.doc_id][r.start_word : r.end_word]
        p, q = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b))
        assert len(p & q) / len(p | q) >= 0.8 and r.n_words == len(b) >= 41
    assert {12, 13} <= found and not found & {1, 2, 3, 4, 5, 6, 8, 9, 10, 11}


def test_repeats_odd_tables(empty, clashing):
    assert substring.repeats(empty).count() == 0
    assert substring.repeats(clashing).count() > 0


def test_repeats_around_a_frequent_line(spark):
    """Two documents share 50 to 55 words that hold a line of 40 to 45 words which stands in many documents before them."""
    rng, rows, wanted = random.Random(6), [], set()
    some = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    for k in range(30):
        line, ahead, after = some(rng.choice([40, 45])), some(5), some(5)
        rows += [(k * 100 + i, " ".join(some(40) + line + some(40))) for i in range(6)]
        # in the last document of some groups the line stands alone before it stands in the passage
        rows += [(k * 100 + i, " ".join((some(30) + line if i == 51 and k % 3 == 0 else []) + some(50) + ahead + line + after + some(50))) for i in (50, 51)]
        wanted.add((k * 100 + 51, k * 100 + 50))
    got = {(r.doc_id, r.match_doc_id) for r in substring.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == wanted


def test_recall_of_edited_passages(spark):
    """Passages of 100 and 150 words with a word replaced every 50 are found in at least nine of ten cases."""
    rng, rows = random.Random(16), []
    some = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    for k in range(120):
        words = some(100 if k % 2 else 150)
        edited = [w if i % 50 != 25 else f"e{rng.randrange(10**9)}" for i, w in enumerate(words)]
        rows += [(2 * k, " ".join(some(60) + words + some(30))), (2 * k + 1, " ".join(some(45) + edited + some(70)))]
    got = {(r.match_doc_id, r.doc_id) for r in substring.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(a // 2 == b // 2 for a, b in got) and len(got) >= 0.9 * 120


def test_equal_texts_need_more_than_one_hash(monkeypatch):
    """Texts whose first 64 bits agree are no copies when the next 64 differ."""
    rows = np.zeros(3, substring.ROW)
    rows["key"], rows["doc"], rows["c"], rows["f"] = 7, [1, 2, 3], 90, substring.COPY
    rows["left"], rows["right"] = [5, 5, 6], [8, 8, 8]
    table = pa.table([pa.array([substring.packed(rows)], pa.binary())], names=["rows"])
    assert [(r["a"], r["b"]) for r in substring._links(table).to_pylist()] == [(1, 2)]


@pytest.mark.parametrize("edits", [0, 1, 3])
def test_passages(edits):
    rng = np.random.default_rng(edits)
    x, y = rng.integers(0, 1 << 30, 300), rng.integers(0, 1 << 30, 400)
    y[150:300] = x[100:250]
    for k in range(edits):
        y[170 + 40 * k : 173 + 40 * k] = -k - 1
    (i, j, k, m, likeness), *rest = substring.passages(x, y, 50)
    assert (i, j, k, m) == (100, 249, 150, 299) and not rest and likeness >= 0.8


def _longest_brute(x, y, shift):
    """Length in x of the longest part of similarity 0.8 and 46 shingles, where y is x with replaced words."""
    best, there = 0, [a == b for a, b in zip(x, y[shift:], strict=False)]
    for i in range(len(x)):
        p, q = set(), set()
        for j in range(i, len(x)):
            p.add(x[j])
            q.add(y[shift + j])
            if there[i] and there[j] and j - i + 1 >= max(46, best + 1) and len(p & q) / len(p | q) >= 0.8:
                best = j - i + 1
    return best


def _replaced(n, edits, seed):
    """Shingles of n random words, and of the same words with some replaced, with other text around."""
    rng = random.Random(seed)
    a = [rng.getrandbits(40) for _ in range(n)]
    b = [rng.getrandbits(40) if i in edits else v for i, v in enumerate(a)]
    head = [rng.getrandbits(40) for _ in range(30)]
    cut = lambda w: [hash(tuple(w[i : i + 5])) for i in range(len(w) - 4)]
    return cut(a), cut(head + b + head)


EDITS = [(80, [38, 39, 40]), (90, [42, 45]), (240, [*range(2, 40, 4), 50, 100, 150, 200]), *[(150, sorted(random.Random(s).sample(range(150), 3 + s % 9))) for s in range(30)]]


@pytest.mark.parametrize("n, edits", EDITS)
def test_passages_are_the_longest_alike(n, edits):
    x, y = _replaced(n, set(edits), n)
    found = substring.passages(np.array(x), np.array(y), 30)
    assert max((j - i + 1 for i, j, *_ in found), default=0) == _longest_brute(x, y, 30)
    assert all(r[4] >= 0.8 for r in found)
