"""Mixing, sharding, packing, media, classifiers, language model and the pipeline."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Row

from faultline.llm import langid, lm, lm_score, media, mixing, packing, sharding, toxicity

from .conftest import SCHEMA, sentence

SIZE = re.compile(r"[^\x20\x09-\x0D]+")


def size_of(text):
    return len(SIZE.findall(text or ""))


def targets_brute(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, fixed, total = {}, set(), sum(sizes.values())
    while len(fixed) < len(names):
        left = total - sum(target[s] for s in fixed)
        open_ = [s for s in names if s not in fixed]
        whole = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / whole >= 3 * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / whole for s in open_}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            fixed.add(s)
    return target


def mix_brute(rows, want):
    """Complete epochs, then document by document in key order whatever still fits."""
    sizes, drawn = defaultdict(int), defaultdict(list)
    for doc_id, text, _, source, _ in rows:
        text, n = text or "", size_of(text)
        sizes[source] += n
        u = (int(hashlib.md5(f"11:{doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        drawn[source].append((-math.log(u) / (math.exp(-abs(len(text) / max(n, 1) - 6.5) / 6.5) * 0.95 + 0.05), n, doc_id))
    out = []
    for source, docs in drawn.items():
        epochs = math.floor(want[source] / sizes[source] + 1e-9) if sizes[source] else 0
        room = round(want[source] - epochs * sizes[source], 6)
        for _, n, doc_id in sorted(docs):
            fits = n <= room
            room -= n * fits
            out.append(Row(doc_id=doc_id, source=source, size=n, source_size=sizes[source], target=want[source], taken=n * (epochs + fits)))
    return out


def test_mix(odd, odd_rows):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(odd_rows)
    sizes = defaultdict(int)
    for r in odd_rows:
        sizes[r[3]] += size_of(r[1])
    want = targets_brute(sizes)
    taken = defaultdict(int)
    for r in rows:
        assert r["size"] == size_of(next(x[1] for x in odd_rows if x[0] == r.doc_id)) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source]) and r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[r.source] += r.taken
    assert sorted(map(str, rows)) == sorted(map(str, mix_brute(odd_rows, want)))
    for s in sizes:
        left = [r["size"] for r in rows if r.source == s and r["size"] and r.taken < 3 * r["size"] and r.taken <= want[s] // max(sizes[s], 1) * r["size"]]
        assert 0 <= want[s] - taken[s] < min(left, default=2)
    again = mixing.mix(odd.repartition(2)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mix_in_bins(odd, odd_rows, monkeypatch):
    """Few bins of keys, refined down to single documents, give the same mixture."""
    want = sorted(map(str, mixing.mix(odd).collect()))
    monkeypatch.setattr(mixing, "PER_RANGE", 1)
    monkeypatch.setattr(mixing, "BINS", 3)
    assert sorted(map(str, mixing.mix(odd).collect())) == want


def test_mix_without_words(spark):
    """A source without words is never taken."""
    df = spark.createDataFrame([(1, " ", "en", "a", 1), (2, None, "en", "a", 0), (3, "one two three", "en", "b", 0), (4, "four", "en", "b", 0)], SCHEMA)
    assert {r.doc_id: (r.taken, r.target) for r in mixing.mix(df).collect()} == {1: (0, 0.0), 2: (0, 0.0), 3: (3, 4.0), 4: (1, 4.0)}
    assert sorted(r.doc_id for r in mixing.mixed(df).collect()) == [3, 4]


def test_mix_odd_tables(empty, clashing):
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    out = mixing.mixed(clashing)
    assert out.columns == clashing.columns
    want = {(r.doc_id, r.taken // max(r["size"], 1)) for r in mixing.mix(clashing).collect() if r.taken}
    got = Counter(r.doc_id for r in out.collect() if size_of(r.text))
    for doc_id, times in want:
        assert got[doc_id] >= times


def test_water_filling(spark):
    rng = random.Random(1)
    for _ in range(3):
        sizes = {f"s{i}": rng.choice([0, 1, 5, 100, 3000]) for i in range(9)} | {None: 50}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = targets_brute(sizes)
        assert got == pytest.approx(want)


def test_shard(odd, odd_rows):
    rows = sharding.shard(odd).collect()
    assert len(rows) == len(odd_rows)
    slots, of, weight = defaultdict(list), defaultdict(set), Counter()
    text = {r[0]: r[1] or "" for r in odd_rows}
    for r in rows:
        data = text[r.doc_id].encode()
        assert r["size"] == len(data) + 1 and r.text_crc32 == zlib.crc32(data) and 0 <= r.shard < 16 and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        of[text[r.doc_id]].add(r.shard)
        weight[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of.values())


def test_shards_are_near_equal(spark):
    rng = random.Random(8)
    rows = [(i, sentence(rng, rng.randrange(5, 60)), rng.choice(["en", "de"]), rng.choice("abc"), 0) for i in range(1500)]
    got = Counter()
    for r in sharding.shard(spark.createDataFrame(rows, SCHEMA)).collect():
        got[r.shard] += r["size"]
    mean = sum(got.values()) / 16
    assert len(got) == 16 and max(got.values()) < 1.05 * mean and min(got.values()) > 0.95 * mean


def tree_brute(rows, shards):
    """The same k-d tree over atoms in memory: {text: shard}."""
    rank = lambda k: {v: i / len({r[k] for r in rows if r[k] is not None}) for i, v in enumerate(sorted({r[k] for r in rows if r[k] is not None}))}
    source, lang, atoms = rank(3), rank(2), {}
    for _, text, la, so, _ in rows:
        x = atoms.setdefault(text, [0, "~", "~"])
        x[0], x[1], x[2] = x[0] + len(text.encode()) + 1, min(x[1], so), min(x[2], la)
    scaled = lambda v: min(int(v * 2**24), 2**24 - 1)
    points = []
    for text, (weight, so, la) in atoms.items():
        low = sharding_hash(text)
        size = round(math.log2(len(text.encode()) + 2) / 40, 9)
        points.append((weight, *[(scaled(v) << 36) + low for v in (source[so], lang[la], size)], text))
    root = [max(p[k] for p in points) + 1 - min(p[k] for p in points) for k in (1, 2, 3)]
    out = {}

    def split(points, first, n):
        if n == 1:
            out.update({p[4]: first for p in points})
            return
        wide = [(max(p[k] for p in points) + 1 - min(p[k] for p in points)) / root[k - 1] for k in (1, 2, 3)]
        k = wide.index(max(wide)) + 1
        points = sorted(points, key=lambda p: p[k])
        goal, run = sum(p[0] for p in points) * (n // 2) / n, 0
        for i, p in enumerate(points):
            if run + p[0] >= goal:
                cut = i if abs(run - goal) <= abs(run + p[0] - goal) else i + 1
                break
            run += p[0]
        split(points[:cut], first, n // 2)
        split(points[cut:], first + n // 2, n - n // 2)

    split(points, 0, shards)
    return out


def sharding_hash(text):
    """36 bits of a text's hash, as the operator breaks ties with it."""
    return int(hashlib.md5(text.encode()).hexdigest()[:9], 16)


def test_shard_is_the_tree(spark):
    rng = random.Random(12)
    rows = [(i, sentence(rng, rng.randrange(5, 60)), rng.choice(["en", "de", "fr"]), rng.choice(["src1", "src10", "src2", "zz"]), 0) for i in range(600)]
    rows += [(1000 + i, *rows[i][1:]) for i in range(40)]
    want = tree_brute(rows, 16)
    got = {r.doc_id: r.shard for r in sharding.shard(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {r[0]: want[r[1]] for r in rows}


def test_shard_odd_tables(empty, clashing):
    assert sharding.shard(empty).count() == 0
    assert sharding.shard(clashing).count() == clashing.count()


@pytest.mark.parametrize("seed", range(6))
def test_boundaries_are_optimal(seed):
    rng = random.Random(seed)
    histogram = {rng.randrange(1, 40): rng.randrange(1, 9) for _ in range(9)}
    lengths, k = sorted(histogram), 3

    def padding(edges):
        return sum(n * (min(e for e in edges if e >= x) - x) for x, n in histogram.items())

    want = min(padding([*c, lengths[-1]]) for r in range(k) for c in itertools.combinations(lengths[:-1], r))
    got = packing.boundaries(histogram, k)
    assert padding(got) == want and len(got) <= k and got == sorted(got)
    assert packing.boundaries({}, k) == []


def test_pack(odd, odd_rows):
    rows = packing.pack(odd, max_len=100, buckets=4, budget=1000).collect()
    lengths = Counter()
    for r in rows:
        assert 1 <= r.n_tokens <= r.padded_len <= 100 and r.start == r.piece * 100
        lengths[r.doc_id] += r.n_tokens
    times = Counter(r[0] for r in odd_rows)
    assert lengths == {r[0]: times[r[0]] * (size_of(r[1]) + 1) for r in odd_rows}
    batches = defaultdict(list)
    for r in rows:
        batches[r.bucket, r.batch_id].append(r)
    for b in batches.values():
        assert sorted(r.position for r in b) == list(range(len(b))) and len(b) * b[0].padded_len <= 1000
    for bucket in {k for k, _ in batches}:
        ids = sorted(i for k, i in batches if k == bucket)
        assert ids == list(range(len(ids))) and len({len(batches[bucket, i]) for i in ids[:-1]}) <= 1


def test_pack_odd_tables(empty, clashing):
    assert packing.pack(empty).count() == 0
    assert packing.pack(clashing).count() >= clashing.count()


def test_media_round_trip():
    rng = random.Random(1)
    for n in (0, 1, 63, 64, 1024, 1025, 4096, 50_000):
        data = bytes(rng.randrange(256) for _ in range(n))
        stored = media.write_media(data)
        info = media.read_media(stored)
        assert media.payload(stored, info) == data
        assert info["codec"] == "raw" and info["duration"] == info["ticks"] == n and len(info["sizes"]) == -(-n // media.BLOCK)
        kinds = [p for p, _, _ in media.boxes(memoryview(stored))]
        assert kinds[0] == b"ftyp" and b"moov/trak/mdia/minf/stbl/stsz" in kinds and kinds[-1] == b"mdat"
        for k in info["keys"]:
            o, s = info["offsets"][k], info["sizes"][k]
            assert stored[o : o + s] == data[k * media.BLOCK : k * media.BLOCK + s]


def track(kind, samples, keys, at):
    """A track of given samples, all in one chunk at ``at``; key frames only where ``keys`` is given."""
    box, full = media._box, media._full
    words = lambda *n: b"".join(x.to_bytes(4, "big") for x in n)
    sync = [full(b"stss", words(len(keys), *keys))] if keys else []
    tables = box(
        b"stbl", full(b"stsd", words(1), box(kind, bytes(8))), full(b"stts", words(1, len(samples), 1)), *sync, full(b"stsc", words(1, 1, max(len(samples), 1), 1)),
        full(b"stsz", words(0, len(samples), *map(len, samples))), full(b"stco", words(1, at)),
    )
    return box(b"trak", box(b"mdia", full(b"mdhd", words(0, 0, 1000, len(samples)), bytes(4)), box(b"minf", tables)))


def test_media_with_several_tracks():
    """Tables are those of one track: the first with samples, whatever the others hold."""
    audio, video = [b"aa", b"bbb", b"c"], [b"%02d" % i for i in range(30)]
    for tracks, codec, n, keys in ((["sowt", "avc1"], "sowt", 3, 3), (["none", "avc1", "sowt"], "avc1", 30, 2)):
        made = {"sowt": (b"sowt", audio, ()), "avc1": (b"avc1", video, (1, 25)), "none": (b"text", [], ())}
        data = media._box(b"ftyp", b"isom") + media._box(b"moov", *[track(*made[t], 1000) for t in tracks])
        info = media.read_media(data)
        assert (info["codec"], len(info["sizes"]), len(info["keys"]), info["offsets"][0]) == (codec, n, keys, 1000)
        assert info["offsets"][info["keys"]].tolist() == [1000 + sum(map(len, dict(sowt=audio, avc1=video)[codec][:k])) for k in info["keys"]]


def test_media_compact_sizes():
    words = lambda *n: b"".join(x.to_bytes(4, "big") for x in n)
    for bits, data in ((4, b"\x12\x30"), (8, bytes([1, 2, 3])), (16, bytes([0, 1, 0, 2, 0, 3]))):
        body = words(0, bits, 3) + data
        assert media._sizes(memoryview(body), {b"stz2": (0, len(body))}).tolist() == [1, 2, 3]


def test_media_digest(spark, odd, odd_rows, empty, clashing):
    rows = {r.doc_id: r for r in media.media_digest(odd).collect()}
    for doc_id, text, *_ in odd_rows:
        data = (text or "").encode()
        padded = data + bytes(-len(data) % 64 or (0 if data else 64))
        r = rows[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.media_sha256 == hashlib.sha256(media.write_media(padded)).hexdigest() and r.duration == len(padded) / media.RATE
    assert media.media_digest(empty).count() == 0 and media.media_digest(clashing).count() == clashing.count()
    df = spark.createDataFrame([(1, bytearray(media.write_media(b"abc" * 900))), (2, bytearray(b"junk")), (3, None)], "id long, media binary")
    got = {r.id: r for r in media.describe_media(df, "id", "media").collect()}
    assert got[1].codec == "raw" and got[1].key_lengths == [1024] and got[2].codec is None and got[3].duration is None


BAD = ["gronk", "zarf", "blick", "idiot"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        text = sentence(rng, rng.randrange(20, 90)).split()
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(BAD) + rng.choice(["", "aa", "bo", "cu"]))
        rows.append((i, " ".join(text), "en", "a", 0))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, SCHEMA).cache()
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache(), {i: t for i, _, t in labels}


def test_toxicity_held_out(labelled):
    docs, labels, truth = labelled
    rows = toxicity.score(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    again = {r.doc_id: r.score for r in toxicity.score(docs.repartition(7), labels).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in rows)
    kept = {r.doc_id for r in toxicity.keep_clean(docs, labels).collect()}
    assert kept == {r.doc_id for r in rows if r.score < 0.7}


def test_toxicity_voters_do_not_know_their_labels(labelled, monkeypatch):
    """A row's lexicons come from other rows: a word that only one row has never votes on it."""
    docs, labels, _ = labelled
    seen = []
    monkeypatch.setattr(toxicity, "_chosen", lambda sums, but, bad, good, f=toxicity._chosen: seen.append((but, bad, good)) or f(sums, but, bad, good))
    toxicity.train(docs, labels)
    assert [x[0] for x in seen] == [None, 0, 1, 2, 3]
    assert sum(seen[0][1] - x[1] for x in seen[1:]) == seen[0][1] and sum(seen[0][2] - x[2] for x in seen[1:]) == seen[0][2]


def test_toxicity_odd_tables(spark, odd, empty, clashing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(100 + i, 1, i % 2) for i in range(20)] + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(odd, none).collect()} <= {0.0, 1 / (1 + math.exp(30))}
    assert toxicity.score(empty, some).count() == 0 and toxicity.score(odd, some).count() == odd.count()
    assert toxicity.keep_clean(clashing, none).count() == clashing.count()


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.3
    accuracy = [0.95, 0.9, 0.8, 0.6, 0.9]
    votes = np.stack([np.where(rng.random(4000) < a, y, ~y).astype(int) for a in accuracy] + [np.full(4000, 2)], 1)
    votes[:, 4] = votes[:, 0]  # a copy of the first voter
    start = (votes[:, :4].sum(1) >= 2).astype(float)
    post, rates, weight = toxicity.label_model(votes, 0.3, start)
    assert ((post > 0.5) == y).mean() > 0.95
    assert abs(rates[1, 1, 1] - 0.9) < 0.05 and abs(rates[3, 1, 1] - 0.6) < 0.07
    assert weight[0] == pytest.approx(weight[4]) and weight[0] < weight[1:4].min()


def test_label_model_mends_noisy_labels():
    """Where one label in eight is wrong, the posterior is nearer to the truth than the labels are, and so is a classifier trained on it."""
    rng = np.random.default_rng(8)
    n, words_ = 3000, 60
    truth = rng.random(n) < 0.25
    marked = np.where(rng.random(n) < 0.125, ~truth, truth).astype(int)
    has = rng.random((n, words_)) < np.where(truth[:, None], 0.12, 0.015)  # words that are more frequent in toxic rows
    votes = np.full((n, toxicity.LEXICONS + toxicity.KINDS + 5), 2)
    for k in range(12):
        votes[:, k] = np.where(has[:, 5 * k : 5 * k + 5].any(1), 1, 2)
    for k in range(toxicity.KINDS):
        hits = has[:, 10 * k : 10 * k + 10].sum(1)
        votes[:, toxicity.LEXICONS + k] = np.where(hits >= 2, 1, np.where(hits == 0, 0, 2))
    post = toxicity.posterior(votes, marked)
    assert ((post > 0.5) == truth).mean() > (marked == truth).mean() + 0.04
    train, test = np.arange(n) < 600, np.arange(n) >= 600
    of, at = np.nonzero(has)

    def accuracy(y):
        kept = train[of]
        w, b = toxicity.regression(of[kept], at[kept], 600, words_, y[train])
        return ((np.bincount(of, w[at], n) + b > np.log(0.7 / 0.3))[test] == truth[test]).mean()

    assert accuracy(post) > accuracy(marked.astype(float))


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(9)
    parts = {"aa": ["kor", "mel", "tin", "sa", "vu"], "bb": ["zhe", "pro", "ski", "na", "ly"], "cc": ["ough", "eau", "ette", "ille", "que"]}
    rows = []
    for i in range(450):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(8, 120))), lang, "a", 0))
    rows += [(1000, None, "aa", "a", 0), (1001, "123 !!", "bb", "a", 0), (1002, "", None, "a", 0), (None, "kormel tinsa", None, None, 0)]
    return spark.createDataFrame(rows, SCHEMA).cache()


def test_language_held_out(tongues, empty, clashing):
    truth = {r.doc_id: r.lang for r in tongues.collect()}
    rows = langid.identify(tongues).collect()
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert len(rows) == len(truth) and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95
    by = {r.doc_id: r for r in rows}
    assert by[1000].lang_pred == by[1001].lang_pred == by[1002].lang_pred == "und" and by[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in rows)
    assert langid.identify(empty).count() == 0
    assert langid.identify(clashing).count() == clashing.count()


def test_language_dictionaries_are_whole_texts(tongues, monkeypatch):
    """Texts are learned whole or not at all; a language that has none short enough teaches with its shortest."""
    monkeypatch.setattr(langid, "DICTIONARY", 900)
    found = langid.dictionaries(tongues, "doc_id", "text", "lang")
    texts = {k: [r.text for r in tongues.collect() if r.lang == k and r.text] for k in ("aa", "bb", "cc")}
    assert set(found) == set(texts) and all(len(d) <= 900 for d in found.values())
    for k, d in found.items():
        left = d.decode()
        for t in sorted(texts[k], key=len, reverse=True):
            left = left.replace(t, "", 1)
        assert not left.strip()
    monkeypatch.setattr(langid, "DICTIONARY", 5)
    assert {k: d.decode() for k, d in langid.dictionaries(tongues.where("length(text) > 20"), "doc_id", "text", "lang").items()}.keys() == texts.keys()


def test_gradients():
    rng = np.random.default_rng(0)
    rows = 12
    p = {k: v.astype(np.float64) for k, v in lm.fresh(rows).items()}
    prior = rng.normal(size=(rows, lm.CLASSES))
    x, y, weight = rng.integers(0, rows, (4, lm.BLOCK)), rng.integers(0, lm.CLASSES, (3, lm.BLOCK)), (rng.random((3, lm.BLOCK)) < 0.8).astype(float)
    _, g, at = lm.gradients(p, x, y, weight, prior)
    table = np.zeros_like(p["table"])
    table[at] = g["table"]
    g["table"] = table
    for k in p:
        for at in [tuple(rng.integers(0, n) for n in p[k].shape) for _ in range(12)]:
            step = 1e-5
            q = {name: v.copy() for name, v in p.items()}
            q[k][at] += step
            up, *_ = lm.gradients(q, x, y, weight, prior)
            q[k][at] -= 2 * step
            down, *_ = lm.gradients(q, x, y, weight, prior)
            assert g[k][at] == pytest.approx((up - down) / 2 / step, rel=2e-3, abs=2e-6), k


def test_powers():
    """Positive, increasing, and within 6.2 % of exp over all that it takes."""
    x = np.linspace(-79, 79, 100_001).astype(np.float32)
    got = lm.powers(x.copy())
    assert (got > 0).all() and (np.diff(got) >= 0).all() and (np.abs(got / np.exp(x.astype(np.float64)) - 1) < 0.062).all()
    assert np.isfinite(lm.powers(np.array([-1e30, 1e30], np.float32))).all()


def _attention_brute(p, prior, inputs, y, b, i):
    """log10 probability of class ``y`` after place i of block b, by loops over the tokens before it."""
    own, past, t = inputs[b], inputs[b - 1], p["table"]
    query = t[own[i], lm.QUERY]
    seen = [(past[j], lm.BLOCK + i - j) for j in range(lm.BLOCK)] + [(own[j], i - j) for j in range(i + 1)]
    weight = [math.exp(query @ t[x, lm.KEY] + p["far"][d]) for x, d in seen]
    h = sum(w * t[x, lm.VALUE] for w, (x, _) in zip(weight, seen, strict=True)) / sum(weight)
    h = h + t[own[i], lm.LAST] + t[own[i - 1] if i else past[-1], lm.BEFORE]
    h = h + np.maximum(h @ p["w1"] + p["b1"], 0) @ p["w2"]
    logits = h @ p["out"] + p["bias"] + prior[own[i]]
    return (logits[y] - math.log(sum(math.exp(x) for x in logits))) / math.log(10)


def test_scores_against_loops():
    """Every token is scored once, with the tokens of its block before it and all of the block before as context."""
    rng = np.random.default_rng(3)
    p = {k: v.astype(np.float64) for k, v in lm.fresh(20).items()}
    prior = rng.normal(size=(20, lm.CLASSES))
    sizes = [40, 0, 1, 16, 17, 95]
    first = np.concatenate([[0], np.cumsum(sizes)])
    tokens, cls = rng.integers(0, 18, first[-1]), rng.integers(0, lm.CLASSES, first[-1])
    inputs, real, place = lm.blocks_of(tokens, first, 19)
    classes = np.zeros(inputs.size, np.int64)
    classes[place] = cls
    got = lm.log10_classes(p, prior, inputs, classes.reshape(inputs.shape), real, 3).ravel()[place]
    want = [_attention_brute(p, prior, inputs, c, *divmod(at, lm.BLOCK)) for c, at in zip(cls, place.tolist(), strict=True)]
    assert np.allclose(got, want, atol=1e-9)
    for n, (a, b) in enumerate(itertools.pairwise(first)):  # what a text's tokens see is the text itself, after starts
        assert inputs.ravel()[place[a:b]].tolist() == [19, *tokens[a:b]][: b - a], n


def test_attention_learns_what_pairs_cannot():
    """Each token repeats the one eight before it: counts of pairs tell nothing, attention tells much."""
    rng = np.random.default_rng(4)
    tokens = np.concatenate([np.tile(rng.integers(0, 24, 8), 20) for _ in range(400)])
    inputs, real, place = lm.blocks_of(tokens, np.arange(0, len(tokens) + 1, 160), 25)
    classes, weight = np.zeros(inputs.size, np.int64), np.zeros(inputs.size)
    classes[place], weight[place] = tokens, 1
    classes, weight = classes.reshape(inputs.shape), weight.reshape(inputs.shape)
    prior = lm.prior_of(np.eye(lm.CLASSES)[:24].sum(0) * np.ones((26, 1)) * 100)
    trainer = lm.Trainer(lm.fresh(26), prior)
    for _ in range(6):
        trainer.feed(inputs, classes, weight)
    mean = lambda p: lm.log10_classes(p, prior, inputs, classes, real).ravel()[place].mean()
    blind = {k: v.copy() for k, v in trainer.p.items()}
    blind["table"][:, lm.VALUE] = 0
    assert mean(trainer.p) > -0.75 and mean(trainer.p) > mean(blind) + 0.4 and -math.log10(24) - 0.05 < mean(lm.fresh(26)) < -1.3


def test_attention_is_causal():
    """A token's score does not depend on what follows."""
    rng = np.random.default_rng(1)
    p, prior = lm.fresh(20), rng.normal(size=(20, lm.CLASSES)).astype(np.float32)
    a = rng.integers(0, 18, 90)
    b = a.copy()
    b[60:] = rng.integers(0, 18, 30)
    cls = rng.integers(0, lm.CLASSES, 90)

    def scores(tokens):
        rows, real, place = lm.blocks_of(tokens, np.array([0, 90]), 19)
        classes = np.zeros(rows.size, np.int64)
        classes[place] = cls
        return lm.log10_classes(p, prior, rows, classes.reshape(rows.shape), real).ravel()[place]

    x, y = scores(a), scores(b)
    assert np.allclose(x[:61], y[:61], atol=1e-6) and not np.allclose(x[61:], y[61:], atol=1e-3)


def base_brute(rows):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    tokens = [[*SIZE.findall((r[1] or "").translate(low)), None] for r in rows]
    held = [zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in rows]
    c = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return [(r[0], h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for r, t, h in zip(rows, tokens, held, strict=True)]


@pytest.mark.parametrize("heavy", [1_000_000, 20])
def test_lm_base(odd, odd_rows, monkeypatch, heavy):
    """The base score is exact, with and without rare words joined apart."""
    monkeypatch.setattr(lm_score, "HEAVY", heavy)
    rows = sorted(lm_score.score(odd, rounds=1).collect(), key=lambda r: (r.doc_id, r.base_score))
    want = sorted(base_brute(odd_rows), key=lambda r: (r[0], r[5]))
    for r, w in zip(rows, want, strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:5] and r.base_score == pytest.approx(w[5])
        assert r.score < 0


def test_lm_is_a_distribution():
    """Classes sum to one, and so do the shares of the ids within a class, after any id."""
    rng = np.random.default_rng(2)
    ids = 300
    counts = np.where(rng.random(ids) < 0.5, rng.integers(1, 500, ids), 0).astype(float)
    rows = lm.rows_of(counts)
    known = int(rows.max())
    cls, inside = lm.classes_of(counts, rows, rng.integers(0, 9, (known + 1, lm.SINGLES + 1)).astype(float))
    follow = rng.integers(0, 50, (known + 2, lm.CLASSES)).astype(float)
    pairs = np.unique(rng.integers(0, ids, 500) * lm_score.SHIFT + rng.integers(0, ids, 500))
    pairs = pairs[rows[pairs // lm_score.SHIFT] != known]
    times = rng.integers(1, 90, len(pairs)).astype(float)
    kept = np.zeros(follow.shape)
    np.add.at(kept, (rows[pairs // lm_score.SHIFT], cls[pairs % lm_score.SHIFT]), times)
    x = lm.Lexicon(rows, cls, inside, lm.prior_of(follow), pairs, times, kept)
    assert np.allclose(np.exp(x.prior).sum(1), 1, atol=1e-4)
    for before in rng.integers(0, ids, 30):
        share = 10 ** x.within(np.full(ids, before), np.arange(ids), x.counted(before * lm_score.SHIFT + np.arange(ids)))
        assert np.allclose(np.bincount(cls, share, lm.CLASSES)[np.unique(cls)], 1)


def test_lm_beats_the_base_on_held_out(spark):
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("an", "the", "or", "ing", "re", "ble") for b in ("st", "ou", "ed", "ly", "ti", "on")]
    rows = []
    for i in range(300):
        at, text = rng.randrange(36), []
        for _ in range(120):
            at = (5 * at + 1) % 36 if rng.random() < 0.8 else rng.randrange(36)
            text.append(vocabulary[at])
        rows.append((i, " ".join(text), "en", "a", 0))
    got = [r for r in lm_score.score(spark.createDataFrame(rows, SCHEMA), rounds=3).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_lm_keeps_rare_pairs(spark, monkeypatch):
    """Pairs that are joined apart count as those that are broadcast, also among ids that share a class."""
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = ["".join(rng.choice(letters) for _ in range(3)) for _ in range(600)]
    rows = [(i, " ".join(vocabulary[int(600 * rng.random() ** 2)] for _ in range(100)), "en", "a", 0) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    scores = lambda: {r.doc_id: r.score for r in lm_score.score(df, rounds=1).collect()}
    want = scores()
    monkeypatch.setattr(lm_score, "PAIRS", 200)
    assert scores() == pytest.approx(want, rel=1e-6)


def test_lm_trains_on_all_training_text(spark, monkeypatch):
    """Every training document reaches a trainer, also in a table of over a million words."""
    seen = {}

    def spied(training, ranks, lexicon, trainers, rounds):
        seen.update(ids={r._id for r in training.select("_id").collect()}, trainers=trainers)
        return lm.fresh(len(lexicon.value.prior))

    monkeypatch.setattr(lm_score, "_train", spied)
    df = spark.range(2500).selectExpr("id AS doc_id", "repeat(concat('w', id % 7, ' of '), 400) AS text")
    lm_score.score(df)
    held = {i for i in range(2500) if zlib.crc32(str(i).encode()) % 5 == 1}
    assert seen["ids"] == set(range(2500)) - held and seen["trainers"] == round(800 * len(seen["ids"]) / lm_score.TRAINER_WORDS)


def test_lm_odd_tables(empty, clashing):
    assert lm_score.score(empty).count() == 0
    assert lm_score.score(clashing, rounds=1).count() == clashing.count()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "mixing", "packing"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], sf).write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(s.columns == docs.columns for s in seen[:-1])
    ids = [Counter(r.doc_id for r in s.select("doc_id").collect()) for s in seen]
    assert all(set(b) <= set(a) for a, b in itertools.pairwise(ids))
    scored = {r.doc_id: r.score for r in toxicity.score(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert set(ids[1]) == {d for d, s in scored.items() if s < toxicity.THRESHOLD}
    norms = [re.sub(r"[\x20\x09-\x0D]", "", r.text) for r in seen[2].collect()]
    assert len(norms) == len(set(norms)) == len({re.sub(r"[\x20\x09-\x0D]", "", r.text) for r in seen[1].collect()})
    assert sum(r.n_tokens for r in seen[5].collect()) == sum(size_of(r.text) + 1 for r in seen[4].collect())
    assert corpus_pipeline.run(spark, sf).count() == seen[5].count()


@pytest.mark.parametrize("table", ["odd", "clashing", "empty"])
def test_pipeline_odd_tables(spark, tmp_path, request, table):
    """Nulls, empty texts, repeated rows, clashing columns and empty tables go through all stages."""
    import corpus_pipeline

    docs = request.getfixturevalue(table)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100 + i, 1, i % 2) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = seen
        stage(spark, before, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        seen = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert seen.columns == docs.columns
            assert {r.doc_id for r in seen.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
        if k == 1:
            norms = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in seen.collect()]
            assert len(norms) == len(set(norms))
    assert sum(r.n_tokens for r in seen.collect()) == sum(size_of(r.text) + 1 for r in before.collect())
