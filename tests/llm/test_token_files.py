"""Token files: exact round trips against the tokenizer itself."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from faultline.llm import queries, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(texts):
    """Ids by encoding whole texts."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [[*e.ids, token_files.END] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def digests(rows):
    """The result of rows (doc_id, text) in the order of files."""
    out, start = [], 0
    for (doc_id, _), ids in zip(rows, whole([t for _, t in rows]), strict=True):
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("sizes", [[], [0], [1, 2, 3], [255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1]])
def test_coding_round_trip(sizes):
    ranks = np.array(sizes, np.uint32)
    control, data = token_files.packed(ranks)
    assert len(control) == (len(sizes) + 3) // 4 and len(data) == sum(max(1, (x.bit_length() + 7) // 8) for x in sizes)
    assert token_files.unpacked(control, data, len(sizes)).tolist() == sizes


def test_blocks_round_trip_and_refuse_damage():
    rng = np.random.default_rng(2)
    ranks = (2 ** rng.uniform(0, 32, 5000)).astype(np.uint32)
    sizes = np.array([0, 4000, 1, 999])
    body = token_files.block([None, 5, -7, 2**60], sizes, ranks)
    doc_ids, got_sizes, got = token_files.parsed(body)
    assert (doc_ids, got_sizes.tolist(), got.tolist()) == ([None, 5, -7, 2**60], sizes.tolist(), ranks.tolist())
    for broken in (body[:-1], body[:100] + bytes([body[100] ^ 1]) + body[101:], b"x" + body[1:]):
        with pytest.raises(ValueError):
            token_files.parsed(broken)


def test_words_encode_as_in_their_text():
    rng = random.Random(1)
    parts = ["The", "the.", "THE,", "é,", "×,", "÷.", "a-.", "don't.", "J\u030c", "j\u030c!", "I\u0307.", "A\u030a,", "x>.", "1.", "ß?", "..", "ÿ:", "don't", "x'd", "(a)", "1,234", "É", "Å", "İstanbul", "漢字かな", "<|endoftext|>", "a<|startoftext|>b", "<|ENDOFTEXT|>", "😀👍🏽", "́", "...", "'s", "x" * 300]
    seps = [" ", "\n", "\t", "\x0b", "\x0c", "\r", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "​", "﻿", "  "]
    texts = ["".join(rng.choice(parts) + rng.choice(seps) for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "", " ", "\x1c"]
    for most in (400_000, 50, 0):
        coder = token_files.WordIds(PATH, most)
        got = []
        for i in range(0, len(texts), 19):
            ids, n = coder([(x or "").encode() for x in texts[i : i + 19]])
            got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert [[*g, token_files.END] for g in got] == whole(texts)


@pytest.mark.parametrize("most", [token_files.BLOCK, 50])
def test_files_round_trip(spark, odd_rows, most):
    from faultline.llm.token_files import read, write

    df = spark.createDataFrame([*odd_rows, (None, "no id", "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    manifest, ranks = write(df, PATH, most=most)
    got = sorted(read(manifest, ranks).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted([r[0] for r in odd_rows] + [None], key=lambda i: (i is not None, i or 0))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["ids"]) for r in got) == sorted(zip([r[0] for r in odd_rows] + [-1], whole([r[1] for r in odd_rows] + ["no id"]), strict=True))
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]))
        at += r["n_tokens"]
    files = manifest.agg({"ids": "sum", "docs": "sum"}).first()
    assert sorted(files) == sorted([at, len(got)])
    assert manifest.count() > 20 if most == 50 else manifest.count() <= 5


def test_pieces_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(token_files, "xxh64", lambda buf, start, end: (end - start).astype(np.uint64) // np.uint64(3))
    texts = ["one two six ten, a bb ccc dddd", "abcdefghijklmnop abcdefghijklmnoq abcdefgh abcdefgi, ten six", "x" * 40 + " " + "y" * 40, "ten"]
    coder = token_files.WordIds(PATH)
    for _ in range(2):
        ids, n = coder([t.encode() for t in texts])
        assert [[*x.tolist(), token_files.END] for x in np.split(ids, np.cumsum(n)[:-1])] == whole(texts)


def test_ranks_go_by_frequency(spark):
    df = spark.createDataFrame([(1, "b b b a a c"), (2, "b a")], "doc_id long, text string")
    _, ranks = token_files.write(df, PATH)
    a, b, c = (whole([x])[0][0] for x in "abc")
    assert np.frombuffer(token_files.get(ranks), "<u4").tolist() == [b, a, token_files.END, c]


def test_token_ids_of_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(map(tuple, queries.op12_token_ids(spark, sf).collect())) == digests(rows)


def test_token_ids_odd_tables(spark, odd, clashing, empty):
    n = odd.count()
    got = token_files.token_digest(odd, PATH).collect()
    assert len(got) == n and sum(r["n_tokens"] for r in got) == max(r["start"] + r["n_tokens"] for r in got)
    assert token_files.token_digest(clashing, PATH).count() == clashing.count()
    assert token_files.token_digest(empty, PATH).count() == 0
