"""Files read in byte ranges give the same rows as files read whole."""

from __future__ import annotations

import json
import random
import struct

import pytest

from faultline.sources import splits


def nested(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind < 4:
        return rng.choice([1, -2.5, None, True, 'a "quoted" {brace}', "back\\slash\\\\", "]}{[", "é漢😀", "", '\\"', "x" * rng.randrange(60)])
    if kind == 4:
        return [nested(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["k", 'q"', "{", "\\"]) + str(i): nested(rng, depth + 1) for i in range(rng.randrange(4))}


@pytest.mark.parametrize("size", [5, 64, 1000, 1 << 20])
def test_json_lists_in_ranges(spark, tmp_path, size):
    rng = random.Random(4)
    items = [{"a": i, "b": nested(rng)} for i in range(20 if size < 7 else 120)] + [[1, {"x": 2}], {}, []]
    (tmp_path / "one.json").write_text(json.dumps(items), encoding="utf-8")
    (tmp_path / "two.json").write_text(" \n" + json.dumps(items[:9] + [5, "text [", None], indent=3, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "none.json").write_text("[]")
    (tmp_path / "empty.json").write_text("")
    rows = splits.json_elements(spark, f"{tmp_path}/*.json", size).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.file, r["at"])):
        by.setdefault(r.file.rpartition("/")[2], []).append(json.loads(r.value))
    assert by == {"one.json": items, "two.json": items[:9]}
    if size > 7:
        got = sorted((r.position, r.a) for r in splits.json_list(spark, f"{tmp_path}/one.json", "a long", size).collect())
        assert got == list(enumerate([*range(120), None, None, None]))


def test_json_list_that_breaks_off(spark, tmp_path):
    (tmp_path / "cut.json").write_text('[{"a": 1}, {"a": [1, 2')
    with pytest.raises(Exception, match="does not end"):
        splits.json_elements(spark, f"{tmp_path}/cut.json", 8).collect()


@pytest.mark.parametrize("size", [16, 100, 1 << 20])
def test_register_records_in_ranges(spark, tmp_path, size):
    rng = random.Random(5)
    records = [(rng.getrandbits(62), rng.getrandbits(32), rng.getrandbits(31), rng.random() < 0.5) for _ in range(200)]
    head = splits.MAGIC + struct.pack("<HHII", 1, 16, 1, 0)
    (tmp_path / "r.bin").write_bytes(head + b"".join(struct.pack("<QII", c, t, r | (w << 31)) for c, t, r, w in records))
    (tmp_path / "none.bin").write_bytes(head)
    got = splits.register_records(spark, f"{tmp_path}/*.bin", size).collect()
    assert sorted((r.position, r.cycle, r.thread, r.register, r.is_write) for r in got) == [(i, *r) for i, r in enumerate(records)]
    (tmp_path / "bad.txt").write_bytes(b"x" * 64)
    with pytest.raises(Exception, match="no register trace"):
        splits.register_records(spark, f"{tmp_path}/bad.txt", size).collect()
