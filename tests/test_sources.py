"""Readers and sinks on small files."""

from __future__ import annotations

import gzip
import json
import struct

import pytest
from pyspark.sql import functions as F

from faultline.plans import reports
from faultline.sources import sinks
from faultline.sources import text as T


def test_csv_rows_and_keys(spark, tmp_path):
    for app, row in (("A", "1,2,3"), ("B", "4,5,6")):
        d = tmp_path / "card" / app
        d.mkdir(parents=True)
        (d / f"result_{app}_2.csv").write_text(f"Masked,SDC,DUE\n{row}\n9,9,9\n")
    df = T.csv_rows(spark, f"{tmp_path}/card/*/*.csv", "Masked int, SDC int, DUE int", r"/([^/]+)/([^/]+)/result_\w+_(\d+)\.csv", ("arch", "app", "component"))
    assert sorted(map(tuple, df.collect())) == [(1, 2, 3, "card", "A", "2"), (4, 5, 6, "card", "B", "2")]


def test_lines_plain_and_gzip(spark, tmp_path):
    (tmp_path / "a.log").write_text("x: 1 2\ny\nx: 3 4\n")
    with gzip.open(tmp_path / "b.log.gz", "wt") as f:
        f.write("x: 7\n")
    log = T.lines(spark, f"{tmp_path}/*.log*")
    got = sorted((r.file, r.metric, r["sample"], r.position, r.value) for r in T.interval_log(log).collect())
    assert [g[1:] for g in got] == [("x", 0, 0, 1.0), ("x", 0, 1, 2.0), ("x", 1, 0, 3.0), ("x", 1, 1, 4.0), ("x", 0, 0, 7.0)]


def test_run_summary_and_outputs(spark, tmp_path):
    (tmp_path / "run.log").write_text("cycle = 5\nOUTPUT base=0x10 bytes=64 name=c\ncycle = 9\nSuccess\nOUTPUT base=32 bytes=4\n")
    log = T.lines(spark, f"{tmp_path}/run.log")
    r = T.run_summaries(log).first()
    assert (r.success, r.failed, r.last_cycle) == (True, False, 9)
    got = sorted((r.base, r.bytes, r.name or "") for r in T.outputs(log).collect())
    assert got == [(16, 64, "c"), (32, 4, "")]


def test_lines_over_splits(spark, tmp_path):
    """Line numbers run on over the splits of a file."""
    text = [f"line {i} " + "x" * (i % 90) for i in range(4000)]
    (tmp_path / "big.log").write_text("\r\n".join(text) + "\n")
    (tmp_path / "small.log").write_text("a\n\nb")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        log = T.lines(spark, f"{tmp_path}/*.log")
        assert spark.read.text(f"{tmp_path}/big.log").rdd.getNumPartitions() > 3
        rows = sorted((r.file.rpartition("/")[2], r.line, r.value) for r in log.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == [("big.log", i, t) for i, t in enumerate(text)] + [("small.log", 0, "a"), ("small.log", 1, ""), ("small.log", 2, "b")]


INJECTIONS = """head
[Run 1] Effects from /x/tmp.out1:
[L1D_FI_READER] a -> k1 PC=0x8 (a.cu:11) ld.global
[L1D_FI_WRITER] a -> k1 PC=0x8 (a.cu:10) st.global
[INJ_PARAMS] [Run 1] tmp.out1 bit=3
[Run 1] tmp.out1: SDC found
[L1D_FI_READER] a -> k1 PC=0x8 (a.cu:11) ld.global
[REG_FI_READER] a -> k2 PC=0x8 (b.cu:5) add
[INJ_PARAMS] [Run 1] tmp.out1 bit=4
[Run 1] tmp.out1: masked
[Run 2] Effects from tmp.out2: [REG_FI_WRITER] a -> k3 PC=1 (c.cu:7) mov
[Run 2] Effects from tmp.out2: [REG_FI_WRITER] a -> k3 PC=1 (c.cu:8) mov
[Run 2] tmp.out2: DUE
[Run 3] Effects from tmp.out3:
[Run 3] tmp.out3: nothing
[Run 4] tmp.out4: Masked
"""


def test_injection_log(spark, tmp_path):
    (tmp_path / "c.log").write_text(INJECTIONS)
    results, params = T.injection_log(T.lines(spark, f"{tmp_path}/c.log"))
    got = [(r.run, r.out, r.occurrence, r.outcome, r.src, r.kernel, r.inst_line, r.inst_text) for r in results.orderBy("run", "occurrence", "position").collect()]
    first = [("L1D", "k1", 10, "st.global"), ("L1D", "k1", 11, "ld.global")]
    nothing = ("invalid", "invalid_summary", -1, "")
    want = [(1, "tmp.out1", 1, "SDC", *x) for x in first] + [(1, "tmp.out1", 2, "Masked", *x) for x in [*first, ("REG", "k2", 5, "add")]]
    want += [(2, "tmp.out2", 1, "DUE", "REG", "k3", n, "mov") for n in (7, 8)] + [(3, "tmp.out3", 1, "Others", *nothing), (4, "tmp.out4", 1, "Masked", *nothing)]
    assert got == want
    assert [(r.run, r.out, r.params) for r in params.collect()] == [(1, "tmp.out1", "bit=4")]
    df = spark.createDataFrame([("rf=1000  l2=5000",)], "v string")
    assert df.select(T.settings(F.col("v"))).first()[0] == {"rf": "1000", "l2": "5000"}


def test_json_by_first_bytes(spark, tmp_path):
    """Compression follows the bytes, whatever the name says."""
    zstandard = pytest.importorskip("zstandard")
    data = json.dumps({"a": 1, "b": [2, 3]}, indent=1).encode()
    for name, made in (("x.json", data), ("y.json", gzip.compress(data)), ("z.txt", zstandard.ZstdCompressor().compress(data)), ("w.gz", data), ("v.json", b"not json")):
        (tmp_path / name).write_bytes(made)
    got = {r.file.rpartition("/")[2]: (r.a, r.b) for r in T.json_documents(spark, str(tmp_path), "struct<a: int, b: array<int>>").collect()}
    assert got == {**dict.fromkeys(("x.json", "y.json", "z.txt", "w.gz"), (1, [2, 3])), "v.json": (None, None)}


def test_manifests(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"run_id": "r1", "run_log": "/x/r1.log", "exit_status": 3}]))
    (tmp_path / "m.csv").write_text("run_id,run_log,more\nr2,/x/r2.log,9\n")
    (tmp_path / "m.tsv").write_text("run_log\texit_status\n/x/r3.log\t0\n")
    (tmp_path / "m.txt").write_text("/x/r4.log\n\n")
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "r5.log").write_text("z")
    got = [T.manifest(spark, str(tmp_path / p), k).first() for p, k in (("m.json", "json"), ("m.csv", "csv"), ("m.tsv", "tsv"), ("m.txt", "text"), ("logs", "folder"))]
    assert [r.run_id for r in got] == ["r1", "r2", "r3", "r4", "r5"] and got[0].exit_status == 3 and got[1].exit_status is None


def test_events_and_threads(spark, tmp_path):
    rows = [{"cycle": 1, "thread_id": 0, "kind": "inst", "src_vals": ["0x1"], "pred": {"reg": "p", "val": 0, "uid": 1}}, {"cycle": 2, "kind": "load"}]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
    got = T.events(spark, f"{tmp_path}/t.jsonl").orderBy("event_index").collect()
    assert [r.event_index for r in got] == [0, 1] and got[0].pred.val == 0 and got[1].src_vals is None
    df = spark.createDataFrame([(5, 4, [[0, 3], [10, 1]]), (6, 9, [[1, 2]])], "cycle long, active_threads_size int, active_thread_ranges array<array<int>>")
    flat, wrong = T.active_threads(df)
    assert sorted((r.cycle, r.thread) for r in flat.collect()) == [(5, 0), (5, 1), (5, 2), (5, 10), (6, 1), (6, 2)] and [r.cycle for r in wrong.collect()] == [6]


def test_trace_forms(spark, tmp_path):
    """A list, an object, a manifest and Parquet give the same events; pickles are refused."""
    events = [{"cycle": 1, "thread_id": 0, "kind": "load"}, {"cycle": 3, "thread_id": 2, "kind": "store"}]
    ranges = [{"space": "global", "base": "0x10", "size": 64}]
    (tmp_path / "list.json").write_text(json.dumps(events))
    (tmp_path / "object.bin").write_bytes(gzip.compress(json.dumps({"trace": events, "memory_ranges": ranges}).encode()))
    (tmp_path / "more.json").write_text(json.dumps([{"space": "shared", "base": "0x0", "size": 8}]))
    (tmp_path / "manifest.json").write_text(json.dumps({"trace_template_ref": "object.bin", "memory_ranges_ref": "more.json", "memory_ranges": [{"space": "local", "base": "0x4", "size": 4}]}))
    (tmp_path / "old.json").write_text(json.dumps({"binary_ref": "x.pkl"}))
    for name, spaces in (("list.json", []), ("object.bin", ["global"]), ("manifest.json", ["global", "local", "shared"])):
        found, where = T.trace(spark, f"{tmp_path}/{name}")
        assert [(r.event_index, r.cycle, r.thread_id, r.kind) for r in found.orderBy("event_index").collect()] == [(0, 1, 0, "load"), (1, 3, 2, "store")]
        assert sorted(r.space for r in where.collect()) == spaces
    found.write.parquet(f"{tmp_path}/columns")
    assert T.trace(spark, f"{tmp_path}/columns")[0].count() == 2
    with pytest.raises(ValueError):
        T.trace(spark, f"{tmp_path}/old.json")


def test_options_geometry_definitions(spark, tmp_path):
    df = spark.createDataFrame([("-l1 N:64:128:6,L:T",), ("-cores 30",)], "v string")
    got = df.select(T.option(F.col("v"), "-cores").alias("cores"), T.cache_geometry(T.option(F.col("v"), "-l1")).alias("g")).collect()
    assert got[1].cores == "30" and tuple(got[0].g) == (64, 128, 6) and got[1].g is None
    (tmp_path / "d.txt").write_text("# name, plot, resets, organization, kind\n\nIPC, Scalar, 0, scalar, float\nbad, pie, 0, scalar, int\nhits,vector,1,index,int\nhits,vector,0,implicit,int\nw,vector,0,index2d,int\nr,scalar,2,scalar,int\nshort,scalar\n")
    ok, bad = T.metric_definitions(T.lines(spark, f"{tmp_path}/d.txt"))
    assert sorted(map(tuple, ok.collect())) == [("hits", "vector", False, "implicit", "int"), ("ipc", "scalar", False, "scalar", "float")]
    assert sorted(r.text.split(",")[0] for r in bad.collect()) == ["bad", "r", "short", "w"]


def test_series_by_definition(spark):
    log = ["cycles: 5 7.9", "cycles: 2", "core: 1 2", "core: 3", "core: 4 5 6", "dram: 1 8 9", "dram: 0 3", "dram: 1 4", "bank: 1 2 7", "bank: 1 2 9", "map: 0 1 5 2 3 6", "map: 4", "other: 1", "dram: 2"]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(log)], "file string, line long, value string")
    lines = ["cycles,scalar,1,scalar,int", "core,vector,0,implicit,int", "dram,vector,1,index,int", "bank,vector2d,0,index2d,float", "map,sparse,0,sparse,int"]
    definitions, _ = T.metric_definitions(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = {}
    for r in sorted(T.defined_series(T.interval_log(df), definitions).collect(), key=lambda r: (r.metric, r.key, r["at"])):
        got.setdefault((r.metric, r.key), []).append((r["at"], r.value, r.rate))
    assert {k: [v for _, v, _ in x] for k, x in got.items()} == {
        ("cycles", ""): [0, 5, 7, 2], ("core", "0"): [0, 1, 3, 4], ("core", "1"): [0, 2, 0, 5], ("core", "2"): [0, 0, 0, 6], ("dram", "0"): [0, 3], ("dram", "1"): [0, 8, 9, 4], ("bank", "1.2"): [0, 7, 9], ("map", "0.1"): [5], ("map", "2.3"): [6],
    }
    assert all([i for i, _, _ in x] == list(range(len(x))) for x in got.values())
    assert [r for _, _, r in got["cycles", ""]] == [None, 5, 2, 2] and [r for _, _, r in got["core", "1"]] == [None, 2, -2, 5] and [r for _, _, r in got["dram", "1"]] == [None, 8, 1, 4]


def test_profiles_source_lines_timings(spark, tmp_path):
    (tmp_path / "p.txt").write_text("kernel line : count, latency\na.ptx 5 : 10 20\na.ptx 7 : 1 2\n")
    got = sorted((r.source, r.line, r.counter, r.value) for r in T.line_profile(T.lines(spark, f"{tmp_path}/p.txt")).collect())
    assert got == [("a.ptx", 5, "count", 10), ("a.ptx", 5, "latency", 20), ("a.ptx", 7, "count", 1), ("a.ptx", 7, "latency", 2)]
    (tmp_path / "s.ptx").write_text("top\n.loc 1 20\nadd\n.loc 1 21\nsub")
    got = [(r.line, r.source_line) for r in T.source_lines(T.lines(spark, f"{tmp_path}/s.ptx")).orderBy("line").collect()]
    assert got == [(0, None), (1, None), (2, 20), (3, 20), (4, 21)]
    (tmp_path / "t.tsv").write_text("timestamp_iso\tlabel\tseconds\nLabel\t7\nb\t1.5\nx\ta\t2\tmore\t9\nb\t0.5\nskip\na\tnope\n \n")
    assert [(r.label, r.seconds) for r in T.timings(T.lines(spark, f"{tmp_path}/t.tsv")).collect()] == [("b", 2.0), ("a", 2.0)]
    (tmp_path / "k.log").write_text("kernel_name = f\nShader 3 bind\ngpu_sim_cycle = 10\nShader 1 bind\ngpu_sim_cycle = 5\nblockDim = (32,1,1)\n")
    r = T.kernel_metrics(T.lines(spark, f"{tmp_path}/k.log")).first()
    assert (r.kernels, r.shaders, r.cycles, r.blocks) == (["f"], [1, 3], 15, ["32,1,1"])


def test_register_trace(spark, tmp_path):
    records = [(7, 3, 5), ((1 << 40) + 1, 9, 6 | 1 << 31)]
    (tmp_path / "r.bin").write_bytes(b"".join(struct.pack("<QII", *r) for r in records))
    got = sorted((r.cycle, r.thread, r.register, r.is_write) for r in T.register_trace(spark, f"{tmp_path}/r.bin").collect())
    assert got == [(7, 3, 5, False), ((1 << 40) + 1, 9, 6, True)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, None)], "b long, a string, c string")
    sinks.write_csv(df, f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == 2
    sinks.write_json(df, f"{tmp_path}/json")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/json").collect()) == ['{"a":"a","b":1}', '{"b":2}']
    assert sinks.write_sparse(df, f"{tmp_path}/sparse") == ["b", "a"] and spark.read.parquet(f"{tmp_path}/sparse").columns == ["b", "a"]
    assert sinks.markdown(df.orderBy("b")).splitlines()[2] == "| 1 | a | - |" and "b  a  c" in sinks.aligned(df)
    many = spark.range(1500)
    assert len(sinks.markdown(many).splitlines()) == 1502 and len(sinks.aligned(many).splitlines()) == 1501
    assert sinks.markdown(many, 10).splitlines()[-1] == sinks.aligned(many, 10).splitlines()[-1] == "... 1490 more rows"
    warnings = spark.createDataFrame([(f"w{i:02}",) for i in range(40)], "warning string")
    assert json.loads(sinks.manifest({"t": "x"}, warnings))["warnings"][-1] == "w29"
    with pytest.raises(ValueError):
        reports.complete(df, 3)
    assert reports.required(df, ["a", "b"]).first().lacking == ["a"]
