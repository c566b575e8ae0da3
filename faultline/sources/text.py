"""Readers of logs, manifests, configurations and traces into typed DataFrames.

Readers that need the order of lines take it from ``_line``, a number per file: text files
are read one row per file and cut, so that a file's lines keep their order.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cleaning import id_list, outcome_label, tolerant_int

#: One dynamic instruction of one thread.
EVENT = (
    "cycle long, thread_id int, sm_id int, cta_id int, warp_id int, pc string, opcode string, kind string, width_bits int, src_regs array<string>, src_reg_uids array<int>, src_vals array<string>, "
    "src_width_bits array<int>, dst_reg string, dst_reg_uid int, dst_val string, dst_old_val string, dst_write_mask string, pred struct<reg: string, val: int, uid: int>, mem_space string, mem_addr string, "
    "mem_addr_effective_bits int, mem_addr_mask string, mem_access_size_bytes int, ea_const_offset long, ea_width_bits int, ea_base_src_indices array<int>, store_size_bytes int, store_data_src_index int, "
    "branch_taken boolean, control_expr struct<op: string, src_indices: array<int>, width_bits: int>"
)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files, gzip included, numbered from 0 in each file.

    Files are read in splits; lines are numbered within a split, and the counts of the splits
    before are added, so a large file is not one task's work.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_n"), F.regexp_replace("value", r"\r$", "").alias("value"))
    before = F.sum("_lines").over(W.partitionBy("_f").orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    counts = rows.groupBy(F.col("file").alias("_f"), F.col("_block").alias("_b")).agg(F.count(F.lit(1)).alias("_lines")).select("_f", "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = rows.join(counts, (F.col("file") == F.col("_f")) & (F.col("_block") == F.col("_b")))
    at = F.row_number().over(W.partitionBy("file", "_block").orderBy("_n")) - 1
    return numbered.select("file", (F.col("_before") + at).cast("int").alias("line"), "value")


def csv_rows(spark: SparkSession, path: str, schema: str, key_pattern: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """The first data row of each CSV file, with key columns taken from its path."""
    df = spark.read.csv(path, header=True, schema=schema).withColumn("_file", F.col("_metadata.file_path")).withColumn("_n", F.monotonically_increasing_id())
    first = F.row_number().over(W.partitionBy("_file").orderBy("_n"))
    df = df.withColumn("_first", first).where("_first = 1")
    for i, k in enumerate(keys, 1):
        df = df.withColumn(k, F.regexp_extract("_file", key_pattern, i))
    return df.drop("_n", "_first", "_file")


def key_values(text: Column, separator: str = ":") -> tuple[Column, Column]:
    """A line cut at its first separator, both parts trimmed."""
    parts = F.split(text, separator, 2)
    return F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))


def settings(text: Column) -> Column:
    """``a=1 b=2`` tokens as a map."""
    return F.str_to_map(F.trim(text), F.lit(r"\s+"), F.lit("="))


def json_documents(spark: SparkSession, path: str, schema: T.StructType | str, wrap: str | None = None) -> DataFrame:
    """(file, fields): one JSON value per file, plain, gzip or zstd by the file's first bytes, whatever its name.

    A file is decoded in one task; a value that does not fit the schema has null fields. With
    ``wrap``, a file's value, if it is a list, stands for an object that has it under that name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_decoded(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["file", "value"])

    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    kind = schema if isinstance(schema, str) else schema.simpleString()
    texts = raw.mapInArrow(run, "file string, value string")
    if wrap:
        texts = texts.withColumn("value", F.when(F.ltrim("value").startswith("["), F.concat(F.lit(f'{{"{wrap}": '), "value", F.lit("}"))))
    return texts.select("file", F.from_json("value", kind).alias("j")).select("file", "j.*")


def _decoded(data: bytes) -> str:
    """Text of plain, gzip or zstd bytes."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    elif data[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard  # only such files need it

        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return data.decode("utf-8", "replace")


def events(spark: SparkSession, path: str) -> DataFrame:
    """Trace events from JSON lines, with ``event_index`` in file order per file."""
    numbered = lines(spark, path).where(F.trim("value") != "")
    parsed = numbered.select("file", F.col("line").cast("long").alias("event_index"), F.from_json("value", EVENT).alias("e"))
    return parsed.select("file", "event_index", "e.*")


RANGE = "space string, base string, size long, start_cycle long, end_cycle long"


def trace(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, memory ranges) of a trace file, which is a JSON list of events, an object that holds
    them as ``events`` or ``trace`` beside ``memory_ranges``, or a manifest that names such a file as
    ``trace_template_ref`` or ``events_ref`` and further ranges as ``memory_ranges_ref``, relative to
    its own folder; or a folder of Parquet with the columns of events. JSON is plain, gzip or zstd.

    Events have ``event_index``, their place in the list (of Parquet: the column of that name).
    Binary pickles are refused: reading them would run what they hold.
    """
    if spark.read.format("binaryFile").load(path).where(F.col("path").endswith(".parquet")).select("path").limit(1).count():
        return spark.read.parquet(path), spark.createDataFrame([], RANGE)
    names = "trace_template_ref string, events_ref string, memory_ranges_ref string, binary_ref string, columnar_ref string"
    top = json_documents(spark, path, f"struct<{names}>").first()
    if top.binary_ref or top.columnar_ref:
        raise ValueError(f"{path} refers to a pickle; write it as JSON or Parquet")
    beside = lambda ref: ref if ref.startswith("/") or "://" in ref else f"{path.rpartition('/')[0]}/{ref}"
    ref = top.trace_template_ref or top.events_ref
    source = beside(ref) if ref else path
    inside = f"array<struct<{EVENT}>>"
    listed = json_documents(spark, source, f"struct<value: {inside}>", wrap="value").select("value")
    held = json_documents(spark, source, f"struct<events: {inside}, trace: {inside}>").select(F.coalesce("events", "trace").alias("value"))
    events = listed.unionByName(held).select(F.posexplode("value").alias("event_index", "e")).select(F.col("event_index").cast("long").alias("event_index"), "e.*")
    ranges = [json_documents(spark, source, f"struct<memory_ranges: array<struct<{RANGE}>>>").select("memory_ranges")]
    if ref:
        ranges.append(json_documents(spark, path, f"struct<memory_ranges: array<struct<{RANGE}>>>").select("memory_ranges"))
    if top.memory_ranges_ref:
        more = beside(top.memory_ranges_ref)
        ranges.append(json_documents(spark, more, f"struct<memory_ranges: array<struct<{RANGE}>>, ranges: array<struct<{RANGE}>>>").select(F.coalesce("memory_ranges", "ranges").alias("memory_ranges")))
        ranges.append(json_documents(spark, more, f"struct<memory_ranges: array<struct<{RANGE}>>>", wrap="memory_ranges").select("memory_ranges"))
    found = ranges[0]
    for r in ranges[1:]:
        found = found.unionByName(r)
    return events, found.select(F.explode("memory_ranges").alias("r")).select("r.*")


def active_threads(df: DataFrame, cycle: str = "cycle", ranges: str = "active_thread_ranges", size: str = "active_threads_size") -> tuple[DataFrame, DataFrame]:
    """(cycle, thread) from run-length ranges, and the cycles whose size disagrees."""
    one = df.select(cycle, size, F.explode(ranges).alias("r"))
    flat = one.select(cycle, F.explode(F.sequence(F.element_at("r", 1), F.element_at("r", 1) + F.element_at("r", 2) - 1)).alias("thread"))
    total = F.aggregate(ranges, F.lit(0).cast("long"), lambda acc, r: acc + F.element_at(r, 2).cast("long"))
    return flat, df.where(total != F.col(size)).select(cycle)


def outputs(df: DataFrame, text: str = "value", marker: str = "OUTPUT") -> DataFrame:
    """Output declarations ``<marker> base=0x.. bytes=N name=X``."""
    part = lambda k, p: F.regexp_extract(text, rf"{k}={p}", 1)
    found = df.where(F.col(text).rlike(rf"{marker}\s+base="))
    return found.withColumns({"base": tolerant_int(part("base", "(0[xX][0-9a-fA-F]+|[0-9]+)")), "bytes": tolerant_int(part("bytes", "([0-9]+)")), "name": F.nullif(part("name", r"(\S+)"), F.lit(""))}).drop(text)


def run_summaries(log: DataFrame, success: str = "Success", failed: str = "Failed", cycle: str = r"cycle\s*=\s*([0-9]+)", marker: str = "OUTPUT") -> DataFrame:
    """Per file: size, sentinels, the last cycle count, and the set of outputs it declares (as ``outputs``) in order of base, bytes and name."""
    count = F.when(F.col("value").rlike(cycle), F.regexp_extract("value", cycle, 1).cast("long"))
    part = lambda k, p: F.regexp_extract("value", rf"{k}={p}", 1)
    output = F.when(F.col("value").rlike(rf"{marker}\s+base="), F.struct(tolerant_int(part("base", "(0[xX][0-9a-fA-F]+|[0-9]+)")).alias("base"), tolerant_int(part("bytes", "([0-9]+)")).alias("bytes"), F.nullif(part("name", r"(\S+)"), F.lit("")).alias("name")))
    return log.groupBy("file").agg(F.array_sort(F.collect_set(output)).alias("outputs"),
        F.sum(F.length("value") + 1).alias("size"), F.bool_or(F.col("value").contains(success)).alias("success"), F.bool_or(F.col("value").contains(failed)).alias("failed"), F.max_by(count, F.when(count.isNotNull(), F.col("line"))).alias("last_cycle"),
    )


def injection_log(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, params) of a campaign log of (file, line, value).

    ``[Run n] Effects from .../tmp.outK:`` opens a pack of the pair (n, tmp.outK), alone or with a
    record on the same line; ``[X_FI_WRITER]`` and ``[X_FI_READER]`` lines after it are records of
    the pack that was opened last. ``[Run n] tmp.outK: text`` is a result of its pair. Results: file,
    run, out, occurrence (of the pair, from 1), outcome, position (from 0), src, kernel, inst_line,
    inst_text: one row for each distinct record of the pair before the result, packs in order and
    in each the writers first. A pack without records, and a pair without packs, stands for
    the record (invalid, invalid_summary, -1, ''). Params: the last ``[INJ_PARAMS]`` text of each pair.
    """
    pair = r"^\[Run\s+(\d+)\]\s+"
    effects, alone = pair + r"Effects from\s+(?:.+/)?(tmp\.out\d+):\s*(.*)$", pair + r"Effects from\s+(?:.+/)?(tmp\.out\d+):\s*$"
    record = r"^\[([-A-Za-z0-9_]+)_FI_(WRITER|READER)\].*?->\s*(\S+)\s+PC=.*\(([^:()]+):(\d+)\)\s*(.*)$"
    result, params = pair + r"(tmp\.out\d+):\s*(.*?)\s*$", r"^\[INJ_PARAMS\]\s+\[Run\s+(\d+)\]\s+(tmp\.out\d+)\s+(.*)$"
    got = lambda p, i, c="value": F.regexp_extract(c, p, i)
    rows = log.withColumn("_opens", F.col("value").rlike(effects))
    key = F.when(F.col("_opens"), F.struct(got(effects, 1).cast("long").alias("run"), got(effects, 2).alias("out")))
    upto = W.partitionBy("file").orderBy("line").rowsBetween(W.unboundedPreceding, W.currentRow)
    # a bare heading starts a pack, an inline one only where the pair changes
    rows = rows.withColumn("_key", F.last(key, ignorenulls=True).over(upto))
    fresh = F.col("_opens") & (F.col("value").rlike(alone) | ~F.col("_key").eqNullSafe(F.lag("_key").over(W.partitionBy("file").orderBy("line"))))
    rows = rows.withColumn("_pack", F.sum(fresh.cast("int")).over(upto)).withColumn("_text", F.when(F.col("_opens"), got(effects, 3)).otherwise(F.col("value")))
    said = rows.where("_key is not null").select("file", "_key.run", "_key.out", "_pack", "line", "_text", F.col("_text").rlike(record).alias("_is"), fresh.alias("_first"))
    records = said.where("_is").select("file", "run", "out", "_pack", "line", (got(record, 2, "_text") == "READER").cast("int").alias("_reads"), got(record, 1, "_text").alias("src"), got(record, 3, "_text").alias("kernel"), got(record, 5, "_text").cast("int").alias("inst_line"), F.trim(got(record, 6, "_text")).alias("inst_text"))
    packs = said.groupBy("file", "run", "out", "_pack").agg(F.min("line").alias("line"), F.min(F.when(F.col("_is"), F.col("line"))).alias("_filled"), F.max("line").alias("_last"))
    results = log.where(F.col("value").rlike(result) & ~F.col("value").rlike(effects)).select("file", got(result, 1).cast("long").alias("run"), got(result, 2).alias("out"), F.col("line").alias("_at"), outcome_label(got(result, 3)).alias("outcome"))
    results = results.withColumn("occurrence", F.row_number().over(W.partitionBy("file", "run", "out").orderBy("_at")))
    on = ["file", "run", "out"]
    invalid = [F.lit(1).alias("_reads"), F.lit("invalid").alias("src"), F.lit("invalid_summary").alias("kernel"), F.lit(-1).alias("inst_line"), F.lit("").alias("inst_text")]
    # a pack is empty for a result when it has no record before the result, and was closed or is looked at then
    closed = said.groupBy("file", "_pack").agg(F.min("line").alias("_start")).select("file", (F.col("_pack") - 1).alias("_pack"), F.col("_start").alias("_end"))
    empty = packs.join(closed, ["file", "_pack"], "left").where("_filled is null").select(*on, "_pack", "line", F.lit(True).alias("_empty"))
    late = results.join(packs.where("_filled is not null").select(*on, "_pack", F.col("line").alias("_open"), "_filled"), on).where("_open < _at and _filled > _at").join(closed, ["file", "_pack"], "left").where("_end is null or _end > _at")
    late = late.select(*on, "_pack", F.col("_at").alias("line")).distinct()
    whole = records.unionByName(empty.drop("_empty").select(*on, "_pack", "line", *invalid)).unionByName(late.select(*on, "_pack", "line", *invalid))
    met = results.join(whole, on, "left").where("line is null or line <= _at")
    met = results.join(met.select(*on, "occurrence", "_pack", "line", "_reads", "src", "kernel", "inst_line", "inst_text"), [*on, "occurrence"], "left")
    what = ["src", "kernel", "inst_line", "inst_text"]
    met = met.withColumns({"src": F.coalesce("src", F.lit("invalid")), "kernel": F.coalesce("kernel", F.lit("invalid_summary")), "inst_line": F.coalesce("inst_line", F.lit(-1)), "inst_text": F.coalesce("inst_text", F.lit(""))})
    one = met.groupBy(*on, "occurrence", "outcome", *what).agg(F.min(F.struct("_pack", "_reads", "line")).alias("_order"))
    one = one.withColumn("position", F.row_number().over(W.partitionBy(*on, "occurrence").orderBy("_order")) - 1)
    texts = log.where(F.col("value").rlike(params)).select("file", got(params, 1).cast("long").alias("run"), got(params, 2).alias("out"), F.trim(got(params, 3)).alias("params"), "line")
    return one.select(*on, "occurrence", "outcome", "position", *what), texts.groupBy(*on).agg(F.max_by("params", "line").alias("params"))


MANIFEST = "run_id string, run_log string, exit_status int, run_batch string, tmp_file string"


def manifest(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A batch manifest: json, csv, tsv, text (one log a line) or a folder's files."""
    empty = spark.createDataFrame([], MANIFEST)
    if kind == "json":
        rows = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    elif kind in ("csv", "tsv"):
        rows = spark.read.csv(path, header=True, sep="," if kind == "csv" else "\t")
        rows = rows.select(*[F.col(c).cast(empty.schema[c].dataType) for c in rows.columns if c in empty.columns])
    elif kind == "text":
        rows = spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("run_log"))
    else:
        rows = spark.read.format("binaryFile").load(path).select(F.col("path").alias("run_log"))
    rows = empty.unionByName(rows, allowMissingColumns=True)
    return rows.withColumn("run_id", F.coalesce("run_id", F.regexp_extract("run_log", r"([^/]+?)(\.[^./]*)?$", 1)))


def option(text: Column, name: str) -> Column:
    """The rest of a line whose first token is ``name``."""
    return F.when(F.get(F.split(F.trim(text), r"\s+", 2), F.lit(0)) == name, F.get(F.split(F.trim(text), r"\s+", 2), F.lit(1)))


def cache_geometry(text: Column) -> Column:
    """``K:sets:line:ways`` as a struct."""
    p = r"^[A-Za-z]:(\d+):(\d+):(\d+)"
    return F.when(text.rlike(p), F.struct(*[F.regexp_extract(text, p, i).cast("int").alias(n) for i, n in enumerate(("sets", "line", "ways"), 1)]))


def kernel_metrics(log: DataFrame) -> DataFrame:
    """Per file: kernels named, shaders bound, cycles in total and block sizes."""
    name, cycles = F.regexp_extract("value", r"kernel_name\s*=\s*(\S+)", 1), F.regexp_extract("value", r"gpu_sim_cycle\s*=\s*([0-9]+)", 1)
    shader, block = F.regexp_extract("value", r"Shader (\d+) bind", 1), F.regexp_extract("value", r"blockDim\s*=\s*\((\d+,\d+,\d+)\)", 1)
    some = lambda c: F.when(c != "", c)
    return log.groupBy("file").agg(F.collect_set(some(name)).alias("kernels"), F.array_sort(F.collect_set(some(shader).cast("int"))).alias("shaders"), F.sum(some(cycles).cast("long")).alias("cycles"), F.collect_set(some(block)).alias("blocks"))


def interval_log(log: DataFrame) -> DataFrame:
    """(file, metric, sample, position, value) from lines ``name: n n n``; samples count per metric."""
    p = r"^\s*([A-Za-z_][\w\[\].-]*)\s*:\s*(.*)$"
    rows = log.where(F.col("value").rlike(p)).select("file", "line", F.regexp_extract("value", p, 1).alias("metric"), F.regexp_extract("value", p, 2).alias("rest"))
    rows = rows.withColumn("sample", F.row_number().over(W.partitionBy("file", "metric").orderBy("line")) - 1)
    flat = rows.select("file", "metric", "sample", F.posexplode(F.filter(F.split("rest", r"[\s,]+"), lambda v: v != "")).alias("position", "value"))
    return flat.withColumn("value", F.col("value").try_cast("double")).where("value is not null")


#: How a plot's numbers may be organized.
ORGANIZED = {"scalar": ("scalar",), "vector": ("implicit", "index"), "vector2d": ("index2d",), "sparse": ("sparse",)}


def metric_definitions(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) definitions of metrics from lines (column value): name, plot, resets, organization, kind.

    A line has these five fields between commas, in any case; resets is 1 where a kernel's start sets the
    counter to 0, kind is int or float. Empty lines and lines that start with # are no definitions; of
    one name the last valid line counts. Invalid ones come as text.
    """
    rows = lines.select(F.trim("value").alias("text")).where((F.col("text") != "") & ~F.col("text").startswith("#")).withColumn("_line", F.monotonically_increasing_id())
    part = F.transform(F.split("text", ","), lambda t: F.lower(F.trim(t)))
    rows = rows.withColumn("f", part).select("text", "_line", *[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(("name", "plot", "resets", "organization", "kind"))])
    fits = F.lit(False)
    for plot, organizations in ORGANIZED.items():
        fits |= (F.col("plot") == plot) & F.col("organization").isin(*organizations)
    fits &= F.col("kind").isin("int", "float") & F.col("resets").isin("0", "1") & (F.col("name") != "")
    rows = rows.withColumn("_ok", F.coalesce(fits, F.lit(False)))
    best = rows.where("_ok").groupBy("name").agg(F.max_by(F.struct("plot", (F.col("resets") == "1").alias("resets"), "organization", "kind"), "_line").alias("d"))
    return best.select("name", "d.*"), rows.where(~F.col("_ok")).select("text")


def defined_series(values: DataFrame, definitions: DataFrame) -> DataFrame:
    """Series of an ``interval_log`` by its metrics' definitions: file, metric, key, at, value, rate.

    scalar: one series of all values. implicit: a series per position, rows that are shorter than the longest of
    their file filled with 0. index and index2d: the first one or two numbers of a line are the key (``i`` or ``i.j``), the
    others continue its series. sparse: triples (i, j, value), the series of ``i.j``. Every series but the sparse
    ones starts with 0 at 0. Values of kind int are cut to integers. rate is the change since the value before;
    where a metric that resets falls, it started anew.

    One plan serves all definitions, which are few and broadcast; positions are counted per file, metric and key.
    """
    keys = ["file", "metric", "key"]
    known = values.join(F.broadcast(definitions), F.lower("metric") == F.col("name"))
    lines = known.groupBy("file", "metric", "sample", "organization", "resets", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda p: p["value"]).alias("v"))
    lines = lines.withColumn("_most", F.max(F.size("v")).over(W.partitionBy("file", "metric")))
    as_key = lambda x: F.format_string("%d", x.cast("long"))
    org, v = F.col("organization"), F.col("v")
    point = lambda key, order, value: F.struct(key.alias("key"), order.cast("int").alias("order"), value.alias("value"))
    after = lambda n: F.when(F.size(v) > n, F.slice(v, n + 1, F.greatest(F.size(v) - n, F.lit(1)))).otherwise(F.array().cast("array<double>"))
    lasting = lambda n, key: F.transform(after(n), lambda x, i: point(key, i, x))
    pairs = F.when(F.size(v) >= 3, F.sequence(F.lit(0), F.floor(F.size(v) / 3).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    two = lambda a, b: F.concat(as_key(a), F.lit("."), as_key(b))
    points = (
        F.when(org == "scalar", F.transform(v, lambda x, i: point(F.lit(""), i, x)))
        .when(org == "implicit", F.transform(F.sequence(F.lit(0), F.col("_most") - 1), lambda i: point(i.cast("string"), F.lit(0), F.coalesce(F.get(v, i), F.lit(0.0)))))
        .when(org == "index", lasting(1, as_key(F.get(v, F.lit(0)))))
        .when(org == "index2d", lasting(2, two(F.get(v, F.lit(0)), F.get(v, F.lit(1)))))
        .when(org == "sparse", F.transform(pairs, lambda k: point(two(F.get(v, k * 3), F.get(v, k * 3 + 1)), k, F.get(v, k * 3 + 2))))
    )
    flat = lines.select("file", "metric", "sample", "organization", "resets", "kind", F.explode(points).alias("p")).select("file", "metric", "sample", "organization", "resets", "kind", "p.*")
    w = W.partitionBy(*keys).orderBy("sample", "order")
    at = F.row_number().over(w) - F.when(F.col("organization") == "sparse", 1).otherwise(0)
    cut = F.when(F.col("kind") == "int", F.when(F.col("value") < 0, F.ceil("value")).otherwise(F.floor("value")).cast("double")).otherwise(F.col("value"))
    series = flat.select(*keys, at.cast("long").alias("at"), cut.alias("value"), "organization", "resets")
    zero = series.where("organization <> 'sparse'").select(*keys, "organization", "resets").distinct().select(*keys, F.lit(0).cast("long").alias("at"), F.lit(0.0).alias("value"), "organization", "resets")
    both = series.unionByName(zero)
    was = F.lag("value").over(W.partitionBy(*keys).orderBy("at"))
    rate = F.when(F.col("resets") & (F.col("value") < was), F.col("value")).otherwise(F.col("value") - was)
    return both.select(*keys, "at", "value", rate.alias("rate"))


def line_profile(log: DataFrame) -> DataFrame:
    """(file, source, line, counter, value): the header names the counters, rows are ``source:line``."""
    head = log.where("line = 0").select("file", F.filter(F.split(F.element_at(F.split("value", ":", 2), -1), r"[\s,]+"), lambda v: v != "").alias("names"))
    p = r"^\s*(.+?)[ ,:]+(\d+)\s*:\s*(.*)$"
    rows = log.where((F.col("line") > 0) & F.col("value").rlike(p)).select("file", F.regexp_extract("value", p, 1).alias("source"), F.regexp_extract("value", p, 2).try_cast("int").alias("at"), F.filter(F.split(F.regexp_extract("value", p, 3), r"[\s,]+"), lambda v: v != "").alias("values"))
    pairs = rows.join(head, "file").select("file", "source", F.col("at").alias("line"), F.explode(F.arrays_zip("names", "values")).alias("x"))
    return pairs.select("file", "source", "line", F.col("x.names").alias("counter"), F.col("x.values").try_cast("long").alias("value"))


def source_lines(log: DataFrame) -> DataFrame:
    """(file, line, source_file, source_line): a ``.loc f n`` line sets the source of the lines after it."""
    p = r"^\s*\.loc\s+(\d+)\s+(\d+)"
    loc = F.when(F.col("value").rlike(p), F.struct(F.regexp_extract("value", p, 1).cast("int").alias("f"), F.regexp_extract("value", p, 2).cast("int").alias("n")))
    before = W.partitionBy("file").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    out = log.withColumn("_loc", F.last(loc, ignorenulls=True).over(before))
    return out.select("file", "line", F.col("_loc.f").alias("source_file"), F.col("_loc.n").alias("source_line"))


def register_names(df: DataFrame, text: str = "value", pattern: str = r"%([A-Za-z]+)(\d+)") -> DataFrame:
    """Distinct registers in the order of prefix and number."""
    found = df.select(F.explode(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))).alias("register")).distinct()
    return found.withColumns({"prefix": F.regexp_extract("register", pattern, 1), "number": F.regexp_extract("register", pattern, 2).cast("long")}).orderBy("prefix", "number")


def timings(log: DataFrame) -> DataFrame:
    """(label, seconds) summed in first-seen order from tab-separated rows: label and seconds, or a time stamp before
    them and whatever after; heads (``timestamp_iso``, ``label``), rows without a label and without a number are skipped."""
    parts = F.split(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")), "\t")
    long = F.size(parts) >= 3
    label = F.trim(F.when(long, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0))))
    seconds = F.trim(F.when(long, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1)))).try_cast("double")
    head = F.when(long, F.get(parts, F.lit(0)) == "timestamp_iso").otherwise(F.lower(F.get(parts, F.lit(0))) == "label")
    rows = log.where(F.size(parts) >= 2).where(~head).select("line", label.alias("label"), seconds.alias("seconds")).where("seconds is not null and label <> ''")
    return rows.groupBy("label").agg(F.sum("seconds").alias("seconds"), F.min("line").alias("first")).orderBy("first")


def shader_ids(text: Column) -> Column:
    return id_list(text)


RECORD = np.dtype([("cycle", "<u8"), ("thread", "<u4"), ("register", "<u4")])


def register_trace(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, cycle, thread, register, is_write) from 16-byte records: u64 cycle, u32 thread, u32 register with its top bit for writes.

    A file is decoded in one task, in pieces (``splits.register_records`` splits it); a header of 16 bytes that begins with
    RFTR is passed over, bytes after the last whole record are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = memoryview(content.as_buffer())
                data = data[16:] if bytes(data[:4]) == b"RFTR" else data
                for at in range(0, len(data) // 16, 1 << 20):
                    x = np.frombuffer(data, RECORD, min(1 << 20, len(data) // 16 - at), at * 16)
                    columns = [np.arange(at, at + len(x)), x["cycle"].astype(np.int64), x["thread"].astype(np.int64), (x["register"] & np.uint32(0x7FFFFFFF)).astype(np.int64), x["register"] >= np.uint32(1 << 31)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(x)), *map(pa.array, columns)], names=["file", "record", "cycle", "thread", "register", "is_write"])

    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    return raw.mapInArrow(run, "file string, record long, cycle long, thread long, register long, is_write boolean")
