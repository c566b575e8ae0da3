"""Readers that split one large file: JSON lists of any length, and files of fixed records.

A JSON list cannot be cut at any sign that its text alone shows: a brace may stand within a string. So it is
read in two passes over byte ranges. The first tells, for each range and for both cases (it begins outside
or inside a string), how deep it leads and whether it ends inside a string; a window over a file's ranges
turns that into where each range begins. The second yields the elements that begin in a range, and reads on
behind it until the last of them ends. A file may have any size; a task holds one range and one element.

Files are opened by URI (``pyarrow.fs``: local, hdfs, s3, gs), not compressed. Elements come as text, so
``from_json`` turns them into columns next to the scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGE_BYTES = 64 << 20
#: Magic number and size of header and record of a register trace, and the bit of a write.
MAGIC, HEADER, RECORD, WRITE = b"RFTR", 16, 16, 0x80000000


def _opened(uri: str) -> pa.NativeFile:
    where, path = fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/(?=[^/])", "file:///", uri)))
    return where.open_input_file(path)


def byte_ranges(spark: SparkSession, path: str, size: int = RANGE_BYTES, header: int = 0, step: int = 1) -> DataFrame:
    """(file, part, start, stop): ranges of about ``size`` bytes behind ``header``, in multiples of ``step``, dealt one to a task."""
    sizes = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("n"))  # names and sizes alone are read
    size = max(size // step, 1) * step
    parts = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil((F.col("n") - header) / size) - 1, F.lit(0)))
    rows = sizes.select("file", "n", F.explode(parts).alias("part")).withColumn("start", F.lit(header) + F.col("part") * size)
    rows = rows.select("file", "part", "start", F.least(F.col("start") + size, F.col("n")).alias("stop")).where("start < stop")
    return rows.repartition(max(1, min(rows.count(), 10_000)), "file", "part")


def _quotes(data: np.ndarray, before: int) -> np.ndarray:
    """Where quotes open or close strings; ``before``: how many backslashes stand just before the data."""
    slash = data == 0x5C
    if not slash.any() and not before:
        return data == 0x22
    # length of the run of backslashes that ends at each byte
    at = np.arange(len(data))
    last_other = np.maximum.accumulate(np.where(slash, -1, at))
    run = at - last_other
    run = np.where(slash, np.where(last_other < 0, at + 1 + before, run), 0)
    prior = np.concatenate([[before], run[:-1]])
    return (data == 0x22) & (prior % 2 == 0)


def _depths(data: np.ndarray, quotes: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """(change of depth at each byte outside strings, whether each byte is in a string)."""
    within = (np.cumsum(quotes) + inside) % 2 == 1
    change = np.zeros(len(data), np.int8)
    change[(data == 0x7B) | (data == 0x5B)] = 1
    change[(data == 0x7D) | (data == 0x5D)] = -1
    change[within] = 0
    return change, within


def _backslashes(source: pa.NativeFile, start: int) -> int:
    """How many backslashes stand just before a place."""
    n = 0
    while start > 0:
        take = min(4096, start)
        source.seek(start - take)
        tail = source.read(take)
        here = len(tail) - len(tail.rstrip(b"\\"))
        n, start = n + here, start - take
        if here < take:
            break
    return n


def _part(source: pa.NativeFile, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    before = _backslashes(source, start)
    source.seek(start)
    data = np.frombuffer(source.read(stop - start), np.uint8)
    return data, _quotes(data, before)


def json_elements(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, at, value): the objects and lists that are elements of each file's top-level list, as text with their byte offset.

    An element that is a number, a string or a literal is left out. A file whose top level is an object has
    no elements here, but for its direct members that are objects or lists. Offsets order the elements.
    """
    ranges = byte_ranges(spark, path, range_bytes)

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, start, stop in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "stop")), strict=True):
                with _opened(file) as source:
                    data, quotes = _part(source, start, stop)
                out.append((int(quotes.sum()) % 2, *(int(_depths(data, quotes, inside)[0].sum(dtype=np.int64)) for inside in (False, True))))
            values = [pa.array([o[i] for o in out], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("file", "part", "start", "stop")), *values], ["file", "part", "start", "stop", "odd", "outside", "within"])

    told = ranges.mapInArrow(survey, "file string, part long, start long, stop long, odd long, outside long, within long")
    before = W.partitionBy("file").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    told = told.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    told = told.withColumn("depth", F.coalesce(F.sum(F.when(F.col("inside"), F.col("within")).otherwise(F.col("outside"))).over(before), F.lit(0)))

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, stop, inside, depth in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "stop", "inside", "depth")), strict=True):
                with _opened(file) as source:
                    found = list(_elements(source, start, stop, inside, depth))
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(found), pa.string()), pa.array([a for a, _ in found], pa.int64()), pa.array([v.decode("utf-8", "replace") for _, v in found], pa.string())], ["file", "at", "value"])

    parts = told.select("file", "part", "start", "stop", "inside", "depth")
    return parts.repartition(max(1, min(ranges.count(), 10_000)), "file", "part").mapInArrow(elements, "file string, at long, value string")


def _elements(source: pa.NativeFile, start: int, stop: int, inside: bool, depth: int) -> Iterator[tuple[int, bytes]]:
    """(offset, text) of the elements at depth 1 that begin in a range."""
    data, quotes = _part(source, start, stop)
    change, within = _depths(data, quotes, inside)
    level = depth + np.cumsum(change, dtype=np.int64)
    opens, closes = np.flatnonzero((change == 1) & (level == 2)), np.flatnonzero((change == -1) & (level == 1))
    raw = data.tobytes()
    for a in opens.tolist():
        k = np.searchsorted(closes, a)
        if k < len(closes):
            yield start + a, raw[a : closes[k] + 1]
            continue
        text, at = [raw[a:]], stop
        now, deep = bool(within[-1]) if len(within) else inside, int(level[-1])
        while True:  # the last one goes on behind the range
            more, marks = _part(source, at, at + max(4096, (stop - start) // 4))
            if not len(more):
                raise ValueError(f"an element that begins at byte {start + a} does not end")
            step, held = _depths(more, marks, now)
            deeper = deep + np.cumsum(step, dtype=np.int64)
            end = np.flatnonzero((step == -1) & (deeper == 1))
            if len(end):
                text.append(more[: end[0] + 1].tobytes())
                yield start + a, b"".join(text)
                break
            text.append(more.tobytes())
            at, now, deep = at + len(more), bool(held[-1]), int(deeper[-1])


def json_list(spark: SparkSession, path: str, schema: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, position, columns of ``schema``): a JSON list's objects as rows; position counts them per file from 0.

    Positions are counted from the ranges' numbers of elements, so no task sorts a file.
    """
    found = json_elements(spark, path, range_bytes).withColumn("_part", F.floor(F.col("at") / range_bytes))
    counts = found.groupBy(F.col("file").alias("_file"), F.col("_part").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select("_file", "_of", F.coalesce(F.sum("_n").over(W.partitionBy("_file").orderBy("_of").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(W.partitionBy("file", "_part").orderBy("at")) - 1
    rows = found.withColumn("_rank", rank).join(counts, (F.col("file") == F.col("_file")) & (F.col("_part") == F.col("_of")))
    return rows.select("file", (F.col("_before") + F.col("_rank")).cast("long").alias("position"), F.from_json("value", schema).alias("j")).select("file", "position", "j.*")


def register_records(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, position, cycle, thread, register, is_write) of register traces of any size, in byte ranges of whole records."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype([("cycle", "<u8"), ("thread", "<u4"), ("register", "<u4")])
        for batch in batches:
            for file, start, stop in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "stop")), strict=True):
                with _opened(file) as source:
                    if source.read(4) != MAGIC:
                        raise ValueError(f"{file} is no register trace")
                    source.seek(start)
                    data = source.read(stop - start)
                if len(data) % RECORD:
                    raise ValueError(f"{file} ends within a record")
                r = np.frombuffer(data, kind)
                first = (start - HEADER) // RECORD
                columns = [pa.array([file] * len(r), pa.string()), pa.array(first + np.arange(len(r))), pa.array(r["cycle"].astype(np.int64)), pa.array(r["thread"].astype(np.int64)), pa.array((r["register"] & ~np.uint32(WRITE)).astype(np.int64)), pa.array((r["register"] & np.uint32(WRITE)) != 0)]
                yield pa.RecordBatch.from_arrays(columns, ["file", "position", "cycle", "thread", "register", "is_write"])

    ranges = byte_ranges(spark, path, range_bytes, HEADER, RECORD)
    return ranges.mapInArrow(decode, "file string, position long, cycle long, thread long, register long, is_write boolean")
