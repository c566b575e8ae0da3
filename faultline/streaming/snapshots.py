"""Interval statistics over streams: tumbling snapshots, carried totals, occupancy."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 4) -> DataFrame:
    """Appended Parquet or JSON files as a stream."""
    kind = "json" if path.rstrip("/").endswith(("json", "jsonl")) else "parquet"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(path)


def snapshots(df: DataFrame, ts: str, keys: list[str], width: str, value: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of each tumbling interval, from 0 each time. Batch and stream alike."""
    if df.isStreaming:
        df = df.withWatermark(ts, late)
    sums = [F.count(F.lit(1)).alias("n"), *([F.sum(value).alias("total")] if value else [])]
    out = df.groupBy(F.window(ts, width), *keys).agg(*sums)
    return out.select(F.col("window.start").alias("start"), *keys, "n", *(["total"] if value else []))


def carried(snaps: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """Batch: counts carried over from interval to interval."""
    return snaps.withColumn("carried", F.sum(count).over(W.partitionBy(*keys).orderBy("start").rowsBetween(W.unboundedPreceding, W.currentRow)))


def running_totals(df: DataFrame, key: str) -> DataFrame:
    """Stream: totals since the start per key, kept in state; a row per key and trigger."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0
        total += sum(len(f) for f in frames)
        state.update((total,))
        yield pd.DataFrame({key: [k[0]], "carried": [total]})

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, carried long", "total long", "update", GroupStateTimeout.NoTimeout)


def occupancy(df: DataFrame, ts: str, width: str, thread: str, pc: str) -> DataFrame:
    """Batch: at the end of each interval, how many threads stand at each pc; a thread keeps its last pc.

    A thread's moves become +1 and -1 events, so intervals are not filled thread by thread.
    """
    at = df.groupBy(F.window(ts, width).alias("w"), thread).agg(F.max_by(pc, ts).alias("pc"))
    at = at.select(F.col("w.start").alias("start"), thread, "pc").withColumn("_was", F.lag("pc").over(W.partitionBy(thread).orderBy("start")))
    moves = at.select("start", F.explode(F.array(F.struct(F.col("pc").alias("pc"), F.lit(1).alias("d")), F.struct(F.col("_was").alias("pc"), F.lit(-1).alias("d")))).alias("m"))
    moves = moves.select("start", "m.pc", "m.d").where("pc is not null").groupBy("start", "pc").agg(F.sum("d").alias("d"))
    return moves.withColumn("threads", F.sum("d").over(W.partitionBy("pc").orderBy("start").rowsBetween(W.unboundedPreceding, W.currentRow))).drop("d")


def occupancy_stream(df: DataFrame, logger: str, at: str, thread: str, pc: str, width: int) -> DataFrame:
    """Stream: (logger, interval, pc, threads) of every interval of ``width`` that has ended, as ``occupancy``.

    ``at`` is an integer time. The state of a logger is the open interval and each thread's current
    pc and its time, with which the next interval is seeded; it grows with the threads of one logger. An
    interval ends when a later row of its logger comes; intervals without rows are left out,
    their counts being those of the one before. Rows of one trigger may come in any order. A thread stands at
    the pc of its latest row: a row that comes late never moves a thread back. It counts from the open interval on.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, held = state.get if state.exists else (None, "{}")
        seat, out = json.loads(held), []
        for t, who, where in sorted(x for f in frames for x in zip(f[at].tolist(), f[thread].tolist(), f[pc].tolist(), strict=True)):
            if now is not None and t // width > now:
                out += [(k[0], now, p, n) for p, n in sorted(Counter(p for _, p in seat.values()).items())]
            now = t // width if now is None else max(now, t // width)
            if str(who) not in seat or seat[str(who)][0] <= t:
                seat[str(who)] = [t, where]
        state.update((now, json.dumps(seat)))
        yield pd.DataFrame(out, columns=[logger, "interval", pc, "threads"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    fields = f"{logger} {kinds[logger]}, interval long, {pc} {kinds[pc]}, threads long"
    return df.select(logger, at, thread, pc).groupBy(logger).applyInPandasWithState(step, fields, "interval long, seat string", "append", GroupStateTimeout.NoTimeout)


def stitched_stream(df: DataFrame, key: str, at: str, x: str) -> DataFrame:
    """Stream: (key, at, x, stitched): x, which starts anew with every kernel, continued over kernels.

    The state of a key is the last x, the greatest one of the open segment and what lies before it.
    Rows of a trigger are taken in the order of ``at``; triggers must follow it.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, top, before = state.get if state.exists else (None, 0, 0)
        out = []
        for t, v in sorted(r for f in frames for r in zip(f[at].tolist(), f[x].tolist(), strict=True)):
            if last is not None and v <= last:
                before, top = before + top, 0
            last, top = v, max(top, v)
            out.append((k[0], t, v, v + before))
        state.update((last, top, before))
        yield pd.DataFrame(out, columns=[key, at, x, "stitched"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    fields = f"{key} {kinds[key]}, {at} {kinds[at]}, {x} long, stitched long"
    return df.select(key, at, x).groupBy(key).applyInPandasWithState(step, fields, "last long, top long, before long", "append", GroupStateTimeout.NoTimeout)


def append_intervals(df: DataFrame, path: str, checkpoint: str, every: str = "40 seconds"):
    """Append finished intervals to Parquet; restarts go on from the checkpoint."""
    return df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
