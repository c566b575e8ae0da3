"""Packing into optimal length buckets.

Lengths are words plus one end mark; a document longer than ``max_len`` becomes several
pieces, whole. The global histogram of piece lengths (at most ``max_len`` rows) goes to the
driver, where dynamic programming chooses the ``buckets`` boundaries with the least padding.
Inside a bucket, pieces are numbered without gaps in the order of ids, and each run of
``budget // boundary`` numbers forms one batch, so a batch never exceeds the token budget,
which is at least ``max_len``.

Defined cases: a null or empty text is one piece of length 1 (the end mark); a null id is
carried; repeated rows are packed each; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, numbered, text_or_empty

MAX_LEN = 2048
BUCKETS = 12
BUDGET = 16_384


def boundaries(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Boundaries that minimise total padding when every length is padded to the next one."""
    lengths = np.array(sorted(k for k, v in histogram.items() if v > 0), dtype=np.int64)
    if not len(lengths):
        return []
    count = np.array([histogram[int(k)] for k in lengths], dtype=np.float64)
    n, total = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * lengths)])
    # cost of one bucket over lengths i..j: all padded to lengths[j]
    m = len(lengths)
    best, cuts = np.full(m + 1, np.inf), []
    best[0] = 0.0
    for _ in range(min(buckets, m)):
        cost = best[:m, None] + lengths[None, :] * (n[None, 1:] - n[:m, None]) - (total[None, 1:] - total[:m, None])
        cost[np.tril_indices(m, -1)] = np.inf
        from_ = cost.argmin(axis=0)
        step = np.concatenate([[0.0], cost[from_, np.arange(m)]])
        cuts.append(from_)
        best = np.concatenate([[np.inf], step[1:]])
    out, j = [], m
    for from_ in reversed(cuts):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(from_[j - 1])
    return out[::-1]


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN) -> DataFrame:
    """(doc_id, piece, start, n_tokens): the whole text cut into runs of at most ``max_len`` tokens."""
    tokens = F.regexp_count(text_or_empty(text_col), F.lit(WORD)) + 1
    out = df.select(F.col(id_col).alias("doc_id"), tokens.cast("long").alias("_tokens"))
    out = out.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_tokens") - 1) / max_len))))
    out = out.withColumn("start", F.col("piece") * max_len)
    return out.select("doc_id", "piece", "start", F.least(F.col("_tokens") - F.col("start"), F.lit(max_len)).cast("long").alias("n_tokens"))


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """One row per piece: doc_id, piece, start, n_tokens, bucket, padded_len, batch_id, position."""
    if budget < max_len:
        raise ValueError(f"a budget of {budget} does not hold a piece of {max_len}")
    cut = materialize(pieces(df, id_col, text_col, max_len), "pack-pieces")
    counted = {r["n_tokens"]: r["n"] for r in cut.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}  # max_len rows at most
    edges = boundaries(counted, buckets) or [max_len]
    bucket = F.lit(len(edges) - 1)
    for i in reversed(range(len(edges) - 1)):
        bucket = F.when(F.col("n_tokens") <= edges[i], F.lit(i)).otherwise(bucket)
    edge = F.element_at(F.array(*[F.lit(e) for e in edges]), F.col("bucket") + 1)
    out = cut.withColumn("bucket", bucket).withColumn("padded_len", edge.cast("long"))
    out = numbered(out, "bucket", ["doc_id", "piece", "n_tokens"], sum(counted.values()), "_slot")
    per_batch = F.floor(F.lit(budget) / F.col("padded_len"))
    out = out.withColumn("batch_id", F.floor(F.col("_slot") / per_batch)).withColumn("position", F.col("_slot") % per_batch)
    return out.select("doc_id", "piece", "start", "n_tokens", "bucket", "padded_len", "batch_id", F.col("position").cast("long").alias("position"))
