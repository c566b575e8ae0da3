"""SimHash near-deduplication with multi-index hashing.

A fingerprint has a bit set where over half of the XXH64 hashes of a text's 3-word shingles
have it. Fingerprints within ``RADIUS`` bits are linked: the 64 bits are cut into two segments
of 32, one of which differs in at most ``RADIUS // 2`` bits; the small Hamming ball around
each segment is enumerated, looked up in the table of segments, and the complete distance of
every match is verified. Links run between distinct fingerprints only, so groups of copies
cost nothing, and components come from star contraction.

A segment that over ``DENSE`` fingerprints share emits no pairs. Its fingerprints meet at the
points of the other segment within 1 bit (near) or 2 bits (far) of theirs: at one point, near
ones that hold the segment itself are within 3 bits of all others that count, so all link to the
first of them. This keeps what is connected, and a point has at most 33 + 496 + 33 * 32 members.

Defined cases: a null or empty text has fingerprint 0 and is linked like any other; fewer
than 3 words are one shingle; null ids are ignored as component names (null where a component
has no other); repeated rows share a fingerprint; an empty table gives an empty table; other
columns are ignored by ``near_groups`` and carried by ``keep_near``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.components import components
from .common import materialize, text_or_empty, with_facts
from .textnum import runs, shingle_ends, texts_of, words, xxh64

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints that share a segment, up to which all their pairs are verified one by one.
DENSE = 1_000
_LANES = np.uint64(0x0101010101010101)


def _bit_counts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, 64): how many of a text's hashes have each bit; every text has some.

    Eight bits at a time are summed in the byte lanes of 64-bit words, over blocks of at
    most 255 hashes so that no lane runs over.
    """
    of = np.diff(first)
    blocks = -(-of // 255)
    begin = np.concatenate([[0], np.cumsum(blocks)])
    at = np.repeat(first[:-1] - 255 * begin[:-1], blocks) + 255 * np.arange(begin[-1])
    counts = np.empty((len(of), 64), np.int64)
    for s in range(8):
        lanes = np.add.reduceat((h >> np.uint64(s)) & _LANES, at)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), begin[:-1], axis=0)
        counts[:, s::8] = sums
    return counts


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """One unsigned 64-bit fingerprint per text."""
    w = words(texts)
    first, start, end = shingle_ends(w, SHINGLE)
    of = np.diff(first)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(of)
    if len(full):
        h = xxh64(w.buf, start, end, SEED)
        counts = _bit_counts(h, np.concatenate([first[full], first[-1:]]))
        bits = counts * 2 > of[full][:, None]
        out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_of(batch.column(batch.num_columns - 1))
        parts = [fingerprints(texts[a:b]) for a, b in runs([len(t) for t in texts])]
        prints = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(prints)], names=[*batch.schema.names[:-1], "_fp"])


def fingerprinted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _fp) per row, the fingerprint as a signed 64-bit integer."""
    bare = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = bare.schema["_id"].dataType.simpleString()
    return bare.mapInArrow(_fingerprinted, f"_id {kind}, _fp long")


_LOW = 0xFFFFFFFF


def _segments() -> Column:
    """(key, rest) of both segments of ``_fp``; bit 32 of a key tells which it is."""
    high, low = F.shiftrightunsigned("_fp", 32), F.col("_fp").bitwiseAND(F.lit(_LOW))
    return F.array(F.struct(high.alias("key"), low.alias("rest")), F.struct(low.bitwiseOR(F.lit(1 << 32)).alias("key"), high.alias("rest")))


def _flips(masks: list[int]) -> Column:
    return F.array(*[F.lit(m).cast("long") for m in masks])


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): pairs a < b of the distinct fingerprints ``_fp`` at most ``radius`` bits apart.

    Of fingerprints that share a dense segment not all pairs, but as many as connect the same ones.
    """
    if radius > 3:
        raise ValueError("two segments reach 3 bits")
    table = prints.select("_fp", F.explode(_segments()).alias("s")).select("_fp", F.col("s.key").alias("_key"), F.col("s.rest").alias("_rest"))
    ball = [0, *[1 << i for i in range(32)]] if radius >= 2 else [0]
    probes = table.withColumn("_flip", F.explode(_flips(ball))).select("_fp", F.col("_key").bitwiseXOR(F.col("_flip")).alias("_key"), "_rest", (F.col("_flip") != 0).alias("_off"))
    # merge joins: exploded keys are many though their compressed size is small, so they must not be broadcast
    dense = materialize(table.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > DENSE), "simhash-dense")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    if dense.isEmpty():
        met = probes.select(F.col("_fp").alias("a"), "_key").hint("merge").join(table.select(F.col("_fp").alias("b"), "_key"), "_key")
        return met.where(near).select("a", "b").distinct()
    sparse = table.select(F.col("_fp").alias("b"), "_key").hint("merge").join(dense, "_key", "left_anti")
    met = probes.select(F.col("_fp").alias("a"), "_key").hint("merge").join(sparse, "_key").where(near).select("a", "b")
    return met.unionByName(_dense_links(probes.hint("merge").join(dense.select("_key"), "_key"), radius)).distinct()


def _dense_links(probes: DataFrame, radius: int) -> DataFrame:
    """Links that connect what is within ``radius`` among the fingerprints at dense segments.

    probes: (_key, _fp, _rest, _off); off: its own segment is one bit away from the key.
    """
    ones = [1 << i for i in range(32)]
    # own: the segment itself; bits of the rest that near and far members may differ in from a point
    near, far, off = {3: (1, 2, 1), 2: (1, None, 0), 1: (0, 1, None), 0: (0, None, None)}[radius]
    balls = {0: [0], 1: [0, *ones], 2: [x | y for i, x in enumerate(ones) for y in ones[:i]]}
    kinds = [(0, ~F.col("_off"), balls[near])]
    if far is not None:
        kinds.append((1, ~F.col("_off"), balls[far] if far == 2 else ones))
    if off is not None:
        kinds.append((2, F.col("_off"), balls[off]))
    at = F.col("_rest").bitwiseXOR(F.col("_mask")).alias("_point")
    parts = [probes.where(who).withColumn("_mask", F.explode(_flips(masks))).select("_key", "_fp", at, F.lit(kind).alias("_kind")) for kind, who, masks in kinds]
    members = parts[0]
    for p in parts[1:]:
        members = members.unionByName(p)
    first = F.min(F.when(F.col("_kind") == 0, F.col("_fp"))).over(W.partitionBy("_key", "_point"))
    met = members.withColumn("_first", first).where("_first <> _fp")
    return met.select(F.least("_first", "_fp").alias("a"), F.greatest("_first", "_fp").alias("b")).distinct()


def _named(light: DataFrame, least: Column) -> tuple[DataFrame, int]:
    """(_fp, _n, _best) of every distinct fingerprint: its rows, and the ``least`` of its component's; all rows."""
    prints = materialize(light.groupBy("_fp").agg(F.min(least).alias("_least"), F.count(F.lit(1)).alias("_n")), "simhash-prints")
    roots = components(links(prints.select("_fp")))
    rooted = prints.hint("merge").join(roots.select(F.col("node").alias("_fp"), "root"), "_fp", "left").withColumn("_root", F.coalesce("root", "_fp")).drop("root")
    rooted = materialize(rooted, "simhash-rooted")
    names = rooted.groupBy("_root").agg(F.min("_least").alias("_best"), F.count(F.lit(1)).alias("_prints"))
    sums = rooted.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    named = with_facts(rooted, names, "_root", "_prints", sums[0]).select("_fp", "_n", "_best")
    return materialize(named, "simhash-named"), sums[1]


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint, component_id."""
    light = materialize(fingerprinted(df, id_col, text_col), "simhash-light")
    named, rows = _named(light, F.col("_id"))
    out = with_facts(light, named, "_fp", "_n", rows)
    return out.select(F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("_best").alias("component_id"))


def keep_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: of each component the row of the least id.

    Of rows of a component that share this id, the text of the least hash stays, and of equal
    ones the row whose JSON has the least hash; a row without an id cannot be named and stays.
    """
    hashed = df.withColumns({"_i": F.col(id_col), "_t": text_or_empty(text_col)}).where("_i is not null").select("_i", "_t")
    prints = hashed.select(F.struct("_i", F.xxhash64("_t").alias("_x")).alias("_i"), "_t")
    light = materialize(fingerprinted(prints, "_i", "_t"), "simhash-light")
    keep = _named(light, F.col("_id"))[0].select(F.col("_best._i").alias("_keep"), F.col("_best._x").alias("_hash")).distinct()
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(id_col).alias("_key"), F.xxhash64(text_or_empty(text_col)).alias("_x"))
    kept = rows.join(keep, (F.col("_key") == F.col("_keep")) & (F.col("_x") == F.col("_hash")), "left_semi")
    kept = kept.groupBy("_key", "_x").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
    return kept.select("_row.*").unionByName(rows.where(F.col("_key").isNull()).select("_row.*"))
