"""Token-id files: frequency ranks in byte-aligned variable-length coding with separate control bytes.

1. Documents are dealt into ranges of ids, sorted, and encoded by a public tokenizer (``WordIds``:
   each distinct piece once as long as it is kept; white space never joins what stands beside it, so
   words encode as they do in their text). Ids go into an intermediate table in order.
2. All ids are counted; the driver gets one count per id, bounded by the vocabulary, and ranks
   them: most frequent first, smaller id first among equals.
3. Consecutive documents are written as files of about ``BLOCK`` ids (a longer document has a file
   of its own): each id's rank takes one to four bytes, and two bits of a control byte say how many.
   A file belongs to the attempt that wrote it; the manifest, a table, names the files that count.
4. Files are read back by the manifest, control bytes decoded by table lookup.

Format of a file, little endian: ``MAGIC``, then as 64-bit numbers documents, ids, data bytes; 64-bit
document ids; a null bit per document (packed, most significant first); 64-bit sizes of documents;
control bytes, (ids + 3) // 4, the first id in the lowest two bits; data bytes; CRC-32 of all before.
Ranks of a table are in one more file: the ids in order of rank, 32 bits each.

Defined cases: a null text is empty and has the end id alone; null ids come first; rows of one
id follow by a hash of their texts; repeated rows count each; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import shared_folder
from .common import materialize
from .textnum import runs, texts_of, words, xxh64

MAGIC = b"FLTOKEN1"
BLOCK = 4_000_000
END = 1
#: Sizes of the four ranks of each control byte.
SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1
#: ASCII letters and digits; marks that, behind one of them, stand for a piece of their own.
_ALNUM, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK[list(b".,;:!?")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _pieces(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, start, end, first) of pieces: words of texts, a mark behind a Latin letter or digit apart; text i has the pieces first[i]:first[i + 1].

    The tokenizer's patterns part such a mark, too. Words of ASCII alone are lower-cased, as the tokenizer does
    with all; others are left to it, and so are words with <, which may name special tokens.
    """
    w = words(texts, lower=False)
    if not len(w.start):
        return w.buf, w.start, w.end, w.first
    size = w.end - w.start
    odd = np.concatenate([[0], np.cumsum((w.buf >= 128) | (w.buf == ord("<")))])
    odd = odd[w.end] > odd[w.start]
    buf = np.where(np.repeat(odd, size + 1), w.buf, _LOWER[w.buf])
    last, prev, third = buf[w.end - 1], buf[np.maximum(w.end - 2, 0)], buf[np.maximum(w.end - 3, 0)]
    letter = (third == 0xC3) & (prev >= 0x80) & (prev != 0x97) & (prev != 0xB7)  # two bytes, U+00C0 to U+00FF without the signs of times and division
    cut = _MARK[last] & ((size > 1) & _ALNUM[prev] | (size > 2) & letter)
    upto = np.concatenate([[0], np.cumsum(1 + cut)])
    start, end = np.repeat(w.start, 1 + cut), np.repeat(w.end, 1 + cut)
    end[upto[:-1][cut]] -= 1
    start[upto[:-1][cut] + 1] = w.end[cut] - 1
    return buf, start, end, upto[w.first]


def _plain(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether a piece has letters of ASCII or of U+00C0 to U+00FF alone: to the tokenizer's patterns it is one piece, too."""
    follows = np.append(buf[1:], np.uint8(0))
    lead = (buf == 0xC3) & (follows >= 0x80) & (follows != 0x97) & (follows != 0xB7)
    good = _ALNUM[buf] & (buf > 57) | lead
    good[1:] |= lead[:-1]
    upto = np.concatenate([[0], np.cumsum(good)])
    return upto[end] - upto[start] == end - start


def _ends(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first and the last eight bytes of each piece and its size, in one number; up to eight bytes it is exact."""
    padded = np.concatenate([np.zeros(8, np.uint8), buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))
    size = np.minimum(end - start, 8).astype(np.uint64)
    keep = np.where(size == 8, np.uint64(2**64 - 1), (np.uint64(1) << (size * np.uint64(8) % np.uint64(64))) - np.uint64(1))
    with np.errstate(over="ignore"):
        return (eight[start + 8] & keep) + (eight[end] >> (np.uint64(64) - np.maximum(size, 1) * np.uint64(8))) * np.uint64(0x9E3779B185EBCA87) * (end - start > 8) + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


class WordIds:
    """Ids of texts through ids of their pieces, each kept piece encoded once.

    Pieces are known by XXH64; a piece that shares it with another one is told by its ends and size, and encoded
    by itself.
    """

    def __init__(self, path: str, most: int = 600_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.known, self.at, self.ends = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint64)
        self.first, self.flat = np.zeros(1, np.int64), np.empty(0, self.width)

    def _encode(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, together: int = 100) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, how many each piece has); plain pieces are encoded many in one text, where an id that ends a word ends a piece."""
        data, plain = buf.tobytes(), _plain(buf, start, end)
        order = np.argsort(~plain, kind="stable")
        made = [data[a:b] for a, b in zip(start[order].tolist(), end[order].tolist(), strict=True)]
        cut = int(plain.sum())
        ids = self._ids([b" ".join(made[i : min(i + together, cut)]) for i in range(0, cut, together)])[0]
        size = np.diff(np.flatnonzero(self.closes[ids]), prepend=-1)
        if len(size) != cut or size.sum() != len(ids):
            ids, size = self._ids(made[:cut])
        more, sizes = self._ids(made[cut:])
        ids, size = np.concatenate([ids, more]), np.concatenate([size, sizes])
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        first = (np.cumsum(size) - size)[back]
        size = size[back]
        return ids[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())], size

    def _ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.concatenate([np.array(f, self.width) for f in found]) if found else np.empty(0, self.width), size

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, how many each text has)."""
        buf, start, end, first = _pieces(texts)
        if not len(start):
            return np.empty(0, self.width), np.zeros(len(texts), np.int64)
        u, where, back = np.unique(xxh64(buf, start, end), return_index=True, return_inverse=True)
        ends = _ends(buf, start, end)
        new = ~np.isin(u, self.known, assume_unique=True)
        if 2 * new.sum() > len(u) and len(self.known) > self.most:  # what is kept is no longer of use
            self._clear()
            new[:] = True
        known, at, told, edges, flat = self.known, self.at, self.ends, self.first, self.flat
        if new.any():
            ids, size = self._encode(buf, start[where[new]], end[where[new]])
            place = np.searchsorted(known, u[new])
            known, at = np.insert(known, place, u[new]), np.insert(at, place, len(edges) - 1 + np.arange(len(size)))
            told = np.concatenate([told, ends[where[new]]])
            edges, flat = np.concatenate([edges, edges[-1] + np.cumsum(size)]), np.concatenate([flat, ids])
            if len(self.known) < self.most:  # else these pieces are known for this call only
                self.known, self.at, self.ends, self.first, self.flat = known, at, told, edges, flat
        which = at[np.searchsorted(known, u)][back]
        other = np.flatnonzero(told[which] != ends)
        if len(other):
            ids, size = self._encode(buf, start[other], end[other])
            which[other] = len(edges) - 1 + np.arange(len(size))
            edges, flat = np.concatenate([edges, edges[-1] + np.cumsum(size)]), np.concatenate([flat, ids])
        n = edges[which + 1] - edges[which]
        out = flat[np.repeat(edges[which] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        upto = np.concatenate([[0], np.cumsum(n)])
        return out, upto[first[1:]] - upto[first[:-1]]


def packed(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    four = np.zeros((len(ranks) + 3) // 4 * 4, np.uint8)
    four[: len(ranks)] = code
    control = (four.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    return control.tobytes(), data.tobytes()


def unpacked(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks of control and data bytes."""
    size = SIZES[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    last = np.cumsum(size, dtype=np.int64)
    if (last[-1] if n else 0) != len(data):
        raise ValueError("the data bytes do not fit the control bytes")
    raw, start = np.frombuffer(data, np.uint8), last - size
    out = raw[start].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= raw[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def block(doc_ids: list[int | None], sizes: np.ndarray, ranks: np.ndarray) -> bytes:
    """The bytes of a file."""
    control, data = packed(ranks)
    known = np.array([0 if i is None else i for i in doc_ids], "<i8")
    null = np.packbits(np.array([i is None for i in doc_ids], bool))
    body = MAGIC + struct.pack("<QQQ", len(doc_ids), len(ranks), len(data)) + known.tobytes() + null.tobytes() + sizes.astype("<i8").tobytes() + control + data
    return body + struct.pack("<I", zlib.crc32(body))


def parsed(body: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, sizes, ranks) of a file's bytes."""
    if body[:8] != MAGIC or zlib.crc32(memoryview(body)[:-4]) != struct.unpack("<I", body[-4:])[0]:
        raise ValueError("not a whole token file")
    docs, ids, data = struct.unpack("<QQQ", body[8:32])
    edges = np.cumsum([32, 8 * docs, (docs + 7) // 8, 8 * docs, (ids + 3) // 4, data]).tolist()
    known, null, sizes, control, held = (body[a:b] for a, b in zip(edges, edges[1:], strict=False))
    gone = np.unpackbits(np.frombuffer(null, np.uint8), count=docs)
    doc_ids = [None if g else i for i, g in zip(np.frombuffer(known, "<i8").tolist(), gone.tolist(), strict=True)]
    return doc_ids, np.frombuffer(sizes, "<i8"), unpacked(control, held, ids)


def _place(uri: str) -> tuple[files.FileSystem, str]:
    """A file system and its path; shared stores are named by their usual schemes."""
    return files.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/(?=[^/])", "file:///", uri)))


def put(uri: str, body: bytes) -> None:
    where, path = _place(uri)
    where.create_dir(os.path.dirname(path), recursive=True)
    with where.open_output_stream(path) as out:
        out.write(body)


def get(uri: str) -> bytes:
    where, path = _place(uri)
    with where.open_input_file(path) as source:
        return source.read()


_kept: dict[str, WordIds] = {}


def encoded(df: DataFrame, tokenizer: str, end: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, ids (bytes) with the place of each row in the order of ids: part, at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = _kept.get(tokenizer) or _kept.setdefault(tokenizer, WordIds(tokenizer))
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for start, stop in runs(list(map(len, texts))):
                ids, n = coder(texts[start:stop])
                parts = np.split(ids, np.cumsum(n)[:-1])
                last = np.array([end], coder.width).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(stop - start, part, np.int32)), pa.array(np.arange(at, at + stop - start)), batch.column("doc_id").slice(start, stop - start), pa.array(n + 1), pa.array([p.tobytes() + last for p in parts], pa.binary())],
                    ["part", "at", "doc_id", "n", "ids"],
                )
                at += stop - start

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text"), F.monotonically_increasing_id()]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order[:2]).mapInArrow(run, "part int, at long, doc_id long, n long, ids binary")


def ranked_ids(rows: DataFrame, width: np.dtype, vocabulary: int) -> np.ndarray:
    """All ids that occur, most frequent first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(vocabulary, np.int64)
        for batch in batches:
            sums += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), width), minlength=vocabulary)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["id", "n"])

    found = rows.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r["id"] for r in sorted(found, key=lambda r: (-r["n"], r["id"]))], "<u4")


def write(df: DataFrame, tokenizer: str, end: int = END, id_col: str = "doc_id", text_col: str = "text", most: int = BLOCK) -> tuple[DataFrame, str]:
    """(manifest, file of ranks). Manifest: part, at, docs, ids, start (ids before), path, in any order."""
    spark = df.sparkSession
    probe = WordIds(tokenizer)
    width, vocabulary = probe.width, max(probe.tokenizer.get_vocab_size(with_added_tokens=True), end + 1)
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    encoded(df, tokenizer, end, id_col, text_col).write.option("compression", "zstd").parquet(f"{folder}/encoded")
    rows = spark.read.parquet(f"{folder}/encoded")
    order = ranked_ids(rows, width, vocabulary)
    put(f"{folder}/ranks.u4", order.tobytes())

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.zeros(vocabulary, "<u4")
        ids_by_rank = np.frombuffer(get(f"{folder}/ranks.u4"), "<u4")
        rank[ids_by_rank] = np.arange(len(ids_by_rank))
        held: list[tuple[int | None, bytes]] = []
        begun, total = (0, 0), 0

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(b) // width.itemsize for _, b in held], np.int64)
            path = f"{folder}/ids/{begun[0]:06d}-{begun[1]:012d}-{uuid.uuid4().hex}.ids"
            put(path, block([i for i, _ in held], sizes, rank[np.frombuffer(b"".join(b for _, b in held), width)]))
            values = (pa.array([begun[0]], pa.int32()), pa.array([begun[1]], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([int(sizes.sum())], pa.int64()), pa.array([path]))
            return pa.RecordBatch.from_arrays(list(values), ["part", "at", "docs", "ids", "path"])

        for batch in batches:
            for part, at, doc_id, n, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "doc_id", "n", "ids")), strict=True):
                if held and (total + n > most or (part, at) != (begun[0], begun[1] + len(held))):
                    yield flush()
                    held, total = [], 0
                if not held:
                    begun = part, at
                held.append((doc_id, ids))
                total += n
        if held:
            yield flush()

    manifest = materialize(rows.mapInArrow(save, "part int, at long, docs long, ids long, path string"), "tokens-manifest")
    return with_starts(manifest), f"{folder}/ranks.u4"


def with_starts(manifest: DataFrame, together: int = 512) -> DataFrame:
    """The manifest with the ids before each file: sums of groups of parts, of parts, and of files are added up apart."""
    before = lambda column, *keys, order: F.coalesce(F.sum(column).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("_n")).withColumn("_g", F.floor(F.col("part") / together))
    groups = parts.groupBy("_g").agg(F.sum("_n").alias("_sum")).withColumn("_one", F.lit(0))
    groups = groups.select("_g", before("_sum", "_one", order="_g").alias("_groups"))
    parts = parts.join(groups, "_g").select("part", (F.col("_groups") + before("_n", "_g", order="part")).alias("_parts"))
    return manifest.join(parts, "part").select("part", "at", "docs", "ids", (F.col("_parts") + before("ids", "part", order="at")).alias("start"), "path")


def read(manifest: DataFrame, ranks: str, digest: bool = False) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens and ids, or instead of them ids_crc32 of their 32-bit little-endian bytes."""
    kind = "ids_crc32 long" if digest else "ids array<int>"

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                table = np.frombuffer(get(ranks), "<u4") if table is None else table
                doc_ids, sizes, found = parsed(get(path))
                ids = table[found]
                edges = np.concatenate([[0], np.cumsum(sizes)])
                if digest:
                    raw = memoryview(ids.tobytes())
                    last = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + edges[:-1]), pa.array(sizes), last], ["doc_id", "start", "n_tokens", kind.split()[0]])

    manifest = materialize(manifest, "tokens-starts")
    dealt = manifest.select("path", "start").repartition(max(1, min(manifest.count(), 10_000)))
    return dealt.mapInArrow(load, f"doc_id long, start long, n_tokens long, {kind}")


def token_digest(df: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    return read(*write(df, tokenizer, end), digest=True)
