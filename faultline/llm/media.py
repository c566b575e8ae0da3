"""Media columns: ISO base media files in binary columns.

``write_media`` stores bytes as one lossless track of 8-bit samples; ``read_media`` walks the
nested boxes of any such file, decodes the sample tables (stts, stsc, stsz, stco or co64,
stss), and returns codec, duration and the byte ranges of key frames without touching the
payload; ``payload`` joins the samples' byte ranges.

Defined cases: a null or empty text has a payload of 64 zero bytes; a malformed or null
container has null fields; repeated rows and equal texts get equal values; a null id is
carried; an empty table gives an empty table; other columns are ignored. One document is in
memory at a time, besides its Arrow batch.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnum import texts_of

RATE = 8000
#: Bytes of one stored sample (a block of 8-bit samples), and every how many a key frame stands.
BLOCK, KEY_EVERY = 1024, 4
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body if len(body) < 0xFFFFFFF0 else struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def write_media(data: bytes) -> bytes:
    """An ISO media file with one audio track of unsigned 8-bit samples, ``data`` as they are."""
    whole, rest = divmod(len(data), BLOCK)
    sizes = [BLOCK] * whole + [rest] * bool(rest)
    n = len(sizes)
    keys = range(1, n + 1, KEY_EVERY)
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))

    def tables(at: int) -> bytes:
        runs = [(whole, BLOCK)] * bool(whole) + [(1, rest)] * bool(rest)
        return _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">I", len(runs)), *(struct.pack(">II", *r) for r in runs)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">IIII", 1, 1, max(n, 1), 1)),
            _full(b"stsz", struct.pack(f">II{n}I", 0, n, *sizes)),
            _full(b"co64", struct.pack(">IQ", 1, at)),
        )

    def movie(at: int) -> bytes:
        head = struct.pack(">IIII", 0, 0, RATE, min(len(data), 0xFFFFFFFF))
        return _box(
            b"moov",
            _full(b"mvhd", head, struct.pack(">IH", 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2)),
            _box(
                b"trak",
                _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, min(len(data), 0xFFFFFFFF)), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), MATRIX, bytes(8), flags=3),
                _box(
                    b"mdia",
                    _full(b"mdhd", head, struct.pack(">HH", 0x55C4, 0)),
                    _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"),
                    _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), tables(at)),
                ),
            ),
        )

    kind = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    start = len(kind) + len(movie(0)) + (8 if len(data) < 0xFFFFFFE0 else 16)
    return b"".join([kind, movie(start), _box(b"mdat", data)])


def boxes(data: memoryview, at: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(path, start, end) of each box's body, walking into those that hold boxes."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} at {at} runs past its parent")
        yield kind, at + head, at + size
        if kind in NESTED:
            for path, a, b in boxes(data, at + head, at + size):
                yield kind + b"/" + path, a, b
        at += size


def _ints(data: memoryview, at: int, n: int, kind: str = ">u4") -> np.ndarray:
    return np.frombuffer(data, dtype=kind, count=n, offset=at).astype(np.int64)


def _tracks(view: memoryview) -> list[dict[bytes, tuple[int, int]]]:
    """The boxes inside each track of a file by kind, in file order."""
    out: list[dict[bytes, tuple[int, int]]] = []
    for path, a, b in boxes(view):
        if path == b"moov/trak":
            out.append({})
        elif path.startswith(b"moov/trak/"):
            out[-1].setdefault(path.rpartition(b"/")[2], (a, b))
    return out


def _sizes(view: memoryview, found: dict[bytes, tuple[int, int]]) -> np.ndarray:
    """Sample sizes from stsz, or from the compact stz2 with fields of 4, 8 or 16 bits."""
    u32 = lambda at: struct.unpack_from(">I", view, at)[0]
    if b"stsz" in found:
        a = found[b"stsz"][0]
        same, n = u32(a + 4), u32(a + 8)
        return np.full(n, same, np.int64) if same else _ints(view, a + 12, n)
    a = found[b"stz2"][0]
    bits, n = view[a + 7], u32(a + 8)
    if bits == 4:
        pairs = _ints(view, a + 12, -(-n // 2), "u1")
        return np.stack([pairs >> 4, pairs & 15], 1).ravel()[:n]
    return _ints(view, a + 12, n, {8: "u1", 16: ">u2"}[bits])


def read_media(data: bytes) -> dict:
    """Codec, time scale, duration, sample ranges and key frames of the first track with samples.

    Tables are those of that track alone; where no track has samples, the first one counts.
    """
    view = memoryview(data)
    tracks = _tracks(view)
    if not tracks:
        raise ValueError("no track")
    filled = [t for t in tracks if (b"stsz" in t or b"stz2" in t) and len(_sizes(view, t))]
    found = (filled or tracks)[0]
    u32 = lambda at: struct.unpack_from(">I", view, at)[0]
    a = found[b"mdhd"][0]
    scale, duration = (u32(a + 20), struct.unpack_from(">Q", view, a + 24)[0]) if view[a] == 1 else (u32(a + 12), u32(a + 16))
    a = found[b"stsd"][0]
    codec = bytes(view[a + 12 : a + 16]).decode("latin-1").strip()
    sizes = _sizes(view, found)
    n = len(sizes)
    a, wide = (found[b"co64"][0], True) if b"co64" in found else (found[b"stco"][0], False)
    chunks = _ints(view, a + 8, u32(a + 4), ">u8" if wide else ">u4")
    a = found[b"stsc"][0]
    runs = _ints(view, a + 8, 3 * u32(a + 4)).reshape(-1, 3)
    ends = np.append(runs[1:, 0], len(chunks) + 1)
    per_chunk = np.repeat(runs[:, 1], ends - runs[:, 0])
    chunk = np.repeat(np.arange(len(chunks)), per_chunk)[:n]
    ahead = np.cumsum(sizes) - sizes
    first = np.concatenate([[0], np.cumsum(per_chunk)[:-1]])[: len(chunks)]
    offsets = chunks[chunk] + ahead - ahead[np.minimum(first, max(n - 1, 0))][chunk] if n else np.empty(0, np.int64)
    a = found[b"stts"][0]
    times = _ints(view, a + 8, 2 * u32(a + 4)).reshape(-1, 2)
    keys = np.arange(n)
    if b"stss" in found:
        a = found[b"stss"][0]
        keys = _ints(view, a + 8, u32(a + 4)) - 1
    return {"codec": codec, "scale": scale, "duration": duration, "ticks": int((times[:, 0] * times[:, 1]).sum()), "offsets": offsets, "sizes": sizes, "keys": keys}


def payload(data: bytes, info: dict) -> bytes:
    view = memoryview(data)
    return b"".join(bytes(view[o : o + s]) for o, s in zip(info["offsets"].tolist(), info["sizes"].tolist(), strict=True))


def feature(data: bytes, info: dict) -> str:
    """Codec, seconds, samples, key frames, level and changes of the stored 8-bit samples."""
    x = np.frombuffer(payload(data, info), np.uint8)
    counts = np.bincount(x, minlength=256) / max(len(x), 1)
    entropy = -float((counts[counts > 0] * np.log2(counts[counts > 0])).sum())
    jumps = int((np.diff(x.astype(np.int16)) != 0).sum())
    return f"{info['codec']};rate={info['scale']};seconds={info['duration'] / info['scale']:.3f};samples={len(info['sizes'])};keys={len(info['keys'])};mean={x.mean():.4f};entropy={entropy:.6f};changes={jumps}"


DIGEST = pa.schema(
    [
        ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()),
        ("feature", pa.string()), ("codec", pa.string()), ("duration", pa.float64()), ("key_offsets", pa.list_(pa.int64())), ("key_lengths", pa.list_(pa.int64())),
    ]
)


def _digest(text: bytes) -> tuple:
    data = text + bytes(-len(text) % 64 or (0 if text else 64))
    stored = write_media(data)
    info = read_media(stored)
    back = payload(stored, info)
    keys = info["keys"]
    return (
        len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(),
        feature(stored, info), info["codec"], info["duration"] / info["scale"], info["offsets"][keys], info["sizes"][keys],
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            rows = [_digest(t) for t in texts_of(part.column(1))]
            columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(DIGEST)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", *DIGEST.names])


def media_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the text stored as an ISO media file, read back, and described."""
    bare = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = bare.schema["doc_id"].dataType.simpleString()
    fields = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration double, key_offsets array<long>, key_lengths array<long>"
    return bare.mapInArrow(_digests, f"doc_id {kind}, {fields}")


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for value in batch.column(1):
            try:
                info = read_media(value.as_buffer().to_pybytes())
                keys = info["keys"]
                rows.append((info["codec"], info["duration"] / info["scale"], info["offsets"][keys], info["sizes"][keys]))
            except (ValueError, KeyError, IndexError, struct.error, ZeroDivisionError, AttributeError):  # not such a file
                rows.append((None,) * 4)
        kinds = [DIGEST.field(k).type for k in ("codec", "duration", "key_offsets", "key_lengths")]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["id", "codec", "duration", "key_offsets", "key_lengths"])


def describe_media(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """Per row of a binary column with ISO media files: id, codec, duration, key-frame ranges."""
    bare = df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    kind = bare.schema["id"].dataType.simpleString()
    return bare.mapInArrow(_described, f"id {kind}, codec string, duration double, key_offsets array<long>, key_lengths array<long>")
