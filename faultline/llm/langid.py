"""Language identification by compression.

For each language that labelled rows name, a zstandard raw-content dictionary is made of
training text; a text is compressed with every dictionary, in blocks, and the language of the
smallest total wins. A prediction is marked ``rejected`` where the runner-up is nearly as
small.

Training texts: of each language the documents that come first by a hash of their id, among
those outside the held-out fold, whole, at most ``DOCS`` and as far as they fit into
``DICTIONARY`` bytes; texts that alone exceed it are left out, but where a language has no
other, its shortest one is taken. This bounds what the driver gets by the number of languages.
Every text is classified whole, and all by the same coders.

Defined cases: null text, or none of its characters a letter: ``und``, score 0; a null
language teaches nothing; without any labelled language all are ``und``; a null id counts as
the text '' for folds; repeated rows get equal results; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fold, share_for, uniform

DOCS, DICTIONARY = 400, 96_000
BLOCK, LEVEL = 16_384, 12
_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Relative margin under which a prediction is rejected, and the margin that gives a score of 0.73.
NARROW, SCALE = 0.01, 0.05


def dictionaries(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, bytes]:
    """Of each language, up to ``DICTIONARY`` bytes of lower-case training text."""
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(id_col, 3) != 1))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("_id"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return {}
    few = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], share_for(DOCS, r["n"]))])
    plain = rows.select("lang", uniform("_id", 3).alias("h"), F.lower(F.regexp_replace("text", r"[^\p{L}]+", " ")).alias("text")).withColumn("size", F.octet_length("text"))
    least = plain.groupBy("lang").agg(F.min("size").alias("size"), F.min_by("text", "size").alias("text")).where(F.col("size") > DICTIONARY)
    plain = plain.where((F.col("h") < few[F.col("lang")]) & (F.col("size") <= DICTIONARY))
    order = W.partitionBy("lang").orderBy("h", F.xxhash64("text"))
    kept = plain.withColumns({"nth": F.row_number().over(order), "upto": F.sum(F.col("size") + 1).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))})
    kept = kept.where((F.col("nth") <= DOCS) & (F.col("upto") <= DICTIONARY + 1)).select("lang", "nth", "text")
    # the more frequent language first: it wins ties
    out: dict[str, list[str]] = {r["lang"]: [] for r in sorted(counts, key=lambda r: (-r["n"], r["lang"]))}
    for r in kept.unionByName(least.select("lang", F.lit(1).alias("nth"), "text")).orderBy("lang", F.desc("nth")).collect():  # DICTIONARY bytes a language
        out[r["lang"]].append(r["text"])
    return {k: " ".join(v).encode() for k, v in out.items()}


def _coder(data: bytes, level: int) -> zstandard.ZstdCompressor:
    made = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=made, write_content_size=False, write_checksum=False)


class Classifier:
    """Compresses with one dictionary per language."""

    def __init__(self, content: dict[str, bytes]) -> None:
        self.names = list(content)
        self.coders = [_coder(content[name], LEVEL) for name in self.names]

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.names or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        data = _NOT_LETTERS.sub(" ", text.lower()).encode("utf-8", "surrogatepass")
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        sizes = sorted((sum(len(c.compress(b)) for b in blocks), i) for i, c in enumerate(self.coders))
        if len(sizes) == 1:
            return self.names[0], 1.0, False
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        return self.names[sizes[0][1]], 1 / (1 + math.exp(-margin / SCALE)), margin < NARROW


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, rejected."""
    content = df.sparkSession.sparkContext.broadcast(dictionaries(df, id_col, text_col, lang_col))  # DICTIONARY bytes a language
    bare = df.select(F.col(id_col).alias("doc_id"), (fold(id_col, 3) == 1).alias("held_out"), F.col(text_col).alias("text"))
    kind = bare.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(content.value)
        for batch in batches:
            found = [classify(t.as_py()) for t in batch.column(2)]
            columns = [pa.array([x[i] for x in found], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return bare.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
