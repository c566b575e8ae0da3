"""Scoring documents with a language model, beside a smoothed unigram base.

1. One pass over the training fold counts words, subword ids and pairs of ids; counts are
   added up by key, so the vocabulary stays distributed.
2. Classes and priors of the model (lm.py) come from these counts, of all training text.
   The network itself is trained on the same text, every token once, by tasks that each read at
   least about ``TRAINER_WORDS`` words; their weights are averaged ``ROUNDS`` times on the way.
3. One pass over all documents scores every token once. Counts of words that make up at
   least 1 / ``HEAVY`` of all training words (so at most ``HEAVY`` words) are broadcast; a
   document's other words are joined with the vocabulary by hash and summed per document.
   So it is with pairs of ids, of which those of at least 1 / ``PAIRS`` are broadcast.

The model's text is the sequence of lower-cased words, each with a leading space, cut into
the subword ids of a public tokenizer, and one end id. Its score is the log10 probability of
that sequence. A word longer than ``LONGEST`` characters is encoded whole, in pieces of so many.

Defined cases: a null text is empty: one end token; a null id counts as the text '' for
folds; without training rows every base score is 0 and the model is uniform; repeated rows
get equal scores; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lm
from .common import fold, materialize
from .textnum import Words, runs, texts_of, words, xxh64

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How text is split before merges; it belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONGEST = 200
SHIFT = 1 << 17
#: A trainer per so many training words.
TRAINER_WORDS, ROUNDS = 600_000, 3
HEAVY = PAIRS = 1_000_000
SEED = 42


#: Of many hashes: the distinct ones in order, where each stands first, and which of them each is.
Distinct = tuple[np.ndarray, np.ndarray, np.ndarray]


def distinct_words(w: Words) -> Distinct:
    return np.unique(xxh64(w.buf, w.start, w.end, SEED), return_index=True, return_inverse=True)


class Coder:
    """Subword ids of words, each distinct word encoded once as long as it is kept."""

    def __init__(self, ranks: dict[bytes, int], most: int = 400_000) -> None:
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.opens = np.zeros(self.end, bool)
        self.opens[[i for b, i in ranks.items() if b[:1] == b" "]] = True
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.known, self.at = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.first, self.flat = np.zeros(1, np.int64), np.empty(0, np.int64)

    def _encode(self, word: bytes) -> list[int]:
        text = " " + word.decode("utf-8", "replace")
        if len(text) <= LONGEST:
            return self.encoding.encode_ordinary(text)
        return [t for i in range(0, len(text), LONGEST) for t in self.encoding.encode_ordinary(text[i : i + LONGEST])]

    def _encode_all(self, made: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each word has): many words as one text, in which an id that opens with a space starts a word."""
        if made and max(map(len, made)) < LONGEST:
            ids = np.array(self.encoding.encode_ordinary(" " + b" ".join(made).decode("utf-8", "replace")), np.int64)
            start = np.flatnonzero(self.opens[ids])
            if len(start) == len(made) and start[0] == 0:
                return ids, np.diff(np.append(start, len(ids)))
        lists = [self._encode(x) for x in made]
        return np.array([t for m in lists for t in m], np.int64), np.fromiter(map(len, lists), np.int64, len(lists))

    def __call__(self, w: Words, distinct: Distinct) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, how many each word has)."""
        u, where, back = distinct
        if len(self.known) > self.most:
            self._clear()
        new = ~np.isin(u, self.known, assume_unique=True)
        if new.any():
            data, pick = w.buf.tobytes(), where[new]
            size = (w.end - w.start)[pick]
            # long words last, so that they do not hold the others up
            order = np.argsort(size >= LONGEST, kind="stable")
            pick, cut = pick[order], int((size < LONGEST).sum())
            made = [data[a:b] for a, b in zip(w.start[pick].tolist(), w.end[pick].tolist(), strict=True)]
            parts = [self._encode_all(made[:cut]), self._encode_all(made[cut:])]
            ids, sizes = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            at = np.empty(len(made), np.int64)
            at[order] = len(self.first) - 1 + np.arange(len(made))
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
            self.flat = np.concatenate([self.flat, ids])
            known, at = np.concatenate([self.known, u[new]]), np.concatenate([self.at, at])
            order = np.argsort(known, kind="stable")
            self.known, self.at = known[order], at[order]
        at = self.at[np.searchsorted(self.known, u)][back]
        n = self.first[at + 1] - self.first[at]
        return self.flat[np.repeat(self.first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())], n


def sequences(coder: Coder, w: Words, distinct: Distinct) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first): the ids of each text followed by the end id."""
    ids, n = coder(w, distinct)
    upto = np.concatenate([[0], np.cumsum(n)])
    first = upto[w.first] + np.arange(len(w.first))
    out = np.full(first[-1], coder.end)
    keep = np.ones(len(out), bool)
    keep[first[1:] - 1] = False
    out[keep] = ids
    return out, first


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}


def _add_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    u, back = np.unique(key, return_inverse=True)
    return u, np.bincount(back, n, len(u)).astype(np.int64)


def _statistics(df: DataFrame, ranks: Broadcast) -> DataFrame:
    """(kind, key, n) over training texts: 0 words by hash, 1 pairs of ids, 2 texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, found = Coder(ranks.value), {0: [], 1: []}

        def out(kind: int) -> pa.RecordBatch:
            key, n = _add_up(found[kind])
            found[kind] = []
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind)), pa.array(key.view(np.int64)), pa.array(n)], names=["kind", "key", "n"])

        texts_seen = 0
        for batch in batches:
            texts = texts_of(batch.column(0))
            texts_seen += len(texts)
            for a, b in runs([len(t) for t in texts]):
                w = words(texts[a:b])
                distinct = distinct_words(w)
                found[0].append((distinct[0], np.bincount(distinct[2], minlength=len(distinct[0]))))
                ids, first = sequences(coder, w, distinct)
                before = np.concatenate([[0], ids[:-1]])
                before[first[:-1]] = coder.end  # the end id also stands for the start
                found[1].append(np.unique(before * SHIFT + ids, return_counts=True))
                for kind in found:
                    if sum(len(k) for k, _ in found[kind]) > 2_000_000:
                        yield out(kind)
        for kind in found:
            if found[kind]:
                yield out(kind)
        yield pa.RecordBatch.from_arrays([pa.array([2]), pa.array([0]), pa.array([texts_seen])], names=["kind", "key", "n"])

    counted = df.mapInArrow(run, "kind long, key long, n long")
    return materialize(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")


def _columns(df: DataFrame) -> dict[str, np.ndarray]:
    """The columns of a bounded result, brought to the driver in Arrow batches."""
    table = df.toArrow()
    return {k: table.column(k).to_numpy() for k in table.column_names}


def _lexicon(counts: DataFrame, ids: int) -> lm.Lexicon:
    """Rows, classes and priors; what is collected is bounded by the tokenizer's ids and by classes."""
    spark = counts.sparkSession
    pairs = counts.where("kind = 1").select((F.col("key") % SHIFT).alias("id"), F.floor(F.col("key") / SHIFT).alias("prev"), "n")
    seen = _columns(pairs.groupBy("id").agg(F.sum("n").alias("n")))
    total = np.zeros(ids)
    total[seen["id"]] = seen["n"]
    rows = lm.rows_of(total)
    known = int(rows.max())

    def keyed(name: str, values: np.ndarray) -> DataFrame:
        return F.broadcast(spark.createDataFrame(pa.table({name: np.arange(ids), f"{name}_as": values.astype(np.int64)})))

    few = np.where(rows < lm.SINGLES, rows, lm.SINGLES)
    named = lambda x, y: _columns(pairs.join(keyed("id", x), "id").join(keyed("prev", y), "prev").groupBy("id_as", "prev_as").agg(F.sum("n").alias("n")))
    found = named(rows, few)
    after = np.zeros((known + 1, lm.SINGLES + 1))
    after[found["id_as"], found["prev_as"]] = found["n"]
    cls, inside = lm.classes_of(total, rows, after)
    start = np.where(np.arange(ids) == ids - 1, known + 1, rows)
    found = named(cls, start)
    follow = np.zeros((known + 2, lm.CLASSES))
    follow[found["prev_as"], found["id_as"]] = found["n"]
    least = max(1, total.sum() / PAIRS)
    often = _columns(pairs.where(F.col("n") >= least).select((F.col("prev") * SHIFT + F.col("id")).alias("key"), "n"))  # PAIRS rows at most
    key, times = often["key"], often["n"].astype(np.float64)
    order = np.argsort(key)
    found = named(cls, np.arange(ids))
    whole = np.zeros((ids, lm.CLASSES), np.float32)
    whole[found["prev_as"], found["id_as"]] = found["n"]
    return lm.Lexicon(start, cls, inside, lm.prior_of(follow), key[order], times[order], follow, whole, float(least))


def _rare_pairs(counts: DataFrame, lexicon: lm.Lexicon) -> DataFrame:
    """(key, gain) of the pairs that are not broadcast: what their counts add to the log10 share within the class."""
    spark = counts.sparkSession
    share = lm.TRUST * 10.0**lexicon.inside
    shares = F.broadcast(spark.createDataFrame(pa.table({"id": np.arange(len(share)), "share": share})))
    pairs = counts.where((F.col("kind") == 1) & (F.col("n") < lexicon.least)).select("key", "n", (F.col("key") % SHIFT).alias("id"))
    return pairs.join(shares, "id").select("key", F.log10(1 + F.col("n") / F.col("share")).alias("gain"))


def _counts_of(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """Of each of n documents the distinct keys and how often each occurs."""
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    one = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))) if len(key) else np.empty(0, np.int64)
    edge = pa.array(np.searchsorted(doc[one], np.arange(n + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(edge, pa.array(key[one].view(np.int64))), pa.ListArray.from_arrays(edge, pa.array(np.diff(np.append(one, len(key)))))


def _packed(p: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **p)
    return out.getvalue()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as found:
        return dict(found)


FAN = 16
NETWORK = "part long, p binary, n long, steps long"


def _averaged(table: pa.Table) -> pa.Table:
    """Networks of several trainers as one, by the tokens each has seen; in the order of their parts."""
    table = table.select(["part", "p", "n", "steps"]).sort_by("part")
    n = table.column("n").to_numpy()
    total: dict[str, np.ndarray] = {}
    for p, share in zip(table.column("p"), n / n.sum(), strict=True):
        for k, x in _unpacked(p.as_py()).items():
            total[k] = total.get(k, 0) + x * share
    whole = _packed({k: x.astype(np.float32) for k, x in total.items()})
    columns = [pa.array([table.column("part")[0].as_py()]), pa.array([whole], pa.binary()), pa.array([int(n.sum())]), pa.array([int(np.max(table.column("steps")))])]
    return pa.table(columns, names=["part", "p", "n", "steps"])


def _train(training: DataFrame, ranks: Broadcast, lexicon: Broadcast, trainers: int, rounds: int) -> dict[str, np.ndarray]:
    """Train by at most ``trainers`` tasks and average, ``rounds`` times, each time on another part of the
    training texts, so that every token is trained on once. Tasks read their share where it lies: no text is shuffled."""
    spark = training.sparkSession
    texts = training.select(F.coalesce("_text", F.lit("")).alias("_text"), F.pmod(F.xxhash64("_id", "_text"), F.lit(rounds)).alias("_round"))
    weights, steps = lm.fresh(len(lexicon.value.prior)), 0
    for k in range(rounds):
        start = spark.sparkContext.broadcast((weights, steps))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # noqa: B023 - run within this round
            from pyspark import TaskContext

            coder, words_of = Coder(ranks.value), lexicon.value
            trainer = lm.Trainer(start.value[0], words_of.prior, step=start.value[1])
            for batch in batches:
                texts = texts_of(batch.column(0))
                for a, b in runs([len(t) for t in texts], 500_000):
                    w = words(texts[a:b])
                    ids, first = sequences(coder, w, distinct_words(w))
                    inputs, _, place = lm.blocks_of(words_of.row[ids], first, words_of.start)
                    classes, weight = np.zeros(inputs.size, np.int64), np.zeros(inputs.size)
                    classes[place], weight[place] = words_of.cls[ids], 1
                    trainer.feed(inputs, classes.reshape(inputs.shape), weight.reshape(inputs.shape))
            if trainer.tokens:
                part = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([_packed(trainer.p)], pa.binary()), pa.array([trainer.tokens]), pa.array([trainer.step])], names=["part", "p", "n", "steps"])

        # averages of averages: no task and not the driver gathers more than a few networks
        made, groups = texts.where(F.col("_round") == k).select("_text").coalesce(trainers).mapInArrow(run, NETWORK), max(64, -(-trainers // FAN))
        while True:
            made = made.groupBy(F.pmod("part", F.lit(groups)).alias("_g")).applyInArrow(_averaged, NETWORK)
            if groups <= 8:
                break
            groups = max(8, -(-groups // FAN))
        table = made.toArrow()
        if table.num_rows:
            found = _averaged(table)
            weights, steps = _unpacked(found.column("p")[0].as_py()), found.column("steps")[0].as_py()
    return weights


def _scored(df: DataFrame, ranks: Broadcast, model: Broadcast, heavy: Broadcast, scale: float) -> DataFrame:
    """Per row: what is known locally, and the words that are not, by hash."""
    kind = df.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(ranks.value)
        words_of, weights = model.value
        known, count = heavy.value
        score_of = np.log10((count + 0.5) / scale)
        for batch in batches:
            texts = texts_of(batch.column(2))
            for a, b in runs([len(t) for t in texts]):
                w = words(texts[a:b])
                n, size = b - a, np.diff(w.first)
                doc = np.repeat(np.arange(n), size)
                distinct = distinct_words(w)
                h, _, back = distinct
                hit, base = np.zeros(len(back), bool), np.zeros(n)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    hit = (known[at] == h)[back]
                    base = np.bincount(doc[hit], score_of[at][back][hit], n)
                h = h[back]
                ids, first = sequences(coder, w, distinct)
                rows, real, place = lm.blocks_of(words_of.row[ids], first, words_of.start)
                classes = np.zeros(rows.size, np.int64)
                classes[place] = words_of.cls[ids]
                got = lm.log10_classes(weights, words_of.prior, rows, classes.reshape(rows.shape), real).ravel()[place]
                before = np.concatenate([[0], ids[:-1]])
                before[first[:-1]] = coder.end
                pair = before * SHIFT + ids
                times = words_of.counted(pair)
                got += words_of.within(before, ids, times)
                # pairs that may be among those not broadcast: its class does follow the id before
                far = (times == 0) & (words_of.whole[before, words_of.cls[ids]] > 0) & (words_of.least > 1)
                columns = [
                    batch.column(0).slice(a, n), batch.column(1).slice(a, n), pa.array(size + 1), pa.array(np.bincount(doc[hit], minlength=n)), pa.array(base), pa.array(np.add.reduceat(got, first[:-1])),
                    *_counts_of(doc[~hit], h[~hit], n), *_counts_of(np.repeat(np.arange(n), np.diff(first))[far], pair[far], n),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "held_out", "n_tokens", "known", "base", "score", "light", "times", "pairs", "pair_times"])

    out = df.mapInArrow(run, f"_id {kind}, held_out boolean, n_tokens long, known long, base double, score double, light array<long>, times array<long>, pairs array<long>, pair_times array<long>")
    return materialize(out.withColumn("_uid", F.monotonically_increasing_id()), "lm-rows")


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = RANKS, held_out: Column | None = None, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    sc = df.sparkSession.sparkContext
    held = fold(id_col, 5) == 1 if held_out is None else held_out
    docs = df.select(F.col(id_col).alias("_id"), held.alias("_held"), F.col(text_col).alias("_text"))
    ranks = sc.broadcast(_ranks(ranks_path))
    training = docs.where(~F.col("_held"))
    counts = _statistics(training.select("_text"), ranks)
    sums = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    ends = sums[2]["n"] if 2 in sums else 0
    word_count, distinct = (sums[0]["n"], sums[0]["v"]) if 0 in sums else (0, 0)
    n, v = word_count + ends, distinct + (ends > 0)
    scale = n + 0.5 * (v + 1)
    lexicon = _lexicon(counts, max(ranks.value.values()) + 2)
    shared = sc.broadcast(lexicon)
    weights = _train(training.select("_id", "_text"), ranks, shared, max(1, round(word_count / TRAINER_WORDS)), rounds)
    least = n / HEAVY
    top = _columns(counts.where((F.col("kind") == 0) & (F.col("n") >= least)).select("key", "n"))  # HEAVY rows at most
    key = np.ascontiguousarray(top["key"]).view(np.uint64)
    order = np.argsort(key)
    heavy = sc.broadcast((key[order], top["n"].astype(np.float64)[order]))
    rows = _scored(docs, ranks, sc.broadcast((lexicon, weights)), heavy, scale)
    light = rows.select("_uid", F.explode(F.arrays_zip("light", "times")).alias("x")).select("_uid", F.col("x.light").alias("key"), F.col("x.times").alias("times"))
    rare = counts.where((F.col("kind") == 0) & (F.col("n") < least)).select("key", F.col("n").alias("c"))
    found = light.join(rare, "key", "left").groupBy("_uid").agg(F.sum(F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + 0.5) / scale)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    met = rows.select("_uid", F.explode(F.arrays_zip("pairs", "pair_times")).alias("x")).select("_uid", F.col("x.pairs").alias("key"), F.col("x.pair_times").alias("times"))
    gains = met.join(_rare_pairs(counts, lexicon), "key").groupBy("_uid").agg(F.sum(F.col("times") * F.col("gain")).alias("gained"))
    out = rows.drop("light", "times", "pairs", "pair_times").join(found, "_uid", "left").join(gains, "_uid", "left")
    end = float(np.log10((ends + 0.5) / scale))
    return out.select(
        F.col("_id").alias("doc_id"), "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0)) + int(ends > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) + end).alias("base_score"), (F.col("score") + F.coalesce("gained", F.lit(0.0))).alias("score"),
    )
