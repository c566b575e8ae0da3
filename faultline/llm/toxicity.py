"""Toxicity by weak supervision.

1. Features of a text are hashes of its lower-case words and of their first bytes, seen at least
   once, twice, three or five times. Over a bounded sample of labelled rows, the features that mark toxic rows are found.
2. Voters: lexicons drawn from these features by kind and count, counting voters by kind of
   feature, a fixed lexicon, and surface patterns. Each votes toxic, clean or not at all. A row is
   judged by lexicons that were drawn from the other ``FOLDS`` parts of the sample alone, so no
   lexicon knows the labels of what it votes on. The label given to a row is one more voter.
3. A generative label model estimates by expectation maximisation how often each voter, the given
   label too, says what in each class, starting from the votes without the given labels. Voters
   that agree beyond what the classes explain are correlated; each one's evidence is divided by
   its share of such company.
4. A logistic regression over the features is trained on the posterior labels. It scores every
   text, whole, on the executors.

The sample: the ``ROWS`` labelled rows outside the held-out fold that come first by a hash of
their id. Only hashes and counts of these rows reach the driver. Labels, language, source
and id are no inputs of a score.

Of several documents of one labelled id one teaches, the text of the least hash.

Defined cases: null and empty texts have no feature and get the score of the intercept; a
null id counts as the text '' for folds and matches no label; null labels teach nothing;
an id labelled twice counts by its largest label; without labelled rows of both kinds every
score is the share of toxic ones (0 without any); repeated rows get equal scores; an empty
table gives an empty table; other columns are ignored by ``score`` and carried by ``keep_clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize, share_for, uniform
from .textnum import runs, texts_of, words, xxh64

ROWS = 20_000
FEATURES = 4096
FOLDS = 4
#: A feature is kept if its rate among toxic rows is e**ODDS times that among others, and if by
#: chance not one of a million features would show its counts (SURE = ln of a million).
ODDS, SURE = 1.5, 13.8
#: Words that vote from the start, whatever the labelled rows show.
INSULTS = ("idiot", "idiots", "moron", "morons", "stupid", "scum", "loser", "losers", "pathetic", "worthless", "disgusting", "trash", "clown", "clowns", "dumb", "imbecile", "vermin", "filth")
THRESHOLD = 0.7
PREFIXES = (4, 5, 6, 8, 10)
LEVELS = (1, 2, 3, 5)
KINDS = 1 + len(PREFIXES)
LEXICONS = KINDS * len(LEVELS)


def features(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, text number, hash) of the words (kind 0) and of longer words' prefixes (kinds from 1)."""
    w = words(texts, letters_only=True)
    of = np.repeat(np.arange(len(texts)), np.diff(w.first))
    yield 0, of, xxh64(w.buf, w.start, w.end, 7)
    for kind, n in enumerate(PREFIXES, 1):
        long = np.flatnonzero(w.end - w.start > n)
        yield kind, of[long], xxh64(w.buf, w.start[long], w.start[long] + n, 7 + kind)


def _patterns(texts: list[bytes]) -> np.ndarray:
    """(texts, 4): shouting, exclamations, stretched letters, many words of one letter."""
    out = np.zeros((len(texts), 4), bool)
    for i, t in enumerate(texts):
        x = np.frombuffer(t, np.uint8)
        if len(x):
            upper, lower = ((x >= 65) & (x <= 90)).sum(), ((x >= 97) & (x <= 122)).sum()
            same = (x[2:] == x[1:-1]) & (x[1:-1] == x[:-2]) & (x[2:] > 64)
            out[i] = upper > lower, (x == 33).sum() * 200 > len(x), same.sum() * 100 > len(x), t.count(b" ") * 3 > len(x)
    return out


def _pairs(texts: list[bytes], known: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of the features that the texts have.

    known: sorted hashes; table: of each hash the feature for each of ``LEVELS``, or -1.
    """
    seen = np.zeros(1 << 16, bool)
    seen[known >> np.uint64(48)] = True
    of_, at_ = [], []
    for _, of, h in features(texts):
        maybe = np.flatnonzero(seen[h >> np.uint64(48)])
        at = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
        hit = known[at] == h[maybe]
        of_.append(of[maybe][hit])
        at_.append(at[hit])
    both, n = np.unique(np.concatenate(of_) * len(known) + np.concatenate(at_), return_counts=True)
    of, at = both // len(known), both % len(known)
    feature = np.where(n[:, None] >= np.array(LEVELS), table[at], -1)
    row, level = np.nonzero(feature >= 0)
    return of[row], feature[row, level]


@dataclass
class Model:
    known: np.ndarray
    table: np.ndarray
    weights: np.ndarray
    bias: float

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        if len(self.known):
            for a, b in runs([len(t) for t in texts]):
                of, at = _pairs(texts[a:b], self.known, self.table)
                z[a:b] += np.bincount(of, self.weights[at], b - a)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def label_model(votes: np.ndarray, prior: float, start: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1, rates (voters, class, vote) and weights, from votes in {0 clean, 1 toxic, 2 none}."""
    n, m = votes.shape
    post, weight, rates = start.astype(float), np.ones(m), np.zeros((m, 2, 3))
    hot = votes[:, :, None] == np.arange(3)
    for step in range(rounds):
        for c, p in ((0, 1 - post), (1, post)):
            rates[:, c] = (np.einsum("n,nmv->mv", p, hot) + 0.5) / (p.sum() + 1.5)
        if step in (1, 5):  # correlation of what the classes leave unexplained
            signed = np.where(votes == 2, 0, 2 * votes - 1).astype(float)
            mean = rates[:, :, 1] - rates[:, :, 0]
            rest = signed - ((1 - post)[:, None] * mean[:, 0] + post[:, None] * mean[:, 1])
            sd = np.sqrt((rest**2).mean(0)) + 1e-9
            corr = np.abs((rest.T @ rest) / n / sd / sd[:, None])
            np.fill_diagonal(corr, 0)
            weight = 1 / (1 + np.where(corr > 0.2, corr, 0).sum(1))
        ratio = np.log(rates[:, 1] / rates[:, 0]) * weight[:, None]
        z = np.log(prior / (1 - prior)) + ratio[np.arange(m), votes].sum(1)
        post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return post, rates, weight


def regression(of: np.ndarray, at: np.ndarray, n: int, m: int, y: np.ndarray, l2: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse binary features and soft labels, by accelerated gradient steps."""
    times = lambda w: np.bincount(of, w[at], n)
    back = lambda r: np.bincount(at, r[of], m)
    x = np.ones(m)
    for _ in range(20):  # the largest eigenvalue bounds the curvature
        x = back(times(x)) / n
        top = float(np.linalg.norm(x)) or 1.0
        x /= top
    step = 1 / (0.25 * (top + 1) + l2)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    w, b = np.zeros(m), float(np.log(share / (1 - share)))
    vw, vb = w, b
    for k in range(steps):
        g = (1 / (1 + np.exp(-np.clip(vb + times(vw), -30, 30))) - y) / n
        nw, nb = vw - step * (back(g) + l2 * vw), vb - step * g.sum()
        vw, vb = nw + k / (k + 3) * (nw - w), nb + k / (k + 3) * (nb - b)
        w, b = nw, nb
    return w, b


def _sample(df: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(toxic, fold, text) of at most ``ROWS`` labelled ids outside the held-out fold, one row an id."""
    few = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold("doc_id", 3) != 1))
    few = few.groupBy(F.col("doc_id").alias("_label_id")).agg(F.max("toxic").alias("_toxic"))
    few = few.where(uniform("_label_id", 4) < share_for(ROWS, labels.count())).orderBy(uniform("_label_id", 4), "_label_id").limit(ROWS)
    bare = df.select(F.col(id_col).alias("_i"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    met = bare.join(F.broadcast(few), F.col("_i") == F.col("_label_id"))
    one = met.groupBy("_label_id").agg(F.first("_toxic").alias("_toxic"), F.min_by("_t", F.xxhash64("_t")).alias("_t"))
    return one.select("_toxic", F.floor(uniform("_label_id", 6) * FOLDS).cast("int").alias("_fold"), "_t")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, level, h, fold, bad, good): how many toxic and other rows of each fold have a feature."""
    for batch in batches:
        toxic, part, texts = np.asarray(batch.column(0).to_pylist()) > 0, np.asarray(batch.column(1)), texts_of(batch.column(2))
        for a, b in runs([len(t) for t in texts]):
            for kind, of, h in features(texts[a:b]):
                if not len(h):
                    continue
                order = np.lexsort((of, h))
                h, of = h[order], of[order]
                first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])))
                n = np.diff(np.append(first, len(h)))
                for level, least in enumerate(LEVELS):
                    at = first[n >= least]
                    bad, where = toxic[a:b][of[at]], part[a:b][of[at]]
                    for k in np.unique(where):
                        mine = where == k
                        u, start = np.unique(h[at[mine]], return_index=True)
                        bads = np.add.reduceat(bad[mine].astype(np.int64), start)
                        alls = np.diff(np.append(start, int(mine.sum())))
                        columns = [np.full(len(u), kind), np.full(len(u), level), u.view(np.int64), np.full(len(u), k), bads, alls - bads]
                        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["kind", "level", "h", "fold", "bad", "good"])


@dataclass
class Features:
    """Chosen features: their kinds and levels, and of each known hash the feature for each level, or -1."""

    kind: np.ndarray
    level: np.ndarray
    fixed: np.ndarray
    known: np.ndarray
    table: np.ndarray


def _chosen(sums: DataFrame, but: int | None, bad: int, good: int) -> Features:
    """The features that mark toxic rows among all counted ones but those of one fold, and the fixed lexicon."""
    found = {}
    if bad and good:
        b, g = (F.col(c) - (F.col(f"{c}{but}") if but is not None else 0) for c in ("bad", "good"))
        n, share = b + g, bad / (bad + good)
        odds = F.log((b + 0.5) / bad) - F.log((g + 0.5) / good)
        part = lambda x, p: F.when(x > 0, x * F.log(x / n / p)).otherwise(0.0)
        chance = part(b, share) + part(g, 1 - share)
        rows = sums.where((n > 0) & (odds >= ODDS) & (chance >= SURE)).select("kind", "level", "h", chance.alias("chance"))
        found = {(r["h"] & 0xFFFFFFFFFFFFFFFF, r["level"]): r["kind"] for r in rows.orderBy(F.desc("chance"), "h", "level").limit(FEATURES).collect()}
    fixed = {(xxhash.xxh64_intdigest(w.encode(), 7), 0) for w in INSULTS}
    found |= dict.fromkeys(fixed, 0)
    order = sorted(found)
    known = np.array(sorted({k[0] for k in order}), np.uint64)
    table = np.full((len(known), len(LEVELS)), -1)
    for i, (h, level) in enumerate(order):
        table[np.searchsorted(known, np.uint64(h)), level] = i
    return Features(np.array([found[k] for k in order]), np.array([k[1] for k in order]), np.array([k in fixed for k in order]), known, table)


def _votes(texts: list[bytes], f: Features) -> np.ndarray:
    """(texts, voters) in {0 clean, 1 toxic, 2 none}: lexicons say toxic or nothing, counts also clean, patterns toxic or nothing."""
    n = len(texts)
    of, at = _pairs(texts, f.known, f.table)
    hits = np.bincount(of * LEXICONS + (f.kind * len(LEVELS) + f.level)[at], minlength=n * LEXICONS).reshape(n, LEXICONS)
    kinds = np.bincount(of * KINDS + f.kind[at], minlength=n * KINDS).reshape(n, KINDS)
    fixed = np.bincount(of[f.fixed[at]], minlength=n)[:, None]
    return np.concatenate([np.where(hits > 0, 1, 2), np.where(kinds >= 2, 1, np.where(kinds == 0, 0, 2)), np.where(fixed > 0, 1, 2), np.where(_patterns(texts), 1, 2)], axis=1)


def posterior(votes: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """How likely each row is toxic, from the voters and the given labels as one voter among them."""
    share = float(np.clip(marked.mean(), 0.001, 0.999))
    start = np.clip((votes[:, LEXICONS : LEXICONS + KINDS] == 1).mean(1), 0.02, 0.98)
    post, _, _ = label_model(np.concatenate([votes, marked[:, None].astype(int)], axis=1), share, start)
    if not (marked == 1).any() or post[marked == 1].mean() < post[marked == 0].mean():  # votes that tell nothing may name the classes the wrong way round
        post, _, _ = label_model(np.concatenate([votes, marked[:, None].astype(int)], axis=1), share, np.clip(marked.astype(float), 0.05, 0.95))
    return post


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit the voters, the label model and the classifier."""
    sample = materialize(_sample(df, labels, id_col, text_col), "toxicity-sample")
    totals = {(r["_fold"], r["t"]): r["n"] for r in sample.groupBy("_fold", (F.col("_toxic") > 0).alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = (sum(n for (_, t), n in totals.items() if t == which) for which in (True, False))
    if not bad or not good:
        return Model(np.empty(0, np.uint64), np.empty((0, len(LEVELS)), int), np.empty(0), 30.0 if bad else -30.0)
    counted = sample.mapInArrow(_counted, "kind long, level long, h long, fold long, bad long, good long")
    apart = [F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in range(FOLDS) for c in ("bad", "good")]
    sums = materialize(counted.groupBy("kind", "level", "h").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), *apart), "toxicity-counts")
    whole = _chosen(sums, None, bad, good)
    parts = [_chosen(sums, k, bad - totals.get((k, True), 0), good - totals.get((k, False), 0)) for k in range(FOLDS)]

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, part, texts = batch.column(0).to_pylist(), np.asarray(batch.column(1)), texts_of(batch.column(2))
            for a, b in runs([len(t) for t in texts]):
                of, at = _pairs(texts[a:b], whole.known, whole.table)
                lists = np.split(at, np.searchsorted(of, np.arange(1, b - a)))
                votes = np.zeros((b - a, LEXICONS + KINDS + 5), int)
                for k in np.unique(part[a:b]):
                    mine = np.flatnonzero(part[a:b] == k)
                    votes[mine] = _votes([texts[a + i] for i in mine], parts[k])
                yield pa.RecordBatch.from_arrays([pa.array([int(t > 0) for t in toxic[a:b]]), pa.array([x.tolist() for x in lists], pa.list_(pa.int64())), pa.array(votes.tolist(), pa.list_(pa.int64()))], names=["toxic", "at", "votes"])

    docs = sample.mapInArrow(seen, "toxic long, at array<long>, votes array<long>").collect()  # ROWS rows at most
    docs.sort(key=lambda r: (r["toxic"], r["at"], r["votes"]))
    n, m = len(docs), len(whole.kind)
    of = np.repeat(np.arange(n), [len(r["at"]) for r in docs])
    at = np.array([x for r in docs for x in r["at"]], np.int64)
    post = posterior(np.array([r["votes"] for r in docs]), np.array([r["toxic"] for r in docs]))
    return Model(whole.known, whole.table, *regression(of, at, n, m, post))


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    bare = df.select(F.col(id_col).alias("doc_id"), (fold(id_col, 3) == 1).alias("held_out"), F.col(text_col).alias("text"))
    kind = bare.schema["doc_id"].dataType.simpleString()
    model = df.sparkSession.sparkContext.broadcast(train(df, labels, id_col, text_col))  # FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.value(texts_of(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return bare.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_clean(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows scored under ``THRESHOLD``, with all their columns."""
    model = df.sparkSession.sparkContext.broadcast(train(df, labels, id_col, text_col))
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = model.value(texts_of(batch.column(at))) < THRESHOLD
            yield batch.filter(pa.array(clean))

    return df.mapInArrow(run, df.schema)
