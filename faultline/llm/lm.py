"""A small causal self-attention language model in numpy.

A token is predicted as its class and then itself: frequent tokens are classes of their own,
the others share classes, in which corpus counts decide. The class comes from one attention
layer over the preceding tokens (at least 17, at most 32) with learned distances, the last two
tokens' embeddings, a feed-forward layer, and the corpus's counts of classes after tokens.

Sequences are cut into blocks of ``BLOCK`` tokens. Each block is scored once, with the block
before it as context: overlapping windows, batched, under a causal mask. Blocks are taken in
runs as they stand, so every token's embeddings are read once and serve both windows.

In float32 both softmaxes raise 2 by ``powers``, which is linear between whole exponents. It is
positive and increasing, so what it is divided by its sum is a distribution as exact as any.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK, DIM, HIDDEN = 16, 16, 32
SINGLES, CLUSTERS = 120, 39
CLASSES = SINGLES + CLUSTERS + 1
#: Tokens with embeddings of their own; two more rows stand for all other tokens and for the start.
KNOWN = 4096
#: As many counts of a pair as its class's own shares weigh.
TRUST = 10.0


@dataclass
class Lexicon:
    """Token ids as rows, classes and log10 shares within the class, from corpus counts."""

    row: np.ndarray
    cls: np.ndarray
    inside: np.ndarray
    prior: np.ndarray
    #: Sorted keys (id before, id) of frequent pairs, their counts, and per row and class the sum of these.
    pair: np.ndarray
    times: np.ndarray
    follow: np.ndarray
    #: Per id before and class the sum of all pairs' counts; without it, ``follow`` stands for it.
    whole: np.ndarray | None = None
    #: Pairs counted less often than this are not in ``pair``.
    least: float = 1.0

    @property
    def other(self) -> int:
        return len(self.prior) - 2

    @property
    def start(self) -> int:
        return len(self.prior) - 1

    def counted(self, key: np.ndarray) -> np.ndarray:
        """Counts of the pairs ``key`` that are in ``pair``, 0 of others."""
        if not len(self.pair):
            return np.zeros(len(key))
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.times[at], 0)

    def within(self, before: np.ndarray, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 share of each id within its class after ``before``: pair counts ``n`` over the class's own shares."""
        share, row = self.inside[ids], self.row[before]
        if self.whole is not None:
            of = self.whole[before, self.cls[ids]]
        elif len(self.pair):
            of = np.where(row == self.other, 0, self.follow[row, self.cls[ids]])
        else:
            return share
        return np.log10((n + TRUST * 10**share) / (of + TRUST))


def rows_of(counts: np.ndarray) -> np.ndarray:
    """Row of each token id: the ``KNOWN`` most frequent in order, all others the last but one."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    seen = order[: min(KNOWN, int((counts > 0).sum()))]
    out = np.full(len(counts), len(seen))
    out[seen] = np.arange(len(seen))
    return out


def classes_of(counts: np.ndarray, rows: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each token id and its log10 share of the class.

    after: (rows, SINGLES + 1) how often a row follows each frequent token or any other;
    rows with like neighbours share a class.
    """
    known = int(rows.max())
    cls = np.full(len(counts), CLASSES - 1)
    ids = np.flatnonzero(rows < known)
    cls[ids] = np.minimum(rows[ids], SINGLES)
    tail = np.arange(min(SINGLES, known), known)
    if len(tail):
        base = after[:known].sum(0) + 1.0
        profile = np.sqrt((after[tail] + 3 * base / base.sum()) / (after[tail].sum(1, keepdims=True) + 3))
        centre = profile[:: max(1, len(tail) // CLUSTERS)][:CLUSTERS].copy()
        for _ in range(12):
            near = (profile @ centre.T - 0.5 * (centre**2).sum(1)).argmax(1)
            for k in range(len(centre)):
                if (near == k).any():
                    centre[k] = profile[near == k].mean(0)
        of_row = np.empty(known, np.int64)
        of_row[tail] = SINGLES + near
        at = ids[rows[ids] >= SINGLES]
        cls[at] = of_row[rows[at]]
    mass = np.bincount(cls, counts + 0.5, CLASSES)
    return cls, np.log10((counts + 0.5) / mass[cls])


def prior_of(follow: np.ndarray) -> np.ndarray:
    """log P(class | last row), from (rows + 2, CLASSES) counts, smoothed towards all rows."""
    total = follow.sum(0) + 0.1
    share = total / total.sum()
    return np.log((follow + 5 * share) / (follow.sum(1, keepdims=True) + 5)).astype(np.float32)


#: Columns of a token's embedding: as key, value and query, as the last token and as the one before it.
KEY, VALUE, QUERY, LAST, BEFORE = (slice(i * DIM, (i + 1) * DIM) for i in range(5))
WIDTH = 5 * DIM


def fresh(rows: int, seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    made = {"table": rng.normal(0, 0.15, (rows, WIDTH)), "far": -0.05 * np.arange(2.0 * BLOCK), "w1": rng.normal(0, 0.2, (DIM, HIDDEN)), "b1": np.zeros(HIDDEN)}
    made |= {"w2": rng.normal(0, 0.1, (HIDDEN, DIM)), "out": rng.normal(0, 0.05, (DIM, CLASSES)), "bias": np.zeros(CLASSES)}
    return {k: v.astype(np.float32) for k, v in made.items()}


_BACK = np.arange(BLOCK)[:, None] - np.arange(BLOCK)  # distance of key j from query i in one block
_FUTURE = _BACK < 0
_SCALE, _ONE = np.float32((1 << 23) / np.log(2)), np.float32(127 << 23)
#: Limits of what is raised: a float's exponent ends beyond.
_REACH = np.float32(80)


def powers(x: np.ndarray) -> np.ndarray:
    """exp(x); of float32, in place, with the bits of a float as the logarithm, linear between powers of 2."""
    if x.dtype != np.float32:
        return np.exp(x)
    np.clip(x, -_REACH, _REACH, out=x)
    x *= _SCALE
    x += _ONE
    return x.astype(np.int32).view(np.float32)


def blocks_of(tokens: np.ndarray, first: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut each text's tokens ``first[i]:first[i + 1]`` into blocks, with a block of ``start`` ahead.

    (inputs, real, place): for all blocks the token before each of theirs, which blocks hold
    tokens, and the flat place of each token.
    """
    n = np.diff(first)
    per = -(-n // BLOCK) + 1
    begin = np.concatenate([[0], np.cumsum(per)])
    flat = np.full(begin[-1] * BLOCK + 1, start)
    place = np.repeat((begin[:-1] + 1) * BLOCK - first[:-1], n) + np.arange(first[-1])
    flat[place + 1] = tokens
    real = np.ones(begin[-1], bool)
    real[begin[:-1]] = False
    inputs = flat[:-1].reshape(-1, BLOCK)
    inputs[~real] = start
    return inputs, np.flatnonzero(real), place


def _hidden(p: dict, e: np.ndarray) -> tuple:
    """What the layers make of the blocks ``e[1:]`` of embeddings, each with the block before it as context.

    (weights of the block before, weights of the own block, h0, z, h): h0 and h are the hidden
    states before and after the feed-forward layer, one row per token.
    """
    q, m = e[1:, :, QUERY], len(e) - 1
    past = np.matmul(q, e[:-1, :, KEY].transpose(0, 2, 1))
    past += p["far"][BLOCK + _BACK]
    own = np.matmul(q, e[1:, :, KEY].transpose(0, 2, 1))
    own += p["far"][np.abs(_BACK)]
    past, own = powers(past), powers(own)
    own[:, _FUTURE] = 0
    total = past.sum(-1, keepdims=True) + own.sum(-1, keepdims=True)
    past /= total
    own /= total
    h0 = np.matmul(past, e[:-1, :, VALUE])
    h0 += np.matmul(own, e[1:, :, VALUE])
    h0 += e[1:, :, LAST]
    h0[:, 1:] += e[1:, :-1, BEFORE]
    h0[:, 0] += e[:-1, -1, BEFORE]
    h0 = h0.reshape(m * BLOCK, DIM)
    z = h0 @ p["w1"]
    z += p["b1"]
    np.maximum(z, 0, out=z)
    h = z @ p["w2"]
    h += h0
    return past, own, h0, z, h


def log10_classes(p: dict, prior: np.ndarray, inputs: np.ndarray, classes: np.ndarray, real: np.ndarray, at_once: int = 32) -> np.ndarray:
    """(all blocks, BLOCK): log10 probability of each class, 0 in blocks that are not ``real``."""
    out = np.zeros(inputs.shape, np.float64)
    table, ones = prior + p["bias"], np.ones(prior.shape[1], prior.dtype)
    for s in range(1, len(inputs), at_once):  # the first block is a start
        x, y = inputs[s - 1 : s + at_once], classes[s : s + at_once].ravel()
        logits = _hidden(p, p["table"][x])[-1] @ p["out"]
        logits += table[x[1:].ravel()]
        share = powers(logits)
        out[s : s + at_once] = np.log10(share[np.arange(len(y)), y] / (share @ ones)).reshape(-1, BLOCK)
    keep = np.zeros(len(out), bool)
    keep[real] = True
    out[~keep] = 0
    return out


def _scatter(at: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, summed gradients) of the rows ``at``."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return at[start], np.add.reduceat(grad[order], start)


def gradients(p: dict, x: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: np.ndarray) -> tuple[float, dict, np.ndarray]:
    """(mean cross-entropy, its gradient, the rows of ``table`` that it has) for the classes ``y`` after the inputs ``x[1:]``; ``x[0]`` is context only."""
    e = p["table"][x]
    past, own, h0, z, h = _hidden(p, e)
    n, m = max(float(weight.sum()), 1.0), len(x) - 1
    y, w = y.ravel(), weight.ravel().astype(e.dtype)
    d = h @ p["out"]
    d += p["bias"]
    d += prior[x[1:].ravel()]
    d = powers(d)
    total, at = d @ np.ones(d.shape[1], d.dtype), np.arange(len(y))
    loss = -float((np.log(d[at, y] / total) * w).sum() / n)
    w /= e.dtype.type(n)
    d *= (w / total)[:, None]
    d[at, y] -= w
    g = {"out": h.T @ d, "bias": np.ones(len(d), d.dtype) @ d}
    dh = d @ p["out"].T
    g["w2"] = z.T @ dh
    dz = dh @ p["w2"].T
    dz *= z > 0
    g["w1"], g["b1"] = h0.T @ dz, dz.sum(0)
    dh += dz @ p["w1"].T
    do = dh.reshape(m, BLOCK, DIM)
    ge = np.zeros_like(e)
    ge[1:, :, LAST] = do
    ge[1:, :-1, BEFORE] = do[:, 1:]
    ge[:-1, -1, BEFORE] += do[:, 0]
    ge[1:, :, VALUE] = np.matmul(own.transpose(0, 2, 1), do)
    ge[:-1, :, VALUE] += np.matmul(past.transpose(0, 2, 1), do)
    d_past, d_own = np.matmul(do, e[:-1, :, VALUE].transpose(0, 2, 1)), np.matmul(do, e[1:, :, VALUE].transpose(0, 2, 1))
    seen = h0.reshape(do.shape) - e[1:, :, LAST]  # what attention gave: its product with do is the weighted mean
    seen[:, 1:] -= e[1:, :-1, BEFORE]
    seen[:, 0] -= e[:-1, -1, BEFORE]
    mean = (do * seen).sum(-1, keepdims=True)
    d_past -= mean
    d_past *= past
    d_own -= mean
    d_own *= own
    q = e[1:, :, QUERY]
    ge[1:, :, QUERY] = np.matmul(d_past, e[:-1, :, KEY]) + np.matmul(d_own, e[1:, :, KEY])
    ge[1:, :, KEY] = np.matmul(d_own.transpose(0, 2, 1), q)
    ge[:-1, :, KEY] += np.matmul(d_past.transpose(0, 2, 1), q)
    ok = ~_FUTURE
    far = np.bincount((BLOCK + _BACK).ravel(), d_past.sum(0).ravel(), 2 * BLOCK) + np.bincount(_BACK[ok], d_own.sum(0)[ok], 2 * BLOCK)
    g["far"] = far.astype(e.dtype)
    rows, g["table"] = _scatter(x.ravel(), ge.reshape(-1, WIDTH))
    return loss, g, rows


class Trainer:
    """Adam over batches of blocks, in the order in which they come; of the embeddings, only rows that a batch has move."""

    def __init__(self, p: dict, prior: np.ndarray, rate: float = 2e-2, step: int = 0) -> None:
        self.p = {k: v.copy() for k, v in p.items()}
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
        self.prior, self.rate, self.step, self.since, self.loss, self.tokens = prior, rate, step, 0, 0.0, 0

    def feed(self, inputs: np.ndarray, classes: np.ndarray, weight: np.ndarray, size: int = 64) -> None:
        """One pass over the blocks, ``size`` in a row at a time."""
        for s in range(1, len(inputs), size):
            w = weight[s : s + size]
            loss, g, rows = gradients(self.p, inputs[s - 1 : s + size], classes[s : s + size], w, self.prior)
            self.step, self.since, n = self.step + 1, self.since + 1, int(w.sum())
            self.loss, self.tokens = self.loss + loss * n, self.tokens + n
            rate = np.float32(self.rate / (1 + self.step / 300) * np.sqrt(1 - 0.99**self.since) / (1 - 0.9**self.since))
            for k, x in g.items():
                at = rows if k == "table" else slice(None)
                m, v = self.m[k][at], self.v[k][at]
                m += np.float32(0.1) * (x - m)
                v += np.float32(0.01) * (x * x - v)
                self.m[k][at], self.v[k][at] = m, v
                self.p[k][at] -= rate * m / (np.sqrt(v) + np.float32(1e-8))
