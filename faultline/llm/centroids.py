"""Centroid clustering in exact integers, screened by float32 products.

A vector's components become integers; the nearest of a few centroids is found for a whole batch
by one float32 matrix product. Each product comes with a rigorous bound of its rounding error
(``screened``), so that each distance lies in an interval. Where one interval lies below all
others its centroid is the nearest; where intervals overlap, the distances to the centroids of the
overlapping ones are computed again in exact integers, and the smaller number wins a tie.

A round is one job over the input and moves no vector: a task sends on one sum per centroid and
component. Sums are exact at any size: they travel as limbs of 40 bits, added up as decimals.
Centroids (``clusters`` x ``dims`` integers) are all that the driver holds.

Defined cases: vectors that are null, have another number of components, or a null or non-finite
component are left out; a null id counts as the text '' in the choice of first centroids, of equal
ids the smaller vector is chosen first; repeated rows count each; fewer vectors than clusters give as
many centroids as there are vectors; an empty table gives an empty table; other columns are ignored.
Distances and inertias beyond a long are given as the largest long.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = (1 << 63) - 1
LIMB = 40


def bound(dims: int) -> int:
    """Components up to this size have exact distances in 64 bits: dims x (2 x bound)^2 <= 2^62."""
    return int(2.0**30 / max(1, dims) ** 0.5)


def integers(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of finite doubles, as int64 where all fit, else as Python integers."""
    if not values.size or np.abs(values).max() * scale < 2.0**62:
        return np.floor(values * scale).astype(np.int64)
    from fractions import Fraction

    return np.array([[Fraction(x) * Fraction(scale) // 1 for x in row] for row in values.tolist()], dtype=object)


def screened(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each point and centroid whether it can be the nearest: bounds from float32 products.

    Both are int64 and small. With u = 2^-24, rounding the components and a product of n of them
    in any order is off by at most g |x| |c|, g = (n + 2) u / (1 - (n + 2) u), by Cauchy-Schwarz;
    what remains in float64 is covered by 2^-40 of the terms' sizes.
    """
    n, unit = points.shape[1], 2.0**-24
    g = (n + 2) * unit / (1 - (n + 2) * unit) * (1 + 2.0**-20)
    x, c = points.astype(np.float64), centres.astype(np.float64)
    product = (points.astype(np.float32) @ centres.astype(np.float32).T).astype(np.float64)
    square = (c * c).sum(axis=1)
    size = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt(square)[None, :]
    score = square[None, :] - 2 * product
    error = 2 * g * size + 2.0**-40 * (square[None, :] + 2 * size)
    return score - error <= (score + error).min(axis=1, keepdims=True)


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of points and centroids, pair by pair."""
    gap = points - centres
    return (gap * gap).sum(axis=1)


def nearest(points: np.ndarray, centres: list[list[int]]) -> np.ndarray:
    """The number of each point's nearest centroid."""
    most, exact = bound(points.shape[1]), np.array(centres, dtype=object)
    fits = points.dtype == np.int64 and bool(np.abs(exact).max() <= most)
    easy = (np.abs(points) <= most).all(axis=1) if fits else np.zeros(len(points), bool)
    out = np.zeros(len(points), np.int64)
    if easy.any():
        near, small = points[easy], exact.astype(np.int64)
        can = screened(near, small)
        best = can.argmax(axis=1)
        open_ = np.flatnonzero(can.sum(axis=1) > 1)
        if len(open_):
            row, which = np.nonzero(can[open_])
            d = distances(near[open_][row], small[which])
            order = np.lexsort((which, d, row))
            first = order[np.unique(row[order], return_index=True)[1]]
            best[open_[row[first]]] = which[first]
        out[easy] = best
    for i in np.flatnonzero(~easy):
        d = distances(np.broadcast_to(points[i].astype(object), exact.shape), exact)
        out[i] = min(range(len(d)), key=lambda k: (d[k], k))
    return out


def to_nearest(points: np.ndarray, centres: list[list[int]], which: np.ndarray) -> list[int]:
    """The exact distance of each point to its centroid."""
    chosen, most = np.array(centres, dtype=object)[which], bound(points.shape[1])
    if points.dtype == np.int64 and np.abs(points).max(initial=0) <= most and np.abs(chosen).max(initial=0) <= most:
        return distances(points, chosen.astype(np.int64)).tolist()
    return list(distances(points.astype(object), chosen)) if len(points) else []


def _points(batch: pa.RecordBatch, dims: int, scale: float) -> np.ndarray:
    flat = batch.column("_v").flatten().to_numpy(zero_copy_only=False)
    return integers(flat.astype(np.float64).reshape(-1, dims), scale)


def _limbs(x: int) -> Iterator[tuple[int, int]]:
    """(place, signed digit) of an integer to the base 2^LIMB."""
    sign, x, place = (-1 if x < 0 else 1), abs(x), 0
    while x:
        yield place, sign * (x & ((1 << LIMB) - 1))
        x, place = x >> LIMB, place + 1


def _tally(df: DataFrame, centres: list[list[int]], scale: float, with_distance: bool) -> dict[tuple[int, int], int]:
    """Exact sums by (centroid, component); component -1 counts, component ``dims`` sums distances."""
    dims = len(centres[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = defaultdict(int)
        for batch in batches:
            points = _points(batch, dims, scale)
            which = nearest(points, centres)
            far = to_nearest(points, centres, which) if with_distance else []
            for k in np.unique(which).tolist():
                own = points[which == k]
                sums[k, -1] += len(own)
                if with_distance:
                    sums[k, dims] += sum(d for d, w in zip(far, which.tolist(), strict=True) if w == k)
                    continue
                for j, s in enumerate((own if np.abs(own).max() <= bound(dims) else own.astype(object)).sum(axis=0)):
                    sums[k, j] += int(s)
        rows = [(k, j, *limb) for (k, j), s in sums.items() for limb in _limbs(s)]
        yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("k", pa.int32()), ("j", pa.int32()), ("place", pa.int32()), ("digit", pa.int64())))})

    parts = df.select("_v").mapInArrow(run, "k int, j int, place int, digit long")
    out: dict = defaultdict(int)
    for r in parts.groupBy("k", "j", "place").agg(F.sum(F.col("digit").cast("decimal(38,0)")).alias("digit")).collect():
        out[r["k"], r["j"]] += int(r["digit"]) << LIMB * r["place"]
    return out


def usable(df: DataFrame, vec_col: str, id_col: str, dims: int) -> DataFrame:
    """Id and vector (doubles) of the rows with exactly ``dims`` components, all finite."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = (F.size(vec_col) == dims) & F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return df.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).alias("_id"), v.alias("_v"))


def first_centroids(rows: DataFrame, clusters: int, seed: int, scale: float) -> list[list[int]]:
    """The vectors whose ids have the smallest hashes."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    found = rows.orderBy(key, "_v").limit(clusters).select("_v").collect()
    return [[int(x) for x in row] for row in integers(np.array([r["_v"] for r in found], dtype=np.float64), scale).tolist()] if found else []


def moved(centres: list[list[int]], sums: dict[tuple[int, int], int]) -> list[list[int]]:
    """Centroids at the floor of their vectors' means; those without vectors stay."""
    return [[sums[k, j] // sums[k, -1] for j in range(len(c))] if sums[k, -1] else c for k, c in enumerate(centres)]


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, clusters: int = 8, rounds: int = 10, scale: float = 1024.0, seed: int = 3) -> DataFrame:
    """One row per usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    rows = usable(df, vec_col, id_col, dims)
    kind = rows.schema["_id"].dataType.simpleString()
    schema = f"vec_id {kind}, cluster int, distance long"
    centres = first_centroids(rows, clusters, seed, scale)
    if not centres:
        none = df.sparkSession.createDataFrame([], schema)
        return none.withColumns({"cluster_inertia": F.lit(0).cast("long"), "inertia": F.lit(0).cast("long"), "centroid_sha256": F.lit("")})
    for _ in range(rounds):
        centres = moved(centres, _tally(rows, centres, scale, False))
    sums = _tally(rows, centres, scale, True)
    inertias = [sums[k, dims] for k in range(len(centres))]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _points(batch, dims, scale)
            which = nearest(points, centres)
            far = pa.array([min(int(d), LONG) for d in to_nearest(points, centres, which)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(which.astype(np.int32)), far], ["vec_id", "cluster", "distance"])

    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    of = lambda values: F.array(*[F.lit(v) for v in values])[F.col("cluster")]
    longs = lambda values: [F.lit(min(v, LONG)).cast("long") for v in values]
    out = rows.mapInArrow(assign, schema)
    return out.withColumns({"cluster_inertia": of(longs(inertias)), "inertia": longs([sum(inertias)])[0], "centroid_sha256": of(names)})
