"""Coarse inverted lists over vectors, shared by the vector operators."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors that fit the index: LIST_VECTORS for each list and LEAST_TRAIN at least, as far as TRAIN_BYTES go. Every vector is indexed.
LEAST_TRAIN, LIST_VECTORS, TRAIN_BYTES = 32768, 16, 256 << 20
#: From so many lists on, they are fitted in two levels.
MANY_LISTS = 512
SEED = 3


def usable(vectors: DataFrame) -> tuple[DataFrame, list[int]]:
    """(vec_id, v) of vectors that take part, and their lengths in order.

    Left out: null ids, null or empty vectors, vectors with null or non-finite components, and zero vectors. Cosine needs equal
    lengths, so vectors of each length are a matter of their own. Components stay floats if they are floats.
    """
    element = vectors.schema["embedding"].dataType.elementType.typeName()
    v = F.col("embedding").cast("array<float>" if element == "float" else "array<double>")
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = good.where((F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0.0))
    return good, sorted(r["n"] for r in good.select(F.size("v").alias("n")).distinct().collect())


def sample(good: DataFrame, dim: int) -> tuple[np.ndarray, int]:
    """Unit vectors of the smallest hashes of the id, and how many vectors there are."""
    total = good.count()
    most = min(max(LEAST_TRAIN, LIST_VECTORS * math.isqrt(total)), max(1, TRAIN_BYTES // (8 * dim)))
    rows = good.select("vec_id", "v", F.xxhash64("vec_id").alias("h")).orderBy("h", "vec_id").limit(most).select("v").toArrow()
    x = matrix(rows.column("v").combine_chunks()) if rows.num_rows else np.zeros((0, dim))
    return unit(x) if len(x) else x, total


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def list_count(total: int, trained: int) -> int:
    """The square root of the number of vectors, as far as there are training vectors for each list."""
    return int(max(1, min(math.isqrt(max(total, 1)), trained // LIST_VECTORS)))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = SEED) -> np.ndarray:
    if k > MANY_LISTS:
        return _two_levels(x, k, rounds, seed)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, c, 1)[:, 0]
        order = np.argsort(own, kind="stable")
        sizes = np.bincount(own, minlength=k)
        used = np.flatnonzero(sizes)
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])[used]
        c[used] = np.add.reduceat(x[order], at, axis=0) / sizes[used, None]
        empty = np.flatnonzero(sizes == 0)
        if len(empty):
            c[empty] = x[rng.choice(len(x), len(empty))]
    return c


def _two_levels(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k centres: those of about sqrt(k) clusters, each divided in proportion to its size."""
    top = kmeans(x, math.isqrt(k), rounds, seed)
    own = nearest(x, top, 1)[:, 0]
    sizes = np.bincount(own, minlength=len(top))
    ends = np.round(np.cumsum(sizes) * (k / len(x))).astype(int)
    parts = np.diff(ends, prepend=0)
    out = []
    for c, n in enumerate(parts):
        if n:
            out.append(kmeans(x[own == c], min(int(n), int(sizes[c]), MANY_LISTS), rounds, seed))
    return np.concatenate(out)


def square_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)[None, :], 0.0)


def nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The n nearest rows of c for each row of x, nearest first."""
    out = []
    for a in range(0, len(x), 4096):
        d = square_distances(x[a : a + 4096], c)
        if n < d.shape[1]:
            top = np.argpartition(d, n - 1, axis=1)[:, :n]
            top = np.take_along_axis(top, np.argsort(np.take_along_axis(d, top, axis=1), axis=1, kind="stable"), axis=1)
        else:
            top = np.argsort(d, axis=1, kind="stable")[:, :n]
        out.append(top)
    return np.concatenate(out) if out else np.zeros((0, n), dtype=np.int64)


def matrix(column) -> np.ndarray:
    """An Arrow list column of equal lengths as a float64 matrix."""
    if len(column) == 0:
        return np.zeros((0, 0))
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat = flat.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def mapped(good: DataFrame, schema: str, function) -> DataFrame:
    """mapInArrow over (vec_id, v), as function(ids, matrix) -> RecordBatch."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            if batch.num_rows:
                yield function(batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1)))

    return good.select("vec_id", "v").mapInArrow(run, schema)
