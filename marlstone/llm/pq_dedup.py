"""Embedding near-dedup by product quantisation.

Unit vectors go to inverted lists; the residual to the list's centre is cut into subspaces, each coded by the nearest of up to 256
centres. A vector is compared with the lists that a linked vector could be in: cosine 0.95 is a distance of 0.316, and two
vectors on the two sides of a boundary between lists are no nearer to each other than either is to the boundary, so those
lists are probed whose boundary is nearer than that, and no link is lost. Lists are numbered, and a vector probes its own and those
before it: each pair meets once and is counted for both.

Asymmetric distances to codes come from table look-ups: with c the list's centre and r a decoded residual, the squared distance of x is
|x - c|^2 + |r|^2 + 2 c r - 2 x r, and x r is a sum of one table entry for each subspace; the tables do not depend on the list. A code's
own error is stored with it, so distance less error is a lower bound and no linked vector is discarded. What remains is
decided by exact cosine.

Neighbouring lists form groups, and a vector goes once to each group that it probes, not once to each list. Equal vectors are one
class and compared once. Links are counted and joined in the tasks that find them; only counts and spanning edges leave a
task, so a dense cluster of n vectors sends n rows, not n squared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ivf
from .ann import cosines
from .common import checkpointed
from .graph import components, label

COSINE = 0.95
SUBSPACES = 8
CODES = 256
#: Added to the linking length for rounding, and to squared look-up distances, which are single precision.
SLACK, TABLE_SLACK = 1e-6, 1e-4
#: Numbers in the vectors of one chunk of a group, at most about; two chunks meet in one task.
CHUNK_NUMBERS, LEAST_CHUNK = 1 << 21, 2048
#: Probing vectors whose tables are made at a time.
STEP = 256


def codebooks(residuals: np.ndarray, subspaces: int) -> list[np.ndarray]:
    return [ivf.kmeans(part, min(CODES, max(1, len(part) // 8)), rounds=8) for part in np.array_split(residuals, subspaces, axis=1)]


def encode(residuals: np.ndarray, books: list[np.ndarray]):
    """(codes, error): the code of each subspace, and the length of what the codes leave out."""
    codes, error = np.zeros((len(residuals), len(books)), dtype=np.uint8), np.zeros(len(residuals))
    for m, (part, book) in enumerate(zip(np.array_split(residuals, len(books), axis=1), books, strict=True)):
        codes[:, m] = ivf.nearest(part, book, 1)[:, 0]
        error += np.square(part - book[codes[:, m]]).sum(axis=1)
    return codes, np.sqrt(error)


def tables(x: np.ndarray, books: list[np.ndarray]) -> list[np.ndarray]:
    """For each subspace, the products of its centres (rows) and the rows of x (columns)."""
    parts = np.array_split(x.astype(np.float32), len(books), axis=1)
    return [book.astype(np.float32) @ part.T for part, book in zip(parts, books, strict=True)]


def decoded(codes: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([book[codes[:, m]] for m, book in enumerate(books)], axis=1)


def looked_up(codes: np.ndarray, made: list[np.ndarray]) -> np.ndarray:
    """Products of decoded residuals (rows) and probing vectors (columns), by table look-up."""
    total = made[0][codes[:, 0]]
    for m in range(1, len(made)):
        total += made[m][codes[:, m]]
    return total


def boundary(d: np.ndarray, d_own: np.ndarray, own_centres: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """How far vectors are from the boundary of their own list with others; d, d_own: squared distances to the centres."""
    apart = np.sqrt(ivf.square_distances(own_centres, centres))
    return (d - d_own[:, None]) / (2.0 * np.maximum(apart, 1e-12))


class Index:
    """Centres, in the order of their groups, and code books."""

    def __init__(self, x: np.ndarray, total: int, reach: float):
        centroids = ivf.kmeans(x, ivf.list_count(total, len(x)))
        dim = x.shape[1]
        self.chunk = max(LEAST_CHUNK, min(CHUNK_NUMBERS // dim, total // 12))
        groups = ivf.kmeans(centroids, max(1, min(len(centroids), -(-total // self.chunk))))
        group = ivf.nearest(centroids, groups, 1)[:, 0]
        order = np.argsort(group, kind="stable")
        self.centroids, self.group, self.groups, self.reach = centroids[order], group[order], len(groups), reach
        self.books = codebooks(x - self.centroids[ivf.nearest(x, self.centroids, 1)[:, 0]], min(SUBSPACES, dim))

    def probed(self, x: np.ndarray):
        """(own list of each row, row, group): the groups that hold lists which rows probe, by row."""
        own, rows, groups = np.zeros(len(x), dtype=np.int32), [], []
        starts = np.searchsorted(self.group, np.arange(self.groups))
        used = np.flatnonzero(np.bincount(self.group, minlength=self.groups))
        for a in range(0, len(x), step := max(1, (1 << 21) // len(self.centroids))):
            d = ivf.square_distances(x[a : a + step], self.centroids)
            own[a : a + step] = mine = d.argmin(axis=1)
            away = boundary(d, d[np.arange(len(d)), mine], self.centroids[mine], self.centroids)
            before = np.arange(d.shape[1])[None, :] - mine[:, None]
            near = (before == 0) | ((before < 0) & (away <= self.reach))
            i, g = np.nonzero(np.logical_or.reduceat(near, starts[used], axis=1))
            rows.append(a + i)
            groups.append(used[g])
        return own, np.concatenate(rows), np.concatenate(groups)


def meet(index: Index, cosine: float, qid, qlist, qtimes, w, yid, ylist, ytimes, v):
    """(id, n, to) from probing vectors w and members v of one group: links counted on both sides, and spanning edges."""
    uw, uv = ivf.unit(w), ivf.unit(v)
    codes, error = encode(uv - index.centroids[ylist], index.books)
    r = decoded(codes, index.books)
    fixed = (np.square(r).sum(axis=1) + 2.0 * (r * index.centroids[ylist]).sum(axis=1)).astype(np.float32)
    lists, place = np.unique(ylist, return_inverse=True)
    limit = np.square(np.sqrt(2.0 - 2.0 * cosine) + SLACK + error).astype(np.float32) + np.float32(TABLE_SLACK) - fixed
    rows, columns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, len(w), STEP):
        x, mine = uw[a : a + STEP], qlist[a : a + STEP]
        d = ivf.square_distances(x, index.centroids[lists])
        own = np.square(x - index.centroids[mine]).sum(axis=1)
        away = boundary(d, own, index.centroids[mine], index.centroids[lists])
        open_ = ((away <= index.reach) & (lists[None, :] < mine[:, None])) | (lists[None, :] == mine[:, None])
        # What a look-up sum must be at least; out of reach where the list is not probed.
        least = np.where(open_, d, np.inf).astype(np.float32).T
        near = least[place] - limit[:, None] <= 2.0 * looked_up(codes, tables(x, index.books))
        j, i = np.nonzero(near)
        i += a
        kept = (ylist[j] < qlist[i]) | (yid[j] < qid[i])
        i, j = i[kept], j[kept]
        for b in range(0, len(i), 1 << 15):
            s = slice(b, b + (1 << 15))
            linked = cosines(w[i[s]], v[j[s]]) >= cosine
            rows.append(i[s][linked])
            columns.append(j[s][linked])
    i, j = np.concatenate(rows), np.concatenate(columns)
    ids, at_id = np.unique(np.concatenate([qid, yid]), return_inverse=True)
    p, q = at_id[i], at_id[len(qid) + j]
    to = label(p, q, len(ids))
    n = np.zeros(len(ids), dtype=np.int64)
    np.add.at(n, p, ytimes[j])
    np.add.at(n, q, qtimes[i])
    used = np.flatnonzero(n)
    return ids[used], n[used], ids[to[used]]


def _found(classes: DataFrame, index: Index, dim: int, cosine: float) -> DataFrame:
    """(id, n, to): the links that each task finds, from rows (id, times, v) of different vectors of one length."""
    import pyarrow as pa

    element = classes.schema["v"].dataType.elementType.typeName()
    number = pa.float32() if element == "float" else pa.float64()

    def hashed(ids):
        h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(29))) >> np.uint64(8)).astype(np.int64)

    def sizes(batches: Iterator) -> Iterator:
        held, asked = np.zeros(index.groups, np.int64), np.zeros(index.groups, np.int64)
        for batch in batches:
            if batch.num_rows:
                own, _, groups = index.probed(ivf.unit(ivf.matrix(batch.column(0))))
                held += np.bincount(index.group[own], minlength=index.groups)
                asked += np.bincount(groups, minlength=index.groups)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.arange(index.groups), held, asked)], names=["g", "held", "asked"])

    # One row for each group of lists reaches the driver.
    counts = classes.select("v").mapInArrow(sizes, "g long, held long, asked long").groupBy("g").agg(F.sum("held"), F.sum("asked")).collect()
    chunks = np.ones((2, index.groups), dtype=np.int64)
    for g, held, asked in counts:
        chunks[:, g] = max(1, -(-held // index.chunk)), max(1, -(-asked // index.chunk))

    def dealt(batches: Iterator) -> Iterator:
        for batch in batches:
            ids, times = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for a in range(0, len(ids), 1024):
                m = ivf.matrix(batch.column(2).slice(a, 1024))
                own, row, group = index.probed(ivf.unit(m))
                h = hashed(ids[a : a + 1024])
                every = np.arange(len(m))
                for asks, rows, g in ((False, every, index.group[own]), (True, row, group)):
                    mine, others = chunks[int(asks)][g], chunks[1 - int(asks)][g]
                    k = np.repeat(np.arange(len(rows)), others)
                    other = np.arange(len(k)) - np.repeat(np.cumsum(others) - others, others)
                    r, chunk = rows[k], (h[rows] % mine)[k]
                    flat = m[r]
                    v = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, dim, dtype=np.int32)), pa.array(flat.ravel(), number))
                    vc, qc = (other, chunk) if asks else (chunk, other)
                    columns = [pa.array(x, pa.int32()) for x in (g[k], vc, qc)] + [pa.array(np.full(len(k), asks)), pa.array(ids[a + r]), pa.array(own[r]), pa.array(times[a + r]), v]
                    yield pa.RecordBatch.from_arrays(columns, names=["g", "vc", "qc", "asks", "id", "list", "times", "v"])

    rows = classes.select("id", "times", "v").mapInArrow(dealt, f"g int, vc int, qc int, asks boolean, id long, list int, times long, v array<{element}>")

    def run(task):
        import pandas as pd

        asks = task["asks"].to_numpy()
        sides = []
        for side in (task[asks], task[~asks]):
            sides += [side["id"].to_numpy(), side["list"].to_numpy(), side["times"].to_numpy(), np.stack(side["v"].to_numpy()).astype(np.float64) if len(side) else None]
        empty = np.zeros(0, np.int64)
        found = meet(index, cosine, *sides) if sides[3] is not None and sides[7] is not None else (empty, empty, empty)
        return pd.DataFrame(dict(zip(("id", "n", "to"), found, strict=True)))

    return rows.groupBy("g", "vc", "qc").applyInPandas(run, "id long, n long, to long")


def link(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per distinct non-null vec_id: vec_id, n_links, component_id, kept.

    n_links counts the other vectors at a cosine of at least the given one; component_id is the smallest vec_id that links
    lead to, itself included. Vectors that are null, zero, or have null or non-finite components link with nothing, vectors of
    different lengths not with each other. Rows that share a vec_id should be equal: one of them is used. An empty table gives
    no rows; other columns are ignored.
    """
    every = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    good, dims = ivf.usable(vectors)
    alone = every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not dims:
        return alone
    good = checkpointed(good.groupBy("vec_id").agg(F.min_by("v", F.xxhash64("v")).alias("v")))
    classes = checkpointed(good.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("times")))
    found = None
    for dim in dims:
        own = classes.where(F.size("v") == dim)
        x, total = ivf.sample(own.select(F.col("id").alias("vec_id"), "v"), dim)
        if total:
            part = _found(own, Index(x, total, float(np.sqrt(2.0 - 2.0 * cosine)) + SLACK), dim, cosine)
            found = part if found is None else found.unionByName(part)
    found = checkpointed(found)
    labels = components(found.select(F.col("id").alias("a"), F.col("to").alias("b"))).withColumnRenamed("id", "label_id")
    links = found.groupBy("id").agg(F.sum("n").alias("n")).withColumnRenamed("id", "links_id")
    reps = classes.join(labels, F.col("id") == F.col("label_id"), "left").join(links, F.col("id") == F.col("links_id"), "left")
    reps = reps.select("v", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = good.join(reps, "v").select("vec_id", "n_links", "component_id").unionByName(alone.select("vec_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id")))
    out = out.groupBy("vec_id").agg(F.coalesce(F.max("n_links"), F.lit(0)).cast("long").alias("n_links"), F.min("component_id").alias("component_id"))
    out = out.withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.withColumn("kept", F.col("component_id") == F.col("vec_id"))
