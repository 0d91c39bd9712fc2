"""Approximate nearest neighbours by adaptive dimension scan.

Vectors are scaled to length one, rotated by a random orthogonal matrix and put into inverted lists; a query probes its
nearest lists. Within a list, distances grow block by block of rotated columns. After d of D columns, sqrt(D/d) times
the partial distance estimates the whole one; a candidate is abandoned once that exceeds (1 + EPSILON / sqrt(d)) times
the query's fifth best distance so far, a hypothesis test whose error falls with d. What survives is ranked by the exact
cosine of the original vectors.

How many lists to probe is measured when the index is fitted: the least number that reaches TARGET_RECALL for queries of
the training sample against the sample.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ivf

NEIGHBOURS = 5
BLOCK = 16
EPSILON = 2.1
TARGET_RECALL = 0.96
QUERY_EVERY = 50
#: Vectors of one list, and queries that probe it, that meet in one group, at most about so many.
CHUNK, QUERY_CHUNK = 4096, 16384


def probes_for(x: np.ndarray, centroids: np.ndarray, k: int, target: float, most: int = 512) -> int:
    """The least number of lists whose vectors hold the target share of the k nearest, for some vectors of x among x."""
    if len(x) < 2:
        return len(centroids)
    own = ivf.nearest(x, centroids, 1)[:, 0]
    pick = np.linspace(0, len(x) - 1, min(most, len(x))).astype(int)
    similar = x[pick] @ x.T
    similar[np.arange(len(pick)), pick] = -2.0
    near = np.argpartition(-similar, min(k, len(x) - 1) - 1, axis=1)[:, :k]
    order = ivf.nearest(x[pick], centroids, len(centroids))
    rank = np.argsort(order, axis=1)
    needed = np.sort(np.take_along_axis(rank, own[near], axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)])


def scan(q: np.ndarray, c: np.ndarray, same: np.ndarray, k: int, block: int = BLOCK, epsilon: float = EPSILON):
    """(query row, candidate row) pairs that may be among the k nearest. q, c: rotated unit vectors; same: pairs to leave out."""
    n, dim = len(c), q.shape[1]
    if not n or not len(q):
        return np.zeros(0, int), np.zeros(0, int)
    width = min(block, dim)
    part = ivf.square_distances(q[:, :width], c[:, :width])
    part[same] = np.inf
    few = min(n, 4 * k)
    first = np.argpartition(part, few - 1, axis=1)[:, :few]
    whole = np.square(q[:, None, :] - c[first]).sum(axis=2)
    whole[~np.isfinite(np.take_along_axis(part, first, axis=1))] = np.inf
    # The k-th smallest whole distance among a few candidates bounds that among all.
    bound = np.sort(whole, axis=1)[:, min(k, few) - 1] if few >= k else np.full(len(q), np.inf)
    d = width

    def alive(value, limit):
        slack = (1.0 + epsilon / np.sqrt(d)) if d < dim else 1.0
        return np.isfinite(value) & (value * (dim / d) <= limit * slack * slack + 1e-9)

    i, j = np.nonzero(alive(part, bound[:, None]))
    value = part[i, j]
    while d < dim and len(i):
        stop = min(d + block, dim)
        value = value + np.square(q[i, d:stop] - c[j, d:stop]).sum(axis=1)
        d = stop
        keep = alive(value, bound[i])
        i, j, value = i[keep], j[keep], value[keep]
    return i, j


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision; each row is computed alike wherever it stands."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def search(vectors: DataFrame, k: int = NEIGHBOURS, every: int = QUERY_EVERY, target_recall: float = TARGET_RECALL) -> DataFrame:
    """The k nearest of each query found: query_id, rank from 1, vec_id, score.

    Queries are the vectors whose id is divisible by `every`; candidates are all vectors of the same length but those with the
    query's id. Ties go to the smaller vec_id. Vectors that are null, zero, or have null or non-finite components take no part.
    Of rows that share an id each is a vector; a neighbour is listed once, with its best score. A query with fewer
    candidates than k has them all if its probes hold them. An empty table gives no rows.
    """
    good, dims = ivf.usable(vectors)
    result = "query_id long, rank int, vec_id long, score double"
    if not dims:
        return vectors.sparkSession.createDataFrame([], result)
    found = [_found(good.where(F.size("v") == dim), dim, k, every, target_recall) for dim in dims]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    out = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _found(good: DataFrame, dim: int, k: int, every: int, target_recall: float) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query in each chunk of a list, for vectors of one length."""
    x, total = ivf.sample(good, dim)
    centroids = ivf.kmeans(x, ivf.list_count(total, len(x)))
    probes = probes_for(x, centroids, k, target_recall)
    rotation = np.linalg.qr(np.random.default_rng(ivf.SEED).normal(size=(dim, dim)))[0]
    element = good.schema["v"].dataType.elementType.typeName()

    def own_list(ids, m):
        import pyarrow as pa

        lists = ivf.nearest(ivf.unit(m), centroids, 1)[:, 0].astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(lists)], names=["vec_id", "list"])

    def probed(ids, m):
        import pyarrow as pa

        lists = ivf.nearest(ivf.unit(m), centroids, probes).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, lists.shape[1])), pa.array(lists.ravel())], names=["vec_id", "list"])

    def with_lists(rows, function):
        def both(ids, m):
            import pyarrow as pa

            found = function(ids, m)
            times = found.num_rows // len(ids)
            index = np.repeat(np.arange(len(ids)), times)
            flat = m[index]
            v = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, dim, dtype=np.int32)), pa.array(flat.ravel(), pa.float32() if element == "float" else pa.float64()))
            return pa.RecordBatch.from_arrays([found.column(0), found.column(1), v], names=["id", "list", "v"])

        return ivf.mapped(rows, f"id long, list int, v array<{element}>", both)

    counts = ivf.mapped(good, "vec_id long, list int", own_list).groupBy("list").agg(
        F.ceil(F.count("*") / CHUNK).cast("int").alias("vs"), F.ceil(F.count_if(F.col("vec_id") % every == 0) * probes / QUERY_CHUNK).cast("int").alias("qs")
    )
    counts = counts.withColumn("qs", F.greatest("qs", F.lit(1)))
    v = with_lists(good, own_list).join(counts, "list").withColumn("vc", F.pmod(F.xxhash64("id"), F.col("vs")).cast("int"))
    v = v.withColumn("qc", F.explode(F.sequence(F.lit(0), F.col("qs") - 1))).select(F.col("list").alias("vl"), "vc", "qc", "id", "v")
    q = with_lists(good.where(F.col("vec_id") % every == 0), probed).join(counts, "list").withColumn("rc", F.pmod(F.xxhash64("id"), F.col("qs")).cast("int"))
    q = q.withColumn("uc", F.explode(F.sequence(F.lit(0), F.col("vs") - 1))).select(F.col("list").alias("ql"), "uc", "rc", F.col("id").alias("query_id"), F.col("v").alias("w"))

    def run(queries, candidates):
        import pandas as pd

        if not len(candidates) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        cid, c = candidates["id"].to_numpy(), np.stack(candidates["v"].to_numpy()).astype(np.float64)
        rotated = ivf.unit(c) @ rotation
        out = []
        for a in range(0, len(queries), 64):
            qid, w = queries["query_id"].to_numpy()[a : a + 64], np.stack(queries["w"].to_numpy()[a : a + 64]).astype(np.float64)
            i, j = scan(ivf.unit(w) @ rotation, rotated, qid[:, None] == cid[None, :], k)
            if not len(i):
                continue
            score = cosines(w[i], c[j])
            order = np.lexsort((cid[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            start = np.flatnonzero(np.diff(i, prepend=-1))
            place = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
            keep = place < k
            out.append(pd.DataFrame({"query_id": qid[i[keep]], "vec_id": cid[j[keep]], "score": score[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})

    return q.groupBy("ql", "uc", "rc").cogroup(v.groupBy("vl", "vc", "qc")).applyInPandas(run, "query_id long, vec_id long, score double")
