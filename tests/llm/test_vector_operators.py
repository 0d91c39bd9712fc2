"""Nearest neighbours and embedding near-dedup against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import ann, ivf, pq_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=1200, dim=24, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, dim))
    x = centres[rng.integers(0, 30, n)] + 0.6 * rng.normal(size=(n, dim))
    x[100:160] = x[100] + 0.05 * rng.normal(size=(60, dim))
    x[300:310] = x[300]
    return x.astype(np.float32)


def frame(spark, x, extra=()):
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, SCHEMA)


ODD = [(5000, None, 1), (5050, [], 1), (5100, [0.0] * 24, 1), (5150, [float("nan")] + [1.0] * 23, 1), (5200, [float("inf")] + [1.0] * 23, 1), (5250, [None] + [1.0] * 23, 1), (5300, [1.0, 2.0], 1), (None, [1.0] * 24, 1)]


@pytest.fixture(scope="module")
def x():
    return vectors()


def test_neighbours_against_brute_force(spark, x):
    df = frame(spark, x, ODD).withColumn("rank", F.lit("a")).withColumn("list", F.lit(1))
    out = ann.search(df.repartition(3)).collect()
    u = x.astype(float)
    u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
    hits = 0
    for q in range(0, len(x), 50):
        rows = sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5]
        s = ann.cosines(np.repeat(x[q : q + 1].astype(float), len(x), axis=0), x.astype(float))
        s[q] = -2
        best = np.lexsort((np.arange(len(x)), -s))[:5]
        hits += len(set(best.tolist()) & {r["vec_id"] for r in rows})
        assert all(r["score"] == s[r["vec_id"]] for r in rows)
        assert [(-r["score"], r["vec_id"]) for r in rows] == sorted((-r["score"], r["vec_id"]) for r in rows)
    assert hits / (5 * len(range(0, len(x), 50))) >= 0.9
    assert {r["query_id"] for r in out} == set(range(0, len(x), 50))
    ties = [r["vec_id"] for r in sorted((r for r in out if r["query_id"] == 300), key=lambda r: r["rank"])]
    assert ties == [301, 302, 303, 304, 305]


def test_neighbours_edges(spark):
    assert ann.search(frame(spark, [])).count() == 0
    assert ann.search(frame(spark, [], ODD[:5])).count() == 0
    few = ann.search(frame(spark, np.eye(3, 24, dtype=np.float32) + 0.1)).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in few) == [(0, 1, 1), (0, 2, 2)]
    twice = ann.search(spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [1.0, 0.1], 0), (1, [1.0, 0.1], 0)], SCHEMA)).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in twice] == [(0, 1, 1)]


def test_scan_keeps_the_nearest():
    """Abandoned candidates are hardly ever among the nearest."""
    rng = np.random.default_rng(2)
    c = ivf.unit(rng.normal(size=(800, 64)))
    q = ivf.unit(rng.normal(size=(40, 64)))
    i, j = ann.scan(q, c, np.zeros((40, 800), dtype=bool), 5)
    kept = set(zip(i.tolist(), j.tolist(), strict=True))
    best = np.argsort(ivf.square_distances(q, c), axis=1)[:, :5]
    assert np.mean([(a, int(b)) in kept for a in range(40) for b in best[a]]) > 0.98
    assert len(kept) < 0.5 * 40 * 800


def brute_links(x, cosine):
    u = x.astype(float)
    u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
    linked = u @ u.T >= cosine
    np.fill_diagonal(linked, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min(label[i], label[linked[i]].min()) if linked[i].any() else label[i] for i in range(len(x))])
        if (new == label).all():
            return linked.sum(axis=1), label
        label = new


def test_links_equal_brute_force(spark, x):
    df = frame(spark, x, ODD).withColumn("v", F.lit(1)).withColumn("times", F.lit(1))
    got = {r["vec_id"]: r for r in pq_dedup.link(df.repartition(3)).collect()}
    n, label = brute_links(x, 0.95)
    assert n.max() >= 59
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n[i], label[i], label[i] == i)
    for i, *_ in ODD[:-1]:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert len(got) == len(x) + len(ODD) - 1


def test_lower_bound_never_discards():
    """Look-up distance less the code's error is at most the true distance, and look-ups are the products they stand for."""
    rng = np.random.default_rng(3)
    r = rng.normal(size=(500, 32))
    books = pq_dedup.codebooks(r, 8)
    codes, error = pq_dedup.encode(r, books)
    y = pq_dedup.decoded(codes, books)
    assert np.allclose(pq_dedup.looked_up(codes, pq_dedup.tables(r, books)), y @ r.T, atol=1e-4)
    squared = np.square(r).sum(axis=1)[None, :] + np.square(y).sum(axis=1)[:, None] - 2 * pq_dedup.looked_up(codes, pq_dedup.tables(r, books))
    true = np.sqrt(ivf.square_distances(r, r))
    assert (np.sqrt(np.maximum(squared, 0)) - error[:, None] <= true + 1e-3).all()


def test_many_lists_are_fitted_in_two_levels():
    rng = np.random.default_rng(4)
    x = ivf.unit(rng.normal(size=(12000, 8)))
    c = ivf.kmeans(x, 700)
    assert 650 <= len(c) <= 700
    assert np.bincount(ivf.nearest(x, c, 1)[:, 0], minlength=len(c)).max() < 200


@pytest.mark.parametrize("dim, inner", [(64, 3), (64, 8), (384, 3), (768, 8)])
def test_links_of_low_dimensional_vectors(spark, dim, inner):
    """Embeddings that lie near few dimensions: differences of linked vectors point across boundaries."""
    rng = np.random.default_rng(dim + inner)
    x = rng.normal(size=(1500, inner)) @ rng.normal(size=(inner, dim)) + 0.02 * rng.normal(size=(1500, dim))
    n, label_ = brute_links(x.astype(np.float32), 0.95)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pq_dedup.link(frame(spark, x)).collect()}
    assert got == {i: (n[i], label_[i]) for i in range(len(x))}


def test_lengths_are_apart(spark):
    """Vectors of several lengths: each is searched and linked among those of its own."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6 if i % 3 else 4).tolist(), 0) for i in range(300)]
    rows += [(i + 300, (np.array(v) * 2).tolist(), 0) for i, v, _ in rows[:60]] + [(900, [3.0], 0), (901, [5.0], 0), (902, [-1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pq_dedup.link(df).collect()}
    near = {r["query_id"]: [] for r in rows_of(ann.search(df))}
    for r in rows_of(ann.search(df)):
        near[r["query_id"]].append(r["vec_id"])
    for n in (4, 6, 1):
        ids = [i for i, v, _ in rows if len(v) == n]
        m = np.array([v for _, v, _ in rows if len(v) == n])
        links, label_ = brute_links(m, 0.95)
        assert [got[i] for i in ids] == [(links[k], ids[label_[k]]) for k in range(len(ids))]
        for k, i in enumerate(ids):
            if i % 50 == 0:
                s = ann.cosines(np.repeat(m[k : k + 1], len(m), axis=0), m)
                s[k] = -2
                best = [ids[j] for j in np.lexsort((ids, -s))[: min(5, len(ids) - 1)]]
                assert len(set(best) & set(near[i])) >= min(4, len(best))


def rows_of(df):
    return df.collect()


def test_links_edges(spark):
    assert pq_dedup.link(frame(spark, [])).count() == 0
    out = sorted(tuple(r) for r in pq_dedup.link(spark.createDataFrame([(3, [1.0, 0.0], 0), (3, [1.0, 0.0], 0), (7, [2.0, 0.0], 0), (9, [0.0, 1.0], 0), (None, [1.0, 0.0], 0)], SCHEMA)).collect())
    assert out == [(3, 1, 3, True), (7, 1, 3, False), (9, 0, 9, True)]


def test_links_are_counted_on_both_sides(spark):
    """Differences that lie along a few axes cross boundaries further than those in random directions."""
    rng = np.random.default_rng(9)
    scale = np.arange(1, 65) ** -1.5
    x = rng.normal(size=(2000, 64)) * scale
    x = ivf.unit(np.concatenate([x, x]))
    step = rng.normal(size=(2000, 64)) * scale
    x[2000:] = ivf.unit(x[2000:] + 0.27 * ivf.unit(step))
    n, label = brute_links(x, 0.95)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pq_dedup.link(frame(spark, x)).collect()}
    assert got == {i: (n[i], label[i]) for i in range(len(x))}
