"""The registered queries over whole small tables, each against SQL or brute force."""

import hashlib
import math
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import ann, queries, toxicity
from test_dedup_operators import brute_lines, jaccard, weighted_sets
from test_text_operators import check_pieces, plain_score
from test_vector_operators import brute_links

QUERIES, ORACLE = queries.queries(), queries.oracle_sql()


@pytest.fixture(scope="module")
def docs(spark, small):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def vectors(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    return [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows])


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, small, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = con.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    plain = lambda rows: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
    assert plain(tuple(r) for r in QUERIES[name](spark, small).select(*columns).collect()) == plain(want.fetchall())


def test_op1(spark, small, vectors):
    ids, x = vectors
    out = {(r["query_id"], r["rank"]): r for r in QUERIES["op1_ann"](spark, small).collect()}
    hits = n = 0
    for k, q in enumerate(ids):
        if q % 50 == 0:
            s = ann.cosines(np.repeat(x[k : k + 1].astype(float), len(x), axis=0), x.astype(float))
            s[k] = -2
            best = [ids[j] for j in np.lexsort((ids, -s))[:5]]
            found = [out[q, rank]["vec_id"] for rank in range(1, 6)]
            hits, n = hits + len(set(best) & set(found)), n + 5
            assert all(out[q, rank]["score"] == s[ids.index(v)] for rank, v in enumerate(found, 1))
    assert hits >= 0.9 * n and len(out) == n


def test_op2(spark, small, docs):
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op2_minhash"](spark, small).collect()}
    sets, parent = weighted_sets(docs), {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and jaccard(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in parent}


def test_op5(spark, small, vectors):
    ids, x = vectors
    n, label = brute_links(x, 0.95)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in QUERIES["op5_pq_dedup"](spark, small).collect()}
    assert got == {v: (n[k], ids[label[k]], label[k] == k) for k, v in enumerate(ids)}


def test_op8(spark, small, docs):
    rows = QUERIES["op8_packing"](spark, small).collect()
    assert [i for i, _ in docs] == list(range(len(docs)))
    assert check_pieces(rows, [t for _, t in docs], 1024) < 0.02 * sum(r["length"] for r in rows)


def test_op9(spark, small, docs):
    want = brute_lines(docs, 8)
    got = {r["doc_id"]: r["kept_sha256"] for r in QUERIES["op9_line_dedup"](spark, small).collect()}
    assert got == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in want.items()}


def test_op10(spark, small, docs):
    """Scores by plain loops, from a model trained on the same fold."""
    table = lambda name: spark.read.parquet(f"{small}/{name}.parquet")
    learned = [r["doc_id"] for r in table("labels").select("doc_id").distinct().collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    lexicon, curve = toxicity.train(table("documents"), table("labels").where(F.col("doc_id").isin(learned)))
    got = {r["doc_id"]: r for r in QUERIES["op10_toxicity"](spark, small).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        assert math.isclose(got[i]["score"], plain_score(t, lexicon, curve)[0], rel_tol=1e-6)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and got[i]["predicted"] == int(got[i]["score"] >= 0.3)
