"""The pipeline's stages against plain Python, each on the rows of the one before."""

import re
from collections import Counter

import corpus_pipeline as cp
import pytest
from marlstone.llm import langid, minhash, mixing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """The rows after each stage."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, out[-1], small).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return [{"columns": d.columns, "rows": d.collect()} for d in out]


def test_columns(stages):
    assert [name for name, _ in cp.STAGES] == ["language_id", "line_dedup", "minhash_near_dedup", "mix_sources", "pack"]
    assert all(s["columns"] == COLUMNS for s in stages[:-1])


def test_language_stage_keeps_what_has_a_language(spark, stages):
    before, after = stages[0]["rows"], {r["doc_id"]: r for r in stages[1]["rows"]}
    names, table = langid.train(spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long"))
    for r in before:
        shares = langid.mixtures([r["text"]], table)[0]
        keeps = bool(re.search(r"[^\W\d_]", r["text"] or "")) and shares.max() >= cp.LEAST_SHARE
        assert (r["doc_id"] in after) == keeps
        if keeps:
            assert after[r["doc_id"]]["lang"] == names[shares.argmax()] and after[r["doc_id"]]["text"] == r["text"]
    assert len(after) > 0.97 * len(before)


def test_line_stage(stages):
    from test_dedup_operators import brute_lines

    want = brute_lines([(r["doc_id"], r["text"]) for r in stages[1]["rows"]], 8)
    old = {r["doc_id"]: r["text"] for r in stages[1]["rows"]}
    got = {r["doc_id"]: r["text"] for r in stages[2]["rows"]}
    assert got == {i: t for i, t in want.items() if t == old[i] or t.strip()}
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2]["rows"])


def test_near_dedup_stage(stages):
    from test_dedup_operators import jaccard, weighted_sets

    rows = [(r["doc_id"], r["text"]) for r in stages[2]["rows"]]
    sets, parent = weighted_sets(rows), {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and jaccard(sets[i], sets[j]) >= minhash.SIMILARITY:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert {r["doc_id"] for r in stages[3]["rows"]} == {i for i in parent if find(i) == i}


def test_mix_stage(stages):
    from test_text_operators import plain_targets

    words = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    old = {r["doc_id"]: r for r in stages[3]["rows"]}
    sizes = Counter()
    for r in old.values():
        sizes[r["source"]] += words(r["text"])
    want = plain_targets(dict(sizes), mixing.WEIGHTS, mixing.SHARE, mixing.MAX_EPOCHS)
    taken, cut = Counter(), 0
    for r in stages[4]["rows"]:
        taken[r["source"]] += words(r["text"])
        cut += r["text"] != old[r["doc_id"]]["text"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert cut <= len(sizes)


def test_pack_stage(stages):
    rows = stages[5]["rows"]
    per_row = Counter(r["doc_id"] for r in stages[4]["rows"])
    tokens = Counter()
    for r in rows:
        tokens[r["doc_id"]] += r["length"]
    assert set(tokens) == set(per_row)
    total = Counter()
    for r in rows:
        total[r["sequence_id"]] += r["length"]
    assert max(total.values()) <= 1024
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in total.values())
    assert padding < 0.02 * sum(total.values())


def test_run_is_the_stages_in_a_row(spark, small, stages):
    got = cp.run(spark, small)
    assert sum(r["length"] for r in got.select("length").collect()) == sum(r["length"] for r in stages[5]["rows"])


def test_near_dedup_without_ids_and_with_repeated_ids(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(None, "alone without an id at all"), (None, long), (4, long), (4, long), (9, long), (None, "two rows without an id"), (None, "two rows without an id"), (5, None)]
    rows += [(7, "one id for this text"), (7, "and for another text too"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"]) for r in cp.near_dedup(spark, docs, "").collect())
    kept = [(None, "alone without an id at all"), (4, long), (None, "two rows without an id"), (5, None), (None, None)]
    assert got == Counter([*kept, (7, "one id for this text"), (7, "and for another text too")])
