"""Near-dedup, substring dedup and line dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import graph, line_dedup, minhash, substring, textvec

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)


def words(n, rng):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def test_word_hashes_and_runs():
    texts = ["a b  c d", None, "", "b c", "A\x0bb é"]
    w = textvec.Words(texts)
    assert np.diff(w.first).tolist() == [3, 0, 0, 2, 3]
    assert w.hash[1] == w.hash[3] and w.hash[2] != w.hash[4]
    folded = textvec.Words(["Hello, WORLD-wide", "hello world wide"], fold=True)
    assert (folded.hash[:3] == folded.hash[3:]).all()
    runs = textvec.Runs(np.array([5, 7, 9, 5, 7], dtype=np.uint64))
    assert runs.hash(np.array([0]), np.array([2])) == runs.hash(np.array([3]), np.array([5]))
    assert len(textvec.Words([]).hash) == 0
    assert list(textvec.groups(["aa", "b" * 50, None, "c"], 10)) == [(0, 1), (1, 2), (2, 4)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(1, 60)] + [(5, None), (9, 9)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# MinHash near-dedup


def weighted_sets(texts):
    """Weighted shingle sets by plain Python, with true document frequencies."""
    tokens = {i: re.findall("[a-z0-9\u0080-\U0010ffff]+", (t or "").lower()) for i, t in texts}
    df = Counter(w for ws in tokens.values() for w in set(ws))
    n = len(texts)
    out = {}
    for i, ws in tokens.items():
        k = min(5, len(ws))
        tf = Counter(tuple(ws[a : a + k]) for a in range(len(ws) - k + 1)) if ws else {}
        out[i] = {s: (1 + np.log(c)) * np.mean([1 + np.log((n + 1) / (df[w] + 1)) for w in s]) for s, c in tf.items()}
    return out


def jaccard(a, b):
    both = sum(min(w, b[s]) for s, w in a.items() if s in b)
    return both / (sum(a.values()) + sum(b.values()) - both) if a and b else 0.0


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for base in range(25):
        text = words(rng.randrange(40, 120), rng)
        for copy in range(rng.randrange(1, 6)):
            new = list(text)
            for _ in range(copy * rng.randrange(0, 2)):
                new[rng.randrange(len(new))] = "changed"
            joined = " ".join(new)
            rows.append((len(rows), joined.upper() if copy == 3 else joined + "." * (copy == 2)))
    rows += [(len(rows) + k, t) for k, t in enumerate([None, "", "  ", "one two", "ONE two!", "y " * 3000, "y " * 3000 + "z"])]
    docs = frame(spark, rows).withColumn("rep", F.lit(1)).withColumn("block", F.lit("x"))
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs.repartition(3)).collect()}
    sets = weighted_sets(rows)
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    near = 0
    for i in sets:
        for j in sets:
            if i < j:
                s = jaccard(sets[i], sets[j])
                near += abs(s - 0.8) < 1e-3
                if s >= 0.8:
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    assert not near
    assert got == {i: find(i) for i in parent}
    assert got[rows[-4][0]] == got[rows[-3][0]]
    empties = [i for i, t in rows if not (t or "").strip()]
    assert all(got[i] == i for i in empties)


def test_sampling_agrees_as_often_as_similarity():
    """The share of agreeing samples estimates the weighted Jaccard similarity."""
    rng = random.Random(3)
    idf = np.ones(minhash.DF_BUCKETS, dtype=np.float32)
    draws = minhash._draws()
    errors = []
    for _ in range(30):
        a = words(200, rng)
        b = list(a)
        for _ in range(rng.randrange(1, 25)):
            b[rng.randrange(200)] = "other"
        h, w, first, _, _ = minhash.weighted_shingles([" ".join(a), " ".join(b)], idf)
        out = minhash.sketch(h, w, first, draws, samples=256)
        x, y = ({int(k): float(v) for k, v in zip(h[first[i] : first[i + 1]], w[first[i] : first[i + 1]], strict=True)} for i in (0, 1))
        errors.append((out[0] == out[1]).mean() - jaccard(x, y))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_near_duplicates_edges(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    text = " ".join(words(60, random.Random(4)))
    rows = [(1, text), (1, text), (None, text), (7, text)]
    assert {tuple(r) for r in minhash.near_duplicates(frame(spark, rows)).collect()} == {(1, 1, True), (7, 1, False)}


def test_large_group_of_near_copies(spark):
    """Hundreds of different near-copies are one class, by a number of proposals linear in the group."""
    rng = random.Random(5)
    text = words(150, rng)
    rows = []
    for i in range(300):
        new = list(text)
        new[rng.randrange(150)] = f"edit{i}"
        rows.append((i, " ".join(new)))
    out = minhash.near_duplicates(frame(spark, rows)).agg(F.countDistinct("class_id")).first()[0]
    assert out == 1


def family(rng, n, common=150, own=21, shared=8):
    """Texts with a common passage, each two below 0.8 alike, and of some two that share more, above."""
    base = words(common, rng)
    tails = [words(own, rng) for _ in range(n)]
    for k in range(0, n - 1, 20):
        tails[k + 1] = tails[k][:shared] + tails[k + 1][shared:]
    order = rng.sample(range(n), n)
    return [(order[k], " ".join(base + tails[k])) for k in range(n)]


def test_near_pairs_within_a_large_family(spark):
    """Every pair of a bucket is compared, not only those that are neighbours in it."""
    rows = sorted(family(random.Random(14), 240))
    sets = weighted_sets(rows)
    pairs = {(i, j): jaccard(sets[i], sets[j]) for i in sets for j in sets if i < j}
    linked = sorted(p for p, s in pairs.items() if s >= 0.8)
    assert sorted(pairs.values())[len(pairs) // 2] > 0.7 and min(abs(s - 0.8) for s in pairs.values()) > 1e-4
    # No text has two partners here.
    assert len(linked) >= 10 and len({x for p in linked for x in p}) == 2 * len(linked)
    want = {i: i for i in sets} | {b: a for a, b in linked}
    out = minhash.near_duplicates(frame(spark, rows)).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == want


# Substring dedup


def brute_substrings(rows, window):
    tokens = [(i, [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]) for i, t in rows]
    first = {}
    for i, ws in tokens:
        for p in range(len(ws) - window + 1):
            key = tuple(ws[p : p + window])
            first[key] = min(first.get(key, i), i)
    out = set()
    for i, ws in tokens:
        gone = set()
        for p in range(len(ws) - window + 1):
            if first[tuple(ws[p : p + window])] < i:
                gone.update(range(p, p + window))
        kept = " ".join(w for p, w in enumerate(ws) if p not in gone)
        out.add((i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substring_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c"] if seed == 3 else VOCABULARY
    passages = [[rng.choice(vocabulary) for _ in range(rng.randrange(10, 40))] for _ in range(6)]
    rows = []
    for i in range(80):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            parts += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randrange(1, 30))]
        rows.append((i * 3 % 241, " ".join(parts) if i % 4 else "\n\t".join(parts)))
    rows += [(900, None), (901, ""), (902, " \n "), (903, "z " * 5000), (904, "z " * 5000), (905, rows[3][1]), (906, "é ü " * 20), (907, "é ü " * 20)]
    got = {tuple(r) for r in substring.remove_repeats(frame(spark, rows).withColumn("block", F.lit(1)).repartition(3)).collect()}
    assert got == brute_substrings(rows, 13)


def test_substring_edges(spark):
    assert substring.remove_repeats(frame(spark, [])).count() == 0
    text = " ".join(words(30, random.Random(6)))
    out = substring.remove_repeats(frame(spark, [(5, text), (5, text), (None, text), (2, text)]), with_text=True).collect()
    assert sorted((r["doc_id"], r["n_removed"], r["kept_text"]) for r in out) == [(2, 0, text), (5, 30, ""), (5, 30, "")]


# Line dedup


def longest_common(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_patience_is_an_alignment():
    rng = random.Random(7)
    for _ in range(300):
        a = [rng.randrange(12) for _ in range(rng.randrange(0, 14))]
        b = [rng.randrange(12) for _ in range(rng.randrange(0, 14))]
        pairs = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) <= longest_common(a, b)
        assert bool(pairs) == bool(set(a) & set(b))
    # Without repeats and moves, the alignment is a longest common subsequence.
    a = list(range(40))
    assert len(line_dedup.patience(a, [x for x in a if x % 3] + [99])) == 26
    assert line_dedup.longest_increasing([3, 1, 2, 5, 4]) in ([1, 2, 4], [1, 2, 3])


def line_items(counts, least):
    """(first, end) of single lines and of the shortest runs of enough words from each line on and up to each line."""
    n = len(counts)
    out = {(k, k + 1) for k in range(n)}
    for k in range(n):
        ends = [e for e in range(k + 1, n + 1) if sum(counts[k:e]) >= least]
        starts = [s for s in range(k + 1) if sum(counts[s : k + 1]) >= least]
        out |= {(k, ends[0])} if ends else set()
        out |= {(starts[-1], k + 1)} if starts else set()
    return out


def brute_lines(rows, least):
    """Every pair that line_dedup pairs, by strings, aligned one by one."""
    lines = {i: [(n, s.strip()) for n, s in enumerate(t.split("\n")) if s.strip()] for i, t in rows if i is not None and t is not None}
    counts = {i: [len(s.split()) for _, s in ls] for i, ls in lines.items()}
    items = {i: {tuple(s for _, s in lines[i][a:b]) for a, b in line_items(counts[i], least)} for i in lines}
    held = {}
    for i, own in items.items():
        for x in own:
            held.setdefault(x, set()).add(i)
    gone = {}
    for i in lines:
        partners = set()
        for x in items[i]:
            before = {j for j in held[x] if j < i}
            if before:
                partners |= before if len(held[x]) <= line_dedup.RARE else {min(held[x])}
        for j in partners:
            for k in line_dedup.common_blocks([s for _, s in lines[j]], [s for _, s in lines[i]], counts[i], least):
                gone.setdefault(i, set()).add(lines[i][k][0])
    return {i: "\n".join(s for n, s in enumerate(t.split("\n")) if n not in gone.get(i, ())) if t is not None else None for i, t in rows}


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(8)
    pool = [" ".join(words(rng.randrange(1, 12), rng)) for _ in range(60)]
    blocks = [[rng.choice(pool) for _ in range(rng.randrange(2, 6))] for _ in range(8)]
    rows = []
    for i in range(70):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            lines += rng.choice(blocks) if rng.random() < 0.5 else [" ".join(words(6, rng)), "", "  "]
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "same line of more than eight words in it here\n" * 400), (204, "same line of more than eight words in it here\n" * 400)]
    docs = frame(spark, rows).withColumn("n_lines", F.lit("old")).withColumn("a", F.lit(1))
    out = line_dedup.remove_lines(docs.repartition(3)).collect()
    assert {r["doc_id"]: r["text"] for r in out} == brute_lines(rows, line_dedup.LEAST_WORDS)
    assert sum(r["n_removed"] > 0 for r in out) > 20
    assert {"doc_id", "text", "n_lines", "n_removed", "a"} <= set(out[0].asDict())


def test_line_dedup_keeps_clean_and_odd_rows(spark):
    rng = random.Random(9)
    clean = [(i, "\n".join(" ".join(words(9, rng)) for _ in range(5))) for i in range(20)]
    short = [(50, "Yes.\n" + clean[0][1][:0] + "own words only here"), (51, "Yes.\nother words stand here")]
    out = {r["doc_id"]: r for r in line_dedup.remove_lines(frame(spark, clean + short)).collect()}
    assert all(r["n_removed"] == 0 for r in out.values())
    line = "a line with quite a few words in it, nine"
    odd = [(None, line), (None, line), (4, line), (4, line), (1, line)]
    got = sorted((str(r["doc_id"]), r["text"], r["n_removed"]) for r in line_dedup.remove_lines(frame(spark, odd)).collect())
    assert got == [("1", line, 0), ("4", "", 1), ("4", "", 1), ("None", line, 0), ("None", line, 0)]
    # Rows of one id and different texts: each by its own text.
    odd = [(1, "Z\nfoo"), (2, "Z\nbar"), (2, f"precious unique first line of another text\n{line}\nmore"), (2, f"{line}\nends"), (1, line)]
    got = sorted((r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.remove_lines(frame(spark, odd)).collect())
    assert got == [(1, "Z\nfoo", 0), (1, line, 0), (2, "Z\nbar", 0), (2, "ends", 1), (2, "precious unique first line of another text\nmore", 1)]
    # White space at the ends of lines does not count.
    ends = [(1, f"{line}\nx"), (2, f"\t{line} \r\ny\r"), (3, f"{line}\x0b\n\x0c")]
    got = sorted((r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.remove_lines(frame(spark, ends)).collect())
    assert got == [(1, f"{line}\nx", 0), (2, "y\r", 1), (3, "\x0c", 1)]
    assert line_dedup.remove_lines(frame(spark, [])).count() == 0


def test_lines_in_one_order_equal_all_pairs(spark):
    """Where shared blocks stand in one order everywhere, every common run of enough words goes; nothing of line_dedup is used."""
    rng = random.Random(19)
    blocks = [[f"b{k} " + " ".join(words(rng.randrange(0, 5), rng)) + f" {n}" for n in range(rng.randrange(1, 7))] for k in range(25)]
    rows = []
    for i in range(60):
        lines = []
        for k in sorted(rng.sample(range(25), rng.randrange(0, 6))):
            at = rng.randrange(len(blocks[k]))
            lines += [f"own {i} {k}"] + (blocks[k] if rng.random() < 0.7 else blocks[k][at:])
        rows.append((i, "\n".join(lines)))
    want = {}
    for i, t in rows:
        b, gone = t.split("\n"), set()
        for j, u in rows:
            a = u.split("\n")
            for p in range(len(a) if j < i else 0):
                for q in range(len(b)):
                    n = 0
                    while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n]:
                        n += 1
                    if sum(len(x.split()) for x in b[q : q + n]) >= 8:
                        gone.update(range(q, q + n))
        want[i] = "\n".join(x for k, x in enumerate(b) if k not in gone)
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_lines(frame(spark, rows)).collect()}
    assert got == want and sum(want[i] != t for i, t in rows) > 20


def test_block_of_frequent_lines(spark):
    """A block is removed although each of its lines has an earlier holder; the result is that of all pairs aligned."""
    block = [f"line {VOCABULARY[k]} of the block" for k in range(10)]
    rows = [(k + 1, block[k]) for k in range(10)] + [(k, "\n".join(block)) for k in range(11, 15)]
    verse = [f"verse {VOCABULARY[k + 20]}" for k in range(9)]
    rows += [(20 + 9 * t + k, verse[k] + "\n" + f"own{t}{k}") for t in range(3) for k in range(9)] + [(60, "\n".join(verse)), (61, "x\n" + "\n".join(verse[2:]) + "\ny")]
    gone = {i: set() for i, _ in rows}
    for j, a in rows:
        for i, b in rows:
            if j < i:
                gone[i].update(line_dedup.common_blocks(a.split("\n"), b.split("\n"), [len(x.split()) for x in b.split("\n")]))
    assert {i for i in gone if gone[i]} == {12, 13, 14, 61}
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.remove_lines(frame(spark, rows)).collect()}
    assert got == {i: len(x) for i, x in gone.items()}
