"""Language ID, toxicity, licences, mixing and packing."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import langid, license_scan, mixing, packing, toxicity
from marlstone.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, lang=None, source=None):
    rows = [(i, t, (lang or {}).get(i), (source or {}).get(i), None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# Language ID

EN = "the and of with from this that which over under between house water morning light"
DE = "der die das und nicht über straße schön möglichkeit zwischen haus wasser morgen licht"


def sentence(words, n, rng):
    return " ".join(rng.choice(words.split()) for _ in range(n))


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(1)
    rows = [(i, sentence(DE if i % 2 else EN, 60, rng), "de" if i % 2 else "en", None, None) for i in range(60)]
    return langid.train(spark.createDataFrame(rows, DOCS))


def test_language_mixture(spark, trained):
    rng = random.Random(2)
    texts = [sentence(EN, 50, rng), sentence(DE, 50, rng), sentence(EN, 60, rng) + " " + sentence(DE, 30, rng), None, "", "123 !!", "x " * 20000 + sentence(DE, 9, rng)]
    names, table = trained
    out = {r["doc_id"]: r for r in langid.identify(docs_of(spark, texts), names, table).collect()}
    assert [out[i]["lang_pred"] for i in range(3)] == ["en", "de", "en"]
    assert 0.55 < out[2]["score"] < 0.8 and '"de"' in out[2]["proportions"]
    assert [(out[i]["lang_pred"], out[i]["score"]) for i in (3, 4, 5)] == [("und", 0.0)] * 3
    assert len(out) == 7


def test_mixture_equals_plain_em(trained):
    """The vectorised EM against loops over words."""
    _, table = trained
    text = "the house und das wasser of morning straße with light nicht schön that over"
    pi = langid.mixtures([text], table, penalty=0.0)[0]
    grams, first, _ = langid.word_grams([text])
    ll = np.array([[table[grams[a:b], k].astype(float).sum() for k in range(2)] for a, b in zip(first, first[1:], strict=False)])
    w = np.array([0.5, 0.5])
    for _ in range(langid.ITERATIONS):
        like = np.exp(np.maximum(ll - ll.max(axis=1, keepdims=True), -30)) * w
        w = (like / like.sum(axis=1, keepdims=True)).mean(axis=0)
    assert np.allclose(pi, w, atol=1e-6)


def plain_mixture(ll, allowed, rounds=langid.ITERATIONS):
    """(proportions, log likelihood) of a mixture of the allowed languages, by loops over words."""
    pi = {k: 1 / len(allowed) for k in allowed}
    for _ in range(rounds):
        sums = dict.fromkeys(allowed, 0.0)
        for word in ll:
            top = max(word)
            parts = {k: pi[k] * math.exp(max(word[k] - top, -30)) for k in allowed}
            for k in allowed:
                sums[k] += parts[k] / sum(parts.values())
        pi = {k: sums[k] / len(ll) for k in allowed}
    value = sum(max(word) + math.log(sum(pi[k] * math.exp(max(word[k] - max(word), -30)) for k in allowed)) for word in ll)
    return pi, value


def test_language_set_is_the_best_of_all_sets(spark):
    """The chosen set against every set of five languages, by penalised likelihood."""
    from itertools import combinations

    rng = random.Random(12)
    letters = ["aeiou", "bcdfg", "hjklm", "npqrs", "tvwxz"]
    own = [[" ".join("".join(rng.choice(x + "e") for _ in range(6)) for _ in range(1)) for _ in range(60)] for x in letters]
    rows = [(i, " ".join(rng.choice(own[i % 5]) for _ in range(80)), f"l{i % 5}", None, None) for i in range(100)]
    names, table = langid.train(spark.createDataFrame(rows, DOCS))
    assert names == [f"l{k}" for k in range(5)]
    texts = []
    for k in [1, 2, 3, 4, 5, 5, 4, 3]:
        chosen = rng.sample(range(5), k)
        texts.append(" ".join(rng.choice(own[x]) for x in chosen for _ in range(rng.randrange(15, 40))))
    got = langid.mixtures(texts, table)
    for i, text in enumerate(texts):
        grams, first, _ = langid.word_grams([text])
        ll = [[float(table[grams[a:b], k].astype(float).sum()) for k in range(5)] for a, b in zip(first, first[1:], strict=False)]
        cost = langid.PENALTY * 0.5 * math.log(len(ll) + 1)
        every = [s for n in range(1, 6) for s in combinations(range(5), n)]
        found = {s: plain_mixture(ll, s) for s in every}
        best = max(every, key=lambda s: found[s][1] - len(s) * cost)
        assert set(np.flatnonzero(got[i] > 0).tolist()) == {k for k, x in found[best][0].items() if x > 0}
        assert np.allclose([got[i][k] for k in best], [found[best][0][k] for k in best], atol=1e-4)


def test_every_language_is_learned(spark):
    rng = random.Random(13)
    words = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for _ in range(300)]
    rows = [(i, " ".join(words[i % 300] * 2), f"x{i % 300:03}", None, None) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    names, table = langid.train(docs)
    assert len(names) == 300
    out = langid.identify(docs, names, table, carry=("lang",))
    assert out.where("lang = lang_pred").count() > 590


def test_language_edges(spark, trained):
    names, table = trained
    assert langid.identify(docs_of(spark, []), names, table).count() == 0
    names0, table0 = langid.train(docs_of(spark, ["the", None]))
    assert names0 == [] and langid.identify(docs_of(spark, ["the"]), names0, table0).first()["lang_pred"] == "und"
    one = langid.train(docs_of(spark, [EN], {0: "en"}))
    assert langid.identify(docs_of(spark, [EN, EN]), *one).select("lang_pred").distinct().collect()[0][0] == "en"


def test_language_held_out_accuracy(spark):
    from marlstone.llm.queries import op3_langid

    d = "/root/testdata/sf0.01"
    out = op3_langid(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert held > 0.97


# Toxicity


def labelled(spark, n=400, seed=3):
    rng = random.Random(seed)
    bad = ["grobnarsh", "grobnatic", "fluzzo", "fluzzine"]
    texts, toxic = [], []
    for i in range(n):
        words = [rng.choice(EN.split()) for _ in range(40)]
        toxic.append(int(i % 4 == 0))
        if toxic[-1]:
            for _ in range(3):
                words.insert(rng.randrange(40), rng.choice(bad))
        texts.append(" ".join(words) + ".")
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    return docs_of(spark, texts), labels


def test_toxicity_learns_word_beginnings(spark):
    docs, labels = labelled(spark)
    lexicon, curve = toxicity.train(docs, labels)
    new = docs_of(spark, ["the grobnaling of fluzzer, a grobna.", "the house of light", None, "", "x" * 200000])
    out = {r["doc_id"]: r["score"] for r in toxicity.score(new, lexicon, curve).collect()}
    assert out[0] > 0.8 and max(out[i] for i in range(1, 5)) < 0.3
    assert all(0 <= s <= 1 for s in out.values())


def test_grammar_negation_report_target():
    g = toxicity.Grammar({"idiot$": 2.0, "moron": 2.0})
    plain, target = g.features("what an idiot today")[1], g.features("you are an idiot today")[1]
    negated, reported = g.features("it was not an idiot")[1], g.features("someone said idiot")[1]
    assert target > plain > reported > negated > 0
    assert g.features("idiotic weather")[2] == 0 and g.features("moronic weather")[2] == 1
    assert g.features("idiot. moron! fine")[2] == 2
    assert g.features(None) == (0.0, 0.0, 0.0)


def plain_score(text, lexicon, curve):
    """The score by loops: clauses, then words with the distance to the last negation, report and target."""
    low = (text or "").lower()
    clauses, begin = [], 0
    for k, c in enumerate(low):
        if c in ".!?;:\n" and (k + 1 == len(low) or low[k + 1].isspace()):
            clauses.append(low[begin : k + 1])
            begin = k + 1
    values = []
    for clause in [*clauses, low[begin:]]:
        last, total = {}, 0.0
        for at, w in enumerate(re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", clause)):
            factor = 1.0
            for name, span, f in (("n", toxicity.NEGATION_SPAN, toxicity.NEGATION_FACTOR), ("r", toxicity.REPORT_SPAN, toxicity.REPORT_FACTOR), ("t", toxicity.TARGET_SPAN, toxicity.TARGET_FACTOR)):
                factor *= f if name in last and at - last[name] <= span else 1.0
            name = "n" if w in toxicity.NEGATIONS else "r" if w in toxicity.REPORTS else "t" if w in toxicity.TARGETS else None
            if name:
                last[name] = at
                continue
            found = [lexicon[w + "$"]] if w + "$" in lexicon else [lexicon[w[:n]] for n in range(len(w), 0, -1) if w[:n] in lexicon]
            if found:
                total += found[0] * factor
            elif w in toxicity.THREATS:
                total += toxicity.SEED_WEIGHT * factor * (1.0 if factor > 1 else 0.1)
        if total > 0:
            values.append(total)
    x = (math.log1p(sum(values)), max(values, default=0.0), len(values)) if values else (0.0, 0.0, 0)
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip((*x, 1.0), curve, strict=True)))), len(values)


def test_toxicity_score_equals_plain_loops(spark):
    """Whole texts, clauses of any length, against a scorer that shares nothing but the word lists."""
    rng = random.Random(15)
    lexicon, curve = {"idiot$": 2.0, "moron": 1.5, "tras": 0.7, "trash$": 3.0}, [1.1, 0.3, 0.2, -2.5]
    pool = [*EN.split(), "idiot", "idiots", "moronic", "trash", "trashy", "you", "not", "don't", "said", "kill", "nicht", "você", "sagte", "x9", "über"]
    texts = [None, "", "idiot", "idiot " + "word " * 5000 + "not an idiot " + "x" * 3000 + " idiot", "say. not; an idiot: or\ta moron?", "a.b idiot! not\nidiot... idiot"]
    for _ in range(150):
        ends = ["", "", "", ",", ".", "!", "?", ";", ":", "\n", "...", ".x"]
        texts.append(" ".join(rng.choice(pool) + rng.choice(ends) for _ in range(rng.randrange(1, 200))))
    got = {r["doc_id"]: (r["score"], r["n_clauses"]) for r in toxicity.score(docs_of(spark, texts), lexicon, curve).collect()}
    for i, t in enumerate(texts):
        want = plain_score(t, lexicon, curve)
        assert math.isclose(got[i][0], want[0], rel_tol=1e-9) and got[i][1] == want[1]


def test_a_long_clause_is_one_clause():
    g = toxicity.Grammar({"idiot$": 2.0})
    far = "idiot " + "word " * 100 + "not an idiot"
    assert g.features(far)[1:] == (2.0 + 2.0 * toxicity.NEGATION_FACTOR, 1.0)
    assert g.features("idiot " + "word " * 40 + "idiot " + "word " * 40 + "idiot")[1:] == (6.0, 1.0)


def test_product_machine_is_the_product_of_its_parts():
    """The composed machine against three counters run side by side."""
    following, factor = toxicity.product_machine()
    rng = random.Random(4)
    state, live = 0, [0, 0, 0]
    spans, factors = (toxicity.NEGATION_SPAN, toxicity.REPORT_SPAN, toxicity.TARGET_SPAN), (toxicity.NEGATION_FACTOR, toxicity.REPORT_FACTOR, toxicity.TARGET_FACTOR)
    which = {toxicity.NEGATION: 0, toxicity.REPORT: 1, toxicity.TARGET: 2}
    for _ in range(500):
        assert math.isclose(factor[state], math.prod(f for f, x in zip(factors, live, strict=True) if x))
        symbol = rng.randrange(6)
        live = [max(0, x - 1) for x in live]
        if symbol in which:
            live[which[symbol]] = spans[which[symbol]]
        state = following[state][symbol]


def test_toxicity_without_labels(spark):
    docs, _ = labelled(spark, 8)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    lexicon, curve = toxicity.train(docs, none)
    out = [r["score"] for r in toxicity.score(docs_of(spark, ["you worthless idiot, you pathetic scum", "hello there"]), lexicon, curve).orderBy("doc_id").collect()]
    assert out[0] > 0.3 > out[1]
    nulls = spark.createDataFrame([(None, None, 1), (1, 1, None), (2, 0, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, nulls)[1] == list(toxicity.DEFAULT_CURVE)
    assert toxicity.score(docs_of(spark, []), lexicon, curve).count() == 0


# Licences


def brute_licenses(text, templates, threshold=0.8, votes=0.1):
    """(licences, best score, matches) by loops over every template and every place that a bigram of it votes for."""
    words = [w for w in re.split("[^a-z0-9]+", (text or "").lower()) if w]
    grams = list(zip(words, words[1:], strict=False))

    def stretches(rows):
        out, end = [], -1
        for low, high, *rest in sorted(rows):
            if not out or low >= end:
                out.append([])
            out[-1].append(rest)
            end = max(end, high)
        return out

    found = []
    for t, (name, notice) in enumerate(templates):
        tw = [w for w in re.split("[^a-z0-9]+", notice.lower()) if w]
        tg = Counter(zip(tw, tw[1:], strict=False))
        place = {g: k for k, g in enumerate(zip(tw, tw[1:], strict=False)) if tg[g] == 1}
        windows = []
        for at, v in Counter(p - place[g] for p, g in enumerate(grams) if g in place).items():
            lo, hi = max(at, 0), min(at + len(tw) - 1, len(grams))
            inside = grams[lo:hi]
            shared = len(set(inside) & set(tg))
            score = 2 * shared / (len(tg) + shared + sum(g not in tg for g in inside))
            if v >= max(1, int(votes * len(tg))) and score >= threshold:
                cut = (hi - lo) // 4
                windows.append((lo + cut, hi - cut, lo, hi, shared, score))
        for part in stretches(set(windows)):
            lo, hi, shared, score = max(part, key=lambda w: (w[3], -w[0]))
            cut = min(3, (hi - lo) // 4)
            found.append((lo + cut, hi - cut, t, shared, score, name))
    matches = [[(shared, score, name) for _, shared, score, name in m] for m in stretches(found)]
    names = {n for m in matches for d, s, n in m if (d, s) == max(m)[:2]}
    return ",".join(sorted(names)), round(max([max(m)[1] for m in matches], default=0.0), 6), len(matches)


def test_license_scan_equals_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for i in range(60):
        parts = [sentence(EN, rng.randrange(1, 12), rng) + "." for _ in range(3)]
        for _ in range(1 + i % 2):
            _, notice = rng.choice(license_scan.TEMPLATES)
            words = notice.split()
            if i % 3:
                for _ in range(i % 5 * len(words) // 12):
                    words[rng.randrange(len(words))] = rng.choice(EN.split())
            parts.insert(rng.randrange(4), " ".join(words))
        texts.append(("\n" if i % 2 else " ").join(parts))
    texts += [None, "", "license", "a " * 30000, "license version license version " * 300]
    docs = docs_of(spark, texts).withColumn("id", F.lit(1)).withColumn("score", F.lit("x"))
    got = {r["doc_id"]: (r["licenses"], r["best_score"], r["n_matches"]) for r in license_scan.scan_licenses(docs).collect()}
    assert got == {i: brute_licenses(t, license_scan.TEMPLATES) for i, t in enumerate(texts)}
    assert sum(bool(x[0]) for x in got.values()) > 25


def wrapped(text, width, mark):
    lines, line = [], ""
    for w in text.split():
        if len(line) + len(w) > width:
            lines.append(line)
            line = ""
        line = f"{line} {w}".strip()
    return "\n".join(mark + x for x in [*lines, line])


@pytest.mark.parametrize("mark", ["", " * ", "// ", "# "])
def test_wrapped_notices_are_found(spark, mark):
    """Full notices over many lines and in comments, after other text and with other owners' names."""
    full = {}
    for name, notice in license_scan.TEMPLATES:
        full[name] = max(full.get(name, ""), notice, key=len)
    body = sentence(EN, 300, random.Random(6))
    names = ["MIT", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0", "Apache-2.0", "MPL-2.0", "ISC"]
    texts = [f"{body}\n{mark}Copyright (c) 2021 Acme Corp\n{mark}\n{wrapped(full[n].replace('the copyright holder', 'Acme Corp'), 72, mark)}\n\n{body}" for n in names]
    out = {r["doc_id"]: r for r in license_scan.scan_licenses(docs_of(spark, texts)).collect()}
    assert [out[i]["licenses"] for i in range(len(names))] == names
    assert all(r["n_matches"] == 1 and r["best_score"] > 0.9 for r in out.values())


def test_license_scan_repeated_rows_and_empty(spark):
    row = (None, "Released under the MIT License.", None, None, None)
    out = license_scan.scan_licenses(spark.createDataFrame([row, row], DOCS)).collect()
    assert [(r["doc_id"], r["licenses"], r["n_matches"]) for r in out] == [(None, "MIT", 2)]
    assert license_scan.scan_licenses(docs_of(spark, [])).count() == 0


# Mixing


def plain_targets(sizes, weights, share, most):
    """Water filling by rounds."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, free = share * sum(sizes.values()), dict.fromkeys(sizes, 0.0), set(sizes)
    while free:
        left = total - sum(most * sizes[s] for s in sizes if s not in free)
        level = left / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] >= most * sizes[s]}
        for s in free:
            target[s] = level * w[s]
        for s in full:
            target[s] = most * sizes[s]
        if not full:
            break
        free -= full
    return target


def test_mixing(spark):
    rng = random.Random(6)
    texts = [" ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(0, 60))) for _ in range(300)] + [None, ""]
    source = {i: rng.choice(["a", "b", "b", "b", "c", "d", None]) for i in range(302)}
    out = mixing.mix_sources(docs_of(spark, texts, source=source)).collect()
    sizes = {s: sum(r["size"] for r in out if r["source"] == s) for s in set(source.values())}
    want = plain_targets(sizes, mixing.WEIGHTS, mixing.SHARE, mixing.MAX_EPOCHS)
    for s in sizes:
        rows = [r for r in out if r["source"] == s]
        assert math.isclose(rows[0]["target"], want[s], rel_tol=1e-9)
        assert rows[0]["source_size"] == sizes[s]
        assert abs(sum(r["taken"] for r in rows) - want[s]) <= 1
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
        epochs = want[s] // sizes[s]
        assert all(r["taken"] >= epochs * r["size"] for r in rows)
    again = mixing.mix_sources(docs_of(spark, texts, source=source).repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert [r["size"] for r in out if r["doc_id"] in (300, 301)] == [0, 0]


def test_mixing_prefers_quality(spark):
    """A clean document's chance of the fractional part is larger than a junk one's."""
    n = 400
    texts = ["one two three four" if i % 2 else "o*e #wo th%ee f**r" for i in range(n)]
    out = mixing.mix_sources(docs_of(spark, texts, source=dict.fromkeys(range(n), "s")), share=0.5).collect()
    clean = sum(r["taken"] for r in out if r["doc_id"] % 2)
    assert clean > 2 * sum(r["taken"] for r in out if not r["doc_id"] % 2)


def test_mixing_edges(spark):
    assert mixing.mix_sources(docs_of(spark, [])).count() == 0
    row = (1, "a b c", None, "s", None)
    out = mixing.mix_sources(spark.createDataFrame([row, row, (None, "x", None, "s", None)], DOCS)).collect()
    assert sum(r["taken"] for r in out) == 10 and all(r["taken"] <= 2 * r["size"] for r in out)
    zero = mixing.mix_sources(docs_of(spark, ["", None], source={0: "s", 1: "t"})).collect()
    assert [(r["target"], r["taken"]) for r in zero] == [(0.0, 0), (0.0, 0)]


# Packing


def check_pieces(rows, texts, length):
    """An exact round trip: every id once, in order, sequences gapless and at most `length` long."""
    import zlib

    encoder = packing.Encoder(tokenizer_path())
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        assert encoder.ids(t) == ids
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            part = np.array(ids[at : at + r["length"]], dtype="<u4")
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding


def test_packing_round_trip(spark):
    rng = random.Random(7)
    texts = [". ".join(sentence(EN, rng.randrange(1, 30), rng) for _ in range(rng.randrange(1, 40))) for _ in range(80)]
    texts += [None, "", "a<|endoftext|>b", "x" * 5000, "word " * 20000, "é" * 3000 + "\ud83d\ude00".encode("utf-16", "surrogatepass").decode("utf-16")]
    docs = docs_of(spark, texts).withColumn("length", F.lit(3)).repartition(3)
    rows = packing.pack(docs, tokenizer_path(), 256).collect()
    total = sum(r["length"] for r in rows)
    assert check_pieces(rows, texts, 256) < 0.03 * total
    assert packing.pack(docs_of(spark, []), tokenizer_path()).count() == 0
    twice = packing.pack(spark.createDataFrame([(None, "a b", None, None, None)] * 2, DOCS), tokenizer_path()).collect()
    assert [(r["doc_id"], r["length"]) for r in twice] == [(None, 3)] * 2


def test_best_cuts_is_optimal():
    """The monotone queue against all cut sets' best, by plain dynamic programming over every pair."""
    rng = random.Random(8)
    for _ in range(120):
        n, length = rng.choice([rng.randrange(1, 60), rng.randrange(200, 400)]), rng.choice([8, 16, 64, 100])
        at = sorted({0, n, *rng.sample(range(n + 1), rng.randrange(0, n + 1)), *range(0, n, length)})
        cost = [0.0] + [rng.choice([0.0, 2.0, 5.0]) for _ in at[1:]]
        cuts = packing.best_cuts(np.array(at), np.array(cost), length)

        def price(a, b):
            size = b - a
            return math.inf if size > length else 0 if size & (size - 1) == 0 else length - size

        best = {0: 0.0}
        for j in range(1, len(at)):
            best[at[j]] = min(best[a] + price(a, at[j]) for a in at[:j]) + cost[j]
        got = sum(price(a, b) + cost[at.index(b)] for a, b in zip(cuts, cuts[1:], strict=False))
        assert cuts[0] == 0 and cuts[-1] == n and math.isclose(got, best[n])
