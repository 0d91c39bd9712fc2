"""Toxicity by a weighted finite-state grammar over clauses.

Words are mapped to symbols by five transducers: insult (a weighted lexicon of word beginnings, learned from labels), threat, target,
negation and reported speech (short word lists in English, German, French and Spanish). Each of the last four is a small weighted machine over symbols; their
product is one machine that reads a clause and weighs each insult or threat by the states at hand: a target nearby
raises it, negation or reported speech before it lowers it. Only clauses with a match are read, each whole, however long; a
document's clause scores become three features, and a logistic curve fitted to the labels turns them into a score.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Expected number of labelled training documents; a bounded sample, chosen by a hash of the id.
TRAIN_DOCS = 24000
#: Entries of the learned lexicon at most, and how long a word beginning can be.
LEXICON = 6000
SHORTEST, LONGEST = 3, 10
#: An entry stands in so many training documents of different text at least, and most documents that have it are toxic: the lower Wilson
#: bound of their share is at least LEAST_SHARE.
LEAST_DOCS = 5
LEAST_SHARE = 0.6
Z = 1.64
THRESHOLD = 0.3

# Words of each class, by language. Insults without labels weigh SEED_WEIGHT.
INSULTS = (
    "clown disgusting dumb fool idiot loser moron pathetic scum stupid trash vermin worthless "
    "abschaum blödmann dumm dummkopf ekelhaft idiotin trottel versager "
    "abruti connard crétin débile imbécile minable ordure "
    "basura cretino escoria estúpido idiota imbécil inútil patético"
).split()
THREATS = (
    "beat crush destroy hang hurt kill punch shoot smash stab strangle "
    "erschießen erstechen töten umbringen verprügeln vernichten zerstören "
    "détruire frapper pendre poignarder tuer étrangler "
    "apuñalar destruir golpear matar"
).split()
TARGETS = (
    "he her him his she them their they u ur you your yours "
    "dein deine dich dir du euch euer ihm ihn ihr "
    "elles ils leur lui te toi tu votre vous "
    "ellas ellos os ti usted ustedes vosotros"
).split()
NEGATIONS = (
    "ain't aren't cannot can't don't hardly isn't neither never no nobody nor not wasn't without "
    "kaum kein keine keinen nicht nie niemals niemand ohne "
    "aucun aucune jamais ne ni pas personne sans "
    "jamás nadie ningún ninguna nunca sin tampoco"
).split()
REPORTS = (
    "accused alleged called claimed claims quote quoted quotes reported reports said says told wrote "
    "behauptet berichtet nannte sagt sagte schrieb zitierte "
    "affirme cité dit déclaré selon écrit "
    "afirma citó declaró dijo escribió según"
).split()
SEED_WEIGHT = 3.0

# The machines: how many words a state lasts, and the factor while it does.
NEGATION_SPAN, NEGATION_FACTOR = 3, 0.3
REPORT_SPAN, REPORT_FACTOR = 8, 0.5
TARGET_SPAN, TARGET_FACTOR = 5, 1.5
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)


def product_machine():
    """(next state, factor) of the composed machine, both indexed [state][symbol].

    A component's state is how many words its effect still lasts; the composed state is the triple of them.
    """
    spans = (NEGATION_SPAN, REPORT_SPAN, TARGET_SPAN)
    factors = (NEGATION_FACTOR, REPORT_FACTOR, TARGET_FACTOR)
    starts = {NEGATION: 0, REPORT: 1, TARGET: 2}
    states = [(a, b, c) for a in range(spans[0] + 1) for b in range(spans[1] + 1) for c in range(spans[2] + 1)]
    number = {s: i for i, s in enumerate(states)}
    following, factor = [], []
    for s in states:
        row = []
        for symbol in range(6):
            after = [max(0, x - 1) for x in s]
            if symbol in starts:
                after[starts[symbol]] = spans[starts[symbol]]
            row.append(number[tuple(after)])
        following.append(row)
        f = 1.0
        for live, x in zip(s, factors, strict=True):
            f *= x if live else 1.0
        factor.append(f)
    return following, factor


class Grammar:
    """The composed grammar for one lexicon: dict of word beginning to weight; a trailing `$` means the whole word."""

    def __init__(self, lexicon: dict):
        import re

        import ahocorasick

        self.lexicon = lexicon
        self.kind = {w: k for k, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}
        self.following, self.factor = product_machine()
        self.machine = ahocorasick.Automaton()
        for entry in {e.rstrip("$") for e in lexicon} | set(THREATS):
            if entry:
                self.machine.add_word(entry, len(entry))
        self.machine.make_automaton()
        self.word = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
        self.edge = re.compile(r"[.!?;:\n](?:\s|$)")

    def weight(self, word: str) -> float:
        """The weight of the longest lexicon entry that the word begins with or is; 0 for none."""
        w = self.lexicon.get(word + "$")
        if w is not None:
            return w
        for n in range(min(len(word), LONGEST), SHORTEST - 1, -1):
            w = self.lexicon.get(word[:n])
            if w is not None:
                return w
        return 0.0

    def clause(self, text: str) -> float:
        state, total = 0, 0.0
        words = self.word.findall(text)
        for w in words:
            kind = self.kind.get(w, OTHER)
            weight = 0.0 if kind in (TARGET, NEGATION, REPORT) else self.weight(w)
            if weight > 0:
                total += weight * self.factor[state]
                kind = INSULT
            elif kind == THREAT:
                total += SEED_WEIGHT * self.factor[state] * (1.0 if self.factor[state] > 1 else 0.1)
            state = self.following[state][kind]
        return total

    def features(self, text: str | None) -> tuple[float, float, float]:
        """(log of 1 + summed clause scores, largest clause score, number of clauses with a score)."""
        if not text:
            return 0.0, 0.0, 0.0
        low = text.lower()
        starts = [start for start in (stop - n + 1 for stop, n in self.machine.iter(low)) if not start or not low[start - 1].isalpha()]
        if not starts:
            return 0.0, 0.0, 0.0
        bounds = [0, *(m.end() for m in self.edge.finditer(low)), len(low)]
        scores = []
        for k in sorted({bisect_right(bounds, start, 0, len(bounds) - 1) for start in starts}):
            value = self.clause(low[bounds[k - 1] : bounds[k]])
            if value > 0:
                scores.append(value)
        if not scores:
            return 0.0, 0.0, 0.0
        return math.log1p(sum(scores)), max(scores), float(len(scores))


def entries(text: str) -> set:
    """The lexicon entries that a text could support: word beginnings and whole words."""
    import re

    out = set()
    for w in set(re.findall(r"[^\W\d_]+", text.lower())):
        out.update(w[:n] for n in range(SHORTEST, min(len(w), LONGEST) + 1))
        out.add(w + "$")
    return out


def text_key(text: str) -> int:
    """A key that near-copies of a text share mostly: a hash of its two longer words of least hash."""
    import re
    from zlib import crc32

    hashes = sorted({crc32(w.encode("utf-8", "replace")) for w in re.findall(r"[^\W\d_]{7,}", text.lower())})[:2]
    return hash((tuple(hashes), 0 if hashes else crc32(text.encode("utf-8", "replace"))))


def one_of_each(labelled: DataFrame) -> DataFrame:
    """(text, y) with one row for each key of text, since a document that was copied often would make its words look telling."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keys = [text_key(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("y"), pa.array(keys, pa.int64())], names=["text", "y", "key"])

    keyed = labelled.select("text", "y").mapInArrow(run, "text string, y int, key long")
    return keyed.groupBy("y", "key").agg(F.min("text").alias("text")).select("text", "y")


def learn_lexicon(labelled: DataFrame, most: int = LEXICON, least: float = LEAST_SHARE) -> dict:
    """Entry -> weight from rows (text, y): the log odds of the Wilson bound of its toxic share, over those of all documents.

    At most `most` entries, the best first, ties by entry. Without labels of both kinds the seed list stands in.
    """

    def count(batches: Iterator) -> Iterator:
        from collections import Counter

        import pyarrow as pa

        def rows(yes, no):
            both = list(yes.keys() | no.keys())
            columns = [pa.array(both, pa.string()), pa.array([yes[x] for x in both], pa.int64()), pa.array([no[x] for x in both], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["entry", "yes", "no"])

        yes, no = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
                (yes if y else no).update(entries(text.as_py()))
                if len(yes) + len(no) > 300_000:
                    yield rows(yes, no)
                    yes, no = Counter(), Counter()
        yield rows(yes, no)

    n = labelled.groupBy("y").count().collect()
    totals = {r["y"]: r["count"] for r in n}
    if not totals.get(1) or not totals.get(0):
        return {w + "$": SEED_WEIGHT for w in INSULTS}
    sums = labelled.select("text", "y").mapInArrow(count, "entry string, yes long, no long").groupBy("entry").agg(F.sum("yes").alias("a"), F.sum("no").alias("b"))
    n, share = F.col("a") + F.col("b"), F.col("a") / (F.col("a") + F.col("b"))
    spread = Z * F.sqrt(share * (1 - share) / n + Z * Z / (4 * n * n))
    bound = (share + Z * Z / (2 * n) - spread) / (1 + Z * Z / n)
    w = F.log(bound / (1 - bound)) - math.log(totals[1] / totals[0])
    found = sums.where(F.col("a") >= LEAST_DOCS).withColumn("bound", bound).where((F.col("bound") >= least) & (F.col("bound") < 1)).withColumn("w", w).where("w > 0")
    top = found.orderBy(F.desc("w"), "entry").limit(most).collect()
    return {r["entry"]: float(r["w"]) for r in top} or {w + "$": SEED_WEIGHT for w in INSULTS}


def fit_logistic(rows: list, ridge: float = 1e-3):
    """Coefficients (intercept last) of a logistic curve, by damped Newton steps. rows: (features..., y)."""
    import numpy as np

    data = np.asarray(rows, dtype=np.float64)
    x = np.column_stack([data[:, :-1], np.ones(len(data))])
    y = data[:, -1]
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (y - p) - ridge * len(y) * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


DEFAULT_CURVE = (1.0, 0.2, 0.3, -3.0)


def train(docs: DataFrame, labels: DataFrame, most_docs: int = TRAIN_DOCS):
    """(lexicon, curve) from labels (doc_id, toxic) and texts; labels that are null or contradict each other are left out.

    About `most_docs` labelled documents are used (all, if there are fewer): their ids, and so the broadcast, are
    bounded by that number.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id")
    rows = rows.agg(F.min("toxic").alias("y"), F.max("toxic").alias("z")).where("y = z").select("doc_id", F.col("y").cast("int").alias("y"))
    total = rows.count()
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    ids = rows.where(draw < (most_docs / total if total else 1.0))
    sample = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "y")
    sample = checkpointed(one_of_each(sample))
    lexicon = learn_lexicon(sample)

    def features(batches: Iterator) -> Iterator:
        import pandas as pd

        grammar = Grammar(lexicon)
        for batch in batches:
            found = [grammar.features(t) for t in batch["text"]]
            yield pd.DataFrame(found, columns=["a", "b", "c"], dtype=float).assign(y=batch["y"].astype(float).to_numpy())

    rows = [tuple(r) for r in sample.mapInPandas(features, "a double, b double, c double, y double").collect()]
    if len({r[-1] for r in rows}) < 2:
        return lexicon, list(DEFAULT_CURVE)
    return lexicon, [float(x) for x in fit_logistic(sorted(rows))]


def score(docs: DataFrame, lexicon: dict, curve: list, carry: tuple = ("doc_id",)) -> DataFrame:
    """The columns of `carry` with score in 0..1 and n_clauses, the number of matched clauses.

    Every row is scored from its whole text alone, null and empty ones too (as texts without a match), so repeated rows
    agree. An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        grammar = Grammar(model.value)
        for batch in batches:
            scores, clauses = [], []
            for text in batch.column("_text"):
                f = grammar.features(text.as_py())
                z = sum(a * b for a, b in zip(f, curve, strict=False)) + curve[-1]
                scores.append(1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, z)))))
                clauses.append(int(f[2]))
            columns = [batch.column(c) for c in carry] + [pa.array(scores, pa.float64()), pa.array(clauses, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*carry, "score", "n_clauses"])

    kept = docs.select(*carry, F.col("text").cast("string").alias("_text"))
    fields = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes if c != "_text")
    return kept.mapInArrow(run, f"{fields}, score double, n_clauses long")
