"""Language identification by multilingual mixture inference.

Model: for each language a smoothed distribution over hashed byte trigrams of words, counted on labelled texts. A document is a
mixture: each word comes from language l with probability pi_l, and its likelihood is the product of its trigrams'.
Expectation-maximisation estimates pi over all words of the document. Which languages are in the mixture, and how many, is
chosen by penalised likelihood: for the k leading languages, log likelihood less k/2 * log(words) * penalty, for every k that
can still be better.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import GROUP_CHARS, Words, groups

BUCKETS = 1 << 16
#: Expected number of training documents for each language; a bounded sample, chosen by a hash of the id.
TRAIN_DOCS_PER_LANGUAGE = 2000
#: Texts are judged in smaller groups where there are more languages than this, since memory is words times languages.
FEW_LANGUAGES = 16
ITERATIONS = 12
PENALTY = 4.0
UNKNOWN = "und"


def word_grams(texts: list):
    """(bucket of each trigram, first trigram of each word, words). A word is padded with a space on both sides."""
    import numpy as np

    words = Words(texts, fold=True)
    size = words.end - words.begin
    first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    # Trigrams of a word end at begin + 1 .. end; the bytes around it count as spaces.
    at = np.arange(first[-1], dtype=np.int64) - np.repeat(first[:-1] - words.begin, size)
    buffer = np.append(words.buffer, np.uint8(32)).astype(np.uint32)
    left, mid, right = buffer[at - 1], buffer[at], buffer[at + 1]
    left[first[:-1]] = 32
    right[first[1:] - 1] = 32
    code = (left << np.uint32(16)) | (mid << np.uint32(8)) | right
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(16), first, words


def _segment_sum(values, first):
    import numpy as np

    total = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def mixtures(texts: list, table, penalty: float = PENALTY, iterations: int = ITERATIONS):
    """Proportions (texts x languages) of the selected language sets; a row of zeros for a text without words.

    table: log probabilities, buckets x languages.
    """
    import numpy as np

    langs = table.shape[1]
    grams, first, words = word_grams(texts)
    n = np.diff(words.first)
    out = np.zeros((len(texts), langs))
    if not len(words.hash):
        return out
    ll = np.add.reduceat(table[grams], first[:-1], axis=0).astype(np.float64)
    single = _segment_sum(ll, words.first)
    # A word is never less likely than this share of its best language's likelihood; keeps long words from underflow.
    top = ll.max(axis=1)
    like = np.exp(np.maximum(ll - top[:, None], -30.0))
    base = np.add.reduceat(np.append(top, 0.0), np.minimum(words.first[:-1], len(top))) * (n > 0)

    def em(rows, allowed):
        """pi and log likelihood for the documents `rows`, languages masked by `allowed`."""
        count = n[rows]
        index = np.concatenate([np.arange(words.first[r], words.first[r + 1]) for r in rows])
        bounds = np.concatenate([[0], np.cumsum(count)])
        own = np.repeat(np.arange(len(rows)), count)
        part = like[index]
        pi = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(iterations):
            joint = part * pi[own]
            joint /= joint.sum(axis=1, keepdims=True)
            pi = _segment_sum(joint, bounds) / count[:, None]
        mixed = np.log(np.maximum((part * pi[own]).sum(axis=1), 1e-300))
        return pi, _segment_sum(mixed[:, None], bounds)[:, 0] + base[rows]

    has = np.flatnonzero(n > 0)
    best = single[has].argmax(axis=1)
    out[has, best] = 1.0
    if langs == 1:
        return out
    cost = penalty * 0.5 * np.log(n[has] + 1.0)
    score = single[has, best] - cost
    pi, full = em(has, np.ones((len(has), langs)))
    order = np.argsort(-pi, axis=1, kind="stable")
    # A larger set cannot reach more than the likelihood of all languages together.
    open_ = full - 2 * cost > score
    for k in range(2, langs + 1):
        rows = np.flatnonzero(open_)
        if not len(rows):
            break
        allowed = np.zeros((len(rows), langs))
        np.put_along_axis(allowed, order[rows, :k], 1.0, axis=1)
        pi, value = em(has[rows], allowed)
        value = value - k * cost[rows]
        better = value > score[rows]
        out[has[rows[better]]] = pi[better]
        score[rows[better]] = value[better]
        open_ &= full - (k + 1) * cost > score
    return out


def train(docs: DataFrame, per_language: int = TRAIN_DOCS_PER_LANGUAGE, buckets: int = BUCKETS):
    """(language names, log probability table) from the non-null `text` and `lang` of `docs`.

    Every language of the labels is learned. Per language about `per_language` documents are read (all, if there are fewer),
    chosen by a hash of doc_id; whole texts are counted. Counts are summed in executors; what reaches the driver, and each
    executor later, is one table of 256 KB for each language.
    """
    import numpy as np

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = sorted(rows.groupBy("lang").count().collect(), key=lambda r: r["lang"])
    if not found:
        return [], np.zeros((buckets, 0), dtype=np.float32)
    names = [r["lang"] for r in found]
    pairs = [x for r in found for x in (F.lit(r["lang"]), F.lit(per_language / r["count"]))]
    share = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("lang")), F.lit(0.0))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < share).select("lang", "text")
    number = {name: i for i, name in enumerate(names)}

    def count(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            texts, langs = batch["text"].tolist(), batch["lang"].tolist()
            for a, b in groups(texts):
                grams, first, words = word_grams(texts[a:b])
                owner = np.repeat(words.owner(), np.diff(first))
                code, n = np.unique(np.array([number[x] for x in langs[a:b]])[owner].astype(np.int64) * buckets + grams, return_counts=True)
                at = np.searchsorted(code // buckets, np.arange(len(names) + 1))
                used = np.flatnonzero(np.diff(at))
                pairs = np.stack([code % buckets, n], axis=1).astype("<i8")
                yield pd.DataFrame({"lang": used.astype(np.int32), "counts": [pairs[at[k] : at[k + 1]].tobytes() for k in used]})

    def total(part):
        import pandas as pd

        sums = np.zeros(buckets, dtype="<i8")
        for x in part["counts"]:
            pairs = np.frombuffer(x, dtype="<i8").reshape(-1, 2)
            sums[pairs[:, 0]] += pairs[:, 1]
        return pd.DataFrame({"lang": part["lang"].iloc[:1], "counts": [sums.tobytes()]})

    schema = "lang int, counts binary"
    tables = sample.mapInPandas(count, schema).groupBy("lang").applyInPandas(total, schema).collect()
    sums = np.zeros((buckets, len(names)), dtype=np.float32)
    for r in tables:
        sums[:, r["lang"]] = np.frombuffer(r["counts"], dtype="<i8")
    table = np.log((sums + 0.5) / (sums.sum(axis=0, dtype=np.float64) + 0.5 * buckets))
    return names, table.astype(np.float32)


def identify(docs: DataFrame, names: list, table, carry: tuple = ("doc_id",), group_chars: int = GROUP_CHARS // 2) -> DataFrame:
    """The columns of `carry` with lang_pred, score and proportions (map of language to share, JSON text).

    lang_pred is the language with the largest share of the document's words, ties to the first by name; score is that share. A text
    that is null or has no letter is `und` with score 0, as is every text if nothing was learned. Every row is judged
    by itself, so repeated rows agree. Whole texts are read. An empty table gives no rows. Memory is that of the longest
    text's words times the number of languages.
    """
    spark = docs.sparkSession
    group_chars = max(1, group_chars * FEW_LANGUAGES // max(FEW_LANGUAGES, len(names)))
    model = spark.sparkContext.broadcast(table)

    def run(batches: Iterator) -> Iterator:
        import json
        import re

        import numpy as np
        import pyarrow as pa

        letter = re.compile(r"[^\W\d_]")
        table = model.value
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            lang, score, mix = [], [], []
            for a, b in groups(texts, group_chars):
                shares = mixtures(texts[a:b], table) if names else np.zeros((b - a, 1))
                top = shares.argmax(axis=1)
                for k, text in enumerate(texts[a:b]):
                    share = float(shares[k, top[k]])
                    if not names or share <= 0 or not text or not letter.search(text):
                        lang.append(UNKNOWN), score.append(0.0), mix.append("{}")
                        continue
                    lang.append(names[top[k]]), score.append(min(1.0, share))
                    mix.append(json.dumps({names[j]: round(float(shares[k, j]), 4) for j in np.flatnonzero(shares[k] > 0)}))
            columns = [batch.column(c) for c in carry] + [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(mix, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*carry, "lang_pred", "score", "proportions"])

    kept = docs.select(*carry, F.col("text").cast("string").alias("_text"))
    fields = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes if c != "_text")
    return kept.mapInArrow(run, f"{fields}, lang_pred string, score double, proportions string")


def held_out(doc_id, folds: int = 3, fold: int = 1):
    """Whether crc32 of the id as text leaves `fold`; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))
