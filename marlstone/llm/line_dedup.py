"""Line dedup by pairwise alignment.

Overlapping documents are found through the hashes of their lines and of their runs of lines: from each line on, and up to each
line, the shortest run that has enough words for a block. Such runs cover every block, whatever else its lines occur in. A rare
line or run (two or three documents have it) pairs each later document with every earlier one that has it; one that more
documents have pairs each later document with the earliest only, which has the whole run, so a line that a third of the corpus
shares costs one pair per document, and nothing shared goes unpaired. Pairs of rare ones come from partial aggregates alone:
with the count, least, greatest and sum of ids, the third id is known. Each pair is
aligned by patience diff on line hashes: lines that occur once in either document and in both, in longest increasing
order, anchor the alignment; gaps between anchors are aligned in the same way, and equal lines next to an anchor are added. Runs of
aligned lines that are long enough are common blocks; they are deleted from the later document.

Only line hashes travel, a few bytes for a line; texts meet the line numbers to delete once, at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed
from .textvec import U64, Runs, mix

#: A line in at most so many documents is rare; aggregates name the documents of two or three.
RARE = 3
#: A common block has at least so many words, so that chance matches of short lines stay.
LEAST_WORDS = 8


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience sorting."""
    from bisect import bisect_left

    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[k], piles[k] = v, i
        back[i] = piles[k - 1] if k else -1
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned index pairs of equal lines, increasing in both, by patience diff."""
    from collections import Counter

    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1) if cb[b[j]] == 1}
        unique = [(i, place[a[i]]) for i in range(a0, a1) if ca[a[i]] == 1 and a[i] in place]
        if unique:
            kept = [unique[k] for k in longest_increasing([j for _, j in unique])]
            out.extend(kept)
            cuts = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
            work.extend((p + 1, r, q + 1, s) for (p, q), (r, s) in zip(cuts, cuts[1:], strict=False))
            continue
        # No unique common line: match greedily in order, the first equal line each time.
        places: dict = {}
        for j in range(b0, b1):
            places.setdefault(b[j], []).append(j)
        low = b0
        from bisect import bisect_left

        for i in range(a0, a1):
            js = places.get(a[i], ())
            k = bisect_left(js, low)
            if k < len(js):
                out.append((i, js[k]))
                low = js[k] + 1
    return sorted(out)


def common_blocks(earlier: list, later: list, words: list[int], least_words: int = LEAST_WORDS) -> list[int]:
    """Lines of `later` in aligned runs of at least `least_words` words."""
    out: list[int] = []
    run: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(earlier, later), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[k] for k in run) >= least_words:
                out.extend(run)
            run = []
        run.append(j)
        last = (i, j)
    return out


def shortest_runs(h: np.ndarray, w: np.ndarray, first: np.ndarray, least_words: int):
    """(hash, owner) of runs of lines; document i has the lines first[i]..first[i+1], with hashes h and word counts w.

    The runs are those from each line on and up to each line that have at least so many words and no line to spare at the
    other end. A run of one line is left out: it has that line's own hash.
    """
    lines = np.arange(len(h))
    sizes = np.diff(first)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    total = np.concatenate([[0], np.cumsum(w)])
    end = np.searchsorted(total, total[lines] + least_words)
    start = np.searchsorted(total, total[lines + 1] - least_words, side="right") - 1
    on, up = end <= np.repeat(first[1:], sizes), start >= np.repeat(first[:-1], sizes)
    a, b = np.concatenate([lines[on], start[up]]), np.concatenate([end[on], lines[up] + 1])
    long = b - a > 1
    a, b = a[long], b[long]
    return mix(Runs(mix(h.view(U64))).hash(a, b)).view(np.int64), owner[a]


#: White space that is dropped from the ends of a line.
BLANKS = " \t\r\x0b\x0c"


def _key(doc_id, text):
    """What names a document: its id and the hash of its text, since rows may share an id but not a text."""
    return F.struct(doc_id.cast("long").alias("doc"), F.xxhash64(text).alias("hash"))


def lines_to_remove(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(key, gone): for documents that lose lines, the sorted numbers from 0 of the lines to delete. key: (doc, hash of the text).

    Lines are compared without white space at their ends; blank lines are neither compared nor counted.
    """
    d = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    each = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("n"), F.btrim(x, F.lit(BLANKS)).alias("s")))
    each = F.filter(each, lambda x: F.length(x["s"]) > 0)
    packed = F.transform(each, lambda x: F.struct(x["n"].alias("n"), F.xxhash64(x["s"]).alias("h"), F.size(F.split(x["s"], r"\s+")).alias("w")))
    docs_lines = d.select(_key(F.col("doc_id"), F.col("text")).alias("key"), packed.alias("lines")).where(F.size("lines") > 0)
    docs_lines = checkpointed(docs_lines.dropDuplicates(["key"]))

    def runs(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(1)
            first = lists.offsets.to_numpy().astype(np.int64)
            values = lists.flatten()
            h, w = (values.field(k).to_numpy(zero_copy_only=False) for k in ("h", "w"))
            found, owner = shortest_runs(h, w.astype(np.int64), first - first[0], least_words)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(found)], names=["key", "h"])

    key_type = "struct<doc:bigint,hash:bigint>"
    seen = docs_lines.select("key", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    seen = seen.unionByName(docs_lines.select("key", "lines").mapInArrow(runs, f"key {key_type}, h long").distinct())
    # With two or three holders, the least, the greatest and sums name them all.
    wide = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c.split(".")[1]) for c in ("key.doc", "key.hash")]
    stats = seen.groupBy("h").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("df"), *wide).where("df > 1")
    # Written out, so that the join below has plain exchanges on both sides and Spark can split a frequent line's rows.
    stats = checkpointed(stats)
    mid = F.struct(*[(F.col(c) - F.col(f"first.{c}") - F.col(f"last.{c}")).cast("long").alias(c) for c in ("doc", "hash")])
    two = F.array(F.struct(F.col("first").alias("a"), F.col("last").alias("b")))
    three = F.array(*[F.struct(x.alias("a"), y.alias("b")) for x, y in ((F.col("first"), mid), (F.col("first"), F.col("last")), (mid, F.col("last")))])
    rare = stats.where(F.col("df") <= RARE).select(F.explode(F.when(F.col("df") == 2, two).otherwise(three)).alias("p")).select("p.a", "p.b")
    often = seen.join(stats.where(F.col("df") > RARE).select("h", "first"), "h").select(F.col("first").alias("a"), F.col("key").alias("b"))
    # Documents of one id are not held against each other.
    pairs = rare.unionByName(often).where(F.col("a.doc") < F.col("b.doc")).distinct()
    left = docs_lines.select(F.col("key").alias("a"), F.transform("lines", lambda x: x["h"]).alias("ha"))
    right = docs_lines.select(F.col("key").alias("b"), F.col("lines").alias("lb"))
    joined = pairs.join(left, "a").join(right, "b").select("b", "ha", "lb.h", "lb.n", "lb.w")

    def align(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at, gone = [], []
            for k, (ha, h, n, w) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True)):
                found = common_blocks(ha, h, w, least_words)
                if found:
                    at.append(k)
                    gone.append([n[k] for k in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(gone, pa.list_(pa.int32()))], names=["key", "gone"])

    found = joined.mapInArrow(align, f"key {key_type}, gone array<int>")
    return found.select("key", F.explode("gone").alias("n")).groupBy("key").agg(F.array_sort(F.collect_set("n")).alias("gone"))


def remove_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """`docs` with text lacking the lines in common blocks, and n_lines and n_removed, both numbers of lines.

    The later document of a pair is the one with the larger doc_id. Rows with a null doc_id or text come back unchanged. Rows
    that share a doc_id are each judged and cut by their own text, and not held against each other. A text without lines to
    delete is returned as it is; one that loses every line that is not blank keeps its blank lines. An empty table gives no
    rows. Columns of `docs` that are named n_lines or n_removed are replaced.
    """
    gone = lines_to_remove(docs, least_words).select(F.col("key").alias("_key"), F.col("gone").alias("_gone"))
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(*own).withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*rows.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts, counts, removed = [], [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("_gone").to_pylist(), strict=True):
                lines = text.split("\n") if text is not None else []
                if gone:
                    dropped = set(gone)
                    text = "\n".join(x for i, x in enumerate(lines) if i not in dropped)
                texts.append(text)
                counts.append(len(lines))
                removed.append(len(gone or ()))
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in own]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=[*own, "n_lines", "n_removed"])

    joined = rows.join(gone, _key(F.col("doc_id"), F.col("text")) == F.col("_key"), "left").drop("_key")
    return joined.mapInArrow(cut, schema)
