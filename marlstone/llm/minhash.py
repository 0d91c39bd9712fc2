"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

Shingles are runs of five folded words. A shingle weighs (1 + ln tf) times the mean idf of its words; word document
frequencies cover the whole corpus in a hashed table of fixed size. Each of 48 samples draws, for a shingle, r and c from
Gamma(2, 1) and b uniform by the shingle's hash, takes t = floor(ln w / r + b) and a = c / exp(r (t - b + 1)), and keeps
the shingle and t of least a: two documents agree in a sample with the probability of their weighted Jaccard
similarity. Bands of three samples propose candidates (a pair of similarity 0.8 is missed with probability 1e-5).

Copies collapse first: texts of equal folded words are one class with one representative. Within a band's bucket no
pairs are enumerated: each member meets the bucket's smallest member and the one before it, which is linear in the
bucket. Proposals whose samples agree too little are dropped, the rest are verified on whole texts by exact weighted
Jaccard. Links make components; buckets that still hold several components propose again, between components, until
no new link is found. Then every pair of a bucket that lies in two components is compared: a bucket is cut into slices, and
each two slices meet in one block, where sketches are compared in memory. The texts of members of likely pairs come to their blocks
and are verified there; only spanning edges leave a task, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import block_count, checkpointed
from .graph import components, label
from .textvec import U64, Runs, Words, groups, mix

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 3
SAMPLES = BANDS * ROWS
#: A proposal is verified if at least so many samples agree; a pair of similarity 0.8 has fewer with probability 1e-5.
LEAST_AGREE = 26
DF_BUCKETS = 1 << 18
_DF_PARTS = 64
_TABLE = 1 << 14
#: Characters of text that are sketched at a time.
SKETCH_CHARS = 1 << 19
#: Partners of one document that are verified in one group.
PARTNERS = 512
#: Members of one bucket that make up one slice of the comparison of all pairs.
SLICE = 512
#: Members of blocks that are verified in one task, about.
BATCH = 4096
#: If no more texts than this are needed, their ids are broadcast (a few MB) and only those texts are shuffled.
BROADCAST_ROWS = 200_000


def _draws():
    rng = np.random.default_rng(20240607)
    r = rng.gamma(2.0, 1.0, _TABLE).astype(np.float32)
    return r, (1.0 / r).astype(np.float32), rng.random(_TABLE).astype(np.float32), np.log(rng.gamma(2.0, 1.0, _TABLE)).astype(np.float32)


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """How many documents have a word of each hash bucket, over all documents; the last entry is their number.

    A table of fixed size: each task sends its counts in packed parts, which are added in executors.
    """

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums = np.zeros(DF_BUCKETS, dtype=np.int64)
        total = 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            total += len(texts)
            for a, b in groups(texts):
                words = Words(texts[a:b], fold=True)
                key = words.owner() * DF_BUCKETS + (words.hash % U64(DF_BUCKETS)).astype(np.int64)
                sums += np.bincount(np.unique(key) % DF_BUCKETS, minlength=DF_BUCKETS)
        parts = [*(x.astype("<i8").tobytes() for x in np.split(sums, _DF_PARTS)), np.array([total], dtype="<i8").tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array(range(_DF_PARTS + 1), pa.int32()), pa.array(parts, pa.binary())], names=["part", "counts"])

    def total(frame):
        import pandas as pd

        sums = sum(np.frombuffer(x, dtype="<i8") for x in frame["counts"])
        return pd.DataFrame({"part": frame["part"].iloc[:1], "counts": pd.Series([sums.tobytes()], dtype=object)})

    rows = docs.select("text").mapInArrow(count, "part int, counts binary").groupBy("part").applyInPandas(total, "part int, counts binary").collect()
    out = np.zeros(DF_BUCKETS + 1, dtype=np.int64)
    width = DF_BUCKETS // _DF_PARTS
    for r in rows:
        found = np.frombuffer(r["counts"], dtype="<i8")
        out[r["part"] * width : r["part"] * width + len(found)] = found
    return out


def idf_table(frequencies: np.ndarray) -> np.ndarray:
    return (1.0 + np.log((frequencies[-1] + 1.0) / (frequencies[:-1] + 1.0))).astype(np.float32)


def weighted_shingles(texts: list, idf: np.ndarray, k: int = SHINGLE):
    """(hash, weight, first, fingerprint) of distinct shingles, those of text i at first[i]..first[i+1] in order of hash.

    A text of one to four words has one shingle, all its words; fingerprint: two uint64 per text of its folded words.
    """
    words = Words(texts, fold=True)
    n, docs = len(words.hash), len(texts)
    counts = np.diff(words.first)
    runs = Runs(words.hash)
    whole = runs.hash(words.first[:-1], words.first[1:])
    second = Runs(mix(words.hash + U64(1))).hash(words.first[:-1], words.first[1:])
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.float32), np.zeros(docs + 1, np.int64), whole, second
    length = np.repeat(np.minimum(counts, k), counts)
    start = np.flatnonzero(words.left() >= length)
    owner = words.owner()[start]
    size = length[start]
    h = runs.hash(start, start + size)
    sums = np.concatenate([[0.0], np.cumsum(idf[(words.hash % U64(len(idf))).astype(np.int64)], dtype=np.float64)])
    mean = (sums[start + size] - sums[start]) / size
    order = np.lexsort((h, owner))
    h, owner, mean = h[order], owner[order], mean[order]
    new = np.flatnonzero((np.diff(h, prepend=~h[:1]) != 0) | (np.diff(owner, prepend=-1) != 0))
    tf = np.diff(np.append(new, len(h)))
    # The float sum depends on where a run stands; rounding makes equal shingles weigh the same everywhere.
    weight = np.round((1.0 + np.log(tf)) * mean[new], 3).astype(np.float32)
    return h[new], weight, np.searchsorted(owner[new], np.arange(docs + 1)), whole, second


def sketch(h: np.ndarray, weight: np.ndarray, first: np.ndarray, draws, samples: int = SAMPLES) -> np.ndarray:
    """Consistent weighted samples, texts x samples, as uint64; zeros for texts without shingles."""
    r, r_inverse, b, log_c = draws
    counts = np.diff(first)
    has = np.flatnonzero(counts)
    out = np.zeros((len(counts), samples), dtype=U64)
    if not len(has):
        return out
    at, reps = first[:-1][has], counts[has]
    log_w = np.log(weight)
    own = np.repeat(np.arange(len(has)), reps)
    odd = mix(np.arange(1, samples + 1, dtype=U64)) | U64(1)
    for s in range(samples):
        i = ((h * odd[s]) >> U64(50)).astype(np.int64)
        ri, bi = r[i], b[i]
        t = np.floor(log_w * r_inverse[i] + bi)
        a = log_c[i] - ri * (t - bi + np.float32(1.0))
        least = np.minimum.reduceat(a, at)
        hit = np.flatnonzero(a == least[own])
        # Shingles can tie by sharing a table entry; the smallest hash wins. Hashes ascend within a text.
        keep = hit[np.flatnonzero(np.diff(own[hit], prepend=-1))]
        out[has, s] = mix(h[keep] + odd[s] * (t[keep].astype(np.int64).astype(U64) + U64(1)))
    return out


def _sketches(docs: DataFrame, idf) -> DataFrame:
    """(doc_id, f1, f2, samples, bands) for texts with words."""
    draws = _draws()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = idf.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in groups(texts, SKETCH_CHARS):
                h, weight, first, whole, second = weighted_shingles(texts[a:b], table)
                out = sketch(h, weight, first, draws)
                has = np.flatnonzero(np.diff(first))
                out = out[has]
                bands = mix(out.reshape(len(has), BANDS, ROWS) * U64(3) + np.arange(ROWS, dtype=U64)).sum(axis=2, dtype=U64)
                bands = mix(bands + mix(np.arange(BANDS, dtype=U64)))
                small = (out >> U64(32)).astype(np.uint32).view(np.int32)
                offsets = np.arange(0, (len(has) + 1) * SAMPLES, SAMPLES, dtype=np.int32)
                columns = [
                    ids.slice(a, b - a).take(pa.array(has)),
                    pa.array(whole[has].view(np.int64)),
                    pa.array(second[has].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(small.ravel())),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, (len(has) + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(bands.view(np.int64).ravel())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "f1", "f2", "samples", "bands"])

    return docs.mapInArrow(run, "doc_id long, f1 long, f2 long, samples array<int>, bands array<long>")


def _verify(pairs: DataFrame, docs: DataFrame, idf, blocks: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts have at least the given weighted Jaccard similarity.

    Pairs are dealt into blocks by their smaller document, one with many partners in several; a text goes once to each
    block that needs it.
    """
    # Aggregates are written out, so that joins with them have plain exchanges and Spark can split a hot key's rows.
    many = checkpointed(pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("salts")).where("salts > 1"))
    salt = F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1)))
    dealt = pairs.join(many, "a", "left").withColumn("block", F.pmod(F.xxhash64("a", salt), F.lit(blocks)).cast("int"))
    dealt = checkpointed(dealt.select("block", "a", "b"))
    needed = dealt.select(F.col("block").alias("at"), F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    needed = checkpointed(needed)
    few = needed.count() <= BROADCAST_ROWS
    texts = docs.join(F.broadcast(needed) if few else needed, "doc_id").select("at", "doc_id", "text")

    def run(texts, pairs):
        import pandas as pd

        ids, raw = texts["doc_id"].to_numpy(), texts["text"].tolist()
        parts = [weighted_shingles(raw[x:y], idf.value)[:3] for x, y in groups(raw, SKETCH_CHARS)]
        if not parts or not len(pairs):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        sizes = np.concatenate([np.diff(p[2]) for p in parts])
        names, first_row = np.unique(ids, return_index=True)
        a, b = (np.searchsorted(names, pairs[c].to_numpy()) for c in ("a", "b"))
        here = (a < len(names)) & (b < len(names))
        here &= (names[a * here] == pairs["a"].to_numpy()) & (names[b * here] == pairs["b"].to_numpy())
        linked = similar(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), sizes, first_row[a[here]], first_row[b[here]], similarity)
        return pairs[["a", "b"]][here][linked]

    return texts.groupBy("at").cogroup(dealt.groupBy("block")).applyInPandas(run, "a long, b long")


def similar(h: np.ndarray, weight: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether texts a[k] and b[k] have at least that weighted Jaccard similarity; text i has the next sizes[i] shingles of h.

    Shingles are numbered; a text's weights are laid out by number once, and looked up for all of its partners together.
    """
    out = np.zeros(len(a), dtype=bool)
    if not len(h):
        return out
    found, number = np.unique(h, return_inverse=True)
    at = np.concatenate([[0], np.cumsum(sizes)])
    # Sums over the same numbers in the same order wherever a text stands.
    total = np.array([weight[p:q].sum(dtype=np.float64) for p, q in zip(at, at[1:], strict=False)])
    order = np.argsort(a, kind="stable")
    starts = np.flatnonzero(np.diff(a[order], prepend=-1))
    laid = np.zeros(len(found))
    for s, e in zip(starts, np.append(starts[1:], len(order)), strict=True):
        k = order[s:e]
        i = a[k[0]]
        own = slice(at[i], at[i + 1])
        laid[number[own]] = weight[own]
        j = b[k]
        used = sizes[j] > 0
        both = np.zeros(len(k))
        if used.any():
            spans = [slice(at[x], at[x + 1]) for x in j[used]]
            least = np.minimum(laid[np.concatenate([number[x] for x in spans])], np.concatenate([weight[x] for x in spans]))
            both[used] = np.add.reduceat(least, np.concatenate([[0], np.cumsum(sizes[j[used]])[:-1]]))
        laid[number[own]] = 0.0
        out[k] = both >= similarity * (total[i] + total[j] - both) - 1e-9
    return out


def _proposals(members: DataFrame) -> DataFrame:
    """(a, b), a < b, from (key, rep): the bucket's smallest with each, and each with the one before it.

    Large buckets are put in order in slices, so that no task holds a whole one.
    """
    stats = checkpointed(members.groupBy("key").agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1"))
    rows = members.join(stats, "key").withColumn("slice", F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / 1024)))
    before = F.lag("rep").over(Window.partitionBy("key", "slice").orderBy("rep"))
    rows = rows.select("rep", "least", before.alias("before"))
    pairs = rows.select(F.explode(F.array_distinct(F.array("least", "before"))).alias("a"), F.col("rep").alias("b"))
    return pairs.where("a is not null and a < b").distinct()


def _likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    left = reps.select(F.col("rep").alias("a"), F.col("samples").alias("sa"))
    right = reps.select(F.col("rep").alias("b"), F.col("samples").alias("sb"))
    agree = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda e: e))
    return pairs.join(left, "a").join(right, "b").where(agree >= LEAST_AGREE).select("a", "b")


def _blocks(named: DataFrame) -> DataFrame:
    """(key, i, j, at, rep, component) from (key, rep, component): the members of each two slices of a bucket.

    A component that has many members in a bucket has slices of its own, the others share slices. Two slices of one
    component do not meet, so a large class costs one row for each member and slice of others.
    """
    each = named.groupBy("key", "component").agg(F.count("*").alias("m"))
    large = F.col("m") > SLICE // 2
    stats = each.groupBy("key").agg(
        F.count("*").alias("n"),
        F.collect_list(F.when(large, F.struct("component", F.ceil(F.col("m") / SLICE).cast("int").alias("k")))).alias("large"),
        F.ceil(F.coalesce(F.sum(F.when(~large, F.col("m"))), F.lit(0)) / SLICE).cast("int").alias("shared"),
    )
    stats = checkpointed(stats.where("n > 1").drop("n"))
    cut = lambda k, owner: F.transform(F.sequence(F.lit(1), k), lambda x: F.struct(owner.alias("owner"), x.alias("salt")))
    none = F.lit(None).cast("long")
    shared = F.when(F.col("shared") > 0, cut(F.col("shared"), none)).otherwise(F.array().cast("array<struct<owner:bigint,salt:int>>"))
    slices = F.concat(shared, F.flatten(F.transform("large", lambda x: cut(x["k"], x["component"]))))
    rows = named.join(stats.withColumn("slices", slices), "key")
    own = F.get(F.filter("large", lambda x: x["component"] == F.col("component")), F.lit(0))
    rows = rows.withColumn("owner", own["component"]).withColumn("salt", F.pmod(F.xxhash64("rep"), F.coalesce(own["k"], F.col("shared"))).cast("int") + 1)
    numbered = F.transform("slices", lambda x, i: F.struct(i.alias("i"), x["owner"].alias("owner"), x["salt"].alias("salt")))
    rows = rows.withColumn("slices", numbered)
    at = F.get(F.filter("slices", lambda x: x["owner"].eqNullSafe(F.col("owner")) & (x["salt"] == F.col("salt"))), F.lit(0))["i"]
    others = F.filter("slices", lambda x: x["owner"].isNull() | F.col("owner").isNull() | (x["owner"] != F.col("owner")))
    rows = rows.select("key", "rep", "component", at.alias("at"), F.explode(others["i"]).alias("to"))
    return rows.select("key", F.least("at", "to").alias("i"), F.greatest("at", "to").alias("j"), "at", "rep", "component")


def _likely_in(component, side, samples, bands, i: int, j: int, key: int):
    """(u, v): members of one block that are a likely pair of two components; a pair that shares several buckets counts in that of the first band."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    p, q = (np.arange(len(side)),) * 2 if i == j else (np.flatnonzero(side == x) for x in (i, j))
    for x in range(0, len(p), 256):
        part = p[x : x + 256]
        u, v = np.nonzero(component[part][:, None] != component[q][None, :])
        u, v = part[u], q[v]
        if i == j:
            u, v = u[u < v], v[u < v]
        for y in range(0, len(u), 1 << 15):
            a, b = u[y : y + (1 << 15)], v[y : y + (1 << 15)]
            likely = (samples[a] == samples[b]).sum(axis=1) >= LEAST_AGREE
            a, b = a[likely], b[likely]
            first = bands[a, (bands[a] == bands[b]).argmax(axis=1)] == key
            left.append(a[first])
            right.append(b[first])
    return np.concatenate(left), np.concatenate(right)


_MEMBER = ("rep", "component", "at", "samples", "bands")


def _across(named: DataFrame, reps: DataFrame, docs: DataFrame, idf, blocks: int, similarity: float) -> DataFrame:
    """(a, b): edges that connect what the verified pairs of a bucket's components connect; every likely pair is verified.

    Pairs do not leave a task. First the members are named that are in a likely pair at all; then their texts come to the
    blocks, many small blocks to one task, and what is linked there leaves as spanning edges, fewer than members.
    """
    grouped = _blocks(named).join(reps, "rep").groupBy("key", "i", "j").agg(F.collect_list(F.struct(*_MEMBER)).alias("m"))

    def partners(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(3)
            keys, i, j = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            at, flat = lists.offsets.to_numpy(), lists.values
            component, side = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("component", "at"))
            samples = flat.field("samples").flatten().to_numpy(zero_copy_only=False).reshape(-1, SAMPLES)
            bands = flat.field("bands").flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
            rows, block = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k in range(len(keys)):
                s = slice(at[k], at[k + 1])
                u, v = _likely_in(component[s], side[s], samples[s], bands[s], i[k], j[k], keys[k])
                used = np.unique(np.concatenate([u, v]))
                rows.append(at[k] + used)
                block.append(np.full(len(used), k))
            take, block = pa.array(np.concatenate(rows)), np.concatenate(block)
            columns = [pa.array(x[block]) for x in (keys, i, j)] + [flat.field(c).take(take) for c in _MEMBER]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "i", "j", *_MEMBER])

    schema = "key long, i int, j int, rep long, component long, at int, samples array<int>, bands array<long>"
    members = checkpointed(grouped.mapInArrow(partners, schema))
    total = members.count()
    if not total:
        return members.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    needed = checkpointed(members.select(F.col("rep").alias("doc_id")).distinct())
    texts = docs.join(F.broadcast(needed) if total <= BROADCAST_ROWS else needed, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    batch = F.pmod(F.xxhash64("key", "i", "j"), F.lit(max(blocks, -(-total // BATCH)))).cast("int")
    rows = members.withColumn("batch", batch).join(texts, F.col("rep") == F.col("doc_id")).drop("doc_id")

    def run(frame):
        import pandas as pd

        names, first, number = np.unique(frame["rep"].to_numpy(), return_index=True, return_inverse=True)
        raw = frame["text"].iloc[first].tolist()
        parts = [weighted_shingles(raw[x:y], idf.value)[:3] for x, y in groups(raw, SKETCH_CHARS)]
        key, i, j, component, side = (frame[c].to_numpy() for c in ("key", "i", "j", "component", "at"))
        samples, bands = np.stack(frame["samples"].to_numpy()), np.stack(frame["bands"].to_numpy())
        order = np.lexsort((j, i, key))
        new = np.flatnonzero((np.diff(key[order], prepend=~key[order[:1]]) != 0) | (np.diff(i[order], prepend=-1) != 0) | (np.diff(j[order], prepend=-1) != 0))
        left, right = [], []
        for s, e in zip(new, np.append(new[1:], len(order)), strict=True):
            own = order[s:e]
            k = own[0]
            u, v = _likely_in(component[own], side[own], samples[own], bands[own], i[k], j[k], key[k])
            left.append(number[own[u]])
            right.append(number[own[v]])
        a, b = np.concatenate(left), np.concatenate(right)
        linked = similar(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([np.diff(p[2]) for p in parts]), a, b, similarity)
        to = label(a[linked], b[linked], len(names))
        used = np.flatnonzero(to != np.arange(len(names)))
        return pd.DataFrame({"a": names[to[used]], "b": names[used]})

    return rows.groupBy("batch").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per distinct non-null doc_id: doc_id, class_id, kept.

    class_id is the smallest doc_id of the document's class: what verified links and equal folded words connect. kept
    marks it. Texts that are null or have no word are classes of their own; a text of one to four words is compared as a
    single shingle. Rows that share a doc_id should be equal; if they are not, any one of them stands for it. Whole texts
    are read. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    blocks = block_count(docs)
    base = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    idf = spark.sparkContext.broadcast(idf_table(document_frequencies(base)))
    sketches = checkpointed(_sketches(base, idf))
    member = sketches.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"))
    reps = sketches.groupBy("f1", "f2").agg(F.min_by(F.struct("doc_id", "samples", "bands"), "doc_id").alias("r")).select(F.col("r.doc_id").alias("rep"), "r.samples", "r.bands")
    reps = checkpointed(reps)
    buckets = reps.select("rep", F.explode("bands").alias("key"))
    tested = checkpointed(_likely(_proposals(buckets), reps))
    edges = checkpointed(_verify(tested, base, idf, blocks, similarity))
    while True:
        labels = components(edges)
        named = buckets.join(labels, buckets["rep"] == labels["id"], "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
        heads = named.groupBy("key", "component").agg(F.min("rep").alias("rep")).select("key", "rep")
        fresh = checkpointed(_likely(_proposals(heads).join(tested, ["a", "b"], "left_anti"), reps))
        if fresh.isEmpty():
            break
        found = checkpointed(_verify(fresh, base, idf, blocks, similarity))
        tested = tested.unionByName(fresh)
        if found.isEmpty():
            break
        edges = edges.unionByName(found)
    rest = checkpointed(_across(named, reps, base, idf, blocks, similarity))
    if not rest.isEmpty():
        edges = edges.unionByName(rest)
        labels = components(edges)
    classes = member.join(labels, member["rep"] == labels["id"], "left").select("f1", "f2", F.coalesce("component", "rep").alias("class_id"))
    known = sketches.select("doc_id", "f1", "f2").join(classes, ["f1", "f2"]).select("doc_id", "class_id")
    every = base.select("doc_id", F.lit(None).cast("long").alias("class_id")).unionByName(known)
    out = every.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    out = out.withColumn("class_id", F.coalesce("class_id", "doc_id"))
    return out.withColumn("kept", F.col("class_id") == F.col("doc_id"))
