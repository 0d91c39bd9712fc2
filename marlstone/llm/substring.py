"""Substring dedup: seed and extend over winnowed anchors.

Contract of the digest: a window is 13 consecutive words of one document; a word goes if a window that covers it has the same words as
a window that starts in a document with a smaller id.

Anchors. Within a window of 13 words the four-word run of least hash is its anchor (the first, if equal): a function
of the window's words alone, so equal windows have equal anchors at equal places. Consecutive windows share an anchor; the words
of all windows that an anchor serves form its span. Seeds are spans' anchors, about two for every eleven words.

Seed. Spans meet by anchor. An anchor that only one document has serves no repeated window. Where a span as a whole
also occurs in a smaller document, all its windows do: a match inside a longer repeat is extended anchor by anchor this
way, without looking at single windows.

Extend. The other spans with a shared anchor are edges of repeats, or first occurrences. Their windows meet by hash, which
extends the match to the left and right word by word and keeps exactly the windows that repeat; adjoining ones merge
into maximal repeats when the words are cut.

Exchange. Documents are dealt into blocks by id. A block sends each distinct span, and later each distinct window, once with its
smallest document, packed into one binary row per receiving partition; answers come back only where there is a smaller
document. So a passage that a third of all documents share is one entry per block, never one per document, and no pair
of documents is ever formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_count, doc_block
from .textvec import GROUP_CHARS, U64, Runs, Words, groups, mix

WINDOW = 13
ANCHOR = 4
#: Blocks of documents for each receiving partition of the exchanges.
BLOCKS_PER_PARTITION = 4

_ENTRY = np.dtype([("span", "<u8"), ("anchor", "<u4"), ("many", "<u4"), ("doc", "<i8")])
_ANSWER = np.dtype([("span", "<u8"), ("doc", "<i8")])


def spans(texts: list, window: int = WINDOW, k: int = ANCHOR):
    """Spans of a list of texts: (words, runs, first, count, anchor hash, span hash, text number).

    first: the word where a span's first window starts; count: how many consecutive windows it has.
    """
    words = Words(texts)
    h = words.hash
    runs = Runs(h)
    ahead = words.left()
    n = len(h)
    none = np.zeros(0, dtype=np.int64)
    if n < window:
        return words, runs, none, none, none.astype(U64), none.astype(U64), none
    at = np.arange(n - k + 1)
    grams = runs.hash(at, at + k)
    width = window - k + 1
    starts = np.flatnonzero(ahead >= window)
    if not len(starts):
        return words, runs, none, none, none.astype(U64), none.astype(U64), none
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    pick = starts + view[starts].argmin(axis=1) if len(starts) < n // 2 else starts + view.argmin(axis=1)[starts]
    new = np.flatnonzero(np.diff(pick, prepend=-1) != 0)
    first = starts[new]
    count = np.diff(np.append(new, len(starts)))
    place = pick[new]
    whole = runs.hash(first, first + count - 1 + window)
    owner = np.searchsorted(words.first, first, side="right") - 1
    return words, runs, first, count, grams[place], mix(whole + (place - first).astype(U64)), owner


def _sorted_docs(ids: list, texts: list):
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    return [ids[i] for i in order], [texts[i] for i in order]


def _deal(entries, key, parts: int, block: int):
    """One binary row for each receiving partition."""
    import pandas as pd

    to = (key % U64(parts)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    entries, to = entries[order], to[order]
    cut = np.flatnonzero(np.diff(to, prepend=-1))
    blobs = [x.tobytes() for x in np.split(entries, cut[1:])] if len(to) else []
    return pd.DataFrame({"part": to[cut].astype(np.int32), "block": np.full(len(cut), block, dtype=np.int32), "entries": pd.Series(blobs, dtype=object)})


_PACKED = "part int, block int, entries binary"


def _block_of(frame) -> int:
    return int(frame["block"].iloc[0])


def _distinct(entries):
    """Distinct spans of a block, with the smallest document (entries come in order of documents) and `many` joined by or."""
    _, at, inverse = np.unique(entries["span"], return_index=True, return_inverse=True)
    out = entries[at].copy()
    return out, inverse


def _seeds(ids, texts):
    """(entries of each group, spans of each group) of documents in order of id."""
    for a, b in groups(texts, GROUP_CHARS):
        words, runs, first, count, anchor, whole, owner = spans(texts[a:b])
        doc = np.asarray(ids[a:b], dtype=np.int64)
        entry = np.zeros(len(first), dtype=_ENTRY)
        entry["span"], entry["anchor"] = whole, (anchor >> U64(32)).astype(np.uint32)
        entry["doc"] = doc[owner]
        yield a, b, words, runs, first, count, owner, entry


def _send_spans(parts: int):
    def run(frame):
        ids, texts = _sorted_docs(frame["doc_id"].tolist(), frame["text"].tolist())
        found = [e[-1] for e in _seeds(ids, texts)]
        entries = np.concatenate(found) if found else np.zeros(0, dtype=_ENTRY)
        # An anchor that two documents of the block have is shared, even if both have the same span.
        order = np.argsort(entries["anchor"], kind="stable")
        by = entries[order]
        edge = np.flatnonzero(np.diff(by["anchor"].astype(np.int64), prepend=-1))
        if len(edge):
            low, high = np.minimum.reduceat(by["doc"], edge), np.maximum.reduceat(by["doc"], edge)
            entries["many"][order] = np.repeat((low != high).astype(np.uint32), np.diff(np.append(edge, len(by))))
        out, _ = _distinct(entries)
        return _deal(out, out["anchor"].astype(U64), parts, _block_of(frame))

    return run


def _gather(frame, dtype):
    blobs = [np.frombuffer(x, dtype=dtype) for x in frame["entries"]]
    source = np.repeat(frame["block"].to_numpy(), [len(x) for x in blobs])
    return np.concatenate(blobs), source


def _reply(answers, source):
    """One binary row of answers for each block."""
    import pandas as pd

    order = np.argsort(source, kind="stable")
    answers, source = answers[order], source[order]
    cut = np.flatnonzero(np.diff(source, prepend=-1))
    blobs = [x.tobytes() for x in np.split(answers, cut[1:])] if len(source) else []
    return pd.DataFrame({"block": source[cut].astype(np.int32), "entries": pd.Series(blobs, dtype=object)})


_REPLY = "block int, entries binary"


def _meet_spans(frame):
    """For each span whose anchor several documents have: the smallest document with that span."""
    entries, source = _gather(frame, _ENTRY)
    order = np.lexsort((entries["doc"], entries["span"], entries["anchor"]))
    entries, source = entries[order], source[order]
    a = np.flatnonzero(np.diff(entries["anchor"].astype(np.int64), prepend=-1))
    sizes = np.diff(np.append(a, len(entries)))
    shared = (np.minimum.reduceat(entries["doc"], a) != np.maximum.reduceat(entries["doc"], a)) | (np.maximum.reduceat(entries["many"], a) > 0)
    shared = np.repeat(shared, sizes)
    new = np.ones(len(entries), dtype=bool)
    new[1:] = (entries["span"][1:] != entries["span"][:-1]) | (entries["anchor"][1:] != entries["anchor"][:-1])
    least = entries["doc"][new][np.cumsum(new) - 1]
    out = np.zeros(int(shared.sum()), dtype=_ANSWER)
    out["span"], out["doc"] = entries["span"][shared], least[shared]
    return _reply(out, source[shared])


def _answers(frame):
    found = [np.frombuffer(x, dtype=_ANSWER) for x in frame["entries"]]
    out = np.concatenate(found) if found else np.zeros(0, dtype=_ANSWER)
    return out[np.argsort(out["span"], kind="stable")]


def _look_up(answers, keys):
    """(found, document) for each key."""
    if not len(answers):
        return np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.int64)
    at = np.minimum(np.searchsorted(answers["span"], keys), len(answers) - 1)
    return answers["span"][at] == keys, answers["doc"][at]


def _windows(first, count):
    """The start of every window of some spans."""
    total = int(count.sum())
    return np.repeat(first, count) + np.arange(total) - np.repeat(np.cumsum(count) - count, count)


def _resolve(ids, texts, answers, window):
    """For each group: what is needed to cut words; spans that repeat as a whole, and the windows still open."""
    for a, b, words, runs, first, count, owner, entry in _seeds(ids, texts):
        known, least = _look_up(answers, entry["span"])
        gone = known & (least < entry["doc"])
        open_ = known & ~gone
        start = _windows(first[open_], count[open_])
        item = np.zeros(len(start), dtype=_ANSWER)
        item["span"] = runs.hash(start, start + window)
        item["doc"] = np.repeat(entry["doc"][open_], count[open_])
        yield a, b, words, _windows(first[gone], count[gone]), start, item


def _first_of(items):
    """Distinct windows, each with its smallest document; items come in order of documents."""
    _, at = np.unique(items["span"], return_index=True)
    return items[at]


def _send_windows(parts: int, window: int):
    def run(docs, replies):
        import pandas as pd

        if not len(docs) or not len(replies):
            return pd.DataFrame({"part": pd.Series([], dtype="int32"), "block": pd.Series([], dtype="int32"), "entries": pd.Series([], dtype=object)})
        ids, texts = _sorted_docs(docs["doc_id"].tolist(), docs["text"].tolist())
        found = [x[-1] for x in _resolve(ids, texts, _answers(replies), window)]
        out = _first_of(np.concatenate(found))
        return _deal(out, mix(out["span"]), parts, _block_of(docs))

    return run


def _meet_windows(frame):
    """For each window that a smaller document has, the smallest."""
    entries, source = _gather(frame, _ANSWER)
    order = np.lexsort((entries["doc"], entries["span"]))
    entries, source = entries[order], source[order]
    new = np.ones(len(entries), dtype=bool)
    new[1:] = entries["span"][1:] != entries["span"][:-1]
    least = entries["doc"][new][np.cumsum(new) - 1]
    behind = least < entries["doc"]
    out = np.zeros(int(behind.sum()), dtype=_ANSWER)
    out["span"], out["doc"] = entries["span"][behind], least[behind]
    return _reply(out, source[behind])


def _cut(window: int, with_text: bool):
    def run(docs, replies):
        import hashlib

        import pandas as pd

        ids, texts = _sorted_docs(docs["doc_id"].tolist(), docs["text"].tolist())
        spans_ = _answers(replies[replies["kind"] == 0]) if len(replies) else np.zeros(0, dtype=_ANSWER)
        wide = _answers(replies[replies["kind"] == 1]) if len(replies) else spans_
        # A window met inside the block counts too: its smallest document may be in the same block.
        local = _first_of(np.concatenate([x[-1] for x in _resolve(ids, texts, spans_, window)] or [np.zeros(0, dtype=_ANSWER)]))
        rows = []
        for a, b, words, gone, start, item in _resolve(ids, texts, spans_, window):
            _, here = _look_up(local, item["span"])
            found, far = _look_up(wide, item["span"])
            repeated = (here < item["doc"]) | (found & (far < item["doc"]))
            begin = np.concatenate([gone, start[repeated]])
            cover = np.zeros(len(words.hash) + window + 1, dtype=np.int64)
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + window, -1)
            out = np.cumsum(cover)[: len(words.hash)] > 0
            raw = words.buffer.tobytes()
            begins, ends = words.begin, words.end
            for i in range(b - a):
                lo, hi = words.first[i], words.first[i + 1]
                kept = np.flatnonzero(~out[lo:hi]) + lo
                body = b" ".join([raw[s:e] for s, e in zip(begins[kept].tolist(), ends[kept].tolist(), strict=True)])
                row = (ids[a + i], int(hi - lo), int(hi - lo - len(kept)), hashlib.sha256(body).hexdigest())
                rows.append((*row, body.decode("utf-8", "replace")) if with_text else row)
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
        out = pd.DataFrame(rows, columns=names)
        for c in ("kept_sha256", "kept_text"):
            if c in out:
                out[c] = out[c].astype(object)
        return out

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """One row per row of `docs` with an id: doc_id, n_words, n_removed, kept_sha256, and kept_text if asked for.

    Words are runs of anything but ASCII white space, unchanged; null texts have none. Rows with a null doc_id take no
    part and are not returned, since "smaller id" says nothing about them. Rows that share a doc_id are each cut, but not because of
    each other. Texts of any length are read whole. An empty table gives no rows; other columns are ignored.
    """
    blocks = block_count(docs)
    parts = max(1, blocks // BLOCKS_PER_PARTITION)
    base = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = base.withColumn("block", doc_block(blocks)).repartition(blocks, "block")
    by_block = base.groupBy("block")
    seeds = by_block.applyInPandas(_send_spans(parts), _PACKED)
    span_replies = seeds.groupBy("part").applyInPandas(_meet_spans, _REPLY)
    windows = by_block.cogroup(span_replies.groupBy("block")).applyInPandas(_send_windows(parts, window), _PACKED)
    window_replies = windows.groupBy("part").applyInPandas(_meet_windows, _REPLY)
    replies = span_replies.withColumn("kind", F.lit(0)).unionByName(window_replies.withColumn("kind", F.lit(1)))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return by_block.cogroup(replies.groupBy("block")).applyInPandas(_cut(window, with_text), schema)


def oracle(window: int = WINDOW) -> str:
    return f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - {window} + 2)) AS p, w FROM w WHERE len(w) >= {window}),
h AS (SELECT doc_id, p, md5(array_to_string(w[p:p + {window - 1}], ' ')) AS k FROM g),
f AS (SELECT k, min(doc_id) AS d FROM h GROUP BY k),
r AS (SELECT DISTINCT doc_id, unnest(range(p, p + {window})) AS p FROM h JOIN f USING (k) WHERE d < doc_id),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS t FROM w),
k AS (SELECT x.doc_id, count(*) AS n, string_agg(x.t, ' ' ORDER BY x.p) AS t FROM x ANTI JOIN r ON x.doc_id = r.doc_id AND x.p = r.p GROUP BY x.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
