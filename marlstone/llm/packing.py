"""Order-preserving packing of documents into sequences of a fixed number of tokens.

The documents of an input partition are one stream of token ids in stored order. Sequences are consecutive windows of
it; a dynamic program chooses where to cut so that padding plus truncation penalties are least. A cut costs nothing at
a document's end, little at a sentence's end and more inside a sentence (such cuts are considered every few dozen
tokens where there is no sentence end). With c the cut and c' the one before,

    f(c) = penalty(c) + min over c - length <= c' < c of f(c') + length - (c - c')

and the minimum of f(c') + c' over the sliding range is the head of a monotone queue. A window whose length is a power
of two is not padded, so those lengths are transitions of their own. No row is shuffled: each input partition is packed by
itself and at most its last windows are short.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

LENGTH = 1024
SENTENCE_CUT = 2.0
INNER_CUT = 12.0
#: Where no sentence ends, a cut is considered every so many tokens.
INNER_STEP = 32
#: Tokens of consecutive whole documents that one run of the dynamic program sees (a longer document is seen whole).
STREAM_TOKENS = 1 << 19
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


class Encoder:
    """Byte-level BPE ids of texts, as the vocabulary file's own tokenizer gives them; id 0 ends each document.

    path: a tokenizers JSON file. Where the same vocabulary is at hand as ranks (same path with the suffix .tiktoken),
    plain texts are encoded with those, which gives the same ids faster; texts that hold a special token's string go
    through the JSON tokenizer.
    """

    def __init__(self, path: str):
        import base64
        import json
        import os

        import numpy as np

        self.path, self.slow, self.fast = path, None, None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = [t["content"] for t in model["added_tokens"]]
        vocabulary = {**model["model"]["vocab"], **{t["content"]: t["id"] for t in model["added_tokens"]}}
        # U+010A is how byte-level vocabularies spell a newline.
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        for token, number in vocabulary.items():
            self.ends[number] = token.endswith((".", "!", "?")) or "\u010a" in token

    def _slow(self, text: str) -> list[int]:
        """By the JSON tokenizer, which is loaded when a text first needs it: it is large."""
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return [*self.slow.encode(text, add_special_tokens=False).ids, 0]

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return [0]
        if self.fast is None or any(s in text for s in self.special):
            return self._slow(text)
        try:
            return [*self.fast.encode_ordinary(text), 0]
        except UnicodeEncodeError:  # a lone surrogate
            return self._slow(text.encode("utf-8", "replace").decode())


def candidates(ids, doc_ends, ends, inner_step: int = INNER_STEP):
    """(positions, penalties) of the cuts considered in a stream, first 0 and last its length."""
    import numpy as np

    at_sentence = np.zeros(len(ids) + 1, dtype=bool)
    at_sentence[1:] = ends[ids]
    whole = at_sentence.copy()
    whole[0] = whole[doc_ends] = True
    marks = np.flatnonzero(whole)
    cost = np.where(at_sentence[marks], SENTENCE_CUT, 0.0)
    cost[np.searchsorted(marks, doc_ends)] = 0.0
    cost[0] = 0.0
    times = (np.diff(marks) - 1) // inner_step
    place = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + 1
    at = np.concatenate([marks, np.repeat(marks[:-1], times) + inner_step * place])
    cost = np.concatenate([cost, np.full(len(place), INNER_CUT)])
    order = np.argsort(at, kind="stable")
    return at[order], cost[order]


def best_cuts(at, cost, length: int = LENGTH) -> list[int]:
    """The cuts of least total cost, from the first position to the last, by monotone queue and the power-of-two transitions."""
    from collections import deque

    import numpy as np

    at = np.asarray(at)
    m = len(at)
    # For each position, the cuts that lie a power of two before it.
    powers: list = [()] * m
    for p in (1 << k for k in range((length - 1).bit_length())):
        k = np.searchsorted(at, at - p)
        (j,) = np.nonzero(at[k] == at - p)
        for x, y in zip(j.tolist(), k[j].tolist(), strict=True):
            powers[x] += (y,)
    at, cost = at.tolist(), np.asarray(cost, dtype=float).tolist()
    best, back = [0.0] * m, [0] * m
    queue: deque = deque([(0.0, 0)])
    floors = deque([0])
    for j in range(1, m):
        c = at[j]
        least = c - length
        while floors[0] < least:
            floors.popleft()
            queue.popleft()
        value, i = queue[0]
        value += length - c
        for k in powers[j]:
            if best[k] < value:
                value, i = best[k], k
        value += cost[j]
        best[j], back[j] = value, i
        key = value + c
        while queue and queue[-1][0] >= key:
            queue.pop()
            floors.pop()
        queue.append((key, j))
        floors.append(c)
    cuts, j = [at[-1]], m - 1
    while j:
        j = back[j]
        cuts.append(at[j])
    return cuts[::-1]


def pack_stream(ids, sizes, ends, length: int = LENGTH):
    """Pieces of one stream: arrays doc number, start in doc, piece length, sequence number, offset, from, to."""
    import numpy as np

    doc_ends = np.cumsum(sizes)
    at, cost = candidates(ids, doc_ends, ends, min(INNER_STEP, length))
    cuts = np.asarray(best_cuts(at, cost, length))
    doc_starts = doc_ends - sizes
    begin = np.union1d(cuts[:-1], doc_starts)
    stop = np.append(begin[1:], doc_ends[-1])
    doc = np.searchsorted(doc_starts, begin, side="right") - 1
    sequence = np.searchsorted(cuts, begin, side="right") - 1
    return doc, begin - doc_starts[doc], stop - begin, sequence, begin - cuts[sequence], begin, stop, len(cuts) - 1


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, stream_tokens: int = STREAM_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the single id 0. Every row is packed as a document of its own, repeated rows and null ids
    included. sequence_id numbers the sequences of an input partition from its number times 2**32. Texts of any length
    are encoded whole. An empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        encoder = Encoder(tokenizer_path)

        def flush(names, streams):
            nonlocal number
            ids = np.concatenate(streams)
            sizes = np.fromiter(map(len, streams), dtype=np.int64, count=len(streams))
            doc, start, size, sequence, offset, begin, stop, count = pack_stream(ids, sizes, encoder.ends, length)
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
            columns = [[names[k] for k in doc.tolist()], start, size, crc, sizes[doc], sequence + number, offset]
            number += count
            return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=NAMES)

        names: list = []
        streams: list = []
        held = 0
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.asarray(encoder.ids(text.as_py()), dtype=np.int32)
                names.append(name.as_py())
                streams.append(ids)
                held += len(ids)
                if held >= stream_tokens:
                    yield flush(names, streams)
                    names, streams, held = [], [], 0
        if names:
            yield flush(names, streams)

    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
