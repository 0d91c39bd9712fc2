"""Vectorised tokenising and hashing of many texts at once.

Texts are laid end to end as UTF-8 bytes; words, their 64-bit hashes and hashes of word runs come from a few
numpy passes over that buffer, without a Python loop over words.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Texts are handled in groups of about so many characters, which bounds memory whatever a partition holds.
GROUP_CHARS = 1 << 20
_BASE = U64(0x9E3779B97F4A7C15)
_RUN = U64(0xD6E8FEB86659FD93)
_RUN_INV = U64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))

_SPACE = np.ones(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = False
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def groups(texts: list, limit: int = GROUP_CHARS):
    """Index ranges of consecutive texts that together have about `limit` characters; a longer text is alone."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if isinstance(text, str) else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


class Words:
    """Words of a list of texts.

    hash: one uint64 per word. begin, end: byte offsets into `buffer`. first: first[i]..first[i+1] are the words of
    text i. A null text has no words. With `fold`, text is lower-cased and words are runs of ASCII letters, digits
    and non-ASCII characters; without, words are runs of anything but ASCII white space, unchanged.
    """

    def __init__(self, texts: list, fold: bool = False):
        raw = [(t.lower() if fold else t).encode("utf-8", "surrogatepass") if t else b"" for t in (t if isinstance(t, str) else "" for t in texts)]
        self.buffer = buf = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 1
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        inside = (_ALNUM if fold else _SPACE)[buf]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.begin, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.begin, bounds)
        size = self.end - self.begin
        n = len(size)
        if n == 0:
            self.hash = np.zeros(0, dtype=U64)
            return
        offset = np.concatenate([[0], np.cumsum(size)[:-1]])
        place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(offset, size)
        value = (buf[inside].astype(U64) + U64(1)) * powers(_BASE, int(size.max()))[place]
        self.hash = mix(np.add.reduceat(value, offset) + size.astype(U64))

    def left(self) -> np.ndarray:
        """For each word, how many words of its text begin there, itself included."""
        counts = np.diff(self.first)
        return np.repeat(self.first[1:], counts) - np.arange(len(self.hash))

    def owner(self) -> np.ndarray:
        """For each word, the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


class Runs:
    """Hashes of any runs of consecutive words, from prefix sums."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self._sum = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(words * powers(_RUN, n)[:n], dtype=U64)])
        self._back = powers(_RUN_INV, n + 1)

    def hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[begin]) * self._back[begin] + (end - begin).astype(U64))
