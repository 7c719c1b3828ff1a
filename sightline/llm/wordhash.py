"""Hashes of words and of runs of words, for many texts at once, in numpy.

Texts come as words joined by one space (words_text() of common.py). A prefix sum of byte values times powers gives
the hash of any run of bytes by two look-ups; two equal runs have equal hashes in whatever text and task they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are worked on at once, if no single text is longer.
CHUNK = 1_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts: start and end in the joined bytes, and the number of the text."""

    def __init__(self, texts: list[bytes]) -> None:
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(texts) else np.zeros(0, np.int64)
        ends = np.flatnonzero(data == 32)
        starts = np.concatenate([[0], ends[:-1] + 1])
        real = ends > starts  # an empty text has no word
        self.data, self.start, self.end = data, starts[real], ends[real]
        self.text = np.searchsorted(begins, self.start, "right") - 1
        self.count = np.bincount(self.text, minlength=len(texts))
        self.first = np.concatenate([[0], np.cumsum(self.count)[:-1]]) if len(texts) else np.zeros(0, np.int64)
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def hashes(self, n: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Position of each word with n - 1 more words after it in its text, and the hash of those n words."""
        last = len(self.start) - n + 1
        at = np.arange(max(last, 0))
        if n > 1 and len(at):
            at = at[self.text[at] == self.text[at + n - 1]]
        s, e = self.start[at], self.end[at + n - 1]
        return at, mix((self.sums[e] - self.sums[s]) * self.down[s] + (e - s).astype(np.uint64))

    def prefixes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word has more than n characters, and the hash of its first n (of all that it has)."""
        begins = np.flatnonzero((self.data & 0xC0) != 0x80)
        stop = begins[np.minimum(np.searchsorted(begins, self.start) + n, len(begins) - 1)] if len(self.start) else self.start
        end = np.minimum(stop, self.end)
        return stop < self.end, mix((self.sums[end] - self.sums[self.start]) * self.down[self.start] + (end - self.start).astype(np.uint64))

    def word(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "surrogatepass")


def chunks(texts: list, size: int = CHUNK) -> Iterator[tuple[int, Words]]:
    """Number of the first text, and the words of as many texts as have `size` bytes, or of one that is longer."""
    got, total, first = [], 0, 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if got and total + len(b) > size:
            yield first, Words(got)
            got, total, first = [], 0, i
        got.append(b)
        total += len(b) + 1
    if got:
        yield first, Words(got)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each shingle of n words; a text of fewer words is one shingle, one without words has none."""
    at, h = w.hashes(n)
    text = w.text[at]
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    if len(short):
        s, e = w.start[w.first[short]], w.end[w.first[short] + w.count[short] - 1]
        text = np.concatenate([text, short])
        h = np.concatenate([h, mix((w.sums[e] - w.sums[s]) * w.down[s] + (e - s).astype(np.uint64))])
    return text, h
