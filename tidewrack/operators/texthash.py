"""Tokens, lines and windows of tokens of many texts at once, in numpy.

Tokens are those of ``tokens.TOKEN`` as the JVM sees them: which code points are letters or numbers is asked of its
regular expressions once. A token's hash is a sum over its characters, mixed; a window's is a polynomial over its
tokens, modulo 2^64, from differences of running sums.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession

#: Characters of texts that are worked on together; a longer text stands alone.
SPAN = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)
#: What ``<NUM>`` is hashed as.
NUMBER = np.uint64(0x5851F42D4C957F2D)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64 bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_edges: dict[str, tuple[int, ...]] = {}


def word_edges(spark: SparkSession) -> tuple[int, ...]:
    """The code points at which runs of letters, numbers and ``_`` begin and end, in turn."""
    if "word" not in _edges:
        points = [*range(0xD800), *range(0xE000, 0x110000)]
        pattern = spark.sparkContext._jvm.java.util.regex.Pattern.compile(r"[^\p{L}\p{N}_]")
        left = pattern.matcher("".join(map(chr, points))).replaceAll(" ")
        word = np.zeros(0x110001, bool)
        word[points] = [c != " " for c in left]
        _edges["word"] = tuple((np.flatnonzero(np.diff(word)) + 1).tolist())
    return _edges["word"]


@functools.cache
def _kinds(edges: tuple[int, ...]) -> np.ndarray:
    """For each code point 0 for white space, 1 for a character of words, 2 for a mark."""
    out = np.full(0x110000, 2, "u1")
    for a, z in zip(edges[::2], edges[1::2]):
        out[a:z] = 1
    out[[9, 10, 11, 12, 13, 32]] = 0
    return out


_held: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i, modulo 2^64, for i under ``n`` at least."""
    if not _held or len(_held[0]) < n:
        size = max(SPAN, 1 << n.bit_length())
        _held.clear()
        for b in (BASE, np.uint64(pow(int(BASE), -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _held.append(np.multiply.accumulate(p))
    return _held[0], _held[1]


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, texts) of about SPAN characters each; a null is an empty text."""
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if held and size + len(t) > SPAN:
            yield at, held
            at, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield at, held


class Tokens:
    """The tokens of some texts, one after the other.

    ``starts``: where each begins in the joined texts, ``bounds``: the first token of each text, and the number of
    all; ``text``: the text of each token; ``line_ends``: where each line ends, ``line_text``: the text of each line.
    """

    def __init__(self, texts: list[str], edges: tuple[int, ...]):
        self.points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
        kind = _kinds(edges)[self.points]
        word = kind == 1
        opens = kind == 2
        opens |= word & ~np.concatenate([[False], word[:-1]])
        self._solid = np.flatnonzero(kind)
        self._opens = opens[self._solid]
        self.starts = self._solid[self._opens]
        ends = np.cumsum([len(t) + 1 for t in texts])  # behind each text and its line end
        self.bounds = np.concatenate([[0], np.searchsorted(self.starts, ends)])
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        self.line_ends = np.flatnonzero(self.points == 10)
        self.line_text = np.searchsorted(ends, self.line_ends, side="right")

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, line, first, n) of each line: its place in the text, the place of its first token there, its tokens."""
        behind = np.searchsorted(self.starts, self.line_ends)
        before = np.concatenate([[0], behind[:-1]])
        head = np.searchsorted(self.line_text, np.arange(len(self.bounds) - 1))
        return self.line_text, np.arange(len(behind)) - head[self.line_text], before - self.bounds[self.line_text], behind - before

    def hashes(self, ignore_literals: bool = True) -> np.ndarray:
        """The hash of each token; of all tokens of digits the same, if so asked."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        c, heads = self.points[self._solid], np.flatnonzero(self._opens)
        place = np.arange(len(c)) - np.repeat(heads, np.diff(np.append(heads, len(c))))
        out = mixed(np.add.reduceat(mixed(c.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32))), heads))
        if ignore_literals:
            out[np.minimum.reduceat((c >= 48) & (c <= 57), heads)] = NUMBER
        return out


def sums(h: np.ndarray) -> np.ndarray:
    """Running sums of the hashes times powers of BASE."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(len(h))[0][: len(h)])])


def windows(running: np.ndarray, k: int) -> np.ndarray:
    """The hash of each window of ``k`` tokens, also those over the ends of texts."""
    n = max(len(running) - k, 0)
    return (running[k:] - running[:n]) * powers(max(n, 1))[1][:n]


def least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    out, have = h, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out
