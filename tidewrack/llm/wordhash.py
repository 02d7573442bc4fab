"""64-bit hashes of all words of many texts at once, in numpy.

A word is a run of ASCII letters and digits or of bytes above 127 of the lower-cased text. Its hash is a
polynomial over its bytes, modulo 2^64, from differences of running sums, mixed at the end. In scripts that put no
spaces between words each character is a word; their marks and the full-width ones are none.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

from tidewrack.functions.arrow import text_pieces

WORD = np.array([chr(b).isalnum() or b > 127 for b in range(128)] + [True] * 128)
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that are hashed at a time, at most: the powers of BASE are kept for so many.
SPAN = 1 << 20


#: Fixed values, first and last characters: scripts without spaces, and marks of theirs and of full width.
UNSPACED = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F))
MARKS = ((0x3000, 0x3004), (0x3008, 0x3020), (0x3030, 0x3030), (0x303D, 0x303D), (0x30FB, 0x30FB), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))


def _among(cp: np.ndarray, ranges: tuple) -> np.ndarray:
    return np.logical_or.reduce([(cp >= a) & (cp <= z) for a, z in ranges])


def _bounds(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 bytes."""
    word, cut = WORD[b], np.zeros(len(b) + 1, bool)
    at = np.flatnonzero(b >= 0xE0)
    if len(at):
        three, four = at[b[at] < 0xF0], at[b[at] >= 0xF0]
        x = b.astype(np.uint32)
        cp = (x[three] & 15) << 12 | (x[three + 1] & 63) << 6 | x[three + 2] & 63
        marks, alone = three[_among(cp, MARKS)], three[_among(cp, UNSPACED) & ~_among(cp, MARKS)]
        wide = four[((x[four] & 7) << 2 | (x[four + 1] & 63) >> 4) >> 1 == 1]  # planes 2 and 3
        for k in range(3):
            word[marks + k] = False
        for p, n in ((alone, 3), (wide, 4)):
            cut[p] = cut[p + n] = True
    inside = np.concatenate([[False], word, [False]])
    both = inside[1:] & inside[:-1] & cut
    return np.flatnonzero(inside[1:] & ~inside[:-1] | both), np.flatnonzero(inside[:-1] & ~inside[1:] | both)


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i, modulo 2^64."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    out = []
    for b in (BASE, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64 bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words of at most SPAN lower-cased bytes."""
    b = np.frombuffer(raw, "u1")
    starts, ends = _bounds(b)
    up, down = _powers(SPAN)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)])])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts, ends


def words_of(text: str | None) -> np.ndarray:
    """Hashes of all words of a text."""
    parts = [word_hashes(p.lower().encode())[0] for piece in text_pieces([text], SPAN // 8) for _, p in piece]
    return np.concatenate([np.zeros(0, np.uint64), *parts])


def document_words(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of the texts that aren't empty; many short ones are hashed together, a long one piece by piece."""
    for piece in text_pieces(texts, SPAN // 8):  # a character has four bytes at the most, and may grow by lower()
        if len(piece) == 1 and len(piece[0][1]) < len(texts[piece[0][0]]):
            continue
        lowered = [p.lower().encode() for _, p in piece]
        h, starts, _ = word_hashes(b"\n".join(lowered))
        bounds = np.searchsorted(starts, np.cumsum([0] + [len(x) + 1 for x in lowered]))
        whole = [(row, h[bounds[k] : bounds[k + 1]]) for k, (row, p) in enumerate(piece) if len(p) == len(texts[row])]
        yield from whole
    for row, text in enumerate(texts):
        if text and len(text) > SPAN // 8:
            yield row, words_of(text)
