"""Encoding by distinct pieces with the tokenizers library.

A byte-pair tokenizer encodes each piece of its pre-tokenizer by itself, and in any text few pieces are
distinct. So a text is cut into pieces, the library encodes a piece when it is first met, and the ids of a
text are the joined ids of its pieces. Where a text has characters for which Python's expressions and the
library's could differ, the library encodes the whole text.
"""

from __future__ import annotations

import array
import os
import re

import numpy as np

#: Pieces that are remembered, and the longest of them; above, all are forgotten and met anew.
KEPT_PIECES, KEPT_CHARS = 500_000, 64

#: Characters of texts that are cut here: ASCII and Latin letters, whose classes and case pairs are settled. Not
#: among them: control characters, U+0085, U+00A0, U+00AD and U+0130, and all from U+0180 on.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ſ]*")
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
#: White space of other kinds than single spaces and single line ends.
OTHER_SPACE = re.compile("[ \n][ \n]|[\t\r]")
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"


def byte_characters() -> list[str]:
    """The character of each byte: printable ones stand for themselves, the others for U+0100 and on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def _shown() -> dict[int, str]:
    """For translate(): the characters of a plain character's bytes."""
    of = byte_characters()
    return {c: "".join(of[b] for b in chr(c).encode()) for c in range(0x180)}


SHOWN = _shown()


class Kept(dict):
    """text -> ids as little-endian unsigned 32-bit integers, by ``ids_of`` where not remembered."""

    def __init__(self, ids_of, most: int | None = None):
        super().__init__()
        self.ids_of, self.most = ids_of, most or KEPT_PIECES

    def __missing__(self, text: str) -> bytes:
        ids = self.ids_of(text)
        if len(text) <= KEPT_CHARS:
            if len(self) >= self.most:
                self.clear()
            self[text] = ids
        return ids


class PieceEncoder:
    """ids of whole texts. ``pattern`` finds the pieces of a plain text, after ``prepare``.

    White space parts pieces in every pattern. If it is ``kept``, a single space starts the piece after it and a
    single line end is a piece, so texts whose white space is of these two kinds are cut there; if not, all
    plain texts are cut at white space. What lies between is remembered as well as the pieces.
    """

    def __init__(self, tokenizer, pattern: str, prepare=None, kept: bool = True, most: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        tokenizer.encode_special_tokens = True
        self.tokenizer, self.prepare, self.kept = tokenizer, prepare or (lambda t: t), kept
        self.model = tokenizer.model.tokenize
        self.find = re.compile(pattern).findall
        self.words = Kept(self._by_pieces, most)
        self.spaced = Kept(lambda w: self._by_pieces(" " + w), most)
        self.line_end = self._encoded("\n") if kept else b""

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids; none of a null or empty text."""
        if not text:
            return b""
        if PLAIN.fullmatch(text) is None:
            return b"".join(self._by_library(text))
        text = self.prepare(text)
        if not self.kept:
            return b"".join(map(self.words.__getitem__, text.split()))
        if OTHER_SPACE.search(text):
            return self._by_pieces(text)
        return self.line_end.join(map(self._line, text.split("\n")))

    def _line(self, line: str) -> bytes:
        first, *rest = line.split(" ")
        return self.words[first] + b"".join(map(self.spaced.__getitem__, rest))

    def _by_pieces(self, text: str) -> bytes:
        parts = self.find(text)
        return self._by_model(parts[0]) if len(parts) == 1 else b"".join(map(self.words.__getitem__, parts))

    def _by_model(self, piece: str) -> bytes:
        return array.array("I", [t.id for t in self.model(piece.translate(SHOWN))]).tobytes()

    def _by_library(self, text: str):
        """The library holds much for each token, so a long text goes in parts, cut at a space between letters."""
        at = 0
        for m in re.finditer(f"(?<=[{LETTERS}])(?= [{LETTERS}])", text):
            if m.start() - at >= 1 << 18:
                yield self._encoded(text[at : m.start()])
                at = m.start()
        yield self._encoded(text[at:])

    def _encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
