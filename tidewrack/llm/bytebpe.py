"""Byte-level BPE encoding and decoding from a file of ranks, with the tokenizers library.

The file gives byte strings and ranks. The library wants characters and merges: each byte stands for one
printable character, and the merge that makes a token is found by merging the token's bytes with the lower
ranks until two parts are left. A token's offsets are the characters of the text that its bytes lie in, as the
library gives them: the tokens' byte lengths place them in the text's bytes, and a map from bytes to characters does
the rest; several tokens of one split character share its offsets.

Decoding looks up each id's bytes and joins them; a character that is split over tokens becomes whole again
by joining bytes before any decoding of UTF-8, and bytes that are no UTF-8 become U+FFFD in the text form.

Null and empty texts have no ids. Repeated rows give repeated rows, an empty table an empty result; other
columns of the input are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.arrow import bound_batches
from tidewrack.llm.pieces import LETTERS, NUMBERS, PieceEncoder, byte_characters

#: The pieces of a plain text, as the pattern of the public tokenizers finds them.
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\t\n\r {LETTERS}{NUMBERS}]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+"


#: Words that an encoder remembers, after a space and without: some 50 MB in each Python worker.
KEPT = 150_000


@functools.cache
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def parts_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two tokens that merge into ``token``; None if its bytes don't merge into two by lower ranks."""
    own, parts = ranks[token], [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], own))
        if ranks.get(parts[at] + parts[at + 1], own) >= own:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


@functools.cache
def library_tokenizer(path: str, pattern: str):
    """The library's tokenizer of the ranks at ``path``; each match of ``pattern`` is encoded separately."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, of = read_ranks(path), byte_characters()
    shown = {t: "".join(of[b] for b in t) for t in ranks}
    merges = [p for t in sorted(ranks, key=ranks.get) if len(t) > 1 and (p := parts_of(t, ranks))]
    t = Tokenizer(models.BPE(vocab={s: ranks[b] for b, s in shown.items()}, merges=[(shown[a], shown[b]) for a, b in merges]))
    t.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return t


@functools.cache
def encoder(path: str, pattern: str) -> PieceEncoder:
    return PieceEncoder(library_tokenizer(path, pattern), PIECE, most=KEPT)


@functools.cache
def byte_table(path: str) -> list[bytes | None]:
    """The bytes of each id."""
    ranks = read_ranks(path)
    table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def decoded_bytes(ids: bytes, path: str) -> bytes:
    """The bytes of little-endian unsigned 32-bit ids; an unknown id raises."""
    return b"".join(map(byte_table(path).__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def byte_lengths(path: str) -> np.ndarray:
    return np.array([len(t or b"") for t in byte_table(path)], np.int64)


def offsets_of(ids: bytes, raw: bytes, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(first character, end) of each of the ids of a text whose UTF-8 is ``raw``; ends are exclusive."""
    character = np.cumsum((np.frombuffer(raw, "u1") & 0xC0) != 0x80)  # of each byte, counted from 1
    ends = np.cumsum(byte_lengths(path)[np.frombuffer(ids, "<u4")])
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if len(ends) else ends
    return character[starts] - 1, character[ends - 1]


def encode(docs: DataFrame, path: str, pattern: str, offsets: bool = False, digests: bool = False) -> DataFrame:
    """(doc_id, ids binary, n_tokens long) of every row, ids as little-endian unsigned 32-bit integers.

    With ``offsets`` also starts and ends, arrays of character places, end exclusive. With ``digests`` also
    decoded_sha256, of the bytes that the ids decode to. All in one pass: a second Python stage would hold the
    encoder in another worker.
    """
    bound_batches(docs.sparkSession)
    more = ([("starts", "array<long>"), ("ends", "array<long>")] if offsets else []) + ([("decoded_sha256", "string")] if digests else [])

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in batches:
            texts = [t.as_py() for t in b.column(1)]
            ids = list(map(enc.ids, texts))
            cols = [b.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            if offsets:
                places = [offsets_of(x, (t or "").encode(), path) for x, t in zip(ids, texts)]
                cols += [pa.array([p[k] for p in places], pa.list_(pa.int64())) for k in (0, 1)]
            if digests:
                cols.append(pa.array([hashlib.sha256(decoded_bytes(x, path)).hexdigest() for x in ids], pa.string()))
            yield pa.record_batch(cols, ["doc_id", "ids", "n_tokens", *(n for n, _ in more)])

    return _texts(docs).mapInArrow(ids_of, ", ".join(["doc_id long, ids binary, n_tokens long", *(f"{n} {t}" for n, t in more)]))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def decode(path: str, ids: Column, as_text: bool = False) -> Column:
    """The bytes of a column of ids, or their text with U+FFFD for what is no UTF-8; null of null."""

    @F.pandas_udf("binary")
    def raw(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else decoded_bytes(v, path))

    @F.pandas_udf("string")
    def text(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else decoded_bytes(v, path).decode("utf-8", "replace"))

    return (text if as_text else raw)(ids)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, offsets_sha256) of every row.

    The last is of the tokens' first characters, and then their ends, as little-endian unsigned 32-bit integers.
    """
    bound_batches(docs.sparkSession)
    names = ["ids_sha256", "decoded_sha256", "offsets_sha256"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sha = encoder(path, pattern), lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            n, rows = [], []
            for t in b.column(1):
                text = t.as_py() or ""
                ids = enc.ids(text)
                places = b"".join(p.astype("<u4").tobytes() for p in offsets_of(ids, text.encode(), path))
                n.append(len(ids) // 4)
                rows.append((sha(ids), sha(decoded_bytes(ids, path)), sha(places)))
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), *(pa.array([r[k] for r in rows], pa.string()) for k in range(3))], ["doc_id", "n_tokens", *names])

    return _texts(docs).mapInArrow(digest, "doc_id long, n_tokens long, " + ", ".join(f"{x} string" for x in names))
