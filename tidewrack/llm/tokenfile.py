"""Token ids as binary files: frequency-ranked ids, byte-aligned variable-length coding, separate control bytes.

An id is replaced by its rank by frequency over the whole corpus (ties to the smaller id), so frequent ids are
small numbers. A number takes one to four bytes; the lengths, two bits each, stand apart in control bytes, four
numbers to a byte. A control byte thus fixes where the next four numbers lie, and numpy decodes by looking up
all control bytes in a table of lengths at once.

A file is a run of blocks. A block: four little-endian unsigned 32-bit integers (documents, numbers, data bytes,
documents without doc_id, which come first and hold 0 for it), the documents' doc_id (signed 64) and how many of the block's numbers are theirs (unsigned 32), control
bytes, data bytes. A document may go on in the next block, which then starts with its doc_id again and has the
top bit of the count set. Blocks hold at most ``BLOCK`` numbers, so readers need bounded memory.

Files hold ascending doc_id ranges, in the order of the manifest, which lists only files of tasks that ended
well: a repeated or lost task leaves files that nothing names. Rows without doc_id come first; repeated rows
stay, in any order among equals. Null and empty texts hold the end id alone. An empty table gives no files.
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.functions.arrow import bound_batches
from tidewrack.llm.pieces import LETTERS, PieceEncoder
from tidewrack.plans.lineage import remove, work_dir, written

BLOCK = 1 << 18
GOES_ON = 1 << 31
#: Bytes of each of the four numbers of a control byte, and their sum.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1
SUMS = LENGTHS.sum(1)

#: The pieces of a plain text after its white space is joined and letters are lower case.
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\t\n\r {LETTERS}0-9\xb2\xb3\xb9\xbc-\xbe]+"


@functools.cache
def encoder(path: str) -> PieceEncoder:
    from tokenizers import Tokenizer

    return PieceEncoder(Tokenizer.from_file(path), PIECE, str.lower, kept=False)


def coded(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes); the last control byte counts unused places as one byte each."""
    n = len(numbers)
    x = np.zeros(-(-n // 4) * 4, "<u4")
    x[:n] = numbers
    size = 1 + (x > 0xFF) + (x > 0xFFFF) + (x > 0xFFFFFF)
    two = (size - 1).reshape(-1, 4)
    control = (two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6).astype("u1")
    keep = np.arange(4) < size[:n, None]
    return control.tobytes(), x[:n].view("u1").reshape(-1, 4)[keep].tobytes()


def numbers_of(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers, by table lookup."""
    size = LENGTHS[np.frombuffer(control, "u1")].ravel()[:n]
    ends = np.cumsum(size)
    raw = np.concatenate([np.frombuffer(data, "u1"), np.zeros(3, "u1")])
    at, out = ends - size, np.zeros(n, "<u4")
    for k in range(4):
        part = raw[at + k].astype("<u4") << np.uint32(8 * k)
        out |= np.where(size > k, part, np.uint32(0))
    return out


def block_bytes(ids: list[int | None], counts: list[int], numbers: np.ndarray) -> bytes:
    control, data = coded(numbers)
    head = np.array([len(ids), len(numbers), len(data), ids.count(None)], "<u4")
    return b"".join((head.tobytes(), np.array([i or 0 for i in ids], "<i8").tobytes(), np.array(counts, "<u4").tobytes(), control, data))


def open_uri(uri: str, mode: str):
    """A stream of any file system that Arrow reaches."""
    fs, path = pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    if mode == "rb":
        return fs.open_input_stream(path)
    fs.create_dir(os.path.dirname(path), recursive=True)
    return fs.open_output_stream(path)


def read_blocks(uri: str) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc_ids, counts, numbers) of each block."""
    with open_uri(uri, "rb") as f:
        while head := f.read(16):
            docs, n, size, without = np.frombuffer(head, "<u4").tolist()
            ids, counts = np.frombuffer(f.read(8 * docs), "<i8"), np.frombuffer(f.read(4 * docs), "<u4")
            control = f.read(-(-n // 4))
            yield [None] * without + ids[without:].tolist(), counts, numbers_of(control, f.read(size), n)


def token_ids(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, salt, ids binary) of every row: unsigned 16-bit ids if the vocabulary allows, else 32-bit ones.

    ``salt`` deals rows of one doc_id, or of none, over ranges.
    """
    bound_batches(docs.sparkSession)

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        kind, seen = id_kind(path), 0
        for b in batches:
            salt = np.arange(seen, seen + b.num_rows, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            seen += b.num_rows
            ids = [np.append(np.frombuffer(enc.ids(t.as_py()), "<u4"), end_id).astype(kind).tobytes() for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(salt.astype("i4")), pa.array(ids, pa.binary())], ["doc_id", "salt", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(ids_of, "doc_id long, salt int, ids binary")


@functools.cache
def id_kind(path: str) -> str:
    return "<u2" if encoder(path).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def frequency_ranks(ids: DataFrame, path: str) -> np.ndarray:
    """rank of each id over the whole corpus; one count for each id of the vocabulary comes to the driver."""
    kind, size = id_kind(path), encoder(path).tokenizer.get_vocab_size()

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=size)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    rows = ids.select("ids").mapInArrow(counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(size, np.int64)
    for r in rows:
        n[r.id] = r.n
    order = np.lexsort((np.arange(size), -n))
    ranks = np.empty(size, "<u4")
    ranks[order] = np.arange(size, dtype="<u4")
    return ranks


def write_files(ids: DataFrame, ranks: np.ndarray, kind: str, folder: str) -> DataFrame:
    """Write ``ids`` in ascending doc_id order; a row (part, uri, docs, tokens) for each file."""
    spark = ids.sparkSession
    held = spark.sparkContext.broadcast(ranks)  # one number for each id of the vocabulary

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        uri, out, docs, tokens = f"{folder}/{part:06d}-{uuid.uuid4().hex}.tok", None, 0, 0
        names, counts, numbers, size = [], [], [], 0
        for b in batches:
            for d, raw in zip(b.column(0).to_pylist(), b.column(1)):
                x = held.value[np.frombuffer(raw.as_buffer(), kind)]
                docs, tokens, more = docs + 1, tokens + len(x), 0
                while True:
                    room = BLOCK - size
                    names.append(d)
                    counts.append(len(x[:room]) | more)
                    numbers.append(x[:room])
                    size += len(x[:room])
                    x, more = x[room:], GOES_ON
                    if size == BLOCK:
                        out = out or open_uri(uri, "wb")
                        out.write(block_bytes(names, counts, np.concatenate(numbers)))
                        names, counts, numbers, size = [], [], [], 0
                    if not len(x):
                        break
        if names:
            out = out or open_uri(uri, "wb")
            out.write(block_bytes(names, counts, np.concatenate(numbers)))
        if out:
            out.close()
            yield pa.record_batch(
                [pa.array([v], t) for v, t in ((part, pa.int64()), (uri, pa.string()), (docs, pa.int64()), (tokens, pa.int64()))],
                ["part", "uri", "docs", "tokens"],
            )

    return ids.mapInArrow(write, "part long, uri string, docs long, tokens long")


def write_corpus(docs: DataFrame, path: str, folder: str, end_id: int = 1) -> tuple[list, np.ndarray]:
    """Write ``docs`` below ``folder``; the manifest in file order, and the ids by rank.

    The manifest has one entry for each file, some hundred thousand at the most; it is kept beside the files.
    """
    spark = docs.sparkSession
    staging = work_dir(spark, "ids")
    ids = written(token_ids(docs, path, end_id), staging)
    ranks = frequency_ranks(ids, path)
    kind = id_kind(path)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = ids.repartitionByRange(parts, "doc_id", "salt").sortWithinPartitions("doc_id", "salt")
    manifest = sorted((r.part, r.uri, r.docs, r.tokens) for r in write_files(ordered.select("doc_id", "ids"), ranks, kind, folder).collect())
    remove(spark, staging)
    by_rank = np.empty(len(ranks), "<u4")
    by_rank[ranks] = np.arange(len(ranks), dtype="<u4")
    spark.createDataFrame(manifest or [], "part long, uri string, docs long, tokens long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    spark.createDataFrame([(by_rank.tobytes(),)], "by_rank binary").coalesce(1).write.mode("overwrite").parquet(f"{folder}/ranks")
    return manifest, by_rank


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, in parallel by file."""
    files = spark.read.parquet(f"{folder}/manifest").orderBy("part").collect()
    by_rank = spark.sparkContext.broadcast(np.frombuffer(bytes(spark.read.parquet(f"{folder}/ranks").first()[0]), "<u4"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    at, rows = 0, []
    for f in files:
        rows.append((f.uri, at))
        at += f.tokens

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out: list[list] = []
                for ids, counts, numbers in read_blocks(uri):
                    raw, p = memoryview(by_rank.value[numbers].tobytes()), 0
                    for d, c in zip(ids, counts.tolist()):
                        n = c & ~GOES_ON
                        part = raw[4 * p : 4 * (p + n)]
                        p += n
                        if c & GOES_ON:
                            out[-1][2:] = [out[-1][2] + n, zlib.crc32(part, out[-1][3])]
                        else:
                            out.append([d, start, n, zlib.crc32(part)])
                        start += n
                    if len(out) > 10_000:
                        yield _rows(out[:-1])
                        out = out[-1:]
                yield _rows(out)

    def _rows(out):
        return pa.record_batch([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.createDataFrame(rows, "uri string, start long").repartition(len(rows)).mapInArrow(read, schema)
