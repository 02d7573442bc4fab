"""Texts to tokens, lines and k-grams.

A text is a file. Tokens are words or single marks; in a comparison a number may stand for any number and a
word for any word. Hash keys stand for long token runs in joins: two independent hashes, so that rows stay
narrow and no token text goes through a self-join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidewrack.functions.arrow import bound_batches
from tidewrack.operators import texthash

TOKEN = r"([\p{L}\p{N}_]+|[^\s\p{L}\p{N}_])"
WORD = r"^[\p{L}_][\p{L}\p{N}_]*$"


def token_array(text: Column, lexeme: str = TOKEN) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(lexeme), F.lit(1))


def normalized(token: Column, ignore_literals: bool = True, ignore_identifiers: bool = False) -> Column:
    """``<NUM>`` for numbers, ``<ID>`` for words, if so asked; else the lexeme."""
    out = token
    if ignore_identifiers:
        out = F.when(token.rlike(WORD), F.lit("<ID>")).otherwise(out)
    if ignore_literals:
        out = F.when(token.rlike("^[0-9]+$"), F.lit("<NUM>")).otherwise(out)
    return out


def line_array(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def token_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_lines)."""
    return docs.select(
        "doc_id",
        F.size(token_array(F.col("text"))).cast("long").alias("n_tokens"),
        F.size(line_array(F.col("text"))).cast("long").alias("n_lines"),
    )


def tokens(docs: DataFrame, ignore_literals: bool = True, ignore_identifiers: bool = False) -> DataFrame:
    """(doc_id, pos, line, norm, orig), a row for each token; pos and line from 0."""
    # a token lies in one line, and its position is that of the line's first token and its place there
    lines = docs.select("doc_id", F.posexplode(line_array(F.col("text"))).alias("line", "s")).withColumn("t", token_array(F.col("s")))
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.select("doc_id", "line", "t", F.coalesce(F.sum(F.size("t")).over(before), F.lit(0)).cast("int").alias("first"))
    placed = lines.select("doc_id", "line", "first", F.posexplode("t").alias("k", "orig")).withColumn("pos", F.col("first") + F.col("k"))
    return placed.select("doc_id", "pos", "line", normalized(F.col("orig"), ignore_literals, ignore_identifiers).alias("norm"), "orig")


def line_starts(docs: DataFrame) -> DataFrame:
    """(doc_id, line, first, n): the position of each line's first token, and how many it has."""
    edges = texthash.word_edges(docs.sparkSession)
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in texthash.chunks(b.column(1).to_pylist()):
                text, *numbers = texthash.Tokens(texts, edges).lines()
                yield pa.record_batch([b.column(0).take(pa.array(text + at)), *(pa.array(x.astype("i4")) for x in numbers)], ["doc_id", "line", "first", "n"])

    rows = docs.select("doc_id", F.col("text").cast("string"))
    return rows.mapInArrow(run, StructType([rows.schema[0], *(StructField(c, IntegerType()) for c in ("line", "first", "n"))]))


def norm_kind_counts(docs: DataFrame, ignore_identifiers: bool = False) -> DataFrame:
    """(norm_kind, n): tokens by what they are compared as."""
    t = docs.select(F.explode(token_array(F.col("text"))).alias("t"))
    norm = normalized(F.col("t"), True, ignore_identifiers)
    kind = F.when(norm.isin("<NUM>", "<ID>"), norm).when(F.col("t").rlike(WORD), F.lit("word")).otherwise(F.lit("mark"))
    return t.groupBy(kind.alias("norm_kind")).agg(F.count("*").alias("n"))


def _window_hashes(rows: DataFrame, name: str, k: int) -> DataFrame:
    """Column ``name``, an array of hashes, made the hashes of its windows of ``k``.

    Windows of 1, 2, 4, ... are joined by pairs, so a window costs log k steps, not k. Each step is a column of
    its own: inlined into the next, it would be computed twice.
    """
    out, width, rest = None, 1, k
    here = name
    while rest:
        if rest & 1:
            out = (here, width) if out is None else _joined(rows, here, width, *out)
            if len(out) == 3:
                rows, out = out[0], out[1:]
        rest >>= 1
        if rest:
            rows, here, width = _joined(rows, here, width, here, width)
    return rows.withColumn(name, F.col(out[0]))


def _joined(rows: DataFrame, a: str, width_a: int, b: str, width_b: int) -> tuple[DataFrame, str, int]:
    """The hashes of each window of ``a`` and the window of ``b`` right after it."""
    n = F.greatest(F.size(b) - width_a, F.lit(0))
    name = f"_{a}_{b}_{width_a + width_b}"[-60:]
    pair = F.zip_with(F.slice(a, 1, n), F.slice(b, width_a + 1, n), lambda x, y: F.xxhash64(x, y))
    return rows.withColumn(name, pair), name, width_a + width_b


def kgrams(docs: DataFrame, k: int, key: str = "doc_id", ignore_literals: bool = True) -> DataFrame:
    """(key, pos, h1, h2) of every full window of ``k`` tokens; texts under ``k`` tokens give none.

    Two hashes of 64 bits from different hashes of the tokens stand for the window.
    """
    norm = F.transform(token_array(F.col("text")), lambda t: normalized(t, ignore_literals))
    return array_kgrams(docs.select(F.col(key), norm.alias("_t")), k, key)


def array_kgrams(rows: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """The k-grams of ``rows`` (key, _t), texts as arrays of compared tokens."""
    rows = rows.where(F.size("_t") >= k)
    rows = rows.withColumn("h1", F.transform("_t", lambda t: F.xxhash64(t))).withColumn("h2", F.transform("_t", lambda t: F.xxhash64(F.lit("2"), t)))
    for name in ("h1", "h2"):
        rows = _window_hashes(rows, name, k)
    rows = rows.select(key, F.posexplode(F.arrays_zip("h1", "h2")).alias("pos", "w"))
    return rows.select(key, "pos", "w.h1", "w.h2")


def bucket_sizes(grams: DataFrame) -> DataFrame:
    """(bucket_size, n_buckets): how many k-grams occur how often."""
    return (
        grams.groupBy("h1", "h2").agg(F.count("*").alias("bucket_size")).groupBy("bucket_size").agg(F.count("*").alias("n_buckets"))
    )
