"""Benchmark decontamination by spaced seeds.

A spaced seed is a fixed mask over consecutive words: the words at its chosen places are hashed, those between
are ignored. Two passages of which a few words differ still share the seeds whose ignored places fall on the
differences. The seeds of test items and documents are joined; each hit fixes how an item would lie in a document,
and the words around it are compared in place. A document holds an item if in some window of ``window`` words of
the item (the whole item, if it is shorter) at least ``similarity`` of the words agree: also half of a long item is
found.

Items under ``SEED_WORDS`` words are held where all their words follow one another; items without a word take no
part. The masks find every window of which a fifth of the words or less differ, as tests show by trying all of
them up to 20 words; a longer window holds parts of 12 to 20 words of which that is true.

Documents are read once, whatever the benchmark's size. A table of ``1 << filter_bits`` bits, set by the items'
seeds, is all that tasks hold of the benchmark: it only spares the join seeds that no item has, and a fuller
table spares fewer. What passes is joined with the items' seeds; these and the items, the small side, are there for
each of ``SALTS`` salts, so that a seed or an item which much of the corpus has is dealt to several tasks.

Null and empty texts hold nothing. Equal texts are compared once; each of their rows gives a row. Equal items of one
item_id count once. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.arrow import bound_batches
from tidewrack.llm.wordhash import document_words, mixed, words_of
from tidewrack.plans.lineage import cut

SEED_WORDS = 5
#: Places of the words that count. With four of five words equal, at any places, some mask fits somewhere: the
#: first family for items of ``LONG`` words or more, the second for shorter ones.
LONG = 12
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 3, 5), (0, 2, 3, 5, 7), (0, 1, 4, 6, 9))
SHORT_MASKS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 2, 3, 4), (0, 1, 3, 4), (0, 1, 3, 5))
#: Items under ``SEED_WORDS`` words, by their number of words: all count.
WHOLE_MASKS = tuple(tuple(range(n)) for n in range(1, SEED_WORDS))
ALL_MASKS = MASKS + SHORT_MASKS + WHOLE_MASKS
STEPS = [mixed(np.arange(1, len(p) + 1, dtype=np.uint64) + np.uint64(100 * m)) | np.uint64(1) for m, p in enumerate(ALL_MASKS)]


def seeds(words: np.ndarray, mask: int) -> np.ndarray:
    """The seed's hash at each start place."""
    places = ALL_MASKS[mask]
    n = len(words) - places[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for p, step in zip(places, STEPS[mask]):
        out += words[p : p + n] * step
    return mixed(out)


def masks_of(n_words: int) -> range:
    """The masks that an item of so many words is indexed by."""
    if n_words >= LONG:
        return range(len(MASKS))
    whole = len(MASKS) + len(SHORT_MASKS)
    return range(len(MASKS), whole) if n_words >= SEED_WORDS else range(whole + n_words - 1, whole + n_words)


WINDOW, SALTS = 50, 8
#: Bytes of a bitmap of Spark's aggregate, and digests that are broadcast, at the most.
BITMAP, FEW = 4096, 1 << 20


def _salted(small: DataFrame) -> DataFrame:
    return small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def items_of(bench: DataFrame) -> DataFrame:
    """(item, item_id, n, words) of the items with a word; ``item`` numbers them."""

    @F.pandas_udf("binary")
    def words(texts: pd.Series) -> pd.Series:
        return pd.Series([words_of(t).tobytes() for t in texts], dtype=object)

    rows = bench.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text").cast("string")).alias("words"))
    rows = rows.where("length(words) > 0").distinct()
    return cut(rows.select(F.monotonically_increasing_id().alias("item"), "item_id", (F.length("words") / 8).cast("int").alias("n"), "words"))


def item_seeds(items: DataFrame) -> DataFrame:
    """(h, mask, item, at, n): the seeds of the items by every mask that is theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, raw in zip(b.column(0).to_pylist(), b.column(1)):
                words = np.frombuffer(raw.as_buffer(), "<u8")
                for m in masks_of(len(words)):
                    h = seeds(words, m)
                    cols = [h.view("i8"), np.full(len(h), m, "i4"), np.full(len(h), item), np.arange(len(h), dtype="i4"), np.full(len(h), len(words), "i4")]
                    yield pa.record_batch([pa.array(c) for c in cols], ["h", "mask", "item", "at", "n"])

    return items.select("item", "words").mapInArrow(run, "h long, mask int, item long, at int, n int")


def seed_filter(of: DataFrame, bits: int) -> np.ndarray:
    """A table of ``1 << bits`` bits with two set for each seed, of that size whatever the number of seeds."""
    places = F.array(F.shiftrightunsigned("h", 64 - bits), F.col("h").bitwiseAND((1 << bits) - 1))
    rows = of.select(F.explode(places).alias("x")).select((F.col("x") + 1).alias("x"))
    maps = rows.groupBy(F.bitmap_bucket_number("x").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("m"))
    table = np.zeros((1 << bits) // 8, "u1")
    for r in maps.toLocalIterator():
        m = np.frombuffer(bytes(r.m), "u1")
        at = (r.b - 1) * BITMAP
        table[at : at + BITMAP] = m[: len(table) - at]
    return table


def may_hold(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of ``h`` whose two bits are set."""
    low = np.uint64(len(table) * 8 - 1)
    out = np.arange(len(h))
    for slot in (h >> np.uint64(64 - int(low).bit_length()), h & low):
        x = slot[out]
        out = out[(table[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype("u1")) & 1 == 1]
    return out


def best_window(same: np.ndarray, window: int) -> tuple[int, int]:
    """(most agreeing words in ``window`` places of an item, place of the first of them)."""
    at = np.flatnonzero(same)
    if not len(at):
        return 0, 0
    n = np.searchsorted(at, at + window) - np.arange(len(at))
    k = int(n.argmax())
    return int(n[k]), int(at[k])


def _found(docs: DataFrame, bench: DataFrame, similarity: float, window: int, filter_bits: int) -> tuple[DataFrame, DataFrame]:
    """(rows (doc_id, d) that pass the filter, held (d, item_id, n_same, n_window, start_word)) by the texts' digests d."""
    spark = docs.sparkSession
    bound_batches(spark)
    items = items_of(bench)
    of = cut(item_seeds(items))
    used = [r.mask for r in of.select("mask").distinct().collect()]  # as many as there are masks
    held = spark.sparkContext.broadcast(seed_filter(of, filter_bits))  # of that many bits
    whole = len(MASKS) + len(SHORT_MASKS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = b.column(1).to_pylist(), []
            for row, words in document_words(texts):
                hs, ps = [], []
                for m in used:
                    s = seeds(words, m)
                    p = may_hold(held.value, s)
                    if m >= whole and len(p):
                        p = p[np.unique(s[p], return_index=True)[1]]  # a few words may be frequent: their first place is enough
                    hs.append(s[p])
                    ps.append(p)
                h = np.concatenate([np.zeros(0, np.uint64), *hs])
                if len(h):
                    digest = hashlib.sha256(texts[row].encode()).digest()[:16]
                    out.append((b.column(0)[row].as_py(), digest, words.tobytes(), h.view("i8"), np.concatenate(ps).astype("i4")))
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["doc_id", "d", "words", "h", "p"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = cut(rows.mapInArrow(scan, "doc_id long, d binary, words binary, h array<long>, p array<int>"))
    hits = scanned.select("d", F.explode(F.arrays_zip("h", "p")).alias("x")).select("d", "x.h", "x.p").distinct()
    hits = hits.withColumn("salt", F.pmod(F.xxhash64("d", "p"), F.lit(SALTS)).cast("int"))
    places = hits.join(_salted(of.drop("mask")), ["h", "salt"]).select("d", "item", "n", (F.col("p") - F.col("at")).alias("start")).distinct()
    texts = scanned.select("d", "words").dropDuplicates(["d"])
    first, last = F.greatest("start", F.lit(0)), F.least(F.col("start") + F.col("n"), (F.length("words") / 8).cast("int"))
    part = F.expr("substring(words, 8 * greatest(start, 0) + 1, 8 * (least(start + n, cast(length(words) / 8 as int)) - greatest(start, 0)))")
    laid = places.join(texts, "d").where(last > first).select("d", "item", "start", part.alias("part"))
    laid = laid.withColumn("salt", F.pmod(F.xxhash64("d", "start"), F.lit(SALTS)).cast("int"))
    both = laid.join(_salted(items), ["item", "salt"]).select("d", "item", "item_id", "start", "part", "words")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, (start, part, words) in enumerate(zip(b.column(3).to_pylist(), b.column(4), b.column(5))):
                words, part = np.frombuffer(words.as_buffer(), "<u8"), np.frombuffer(part.as_buffer(), "<u8")
                same = np.zeros(len(words), bool)
                same[max(0, -start) : max(0, -start) + len(part)] = words[max(0, -start) : max(0, -start) + len(part)] == part
                n, at = best_window(same, window)
                of = min(window, len(words))
                if n >= (similarity * of if len(words) >= SEED_WORDS else of):
                    out.append((k, n, of, start + at))
            cols = list(zip(*out)) if out else [[]] * 4
            taken = pa.array(list(cols[0]), pa.int64())
            yield pa.record_batch([*(b.column(c).take(taken) for c in (0, 1, 2)), *(pa.array(list(c), pa.int64()) for c in cols[1:])], ["d", "item", "item_id", "n_same", "n_window", "start_word"])

    fits = both.mapInArrow(compare, "d binary, item long, item_id long, n_same long, n_window long, start_word long")
    best = fits.groupBy("d", "item").agg(F.min(F.struct((-F.col("n_same")).alias("m"), "start_word", "n_window", "item_id")).alias("x"))
    return scanned.select("doc_id", "d"), best.select("d", "x.item_id", (-F.col("x.m")).alias("n_same"), "x.n_window", "x.start_word")


def contaminated(docs: DataFrame, bench: DataFrame, similarity: float = 0.8, window: int = WINDOW, filter_bits: int = 26) -> DataFrame:
    """(doc_id, item_id, n_same, n_window, similarity, start_word): the items that each row's text holds.

    ``n_same`` words agree of the ``n_window`` of the best window, the first of them at the text's word ``start_word``;
    ties go to the earliest.
    """
    rows, held = _found(docs, bench, similarity, window, filter_bits)
    out = rows.join(held, "d").withColumn("similarity", F.col("n_same") / F.col("n_window"))
    return out.select("doc_id", "item_id", "n_same", "n_window", "similarity", "start_word")


def without_contaminated(docs: DataFrame, bench: DataFrame, similarity: float = 0.8, window: int = WINDOW, filter_bits: int = 26) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; rows without doc_id are judged by text too.

    Digests of held texts are broadcast up to a counted ``FEW``; beyond that rows and digests are joined by a shuffle.
    """
    _, held = _found(docs, bench, similarity, window, filter_bits)
    held = cut(held.select(F.col("d").alias("_")).distinct())
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(F.unhex(F.substring(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256), 1, 32)).alias("d"), *(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)))
    few = F.broadcast(held) if held.count() <= FEW else held
    kept = rows.join(few, rows.d == F.col("_"), "left_anti")
    return kept.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names)))


#: The same in SQL for scripts with spaces: all places of all items by the words they share.
ORACLE_SQL = rf"""
WITH dw AS (SELECT r, doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents)),
it AS (SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
iw AS (SELECT item_id, md5(array_to_string(w, ' ')) AS i, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS p FROM it),
same AS (SELECT r, doc_id, item_id, i, n, dw.p - iw.p AS start, iw.p AS ip FROM dw JOIN iw USING (word)),
wide AS (SELECT r, i, item_id, start FROM same GROUP BY ALL HAVING count(*) >= least(any_value(n), {WINDOW}) * 0.8),
win AS (SELECT r, doc_id, item_id, i, n, start, ip, count(*) OVER (PARTITION BY r, item_id, i, start ORDER BY ip RANGE BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS m FROM same JOIN wide USING (r, i, item_id, start)),
best AS (SELECT r, any_value(doc_id) AS doc_id, item_id, least(any_value(n), {WINDOW}) AS n_window, max(m) AS n_same, arg_min(start + ip, (-m, start + ip)) AS start_word, any_value(n) AS n FROM win GROUP BY r, item_id, i)
SELECT doc_id, item_id, CAST(n_same AS BIGINT) AS n_same, CAST(n_window AS BIGINT) AS n_window, n_same / n_window AS similarity, CAST(start_word AS BIGINT) AS start_word
FROM best WHERE n_same >= n_window * CASE WHEN n < {SEED_WORDS} THEN 1.0 ELSE 0.8 END"""
