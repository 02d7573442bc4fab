"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits. Every bit position gets a non-zero vector of r + 1 bits; the table of a non-zero
vector v keeps the positions whose vector has an odd inner product with v. Any r differing positions span at
most r dimensions, so some v is orthogonal to all of them, and in its table the two fingerprints collide: with
2^(r+1) - 1 tables every pair within r bits meets, without exception.

Only distinct fingerprints are compared, and only connectivity is wanted, so a bucket isn't expanded into its
pairs: first each member links to its bucket's smallest one, and components are formed; then only buckets that
still hold several components are compared exactly, across components. Buckets above ``split_at`` members are
split once more by a second covering family over the positions that the first table left out, which again
keeps every pair within r bits together.

Null and empty texts have fingerprint zero and link like any other; a document with fewer words than a shingle
hashes its whole word sequence. Equal rows share a component; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.arrow import bound_batches
from tidewrack.llm.wordhash import document_words, mixed
from tidewrack.operators.matching import _bit_table
from tidewrack.plans.components import connected_components
from tidewrack.plans.lineage import cut, drop, release

#: Shingles that are hashed and counted at a time.
BLOCK = 1 << 16


def fingerprint_of(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The unsigned fingerprint: a bit is 1 if set in over half of the shingles' hashes, repeats included."""
    w = (text or "").encode().lower().split()  # of bytes: only A-Z change, and only ASCII white space parts
    if not w:
        return 0
    n, ones = max(1, len(w) - words + 1), np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, BLOCK):
        h = np.fromiter((digest(join(w[i : i + words]), seed) for i in range(at, min(n, at + BLOCK))), "<u8")
        ones += _ones(h)
    return int(_majority(ones, n))


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> np.uint64:
    return np.packbits((2 * ones > n).astype("u1"), bitorder="little").view("<u8")[0]


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp long) of every row; fp is the fingerprint's two's complement."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t, words) for t in texts], "u8").view("i8"))

    return docs.select("doc_id", fp("text").alias("fp"))


def covering_masks(radius: int, shift: int = 1) -> list[int]:
    """The signed 64-bit masks of the 2^(radius+1) - 1 tables; ``shift`` deals the vectors out otherwise."""
    n = (1 << (radius + 1)) - 1
    vectors = [1 + (i * shift) % n for i in range(64)]
    masks = [sum(1 << i for i, x in enumerate(vectors) if bin(x & v).count("1") & 1) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _tables(masks: list[int], fp: Column, under: Column | None = None) -> Column:
    """array<struct(t, k)>: the key of ``fp`` in each table."""
    keys = (F.lit(m) if under is None else F.lit(m).bitwiseOR(under) for m in masks)
    return F.array(*(F.struct(F.lit(t).alias("t"), fp.bitwiseAND(m).alias("k")) for t, m in enumerate(keys)))


def _near(a: str, b: str, radius: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius


def near_components(prints: DataFrame, radius: int = 4, split_at: int = 256) -> DataFrame:
    """(v, component) of the distinct values v of ``prints.fp`` that have a near other; component is a label."""
    masks = covering_masks(radius)
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fps = cut(prints.select("fp").distinct().repartition(parts, "fp"))  # they are about to become one row for each table
    key = ["t", "k"]
    rows = fps.select("fp", F.explode(_tables(masks, F.col("fp"))).alias("x")).select("x.t", "x.k", "fp")
    full = rows.groupBy(*key).agg(F.min("fp").alias("pivot"), F.count("*").alias("members")).where("members > 1")
    rows = cut(rows.join(full, key).select(*key, "fp", "pivot", "members"), fps)
    star = rows.where((F.col("fp") != F.col("pivot")) & _near("fp", "pivot", radius)).select(F.col("fp").alias("a"), F.col("pivot").alias("b"))
    label = connected_components(star, "a", "b").select(F.col("node").alias("v"), "component")

    named = rows.join(label, rows.fp == label.v, "left").select(*key, "fp", "members", F.coalesce("component", "fp").alias("c"))
    mixed = named.groupBy(*key).agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select(*key)
    rows = cut(named.join(mixed, key), rows)
    mask_of = F.element_at(F.array(*map(F.lit, masks)), F.col("t") + 1)
    fine = F.when(F.col("members") > split_at, _tables(covering_masks(radius, shift=7), F.col("fp"), mask_of)).otherwise(
        F.array(F.struct(F.lit(-1).alias("t"), F.lit(0).cast("long").alias("k")))
    )
    split = rows.select(*key, "fp", "c", F.explode(fine).alias("x")).select(*key, F.col("x.t").alias("t2"), F.col("x.k").alias("k2"), "fp", "c")
    other = split.select(*key, "t2", "k2", F.col("fp").alias("fp2"), F.col("c").alias("c2"))
    pairs = split.join(other, [*key, "t2", "k2"]).where((F.col("c") < F.col("c2")) & _near("fp", "fp2", radius))
    between = connected_components(pairs.select("c", "c2").distinct(), "c", "c2").withColumnRenamed("component", "last")

    # a fingerprint is touched by a star, or stands alone and is touched by an exact pair
    joined = label.join(between, label.component == between.node, "left").select("v", F.coalesce("last", "component").alias("component"))
    single = between.join(label, between.node == label.v, "left_anti")
    return joined.union(single.select(F.col("node").alias("v"), F.col("last").alias("component")))


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4) -> DataFrame:
    """(doc_id, fingerprint hex, component_id) of every row; component_id is the smallest doc_id reachable."""
    prints = cut(fingerprints(docs, words))
    low = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    label = low.join(near_components(prints, radius).withColumnRenamed("v", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("c"))
    least = label.groupBy("c").agg(F.min("low").alias("component_id"))
    of = label.join(least, "c").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# near texts: links by the shingles themselves, found by fingerprints and by the rarest shingles

#: Seed of the fingerprint over distinct words, and the words of a shingle.
SEED, SHINGLE = 1, 5
#: A table of fixed size counts the shingles by the first bits of their hashes, in blocks; a text's digest has so many bits.
CELL_BITS, BLOCK_BITS, DIGEST_BITS = 20, 14, 512


def word_fingerprint(words: np.ndarray) -> int:
    """The signed fingerprint over the distinct words."""
    words = np.unique(words)
    ones = sum(_ones(mixed(words[at : at + BLOCK] ^ SALTS[SEED])) for at in range(0, len(words), BLOCK))
    return int(_majority(ones, len(words)).view("i8"))


SALTS = mixed(np.arange(1, 1 << 8, dtype=np.uint64))


def shingle_set(words: np.ndarray) -> np.ndarray:
    """The distinct signed hashes of all runs of ``SHINGLE`` words; fewer words are one shingle."""
    n = max(1, len(words) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        out += words[k : k + n] * SALTS[100 + k]
    return np.unique(mixed(out)).view("i8")


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles.view("u8") >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def shingle_counts(texts: DataFrame) -> np.ndarray:
    """How many shingles of all rows of ``texts`` (_t) each cell has; the table has one size for any input."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(1 << CELL_BITS, np.int64)
        for p in parts:
            sets = [shingle_set(words) for _, words in document_words(p["_t"].tolist()) if len(words)]
            if sets:
                held += np.bincount(_cells(np.concatenate(sets)), minlength=1 << CELL_BITS)
        for b, x in enumerate(held.reshape(-1, 1 << BLOCK_BITS)):
            at = np.flatnonzero(x)
            if len(at):
                yield pd.DataFrame({"block": [b], "at": [at.astype("<u2").tobytes()], "n": [x[at].astype("<u4").tobytes()]})

    def total(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for p in parts:
            for b, at, n in zip(p["block"], p["at"], p["n"]):
                held.setdefault(b, np.zeros(1 << BLOCK_BITS, np.int64))[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<u4")
        for b, x in held.items():
            yield pd.DataFrame({"block": [b], "n": [np.minimum(x, (1 << 32) - 1).astype("<u4").tobytes()]})

    blocks = texts.select("_t").mapInPandas(count, "block int, at binary, n binary").repartition("block").mapInPandas(total, "block int, n binary")
    out = np.zeros((1 << CELL_BITS - BLOCK_BITS, 1 << BLOCK_BITS), "<u4")
    for b, n in blocks.toLocalIterator():  # at most 64 rows of 64 KB
        out[b] = np.frombuffer(n, "<u4")
    return out.reshape(-1)


def prefix_length(n: int, share: float) -> int:
    """How many of ``n`` ordered elements hold one of any ``share`` of them."""
    return n - math.ceil(n * share - 1e-9) + 1


def near_texts(docs: DataFrame, similarity: float = 0.8, radius: int = 4, split_at: int = 256) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, nodes, label) of ``docs`` by their texts.

    ``rows`` are the input's: _d, the text's digest, _m, all other columns that have an order, _h, a hash of _m, _t,
    the text, and _r, the whole row. ``nodes``: a row (id, d, m, h, ...) for each distinct text, m the least _m; ``label``
    (id, c): the texts that are linked to others, and their component. Two texts are linked if, and only if, ``similarity``
    of their shingles of five words are common; texts without a word are linked to equal ones only.

    Texts whose SimHash fingerprints over the distinct words are linked within ``radius`` are compared with one of them.
    No link depends on that: all shingles have one order, rare ones first, and texts that have ``similarity`` in
    common share one of their first ones, in 1 - ``similarity`` of the longer and (1 - ``similarity``) / (1 + ``similarity``) of the
    shorter. Texts that share a first shingle are compared with the one that has it nearest to its front; where several
    components share one after that, all pairs across components whose lengths and places allow it are.

    The order goes by a table of counts of fixed size. It decides how many candidates there are, not which links.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    text = F.col("text").cast("string")
    kinds = {f.name: f.dataType.typeName() for f in docs.schema}
    by = [c for c in docs.columns if c not in ("doc_id", "text") and kinds[c] not in ("map", "variant")]
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("text").isNull().alias("t"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(by)))
    whole = F.struct(*(F.col(f"`{c}`").alias(f"r{i}") for i, c in enumerate(docs.columns)))
    rows = docs.select(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("_d"), order.alias("_m"), text.alias("_t"), whole.alias("_r")).withColumn("_h", F.xxhash64("_m"))
    both_share, apart_share = 2 * similarity / (1 + similarity), (1 - similarity) / (1 + similarity)
    counts = spark.sparkContext.broadcast(shingle_counts(rows))

    @F.pandas_udf("fp long, n int, bits array<long>, keys array<long>")
    def features(texts: pd.Series) -> pd.DataFrame:
        out: list = [(None, None, None, None)] * len(texts)
        for row, words in document_words(texts.tolist()):
            if len(words):
                s = shingle_set(words)
                keys = s[np.lexsort((s, counts.value[_cells(s)]))][: prefix_length(len(s), similarity)]
                odd = (np.bincount(s & (DIGEST_BITS - 1), minlength=DIGEST_BITS) & 1).astype("u1")
                out[row] = (word_fingerprint(words), len(s), np.packbits(odd, bitorder="little").view("<i8"), keys)
        return pd.DataFrame({c: pd.Series([x[i] for x in out], dtype=object) for i, c in enumerate(("fp", "n", "bits", "keys"))})

    @F.pandas_udf("array<long>")
    def shingles(texts: pd.Series) -> pd.Series:
        out: list = [None] * len(texts)
        for row, words in document_words(texts.tolist()):
            out[row] = shingle_set(words)
        return pd.Series(out, dtype=object)

    prints = rows.select("_d", "_m", features("_t").alias("f"))
    nodes = prints.groupBy("_d").agg(F.min("_m").alias("m"), F.first("f").alias("f"))
    nodes = cut(nodes.select(F.monotonically_increasing_id().alias("id"), F.col("_d").alias("d"), "m", F.xxhash64("m").alias("h"), "f.*"))

    def linked(pairs: DataFrame) -> DataFrame:
        """Of pairs (x, y) those that have shingles enough in common."""
        brief = {s: nodes.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("bits").alias(f"b{s}")) for s in "xy"}
        # of bits that say whether a number is odd at least so many shingles are in one text only
        apart = sum((F.bit_count(F.col("bx")[i].bitwiseXOR(F.col("by")[i])) for i in range(DIGEST_BITS // 64)), F.lit(0))
        close = pairs.distinct().join(brief["x"], "x").join(brief["y"], "y").where(apart <= apart_share * (F.col("nx") + F.col("ny")) + 1e-6)
        pairs = cut(close.select("x", "y"))
        release(spark)
        ids = pairs.select("x").union(pairs.select("y")).distinct()
        wanted = nodes.join(ids, nodes.id == ids.x, "left_semi").select("id", "d", "h")
        texts = rows.select("_d", "_h", "_t").join(wanted, (F.col("_d") == F.col("d")) & (F.col("_h") == F.col("h")))
        sets = cut(texts.dropDuplicates(["_d", "_h"]).select("id", shingles("_t").alias("s")))  # by what they were joined by: no text moves again
        release(spark)
        both = pairs.join(sets.withColumnRenamed("id", "x").withColumnRenamed("s", "sx"), "x").join(sets.withColumnRenamed("id", "y").withColumnRenamed("s", "sy"), "y")
        common = F.size(F.array_intersect("sx", "sy"))
        enough = common >= similarity * (F.size("sx") + F.size("sy") - common)
        out = cut(both.where(enough).select("x", "y"), pairs, sets)
        release(spark)
        return out

    release(spark)

    # texts of one component by fingerprints, with one of them
    prints = nodes.where("fp is not null").select("id", "fp")
    alike = near_components(prints, radius, split_at)
    group = prints.join(alike, prints.fp == alike.v, "left").select("id", F.coalesce("component", "fp").alias("g"))
    lead = group.groupBy("g").agg(F.min("id").alias("y"), F.count("*").alias("members")).where("members > 1")
    by_print = group.join(lead, "g").where("id <> y").select(F.col("y").alias("x"), F.col("id").alias("y"))

    # texts that share one of their first shingles, with the one that has it nearest to its front
    several = nodes.select(F.explode("keys").alias("m")).groupBy("m").agg(F.count("*").alias("members")).where("members > 1").select("m")
    several = cut(several)
    held = spark.sparkContext.broadcast(_bit_table(several, several.count()))
    drop(several)
    release(spark)

    @F.pandas_udf("array<int>")
    def shared(keys: pd.Series) -> pd.Series:
        """Places of the keys that may be another text's too: the table has a bit of each that is."""
        table, out = held.value, []
        for k in keys:
            bit = np.asarray(k, "i8") & (8 * len(table) - 1)
            out.append(np.flatnonzero(table[bit >> 3] >> (bit & 7).astype("u1") & 1).astype("i4"))
        return pd.Series(out, dtype=object)

    member = nodes.where("n is not null").select("id", "n", "keys", F.explode(shared("keys")).alias("pos")).select("id", "n", "pos", F.col("keys")[F.col("pos")].alias("b"))
    member = cut(member)
    member = cut(member.join(member.groupBy("b").agg(F.count("*").alias("members")).where("members > 1").select("b"), "b"), member)
    release(spark)
    pivot = member.groupBy("b").agg(F.min_by("id", F.struct("pos", F.xxhash64("id"))).alias("pid"), F.min_by("n", F.struct("pos", F.xxhash64("id"))).alias("pn"))
    fits = F.least("n", "pn") >= similarity * F.greatest("n", "pn") - 1e-6
    star = member.join(pivot, "b").where((F.col("id") != F.col("pid")) & fits).select(F.least("id", "pid").alias("x"), F.greatest("id", "pid").alias("y"))
    links = linked(by_print.union(star))

    # where several components share one, all pairs across them
    label = connected_components(links, "x", "y").select(F.col("node").alias("id"), "component")
    named = member.join(label, "id", "left").select("b", "id", "n", "pos", F.coalesce("component", "id").alias("c"))
    mixed = named.groupBy("b").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("b")
    rest = cut(named.join(mixed, "b"), member)
    release(spark)
    short = rest.where(F.col("pos") < F.col("n") - F.ceil(F.col("n") * both_share - 1e-9) + 1)
    short = short.select("b", F.col("id").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"), F.col("c").alias("cy"))
    longer = (F.col("n") > F.col("ny")) | ((F.col("n") == F.col("ny")) & (F.col("id") > F.col("y")))
    # the shingles behind the first common one are all that can be common, with it
    room = F.least(F.col("n") - F.col("pos"), F.col("ny") - F.col("py")) >= both_share / 2 * (F.col("n") + F.col("ny")) - 1e-6
    pairs = rest.join(short, "b").where((F.col("c") != F.col("cy")) & longer & (F.col("ny") >= similarity * F.col("n") - 1e-6) & room)
    across = linked(pairs.select(F.least("id", "y").alias("x"), F.greatest("id", "y").alias("y")))
    label = connected_components(links.union(across), "x", "y").select(F.col("node").alias("id"), F.col("component").alias("c"))
    return rows, nodes, label


def keep_first(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near texts, any number of columns, their names free.

    Of a group the row with the smallest doc_id stays, rows without one last; of rows with one doc_id that with a text
    that isn't null, then that with the least other columns in their order, then that with the least digest of the text. Columns without an order (maps) decide
    nothing: of rows that differ in nothing else any one stays. A null text is an empty one. Rows that share a doc_id, or
    have none, are different documents if their texts are.
    """
    rows, nodes, label = near_texts(docs, similarity)
    of = nodes.join(label, "id", "left").groupBy(F.coalesce("c", F.col("id")).alias("c"))
    first = of.agg(F.min(F.struct("m", "d")).alias("x")).select("x.m", "x.d", F.xxhash64("x.m").alias("h"))
    # dealt by digest and hash alone, as duplicates are dropped by these: no row moves twice
    same = (F.col("_d") == F.col("d")) & (F.col("_h") == F.col("h")) & F.col("_m").between(F.col("m"), F.col("m"))
    kept = rows.join(first, same, "left_semi").dropDuplicates(["_d", "_h"])
    return kept.select(*(F.col(f"_r.r{i}").alias(c) for i, c in enumerate(docs.columns)))
