"""Units of statements, MinHash signatures, band joins and exact Jaccard similarity.

A unit is a text, its statements are its distinct non-empty lines; units of one statement have no signature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.operators.tokens import line_array

MODULUS = (1 << 31) - 1
BANDS, ROWS = 8, 2
#: Multipliers and offsets of the slots, by rule: powers of a generator modulo the prime.
COEFFICIENTS = [(pow(16807, 3 * i + 5, MODULUS), pow(48271, 2 * i + 3, MODULUS)) for i in range(BANDS * ROWS)]


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, lines): the distinct statements, for texts with two or more."""
    lines = F.array_distinct(F.filter(line_array(F.col("text")), lambda s: s != ""))
    return docs.select("doc_id", lines.alias("lines")).where(F.size("lines") >= 2)


def signatures(of: DataFrame) -> DataFrame:
    """(doc_id, sig array<bigint>): the least of (a x + b) mod p over the statements' hashes x, for each slot."""
    hashed = of.select("doc_id", F.transform("lines", lambda s: F.conv(F.substring(F.md5(s), 1, 7), 16, 10).cast("bigint")).alias("x"))

    def slot(a: int, b: int):
        return F.array_min(F.transform("x", lambda v: (v * F.lit(a) + F.lit(b)) % F.lit(MODULUS)))

    return hashed.select("doc_id", F.array(*(slot(a, b) for a, b in COEFFICIENTS)).alias("sig"))


def met(max_bucket: int | None) -> Column:
    """Whether ``size`` is two or more, and no more than ``max_bucket`` if there is one."""
    return F.col("size") >= 2 if max_bucket is None else F.col("size").between(2, max_bucket)


def candidate_pairs(sigs: DataFrame, max_bucket: int | None = 50) -> DataFrame:
    """(doc_a, doc_b): units that share a band's key, of buckets of two to ``max_bucket`` units, or of two or more."""
    keys = F.array(*(F.struct(F.lit(i).alias("band"), F.col("sig")[ROWS * i].alias("r0"), F.col("sig")[ROWS * i + 1].alias("r1")) for i in range(BANDS)))
    rows = sigs.select("doc_id", F.explode(keys).alias("x")).select("x.*", "doc_id")
    key = ["band", "r0", "r1"]
    sized = rows.groupBy(*key).agg(F.count("*").alias("size")).where(met(max_bucket))
    few = rows.join(sized, key)
    a, b = few.withColumnRenamed("doc_id", "doc_a"), few.withColumnRenamed("doc_id", "doc_b").drop("size")
    return a.join(b, key).where("doc_a < doc_b").select("doc_a", "doc_b").distinct()


def jaccard_pairs(pairs: DataFrame, of: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_a, doc_b, jaccard) of the pairs that are at least so similar; two empty sets are 1, one empty is 0."""
    hashed = of.select("doc_id", F.transform("lines", lambda s: F.md5(s)).alias("s"))
    both = _with(pairs, hashed, "s")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    union = F.size("s_a") + F.size("s_b") - shared
    score = F.when(union == 0, F.lit(1.0)).otherwise(shared / union)
    return both.select("doc_a", "doc_b", F.round(score, 6).alias("jaccard"), score.alias("_s")).where(F.col("_s") >= least).drop("_s")


def estimated_pairs(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """(doc_a, doc_b, est): the share of equal slots."""
    both = _with(pairs, sigs.withColumnRenamed("sig", "s"), "s")
    same = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda a, x: a + x)
    return both.select("doc_a", "doc_b", F.round(same / F.lit(float(BANDS * ROWS)), 6).alias("est"))


def _with(pairs: DataFrame, of: DataFrame, name: str) -> DataFrame:
    a = of.select(F.col("doc_id").alias("doc_a"), F.col(name).alias(f"{name}_a"))
    b = of.select(F.col("doc_id").alias("doc_b"), F.col(name).alias(f"{name}_b"))
    return pairs.join(a, "doc_a").join(b, "doc_b")
