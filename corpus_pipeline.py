"""A corpus pipeline: quality, near-duplicates, benchmark passages, secrets, tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewrack.llm import bytebpe, decontaminate, quality, secrets, simhash
from tidewrack.llm.queries import piece_pattern, tokenizer_file
from tidewrack.plans.lineage import remove, work_dir
from tidewrack.session import table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates; links are verified by shingles."""
    return simhash.keep_first(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redacted_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced."""
    return secrets.redact(docs)


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and the digest of the decoded ids of all documents."""
    return bytebpe.encode(docs, tokenizer_file("byte_bpe_50k.tiktoken"), piece_pattern(), digests=True)


STAGES = [
    ("quality classifier", good_documents),
    ("SimHash near-dedup", distinct_documents),
    ("benchmark decontamination", clean_documents),
    ("secret scans", redacted_documents),
    ("byte-level BPE", encoded_documents),
]

#: Not in SQL: the classifier, the fingerprints and the tokenizer aren't; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = work_dir(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
