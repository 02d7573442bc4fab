"""The registered queries of this subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewrack.llm import bytebpe, decontaminate, html, langid, neighbours, quality, secrets, shards, simhash, tokenfile
from tidewrack.plans.lineage import work_dir
from tidewrack.session import table


@functools.cache
def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def piece_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), piece_pattern())


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the compacted store holds; which of its files a row is in depends on the input's parts."""
    return shards.shard_documents(table(spark, sf_dir, "documents")).drop("shard", "version")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "tokens")
    tokenfile.write_corpus(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), folder)
    return tokenfile.read_corpus(spark, folder)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_decontamination, op3_byte_bpe, op4_html_extraction, op5_secret_scan,
        op6_sharding, op7_nearest_neighbours, op8_token_files, op9_simhash, op10_quality,
    )
}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": decontaminate.ORACLE_SQL, "op5_secret_scan": secrets.oracle_sql(), "op6_sharding": shards.ORACLE_SQL}
