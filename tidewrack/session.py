"""Session construction for local runs; on a cluster the session is handed in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", checkpoint_dir: str | None = None, text_parts: int | None = None) -> SparkSession:
    """A session for tests and benchmarks on one machine.

    ``text_parts``: parts to which tables of texts are dealt, as they come in one file here.
    """
    builder = SparkSession.builder
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    if text_parts:
        builder = builder.config(TEXT_PARTS, str(text_parts))
    return (
        builder.master(f"local[{cores}]")
        .appName("tidewrack")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Tables of texts, whose rows cost much more to work on than to move.
TEXTS = ("documents", "pages")
#: Setting: parts to which a table of texts is dealt when it is read. Unset, tables are taken as they come.
TEXT_PARTS = "spark.tidewrack.textParts"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = spark.conf.get(TEXT_PARTS, None)
    return df.repartition(int(parts)) if parts and name in TEXTS else df
