"""Source files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.functions.globs import DEFAULT_EXCLUDES, excluded_path, path_role, selected


def source_files(spark: SparkSession, root: str, include=(), exclude=DEFAULT_EXCLUDES, suffix: str = ".dart", tool_folders_only: bool = False) -> DataFrame:
    """(path, content, content_hash, role) of the files below ``root``; paths are relative to it.

    ``root`` may be one file, whose path is then its name; a file of another suffix gives no rows, nor does an empty one,
    which Spark doesn't read. Files in tool and
    build folders are left out, with ``tool_folders_only`` not those below a first folder called build.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root)
    base, name = root.rstrip("/").split("://")[-1], F.element_at(F.split("path", "/"), -1)
    relative = F.regexp_replace(F.expr(f"substring(path, instr(path, {_quoted(base)}) + {len(base) + 1})"), "^/", "")
    rows = raw.select(F.when(relative == "", name).otherwise(relative).alias("path"), F.decode("content", "UTF-8").alias("content"))
    kept = selected(F.col("path"), include, exclude, suffix) & ~excluded_path(F.concat(F.lit("./") if tool_folders_only else F.lit(""), F.col("path")))
    return rows.where(kept).withColumn("content_hash", F.md5("content")).withColumn("role", path_role(F.col("path")))


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def from_memory(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """(path, content) of texts at hand."""
    return spark.createDataFrame(list(files.items()), "path string, content string")
