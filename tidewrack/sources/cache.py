"""A content-addressed cache of extracted facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.plans.lineage import claimed, hadoop_path, remove


def content_hash(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def options_hash(*options) -> str:
    import hashlib

    return hashlib.md5("|".join(map(str, options)).encode()).hexdigest()


def fingerprint(df: DataFrame) -> str | None:
    """A hash of the names, sizes and times of the files that ``df`` reads; None if it reads none."""
    spark, parts = df.sparkSession, []
    for path in sorted(df.inputFiles()):
        fs, p = hadoop_path(spark, path)
        x = fs.getFileStatus(p)
        parts.append(f"{path}|{x.getLen()}|{x.getModificationTime()}")
    return options_hash(*parts) if parts else None


def work_list(files: DataFrame, cached: DataFrame) -> DataFrame:
    """(path, action): ``hit`` if the cache has the path's content, ``extract`` if not, ``prune`` if the path is gone."""
    c = cached.select("path", F.col("content_hash").alias("was"))
    action = F.when(F.col("content_hash").isNull(), "prune").when(F.col("was") == F.col("content_hash"), "hit").otherwise("extract")
    return files.select("path", "content_hash").join(c, "path", "full_outer").select("path", action.alias("action"))


class FactCache:
    """Facts by (path, content_hash, options), each refresh a numbered folder that replaces the one before.

    A refresh claims a number that no other can get, and counts when its file below ``done`` is there; the facts are
    those of the highest that counts. What a refresh replaces stays until the next one, for those who still read it.
    """

    def __init__(self, spark: SparkSession, folder: str, options: str):
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/{options}"

    def _numbers(self, of: str) -> list[int]:
        fs, p = hadoop_path(self.spark, f"{self.folder}/{of}")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(p)) if fs.exists(p) else []

    def _read(self, name: str) -> DataFrame | None:
        n = self._numbers("done")
        return self.spark.read.parquet(f"{self.folder}/{name}/{n[-1]}") if n else None

    def facts(self) -> DataFrame | None:
        return self._read("facts")

    def refreshed(self, files: DataFrame, extract) -> DataFrame:
        """Facts of ``files`` (path, content): those of unchanged files from the cache, others by ``extract``.

        ``extract`` maps (path, content, content_hash) rows to fact rows with path and content_hash; files that give
        none are remembered too. Files that are gone are pruned.
        """
        key = ["path", "content_hash"]
        files = files.withColumn("content_hash", content_hash(F.col("content")))
        old, known, done = self.facts(), self._read("files"), self._numbers("done")
        if old is None:
            new = extract(files)
        else:
            kept = old.join(files.select(*key), key, "left_semi")
            new = extract(files.join(known, key, "left_anti")).select(*old.columns).unionByName(kept)
        n = done[-1] + 1 if done else 0
        while not claimed(self.spark, f"{self.folder}/claims/{n}"):
            n += 1
        new.write.parquet(f"{self.folder}/facts/{n}")
        files.select(*key).distinct().write.parquet(f"{self.folder}/files/{n}")
        claimed(self.spark, f"{self.folder}/done/{n}")
        for gone in done[:-1]:
            for name in ("done", "facts", "files"):
                remove(self.spark, f"{self.folder}/{name}/{gone}")
        return self.facts()

    def clear(self) -> None:
        remove(self.spark, self.folder)
