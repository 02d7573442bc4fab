"""Cutting lineage in storage that every executor and the driver share.

Iterative plans must not depend on one executor's disk: they are cut with reliable checkpoints, or with
tables written below the folder that the cluster names in ``spark.checkpoint.dir``. Whatever an application
leaves there is removed when it ends, and what a loop has done with, at once.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder of each application that names none, by its id.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, else the context's; a temporary one only for a local master."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    named = named or _own.get(sc.applicationId) or sc.getCheckpointDir()
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="tidewrack-")
        remove_at_end(spark, named)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Have ``path``, which must be there, removed when the driver's JVM ends."""
    fs, p = hadoop_path(spark, path)
    fs.deleteOnExit(p)


def _checkpoint_file(df: DataFrame) -> str | None:
    plan = df._jdf.queryExecution().logical()
    file = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
    return file.get() if file and file.isDefined() else None


def cut(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """``df`` computed once and read from a reliable checkpoint from now on.

    The results ``spent`` of earlier cuts, which nothing will read any more, are removed then.
    """
    spark = df.sparkSession
    shared_dir(spark)
    out = df.checkpoint(eager=True)
    if file := _checkpoint_file(out):
        remove_at_end(spark, file)
    drop(*spent)
    return out


def unsized(df: DataFrame) -> DataFrame:
    """A result of ``cut`` without the size that was guessed for it from the input's.

    Spark takes what a Python stage or an explode makes for little more than what it read. A small input whose rows
    become many would be broadcast, through the driver; without a size only what was measured at run time is.
    """
    spark, plan = df.sparkSession, df._jdf.queryExecution().logical()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.rdd(), df._jdf.schema(), False), spark)


def drop(*cuts: DataFrame) -> None:
    """Remove what earlier cuts hold; they, and what is read from them, can't be used any more."""
    for df in cuts:
        if file := _checkpoint_file(df):
            remove(df.sparkSession, file)


def release(spark: SparkSession) -> None:
    """Have the shuffle files go that nothing will read any more.

    Spark removes them when the driver's JVM happens to collect what named them; until then they fill the executors' disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it is removed when the application ends."""
    own = f"{shared_dir(spark)}/tidewrack-{spark.sparkContext.applicationId}"
    fs, p = hadoop_path(spark, own)
    if fs.mkdirs(p):
        fs.deleteOnExit(p)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    """``df`` written as a table at ``path`` and read from there."""
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the JVM for any URI that Spark can open."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def claimed(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` was made a file by this call, and by no other before: of many callers one gets it."""
    fs, p = hadoop_path(spark, path)
    fs.mkdirs(p.getParent())
    try:
        fs.create(p, False).close()
    except Exception as e:
        if "FileAlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise
    return True


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)
