"""A store of immutable shards with size-tiered compaction and a versioned manifest.

Arrivals are appended as they come, each as small Parquet shards; nothing is ever changed in place. Shards fall
into tiers by size, each ``fan_in`` times the one below. When a tier has ``fan_in`` shards or more, runs of
its shards, in order, are merged into files of about ``target_bytes``; a shard of over half the target is final.
Merging reads a run's files in one task and writes one file: rows aren't shuffled, and a key's weight doesn't matter.

The manifest of a version names all live shards with rows and bytes. A commit writes it under another name and
renames it to the next number, which fails if that number is there: readers see a whole version or none, and of
two writers one has to try again on the other's version. Folders that no manifest names, of broken-off or beaten
writers, are litter that ``vacuum`` removes.

Nulls, repeated rows and any columns are kept as they are, whole texts included. An empty arrival commits a
version without a new shard. All arrivals must have the store's columns.
"""

from __future__ import annotations

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewrack.plans.lineage import claimed, hadoop_path, remove, work_dir


@dataclass(frozen=True)
class Shard:
    path: str  # below the store's folder
    bytes: int
    rows: int


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    shards: tuple[Shard, ...]


#: Times that a commit is tried while others commit first.
TRIES = 100


class Conflict(RuntimeError):
    """Another writer has committed the version."""


class ShardStore:
    def __init__(
        self, spark: SparkSession, path: str, target_bytes: int = 128 << 20, least_bytes: int = 1 << 20, fan_in: int = 4,
        target_rows: int = 1 << 20, grace_seconds: int = 24 * 3600,
    ):
        self.spark, self.path = spark, path.rstrip("/")
        self.target_bytes, self.least_bytes, self.fan_in = target_bytes, least_bytes, fan_in
        self.target_rows, self.grace_seconds = target_rows, grace_seconds

    # manifests

    def _list(self, folder: str):
        fs, p = hadoop_path(self.spark, f"{self.path}/{folder}")
        return list(fs.listStatus(p)) if fs.exists(p) else []

    def versions(self) -> list[int]:
        names = (x.getPath().getName() for x in self._list("manifest"))
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """The manifest of a version, the latest if none is named; version 0 is empty."""
        version = max(self.versions(), default=0) if version is None else version
        if version == 0:
            return Manifest(0, "", ())
        fs, p = hadoop_path(self.spark, f"{self.path}/manifest/v{version:08d}.json")
        stream = fs.open(p)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        x = json.loads(text)
        return Manifest(x["version"], x["schema"], tuple(Shard(**s) for s in x["shards"]))

    def _commit(self, base: Manifest, schema: str, shards: tuple[Shard, ...], folders: tuple[str, ...] = ()) -> Manifest:
        """Make the version after ``base``; ``folders`` are the data folders that the writer holds an intent for."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        new = Manifest(base.version + 1, schema, shards)
        fs, draft = hadoop_path(self.spark, f"{self.path}/manifest/draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(json.dumps(asdict(new)).encode())
        out.close()
        final = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/v{new.version:08d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(), conf)
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        for folder in folders:
            fs.setTimes(hadoop_path(self.spark, self._intent(folder))[1], int(1000 * time.time()), -1)  # fails if it is gone
        try:
            context.rename(draft, final, none)
        except Exception as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                raise Conflict(f"version {new.version} is there") from e
            raise
        for folder in folders:
            remove(self.spark, self._intent(folder))
        return new

    def _intent(self, folder: str) -> str:
        return f"{self.path}/intent/{folder.rpartition('/')[2]}"

    # shards

    def _written(self, df: DataFrame) -> tuple[str, tuple[Shard, ...]]:
        """``df`` written, a file for each non-empty task, under an intent: (folder, its files with their rows)."""
        folder = f"data/{uuid.uuid4().hex}"
        claimed(self.spark, self._intent(folder))
        df.write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        files = {x.getPath().getName(): x.getLen() for x in self._list(folder) if x.getPath().getName().endswith(".parquet")}
        if not files:
            return folder, ()
        back = self.spark.read.schema(df.schema).parquet(f"{self.path}/{folder}")
        n = {r.f: r.n for r in back.groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("f")).agg(F.count("*").alias("n")).collect()}
        return folder, tuple(Shard(f"{folder}/{f}", size, n[f]) for f, size in sorted(files.items()) if n.get(f))

    def append(self, arrivals: DataFrame, rows_per_shard: int = 100_000) -> Manifest:
        """Commit ``arrivals`` as new small shards."""
        base = self._same_columns(arrivals)
        schema = arrivals.schema.json()
        spark, key = self.spark, "spark.sql.files.maxRecordsPerFile"
        before = spark.conf.get(key, "0")
        spark.conf.set(key, str(rows_per_shard))
        try:
            folder, shards = self._written(arrivals)
        finally:
            spark.conf.set(key, before)
        for _ in range(TRIES):
            try:
                return self._commit(base, base.schema or schema, base.shards + shards, (folder,))
            except Conflict:  # another version came first: the written files join that one
                base = self._same_columns(arrivals)
        raise Conflict(f"no turn in {TRIES} tries")

    def _same_columns(self, arrivals: DataFrame) -> Manifest:
        """The latest manifest; an error if the store has other columns than the arrivals."""
        base = self.manifest()
        if base.schema and StructType.fromJson(json.loads(base.schema)).fieldNames() != arrivals.schema.fieldNames():
            raise ValueError("the arrival has other columns than the store")
        return base

    def tier(self, size: int) -> int:
        t = 0
        while size >= self.least_bytes * self.fan_in ** (t + 1):
            t += 1
        return t

    def runs(self, shards: tuple[Shard, ...]) -> list[list[Shard]]:
        """The runs to merge now: of each full tier, shards in order up to the target's bytes and rows, two at least."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if 2 * s.bytes <= self.target_bytes and 2 * s.rows <= self.target_rows:
                tiers.setdefault(self.tier(s.bytes), []).append(s)
        out = []
        for _, members in sorted(tiers.items()):
            if len(members) < self.fan_in:
                continue
            run, size, rows = [], 0, 0
            for s in members:
                if run and (size + s.bytes > self.target_bytes or rows + s.rows > self.target_rows):
                    out.append(run)
                    run, size, rows = [], 0, 0
                run.append(s)
                size, rows = size + s.bytes, rows + s.rows
            out.append(run)
        return [r for r in out if len(r) > 1]

    def compact(self, max_rounds: int = 20, runs_per_job: int = 64) -> Manifest:
        """Merge until no tier is full; each round commits a version.

        If another version comes first, the merge still holds as long as all merged shards are live in it.
        """
        for _ in range(max_rounds):
            base = self.manifest()
            runs = self.runs(base.shards)
            if not runs:
                return base
            schema = StructType.fromJson(json.loads(base.schema))
            read = lambda run: self.spark.read.schema(schema).parquet(*(f"{self.path}/{s.path}" for s in run)).coalesce(1)
            merged: list[Shard] = []
            folders: list[str] = []
            for at in range(0, len(runs), runs_per_job):
                folder, files = self._written(reduce(DataFrame.union, map(read, runs[at : at + runs_per_job])))
                folders.append(folder)
                merged += files
            gone = {s.path for r in runs for s in r}
            rows = sum(s.rows for r in runs for s in r)
            if rows != sum(s.rows for s in merged):
                raise RuntimeError("a merge lost rows")
            for _ in range(TRIES):
                if not gone <= {s.path for s in base.shards}:
                    for folder in folders:  # another compaction took some of them: what was merged here is litter
                        remove(self.spark, self._intent(folder))
                    break
                try:
                    self._commit(base, base.schema, tuple(s for s in base.shards if s.path not in gone) + tuple(merged), tuple(folders))
                    break
                except Conflict:
                    base = self.manifest()
            else:
                raise Conflict(f"no turn in {TRIES} tries")
        raise RuntimeError("compaction didn't settle")

    def vacuum(self, keep_versions: int = 1) -> int:
        """Remove files that the last ``keep_versions`` manifests don't name; readers of older ones must have ended.

        Folders of writers that haven't committed yet stay, unless their intent is older than the grace period.
        """
        fs, _ = hadoop_path(self.spark, self.path)
        folders = self._list("data")  # before the intents: a folder that is made later has one
        held = set()
        for x in self._list("intent"):
            if x.getModificationTime() < 1000 * (time.time() - self.grace_seconds):
                fs.delete(x.getPath(), False)
            else:
                held.add(x.getPath().getName())
        # after the intents: a writer that has committed since is named here
        live = {s.path for v in self.versions()[-keep_versions:] for s in self.manifest(v).shards}
        n = 0
        for folder in folders:
            name = folder.getPath().getName()
            if name in held:
                continue
            for f in self._list(f"data/{name}"):
                if f.getPath().getName().endswith(".parquet") and f"data/{name}/{f.getPath().getName()}" not in live:
                    n += bool(fs.delete(f.getPath(), False))
        return n

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        m = self.manifest(version)
        schema = StructType.fromJson(json.loads(m.schema)) if m.schema else StructType()
        if not m.shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{s.path}" for s in m.shards))


def append_concurrently(stores: list[tuple[ShardStore, DataFrame]]) -> list[Manifest]:
    """Appends from several writers at once."""
    with ThreadPoolExecutor(max(1, len(stores))) as pool:
        return list(pool.map(lambda x: x[0].append(x[1]), stores))


def shard_documents(docs: DataFrame, path: str | None = None, rows_per_shard: int = 2000, target_bytes: int = 128 << 20) -> DataFrame:
    """Append ``docs``, compact, and read back: doc_id, shard, version, n_chars and text_sha256 of every row.

    ``shard`` is the place of the row's file in the manifest; ``n_chars`` and the hash are of the stored text. A
    store of its own, without ``path``, is vacuumed; one that others may write to or read from isn't.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, path or work_dir(spark, "shards"), target_bytes)
    store.append(docs, rows_per_shard)
    m = store.compact()
    if path is None:
        store.vacuum()
    schema = "doc_id long, shard int, version int, n_chars long, text_sha256 string"
    if not m.shards:
        return spark.createDataFrame([], schema)
    number = {s.path.rpartition("/")[2]: i for i, s in enumerate(m.shards)}
    names = spark.createDataFrame(list(number.items()), "_file string, shard int")  # one row for each file
    rows = store.read().select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("_file"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("text", 256).alias("text_sha256"),
    )
    return rows.join(names, "_file").select("doc_id", "shard", F.lit(m.version).alias("version"), "n_chars", "text_sha256")


ORACLE_SQL = "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS text_sha256 FROM documents"
