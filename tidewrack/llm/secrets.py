"""Secret scanning with an incremental blob ledger, in DataFrame operations only.

Every version of a path is content-addressed by the SHA-256 of its text. A ledger of two tables below one
folder remembers which (blob, rule, rule version) were scanned and what was found; a scan reads the texts of
unseen pairs only, once for each distinct blob, and findings join back to every path that holds the blob.

Positions are code points, end exclusive. Spark gives matches but not their places, so a text is also split
at the matches: running sums over the lengths of gaps and matches are the places.

Null texts are empty; they and texts without findings get zero counts and empty lists. Repeated rows and
equal texts share one blob; an empty input gives empty results. Other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewrack.plans.lineage import claimed, hadoop_path, work_dir


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


#: The patterns as asked for, in order. A run of hex digits or of key characters is maximal, so
#: the least length can stand in the pattern; not so for assignments, whose short matches use up their text.
RULES = (
    Rule("assign", 1, r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _matches(text: Column, rule: Rule) -> Column:
    """array<struct(gap, size, ok)> of the matches in order."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    inner = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else sizes
    return F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(sizes)).alias("g"), sizes.alias("s"), inner.alias("i")),
        lambda x: F.struct(x["g"].alias("gap"), x["s"].alias("size"), (x["i"] >= rule.least).alias("ok")),
    )


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, rule, rule_version, start, end) of ``blobs`` (blob, content, rule_kinds array of rules to run)."""
    found = F.array(
        *(
            F.struct(
                F.lit(r.kind).alias("rule"),
                F.lit(r.version).alias("rule_version"),
                F.when(F.array_contains("rule_kinds", r.kind) & F.col("content").rlike(r.pattern), _matches(F.col("content"), r)).alias("m"),
            )
            for r in rules
        )
    )
    rows = blobs.select("blob", F.explode(found).alias("f")).where("f.m is not null")
    rows = rows.select("blob", "f.rule", "f.rule_version", F.posexplode("f.m").alias("at", "x"))
    run = Window.partitionBy("blob", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("x.gap") + F.col("x.size")).over(run)
    placed = rows.select("blob", "rule", "rule_version", end.alias("end"), "x.size", "x.ok")
    return placed.where("ok").select(
        "blob", "rule", "rule_version", (F.col("end") - F.col("size")).cast("long").alias("start"), F.col("end").cast("long").alias("end")
    )


class BlobLedger:
    """The ledger at ``path``: ``scanned`` (blob, rule, rule_version) and ``findings`` with start and end.

    Each scan claims a number, which no other scan can get, and adds a folder of that number to both tables; a file
    below ``done`` makes them count. A scan that was broken off thus counts for nothing. Scans that run at the same
    time may both scan a blob that neither has seen; its findings are read once.
    """

    SCANNED = "blob string, rule string, rule_version int"
    FINDINGS = SCANNED + ", start long, end long"

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES):
        self.spark, self.path, self.rules = spark, path, rules

    def _numbers(self) -> list[str]:
        """The numbers of the scans that ended."""
        fs, p = hadoop_path(self.spark, f"{self.path}/done")
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def _claimed(self) -> str:
        """A number of this scan's own."""
        n = len(self._numbers())
        while not claimed(self.spark, f"{self.path}/claims/{n:08d}"):
            n += 1
        return f"{n:08d}"

    def _read(self, name: str, schema: str) -> DataFrame:
        parts = [f"{self.path}/{name}/{n}" for n in self._numbers()]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self._read("scanned", self.SCANNED)

    def findings(self) -> DataFrame:
        """Findings of the present rule versions."""
        now = F.array(*(F.struct(F.lit(r.kind).alias("k"), F.lit(r.version).alias("v")) for r in self.rules))
        rows = self._read("findings", self.FINDINGS).where(
            F.exists(now, lambda r: (r["k"] == F.col("rule")) & (r["v"] == F.col("rule_version")))
        )
        return rows.distinct() if len(self._numbers()) > 1 else rows

    def scan(self, versions: DataFrame, text: str = "text") -> int:
        """Scan what the ledger hasn't seen of ``versions``; the number of (blob, rule) pairs scanned."""
        blobs = versions.select(blob_id(F.col(text)).alias("blob"), F.coalesce(text, F.lit("")).alias("content"))
        number = self._claimed()
        if self._numbers():
            seen = self.scanned().where(
                " or ".join(f"(rule = '{r.kind}' and rule_version = {r.version})" for r in self.rules)
            )
            seen = seen.groupBy("blob").agg(F.collect_set("rule").alias("seen_rules"))
            blobs = blobs.join(seen, "blob", "left").select(
                "blob",
                "content",
                F.array_except(F.array(*(F.lit(r.kind) for r in self.rules)), F.coalesce("seen_rules", F.array().cast("array<string>"))).alias("rule_kinds"),
            )
            blobs = blobs.where(F.size("rule_kinds") > 0)
        else:
            blobs = blobs.withColumn("rule_kinds", F.array(*(F.lit(r.kind) for r in self.rules)))
        unseen = blobs.groupBy("blob").agg(F.first("content").alias("content"), F.first("rule_kinds").alias("rule_kinds"))
        scan_blobs(unseen, self.rules).write.parquet(f"{self.path}/findings/{number}")
        kinds = F.array(*(F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("rule_version")) for r in self.rules))
        pairs = blobs.select("blob", "rule_kinds").groupBy("blob").agg(F.first("rule_kinds").alias("rule_kinds"))
        pairs = pairs.select("blob", "rule_kinds", F.explode(kinds).alias("r")).where(F.array_contains("rule_kinds", F.col("r.rule")))
        out = f"{self.path}/scanned/{number}"
        pairs.select("blob", "r.rule", "r.rule_version").write.parquet(out)
        claimed(self.spark, f"{self.path}/done/{number}")
        return self.spark.read.schema(self.SCANNED).parquet(out).count()


def spans_by_blob(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, n_<kind>..., spans) with spans sorted by start and then by the order of the rules."""
    order = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))))
    rows = findings.select("blob", "rule", F.struct("start", order[F.col("rule")].alias("o"), "end", "rule").alias("s"))
    spans = F.transform(
        F.array_sort(F.collect_list("s")), lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string"))
    )
    return rows.groupBy("blob").agg(
        *(F.count_if(F.col("rule") == r.kind).alias(f"n_{r.kind}") for r in rules), F.array_join(spans, ",").alias("spans")
    )


def secret_spans(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts by kind, the spans, and the hash of the base spans."""
    spark = docs.sparkSession
    ledger = BlobLedger(spark, ledger_path or work_dir(spark, "secrets"))
    ledger.scan(docs)
    paths = docs.select("doc_id", blob_id(F.col("text")).alias("blob"))
    found = paths.join(spans_by_blob(ledger.findings()), "blob", "left")
    spans = F.coalesce("spans", F.lit(""))
    return found.select(
        "doc_id",
        *(F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in RULES),
        F.sha2(spans, 256).alias("base_sha256"),
        spans.alias("spans"),
    )


def _unused(name: str, columns: list[str]) -> str:
    """``name``, made longer until no column is called so."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def redact(docs: DataFrame, ledger_path: str | None = None, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark`` and n_chars, if there, kept true; no row goes.

    Overlapping or touching spans are replaced together. Rows in which no pattern occurs pass through as they
    are; only the others are scanned, and joined with the places.
    """
    spark, columns = docs.sparkSession, docs.columns
    blob, cuts_ = _unused("_blob", columns), _unused("_cuts", columns)
    ledger = BlobLedger(spark, ledger_path or work_dir(spark, "secrets"))
    occurs = F.coalesce(reduce(Column.__or__, (F.col("text").rlike(r.pattern) for r in RULES)), F.lit(False))
    clean, docs = docs.where(~occurs), docs.where(occurs)
    ledger.scan(docs)
    before = Window.partitionBy("blob").orderBy("start", "end")
    reach = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    islands = ledger.findings().select("blob", "start", "end", (F.coalesce(reach, F.lit(-1)) < F.col("start")).cast("int").alias("opens"))
    islands = islands.withColumn("island", F.sum("opens").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("blob", "island").agg(F.min("start").alias("s"), F.max("end").alias("e"))
    cuts = merged.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias(cuts_))
    joined = docs.withColumn(blob, blob_id(F.col("text"))).join(cuts.withColumnRenamed("blob", blob), blob, "left")
    last = F.array(F.struct(F.length("text").cast("long").alias("s"), F.lit(0).cast("long").alias("e")))
    parts = F.transform(
        F.concat(cuts_, last),
        lambda c, i: F.substring(
            F.col("text"),
            (F.when(i > 0, F.get(cuts_, i - 1)["e"]).otherwise(F.lit(0)) + 1).cast("int"),
            (c["s"] - F.when(i > 0, F.get(cuts_, i - 1)["e"]).otherwise(F.lit(0))).cast("int"),
        ),
    )
    text = F.when(F.col(cuts_).isNull(), F.col("text")).otherwise(F.array_join(parts, mark))
    out = joined.withColumn("text", text)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col(cuts_).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return clean.union(out.select(*columns))


def oracle_sql() -> str:
    """The same result in DuckDB's SQL: places from the pieces between matches."""
    parts = []
    for o, r in enumerate(RULES):
        pat = r.pattern.replace("'", "''").replace("((?i)password|passwd|secret|token|api_?key)", "((?i:password|passwd|secret|token|api_?key))")
        parts.append(
            f"SELECT rid, '{r.kind}' AS kind, {o} AS o, "
            f"list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS s, "
            f"length(ms[i]) AS n, length(gs[i]) AS g FROM (SELECT rid, ms, gs, ps, unnest(range(1, len(ms) + 1)) AS i FROM ("
            f"SELECT rid, regexp_extract_all(t, '{pat}', 0) AS ms, regexp_extract_all(t, '{pat}', {r.group}) AS gs, "
            f"string_split_regex(t, '{pat}') AS ps FROM base)) WHERE length(gs[i]) >= {r.least}"
        )
    return f"""
WITH base AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({' UNION ALL '.join(parts)}),
per AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s + n AS BIGINT) AS VARCHAR), ',' ORDER BY s, o) AS spans FROM hits GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
  CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM base LEFT JOIN per USING (rid)"""
