"""Clone detection over source files, from a scan to a report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.operators import clusters, matching, ranges, similarity
from tidewrack.operators.tokens import array_kgrams
from tidewrack.plans.lineage import cut, unsized
from tidewrack.sources import dart


CATEGORIES, BUCKETS = ("all", "logic", "data", "boilerplate"), ("all", "identical", "parameterized", "structural", "gapped")


@dataclass(frozen=True)
class DedupeOptions:
    """``ignore_comments`` changes nothing: comments are no tokens, so they are never compared. With ``max_bucket`` None
    nothing is too frequent to be compared."""

    min_tokens: int = 40
    min_lines: int = 4
    ignore_literals: bool = True
    ignore_identifiers: bool = False
    max_bucket: int | None = 50
    category: str = "all"
    bucket: str = "all"
    top: int = 0
    fail_threshold: float | None = None
    only_changed: bool = False
    ignore_comments: bool = True

    def __post_init__(self):
        if self.min_tokens < 1 or self.min_lines < 1 or self.top < 0:
            raise ValueError("counts must be positive")
        if self.category not in CATEGORIES or self.bucket not in BUCKETS:
            raise ValueError("unknown category or bucket")


@dataclass(frozen=True)
class DedupeReport:
    """Distributed results; ``summary`` is one row."""

    instances: DataFrame
    clusters: DataFrame
    file_metrics: DataFrame
    summary: DataFrame


def detect(files: DataFrame, options: DedupeOptions = DedupeOptions(), changed: DataFrame | None = None) -> DedupeReport:
    """Clones in ``files`` (path, content); with ``changed`` (path, start, end) clusters tell what the diff touches."""
    k = max(5, options.min_tokens)
    toks = unsized(cut(dart.token_rows(files, options.ignore_literals, options.ignore_identifiers)))
    by_file = toks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "norm"))).alias("x"))  # one file's tokens
    arrays = by_file.select(F.col("path").alias("doc_id"), F.transform("x", lambda t: t["norm"]).alias("_t"))
    grams = unsized(cut(array_kgrams(arrays, k)))
    if options.max_bucket is None:
        shared = grams.join(grams.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), ["h1", "h2"])
        pieces = shared.select(F.col("doc_id").alias("id"), F.col("pos").alias("start"), F.lit(1).alias("len"), "h1", "h2")
        pairs = unsized(cut(matching.whole_maximal_pairs(pieces, k)))
    else:
        pairs = unsized(cut(matching.clone_pairs(grams, k, options.max_bucket)))
    pairs = pairs.select("doc_a", "start_a", F.col("n_tokens").alias("n_a"), "doc_b", "start_b", F.col("n_tokens").alias("n_b"))
    units = unsized(cut(dart.unit_rows(files, options.min_tokens, options.min_lines, options.ignore_literals, options.ignore_identifiers)))
    pairs = unsized(cut(pairs.union(_unit_pairs(units, options.max_bucket)).distinct()))
    at = toks.select(F.col("path").alias("doc_id"), "pos", "line", "col", (F.col("col") + F.length("orig")).alias("end_col"))
    placed = _tall_enough(matching.maximal_pairs(pairs), at, options.min_lines)
    found = clusters.without_overlaps(clusters.spans(cut(placed)))
    first = at.select("doc_id", F.col("pos").alias("start"), F.col("line").alias("start_line"), F.col("col").alias("start_column"))
    last = at.select("doc_id", F.col("pos").alias("_end"), F.col("line").alias("end_line"), F.col("end_col").alias("end_column"))
    rows = found.withColumn("_end", F.col("start") + F.col("n_tokens") - 1).join(first, ["doc_id", "start"]).join(last, ["doc_id", "_end"])
    rows = rows.select("cluster", F.col("doc_id").alias("path"), "start", "n_tokens", "start_line", "start_column", "end_line", "end_column")
    instances = cut(with_snippets(rows, files))
    lines = (F.col("end_line") - F.col("start_line") + 1).alias("lines")
    size = instances.select("cluster", "path", "start", "n_tokens", "start_line", "end_line", lines)
    key = F.struct("path", "start")
    every = size.groupBy("cluster").agg(
        F.count("*").alias("n_instances"), F.min_by("n_tokens", key).alias("token_count"), F.round(F.avg("lines")).cast("long").alias("line_count"),
        (F.sum("lines") - F.min_by("lines", key)).alias("lines_saved"),
    )
    every = every.join(_kinds(instances, toks), "cluster")
    for kind in ("category", "bucket"):
        if getattr(options, kind) != "all":
            every = every.where(F.col(kind) == getattr(options, kind))
    if changed is not None:
        flags = ranges.diff_flags(
            instances.select("cluster", F.col("path").alias("doc_id"), F.col("start_line").alias("start"), F.col("end_line").alias("end")),
            changed.withColumnRenamed("path", "doc_id"), options.only_changed,
        )
        every = every.join(flags.select("cluster", "intersects_diff", "is_new"), "cluster")
    total = files.select("path", F.size(F.split("content", "\n", -1)).cast("long").alias("total_lines"))
    n_tokens = toks.groupBy("path", "line").agg(F.count("*").alias("n"))
    dup = instances.select("path", F.explode(F.sequence("start_line", "end_line")).alias("line")).distinct()
    per = dup.join(n_tokens, ["path", "line"], "left").groupBy("path").agg(F.count("*").alias("dup_lines"), F.coalesce(F.sum("n"), F.lit(0)).alias("dup_tokens"))
    count = instances.groupBy("path").agg(F.countDistinct("cluster").alias("n_clusters"))
    toks_of = n_tokens.groupBy("path").agg(F.sum("n").alias("total_tokens"))
    metrics = total.join(toks_of, "path", "left").join(per, "path", "left").join(count, "path", "left").fillna(0)
    pct = F.when(F.col("total_lines") > 0, F.col("dup_lines") / F.col("total_lines") * 100).otherwise(F.lit(0.0))
    metrics = metrics.withColumn("dup_pct", F.round(pct, 6))
    summed = metrics.agg(F.count("*").alias("files"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_lines", "dup_lines", "total_tokens", "dup_tokens")))
    saved = every.agg(F.count("*").alias("clusters"), F.coalesce(F.sum("lines_saved"), F.lit(0)).alias("saved"))
    summary = summed.crossJoin(saved).select("*", F.least("saved", "dup_lines").alias("lines_saved"), F.round(pct, 6).alias("dup_pct")).drop("saved")  # one row each
    return DedupeReport(instances, every, metrics, summary)


def with_snippets(spans: DataFrame, files: DataFrame) -> DataFrame:
    """``spans`` (path, start_line, end_line) with ``snippet``, these lines of the file, trimmed; empty if there are none."""
    return spans.join(files.select("path", "content"), "path").withColumn("snippet", lines_of(F.col("content"), F.col("start_line"), F.col("end_line"))).drop("content")


def lines_of(content: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end`` of a text, as far as it has them, trimmed."""
    lines = F.split(F.coalesce(content, F.lit("")), "\n", -1)
    first, last = F.greatest(start, F.lit(1)), F.least(end, F.size(lines))
    text = F.array_join(F.slice(lines, F.least(first, F.size(lines)), F.greatest(last - first + 1, F.lit(0))), "\n")
    return F.when(last >= first, F.regexp_replace(text, r"^\s+|\s+$", "")).otherwise(F.lit(""))


def _unit_pairs(units: DataFrame, max_bucket: int | None) -> DataFrame:
    """(doc_a, start_a, n_a, doc_b, start_b, n_b) of units with equal tokens or at least 0.8 of their statements in common."""
    sides = {s: units.select(F.col("doc_id").alias(f"doc_{s}"), F.col("path").alias(f"p_{s}"), F.col("first").alias(f"start_{s}"), F.col("n_tokens").alias(f"n_{s}"), "hash") for s in "ab"}
    sized = units.groupBy("hash").agg(F.count("*").alias("size")).where(similarity.met(max_bucket))
    equal = sides["a"].join(sized, "hash").join(sides["b"], "hash").where("doc_a < doc_b").select("doc_a", "doc_b")
    many = units.where(F.size("lines") >= 2).select("doc_id", "lines")
    alike = similarity.jaccard_pairs(similarity.candidate_pairs(similarity.signatures(many), max_bucket), many).select("doc_a", "doc_b")
    rows = equal.union(alike).distinct().join(sides["a"].drop("hash"), "doc_a").join(sides["b"].drop("hash"), "doc_b")
    rows = rows.where("p_a <> p_b or start_a >= start_b + n_b or start_b >= start_a + n_a")
    swap = (F.col("p_a") > F.col("p_b")) | ((F.col("p_a") == F.col("p_b")) & (F.col("start_a") > F.col("start_b")))
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return rows.select(*(pick(f"{c}_{s}", f"{c}_{o}").alias("doc_" + s if c == "p" else f"{c}_{s}") for s, o in ("ab", "ba") for c in ("p", "start", "n")))


def _kinds(instances: DataFrame, toks: DataFrame) -> DataFrame:
    """(cluster, bucket, category) by the tokens of each cluster's instances."""
    places = F.explode(F.sequence("start", (F.col("start") + F.col("n_tokens") - 1).cast("int"))).alias("pos")
    rows = instances.select("cluster", "path", F.col("start").cast("int").alias("start"), "n_tokens").select("cluster", "path", "start", places)
    rows = rows.join(toks.select("path", "pos", "orig", "norm"), ["path", "pos"])
    rows = rows.groupBy("cluster", "path", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "orig", "norm"))).alias("x"))
    rows = rows.select("cluster", F.struct("path", "start").alias("doc_id"), F.col("x.orig").alias("t"), F.col("x.norm").alias("n"))
    first = rows.groupBy("cluster").agg(F.min("doc_id").alias("component"))
    rows = cut(rows.join(first, "cluster").select("component", "cluster", "doc_id", "t", "n"))
    # two clusters may begin with spans of one start: the cluster is part of what names a component
    rows = rows.select(F.struct("cluster", "component").alias("component"), F.struct("cluster", "doc_id").alias("doc_id"), "t", "n")
    lead = rows.where("doc_id = component")
    found = clusters.token_buckets(rows).join(clusters.token_categories(lead), "component")
    return found.select(F.col("component.cluster").alias("cluster"), "bucket", "category")


def _tall_enough(pairs: DataFrame, at: DataFrame, min_lines: int) -> DataFrame:
    """Pairs of which both sides span the lines asked for."""
    for side in "ab":
        name = f"doc_{side}"
        low = at.select(F.col("doc_id").alias(name), F.col("pos").alias(f"start_{side}"), F.col("line").alias("_l0"))
        high = at.select(F.col("doc_id").alias(name), F.col("pos").alias("_p"), F.col("line").alias("_l1"))
        cols = pairs.columns
        rows = pairs.withColumn("_p", F.col(f"start_{side}") + matching.side_length(pairs, side) - 1).join(low, [name, f"start_{side}"]).join(high, [name, "_p"])
        pairs = rows.where(F.col("_l1") - F.col("_l0") + 1 >= min_lines).select(*cols)
    return pairs
