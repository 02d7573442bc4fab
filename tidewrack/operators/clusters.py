"""Clusters of clones: components, roll-ups, buckets, categories, metrics of files and of the whole."""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.operators.matching import side_length, whole_text_pairs
from tidewrack.operators.ordering import placed as numbered
from tidewrack.operators.tokens import line_array, line_starts, normalized, token_array, token_counts
from tidewrack.plans.components import connected_components
from tidewrack.plans.lineage import cut

#: Lexemes that tell a clone's category.
CONTROL = ("if", "for", "while", "switch", "case", "return", "try", "catch", "await", "yield")
LITERAL = (":", "[", "]", "{", "}")
BOILERPLATE = ("import", "export", "part", "typedef", "library")


def members(pairs: DataFrame) -> DataFrame:
    """(doc_id, component) of the units that a pair links; component is the smallest doc_id."""
    return connected_components(pairs, "doc_a", "doc_b").select(F.col("node").alias("doc_id"), "component")


def rollup(of: DataFrame, docs: DataFrame) -> DataFrame:
    """(component, n_instances, token_count, line_count, lines_saved): saved are the lines of all but the first."""
    rows = of.join(token_counts(docs), "doc_id")
    first = F.min_by("n_lines", "doc_id")
    return rows.groupBy("component").agg(
        F.count("*").alias("n_instances"),
        F.min_by("n_tokens", "doc_id").alias("token_count"),
        F.round(F.avg("n_lines")).cast("long").alias("line_count"),
        (F.sum("n_lines") - first).alias("lines_saved"),
    )


def ranked(clusters: DataFrame) -> DataFrame:
    """Clusters with display_id by lines saved, tokens, component."""
    return numbered(clusters, [F.desc("lines_saved"), F.desc("token_count"), F.asc("component")], "display_id")


def top(clusters: DataFrame, k: int) -> DataFrame:
    """The first ``k`` clusters in report order; 0 is all."""
    out = clusters.orderBy(F.desc("lines_saved"), F.desc("token_count"), "component")
    return out.limit(k) if k else out


def buckets(of: DataFrame, docs: DataFrame, ignore_identifiers: bool = False) -> DataFrame:
    """(component, bucket): how members differ from the first.

    ``gapped`` if a token count differs; ``identical`` if all lexemes are equal; without a renamed word
    ``structural``, also where normalised lexemes differ; else ``parameterized`` if all normalised lexemes are
    equal and ``gapped`` if not.
    """
    toks = docs.select("doc_id", token_array(F.col("text")).alias("t"))
    toks = toks.withColumn("n", F.transform("t", lambda t: normalized(t, True, ignore_identifiers)))
    return token_buckets(of.join(toks, "doc_id"))


def token_buckets(rows: DataFrame) -> DataFrame:
    """(component, bucket) of ``rows`` (component, doc_id, t, n): each member's lexemes, and as they are compared."""
    lead = rows.where("doc_id = component").select("component", F.col("t").alias("t0"), F.col("n").alias("n0"))
    rows = rows.join(lead, "component")
    renamed = F.exists(
        F.arrays_zip("t", "t0", "n", "n0"), lambda x: (x["n"] == "<ID>") & (x["n0"] == "<ID>") & (x["t"] != x["t0"])
    )
    same_size = F.size("t") == F.size("t0")
    flags = rows.groupBy("component").agg(
        F.bool_and(same_size).alias("sized"),
        F.bool_and(F.col("t") == F.col("t0")).alias("equal"),
        F.bool_or(same_size & renamed).alias("renamed"),
        F.bool_and(F.col("n") == F.col("n0")).alias("norm_equal"),
    )
    bucket = (
        F.when(~F.col("sized"), "gapped").when(F.col("equal"), "identical").when(~F.col("renamed"), "structural")
        .when(F.col("norm_equal"), "parameterized").otherwise("gapped")
    )
    return flags.select("component", bucket.alias("bucket"))


def categories(of: DataFrame, docs: DataFrame) -> DataFrame:
    """(component, category) of each cluster's first member, by the lexemes it holds."""
    lead = of.where("doc_id = component").join(docs.select("doc_id", token_array(F.col("text")).alias("t")), "doc_id")
    return token_categories(lead)


def token_categories(lead: DataFrame) -> DataFrame:
    """(component, category) of ``lead`` (component, t): the lexemes of each cluster's first member."""
    count = lambda test: F.size(F.filter("t", test))
    control = count(lambda t: t.isin(*CONTROL))
    data = count(lambda t: t.rlike("^[0-9]+$") | t.isin(*LITERAL))
    plate = count(lambda t: t.isin(*BOILERPLATE))
    category = (
        F.when((plate > 0) & (plate >= control), "boilerplate").when(control > 0, "logic")
        .when(data > F.size("t") / 2, "data").otherwise("logic")
    )
    return lead.select("component", category.alias("category"))


def spans(pairs: DataFrame) -> DataFrame:
    """(cluster, doc_id, start, n_tokens): the distinct spans of pairs, with their component.

    The vertex of a span is a 64-bit hash of it; the cluster is the component's smallest hash.
    """
    sides = [pairs.select(F.col(f"doc_{s}").alias("doc_id"), F.col(f"start_{s}").alias("start"), side_length(pairs, s).alias("n_tokens")) for s in "ab"]
    vertex = F.xxhash64("doc_id", "start", "n_tokens")
    every = sides[0].union(sides[1]).distinct().withColumn("v", vertex)
    edges = pairs.select(F.xxhash64("doc_a", "start_a", side_length(pairs, "a")).alias("a"), F.xxhash64("doc_b", "start_b", side_length(pairs, "b")).alias("b"))
    label = connected_components(edges, "a", "b")
    return every.join(label, every.v == label.node).select(F.col("component").alias("cluster"), "doc_id", "start", "n_tokens")


def without_overlaps(of: DataFrame) -> DataFrame:
    """Spans of each cluster and text, longest first, without those that overlap an earlier kept one.

    Ties go to the smaller start. The rows stream past in this order, and only a text's kept spans are held; clusters
    that are left with one span go.
    """

    columns = of.columns

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, ends = [], []  # of the kept, in order: they don't overlap
        for b in batches:
            keep = []
            for i, s, n in zip(*(b.column(c).to_pylist() for c in ("_i", "start", "n_tokens"))):
                if i == 1:
                    starts, ends = [], []
                at = bisect(starts, s)
                keep.append((not at or ends[at - 1] <= s) and (at == len(starts) or s + n <= starts[at]))
                if keep[-1]:
                    starts.insert(at, s)
                    ends.insert(at, s + n)
            yield b.filter(pa.array(keep, pa.bool_())).select(columns)

    order = Window.partitionBy("cluster", "doc_id").orderBy(F.desc("n_tokens"), "start")
    kept = cut(of.withColumn("_i", F.row_number().over(order)).mapInArrow(greedy, of.schema))
    many = kept.groupBy("cluster").agg(F.count("*").alias("_n")).where("_n >= 2").select("cluster")
    return kept.join(many, "cluster", "left_semi")


def whole_without_overlaps(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, start, n_tokens): what ``without_overlaps`` leaves of the spans of all maximal pairs of ``docs``, however
    frequent; copies of a text have the same spans.

    A cluster in which two different texts meet joins all of their copies. One of spans of a single text is one for
    each of its copies, with as many spans; whole texts with copies are left always.
    """
    pairs, copied, members = whole_text_pairs(docs, k)
    kept = without_overlaps(spans(pairs)).select("doc_id", "start", "n_tokens").union(copied).distinct()
    return kept.withColumnRenamed("doc_id", "id").join(members, "id").select("doc_id", "start", "n_tokens")


def span_lines(of: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans with the first and last line that they touch, from 0."""
    full = line_starts(docs).where("n > 0")
    touched = of.join(full, "doc_id").where("first < start + n_tokens and first + n > start")
    return touched.groupBy("cluster", "doc_id", "start", "n_tokens").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"))


def duplicate_lines(placed: DataFrame) -> DataFrame:
    """(doc_id, line): the distinct lines of all spans."""
    return placed.select("doc_id", F.explode(F.sequence("first_line", "last_line")).alias("line")).distinct()


def file_metrics(placed: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, total_lines, dup_lines, total_tokens, dup_tokens, dup_pct, n_clusters) of every text.

    A token counts as duplicate if its line does.
    """
    dup = duplicate_lines(placed).join(line_starts(docs), ["doc_id", "line"])
    dup = dup.groupBy("doc_id").agg(F.count("*").alias("dup_lines"), F.sum("n").cast("long").alias("dup_tokens"))
    n = placed.groupBy("doc_id").agg(F.countDistinct("cluster").alias("n_clusters"))
    rows = token_counts(docs).join(dup, "doc_id", "left").join(n, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    pct = F.when(F.col("n_lines") > 0, F.coalesce("dup_lines", F.lit(0)) / F.col("n_lines") * 100).otherwise(F.lit(0.0))
    return rows.select("doc_id", F.col("n_lines").alias("total_lines"), zero("dup_lines"), F.col("n_tokens").alias("total_tokens"), zero("dup_tokens"), F.round(pct, 6).alias("dup_pct"), zero("n_clusters"))


def summary(metrics: DataFrame, placed: DataFrame, fail_threshold: float = 5.0) -> DataFrame:
    """One row of totals; all zero without texts. ``fails`` if the overall share is over the threshold."""
    size = placed.select("cluster", "doc_id", "start", (F.col("last_line") - F.col("first_line") + 1).alias("lines"))
    saved = size.groupBy("cluster").agg((F.sum("lines") - F.min_by("lines", F.struct("doc_id", "start"))).alias("s"))
    saved = saved.agg(F.count("*").alias("clusters"), F.coalesce(F.sum("s"), F.lit(0)).cast("long").alias("saved"))
    total = metrics.agg(
        F.count("*").alias("files"),
        *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("total_lines", "dup_lines", "total_tokens", "dup_tokens")),
        F.count_if(F.col("dup_lines") > 0).alias("files_with_dup"),
    )
    pct = F.when(F.col("total_lines") > 0, F.col("dup_lines") / F.col("total_lines") * 100).otherwise(F.lit(0.0))
    row = total.crossJoin(saved)  # one row each
    return row.select("files", "files_with_dup", "clusters", "total_lines", "dup_lines", "total_tokens", "dup_tokens", F.least("saved", "dup_lines").alias("lines_saved"), F.round(pct, 6).alias("dup_pct"), (pct > fail_threshold).alias("fails"))


def line_set_agreement(docs: DataFrame, a, b) -> DataFrame:
    """(both, only_a, only_b, jaccard_pct) of the sets of non-empty lines of two kinds of texts."""
    lines = docs.select(F.explode(line_array(F.col("text"))).alias("line"), a.alias("in_a"), b.alias("in_b")).where("line <> ''")
    sides = lines.groupBy("line").agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b")).where("in_a or in_b")
    n = sides.agg(
        F.count_if(F.col("in_a") & F.col("in_b")).alias("both"),
        F.count_if(F.col("in_a") & ~F.col("in_b")).alias("only_a"),
        F.count_if(~F.col("in_a") & F.col("in_b")).alias("only_b"),
    )
    union = F.col("both") + F.col("only_a") + F.col("only_b")
    return n.withColumn("jaccard_pct", F.when(union > 0, F.round(F.col("both") / union * 100, 6)).otherwise(F.lit(100.0)))
