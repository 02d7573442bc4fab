"""Ranges of lines: merging, overlap joins, flags and shares of duplicated changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(ranges: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """(key, start, end): ranges with both ends inside; touching ones, end + 1 = start, become one."""
    order = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = ranges.select(key, start, end, F.when(F.col(start) <= reach + 1, 0).otherwise(1).alias("opens"))
    rows = rows.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def overlapping(left: DataFrame, ranges: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``left`` (key, start, end, ...) with each overlapping range as r_start and r_end."""
    r = ranges.select(F.col(key).alias("r_key"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    on = (F.col(key) == F.col("r_key")) & (F.col("start") <= F.col("r_end")) & (F.col("end") >= F.col("r_start"))
    return left.join(r, on, how).drop("r_key")


def diff_flags(instances: DataFrame, ranges: DataFrame, only_changed: bool = False) -> DataFrame:
    """(cluster, n_instances, n_in_diff, intersects_diff, is_new): new if all of its instances are in the diff."""
    hit = overlapping(instances, ranges, "doc_id", "left")
    each = hit.groupBy("cluster", "doc_id", "start", "end").agg(F.max(F.col("r_start").isNotNull()).alias("hit"))
    out = each.groupBy("cluster").agg(
        F.count("*").alias("n_instances"), F.count_if("hit").alias("n_in_diff"), F.bool_or("hit").alias("intersects_diff"), F.bool_and("hit").alias("is_new")
    )
    return out.where("intersects_diff") if only_changed else out


def diff_duplication(instances: DataFrame, ranges: DataFrame) -> DataFrame:
    """One row: changed lines, distinct duplicated ones of them, and their share in percent.

    Without changed lines the share is 100 if any is duplicated, else 0.
    """
    changed = ranges.agg(F.coalesce(F.sum(F.col("end") - F.col("start") + 1), F.lit(0)).cast("long").alias("changed_lines"))
    both = overlapping(instances, ranges, "doc_id").select(
        "doc_id", F.explode(F.sequence(F.greatest("start", "r_start"), F.least("end", "r_end"))).alias("line")
    )
    dup = both.distinct().agg(F.count("*").alias("dup_lines"))
    pct = F.when(F.col("changed_lines") > 0, F.col("dup_lines") / F.col("changed_lines") * 100).when(F.col("dup_lines") > 0, 100.0).otherwise(0.0)
    return changed.crossJoin(dup).withColumn("dup_pct", F.round(pct, 6))  # one row each


def touched_declarations(decls: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """(key, name, ranges): declarations that a range touches, with all such ranges as ``start-end`` in order."""
    hit = overlapping(decls, ranges, key)
    text = F.transform(F.array_sort(F.collect_set(F.struct("r_start", "r_end"))), lambda r: F.concat_ws("-", r["r_start"].cast("string"), r["r_end"].cast("string")))
    return hit.groupBy(key, "name").agg(F.array_join(text, ",").alias("ranges"))
