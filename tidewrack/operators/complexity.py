"""Nesting-weighted scores of declarations and their change between two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nesting_score(events: DataFrame, *key: str) -> DataFrame:
    """(key, score) of ordered ``events`` (key, seq, base, structural, opens).

    An event adds ``base``, and if ``structural`` also the depth at its place: the sum of ``opens`` before it.
    """
    before = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    depth = F.coalesce(F.sum("opens").over(before), F.lit(0))
    rows = events.select(*key, (F.col("base") + F.when(F.col("structural"), depth).otherwise(0)).alias("s"))
    return rows.groupBy(*key).agg(F.sum("s").cast("long").alias("score"))


def operator_runs(events: DataFrame, key: str, order: list[str], operator: str) -> DataFrame:
    """(key, n_runs): runs of like operators, each scoring one."""
    prior = F.lag(operator).over(Window.partitionBy(key).orderBy(*order))
    rows = events.select(key, (prior.isNull() | (prior != F.col(operator))).cast("int").alias("opens"))
    return rows.groupBy(key).agg(F.sum("opens").alias("n_runs"))


def last_wins(scores: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row by ``order`` of rows with the same key."""
    return scores.groupBy(*key).agg(F.max_by("score", order).alias("score"))


def delta(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key, old_score, new_score, delta, status) of every declaration of either snapshot (key, score)."""
    o, n = old.withColumnRenamed("score", "old_score"), new.withColumnRenamed("score", "new_score")
    change = F.coalesce("new_score", F.lit(0)) - F.coalesce("old_score", F.lit(0))
    status = (
        F.when(F.col("old_score").isNull(), "added").when(F.col("new_score").isNull(), "removed")
        .when(change > 0, "increased").when(change < 0, "improved").otherwise("unchanged")
    )
    return o.join(n, key, "full_outer").select(*key, "old_score", "new_score", change.alias("delta"), status.alias("status"))


def summary(deltas: DataFrame) -> DataFrame:
    """One row: counts by status, changed declarations, and the net change."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return deltas.agg(
        n("added"), n("removed"), n("increased"), n("improved"),
        F.count_if(F.col("status") != "unchanged").alias("declarations_changed"),
        F.coalesce(F.sum("delta"), F.lit(0)).cast("long").alias("net_delta"),
    )


def violations(deltas: DataFrame, threshold: int | None = None, fail_on_increase: bool = False) -> DataFrame:
    """Deltas that fail: increased ones, if so asked, above the threshold if there is one; else added or
    increased ones above the threshold."""
    above = F.coalesce(F.col("new_score"), F.lit(0)) > threshold if threshold is not None else F.lit(True)
    grown = F.col("status") == "increased"
    by_increase = grown & above if fail_on_increase else F.lit(False)
    by_threshold = above & F.col("status").isin("added", "increased") if threshold is not None else F.lit(False)
    return deltas.where(by_increase | by_threshold)
