"""Reachability over declaration graphs, and what it says of dead declarations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.plans.lineage import cut


#: Rounds whose tables are kept apart before they become one.
APART = 16


def reachable(edges: DataFrame, roots: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(id) of all nodes that ``roots`` (id) reach over ``edges`` (src, dst), themselves included.

    Each round joins the frontier, not all that was reached, with the edges, and writes its new nodes only: the
    rounds' tables stay apart, and become one after every ``APART``.
    """
    edges = cut(edges.select("src", "dst").where("src <> dst").distinct())
    seen = [cut(roots.select("id").distinct())]
    for _ in range(max_rounds):
        frontier = seen[-1]
        step = frontier.join(edges, frontier.id == edges.src).select(F.col("dst").alias("id")).distinct()
        found = cut(step.join(reduce(DataFrame.union, seen), "id", "left_anti"))
        if found.isEmpty():
            return reduce(DataFrame.union, seen)
        if len(seen) == APART:
            seen = [cut(reduce(DataFrame.union, seen), *seen)]
        seen.append(found)
    raise RuntimeError(f"the search didn't end in {max_rounds} rounds")


def with_sealed(edges: DataFrame, sealed: DataFrame) -> DataFrame:
    """``edges`` and, for each sealed (parent, child), an edge to the direct subtype."""
    return edges.union(sealed.select(F.col("parent").alias("src"), F.col("child").alias("dst")))


def group_edges(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """(src, dst): from each declaration of a file to all of the other files of its conditional group.

    ``nodes`` (id, file), ``groups`` (grp, file). The product is of one group's files, which an import names.
    """
    a = groups.join(nodes, "file").select("grp", F.col("file").alias("file_a"), F.col("id").alias("src"))
    b = groups.join(nodes, "file").select("grp", F.col("file").alias("file_b"), F.col("id").alias("dst"))
    return a.join(b, "grp").where("file_a <> file_b").select("src", "dst").distinct()


def resolved(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst): references (src, element, path, name, owner) to nodes (id, element, path, name).

    By element, else by path and name, else by path and the top-level owner's name; unresolved ones go.
    """
    by_element = nodes.select("element", F.col("id").alias("d1")).where("element is not null").dropDuplicates(["element"])
    by_name = nodes.select("path", "name", F.col("id").alias("d2")).dropDuplicates(["path", "name"])
    by_owner = by_name.select("path", F.col("name").alias("owner"), F.col("d2").alias("d3"))
    rows = refs.join(by_element, "element", "left").join(by_name, ["path", "name"], "left").join(by_owner, ["path", "owner"], "left")
    rows = rows.select("src", F.coalesce("d1", "d2", "d3").alias("dst"))
    return rows.where("dst is not null and dst <> src").distinct()


def hazards(site_refs: DataFrame, live: DataFrame) -> DataFrame:
    """(site, id, hazard) of references to nodes that aren't live; hazard if the site also touches a live node."""
    marked = site_refs.join(live.withColumn("is_live", F.lit(True)), "id", "left")
    by_site = marked.groupBy("site").agg(F.max(F.coalesce("is_live", F.lit(False))).alias("hazard"))
    dead = marked.where("is_live is null").select("site", "id").distinct()
    return dead.join(by_site, "site").select("site", "id", "hazard")


def classified(candidates: DataFrame, live: DataFrame, tested: DataFrame, test_support: DataFrame, site_refs: DataFrame) -> DataFrame:
    """(id, classification, action) of ``candidates`` that production doesn't reach.

    Not reached by tests either: delete. Test support that tests reach stays and isn't listed. Touched by a test
    that also touches live code: a hazard to refactor by hand; else delete together with its tests.
    """
    dead = candidates.select("id").join(live, "id", "left_anti").distinct()
    risky = hazards(site_refs, live).where("hazard").select("id").distinct().withColumn("risky", F.lit(True))
    rows = dead.join(tested.withColumn("tested", F.lit(True)), "id", "left").join(test_support.select("id").distinct().withColumn("support", F.lit(True)), "id", "left").join(risky, "id", "left")
    kind = F.when(F.col("tested").isNull(), "pureUndead").when(F.col("support"), "preserved").when(F.col("risky"), "coInvokedHazard").otherwise("testedUndead")
    action = F.when(F.col("classification") == "pureUndead", "delete").when(F.col("classification") == "coInvokedHazard", "manualRefactorHazard").otherwise("deleteWithOrphanTests")
    return rows.select("id", kind.alias("classification")).where("classification <> 'preserved'").withColumn("action", action)


def private_candidates(nodes: DataFrame, live: DataFrame, edges: DataFrame, test_refs: DataFrame) -> DataFrame:
    """(id): live public declarations of ``nodes`` (id, file, exported) that only their own file uses."""
    files = nodes.select(F.col("id").alias("n"), "file")
    across = edges.join(files.toDF("src", "file_a"), "src").join(files.toDF("dst", "file_b"), "dst").where("file_a <> file_b").select(F.col("dst").alias("id"))
    own = nodes.where("not exported").select("id").join(live, "id", "left_semi")
    return own.join(across, "id", "left_anti").join(test_refs.select("id"), "id", "left_anti")


def without_sealed_subtypes(candidates: DataFrame, supers: DataFrame, sealed: DataFrame, live: DataFrame) -> DataFrame:
    """``candidates`` (id) without those that have a direct super (id, parent) that is sealed and live."""
    kept = supers.join(sealed.select("parent").distinct(), "parent").join(live.withColumnRenamed("id", "parent"), "parent", "left_semi")
    return candidates.join(kept.select("id"), "id", "left_anti")
