"""Dead declarations of a package: roots by role and mode, two searches, findings.

Input tables, by whatever front end extracted them:

- ``nodes`` (id, path, name, kind, line, column, length, annotations, pragmas, has_external, extended_type,
  ignored, sealed, exported)
- ``refs`` (src, dst), references between declarations; ``supers`` (id, parent)
- ``groups`` (grp, file), the files of a conditional import
- ``sites`` (site, path, line, column, description), test calls; ``site_refs`` (site, id)
- ``extra`` (path, role), files whose role is given: ``test``, or ``other`` for production

Null flags are false. Empty tables give an empty result and a summary of zeros.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions import declarations as says
from tidewrack.functions.globs import any_glob, path_role
from tidewrack.operators import graph
from tidewrack.plans.lineage import cut

MODES, EXAMPLES = ("library", "closedApp"), ("demonstration", "strict", "skip")


@dataclass(frozen=True)
class ReachOptions:
    mode: str = "library"
    example_mode: str = "demonstration"
    ignore_external_bindings: bool = False
    test_support_patterns: tuple[str, ...] = ("Fake*", "Mock*")
    ignore_name_patterns: tuple[str, ...] = ()
    suggest_private: bool = False
    adapter: says.FrameworkAdapter = field(default_factory=says.Composite)

    def __post_init__(self):
        if self.mode not in MODES or self.example_mode not in EXAMPLES:
            raise ValueError("unknown mode")


@dataclass(frozen=True)
class PackageFacts:
    nodes: DataFrame
    refs: DataFrame
    supers: DataFrame
    groups: DataFrame
    sites: DataFrame
    site_refs: DataFrame
    extra: DataFrame


@dataclass(frozen=True)
class ReachReport:
    """``findings`` (id, name, kind, path, line, column, length, classification, action, is_external_binding) in no
    order, ``orphan_sites`` (id, path, line, column, description, hazard) of the findings that tests touch, and
    ``summary`` of one row."""

    findings: DataFrame
    orphan_sites: DataFrame
    summary: DataFrame

    def fails(self) -> bool:
        """The gate: whether there is any finding."""
        return not self.findings.isEmpty()


def described(facts: PackageFacts, options: ReachOptions) -> DataFrame:
    """The nodes with role and flags."""
    n, c = facts.nodes, F.col
    flag = lambda x: F.coalesce(x, F.lit(False))
    role = F.coalesce(c("given"), path_role(c("path")))
    native = says.is_native_or_entry(c("annotations"), c("pragmas")) | options.adapter.is_entry_point(c("pragmas"))
    support = says.is_test_support(c("name"), c("annotations")) | any_glob(c("name"), options.test_support_patterns)
    external = options.adapter.is_external_binding(c("annotations"), c("has_external"), c("extended_type"))
    given = facts.extra.select("path", c("role").alias("given")).groupBy("path").agg(F.max("given").alias("given"))  # test before other
    rows = n.join(given, "path", "left").where(F.lit(options.example_mode != "skip") | (role != "demonstration"))
    return rows.select(
        "id", "path", "name", "kind", "line", "column", "length", role.alias("role"), flag(c("given") == "other").alias("extra"),
        *(flag(c(x)).alias(x) for x in ("ignored", "sealed", "exported")),
        flag(native).alias("native"), flag(support).alias("support"), flag(external).alias("external"),
    )


def exported(nodes: DataFrame, groups: DataFrame, options: ReachOptions) -> DataFrame:
    """(id) that users of the library can name: what its public files export or declare, and public declarations
    of the files that take such a file's place on some platform. None of a closed application."""
    if options.mode != "library":
        return nodes.select("id").limit(0)
    open_ = nodes.where(~F.col("name").startswith("_"))
    public = nodes.where("role = 'publicLib'").select(F.col("path").alias("file")).distinct()
    stands_in = groups.join(groups.join(public, "file").select("grp").distinct(), "grp").select(F.col("file").alias("path")).distinct()
    return (
        nodes.where("exported").select("id").union(open_.where("role = 'publicLib'").select("id"))
        .union(open_.join(stands_in, "path", "left_semi").select("id")).distinct()
    )


def _production_root(options: ReachOptions) -> Column:
    main, role = F.col("name") == "main", F.col("role")
    app = F.col("path").rlike(r"^lib/main(_[^/]*)?\.dart$")
    names = sorted(options.adapter.roots())
    named = F.col("name").isin(names) & (~main | app) if names else F.lit(False)
    example = (role == "demonstration") if options.example_mode == "demonstration" else (role == "demonstration") & main
    return (role.isin("executable", "auxiliary") & main) | example | F.col("native") | named | F.col("extra")


def _in_scope(options: ReachOptions) -> Column:
    role, main = F.col("role"), F.col("name") == "main"
    scope = (role == "internalSrc") | (role.isin("executable", "auxiliary") & ~main)
    if options.example_mode == "strict":
        scope |= (role == "demonstration") & ~main
    return scope | (role == "publicLib") if options.mode == "closedApp" else scope


def analyze(facts: PackageFacts, options: ReachOptions = ReachOptions()) -> ReachReport:
    """Search from production and from test roots, and classify what production doesn't reach."""
    nodes = cut(described(facts, options))
    known = nodes.select("id")
    refs = facts.refs.where("src <> dst")
    parents = nodes.where("sealed").select(F.col("id").alias("parent"))
    sealed = facts.supers.select("parent", F.col("id").alias("child")).join(parents, "parent", "left_semi")
    grouped = graph.group_edges(nodes.select("id", F.col("path").alias("file")), facts.groups)
    edges = cut(graph.with_sealed(refs.select("src", "dst").union(grouped), sealed))
    public = cut(exported(nodes, facts.groups, options))
    live = cut(graph.reachable(edges, nodes.where(_production_root(options)).select("id").union(public)).join(known, "id", "left_semi"))
    tested = cut(graph.reachable(edges, nodes.where("role = 'test'").select("id")).join(known, "id", "left_semi"))

    unnamed = ~any_glob(F.col("name"), options.ignore_name_patterns)
    scope = nodes.where(_in_scope(options) & unnamed & ~F.col("ignored"))
    if options.ignore_external_bindings:
        scope = scope.where(~F.col("external"))
    candidates = graph.without_sealed_subtypes(scope.select("id"), facts.supers.select("id", "parent"), sealed, live)
    found = graph.classified(candidates, live, tested, nodes.where("support").select("id"), facts.site_refs)
    if options.suggest_private:
        own = F.col("role") == "internalSrc"
        own = own | (F.col("role") == "publicLib") if options.mode == "closedApp" else own
        open_ = nodes.where(own & unnamed & ~F.col("name").startswith("_") & ~F.expr("ignored or native or external or support")).select("id")
        uses = refs.select("src", "dst").union(facts.supers.select("id", "parent"))
        shown = public.withColumn("shown", F.lit(True))
        files = nodes.select("id", F.col("path").alias("file")).join(shown, "id", "left").select("id", "file", F.col("shown").isNotNull().alias("exported"))
        private = graph.private_candidates(files, live, uses, facts.site_refs).join(open_, "id", "left_semi")
        found = found.union(private.select("id", F.lit("privateCandidate"), F.lit("makePrivate")))
    found = cut(found)
    at = nodes.select("id", "name", "kind", "path", "line", "column", "length", F.col("external").alias("is_external_binding"))
    findings = found.join(at, "id").select("id", "name", "kind", "path", "line", "column", "length", "classification", "action", "is_external_binding")
    touched = graph.hazards(facts.site_refs, live).join(found.where("classification in ('testedUndead', 'coInvokedHazard')").select("id"), "id", "left_semi")
    orphans = touched.join(facts.sites, "site").select("id", "path", "line", "column", "description", "hazard")
    kinds = ("pureUndead", "testedUndead", "coInvokedHazard", "privateCandidate")
    counts = found.agg(*(F.count_if(F.col("classification") == k).alias(k) for k in kinds))
    summary = nodes.agg(F.count("*").alias("total_declarations")).crossJoin(counts)  # one row each
    return ReachReport(findings, orphans, summary)
