"""Queries of the source-code operators: small programs are written from rows of the tables, and read again.

What a program means is known from its rows, so each query has SQL that never sees a program.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.catalogue import _EDGES, _edges, query
from tidewrack.functions import declarations as says
from tidewrack.functions.globs import excluded_path, path_role, selected
from tidewrack.operators import ordering
from tidewrack.plans import dedupe, reachability
from tidewrack.plans.lineage import cut
from tidewrack.sources import dart, diffs, package, slices, workspace


def _text(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _joined(first: str, last: str, one, separator: str = "") -> Column:
    """``one`` of each number from ``first`` to ``last``, which are SQL, joined; empty if there is none."""
    numbers = F.expr(f"if({last} < {first}, array(), sequence(cast({first} as int), cast({last} as int)))")
    return F.array_join(F.transform(numbers, one), separator)


# paths, lines, diffs

_PATHS = ("lib/a{}.dart", "lib/src/a{}.dart", "lib/src/a{}.g.dart", "build/a{}.dart", "lib/build/a{}.dart", "test/.dart_tool/a{}.dart", "test/a{}.dart", "bin/a{}.txt", "example/native_a{}.dart", "web/x/a{}.dart", "a{}.dart")
_KEPT = {0: "publicLib", 1: "internalSrc", 4: "publicLib", 6: "test", 9: "auxiliary", 10: "other"}


@query(f"SELECT doc_id, CASE doc_id % {len(_PATHS)} {' '.join(f'WHEN {k} THEN {chr(39)}{r}{chr(39)}' for k, r in _KEPT.items())} END AS role FROM documents WHERE doc_id % {len(_PATHS)} IN {tuple(_KEPT)}")
def path_filters(t):
    """Which of several kinds of paths a scan keeps, and their roles."""
    kinds = F.array(*(F.format_string(p.replace("{}", "%s"), F.col("doc_id")) for p in _PATHS))
    rows = t("documents").select("doc_id", F.get(kinds, (F.col("doc_id") % len(_PATHS)).cast("int")).alias("path"))
    return rows.where(selected(F.col("path")) & ~excluded_path(F.col("path"))).select("doc_id", path_role(F.col("path")).alias("role"))


@query(r"""SELECT doc_id, CASE WHEN len(l) >= 2 THEN regexp_replace(array_to_string(l[2:3], chr(10)), '^\s+|\s+$', '', 'g') ELSE '' END AS snippet FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)""")
def line_snippets(t):
    """Lines 2 and 3 of each text, as far as there are any."""
    return t("documents").select("doc_id", dedupe.lines_of(F.col("text"), F.lit(2), F.lit(3)).alias("snippet"))


@query("""WITH n AS (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) + doc_id % 7 AS n FROM documents),
l AS (SELECT doc_id, unnest(range(1, n + 1)) AS i FROM n), p AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM l WHERE i % 5 IN (1, 2))
SELECT doc_id, min(i) AS start, max(i) AS "end" FROM p GROUP BY doc_id, g""")
def unified_diff_ranges(t):
    """A diff for each document, as long as it and some lines more, with added, removed and kept lines; paths from a folder."""
    n = (F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)) + F.col("doc_id") % 7).cast("int")
    docs = t("documents").select("doc_id", n.alias("n"), F.when(F.col("doc_id") % 2 == 0, "pkg/sub").otherwise("pkg").alias("folder"))
    line = lambda i: F.when(i % 5 == 1, F.concat(F.lit("-gone\n+line "), i.cast("string"))).when(i % 5 == 2, F.concat(F.lit("+line "), i.cast("string"))).otherwise(F.concat(F.lit(" line "), i.cast("string")))
    path = _text(F.col("folder"), "/d", F.col("doc_id"), ".txt")
    removed = F.size(F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: i % 5 == 1))
    kept = F.size(F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: (i % 5 != 1) & (i % 5 != 2)))
    text = _text("diff --git a/", path, " b/", path, "\n--- a/", path, "\n+++ b/", path, "\n@@ -1,", (removed + kept).cast("string"), " +1,", F.col("n").cast("string"), " @@\n", _joined("1", "n", line, "\n"), "\n")
    ranges = diffs.relative_to(diffs.changed_ranges(docs.select(F.col("doc_id").cast("string").alias("diff_id"), text.alias("text"))), "pkg")
    return ranges.select(F.regexp_extract("path", r"^(?:sub/)?d(\d+)\.txt$", 1).cast("long").alias("doc_id"), "start", "end")


# declarations

_ANNOTATIONS = (("meta.protected",), ("Native",), ("JS",), ("pragma",), ("visibleForTesting.named",), ())
_PRAGMAS = ("vm:entry-point", "wasm:export:name", "flutter:entrypoint", "inline")


@query("""SELECT support, native, entry, external, count(*) AS n FROM (SELECT p_size % 6 IN (0, 4) OR p_brand IN ('Brand#1', 'Brand#2') AS support, p_size % 6 = 1 OR (p_size % 6 = 3 AND p_partkey % 4 = 0) AS native,
p_size % 6 = 3 AND p_partkey % 4 <> 3 AS entry, p_size % 6 = 2 OR p_size >= 48 AS external FROM part) GROUP BY ALL""")
def declaration_flags(t):
    """What annotations, pragmas and names say of declarations, by the framework adapters."""
    annotations = F.get(F.array(*(F.array(*map(F.lit, a)).cast("array<string>") for a in _ANNOTATIONS)), F.col("p_size") % 6)
    pragma = F.get(F.array(*map(F.lit, _PRAGMAS)), (F.col("p_partkey") % 4).cast("int"))
    rows = t("part").select(
        F.when(F.col("p_brand") == "Brand#1", "FakePart").when(F.col("p_brand") == "Brand#2", "PartMock").otherwise("Part").alias("name"), annotations.alias("a"),
        F.when(F.col("p_size") % 6 == 3, F.array(pragma)).alias("p"), F.when(F.col("p_size") >= 48, "JSObject").otherwise("String").alias("of"),
    )
    adapter = says.Composite()
    flags = rows.select(
        says.is_test_support(F.col("name"), F.col("a")).alias("support"), says.is_native_or_entry(F.col("a"), F.col("p")).alias("native"),
        adapter.is_entry_point(F.col("p")).alias("entry"), adapter.is_external_binding(F.col("a"), F.lit(None).cast("boolean"), F.col("of")).alias("external"),
    )
    return flags.groupBy("support", "native", "entry", "external").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS orderkey, 'f' || o_orderkey AS name, n * (n + 1) // 2 + CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS score, row_number() OVER (
ORDER BY n * (n + 1) // 2 + CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END DESC, o_orderkey) AS place FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def dart_nesting_scores(t):
    """A function for each order, with as many nested conditions as it has lines; scored and put in order."""
    n = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").cast("int").alias("n"))
    rows = t("orders").select("o_orderkey").join(n, "o_orderkey")
    body = _text(F.repeat(F.lit("  if (x > 0) {\n"), F.col("n")), "print(x);", F.repeat(F.lit("}\n"), F.col("n")))
    more = _text(F.when(F.col("o_orderkey") % 3 == 0, "  final y = x > 1 && x < 5 || x == 9;\n").otherwise(""), F.when(F.col("o_orderkey") % 2 == 0, "  for (final i in items) print(i);\n").otherwise(""))
    files = rows.select(F.col("o_orderkey").cast("string").alias("path"), _text("int f", F.col("o_orderkey"), "(int x) {\n", body, more, "  return x;\n}\n").alias("content"))
    scores = dart.complexity_rows(files).select(F.col("path").cast("long").alias("orderkey"), "name", F.col("score").cast("long").alias("score"))
    return ordering.placed(scores, [F.desc("score"), F.asc("orderkey")])


@query(f"""WITH RECURSIVE {_EDGES}, im AS (SELECT p_partkey AS id FROM part WHERE p_brand = 'Brand#1'),
pr AS (SELECT id FROM im UNION SELECT dst FROM pr JOIN ed ON src = id),
si AS (SELECT DISTINCT l_orderkey AS site, l_partkey AS id FROM lineitem WHERE l_quantity >= 49), te AS (SELECT DISTINCT id FROM si UNION SELECT dst FROM te JOIN ed ON src = id),
hz AS (SELECT DISTINCT s.id FROM si s WHERE EXISTS (SELECT 1 FROM si x WHERE x.site = s.site AND x.id IN (SELECT id FROM pr)))
SELECT p_partkey AS part_id, CASE WHEN p_partkey NOT IN (SELECT id FROM te) THEN 'pureUndead' WHEN p_partkey IN (SELECT id FROM hz) THEN 'coInvokedHazard' ELSE 'testedUndead' END AS classification
FROM part WHERE p_partkey NOT IN (SELECT id FROM pr) AND p_size <> 7 AND NOT (p_size >= 45 AND p_partkey IN (SELECT id FROM te))""")
def dart_dead_parts(t):
    """A package with a function for each part, which calls the parts bought with it; a command runs Brand#1, tests run
    large orders. Sizes from 45 on are test support by their annotation, size 7 is ignored by a comment."""
    edges, parts = cut(_edges(t)), t("part").select("p_partkey", "p_size", "p_brand")
    calls = edges.groupBy(F.col("src").alias("p_partkey")).agg(F.array_sort(F.collect_list("dst")).alias("dst"))
    name = lambda i: _text("p", i.cast("string"))
    imports = lambda ids: F.array_join(F.transform(ids, lambda i: _text("import 'package:pkg/src/p", i.cast("string"), ".dart';")), "\n")
    run = lambda ids: F.array_join(F.transform(ids, lambda i: _text(name(i), "();")), " ")
    rows = parts.join(calls, "p_partkey", "left").withColumn("dst", F.coalesce("dst", F.array().cast("array<bigint>")))
    marks = _text(F.when(F.col("p_size") == 7, "// tidewrack:ignore\n").otherwise(""), F.when(F.col("p_size") >= 45, "@visibleForTesting\n").otherwise(""))
    files = rows.select(_text("lib/src/p", F.col("p_partkey"), ".dart").alias("path"), _text(imports(F.col("dst")), "\n", marks, "void ", name(F.col("p_partkey")), "() { ", run(F.col("dst")), " }\n").alias("content"))
    first = parts.where("p_brand = 'Brand#1'").agg(F.array_sort(F.collect_list("p_partkey")).alias("ids"))
    files = files.union(first.select(F.lit("bin/run.dart"), _text(imports(F.col("ids")), "\nvoid main() { ", run(F.col("ids")), " }\n")))
    sites = t("lineitem").where("l_quantity >= 49").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("ids"))
    tests = sites.select(_text("test/o", F.col("l_orderkey"), "_test.dart"), _text(imports(F.col("ids")), "\nvoid main() { test('order ", F.col("l_orderkey"), "', () { ", run(F.col("ids")), " }); }\n"))
    facts = package.package_facts(files.union(tests), "pkg")
    found = reachability.analyze(facts).findings
    return found.select(F.substring("name", 2, 20).cast("long").alias("part_id"), "classification")


@query("""WITH n AS (SELECT s_nationkey AS nation, count(*) AS n FROM supplier GROUP BY 1 HAVING count(*) >= 2)
SELECT nation, n AS n_instances, 'identical' AS bucket, 'logic' AS category FROM n""")
def dart_clone_clusters(t):
    """A file for each supplier, whose function is that of its nation under a name of its own."""
    line = lambda i: _text("  if (total > ", i.cast("string"), ") total = total + call_", F.col("s_nationkey").cast("string"), "_", i.cast("string"), "(a, b);\n")
    text = _text("int own", F.col("s_suppkey"), "(int a, int b) {\n  var total = 0;\n", _joined("1", "8", line), "  return total;\n}\n")
    files = t("supplier").select(_text("n", F.col("s_nationkey"), "/s", F.col("s_suppkey"), ".dart").alias("path"), text.alias("content"))
    report = dedupe.detect(files, dedupe.DedupeOptions(max_bucket=None))
    nation = report.instances.groupBy("cluster").agg(F.min(F.regexp_extract("path", r"^n(\d+)/", 1).cast("long")).alias("nation"))
    return report.clusters.join(nation, "cluster").select("nation", "n_instances", "bucket", "category")


@query("""SELECT o_orderkey AS orderkey, 'v1' AS inputs, CASE WHEN n >= 3 THEN 'v' || (n - 1) ELSE '' END AS outputs, n % 2 = 0 AS is_clean,
CASE WHEN o_orderkey % 3 = 0 THEN 'Future<' || CASE WHEN n >= 3 THEN 'int' ELSE 'void' END || '> part(int v1) async' ELSE CASE WHEN n >= 3 THEN 'int' ELSE 'void' END || ' part(int v1)' END AS signature
FROM (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY 1) WHERE n >= 2""")
def dart_slice_signatures(t):
    """A function for each order, whose variables each come from the one before; the slice is its middle."""
    n = t("lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n")).where("n >= 2")
    step = lambda i: _text("  var v", i.cast("string"), " = v", (i - 1).cast("string"), " + 1;\n")
    leave = _text(F.when(F.col("n") % 2 == 1, "  if (v1 > 5) return;\n").otherwise("  print(v1);\n"), F.when(F.col("l_orderkey") % 3 == 0, "  await pause(v1);\n").otherwise("  print(1);\n"))
    text = _text("void f(int a) async {\n  var v1 = a + 1;\n", leave, _joined("2", "n - 1", step), "  print(v", (F.col("n") - 1).cast("string"), ");\n  print(a);\n}\n")
    requests = n.select(F.col("l_orderkey").cast("string").alias("unit"), text.alias("source"), F.lit(3).alias("start_line"), (F.col("n") + 2).alias("end_line"))
    report = slices.analyze(requests)
    return slices.signatures(report, "part").select(F.col("unit").cast("long").alias("orderkey"), "inputs", "outputs", "is_clean", "signature")


@query("""SELECT s_suppkey AS suppkey, s_name AS name FROM supplier WHERE s_acctbal > 0 AND s_name <> 'Supplier#1' AND s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey = 1)""")
def package_dependants(t):
    """Suppliers are packages, the parts that they ship what these depend on: who uses part 1."""
    packages = t("supplier").select(F.col("s_suppkey").alias("folder"), F.col("s_name").alias("name"), (F.col("s_acctbal") > 0).alias("has_config"))
    depends = t("lineitem").select(F.col("l_suppkey").alias("folder"), F.when(F.col("l_partkey") == 1, "Supplier#1").otherwise("else").alias("package"))
    return workspace.dependants(packages, depends, "Supplier#1").select(F.col("folder").alias("suppkey"), "name")
