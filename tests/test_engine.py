import json

import pytest

from tidewrack import cli, reports
from tidewrack.operators import complexity, graph, ranges
from tidewrack.plans.dedupe import DedupeOptions, detect
from tidewrack.sources import files

BODY = "\n".join(f"  final v{i} = compute(a, b) + {i};\n  if (v{i} > b) {{ print('x{i}'); }}" for i in range(6))
A = f"int first(int a, int b) {{\n{BODY}\n  return a;\n}}\n"
C = f"class K {{\n  void other() {{}}\n}}\nint first(int a, int b) {{\n{BODY.replace('x1', 'zz')}\n  return a;\n}}\n"


def test_detect(spark):
    r = detect(files.from_memory(spark, {"a.dart": A, "c.dart": C, "d.dart": "void f() {}\n"}), DedupeOptions(20, 4))
    s = r.summary.first()
    assert s.files == 3 and s.clusters == 1 and s.dup_lines > 20 and s.lines_saved > 0
    x = json.loads(reports.dedupe_json(r))
    assert len(x["clusters"][0]["instances"]) == 2 and x["clusters"][0]["instances"][0]["filePath"] == "a.dart"
    assert "a.dart" in reports.dedupe_markdown(r)
    assert reports.read_dedupe_json(json.dumps(x))["clusters"][0]["isNew"] is False
    changed = spark.createDataFrame([("a.dart", 3, 3)], "path string, start int, end int")
    f = detect(files.from_memory(spark, {"a.dart": A, "c.dart": C}), DedupeOptions(20, 4), changed).clusters.first()
    assert f.intersects_diff and not f.is_new


def test_detect_nothing(spark):
    r = detect(files.from_memory(spark, {"d.dart": "void f() {}\n"}), DedupeOptions())
    assert r.summary.first().clusters == 0 and r.summary.first().dup_pct == 0
    with pytest.raises(ValueError):
        DedupeOptions(min_tokens=0)


def test_cli(spark, tmp_path):
    for name, text in {"a.dart": A, "c.dart": C}.items():
        (tmp_path / name).write_text(text)
    said = []
    run = lambda *argv: cli.run(list(argv), spark, said.append)
    assert run("dedupe", str(tmp_path), "-k", "20", "--format", "json") == 0 and json.loads(said[-1])["summary"]["clusters"] == 1
    assert run("dedupe", str(tmp_path), "-k", "20", "--fail-threshold", "5") == 1
    assert run("complexity", str(tmp_path)) == 0 and "first" in said[-1]
    assert run("complexity", str(tmp_path), "-f", "3") == 1
    assert run("dedupe", str(tmp_path / "none")) == 66
    assert run("dedupe", str(tmp_path), "-k", "-3") == 64 and run("nothing") == 64
    old = tmp_path / "old"
    old.mkdir()
    (old / "a.dart").write_text("int first(int a, int b) { return a; }\n")
    assert run("complexity", str(tmp_path), "--old", str(old), "--fail-on-increase") == 1


def test_ranges(spark):
    r = spark.createDataFrame([("a", 1, 3), ("a", 4, 5), ("a", 7, 9), ("a", 8, 8), ("b", 1, 1)], "f string, start int, end int")
    assert sorted(map(tuple, ranges.merged(r, "f").collect())) == [("a", 1, 5), ("a", 7, 9), ("b", 1, 1)]
    none = spark.createDataFrame([], "doc_id string, start int, end int")
    inst = spark.createDataFrame([(1, "a", 1, 2)], "cluster int, doc_id string, start int, end int")
    assert tuple(ranges.diff_duplication(inst, none).first()) == (0, 0, 0.0)


def test_delta_rules(spark):
    key = "name string, score int"
    old = spark.createDataFrame([("a", 3), ("b", 5), ("c", 1), ("e", 1)], key)
    new = spark.createDataFrame([("a", 2), ("b", 9), ("d", 9), ("e", 1)], key)
    d = complexity.delta(old, new, ["name"])
    assert {r.name: r.status for r in d.collect()} == {"a": "improved", "b": "increased", "c": "removed", "d": "added", "e": "unchanged"}
    names = lambda **kw: sorted(r.name for r in complexity.violations(d, **kw).collect())
    assert names() == [] and names(threshold=8) == ["b", "d"] and names(fail_on_increase=True) == ["b"]
    assert names(threshold=9, fail_on_increase=True) == []
    twice = spark.createDataFrame([("a", 1, 1), ("a", 2, 5)], "name string, at int, score int")
    assert complexity.last_wins(twice, ["name"], "at").first().score == 5


def test_graph(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6), (9, 9)], "src long, dst long")
    assert sorted(r.id for r in graph.reachable(edges, ids(1)).collect()) == [1, 2, 3]
    assert graph.reachable(edges, ids()).count() == 0
    sealed = spark.createDataFrame([(2, 7)], "parent long, child long")
    assert sorted(r.id for r in graph.reachable(graph.with_sealed(edges, sealed), ids(1)).collect()) == [1, 2, 3, 7]
    sites = spark.createDataFrame([(1, 1), (1, 5), (2, 6)], "site long, id long")
    got = graph.classified(ids(1, 4, 5, 6, 8), ids(1), ids(5, 6, 8), ids(8), sites)
    assert {r.id: r.classification for r in got.collect()} == {4: "pureUndead", 5: "coInvokedHazard", 6: "testedUndead"}
    refs = spark.createDataFrame([(1, "e", None, None, None), (1, None, "p", "n", "o"), (1, None, "p", "x", "n"), (1, "z", "q", "x", "n")], "src long, element string, path string, name string, owner string")
    nodes = spark.createDataFrame([(2, "e", "p", "m"), (3, None, "p", "n")], "id long, element string, path string, name string")
    assert sorted(r.dst for r in graph.resolved(refs, nodes).collect()) == [2, 3]
    kept = graph.without_sealed_subtypes(ids(7, 8), spark.createDataFrame([(7, 2)], "id long, parent long"), sealed, ids(2))
    assert [r.id for r in kept.collect()] == [8]


def test_reach_over_many_rounds(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(5, 0), (50, 51), (3, 3), (None, 4), (7, None)], "src long, dst long")
    roots = spark.createDataFrame([(0,), (0,), (60,)], "id long")
    assert sorted(r.id for r in graph.reachable(edges, roots).collect()) == [*range(21), 60]


def test_what_rows_become_is_not_broadcast_by_the_size_of_the_input(spark):
    from pyspark.sql import functions as F
    from tidewrack.plans import lineage

    few = spark.range(3).select("id", F.explode(F.sequence(F.lit(1), F.lit(1000))).alias("x"))
    many = lineage.unsized(lineage.cut(few))
    assert many.count() == 3000
    assert many.alias("a").join(many.alias("b"), "x").count() == 9000
    plan = many.join(many.withColumnRenamed("id", "other"), "x")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    lineage.drop(many)


def test_rounds_of_components_release_what_they_moved(spark, monkeypatch):
    """Each round's shuffle files and plans stayed until the driver's JVM collected them, in a heap that grew meanwhile."""
    from tidewrack.plans import components

    calls = {"cut": 0, "release": 0}

    def counted(name, f):
        def run(*args):
            calls[name] += 1
            return f(*args)

        return run

    for name in calls:
        monkeypatch.setattr(components, name, counted(name, getattr(components, name, None)), raising=False)
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {tuple(x) for x in components.connected_components(path, "a", "b").collect()} == {(i, 0) for i in range(41)}
    assert calls["cut"] > 3 and calls["release"] == calls["cut"] - 2  # not before the first round, nor after the last
