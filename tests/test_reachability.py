import json

import pytest
from pyspark.sql import functions as F

from tidewrack import reports
from tidewrack.functions import declarations as says
from tidewrack.plans.reachability import PackageFacts, ReachOptions, analyze

NODE = "id string, path string, name string, kind string, line int, column int, length int, annotations array<string>, pragmas array<string>, has_external boolean, extended_type string, ignored boolean, sealed boolean, exported boolean"


def node(path, name, notes=None, pragmas=None, **flags):
    f = {"has_external": None, "extended_type": None, "ignored": None, "sealed": None, "exported": None} | flags
    return (f"{path}#{name}", path, name, "function", 1, 1, 9, notes, pragmas, *f.values())


def package(spark, nodes, refs=(), supers=(), groups=(), sites=(), site_refs=(), extra=()):
    table = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return PackageFacts(
        table(nodes, NODE), table(refs, "src string, dst string"), table(supers, "id string, parent string"), table(groups, "grp string, file string"),
        table(sites, "site string, path string, line int, column int, description string"), table(site_refs, "site string, id string"),
        table(extra, "path string, role string"),
    )


def found(report):
    return {r["name"]: (r["classification"], r["action"]) for r in report.findings.collect()}


API, SRC, TEST = "lib/a.dart", "lib/src/b.dart", "test/b_test.dart"


def test_classes(spark):
    nodes = [
        node(API, "api"), node(API, "_hidden"), node(SRC, "used"), node(SRC, "dead"), node(SRC, "tested"), node(SRC, "mixed"),
        node(SRC, "FakeClock"), node(SRC, "quiet", ignored=True), node(SRC, "called", ["ffi.Native"]), node(SRC, "traced", None, ["vm:entry-point"]), node(TEST, "main"),
    ]
    to = lambda a, b: (f"{a[0]}#{a[1]}", f"{b[0]}#{b[1]}")
    main = (TEST, "main")
    refs = [to((API, "api"), (SRC, "used")), *(to(main, (SRC, n)) for n in ("tested", "mixed", "used", "FakeClock")), to((SRC, "dead"), (SRC, "dead"))]
    sites = [("s1", TEST, 3, 1, "one"), ("s2", TEST, 7, 1, None)]
    site_refs = [("s1", f"{SRC}#tested"), ("s2", f"{SRC}#mixed"), ("s2", f"{SRC}#used")]
    r = analyze(package(spark, nodes, refs, sites=sites, site_refs=site_refs))
    assert found(r) == {
        "dead": ("pureUndead", "delete"), "tested": ("testedUndead", "deleteWithOrphanTests"), "mixed": ("coInvokedHazard", "manualRefactorHazard"),
    }
    assert {(x.id, x.line, x.hazard) for x in r.orphan_sites.collect()} == {(f"{SRC}#tested", 3, False), (f"{SRC}#mixed", 7, True)}
    assert r.summary.first().asDict() == {"total_declarations": 11, "pureUndead": 1, "testedUndead": 1, "coInvokedHazard": 1, "privateCandidate": 0}
    back = reports.read_reach_json(reports.reach_json(r, "p"))
    assert back["pureUndead"] == 1 and [f["name"] for f in back["findings"] if f["orphanTests"]] == ["mixed", "tested"] and len(back["findings"]) == 3
    assert "makePrivate" not in reports.reach_markdown(r) and r.fails()
    with pytest.raises(ValueError):
        reports.read_reach_json(json.dumps({"version": "1", "package": "p", "summary": {"totalDeclarations": 1}, "undead": [{"classification": "?"}]}))


def test_modes(spark):
    nodes = [node(API, "unusedFeature"), node("bin/x.dart", "main"), node("bin/x.dart", "helper"), node("example/e.dart", "main"), node("example/e.dart", "show"), node(SRC, "_x", exported=True)]
    facts = package(spark, nodes)
    assert set(found(analyze(facts))) == {"helper"}
    assert set(found(analyze(facts, ReachOptions(mode="closedApp")))) == {"unusedFeature", "helper", "_x"}
    assert set(found(analyze(facts, ReachOptions(example_mode="strict")))) == {"helper", "show"}
    skipped = analyze(facts, ReachOptions(example_mode="skip", ignore_name_patterns=("hel*",)))
    assert found(skipped) == {} and skipped.summary.first().total_declarations == 4 and not skipped.fails()
    with pytest.raises(ValueError):
        ReachOptions(mode="other")


def test_sealed_groups_and_extra_files(spark):
    io, web, dead = "lib/src/io.dart", "lib/src/web.dart", "lib/src/z.dart"
    nodes = [node(API, "Shape", sealed=True), node(SRC, "Circle"), node(io, "open"), node(web, "open"), node(web, "_own"), node(dead, "Gone"), node("plugins/p.dart", "run"), node(SRC, "onRun")]
    groups = [("g", API), ("g", io), ("g", web)]
    facts = package(spark, nodes, [("plugins/p.dart#run", f"{SRC}#onRun")], [(f"{SRC}#Circle", f"{API}#Shape")], groups, extra=[("plugins/p.dart", "other")])
    assert set(found(analyze(facts))) == {"Gone"}


def test_private_candidates(spark):
    nodes = [node(API, "api"), node(SRC, "helper"), node(SRC, "shared"), node(SRC, "seen"), node(SRC, "_own"), node(SRC, "entry"), node("lib/src/c.dart", "other")]
    a = lambda n, p=SRC: f"{p}#{n}"
    refs = [(a("api", API), a("entry")), (a("entry"), a("helper")), (a("entry"), a("shared")), (a("entry"), a("seen")), (a("entry"), a("_own")), (a("entry"), "lib/src/c.dart#other"), ("lib/src/c.dart#other", a("shared"))]
    facts = package(spark, nodes, refs, site_refs=[("s", a("seen"))])
    assert found(analyze(facts)) == {}
    assert found(analyze(facts, ReachOptions(suggest_private=True))) == {"helper": ("privateCandidate", "makePrivate")}


def test_empty_and_repeated(spark):
    r = analyze(package(spark, []))
    assert r.findings.count() == 0 and r.summary.first().total_declarations == 0
    twice = analyze(package(spark, [node(SRC, "dead")], [("no", "where")] * 2, extra=[(SRC, None)] * 2))
    assert found(twice) == {"dead": ("pureUndead", "delete")} and twice.findings.count() == 1


def test_predicates(spark):
    rows = spark.createDataFrame(
        [(["meta.protected"], ["wasm:export:f"], "MyMock", None), (["JS.named"], None, None, "JSObject"), (None, ["dart2js:noInline"], "test", "String")],
        "a array<string>, p array<string>, n string, t string",
    )
    both = says.Composite(says.Flutter(["Plug"], has_app=True), says.Builders(["make"]), says.PackageTest(), says.Interop())
    got = rows.select(
        says.is_test_support(F.col("n"), F.col("a")), says.is_native_or_entry(F.col("a"), F.col("p")), both.is_entry_point(F.col("p")),
        both.is_external_binding(F.col("a"), F.lit(None).cast("boolean"), F.col("t")), F.coalesce(both.is_test_call(F.col("n")), F.lit(False)),
    ).collect()
    assert [tuple(r) for r in got] == [(True, False, True, False, False), (False, False, False, True, False), (False, False, False, False, True)]
    assert both.roots() == {"Plug", "main", "make"}
