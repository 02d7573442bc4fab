import pytest

from tidewrack.functions import globs
from tidewrack.operators import dataflow
from tidewrack.sources import cache, dart, diffs, files

SCORES = [
    ("", 0), ("if (a) b();", 1), ("if (a) { b(); } else { c(); }", 2), ("final x = a ? b : c;", 1), ("final x = a ? b : c ? d : e;", 3),
    ("if (a && b && c) d();", 2), ("if (a && b || c) d();", 3), ("if ((a && b) && c) d();", 2), ("final x = a && b && c;", 1),
    ("if (a) { if (b) { c(); } }", 3), ("if (a) {} else if (b) {} else if (c) {} else {}", 4), ("if (a) {} else if (b) { if (c) {} }", 4),
    ("for (var i = 0; i < 3; i++) f();", 1), ("while (a) f();", 1), ("do { f(); } while (a);", 1), ("for (final x in y) { while (a) {} }", 3),
    ("switch (a) { case 1: f(); break; case 2: g(); break; default: h(); }", 1), ("switch (a) { case 1: if (b) f(); }", 3),
    ("try { f(); } catch (e) { g(); }", 1), ("try { f(); } on X catch (e) { if (a) g(); } finally { h(); }", 3),
    ("xs.forEach((x) { if (x) f(); });", 2), ("outer: for (;;) { break outer; }", 2), ("final xs = [if (a) 1 else 2];", 2),
    ("final s = 'if (a) && b'; // if (c)", 0), ("int? x = f(a?.b ?? c);", 0),
]


@pytest.mark.parametrize("code,score", SCORES)
def test_scores(code, score):
    assert dart.snippet_score(code) == score


def test_declarations():
    src = """class A extends B {
  A(this.x) : y = 1 { if (x) f(); }
  A.named();
  int get v => x ? 1 : 2;
  void m(int a) async {
    for (final b in c) { if (b) d(); }
  }
}
int top(x) => x && y ? 1 : 0;
"""
    got = {n: (s, e, k) for n, s, e, k in dart.analyze(src)}
    assert got["A.m"] == (5, 7, 3) and got["A"] == (2, 2, 1) and got["top"][2] == 2 and got["get A.v"][2] == 1
    assert dart.analyze("}}} ((") == []


def test_tokens_and_units(spark):
    t = dart.tokenize("var a = 'x' + 0x1F; /* c */ // d\n b?.c ?? 2.5;")
    assert [x.norm() for x in t] == ["var", "a", "=", "<STR>", "+", "<NUM>", ";", "b", "?.", "c", "??", "<NUM>", ";"]
    assert (t[7].line, t[7].column) == (2, 2)
    src = "void f() {\n  if (a) {\n    b();\n    c();\n  }\n  do {\n g();\n } while (x);\n}\n"
    kinds = [k for k, *_ in dart.candidate_units(dart.tokenize(src), min_tokens=8, min_lines=3)]
    assert "if" in kinds and "do" not in kinds and "declaration" in kinds
    rows = files.from_memory(spark, {"a.dart": src, "b.dart": ""})
    assert dart.token_rows(rows).count() == len(dart.tokenize(src))
    assert [(r.name, r.score) for r in dart.complexity_rows(rows).collect()] == [("f", 2)]


DIFF = '''diff --git a/lib/a.dart b/lib/a.dart
--- a/lib/a.dart\t2020
+++ b/lib/a.dart
@@ -1,3 +1,5 @@ head
 x
+one
-gone
+two
 y
+three
\\ No newline at end of file
diff --git a/o.dart b/n.dart
rename from o.dart
rename to n.dart
diff --git a/d.dart b/d.dart
deleted file mode 100644
--- a/d.dart
+++ /dev/null
@@ -1 +0,0 @@
-x
'''


def test_diff(spark):
    a, b, c = diffs.parse(DIFF)
    assert a.new_path == "lib/a.dart" and a.ranges == [(2, 3), (5, 5)] and a.merged() == [(2, 3), (5, 5)]
    assert b.is_renamed and (b.old_path, b.new_path) == ("o.dart", "n.dart") and c.is_deleted and c.new_path is None
    two = diffs.parse("--- a\n+++ a\n@@ -1 +1,2 @@\n x\n+y\n--- b\n+++ b\n@@ -0,0 +1 @@\n+z\n")
    assert [(f.new_path, f.ranges) for f in two] == [("a", [(2, 2)]), ("b", [(1, 1)])]
    assert diffs.parse("") == []
    rows = diffs.changed_ranges(spark.createDataFrame([("d", DIFF)], "diff_id string, text string")).collect()
    assert [(r.path, r.start, r.end) for r in rows] == [("lib/a.dart", 2, 3), ("lib/a.dart", 5, 5)]


def test_globs(spark):
    import re

    for glob, path, hit in [
        ("**/*.g.dart", "a/b.g.dart", True), ("**/*.g.dart", "b.g.dart", True), ("*.dart", "a/b.dart", False), ("lib/**", "lib/a/b.dart", True),
        ("a?.dart", "ab.dart", True), ("a?.dart", "a/.dart", False), ("a+b(1).dart", "a+b(1).dart", True),
    ]:
        assert bool(re.match(globs.glob_regex(glob), path)) == hit, glob
    assert re.match(globs.glob_regex("A*", case_sensitive=False), "abc")


def test_scan_and_cache(spark, tmp_path):
    for p, text in {"lib/a.dart": "a", "lib/src/b.dart": "b", "lib/c.g.dart": "c", "build/d.dart": "d", "test/e.dart": "e", "f.txt": "f"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(text)
    scan = lambda: files.source_files(spark, str(tmp_path))
    assert sorted((r.path, r.role) for r in scan().collect()) == [("lib/a.dart", "publicLib"), ("lib/src/b.dart", "internalSrc"), ("test/e.dart", "test")]
    seen = []

    def extract(df):
        rows = df.select("path", "content", "content_hash").collect()
        seen.append(sorted(r.path for r in rows))
        return spark.createDataFrame([(r.path, r.content_hash, len(r.content)) for r in rows], "path string, content_hash string, n int")

    c = cache.FactCache(spark, str(tmp_path / "cache"), cache.options_hash(40, 4))
    one = lambda: c.refreshed(scan().select("path", "content"), extract).collect()
    assert len(one()) == 3
    (tmp_path / "lib/a.dart").write_text("changed")
    (tmp_path / "test/e.dart").unlink()
    assert {(r.path, r.n) for r in one()} == {("lib/a.dart", 7), ("lib/src/b.dart", 1)} and seen[-1] == ["lib/a.dart"]
    c.clear()
    assert c.facts() is None


def test_signature():
    assert dataflow.signature("f", [("a", "int")], []) == "void f(int a)"
    assert dataflow.signature("f", [], [("a", "int")], True) == "Future<int> f() async"
    assert dataflow.signature("f", [], [("_a", "int"), ("a", "String")]) == "({int a, String a2}) f()"
