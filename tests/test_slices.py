"""Slices of functions: what goes in, what comes out, what can't be moved."""

import pytest

from tidewrack.operators.dataflow import signature
from tidewrack.sources import slices

#: (name, source, first line, last line, inputs, mutations, outputs, escapes, signature)
CASES = [
    ("reads", "void f(int a, String b) {\n  print('x');\n  final sum = a + b.length;\n  print(sum);\n  print('y');\n}", 3, 4, "a b", "", "", [], "void _extracted(int a, String b)"),
    ("counter", "void f() {\n  int count = 0;\n  count += 5;\n  print('x');\n  print(count);\n}", 3, 4, "count", "count", "count", [], "int _extracted(int count)"),
    ("record", "void f(String token, int retry) {\n  bool ok = false;\n  if (token.isNotEmpty) {\n    ok = true;\n  }\n  final user = ok ? 'U_$token' : null;\n  if (ok && user != null) {\n    print(user);\n  }\n}",
     3, 6, "token ok", "ok", "ok user", [], "({bool ok, String? user}) _extracted(String token, bool ok)"),
    ("discarded", "void f() {\n  int x = 10;\n  final temp = x * 2;\n  print(temp);\n  final result = temp + 5;\n  print(result);\n}", 3, 5, "x", "", "result", [], "int _extracted(int x)"),
    ("property", "class M { int value = 0; }\nvoid f(M m) {\n  m.value = 42;\n  print(m.value);\n  print(m.value);\n}", 3, 4, "m", "", "", [], "void _extracted(M m)"),
    ("async", "Future<void> f(String url) async {\n  final r = await Future.value('d $url');\n  print('x');\n  print(r);\n}", 2, 3, "url", "", "r", [], "Future<String> _extracted(String url) async"),
    ("method", "class S {\n  void run(int id) {\n    final p = 'ID';\n    final m = '$p ${id + 1}';\n    print(m);\n    print(m.length);\n  }\n}", 4, 5, "p id", "", "m", [], "String _extracted(String p, int id)"),
    ("fields", "const String top = 'P';\nclass A {\n  static const int most = 3;\n  void run(int n) {\n    final again = n < most;\n    print('$top $again');\n  }\n}", 5, 6, "n", "", "", [], "void _extracted(int n)"),
    ("swap", "void f(int a, int b) {\n  print('x');\n  (a, b) = (b, a);\n  print(a + b);\n}", 3, 3, "b a", "a b", "a b", [], "({int a, int b}) _extracted(int b, int a)"),
    ("stream", "void f(Stream<int> s) async {\n  print('x');\n  await for (final item in s) {\n    print(item);\n  }\n  print('y');\n}", 3, 5, "s", "", "", [], "Future<void> _extracted(Stream<int> s) async"),
    ("private", "void f() {\n  int _n = 0;\n  int _m = 1;\n  _n += 1;\n  _m += 2;\n  print('$_n $_m');\n}", 4, 5, "_n _m", "_n _m", "_n _m", [], "({int n, int m}) _extracted(int _n, int _m)"),
    ("promoted", "void f(Object o) {\n  if (o is String) {\n    print(o.length);\n    print(o.trim());\n  }\n}", 3, 4, "o", "", "", [], "void _extracted(String o)"),
    ("generic", "T f<T extends num, U>(T item) {\n  print(item);\n  return item;\n}", 2, 2, "item", "", "", [], "void _extracted<T extends num>(T item)"),
    ("carried", "void f(List<int> items) {\n  var total = 0;\n  for (var i = 0; i < items.length; i++) {\n    print(total);\n    total = total + items[i];\n  }\n}", 5, 5, "total items i", "total", "total", [],
     "int _extracted(int total, List<int> items, int i)"),
    ("never read", "void f(List<int> items) {\n  var flag = 0;\n  for (var i = 0; i < items.length; i++) {\n    flag = i;\n  }\n}", 4, 4, "flag i", "flag", "", [], "void _extracted(int flag, int i)"),
    ("fresh", "void f(List<int> items) {\n  for (final item in items) {\n    var acc = 0;\n    print(acc);\n    acc = item * 2;\n  }\n}", 5, 5, "acc item", "acc", "", [], "void _extracted(int acc, int item)"),
    ("header", "void f(List<int> items) {\n  for (var i = 0; i < items.length; i++) {\n    i += items[i];\n  }\n}", 3, 3, "i items", "i", "i", [], "int _extracted(int i, List<int> items)"),
    ("for in", "void f(List<int> items) {\n  for (var item in items) {\n    print(item);\n    item = item * 2;\n  }\n}", 4, 4, "item", "item", "", [], "void _extracted(int item)"),
    ("return", "void f(int x) {\n  print('a');\n  if (x < 0) {\n    return;\n  }\n  print('b');\n}", 3, 5, "x", "", "", [("earlyReturn", 4)], None),
    ("lambda", "void f(List<int> ns) {\n  print('a');\n  final evens = ns.where((n) {\n    return n % 2 == 0;\n  }).toList();\n  print(evens);\n}", 3, 5, "ns", "", "evens", [], None),
    ("break", "void f(List<String> items) {\n  for (final item in items) {\n    if (item == 's') {\n      break;\n    }\n    print(item);\n  }\n}", 3, 5, "item", "", "", [("loopBreak", 4)], None),
    ("own break", "void f() {\n  print('a');\n  for (var i = 0; i < 10; i++) {\n    if (i == 5) {\n      break;\n    }\n  }\n  print('b');\n}", 3, 7, "", "", "", [], None),
    ("switch", "void f(int c) {\n  print('a');\n  switch (c) {\n    case 1:\n      print('1');\n      break;\n    default:\n      print('2');\n  }\n}", 3, 9, "c", "", "", [], None),
    ("continue", "void f(List<int> items) {\n  for (final item in items) {\n    switch (item) {\n      case 0:\n        continue;\n      default:\n        print(item);\n    }\n  }\n}", 3, 8, "item", "", "", [("loopContinue", 5)], None),
    ("yield", "Iterable<int> f(int n) sync* {\n  print('a');\n  yield n;\n  print('b');\n}", 3, 4, "n", "", "", [("yieldEscape", 3)], None),
    ("label", "void f() {\n  outer:\n  for (var i = 0; i < 10; i++) {\n    for (var j = 0; j < 5; j++) {\n      if (j == 2) break outer;\n    }\n  }\n}", 4, 6, "", "", "", [("loopBreak", 5)], None),
    ("rethrow", "void f() {\n  try {\n    print('d');\n  } catch (e) {\n    print('F $e');\n    rethrow;\n  }\n}", 5, 6, "e", "", "", [("rethrowEscape", 6)], None),
    ("closure", "void f(B b) {\n  int count = 0;\n  b.onClick = () {\n    count++;\n  };\n}", 3, 5, "b count", "count", "", [("closureEscape", 4)], None),
    ("pattern in closure", "void f(B x) {\n  int a = 0;\n  int b = 1;\n  x.onClick = () {\n    (a, b) = (b, a);\n  };\n}", 4, 6, "x b a", "a b", "", [("closureEscape", 5), ("closureEscape", 5)], None),
    ("constructor", "class P {\n  final int x;\n  P(int a)\n      : x = a * 2 {\n    print(a);\n  }\n}", 4, 4, "a", "", "", [("constructorInitializerEscape", 4)], None),
    ("twice", "void f() {\n  int x = 0;\n  x = 1;\n  x = 2;\n  print(x);\n}", 3, 4, "x", "x", "x", [], "int _extracted(int x)"),
    ("pattern", "void f() {\n  final (a, b) = pair();\n  print(a);\n  print(b);\n}", 2, 3, "", "", "b", [], None),
    ("one way", "void f(int a, int b) {\n  (a, b) = (1, 2);\n  print(a);\n}", 2, 2, "", "a b", "a", [], "int _extracted()"),
]


@pytest.fixture(scope="module")
def got(spark):
    rows = [(c[0], c[1], c[2], c[3]) for c in CASES]
    rows += [("outside", "int a = 1;\nint b = 2;\n", 1, 2), ("swapped", "void f() {}", 2, 1), ("behind", "void f() {}", 9, 9), ("null", None, 1, 1), ("line 0", "void f() {}", 0, 1)]
    return slices.results(slices.analyze(spark.createDataFrame(rows, "unit string, source string, start_line int, end_line int")))


@pytest.mark.parametrize("case", CASES, ids=[c[0] for c in CASES])
def test_slice(got, case):
    name, _, _, _, ins, muts, outs, escapes, says = case
    r = got[name]
    names = lambda k: sorted(v["name"] for v in r[k])
    assert (names("inputs"), names("mutations"), names("outputs")) == (sorted(ins.split()), sorted(muts.split()), sorted(outs.split()))
    assert [(e["type"], e["line"]) for e in r["escapes"]] == escapes and r["isCleanlyExtractable"] == (not escapes)
    if says:
        assert r["suggestedSignature"] == says


def test_lines_of_first_mutations(got):
    assert [v["mutationLine"] for v in got["twice"]["mutations"]] == [3] and got["twice"]["inputs"][0]["declarationLine"] == 2
    assert "count" in got["closure"]["escapes"][0]["description"] and got["method"]["enclosing"] == "run"


def test_bad_requests(got):
    assert all(set(got[k]) == {"error"} for k in ("outside", "swapped", "behind", "null", "line 0"))


def test_signature_fields():
    assert signature("f", [], [("a", "int"), ("_a", "int"), ("a2", "int"), ("_", "bool")]) == "({int a, int a2, int a22, bool result}) f()"
    assert signature("f", [("x", "T")], [], True, ["T"]) == "Future<void> f<T>(T x) async"


def test_facts_are_not_broadcast_by_a_guessed_size(spark, tmp_path):
    """Spark took the events of many functions for little more than the requests, and sent them through the driver."""
    from tidewrack.sources import slices

    rows = [("1", "int f(int a) {\n  var b = a;\n  print(b);\n  return b;\n}\n", 2, 3)]
    spark.createDataFrame(rows, "unit string, source string, start_line int, end_line int").write.parquet(str(tmp_path / "requests"))
    report = slices.analyze(spark.read.parquet(str(tmp_path / "requests")))
    for part in (report.units, report.inputs, report.outputs, report.mutations):
        assert "BroadcastHashJoin" not in part._jdf.queryExecution().executedPlan().toString()
    assert [r.name for r in report.inputs.collect()] == ["a"]
