"""From a package's files to its dead declarations."""

import pytest

from tidewrack.plans.reachability import ReachOptions, analyze
from tidewrack.sources import files, package


def found(spark, tree, pkg="pkg", extra=None, **options):
    facts = package.package_facts(files.from_memory(spark, tree), pkg, extra)
    report = analyze(facts, ReachOptions(**options))
    return {r.name: r.classification for r in report.findings.collect()}, report


BASE = {"lib/pkg.dart": "export 'src/live.dart';\n"}


def test_declarations_of_a_file():
    source = """
library pkg;
import 'dart:io' as io;
import 'a.dart' show A, B hide C;
export 'x.dart' if (dart.library.io == 'true') 'y.dart' if (dart.library.js) 'z.dart';
part 'p.dart';
@immutable @pragma('vm:entry-point') sealed class Shape<T extends Num> extends Base<Foo> with M1, p.M2 implements I { int area(int x) => x * factor; }
abstract final class Two = Base with M1;
mixin M on Shape {}
enum Color { red, green }
extension Ext on String { String shout() => upper(this); int get size2 => 1; }
extension type Id(JSObject o) {}
typedef Handler = void Function(int);
typedef int Old(String s);
Map<String, int> a = {'x': other}, b;
final c = make('$d ${e.f(g)}');
int get total => _sum;
set total(int v) { _sum = v; }
external void native();
// tidewrack:ignore
Future<List<int>> load<T>(T x, {required int named}) async { return call(named: x); }
var last;
"""
    f = package.parse_file(source)
    assert [(d.kind, d.uri, d.alternates, d.prefix, d.show, d.hide) for d in f.directives] == [
        ("import", "dart:io", [], "io", None, []), ("import", "a.dart", [], None, ["A", "B"], ["C"]),
        ("export", "x.dart", ["y.dart", "z.dart"], None, None, []), ("part", "p.dart", [], None, None, []),
    ]
    d = {(x.name, x.kind): x for x in f.declared}
    assert list(d) == [
        ("Shape", "class"), ("Two", "class"), ("M", "mixin"), ("Color", "enum"), ("Ext", "extension"), ("Id", "extensionType"), ("Handler", "typedef"), ("Old", "typedef"),
        ("a", "variable"), ("b", "variable"), ("c", "variable"), ("total", "getter"), ("total", "setter"), ("native", "function"), ("load", "function"), ("last", "variable"),
    ]
    shape = d["Shape", "class"]
    assert shape.sealed and shape.annotations == ["immutable", "pragma"] and shape.pragmas == ["vm:entry-point"] and shape.supers == ["Base", "M1", "p.M2", "I"]
    assert {"factor", "Foo", "Num"} <= set(shape.names) and d["Two", "class"].supers == ["Base", "M1"]
    assert d["Ext", "extension"].members == ["shout", "size2"] and d["Id", "extensionType"].extended_type == "JSObject"
    assert {"d", "e", "g", "make"} <= set(d["c", "variable"].names) and "other" in d["a", "variable"].names
    assert d["native", "function"].has_external and d["load", "function"].ignored and not d["last", "variable"].ignored
    assert "named" in d["load", "function"].names and (d["last", "variable"].line, d["last", "variable"].column) == (22, 5)
    assert package.parse_file(None).declared == [] and package.parse_file("}{)(").declared == []
    assert all(x.ignored for x in package.parse_file("// tidewrack:ignore_for_file\nint a = 1; void b() {}").declared)


def test_test_sites():
    f = package.parse_file("void test(String d, Function f) {}\nvoid main() { setUp(() { prepare(); }); group('g', () { test('adds', () { expect(add(1), 2); }); }); x.test('no'); testWidgets(name, (t) {}); }")
    assert [(s.description, s.line) for s in f.sites] == [("setUp", 2), ("adds", 2), (None, 2)]
    assert "add" in f.sites[1].names and "prepare" in f.sites[0].names


def test_uris():
    r = package.resolved_uri
    assert r("package:pkg/src/a.dart", "test/t.dart", "pkg") == "lib/src/a.dart" and r("package:other/a.dart", "lib/x.dart", "pkg") is None
    assert r("../a.dart", "lib/src/x.dart", "pkg") == "lib/a.dart" and r("dart:io", "lib/x.dart", "pkg") is None


def test_unexported_function(spark):
    got, report = found(spark, BASE | {"lib/src/live.dart": "void liveFunc() {}", "lib/src/dead.dart": "void deadFunc() {}"})
    assert got == {"deadFunc": "pureUndead"}
    (f,) = report.findings.collect()
    assert (f.kind, f.path, f.action, f.id) == ("function", "lib/src/dead.dart", "delete", "lib/src/dead.dart#function#deadFunc#0")
    assert report.summary.first().total_declarations == 2


TESTED = {"lib/src/live.dart": "class Live {}", "lib/src/old.dart": "class Old { String parse(String s) => s; }"}


@pytest.mark.parametrize("body, want", [("final p = Old(); p.parse('x');", "testedUndead"), ("Live(); Old();", "coInvokedHazard")])
def test_tests_of_dead_code(spark, body, want):
    test = f"import 'package:pkg/src/old.dart';\nimport 'package:pkg/pkg.dart';\nvoid test(String d, Function f) {{}}\nvoid main() {{ test('parses', () {{ {body} }}); }}"
    got, report = found(spark, BASE | TESTED | {"test/old_test.dart": test})
    assert got == {"Old": want}
    (o,) = report.orphan_sites.collect()
    assert (o.path, o.description, o.hazard) == ("test/old_test.dart", "parses", want == "coInvokedHazard")


def test_conditional_files(spark):
    tree = {
        "lib/pkg.dart": "export 'src/live.dart'; export 'src/io.dart' if (dart.library.js_interop) 'src/web.dart';",
        "lib/src/live.dart": "import 'stub.dart' if (dart.library.io) 'real.dart';\nclass Live {}",
        "lib/src/stub.dart": "class LiveStub {}", "lib/src/real.dart": "class LiveReal {}",
        "lib/src/io.dart": "class Impl {}", "lib/src/web.dart": "class WebImpl {}",
        "lib/src/dead.dart": "import 'dead_stub.dart' if (dart.library.io) 'dead_io.dart';\nclass Dead {}",
        "lib/src/dead_stub.dart": "class DeadStub {}", "lib/src/dead_io.dart": "class DeadIo {}",
    }
    assert set(found(spark, tree)[0]) == {"Dead", "DeadStub", "DeadIo"}


def test_names_through_exports_prefixes_extensions_and_parts(spark):
    tree = {
        "bin/run.dart": "import 'package:pkg/src/a.dart' as p show A;\nvoid main() { p.A().go().twice(); print('${p.A}'); helper(); }\nimport 'package:pkg/src/b.dart' hide hidden;",
        "lib/src/a.dart": "part 'a_part.dart';\nclass A { final x = fromPart(); }\nclass NotShown {}", "lib/src/a_part.dart": "part of 'a.dart';\nint fromPart() => 1;\nint unusedPart() => 2;",
        "lib/src/b.dart": "export 'c.dart' show helper;\nvoid hidden() {}", "lib/src/c.dart": "void helper() { _own(); }\nvoid _own() {}\nvoid other() {}\nextension Twice on int { int twice() => this * 2; }\nextension Never on int { int thrice() => 3; }",
    }
    got = set(found(spark, tree)[0])
    assert got == {"NotShown", "unusedPart", "hidden", "other", "Never", "Twice"}  # Twice isn't imported by bin/run.dart
    tree["lib/src/b.dart"] = "export 'c.dart';\nvoid hidden() {}"
    assert "Twice" not in found(spark, tree)[0]


def test_modes_and_sealed(spark):
    tree = BASE | {
        "lib/src/live.dart": "import 'shape.dart';\nint area(Shape s) => 1;", "lib/src/shape.dart": "sealed class Shape {}\nclass Round extends Shape {}\nclass Lone {}",
        "lib/other.dart": "class Feature {}", "example/e.dart": "import 'package:pkg/src/shape.dart';\nvoid demo() { Lone(); }",
    }
    assert found(spark, tree)[0] == {}
    assert set(found(spark, tree, example_mode="skip")[0]) == {"Lone"}
    tree["bin/a.dart"] = "import 'package:pkg/pkg.dart';\nvoid main() { area(null); }"
    assert set(found(spark, tree, mode="closedApp", example_mode="strict")[0]) == {"Lone", "demo", "Feature"}
