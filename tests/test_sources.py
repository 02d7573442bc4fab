"""Files, workspaces, git, and the command line over them."""

import json
import subprocess

import pytest

from tidewrack import cli, reports
from tidewrack.plans import dedupe
from tidewrack.sources import diffs, files, git, workspace

BODY = "".join(f"  total = total + step{i}(a, {i});\n" for i in range(8))
TWICE = f"int one(int a) {{\n  var total = 0;\n{BODY}  return total;\n}}\n"


def tree(root, of):
    for path, text in of.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)


def ran(spark, *args):
    said = []
    return cli.run([str(a) for a in args], spark, said.append), "\n".join(said)


def test_single_file(spark, tmp_path):
    tree(tmp_path, {"a.dart": "void f(int x) { if (x > 0) { print(x); } }", "b.txt": "x", "build/c.dart": "void g() {}", "lib/build/d.dart": "int d = 1;", "empty.dart": ""})
    names = lambda p, **k: sorted(r.path for r in files.source_files(spark, str(p), **k).collect())
    assert names(tmp_path / "a.dart") == ["a.dart"] and names(tmp_path / "b.txt") == [] and names(tmp_path) == ["a.dart", "lib/build/d.dart"]
    assert names(tmp_path, tool_folders_only=True) == ["a.dart", "build/c.dart", "lib/build/d.dart"]
    assert ran(spark, "complexity", tmp_path / "a.dart", "-f", 0) == (1, "1  f  a.dart:1-1")
    assert ran(spark, "complexity", tmp_path / "no.dart")[0] == 66 and ran(spark, "complexity")[0] == 64


def test_dedupe_formats(spark, tmp_path, monkeypatch):
    tree(tmp_path, {"a.dart": TWICE, "b.dart": "// x\n" + TWICE.replace("one", "two"), "c.dart": "int c = 1;\n"})
    code, text = ran(spark, "dedupe", tmp_path, "--format", "text", "-k", 20)
    assert code == 0 and "1. " in text and "a.dart:" in text and "##" not in text and "c.dart" not in text
    assert "a.dart" not in ran(spark, "dedupe", tmp_path, "--format", "text", "-k", 20, "--no-files", "--no-clusters")[1]
    monkeypatch.setenv("GITHUB_STEP_SUMMARY", str(tmp_path / "summary.md"))
    code, text = ran(spark, "dedupe", tmp_path, "--format", "github", "-k", 20, "--json-output", tmp_path / "r.json", "--fail-threshold", 5)
    assert code == 1 and text.count("::warning file=") == 2 and "## Duplication" in (tmp_path / "summary.md").read_text()
    report = json.loads((tmp_path / "r.json").read_text())
    (c,) = report["clusters"]
    first = c["instances"][0]
    assert first["snippet"] == "\n".join(TWICE.split("\n")[first["startLine"] - 1 : first["endLine"]]).strip() and first["startColumn"] >= 1 and first["endColumn"] > 1
    assert ran(spark, "dedupe", tmp_path, "--bucket", "nothing")[0] == 64
    other = "identical" if c["bucket"] != "identical" else "gapped"
    assert "1. " not in ran(spark, "dedupe", tmp_path, "--format", "text", "-k", 20, "--bucket", other)[1]


def test_snippets(spark):
    spans = [("a", 1, 2), ("a", 2, 9), ("a", 5, 9), ("b", 1, 1), ("a", 0, 1), ("a", 2, 1)]
    rows = spark.createDataFrame(spans, "path string, start_line int, end_line int")
    got = dedupe.with_snippets(rows, files.from_memory(spark, {"a": "  x\ny\n z \n", "b": ""}))
    assert {(r.path, r.start_line, r.end_line): r.snippet for r in got.collect()} == dict(zip(spans, ["x\ny", "y\n z", "", "", "x", ""]))


def test_workspace(spark, tmp_path):
    spec = "name: core\nflutter:\n  plugin:\n    platforms:\n      ios:\n        pluginClass: CorePlugin\n      web:\n        dartPluginClass: none\n"
    tree(tmp_path, {
        ".git/HEAD": "", "core/pubspec.yaml": spec, "core/build.yaml": "builders:\n  a:\n    builder_factories: ['makeA', 'makeB']\n  b:\n    builder_factories: makeC\n",
        "core/.dart_tool/package_config.json": "{}", "core/lib/core.dart": "export 'src/used.dart' show Shown;", "core/lib/src/used.dart": "class Shown {}\nclass ByApp {}\nclass ByTest {}\nclass Dead {}\nclass Plain {}",
        "apps/app/pubspec.yaml": "name: app\ndependencies:\n  core:\n    path: ../../core\n", "apps/app/.dart_tool/package_config.json": "{}",
        "apps/app/lib/app.dart": "import 'package:core/src/used.dart';\nfinal x = ByApp();", "apps/app/test/t.dart": "import 'package:core/src/used.dart';\nvoid main() { test('t', () { ByTest(); }); }",
        "apps/bare/pubspec.yaml": "name: bare\ndependencies: {core: any}\n", "apps/else/pubspec.yaml": "name: else_\n", "apps/else/.dart_tool/package_config.json": "{}",
        "node_modules/x/pubspec.yaml": "name: x\ndependencies: {core: any}\n", "tool_dir/plain.dart": "import 'package:core/src/used.dart';\nPlain? p;",
    })
    root = str(tmp_path / "core")
    assert workspace.package_name(root) == "core" and workspace.find_workspace_root(root) == str(tmp_path)
    assert workspace.builder_factories(root) == {"makeA", "makeB", "makeC"} and workspace.plugin_classes(root) == {"CorePlugin"} and workspace.is_flutter_package(root)
    assert workspace.has_package_config(root) and workspace.has_enclosing_package_config(root + "/lib") and not workspace.has_enclosing_package_config(str(tmp_path / "apps"))
    app = str(tmp_path / "apps" / "app")
    assert workspace.consumers(spark, root) == [(app + "/lib", "other"), (app + "/test", "test")]
    assert workspace.roots_of(app) == [(app + "/lib", "other"), (app + "/test", "test")] and workspace.roots_of(root + "/lib/core.dart")[0][1] == "other"
    (tmp_path / "core/pubspec.yaml").write_text(spec + "  broken: [\n")
    assert workspace.plugin_classes(root) == {"CorePlugin"}
    (tmp_path / "core/pubspec.yaml").write_text("name: core\n")
    code, text = ran(spark, "dead", root, "--format", "json", "--fail-on-findings", "--extra-roots", "../tool_dir/plain.dart")
    found = {f["name"]: f["classification"] for f in json.loads(text)["undead"]}
    assert code == 1 and found == {"ByTest": "testedUndead", "Dead": "pureUndead"}
    code, text = ran(spark, "dead", root, "--no-workspace-discovery")
    assert code == 0 and all(f"| {n} |" in text for n in ("ByApp", "ByTest", "Dead", "Plain"))
    assert ran(spark, "dead", tmp_path)[0] == 78


def test_git(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", *a], cwd=tmp_path, check=True, capture_output=True)
    with pytest.raises(git.GitError):
        git.Repository(str(tmp_path))
    assert ran(spark, "complexity", tmp_path, "-d", "main")[0] == 69
    run("init", "-b", "main"), run("config", "user.email", "a@example.org"), run("config", "user.name", "a")
    old = "void f(int x) {\n  print(x);\n}\nvoid gone() { if (true) {} }\n"
    tree(tmp_path, {"lib/a.dart": old, "lib/d.dart": "int d = 1;\n", "tool/t.txt": "x\n"})
    run("add", "."), run("commit", "-m", "1")
    tree(tmp_path, {"lib/a.dart": "void f(int x) {\n  if (x > 0) {\n    print(x);\n  }\n}\n", "lib/é b.dart": "int e = 1;\n", "tool/t.txt": "y\n", "web/w.dart": "int w = 2;\n"})
    (tmp_path / "lib/d.dart").unlink()
    run("add", "."), run("commit", "-m", "2")
    repo = git.Repository(str(tmp_path / "lib"))
    names = lambda *t: sorted(r.path for r in repo.changed_files(spark, "HEAD~1", list(t)).collect())
    assert names() == ["lib/a.dart", "lib/é b.dart", "web/w.dart"] and names(str(tmp_path / "lib")) == ["lib/a.dart", "lib/é b.dart"]
    assert repo.merge_base("HEAD~1") == subprocess.run(["git", "rev-parse", "HEAD~1"], cwd=tmp_path, capture_output=True, text=True).stdout.strip()
    assert repo.content_at("HEAD~1", "lib/a.dart") == old and repo.content_at("HEAD~1", "web/w.dart") == "" and repo.current("lib/d.dart") == ""
    got = sorted(tuple(r) for r in repo.changed_ranges(spark, "HEAD~1", str(tmp_path / "lib")).collect())
    assert got == [("a.dart", 2, 4), ("é b.dart", 1, 1)]
    assert ran(spark, "complexity", tmp_path, "-d", "HEAD~1", "--fail-on-increase") == (1, "+1  f  lib/a.dart  increased\n-1  gone  lib/a.dart  removed")
    assert ran(spark, "dedupe", tmp_path / "lib", "-d", "HEAD~1", "--format", "json")[0] == 0


def test_relative_ranges(spark):
    rows = spark.createDataFrame([("a/b/c.dart", 1, 2), ("a/bb.dart", 3, 3), ("x.dart", 4, 4)], "path string, start int, end int")
    got = lambda f: sorted(r.path for r in diffs.relative_to(rows, f).collect())
    assert got("a/b") == ["c.dart"] and got("a") == ["b/c.dart", "bb.dart"] and got(".") == ["a/b/c.dart", "a/bb.dart", "x.dart"] and got("x.dart") == ["x.dart"]


def test_agreement_of_reports(spark, tmp_path):
    (tmp_path / "own.json").write_text(json.dumps({"clusters": [{"instances": [{"filePath": "./lib/a.dart", "startLine": 1, "endLine": 4}, {"filePath": "b.dart", "startLine": 2, "endLine": 2}]}]}))
    (tmp_path / "other.json").write_text(json.dumps({"metrics": {}, "clusters": [{"occurrences": [{"path": "lib/./a.dart", "start_line": 3, "end_line": 6}]}, {"occurrences": []}]}))
    (tmp_path / "none.json").write_text("{}")
    a, b, c = (reports.line_sets(spark, str(tmp_path / f"{n}.json")) for n in ("own", "other", "none"))
    assert a.count() == 5 and reports.line_sets(spark, str(tmp_path / "own.json"), 4).count() == 4 and c.count() == 0
    got = reports.agreement(a, b)
    assert (got["both"], got["only_a"], got["only_b"], got["union"]) == (2, 3, 2, 7) and reports.agreement(c, c)["jaccard_pct"] == 100.0


def test_data_flow_command(spark, tmp_path):
    tree(tmp_path, {"a.dart": "void f() {\n  int n = 0;\n  n += 5;\n  print(n);\n}\n"})
    code, text = ran(spark, "data-flow", f"{tmp_path}/a.dart:3-3", "-n", "more")
    r = json.loads(text)
    assert code == 0 and r["suggestedSignature"] == "int more(int n)" and (r["startLine"], r["enclosing"]) == (3, "f") and r["outputs"][0] == {"name": "n", "type": "int", "isMutated": True, "declarationLine": 2, "mutationLine": 3}
    assert ran(spark, "data-flow", tmp_path / "a.dart", "-l", "3-4", "--format", "text")[1].endswith("can be moved\nvoid _extracted(int n)")
    assert ran(spark, "data-flow", tmp_path / "a.dart", "-l", "9-9")[0] == 64 and ran(spark, "data-flow", tmp_path / "a.dart")[0] == 64 and ran(spark, "data-flow", tmp_path / "x.dart")[0] == 66
