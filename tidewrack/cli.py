"""Command line: ``dedupe``, ``dead``, ``complexity`` and ``data-flow`` over source files.

Exit codes: 0 fine, 1 a gate failed, 64 wrong usage, 66 no such input, 69 something needed isn't there, 70 an error
inside, 78 the package isn't set up.
"""

from __future__ import annotations

import argparse
import os
import re
import sys

from tidewrack import reports
from tidewrack.functions.globs import DEFAULT_EXCLUDES
from tidewrack.plans.dedupe import BUCKETS, CATEGORIES

OK, FAILED, USAGE, NO_INPUT, UNAVAILABLE, SOFTWARE, CONFIG = 0, 1, 64, 66, 69, 70, 78


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        print(message, file=sys.stderr)
        raise SystemExit(USAGE)


def _count(text: str) -> int:
    n = int(text)
    if n < 0:
        raise argparse.ArgumentTypeError("a count can't be negative")
    return n


def _names(text: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in text.split(",") if x.strip())


def _lines(text: str) -> tuple[int, int]:
    m = re.fullmatch(r"\s*(\d+)(?:\s*[-:]\s*(\d+))?\s*", text)
    if not m:
        raise argparse.ArgumentTypeError("lines are START-END")
    return int(m[1]), int(m[2] or m[1])


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="tidewrack")
    sub = p.add_subparsers(dest="command", required=True, parser_class=_Parser)
    flag = argparse.BooleanOptionalAction
    d = sub.add_parser("dedupe")
    d.add_argument("path")
    d.add_argument("-f", "--format", choices=("markdown", "json", "text", "github"), default="markdown")
    d.add_argument("-k", "--min-tokens", type=_count, default=40)
    d.add_argument("-l", "--min-lines", type=_count, default=4)
    d.add_argument("--ignore-comments", action=flag, default=True, help="no effect: comments are never compared")
    d.add_argument("--ignore-literals", action=flag, default=True)
    d.add_argument("--ignore-identifiers", action=flag, default=False)
    d.add_argument("--category", choices=CATEGORIES, default="all")
    d.add_argument("--bucket", choices=BUCKETS, default="all")
    d.add_argument("--top", type=_count, default=0)
    d.add_argument("--files", action=flag, default=True, help="the table of files, in text")
    d.add_argument("--clusters", action=flag, default=True, help="the list of clusters, in text")
    d.add_argument("--fail-threshold", type=float)
    d.add_argument("--exclude", action="append", help="replaces the default list")
    d.add_argument("--include", action="append", default=[])
    d.add_argument("--diff", help="a unified diff; clusters tell what it touches")
    d.add_argument("-d", "--git-diff", metavar="REF", help="the same with git's diff against REF")
    d.add_argument("--only-changed", action="store_true")
    d.add_argument("--json-output")
    u = sub.add_parser("dead")
    u.add_argument("path")
    u.add_argument("--format", choices=("markdown", "json"), default="markdown")
    u.add_argument("--json-output")
    u.add_argument("--example-mode", choices=("demonstration", "strict", "skip"), default="demonstration")
    u.add_argument("-m", "--mode", choices=("library", "closedApp", "closed-app"), default="library")
    u.add_argument("--include-generated", action="store_true")
    u.add_argument("--fail-on-findings", action="store_true")
    u.add_argument("--test-support-patterns", type=_names, default=("Fake*", "Mock*"))
    u.add_argument("--ignore-name-patterns", type=_names, default=())
    u.add_argument("--extra-roots", type=_names, default=())
    u.add_argument("--ignore-external-bindings", action="store_true")
    u.add_argument("--workspace-discovery", action=flag, default=True)
    u.add_argument("--suggest-private", action="store_true")
    u.add_argument("--directive", default="tidewrack", help="what stands before :ignore in comments")
    c = sub.add_parser("complexity")
    c.add_argument("path")
    c.add_argument("--old", help="an earlier copy of the folder to compare with")
    c.add_argument("-d", "--git-diff", metavar="REF", help="compare with the merge base of REF")
    c.add_argument("-t", "--threshold", type=_count, default=0)
    c.add_argument("-f", "--fail-threshold", type=_count)
    c.add_argument("--fail-on-increase", action="store_true")
    c.add_argument("--format", choices=("text", "json", "github"), default="text")
    s = sub.add_parser("data-flow")
    s.add_argument("path", help="a file, or FILE:START-END")
    s.add_argument("-l", "--lines", type=_lines)
    s.add_argument("-n", "--name", default="_extracted")
    s.add_argument("--format", choices=("json", "text"), default="json")
    for x in (d, u, s):
        x.add_argument("--sdk-path", help="no effect: no compiler is used")
    return p


def run(argv: list[str], spark=None, out=print) -> int:
    from tidewrack.sources.git import GitError

    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    if a.command == "data-flow" and not a.lines and (m := re.fullmatch(r"(.*):(\d+-\d+)", a.path)):
        a.path, a.lines = m[1], _lines(m[2])
    if not os.path.exists(a.path):
        return NO_INPUT
    try:
        if spark is None:
            from tidewrack.session import local_session

            spark = local_session()
        return {"dedupe": _dedupe, "dead": _dead, "complexity": _complexity, "data-flow": _data_flow}[a.command](spark, a, out)
    except ValueError as e:
        print(e, file=sys.stderr)
        return USAGE
    except LookupError as e:
        print(e, file=sys.stderr)
        return CONFIG
    except GitError as e:
        print(e, file=sys.stderr)
        return UNAVAILABLE
    except Exception as e:  # noqa: BLE001
        print(e, file=sys.stderr)
        return SOFTWARE


def _written(path: str | None, text: str) -> None:
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)


def _dedupe(spark, a, out) -> int:
    from tidewrack.plans.dedupe import DedupeOptions, detect
    from tidewrack.sources import diffs, files
    from tidewrack.sources.git import Repository

    options = DedupeOptions(
        a.min_tokens, a.min_lines, a.ignore_literals, a.ignore_identifiers, category=a.category, bucket=a.bucket, top=a.top, fail_threshold=a.fail_threshold, only_changed=a.only_changed
    )
    changed = None
    if a.git_diff:
        changed = Repository(a.path).changed_ranges(spark, a.git_diff, a.path)
    elif a.diff:
        with open(a.diff) as f:
            text = f.read()
        changed = diffs.changed_ranges(spark.createDataFrame([("diff", text)], "diff_id string, text string")).drop("diff_id")
    scan = files.source_files(spark, a.path, a.include, a.exclude or DEFAULT_EXCLUDES).select("path", "content")
    report = detect(scan, options, changed)
    as_json = reports.dedupe_json(report) if a.format == "json" or a.json_output else ""
    _written(a.json_output, as_json)
    if a.format == "github":
        out(reports.dedupe_annotations(report))
        reports.step_summary(reports.dedupe_markdown(report, a.top), os.environ.get("GITHUB_STEP_SUMMARY"))
    elif a.format == "text":
        out(reports.dedupe_text(report, a.top, a.files, a.clusters))
    else:
        out(as_json if a.format == "json" else reports.dedupe_markdown(report, a.top))
    over = a.fail_threshold is not None and report.summary.first().dup_pct > a.fail_threshold
    return FAILED if over else OK


def _dead(spark, a, out) -> int:
    from tidewrack.functions import declarations as says
    from tidewrack.plans.reachability import ReachOptions, analyze
    from tidewrack.sources import package, workspace

    source = workspace.read_package(spark, a.path, a.include_generated, a.extra_roots, a.workspace_discovery)
    adapter = says.Composite(
        says.Flutter(workspace.plugin_classes(a.path), workspace.is_flutter_package(a.path)), says.Builders(workspace.builder_factories(a.path)), says.PackageTest(), says.Interop()
    )
    options = ReachOptions(
        "library" if a.mode == "library" else "closedApp", a.example_mode, a.ignore_external_bindings, a.test_support_patterns, a.ignore_name_patterns, a.suggest_private, adapter
    )
    report = analyze(package.package_facts(source.files, source.name, source.extra, a.directive), options)
    as_json = reports.reach_json(report, source.name) if a.format == "json" or a.json_output else ""
    _written(a.json_output, as_json)
    out(as_json if a.format == "json" else reports.reach_markdown(report))
    return FAILED if a.fail_on_findings and report.fails() else OK


def _complexity(spark, a, out) -> int:
    from pyspark.sql import functions as F

    from tidewrack.operators import complexity
    from tidewrack.sources import dart, files
    from tidewrack.sources.git import Repository

    if a.old or a.git_diff:
        key = ["path", "name"]
        if a.old:
            old, new = (dart.complexity_rows(files.source_files(spark, p, exclude=())) for p in (a.old, a.path))
        else:
            repo = Repository(a.path)
            base = repo.merge_base(a.git_diff)
            both = repo.snapshots(repo.changed_files(spark, base, [a.path]), base)
            old, new = (dart.complexity_rows(both.select("path", F.col(f"{k}_content").alias("content"))) for k in ("old", "new"))
        change = complexity.delta(complexity.last_wins(old, key, "start_line"), complexity.last_wins(new, key, "start_line"), key)
        listed = reports.rows(change.where("status <> 'unchanged'"), [F.desc("delta"), F.desc("new_score"), *key])
        if a.format == "json":
            out(reports.json.dumps([{k: r[k] for k in (*key, "old_score", "new_score", "delta", "status")} for r in listed], separators=(",", ":")))
        elif a.format == "github":
            out("\n".join(reports.annotation("warning", r["path"], 1, f"{r['name']}: {r['status']} by {r['delta']:+d}") for r in listed if r["delta"] > 0))
        else:
            out("\n".join(f"{r['delta']:+d}  {r['name']}  {r['path']}  {r['status']}" for r in listed))
        return FAILED if not complexity.violations(change, a.fail_threshold, a.fail_on_increase).isEmpty() else OK
    scores = dart.complexity_rows(files.source_files(spark, a.path, exclude=()))
    listed = reports.rows(scores, [F.desc("score"), "path", "start_line"])
    if a.format == "json":
        out(reports.complexity_json([r for r in listed if r["score"] >= a.threshold]))
    elif a.format == "github":
        out("\n".join(reports.annotation("warning", r["path"], r["start_line"], f"{r['name']} scores {r['score']}") for r in listed if r["score"] >= a.threshold))
        reports.step_summary(reports.complexity_markdown(listed, a.threshold), os.environ.get("GITHUB_STEP_SUMMARY"))
    else:
        out(reports.complexity_text(listed, a.threshold))
    return FAILED if a.fail_threshold is not None and any(r["score"] > a.fail_threshold for r in listed) else OK


def _data_flow(spark, a, out) -> int:
    from tidewrack.sources import slices
    from tidewrack.sources.workspace import read_text

    if not a.lines:
        raise ValueError("which lines? --lines START-END")
    request = spark.createDataFrame([("slice", read_text(a.path), *a.lines)], "unit string, source string, start_line int, end_line int")
    result = slices.results(slices.analyze(request), {"slice": a.name})["slice"]
    if "error" in result:
        raise ValueError(result["error"])
    out((reports.slice_json if a.format == "json" else reports.slice_text)(result, a.path, *a.lines))
    return OK


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
