"""Reports of small results: JSON, Markdown, text and annotations."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from tidewrack.plans.dedupe import DedupeReport


def rows(df: DataFrame, order: list, limit: int = 0) -> list[dict]:
    """The rows of a report's table in order; what is rendered is bounded by ``limit``, or all if 0."""
    out = df.orderBy(*order)
    return [r.asDict(recursive=True) for r in (out.limit(limit) if limit else out).collect()]


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(map(str.capitalize, rest))


def dedupe_json(report: DedupeReport) -> str:
    """All clusters with their instances; filters and limits don't apply here."""
    from pyspark.sql import functions as F

    instances: dict = {}
    for r in rows(report.instances, ["cluster", "path", "start"]):
        one = {"filePath": r["path"], "startLine": r["start_line"], "startColumn": r["start_column"], "endLine": r["end_line"], "endColumn": r["end_column"], "tokenCount": r["n_tokens"], "snippet": r["snippet"]}
        instances.setdefault(r["cluster"], []).append(one)
    found = rows(report.clusters, [F.desc("lines_saved"), F.desc("token_count"), "cluster"])
    listed = [
        {"id": f"cluster-{i}"} | {camel(k): v for k, v in c.items() if k != "cluster" and v is not False} | {"instances": instances[c["cluster"]]}
        for i, c in enumerate(found, 1)
    ]
    files = [{camel(k): v for k, v in r.items()} for r in rows(report.file_metrics, ["path"])]
    summary = {camel(k): v for k, v in report.summary.first().asDict().items()}
    return json.dumps({"version": 1, "summary": summary, "clusters": listed, "fileMetrics": files}, indent=2, ensure_ascii=False)


def read_dedupe_json(text: str) -> dict:
    """A report of above; missing optional keys get their defaults, an unknown version is an error."""
    x = json.loads(text)
    if x.get("version", 1) != 1:
        raise ValueError(f"unknown version {x['version']}")
    return {"summary": x.get("summary", {}), "clusters": [{"intersectsDiff": False, "isNew": False, "instances": []} | c for c in x.get("clusters", [])], "fileMetrics": x.get("fileMetrics", [])}


def markdown(title: str, header: list[str], body: list[list]) -> str:
    line = lambda cells: "| " + " | ".join(str(c).replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
    return "\n".join([f"## {title}", "", line(header), line(["---"] * len(header)), *map(line, body), ""])


def dedupe_markdown(report: DedupeReport, top: int = 0) -> str:
    from pyspark.sql import functions as F

    s = report.summary.first()
    files = rows(report.file_metrics.where("dup_lines > 0"), [F.desc("dup_pct"), "path"])
    found = rows(report.clusters, [F.desc("lines_saved"), F.desc("token_count"), "cluster"], top)
    return "\n".join(
        [
            markdown("Duplication", ["files", "clusters", "lines", "duplicate lines", "%", "lines saved"], [[s.files, s.clusters, s.total_lines, s.dup_lines, f"{s.dup_pct:.1f}", s.lines_saved]]),
            markdown("Files", ["file", "lines", "duplicate", "%", "clusters"], [[r["path"], r["total_lines"], r["dup_lines"], f"{r['dup_pct']:.1f}", r["n_clusters"]] for r in files]),
            markdown("Clusters", ["cluster", "instances", "tokens", "lines", "saved"], [[i, c["n_instances"], c["token_count"], c["line_count"], c["lines_saved"]] for i, c in enumerate(found, 1)]),
        ]
    )


def dedupe_text(report: DedupeReport, top: int = 0, with_files: bool = True, with_clusters: bool = True) -> str:
    """The totals, the files with duplicate lines and the clusters with their places, in plain lines."""
    from pyspark.sql import functions as F

    s = report.summary.first()
    out = [f"{s.files} files, {s.clusters} clusters, {s.dup_lines} of {s.total_lines} lines duplicate ({s.dup_pct:.1f} %), {s.lines_saved} could go"]
    if with_files:
        files = rows(report.file_metrics.where("dup_lines > 0"), [F.desc("dup_pct"), "path"])
        width = max((len(r["path"]) for r in files), default=0)
        out += ["", *(f"{r['path'].ljust(width)}  {r['dup_pct']:5.1f} %  {r['dup_lines']} of {r['total_lines']} lines" for r in files)]
    if with_clusters:
        found = rows(report.clusters, [F.desc("lines_saved"), F.desc("token_count"), "cluster"], top)
        places: dict = {}
        for r in rows(report.instances, ["cluster", "path", "start"]):
            places.setdefault(r["cluster"], []).append(f"    {r['path']}:{r['start_line']}-{r['end_line']}")
        for i, c in enumerate(found, 1):
            out += ["", f"{i}. {c['bucket']}, {c['category']}: {c['n_instances']} times {c['token_count']} tokens, {c['lines_saved']} lines could go", *places[c["cluster"]]]
    return "\n".join(out)


def dedupe_annotations(report: DedupeReport) -> str:
    """A warning at each instance of each cluster; filters and limits don't apply here."""
    clusters = {c["cluster"]: c for c in rows(report.clusters, ["cluster"])}
    of = [r for r in rows(report.instances, ["path", "start_line", "cluster"]) if r["cluster"] in clusters]
    return "\n".join(annotation("warning", r["path"], r["start_line"], f"{clusters[r['cluster']]['n_instances']} copies of {r['n_tokens']} tokens ({clusters[r['cluster']]['bucket']})") for r in of)


def step_summary(text: str, path: str | None) -> bool:
    """Append ``text`` to the summary file of a continuous-integration step, if there is one."""
    if not path:
        return False
    with open(path, "a", encoding="utf-8") as f:
        f.write(text.rstrip("\n") + "\n")
    return True


def line_sets(spark, path: str, min_lines: int = 1) -> DataFrame:
    """(path, line) that the clones of a JSON report cover, one of above or one whose clusters have ``occurrences``
    (path, start_line, end_line). What has fewer than ``min_lines`` lines counts for nothing; missing keys are empty."""
    from pyspark.sql import functions as F

    own = "struct<filePath:string, startLine:int, endLine:int>"
    other = "struct<path:string, start_line:int, end_line:int>"
    raw = spark.read.schema(f"clusters array<struct<instances:array<{own}>, occurrences:array<{other}>>>").json(path, multiLine=True)
    each = raw.select(F.explode("clusters").alias("c"))
    spans = each.select(F.explode("c.instances").alias("x")).select(F.col("x.filePath").alias("path"), F.col("x.startLine").alias("a"), F.col("x.endLine").alias("z"))
    spans = spans.union(each.select(F.explode("c.occurrences").alias("x")).select("x.path", "x.start_line", "x.end_line"))
    spans = spans.where((F.col("z") - F.col("a") + 1 >= min_lines) & (F.col("a") <= F.col("z")))
    plain = F.regexp_replace(F.regexp_replace("path", "/(\\./)+", "/"), "^(\\./)+", "")
    return spans.select(plain.alias("path"), F.explode(F.sequence("a", "z")).alias("line")).distinct()


def agreement(a: DataFrame, b: DataFrame) -> dict:
    """How far two line sets (path, line) agree."""
    from pyspark.sql import functions as F

    both = a.withColumn("a", F.lit(True)).join(b.withColumn("b", F.lit(True)), ["path", "line"], "full_outer")
    r = both.agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b")).first()
    union = r.both + r.only_a + r.only_b
    return r.asDict() | {"union": union, "jaccard_pct": 100.0 * r.both / union if union else 100.0}


def slice_json(result: dict, path: str, start_line: int, end_line: int) -> str:
    return json.dumps({"file": path, "startLine": start_line, "endLine": end_line} | result, indent=2, ensure_ascii=False)


def slice_text(result: dict, path: str, start_line: int, end_line: int) -> str:
    """What goes in and comes out of a slice, and what keeps it from being moved."""
    usage = lambda v: f"  {v['type']} {v['name']}" + (f", changed in line {v['mutationLine']}" if "mutationLine" in v else "")
    out = [f"{path}:{start_line}-{end_line} in {result['enclosing']}"]
    for k in ("inputs", "mutations", "outputs"):
        out += [f"{k}:", *(map(usage, result[k]) if result[k] else ["  none"])]
    out += ["escapes:", *([f"  line {e['line']}: {e['description']}" for e in result["escapes"]] or ["  none"])]
    return "\n".join([*out, "can be moved" if result["isCleanlyExtractable"] else "can't be moved as it is", result["suggestedSignature"]])


def complexity_markdown(scores: list[dict], threshold: int = 0) -> str:
    shown = [r for r in scores if r["score"] >= threshold]
    return markdown("Complexity", ["score", "declaration", "place"], [[r["score"], r["name"], f"{r['path']}:{r['start_line']}"] for r in shown])


def annotation(level: str, path: str, line: int, message: str) -> str:
    """A line that continuous-integration runners show beside the code."""
    escape = lambda s: s.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    return f"::{level} file={escape(path).replace(':', '%3A').replace(',', '%2C')},line={line}::{escape(message)}"


def complexity_json(scores: list[dict]) -> str:
    return json.dumps([{"file": r["path"], "name": r["name"], "start_line": r["start_line"], "end_line": r["end_line"], "score": r["score"]} for r in scores], separators=(",", ":"))


def complexity_text(scores: list[dict], threshold: int = 0) -> str:
    shown = [r for r in scores if r["score"] >= threshold]
    width = max((len(str(r["score"])) for r in shown), default=1)
    return "\n".join(f"{str(r['score']).rjust(width)}  {r['name']}  {r['path']}:{r['start_line']}-{r['end_line']}" for r in shown)


#: Names of a reachability report's counts, with older spellings that are still read.
REACH_COUNTS = {
    "pureUndead": ("pureUndead", "pureUndeads"), "testedUndead": ("testedUndead", "testedUndeads"),
    "coInvokedHazard": ("coInvokedHazards",), "privateCandidate": ("privateCandidates", "privateCandidate"),
}


def reach_json(report, package: str, version: str = "1") -> str:
    """Findings in the order of file, line and column, each with the tests that would be orphans."""
    sites: dict = {}
    for r in rows(report.orphan_sites, ["path", "line", "column"]):
        one = {"file": r["path"], "line": r["line"], "column": r["column"], "description": r["description"], "coInvokedHazard": r["hazard"]}
        sites.setdefault(r["id"], []).append({k: v for k, v in one.items() if v is not None})
    listed = []
    for r in rows(report.findings, ["path", "line", "column", "id"]):
        one = {"id": r["name"], "name": r["name"], "kind": r["kind"], "file": r["path"], "line": r["line"], "column": r["column"], "length": r["length"]}
        one |= {"classification": r["classification"], "suggestedAction": r["action"]}
        if r["is_external_binding"]:
            one["isExternalBinding"] = True
        if r["id"] in sites:
            one["orphanTests"] = sites[r["id"]]
        listed.append(one)
    s = report.summary.first()
    summary = {"totalDeclarations": s.total_declarations} | {names[0]: s[k] for k, names in REACH_COUNTS.items()}
    return json.dumps({"version": version, "package": package, "summary": summary, "undead": listed}, indent=2, ensure_ascii=False)


def read_reach_json(text: str) -> dict:
    """A report of above, also with older names of counts; missing optional keys get their defaults."""
    x = json.loads(text)
    s = x["summary"]
    counts = {k: next((s[n] for n in names if n in s), 0) for k, names in REACH_COUNTS.items()}
    found = []
    for f in x.get("undead") or []:
        if f["classification"] not in REACH_COUNTS:
            raise ValueError(f"unknown classification {f['classification']}")
        external = f.get("isExternalBinding", f.get("isExternalJsInterop", False))
        found.append({**f, "isExternalBinding": external, "orphanTests": [{"description": None, "coInvokedHazard": False} | t for t in f.get("orphanTests") or []]})
    return {"version": x["version"], "package": x["package"], "totalDeclarations": s["totalDeclarations"], **counts, "findings": found}


def reach_markdown(report) -> str:
    """A table of counts, and one of each classification that occurs."""
    s = report.summary.first().asDict()
    parts = [markdown("Declarations", list(s), [list(s.values())])]
    found = rows(report.findings, ["path", "line", "column", "id"])
    for kind in REACH_COUNTS:
        body = [[f["name"], f["kind"], f"{f['path']}:{f['line']}:{f['column']}", f["action"]] for f in found if f["classification"] == kind]
        if body:
            parts.append(markdown(kind, ["name", "kind", "place", "action"], body))
    return "\n".join(parts)
