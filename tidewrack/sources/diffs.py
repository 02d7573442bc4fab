"""Unified diffs to changed line ranges."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@ ?(.*)$")
GIT = re.compile(r'^diff --git ("?a/.*"?) ("?b/.*"?)$')


@dataclass
class FileDiff:
    old_path: str | None = None
    new_path: str | None = None
    is_new: bool = False
    is_deleted: bool = False
    is_renamed: bool = False
    ranges: list[tuple[int, int]] = field(default_factory=list)

    def merged(self) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for s, e in sorted(self.ranges):
            if out and s <= out[-1][1] + 1:
                out[-1] = (out[-1][0], max(e, out[-1][1]))
            else:
                out.append((s, e))
        return out


def _path(raw: str) -> str | None:
    p = raw.split("\t")[0].strip()
    if len(p) > 1 and p[0] == p[-1] == '"':
        p = p[1:-1].encode("latin-1", "backslashreplace").decode("unicode_escape").encode("latin-1", "replace").decode("utf-8", "replace")
    if p == "/dev/null":
        return None
    return p[2:] if p[:2] in ("a/", "b/") else p


def parse(text: str) -> list[FileDiff]:
    """Files of a diff with the ranges of added lines; deletions don't break a range, context does.

    Plain diffs without ``diff --git`` lines start a file at each ``---``, ``+++`` pair outside a hunk.
    """
    files: list[FileDiff] = []
    now: FileDiff | None = None
    old_left = new_left = line = 0
    start: int | None = None

    def close() -> None:
        nonlocal start
        if start is not None and now is not None:
            now.ranges.append((start, line - 1))
        start = None

    lines, by_git = (text or "").split("\n"), False
    for i, s in enumerate(lines):
        if old_left > 0 or new_left > 0:
            if s.startswith("+"):
                start = line if start is None else start
                line, new_left = line + 1, new_left - 1
            elif s.startswith("-"):
                old_left -= 1
            elif s.startswith("\\"):
                pass
            else:
                close()
                line, old_left, new_left = line + 1, old_left - 1, new_left - 1
            if old_left <= 0 and new_left <= 0:
                close()
            continue
        if m := GIT.match(s):
            now, by_git = FileDiff(_path(m[1]), _path(m[2])), True
            files.append(now)
        elif s.startswith("--- ") and i + 1 < len(lines) and lines[i + 1].startswith("+++ "):
            if now is None or now.ranges or not by_git:
                now = FileDiff()
                files.append(now)
            now.old_path = _path(s[4:])
            now.is_new |= now.old_path is None
        elif s.startswith("+++ ") and now is not None:
            now.new_path = _path(s[4:])
            now.is_deleted |= now.new_path is None
        elif now is not None and s.startswith("new file"):
            now.is_new = True
        elif now is not None and s.startswith("deleted file"):
            now.is_deleted = True
        elif now is not None and s.startswith("rename from "):
            now.old_path, now.is_renamed = s[12:], True
        elif now is not None and s.startswith("rename to "):
            now.new_path, now.is_renamed = s[10:], True
        elif (m := HUNK.match(s)) and now is not None:
            old_left, new_left = int(m[2] or 1), int(m[4] or 1)
            line = int(m[3])
    close()
    return files


def changed_ranges(diffs: DataFrame) -> DataFrame:
    """(diff_id, path, start, end) of the added lines in ``diffs`` (diff_id, text), a diff in each row."""

    def run(parts):
        for p in parts:
            rows = [(d, f.new_path, s, e) for d, t in zip(p.diff_id, p.text) for f in parse(t) if f.new_path for s, e in f.merged()]
            yield pd.DataFrame(rows, columns=["diff_id", "path", "start", "end"])

    return diffs.select("diff_id", "text").mapInPandas(run, "diff_id string, path string, start int, end int")


def relative_to(ranges: DataFrame, folder: str) -> DataFrame:
    """``ranges`` with paths from ``folder``, itself a path from where they now begin; what lies outside goes.

    A ``folder`` that is a file leaves that file, under its name.
    """
    folder = folder.strip("/")
    if folder in ("", "."):
        return ranges
    own, inside = F.col("path") == folder, F.col("path").startswith(folder + "/")
    path = F.when(own, F.element_at(F.split("path", "/"), -1)).otherwise(F.expr(f"substring(path, {len(folder) + 2})"))
    return ranges.where(own | inside).withColumn("path", path)
