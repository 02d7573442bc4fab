"""Snapshots and diffs from a git repository."""

from __future__ import annotations

import os
import subprocess

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.functions.globs import excluded_path
from tidewrack.sources import diffs
from tidewrack.sources.workspace import read_text


class GitError(RuntimeError):
    """git isn't there, or refuses."""


def _git(root: str, *args: str) -> str:
    try:
        done = subprocess.run(["git", "-c", "core.quotepath=off", *args], cwd=root, capture_output=True, timeout=300)
    except (OSError, subprocess.TimeoutExpired) as e:
        raise GitError(str(e)) from e
    if done.returncode:
        raise GitError(done.stderr.decode("utf-8", "replace").strip())
    return done.stdout.decode("utf-8", "replace")


class Repository:
    """``path`` may be any folder or file inside."""

    def __init__(self, path: str):
        folder = path if os.path.isdir(path) else os.path.dirname(path) or "."
        self.root = _git(folder, "rev-parse", "--show-toplevel").strip()

    def merge_base(self, ref: str) -> str:
        return _git(self.root, "merge-base", ref, "HEAD").strip()

    def changed_paths(self, ref: str) -> list[str]:
        """Paths of added, copied, modified and renamed files since ``ref``, from the repository's root."""
        out = _git(self.root, "diff", "--name-only", "-z", "--diff-filter=ACMR", ref)
        return [p for p in out.split("\0") if p]

    def changed_files(self, spark: SparkSession, ref: str, targets: list[str] | None = None, suffix: str = ".dart") -> DataFrame:
        """(path) of those that are scanned: of the suffix, in no tool folder, within ``targets`` if there are any."""
        rows = spark.createDataFrame([(p,) for p in self.changed_paths(ref)], "path string")
        rows = rows.where(F.col("path").endswith(suffix) & ~excluded_path(F.col("path")))
        inside = F.lit(not targets)
        for t in targets or []:
            place = os.path.relpath(os.path.realpath(t), os.path.realpath(self.root)).replace(os.sep, "/")
            inside = inside | (F.col("path") == place) | F.col("path").startswith(place + "/") if place != "." else F.lit(True)
        return rows.where(inside)

    def content_at(self, ref: str, path: str) -> str:
        """The file's text at ``ref``, empty if it wasn't there under this path."""
        try:
            return _git(self.root, "show", f"{ref}:{path}")
        except GitError:
            return ""

    def current(self, path: str) -> str:
        return read_text(os.path.join(self.root, path))

    def diff(self, ref: str) -> str:
        return _git(self.root, "diff", "--no-color", "--no-ext-diff", ref)

    def snapshots(self, paths: DataFrame, ref: str) -> DataFrame:
        """(path, old_content, new_content) of ``paths`` (path) at ``ref`` and now; tasks read them in the repository."""

        def read(parts):
            for p in parts:
                yield pd.DataFrame([(x, self.content_at(ref, x), self.current(x)) for x in p.path], columns=["path", "old_content", "new_content"])

        return paths.select("path").mapInPandas(read, "path string, old_content string, new_content string")

    def changed_ranges(self, spark: SparkSession, ref: str, target: str | None = None) -> DataFrame:
        """(path, start, end) of the lines added since ``ref``, paths from ``target``."""
        rows = diffs.changed_ranges(spark.createDataFrame([("git", self.diff(ref))], "diff_id string, text string")).drop("diff_id")
        if target is None:
            return rows
        return diffs.relative_to(rows, os.path.relpath(os.path.realpath(target), os.path.realpath(self.root)).replace(os.sep, "/"))
