"""Globs as regular expressions, path predicates and path roles."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Generated files that a scan leaves out by default.
DEFAULT_EXCLUDES = (
    "**/*.g.dart", "**/*.freezed.dart", "**/*.pb.dart", "**/*.pbjson.dart", "**/*.pbenum.dart", "**/*.pbserver.dart",
    "**/*_bindings.dart", "**/native_*.dart", "**/jni_*.dart", "**/*.mocks.dart", "**/*.config.dart",
)

_PART = re.compile(r"\*\*/|\*\*|\*|\?|[^*?]+")
_MEANS = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}


def glob_regex(glob: str, case_sensitive: bool = True) -> str:
    """An anchored expression that Java, RE2 and Python read alike."""
    body = "".join(_MEANS.get(p) or re.sub(r"([^\w/ ])", r"\\\1", p) for p in _PART.findall(glob))
    return ("" if case_sensitive else "(?i)") + f"^{body}$"


def any_glob(path: Column, globs, case_sensitive: bool = True) -> Column:
    tests = [path.rlike(glob_regex(g, case_sensitive)) for g in globs]
    return reduce(Column.__or__, tests, F.lit(False))


def selected(path: Column, include=(), exclude=DEFAULT_EXCLUDES, suffix: str = ".dart") -> Column:
    """Whether a relative path is scanned. Each glob is tried on the path, on it after a slash and on its last
    part; what is excluded stays out even if included, and without include globs all else is in."""
    last = F.element_at(F.split(path, "/"), -1)
    hit = lambda globs: any_glob(path, globs) | any_glob(F.concat(F.lit("/"), path), globs) | any_glob(last, globs)
    wanted = hit(include) if include else F.lit(True)
    return path.endswith(suffix) & ~hit(exclude) & wanted


def excluded_path(path: Column) -> Column:
    """Tool and build folders: any part ``.dart_tool`` or ``.git``, or a first part ``build``."""
    parts = F.split(path, "/")
    return F.array_contains(parts, ".dart_tool") | F.array_contains(parts, ".git") | (parts[0] == "build")


def path_role(path: Column) -> Column:
    """The role of a package's file by its first folders."""
    first = F.split(path, "/")[0]
    return (
        F.when(path.startswith("lib/src/"), "internalSrc").when(first == "lib", "publicLib").when(first == "bin", "executable")
        .when(first == "example", "demonstration").when(first.isin("test", "integration_test", "test_driver"), "test")
        .when(first.isin("tool", "benchmark", "web"), "auxiliary").otherwise("other")
    )
