"""What lies around a package: its pubspec, build and plugin declarations, the workspace, packages that use it.

These are a handful of small files, read by the driver. Broken or missing ones say nothing.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.sources.files import source_files

try:  # not every image has it; without it only plain scalars are read
    import yaml
except ImportError:
    yaml = None

#: Fixed values.
SKIPPED = frozenset(".git .dart_tool build out node_modules third_party example examples".split())
WORKSPACE_FILES = (".git", "DEPS", ".gclient")
DEPENDS = ("dependencies", "dev_dependencies", "dependency_overrides")
MAX_DEPTH = 4


def read_text(path: str) -> str:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read()
    except OSError:
        return ""


def parsed(text: str) -> dict:
    """The mapping of a YAML text; empty if it is none."""
    if yaml is None:
        return {m[1]: m[2] or {} for m in re.finditer(r"(?m)^(\w+):[ \t]*([^#\n]*?)[ \t]*$", text)}
    try:
        out = yaml.safe_load(text)
    except yaml.YAMLError:
        return {}
    return out if isinstance(out, dict) else {}


def package_name(root: str) -> str | None:
    m = re.search(r"""(?m)^name:\s*['"]?([A-Za-z_]\w*)""", read_text(os.path.join(root, "pubspec.yaml")))
    return m[1] if m else None


def _found(node, key: str) -> list:
    """All values of ``key`` anywhere inside."""
    if isinstance(node, dict):
        return [v for k, v in node.items() if str(k) == key] + [x for k, v in node.items() if str(k) != key for x in _found(v, key)]
    return [x for v in node for x in _found(v, key)] if isinstance(node, list) else []


def builder_factories(root: str) -> frozenset[str]:
    """The names under any ``builder_factories`` of a package's build.yaml."""
    out: set[str] = set()
    for value in _found(parsed(read_text(os.path.join(root, "build.yaml"))), "builder_factories"):
        out.update(str(x).strip() for x in (value if isinstance(value, list) else [value]) if x is not None)
    return frozenset(x for x in out if x)


def plugin_classes(root: str) -> frozenset[str]:
    """The plugin classes below ``flutter`` of a pubspec; of one that can't be read, all that look like one."""
    text = read_text(os.path.join(root, "pubspec.yaml"))
    flutter = parsed(text).get("flutter") if yaml else None
    if flutter:
        named = [v for k in ("pluginClass", "dartPluginClass") for v in _found(flutter, k)]
    else:
        broken = yaml is None or (text and not parsed(text))
        named = re.findall(r"""(?m)^\s+(?:pluginClass|dartPluginClass):\s*['"]?([A-Za-z_]\w*)""", text) if broken else []
    return frozenset(str(x) for x in named if x and str(x) != "none")


def is_flutter_package(root: str) -> bool:
    text = read_text(os.path.join(root, "pubspec.yaml"))
    return bool(re.search(r"(?m)^flutter:", text) or re.search(r"sdk:\s*flutter\b", text))


def has_package_config(root: str) -> bool:
    return os.path.isfile(os.path.join(root, ".dart_tool", "package_config.json"))


def _upwards(path: str):
    path = os.path.abspath(path)
    while True:
        yield path
        if os.path.dirname(path) == path:
            return
        path = os.path.dirname(path)


def has_enclosing_package_config(path: str) -> bool:
    return any(map(has_package_config, _upwards(path)))


def find_workspace_root(path: str) -> str | None:
    """The nearest folder upwards with a repository, a checkout's list of parts or a pubspec that names a workspace."""
    for p in _upwards(path):
        if any(os.path.exists(os.path.join(p, f)) for f in WORKSPACE_FILES) or re.search(r"(?m)^workspace:", read_text(os.path.join(p, "pubspec.yaml"))):
            return p
    return None


def packages_below(root: str) -> tuple[list[tuple[str, str, bool]], list[tuple[str, str]]]:
    """((folder, name, has a package config)..., (folder, package it depends on)...) down to ``MAX_DEPTH`` folders."""
    packages, depends = [], []
    for folder, subs, files in os.walk(root):
        depth = 0 if folder == root else os.path.relpath(folder, root).count(os.sep) + 1
        subs[:] = [] if depth >= MAX_DEPTH else sorted(s for s in subs if s not in SKIPPED)
        if "pubspec.yaml" in files:
            spec = parsed(read_text(os.path.join(folder, "pubspec.yaml")))
            packages.append((folder, package_name(folder) or "", has_enclosing_package_config(folder)))
            depends += [(folder, str(d)) for k in DEPENDS if isinstance(spec.get(k), dict) for d in spec[k]]
    return packages, depends


def dependants(packages: DataFrame, depends: DataFrame, target: str) -> DataFrame:
    """Of ``packages`` (folder, name, has_config) those that depend, by ``depends`` (folder, package), on ``target``."""
    users = depends.where(F.col("package") == target).select("folder").distinct()
    return packages.where(F.col("has_config") & (F.col("name") != target)).join(users, "folder", "left_semi")


def consumers(spark: SparkSession, root: str, workspace: str | None = None) -> list[tuple[str, str]]:
    """(folder, role) of the folders of other packages of the workspace that use the package: lib is production, test is test."""
    workspace, target = workspace or find_workspace_root(root), package_name(root)
    if not workspace or not target:
        return []
    packages, depends = packages_below(workspace)
    own = os.path.abspath(root)
    rows = spark.createDataFrame([p for p in packages if os.path.abspath(p[0]) != own], "folder string, name string, has_config boolean")
    using = sorted(r.folder for r in dependants(rows, spark.createDataFrame(depends, "folder string, package string"), target).collect())
    both = [(os.path.join(f, sub), role) for f in using for sub, role in (("lib", "other"), ("test", "test"))]
    return [x for x in both if os.path.isdir(x[0])]


def roots_of(path: str) -> list[tuple[str, str]]:
    """(path, role) of an extra root: a file is production, a folder with lib or test is split, another is all tests."""
    if os.path.isfile(path):
        return [(path, "other")]
    parts = [(os.path.join(path, s), r) for s, r in (("lib", "other"), ("test", "test")) if os.path.isdir(os.path.join(path, s))]
    return parts or ([(path, "test")] if os.path.isdir(path) else [])


@dataclass(frozen=True)
class PackageSource:
    name: str
    files: DataFrame  # path, content
    extra: DataFrame  # path, role


def read_package(spark: SparkSession, root: str, include_generated: bool = False, extra_roots: tuple[str, ...] = (), discovery: bool = True) -> PackageSource:
    """A package's files with paths from its root, and those of extra roots and of packages that use it."""
    from tidewrack.functions.globs import DEFAULT_EXCLUDES

    name = package_name(root)
    if name is None:
        raise LookupError(f"no pubspec.yaml with a name in {root}")
    exclude = () if include_generated else DEFAULT_EXCLUDES
    files = source_files(spark, root, exclude=exclude).select("path", "content")
    extra = spark.createDataFrame([], "path string, role string")
    more = [x for p in extra_roots for x in roots_of(os.path.join(root, p) if not os.path.isabs(p) else p)]
    for path, role in more + (consumers(spark, root) if discovery else []):
        place = os.path.relpath(path, root).replace(os.sep, "/")
        part = source_files(spark, path, exclude=exclude, tool_folders_only=True)
        part = part.select((F.lit(place) if os.path.isfile(path) else F.concat(F.lit(place + "/"), "path")).alias("path"), "content")
        files = files.join(part.select("path"), "path", "left_anti").union(part)
        extra = extra.union(part.select("path", F.lit(role)))
    return PackageSource(name, files, extra.distinct())
