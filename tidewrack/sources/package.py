"""Declarations, references and test sites of a package's Dart files, as tables for the reachability engine.

A file is read on its own: its directives, its top-level declarations with the names that each uses, and its test
calls. Names then meet declarations in joins: a name means what its file declares, or what a file that it imports
exports, with ``show``, ``hide`` and prefixes. There is no compiler, so a local name that hides a top-level one
still counts as a use of it, and a member's name as a use of every visible extension that has such a member: what is
reported as dead is dead, some dead things may stay unreported.

Empty and null contents declare nothing; what can't be read gives no facts rather than an error.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.declarations import FIXTURES, TESTS
from tidewrack.functions.globs import path_role
from tidewrack.plans.lineage import cut
from tidewrack.plans.reachability import PackageFacts
from tidewrack.sources.dart import RESERVED, Token, matching, tokenize

#: Fixed values.
MODIFIERS = frozenset("abstract sealed base interface final external augment static late const var covariant".split())
TYPES = {"class": "class", "mixin": "mixin", "enum": "enum", "extension": "extension"}
TEST_CALLS = (*TESTS, "testWidgets")

COMMENT = re.compile(r"""(?P<quoted>r?'''.*?'''|r?\"\"\".*?\"\"\"|r'[^'\n]*'|r"[^"\n]*"|'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*")|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))""", re.S)
INTERPOLATION = re.compile(r"(?<!\\)\$(?:([A-Za-z_]\w*)|\{)")
WORD = re.compile(r"[A-Za-z_$][\w$]*")


@dataclass
class Directive:
    kind: str
    offset: int
    uri: str
    alternates: list[str]
    prefix: str | None
    show: list[str] | None
    hide: list[str]


@dataclass
class Declared:
    name: str
    kind: str
    offset: int
    length: int
    line: int
    column: int
    annotations: list[str] = field(default_factory=list)
    pragmas: list[str] = field(default_factory=list)
    has_external: bool = False
    extended_type: str | None = None
    ignored: bool = False
    sealed: bool = False
    supers: list[str] = field(default_factory=list)
    members: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)


@dataclass
class Site:
    offset: int
    line: int
    column: int
    description: str | None
    names: list[str]


@dataclass
class FileFacts:
    directives: list[Directive]
    declared: list[Declared]
    sites: list[Site]


def comments(source: str) -> list[tuple[int, str]]:
    """(offset, text) of the comments."""
    return [(m.start(), m[0]) for m in COMMENT.finditer(source) if m["comment"]]


def _unquoted(text: str) -> str:
    text = text[1:] if text[:1] == "r" else text
    n = 3 if text[:3] in ("'''", '\"\"\"') else 1
    return text[n : len(text) - n if len(text) >= 2 * n else None]


def names_in_string(text: str) -> Iterator[str]:
    """The names in a string's interpolations, in order."""
    at = len(text) if text[:1] == "r" else 0
    while m := INTERPOLATION.search(text, at):
        at = m.end()
        if m[1]:
            yield m[1]
            continue
        depth = 1
        while at < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[at], 0)
            at += 1
        yield from WORD.findall(text[m.end() : at])


def used_names(tokens: list[Token], first: int, last: int) -> list[str]:
    """The distinct names in tokens [first, last]: ``x``, ``p.x`` after a name, ``.x`` of a member."""
    out: set[str] = set()
    for i in range(first, last + 1):
        t = tokens[i]
        if t.kind == "string":
            out.update(n for n in names_in_string(t.text) if n not in RESERVED)
        if t.kind != "name" or t.text in RESERVED:
            continue
        before = tokens[i - 1].text if i > first else ""
        if before in (".", "?.", "..", "?.."):
            out.add("." + t.text)
            if before == "." and i - 2 >= first and tokens[i - 2].kind == "name":
                out.add(f"{tokens[i - 2].text}.{t.text}")
        elif not (i < last and tokens[i + 1].text == ":" and before in ("(", ",", "{")):  # not an argument's label
            out.add(t.text)
    return sorted(out)


class _Reader:
    def __init__(self, source: str, tool: str):
        self.source, self.tokens = source, tokenize(source)
        self.pair, self.comments = matching(self.tokens), comments(source)
        self.whole = any(re.search(rf"//\s*{tool}:ignore_for_file\b", c) for _, c in self.comments)
        self.mark = re.compile(rf"//\s*{tool}:ignore\b(?!_)")

    def text(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def facts(self) -> FileFacts:
        directives, declared = [], []
        i, behind = 0, 0
        while i < len(self.tokens):
            head, annotations, pragmas = self.annotations(i)
            if head >= len(self.tokens):
                break
            end = self.end(head)
            if self.text(head) in ("import", "export", "part", "library"):
                directives += self.directive(head, end)
            else:
                start = self.tokens[head].offset
                ignored = self.whole or any(behind <= at < start and self.mark.search(c) for at, c in self.comments)
                for d in self.declaration(i, head, end):
                    d.annotations, d.pragmas, d.ignored = annotations, pragmas, ignored
                    declared.append(d)
            behind = self.tokens[end].offset + 1
            i = end + 1
        return FileFacts(directives, declared, list(self.sites()))

    def annotations(self, i: int) -> tuple[int, list[str], list[str]]:
        names, pragmas = [], []
        while self.text(i) == "@":
            j = i + 2
            while self.text(j) == "." and j + 1 < len(self.tokens):
                j += 2
            names.append("".join(t.text for t in self.tokens[i + 1 : j]))
            if self.text(j) == "(" and j in self.pair:
                if names[-1] == "pragma" and j + 1 < len(self.tokens) and self.tokens[j + 1].kind == "string":
                    pragmas.append(_unquoted(self.text(j + 1)))
                j = self.pair[j] + 1
            i = j
        return i, names, pragmas

    def end(self, i: int) -> int:
        """The last token of the top-level thing that starts at i."""
        assigned = False
        while i < len(self.tokens):
            t = self.text(i)
            if t == ";":
                return i
            assigned |= t in ("=", "=>")
            if t in "([{" and self.pair.get(i, -1) > i:
                i = self.pair[i]
                if t == "{" and not assigned:
                    return i
            i += 1
        return len(self.tokens) - 1

    def directive(self, i: int, end: int) -> list[Directive]:
        kind, at = self.text(i), self.tokens[i].offset
        uris = [j for j in range(i, end) if self.tokens[j].kind == "string"]
        if not uris or kind == "library" or self.text(i + 1) == "of" and kind == "part":
            return []
        # a condition may compare with a string: the addresses are those outside of brackets
        inside = {k for j in range(i, end) if self.text(j) == "(" and j in self.pair for k in range(j, self.pair[j])}
        uris = [j for j in uris if j not in inside]
        lists: dict[str, list[str]] = {}
        prefix = None
        for j in range(uris[0] + 1, end):
            t = self.text(j)
            if t == "as":
                prefix = self.text(j + 1)
            elif t in ("show", "hide") and j not in inside:
                k = j + 1
                while k < end and (self.tokens[k].kind == "name" and self.text(k) not in ("show", "hide") or self.text(k) == ","):
                    k += 1
                lists.setdefault(t, []).extend(x.text for x in self.tokens[j + 1 : k] if x.text != ",")
        return [Directive(kind, at, _unquoted(self.text(uris[0])), [_unquoted(self.text(j)) for j in uris[1:]], prefix, lists.get("show"), lists.get("hide", []))]

    def declaration(self, start: int, head: int, end: int) -> list[Declared]:
        i, external, sealed = head, False, False
        while self.text(i) in MODIFIERS and i < end:
            external |= self.text(i) == "external"
            sealed |= self.text(i) == "sealed"
            i += 1
        made = lambda at, name, kind, **more: Declared(
            name, kind, self.tokens[at].offset, self.tokens[end].offset + len(self.text(end)) - self.tokens[at].offset,
            self.tokens[at].line, self.tokens[at].column, has_external=external, **more,
        )
        names = lambda but: sorted(set(used_names(self.tokens, start, end)) - {but})
        t = self.text(i)
        if t == "mixin" and self.text(i + 1) == "class":
            i, t = i + 1, "class"
        if t in TYPES and i + 1 <= end and (self.tokens[i + 1].kind == "name" or t == "extension"):
            return [self.type_(i, head, end, made, names, sealed)]
        if t == "typedef":
            plain = next((j for j in range(i + 1, end) if self.text(j) == "="), None)
            name = self.text(i + 1) if plain else next((self.text(j - 1) for j in range(i + 2, end) if self.text(j) == "("), self.text(i + 1))
            return [made(head, name, "typedef", names=names(name))]
        depth = 0
        for j in range(i, end + 1):
            t = self.text(j)
            if t in ("get", "set") and j < end and self.tokens[j + 1].kind == "name" and self.text(j + 2) in ("(", "=>", "{", "async", "sync", ";"):
                name = self.text(j + 1)
                return [made(head, name, "getter" if t == "get" else "setter", names=names(name))]
            depth += {"<": 1, ">": -1}.get(t, 0)
            if t == "(" and j > i and (self.tokens[j - 1].kind == "name" and depth <= 0 or self.text(j - 1) == ">"):
                k = j - 1
                if self.text(k) == ">":
                    nested = 0
                    while k > i:
                        nested += {">": 1, "<": -1}.get(self.text(k), 0)
                        k -= 1
                        if not nested:
                            break
                name = self.text(k)
                after = self.text(self.pair.get(j, end) + 1) if j in self.pair else ""
                if self.tokens[k].kind == "name" and name not in RESERVED and name != "Function" and after in ("{", "=>", ";", "async", "sync"):
                    return [made(head, name, "function", names=names(name))]
            if t in ("=", ";"):
                break
        return self.variables(i, head, start, end, external)

    def type_(self, i: int, head: int, end: int, made, names, sealed: bool) -> Declared:
        kind, k = TYPES[self.text(i)], i + 1
        if kind == "extension" and self.text(k) == "type":
            kind, k = "extensionType", k + 1 + (self.text(k + 1) == "const")
        name = self.text(k) if self.tokens[k].kind == "name" and self.text(k) != "on" else "anonymous"
        body = next((j for j in range(k, end) if self.text(j) == "{"), end)
        supers, depth, taking = [], 0, False
        for j in range(k, body):
            t = self.tokens[j]
            depth += {"<": 1, ">": -1}.get(t.text, 0)
            if not depth and t.text in ("extends", "implements", "with", "=", "on"):
                taking = t.text != "on"
            elif not depth and taking and t.kind == "name" and self.text(j + 1) != ".":
                supers.append(f"{self.text(j - 2)}.{t.text}" if self.text(j - 1) == "." else t.text)
        extended = None
        if kind == "extensionType":
            open_ = next((j for j in range(k, body) if self.text(j) == "("), None)
            extended = self.text(open_ + 1) if open_ else None
        members, j, value = [], body + 1, False
        while j < end:  # names of members: before a parameter list, an arrow or an assignment
            t = self.text(j)
            if not value and self.tokens[j].kind == "name" and self.text(j + 1) in ("(", "=>", "=", ";", "<", "{"):
                members.append(t)
            value = t != ";" and (value or t in ("=>", "="))
            j = self.pair[j] + 1 if t in "([{" and self.pair.get(j, -1) > j else j + 1
        inside = any(self.text(x) == "external" for x in range(body, end))
        d = made(head, name, kind, sealed=sealed, supers=supers, extended_type=extended, members=sorted(set(members)) if kind == "extension" else [], names=names(name))
        d.has_external |= inside
        return d

    def variables(self, i: int, head: int, start: int, end: int, external: bool) -> list[Declared]:
        """A row for each variable of a list."""
        names, depth, j, first = [], 0, i, True
        while j <= end:
            t = self.text(j)
            if t in ("=", ",", ";") and not depth and first and j > i and self.tokens[j - 1].kind == "name":
                names.append(j - 1)
                first = t != "="
                if t != "=":
                    first = True
            if t == "=" and not depth:
                first = False
            if t == "," and not depth:
                first = True
            if first:
                depth = max(0, depth + {"<": 1, ">": -1}.get(t, 0))
            j = self.pair[j] + 1 if t in "([{" and self.pair.get(j, -1) > j else j + 1
        return [
            Declared(self.text(k), "variable", self.tokens[k].offset, len(self.text(k)), self.tokens[k].line, self.tokens[k].column, has_external=external,
                     names=sorted(set(used_names(self.tokens, start, end)) - {self.text(k)}))
            for k in names
        ]

    def sites(self) -> Iterator[Site]:
        for i, t in enumerate(self.tokens):
            if t.kind != "name" or t.text not in TEST_CALLS + FIXTURES or self.text(i + 1) != "(" or i + 1 not in self.pair or self.text(i - 1) == ".":
                continue
            close = self.pair[i + 1]
            if self.text(close + 1) in ("{", "=>", "async"):
                continue  # a function of that name
            first = self.tokens[i + 2] if close > i + 2 else None
            said = t.text if t.text in FIXTURES else _unquoted(first.text) if first and first.kind == "string" else None
            yield Site(t.offset, t.line, t.column, said, used_names(self.tokens, i + 2, close - 1))


def parse_file(source: str | None, tool: str = "tidewrack") -> FileFacts:
    try:
        return _Reader(source or "", tool).facts()
    except (IndexError, KeyError, RecursionError):
        return FileFacts([], [], [])


def resolved_uri(uri: str, path: str, package: str) -> str | None:
    """The path in the package that a directive of the file ``path`` names, None outside of it."""
    if uri.startswith("package:"):
        name, _, rest = uri[8:].partition("/")
        return f"lib/{rest}" if name == package else None
    if ":" in uri:
        return None
    out = posixpath.normpath(posixpath.join(posixpath.dirname(path), uri))
    return None if out.startswith("/") else out


DIRECTIVE = "struct<kind:string, offset:int, uri:string, alternates:array<string>, prefix:string, `show`:array<string>, hide:array<string>>"
DECLARED = (
    "struct<name:string, kind:string, offset:int, length:int, line:int, `column`:int, annotations:array<string>, pragmas:array<string>, has_external:boolean,"
    " extended_type:string, ignored:boolean, sealed:boolean, supers:array<string>, members:array<string>, names:array<string>>"
)
SITE = "struct<offset:int, line:int, `column`:int, description:string, names:array<string>>"


def file_facts(files: DataFrame, package: str, tool: str = "tidewrack") -> DataFrame:
    """(path, directives, declared, sites) of each file (path, content); addresses are paths in the package."""

    def run(parts):
        for p in parts:
            rows = []
            for path, content in zip(p.path, p.content):
                f = parse_file(content, tool)
                for d in f.directives:
                    d.uri = resolved_uri(d.uri, path, package)
                    d.alternates = [u for a in d.alternates if (u := resolved_uri(a, path, package))]
                rows.append((path, *([asdict(x) for x in part] for part in (f.directives, f.declared, f.sites))))
            yield pd.DataFrame(rows, columns=["path", "directives", "declared", "sites"])

    return files.select("path", "content").mapInPandas(run, f"path string, directives array<{DIRECTIVE}>, declared array<{DECLARED}>, sites array<{SITE}>")


def _passes(name: Column, show: Column, hide: Column) -> Column:
    return (show.isNull() | F.array_contains(show, name)) & ~F.coalesce(F.array_contains(hide, name), F.lit(False))


def namespaces(own: DataFrame, exports: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(path, name, id): what each file exports, its open declarations and what it re-exports, however far."""
    seen = cut(own.where(~F.col("name").startswith("_")).select("path", "name", "id").distinct())
    fresh = seen
    links = exports.select(F.col("path").alias("lib"), "target", "show", "hide")
    for _ in range(max_rounds):
        more = links.join(fresh, links.target == fresh.path).where(_passes(F.col("name"), F.col("show"), F.col("hide")))
        fresh = cut(more.select(F.col("lib").alias("path"), "name", "id").distinct().join(seen, ["path", "name", "id"], "left_anti"))
        if fresh.isEmpty():
            return seen
        seen = cut(seen.union(fresh))
    raise RuntimeError("exports didn't settle")


def package_facts(files: DataFrame, package: str, extra: DataFrame | None = None, tool: str = "tidewrack") -> PackageFacts:
    """The tables of a package's ``files`` (path, content), paths relative to the package.

    ``extra`` (path, role) gives files of other roots their role.
    """
    facts = cut(file_facts(files, package, tool))
    directives = facts.select("path", F.explode("directives").alias("d")).select("path", "d.*")
    rows = facts.select("path", F.explode("declared").alias("d")).select("path", "d.*")
    rows = rows.withColumn("id", F.concat_ws("#", "path", F.when(F.col("kind") == "variable", "var").otherwise(F.col("kind")), "name", "offset"))
    # a part belongs to the library that names it: they declare for one another
    parts = directives.where("kind = 'part' and uri is not null").select(F.col("uri").alias("path"), F.col("path").alias("library")).distinct()
    library = rows.select("path").union(facts.select("path")).distinct().join(parts, "path", "left").select("path", F.coalesce("library", "path").alias("library"))
    rows = cut(rows.join(library, "path"))
    own = rows.select(F.col("library").alias("path"), "name", "id")
    spread = directives.where("kind in ('import', 'export') and uri is not null")
    targets = F.explode(F.concat(F.array("uri"), "alternates"))
    spread = spread.select("path", "kind", "offset", "prefix", "show", "hide", targets.alias("target")).join(library, "path").drop("path").withColumnRenamed("library", "path")
    spread = cut(spread)
    shown = namespaces(own, spread.where("kind = 'export'"))

    imports = spread.where("kind = 'import'").select("path", "prefix", "show", "hide", "target").join(shown.withColumnRenamed("path", "target"), "target")
    imports = imports.where(_passes(F.col("name"), F.col("show"), F.col("hide")))
    named = imports.select("path", F.concat_ws(".", "prefix", "name").alias("name"), "id")
    visible = cut(own.union(named).distinct())
    # extensions are used by their members' names
    extensions = rows.where("size(members) > 0").select("id", F.explode("members").alias("m"))
    by_member = visible.select("path", "id").distinct().join(extensions, "id").select("path", F.concat(F.lit("."), "m").alias("name"), "id")
    visible = cut(visible.union(by_member).distinct())

    uses = rows.select(F.col("id").alias("src"), F.col("library").alias("path"), F.explode("names").alias("name"))
    refs = uses.join(visible, ["path", "name"]).select("src", F.col("id").alias("dst"))
    # what a file exports belongs to each of its declarations
    given = spread.where("kind = 'export'").join(shown.withColumnRenamed("path", "target"), "target").where(_passes(F.col("name"), F.col("show"), F.col("hide")))
    given = rows.select(F.col("id").alias("src"), F.col("library").alias("path")).join(given.select("path", F.col("id").alias("dst")), "path").select("src", "dst")
    refs = refs.union(given).where("src <> dst").distinct()
    supers = rows.select("id", F.col("library").alias("path"), F.explode("supers").alias("name")).join(visible.withColumnRenamed("id", "parent"), ["path", "name"]).select("id", "parent").distinct()

    public = shown.where(path_role(F.col("path")) == "publicLib").select("id").distinct().withColumn("exported", F.lit(True))
    nodes = rows.join(public, "id", "left").select(
        "id", "path", "name", "kind", "line", "column", "length", "annotations", "pragmas", "has_external", "extended_type", "ignored", "sealed",
        F.coalesce("exported", F.lit(False)).alias("exported"),
    )
    switched = directives.where("size(alternates) > 0 and uri is not null").select(F.concat_ws("#", "path", "offset").alias("grp"), F.concat(F.array("path", "uri"), "alternates").alias("f"))
    groups = switched.select("grp", F.explode("f").alias("file")).distinct()
    at = facts.select("path", F.explode("sites").alias("s")).where(path_role(F.col("path")) == "test")
    if extra is not None:
        tests = extra.where("role = 'test'").select("path").distinct()
        at = at.union(facts.join(tests, "path", "left_semi").select("path", F.explode("sites").alias("s"))).distinct()
    at = at.select(F.concat_ws("#", "path", "s.offset").alias("site"), "path", "s.line", "s.column", "s.description", "s.names")
    touched = at.select("site", "path", F.explode("names").alias("name")).join(library, "path").select("site", F.col("library").alias("path"), "name")
    site_refs = touched.join(visible, ["path", "name"]).select("site", "id").distinct()
    extra = extra if extra is not None else files.sparkSession.createDataFrame([], "path string, role string")
    return PackageFacts(cut(nodes), cut(refs), cut(supers), cut(groups), cut(at.drop("names")), cut(site_refs), extra)
