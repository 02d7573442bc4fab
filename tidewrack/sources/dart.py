"""A tolerant Dart front end: tokens, declarations, candidate units and nesting-weighted scores.

Names are not resolved: that needs a compiler. What cannot be read gives no facts rather than an error.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

_LEXEME = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))"""
    r"""|(?P<string>r?'''.*?(?:'''|\Z)|r?\"\"\".*?(?:\"\"\"|\Z)|r'[^'\n]*'?|r"[^"\n]*"?|'(?:\\.|[^'\\\n])*'?|"(?:\\.|[^"\\\n])*"?)"""
    r"""|(?P<number>0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"""
    r"""|(?P<name>[A-Za-z_$][\w$]*)"""
    r"""|(?P<mark>\?\?=|>>>=|\.\.\.\?|\.\.\.|\?\.\.|~/=|<<=|>>>|&&|\|\||=>|==|!=|<=|>=|\?\?|\?\.|\.\.|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|~/|<<|.)""",
    re.S,
)
#: Names that start a statement and so are never a declaration's name.
RESERVED = frozenset("if for while do switch case default try catch finally on return throw rethrow break continue assert yield await else new const super this in is as when".split())
UNIT_KINDS = ("if", "for", "while", "try", "switch")


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    offset: int
    line: int
    column: int

    def norm(self, ignore_literals: bool = True, ignore_identifiers: bool = False) -> str:
        if ignore_literals and self.kind in ("string", "number"):
            return "<STR>" if self.kind == "string" else "<NUM>"
        return "<ID>" if ignore_identifiers and self.kind == "name" and self.text not in RESERVED else self.text


def tokenize(source: str) -> list[Token]:
    """Tokens without comments and white space; lines and columns from 1."""
    out, line, start = [], 1, 0
    for m in _LEXEME.finditer(source):
        text = m[0]
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, text, m.start(), line, m.start() - start + 1))
        if "\n" in text:
            line += text.count("\n")
            start = m.start() + text.rindex("\n") + 1
    return out


def matching(tokens: list[Token]) -> dict[int, int]:
    """The index of each bracket's partner."""
    open_, pairs = [], {}
    ends = {")": "(", "]": "[", "}": "{"}
    for i, t in enumerate(tokens):
        if t.kind != "mark":
            continue
        if t.text in "([{":
            open_.append(i)
        elif t.text in ends and open_ and tokens[open_[-1]].text == ends[t.text]:
            j = open_.pop()
            pairs[i], pairs[j] = j, i
    return pairs


@dataclass(frozen=True)
class Declaration:
    name: str
    start_line: int
    end_line: int
    head: int  # the parameter list
    first: int  # the body's tokens
    last: int


def declarations(tokens: list[Token]) -> list[Declaration]:
    """Functions, methods, accessors and constructors; nested functions belong to the one around them."""
    pair = matching(tokens)
    out: list[Declaration] = []

    def members(i: int, end: int, owner: str) -> None:
        start = i
        while i < end:
            t = tokens[i]
            if t.kind == "name" and t.text in ("class", "mixin", "extension", "enum") and i + 1 < end:
                name = tokens[i + 1].text
                while i < end and tokens[i].text not in ("{", ";"):
                    i += 1
                if i < end and tokens[i].text == "{" and i in pair:
                    members(i + 1, pair[i], name)
                    i = pair[i]
                i, start = i + 1, i + 1
                continue
            body, head = -1, -1
            named = _name_before(tokens, start, i)
            if t.text == "(" and i in pair and named >= 0 and tokens[named].text not in RESERVED:
                head, body = i, pair[i] + 1
            elif t.text in ("{", "=>") and any(x.text == "get" for x in tokens[start:i]):
                head, body = i, i
            if head >= 0 and not any(x.text == "=" for x in tokens[start:i]):
                while body < end and tokens[body].text in ("async", "sync", "*"):
                    body += 1
                if body < end and tokens[body].text == ":":  # initialisers
                    while body < end and tokens[body].text not in ("{", ";"):
                        body = pair.get(body, body) + 1 if tokens[body].text in "([" else body + 1
                if body < end and tokens[body].text in ("{", "=>"):
                    last = pair.get(body, end - 1) if tokens[body].text == "{" else _until_semicolon(tokens, pair, body, end)
                    before = tokens[start : named + 1] if named >= 0 else tokens[start:i]
                    name = before[-1].text
                    if len(before) > 2 and before[-2].text == ".":
                        name = before[-3].text + "." + name
                    prefix = next((x.text + " " for x in before[-2:] if x.text in ("get", "set")), "")
                    full = name if not owner else owner if name == owner else name if name.startswith(owner + ".") else f"{owner}.{name}"
                    out.append(Declaration(prefix + full, tokens[start].line, tokens[last].line, head, body, last))
                    i, start = last + 1, last + 1
                    continue
            if t.text in (";", "}"):
                start = i + 1
            i = pair[i] + 1 if t.text in "([{" and i in pair and pair[i] > i else i + 1

    members(0, len(tokens), "")
    return out


def _name_before(tokens: list[Token], start: int, i: int) -> int:
    """The place of the name right before i, or before the type parameters there; -1 if there is none after start."""
    j, depth = i - 1, 0
    if j > start and tokens[j].text == ">":
        while j > start:
            depth += {">": 1, "<": -1}.get(tokens[j].text, 0)
            j -= 1
            if not depth:
                break
    return j if j >= start and tokens[j].kind == "name" and (j < i - 1 or depth == 0) else -1


def _until_semicolon(tokens, pair, i, end) -> int:
    while i < end and tokens[i].text != ";":
        i = pair[i] + 1 if tokens[i].text in "([{" and pair.get(i, -1) > i else i + 1
    return min(i, end - 1)


class Scorer:
    """The score of a body: what nests costs one and its depth, what doesn't costs one."""

    def __init__(self, tokens: list[Token]):
        self.tokens, self.pair, self.score = tokens, matching(tokens), 0

    def text(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def group(self, i: int, depth: int) -> int:
        """An expression in brackets; the place behind."""
        end = self.pair.get(i, len(self.tokens) - 1)
        self.expression(i + 1, end, depth)
        return end + 1

    def statement(self, i: int, end: int, depth: int, else_if: bool = False) -> int:
        t = self.text(i)
        if t == "{":
            close = self.pair.get(i, end)
            j = i + 1
            while j < close:
                j = self.statement(j, close, depth)
            return close + 1
        if t == "if":
            self.score += 1 if else_if else 1 + depth
            j = self.statement(self.group(i + 1, depth), end, depth + 1)
            if j < end and self.text(j) == "else":
                if self.text(j + 1) == "if":
                    return self.statement(j + 1, end, depth, else_if=True)
                self.score += 1
                return self.statement(j + 1, end, depth + 1)
            return j
        if t == "await" and self.text(i + 1) == "for":
            return self.statement(i + 1, end, depth)
        if t in ("for", "while"):
            self.score += 1 + depth
            return self.statement(self.group(i + 1, depth), end, depth + 1)
        if t == "do":
            self.score += 1 + depth
            j = self.statement(i + 1, end, depth + 1)
            return self.group(j + 1, depth) + 1 if self.text(j) == "while" else j
        if t == "switch":
            self.score += 1 + depth
            return self.cases(self.group(i + 1, depth), depth + 1)
        if t in ("try", "finally"):
            return self.statement(i + 1, end, depth)
        if t in ("on", "catch") and self.text(i - 1) == "}":
            self.score += 1 + depth
            while i < end and self.text(i) != "{":
                i += 1
            return self.statement(i, end, depth + 1)
        if t in ("break", "continue"):
            self.score += self.text(i + 1) != ";"
            return i + 3 if self.text(i + 1) != ";" else i + 2
        if self.tokens[i].kind == "name" and self.text(i + 1) == ":" and t not in RESERVED:
            return i + 2  # a label
        stop = self._statement_end(i, end)
        self.expression(i, stop, depth)
        return stop + 1

    def _statement_end(self, i: int, end: int) -> int:
        while i < end and self.text(i) != ";":
            close = self.pair.get(i, -1)
            if close > i:
                # a local function ends with its block
                if self.text(i) == "{" and self.text(i - 1) in (")", "async", "*") and self.text(close + 1) not in (";", ",", ")", ".", "?.", ".."):
                    return close
                i = close
            i += 1
        return i

    def cases(self, i: int, depth: int) -> int:
        close = self.pair.get(i, len(self.tokens) - 1)
        j = i + 1
        while j < close:
            if self.text(j) in ("case", "default"):
                stop = j
                while stop < close and self.text(stop) != ":":
                    stop = self.pair[stop] + 1 if self.pair.get(stop, -1) > stop else stop + 1
                self.expression(j + 1, stop, depth)
                j = stop + 1
            elif any(self.text(x) == "=>" for x in range(j, min(close, j + 40))) and self.text(j) not in ("return", "if", "for"):
                stop = j  # an arm of a switch expression
                while stop < close and self.text(stop) != ",":
                    stop = self.pair[stop] + 1 if self.pair.get(stop, -1) > stop else stop + 1
                arrow = next((x for x in range(j, stop) if self.text(x) == "=>"), j)
                self.expression(j, arrow, depth)
                self.expression(arrow + 1, stop, depth)
                j = stop + 1
            else:
                j = self.statement(j, close, depth)
        return close + 1

    def expression(self, i: int, end: int, depth: int) -> None:
        """Tokens [i, end): conditionals, closures, switch expressions, collection elements and operator runs."""
        self._runs(i, end)
        while i < end:
            t = self.text(i)
            if t in ("if", "for") and self.text(i + 1) == "(":  # of a collection
                else_if = t == "if" and self.text(i - 1) == "else"
                self.score += 1 if else_if else 1 + depth
                j = self.group(i + 1, depth)
                stop = self._element_end(j, end)
                self.expression(j, stop, depth + 1)
                if self.text(stop) == "else":
                    if self.text(stop + 1) == "if":
                        i = stop + 1
                        continue
                    self.score += 1
                    last = self._element_end(stop + 1, end)
                    self.expression(stop + 1, last, depth + 1)
                    stop = last
                i = stop
            elif t == "switch" and self.text(i + 1) == "(":
                self.score += 1 + depth
                i = self.cases(self.group(i + 1, depth), depth + 1)
            elif t == "when":
                self.score += 1
                i += 1
            elif t == "?" and (colon := self._colon(i, end)) is not None:
                self.score += 1 + depth
                self.expression(i + 1, colon, depth + 1)
                self.expression(colon + 1, end, depth + 1)
                return
            elif t == "(" and self.pair.get(i, -1) > i:
                after = self.pair[i] + 1
                while self.text(after) in ("async", "sync", "*"):
                    after += 1
                if self.text(after) == "{":
                    self.expression(i + 1, self.pair[i], depth)
                    i = self.statement(after, end, depth + 1)
                elif self.text(after) == "=>":
                    self.expression(i + 1, self.pair[i], depth)
                    stop = self._element_end(after + 1, end)
                    self.expression(after + 1, stop, depth + 1)
                    i = stop
                else:
                    i = self._inner(i, depth)
            elif t in ("[", "{") and self.pair.get(i, -1) > i:
                i = self._inner(i, depth)
            else:
                i += 1

    def _inner(self, i: int, depth: int) -> int:
        """A bracket's parts between commas; a plain bracket's operators count with the run around it."""
        close, j = self.pair[i], i + 1
        plain = self.text(i) == "(" and self._is_plain(i)
        while j < close:
            stop = self._element_end(j, close)
            if plain:
                self.skip_runs = True
            self.expression(j, stop, depth)
            j = stop + 1
        return close + 1

    def _is_plain(self, i: int) -> bool:
        before = self.tokens[i - 1] if i else None
        return before is None or before.kind == "mark" and before.text not in (")", "]", ">") or before.text in ("return", "in")

    skip_runs = False

    def _runs(self, i: int, end: int) -> None:
        if self.skip_runs:
            self.skip_runs = False
            return
        last = None
        for op in self._operators(i, end):
            if op in ("&&", "||"):
                self.score += op != last
                last = op
            else:
                last = None

    def _operators(self, i: int, end: int) -> Iterator[str]:
        """Logical operators, and marks that end a run, through plain brackets."""
        while i < end:
            t = self.text(i)
            if t in ("&&", "||"):
                yield t
            elif t in (",", ";", "?", ":", "=>", "=", "??"):
                yield ","
                if t == "?" and self._colon(i, end) is not None or t == "=>":
                    return  # these parts are read by themselves
            elif t in "([{" and self.pair.get(i, -1) > i:
                if t == "(" and self._is_plain(i) and self.text(self.pair[i] + 1) not in ("{", "=>", "async"):
                    yield from self._operators(i + 1, self.pair[i])
                i = self.pair[i]
            i += 1

    def _colon(self, i: int, end: int) -> int | None:
        """The colon of the conditional whose mark is at i; none if the mark is a nullable type's."""
        depth, j = 0, i + 1
        while j < end:
            t = self.text(j)
            if t in (",", ";", "="):
                return None
            if t == "?":
                depth += 1
            elif t == ":":
                if not depth:
                    return j
                depth -= 1
            j = self.pair[j] + 1 if self.pair.get(j, -1) > j else j + 1
        return None

    def _element_end(self, i: int, end: int) -> int:
        while i < end and self.text(i) not in (",", ";", "else"):
            i = self.pair[i] + 1 if self.pair.get(i, -1) > i else i + 1
        return min(i, end)


def body_score(tokens: list[Token], d: Declaration) -> int:
    s = Scorer(tokens)
    if s.text(d.head) == "(":
        s.expression(d.head + 1, s.pair[d.head], 0)
    if s.text(d.first) == "{":
        s.statement(d.first, d.last, 0)
    else:
        s.expression(d.first + 1, d.last + (d.last == len(tokens) - 1 and s.text(d.last) != ";"), 0)
    return s.score


def analyze(source: str) -> list[tuple[str, int, int, int]]:
    """(name, start_line, end_line, score) of each declaration, the highest score first."""
    try:
        tokens = tokenize(source)
        rows = [(d.name, d.start_line, d.end_line, body_score(tokens, d)) for d in declarations(tokens)]
    except (IndexError, KeyError, RecursionError):
        return []
    return sorted(rows, key=lambda r: (-r[3], r[1], r[0]))


def snippet_score(code: str) -> int:
    """The score of statements outside any declaration."""
    tokens = tokenize("{" + code + "}")
    s = Scorer(tokens)
    s.statement(0, len(tokens) - 1, 0)
    return s.score


def candidate_units(tokens: list[Token], min_tokens: int = 40, min_lines: int = 4) -> list[tuple[str, int, int]]:
    """(kind, first, last): declarations, blocks and if, for, while, try and switch statements of enough tokens
    and lines; ``do`` loops aren't units."""
    pair, spans = matching(tokens), []
    spans += [("declaration", d.head, d.last) for d in declarations(tokens)]
    for i, t in enumerate(tokens):
        if t.text == "{" and i in pair and i and tokens[i - 1].text in (")", "else", "try", "finally", "do", "async", "{", "}", ";"):
            spans.append(("block", i, pair[i]))
        elif t.kind == "name" and t.text in UNIT_KINDS and i + 1 < len(tokens) and tokens[i + 1].text in ("(", "{"):
            j = pair.get(i + 1, i) + 1 if tokens[i + 1].text == "(" else i + 1
            last = pair.get(j, j) if j < len(tokens) and tokens[j].text == "{" else _until_semicolon(tokens, pair, j, len(tokens))
            spans.append((t.text, i, last))
    big = lambda a, b: b - a + 1 >= min_tokens and tokens[b].line - tokens[a].line + 1 >= min_lines
    return sorted({s for s in spans if s[2] > s[1] and big(s[1], s[2])}, key=lambda s: (s[1], -s[2], s[0]))


def statement_spans(tokens: list[Token], first: int, last: int) -> list[tuple[int, int]]:
    """(first, last) of the statements right inside the block that ``first`` opens and ``last`` closes."""
    s, out, i = Scorer(tokens), [], first + 1
    while i < last:
        j = s.statement(i, last, 0)
        while j < last and (tokens[j - 1].text == ":" or tokens[j - 1].text == "}" and tokens[j].text in ("on", "catch", "finally")):
            j = s.statement(j, last, 0)
        out.append((i, min(j, last) - 1))
        i = max(j, i + 1)
    return out


def unit_rows(files: DataFrame, min_tokens: int, min_lines: int, ignore_literals: bool = True, ignore_identifiers: bool = False) -> DataFrame:
    """(doc_id, path, first, n_tokens, hash, lines) of the candidate units of ``files`` (path, content).

    ``hash`` is of the compared tokens, ``lines`` are the distinct hashes of the statements of declarations and
    blocks with a block body; other units have none.
    """

    def units(path, content):
        tokens = tokenize(content)
        norm = [t.norm(ignore_literals, ignore_identifiers) for t in tokens]
        digest = lambda a, b: hashlib.md5("\0".join(norm[a : b + 1]).encode("utf-8", "replace")).hexdigest()
        body = {(d.head, d.last): d.first for d in declarations(tokens)}
        seen = set()
        for kind, a, b in candidate_units(tokens, min_tokens, min_lines):
            open_ = body.get((a, b), a) if kind == "declaration" else a
            lines = {digest(*s) for s in statement_spans(tokens, open_, b)} if tokens[open_].text == "{" else set()
            if (a, b) not in seen:
                yield f"{path}:{a}:{b}", path, a, b - a + 1, digest(a, b), sorted(lines)
            seen.add((a, b))

    def run(parts):
        for p in parts:
            rows = []
            for path, content in zip(p.path, p.content):
                try:
                    rows += units(path, content or "")
                except (IndexError, KeyError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=["doc_id", "path", "first", "n_tokens", "hash", "lines"])

    return files.select("path", "content").mapInPandas(run, "doc_id string, path string, first int, n_tokens int, hash string, lines array<string>")


def token_rows(files: DataFrame, ignore_literals: bool = True, ignore_identifiers: bool = False) -> DataFrame:
    """(path, pos, norm, orig, line, col) of the tokens of ``files`` (path, content)."""

    def run(parts):
        for p in parts:
            rows = [
                (path, i, t.norm(ignore_literals, ignore_identifiers), t.text, t.line, t.column)
                for path, content in zip(p.path, p.content) for i, t in enumerate(tokenize(content or ""))
            ]
            yield pd.DataFrame(rows, columns=["path", "pos", "norm", "orig", "line", "col"])

    return files.select("path", "content").mapInPandas(run, "path string, pos int, norm string, orig string, line int, col int")


def complexity_rows(files: DataFrame) -> DataFrame:
    """(path, name, start_line, end_line, score) of the declarations of ``files`` (path, content)."""

    def run(parts):
        for p in parts:
            rows = [(path, *r) for path, content in zip(p.path, p.content) for r in analyze(content or "")]
            yield pd.DataFrame(rows, columns=["path", "name", "start_line", "end_line", "score"])

    return files.select("path", "content").mapInPandas(run, "path string, name string, start_line int, end_line int, score int")
