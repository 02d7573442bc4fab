"""Variable events, jumps and loops of slices of Dart functions, as tables for the data-flow operators.

A request is a range of lines in a source; its function is read token by token, with block scopes, and a token's
index is its place. Types are those written, else guessed from plain initialisers, ``dynamic`` otherwise. Without a
compiler, fields, properties and top-level names are told from variables by scope alone: what no scope declares is
none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.operators import dataflow
from tidewrack.plans.lineage import cut, unsized
from tidewrack.sources.dart import RESERVED, Declaration, Token, declarations, matching, tokenize
from tidewrack.sources.package import names_in_string

ASSIGN = frozenset("= += -= *= /= ~/= %= &= |= ^= <<= >>>= ??=".split())
INTRODUCE = frozenset("final var const late".split())
NEVER = 1 << 30


@dataclass
class Variable:
    name: str
    type: str
    declared: int
    line: int


@dataclass
class Facts:
    """What a function's tokens say; places are token indices."""

    name: str
    first: int
    last: int
    type_params: list[tuple[str, str]] = field(default_factory=list)
    variables: dict[str, Variable] = field(default_factory=dict)
    uses: list[tuple[str, int, bool, bool, str]] = field(default_factory=list)  # variable, place, is write, by a pattern, type there
    jumps: list[tuple[int, str, int | None]] = field(default_factory=list)  # place, kind, target
    captured: list[tuple[int, str, int]] = field(default_factory=list)  # place, variable, start of the closure
    loops: list[tuple[int, int, int]] = field(default_factory=list)  # first, last, carry
    awaits: list[int] = field(default_factory=list)


class _Function:
    def __init__(self, tokens: list[Token], pair: dict[int, int], d: Declaration):
        self.tokens, self.pair, self.d = tokens, pair, d
        self.facts = Facts(d.name.rpartition(".")[2].rpartition(" ")[2], d.head, d.last)
        self.scopes: list[tuple[int, dict[str, str]]] = [(NEVER, {})]  # (last place, name to variable)
        self.closures: list[tuple[int, int]] = []
        self.targets: list[tuple[int, int, str, str | None]] = []  # first, last, loop or switch, label
        self.catches: list[tuple[int, int]] = []
        self.promoted: list[tuple[int, int, str, str]] = []  # first, last, variable, type

    def text(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def kind(self, i: int) -> str:
        return self.tokens[i].kind if 0 <= i < len(self.tokens) else ""

    def source(self, a: int, b: int) -> str:
        out = ""
        for i in range(a, b):
            t = self.text(i)
            out += (" " if out and (self.kind(i) == "name" and (out[-1].isalnum() or out[-1] in ",>?") or out[-1] == ",") else "") + t
        return out

    def declare(self, name: str, type_: str, at: int, scope: dict[str, str]) -> None:
        key = f"{name}@{at}"
        scope[name] = key
        self.facts.variables[key] = Variable(name, type_, at, self.tokens[at].line)

    def lookup(self, name: str) -> str | None:
        return next((s[name] for _, s in reversed(self.scopes) if name in s), None)

    def parameters(self, open_: int, scope: dict[str, str]) -> None:
        close = self.pair.get(open_, open_)
        i = open_ + 1
        while i < close:
            if self.text(i) in ("{", "["):
                self.parameters(i, scope)
                i = self.pair.get(i, i) + 1
                continue
            end, depth = i, 0
            while end < close and not (self.text(end) == "," and not depth):
                depth += {"<": 1, ">": -1}.get(self.text(end), 0)
                if self.text(end) in ("{", "[") and end == i:
                    break
                end = self.pair[end] + 1 if self.text(end) in "([{" and self.pair.get(end, -1) > end else end + 1
            value = next((j for j in range(i, end) if self.text(j) == "="), end)
            start = i
            while self.text(start) in ("required", "final", "covariant", "const", "var") and start < value:
                start += 1
            if value - 1 >= start and self.kind(value - 1) == "name" and self.text(value - 2) != ".":
                self.declare(self.text(value - 1), self.source(start, value - 1) or "dynamic", value - 1, scope)
            elif value - 1 >= start and self.text(value - 1) == ")":  # a function as a parameter
                k = self.pair.get(value - 1, value) - 1
                if self.kind(k) == "name":
                    self.declare(self.text(k), "Function", k, scope)
            i = end + 1

    def run(self) -> Facts:
        d, scope = self.d, self.scopes[0][1]
        if self.text(d.head) == "(":
            if self.text(d.head - 1) == ">":
                self.type_parameters(d.head - 1)
            self.parameters(d.head, scope)
            start = self.pair[d.head] + 1
            if self.text(start) == ":":
                for j in range(start, d.first):
                    self.facts.jumps.append((j, "constructorInitializerEscape", None))
        else:
            start = d.first
        i = start
        while i <= d.last:
            while self.scopes[-1][0] < i:
                self.scopes.pop()
            i = self.step(i)
        return self.facts

    def type_parameters(self, close: int) -> None:
        depth, i = 0, close
        while i > 0:
            depth += {">": 1, "<": -1}.get(self.text(i), 0)
            if not depth:
                break
            i -= 1
        if i and self.kind(i - 1) == "name":
            self.facts.name = self.text(i - 1)
        start, depth = i + 1, 0
        for j in range(i + 1, close + 1):
            if j == close or self.text(j) == "," and not depth:
                self.facts.type_params.append((self.text(start), " ".join(t.text for t in self.tokens[start:j])))
                start = j + 1
            depth += {"<": 1, ">": -1}.get(self.text(j), 0)

    def statement_end(self, i: int) -> int:
        """The last place of the statement at i."""
        t = self.text(i)
        if t == "{":
            return self.pair.get(i, i)
        if t in ("for", "while", "if", "switch") and self.text(i + 1) == "(":
            end = self.statement_end(self.pair.get(i + 1, i + 1) + 1)
            return self.statement_end(end + 2) if t == "if" and self.text(end + 1) == "else" else end
        while i < self.d.last and self.text(i) != ";":
            i = self.pair[i] + 1 if self.text(i) in "([{" and self.pair.get(i, -1) > i else i + 1
        return i

    def at_statement(self, i: int) -> bool:
        return self.text(i - 1) in ("{", "}", ";", "=>", ":", "else", "do") or self.text(i - 1) == ")" or self.text(i - 1) == "(" and self.text(i - 2) == "for"

    def step(self, i: int) -> int:
        t, kind = self.text(i), self.kind(i)
        f = self.facts
        if t == "{" and i in self.pair:
            self.scopes.append((self.pair[i], {}))
            return i + 1
        if t in ("for", "while", "do", "switch") and kind == "name":
            return self.loop(i)
        if t == "if" and self.text(i + 1) == "(" and i + 1 in self.pair:
            self.promotions(i)
            return i + 1
        if t == "await":
            f.awaits.append(i)
            return i + 1
        if t == "return":
            f.jumps.append((i, "earlyReturn", self.closure(i)))
            return i + 1
        if t == "yield":
            f.jumps.append((i, "yieldEscape", self.closure(i)))
            return i + 1
        if t == "rethrow":
            f.jumps.append((i, "rethrowEscape", next((a for a, b in reversed(self.catches) if a <= i <= b), None)))
            return i + 1
        if t in ("break", "continue"):
            label = self.text(i + 1) if self.kind(i + 1) == "name" else None
            around = [x for x in self.targets if x[0] <= i <= x[1] and (x[3] == label if label else x[2] == "loop" or t == "break")]
            f.jumps.append((i, "loopBreak" if t == "break" else "loopContinue", around[-1][0] if around else None))
            return i + 1 + (label is not None)
        if t == "catch" and self.text(i + 1) == "(":
            close = self.pair.get(i + 1, i + 1)
            body = close + 1
            end = self.pair.get(body, body)
            scope: dict[str, str] = {}
            for j in range(i + 2, close):
                if self.kind(j) == "name":
                    kinds = [self.text(k) for k in range(max(0, i - 3), i) if self.kind(k) == "name" and self.text(k - 1) == "on"]
                    self.declare(self.text(j), "StackTrace" if scope else kinds[0] if kinds else "Object", j, scope)
            self.scopes.append((end, scope))
            self.catches.append((i, end))
            return body
        if t == "(" and i in self.pair:
            after = self.pair[i] + 1
            mark = after
            while self.text(mark) in ("async", "sync", "*"):
                mark += 1
            before = self.tokens[i - 1] if i else None
            call = before is not None and (before.kind == "name" and before.text not in RESERVED or before.text in (")", "]", ">"))
            controls = before is not None and before.text in ("if", "for", "while", "switch", "assert")
            if self.text(mark) in ("{", "=>") and not controls and (not call or self.local_function(i)):
                scope = {}
                if self.text(mark) == "{":
                    end = self.pair.get(mark, mark)
                else:
                    end = mark + 1
                    while end < self.d.last and self.text(end) not in (",", ";", ")", "]", "}"):
                        end = self.pair[end] + 1 if self.text(end) in "([{" and self.pair.get(end, -1) > end else end + 1
                    end -= 1
                self.parameters(i, scope)
                self.scopes.append((end, scope))
                self.closures.append((i, end))
                return mark + (self.text(mark) == "=>")
            if self.text(after) == "=" and self.at_statement(i):  # a pattern that assigns
                for j in range(i + 1, self.pair[i]):
                    if self.kind(j) == "name" and self.text(j + 1) != ":" and (key := self.lookup(self.text(j))):
                        self.use(key, j, True, True)
                return after + 1
            return i + 1
        if t in INTRODUCE and self.at_statement(i) or kind == "name" and t not in RESERVED and self.at_statement(i) and self.typed(i):
            return self.introduction(i)
        if kind == "string":
            for name in names_in_string(t):
                if key := self.lookup(name):
                    self.use(key, i, False)
            return i + 1
        if kind == "name" and self.text(i - 1) not in (".", "?.", "..", "?..") and (key := self.lookup(t)):
            after, before = self.text(i + 1), self.text(i - 1)
            label = after == ":" and before in ("(", ",", "{") and self.text(i - 1) != "?"
            if not label:
                step = after in ("++", "--") or before in ("++", "--")
                if after in ASSIGN or step:
                    if after != "=":
                        self.use(key, i, False)
                    self.use(key, i, True)
                else:
                    self.use(key, i, False)
        return i + 1

    def local_function(self, i: int) -> bool:
        return self.kind(i - 1) == "name" and (self.kind(i - 2) == "name" and self.text(i - 2) not in RESERVED or self.text(i - 2) in (">", "?", "{", "}", ";"))

    def closure(self, i: int) -> int | None:
        return next((a for a, b in reversed(self.closures) if a <= i <= b), None)

    def use(self, key: str, i: int, write: bool, by_pattern: bool = False) -> None:
        v = self.facts.variables[key]
        type_ = next((t for a, b, k, t in reversed(self.promoted) if k == key and a <= i <= b), v.type)
        self.facts.uses.append((key, i, write, by_pattern, type_))
        inner = self.closure(i)
        if write and inner is not None and v.declared < inner:
            self.facts.captured.append((i, v.name, inner))

    def promotions(self, i: int) -> None:
        """``if (x is T) ...``: the type of x in what follows."""
        close = self.pair[i + 1]
        for j in range(i + 2, close - 1):
            if self.text(j + 1) == "is" and self.kind(j) == "name" and self.text(j + 2) != "!" and self.text(j - 1) in ("(", "&&") and (key := self.lookup(self.text(j))):
                end = j + 3
                while end < close and self.text(end) not in ("&&", "||", ")"):
                    end += 1
                self.promoted.append((close + 1, self.statement_end(close + 1), key, self.source(j + 2, end)))

    def loop(self, i: int) -> int:
        t = self.text(i)
        label = self.text(i - 2) if self.text(i - 1) == ":" and self.kind(i - 2) == "name" and self.text(i - 3) in ("{", "}", ";") else None
        if t == "do":
            body = self.statement_end(i + 1)
            end = self.statement_end(body + 1)
            self.facts.loops.append((i, end, i))
            self.targets.append((i, end, "loop", label))
            return i + 1
        if self.text(i + 1) != "(" or i + 1 not in self.pair:
            return i + 1
        close = self.pair[i + 1]
        end = self.statement_end(close + 1)
        if t == "switch":
            self.targets.append((i, self.pair.get(close + 1, end), "switch", label))
            return i + 1
        if t == "while":
            if self.facts.loops and self.facts.loops[-1][1] > i and any(a < i <= b and self.text(a) == "do" and self.statement_end(a + 1) == i - 1 for a, b, _ in self.facts.loops):
                return i + 1  # the end of a do loop
            self.facts.loops.append((i, end, i))
        else:
            self.scopes.append((end, {}))
            semicolon = next((j for j in range(i + 2, close) if self.text(j) == ";"), None)
            self.facts.loops.append((i, end, semicolon if semicolon else i))
        self.targets.append((i, end, "loop", label))
        return i + 1

    def typed(self, i: int) -> int:
        """The place of the name if a type and a declared name stand at i, else 0."""
        j = i + 1
        while self.text(j) == "." and self.kind(j + 1) == "name":
            j += 2
        if self.text(j) == "<":
            depth = 0
            while j < self.d.last:
                depth += {"<": 1, ">": -1}.get(self.text(j), 0)
                if self.kind(j) != "name" and self.text(j) not in ("<", ">", ",", "?", ".", "(", ")"):
                    return 0
                j += 1
                if not depth:
                    break
        j += self.text(j) == "?"
        return j if self.kind(j) == "name" and self.text(j) not in RESERVED and self.text(j + 1) in ("=", ";", ",", "in") else 0

    def introduction(self, i: int) -> int:
        """A declaration of variables; their initialisers are read as any expression, before the name is known."""
        start = i
        while self.text(i) in INTRODUCE:
            i += 1
        if self.text(i) in "([{" and i in self.pair:  # a pattern
            scope = self.scopes[-1][1]
            for j in range(i + 1, self.pair[i]):
                if self.kind(j) == "name" and self.text(j + 1) in (",", ")", "]", "}"):
                    self.declare(self.text(j), "dynamic", j, scope)
            return self.pair[i] + 1
        at = self.typed(i) if start == i or self.kind(i + 1) == "name" or self.text(i + 1) in ("<", "?", ".") else i
        at = at or i
        written = self.source(i, at)
        scope = self.scopes[-1][1]
        if self.text(at + 1) == "in":
            self.declare(self.text(at), written or self.element(at + 2), at, scope)
            return at + 2
        while True:
            name, j = at, at + 1
            if self.text(j) == "=":
                j += 1
                begin = j
                while j < self.d.last and self.text(j) not in (";", ","):
                    j = self.pair[j] + 1 if self.text(j) in "([{" and self.pair.get(j, -1) > j else j + 1
                guessed = written or self.guessed(begin, j)
                k = begin
                while k < j:
                    while self.scopes[-1][0] < k:
                        self.scopes.pop()
                    k = self.step(k)
                while self.scopes[-1][0] < j:
                    self.scopes.pop()
            else:
                guessed = written or "dynamic"
            self.declare(self.text(name), guessed, name, scope)
            if self.text(j) != "," or self.kind(j + 1) != "name":
                return j
            at = j + 1

    def type_at(self, i: int) -> str | None:
        key = self.lookup(self.text(i))
        return self.facts.variables[key].type if key else None

    def element(self, i: int) -> str:
        m = re.fullmatch(r"(?:List|Set|Iterable|Stream)<(.*)>", self.type_at(i) or "")
        return m[1] if m and self.text(i + 1) == ")" else "dynamic"

    def guessed(self, a: int, b: int) -> str:
        """The type of a plain expression."""
        if self.text(a) == "await":
            inner = self.guessed(a + 1, b)
            m = re.fullmatch(r"(?:Future|FutureOr)<(.*)>", inner)
            return m[1] if m else inner
        for j in range(a, b):
            if self.text(j) == "?" and any(self.text(k) == ":" for k in range(j, b)):
                colon = next(k for k in range(j, b) if self.text(k) == ":")
                x, y = self.guessed(j + 1, colon), self.guessed(colon + 1, b)
                if x == y:
                    return x
                if "Null" in (x, y):
                    other = y if x == "Null" else x
                    return other if other.endswith("?") or other == "dynamic" else other + "?"
                return "num" if {x, y} == {"int", "double"} else "Object"
        outside = [j for j in range(a, b)]
        top, j = [], a
        while j < b:
            top.append(self.text(j))
            j = self.pair[j] + 1 if self.text(j) in "([{" and self.pair.get(j, -1) > j else j + 1
        if any(x in ("==", "!=", "&&", "||", "<=", ">=", "is") for x in top) or top[:1] == ["!"] or (("<" in top or ">" in top) and self.kind(a) != "name" or "<" in top and top[-1] != ")" and ">" not in top):
            return "bool"
        if "/" in top:
            return "double"
        if "~/" in top:
            return "int"
        for op in ("+", "-", "*", "%"):
            if op in top[1:]:
                parts, start = [], a
                for j in outside + [b]:
                    if j == b or self.text(j) == op:
                        parts.append(self.guessed(start, j))
                        start = j + 1
                return parts[0] if len(set(parts)) == 1 else "double" if set(parts) == {"int", "double"} else parts[0] if parts[0] == "String" else "num" if set(parts) <= {"int", "double", "num"} else "dynamic"
        if self.kind(a) == "string":
            return "String" if b == a + 1 or all(self.kind(j) == "string" for j in range(a, b)) else self.member(a, b, "String")
        if self.kind(a) == "number":
            return "double" if re.search(r"[.eE]", self.text(a)) and not self.text(a).startswith("0x") else "int"
        if self.text(a) in ("true", "false"):
            return "bool"
        if self.text(a) == "null":
            return "Null"
        if self.text(a) == "<":
            end = next((j for j in range(a, b) if self.text(j) == ">"), a)
            return f"List<{self.source(a + 1, end)}>" if self.text(end + 1) == "[" else f"Map<{self.source(a + 1, end)}>" if "," in self.source(a + 1, end) else f"Set<{self.source(a + 1, end)}>"
        if self.text(a) == "[":
            kinds = {self.guessed(a + 1, next((j for j in range(a + 1, b) if self.text(j) in (",", "]")), b))} if self.text(a + 1) != "]" else {"dynamic"}
            return f"List<{kinds.pop()}>"
        if self.kind(a) == "name":
            known = self.type_at(a)
            if known:
                return known if b == a + 1 else self.member(a, b, known)
            if self.text(a)[:1].isupper() and self.text(a + 1) in ("(", "<", "."):
                if self.text(a) == "Future" and self.text(a + 2) == "value" and self.text(a + 3) == "(":
                    return f"Future<{self.guessed(a + 4, self.pair.get(a + 3, b))}>"
                if self.text(a + 1) == "<":
                    end = next((j for j in range(a, b) if self.text(j) == ">"), a)
                    return self.source(a, end + 1)
                return self.text(a)
        return "dynamic"

    def member(self, a: int, b: int, of: str) -> str:
        if self.text(b - 2) == "." or self.text(b - 1) == ")":
            last = self.text(b - 1) if self.text(b - 1) != ")" else self.text(self.pair.get(b - 1, b) - 1)
            known = {"length": "int", "isEmpty": "bool", "isNotEmpty": "bool", "toString": "String", "toInt": "int", "toDouble": "double", "contains": "bool"}
            same = {"toUpperCase", "toLowerCase", "trim", "substring", "abs"}
            return known.get(last) or (of if last in same else "dynamic")
        m = re.fullmatch(r"List<(.*)>", of)
        return m[1] if m and self.text(a + 1) == "[" and self.pair.get(a + 1) == b - 1 else "dynamic"


def read_slice(source: str, start_line: int, end_line: int) -> tuple[Facts, list[Token], int, int]:
    """(facts, tokens, first, last place) of the function that holds the lines; ValueError if there is none."""
    if start_line < 1 or end_line < start_line:
        raise ValueError(f"bad lines: {start_line} must be 1 or more, and no more than {end_line}")
    lines = source.count("\n") + 1
    if start_line > lines:
        raise ValueError(f"line {start_line} is behind the last, {lines}")
    tokens = tokenize(source)
    around = [d for d in declarations(tokens) if d.start_line <= start_line and end_line <= d.end_line]
    if not around:
        raise ValueError(f"the lines {start_line} to {end_line} aren't within one function")
    d = max(around, key=lambda d: d.head)
    facts = _Function(tokens, matching(tokens), d).run()
    places = [i for i in range(d.head, d.last + 1) if start_line <= tokens[i].line <= end_line]
    first = places[0] if places else next((i for i in range(d.head, d.last + 1) if tokens[i].line > end_line), d.last)
    return facts, tokens, first, places[-1] if places else first - 1


EVENT = "struct<var:string, name:string, at:int, is_write:boolean, is_decl:boolean, by_pattern:boolean, type:string, line:int, seq:int>"
SCHEMA = (
    "unit string, error string, enclosing string, first int, last int, type_params array<struct<name:string, source:string>>,"
    f" events array<{EVENT}>, jumps array<struct<at:int, kind:string, target:int, line:int>>, captured array<struct<at:int, name:string, closure:int, line:int>>,"
    " loops array<struct<loop_first:int, loop_last:int, carry:int>>, awaits array<int>"
)


def slice_facts(requests: DataFrame) -> DataFrame:
    """Facts of each request (unit, source, start_line, end_line); ``error`` says what is wrong with one."""

    def one(unit, source, a, b) -> tuple:
        try:
            f, tokens, first, last = read_slice(source or "", int(a), int(b))
        except (ValueError, IndexError, KeyError, RecursionError) as e:
            return (unit, str(e) or type(e).__name__, None, None, None, [], [], [], [], [], [])
        line = lambda i: tokens[i].line
        events = [{"var": k, "name": v.name, "at": v.declared, "is_write": True, "is_decl": True, "by_pattern": False, "type": v.type, "line": v.line, "seq": 0} for k, v in f.variables.items()]
        events += [{"var": k, "name": f.variables[k].name, "at": i, "is_write": w, "is_decl": False, "by_pattern": p, "type": t, "line": line(i), "seq": n} for n, (k, i, w, p, t) in enumerate(f.uses)]
        return (
            unit, None, f.name, first, last, [{"name": n, "source": s} for n, s in f.type_params], events,
            [{"at": i, "kind": k, "target": t, "line": line(i)} for i, k, t in f.jumps],
            [{"at": i, "name": n, "closure": c, "line": line(i)} for i, n, c in f.captured],
            [{"loop_first": a, "loop_last": b, "carry": c} for a, b, c in f.loops], f.awaits,
        )

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [one(*r) for r in zip(p.unit, p.source, p.start_line, p.end_line)]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in ("unit", "error", "enclosing", "first", "last", "type_params", "events", "jumps", "captured", "loops", "awaits")])
            yield out.astype({"first": "Int32", "last": "Int32"})

    return requests.select("unit", "source", "start_line", "end_line").mapInPandas(run, SCHEMA)


@dataclass(frozen=True)
class SliceReport:
    """Tables by unit: ``units`` (unit, error, enclosing, is_clean, is_async, type_params), ``inputs``, ``mutations``
    and ``outputs`` (unit, name, type, is_mutated, declared_line, mutation_line, at, declared), ``at`` the order of first uses, ``escapes``
    (unit, kind, line, at, name)."""

    units: DataFrame
    inputs: DataFrame
    mutations: DataFrame
    outputs: DataFrame
    escapes: DataFrame


def analyze(requests: DataFrame) -> SliceReport:
    facts = unsized(cut(slice_facts(requests)))
    right = facts.where("error is null")
    slices = right.select("unit", F.lit(0).alias("slice"), "first", "last").where("last >= first")
    all_events = unsized(cut(right.select("unit", F.explode("events").alias("e")).select("unit", "e.*")))
    # a declaration is no use, and a pattern that only writes takes no input
    events = all_events.select("unit", "at", "var", "is_write", "is_decl", "by_pattern")
    used = events.where("not is_decl").select("unit", "at", "var", "is_write", "is_decl").union(events.where("is_decl").select("unit", "at", "var", "is_write", "is_decl"))
    inside = all_events.where("not is_decl").join(slices, "unit").where("at >= first and at <= last")
    plain_at = F.coalesce(F.min(F.when(~F.col("by_pattern"), F.col("seq"))), F.min("seq"))
    first_use = inside.groupBy("unit", "var").agg(plain_at.alias("at"), F.min_by("type", "seq").alias("type"), F.min(F.when(F.col("is_write"), F.col("line"))).alias("mutation_line"))
    told = all_events.where("is_decl").select("unit", "var", "name", F.col("type").alias("own_type"), F.col("line").alias("declared_line"), F.col("at").alias("declared"))

    def table(of: DataFrame) -> DataFrame:
        rows = of.select("unit", "var").join(told, ["unit", "var"]).join(first_use, ["unit", "var"], "left")
        return rows.select(
            "unit", "name", F.coalesce("type", "own_type").alias("type"), F.col("mutation_line").isNotNull().alias("is_mutated"), "declared_line", "mutation_line",
            F.coalesce("at", F.lit(-1)).alias("at"), "declared",
        )

    plain = events.where("not by_pattern").select("unit", "at", "var", "is_write", "is_decl")
    ins = table(dataflow.inputs(plain, slices))
    muts = table(dataflow.mutations(used, slices))
    loops = right.select("unit", F.explode("loops").alias("l")).select("unit", "l.*")
    outs = table(dataflow.outputs(used, slices, loops))
    jumps = right.select("unit", F.explode("jumps").alias("j")).select("unit", "j.at", "j.kind", "j.target", "j.line")
    left = dataflow.escapes(jumps, slices).join(jumps.select("unit", "at", "kind", "line"), ["unit", "at", "kind"]).select("unit", "kind", "line", "at", F.lit(None).cast("string").alias("name"))
    caught = right.select("unit", "first", "last", F.explode("captured").alias("c")).where("c.at >= first and c.at <= last and c.closure >= first")
    left = left.union(caught.select("unit", F.lit("closureEscape"), "c.line", "c.at", "c.name"))
    left = unsized(cut(left.groupBy("unit", "kind", "line", "name").agg(F.min("at").alias("at")).select("unit", "kind", "line", "at", "name")))
    waits = right.select("unit", F.exists("awaits", lambda x: (x >= F.col("first")) & (x <= F.col("last"))).alias("is_async"))
    units = facts.select("unit", "error", "enclosing", "type_params").join(waits, "unit", "left").join(left.groupBy("unit").agg(F.count("*").alias("n")), "unit", "left")
    units = units.select("unit", "error", "enclosing", F.col("n").isNull().alias("is_clean"), "is_async", "type_params")
    return SliceReport(units, ins, muts, outs, left)


#: What a report says of each kind of escape.
SAYS = {
    "earlyReturn": "a return leaves the function", "loopBreak": "a break leaves a loop or label outside of the slice", "loopContinue": "a continue goes on with a loop outside of the slice",
    "yieldEscape": "a yield gives to the caller's generator", "rethrowEscape": "a rethrow stands outside of its catch", "closureEscape": "a nested function changes the variable {name}",
    "constructorInitializerEscape": "a constructor's initialisers can't be moved",
}


def results(report: SliceReport, names: dict[str, str] | None = None) -> dict[str, dict]:
    """The report of each unit, for a few requests; ``names`` gives the new functions' names. A unit with an error has only that."""
    rows: dict[str, dict[str, list]] = {}
    for kind in ("inputs", "mutations", "outputs"):
        for r in getattr(report, kind).collect():
            rows.setdefault(r.unit, {}).setdefault(kind, []).append(r)
    for r in report.escapes.collect():
        rows.setdefault(r.unit, {}).setdefault("escapes", []).append(r)
    out = {}
    for u in report.units.collect():
        if u.error:
            out[u.unit] = {"error": u.error}
            continue
        found = {k: sorted(rows.get(u.unit, {}).get(k, []), key=lambda r: r.at) for k in ("inputs", "mutations", "outputs", "escapes")}
        found["outputs"].sort(key=lambda r: r.declared)
        kinds = " ".join(r.type for k in ("inputs", "outputs") for r in found[k])
        params = [p.source for p in u.type_params if re.search(rf"\b{re.escape(p.name)}\b", kinds)]
        pairs = {k: [(r.name, r.type) for r in found[k]] for k in ("inputs", "outputs")}
        usage = lambda r: {"name": r.name, "type": r.type, "isMutated": r.is_mutated, "declarationLine": r.declared_line} | ({"mutationLine": r.mutation_line} if r.mutation_line else {})
        out[u.unit] = {
            "enclosing": u.enclosing, "isCleanlyExtractable": u.is_clean,
            **{k: [usage(r) for r in found[k]] for k in ("inputs", "mutations", "outputs")},
            "escapes": [{"type": r.kind, "line": r.line, "description": SAYS[r.kind].format(name=r.name)} for r in found["escapes"]],
            "suggestedSignature": dataflow.signature((names or {}).get(u.unit, "_extracted"), pairs["inputs"], pairs["outputs"], u.is_async, params),
        }
    return out


def signatures(report: SliceReport, name: str = "_extracted") -> DataFrame:
    """(unit, inputs, outputs, is_clean, signature) of each unit without an error, names joined by commas; in tasks, for any number."""
    lists = {k: getattr(report, k).groupBy("unit").agg(F.array_sort(F.collect_list(F.struct(at, "name", "type"))).alias(k)) for k, at in (("inputs", "at"), ("outputs", "declared"))}
    rows = report.units.where("error is null").join(lists["inputs"], "unit", "left").join(lists["outputs"], "unit", "left")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for unit, clean, waits, params, ins, outs in zip(p.unit, p.is_clean, p.is_async, p.type_params, p.inputs, p.outputs):
                pairs = [[(v["name"], v["type"]) for v in (x if x is not None else [])] for x in (ins, outs)]
                kinds = " ".join(t for x in pairs for _, t in x)
                used = [t["source"] for t in params if re.search(rf"\b{re.escape(t['name'])}\b", kinds)]
                out.append((unit, *(",".join(n for n, _ in x) for x in pairs), bool(clean), dataflow.signature(name, *pairs, bool(waits), used)))
            yield pd.DataFrame(out, columns=["unit", "inputs", "outputs", "is_clean", "signature"])

    return rows.select("unit", "is_clean", "is_async", "type_params", "inputs", "outputs").mapInPandas(run, "unit string, inputs string, outputs string, is_clean boolean, signature string")
