"""What annotations, pragmas and names say of a declaration, as column expressions; and framework adapters.

``annotations`` is an array of names as written, such as ``meta.protected``; ``pragmas`` an array of pragma names.
Null arrays hold nothing, a null name fits nothing.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
TEST_SUPPORT = ("visibleForTesting", "VisibleForTesting", "visibleForOverriding", "VisibleForOverriding", "protected", "Protected")
NATIVE = ("Native", "native")
ENTRY_PRAGMAS = ("vm:entry-point", "vm:entrypoint", "vm:isolate-unsendable", "wasm:entry-point", "wasm:export", "dyn-module:entry-point")
FLUTTER_PRAGMAS = ("vm:entry-point", "vm:entrypoint", "flutter:entry-point", "flutter:entrypoint")
WASM_PRAGMAS = ("wasm:export", "wasm:entry-point", "wasm:entrypoint")
INTEROP = ("JS", "staticInterop", "anonymous")
INTEROP_TYPES = (
    "JSAny", "JSObject", "JSFunction", "JSArray", "JSString", "JSNumber", "JSBoolean", "JSPromise", "JSSymbol", "JSBigInt", "JSBoxedDartObject", "JSTypedArray",
    "JSUint8Array", "JSInt8Array", "JSUint8ClampedArray", "JSInt16Array", "JSUint16Array", "JSInt32Array", "JSUint32Array", "JSFloat32Array", "JSFloat64Array",
    "JSArrayBuffer", "JSDataView", "JSExportedDartFunction",
)
TESTS, FIXTURES = ("test", "solo_test"), ("setUp", "setUpAll", "tearDown", "tearDownAll")


def _or(tests: Iterable[Column]) -> Column:
    return reduce(Column.__or__, tests, F.lit(False))


def has_annotation(annotations: Column, names: Iterable[str]) -> Column:
    """Whether one of ``names`` is an annotation's last part, or the class of a named constructor."""
    wanted = list(names)
    hit = lambda a: F.exists(F.slice(F.split(a, r"\."), -2, 2), lambda p: p.isin(wanted)) | a.isin(wanted)
    return F.coalesce(F.exists(annotations, hit), F.lit(False))


def has_pragma(pragmas: Column, names: Iterable[str], with_argument: bool = False) -> Column:
    """Whether a pragma is one of ``names``, with ``with_argument`` also one followed by a colon and more."""
    names = list(names)
    hit = lambda p: p.isin(names) | (_or(p.startswith(n + ":") for n in names) if with_argument else F.lit(False))
    return F.coalesce(F.exists(pragmas, hit), F.lit(False))


def is_test_support(name: Column, annotations: Column) -> Column:
    return F.coalesce(name.rlike("^(Fake|Mock)|(Fake|Mock)$"), F.lit(False)) | has_annotation(annotations, TEST_SUPPORT)


def is_native_or_entry(annotations: Column, pragmas: Column) -> Column:
    return has_annotation(annotations, NATIVE) | has_pragma(pragmas, ENTRY_PRAGMAS)


class FrameworkAdapter:
    """What a framework adds: names that are roots, and predicates. Subclasses override what they know."""

    def roots(self) -> frozenset[str]:
        return frozenset()

    def is_entry_point(self, pragmas: Column) -> Column:
        return F.lit(False)

    def is_external_binding(self, annotations: Column, has_external: Column, extended_type: Column) -> Column:
        return F.lit(False)

    def is_test_call(self, name: Column) -> Column:
        return F.lit(False)

    def is_fixture_call(self, name: Column) -> Column:
        return F.lit(False)


class Flutter(FrameworkAdapter):
    def __init__(self, plugin_classes: Iterable[str] = (), has_app: bool = False):
        self._roots = frozenset(plugin_classes) | (frozenset({"main"}) if has_app else frozenset())

    def roots(self) -> frozenset[str]:
        return self._roots

    def is_entry_point(self, pragmas: Column) -> Column:
        return has_pragma(pragmas, FLUTTER_PRAGMAS)

    def is_test_call(self, name: Column) -> Column:
        return name == "testWidgets"


class Builders(FrameworkAdapter):
    def __init__(self, factories: Iterable[str] = ()):
        self._roots = frozenset(factories)

    def roots(self) -> frozenset[str]:
        return self._roots


class PackageTest(FrameworkAdapter):
    def is_test_call(self, name: Column) -> Column:
        return name.isin(*TESTS)

    def is_fixture_call(self, name: Column) -> Column:
        return name.isin(*FIXTURES)


class Interop(FrameworkAdapter):
    """``extended_type`` is what an extension type stands for, null for other declarations."""

    def is_entry_point(self, pragmas: Column) -> Column:
        return has_pragma(pragmas, WASM_PRAGMAS, with_argument=True)

    def is_external_binding(self, annotations: Column, has_external: Column, extended_type: Column) -> Column:
        stands_for = F.coalesce(extended_type.isin(*INTEROP_TYPES), F.lit(False))
        return F.coalesce(has_external, F.lit(False)) | has_annotation(annotations, INTEROP) | stands_for


class Composite(FrameworkAdapter):
    """The roots of all ``adapters``, and what any of them says."""

    def __init__(self, *adapters: FrameworkAdapter):
        self.adapters = adapters or (Flutter(), Builders(), PackageTest(), Interop())

    def roots(self) -> frozenset[str]:
        return frozenset().union(*(a.roots() for a in self.adapters))

    def is_entry_point(self, pragmas: Column) -> Column:
        return _or(a.is_entry_point(pragmas) for a in self.adapters)

    def is_external_binding(self, annotations: Column, has_external: Column, extended_type: Column) -> Column:
        return _or(a.is_external_binding(annotations, has_external, extended_type) for a in self.adapters)

    def is_test_call(self, name: Column) -> Column:
        return _or(a.is_test_call(name) for a in self.adapters)

    def is_fixture_call(self, name: Column) -> Column:
        return _or(a.is_fixture_call(name) for a in self.adapters)
