"""Inputs, mutations, outputs and escapes of slices of an ordered log of variable events.

``events``: (unit, at, var, is_write, is_decl); ``slices``: (unit, slice, first, last), places inside. A
variable's declaration is its first event with is_decl, else its first event.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def declarations(events: DataFrame) -> DataFrame:
    """(unit, var, declared)."""
    first = F.coalesce(F.min(F.when(F.col("is_decl"), F.col("at"))), F.min("at"))
    return events.groupBy("unit", "var").agg(first.alias("declared"))


def _places(spans: DataFrame, first: str = "first", last: str = "last") -> DataFrame:
    """``spans`` with a row for each place ``at`` inside: joins by unit and place are no product of a unit's rows."""
    return spans.withColumn("at", F.explode(F.sequence(first, last)))


def usages(events: DataFrame, slices: DataFrame) -> DataFrame:
    """(unit, slice, var, declared, first, last, at, is_write) of each event with each slice that it lies in."""
    return events.join(_places(slices), ["unit", "at"]).join(declarations(events), ["unit", "var"])


def inputs(events: DataFrame, slices: DataFrame) -> DataFrame:
    """(unit, slice, var, is_mutated): variables declared before the slice and used in it."""
    used = usages(events, slices).where(F.col("declared") < F.col("first"))
    return used.groupBy("unit", "slice", "var").agg(F.bool_or("is_write").alias("is_mutated"))


def mutations(events: DataFrame, slices: DataFrame) -> DataFrame:
    """(unit, slice, var, first_mutation): variables declared before the slice and written in it."""
    written = usages(events, slices).where(F.col("is_write") & (F.col("declared") < F.col("first")))
    return written.groupBy("unit", "slice", "var").agg(F.min("at").alias("first_mutation"))


def outputs(events: DataFrame, slices: DataFrame, loops: DataFrame | None = None) -> DataFrame:
    """(unit, slice, var): declared or written in the slice and read after it.

    Also what a loop carries: with ``loops`` (unit, loop_first, loop_last, carry) that begin before the slice and hold it, variables
    written in the slice, declared before ``carry`` and read anywhere in the loop.
    """
    made = usages(events, slices).where(F.col("is_write") | (F.col("declared") >= F.col("first")))
    reads = events.where(~F.col("is_write")).select("unit", "var", "at")
    last_read = reads.groupBy("unit", "var").agg(F.max("at").alias("last_read"))
    out = made.join(last_read, ["unit", "var"]).where("last_read > last").select("unit", "slice", "var").distinct()
    if loops is not None:
        inside = _places(loops, "loop_first", "loop_last")
        around = slices.withColumn("at", F.col("first")).join(inside, ["unit", "at"]).where("loop_first < first and last <= loop_last").select("unit", "slice", "loop_first", "loop_last")
        read = reads.join(inside, ["unit", "at"]).join(declarations(events), ["unit", "var"]).where("declared < carry")
        carried = made.where("is_write").select("unit", "slice", "var").distinct().join(around, ["unit", "slice"])
        carried = carried.join(read, ["unit", "var", "loop_first", "loop_last"], "left_semi").select("unit", "slice", "var")
        out = out.union(carried).distinct()
    return out


def escapes(jumps: DataFrame, slices: DataFrame) -> DataFrame:
    """(unit, slice, at, kind): jumps (unit, at, kind, target) inside a slice whose target lies outside it.

    A jump without target, such as a return, always leaves.
    """
    rows = jumps.join(_places(slices), ["unit", "at"])
    return rows.where("target is null or target < first or target > last").select("unit", "slice", "at", "kind")


def extractable(slices: DataFrame, leaving: DataFrame) -> DataFrame:
    """(unit, slice, is_clean): clean slices have no escape."""
    n = leaving.groupBy("unit", "slice").agg(F.count("*").alias("n"))
    return slices.join(n, ["unit", "slice"], "left").select("unit", "slice", F.col("n").isNull().alias("is_clean"))


def signature(name: str, ins: list[tuple[str, str]], outs: list[tuple[str, str]], is_async: bool = False, type_params: list[str] | None = None) -> str:
    """The signature of an extracted function; several outputs become a record with named fields.

    A field is the variable's name without underscores in front, ``result`` if nothing is left, with the least number
    from 2 behind it that makes it unlike the fields before.
    """
    if not outs:
        result = "void"
    elif len(outs) == 1:
        result = outs[0][1]
    else:
        fields: dict[str, str] = {}
        for var, kind in outs:
            plain = var.lstrip("_") or "result"
            fields[next(f for n in itertools.count(1) if (f := plain if n == 1 else f"{plain}{n}") not in fields)] = kind
        result = "({" + ", ".join(f"{kind} {f}" for f, kind in fields.items()) + "})"
    params = ", ".join(f"{kind} {var}" for var, kind in ins)
    generic = f"<{', '.join(type_params)}>" if type_params else ""
    return f"Future<{result}> {name}{generic}({params}) async" if is_async else f"{result} {name}{generic}({params})"
