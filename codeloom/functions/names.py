"""Scalar functions on names, types, paths and addresses, all in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often (or in a loop) it occurs."""
    return F.element_at(F.transform(F.array(value), use), 1)


def camel_tokens(name: Column) -> Column:
    """Distinct parts of a name at capitals, underscores and spaces."""
    return F.array_distinct(F.split(F.regexp_replace(F.regexp_replace(name, "(.+?)([A-Z])", "$1_$2"), "[_ ]+", "_"), "_"))


def segment(name: Column) -> Column:
    """Parts at a change from small to capital letters and at underscores, in order and with repeats."""
    return F.split(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2"), "_")


def grams(words: Column, most: int = 3) -> Column:
    """All runs of 1 to ``most`` words."""

    def of(ws: Column) -> Column:
        runs = lambda n: F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(1), F.size(ws) - (n - 1)), lambda i: F.array_join(F.slice(ws, i, n), " "))).otherwise(F.expr("cast(array() as array<string>)"))
        return F.concat(*(runs(n) for n in range(1, most + 1)))

    return let(words, of)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def last_two(path: Column, line: Column) -> Column:
    """The last two parts of a path with a line number."""
    parts = F.split(path, "/")
    return F.concat(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/"), F.lit("#"), line.cast("string"))


def return_type(signature: Column) -> Column:
    return F.trim(F.element_at(F.split(signature, r"\("), 1))


def parameter_types(signature: Column) -> Column:
    """The types between the parentheses; commas inside angle brackets or parentheses do not part them."""
    inside = F.regexp_replace(F.regexp_extract(signature, r"\((.*)\)", 1), r"^\s+|\s+$", "")
    # commas at depth 0 become a mark: pieces between brackets carry their depth along
    pieces = F.regexp_extract_all(inside, F.lit(r"[<(]|[>)]|,|[^<>(),]+"), 0)
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))
    step = lambda acc, x: F.struct((acc["depth"] + F.when(x.isin("<", "("), 1).when(x.isin(">", ")"), -1).otherwise(0)).alias("depth"), F.concat(acc["out"], F.when((x == ",") & (acc["depth"] == 0), F.lit("\u0001")).otherwise(x)).alias("out"))
    parted = F.aggregate(pieces, start, step, lambda acc: acc["out"])
    return F.filter(F.transform(F.split(parted, "\u0001"), lambda x: F.trim(x)), lambda x: x != "")


def array_sizes(type_name: Column) -> Column:
    """All bracketed sizes of an array type."""
    return F.regexp_extract_all(type_name, F.lit(r"\[(.*?)\]"), 1)


def type_class(type_name: Column) -> Column:
    """multi_array, array, pointer or scalar; an array of pointers is an array."""
    n = F.size(array_sizes(type_name))
    return F.when(n > 1, "multi_array").when(n == 1, "array").when(type_name.contains("*"), "pointer").otherwise("scalar")


def position(text: Column) -> Column:
    """``[line:col]`` as a struct that compares by line, then column."""
    return F.struct(F.regexp_extract(text, r"\[?(\d+):", 1).try_cast("int").alias("line"), F.regexp_extract(text, r":(\d+)\]?", 1).try_cast("int").alias("col"))


def address(hexa: Column) -> Column:
    """``0x...`` as a number."""
    return F.conv(F.regexp_replace(hexa, "^0[xX]", ""), 16, 10).try_cast("long")


def frame_offset(offset: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(F.abs(offset + 16))))


def global_id(unit: Column, local: Column) -> Column:
    """A unit's number followed by its local hash in 11 digits."""
    return F.concat(unit.cast("string"), F.lpad(local.cast("string"), 11, "0"))
