"""List, object and comparison operations of data-flow nodes, as column expressions.

Null lists stay null; positions count from 0 and, where negative, from the end.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def nth(values: Column, at: int) -> Column:
    return F.get(values, F.lit(at)) if at >= 0 else F.get(values, F.size(values) + at)


def head(values: Column, n: int) -> Column:
    return F.slice(values, 1, n)


def tail(values: Column, n: int) -> Column:
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), F.lit(n))


def ordered(values: Column, descending: bool = False) -> Column:
    return F.sort_array(values, asc=not descending)


def distinct(values: Column) -> Column:
    return F.array_distinct(values)


def compared(value: Column, op: str, other) -> Column:  # noqa: ANN001
    """One of the fourteen comparisons; texts compare as they stand, empty means null or without characters."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    ops = {
        "=": lambda: value == other,
        "≠": lambda: value != other,
        ">": lambda: value > other,
        "≥": lambda: value >= other,
        "<": lambda: value < other,
        "≤": lambda: value <= other,
        "contains": lambda: F.contains(text, F.lit(other)),
        "not contains": lambda: ~F.contains(text, F.lit(other)),
        "start with": lambda: F.startswith(text, F.lit(other)),
        "end with": lambda: F.endswith(text, F.lit(other)),
        "empty": lambda: text == "",
        "not empty": lambda: text != "",
        "in": lambda: value.isin(other),
        "not in": lambda: ~value.isin(other),
    }
    if op not in ops:
        raise ValueError(f"unknown comparison: {op}")
    return ops[op]()


def filtered(values: Column, op: str, other) -> Column:  # noqa: ANN001
    return F.filter(values, lambda x: compared(x, op, other))


def all_or_any(conditions: list[Column], logic: str = "and") -> Column:
    """Conditions joined by and, or by or; no condition holds always."""
    out = None
    for c in conditions:
        c = F.coalesce(c, F.lit(False))
        out = c if out is None else (out & c if logic == "and" else out | c)
    return F.lit(True) if out is None else out


def metadata_filter(conditions: list[tuple[str, str, object]], logic: str = "and") -> Column:
    """A filter of (column, comparison, value) conditions."""
    return all_or_any([compared(F.col(k), op, v) for k, op, v in conditions], logic)


#: Names of the delimiters.
DELIMITERS = {"comma": ",", "line": "\n", "tab": "\t", "underline": "_", "slash": "/", "hyphen": "-"}


def merged(parts: list[Column], delimiter: str) -> Column:
    return F.concat_ws(DELIMITERS[delimiter], *parts)


def split(text: Column, delimiter: str) -> Column:
    return F.split(text, re.escape(DELIMITERS[delimiter]))


def assigned(old: Column, op: str, value: Column | None = None) -> Column:
    """The new value of a variable: overwrite, clear, +=, -=, *=, /= (null by zero), append, extend, remove_first, remove_last."""
    if op in ("overwrite", "set"):
        return value
    if op == "clear":
        return F.lit(None)
    if op == "append":
        return F.concat(old, F.array(value))
    if op == "extend":
        return F.concat(old, value)
    if op == "remove_first":
        return F.slice(old, F.lit(2), F.size(old))
    if op == "remove_last":
        return F.slice(old, F.lit(1), F.greatest(F.size(old) - 1, F.lit(0)))
    ops = {"+=": lambda: old + value, "-=": lambda: old - value, "*=": lambda: old * value, "/=": lambda: F.when(value != 0, old / value)}
    if op not in ops:
        raise ValueError(f"unknown assignment: {op}")
    return ops[op]()


# ---- objects are maps of strings
def selected(obj: Column, keys: list[str]) -> Column:
    return F.map_filter(obj, lambda k, v: k.isin(keys))


def removed(obj: Column, keys: list[str]) -> Column:
    return F.map_filter(obj, lambda k, v: ~k.isin(keys))


def renamed(obj: Column, names: dict[str, str]) -> Column:
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.transform_keys(obj, lambda k, v: F.coalesce(F.element_at(table, k), k))


def combined(a: Column, b: Column) -> Column:
    """Both objects; of equal keys the second's value."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def updated(obj: Column, key: str, value: Column) -> Column:
    return combined(obj, F.create_map(F.lit(key), value))


def value_filtered(obj: Column, op: str, other) -> Column:  # noqa: ANN001
    return F.map_filter(obj, lambda k, v: compared(v, op, other))


def literals(obj: Column) -> Column:
    """Values that read as numbers, as numbers; the others go."""
    return F.map_filter(F.transform_values(obj, lambda k, v: v.try_cast("double")), lambda k, v: v.isNotNull())
