"""Identifier codes in texts, as column expressions: display codes (ERR 02, NO CF, FULL CF) and codes such as E03 or AB-123.

Odd input: a null text holds no codes; a value that is no code normalises to null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.text import all_of

_FREE = r"(?<![A-Za-z0-9])(?:{})(?![A-Za-z0-9])"
_DISPLAY = r"(?:ERR[\s_-]*(?:[0-9]{1,3}|CF)|NO[\s_-]*CF|FULL[\s_-]*CF)"
_PLAIN = r"[A-Za-z]{1,3}[_-]?[0-9]{2,3}"
#: Letters, then digits, then anything of both or hyphens: what may be a model name (on lower-case text).
_MODEL = r"(?<![\p{L}\p{N}_])[a-z]+[0-9]+[a-z0-9-]*(?![\p{L}\p{N}_])"


def normalized_code(value: Column) -> Column:
    """The one form of a code: display codes as 'ERR nn', 'NO CF' or 'FULL CF', others without separator; null for no code."""
    raw = F.upper(F.btrim(value))
    joined = F.regexp_replace(raw, r"[\s_-]+", "")
    number = F.substring(joined, 4, 3)
    return (
        F.when(raw.rlike(r"^ERR[\s_-]*(?:[0-9]{1,3}|CF)$"), F.concat(F.lit("ERR "), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)))
        .when(raw.rlike(r"^NO[\s_-]*CF$"), "NO CF")
        .when(raw.rlike(r"^FULL[\s_-]*CF$"), "FULL CF")
        .when(raw.rlike(r"^[A-Z]{1,3}[_-]?[0-9]{2,3}$"), F.regexp_replace(raw, "[_-]", ""))
    )


def codes(text: Column) -> Column:
    """Distinct codes of a text in order of first occurrence, each in its one form."""
    return F.array_distinct(F.transform(all_of(text, "(?i)" + _FREE.format(f"{_DISPLAY}|{_PLAIN}")), normalized_code))


def display_codes(text: Column) -> Column:
    """Distinct display codes alone."""
    return F.array_distinct(F.transform(all_of(text, "(?i)" + _FREE.format(_DISPLAY)), normalized_code))


def has_display_code(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("(?i)" + _FREE.format(_DISPLAY))


def search_forms(text: Column) -> Column:
    """The spellings under which display codes are searched: spaced, joined, with an underscore."""
    spaced = F.filter(codes(text), lambda c: F.contains(c, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(spaced, lambda c: F.array(c, F.replace(c, F.lit(" "), F.lit("")), F.replace(c, F.lit(" "), F.lit("_"))))))


def other_codes(text: Column) -> Column:
    """Distinct model-like names (lower case) that are no codes of the forms above."""
    return F.array_distinct(F.filter(all_of(F.lower(text), _MODEL), lambda c: normalized_code(c).isNull()))


def exact_terms(text: Column) -> Column:
    """Everything that must match exactly: codes in their one form, and other model-like names."""
    # a code has a digit, or the letters CF: one look spares the other patterns
    some = F.coalesce(text, F.lit("")).rlike("[0-9]|[Cc][Ff]")
    return F.when(some, F.concat(codes(text), other_codes(text))).otherwise(F.array().cast("array<string>"))
