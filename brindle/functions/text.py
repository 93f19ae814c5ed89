"""Text functions as column expressions; nothing leaves the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of two letters or more, after lower().
WORD = r"[a-z]{2,}"
#: Codes, words and numbers, after lower() (a run of letters is taken once, never given back); runs of ideographs; codes that must match exactly, after lower().
TOKEN = r"[a-z]++[0-9]++[a-z0-9-]*+|[a-z]{2,}+|[0-9]++(?:\.[0-9]++)?"
IDEOGRAPHS = r"[一-鿿]+"
EXACT = r"\b[a-z]+[0-9]+[a-z0-9-]*\b"
NUMBER = r"[0-9]+(?:\.[0-9]+)?"
URL = r"https?://[^\s\"'<>]+"


def all_of(text: Column, pattern: str) -> Column:
    """All matches of a pattern, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def words(text: Column) -> Column:
    """Distinct words of a text in order of first occurrence."""
    return F.array_distinct(all_of(F.lower(text), WORD))


def tokens(text: Column) -> Column:
    """Distinct codes, words, numbers, pairs of neighbouring ideographs, and whole runs of four ideographs or fewer."""
    runs = all_of(text, IDEOGRAPHS)
    pairs = F.flatten(F.transform(F.filter(runs, lambda r: F.length(r) > 1), lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    plain = all_of(F.lower(text), TOKEN)
    # most texts have no ideographs: one look tells
    some = F.coalesce(text, F.lit("")).rlike("[一-鿿]")
    return F.array_distinct(F.when(some, F.concat(plain, pairs, F.filter(runs, lambda r: F.length(r) <= 4))).otherwise(plain))


def exact_tokens(text: Column) -> Column:
    """Distinct tokens that are codes: letters with digits after them."""
    return F.array_distinct(all_of(F.lower(text), EXACT))


def normalized(text: Column) -> Column:
    """Lower case, runs of white space as one space, no outer space."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\r]+", " "))


def estimated_tokens(text: Column) -> Column:
    """Ideographs count one each, four other characters one together."""
    body = F.coalesce(text, F.lit(""))
    wide = F.length(F.regexp_replace(body, "[^一-鿿]", ""))
    return (wide + F.ceil((F.length(body) - wide) / 4)).cast("long")


#: Words of the manual profile that count as keywords.
MANUAL_WORDS = ["警告", "注意", "断电", "过滤器", "排水", "安装", "清洁"]


def keywords(text: Column, manual: bool = False, most: int = 20) -> Column:
    """Model-like names and numbers with units as they stand, then words of the manual profile; distinct, at most so many."""
    found = all_of(text, r"(?<![\p{L}\p{N}_])(?:[A-Za-z]+[0-9]+[A-Za-z0-9-]*|[0-9]+(?:\.[0-9]+)?(?:V|W|A|Hz|mm|cm)?)(?![\p{L}\p{N}_])")
    if manual:
        held = F.filter(F.array(*map(F.lit, MANUAL_WORDS)), lambda w: F.contains(F.coalesce(text, F.lit("")), w))
        found = F.concat(found, held)
    return F.slice(F.array_distinct(found), 1, most)


def any_term(text: Column, terms: list[str]) -> Column:
    """Whether one of the terms stands in the text (lower case)."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(re.escape(t) for t in terms))


def redaction(x: Column) -> Column:
    """What stands for a redacted identifier: ten digits of its checksum."""
    return F.concat(F.lit("[已脱敏:"), F.substring(F.sha2(x, 256), 1, 10), F.lit("]"))


def redacted(text: Column) -> Column:
    """Runs of eight digits or more become a token, in one pass: what stands before each run, then its token, then the rest."""
    body = F.coalesce(text, F.lit(""))
    long = all_of(body, "[0-9]{8,}")
    plain = F.split(body, "[0-9]{8,}")
    return F.array_join(F.transform(plain, lambda x, i: F.concat(x, F.coalesce(redaction(F.get(long, i)), F.lit("")))), "")


def exact_and_units(low: Column) -> Column:
    """Codes, and numbers with their units, of a text in lower case."""
    return all_of(low, r"[a-z]+[0-9]+[a-z0-9-]*|[0-9]+(?:\.[0-9]+)?(?:v|w|a|hz|mm|cm)?")


def pairs(text: Column) -> Column:
    """Pairs of neighbouring ideographs."""
    runs = all_of(text, "[一-鿿]{2,}")
    return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))


def search_tokens(text: Column) -> Column:
    """Distinct codes and numbers with units, words, and pairs of neighbouring ideographs. operators.segment adds a dictionary's words."""
    low = F.lower(text)
    return F.array_distinct(F.concat(exact_and_units(low), all_of(low, "[a-z0-9_]+"), pairs(low)))


def stem(name: Column) -> Column:
    """A file name's stem in lower case, letters and digits only; empty where there is none."""
    last = F.regexp_extract(F.coalesce(name, F.lit("")), "[^/]*$", 0)
    return F.regexp_replace(F.lower(F.regexp_replace(last, r"(.)\.[^.]+$", "$1")), "[^a-z0-9]+", "")


def lines(text: Column) -> Column:
    """Trimmed lines that are not blank."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")
    return F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(" \t\n\r\x0b\x0c"))), lambda x: x != "")


def table_pieces(text: Column) -> Column:
    """Each further line under the first one as its header; the text itself where there is one line or none."""
    # the lines are bound, so they are found once, not again for each piece
    found = F.transform(F.array(lines(text)), lambda rows: F.when(F.size(rows) > 1, F.transform(F.slice(rows, F.lit(2), F.size(rows)), lambda x: F.concat(F.element_at(rows, 1), F.lit("\n"), x))).otherwise(F.array(text)))
    return F.element_at(found, 1)


def question_pieces(text: Column) -> Column:
    """The text cut before each question mark of the form 'Q:' or '问：'; pieces are trimmed, blank ones go."""
    parts = F.split(text, r"(?i)(?=(?<![\p{L}\p{N}_])(?:Q|问)[:：])")
    return F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(" \t\n\r\x0b\x0c"))), lambda x: x != "")


def normal_answer(text: Column) -> Column:
    """Unix line ends, no outer blanks, no blanks at a line's end."""
    unix = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), F.lit(" \t\n\r\x0b\x0c"))
    return F.regexp_replace(unix, r"(?m)[ \t\x0b\x0c]+$", "")


#: Typographic signs and what stands for them in a submission.
TYPOGRAPHIC = {"\u00a0": " ", "“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", "—": "-", "…": "，", "·": "-", "•": "-", "≤": "<=", "≥": ">=", "℃": "C", "℉": "F"}


def submission(text: Column) -> Column:
    """Plain signs for typographic ones, no invisible characters, no blanks at a line's end, at most one blank line."""
    out = F.coalesce(text, F.lit(""))
    single = {a: b for a, b in TYPOGRAPHIC.items() if len(b) == 1}
    out = F.translate(out, "".join(single), "".join(single.values()))
    for a, b in TYPOGRAPHIC.items():
        if len(b) > 1:
            out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(out, r"[\u200b-\u200f\u202a-\u202e\ufeff]", "")
    out = F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return F.btrim(out, F.lit(" \t\n\r"))


def unescaped(text: Column) -> Column:
    r"""Runs of literal \uXXXX become the characters they stand for."""
    runs = F.array_distinct(all_of(text, r"(?:\\u[0-9a-fA-F]{4})+"))
    longest_first = F.array_sort(runs, lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(longest_first, F.coalesce(text, F.lit("")), lambda acc, r: F.replace(acc, r, F.decode(F.unhex(F.replace(r, F.lit("\\u"), F.lit(""))), "UTF-16BE")))


def repaired_question(text: Column) -> Column:
    """An exported question: escapes undone, joined quotes as line ends, each line without outer quotes, commas and blanks."""
    one = F.regexp_replace(F.regexp_replace(unescaped(text), r'"[ \t\n\r]*,[ \t\n\r]*\??[ \t\n\r]*"', "\n"), "\r\n?", "\n")

    def clean(x: Column) -> Column:
        x = F.btrim(F.btrim(x, F.lit(" \t")), F.lit('"“”'))
        return F.btrim(F.btrim(F.regexp_replace(x, r"[，,][ \t]*\?$", ""), F.lit(" ，,")), F.lit('"“”'))

    return F.array_join(F.filter(F.transform(F.split(one, "\n"), clean), lambda x: x != ""), "\n")


def without_urls(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)https?://[^ \t\n\r\"'，。！？；]+", ""))


def preview(text: Column, most: int = 36) -> Column:
    """The first characters of a text in one line."""
    return F.substring(F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \t\n\r]+", " ")), 1, most)


def within_budget(text: Column, budget: int) -> Column:
    """The longest start of a text whose estimated tokens are within the budget, without blanks at its end.

    One fold over the characters of what could fit at all; ideographs cost one token, four others cost one together.
    """
    head = F.substring(F.coalesce(text, F.lit("")), 1, 4 * budget)
    start = F.struct(F.lit(0).alias("wide"), F.lit(0).alias("narrow"), F.lit(0).alias("fits"))

    def step(acc: Column, c: Column) -> Column:
        wide = acc["wide"] + c.rlike("[一-鿿]").cast("int")
        narrow = acc["narrow"] + 1 - c.rlike("[一-鿿]").cast("int")
        return F.struct(wide.alias("wide"), narrow.alias("narrow"), F.when(wide + F.ceil(narrow / 4) <= budget, wide + narrow).otherwise(acc["fits"]).cast("int").alias("fits"))

    fits = F.aggregate(F.split(head, "(?s)(?!^)"), start, step, lambda acc: acc["fits"])
    return F.when(F.lit(budget <= 0) | (F.length(head) == 0), F.lit("")).otherwise(F.rtrim(F.substr(head, F.lit(1), fits), F.lit(" \t\n\r")))


def numbered_steps(text: Column) -> Column:
    """What follows each of the markers '1.', '2、', ... at a line's or sentence's start; none where there are under two."""
    marker = r"(?:^|[\n。；;])[ \t\n]*(?:步骤[ \t\n]*)?[0-9]+[.、:：][ \t\n]*"
    found = all_of(text, marker)
    parts = F.split(F.coalesce(text, F.lit("")), marker)
    steps = F.filter(F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: F.btrim(x, F.lit(" \n。；;，,"))), lambda x: x != "")
    return F.when(F.size(found) >= 2, steps).otherwise(F.array().cast("array<string>"))


def safe_component(value: Column, most: int = 120) -> Column:
    """A path component of a name: unsafe characters as underscores, bounded length, with twelve digits of its checksum."""
    plain = F.regexp_replace(F.coalesce(value, F.lit("")), r"[^A-Za-z0-9._-]+", "_")
    return F.concat(F.substring(F.btrim(plain, F.lit("._")), 1, most - 13), F.lit("-"), F.substring(F.sha2(F.coalesce(value, F.lit("")), 256), 1, 12))


def json_object(text: Column) -> Column:
    """What stands from the first opening to the last closing brace; null where there is none."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def joined_parts(parts: list[Column], most: int = 1200, by: str = "\n") -> Column:
    """Distinct parts that are not blank, trimmed, in order, in one string of bounded length."""
    kept = F.array_distinct(F.filter(F.transform(F.array(*parts), lambda x: F.btrim(x)), lambda x: x.isNotNull() & (x != "")))
    return F.substring(F.array_join(kept, by), 1, most)


def string_list(values: Column) -> Column:
    """Trimmed, distinct, not empty strings of a list, in order; an empty list for null."""
    return F.coalesce(F.array_distinct(F.filter(F.transform(values, lambda x: F.btrim(x)), lambda x: x.isNotNull() & (x != ""))), F.array().cast("array<string>"))


def lines_before(text: Column, marker: str) -> Column:
    """The lines of a text before the first line that begins with the marker."""
    rows = F.split(F.coalesce(text, F.lit("")), "\n")
    at = F.aggregate(rows, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda acc, x: F.struct((acc["n"] + (acc["go"] & ~F.startswith(x, F.lit(marker))).cast("int")).alias("n"), (acc["go"] & ~F.startswith(x, F.lit(marker))).alias("go")), lambda acc: acc["n"])
    return F.btrim(F.array_join(F.slice(rows, F.lit(1), at), "\n"), F.lit(" \t\n\r"))


def citations(text: Column) -> Column:
    """Numbers of citations of the form [ID:n], Arabic-Indic digits included, in order."""
    plain = F.translate(F.coalesce(text, F.lit("")), "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
    return F.transform(F.regexp_extract_all(plain, F.lit(r"\[ID:[ ]*([0-9]+)\]"), F.lit(1)), lambda x: x.cast("int"))


def locator(first: Column, last: Column, imported: Column) -> Column:
    """Where evidence stands: imported section n, page n, or pages n-m."""
    page = F.when(first == last, F.format_string("第 %d 页", first)).otherwise(F.format_string("第 %d-%d 页", first, last))
    return F.when(imported, F.format_string("导入章节 %d", first)).otherwise(page)


#: Labels before an identifier, and an identifier: four characters or more with a digit (fixed values).
_LABELLED = r"(?i)(订单(?:号|编号|标识)?|设备序列号|序列号|serial(?:[ \t\n]+number)?|s[ \t\n]*/[ \t\n]*n|sn)([ \t\n]*[:：#]?[ \t\n]*)((?=[A-Za-z0-9._/-]{4,})(?=[A-Za-z0-9._/-]*[0-9])[A-Za-z0-9][A-Za-z0-9._/-]{3,})"


def identifiers(text: Column) -> Column:
    """Distinct identifiers that stand after a label."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_LABELLED), F.lit(3)))


def redacted_record(text: Column, known: Column, most: int = 1000) -> Column:
    """A text without identifiers: known ones (of the whole record), labelled ones and runs of eight digits or more become
    a token with ten digits of their checksum; the result is cut to a length."""
    all_known = F.array_union(known, identifiers(text))
    longest_first = F.array_sort(all_known, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    out = F.aggregate(longest_first, F.coalesce(text, F.lit("")), lambda acc, x: F.replace(acc, x, redaction(x)))
    long = F.array_distinct(all_of(out, "(?<![0-9])[0-9]{8,}(?![0-9])"))
    out = F.aggregate(F.array_sort(long, lambda a, b: F.length(b) - F.length(a)), out, lambda acc, x: F.replace(acc, x, redaction(x)))
    return F.substring(out, 1, most)
