"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score. Built-in functions only.

Rules for odd input: a null or empty text has no spans; spans of different kinds may overlap, spans of one kind never do;
repeated rows each get their own result; an empty table gives an empty result; all other columns are kept, but for a
column named like the result, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import spare, whole_text

#: kind -> (pattern, context words, score without context). Patterns with look-behind start a match only where a run starts,
#: which gives the leftmost matches of the plain pattern without trying each start in a run.
KINDS: dict[str, tuple[str, str, float]] = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "mail|contact|write", 0.7),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "ip|host|server|address|login", 0.6),
    "card": (r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])", "card|visa|master|credit|karte|carte|tarjeta", 0.6),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "phone|tel|call|mobile|fax", 0.6),
    # groups of four, or no spaces; the check finds where it ends
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", "iban|account|bank|konto|compte|cuenta", 0.6),
    "ssn": (r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "ssn|social security", 0.3),
    "local_phone": (r"(?<![0-9+(])(?<![0-9+)][ .(-])\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4}(?![0-9-])", "phone|tel|call|mobile|fax", 0.3),
    # a card beside other numbers, which the base pattern takes for one longer number
    "card_group": (r"(?<![0-9])(?:(?<=[0-9] )|(?=[0-9]{16} [0-9]))[3-6][0-9]{15}(?![0-9])", "card|visa|master|credit|karte|carte|tarjeta", 0.5),
    # a key word, = or :, and a long value of letters and digits
    "secret": (r"(?i)(?<![A-Za-z0-9])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\x22']?\s{0,3}[=:]\s{0,3}[\x22']?[A-Za-z0-9+/_=-]{16,256}+", "key|login|auth", 0.6),
}
#: The kinds whose every checked match counts, whatever stands near it.
BASE = ("email", "ip", "card", "phone")
#: A span counts from this score on; a context word within this many characters before or after a span adds to its score.
LEAST_SCORE, CONTEXT_CHARS, CONTEXT_SCORE = 0.5, 40, 0.25

_SPAN = "array<struct<start:int,end:int,kind:int,name:string,score:double>>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _mod97(c: Column) -> Column:
    """True if an IBAN's remainder is right: its first four characters go last, letters count from 10."""
    plain = F.regexp_replace(c, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    rest = F.aggregate(
        F.filter(F.split(turned, ""), lambda x: x != ""),
        F.lit(0),
        lambda acc, x: F.when(x.rlike("[0-9]"), (acc * 10 + F.ascii(x) - 48) % 97).otherwise((acc * 100 + F.ascii(x) - 55) % 97).cast("int"),
    )
    return F.length(plain).between(15, 34) & (rest == 1)


def _valid(kind: str, m: Column) -> Column:
    """Whether a match of the kind passes its checksum or its limits."""
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "card_group":
        return F.call_function("luhn_check", m)
    if kind == "iban":
        return m != ""
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]{4}")
    return F.lit(True)


def _ended(x: Column) -> Column:
    """An IBAN's match cut to its longest part of whole groups whose remainder is right; empty where there is none."""
    groups = F.split(x["m"], " ")
    parts = F.transform(F.sequence(F.size(groups), F.lit(1)), lambda n: F.array_join(F.slice(groups, F.lit(1), n), " "))
    best = F.coalesce(F.get(F.filter(parts, _mod97), F.lit(0)), F.lit(""))
    return F.struct(x["start"].alias("start"), (x["start"] + F.length(best)).alias("end"), best.alias("m"))


def _placed(text: Column, pattern: str, found: Column) -> Column:
    """Start, end and string of each match: the text between two matches gives the distance from one to the next."""
    none = F.array().cast("array<struct<start:int,end:int,m:string>>")
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    steps = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("n"), m.alias("m")))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        row = F.struct(start.alias("start"), (start + x["n"]).alias("end"), x["m"].alias("m"))
        return F.struct((start + x["n"]).alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    placed = F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda acc: acc["out"])
    return F.when(F.size(found) > 0, placed).otherwise(none)


def _checked(k: int, kind: str, body: Column, column: str) -> Column:
    """The spans of one kind that pass its check and score enough."""
    pattern, words, score = KINDS[kind]

    def scored(x: Column) -> Column:
        at = F.greatest(x["start"] - CONTEXT_CHARS, F.lit(0))
        near = F.lower(F.concat_ws(" ", F.substr(body, at + 1, x["start"] - at), F.substr(body, x["end"] + 1, F.lit(CONTEXT_CHARS))))
        value = F.lit(score) + F.when(near.rlike(rf"\b(?:{words})"), CONTEXT_SCORE).otherwise(0.0)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(k).alias("kind"), F.lit(kind).alias("name"), value.alias("score"))

    found = _placed(body, pattern, F.col(column))
    placed = F.filter(F.transform(found, _ended) if kind == "iban" else found, lambda x: _valid(kind, x["m"]))
    return F.filter(F.transform(placed, scored), lambda x: x["score"] >= LEAST_SCORE).cast(_SPAN)


def find_pii(df: DataFrame, text: str = "text", spans_name: str = "pii_spans") -> DataFrame:
    """Adds pii_spans (or replaces a column so named): array of (start, end, kind number, name, score), by start and kind.

    Positions count code points, ends are exclusive. Every row is one narrow projection: no shuffle, no Python.
    """
    kept = [c for c in df.columns if c != spans_name]
    body_name, all_name = spare(df, "pii_text"), spare(df, "pii_all")
    names = {kind: spare(df, f"pii_{kind}_found") for kind in KINDS}
    out, body = df.withColumn(body_name, whole_text(f"`{text}`")), F.col(body_name)
    for kind, (pattern, _, _) in KINDS.items():
        out = out.withColumn(names[kind], F.regexp_extract_all(body, F.lit(pattern), F.lit(0)))
    for k, kind in enumerate(KINDS):
        out = out.withColumn(names[kind], _checked(k, kind, body, names[kind]))
    spans = F.sort_array(F.concat(*(F.col(n) for n in names.values())))
    # sort_array compares the structs field by field: start first; kinds at one start must go by kind, not by end
    by_kind = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).when(a["kind"] != b["kind"], F.when(a["kind"] < b["kind"], -1).otherwise(1)).otherwise(0))
    all_spans = F.when(F.size(spans) > 1, by_kind).otherwise(spans)
    return out.withColumn(all_name, all_spans).select(*(F.col(f"`{c}`") for c in kept), F.col(all_name).alias(spans_name))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _count(kind: int) -> Column:
    return F.size(F.filter(F.col("base"), lambda x: x["kind"] == kind)).cast("long")


def pii_digest(df: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, digest of the base spans, all spans as text, and their number.

    A null text is empty; repeated rows each get a row; a null doc_id stays null.
    """
    found = find_pii(df.select("doc_id", "text"))
    base = F.filter(F.col("pii_spans"), lambda x: x["kind"] < len(BASE))
    return found.withColumn("base", base).select(
        "doc_id",
        *(_count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("pii_spans")).alias("spans"),
        F.size("pii_spans").cast("long").alias("n_spans"),
    )


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """The same columns with each span of the text replaced by its kind in angle brackets.

    Overlapping spans: the one that starts first (then the first kind) is replaced, and what starts inside it goes with
    it. A null text stays null.
    """
    body = F.col(f"`{text}`")

    def step(acc: Column, x: Column) -> Column:
        put = F.concat(acc["out"], F.array(F.substr(body, acc["at"] + 1, x["start"] - acc["at"]), F.concat(F.lit("<"), F.upper(x["name"]), F.lit(">"))))
        inside = x["start"] < acc["at"]
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(put).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    name = spare(df, "pii_spans")
    found = find_pii(df, text, name)
    done = F.aggregate(F.col(name), start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(body, acc["at"] + 1)))
    return found.withColumn(text, F.when(F.size(name) > 0, done).otherwise(body)).select(*(F.col(f"`{c}`") for c in df.columns))
