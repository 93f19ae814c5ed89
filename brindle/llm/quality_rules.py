"""Quality rules: a table of thresholds compiled into one projection. Built-in functions only.

Rules for odd input: a null text counts as empty and fails (fewer than 50 words); repeated rows each get their own
verdict; an empty table gives an empty result; other columns are kept by rate(), except that columns named like its own (MEASURES) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import SPACE_CHARS, SPACE_CLASS, whole_text

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the and of to in is that for it with as was on be are this by or at from "
    "le la les de des du et un une en que qui est dans pour pas sur au aux avec "
    "der die das und ist nicht von zu den mit ein eine auf für im sich auch dem "
    "el los las del y por con se su para como más al o no una es"
).split()
#: measure -> (least, most): a text outside any of these ranges is rejected.
THRESHOLDS: dict[str, tuple[float | None, float | None]] = {
    "q_words": (50, None),
    "q_mean_word_chars": (2.0, 14.0),
    "q_symbol_ratio": (None, 0.3),
    "q_dup_line_ratio": (None, 0.5),
    "q_repeat_ratio": (None, 0.5),
    "q_stop_ratio": (0.01, None),
    "q_line_chars": (None, 100000.0),
}
#: Columns that measure() and rate() add; input columns so named are replaced.
MEASURES = {"q_words", "q_word_chars", "q_symbols", "q_lines", "q_dup_lines", "q_repeat_words", "q_stops", "q_mean_word_chars", "q_symbol_ratio", "q_dup_line_ratio", "q_repeat_ratio", "q_stop_ratio", "q_line_chars", "q_kept"}
#: The lower bits of a sort key hold a word's place, the upper ones a hash of three words.
PLACE_BITS = 22


def _repeats(slow_from: int) -> Column:
    """How many words stand in a three-word window that occurs twice or more.

    Windows become 64-bit keys (hash above, place below), sorted; equal neighbours are compared word by word. Should two
    different windows share a hash, or a text be too long for the places, the row is done by sorting the words themselves.
    Each intermediate array is bound once, as the variable of a lambda over a one-element array: the optimizer may put an
    expression in the place of a column's name, and inside a lambda that would be computed for every element.
    """
    let = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    at = lambda i: f"cast(s[{i}] & {(1 << PLACE_BITS) - 1} as int)"
    same = " and ".join(f"w[{at('i')} + {k}] = w[{at('i - 1')} + {k}]" for k in range(3))
    places = ", ".join(f"{at(i)} + {k}" for i in ("i", "i - 1") for k in range(3))
    all_of = lambda array: f"cast(size(array_distinct(flatten({array}))) as long)"
    near = "l[i].a = l[i - 1].a and l[i].b = l[i - 1].b and l[i].c = l[i - 1].c"
    by_words = let(
        "l",
        "array_sort(transform(sequence(0, size(w) - 3), i -> struct(w[i] as a, w[i + 1] as b, w[i + 2] as c, i as i)))",
        all_of(f"transform(filter(sequence(1, greatest(1, size(l) - 1)), i -> i < size(l) and {near}), i -> array(l[i].i, l[i].i + 1, l[i].i + 2, l[i - 1].i, l[i - 1].i + 1, l[i - 1].i + 2))"),
    )
    by_keys = let(
        "s",
        f"sort_array(transform(sequence(0, size(w) - 3), i -> shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), {PLACE_BITS}) | i))",
        let(
            "d",
            f"filter(sequence(1, greatest(1, size(s) - 1)), i -> i < size(s) and shiftright(s[i], {PLACE_BITS}) = shiftright(s[i - 1], {PLACE_BITS}))",
            f"case when size(d) = 0 then 0L when exists(d, i -> not ({same})) then {by_words} else {all_of(f'transform(d, i -> array({places}))')} end",
        ),
    )
    return F.expr(let("w", "_w", f"case when size(w) < 3 then 0L when size(w) >= {slow_from} then {by_words} else {by_keys} end"))


def measure(df: DataFrame, text: str = "text", slow_from: int = 1 << PLACE_BITS) -> DataFrame:
    """Adds the q_ measures of each whole text; no shuffle, no Python. slow_from: words from which the long way is taken."""
    names = [f"in_{k}" for k in range(len(df.columns))]  # so that no column clashes with those made here
    body = F.col("_t")
    stops = sorted({w for s in STOP_WORDS for w in (s, s.capitalize())})
    out = (
        df.toDF(*names)
        .withColumn("_t", whole_text(names[df.columns.index(text)]))
        .withColumn("_trim", F.btrim(body, F.lit(SPACE_CHARS)))
        .withColumn("_w", F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", SPACE_CLASS + "+")))
        .withColumn("_lines", F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
        .withColumn("q_words", F.size("_w").cast("long"))
    )
    out = (
        out.withColumn("q_repeat_words", _repeats(slow_from))
        .withColumn("q_word_chars", F.length(F.concat_ws("", F.col("_w"))).cast("long"))
        .withColumn("q_symbols", (F.length(body) - F.length(F.regexp_replace(body, r"[#*$%&|<>]+", ""))).cast("long"))
        .withColumn("q_lines", F.size("_lines").cast("long"))
        .withColumn("q_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("q_stops", F.size(F.filter("_w", lambda x: x.isin(*stops))).cast("long"))
    )
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.select(
        *(F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True) if c.lower() not in MEASURES),
        *(F.col(c) for c in ("q_words", "q_word_chars", "q_symbols", "q_lines", "q_dup_lines", "q_repeat_words", "q_stops")),
        over("q_word_chars", "q_words").alias("q_mean_word_chars"),
        over("q_symbols", "q_word_chars").alias("q_symbol_ratio"),
        over("q_dup_lines", "q_lines").alias("q_dup_line_ratio"),
        over("q_repeat_words", "q_words").alias("q_repeat_ratio"),
        over("q_stops", "q_words").alias("q_stop_ratio"),
        over("q_word_chars", "q_lines").alias("q_line_chars"),
    )


def verdict(thresholds: dict[str, tuple[float | None, float | None]] = THRESHOLDS) -> Column:
    """The table of thresholds as one boolean expression over the measures."""
    ok = F.lit(True)
    for name, (least, most) in thresholds.items():
        if least is not None:
            ok = ok & (F.col(name) >= least)
        if most is not None:
            ok = ok & (F.col(name) <= most)
    return ok


def rate(df: DataFrame, text: str = "text", thresholds: dict[str, tuple[float | None, float | None]] = THRESHOLDS) -> DataFrame:
    """Adds the measures and q_kept, whether the text passes every threshold."""
    return measure(df, text).withColumn("q_kept", verdict(thresholds))


def rules_digest(df: DataFrame) -> DataFrame:
    """doc_id, the base counts, whether the base rules fail, and the verdict. Null doc_ids and repeated rows each get a row."""
    failed = (F.col("q_words") < 50) | (100 * F.col("q_repeat_words") > 50 * F.col("q_words"))
    return rate(df.select("doc_id", "text")).select(
        "doc_id",
        F.col("q_words").alias("n_words"),
        F.col("q_word_chars").alias("word_chars"),
        F.col("q_symbols").alias("n_symbols"),
        F.col("q_dup_lines").alias("n_dup_lines"),
        F.col("q_repeat_words").alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & F.col("q_kept")).alias("kept"),
        F.round("q_stop_ratio", 6).alias("stop_ratio"),
    )
