"""DuckDB SQL for the numbered queries that SQL can express. The others are tested against brute force in tests/llm."""

from __future__ import annotations

from brindle.llm.centroids import DIMENSIONS, ROUNDS, SEED, STEPS, K
from brindle.llm.quality_rules import STOP_WORDS, THRESHOLDS
from brindle.llm.ranked import TOP


def _rules() -> str:
    """The counts of op7 and its verdict, from the same table of thresholds."""
    stops = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted({w for s in STOP_WORDS for w in (s, s.capitalize())}))
    over = lambda a, b: f"case when {b} > 0 then {a} / {b}::double else 0 end"
    measures = {
        "q_words": "n_words",
        "q_mean_word_chars": over("word_chars", "n_words"),
        "q_symbol_ratio": over("n_symbols", "word_chars"),
        "q_dup_line_ratio": over("n_dup_lines", "n_lines"),
        "q_repeat_ratio": over("n_repeat_words", "n_words"),
        "q_stop_ratio": over("n_stops", "n_words"),
        "q_line_chars": over("word_chars", "n_lines"),
    }
    tests = [f"{measures[m]} >= {least}" for m, (least, _) in THRESHOLDS.items() if least is not None]
    tests += [f"{measures[m]} <= {most}" for m, (_, most) in THRESHOLDS.items() if most is not None]
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from d),
g as (select r, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from w, unnest(range(1, len(w) - 1)) as u(i)),
t as (select r, i, count(*) over (partition by r, a, b, c) as n from g),
p as (select r, count(distinct i + k)::bigint as n_repeat_words from t, (values (0), (1), (2)) as v(k) where n >= 2 group by r),
m as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, len(l)::bigint as n_lines,
 (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, len(list_filter(w, lambda x: x in ({stops})))::bigint as n_stops from w left join p using (r)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {' and '.join(tests)} as kept, round({measures['q_stop_ratio']}, 6) as stop_ratio from f"""


def _centroids() -> str:
    """Plain rounds of op13, one after another: every vector against every centroid."""
    steps = [
        f"v0 as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({STEPS} * x::double)::bigint) as v from embeddings"
        f" where len(embedding) = {DIMENSIONS} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIMENSIONS})",
        f"h as (select v, row_number() over (order by sha256('{SEED}:' || coalesce(vec_id::varchar, '')), v) - 1 as c from v0)",
        f"c0 as materialized (select c, v as w from h where c < {K})",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"p{k} as (select r, c, list_sum(list_transform(range(1, {DIMENSIONS + 1}), lambda i: (v[i] - w[i]) * (v[i] - w[i])))::bigint as d from v0, c{k})")
        steps.append(f"a{k} as materialized (select r, arg_min(c, (d, c)) as c, min(d) as d from p{k} group by r)")
        if k < ROUNDS:
            steps.append(f"u{k} as (select c, i, sum(v[i])::bigint as s, count(*) as n from a{k} join v0 using (r), unnest(range(1, {DIMENSIONS + 1})) as t(i) group by c, i)")
            steps.append(f"m{k} as (select c, list((s - (((s % n) + n) % n)) // n order by i) as w from u{k} group by c)")
            steps.append(f"c{k + 1} as materialized (select c, coalesce(m{k}.w, c{k}.w) as w from c{k} left join m{k} using (c))")
    return f"""with {", ".join(steps)}
select vec_id, c::int as cluster, d as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
 sha256(list_aggregate(list_transform(w, lambda x: x::bigint::varchar), 'string_agg', ',')) as centroid_sha256
from a{ROUNDS} join v0 using (r) join c{ROUNDS} using (c)"""


def _warc() -> str:
    """The records of op11: digests in base 32, and the largest page_id of each payload."""
    half = "['" + "', '".join(f"{k:04b}" for k in range(16)) + "']"
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    five = lambda i: "+".join(f"{1 << (4 - k)} * substr(bits, 5 * {i} + {k + 1}, 1)::int" for k in range(5))
    return f"""
with p as (select row_number() over (order by page_id, url) as r, page_id, coalesce(html, '') as html from pages),
b as (select *, list_aggregate(list_transform(range(1, 41), lambda i: ({half})[strpos('0123456789abcdef', substr(sha1(html), i::int, 1))]), 'string_agg', '') as bits from p),
d as (select r, page_id, strlen(html)::bigint as payload_bytes, {" || ".join(f"substr('{alphabet}', 1 + {five(i)}, 1)" for i in range(32))} as payload_digest from b),
h as (select *, row_number() over (partition by payload_digest order by page_id desc nulls last, r desc) as k, first_value(page_id) over (partition by payload_digest order by page_id desc nulls last, r desc) as head from d)
select page_id, payload_bytes, payload_digest, case when k = 1 then 'response' else 'revisit' end as record_type, case when k > 1 then head end as refers_to from h"""


def _ranked() -> str:
    """Scores of op12 for every document and item."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    terms = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    return f"""
with t as (select row_number() over () as r, doc_id, {terms} as w from documents),
d as (select r, doc_id, len(w)::bigint as n from t where len(w) > 0),
s as (select count(*)::bigint as nn, sum(n)::bigint as ll from d),
f as (select r, term, count(*)::bigint as tf from (select r, unnest(w) as term from t) group by r, term),
x as (select term, floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)::double))::bigint as weight from f, s group by term, nn),
q as (select distinct item_id, term from (select item_id, unnest({terms}) as term from benchmark)),
g as (select item_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::bigint as score from q join x using (term) join f using (term) join d using (r), s group by item_id, r),
k as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from g join d using (r) where score > 0)
select item_id, rank::int as rank, doc_id, score from k where rank <= {TOP}"""


def oracle_sql() -> dict[str, str]:
    return {"op7_rules": _rules(), "op11_warc": _warc(), "op12_ranked": _ranked(), "op13_centroids": _centroids()}
