"""PII, pieces, packing, rules and fingerprints against plain Python."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brindle.llm import fingerprint, packing, pieces, pii, quality_rules
from brindle.llm.common import table
from brindle.llm.queries import tokenizer_path

ODD = [
    None,
    "",
    " ",
    "\n\n",
    "a",
    "x" * 70_000,
    "word " * 9_000,
    "a@b.c%d@e.f x@a.b-c.d@e.f .a@b..c a@b.c. user+tag@mail.example.com,",
    "1.2.3.4.5.6.7.8 256.1.1.1 999.9.9.9 01.002.3.4 1.1.1.1111",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 12345678901234567890123 0000 0000 0000",
    "card 4111 1111  1111 1111 +1 (555) 123-4567 +49 30 123456 +1 2 3 +123456789012345678 call +33.1.23.45.67.89",
    "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 not GB82WEST12345698765433",
    "ssn: 123-45-6789 tel (555) 123-4567 nothing 123-45-6789",
    "😀 a@b.co 😀😀 10.0.0.1 ünïcödé 4111111111111111",
    "the cat the cat the cat the cat\nthe cat the cat\n\nthe cat the cat\n \x0b x",
    "# * $ % & | < > a#b\tc\rd\x0ce f g",
    "<|endoftext|> hello<|startoftext|>world <|ENDOFTEXT|>",
    "don't I'M we'll  l'été  ½ ² ﬁ Ǆ İ ß ΑΣ",
    "日本語のテキスト 한국어 العربية हिन्दी ​ ﻿ \u0000 end",
    "tab\tand  many    spaces   ▁under▁score ▁▁",
]


@pytest.fixture(scope="module")
def docs(spark, sf):
    base = table(spark, sf, "documents").select("doc_id", "text")
    odd = spark.createDataFrame(list(enumerate(ODD, 1_000_000)) + [(1_000_004, "a"), (None, "no id +1 555 123 4567")], "doc_id long, text string")
    return base.unionByName(odd).coalesce(4).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r[0], r[1] or "") for r in docs.collect()]


def same(df, expected, columns):
    got = Counter(tuple(r[c] for c in columns) for r in df.collect())
    assert got == Counter(expected)


def luhn(digits):
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate((("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, kind, m.end()))
    return sorted(out)


def test_pii(docs, rows):
    expected = []
    for doc, text in rows:
        spans = base_spans(text)
        digest = hashlib.sha256(",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans).encode()).hexdigest()
        expected.append((doc, *(sum(k == n for _, n, _, _ in spans) for k in range(4)), digest))
    found = pii.pii_digest(docs)
    same(found, expected, ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"))
    spans = {r["doc_id"]: r["spans"] or "" for r in found.where("doc_id >= 1000000").collect()}
    assert spans[1_000_011].count("iban") == 2
    assert spans[1_000_012].count("ssn") == 1 and spans[1_000_012].count("local_phone") == 1


def test_redact_keeps_columns_and_hides_spans(spark):
    df = spark.createDataFrame([(1, "write a@b.co or 10.0.0.1.", "x"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, pii_spans string")
    assert [tuple(r) for r in pii.redact(df.drop("pii_spans")).orderBy("doc_id").collect()] == [(1, "write <EMAIL> or <IP>."), (2, None), (3, "")]
    assert pii.redact(df).columns == df.columns


def test_pii_is_native(docs, spark):
    plan = pii.pii_digest(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pieces(docs, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = [(doc, len(ids := sp.encode(text)), sha(",".join(map(str, ids))), sha(sp.decode(ids))) for doc, text in rows]
    same(pieces.piece_digest(docs, tokenizer_path("piece_bpe_32k.model")), expected, ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))


def test_encode_then_decode(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i long, text string")
    for r in pieces.decode_pieces(pieces.encode_pieces(df, path), path).collect():
        assert r["piece_ids"] == sp.encode(r["text"] or "")
        assert r["decoded"] == sp.decode(r["piece_ids"])


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    expected = []
    for doc, text in rows:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            expected.append((doc, k, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))))
    packed = packing.pack_documents(docs, path).cache()
    same(packed, expected, ("doc_id", "piece", "start", "length", "ids_crc32"))
    by = {}
    for r in packed.collect():
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(x[3] for x in expected)
    assert len(by) <= -(-total // 2048) * 1.06 + 2


def test_open_bins_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 8, 4, 2, 3)] == [(0, 0), (1, 0), (2, 0), (0, 6), (1, 7), (3, 0)]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_rules(docs, rows):
    expected = []
    for doc, text in rows:
        words = words_of(text)
        lines = [x for x in text.split("\n") if words_of(x)]
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
        expected.append((doc, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed))
    found = quality_rules.rules_digest(docs)
    same(found, expected, ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    assert found.where("base_failed and kept").isEmpty()
    slow = quality_rules.measure(docs, slow_from=3).select("doc_id", "q_repeat_words")
    same(slow, [(x[0], x[5]) for x in expected], ("doc_id", "q_repeat_words"))


def plain_fingerprint(text):
    """The definition, byte by byte, with whole numbers."""
    raw, base, m32, m64 = text.encode("utf-8", "surrogatepass"), 0x9E3779B97F4A7C15 | 1, (1 << 32) - 1, (1 << 64) - 1
    n, roll = len(raw), []
    if not n:
        return "3::"
    for i in range(n):
        window = [raw[i - k] if i >= k else 0 for k in range(7)]
        mixed = 0
        for k, b in enumerate(window):
            mixed ^= (b << 5 * k) & m32
        roll.append((sum(b * (8 - k) for k, b in enumerate(window)) + mixed) & m32)

    def letters(block):
        out, h, power = [], 0, 1
        for i in range(n):
            h, power = (h + (raw[i] + 1) * power) & m64, power * base & m64
            if roll[i] % block == block - 1 or i == n - 1:
                h ^= h >> 29
                out.append(fingerprint.LETTERS[(h * 0xBF58476D1CE4E5B9 & m64) >> 58])
                h, power = 0, 1
        return "".join(c for i, c in enumerate(out) if i < 3 or any(out[i - k] != c for k in (1, 2, 3)))

    block = 3
    while block * 64 < n:
        block *= 2
    while sum(r % block == block - 1 for r in roll) > 128:
        block *= 2
    return f"{block}:{letters(block)}:{letters(2 * block)}"


def plain_likeness(a, b):
    """By insertions and deletions of the signatures of one block size; no common run of four letters means not alike."""

    def alike(x, y):
        if not x or not y:
            return float(x == y)
        k = min(4, len(x), len(y))
        if not {x[i : i + k] for i in range(len(x) - k + 1)} & {y[i : i + k] for i in range(len(y) - k + 1)}:
            return 0.0
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                last, row[j] = row[j], last if c == d else 1 + min(row[j], row[j - 1])
        return 1 - row[-1] / (len(x) + len(y))

    if a == b:
        return 1.0
    (p, p1, p2), (q, q1, q2) = a.split(":"), b.split(":")
    if not p1 or not q1:
        return 0.0
    if p == q:
        return max(alike(p1, q1), alike(p2, q2))
    return alike(p2, q1) if int(p) * 2 == int(q) else alike(p1, q2) if int(q) * 2 == int(p) else 0.0


def test_fingerprints_by_definition(rows):
    texts = [t for _, t in rows if len(t) < 20_000][:60] + ["aaaa" * 300, "ab" * 700, "é漢" * 50]
    marks = [plain_fingerprint(t) for t in texts]
    assert [fingerprint.fingerprint(t) for t in texts] == marks
    edited = [t[: len(t) // 2] + t[len(t) // 2 + 5 :] for t in texts]
    for a, b in [*zip(marks, map(plain_fingerprint, edited), strict=True), *zip(marks, marks[1:], strict=False)]:
        assert abs(fingerprint.likeness(a, b) - plain_likeness(a, b)) < 1e-9, (a, b)


def test_fingerprints(docs, rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = {}
    for r in fingerprint.fingerprint_digest(docs).collect():
        got.setdefault((r["doc_id"], r["n_chars"]), []).append(r)
    for k, (doc, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        mark, other, after = (fingerprint.fingerprint(t) for t in (text, edited, following))
        want = (len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mark, other, fingerprint.likeness(mark, other), fingerprint.likeness(mark, after))
        assert want in [tuple(r)[1:] for r in got[(doc, len(text))]]
    assert sum(map(len, got.values())) == len(rows)


def test_fingerprint_follows_small_changes():
    a = " ".join(f"word{i * 7919 % 1009}" for i in range(900))
    b = a[:2000] + "INSERTED" + a[2000:]
    c = " ".join(f"other{i * 104729 % 1013}" for i in range(900))
    mark = fingerprint.fingerprint
    assert fingerprint.likeness(mark(a), mark(b)) > 0.8
    assert fingerprint.likeness(mark(a), mark(c)) < 0.3
    assert fingerprint.likeness(mark(a), mark(a)) == 1.0 and mark("") == "3::"


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    for df in (pii.pii_digest(empty), pieces.piece_digest(empty, tokenizer_path("piece_bpe_32k.model")), quality_rules.rules_digest(empty), fingerprint.fingerprint_digest(empty), packing.pack_documents(empty, tokenizer_path("word_bpe_49k.json"))):
        assert df.count() == 0 and "doc_id" in df.columns


def test_extra_columns_stay(spark):
    from brindle.llm import line_dedup, mil_quality, near_dedup

    names = ["q_words", "_t", "_w", "_lines", "pii_text", "pii_spans_", "pii_email_found", "_doc", "_text", "_kept", "line_doc", "quality_score", "stay", "h1", "rep"]
    df = spark.createDataFrame([(1, "write to a.b@c.de or call\nwrite to a.b@c.de or call", *names)], f"doc_id long, text string, {', '.join(f'{n} string' for n in names)}")
    same = [c for c in df.columns if c != "text"]
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for out in (pii.find_pii(df), pii.redact(df), line_dedup.dedup_lines(df), near_dedup.keep_one(df), mil_quality.keep_good(df, labels, 0.0)):
        row = out.first()
        assert [row[c] for c in same] == [1, *names] and out.columns[: len(df.columns)] == df.columns
    rated = quality_rules.rate(df)
    assert len(set(rated.columns)) == len(rated.columns) and rated.first()["q_words"] == 10 and rated.first()["_t"] == "_t"
    assert F is not None


PRIVATE = [("IBAN DE89370400440532013000 Bank", "iban:5:27"), ("DE89 3704 0044 0532 0130 00 Bitte", "iban:0:27"), ("ES91 2100 0418 4502 0005 1332 BANK OF", "iban:0:29"), ("DE89370400440532013001 Bank", ""), ("123-45-6789 is my SSN", "ssn:0:11"), ("123-45-6789 is a part", ""), ('x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y', "secret:2:51"), ("token = word word", ""), ("7536784127813050 4845168114407329 x", "card_group:17:33"), ("call 555-555-1234 me", "local_phone:5:17")]


def test_further_kinds(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(PRIVATE)], "doc_id long, text string")
    assert {r["doc_id"]: r["spans"] for r in pii.pii_digest(df).collect()} == {k: s for k, (_, s) in enumerate(PRIVATE)}


def test_packer_words_against_the_tokenizer():
    """Odd characters, contractions, special tokens, long words and window borders."""
    import random

    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tokenizer, mine = Tokenizer.from_file(path), packing.WordEncoder(path)
    r = random.Random(2)
    signs = "aB'sSreRE  \t\x1c\x85\xa0éÉİıßẞ1٣²½ªº“”’—\u0301<|>startoftext…¡¿漢字😀ſǅ\n.,#İ×"
    words = ["<|startoftext|>", "<|endoftext|>", "'S", "we'll", "I'VE", "don't", "É", "á", "x" * 70]
    texts = ["".join(r.choice(words) if r.random() < 0.1 else r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    for text, ids in zip(texts, mine.encode(texts), strict=True):
        assert ids == b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(text, add_special_tokens=False).ids), text
