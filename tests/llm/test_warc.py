"""WARC archives against plain Python: records, verdicts, rolled files, equal bytes, torn writes."""

import base64
import gzip
import hashlib
import json
import uuid
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from brindle.llm import warc

PAGES = "page_id long, url string, html string"


def folder(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


def plain(rows, least=0):
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as a bag."""
    groups, out = defaultdict(list), []
    for page_id, url, html in rows:
        groups[(html or "").encode()].append((page_id is not None, page_id or 0, url is not None, url or "", page_id))
    for data, mine in groups.items():
        mine.sort(reverse=True)
        for k, row in enumerate(mine):
            other = k > 0 and len(data) >= least
            out.append((row[4], len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if other else "response", mine[0][4] if other else None))
    return Counter(out)


def read(spark, path):
    return warc.read_warc(spark, path).collect()


def digest(rows):
    return Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows)


def made(n=150):
    text = lambda k: f"<p>{'é' * k} {k}</p>" * (1 + k % 40)
    rows = [(k, f"http://h{k % 7}.example.com/{k}?a=b c\r\nX: y", text(k // 3 if k % 2 else k)) for k in range(n)]
    rows += [(1000, "u", None), (1001, "u", ""), (None, "u", text(3)), (None, None, text(4)), (1002, None, text(4)), (7, "again", text(5)), (7, "again", text(5)), (8, "alone", "once"), (8, "alone", "once")]
    return [*rows, *[(5000, "http://hot.example.com/", "the same")] * 200, (-(1 << 63), "least", "x"), ((1 << 63) - 1, "most", "x"), (9, "ﷺ", "\x00\r\n\r\nWARC/1.1\r\n")]


def test_records(spark, tmp_path):
    rows, path = made(), folder(tmp_path)
    frame = spark.createDataFrame([(*r, "x", 1, True) for r in rows], PAGES + ", digest string, copies long, note boolean").repartition(5)
    warc.write_warc(frame, path, shard_bytes=20_000, file_bytes=1500)
    got = read(spark, path)
    assert digest(got) == plain(rows)
    ids = {r["record_id"]: r for r in got}
    assert len(ids) == len(got) == len(rows)
    payloads = Counter((r["page_id"], r["payload"].decode()) for r in got if r["record_type"] == "response")
    assert all(n == 1 for n in payloads.values()) and {p for _, p in payloads} == {h or "" for _, _, h in rows}
    for r in got:
        if r["record_type"] == "revisit":
            first = ids[r["refers_to_record"]]
            assert r["payload"] is None and first["record_type"] == "response" and (first["page_id"], first["payload_digest"]) == (r["refers_to"], r["payload_digest"])
    files = json.loads((Path(path[7:]) / warc.MANIFEST).read_text())["files"]
    assert len({r["archive"] for r in got}) == len(files) > 3 and sum(f["records"] for f in files) == len(rows)
    assert sorted(p.name for p in Path(path[7:]).iterdir()) == sorted([f["name"] for f in files] + [warc.MANIFEST])
    assert any(f["name"].endswith("-0001.warc.gz") for f in files)
    order = [(r["archive"], r["offset"]) for r in sorted(got, key=lambda r: (r["page_id"] is not None, r["page_id"] or 0))]
    assert [a for a, _ in order] == sorted(a for a, _ in order)


def test_any_gzip_reader_reads_the_files(spark, tmp_path):
    path = folder(tmp_path)
    warc.write_warc(spark.createDataFrame([(1, "http://a/", "<p>é</p>"), (2, "http://b/", "<p>é</p>")], PAGES), path)
    (file,) = Path(path[7:]).glob("*.warc.gz")
    text = gzip.decompress(file.read_bytes()).decode()
    assert text.count("WARC/1.1\r\n") == 3 and "WARC-Type: revisit\r\n" in text and "WARC-Refers-To-Target-URI: http://b/\r\n" in text and text.count("<p>é</p>") == 1


def test_equal_rows_give_equal_files(spark, tmp_path):
    rows, sums = made(60), []
    for parts in (1, 7):
        path = folder(tmp_path)
        warc.write_warc(spark.createDataFrame(rows if parts == 1 else rows[::-1], PAGES).repartition(parts), path, shard_bytes=20_000, file_bytes=1500)
        sums.append({p.name: hashlib.sha1(p.read_bytes()).hexdigest() for p in Path(path[7:]).iterdir()})
    assert sums[0] == sums[1] and len(sums[0]) > 3


def test_small_payloads_may_stay_responses(spark, tmp_path):
    rows, path = made(60), folder(tmp_path)
    warc.write_warc(spark.createDataFrame(rows, PAGES), path, revisit_from=20)
    assert digest(read(spark, path)) == plain(rows, 20)


def test_torn_writes_show_nothing(spark, tmp_path):
    path = folder(tmp_path)
    Path(path[7:]).mkdir()
    (Path(path[7:]) / "_part-000000-0000.warc.gz.lost").write_bytes(b"left by a lost task")
    with pytest.raises(Exception, match="no manifest"):
        read(spark, path)
    warc.write_warc(spark.createDataFrame([(k, "u", f"page {k}") for k in range(20)], PAGES), path)
    assert len(read(spark, path)) == 20 and not list(Path(path[7:]).glob("_*"))
    with pytest.raises(Exception, match="there is a manifest"):
        warc.write_warc(spark.createDataFrame([(1, "u", "x")], PAGES), path)
    (file,) = Path(path[7:]).glob("*.warc.gz")
    whole = file.read_bytes()
    file.write_bytes(whole[:-30])
    with pytest.raises(Exception, match="size that the manifest states"):
        read(spark, path)
    assert len(list(warc.members(__import__("io").BytesIO(whole)))) == 21
    with pytest.raises(ValueError, match="inside a record"):
        list(warc.members(__import__("io").BytesIO(whole[:-30])))


def test_empty_table(spark, tmp_path):
    path = folder(tmp_path)
    warc.write_warc(spark.createDataFrame([], PAGES), path)
    assert read(spark, path) == []
    assert warc.warc_digest(spark.createDataFrame([], PAGES)).count() == 0


def test_very_long_page(spark, tmp_path):
    path, html = folder(tmp_path), "<p>long</p>" * 1_000_000
    warc.write_warc(spark.createDataFrame([(1, "u", html), (2, "u", "short")], PAGES), path)
    assert {r["page_id"]: r["payload"].decode() for r in read(spark, path)} == {1: html, 2: "short"}
