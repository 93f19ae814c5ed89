"""WARC: a deterministic sharded writer and a reader, as a Spark data source.

Plan: digests of all payloads are grouped on rows without html; of records with equal payloads the one with the largest page_id
(then url) is the response and the others revisit it. Records are ordered by page_id, url and digest, and a running sum over that
order cuts them into shards of about SHARD_BYTES. So a record's shard depends on the rows alone, not on Spark's partitions.

Write: html is shuffled once, to its shard, where the verdicts on shared payloads meet it in the sort order. A task writes its
shard record by record (each a gzip member of its own), makes headers and digests anew from the payload, and starts another file
when the compressed size passes FILE_BYTES. Files have temporary names until all tasks are done; then the driver renames them
and puts a manifest beside them, by a rename too. A reader sees the manifest's files only, so a torn write shows nothing, and
files left by lost or repeated tasks are removed with the commit. Equal tables give equal files, byte by byte.

Read: a file is a task; every record's digests are computed again and compared with its headers.

Rules for odd input: a null html is an empty payload; a null url is written as about:blank, and blanks, control characters and
non-ASCII of a url as percent codes; a null page_id has no header, is null again when read, and comes before all others;
each repeated row gets a record, the first of them the response; an empty table gives a manifest without files; other columns
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from brindle.llm.common import forgotten, shared_dir, slices_of_bytes, written

#: Bytes of payload and headers that a shard holds, about; compressed bytes after which a file is closed; the least payload that is revisited.
SHARD_BYTES, FILE_BYTES, REVISIT_FROM = 128 << 20, 32 << 20, 0
#: Bytes that a record's headers take, about; bytes of html dealt out or given back at once; bytes read at once.
HEADER_BYTES, SLICE_BYTES, CHUNK = 1024, 8 << 20, 1 << 20
#: The date of records, since the pages have none.
DATE = "2000-01-01T00:00:00Z"
MANIFEST = "manifest.json"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:brindle:warc")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_KEY = ("page_id", "url", "digest")
_DEALT = "shard int, page_id long, url string, digest string, note boolean, copies long, html binary, head_id long, head_url string"
_SCHEMA = "archive string, offset long, record_type string, record_id string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, refers_to_record string, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _place(page_id: int | None, url: str | None, digest: str) -> tuple:
    """A key as Python orders it: like Spark, nulls first and strings by bytes."""
    return page_id is not None, page_id or 0, url is not None, (url or "").encode(), digest


def plan(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Each different row's key, bytes, copies, and the head of its payload's group where the payload is shared. No html."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keys = pages.select(F.col("page_id").cast("long"), "url", F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("bytes")).groupBy(*_KEY, "bytes").agg(F.count("*").alias("copies"))
    keys = written(keys)
    shared = keys.where(F.col("bytes") >= revisit_from).groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("head"), F.sum("copies").alias("n")).where("n > 1").drop("n")
    out = written(keys.join(shared, "digest", "left").select(*_KEY, "bytes", "copies", F.col("head.page_id").alias("head_id"), F.col("head.url").alias("head_url"), F.col("head").isNotNull().alias("shared")))
    forgotten(keys)
    return out


def first_keys(planned: DataFrame, shard_bytes: int = SHARD_BYTES) -> list[tuple]:
    """The first key of each shard, in order. Running sums within ranges, then over ranges: no task holds all rows."""
    is_head = ~F.col("shared") | (F.col("page_id").eqNullSafe(F.col("head_id")) & F.col("url").eqNullSafe(F.col("head_url")))
    weight = F.col("copies") * HEADER_BYTES + F.when(is_head, F.col("bytes")).otherwise(0)
    ranges = written(planned.select(*_KEY, weight.alias("w")).repartitionByRange(*_KEY).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("part").agg(F.sum("w").alias("w")).select("part", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("start"))  # a row for each range
    within = Window.partitionBy("part").orderBy(*_KEY).rowsBetween(Window.unboundedPreceding, -1)
    at = ranges.withColumn("sum", F.coalesce(F.sum("w").over(within), F.lit(0))).join(F.broadcast(starts), "part")
    shard = F.floor((F.col("start") + F.col("sum")) / shard_bytes)
    rows = at.groupBy(shard.alias("shard")).agg(F.min(F.struct(*_KEY)).alias("k")).collect()  # a row for each shard
    forgotten(ranges)
    return sorted(_place(*r["k"]) for r in rows)


def _dealt(firsts: list[tuple]):  # noqa: ANN202
    """Gives each row its shard; equal rows of a batch become one with their number, so that a row that is repeated very often is not sent again and again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices_of_bytes(whole, "html", SLICE_BYTES):
                rows: dict[tuple, list] = {}
                for page_id, url, html, digest, head_id, head_url in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "head_id", "head_url")), strict=True):
                    note = digest is not None
                    data = None if note else (html or b"")
                    key = (page_id, url, digest if note else hashlib.sha1(data).hexdigest(), note)
                    if key in rows:
                        rows[key][1] += 1
                    else:
                        rows[key] = [max(0, bisect_right(firsts, _place(*key[:3])) - 1), 1, data, head_id, head_url]
                columns = [[r[0] for r in rows.values()], *([k[i] for k in rows] for i in range(4)), *([r[i] for r in rows.values()] for i in range(1, 5))]
                kinds = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in _DEALT.split(", ")])

    return run


def write_warc(pages: DataFrame, path: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, revisit_from: int = REVISIT_FROM) -> None:
    """Writes pages (page_id, url, html) as archives under path, which must hold no manifest yet."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    planned = plan(pages, revisit_from)
    firsts = first_keys(planned, shard_bytes)
    none = lambda kind: F.lit(None).cast(kind)
    rows = pages.select(F.col("page_id").cast("long"), "url", F.col("html").cast("binary"), none("string").alias("digest"), none("long").alias("head_id"), none("string").alias("head_url"))
    notes = planned.where("shared").select("page_id", "url", none("binary").alias("html"), "digest", "head_id", "head_url")
    shards = max(1, len(firsts))
    dealt = rows.unionByName(notes).mapInArrow(_dealt(firsts), _DEALT).repartitionById(shards, F.col("shard"))
    ordered = dealt.sortWithinPartitions("shard", *_KEY, F.desc("note"))
    ordered.write.format("warc").mode("append").option("fileBytes", str(file_bytes)).save(path)
    forgotten(planned)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all archives under path that the manifest names, warcinfo records left out."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def _header_text(text: str) -> str:
    """A url that fits on a header line."""
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def _record_id(page_id: int | None, url: str | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, json.dumps([page_id, url, digest, copy]))}>"


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One compressed record."""
    lines = [("WARC-Type", kind), ("WARC-Date", DATE), *fields, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def _http(payload: bytes, full_length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {full_length}\r\n\r\n".encode() + payload


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, copy: int, refers_to: tuple | None) -> bytes:
    """A page's response, or a revisit where refers_to is the key (page_id, url) of the response."""
    fields = [("WARC-Record-ID", _record_id(page_id, url, digest, copy)), ("WARC-Target-URI", "about:blank" if url is None else _header_text(url)), ("Content-Type", "application/http;msgtype=response")]
    fields.append(("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"))
    fields += [("WARC-Page-ID", str(page_id))] if page_id is not None else []
    if refers_to is None:
        return _record("response", fields, _http(payload, len(payload)))
    fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id(*refers_to, digest, 0)), ("WARC-Refers-To-Date", DATE)]
    fields += [("WARC-Refers-To-Target-URI", "about:blank" if refers_to[1] is None else _header_text(refers_to[1]))]
    fields += [("WARC-Refers-To-Page-ID", str(refers_to[0]))] if refers_to[0] is not None else []
    return _record("revisit", fields, _http(b"", len(payload)))


@dataclass
class _Files(WriterCommitMessage):
    """What a task has written: (temporary name, name, records, bytes, sha1) of each file."""

    files: list[tuple[str, str, int, int, str]] = field(default_factory=list)


class _Roll:
    """The files of one shard, each closed when it is large enough."""

    def __init__(self, fs: pafs.FileSystem, folder: str, most: int) -> None:
        self.fs, self.folder, self.most, self.done = fs, folder, most, _Files()
        self.shard, self.number, self.stream = -1, 0, None

    def put(self, shard: int, record: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.number = shard, 0
        if self.stream is None:
            self.name = f"part-{shard:06d}-{self.number:04d}.warc.gz"
            self.temporary = f"_{self.name}.{uuid.uuid4().hex}"
            self.stream, self.sum, self.size, self.records = self.fs.open_output_stream(f"{self.folder}/{self.temporary}", compression=None), hashlib.sha1(), 0, 0
            self._add(_record("warcinfo", [("WARC-Record-ID", _record_id(None, self.name, "", 0)), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self._add(record)
        self.records += 1
        if self.size >= self.most:
            self.close()

    def _add(self, data: bytes) -> None:
        self.stream.write(data)
        self.sum.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.done.files.append((self.temporary, self.name, self.records, self.size, self.sum.hexdigest()))
            self.stream, self.number = None, self.number + 1


def _place_of(path: str) -> tuple[pafs.FileSystem, str]:
    fs, folder = pafs.FileSystem.from_uri(path if re.match(r"[a-zA-Z][\w+.-]*:", path) else f"file://{path}")
    return fs, folder.rstrip("/")


def _manifest(path: str) -> list[dict] | None:
    fs, folder = _place_of(path)
    if fs.get_file_info(f"{folder}/{MANIFEST}").type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(f"{folder}/{MANIFEST}") as f:
        return json.loads(f.read())["files"]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, file_bytes: int) -> None:
        self.path, self.file_bytes = path, file_bytes
        if _manifest(path) is not None:
            raise ValueError(f"there is a manifest in {path}")
        fs, folder = _place_of(path)
        fs.create_dir(folder, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Files:
        """Rows come by shard and key; the verdict on a shared payload comes before its rows."""
        fs, folder = _place_of(self.path)
        out = _Roll(fs, folder, self.file_bytes)
        key, head, copy = None, None, 0
        for batch in iterator:
            for part in slices_of_bytes(batch, "html", SLICE_BYTES):
                for r in part.to_pylist():
                    mine = (r["page_id"], r["url"], r["digest"])
                    if mine != key:
                        key, head, copy = mine, None, 0
                    if r["note"]:
                        head = (r["head_id"], r["head_url"])
                        continue
                    for _ in range(r["copies"]):
                        first = head is None or (head == mine[:2] and copy == 0)
                        out.put(r["shard"], page_record(*mine[:2], r["html"], mine[2], copy, None if first else head))
                        copy += 1
        out.close()
        return out.done

    def commit(self, messages: list[_Files | None]) -> None:
        fs, folder = _place_of(self.path)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f[1])
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda f: fs.move(f"{folder}/{f[0]}", f"{folder}/{f[1]}"), files))
        rows = [{"name": name, "records": n, "bytes": size, "sha1": total} for _, name, n, size, total in files]
        with fs.open_output_stream(f"{folder}/_{MANIFEST}", compression=None) as f:
            f.write(json.dumps({"files": rows}, indent=1).encode())
        fs.move(f"{folder}/_{MANIFEST}", f"{folder}/{MANIFEST}")
        self._clear()

    def abort(self, messages: list[_Files | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Files with temporary names that no commit will take."""
        fs, folder = _place_of(self.path)
        for info in fs.get_file_info(pafs.FileSelector(folder)):
            if info.base_name.startswith("_"):
                fs.delete_file(info.path)


def members(stream: pa.NativeFile) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member; ValueError where the last one is cut."""
    offset, read, rest = 0, 0, b""
    while True:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not rest:
                rest = stream.read(CHUNK)
                if not rest:
                    if parts or read > offset:
                        raise ValueError("an archive ends inside a record")
                    return
                read += len(rest)
            parts.append(unpacker.decompress(rest))
            rest = unpacker.unused_data
        yield offset, b"".join(parts)
        offset = read - len(rest)


def parsed(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers in lower case and block of a record; ValueError where digest or length do not fit."""
    head, _, rest = content.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    if not version.startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n" or len(block) != int(fields["content-length"]) or fields["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError("a record's headers and its block do not fit")
    return fields, block


@dataclass
class _File(InputPartition):
    name: str
    size: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, payload: bool) -> None:
        self.path, self.payload = path, payload

    def partitions(self) -> list[_File]:
        files = _manifest(self.path)
        if files is None:
            raise ValueError(f"there is no manifest in {self.path}")
        return [_File(f["name"], f["bytes"]) for f in files] or [_File("", 0)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, folder = _place_of(self.path)
        if fs.get_file_info(f"{folder}/{partition.name}").size != partition.size:
            raise ValueError(f"{partition.name} has not the size that the manifest states")
        rows, size = [], 0
        with fs.open_input_stream(f"{folder}/{partition.name}", compression=None) as stream:
            for offset, content in members(stream):
                fields, block = parsed(content)
                if fields["warc-type"] == "warcinfo":
                    continue
                rows.append(self._row(partition.name, offset, fields, block))
                size += len(block)
                if size >= SLICE_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _row(self, name: str, offset: int, fields: dict[str, str], block: bytes) -> tuple:
        """Length and digest are those of the payload read; a revisit has none, its headers tell."""
        http, _, payload = block.partition(b"\r\n\r\n")
        stated = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        kind = fields["warc-type"]
        if kind == "response" and (len(payload) != stated or base32_sha1(payload) != digest):
            raise ValueError(f"a payload in {name} at {offset} is not the one that its headers tell of")
        number = lambda k: int(fields[k]) if k in fields else None
        held = payload if self.payload and kind == "response" else None
        return name, offset, kind, fields["warc-record-id"], number("warc-page-id"), fields["warc-target-uri"], stated, digest, number("warc-refers-to-page-id"), fields.get("warc-refers-to"), held


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    columns = [f.split() for f in _SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), columns, strict=True)], names=[n for n, _ in columns])


class WarcSource(DataSource):
    """Format "warc": save() takes rows as write_warc() orders them; load() gives records. Options: fileBytes, payload."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], self.options.get("payload", "true") == "true")

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("archives are written once; name another folder")
        return _Writer(self.options["path"], int(self.options.get("filebytes", self.options.get("fileBytes", FILE_BYTES))))


def warc_digest(pages: DataFrame) -> DataFrame:
    """Writes all pages, reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to of every record."""
    path = f"{shared_dir(pages.sparkSession).rstrip('/')}/brindle-{uuid.uuid4().hex}"
    write_warc(pages, path)
    return read_warc(pages.sparkSession, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
