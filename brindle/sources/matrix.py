"""Vector matrices as a Spark data source, format "vector_matrix": ids in order beside float32 rows, in parts under a manifest.

Write: write_matrix() orders rows by id over ranges; each task writes its range as parts of at most PART_ROWS rows under temporary
names, and the driver renames them and puts the manifest beside them, by a rename too, when all are done. Readers see the
manifest's files only, so a torn write shows nothing; overwriting puts the new manifest before old parts go.

Read: a part is a task. A part's ids and rows are two files, and only those that the asked schema needs are read (schema("id string")
reads no rows). Equality and bounds on id leave out parts by the manifest, where spark.sql.python.filterPushdown.enabled is on.

Odd input: a null id, an id that occurs twice, a vector that is null, of another size, or has a value that is not finite in float32
fails the write and leaves what was there; an empty table gives a manifest without parts and, where no size is given, size 0.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

PART_ROWS, READ_ROWS, MANIFEST = 65536, 4096, "manifest.json"


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    fs, folder = pafs.FileSystem.from_uri(path if re.match(r"[a-zA-Z][\w+.-]*:", path) else f"file://{path}")
    return fs, folder.rstrip("/")


def _read(fs: pafs.FileSystem, path: str) -> bytes:
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


def _write(fs: pafs.FileSystem, path: str, data: bytes) -> str:
    with fs.open_output_stream(path, compression=None) as f:
        f.write(data)
    return hashlib.sha256(data).hexdigest()


def manifest(path: str) -> dict | None:
    """size (of a vector), rows, and parts in the order of their ids (name, rows, first, last, digests); None where nothing was committed."""
    fs, folder = _place(path)
    if fs.get_file_info(f"{folder}/{MANIFEST}").type == pafs.FileType.NotFound:
        return None
    return json.loads(_read(fs, f"{folder}/{MANIFEST}"))


@dataclass
class _Parts(WriterCommitMessage):
    parts: list[dict] = field(default_factory=list)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, size: int | None, overwrite: bool) -> None:
        self.path, self.size, self.overwrite, self.job = path, size, overwrite, uuid.uuid4().hex
        if not overwrite and manifest(path) is not None:
            raise ValueError(f"there is a matrix in {path}")
        fs, folder = _place(path)
        fs.create_dir(folder, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Parts:
        fs, folder = _place(self.path)
        done, ids, rows, size, last = _Parts(), [], [], self.size, None

        def close() -> None:
            name = f"part-{uuid.uuid4().hex}"
            sums = [_write(fs, f"{folder}/_{name}.{kind}", data) for kind, data in (("ids", json.dumps(ids, ensure_ascii=False).encode()), ("f32", np.concatenate(rows).tobytes()))]
            done.parts.append({"name": name, "rows": len(ids), "size": size, "first": ids[0], "last": ids[-1], "sha256": sums})
            ids.clear()
            rows.clear()

        for batch in iterator:
            for lo in range(0, batch.num_rows, READ_ROWS):
                part = batch.slice(lo, READ_ROWS)
                v, keys = part.column("v"), part.column("id").to_pylist()
                lengths = {len(x) if x is not None else None for x in v.to_pylist()} if v.null_count else set(np.unique(np.diff(v.offsets.to_numpy())).tolist())
                size = size if size is not None or not lengths or None in lengths else min(lengths)
                if lengths - {size}:
                    raise ValueError(f"a vector's size is not {size}, by the row after {last}")
                x = np.asarray(v.flatten(), np.float64).astype(np.float32).reshape(len(keys), size)
                bad = np.flatnonzero(~np.isfinite(x).all(1))
                if len(bad):
                    raise ValueError(f"a vector has a value that is not finite: {keys[bad[0]]}")
                for key in keys:
                    if key is None or key == last:
                        raise ValueError("a vector has no id" if key is None else f"an id occurs twice: {key}")
                    last = key
                ids += keys
                rows.append(x)
                if len(ids) >= PART_ROWS:
                    close()
        if ids:
            close()
        return done

    def commit(self, messages: list[_Parts | None]) -> None:
        fs, folder = _place(self.path)
        parts = sorted((p for m in messages if m for p in m.parts), key=lambda p: p["first"].encode())
        sizes = {p["size"] for p in parts}
        if len(sizes) > 1 or any(a["last"].encode() >= b["first"].encode() for a, b in zip(parts, parts[1:], strict=False)):
            self.abort(messages)
            raise ValueError(f"vectors of several sizes: {sorted(sizes)}" if len(sizes) > 1 else "ranges of ids overlap; write with write_matrix()")
        for p in parts:
            for kind in ("ids", "f32"):
                fs.move(f"{folder}/_{p['name']}.{kind}", f"{folder}/{p['name']}.{kind}")
        size = self.size if self.size is not None else next(iter(sizes), 0)
        _write(fs, f"{folder}/_{MANIFEST}", json.dumps({"size": size, "rows": sum(p["rows"] for p in parts), "parts": parts}, ensure_ascii=False, indent=1).encode())
        fs.move(f"{folder}/_{MANIFEST}", f"{folder}/{MANIFEST}")
        self._clear({p["name"] for p in parts})

    def abort(self, messages: list[_Parts | None]) -> None:
        kept = manifest(self.path)
        self._clear({p["name"] for p in kept["parts"]} if kept else set())

    def _clear(self, kept: set[str]) -> None:
        """Files that the manifest does not name."""
        fs, folder = _place(self.path)
        for info in fs.get_file_info(pafs.FileSelector(folder)):
            if info.base_name != MANIFEST and info.base_name.partition(".")[0] not in kept:
                fs.delete_file(info.path)


@dataclass
class _Part(InputPartition):
    part: dict


class _Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]) -> None:
        self.path, self.columns, self.bounds = path, columns, []

    def _may_hold(self, part: dict) -> bool:
        first, last = part["first"].encode(), part["last"].encode()
        for f in self.bounds:
            at = [x.encode() for x in (f.value if isinstance(f, In) else [f.value]) if isinstance(x, str)]
            if isinstance(f, EqualTo | In):
                held = any(first <= x <= last for x in at)
            elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                held = not at or last >= at[0]
            else:
                held = not at or first <= at[0]
            if not held:
                return False
        return True

    def partitions(self) -> list[_Part]:
        found = manifest(self.path)
        if found is None:
            raise ValueError(f"there is no matrix in {self.path}")
        return [_Part(p) for p in found["parts"] if self._may_hold(p)] or [_Part({})]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        part = partition.part
        if not part:
            return
        fs, folder = _place(self.path)
        columns = {}
        for column, kind, total in (("id", "ids", part["sha256"][0]), ("v", "f32", part["sha256"][1])):
            if column in self.columns:
                data = _read(fs, f"{folder}/{part['name']}.{kind}")
                if hashlib.sha256(data).hexdigest() != total:
                    raise ValueError(f"{part['name']}.{kind} is not what was written")
                columns[column] = json.loads(data) if column == "id" else np.frombuffer(data, np.float32)
        for lo in range(0, part["rows"], READ_ROWS):
            n, size = min(READ_ROWS, part["rows"] - lo), part["size"]
            made = {"id": lambda lo=lo, n=n: pa.array(columns["id"][lo : lo + n], pa.string()), "v": lambda lo=lo, n=n, size=size: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * size, pa.int32()), pa.array(columns["v"][lo * size : (lo + n) * size]))}
            yield pa.RecordBatch.from_arrays([made[c]() for c in self.columns], names=self.columns)


class _PrunedReader(_Reader):
    """A reader that takes filters; Spark allows it only where its setting is on."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Bounds on id choose parts; Spark still tests each row."""
        for f in filters:
            if getattr(f, "attribute", None) == ("id",) and isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                self.bounds.append(f)
            yield f


class MatrixSource(DataSource):
    """Rows id (string) and v (array of float). Options: path, size, filters."""

    @classmethod
    def name(cls) -> str:
        return "vector_matrix"

    def schema(self) -> str:
        return "id string, v array<float>"

    def reader(self, schema: StructType) -> _Reader:
        return (_PrunedReader if self.options.get("filters") == "true" else _Reader)(self.options["path"], schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        size = self.options.get("size")
        return _Writer(self.options["path"], int(size) if size else None, overwrite)


def write_matrix(vectors: DataFrame, path: str, size: int | None = None, overwrite: bool = False, ranges: int | None = None) -> None:
    """Writes vectors (id, v) in the order of their ids, in so many ranges (without a number: as Spark deals them)."""
    vectors.sparkSession.dataSource.register(MatrixSource)
    rows = vectors.select(F.col("id").cast("string").alias("id"), F.col("v").cast("array<double>").alias("v"))
    out = rows.repartitionByRange(*([ranges] if ranges else []), "id").sortWithinPartitions("id").write.format("vector_matrix").mode("overwrite" if overwrite else "append")
    (out.option("size", str(size)) if size is not None else out).save(path)


def read_matrix(spark: SparkSession, path: str, columns: str = "id string, v array<float>") -> DataFrame:
    """id and v, or one of them."""
    spark.dataSource.register(MatrixSource)
    filters = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("vector_matrix").schema(columns).option("filters", filters).load(path)
