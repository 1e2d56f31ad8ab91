"""Vector files: fvecs, ivecs and bvecs as a Spark data source, split by byte ranges of whole records.

    spark.dataSource.register(VecsSource)
    spark.read.format("vecs").load("base.fvecs")                     # id, vec
    df.write.format("vecs").mode("append").save("out/base.fvecs")    # a folder of part files

Options: format (fvecs, ivecs, bvecs; else by the name), rows (only the first so many). Records are a little-endian int32
dimension and the components. A dimension that changes, or a file that ends within a record, is an error.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

KINDS = {"fvecs": ("<f4", "array<float>"), "ivecs": ("<i4", "array<int>"), "bvecs": ("u1", "array<float>")}
PART_BYTES, BATCH = 64 << 20, 4096


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def kind_of(path: str, given: str | None = None) -> str:
    kind = given or next((k for k in KINDS if f".{k}" in path), "fvecs")
    if kind not in KINDS:
        raise ValueError(f"no vector format {kind!r}; there are {', '.join(KINDS)}")
    return kind


def files_of(path: str) -> list[tuple[str, int]]:
    """Names and sizes of a file, or of the part files of a folder, in order."""
    fs, name = file_system(path)
    info = fs.get_file_info(name)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [(name, info.size)]
    found = fs.get_file_info(pafs.FileSelector(name))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")) and not f.base_name.endswith(".part"))


def first_dimension(fs: pafs.FileSystem, name: str) -> int:
    with fs.open_input_file(name) as file:
        head = file.read(4)
    if len(head) < 4:
        raise ValueError(f"{name} ends within a record")
    (d,) = struct.unpack("<i", head)
    if d <= 0:
        raise ValueError(f"{name} says dimension {d}")
    return d


class Range(InputPartition):
    def __init__(self, name: str, first_id: int, begin: int, rows: int, dim: int):
        super().__init__(name)
        self.name, self.first_id, self.begin, self.rows, self.dim = name, first_id, begin, rows, dim


class VecsReader(DataSourceReader):
    def __init__(self, path: str, kind: str, limit: int | None):
        self.path, self.kind, self.limit = path, kind, limit
        self.width = np.dtype(KINDS[kind][0]).itemsize

    def partitions(self) -> list[Range]:
        fs, _ = file_system(self.path)
        out, at = [], 0
        for name, size in files_of(self.path):
            if not size:
                continue
            dim = first_dimension(fs, name)
            record = 4 + dim * self.width
            if size % record:
                raise ValueError(f"{name}: {size} bytes aren't whole records of dimension {dim}")
            n, step = size // record, max(1, PART_BYTES // record)
            for begin in range(0, n, step):
                rows = min(step, n - begin, *([] if self.limit is None else [self.limit - at]))
                if rows > 0:
                    out.append(Range(name, at, begin * record, rows, dim))
                    at += rows
        return out or [Range("", 0, 0, 0, 1)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.rows:
            return
        fs, _ = file_system(self.path)
        code, element = KINDS[self.kind]
        record = np.dtype([("d", "<i4"), ("v", code, (part.dim,))])
        with fs.open_input_file(part.name) as file:
            file.seek(part.begin)
            for at in range(0, part.rows, BATCH):
                n = min(BATCH, part.rows - at)
                held = np.frombuffer(file.read(n * record.itemsize), record)
                if (held["d"] != part.dim).any():
                    raise ValueError(f"{part.name}: the dimension changes from {part.dim}")
                flat = np.ascontiguousarray(held["v"]).ravel().astype(np.int32 if element == "array<int>" else np.float32)
                vec = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * part.dim, part.dim, dtype=np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.first_id + at, part.first_id + at + n)), vec], ["id", "vec"])


class Written(WriterCommitMessage):
    def __init__(self, part: str, name: str):
        self.part, self.name = part, name


class VecsWriter(DataSourceWriter):
    """Each task writes a part file beside its final name; the driver renames them once all are there."""

    def __init__(self, path: str, kind: str, overwrite: bool):
        self.path, self.kind, self.overwrite, self.run = path, kind, overwrite, uuid.uuid4().hex[:12]

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        fs, folder = file_system(self.path)
        fs.create_dir(folder, recursive=True)
        task = TaskContext.get()
        name = f"{folder}/part-{self.run}-{task.partitionId():06d}.{self.kind}"
        part, dim = f"{name}.{task.taskAttemptId()}.part", None
        with fs.open_output_stream(part, compression=None) as out:
            for row in rows:
                v = np.asarray(row["vec"], KINDS[self.kind][0])
                if dim not in (None, len(v)):
                    raise ValueError(f"vectors of {dim} and of {len(v)} components can't go to one file")
                dim = len(v)
                out.write(struct.pack("<i", dim) + v.tobytes())
        return Written(part, name)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = file_system(self.path)
        if self.overwrite:
            for name, _ in files_of(self.path):
                fs.delete_file(name)
        for m in filter(None, messages):
            fs.move(m.part, m.name)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = file_system(self.path)
        for m in filter(None, messages):
            fs.delete_file(m.part)


class VecsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vecs"

    def _kind(self) -> str:
        return kind_of(self.options["path"], self.options.get("format"))

    def schema(self) -> str:
        return f"id long, vec {KINDS[self._kind()][1]}"

    def reader(self, schema: StructType) -> VecsReader:
        rows = self.options.get("rows")
        return VecsReader(self.options["path"], self._kind(), None if rows is None else int(rows))

    def writer(self, schema: StructType, overwrite: bool) -> VecsWriter:
        return VecsWriter(self.options["path"], self._kind(), overwrite)


def read_vecs(spark: SparkSession, path: str, kind: str | None = None, rows: int | None = None) -> DataFrame:
    spark.dataSource.register(VecsSource)
    reader = spark.read.format("vecs")
    for name, value in (("format", kind), ("rows", rows)):
        if value is not None:
            reader = reader.option(name, value)
    return reader.load(path)


def write_vecs(df: DataFrame, path: str, kind: str | None = None, mode: str = "append") -> None:
    """df: vec, in the order of its partitions."""
    df.sparkSession.dataSource.register(VecsSource)
    writer = df.select("vec").write.format("vecs").mode(mode)
    (writer.option("format", kind) if kind else writer).save(path)
