"""Binary vector files as Spark tables: fvecs (float32), ivecs (int32), Ivecs (uint64) and bvecs (uint8).

Each record is an int32 dimension and that many values.  The reader is a Python data source that splits a
file into runs of records; the dimension of every record is checked against the first (``mode`` FAILFAST)
or kept as it is (``ragged``: records of any length, read as one run a file).

    register(spark)
    spark.read.format("vecs").option("path", p).option("dtype", "float32").load()
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

KINDS = {"float32": (np.float32, "float"), "int32": (np.int32, "int"), "uint64": (np.uint64, "bigint"), "uint8": (np.uint8, "smallint")}
EXTENSIONS = {".fvecs": "float32", ".ivecs": "int32", ".Ivecs": "uint64", ".bvecs": "uint8"}
RUN_BYTES = 64 << 20


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (file, hdfs, s3, ...), and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def entries(path: str) -> list[fs.FileInfo]:
    """The files of a folder by name, or the file itself."""
    system, inner = file_system(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [info]
    found = system.get_file_info(fs.FileSelector(inner))
    return sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.base_name)


def kind_of(path: str, given: str | None = None) -> str:
    kind = given or EXTENSIONS.get(os.path.splitext(path)[1])
    if kind not in KINDS:
        raise ValueError(f"unknown vector type {kind!r}; one of {sorted(KINDS)}")
    return kind


class Run(InputPartition):
    def __init__(self, path: str, first: int, count: int, base: int):
        self.path, self.first, self.count, self.base = path, first, count, base


class VecsReader(DataSourceReader):
    def __init__(self, path: str, kind: str, ragged: bool):
        self.path, self.kind, self.ragged = path, kind, ragged
        self.item = np.dtype(KINDS[kind][0]).itemsize

    def partitions(self) -> list[Run]:
        runs, base = [], 0
        system, _ = file_system(self.path)
        for info in entries(self.path):
            path, size = info.path, info.size
            if not size:
                continue
            if self.ragged:
                runs.append(Run(path, 0, -1, base))
                continue
            with system.open_input_file(path) as f:
                dim = struct.unpack("<i", f.read(4))[0]
            record = 4 + dim * self.item
            if dim < 0 or size % record:
                raise ValueError(f"{path}: {size} bytes are no whole number of records of {dim} values")
            total, each = size // record, max(1, RUN_BYTES // record)
            runs += [Run(path, i, min(each, total - i), base + i) for i in range(0, total, each)]
            base += total
        return runs

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(KINDS[self.kind][0])
        signed = {"uint64": np.int64, "uint8": np.int16}.get(self.kind, KINDS[self.kind][0])
        if run.count < 0:
            yield from self._ragged(run, kind, signed)
            return
        with file_system(self.path)[0].open_input_file(run.path) as f:
            dim = struct.unpack("<i", f.read(4))[0]
            record = 4 + dim * kind.itemsize
            f.seek(run.first * record)
            done = 0
            while done < run.count:
                n = min(run.count - done, max(1, (4 << 20) // record))
                raw = np.frombuffer(f.read(n * record), np.uint8).reshape(n, record)
                if (np.ascontiguousarray(raw[:, :4]).view("<i4")[:, 0] != dim).any():
                    raise ValueError(f"{run.path}: records of different dimensions")
                values = np.ascontiguousarray(raw[:, 4:]).view(kind).reshape(-1)
                values = values.view(np.int64) if self.kind == "uint64" else values.astype(signed)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(values))
                yield pa.record_batch([pa.array(np.arange(n) + run.base + done), lists], ["id", "v"])
                done += n

    def _ragged(self, run: Run, kind: np.dtype, signed: type) -> Iterator[pa.RecordBatch]:
        with file_system(self.path)[0].open_input_stream(run.path) as f:
            i = run.base
            while head := f.read(4):
                dim = struct.unpack("<i", head)[0]
                raw = f.read(dim * kind.itemsize)
                if len(raw) != dim * kind.itemsize:
                    raise ValueError(f"{run.path}: cut off in record {i}")
                values = np.frombuffer(raw, kind)
                values = values.view(np.int64) if self.kind == "uint64" else values.astype(signed)
                yield pa.record_batch([pa.array([i]), pa.ListArray.from_arrays(pa.array([0, dim], pa.int32()), pa.array(values))], ["id", "v"])
                i += 1


class Part(WriterCommitMessage):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows


class VecsWriter(DataSourceWriter):
    """One part file a partition, under a folder; rows keep their order inside a partition."""

    def __init__(self, path: str, kind: str, overwrite: bool):
        self.path, self.kind, self.overwrite = path, kind, overwrite
        system, inner = file_system(path)
        if not overwrite and system.get_file_info(inner).type != fs.FileType.NotFound and entries(path):
            raise ValueError(f"{path} is not empty")
        system.create_dir(inner, recursive=True)

    def write(self, rows) -> Part:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, inner = file_system(self.path)
        path = f"{inner}/.part-{context.partitionId():05d}-{context.taskAttemptId()}"
        kind, n = KINDS[self.kind][0], 0
        with system.open_output_stream(path) as f:
            for row in rows:
                v = np.asarray(row[-1])
                v = v.astype(np.int64).view(np.uint64) if self.kind == "uint64" else v.astype(kind)
                f.write(struct.pack("<i", len(v)) + v.tobytes())
                n += 1
        return Part(path, n)

    def commit(self, messages: list[Part | None]) -> None:
        system, inner = file_system(self.path)
        if self.overwrite:
            for old in entries(self.path):
                if old.base_name.startswith("part-"):
                    system.delete_file(old.path)
        extension = next(e for e, k in EXTENSIONS.items() if k == self.kind)
        for m in messages:
            if m is not None:
                name = os.path.basename(m.path)[1:].rsplit("-", 1)[0]
                system.move(m.path, f"{inner}/{name}{extension}")

    def abort(self, messages: list[Part | None]) -> None:
        system, _ = file_system(self.path)
        for m in messages:
            if m is not None and system.get_file_info(m.path).type == fs.FileType.File:
                system.delete_file(m.path)


class VecsSource(DataSource):
    """Options: path; dtype (else from the file's extension); ragged (false)."""

    @classmethod
    def name(cls) -> str:
        return "vecs"

    def kind(self) -> str:
        return kind_of(self.options["path"], self.options.get("dtype"))

    def schema(self) -> str:
        return f"id bigint, v array<{KINDS[self.kind()][1]}>"

    def reader(self, schema) -> VecsReader:
        return VecsReader(self.options["path"], self.kind(), self.options.get("ragged", "false").lower() == "true")

    def writer(self, schema, overwrite: bool) -> VecsWriter:
        return VecsWriter(self.options["path"], self.kind(), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VecsSource)


def read_vecs(spark: SparkSession, path: str, dtype: str | None = None, ragged: bool = False, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A vector file or folder as (id, vector); ids are record numbers."""
    register(spark)
    rows = spark.read.format("vecs").option("path", path).option("dtype", kind_of(path, dtype)).option("ragged", str(ragged).lower()).load()
    return rows.withColumnsRenamed({"id": id_col, "v": column})


def write_vecs(df: DataFrame, path: str, column: str = "embedding", dtype: str = "float32", order: str | None = None, single: bool = False) -> None:
    """Vectors of a column to a folder of vector files; ``single`` writes them as one file in ``order``."""
    register(df.sparkSession)
    rows = df.repartition(1) if single else df
    rows = rows.sortWithinPartitions(order) if order and single else rows.repartitionByRange(order).sortWithinPartitions(order) if order else rows
    rows.select(column).write.format("vecs").option("path", path).option("dtype", dtype).mode("overwrite").save()
