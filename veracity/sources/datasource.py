"""Record files as a Spark data source: spark.read / readStream / write / writeStream .format("records").

Files are JSON lines as the record writers leave them, with bare NaN and Infinity both ways. A batch reads files in ranges of bytes that begin
after a line end, so one large file is many tasks. A stream follows files that grow or come anew: an offset holds the bytes of each file up to its
last whole line. Writers make one file a task under a name apart, which the commit renames; a stream's names hold the number of the
batch, so that a batch written twice is there once.

Options: path (a file or folder, local or any address that pyarrow knows and that all executors reach), splitBytes (64 MB)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import MapType, StructType

from .records import RECORD

SPLIT, ROWS, BLOCK = 64 << 20, 1000, 1 << 20


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (pafs.LocalFileSystem(), path)


def _files(path: str) -> dict[str, int]:
    """Names and sizes of the record files at a path, in the order of names; what begins with . or _ isn't one."""
    fs, base = _at(path)
    info = fs.get_file_info(base)
    if info.type == pafs.FileType.File:
        return {base: info.size}
    if info.type == pafs.FileType.NotFound:
        return {}
    found = fs.get_file_info(pafs.FileSelector(base))
    return {f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.type == pafs.FileType.File and f.base_name[0] not in "._" and f.extension in ("json", "jsonl")}


@dataclass
class Range(InputPartition):
    """The lines that begin in bytes start .. end - 1 of a file."""

    file: str
    start: int
    end: int


def _ranges(file: str, start: int, end: int, split: int) -> list[Range]:
    return [Range(file, a, min(a + split, end)) for a in range(start, end, split)]


def _lines(path: str, part: Range) -> Iterator[bytes]:
    fs, _ = _at(path)
    with fs.open_input_file(part.file) as f:
        at = part.start
        if at:  # the line that holds the byte before belongs to the range before
            f.seek(at - 1)
            at += len(_line(f)) - 1
        f.seek(at)
        while at < part.end:
            line = _line(f)
            if not line:
                return
            at += len(line)
            yield line


def _line(f) -> bytes:
    """From the present place to the next line end, and the file is there afterwards."""
    start, parts = f.tell(), []
    while block := f.read(8192):
        cut = block.find(b"\n")
        parts.append(block if cut < 0 else block[: cut + 1])
        if cut >= 0:
            break
    out = b"".join(parts)
    f.seek(start + len(out))
    return out


def _parsed(path: str, part: Range, schema: StructType) -> Iterator[pa.RecordBatch]:
    arrow = to_arrow_schema(schema)
    maps = [f.name for f in schema if isinstance(f.dataType, MapType)]
    rows: list[dict] = []
    for line in _lines(path, part):
        if line.strip():
            row = json.loads(line)
            rows.append({f.name: list(row[f.name].items()) if f.name in maps and row.get(f.name) is not None else row.get(f.name) for f in schema})
        if len(rows) == ROWS:
            yield pa.RecordBatch.from_pylist(rows, arrow)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, arrow)


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, split: int) -> None:
        self.path, self.schema, self.split = path, schema, split

    def partitions(self) -> list[InputPartition]:
        found = _files(self.path)
        if not found:
            raise FileNotFoundError(f"no records at {self.path}")
        return [r for file, size in found.items() for r in _ranges(file, 0, size, self.split)] or [Range(next(iter(found)), 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from _parsed(self.path, partition, self.schema)


def _whole(fs: pafs.FileSystem, file: str, size: int) -> int:
    """Bytes of a file up to its last line end."""
    with fs.open_input_file(file) as f:
        end = size
        while end > 0:
            start = max(0, end - BLOCK)
            f.seek(start)
            cut = f.read(end - start).rfind(b"\n")
            if cut >= 0:
                return start + cut + 1
            end = start
    return 0


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, schema: StructType, split: int) -> None:
        self.path, self.schema, self.split, self.seen = path, schema, split, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, _ = _at(self.path)
        for file, size in _files(self.path).items():
            if size != self.seen.get(file, (0, 0))[0]:  # only files that changed are looked at
                self.seen[file] = (size, _whole(fs, file, size))
        return {file: whole for file, (_, whole) in self.seen.items() if whole}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [r for file, to in end.items() for r in _ranges(file, start.get(file, 0), to, self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from _parsed(self.path, partition, self.schema)

    def commit(self, end: dict) -> None:
        """The files stay."""


@dataclass
class Written(WriterCommitMessage):
    temporary: str | None
    partition: int


class _Files:
    """One file a task, under a name apart until it is committed."""

    def __init__(self, path: str, overwrite: bool = False) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        fs, base = _at(self.path)
        context = TaskContext.get()
        fs.create_dir(base, recursive=True)
        name, some = f"{base}/_{self.job}-{context.taskAttemptId()}", False
        with fs.open_output_stream(name) as out:
            for row in rows:
                some = True
                out.write((json.dumps(row.asDict(recursive=True), ensure_ascii=False) + "\n").encode())
        if not some:
            fs.delete_file(name)
        return Written(name if some else None, context.partitionId())

    def put(self, messages: list[Written | None], name: str) -> None:
        fs, base = _at(self.path)
        old = _files(self.path) if self.overwrite else {}
        fs.create_dir(base, recursive=True)
        for m in messages:
            if m and m.temporary:
                fs.move(m.temporary, f"{base}/part-{name}-{m.partition:05}.jsonl")
        for file in old:
            fs.delete_file(file)

    def drop(self, messages: list[Written | None]) -> None:
        fs, _ = _at(self.path)
        for m in messages:
            if m and m.temporary:
                fs.delete_file(m.temporary)


class _Writer(_Files, DataSourceWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self.put(messages, self.job)

    def abort(self, messages: list[Written | None]) -> None:
        self.drop(messages)


class _StreamWriter(_Files, DataSourceStreamWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.put(messages, f"{batchId:010}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.drop(messages)


class RecordsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return RECORD

    def _given(self, schema: StructType) -> tuple[str, StructType, int]:
        if not self.options.get("path"):
            raise ValueError("the option path is missing")
        return self.options["path"], schema, int(self.options.get("splitBytes", SPLIT))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(*self._given(schema))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(*self._given(schema))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self._given(schema)[0], overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamWriter(self._given(schema)[0])


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(RecordsSource)
