"""The JSON envelope ``{metadata, created_at, version, data: [...]}`` as a data source.

``spark.read.format("json_envelope")`` and ``df.write.format("json_envelope")`` handle documents
of any size, several tasks both ways. Written, a document is a folder of files which, put one
behind another in the order of their names, are one JSON document: a head, the records, one a line,
and a tail. Tasks write their records to files of their own; the commit, which only sees names and
counts, gives the files their places and writes head and tail last, so a folder with a tail is
whole. Nothing is gathered.

Read, every file of such a document is cut into ranges of bytes, and a task takes the lines that
begin in its range. A document that doesn't keep a record a line, as other programs write it, is
one value and is read by one task. A folder without a tail is refused.

Paths may have any scheme that Arrow's file systems know; a path without one is a local or
mounted folder that all executors share.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from textmatch.config import ship_package

FORMAT = "json_envelope"
VERSION = "1.0"
SPLIT_BYTES = 32 << 20
BATCH = 4096
HEAD, TAIL = "00000000-head.json", "99999999-tail.json"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


@dataclass
class Range(InputPartition):
    """Bytes of a file; ``end`` is -1 for a document that is read whole."""

    file: str
    start: int
    end: int


class EnvelopeReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, split: int):
        self.path, self.schema, self.split = path, schema, split

    def partitions(self) -> list[Range]:
        fs, path = _open(self.path)
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == pafs.FileType.File:
            files = [info]
        else:
            files = sorted(
                (f for f in fs.get_file_info(pafs.FileSelector(path)) if f.is_file and not f.base_name.startswith((".", "_"))),
                key=lambda f: f.base_name,
            )
            if not any(f.base_name == TAIL for f in files):
                if len(files) != 1:
                    raise ValueError(f"{self.path} is not a whole document")
                return [Range(files[0].path, 0, -1)]
        found = []
        for f in files:
            if f.base_name in (HEAD, TAIL):
                continue
            if not self._by_line(fs, f.path):
                found.append(Range(f.path, 0, -1))
                continue
            found += [Range(f.path, at, min(at + self.split, f.size)) for at in range(0, f.size, self.split)]
        return found or [Range("", 0, 0)]

    @staticmethod
    def _by_line(fs: pafs.FileSystem, file: str) -> bool:
        """Whether the file has records only, one a line, as the writer leaves them."""
        with fs.open_input_stream(file) as stream:
            first = stream.read(2)
        return first[:1] == b"," or first[:1] == b" "

    def _records(self, part: Range) -> Iterator[dict]:
        fs, _ = _open(self.path)
        if part.end < 0:
            with fs.open_input_stream(part.file) as stream:
                yield from json.loads(stream.read())["data"]
            return
        with fs.open_input_file(part.file) as raw:
            # The line that begins before the range belongs to the range before.
            at = part.start
            raw.seek(max(0, at - 1))
            lines = _lines(raw, max(0, at - 1))
            if at:
                next(lines, None)
            for begin, line in lines:
                if begin >= part.end:
                    return
                yield json.loads(line[1:])

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        held: list[dict] = []
        if partition.file:
            for record in self._records(partition):
                held.append(record)
                if len(held) == BATCH:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held = []
        yield pa.RecordBatch.from_pylist(held, schema)


def _lines(raw: pa.NativeFile, at: int, size: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(place, line) from where the file stands, without line ends."""
    rest = b""
    while block := raw.read(size):
        *whole, rest = (rest + block).split(b"\n")
        for line in whole:
            yield at, line
            at += len(line) + 1
    if rest:
        yield at, rest


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


def _plain(value):
    if isinstance(value, datetime.datetime | datetime.date):
        return value.isoformat()
    return float(value) if hasattr(value, "as_integer_ratio") else str(value)


class EnvelopeWriter(DataSourceArrowWriter):
    def __init__(self, path: str, metadata: dict[str, str], overwrite: bool):
        self.path, self.metadata, self.overwrite = path, metadata, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = _open(self.path)
        fs.create_dir(f"{path}/_parts", recursive=True)
        file, rows = f"_parts/{uuid.uuid4().hex}", 0
        with fs.open_output_stream(f"{path}/{file}") as out:
            for batch in iterator:
                for record in batch.to_pylist():
                    # What stands before a record is decided for the first one at the commit.
                    out.write(b"," + json.dumps(record, ensure_ascii=False, default=_plain).encode() + b"\n")
                    rows += 1
        return Written(file, rows)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = _open(self.path)
        if self.overwrite:
            for old in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
                if old.is_file:
                    fs.delete_file(old.path)
        fs.create_dir(path, recursive=True)
        kept = [m for m in messages if m is not None and m.rows]
        for i, m in enumerate(kept, 1):
            place = f"{path}/{i:08}-rows.json"
            if i > 1:
                fs.move(f"{path}/{m.file}", place)
                continue
            # Only the first file is copied, as no comma stands before the first record.
            with fs.open_input_stream(f"{path}/{m.file}") as source, fs.open_output_stream(place) as out:
                source.read(1)
                out.write(b" ")
                while block := source.read(1 << 20):
                    out.write(block)
        if fs.get_file_info(f"{path}/_parts").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{path}/_parts")
        now = datetime.datetime.now(datetime.timezone.utc).isoformat()
        head = {"metadata": self.metadata, "created_at": now, "version": VERSION}
        with fs.open_output_stream(f"{path}/{HEAD}") as out:
            out.write(json.dumps(head)[:-1].encode() + b', "data": [\n')
        with fs.open_output_stream(f"{path}/{TAIL}") as out:
            out.write(b"]}\n")

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = _open(self.path)
        for m in messages:
            if m is not None and fs.get_file_info(f"{path}/{m.file}").is_file:
                fs.delete_file(f"{path}/{m.file}")


class Envelope(DataSource):
    """Options: ``path``; for reading ``splitBytes``; for writing ``metadata``, a JSON object."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def reader(self, schema: T.StructType) -> EnvelopeReader:
        return EnvelopeReader(self.options["path"], schema, int(self.options.get("splitBytes", SPLIT_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> EnvelopeWriter:
        return EnvelopeWriter(self.options["path"], json.loads(self.options.get("metadata", "{}")), overwrite)


def register_envelope(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(Envelope)


def write_envelope_table(df: DataFrame, path: str, metadata: dict[str, object] | None = None) -> None:
    """A table of any size as one JSON document, replacing what is at ``path``."""
    register_envelope(df.sparkSession)
    kept = json.dumps({str(k): str(v) for k, v in (metadata or {}).items()})
    df.write.format(FORMAT).option("metadata", kept).mode("overwrite").save(path)


def read_envelope_table(
    spark: SparkSession, path: str, schema: T.StructType | str, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """The records of a JSON document, by several tasks if it keeps one a line."""
    register_envelope(spark)
    return spark.read.format(FORMAT).schema(schema).option("splitBytes", split_bytes).load(path)
