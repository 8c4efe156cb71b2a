"""Statement CSVs as a Spark format of their own.

    spark.dataSource.register(StatementCsv)
    spark.read.format("statement_csv").load(folder)
    rows.write.format("statement_csv").mode("append").save(folder)

Reading: one row for each record, in the order of the file (seq from 1), whatever the partitions; quoted fields may hold commas,
quotes and line breaks; columns may stand in any order, others are left out. A file that can't be read as such (not UTF-8, a
column missing, no record, a quote that doesn't close, a record with too many fields) is one row with the `problem`.

Writing: each `source_file` becomes one CSV. Tasks write below a temporary folder of the job; files appear when all tasks are
done, and none do if one fails. Rows of a file must come together, in order: repartition by source_file and sort by seq.

Folders are local paths or addresses that Arrow can open. Where only Spark can read, `verified_csv.read_files` brings the bytes
and the same records are made of them.
"""

from __future__ import annotations

import csv
import hashlib
import io
import posixpath
import re
import sys
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Columns of the template; the first eight are the same in every row of a file.
COLUMNS = ["account_id", "currency", "period_start", "period_end", "opening_balance", "closing_balance", "expected_debits", "expected_credits",
           "date", "description", "debit", "credit", "balance"]
SCHEMA = "source_file string, sha256 string, seq int, " + ", ".join(f"{c} string" for c in COLUMNS) + ", problem string"
#: Bytes of files that one task reads, about.
TASK_BYTES = 32 << 20
_ARROW = pa.schema([("source_file", pa.string()), ("sha256", pa.string()), ("seq", pa.int32()), *[(c, pa.string()) for c in COLUMNS], ("problem", pa.string())])


def records(data: bytes) -> Iterator[list[str]]:
    """The records of a file, each with the fields of COLUMNS; ValueError says what is wrong with it."""
    csv.field_size_limit(sys.maxsize)
    try:
        lines = csv.reader(io.StringIO(data.decode("utf-8-sig"), newline=""), strict=True)
        header = next((x for x in lines if x), [])
        names = [x.strip() for x in header]
        if missing := [c for c in COLUMNS if c not in names]:
            raise ValueError(f"columns missing: {', '.join(sorted(missing))}")
        places = [names.index(c) for c in COLUMNS]
        as_is = names == COLUMNS
        found = False
        for fields in lines:
            if not fields:
                continue  # a blank line
            if len(fields) > len(names):
                raise ValueError(f"line {lines.line_num}: {len(fields)} fields under {len(names)} columns")
            found = True
            if as_is and len(fields) == len(COLUMNS):
                yield fields
                continue
            yield [fields[i] if i < len(fields) else "" for i in places]
        if not found:
            raise ValueError("no transactions: a statement without activity needs a review of its own")
    except UnicodeDecodeError as error:
        raise ValueError("not UTF-8") from error
    except csv.Error as error:
        raise ValueError(f"not a CSV: {error}") from error


def batch_of(source_file: str, data: bytes) -> pa.RecordBatch:
    """The rows of one file; a broken file is one row."""
    sha = hashlib.sha256(data).hexdigest()
    try:
        rows = list(records(data))
        n, seq, own, problem = len(rows), range(1, len(rows) + 1), [pa.array(c, pa.string()) for c in zip(*rows, strict=True)], None
    except ValueError as error:
        n, seq, own, problem = 1, [None], [pa.nulls(1, pa.string())] * len(COLUMNS), str(error)
    same = lambda x: pa.repeat(pa.scalar(x, pa.string()), n)
    return pa.RecordBatch.from_arrays([same(source_file), same(sha), pa.array(seq, pa.int32()), *own, same(problem)], schema=_ARROW)


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"[a-z][a-z0-9+.-]+://", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub(r"^file:", "", path)


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class StatementCsvReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Files]:
        """Files in packs of about TASK_BYTES; a folder without files is one empty pack."""
        store, root = open_folder(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        own = sorted((f for f in found if f.is_file and f.path.endswith(".csv") and "/_" not in f.path), key=lambda f: f.path)
        packs, held, size = [], [], 0
        for f in own:
            if held and size + f.size > TASK_BYTES:
                packs.append(Files(tuple(held)))
                held, size = [], 0
            held.append(f.path)
            size += f.size
        return [*packs, Files(tuple(held))]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = open_folder(self.path)
        for path in partition.paths:
            with store.open_input_file(path) as f:
                yield batch_of(path, f.read())


@dataclass
class Written(WriterCommitMessage):
    """Names of files, and where a task wrote them."""

    files: dict[str, str]


class StatementCsvWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _temporary(self, root: str) -> str:
        return posixpath.join(root, "_temporary", self.job)

    def write(self, iterator: Iterator[Row]) -> Written:
        return self._write((row.source_file, [[row[c] for c in COLUMNS]]) for row in iterator)

    def _write(self, pieces: Iterator[tuple[str, Iterable[Sequence[str | None]]]]) -> Written:
        """Pieces of files: a name and records, null as empty."""
        store, root = open_folder(self.path)
        folder = posixpath.join(self._temporary(root), uuid.uuid4().hex)  # of this attempt
        store.create_dir(folder, recursive=True)
        files: dict[str, str] = {}
        name = out = sink = None
        try:
            for own, rows in pieces:
                if own != name:
                    if sink is not None:
                        sink.close()
                    name = own
                    if not name or "/" in name or name in files:
                        raise ValueError(f"{name}: a file needs a plain name, and its rows must come together")
                    files[name] = posixpath.join(folder, name)
                    sink = io.TextIOWrapper(store.open_output_stream(files[name]), "utf-8", newline="")
                    out = csv.writer(sink)
                    out.writerow(COLUMNS)
                out.writerows(rows)
        finally:
            if sink is not None:
                sink.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = open_folder(self.path)
        names = [name for m in messages if m for name in m.files]
        if len(names) != len(set(names)):
            self.abort(messages)
            raise ValueError("rows of one file came to several tasks")
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(root)):
                if old.is_file and old.base_name.endswith(".csv"):
                    store.delete_file(old.path)
        for m in messages:
            for name, path in (m.files if m else {}).items():
                store.move(path, posixpath.join(root, name))
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*open_folder(self.path))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(self._temporary(root)).type != fs.FileType.NotFound:
            store.delete_dir(self._temporary(root))
        parent = posixpath.join(root, "_temporary")
        if store.get_file_info(parent).type != fs.FileType.NotFound and not store.get_file_info(fs.FileSelector(parent)):
            store.delete_dir(parent)


class StatementCsvArrowWriter(StatementCsvWriter, DataSourceArrowWriter):
    """The same over Arrow batches: rows of a file are written as a piece, not turned into Rows one by one."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self._write(piece for batch in iterator for piece in _pieces(batch))


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[str, Iterable[Sequence[str | None]]]]:
    runs = pc.run_end_encode(batch.column("source_file"))
    columns, begin = [batch.column(c).to_pylist() for c in COLUMNS], 0
    for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
        yield name, zip(*[c[begin:end] for c in columns], strict=True)
        begin = end


class StatementCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return "statement_csv"

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        if "path" not in self.options:
            raise ValueError("name a folder or a file: load(path) or save(path)")
        return self.options["path"]

    def reader(self, schema: StructType) -> StatementCsvReader:
        return StatementCsvReader(self._path())

    def writer(self, schema: StructType, overwrite: bool) -> StatementCsvWriter:
        if missing := [c for c in ("source_file", *COLUMNS) if c not in schema.names]:
            raise ValueError(f"columns missing: {', '.join(missing)}")
        return StatementCsvArrowWriter(self._path(), overwrite)
