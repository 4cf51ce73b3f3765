"""Binary files of fixed-length records as a Spark data source that splits them by byte ranges.

``record_image`` is an image of records: a 64-bit count, then little-endian structs
with C alignment. ``int8_matrix`` is a row-major matrix of signed bytes. A path may
be one file of any size or a folder, whose files are taken in order of their names;
names that begin with ``_`` or ``.`` are left out. Each range of about ``range_bytes``
is a task of its own, begins and ends between records, and is read in parts of
``PART`` bytes. The planner lists files and their sizes, and reads none of them.

Writing gives a folder: each task writes whole files of at most ``range_bytes``,
under hidden names until the job commits, so that a lost executor or a failed
attempt leaves nothing behind that would be read. Paths are opened by Arrow, by
their URI.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

RANGE_BYTES = 64 << 20
PART = 4 << 20
KINDS = {"long": "<i8", "int": "<i4"}


def record_type(fields: tuple) -> np.dtype:
    """The numpy type of a record: little-endian, with C alignment."""
    return np.dtype([(n, KINDS[t]) for n, t in fields], align=True)


def place_of(path: str):
    """The Arrow file system of a path and the path inside it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files of a folder in order of their names."""
    from pyarrow import fs

    place, inside = place_of(path)
    about = place.get_file_info(inside)
    if about.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [about] if about.type == fs.FileType.File else place.get_file_info(fs.FileSelector(inside))
    return [(x.path, x.size) for x in sorted(found, key=lambda x: x.path) if x.type == fs.FileType.File and x.base_name[0] not in "_."]


@dataclass
class Range(InputPartition):
    """Records ``first`` to ``last`` of a file, and how many records stand before it in earlier files."""

    path: str
    first: int
    last: int
    before: int


class _Reader(DataSourceReader):
    header = 0

    def __init__(self, options: dict, record_bytes: int):
        self.path, self.record_bytes = options["path"], record_bytes
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        step, before, out = max(1, self.range_bytes // self.record_bytes), 0, []
        for path, size in files_of(self.path):
            n = max(0, size - self.header) // self.record_bytes
            out += [Range(path, a, min(n, a + step), before) for a in range(0, n, step)]
            before += n
        return out or [Range("", 0, 0, 0)]

    def _parts(self, part: Range) -> Iterator[tuple[int, bytes]]:
        """(number of the first record in the file, bytes of whole records) of a range."""
        if part.first == part.last:
            return
        place, _ = place_of(self.path)
        step = max(1, PART // self.record_bytes)
        with place.open_input_file(part.path) as f:
            last = min(part.last, self.records(f))
            for a in range(part.first, last, step):
                b = min(last, a + step)
                yield a, f.read_at((b - a) * self.record_bytes, self.header + a * self.record_bytes)

    def records(self, f) -> int:
        return (f.size() - self.header) // self.record_bytes


class _ImageReader(_Reader):
    header = 8

    def __init__(self, options: dict, fields: tuple):
        self.kind = record_type(fields)
        super().__init__(options, self.kind.itemsize)

    def records(self, f) -> int:
        return min(super().records(f), int.from_bytes(f.read_at(8, 0), "little"))

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for _, data in self._parts(partition):
            found = np.frombuffer(data, self.kind)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[n])) for n in self.kind.names], names=list(self.kind.names))


class _MatrixReader(_Reader):
    def __init__(self, options: dict):
        self.cols = int(options["cols"])
        super().__init__(options, self.cols)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for a, data in self._parts(partition):
            values = np.frombuffer(data, np.int8).astype(np.int64)
            at = np.arange(len(values)) + (partition.before + a) * self.cols
            yield pa.RecordBatch.from_arrays([pa.array(at // self.cols), pa.array(at % self.cols), pa.array(values)], names=["i", "j", "v"])


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, fields: tuple | None, overwrite: bool):
        self.path, self.fields, self.overwrite = options["path"], fields, overwrite
        self.job = uuid.uuid4().hex[:12]
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))

    def _bytes(self, table: pa.Table) -> tuple[bytes, int]:
        if self.fields is None:
            return np.column_stack([c.to_numpy().astype(np.int8) for c in table.columns]).tobytes(), table.num_columns
        kind = record_type(self.fields)
        out = np.zeros(table.num_rows, kind)
        for n in kind.names:
            out[n] = table.column(n).to_numpy()
        return out.tobytes(), kind.itemsize

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        place, inside = place_of(self.path)
        place.create_dir(inside, recursive=True)
        attempt, task = uuid.uuid4().hex[:8], TaskContext.get().partitionId()
        names, held, size = [], [], 0

        def flush() -> None:
            names.append(f"part-{self.job}-{task:06d}-{len(names):06d}-{attempt}.bin")
            with place.open_output_stream(f"{inside}/_{names[-1]}") as out:
                if self.fields is not None:
                    out.write((size // record_type(self.fields).itemsize).to_bytes(8, "little"))
                for data in held:
                    out.write(data)

        for batch in iterator:
            data, width = self._bytes(pa.Table.from_batches([batch]))
            room = max(width, self.range_bytes // width * width)
            for a in range(0, len(data), room):
                piece = data[a : a + room]
                if held and size + len(piece) > room:
                    flush()
                    held, size = [], 0
                held.append(piece)
                size += len(piece)
        if held:
            flush()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        place, inside = place_of(self.path)
        place.create_dir(inside, recursive=True)
        if self.overwrite:
            for path, _ in files_of(self.path):
                place.delete_file(path)
        for m in messages:
            for name in m.names if m else []:
                place.move(f"{inside}/_{name}", f"{inside}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        place, inside = place_of(self.path)
        for m in messages:
            for name in m.names if m else []:
                place.delete_file(f"{inside}/_{name}")


class RecordImage(DataSource):
    """Options: path, fields (``name:long`` or ``name:int``, joined by commas), range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "record_image"

    def fields(self) -> tuple:
        return tuple(tuple(x.split(":")) for x in self.options["fields"].split(","))

    def schema(self) -> str:
        return ", ".join(f"{n} {t}" for n, t in self.fields())

    def reader(self, schema) -> _ImageReader:
        return _ImageReader(self.options, self.fields())

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, self.fields(), overwrite)


class Int8Matrix(DataSource):
    """Options: path, cols, range_bytes. Rows are read as (i, j, v) and written as one column for each column of the matrix."""

    @classmethod
    def name(cls) -> str:
        return "int8_matrix"

    def schema(self) -> str:
        return "i long, j long, v long"

    def reader(self, schema) -> _MatrixReader:
        return _MatrixReader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, None, overwrite)


def register(spark) -> None:
    for kind in (RecordImage, Int8Matrix):
        spark.dataSource.register(kind)
