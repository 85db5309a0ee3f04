"""Files of traces of one length as Spark data sources, read in byte ranges and written by many tasks at once.

A file is `skip` bytes and then traces of one size. Partitions are ranges of a file's bytes: a task takes the traces that begin
in its range, so one large file is the work of many tasks, and small files go to a task together; the driver only lists files and
their sizes. Columns that aren't in the schema given to the reader are not made; without samples only headers are read, one after
another where they lie further apart than a few pages.

Writing. A trace's place in its file follows from its row, so tasks write each its own traces at their places in
hidden files, and a trace written again by a repeated task is the same bytes at the same place. The commit, on the driver, writes what stands
before the traces and renames the files; no trace passes through it. Places that no row fills are zero. This needs a file system with
writes at any place, one that all executors share; reading takes any that Arrow knows.
"""

from __future__ import annotations

import os
import uuid
from abc import abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql.datasource import DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of a file to a partition, and of traces held at once.
RANGE_BYTES, STEP_BYTES = 64 << 20, 8 << 20
#: Bytes of small files to a partition, and what a file counts there besides its bytes; headers that lie no further apart are read in one go.
PACK_BYTES, OPEN_BYTES, GAP_BYTES = 16 << 20, 16 << 10, 16 << 10


def local(path: str) -> str:
    """The path of a file or folder that can be written at any place."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    if ":" in path.split("/")[0]:
        raise ValueError(f"{path}: traces are written at their places, for which the file system must be mounted")
    return path


@dataclass
class Span(InputPartition):
    """The traces that begin at bytes from low to high (without it) of a file."""

    path: str
    low: int
    high: int
    size: int

    def __post_init__(self) -> None:
        super().__init__((self.path, self.low, self.high))


@dataclass
class Pack(InputPartition):
    """Small files of one folder, whole: names and sizes."""

    folder: str
    files: list[tuple[str, int]]

    def __post_init__(self) -> None:
        super().__init__(None)

    def spans(self) -> list[Span]:
        return [Span(f"{self.folder}/{name}", 0, size, size) for name, size in self.files]


class TraceReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options
        self.names = [f.name for f in schema.fields]

    def files(self) -> list[tuple[str, int]]:
        path = self.options["path"]
        system, root = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root))
        return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not os.path.basename(f.path).startswith((".", "_")))

    def partitions(self) -> list[InputPartition]:
        step = int(self.options.get("rangebytes", RANGE_BYTES))
        spans, packs, room = [], [], 0
        for path, size in self.files():
            if size > min(step, PACK_BYTES):
                spans += [Span(path, low, min(low + step, size), size) for low in range(0, size, step)]
                continue
            # A file shorter than a trace is read too: the reader says what is wrong with it.
            folder, name = os.path.split(path)
            room -= size + OPEN_BYTES
            if room < 0 or packs[-1].folder != folder:
                packs.append(Pack(folder, []))
                room = min(step, PACK_BYTES) - size - OPEN_BYTES
            packs[-1].files.append((name, size))
        return spans + packs

    @abstractmethod
    def layout(self, read_at, size: int) -> tuple[int, np.dtype, dict]:
        """Bytes before the first trace, what a trace is, and what columns() needs of the file; read_at(place, length) gives bytes."""

    @abstractmethod
    def columns(self, traces: np.ndarray, first: int, of_file: dict) -> dict[str, np.ndarray | pa.Array]:
        """The named columns of some traces, the first of which has that number in its file."""

    def header_bytes(self, kind: np.dtype) -> int:
        """How much of a trace is read where no samples are wanted."""
        return kind.fields["samples"][1]

    def read(self, part: Span | Pack | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no files
            return
        few, rows = [], 0
        for span in part.spans() if isinstance(part, Pack) else [part]:
            for batch in self._read(span):
                few.append(batch)
                rows += batch.nbytes
                if rows >= STEP_BYTES // 4:
                    yield _one(few)
                    few, rows = [], 0
        if few:
            yield _one(few)

    def _read(self, span: Span) -> Iterator[pa.RecordBatch]:
        path, self.path = self.options["path"], span.path
        system = fs.FileSystem.from_uri(path)[0] if ":" in path.split("/")[0] else fs.LocalFileSystem()
        with system.open_input_file(span.path) as source:

            def read_at(place: int, length: int) -> bytes:
                source.seek(place)
                return source.read(length)

            skip, kind, of_file = self.layout(read_at, span.size)
            size = kind.itemsize
            whole = max(0, span.size - skip) // size
            first, last = (min(whole, max(0, -(-(at - skip) // size))) for at in (span.low, span.high))
            schema = pa.schema([(n, _arrow(self.schema[n])) for n in self.names])
            for k in range(first, last, max(1, STEP_BYTES // size)):
                n = min(last - k, max(1, STEP_BYTES // size))
                if "samples" in self.names or (self.header_bytes(kind) and size <= GAP_BYTES):
                    traces = np.frombuffer(read_at(skip + k * size, n * size), kind)
                else:
                    traces = np.zeros(n, kind)
                    raw, head = traces.view(np.uint8).reshape(n, size), self.header_bytes(kind)
                    for i in range(n if head else 0):
                        raw[i, :head] = np.frombuffer(read_at(skip + (k + i) * size, head), np.uint8)
                found = self.columns(traces, k, of_file)
                keep = found.pop("__keep", None)
                columns = [pa.array(found[c], schema.field(c).type) if isinstance(found[c], np.ndarray) else found[c] for c in self.names]
                batch = pa.RecordBatch.from_arrays(columns, schema=schema)
                yield batch if keep is None else batch.filter(pa.array(keep))


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else next(iter(pa.Table.from_batches(batches).combine_chunks().to_batches()), batches[0])


def _arrow(f) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(f.dataType)


def samples_column(samples: np.ndarray) -> pa.Array:
    """Rows of samples as an array column of 32-bit floats."""
    flat = pa.array(np.ascontiguousarray(samples, "<f4").reshape(-1))
    return pa.FixedSizeListArray.from_arrays(flat, samples.shape[1]).cast(pa.list_(pa.float32())) if samples.shape[1] else pa.array([[]] * len(samples), pa.list_(pa.float32()))


def put_samples(column: pa.Array, out: np.ndarray) -> None:
    """Rows of an array column into rows of samples; what is longer is cut, what is shorter or null is zero."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values, wide = column.flatten().to_numpy(zero_copy_only=False), out.shape[1]
    if len(lengths) and (lengths == lengths[0]).all():
        n = min(int(lengths[0]), wide)
        out[:, :n] = values.reshape(len(lengths), -1)[:, :n]
        return
    rows = np.repeat(np.arange(len(lengths)), lengths)
    places = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    kept = places < wide
    out[rows[kept], places[kept]] = values[kept]


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: traces, and the least and greatest sample, by file."""

    files: dict[str, tuple[int, float, float]] = field(default_factory=dict)


class TraceWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.options = options
        self.names = [f.name for f in schema.fields]
        self.folder = local(options["path"])
        if os.path.exists(self.folder) and os.listdir(self.folder) and not overwrite:
            raise FileExistsError(self.folder)
        self.hidden = f"{self.folder.rstrip('/')}/_writing-{uuid.uuid4().hex}"
        os.makedirs(self.hidden, exist_ok=True)

    @abstractmethod
    def place(self) -> tuple[int, np.dtype]:
        """Bytes before the first trace, and what a trace is."""

    @abstractmethod
    def fill(self, batch: pa.RecordBatch, out: np.ndarray) -> np.ndarray:
        """Puts the rows of a batch into traces; their numbers in their files."""

    @abstractmethod
    def before(self, least: float, greatest: float) -> bytes:
        """What stands before the traces of a file with such samples."""

    def whole(self) -> int | None:
        """Traces of a file, if all have as many."""
        return None

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        skip, kind = self.place()
        done, open_files = Written(), {}
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                out = np.zeros(batch.num_rows, kind)
                numbers = np.asarray(self.fill(batch, out), np.int64)
                coded = batch.column(self.names.index("file")).dictionary_encode()
                names, codes = coded.dictionary.to_pylist() + [None], pc.fill_null(coded.indices, -1).to_numpy()
                if (numbers < 0).any() or (self.whole() is not None and (numbers >= self.whole()).any()):
                    raise ValueError("a trace lies outside its file")
                # Neighbours in a file are written in one go.
                order = np.lexsort((numbers, codes))
                ends = np.flatnonzero((np.diff(numbers[order]) != 1) | (np.diff(codes[order]) != 0)) + 1
                for rows in np.split(order, ends):
                    name = names[codes[rows[0]]]
                    if name is None or name != os.path.basename(name) or name.startswith((".", "_")):
                        raise ValueError(f"{name!r} can't be a file's name")
                    if name not in open_files:
                        if len(open_files) >= 100:
                            os.close(open_files.pop(next(iter(open_files))))
                        open_files[name] = os.open(f"{self.hidden}/{name}", os.O_WRONLY | os.O_CREAT, 0o644)
                    os.pwrite(open_files[name], out[rows].tobytes(), skip + int(numbers[rows[0]]) * kind.itemsize)
                    s = out["samples"][rows]
                    n, least, greatest = done.files.get(name, (0, np.inf, -np.inf))
                    done.files[name] = (n + len(rows), min(least, float(s.min(initial=np.inf))), max(greatest, float(s.max(initial=-np.inf))))
        finally:
            for f in open_files.values():
                os.close(f)
        return done

    def commit(self, messages: list[Written | None]) -> None:
        total: dict[str, tuple[int, float, float]] = {}
        for m in messages:
            for name, (n, least, greatest) in (m.files if m else {}).items():
                had = total.get(name, (0, np.inf, -np.inf))
                total[name] = (had[0] + n, min(had[1], least), max(had[2], greatest))
        skip, kind = self.place()
        for name, (n, least, greatest) in total.items():
            if self.whole() is not None and n < self.whole():  # what no row fills is zero
                least, greatest = min(least, 0.0), max(greatest, 0.0)
            at = f"{self.hidden}/{name}"
            f = os.open(at, os.O_WRONLY)
            try:
                os.pwrite(f, self.before(least, greatest), 0)
                if self.whole() is not None:
                    os.ftruncate(f, skip + self.whole() * kind.itemsize)
            finally:
                os.close(f)
            os.replace(at, f"{self.folder}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        for name in os.listdir(self.hidden):
            os.unlink(f"{self.hidden}/{name}")
        os.rmdir(self.hidden)
