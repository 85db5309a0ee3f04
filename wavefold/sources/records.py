"""Trace records: fixed-length headers and float samples, laid out as a job declares.

Records are a data source: read in byte ranges, a row a trace (path, ordinal, the declared fields, samples), and written by many
tasks into one file a shot (ranges.py). Without samples only headers are read.
"""

from __future__ import annotations

import json
import shutil
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource
from pyspark.sql.types import StructType

from wavefold.sources.ranges import RANGE_BYTES, TraceReader, TraceWriter, local, put_samples, samples_column
from wavefold.sources.tables import shared_folder

#: Bytes of records that stand at once in through_records().
ROUND_BYTES = 4 << 30

TYPES = {"int": ("i4", "int"), "short": ("i2", "int"), "float": ("f4", "double"), "double": ("f8", "double")}

# Types of the fields that a job may place, and where lines are if it doesn't say (first byte counted from 1).
FIELD_TYPES = {"shot_id": "int", "recv_id": "int", "sx": "double", "sy": "double", "sz": "float", "rx": "double", "ry": "double", "rz": "float", "xline": "int", "iline": "int"}
LINES = {"xline": 193, "iline": 189}


@dataclass(frozen=True)
class Layout:
    """Where a record's fields are: name to (first byte counted from 1, type); header length and samples of a trace; byte order."""

    fields: dict[str, tuple[int, str]]
    samples: int
    header: int = 240
    skip: int = 0
    order: str = ">"

    def dtype(self) -> np.dtype:
        names = [*self.fields, "samples"]
        formats = [*(self.order + TYPES[kind][0] for _, kind in self.fields.values()), (self.order + "f4", (self.samples,))]
        return np.dtype({"names": names, "formats": formats, "offsets": [*(at - 1 for at, _ in self.fields.values()), self.header], "itemsize": self.header + 4 * self.samples})


def job_layout(places: dict[str, int], samples: int, types: dict[str, str] | None = None, **rest: int | str) -> Layout:
    """The layout of a job that places some fields; lines have places of their own, and all have types that types may replace."""
    unknown = set(places) - set(FIELD_TYPES)
    if unknown:
        raise ValueError(f"no such field: {', '.join(sorted(unknown))}")
    kinds = FIELD_TYPES | (types or {})
    return Layout({name: (at, kinds[name]) for name, at in (LINES | places).items() if at > 0}, samples, **rest)


def _layout(options: dict) -> Layout:
    return _said(options["layout"])


@lru_cache
def _said(text: str) -> Layout:
    said = json.loads(text)
    return Layout(**said | {"fields": {n: tuple(f) for n, f in said["fields"].items()}})


class RecordReader(TraceReader):
    def layout(self, read_at: Callable[[int, int], bytes], size: int) -> tuple[int, np.dtype, dict]:
        said = _layout(self.options)
        return said.skip, said.dtype(), {"fields": said.fields}

    def header_bytes(self, kind: np.dtype) -> int:
        wanted = [kind.fields[n] for n in self.names if n in kind.fields]
        return max((at + k.itemsize for k, at, *_ in wanted), default=0)

    def columns(self, traces: np.ndarray, first: int, of_file: dict) -> dict[str, np.ndarray | pa.Array]:
        out = {"ordinal": first + np.arange(len(traces)), "path": pa.array([self.path] * len(traces))}
        out |= {n: traces[n].astype(TYPES[kind][0]) for n, (_, kind) in of_file["fields"].items() if n in self.names}
        return out | ({"samples": samples_column(traces["samples"])} if "samples" in self.names else {})


class RecordWriter(TraceWriter):
    """Rows (file, ordinal, fields, samples) to a record each file, a trace at the place of its ordinal."""

    def place(self) -> tuple[int, np.dtype]:
        said = _layout(self.options)
        return said.skip, said.dtype()

    def fill(self, batch: pa.RecordBatch, out: np.ndarray) -> np.ndarray:
        for name in _layout(self.options).fields:
            out[name] = batch.column(self.names.index(name)).to_numpy(zero_copy_only=False)
        put_samples(batch.column(self.names.index("samples")), out["samples"])
        return batch.column(self.names.index("ordinal")).to_numpy(zero_copy_only=False)

    def before(self, least: float, greatest: float) -> bytes:
        return bytes(_layout(self.options).skip)


class RecordSource(DataSource):
    """spark.read.format("wavefold_records") and its writer; the layout is an option."""

    @classmethod
    def name(cls) -> str:
        return "wavefold_records"

    def schema(self) -> str:
        return _columns(_layout(self.options))

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(schema, dict(self.options), overwrite)


def _columns(layout: Layout, header_only: bool = False) -> str:
    return "path string, ordinal bigint, " + ", ".join(f"`{n}` {TYPES[t][1]}" for n, (_, t) in layout.fields.items()) + ", samples array<float>" * (not header_only)


def read_records(spark: SparkSession, path: str, layout: Layout, header_only: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A row for each trace of the files in path: path, ordinal, the declared fields and, unless headers are enough, samples. A rest shorter than a trace is left out."""
    spark.dataSource.register(RecordSource)
    return spark.read.format("wavefold_records").schema(_columns(layout, header_only)).option("layout", json.dumps(asdict(layout))).option("rangeBytes", range_bytes).load(path)


def write_records(traces: DataFrame, path: str, layout: Layout) -> None:
    """A record for each file of traces (file, ordinal from 0, the declared fields, samples) in the folder path, written by all tasks at once. Missing samples, and ordinals that no row has, are zero."""
    traces.sparkSession.dataSource.register(RecordSource)
    fields = [F.coalesce(F.col(n), F.lit(0)).cast(TYPES[kind][1]).alias(n) for n, (_, kind) in layout.fields.items()]
    rows = traces.select("file", F.col("ordinal").cast("bigint"), *fields, F.col("samples").cast("array<float>"))
    rows.write.format("wavefold_records").mode("append").option("layout", json.dumps(asdict(layout))).save(path)


def through_records(traces: DataFrame, layout: Layout, result: Callable[[DataFrame], DataFrame], header_only: bool = False) -> DataFrame:
    """What result makes of the records that write_records() writes of traces and read_records() reads, files being apart from each other: result may count on whole files, not on all of them.

    Records are far larger than the rows they come from, so files go in rounds of about ROUND_BYTES, all of a file in one: the rows of a round stay as a table, and its files are removed before the next is written."""
    spark = traces.sparkSession
    rounds = max(1, -(-traces.count() * layout.dtype().itemsize // ROUND_BYTES))
    if rounds == 1:
        write_records(traces, folder := shared_folder(spark, "records"), layout)
        return result(read_records(spark, folder, layout, header_only))
    kept = shared_folder(spark, "through")
    for k in range(rounds):
        write_records(traces.filter(F.pmod(F.xxhash64("file"), F.lit(rounds)) == k), folder := shared_folder(spark, "records"), layout)
        out = result(read_records(spark, folder, layout, header_only))
        out.write.mode("append").parquet(kept)
        shutil.rmtree(local(folder))
    return spark.read.schema(out.schema).parquet(kept)


def scale_headers(traces: DataFrame, xy: list[str], scalar: float, z: list[str], shift: float) -> DataFrame:
    """Coordinates times a scalar, elevations less a shift."""
    return traces.withColumns({c: F.col(c) * scalar for c in xy} | {c: F.col(c) - shift for c in z})
