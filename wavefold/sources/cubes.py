"""Binary cubes: a header of 128 words and float samples, depth fastest.

Cubes are a data source: read in byte ranges, a row a trace (path, iy, ix, x, y, samples), and written by many tasks into one
file (ranges.py). Byte order is judged by whether the x spacing is plausible.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource
from pyspark.sql.types import StructType

from wavefold.sources.ranges import RANGE_BYTES, TraceReader, TraceWriter, put_samples, samples_column

# Fixed values of the file format: words of the header by position, its magic and its units.
HEADER_BYTES = 512
FIELDS = {"x0": (0, "f"), "nx": (1, "i"), "dx": (2, "f"), "y0": (3, "f"), "ny": (4, "i"), "dy": (5, "f"), "z0": (6, "f"), "nz": (7, "i"), "dz": (8, "f"), "vmin": (12, "f"), "vmax": (13, "f"), "first_x": (14, "i"), "first_y": (15, "i"), "step_x": (16, "i"), "step_y": (17, "i")}
MAGIC, VERSION, DISTANCE_UNIT, ANGLE_UNIT = b"SFDM", 2, 1, 2
PLAUSIBLE_STEP = (1.0, 100_000.0)


def read_header(raw: bytes) -> dict:
    """Header fields and `order`, the byte order ("<" or ">") that makes dx plausible; little-endian if neither does."""
    order = next((o for o in "<>" if PLAUSIBLE_STEP[0] <= struct.unpack_from(o + "f", raw, 8)[0] <= PLAUSIBLE_STEP[1]), "<")
    return {name: struct.unpack_from(order + kind, raw, 4 * word)[0] for name, (word, kind) in FIELDS.items()} | {"order": order}


def header_bytes(header: dict) -> bytes:
    raw = bytearray(HEADER_BYTES)
    for name, (word, kind) in FIELDS.items():
        struct.pack_into("<" + kind, raw, 4 * word, header.get(name, 0))
    raw[72:76] = MAGIC
    struct.pack_into("<iii", raw, 76, VERSION, DISTANCE_UNIT, ANGLE_UNIT)
    return bytes(raw)


class CubeReader(TraceReader):
    """Traces of cubes with a header, or of raw ones, whose options nx, ny, nz, order say what a header would."""

    def layout(self, read_at: Callable[[int, int], bytes], size: int) -> tuple[int, np.dtype, dict]:
        o = self.options
        raw = "nz" in o
        h = {"nx": int(o["nx"]), "ny": int(o["ny"]), "nz": int(o["nz"]), "order": o.get("order", "<"), "x0": 0.0, "dx": 1.0, "y0": 0.0, "dy": 1.0} if raw else read_header(read_at(0, HEADER_BYTES))
        skip = 0 if raw else HEADER_BYTES
        if size < skip + 4 * h["nx"] * h["ny"] * h["nz"]:
            raise ValueError(f"a cube of {h['nx']} x {h['ny']} x {h['nz']} samples ends too early")
        return skip, np.dtype([("samples", h["order"] + "f4", (h["nz"],))]), h

    def columns(self, traces: np.ndarray, first: int, of_file: dict) -> dict[str, np.ndarray | pa.Array]:
        n, o, h = first + np.arange(len(traces)), self.options, of_file
        iy, ix = n // h["nx"], n % h["nx"]
        (x0, y0, z0), (rx, ry, rz) = (json.loads(o.get(k, d)) for k, d in (("offsets", "[0, 0, 0]"), ("ratios", "[1, 1, 1]")))
        keep = (iy < h["ny"]) & (ix >= x0) & (iy >= y0) & ((ix - x0) % rx == 0) & ((iy - y0) % ry == 0)
        out = {"path": pa.array([self.path] * len(n)), "iy": (iy - y0) // ry, "ix": (ix - x0) // rx, "x": h["x0"] + ix * float(h["dx"]), "y": h["y0"] + iy * float(h["dy"]), "__keep": keep}
        return out | ({"samples": samples_column(traces["samples"][:, z0::rz])} if "samples" in self.names else {})


class CubeWriter(TraceWriter):
    """Rows (file, iy, ix, samples) to a cube each file; the header's fields are options."""

    def header(self) -> dict:
        return json.loads(self.options["header"])

    def place(self) -> tuple[int, np.dtype]:
        return HEADER_BYTES, np.dtype([("samples", "<f4", (self.header()["nz"],))])

    def whole(self) -> int:
        h = self.header()
        return h["nx"] * h["ny"]

    def fill(self, batch: pa.RecordBatch, out: np.ndarray) -> np.ndarray:
        h = self.header()
        iy, ix = (batch.column(self.names.index(c)).to_numpy(zero_copy_only=False) for c in ("iy", "ix"))
        if ((ix < 0) | (ix >= h["nx"])).any():
            raise ValueError("a trace lies outside its cube")
        put_samples(batch.column(self.names.index("samples")), out["samples"])
        return iy * h["nx"] + ix

    def before(self, least: float, greatest: float) -> bytes:
        return header_bytes(self.header() | {"vmin": least, "vmax": greatest})


class CubeSource(DataSource):
    """spark.read.format("wavefold_cube") and its writer."""

    @classmethod
    def name(cls) -> str:
        return "wavefold_cube"

    def schema(self) -> str:
        return CUBE

    def reader(self, schema: StructType) -> CubeReader:
        return CubeReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> CubeWriter:
        return CubeWriter(schema, dict(self.options), overwrite)


CUBE = "path string, iy int, ix int, x double, y double, samples array<float>"


def read_cubes(spark: SparkSession, path: str, stride: int = 1, range_bytes: int = RANGE_BYTES, columns: list[str] | None = None) -> DataFrame:
    """One row a trace of each file in path: path, iy, ix, x, y, samples; every stride-th line in x and y, with the numbers it has in the file. Only the named columns are made."""
    spark.dataSource.register(CubeSource)
    kinds = dict(c.split(" ") for c in CUBE.split(", "))
    rows = spark.read.format("wavefold_cube").schema(", ".join(f"{c} {kinds[c]}" for c in columns or kinds)).option("rangeBytes", range_bytes).load(path)
    return rows.filter((F.pmod("iy", F.lit(stride)) == 0) & (F.pmod("ix", F.lit(stride)) == 0)) if stride > 1 else rows


def write_cubes(traces: DataFrame, path: str, header: dict) -> None:
    """A cube for each file of traces (file, iy, ix, samples) in the folder path, written by all tasks at once. Missing traces and samples are zero; header needs nx, ny, nz, and takes the least and greatest sample."""
    traces.sparkSession.dataSource.register(CubeSource)
    traces.select("file", F.col("iy").cast("int"), F.col("ix").cast("int"), F.col("samples").cast("array<float>")).write.format("wavefold_cube").mode("append").option("header", json.dumps(header)).save(path)


def read_raw_cube(spark: SparkSession, path: str, shape: tuple[int, int, int], offsets: tuple[int, int, int] = (0, 0, 0), ratios: tuple[int, int, int] = (1, 1, 1), order: str = "<", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row (iy, ix, samples) a trace of a cube without header, depth fastest; shape, offsets and ratios in x, y, z. A file is read in ranges of whole traces by many tasks, whatever its size; every ratios-th
    place from its offset on is kept."""
    spark.dataSource.register(CubeSource)
    options = dict(zip(("nx", "ny", "nz"), shape, strict=True)) | {"order": order, "offsets": json.dumps(offsets), "ratios": json.dumps(ratios), "rangeBytes": range_bytes}
    return spark.read.format("wavefold_cube").schema("iy int, ix int, samples array<float>").options(**options).load(path)


def cube_range(traces: DataFrame, key: str) -> DataFrame:
    """The least and greatest sample of each cube of traces (key, samples)."""
    return traces.groupBy(key).agg(F.min(F.array_min("samples")).alias("vmin"), F.max(F.array_max("samples")).alias("vmax"))


def checked_velocity(traces: DataFrame, least: float = 100.0) -> DataFrame:
    """Traces of velocities; a value that is null, not finite or too small is an error where it is read."""
    fine = F.forall("samples", lambda v: v.isNotNull() & ~F.isnan(v) & (v < float("inf")) & (v >= least))
    return traces.filter(F.assert_true(fine, "a velocity is not finite or too small").isNull())


def load_model(spark: SparkSession, path: str, velocity: bool = False, shape: tuple[int, int, int] | None = None) -> DataFrame:
    """A model's traces by its path's suffix: .fdm a cube with header, .bin one without (shape is needed), .parquet a table of traces (iy, ix, samples)."""
    if path.endswith(".fdm"):
        traces = read_cubes(spark, path).select("iy", "ix", "samples")
    elif path.endswith(".bin"):
        if shape is None:
            raise ValueError("a cube without header needs its shape")
        traces = read_raw_cube(spark, path, shape)
    elif path.endswith(".parquet"):
        traces = spark.read.parquet(path).select("iy", "ix", "samples")
    else:
        raise ValueError(f"no model format is known for {path}")
    return checked_velocity(traces) if velocity else traces
