"""Receiver operators in frequency and wavenumber.

Traces of a line of receivers are transformed over time inside Arrow batches, dealt to frequencies by a shuffle, transformed over
receivers, multiplied by a weight for each frequency and wavenumber, and brought back the same way. A shuffle moves each
sample once; a row is one trace or one frequency of one line, and lines and frequencies are the work of all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Weight = Callable[[np.ndarray, np.ndarray], np.ndarray]


def obliquity(velocity: float, power: float = 1.0, depth: float = 0.0, floor: float = 0.1) -> Weight:
    """The cosine of the angle from the vertical to a power; with a depth below the surface also over the magnitude of sin(kz depth), no less than the floor, which takes the ghost's notches out. What doesn't propagate is cut, frequency by frequency."""

    def weight(w: np.ndarray, k: np.ndarray) -> np.ndarray:
        kz2 = (w / velocity) ** 2 - k**2
        kz = np.sqrt(np.maximum(kz2, 0.0))
        cosine = np.divide(kz * velocity, w, out=np.zeros(np.broadcast(kz, w).shape), where=np.broadcast_to(w, np.broadcast(kz, w).shape) > 0)
        out = np.where(kz2 > 0, cosine**power, 0.0)
        return out / np.maximum(np.abs(np.sin(kz * depth)), floor) if depth > 0 else out

    return weight


def _dense(rows: DataFrame, keys: list[str], index: str, n: int, names: list[str]) -> DataFrame:
    """A row for each group with arrays of n numbers, zero where the group has no row."""
    met = rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col(index).cast("int").alias("k"), F.struct(*names).alias("v")))).alias("__m"))

    def numbers(name: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.try_element_at("__m", k).getField(name), F.lit(0.0))).alias(name)

    return met.select(*keys, *map(numbers, names))


def _stack(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def filter_line(rows: DataFrame, keys: list[str], receiver: str, samples: str, n: int, length: int, dx: float, dt: float, weight: Weight) -> DataFrame:
    """(keys, receiver, samples): traces of `length` samples at receivers 0 to n - 1 of each line, by a weight of angular frequency and wavenumber. Receivers that a line lacks are zero, and have a trace in the result."""
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keys)
    width = length // 2 + 1
    arrays = lambda a: pa.array(list(a), pa.list_(pa.float64()))

    def to_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = np.fft.rfft(_stack(b.column(len(keys) + 1), length), axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], arrays(s.real), arrays(s.imag)], [*keys, receiver, "re", "im"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 2 * np.pi * np.fft.fftfreq(n, dx)
        for b in batches:
            if b.num_rows:
                w = 2 * np.pi * b.column(len(keys)).to_numpy() / (length * dt)
                s = np.fft.fft(_stack(b.column(len(keys) + 1), n) + 1j * _stack(b.column(len(keys) + 2), n), axis=1)
                s = np.fft.ifft(s * weight(w[:, None], k[None, :]), axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keys) + 1], arrays(s.real), arrays(s.imag)], [*keys, "m", "re", "im"])

    def to_time(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = _stack(b.column(len(keys) + 1), width) + 1j * _stack(b.column(len(keys) + 2), width)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keys) + 1], arrays(np.fft.irfft(s, length, axis=1))], [*keys, receiver, samples])

    spread = lambda df, own, at: df.select(*keys, own, F.posexplode(F.arrays_zip("re", "im")).alias(at, "s")).select(*keys, own, at, "s.re", "s.im")
    kept = rows.filter(F.col(receiver).between(0, n - 1) & (F.size(samples) == length)).select(*keys, F.col(receiver).cast("int"), F.col(samples).cast("array<double>"))
    spectra = spread(kept.mapInArrow(to_frequency, f"{kinds}`{receiver}` int, re array<double>, im array<double>"), receiver, "m")
    lines = _dense(spectra, [*keys, "m"], receiver, n, ["re", "im"])
    filtered = spread(lines.mapInArrow(across, f"{kinds}m int, re array<double>, im array<double>"), "m", receiver)
    back = _dense(filtered, [*keys, receiver], "m", width, ["re", "im"])
    return back.mapInArrow(to_time, f"{kinds}`{receiver}` int, `{samples}` array<double>")
