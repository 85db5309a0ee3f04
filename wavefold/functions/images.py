"""Wavenumber filters of images, a line a row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def wavenumbers(shape: tuple[int, int], steps: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    return np.meshgrid(*(2 * np.pi * np.fft.fftfreq(n, d) for n, d in zip(shape, steps, strict=True)), indexing="ij")


def laplacian(kx: np.ndarray, kz: np.ndarray) -> np.ndarray:
    return -(kx**2 + kz**2)


def reciprocal(floor: float):
    """1 / |k|, |k| no less than the floor."""
    return lambda kx, kz: 1 / np.maximum(np.hypot(kx, kz), floor)


def direction(axis: int, floor: float):
    """i k / |k| along an axis: the derivative without its gain."""
    return lambda kx, kz: 1j * (kx, kz)[axis] / np.maximum(np.hypot(kx, kz), floor)


def evanescent_cut(slowest: float, frequency: float, taper: float):
    """Removes wavenumbers that don't propagate, with a cosine edge below the limit."""

    def weight(kx: np.ndarray, kz: np.ndarray) -> np.ndarray:
        limit = 2 * np.pi * frequency / slowest
        x = np.clip((limit - np.hypot(kx, kz)) / (taper * limit), 0, 1)
        return 0.5 - 0.5 * np.cos(np.pi * x)

    return weight


def combine(image: np.ndarray, filtered: np.ndarray) -> np.ndarray:
    """2 a - b / 2, which keeps reflections and lowers what scatters forward."""
    return 2 * image - filtered / 2


def _along(df: DataFrame, keys: list[str], line: str, along: str, n: int, parts: list[str], function: Callable[[np.ndarray, np.ndarray], np.ndarray], real: bool) -> DataFrame:
    """A function of lines (complex matrices, a row a line, and the lines' numbers): the cells (keys, line, along, parts) of one line meet in a row; absent cells are zero."""
    grouped = df.groupBy(*keys, line).agg(F.collect_list(F.struct(along, *parts)).alias("__line"))  # n cells at most
    width = len(keys)
    names = [*keys, line, along, *(["re"] if real else ["re", "im"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(width + 1)
            inside = cells.flatten()
            at, *values = (np.asarray(inside.field(k)) for k in range(1 + len(parts)))
            m = np.zeros((batch.num_rows, n), dtype=complex)
            m[np.repeat(np.arange(batch.num_rows), np.asarray(cells.value_lengths())), at] = values[0] if len(values) == 1 else values[0] + 1j * values[1]
            out = function(m, np.asarray(batch.column(width)))
            row = pa.array(np.repeat(np.arange(batch.num_rows), n))
            found = [pa.array(out.real.ravel())] if real else [pa.array(out.real.ravel()), pa.array(out.imag.ravel())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(row) for k in range(width + 1)), pa.array(np.tile(np.arange(n), batch.num_rows)), *found], names)

    kinds = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    return grouped.select(*keys, F.col(line).cast("bigint").alias(line), "__line").mapInArrow(run, f"{kinds}`{line}` bigint, `{along}` bigint, re double" + ", im double" * (not real))


def filter_images(cells: DataFrame, keys: list[str], shape: tuple[int, int], steps: tuple[float, float], weight: Callable[[np.ndarray, np.ndarray], np.ndarray], value: str = "value") -> DataFrame:
    """Images (keys, ix, iz, value) filtered by a weight of the wavenumbers; absent cells are zero.

    The spectrum is taken line by line: along z, along x with the weight and back, back along z, with a shuffle between, so that a task has lines and never an image. Cells must not be repeated.
    """
    nx, nz = shape
    kx, kz = (2 * np.pi * np.fft.fftfreq(n, d) for n, d in zip(shape, steps, strict=True))
    deep = _along(cells.select(*keys, "ix", "iz", F.col(value).cast("double").alias("re")), keys, "ix", "iz", nz, ["re"], lambda m, _: np.fft.fft(m, axis=1), False)
    weighed = _along(deep, keys, "iz", "ix", nx, ["re", "im"], lambda m, at: np.fft.ifft(np.fft.fft(m, axis=1) * weight(kx[None, :], kz[at][:, None]), axis=1), False)
    return _along(weighed, keys, "ix", "iz", nz, ["re", "im"], lambda m, _: np.fft.ifft(m, axis=1), True).withColumnRenamed("re", value)
