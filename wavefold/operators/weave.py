"""Volumes on other grids, a line at a time: twice as fine by phase ramps, or at any places by windowed sincs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavefold.functions.kernels import weights
from wavefold.functions.traces import map_traces, time_shift


def doubled(x: np.ndarray) -> np.ndarray:
    """Rows of samples, and between them those half a sample later."""
    out = np.empty((x.shape[0], 2 * x.shape[1]))
    out[:, ::2], out[:, 1::2] = x, time_shift(-0.5)(x)
    return out


def _lines(cells: DataFrame, keys: list[str], axes: list[str], axis: str, n: int, value: str) -> tuple[DataFrame, list[str]]:
    """A row of n samples for each line along an axis, cells that are not there as zero; and what tells lines apart."""
    lines = [*keys, *(a for a in axes if a != axis)]
    table = F.map_from_entries(F.collect_list(F.struct(F.col(axis).cast("int").alias("k"), F.col(value).cast("double").alias("v"))))
    samples = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.try_element_at("__m", k), F.lit(0.0)))
    return cells.filter(F.col(axis).between(0, n - 1)).groupBy(*lines).agg(table.alias("__m")).select(*lines, samples.alias("samples")), lines


def _cells(lines: DataFrame, keys: list[str], axis: str, value: str) -> DataFrame:
    return lines.select(*keys, F.posexplode("samples").alias(axis, value)).withColumn(axis, F.col(axis).cast("bigint"))


def regrid_sinc(cells: DataFrame, keys: list[str], axes: dict[str, tuple[int, list[float]]], value: str, half: int = 9) -> DataFrame:
    """(keys, axes, value) at other places of each axis (name: how many places it has, and where the new ones lie in places and fractions), by a windowed sinc of so many samples on both sides that narrows near the ends; zero beyond
    them. One axis after another, each a shuffle of lines and a matrix of weights as large as the two axes; an uneven axis is given by where its places lie (lookups.axis_index has the same for points)."""
    order = sorted(axes, key=lambda a: len(axes[a][1]) / axes[a][0])  # what makes fewer cells comes first
    for axis in order:
        n, places = axes[axis]
        table = weights(n, np.array(places, dtype=float), "lanczos", half).T
        whole, lines = _lines(cells, keys, list(axes), axis, n, value)
        cells = _cells(map_traces(whole, lines, "samples", lambda x, table=table: x @ table), lines, axis, value)
    return cells.select(*keys, *axes, value)


def weave(cells: DataFrame, keys: list[str], axes: dict[str, int], value: str) -> DataFrame:
    """(keys, axes, value) with twice as many places along each axis (name: how many places it has): even places are the cells' own, odd ones come from half-sample shifts along one, two or all axes, by a
    phase ramp over wavenumbers. A volume that its samples determine is found at the new places exactly. Cells that are not there are zero; a line is one row, lines are dealt to all tasks."""
    for axis, n in axes.items():
        whole, lines = _lines(cells, keys, list(axes), axis, n, value)
        cells = _cells(map_traces(whole, lines, "samples", doubled), lines, axis, value)
    return cells.select(*keys, *axes, value)
