"""Uneven axes: derivatives by weights of their own at each place, and whole traces interpolated along them.

An axis is a list of ascending coordinates, one for each index of a grid: its weights are a table as long as the axis (MOST_PLACES at
most, so it is broadcast), made once and joined by index. Cells are dealt to blocks with halos as the
other stencils are (stencils.py), so lines of any length are the work of all tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavefold.functions.kernels import lagrange_axis
from wavefold.functions.traces import map_traces
from wavefold.operators import stencils

MOST_PLACES = 100_000


def derivative_weights(axis: np.ndarray, half: int, order: int) -> np.ndarray:
    """A row for each place with the weights of the places from half before to half after it, for the first or second derivative of the polynomial through them. Near an end fewer places are
    used, as many on both sides; the end itself has the derivative of the place beside it."""
    n = len(axis)
    reach = max(half, 2)
    out = np.zeros((n, 2 * reach + 1))
    for i in range(n if n > 2 else 0):
        centre = min(max(i, 1), n - 2)
        m = min(half, centre, n - 1 - centre)
        x = axis[centre - m : centre + m + 1] - axis[centre]
        scale = np.abs(x).max()
        powers = np.vander(x / scale, increasing=True).T
        unit = np.zeros(2 * m + 1)
        unit[order] = order / scale**order  # 1! and 2!
        first = reach + centre - m - i
        out[i, first : first + 2 * m + 1] = np.linalg.solve(powers, unit)
    return out


def derivative(rows: DataFrame, keys: list[str], index: str, value: str, name: str, axis: list[float], order: int = 2, points: int = 9) -> DataFrame:
    """(keys, index, value, name): the derivative along an uneven axis of which index numbers the places; neighbours that are not there count as zero, places beyond the axis have none."""
    if not 0 < len(axis) <= MOST_PLACES or any(a >= b for a, b in zip(axis, axis[1:], strict=False)):
        raise ValueError(f"an axis is from 1 to {MOST_PLACES} ascending places")
    table = derivative_weights(np.array(axis, dtype=float), points // 2, order)
    half = table.shape[1] // 2
    weights = rows.sparkSession.createDataFrame([(i, w.tolist()) for i, w in enumerate(table)], f"`{index}` bigint, __w array<double>")
    dealt = stencils.blocks(rows.select(*keys, index, value), index, half).join(F.broadcast(weights), index)
    total = stencils.dot(stencils.near(keys, index, half), index, value, F.col("__w"), half)[0]
    return dealt.withColumn(name, total).filter("__own").select(*keys, index, value, name)


def laplacian(cells: DataFrame, keys: list[str], axes: dict[str, float], depth: str, places: list[float], value: str, accuracy: int = 8) -> DataFrame:
    """(keys, axes, depth, laplacian): second differences along regular axes (name: step) and along an uneven depth."""
    every = [*axes, depth]
    cells = cells.select(*keys, *every, value)
    parts = derivative(cells, [*keys, *axes], depth, value, "__d", places, 2, accuracy + 1).select(*keys, *every, "__d")
    for axis, step in axes.items():
        lines = [*keys, *(a for a in every if a != axis)]
        parts = parts.unionByName(stencils.derivative(cells, lines, axis, value, "__d", True, step, accuracy).select(*keys, *every, "__d"))
    return parts.groupBy(*keys, *every).agg(F.sum("__d").alias("laplacian"))


def resample(rows: DataFrame, keep: list[str], samples: str, axis: Callable[[int], np.ndarray], places: Callable[[int], np.ndarray], points: int = 8) -> DataFrame:
    """Whole traces on an uneven axis at other places, by polynomials through the points around them (functions/kernels.py). axis and places are of a trace of so many samples; the weights are made once for each length."""
    made: dict[int, np.ndarray] = {}

    def apply(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        if n not in made:
            made[n] = lagrange_axis(axis(n), places(n), points)
        return x @ made[n].T

    return map_traces(rows, keep, samples, apply)
