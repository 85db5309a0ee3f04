"""Weights that depend on the place: tapers at the edges of volumes, in time and in depth."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def rise(share: Column) -> Column:
    """A cosine from 0 at share 0 to 1 at share 1."""
    return 0.5 * (1 - F.cos(share * math.pi))


def smooth_step(share: Column) -> Column:
    """10 x^3 - 15 x^4 + 6 x^5: from 0 to 1 with level ends."""
    x = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    return x * x * x * (10 - 15 * x + 6 * x * x)


def edges(index: Column, n: int, width: int) -> Column:
    """Rises over width places from the first one, where it is 0, and falls likewise to the last one."""
    near = F.least(index, n - 1 - index)
    return F.when(near < width, rise(near / width)).otherwise(1.0)


def boundary(index: Column, n: int, width: int, least: float) -> Column:
    """Within width places of either edge a cosine from `least` at the edge to 1; an edge that is no axis (width 0) leaves it."""
    if not width:
        return F.lit(1.0)
    near = F.least(index, n - 1 - index)
    return F.when(near < width, 1 - (1 - least) * 0.5 * (1 + F.cos(near / width * math.pi))).otherwise(1.0)


def time_or_depth(it: Column, n_times: int, iz: Column, n_depths: int) -> Column:
    """The time taper while that lasts, else the depth taper."""
    depth = F.when(iz < n_depths, rise(iz / n_depths)).otherwise(1.0) if n_depths else F.lit(1.0)
    return F.when(it < n_times, rise(it / n_times)).otherwise(depth) if n_times else depth
