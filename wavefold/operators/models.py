"""Models and images on regular grids: from traces to cells, element-wise physics, coarser grids and curvature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavefold.operators import stencils


def snap_to_grid(traces: DataFrame, x: str, value: str, step: float) -> DataFrame:
    """Mean value by the nearest place of a grid with the given step that begins at the least coordinate: (ix, value)."""
    origin = F.broadcast(traces.agg(F.min(x).alias("__x0")))
    placed = traces.crossJoin(origin).withColumn("ix", F.rint((F.col(x) - F.col("__x0")) / step).cast("bigint"))
    return placed.groupBy("ix").agg(F.avg(value).alias(value))


def fill_holes(cells: DataFrame, keys: list[str], ix: str, value: str) -> DataFrame:
    """Every place from the first to the last of each line, holes filled from the nearest cell, the one before on a tie: each cell spreads over the places up to the next."""
    w = Window.partitionBy(*keys).orderBy(ix)
    return _spread(cells.withColumns({"__next": F.lead(ix).over(w), "__after": F.lead(value).over(w)}), ix, value)


def _spread(cells: DataFrame, ix: str, value: str) -> DataFrame:
    others = [c for c in cells.columns if c not in (ix, value, "__next", "__after")]
    spread = cells.withColumn("__at", F.explode(F.sequence(F.col(ix), F.coalesce(F.col("__next") - 1, F.col(ix)))))
    nearer = F.col("__at") - F.col(ix) <= F.col("__next") - F.col("__at")
    return spread.select(*others, F.col("__at").alias(ix), F.when(F.col("__next").isNull() | nearer, F.col(value)).otherwise(F.col("__after")).alias(value))


def axis_from_angles(dip: Column, azimuth: Column) -> tuple[Column, Column]:
    """Horizontal parts of a symmetry axis from degrees of dip and azimuth."""
    d, a = F.radians(dip), F.radians(azimuth)
    return -F.sin(d) * F.cos(a), -F.sin(d) * F.sin(a)


def axis_from_slopes(dx: Column, dy: Column) -> tuple[Column, Column]:
    long = F.sqrt(1 + dx * dx + dy * dy)
    return -dx / long, -dy / long


def angles_of(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Dip and azimuth (0 to 360) in degrees of a vector."""
    return F.degrees(F.acos(z / F.sqrt(x * x + y * y + z * z))), F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def step_squared(velocity: Column, dt: float) -> Column:
    """The factor of the spatial side in a time step."""
    return F.pow(velocity * dt, F.lit(2.0))


def step_attenuated(velocity: Column, inverse_q: Column, dt: float, c: float) -> tuple[Column, Column]:
    """step_squared() and the attenuation 1 / Q as a time step of an attenuating medium takes them: both over 1 - c / Q, the first with the cosine-like series of 1 / Q."""
    over = 1 / (1 - c * inverse_q)
    q2 = inverse_q * inverse_q
    return step_squared(velocity, dt) * (1 - q2 / 4 + q2 * q2 / 48) * over, inverse_q * over


def coarsen(cells: DataFrame, keys: list[str], order: str, velocity: str, ratio: int) -> DataFrame:
    """Every ratio-th place with the mean slowness around it, as velocity."""
    slow = cells.withColumn("__s", 1 / F.col(velocity))
    mean = stencils.box_mean(slow, keys, order, "__s", ratio // 2)
    return mean.filter(F.pmod(F.col(order), F.lit(ratio)) == 0).select(*keys, order, (1 / F.col("mean")).alias(velocity))


def laplacian(cells: DataFrame, ix: str, iz: str, value: str, dx: float, dz: float) -> DataFrame:
    """Sum of the second differences along both axes, neighbours that are not there as zero."""
    return stencils.laplacian(cells, [], {ix: dx, iz: dz}, value)


def depth_power(value: Column, depth: Column, power: float) -> Column:
    return value * F.pow(depth, F.lit(power))


def centre_slice(cells: DataFrame, index: str, n: int) -> DataFrame:
    return cells.filter(F.col(index) == n // 2)
