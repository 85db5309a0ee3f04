"""Sums, extremes and the compensation of images by them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stack(cells: DataFrame, keys: list[Column], value: Column) -> DataFrame:
    """Sum and fold of the cells at each place; partial sums come before the shuffle."""
    return cells.groupBy(*keys).agg(F.sum(value).alias("stack"), F.count(F.lit(1)).alias("fold"))


def stack_onto(image: DataFrame, partial: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds a partial image to the lines of an image that it shares."""
    add = partial.groupBy(*keys).agg(F.sum(value).alias("__add"))
    return image.join(add, keys, "left").withColumn(value, F.col(value) + F.coalesce("__add", F.lit(0))).drop("__add")


def stack_lines(image: DataFrame, partial: DataFrame, lines: list[str], depth: str, value: str, accumulate: bool = True) -> DataFrame:
    """An image with the lines of a partial one that it has too: added to them, or put in their place. Other lines of the partial image are left out; depths must match, a cell that the image hasn't got is left out too."""
    put = partial.groupBy(*lines, depth).agg(F.sum(value).alias("__put"))
    new = F.col(value) + F.coalesce("__put", F.lit(0)) if accumulate else F.coalesce("__put", value)
    return image.join(put, [*lines, depth], "left").withColumn(value, new).drop("__put")


def illumination(cells: DataFrame, keys: list[str], value: Column) -> DataFrame:
    return cells.groupBy(*keys).agg(F.sum(value * value).alias("illumination"))


def with_scalar(cells: DataFrame, **scalars: Column) -> DataFrame:
    """Cells with aggregates over all of them: one row, joined to each."""
    return cells.crossJoin(F.broadcast(cells.agg(*(c.alias(n) for n, c in scalars.items()))))


def whiten(cells: DataFrame, value: str, share: float) -> DataFrame:
    """Raises values to a share of the largest magnitude."""
    return with_scalar(cells, __most=F.max(F.abs(value))).withColumn("whitened", F.greatest(F.col(value), share * F.col("__most"))).drop("__most")


def compensate(cells: DataFrame, image: str, value: str, share: float) -> DataFrame:
    """The image over the whitened illumination."""
    return whiten(cells, value, share).withColumn("compensated", F.col(image) / F.col("whitened"))


def damp(cells: DataFrame, value: str, power: float, water: float) -> DataFrame:
    """Weights 1 / (m (a + w e^-a)), m the mean to a power and a the value over m."""
    m = F.pow(F.col("__mean"), F.lit(power))
    a = F.col(value) / m
    return with_scalar(cells, __mean=F.avg(value)).withColumn("damping", 1 / (m * (a + water * F.exp(-a)))).drop("__mean")


def profile(cells: DataFrame, depth: str, value: str) -> DataFrame:
    """Least, largest and mean value at each depth."""
    return cells.groupBy(depth).agg(F.min(value).alias("least"), F.max(value).alias("largest"), F.avg(value).alias("mean"))


def stable_step(cells: DataFrame, wavenumber: float, speed: Column, anisotropy: Column | None = None, density: Column | None = None, attenuation: float = 1.0) -> DataFrame:
    """The largest stable time step (dt): the least over cells of 2 / (k speed), over sqrt(anisotropy); with density the speed counts times its root, and the least root of all multiplies the step; attenuation rescales it."""
    rate = speed if anisotropy is None else speed * F.sqrt(anisotropy)
    if density is None:
        return cells.agg((F.min(2.0 / (wavenumber * rate)) * attenuation).alias("dt"))
    return cells.agg((F.min(2.0 / (wavenumber * rate * F.sqrt(density))) * F.sqrt(F.min(density)) * attenuation).alias("dt"))


def attenuation_rescale(least_quality: float, top: float, reference: float) -> float:
    """What the step is multiplied by for the strongest attenuation, from the smallest quality factor."""
    return 1 - (3 + 2 / math.pi * math.log(top / reference)) / least_quality


def anisotropic_rate(velocity: Column, epsilon: Column, delta: Column, steps: tuple[float, ...], axis: tuple[Column, Column] | None = None) -> Column:
    """The fastest of the modes of a cell: over all choices of axes of velocity sqrt((t + sqrt(t t - 8 (e - d) h v)) / 2), t = (1 + 2 e) h + v, h and v the squared wavenumbers across and along the symmetry axis.

    steps: dx, dz or dx, dy, dz. axis: horizontal parts of a tilted symmetry axis.
    """
    inverse = [F.lit(1.0 / s) for s in steps]
    kx, ky, kz = (inverse[0], F.lit(0.0), inverse[1]) if len(steps) == 2 else inverse
    if axis is not None:
        x, y = axis
        sine = F.sqrt(x * x + y * y)
        cosine = F.sqrt(F.greatest(1 - sine * sine, F.lit(0.0)))
        cos_phi, sin_phi = F.when(sine > 1e-15, -x / sine).otherwise(1.0), F.when(sine > 1e-15, -y / sine).otherwise(0.0)
        kx, ky, kz = cos_phi * cosine * kx + sin_phi * cosine * ky - sine * kz, (-sin_phi * kx + cos_phi * ky) if len(steps) == 3 else F.lit(0.0), cos_phi * sine * kx + sin_phi * sine * ky + cosine * kz
    squares, modes = [k * k for k in (kz, kx, ky)], []
    for choice in range(1, 8 if len(steps) == 3 else 4):
        v = squares[0] if choice & 1 else F.lit(0.0)
        h = sum((squares[i] for i in (1, 2) if choice >> i & 1), F.lit(0.0))
        t = (1 + 2 * epsilon) * h + v
        modes.append(F.sqrt((t + F.sqrt(F.greatest(t * t - 8 * (epsilon - delta) * h * v, F.lit(0.0)))) / 2))
    return velocity * F.greatest(*modes)


def least_between(cells: DataFrame, depth: str, value: str, low: Column, high: Column) -> DataFrame:
    """The least value over a range of depths (ends included), and how many cells it has; the range must lie inside the model to mean all of it."""
    return cells.filter(F.col(depth).between(low, high)).agg(F.min(value).alias("least"), F.count(F.lit(1)).alias("n"))


def surface_and_least(cells: DataFrame, depth: str, surface: int, value: str) -> DataFrame:
    """The mean value at the surface's depth and the least of all, in one pass."""
    return cells.agg(F.avg(F.when(F.col(depth) == surface, F.col(value))).alias("at_surface"), F.min(value).alias("least"))


def mean_and_deviation(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and population deviation."""
    return cells.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))


def checks(cells: DataFrame, columns: list[str], least: float) -> DataFrame:
    """One row a column: how many values are null, not finite, or smaller than allowed."""
    bad = {}
    for c in columns:
        x = F.col(c).cast("double")
        bad |= {f"{c}:nulls": x.isNull(), f"{c}:not_finite": F.isnan(x) | (F.abs(x) == float("inf")), f"{c}:small": x < least}
    one = cells.agg(*(F.count_if(v).alias(k) for k, v in bad.items()))
    rows = F.array(*(F.struct(F.lit(c).alias("name"), *(F.col(f"`{c}:{k}`").alias(k) for k in ("nulls", "not_finite", "small"))) for c in columns))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def cone_radius(depth: Column, table: list[tuple[float, float]]) -> Column:
    """The radius of a cone at a depth. table: depth and radius, ascending; straight between entries and beyond them."""
    radius = None
    for (z0, r0), (z1, r1) in reversed(list(zip(table, table[1:], strict=False))):
        line = r0 + (depth - z0) * ((r1 - r0) / (z1 - z0))
        radius = line if radius is None else F.when(depth <= z1, line).otherwise(radius)
    return radius


def cone_angle_radius(depth: Column, degrees: float, least: float) -> Column:
    return depth * math.tan(math.radians(degrees)) + least


def cone_weight(offset: Column, radius: Column) -> Column:
    """1 inside the cone, a cosine from there down to 0 at twice its radius; 0 all over where there is no cone (a radius of 0 or less)."""
    beyond = (offset - radius) / radius
    return F.when(offset <= radius, 1.0).when((radius <= 0) | (beyond > 1), 0.0).otherwise(0.5 * (1 + F.cos(beyond * math.pi)))


def vti_scale(epsilon: Column, delta: Column, h: Column, z: Column) -> Column:
    """The anisotropic scale (1 + sqrt(1 - 8 (e - d) h2 z2 / ((1 + 2 e) h2 + z2)^2)) / 2, at most 1."""
    h2, z2 = h * h, z * z
    under = 1 - 8 * (epsilon - delta) * h2 * z2 / F.pow((1 + 2 * epsilon) * h2 + z2, F.lit(2.0))
    return F.least(F.lit(1.0), 0.5 * (1 + F.sqrt(F.greatest(under, F.lit(0.0)))))


def tti_scale(epsilon: Column, delta: Column, vector: tuple[Column, Column, Column], axis: tuple[Column, Column]) -> Column:
    """vti_scale() about a tilted symmetry axis, of which the horizontal parts are given: along it is the vector's part on the axis, across it the rest."""
    x, y, z = vector
    along = x * axis[0] + y * axis[1] + z * F.sqrt(F.greatest(F.lit(0.0), 1 - axis[0] * axis[0] - axis[1] * axis[1]))
    across = F.sqrt(F.greatest(F.lit(0.0), x * x + y * y + z * z - along * along))
    return vti_scale(epsilon, delta, across, along)


def running_depth(cells: DataFrame, keys: list[str], order: str, velocity: Column, dt: float) -> DataFrame:
    """One-way depth after each time sample: the running sum of velocity times half the step."""
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("depth", F.sum(velocity * (dt / 2)).over(window))
