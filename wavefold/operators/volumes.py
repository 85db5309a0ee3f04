"""Element-wise algebra of volumes: cells aligned by their places, one to one, and combined."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How two values of one cell are combined; the second may be missing where `whole` keeps the first.
OPERATIONS: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": lambda a, b: F.when(b != 0, a / b),
}
#: What a missing second value counts as, so that it changes nothing.
NEUTRAL = {"add": 0, "subtract": 0, "multiply": 1, "divide": 1}


def combine(a: DataFrame, b: DataFrame, axes: list[str], value: str, operation: str, whole: bool = False) -> DataFrame:
    """(axes, value): a's value with b's of the same cell. Only cells of both, or with whole all of a, those without b as they are. A division by zero is null."""
    other = b.select(*axes, F.col(value).alias("__b"))
    joined = a.select(*axes, value).join(other, axes, "left" if whole else "inner")
    second = F.coalesce("__b", F.lit(NEUTRAL[operation])) if whole else F.col("__b")
    return joined.select(*axes, OPERATIONS[operation](F.col(value), second).alias(value))


def subtract_product(out: DataFrame, parts: list[DataFrame], axes: list[str], value: str) -> DataFrame:
    """out less the product of the parts (a derivative, a velocity, a density) at the cells that all of them have; elsewhere as it is."""
    product = parts[0].select(*axes, F.col(value).alias("__p"))
    for k, part in enumerate(parts[1:]):
        product = product.join(part.select(*axes, F.col(value).alias(f"__p{k}")), axes).select(*axes, (F.col("__p") * F.col(f"__p{k}")).alias("__p"))
    return out.select(*axes, value).join(product, axes, "left").select(*axes, (F.col(value) - F.coalesce("__p", F.lit(0))).alias(value))


def signed(product: Column, sign: int) -> Column:
    """A product as it is (0), or its part of one sign: positive (1) or negative (-1), as a magnitude."""
    return product if not sign else F.greatest(sign * product, F.lit(0))


def expand(trace: DataFrame, places: DataFrame) -> DataFrame:
    """One trace's samples at every place. trace is one line, of as many rows as it has samples."""
    return places.crossJoin(F.broadcast(trace))


def hold(cells: DataFrame, lines: list[str], depth: str, value: str, at: int) -> DataFrame:
    """Each line's value at one depth over the whole line; a line without that depth has none (null)."""
    held = cells.filter(F.col(depth) == at).select(*lines, F.col(value).alias("__held"))
    return cells.drop(value).join(held, lines, "left").withColumnRenamed("__held", value)


def swap_axes(cells: DataFrame, x: str, y: str) -> DataFrame:
    """A volume of one x and several y places with the two exchanged, so that x is the long axis; others as they are. Every place counts once, whatever its depths."""
    size = cells.agg(F.min(x).alias("__x0"), F.max(x).alias("__x1"), F.min(y).alias("__y0"), F.max(y).alias("__y1"))
    swapped = (F.col("__x0") == F.col("__x1")) & (F.col("__y0") < F.col("__y1"))
    both = cells.crossJoin(F.broadcast(size))
    return both.withColumns({x: F.when(swapped, F.col(y)).otherwise(F.col(x)), y: F.when(swapped, F.col(x)).otherwise(F.col(y))}).drop("__x0", "__x1", "__y0", "__y1")
