"""Sliding means, medians, weighted sums and derivatives along an axis of numbered places.

A neighbour is the row at the place so many steps away, not the next row there is. Lines are cut into blocks of
places, each with a halo of the neighbouring blocks' rows as wide as the stencil reaches; sums, sorted lists and weighted sums run within a block. So a
row is shuffled 1 + 2 half / BLOCK times, whatever the stencil's width, and no window holds a whole line: a long
line, or few lines, are the work of all tasks.

Places beyond the first and the last row of a line repeat that row, where edges are said to be repeated. A place
missing within a line is left out of means, medians and weighted sums (weights are those of the rest), and
counts as zero in derivatives. Places without a row of their own have no result.
"""

from __future__ import annotations

from collections.abc import Callable
from math import factorial

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Places of a block, at least; parts into which the rows of a line are dealt to meet its span.
BLOCK, SALTS = 1024, 16


def spans(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, __lo, __hi): the first and last place of each line."""
    return rows.groupBy(*keys).agg(F.min(order).alias("__lo"), F.max(order).alias("__hi"))


def blocks(rows: DataFrame, order: str, half: int) -> DataFrame:
    """Rows dealt to blocks of BLOCK places (or 16 half, if that is more), each with a halo of half places of its neighbours: 1 + 2 half / BLOCK rows a row. __own tells a block's own rows from its halo."""
    size = max(BLOCK, 16 * half)
    at = F.col(order)
    block = lambda place: F.floor(place / F.lit(size)).cast("bigint")
    return rows.withColumn("__block", F.explode(F.sequence(block(at - half), block(at + half)))).withColumn("__own", F.col("__block") == block(at))


def near(keys: list[str], order: str, half: int) -> WindowSpec:
    """The rows of a block up to half places away. A window is a block, however long its line."""
    return Window.partitionBy(*keys, "__block").orderBy(order).rangeBetween(-half, half)


def _at_places(rows: DataFrame, keys: list[str], order: str, value: str, half: int, result: Callable[[WindowSpec, Column, Column], Column], name: str, places: DataFrame | None) -> DataFrame:
    """(keys, order, value, name); result(rows near, how many places before the line's first one, how many behind its last) is computed within blocks. Where there are places before the first
    row or behind the last one, that row is the first or last of those near. places: rows with the same places, if it takes less to compute them."""
    lines = spans(rows if places is None else places, keys, order)
    dealt = blocks(rows.select(*keys, order, value), order, half)
    if keys:
        # A long line is dealt by salts, as its span is wanted by all of its rows.
        part = F.pmod(F.xxhash64(order), F.lit(SALTS)).cast("int")
        each = lines.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = dealt.withColumn("__salt", part).join(each, [*keys, "__salt"])
    else:
        dealt = dealt.crossJoin(F.broadcast(lines))  # one row
    before, behind = (F.greatest(F.lit(0), x).cast("int") for x in (F.col("__lo") - (F.col(order) - half), F.col(order) + half - F.col("__hi")))
    return dealt.withColumn(name, result(near(keys, order, half), before, behind)).filter("__own").select(*keys, order, value, name)


def box_mean(rows: DataFrame, keys: list[str], order: str, value: str, half: int, name: str = "mean", places: DataFrame | None = None) -> DataFrame:
    """Mean over 2 half + 1 places, edges repeated."""

    def result(near: WindowSpec, before: Column, behind: Column) -> Column:
        first, last = F.first(value).over(near), F.last(value).over(near)
        edge = lambda v, n: F.when(v.isNotNull(), v * n).otherwise(F.lit(0))
        there = lambda v, n: F.when(v.isNotNull(), n).otherwise(F.lit(0))
        total = F.coalesce(F.sum(value).over(near), F.lit(0)) + edge(first, before) + edge(last, behind)
        count = F.count(value).over(near) + there(first, before) + there(last, behind)
        return F.when(count > 0, total / count)

    return _at_places(rows, keys, order, value, half, result, name, places)


def running_median(rows: DataFrame, keys: list[str], order: str, value: str, half: int, name: str = "median", places: DataFrame | None = None) -> DataFrame:
    """Median of 2 half + 1 places, edges repeated; of an even number the lower of the two in the middle. With half 1 the end points stay."""

    def result(near: WindowSpec, before: Column, behind: Column) -> Column:
        edges = [F.array_repeat(v, n) for v, n in ((F.first(value).over(near), before), (F.last(value).over(near), behind))]
        values = F.array_sort(F.array_compact(F.concat(F.collect_list(value).over(near), *edges)))
        return F.when(F.size(values) > 0, F.try_element_at(values, F.ceil(F.size(values) / 2).cast("int")))

    return _at_places(rows, keys, order, value, half, result, name, places)


def median3(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    return running_median(rows, keys, order, value, 1)


def dot(near: WindowSpec, order: str, value: str, weights: Column, half: int) -> tuple[Column, Column]:
    """The sum of weights times values of the rows near, and of the weights of those that have a value; weights: an array, from half before to half after."""
    found = F.collect_list(F.struct(F.col(order).alias("at"), F.col(value).cast("double").alias("v"))).over(near)
    weight = lambda s: F.element_at(weights, (s["at"] - F.col(order) + half + 1).cast("int"))
    there = F.filter(found, lambda s: s["v"].isNotNull())
    return F.aggregate(there, F.lit(0.0), lambda t, s: t + weight(s) * s["v"]), F.aggregate(there, F.lit(0.0), lambda t, s: t + weight(s))


def weighted(rows: DataFrame, keys: list[str], order: str, value: str, weights: list[float], name: str, places: DataFrame | None = None) -> DataFrame:
    """Weighted mean of a place and its neighbours, edges repeated; weights go from the one before to the one after."""
    # Of so many places before the first one, the weights in all; likewise from the end.
    ahead, astern = (F.array(*(F.lit(float(sum(w[:n]))) for n in range(len(weights) // 2 + 1))) for w in (weights, weights[::-1]))

    def result(around: WindowSpec, before: Column, behind: Column) -> Column:
        total, count = dot(around, order, value, F.array(*map(F.lit, weights)), len(weights) // 2)
        for v, share in ((F.first(value).over(around), F.get(ahead, before)), (F.last(value).over(around), F.get(astern, behind))):
            total, count = total + F.when(v.isNotNull(), v * share).otherwise(0.0), count + F.when(v.isNotNull(), share).otherwise(0.0)
        return F.when(count != 0, total / count * sum(weights))

    return _at_places(rows, keys, order, value, len(weights) // 2, result, name, places)


Step = Callable[[DataFrame, list[str], str, DataFrame], DataFrame]


def along_axes(cells: DataFrame, keys: list[str], axes: list[str], value: str, steps: list[tuple[str, Step]]) -> DataFrame:
    """Filters one after another, each along one axis of cells (keys, axes, value): (axis, function of cells, keys of a line, axis and the first cells that gives a column "filtered"). Filters keep the places there are, so lines' ends are
    those of the first cells."""
    first = cells
    for axis, step in steps:
        lines = [*keys, *(a for a in axes if a != axis)]
        cells = step(cells.select(*keys, *axes, value), lines, axis, first).select(*keys, *axes, F.col("filtered").alias(value))
    return cells


#: Weights of common smoothing filters.
SMOOTH_3, MEAN_3, QUARTERS, SMOOTH_5 = [0.2, 0.6, 0.2], [1 / 3, 1 / 3, 1 / 3], [0.25, 0.5, 0.25], [0.04, 0.16, 0.6, 0.16, 0.04]


def mean_along(value: str, half: int) -> Step:
    return lambda cells, keys, axis, first: box_mean(cells, keys, axis, value, half, "filtered", first)


def median_along(value: str, half: int = 1) -> Step:
    return lambda cells, keys, axis, first: running_median(cells, keys, axis, value, half, "filtered", first)


def weighted_along(value: str, weights: list[float]) -> Step:
    return lambda cells, keys, axis, first: weighted(cells, keys, axis, value, weights, "filtered", first)


def differences(order: int, second: bool) -> list[float]:
    """Weights of the central difference of an even order for distances 0 to order / 2; those of the other side are the same, negated for a first difference."""
    n = order // 2
    common = [(-1) ** (k + 1) * factorial(n) ** 2 / (factorial(n - k) * factorial(n + k)) for k in range(1, n + 1)]
    if second:
        return [-2 * sum(1 / k**2 for k in range(1, n + 1)), *(2 * c / k**2 for k, c in enumerate(common, 1))]
    return [0.0, *(c / k for k, c in enumerate(common, 1))]


def derivative(rows: DataFrame, keys: list[str], order: str, value: str, name: str, second: bool = False, step: float = 1.0, accuracy: int = 8) -> DataFrame:
    """(keys, order, value, name): central difference of the given order of accuracy; neighbours that are not there count as zero."""
    one = differences(accuracy, second)
    half = len(one) - 1
    weights = [*((1 if second else -1) * c for c in one[:0:-1]), *one]
    dealt = blocks(rows.select(*keys, order, value), order, half)
    total = dot(near(keys, order, half), order, value, F.array(*map(F.lit, weights)), half)[0]
    return dealt.withColumn(name, total / (step**2 if second else step)).filter("__own").select(*keys, order, value, name)


def gradient(cells: DataFrame, keys: list[str], axes: dict[str, float], value: str, accuracy: int = 8) -> DataFrame:
    """Cells with a column d_<axis> for each axis (name: step): the first differences along all axes."""
    out = cells.select(*keys, *axes, value)
    for axis, step in axes.items():
        lines = [*keys, *(a for a in axes if a != axis)]
        one = derivative(cells.select(*keys, *axes, value), lines, axis, value, f"d_{axis}", step=step, accuracy=accuracy).drop(value)
        out = out.join(one, [*keys, *axes])
    return out


def divergence(cells: DataFrame, keys: list[str], axes: dict[str, tuple[str, float]], name: str, accuracy: int = 8) -> DataFrame:
    """The sum over axes (name: component, step) of each component's first difference along its axis."""
    parts = None
    for axis, (component, step) in axes.items():
        lines = [*keys, *(a for a in axes if a != axis)]
        one = derivative(cells.select(*keys, *axes, component), lines, axis, component, "__d", step=step, accuracy=accuracy).select(*keys, *axes, "__d")
        parts = one if parts is None else parts.union(one)
    return parts.groupBy(*keys, *axes).agg(F.sum("__d").alias(name))


def laplacian(cells: DataFrame, keys: list[str], axes: dict[str, float], value: str, accuracy: int = 8) -> DataFrame:
    """(keys, axes, laplacian): the sum of the second differences along all axes (name: step), neighbours that are not there as zero. Every cell is spread once to all places that it adds to."""
    targets = []
    for axis, step in axes.items():
        one = differences(accuracy, True)
        for k in range(1 - len(one), len(one)):
            targets.append(F.struct(*((F.col(a) + (k if a == axis else 0)).alias(a) for a in axes), F.lit(one[abs(k)] / step**2).alias("__w"), F.lit(k == 0).alias("__is")))
    spread = cells.select(*keys, F.col(value).alias("__v"), F.explode(F.array(*targets)).alias("__t")).select(*keys, "__v", "__t.*")
    return spread.groupBy(*keys, *axes).agg(F.sum(F.col("__w") * F.col("__v")).alias("laplacian"), F.max("__is").alias("__own")).filter("__own").drop("__own")


def upsample(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Twice as many places: each, and its mean with the next place; where that has no row its own value is repeated."""
    following = rows.select(*keys, (F.col(order) - 1).alias(order), F.col(value).alias("__next"))
    halves = F.array(F.struct((2 * F.col(order)).alias("fine"), F.col(value).alias("v")), F.struct((2 * F.col(order) + 1).alias("fine"), ((F.col(value) + F.coalesce("__next", value)) / 2).alias("v")))
    return rows.join(following, [*keys, order], "left").select(*keys, F.explode(halves).alias("h")).select(*keys, "h.fine", F.col("h.v").alias(value))


def smooth_least(profile: DataFrame, keys: list[str], order: str, value: str, rounds: int) -> DataFrame:
    """So many times the lesser of each value and its mean with its neighbours (quarters), ends with the one neighbour (halves). A profile is short, a value a depth."""
    w = Window.partitionBy(*keys).orderBy(order)
    for _ in range(rounds):
        before, after = F.lag(value).over(w), F.lead(value).over(w)
        mean = F.when(before.isNull() & after.isNull(), F.col(value)).when(before.isNull(), (F.col(value) + after) / 2).when(after.isNull(), (F.col(value) + before) / 2).otherwise((before + 2 * F.col(value) + after) / 4)
        profile = profile.withColumn("__m", mean).withColumn(value, F.least(value, "__m")).drop("__m")
    return profile
