"""Frames, shots and traces: scans, selections and geometry of headers."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frame_scan(traces: DataFrame, shot: str, order: list[str], keep: dict[str, str]) -> DataFrame:
    """One row a shot: how many traces it has, and columns of its first trace in order (new name: column)."""
    first = F.min_by(F.struct(*(F.col(c).alias(n) for n, c in keep.items())), F.struct(*order))
    return traces.groupBy(shot).agg(F.count(F.lit(1)).alias("n_traces"), first.alias("first")).select(shot, "n_traces", "first.*")


def swap_ends(frames: DataFrame, acquisition: Column, pairs: list[tuple[str, str]]) -> DataFrame:
    """Exchanges source and receiver columns where receivers stand on the sea bed."""
    swapped = acquisition.isin("obn", "obc", "obs")
    return frames.withColumns({a: F.when(swapped, F.col(b)).otherwise(F.col(a)) for x, y in pairs for a, b in ((x, y), (y, x))})


def bounding_box(traces: DataFrame, shot: str, x: str, y: str, pad: float) -> DataFrame:
    """One row a shot: trace count, padded bounds and centroid."""
    box = {f"{f.__name__}_{n}": f(F.col(c)) + (pad if f is F.max else -pad) for n, c in (("x", x), ("y", y)) for f in (F.min, F.max)}
    return traces.groupBy(shot).agg(F.count(F.lit(1)).alias("n_traces"), *(v.alias(k) for k, v in box.items()), F.avg(x).alias("centre_x"), F.avg(y).alias("centre_y"))


def first_shots(shots: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n shots in order: a top-k, never a full sort."""
    return shots.orderBy(*order).limit(n)


def expand_sources(shots: DataFrame, delays: DataFrame, on: str, extra: Column, x: str, y: str) -> DataFrame:
    """Each shot with its simultaneous sources: the nominal one with delay 0 first, then those listed, in order."""
    listed = delays.groupBy(on).agg(F.array_sort(F.collect_list(extra)).alias("listed"))
    nominal = F.array(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.lit(0.0).alias("delay")))
    return shots.join(listed, on, "left").withColumn("sources", F.concat(nominal, F.coalesce("listed", F.array().cast(nominal_type())))).drop("listed")


def nominal_type() -> str:
    return "array<struct<x:double,y:double,delay:double>>"


def to_local(x: Column, y: Column, origin: tuple[float, float], along: tuple[float, float]) -> tuple[Column, Column]:
    """World to survey coordinates: projections on the first direction and on the one at right angles to it."""
    dx, dy = x - origin[0], y - origin[1]
    return dx * along[0] + dy * along[1], dy * along[0] - dx * along[1]


def to_world(u: Column, v: Column, origin: tuple[float, float], along: tuple[float, float]) -> tuple[Column, Column]:
    """The inverse of to_local."""
    return u * along[0] - v * along[1] + origin[0], u * along[1] + v * along[0] + origin[1]


def to_line(u: Column, spacing: float, first: int) -> Column:
    """The number of the nearest line; halves go away from zero."""
    return (F.round(u / spacing) + first).cast("bigint")


def live_traces(traces: DataFrame, inside: Column, kept: DataFrame, on: str) -> DataFrame:
    """Traces whose stencil lies inside the grid, of shots that are kept."""
    return traces.filter(inside).join(kept.select(on), on, "left_semi")


def offset_weight(offset: Column, most: float) -> Column:
    """0 from the largest offset on, a cosine from 1 down to 0.08 over its outer half, else 1."""
    half = 0.5 * most
    return F.when(offset >= most, 0.0).when(offset > half, 0.08 + 0.92 * F.cos((offset - half) / half * 1.5707963267948966)).otherwise(1.0)


def renumber(traces: DataFrame, shot: str, order: list[str], base: int) -> DataFrame:
    """Consecutive receiver numbers from base within each shot."""
    return traces.withColumn("receiver", F.row_number().over(Window.partitionBy(shot).orderBy(*order)) + (base - 1))


def window_clamped(cells: DataFrame, targets: DataFrame, ix: str, iy: str, bounds: tuple[int, int, int, int], value: str) -> DataFrame:
    """Values for target places, those outside the cube taken from its nearest edge. bounds: least and largest ix, then iy."""
    x0, x1, y0, y1 = bounds
    keyed = targets.withColumns({"__x": F.least(F.greatest(F.col(ix), F.lit(x0)), F.lit(x1)), "__y": F.least(F.greatest(F.col(iy), F.lit(y0)), F.lit(y1))})
    source = cells.select(F.col(ix).alias("__x"), F.col(iy).alias("__y"), value)
    return keyed.join(source, ["__x", "__y"], "left").drop("__x", "__y")


def from_line(line: Column, spacing: float, first: int) -> Column:
    """The coordinate of a line: the inverse of to_line for places on lines."""
    return (line - first) * spacing


@dataclass(frozen=True)
class Survey:
    """Three corners (x, y, crossline, inline): the least of both numbers, the largest crossline, the largest inline."""

    origin: tuple[float, float]
    along: tuple[float, float]
    across: tuple[float, float]
    spacing: tuple[float, float]
    first: tuple[int, int]


def survey(corners: list[tuple[float, float, int, int]]) -> Survey:
    """Directions and line spacings from three corners, in their order; corners in any other are an error."""
    (x0, y0, a0, b0), (x1, y1, a1, b1), (x2, y2, a2, b2) = corners
    if not (a0 == a2 < a1 and b0 == b1 < b2):
        raise ValueError("corners must be the least of both lines, the largest crossline, the largest inline")
    long, wide = math.hypot(x1 - x0, y1 - y0), math.hypot(x2 - x0, y2 - y0)
    return Survey((x0, y0), ((x1 - x0) / long, (y1 - y0) / long), ((x2 - x0) / wide, (y2 - y0) / wide), (long / (a1 - a0), wide / (b2 - b0)), (a0, b0))


def place_of_lines(crossline: Column, inline: Column, s: Survey) -> tuple[Column, Column]:
    """World coordinates of a crossline and an inline."""
    u, v = from_line(crossline, s.spacing[0], s.first[0]), from_line(inline, s.spacing[1], s.first[1])
    return s.origin[0] + u * s.along[0] + v * s.across[0], s.origin[1] + u * s.along[1] + v * s.across[1]


def lines_of_place(x: Column, y: Column, s: Survey) -> tuple[Column, Column]:
    """The nearest crossline and inline of world coordinates, by projection on the two directions."""
    dx, dy = x - s.origin[0], y - s.origin[1]
    return to_line(dx * s.along[0] + dy * s.along[1], s.spacing[0], s.first[0]), to_line(dx * s.across[0] + dy * s.across[1], s.spacing[1], s.first[1])


def source_array(shots: DataFrame, order: list[str], n: int, x: str, y: str) -> DataFrame:
    """The first n shots in order with their offsets from their mean, which is the working source: (order, x, y, mean_x, mean_y, dx, dy). n is the size of an array of sources."""
    first = shots.orderBy(*order).limit(n).select(*dict.fromkeys([*order, x, y]))
    mean = first.agg(F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"))
    return first.crossJoin(F.broadcast(mean)).withColumns({"dx": F.col(x) - F.col("mean_x"), "dy": F.col(y) - F.col("mean_y")})


def window_of(ranges: DataFrame, bounds: dict[str, tuple[Column, Column, Column, Column]]) -> DataFrame:
    """Ranges cut to a model's extent. bounds: axis to first and last of the range and of the model; adds <axis>_first, <axis>_last, and inside, whether anything is left."""
    out, inside = ranges, F.lit(True)
    for axis, (a, b, low, high) in bounds.items():
        out = out.withColumns({f"{axis}_first": F.greatest(a, low), f"{axis}_last": F.least(b, high)})
        inside = inside & (F.col(f"{axis}_first") <= F.col(f"{axis}_last"))
    return out.withColumn("inside", inside)


def aperture(traces: DataFrame, shot: str, source: tuple[str, str], receiver: tuple[str, str], pad: tuple[float, float], dimensions: int = 3) -> DataFrame:
    """The range that a shot's sources and receivers span, padded: (shot, x0, x1, y0, y1). Two dimensions leave y at the sources' mean, one x too."""
    out = []
    for k, axis in enumerate("xy"):
        low, high = F.least(F.min(source[k]), F.min(receiver[k])) - pad[k], F.greatest(F.max(source[k]), F.max(receiver[k])) + pad[k]
        flat = dimensions == 1 or dimensions == 2 and axis == "y"
        out += [(F.avg(source[k]) if flat else low).alias(f"{axis}0"), (F.avg(source[k]) if flat else high).alias(f"{axis}1")]
    return traces.groupBy(shot).agg(*out)


def parse_delays(lines: DataFrame, text: str, continuous: float | None = None) -> DataFrame:
    """Lines of a delay file as rows (shot, other, dx, dy, delay). A line is a shot and triples (dx, dy, delay); with continuous, the distance between shots, pairs (other shot, delay), whose dx is the
    shots' distance. Comments behind # and blank lines are skipped; any other count of numbers is an error."""
    words = F.filter(F.split(F.trim(F.regexp_replace(text, "#.*", "")), r"\s+"), lambda w: w != "")
    size = 3 if continuous is None else 2
    kept = lines.select(words.alias("w")).filter(F.size("w") > 0)
    right = F.when((F.size("w") - 1) % size != 0, F.raise_error(F.concat(F.lit("not a delay line: "), F.array_join("w", " ")))).otherwise(F.expr(f"sequence(0, (size(w) - 1) div {size} - 1)"))
    spread = kept.filter(F.size("w") > 1).select("w", F.explode(right).alias("i")).select(F.col("w")[0].cast("bigint").alias("shot"), *(F.element_at("w", (F.col("i") * size + 2 + k).cast("int")).cast("double").alias(f"v{k}") for k in range(size)))
    if continuous is None:
        return spread.select("shot", F.lit(None).cast("bigint").alias("other"), F.col("v0").alias("dx"), F.col("v1").alias("dy"), F.col("v2").alias("delay"))
    other = F.col("v0").cast("bigint")
    return spread.select("shot", other.alias("other"), ((other - F.col("shot")) * continuous).alias("dx"), F.lit(0.0).alias("dy"), F.col("v1").alias("delay"))


def with_template(data: DataFrame, template: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Data rows with the columns of the template row of the same number, in order, within keys. Counts must agree: a row of either side without its match is an error."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).alias("__n")
    a, b = data.select("*", number, F.lit(True).alias("__data")), template.select(*keys, *columns, number, F.lit(True).alias("__template"))
    both = a.join(b, [*keys, "__n"], "full")
    whole = F.assert_true(F.col("__data").isNotNull() & F.col("__template").isNotNull(), "counts of data and template differ")
    return both.filter(whole.isNull()).drop("__n", "__data", "__template")
