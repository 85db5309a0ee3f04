"""Weighted neighbour lookups as equi-joins: correlations over lags, corners, overlaps and as-of places."""

from __future__ import annotations

from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lag_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, half: int, a: Column, b: Column) -> DataFrame:
    """For each key and lag from -half to half, the sum over time t of a(t) b(t + lag). A band predicate would compare all pairs; each left row is spread over its band instead, and times are matched exactly."""
    spread = left.select(*keys, F.col(time).alias("__t"), a.alias("__a")).withColumn("lag", F.explode(F.sequence(F.lit(-half), F.lit(half)))).withColumn("__at", F.col("__t") + F.col("lag"))
    other = right.select(*keys, F.col(time).alias("__at"), b.alias("__b"))
    return spread.join(other, [*keys, "__at"]).groupBy(*keys, "lag").agg(F.sum(F.col("__a") * F.col("__b")).alias("correlation"), F.count(F.lit(1)).alias("n"))


#: Cells of a brick, without those around it; and of a grid that is sent to every task.
BRICK, FEW = 200, 100_000
#: Bytes of a generated method that the JVM's compiler takes; longer ones would run interpreted, so Spark generates the expressions of such a stage one by one. A session setting, which stays set.
HUGE = 8000


def met_bricks(points: DataFrame, axes: list[str], below: int, above: int, cells: DataFrame, value: Column, few: bool) -> tuple[DataFrame, list[tuple[Column, dict[str, int]]]]:
    """Points with __cells, the values of the brick of cells that each lies in, and where in __cells a point's cells from `below` under its base (__i_<axis>) to `above` over it are, with their numbers along each axis.

    A brick holds also the cells around it that its points reach, so a point stays one row, and no row of it is made for each cell. Cells at one place add up. With few, bricks are sent to every task; else both sides are dealt by brick."""
    points.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", HUGE)
    edge, starts = max(1, round(BRICK ** (1 / len(axes)))), [f"__b_{a}" for a in axes]
    wide = edge + below + above
    strides = [wide ** (len(axes) - 1 - n) for n in range(len(axes))]
    start = lambda i: i - F.pmod(i, F.lit(edge))
    held = cells.select(*(F.col(a).cast("bigint").alias(a) for a in axes), value.cast("double").alias("__v"))
    for a in axes:
        held = held.withColumn(f"__b_{a}", F.explode(F.sequence(start(F.col(a) - above), start(F.col(a) + below), F.lit(edge).cast("bigint"))))
    place = reduce(Column.__add__, ((F.col(a) - F.col(f"__b_{a}") + below) * n for a, n in zip(axes, strides, strict=True))).cast("int")
    held = held.groupBy(*starts, place.alias("__p")).agg(F.when(F.count_if(F.col("__v").isNull()) == 0, F.sum("__v")).alias("__v"))
    bricks = held.groupBy(*starts).agg(F.map_from_entries(F.collect_list(F.struct("__p", "__v"))).alias("__m"))
    bricks = bricks.select(*starts, F.transform(F.sequence(F.lit(0), F.lit(wide ** len(axes) - 1)), lambda p: F.try_element_at("__m", p)).alias("__cells"))
    met = points.withColumns({f"__b_{a}": start(F.col(f"__i_{a}")) for a in axes}).join(F.broadcast(bricks) if few else bricks, starts, "left")
    first = reduce(Column.__add__, (F.pmod(f"__i_{a}", F.lit(edge)) * n for a, n in zip(axes, strides, strict=True))).cast("int")
    met = met.withColumn("__first", first)
    around: list[dict[str, int]] = [{}]
    for a in axes:
        around = [{**o, a: k} for o in around for k in range(below + above + 1)]
    return met, [(F.col("__first") + sum(o[a] * n for a, n in zip(axes, strides, strict=True)), o) for o in around]


def based_in(points: DataFrame, at: dict[str, str], shape: dict[str, int], clamp: bool) -> DataFrame:
    """Points with the first of the two cells around them along each axis (__i_<axis>), and how far beyond it they are (__f_<axis>)."""
    for index, c in at.items():
        n = shape[index]
        x = F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(n - 1.0)) if clamp else F.col(c)
        points = points.withColumn(f"__i_{index}", F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(max(0, n - 2))).cast("bigint")).withColumn(f"__f_{index}", x - F.col(f"__i_{index}") if n > 1 else F.lit(0.0))
    return points


def corners(points: DataFrame, keys: list[str], at: dict[str, str], shape: dict[str, int], clamp: bool = False) -> DataFrame:
    """(keys, indices, __w): the cells around each point that have a weight."""
    based, found, places = based_in(points, at, shape, clamp), [[]], []
    for index in at:
        found = [[*corner, (index, k)] for corner in found for k in (0, 1)[: min(2, shape[index])]]
    for corner in found:
        weight = F.lit(1.0)
        for index, k in corner:
            weight = weight * (F.col(f"__f_{index}") if k else 1 - F.col(f"__f_{index}"))
        places.append(F.struct(*((F.col(f"__i_{index}") + k).alias(index) for index, k in corner), weight.alias("__w")))
    return based.select(*keys, F.explode(F.array(*places)).alias("__c")).select(*keys, "__c.*").filter("__w != 0")


def linear(points: DataFrame, keys: list[str], at: dict[str, str], shape: dict[str, int], cells: DataFrame, value: str, clamp: bool = False, reciprocal: bool = False) -> DataFrame:
    """(keys, value) at points between cells, linear along every axis. at: cell index to point column; shape: how many places each axis has; keys: what tells points apart, repeated points too.

    The base cell is clamped into the grid while the fraction is not, so that points outside extrapolate; with clamp they take the nearest edge. With reciprocal 1 / value is interpolated. An axis of
    one place is constant. A point of which a corner with a weight is not there has no value (null). A point stays one row; a grid of few cells by its shape goes to every task.
    """
    based = based_in(points.select(*dict.fromkeys([*keys, *at.values()])), at, shape, clamp).filter(reduce(Column.__and__, (F.col(f"__f_{i}").isNotNull() for i in at)))
    inside = cells.filter(reduce(Column.__and__, (F.col(i).between(0, shape[i] - 1) for i in at)))
    met, places = met_bricks(based, list(at), 0, 1, inside, 1 / F.col(value) if reciprocal else F.col(value), prod(shape[i] for i in at) <= FEW)
    total = F.lit(0.0)
    for place, corner in places:
        if all(k < shape[i] for i, k in corner.items()):
            weight = reduce(Column.__mul__, (F.col(f"__f_{i}") if k else 1 - F.col(f"__f_{i}") for i, k in corner.items()))
            total = total + F.when(weight != 0, weight * F.get("__cells", place)).otherwise(0.0)
    found = met.select(*keys, total.alias("__t")).groupBy(*keys)
    total = F.when(F.count_if(F.col("__t").isNull()) == 0, F.sum("__t"))
    return found.agg((1 / total if reciprocal else total).alias(value))


def bilinear(points: DataFrame, keys: list[str], cells: DataFrame, x: str, y: str, shape: tuple[int, int], value: str) -> DataFrame:
    """Values at points between cells (ix, iy)."""
    return linear(points, keys, {"ix": x, "iy": y}, {"ix": shape[0], "iy": shape[1]}, cells, value)


def nodes(spark: SparkSession, axes: dict[str, tuple[float, float, int]]) -> DataFrame:
    """All places of a regular grid: an index and a coordinate x_<index> for each axis (name: origin, step, count)."""
    count = 1
    for _, _, n in axes.values():
        count *= n
    out, below = spark.range(count), 1
    for index, (origin, step, n) in axes.items():
        i = F.pmod(F.floor(F.col("id") / below), F.lit(n)).cast("bigint")
        out = out.withColumn(index, i).withColumn(f"x_{index}", origin + i * step)
        below *= n
    return out.drop("id")


def regrid(cells: DataFrame, source: dict[str, tuple[float, float, int]], target: dict[str, tuple[float, float, int]], value: str, reciprocal: bool = False, clamp: bool = True) -> DataFrame:
    """Values of a volume at the places of another grid, edges clamped; axes as (origin, step, count). With reciprocal the slowness of velocities is interpolated."""
    grid = nodes(cells.sparkSession, target)
    points = grid.select(*target, *(((F.col(f"x_{a}") - source[a][0]) / source[a][1]).alias(f"__at_{a}") for a in source)).select(*(F.col(a).alias(f"__to_{a}") for a in target), *(f"__at_{a}" for a in source))
    out = linear(points, [f"__to_{a}" for a in target], {a: f"__at_{a}" for a in source}, {a: n for a, (_, _, n) in source.items()}, cells, value, clamp, reciprocal)
    return out.select(*(F.col(f"__to_{a}").alias(a) for a in target), value)


def interval_average(cells: DataFrame, low: Column, high: Column, value: Column, width: float, keys: list[str] | None = None) -> DataFrame:
    """Length-weighted averages of cells [low, high) over bins of the given width, within keys: each cell is spread over the bins it overlaps."""
    keys = keys or []
    spread = cells.select(*keys, low.alias("lo"), high.alias("hi"), value.alias("v")).filter(F.col("hi") > F.col("lo"))
    spread = spread.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.ceil(F.col("hi") / width) - 1)))
    length = F.least(F.col("hi"), (F.col("bin") + 1) * F.lit(width)) - F.greatest(F.col("lo"), F.col("bin") * F.lit(width))
    return spread.withColumn("length", length).groupBy(*keys, "bin").agg((F.sum(F.col("length") * F.col("v")) / F.sum("length")).alias("average"), F.sum("length").alias("covered"))


def layered(cells: DataFrame, points: DataFrame, keys: list[str], at: dict[str, str], shape: dict[str, int], depth: str, thickness: float, width: float, velocity: str) -> DataFrame:
    """(keys, bin, velocity): at each point the columns of a velocity model, laterally linear in slowness and of mean slowness over depth bins of the given width. A model's column is one row of slownesses by depth; a point
    meets the columns at its corners, four at most, and combines them by depth. A depth that one of them lacks has no velocity."""
    columns = cells.groupBy(*at).agg(F.map_from_entries(F.collect_list(F.struct(F.col(depth).alias("d"), (1 / F.col(velocity)).alias("s")))).alias("__column"))
    met = corners(points, keys, at, shape, clamp=True).join(columns, list(at), "left").groupBy(*keys).agg(F.collect_list(F.struct(F.col("__w").alias("w"), F.col("__column").alias("c"))).alias("__found"))
    # Of a missing column, and of a depth that a column lacks, comes null.
    sums = lambda d: F.aggregate("__found", F.lit(0.0), lambda t, e: t + e["w"] * F.try_element_at(e["c"], d))
    depths = F.transform(F.map_keys(F.col("__found")[0]["c"]), lambda d: F.struct(d.alias("d"), sums(d).alias("s")))
    known = met.select(*keys, F.explode(depths).alias("__d")).filter("__d.s IS NOT NULL")
    out = interval_average(known, F.col("__d.d") * thickness, (F.col("__d.d") + 1) * thickness, F.col("__d.s"), width, keys)
    return out.select(*keys, "bin", (1 / F.col("average")).alias(velocity), "covered")


def as_of(rows: DataFrame, keys: list[str], at: str, table: DataFrame, table_at: str, columns: list[str], width: float = 64.0) -> DataFrame:
    """Each row with the table's columns at the last place not beyond it, within keys; of several rows at one place the greatest by the columns in turn.

    Places are cut into buckets of a width. What a bucket has before it is the last place of an earlier bucket, carried over the buckets of a key; within a bucket the distinct places of both sides are ordered together, and
    rows find theirs by equality. So a window holds one bucket, or a row for each bucket, not a key's rows."""
    bucket = F.floor(F.col("__at") / F.lit(width)).alias("__bucket")
    known = table.filter(F.col(table_at).isNotNull()).groupBy(*keys, F.col(table_at).alias("__at")).agg(F.max(F.struct(*columns)).alias("__t")).select("*", bucket)
    asked = rows.select(*keys, F.col(at).alias("__at")).distinct().select("*", bucket)
    ends = known.groupBy(*keys, "__bucket").agg(F.max_by("__t", "__at").alias("__last"))
    every = ends.unionByName(asked.select(*keys, "__bucket").distinct(), allowMissingColumns=True).groupBy(*keys, "__bucket").agg(F.max("__last").alias("__last"))
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(*keys, "__bucket", F.last("__last", ignorenulls=True).over(earlier).alias("__carried"))
    within = Window.partitionBy(*keys, "__bucket").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = asked.withColumn("__side", F.lit(1)).unionByName(known.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    placed = both.withColumn("__t", F.last("__t", ignorenulls=True).over(within)).filter("__side = 1")
    same = lambda a, b, names: reduce(Column.__and__, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names))
    found = placed.alias("__p").join(carried.alias("__c"), same("__p", "__c", [*keys, "__bucket"])).select("__p.*", F.coalesce("__t", "__carried").alias("__found"))
    matched = F.col(f"__rows.{at}").eqNullSafe(F.col("__f.__at"))
    if keys:
        matched &= same("__rows", "__f", keys)
    return rows.alias("__rows").join(found.alias("__f"), matched).select("__rows.*", *(F.col("__f.__found").getField(c).alias(c) for c in columns))


def axis_index(z: Column, axis: list[float]) -> Column:
    """Where a coordinate lies on an uneven axis, in places and fractions of the step to the next; on the axis' ends beyond them. The place is found by halving, so the axis may be long."""
    table, n = F.array(*map(F.lit, map(float, axis))), len(axis)
    if n == 1:
        return F.lit(0.0)
    steps = [1 << k for k in range(n.bit_length() - 1, -1, -1)]
    low = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when((at + step <= n - 2) & (F.get(table, at + step) <= z), at + step).otherwise(at))
    a, b = F.get(table, low), F.get(table, low + 1)
    return F.greatest(F.lit(0.0), F.least(F.lit(n - 1.0), low + (z - a) / (b - a)))


def mirror(cells: DataFrame, keys: list[str], index: str, surface: int, value: str, sign: int) -> DataFrame:
    """Cells above the surface index set to the mirror image below it, times sign; the surface itself is zero for an odd field."""
    image = cells.select(*keys, (2 * surface - F.col(index)).alias(index), F.col(value).alias("__image"))
    joined = cells.join(image, [*keys, index], "left")
    inside = F.when(F.col(index) < surface, F.coalesce(sign * F.col("__image"), F.lit(0.0))).when((F.col(index) == surface) & F.lit(sign < 0), 0.0).otherwise(F.col(value))
    return joined.withColumn(value, inside).drop("__image")


def difference(first: DataFrame, second: DataFrame, keys: list[str], value: str) -> DataFrame:
    """first minus second on matching keys; what only one pass has stays as it is, negated for the second."""
    b = second.select(*keys, F.col(value).alias("__b"))
    return first.join(b, keys, "full").select(*keys, (F.coalesce(F.col(value), F.lit(0)) - F.coalesce("__b", F.lit(0))).alias(value))


def mismatches(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float, guard: float = 1e-12) -> DataFrame:
    """Cells whose relative difference is beyond the tolerance, with that difference."""
    joined = a.join(b.select(*keys, F.col(value).alias("__b")), keys)
    off = F.abs(F.col(value) - F.col("__b")) / F.greatest(F.abs(F.col(value)), F.abs("__b"), F.lit(guard))
    return joined.select(*keys, F.col(value).alias("a"), F.col("__b").alias("b"), off.alias("relative")).filter(F.col("relative") > tolerance)


def weight_of(x: Column, ix: Column, half: int) -> Column:
    """The weight of cell ix for a place x: linear for half 1, a windowed sinc over 2 half cells beyond that."""
    t = F.abs(x - ix)
    if half == 1:
        return 1 - t
    a, b = t * 3.141592653589793, t * (3.141592653589793 / half)
    return F.when(t < 1e-9, 1.0).otherwise(F.sin(a) / a * F.sin(b) / b)


def spread_weights(places: DataFrame, x: str, half: int, index: str = "ix", weight: str = "w") -> DataFrame:
    """Each place with the cells (index) it touches along an axis and their weights: linear for half 1, a windowed sinc over 2 half cells beyond that. A weight that is there already is multiplied by it."""
    base = F.floor(x)
    cells = F.transform(F.sequence(F.lit(1 - half), F.lit(half)), lambda k: (base + k).cast("bigint"))
    touched = F.transform(cells, lambda ix: F.struct(ix.alias("ix"), weight_of(F.col(x), ix, half).alias("w")))
    own = F.col("__t.w") * F.col(weight) if weight in places.columns else F.col("__t.w")
    return places.withColumn("__t", F.explode(touched)).withColumns({index: F.col("__t.ix"), weight: own}).drop("__t")


def band_limited(x: Column, ix: Column, reach: Column, low: float, high: float, dipole: bool = False) -> Column:
    """The weight of cell ix for a band-limited impulse at x that touches 2 reach cells. low, high: where the band begins to fall and ends, in cycles a cell; alike, or for a dipole, it is a sinc (or its slope) in
    a Blackman window, else the difference of two squared sincs whose outer cells are tapered by cosines."""
    pi = 3.141592653589793
    t, first = ix - x, F.floor(x) - reach + 1
    last = F.floor(x) + reach
    if low == high or dipole:
        a = 2 * low * pi * t
        wide = F.greatest(last - x, x - first)
        shape = F.when(F.abs(a) < 1e-4, -a / 3 if dipole else F.lit(1.0)).otherwise(F.cos(a) / a - F.sin(a) / (a * a) if dipole else F.sin(a) / a)
        angle = pi * (wide + t) / wide
        return 2 * low * shape * F.when(reach > 1, 0.42 - 0.5 * F.cos(angle) + 0.08 * F.cos(2 * angle)).otherwise(1.0)
    a1, a2 = low * pi, high * pi
    square = lambda a: F.when(F.abs(t) < 1e-9, F.lit(1.0)).otherwise(F.pow(F.sin(a * t) / (a * t), F.lit(2.0)))
    edge, taper = F.least(ix - first, last - ix), F.floor(reach / 2)
    return (a2 * a2 * square(a2) - a1 * a1 * square(a1)) / pi / (a2 - a1) * F.when((edge < taper) & (reach > 1), 0.5 - 0.5 * F.cos(pi * edge / taper)).otherwise(1.0)


def spread_band(places: DataFrame, x: str, n: int, half: int, low: float, high: float, dipole: bool = False, index: str = "ix", weight: str = "w") -> DataFrame:
    """spread_weights() of a band-limited impulse, or its slope, on an axis of n cells: 2 half cells, fewer near the ends, as many on both sides; of one cell the weight is 1. Places outside, or where no cell lies beyond, touch none. So gather() and scatter() of
    these weights are each other's adjoint."""
    if not 0 < low <= high <= 0.5:
        raise ValueError("a band begins to fall above 0 and ends at 0.5 at most, not before it falls")
    if n == 1:
        if dipole:
            raise ValueError("one cell has no slope")
        touched = F.array(F.struct(F.lit(0).cast("bigint").alias("ix"), F.lit(1.0).alias("w")))
    else:
        base = F.floor(x).cast("bigint")
        reach = F.least(F.lit(half).cast("bigint"), base, n - 1 - base)
        cells = F.filter(F.transform(F.sequence(F.lit(1 - half), F.lit(half)), lambda k: (base + k).cast("bigint")), lambda ix: (ix > base - reach) & (ix <= base + reach))
        touched = F.transform(cells, lambda ix: F.struct(ix.alias("ix"), band_limited(F.col(x), ix, reach, low, high, dipole).alias("w")))
    own = F.col("__t.w") * F.col(weight) if weight in places.columns else F.col("__t.w")
    return places.withColumn("__t", F.explode(touched)).withColumns({index: F.col("__t.ix"), weight: own}).drop("__t")


def gather_bands(receivers: DataFrame, keys: list[str], x: str, n: int, half: int, bands: dict[str, tuple[float, float, bool]], cells: DataFrame, value: str) -> DataFrame:
    """Receivers with what each band (name: low, high, dipole) reads from the cells of a line around them: each cell is looked up once, whatever the number of bands. Receivers that touch no cell read zero."""
    base, reached = F.floor(x).cast("bigint"), F.least(F.lit(half).cast("bigint"), F.floor(x).cast("bigint"), n - 1 - F.floor(x).cast("bigint"))
    offsets = F.filter(F.sequence(F.lit(1 - half), F.lit(half)), lambda k: (k > -reached) & (k <= reached))
    touched = receivers.select(*keys, F.col(x).alias("__x"), reached.alias("__m"), base.alias("__base"), F.explode_outer(offsets).alias("__k")).withColumn("ix", F.col("__base") + F.col("__k"))
    weights = {name: band_limited(F.col("__x"), F.col("ix"), F.col("__m"), *band) for name, band in bands.items()}
    found = touched.join(cells.select("ix", F.col(value).alias("__v")), "ix", "left").groupBy(*keys)
    return found.agg(*(F.coalesce(F.sum(w * F.col("__v")), F.lit(0.0)).alias(name) for name, w in weights.items()))


def spread_axes(places: DataFrame, at: dict[str, str], half: int) -> DataFrame:
    """spread_weights() along several axes (cell index to column), weights multiplied."""
    for index, x in at.items():
        places = spread_weights(places, x, half, index)
    return places


def read_around(receivers: DataFrame, at: dict[str, str], cells: DataFrame, value: str, half: int = 1, few: bool = False) -> DataFrame:
    """Receivers with __read: the weighted sum of the cells each touches along all axes (cell index to column), as in gather()."""
    based = receivers.withColumns({f"__i_{a}": F.floor(x) for a, x in at.items()})
    based = based.withColumns({f"__w_{a}": F.array(*(weight_of(F.col(x), F.col(f"__i_{a}") + k, half) for k in range(1 - half, half + 1))) for a, x in at.items()})
    met, places = met_bricks(based, list(at), half - 1, half, cells, F.coalesce(value, F.lit(0)), few)
    total = F.lit(0.0)
    for place, offsets in places:
        weight = reduce(Column.__mul__, (F.get(f"__w_{a}", F.lit(k)) for a, k in offsets.items()))
        total = total + weight * F.coalesce(F.get("__cells", place), F.lit(0.0))
    return met.select(*receivers.columns, total.alias("__read"))


def gather(receivers: DataFrame, keys: list[str], at: dict[str, str], cells: DataFrame, value: str, half: int = 1, few: bool = False) -> DataFrame:
    """A field's value at each receiver: the weighted sum of the cells it touches along all axes (cell index to column); cells that are not there count as zero. keys tell receivers apart, repeated places too. few: the cells fit every task."""
    read = read_around(receivers.select(*dict.fromkeys([*keys, *at.values()])), at, cells, value, half, few)
    return read.groupBy(*keys).agg(F.sum("__read").alias(value))


def scatter(sources: DataFrame, at: dict[str, str], amplitude: str, half: int = 1) -> DataFrame:
    """What sources add to each cell (indices, added); the adjoint of gather, with partial sums before the shuffle."""
    return spread_axes(sources, at, half).groupBy(*at).agg(F.sum(F.col("w") * F.col(amplitude)).alias("added"))


def gather_less_ghost(receivers: DataFrame, keys: list[str], at: dict[str, str], depth: str, surface: float, cells: DataFrame, value: str, half: int = 1, few: bool = False) -> DataFrame:
    """gather() less what the mirror image of each receiver about the surface reads, a row a receiver. depth: the axis that is mirrored."""
    read = read_around(receivers.select(*dict.fromkeys([*keys, *at.values()])), at, cells, value, half, few)
    image = read.select("*", F.col("__read").alias("__own"), (2 * surface - F.col(at[depth])).alias("__image")).drop("__read")
    both = read_around(image, at | {depth: "__image"}, cells, value, half, few)
    return both.groupBy(*keys).agg(F.sum(F.col("__own") - F.col("__read")).alias(value))


def inject(sources: DataFrame, at: dict[str, str], amplitude: str, velocity: DataFrame, speed: str, dt: float, depth: str | None = None, surface: float = 0.0, half: int = 1) -> DataFrame:
    """(indices, added): what sources add to the cells of a velocity model, times (speed dt) squared; with a depth axis less their mirror images about the surface. Only cells of the model."""
    both = sources.select(*at.values(), amplitude)
    if depth is not None:
        x = at[depth]
        both = both.unionByName(both.withColumns({x: 2 * surface - F.col(x), amplitude: -F.col(amplitude)}))
    added = scatter(both, at, amplitude, half)
    return added.join(velocity.select(*at, speed), list(at)).select(*at, (F.col("added") * F.pow(F.col(speed) * dt, F.lit(2.0))).alias("added"))
