"""Registered queries on volumes, vectors, tapers and surveys, and SQL that gives the same rows.

A volume is made of the line items: cells (ix, iy, iz) by part, supplier and line number, with the summed
quantity as value. It has the holes that the table leaves; a small model with values everywhere comes from
the parts.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wavefold.functions import traces, wavelets
from wavefold.functions.kernels import weights
from wavefold.operators import axes, frames, gathers, lookups, models, receivers, reductions, stencils, tapers, vectors, volumes, weave
from wavefold.plans.catalogue import around_sql, big, difference_sql
from wavefold.plans.registry import query
from wavefold.sources import cubes, images, records
from wavefold.sources.tables import extract_shots, load, save, shared_folder, store_shots, table

NX, NY, NZ = 12, 6, 7
AXES = ["ix", "iy", "iz"]
_CELL = f"l_partkey % {NX} AS ix, l_suppkey % {NY} AS iy, (l_linenumber - 1)::BIGINT AS iz"
_VOLUME = f"(SELECT {_CELL}, sum(l_quantity)::BIGINT::DOUBLE AS v FROM lineitem GROUP BY 1, 2, 3)"
_DENSITY = f"(SELECT {_CELL}, count(*)::DOUBLE AS v FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2, 3)"


def _cell() -> list[Column]:
    return [(F.col("l_partkey") % NX).alias("ix"), (F.col("l_suppkey") % NY).alias("iy"), (F.col("l_linenumber") - 1).cast("bigint").alias("iz")]


def _volume(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(*_cell()).agg(F.sum("l_quantity").alias("v"))


def _density(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").filter("l_returnflag <> 'R'").groupBy(*_cell()).agg(F.count(F.lit(1)).cast("double").alias("v"))


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) + 0.0 for n in names})


# Filters along several axes


def _chain_sql(rows: str, axes: list[str], steps: list[tuple[str, int, str]]) -> str:
    """Filters one after another; a step is its axis, half width and the SQL of its result over k and v."""
    for axis, half, result in steps:
        keys = [a for a in axes if a != axis]
        rows = f"(SELECT {', '.join([*keys, axis])}, {result} AS v FROM {around_sql(rows, keys, axis, half)} GROUP BY {', '.join([*keys, axis])})"
    return rows


_MEDIAN = "list_sort(list(v))[(count(*)::INT + 1) // 2]"


def _weighted(w: list[float]) -> str:
    half = len(w) // 2
    case = "CASE k " + " ".join(f"WHEN {k - half} THEN {x!r}::DOUBLE" for k, x in enumerate(w)) + " END"
    return f"sum({case} * v) / sum({case})"


@query(f"SELECT ix, iy, iz, round(v, 5) + 0.0 AS v FROM {_chain_sql(_VOLUME, AXES, [('iy', 1, 'avg(v)'), ('ix', 2, 'avg(v)'), ('iz', 1, 'avg(v)')])}")
def mean_3d(spark: SparkSession, d: str) -> DataFrame:
    steps = [("iy", stencils.mean_along("v", 1)), ("ix", stencils.mean_along("v", 2)), ("iz", stencils.mean_along("v", 1))]
    return _rounded(stencils.along_axes(_volume(spark, d), [], AXES, "v", steps), 5, "v")


@query(f"SELECT ix, iy, iz, v FROM {_chain_sql(_VOLUME, AXES, [('iy', 1, _MEDIAN), ('ix', 1, _MEDIAN), ('iz', 1, _MEDIAN)])}")
def median_3d(spark: SparkSession, d: str) -> DataFrame:
    return stencils.along_axes(_volume(spark, d), [], AXES, "v", [(a, stencils.median_along("v")) for a in ("iy", "ix", "iz")])


@query(f"SELECT ix, iy, iz, round(v, 5) + 0.0 AS v FROM {_chain_sql(_VOLUME, AXES, [(a, 1, _weighted(stencils.QUARTERS)) for a in ('iz', 'ix', 'iy')])}")
def smooth_3d(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stencils.along_axes(_volume(spark, d), [], AXES, "v", [(a, stencils.weighted_along("v", stencils.QUARTERS)) for a in ("iz", "ix", "iy")]), 5, "v")


@query(f"SELECT ix, iy, iz, round(v, 5) + 0.0 AS v FROM {_chain_sql(_VOLUME, AXES, [('ix', 1, 'avg(v)'), ('iy', 1, 'avg(v)'), ('iz', 1, _weighted(stencils.SMOOTH_3))])}")
def mean_xy_smooth_z(spark: SparkSession, d: str) -> DataFrame:
    steps = [("ix", stencils.mean_along("v", 1)), ("iy", stencils.mean_along("v", 1)), ("iz", stencils.weighted_along("v", stencils.SMOOTH_3))]
    return _rounded(stencils.along_axes(_volume(spark, d), [], AXES, "v", steps), 5, "v")


@query(f"SELECT ix, iy, iz, round(v, 5) + 0.0 AS v FROM {_chain_sql(_VOLUME, AXES, [('ix', 1, _MEDIAN), ('ix', 1, _weighted(stencils.MEAN_3)), ('iy', 1, _MEDIAN), ('iy', 1, _weighted(stencils.MEAN_3))])}")
def median_then_mean_2d(spark: SparkSession, d: str) -> DataFrame:
    steps = [(a, f) for a in ("ix", "iy") for f in (stencils.median_along("v"), stencils.weighted_along("v", stencils.MEAN_3))]
    return _rounded(stencils.along_axes(_volume(spark, d), [], AXES, "v", steps), 5, "v")


@query(f"SELECT ix, iy, iz, round(v, 5) + 0.0 AS v FROM {_chain_sql(_VOLUME, AXES, [('ix', 2, _weighted(stencils.SMOOTH_5)), ('iy', 1, _weighted(stencils.SMOOTH_3))])}")
def average_2d(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stencils.along_axes(_volume(spark, d), [], AXES, "v", [("ix", stencils.weighted_along("v", stencils.SMOOTH_5)), ("iy", stencils.weighted_along("v", stencils.SMOOTH_3))]), 5, "v")


_STEP_LEAST = "SELECT iz, CASE WHEN a IS NULL AND b IS NULL THEN v WHEN a IS NULL THEN least(v, (v + b) / 2) WHEN b IS NULL THEN least(v, (v + a) / 2) ELSE least(v, (a + 2 * v + b) / 4) END AS v FROM (SELECT *, lag(v) OVER (ORDER BY iz) AS a, lead(v) OVER (ORDER BY iz) AS b FROM ({}))"


@query(f"SELECT iz, round(v, 6) + 0.0 AS v FROM ({_STEP_LEAST.format(_STEP_LEAST.format(_STEP_LEAST.format('SELECT p_size AS iz, min(p_retailprice) AS v FROM part GROUP BY 1')))})")
def least_velocity_profile(spark: SparkSession, d: str) -> DataFrame:
    profile = table(spark, d, "part").groupBy(F.col("p_size").alias("iz")).agg(F.min("p_retailprice").alias("v"))
    return _rounded(stencils.smooth_least(profile, [], "iz", "v", 3), 6, "v")


# Derivatives of volumes

_D = {a: difference_sql(_VOLUME, [k for k in AXES if k != a], a, 8, False) for a in AXES}
_D2 = {a: difference_sql(_VOLUME, [k for k in AXES if k != a], a, 12, True) for a in AXES}


@query(f"SELECT ix, iy, iz, round(x.d / 12.7, 5) + 0.0 AS d_ix, round(y.d / 25.3, 5) + 0.0 AS d_iy, round(z.d / 7.1, 5) + 0.0 AS d_iz FROM {_D['ix']} x JOIN {_D['iy']} y USING (ix, iy, iz) JOIN {_D['iz']} z USING (ix, iy, iz)")
def gradient_3d(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stencils.gradient(_volume(spark, d), [], {"ix": 12.7, "iy": 25.3, "iz": 7.1}, "v").drop("v"), 5, "d_ix", "d_iy", "d_iz")


@query(f"SELECT ix, iy, iz, round(x.d / 12.7 + y.d / 25.3, 5) + 0.0 AS divergence FROM {_D['ix']} x JOIN {_D['iy'].replace('sum(l_quantity)::BIGINT::DOUBLE', 'sum(l_linenumber)::BIGINT::DOUBLE')} y USING (ix, iy, iz)")
def divergence_2d(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "lineitem").groupBy(*_cell()).agg(F.sum("l_quantity").alias("v"), F.sum("l_linenumber").cast("double").alias("u"))
    out = stencils.divergence(both, ["iz"], {"ix": ("v", 12.7), "iy": ("u", 25.3)}, "divergence")
    return _rounded(out, 5, "divergence").select(*AXES, "divergence")


@query(f"SELECT ix, iy, iz, round(x.d / (12.7 * 12.7) + y.d / (25.3 * 25.3) + z.d / (7.1 * 7.1), 5) + 0.0 AS laplacian FROM {_D2['ix']} x JOIN {_D2['iy']} y USING (ix, iy, iz) JOIN {_D2['iz']} z USING (ix, iy, iz)")
def laplacian_3d(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stencils.laplacian(_volume(spark, d), [], {"ix": 12.7, "iy": 25.3, "iz": 7.1}, "v", accuracy=12), 5, "laplacian")


# Lookups between cells

_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_ID = ", ".join(_KEYS)


def _linear_sql(points: str, keys: str, axes: dict[str, int], cells: str, clamp: bool, reciprocal: bool) -> str:
    """Values at points (keys, x_<axis>) between cells, all corners by one join on ranges of each axis."""
    at = {a: f"least(greatest(x_{a}, 0), {n - 1})" if clamp else f"x_{a}" for a, n in axes.items()}
    base = ", ".join(f"least(greatest(floor({at[a]}), 0), {max(0, n - 2)})::BIGINT AS b_{a}, {at[a]} AS p_{a}" for a, n in axes.items())
    weight = " * ".join(f"(CASE WHEN {n} = 1 THEN 1 WHEN c_{a} = 1 THEN p_{a} - b_{a} ELSE 1 - (p_{a} - b_{a}) END)" for a, n in axes.items())
    corners = "".join(f", (SELECT unnest(range({min(2, n)})) AS c_{a})" for a, n in axes.items())
    match = " AND ".join(f"g.{a} = b_{a} + c_{a}" for a in axes)
    value = "1 / g.v" if reciprocal else "g.v"
    total = "CASE WHEN count(*) FILTER (v IS NULL) = 0 THEN sum(w * v) END"
    return f"(SELECT {keys}, {f'1 / ({total})' if reciprocal else total} AS v FROM (SELECT {keys}, w, {value} AS v FROM (SELECT *, {weight} AS w FROM (SELECT *, {base} FROM {points}){corners}) LEFT JOIN {cells} g ON {match} WHERE w <> 0) GROUP BY {keys})"


_SHAPE = {"ix": NX, "iy": NY, "iz": NZ}
_POINTS = f"(SELECT {_ID}, l_quantity / 4.3 - 0.6 AS x_ix, l_discount / 0.0171 - 0.2 AS x_iy, l_tax / 0.0113 - 0.4 AS x_iz FROM lineitem)"


def _points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(*_KEYS, (F.col("l_quantity") / 4.3 - 0.6).alias("x_ix"), (F.col("l_discount") / 0.0171 - 0.2).alias("x_iy"), (F.col("l_tax") / 0.0113 - 0.4).alias("x_iz"))


_AT = {a: f"x_{a}" for a in AXES}


@query(f"SELECT {_ID}, round(v, 5) + 0.0 AS v FROM {_linear_sql(_POINTS, _ID, _SHAPE, _VOLUME, False, False)}")
def trilinear(spark: SparkSession, d: str) -> DataFrame:
    """Every line item is a point of its own; those outside the volume extrapolate, those next to a hole have no value."""
    return _rounded(lookups.linear(_points(spark, d), _KEYS, _AT, _SHAPE, _volume(spark, d), "v"), 5, "v")


@query(f"SELECT {_ID}, round(v, 5) + 0.0 AS v FROM {_linear_sql(_POINTS, _ID, _SHAPE, _VOLUME, True, True)}")
def trilinear_slowness(spark: SparkSession, d: str) -> DataFrame:
    """Edges clamped, slowness interpolated."""
    return _rounded(lookups.linear(_points(spark, d), _KEYS, _AT, _SHAPE, _volume(spark, d), "v", clamp=True, reciprocal=True), 5, "v")


_NODES = "(SELECT jx, jy, jz, ((30.0 + jx * 7.5) - 25.0) / 12.5 AS x_ix, ((10.0 + jy * 10.0) - 20.0) / 25.0 AS x_iy, ((0.0 + jz * 3.1) - 2.0) / 5.0 AS x_iz FROM (SELECT unnest(range(25)) AS jx), (SELECT unnest(range(18)) AS jy), (SELECT unnest(range(14)) AS jz))"


@query(f"SELECT jx AS ix, jy AS iy, jz AS iz, round(v, 5) + 0.0 AS v FROM {_linear_sql(_NODES, 'jx, jy, jz', _SHAPE, _VOLUME, True, True)}")
def regrid_volume(spark: SparkSession, d: str) -> DataFrame:
    """Onto a finer grid that overlaps the volume's, by slowness."""
    source = {"ix": (25.0, 12.5, NX), "iy": (20.0, 25.0, NY), "iz": (2.0, 5.0, NZ)}
    target = {"ix": (30.0, 7.5, 25), "iy": (10.0, 10.0, 18), "iz": (0.0, 3.1, 14)}
    return _rounded(lookups.regrid(_volume(spark, d), source, target, "v", reciprocal=True), 5, "v")


_LAYERS = f"(SELECT p.o_orderkey, z.iz AS layer, x_ix, x_iy, z.iz::DOUBLE AS x_iz FROM (SELECT o_orderkey, (o_custkey % 97) / 9.7 AS x_ix, (o_orderkey % 53) / 11.3 AS x_iy FROM orders) p, (SELECT DISTINCT iz FROM {_VOLUME}) z)"


@query(f"""
    WITH l AS (SELECT o_orderkey, layer * 5.0 AS lo, (layer + 1) * 5.0 AS hi, v FROM {_linear_sql(_LAYERS, 'o_orderkey, layer', _SHAPE, _VOLUME, True, True)} WHERE v IS NOT NULL),
    s AS (SELECT *, unnest(range(floor(lo / 8.0)::BIGINT, ceil(hi / 8.0)::BIGINT)) AS bin FROM l)
    SELECT o_orderkey, bin, round(sum(least(hi, (bin + 1) * 8.0) - greatest(lo, bin * 8.0)) / sum((least(hi, (bin + 1) * 8.0) - greatest(lo, bin * 8.0)) / v), 5) + 0.0 AS v FROM s GROUP BY 1, 2
""")
def layered_velocity(spark: SparkSession, d: str) -> DataFrame:
    """The column below each shot: laterally linear at all depths, then of mean slowness over thicker layers."""
    shots = table(spark, d, "orders").select("o_orderkey", ((F.col("o_custkey") % 97) / 9.7).alias("x_ix"), ((F.col("o_orderkey") % 53) / 11.3).alias("x_iy"))
    out = lookups.layered(_volume(spark, d), shots, ["o_orderkey"], {"ix": "x_ix", "iy": "x_iy"}, {"ix": NX, "iy": NY}, "iz", 5.0, 8.0, "v")
    return _rounded(out.drop("covered"), 5, "v")


def _sinc_sql(axis: str, half: int) -> str:
    t = f"abs(x_{axis} - c_{axis})"
    return f"(CASE WHEN {t} < 1e-9 THEN 1 ELSE sin(pi() * {t}) / (pi() * {t}) * sin(pi() * {t} / {half}) / (pi() * {t} / {half}) END)"


@query(f"""
    WITH a AS (SELECT *, floor(x_ix)::BIGINT + k AS c_ix FROM {_POINTS}, (SELECT unnest(range(-2, 4)) AS k)),
    b AS (SELECT *, floor(x_iy)::BIGINT + j AS c_iy FROM a, (SELECT unnest(range(-2, 4)) AS j))
    SELECT {_ID}, round(sum({_sinc_sql('ix', 3)} * {_sinc_sql('iy', 3)} * coalesce(v, 0)), 5) + 0.0 AS v FROM b LEFT JOIN (SELECT ix, iy, sum(v) AS v FROM {_VOLUME} GROUP BY 1, 2) ON ix = c_ix AND iy = c_iy GROUP BY {_ID}
""")
def interpolate_2d(spark: SparkSession, d: str) -> DataFrame:
    """A windowed sinc along both axes of a map; cells that are not there count as zero."""
    cells = _volume(spark, d).groupBy("ix", "iy").agg(F.sum("v").alias("v"))  # of a remainder each, so 23 x 11 at most
    return _rounded(lookups.gather(_points(spark, d), _KEYS, {"ix": "x_ix", "iy": "x_iy"}, cells, "v", 3, few=True), 5, "v")


def _one_sql(axis: str, k: str) -> str:
    return f"(CASE {k} WHEN 1 THEN x_{axis} - floor(x_{axis}) ELSE 1 - (x_{axis} - floor(x_{axis})) END)"


@query(f"""
    WITH p AS (SELECT l_quantity, l_quantity / 4.3 - 0.6 AS x_ix, l_discount / 0.0171 - 0.2 AS x_iy, l_tax / 0.0113 - 0.4 AS x_iz FROM lineitem)
    SELECT floor(x_ix)::BIGINT + a AS ix, floor(x_iy)::BIGINT + b AS iy, floor(x_iz)::BIGINT + c AS iz, round(sum({_one_sql('ix', 'a')} * {_one_sql('iy', 'b')} * {_one_sql('iz', 'c')} * l_quantity), 4) + 0.0 AS added
    FROM p, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b), (SELECT unnest([0, 1]) AS c) GROUP BY 1, 2, 3
""")
def scatter_3d(spark: SparkSession, d: str) -> DataFrame:
    """Separable weights along three axes, summed up by cell."""
    points = table(spark, d, "lineitem").select("l_quantity", (F.col("l_quantity") / 4.3 - 0.6).alias("x_ix"), (F.col("l_discount") / 0.0171 - 0.2).alias("x_iy"), (F.col("l_tax") / 0.0113 - 0.4).alias("x_iz"))
    return _rounded(lookups.scatter(points, _AT, "l_quantity"), 4, "added")


# Weights by matrix: uneven axes and half-sample shifts

_UNEVEN = "i + 0.01 * i * i + 0.3 * (i % 3)"


@query(f"""
    WITH t AS (SELECT vec_id, embedding AS e, len(embedding) AS n FROM embeddings WHERE len(embedding) > 1),
    a AS (SELECT n, list_transform(range(n), lambda i: ({_UNEVEN})::DOUBLE) AS z FROM (SELECT DISTINCT n FROM t)),
    p AS (SELECT n, z, i, i * 1.25 - 1.0 AS p FROM (SELECT n, z, unnest(range(ceil((z[n] + 2.0) / 1.25)::BIGINT)) AS i FROM a)),
    b AS (SELECT *, least(greatest(len(list_filter(z, lambda v: v <= p)) - 1, 0), n - 2) AS base FROM p),
    r AS (SELECT *, CASE WHEN p < z[1] OR p > z[n] THEN 1 ELSE least(4, base + 1, n - 1 - base) END AS room FROM b),
    u AS (SELECT *, list_slice(z, (base - room + 2)::BIGINT, (base + room + 1)::BIGINT) AS used FROM r),
    w AS (SELECT n, i, base, room, list_transform(used, lambda zj: list_aggregate(list_transform(list_filter(used, lambda zm: zm <> zj), lambda zm: (p - zm) / (zj - zm)), 'product')) AS ws FROM u)
    SELECT vec_id, i::BIGINT AS i, round(list_dot_product(ws, list_transform(list_slice(e, (base - room + 2)::BIGINT, (base + room + 1)::BIGINT), lambda v: v::DOUBLE)), 6) + 0.0 AS x FROM t JOIN w USING (n)
""")
def lagrange_uneven(spark: SparkSession, d: str) -> DataFrame:
    """Whole traces as values on an uneven axis, interpolated at even places by polynomials; beyond the ends by straight lines."""
    import numpy as np

    def axis(n: int) -> np.ndarray:
        i = np.arange(n)
        return i + 0.01 * i * i + 0.3 * (i % 3)

    rows = table(spark, d, "embeddings").filter(F.size("embedding") > 1)
    out = axes.resample(rows, ["vec_id"], "embedding", axis, lambda n: 1.25 * np.arange(np.ceil((axis(n)[-1] + 2.0) / 1.25)) - 1.0)
    return _rounded(out.select("vec_id", F.posexplode("samples").alias("i", "x")), 6, "x").select("vec_id", big(F.col("i")).alias("i"), "x")


_DEPTHS = [0.0, 3.0, 7.0, 12.0, 18.5, 25.0, 33.0]


def _uneven_sql(rows: str, keys: list[str], order: int, half: int) -> str:
    """(keys, iz, d): the derivative along the uneven depths, by weights of polynomials in fractions; no matrix is solved."""
    z, terms = [Fraction(x) for x in _DEPTHS], []
    for i in range(len(z)):
        centre = min(max(i, 1), len(z) - 2)
        m = min(half, centre, len(z) - 1 - centre)
        used = range(centre - m, centre + m + 1)
        for j in used:
            basis = [Fraction(1)]  # coefficients of the polynomial in z - z[centre] that is 1 at j and 0 at the other places
            for k in used:
                if k != j:
                    x = z[k] - z[centre]
                    basis = [(a - x * b) / (z[j] - z[k]) for a, b in zip([Fraction(0), *basis], [*basis, Fraction(0)], strict=True)]
            terms.append((i, j, float(basis[order] * order)))
    table = ", ".join(f"({i}, {j}, {w!r}::DOUBLE)" for i, j, w in terms)
    return f"(SELECT {', '.join(f'a.{c}' for c in keys)}, a.iz, coalesce(sum(w.w * n.v), 0) AS d FROM {rows} a JOIN (VALUES {table}) w(i, j, w) ON w.i = a.iz LEFT JOIN {rows} n ON n.iz = w.j AND {' AND '.join(f'n.{c} = a.{c}' for c in keys)} GROUP BY {', '.join(f'a.{c}' for c in keys)}, a.iz)"


@query(f"SELECT ix, iy, iz, round(x.d / (12.7 * 12.7) + y.d / (25.3 * 25.3) + z.d, 5) + 0.0 AS laplacian FROM {difference_sql(_VOLUME, ['iy', 'iz'], 'ix', 8, True)} x JOIN {difference_sql(_VOLUME, ['ix', 'iz'], 'iy', 8, True)} y USING (ix, iy, iz) JOIN {_uneven_sql(_VOLUME, ['ix', 'iy'], 2, 4)} z USING (ix, iy, iz)")
def laplacian_irregular(spark: SparkSession, d: str) -> DataFrame:
    """Second differences along two even axes and along uneven depths, whose weights differ from place to place."""
    return _rounded(axes.laplacian(_volume(spark, d), [], {"ix": 12.7, "iy": 25.3}, "iz", _DEPTHS, "v"), 5, "laplacian")


@query(f"SELECT ix, iy, iz, round(d, 5) + 0.0 AS slope FROM {_uneven_sql(_VOLUME, ['ix', 'iy'], 1, 2)}")
def slope_irregular(spark: SparkSession, d: str) -> DataFrame:
    """The slope along uneven depths."""
    return _rounded(axes.derivative(_volume(spark, d), ["ix", "iy"], "iz", "v", "slope", _DEPTHS, 1, 5), 5, "slope").select(*AXES, "slope")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(greatest(0, least(6, i + (z - a[i + 1]) / (a[i + 2] - a[i + 1]))), 6) + 0.0 AS at FROM (SELECT *, {_DEPTHS}::DOUBLE[] AS a, greatest(0, least(5, len(list_filter({_DEPTHS}::DOUBLE[], lambda x: x <= z)) - 1)) AS i FROM (SELECT *, l_quantity * 0.8 - 2.0 AS z FROM lineitem))")
def depth_places(spark: SparkSession, d: str) -> DataFrame:
    """Where depths lie on an uneven axis, in places and fractions."""
    return table(spark, d, "lineitem").select(*_KEYS, (F.round(lookups.axis_index(F.col("l_quantity") * 0.8 - 2.0, _DEPTHS), 6) + 0.0).alias("at"))


# Band-limited impulses

_BANDS = {"fall": (0.2, 0.4, False), "sinc": (0.25, 0.25, False), "dipole": (0.3, 0.3, True)}
_CELLS, _HALF = 50, 5
_ALONG = f"(SELECT {', '.join(['l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey', 'l_extendedprice'])}, l_quantity, l_partkey % {_CELLS} + l_discount * 9.7 AS x FROM lineitem)"


def _band_sql(low: float, high: float, dipole: bool) -> str:
    t, first, last = "(ix - x)", "(floor(x) - m + 1)", "(floor(x) + m)"
    if low == high or dipole:
        a = f"({2 * low!r} * pi() * {t})"
        wide = f"greatest({last} - x, x - {first})"
        shape = f"CASE WHEN abs({a}) < 1e-4 THEN -{a} / 3 ELSE cos({a}) / {a} - sin({a}) / ({a} * {a}) END" if dipole else f"CASE WHEN abs({a}) < 1e-4 THEN 1 ELSE sin({a}) / {a} END"
        turn = f"(pi() * ({wide} + {t}) / {wide})"
        return f"{2 * low!r} * ({shape}) * CASE WHEN m > 1 THEN 0.42 - 0.5 * cos({turn}) + 0.08 * cos(2 * {turn}) ELSE 1 END"
    square = lambda k: f"(CASE WHEN abs({t}) < 1e-9 THEN 1 ELSE pow(sin({k!r} * pi() * {t}) / ({k!r} * pi() * {t}), 2) END)"
    edge = f"least(ix - {first}, {last} - ix)"
    return f"pi() * ({high!r} * {high!r} * {square(high)} - {low!r} * {low!r} * {square(low)}) / pi() / {high - low!r} * CASE WHEN m > 1 AND {edge} < floor(m / 2) THEN 0.5 - 0.5 * cos(pi() * {edge} / floor(m / 2)) ELSE 1 END"


_REACH = f"(SELECT *, least({_HALF}, floor(x)::BIGINT, {_CELLS - 1} - floor(x)::BIGINT) AS m FROM {_ALONG})"
_TOUCHED = f"(SELECT *, unnest(range(floor(x)::BIGINT - m + 1, floor(x)::BIGINT + m + 1)) AS ix FROM {_REACH} WHERE m > 0)"


def _along(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(*_KEYS, "l_quantity", (F.col("l_partkey") % _CELLS + F.col("l_discount") * 9.7).alias("x"))


@query(" UNION ALL ".join(f"SELECT '{name}' AS band, ix, round(sum({_band_sql(*band)} * l_quantity), 4) + 0.0 AS added FROM {_TOUCHED} GROUP BY ix" for name, band in _BANDS.items()))
def inject_band_limited(spark: SparkSession, d: str) -> DataFrame:
    """What band-limited sources of one pole and of two add to the cells of a line."""
    parts = []
    for name, (low, high, dipole) in _BANDS.items():
        touched = lookups.spread_band(_along(spark, d), "x", _CELLS, _HALF, low, high, dipole)
        parts.append(touched.groupBy("ix").agg(F.sum(F.col("w") * F.col("l_quantity")).alias("added")).select(F.lit(name).alias("band"), "ix", "added"))
    return _rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), 4, "added")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, {', '.join(f'round(coalesce(sum({_band_sql(*band)} * v), 0), 5) + 0.0 AS {name}' for name, band in _BANDS.items())} FROM (SELECT r.*, ix FROM {_REACH} r LEFT JOIN {_TOUCHED} t USING (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) LEFT JOIN (SELECT p_size - 1 AS ix, sum(p_retailprice) AS v FROM part GROUP BY 1) USING (ix) GROUP BY 1, 2, 3, 4, 5")
def receive_band_limited(spark: SparkSession, d: str) -> DataFrame:
    """What band-limited receivers of one pole and of two read from the cells of a line."""
    cells = table(spark, d, "part").groupBy((F.col("p_size") - 1).cast("bigint").alias("ix")).agg(F.sum("p_retailprice").alias("v"))
    return _rounded(lookups.gather_bands(_along(spark, d), _KEYS, "x", _CELLS, _HALF, _BANDS, cells, "v"), 5, *_BANDS)


@query("""
    WITH p AS (SELECT vec_id, embedding, len(embedding) AS n, unnest(range(len(embedding))) AS i FROM embeddings),
    w AS (SELECT vec_id, i, n, j, i + 0.5::DOUBLE - j AS t, embedding[j + 1]::DOUBLE AS x FROM (SELECT *, unnest(range(greatest(0, i - 3), least(n - 1, i + 4) + 1)) AS j FROM p WHERE i + 0.5 <= n - 1))
    SELECT p.vec_id, p.i, round(coalesce(sum(w.x * CASE WHEN abs(t) >= 4 THEN 0 ELSE sin(pi() * t) / (pi() * t) * sin(pi() * t / 4) / (pi() * t / 4) END), 0), 6) + 0.0 AS x FROM p LEFT JOIN w ON w.vec_id = p.vec_id AND w.i = p.i GROUP BY 1, 2
""")
def shift_half_sample(spark: SparkSession, d: str) -> DataFrame:
    """Values half a sample later, by a windowed sinc that is cut at the ends; zero beyond the last sample."""
    import numpy as np

    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("samples"))
    out = traces.map_traces(rows, ["vec_id"], "samples", lambda x: x @ weights(x.shape[1], np.arange(x.shape[1]) + 0.5, "lanczos", 4, narrow=False).T)
    return _rounded(out.select("vec_id", F.posexplode("samples").alias("i", "x")), 6, "x").select("vec_id", big(F.col("i")).alias("i"), "x")


# Algebra of volumes


@query(f"SELECT ix, iy, iz, CASE WHEN b.v <> 0 THEN round(a.v / b.v, 6) END AS ratio, round(a.v * b.v, 3) AS product, a.v + b.v AS total, a.v - b.v AS rest FROM {_VOLUME} a JOIN {_DENSITY} b USING (ix, iy, iz)")
def volume_algebra(spark: SparkSession, d: str) -> DataFrame:
    a, b = _volume(spark, d), _density(spark, d)
    parts = {"ratio": ("divide", 6), "product": ("multiply", 3), "total": ("add", 9), "rest": ("subtract", 9)}
    out = None
    for name, (operation, digits) in parts.items():
        one = volumes.combine(a, b, AXES, "v", operation).select(*AXES, F.round("v", digits).alias(name))
        out = one if out is None else out.join(one, AXES)
    return out


@query(f"SELECT ix, iy, iz, round(a.v * coalesce(1 / (m.m * (b.v / m.m + 0.3 * exp(-b.v / m.m))), 1), 6) AS v FROM {_VOLUME} a LEFT JOIN {_DENSITY} b USING (ix, iy, iz), (SELECT pow(avg(v), 0.9) AS m FROM {_DENSITY}) m")
def damped_volume(spark: SparkSession, d: str) -> DataFrame:
    damping = reductions.damp(_density(spark, d), "v", 0.9, 0.3).select(*AXES, F.col("damping").alias("v"))
    return _rounded(volumes.combine(_volume(spark, d), damping, AXES, "v", "multiply", whole=True), 6, "v")


@query(f"SELECT ix, iy, iz, a.v - coalesce(b.v * c.v, 0) AS v FROM {_VOLUME} a LEFT JOIN ({_DENSITY} b JOIN (SELECT {_CELL}, max(l_linenumber)::DOUBLE AS v FROM lineitem GROUP BY 1, 2, 3) c USING (ix, iy, iz)) USING (ix, iy, iz)")
def subtract_scaled(spark: SparkSession, d: str) -> DataFrame:
    scale = table(spark, d, "lineitem").groupBy(*_cell()).agg(F.max("l_linenumber").cast("double").alias("v"))
    return volumes.subtract_product(_volume(spark, d), [_density(spark, d), scale], AXES, "v")


@query(f"SELECT a.ix, a.iy, a.iz, b.v FROM {_VOLUME} a LEFT JOIN (SELECT ix, iy, v FROM {_VOLUME} WHERE iz = 2) b ON a.ix = b.ix AND a.iy = b.iy")
def hold_depth(spark: SparkSession, d: str) -> DataFrame:
    return volumes.hold(_volume(spark, d), ["ix", "iy"], "iz", "v", 2).select(*AXES, "v")


@query(f"SELECT p.ix, p.iy, t.iz, t.v FROM (SELECT DISTINCT ix, iy FROM {_VOLUME}) p, (SELECT iz, v FROM {_VOLUME} WHERE ix = 1 AND iy = 1) t")
def expand_trace(spark: SparkSession, d: str) -> DataFrame:
    cells = _volume(spark, d)
    return volumes.expand(cells.filter("ix = 1 AND iy = 1").select("iz", "v"), cells.select("ix", "iy").distinct())


@query(f"SELECT iy AS ix, 0::BIGINT AS iy, iz, sum(v) AS v FROM {_VOLUME} GROUP BY 1, 3")
def long_axis_first(spark: SparkSession, d: str) -> DataFrame:
    section = _volume(spark, d).groupBy("iy", "iz").agg(F.sum("v").alias("v")).withColumn("ix", F.lit(0).cast("bigint"))
    return volumes.swap_axes(section, "ix", "iy").select(*AXES, "v")


@query("SELECT p_partkey, round(CASE WHEN x > 0 THEN x ELSE 0 END, 6) + 0.0 AS positive, round(CASE WHEN x < 0 THEN -x ELSE 0 END, 6) + 0.0 AS negative FROM (SELECT p_partkey, sin(p_partkey) * (p_size - 25) AS x FROM part)")
def signed_products(spark: SparkSession, d: str) -> DataFrame:
    product = F.sin("p_partkey") * (F.col("p_size") - 25)
    return table(spark, d, "part").select("p_partkey", *((F.round(volumes.signed(product, s), 6) + 0.0).alias(n) for n, s in (("positive", 1), ("negative", -1))))


# Reductions


@query("SELECT min(p_retailprice) AS least, count(*) AS n FROM part WHERE p_size BETWEEN 10 AND 30")
def least_between_depths(spark: SparkSession, d: str) -> DataFrame:
    return reductions.least_between(table(spark, d, "part"), "p_size", "p_retailprice", F.lit(10), F.lit(30))


@query("SELECT round(avg(p_retailprice) FILTER (p_size = 1), 6) AS at_surface, min(p_retailprice) AS least FROM part")
def surface_velocity(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(reductions.surface_and_least(table(spark, d, "part"), "p_size", 1, "p_retailprice"), 6, "at_surface")


@query("SELECT l_linenumber, round(avg(l_suppkey), 6) AS mean, round(stddev_pop(l_suppkey), 6) AS deviation FROM lineitem GROUP BY 1")
def spread_of_depths(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(reductions.mean_and_deviation(table(spark, d, "lineitem"), ["l_linenumber"], "l_suppkey"), 6, "mean", "deviation")


_MODEL = "(SELECT p_partkey, p_retailprice AS vel, p_size / 250.0 AS e, p_size / 600.0 AS dl, 1.0 + (p_partkey % 9) / 10.0 AS rho, -sin(radians(p_size)) * cos(radians(p_partkey % 360)) AS px, -sin(radians(p_size)) * sin(radians(p_partkey % 360)) AS py FROM part)"


def _model(spark: SparkSession, d: str) -> DataFrame:
    dip, azimuth = F.radians("p_size"), F.radians(F.col("p_partkey") % 360)
    return table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("vel"), (F.col("p_size") / 250.0).alias("e"), (F.col("p_size") / 600.0).alias("dl"), (1.0 + (F.col("p_partkey") % 9) / 10.0).alias("rho"), (-F.sin(dip) * F.cos(azimuth)).alias("px"), (-F.sin(dip) * F.sin(azimuth)).alias("py"))


def _rate_sql(kx: str, ky: str, kz: str) -> str:
    modes = []
    for z in (0, 1):
        for x in (0, 1):
            for y in (0, 1):
                if x + y + z:
                    h, v = f"({x} * pow({kx}, 2) + {y} * pow({ky}, 2))", f"({z} * pow({kz}, 2))"
                    t = f"((1 + 2 * e) * {h} + {v})"
                    modes.append(f"sqrt(({t} + sqrt(greatest({t} * {t} - 8 * (e - dl) * {h} * {v}, 0))) / 2)")
    return f"greatest({', '.join(modes)})"


@query(f"SELECT round(min(2.0 / (1.7 * vel * {_rate_sql('1 / 12.5', '1 / 25.0', '1 / 10.0')} * sqrt(1 + 2 * e))), 9) AS dt FROM {_MODEL}")
def stable_dt_vti(spark: SparkSession, d: str) -> DataFrame:
    rate = reductions.anisotropic_rate(F.col("vel"), F.col("e"), F.col("dl"), (12.5, 25.0, 10.0))
    return _rounded(reductions.stable_step(_model(spark, d), 1.7, rate, 1 + 2 * F.col("e")), 9, "dt")


@query(f"WITH m AS (SELECT *, sqrt(px * px + py * py) AS s FROM {_MODEL}), a AS (SELECT *, sqrt(1 - s * s) AS c, CASE WHEN s > 1e-15 THEN -px / s ELSE 1 END AS cp, CASE WHEN s > 1e-15 THEN -py / s ELSE 0 END AS sp FROM m), k AS (SELECT *, cp * c / 12.5 + sp * c / 25.0 - s / 10.0 AS kx, -sp / 12.5 + cp / 25.0 AS ky, cp * s / 12.5 + sp * s / 25.0 + c / 10.0 AS kz FROM a) SELECT round(min(2.0 / (1.7 * vel * {_rate_sql('kx', 'ky', 'kz')} * sqrt(rho) * sqrt(1 + 2 * e))) * sqrt(min(rho)), 9) AS dt FROM k")
def stable_dt_tti_density(spark: SparkSession, d: str) -> DataFrame:
    rate = reductions.anisotropic_rate(F.col("vel"), F.col("e"), F.col("dl"), (12.5, 25.0, 10.0), (F.col("px"), F.col("py")))
    return _rounded(reductions.stable_step(_model(spark, d), 1.7, rate, 1 + 2 * F.col("e"), F.col("rho")), 9, "dt")


@query("SELECT min(round(p_retailprice * 100)::BIGINT)::BIGINT AS record_dt, count(*) AS n FROM part")
def record_interval(spark: SparkSession, d: str) -> DataFrame:
    """The sample interval of a record and how many traces it has; an interval is the same for all."""
    return table(spark, d, "part").agg(F.min(F.round(F.col("p_retailprice") * 100).cast("bigint")).alias("record_dt"), F.count(F.lit(1)).alias("n"))


@query("SELECT count(DISTINCT l_orderkey) AS n_shots, count(*) AS n_traces FROM lineitem")
def shot_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(F.count_distinct("l_orderkey").alias("n_shots"), F.count(F.lit(1)).alias("n_traces"))


# Vectors


@query("""
    WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_partkey + 1.0 AS a1, l_suppkey - 3.0 AS a2, l_quantity AS a3, l_linenumber * 1.0 AS b1, l_quantity - 20.0 AS b2, l_suppkey + 0.5 AS b3 FROM lineitem),
    p AS (SELECT *, a1 * b1 + a2 * b2 + a3 * b3 AS dt, b1 * b1 + b2 * b2 + b3 * b3 AS bb, a2 * b3 - a3 * b2 AS c1, a3 * b1 - a1 * b3 AS c2, a1 * b2 - a2 * b1 AS c3 FROM v)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(dt, 3) + 0.0 AS dot, round(c1, 3) + 0.0 AS c1, round(c2, 3) + 0.0 AS c2, round(c3, 3) + 0.0 AS c3, round(b1 * dt / bb, 5) + 0.0 AS p1, round(b2 * dt / bb, 5) + 0.0 AS p2,
        round(a1 * cos(radians(l_linenumber * 31.0)) - c1 / sqrt(bb) * sin(radians(l_linenumber * 31.0)) + b1 * dt / bb * (1 - cos(radians(l_linenumber * 31.0))), 5) + 0.0 AS r1,
        round(sqrt(a1 * a1 + a2 * a2 + a3 * a3), 5) AS long, round(degrees(atan2(a2, a1)) - 180 * floor(degrees(atan2(a2, a1)) / 180), 4) + 0.0 AS azimuth FROM p
""")
def vector_algebra(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("l_partkey") + 1.0, F.col("l_suppkey") - 3.0, F.col("l_quantity")
    b = F.col("l_linenumber") * 1.0, F.col("l_quantity") - 20.0, F.col("l_suppkey") + 0.5
    c, p, r = vectors.cross(a, b), vectors.project(a, b), vectors.rotate(a, b, F.col("l_linenumber") * 31.0)
    found = {"dot": (vectors.dot(a, b), 3), "c1": (c[0], 3), "c2": (c[1], 3), "c3": (c[2], 3), "p1": (p[0], 5), "p2": (p[1], 5), "r1": (r[0], 5), "long": (vectors.norm(a), 5), "azimuth": (vectors.azimuth(a, False), 4)}
    return table(spark, d, "lineitem").select(*_KEYS, *((F.round(x, n) + 0.0).alias(k) for k, (x, n) in found.items()))


# Surveys and shots

_CORNERS = [(1000.0, 500.0, 1, 10), (1800.0, 1100.0, 81, 10), (400.0, 1300.0, 1, 50)]


@query(f"SELECT {_ID}, round(1000 + (l_partkey % 81) * 12.5 * 0.8 - (l_suppkey % 41) * 25 * 0.6, 6) AS x, round(500 + (l_partkey % 81) * 12.5 * 0.6 + (l_suppkey % 41) * 25 * 0.8, 6) AS y, (l_partkey % 81 + 1)::BIGINT AS crossline, (l_suppkey % 41 + 10)::BIGINT AS inline FROM lineitem")
def lines_to_places(spark: SparkSession, d: str) -> DataFrame:
    """Line numbers to coordinates by a survey's corners, and back."""
    s = frames.survey(_CORNERS)
    x, y = frames.place_of_lines(F.col("l_partkey") % 81 + 1, F.col("l_suppkey") % 41 + 10, s)
    placed = table(spark, d, "lineitem").select(*_KEYS, x.alias("x"), y.alias("y"))
    crossline, inline = frames.lines_of_place(F.col("x"), F.col("y"), s)
    return _rounded(placed.withColumns({"crossline": crossline, "inline": inline}), 6, "x", "y")


@query("WITH f AS (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 50) SELECT o_orderkey, o_custkey, round(avg(o_orderkey) OVER (), 6) AS mean_x, round(avg(o_custkey) OVER (), 6) AS mean_y, round(o_orderkey - avg(o_orderkey) OVER (), 6) AS dx, round(o_custkey - avg(o_custkey) OVER (), 6) AS dy FROM f")
def source_array(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 shots as one source: a source array is so many."""
    out = frames.source_array(table(spark, d, "orders"), ["o_orderkey"], 50, "o_orderkey", "o_custkey")
    return _rounded(out, 6, "mean_x", "mean_y", "dx", "dy")


@query("SELECT l_orderkey, greatest(min(l_partkey) - 5, 20) AS x_first, least(max(l_partkey) + 5, 150) AS x_last, greatest(min(l_suppkey) - 2, 3) AS y_first, least(max(l_suppkey) + 2, 8) AS y_last, greatest(min(l_partkey) - 5, 20) <= least(max(l_partkey) + 5, 150) AND greatest(min(l_suppkey) - 2, 3) <= least(max(l_suppkey) + 2, 8) AS inside FROM lineitem GROUP BY 1")
def model_window(spark: SparkSession, d: str) -> DataFrame:
    span = table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.min("l_partkey") - 5).alias("a"), (F.max("l_partkey") + 5).alias("b"), (F.min("l_suppkey") - 2).alias("c"), (F.max("l_suppkey") + 2).alias("e"))
    return frames.window_of(span, {"x": (F.col("a"), F.col("b"), F.lit(20), F.lit(150)), "y": (F.col("c"), F.col("e"), F.lit(3), F.lit(8))}).drop("a", "b", "c", "e")


@query("SELECT l_orderkey, least(min(l_partkey), min(l_suppkey * 10)) - 12.5 AS x0, greatest(max(l_partkey), max(l_suppkey * 10)) + 12.5 AS x1, round(avg(l_linenumber), 6) AS y0, round(avg(l_linenumber), 6) AS y1 FROM lineitem GROUP BY 1")
def shot_aperture(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("rx", F.col("l_suppkey") * 10)
    return _rounded(frames.aperture(rows, "l_orderkey", ("l_partkey", "l_linenumber"), ("rx", "l_suppkey"), (12.5, 12.5), dimensions=2), 6, "y0", "y1")


@query("SELECT l_orderkey AS shot, l_partkey AS other, (l_partkey - l_orderkey) * 25.0 AS dx, 0.0::DOUBLE AS dy, l_linenumber * 0.5::DOUBLE AS delay FROM lineitem")
def parse_delay_lines(spark: SparkSession, d: str) -> DataFrame:
    """Delay lines written from the line items, one a shot, with comments and blank lines among them, and read back."""
    pair = F.concat_ws(" ", F.col("l_partkey").cast("string"), (F.col("l_linenumber") * 0.5).cast("string"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.concat_ws("  ", F.collect_list(pair)).alias("pairs")).select(F.explode(F.array(F.concat(F.lit("# shot "), F.col("l_orderkey").cast("string")), F.lit(" "), F.concat(F.lit(" "), F.col("l_orderkey").cast("string"), F.lit("\t"), F.col("pairs"), F.lit(" # end")))).alias("line"))
    return frames.parse_delays(lines, "line", continuous=25.0)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity FROM lineitem")
def stored_shots(spark: SparkSession, d: str) -> DataFrame:
    """Traces written by bucket of their shot, and all read back."""
    folder = shared_folder(spark, "shots")
    store_shots(table(spark, d, "lineitem").select(*_KEYS, "l_quantity"), folder, "l_orderkey", 16)
    return extract_shots(spark, folder, "l_orderkey")


_WIDE, _DEEP = 48, 20
_FILED = f"(SELECT l_returnflag AS part, l_suppkey % {_DEEP} AS iy, l_partkey % {_WIDE} AS ix, (l_linenumber - 1) % {NZ} AS iz, sum(l_quantity)::BIGINT AS v FROM lineitem GROUP BY 1, 2, 3, 4)"


@query(f"SELECT p.part || '.fdm' AS file, y.iy::BIGINT AS iy, x.ix::BIGINT AS ix, z.iz::BIGINT AS iz, coalesce(v, 0)::DOUBLE AS v, max(coalesce(v, 0)) OVER (PARTITION BY p.part)::DOUBLE AS vmax FROM (SELECT DISTINCT l_returnflag AS part FROM lineitem) p, (SELECT unnest(range({_DEEP})) AS iy) y, (SELECT unnest(range({_WIDE})) AS ix) x, (SELECT unnest(range({NZ})) AS iz) z LEFT JOIN {_FILED} f ON f.part = p.part AND f.iy = y.iy AND f.ix = x.ix AND f.iz = z.iz")
def cube_files(spark: SparkSession, d: str) -> DataFrame:
    """Cubes written as files with headers, a file for each flag, and read back in ranges, with the greatest sample of each."""
    rows = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % _DEEP).alias("iy"), (F.col("l_partkey") % _WIDE).alias("ix"), F.concat("l_returnflag", F.lit(".fdm")).alias("file"), ((F.col("l_linenumber") - 1) % NZ).alias("iz")).agg(F.sum("l_quantity").alias("v"))
    found = F.map_from_entries(F.collect_list(F.struct("iz", "v")))
    stored = rows.groupBy("file", "iy", "ix").agg(found.alias("m")).select("file", "iy", "ix", F.transform(F.sequence(F.lit(0), F.lit(NZ - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("samples"))
    folder = shared_folder(spark, "cubes")
    cubes.write_cubes(stored, folder, {"nx": _WIDE, "ny": _DEEP, "nz": NZ, "dx": 12.5, "dy": 25.0, "dz": 5.0})
    read = cubes.read_cubes(spark, folder, range_bytes=1 << 14)
    most = cubes.cube_range(cubes.read_cubes(spark, folder, columns=["path", "samples"]), "path").select("path", F.col("vmax").cast("double"))
    out = read.join(most, "path").select(F.element_at(F.split("path", "/"), -1).alias("file"), big(F.col("iy")).alias("iy"), big(F.col("ix")).alias("ix"), F.posexplode("samples").alias("iz", "v"), "vmax")
    return out.withColumns({"iz": big(F.col("iz")), "v": F.col("v").cast("double")})


@query("SELECT l_suppkey::VARCHAR || '.rec' AS file, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS ordinal, l_partkey::DOUBLE AS sx, l_linenumber AS recv_id, l_quantity AS a, l_extendedprice::FLOAT::DOUBLE AS b FROM lineitem")
def record_files(spark: SparkSession, d: str) -> DataFrame:
    """Traces written as record files of a job's layout, a file for each shot, and read back in ranges."""
    nth = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")) - 1
    numbered = table(spark, d, "lineitem").select(*_KEYS, "l_quantity", nth.alias("ordinal"))  # names and samples are made after the sort
    stored = numbered.select(F.concat(F.col("l_suppkey").cast("string"), F.lit(".rec")).alias("file"), "ordinal", F.col("l_partkey").alias("sx"), F.col("l_linenumber").alias("recv_id"), F.array("l_quantity", "l_extendedprice").alias("samples"))
    layout = records.job_layout({"recv_id": 13, "sx": 73, "xline": 0, "iline": 0}, 2)
    return records.through_records(stored, layout, lambda read: read.select(F.element_at(F.split("path", "/"), -1).alias("file"), "ordinal", "sx", "recv_id", F.col("samples")[0].cast("double").alias("a"), F.col("samples")[1].cast("double").alias("b")))


@query("SELECT l_suppkey::VARCHAR || '.rec' AS file, count(*) AS n_traces, min(l_partkey)::DOUBLE AS min_sx, max(l_linenumber) AS most FROM lineitem GROUP BY 1")
def record_headers(spark: SparkSession, d: str) -> DataFrame:
    """The extent of each shot's record, for which only headers are read."""
    nth = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber")) - 1
    numbered = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber", "l_tax", nth.alias("ordinal"))  # names and samples are made after the sort
    stored = numbered.select(F.concat(F.col("l_suppkey").cast("string"), F.lit(".rec")).alias("file"), "ordinal", F.col("l_partkey").alias("sx"), F.col("l_linenumber").alias("recv_id"), F.array_repeat(F.col("l_tax"), 64).alias("samples"), F.lit(0).alias("xline"), F.lit(0).alias("iline"))
    layout = records.job_layout({"recv_id": 13, "sx": 73}, 64)
    extent = [F.count(F.lit(1)).alias("n_traces"), F.min("sx").alias("min_sx"), F.max("recv_id").alias("most")]
    return records.through_records(stored, layout, lambda heads: heads.groupBy(F.element_at(F.split("path", "/"), -1).alias("file")).agg(*extent), header_only=True)


@query("WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) SELECT a.l_orderkey, a.l_linenumber, a.l_extendedprice, b.l_quantity AS template FROM n a JOIN n b ON a.l_orderkey = b.l_orderkey AND a.k = b.k")
def template_headers(spark: SparkSession, d: str) -> DataFrame:
    """Traces take the headers of the template trace of the same number in their shot."""
    rows = table(spark, d, "lineitem")
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    template = rows.select("l_orderkey", *order, F.col("l_quantity").alias("template"))
    data = rows.select("l_orderkey", *order, "l_extendedprice")
    return frames.with_template(data, template, ["l_orderkey"], order, ["template"]).select("l_orderkey", "l_linenumber", "l_extendedprice", "template")


# Tapers


_EDGE = "(CASE WHEN {0} < {1} THEN 0.5 * (1 - cos({0} / {1}.0 * pi())) ELSE 1 END)"


@query(f"SELECT ix, iy, iz, round(v * {_EDGE.format(f'least(ix, {NX - 1} - ix)', 4)} * {_EDGE.format(f'least(iy, {NY - 1} - iy)', 2)}, 6) + 0.0 AS v FROM {_VOLUME}")
def tapered_volume(spark: SparkSession, d: str) -> DataFrame:
    return _volume(spark, d).select(*AXES, (F.round(F.col("v") * tapers.edges(F.col("ix"), NX, 4) * tapers.edges(F.col("iy"), NY, 2), 6) + 0.0).alias("v"))


@query("SELECT ix, iy, iz, round(v * " + " * ".join(f"(CASE WHEN least({a}, {n - 1} - {a}) < {w} THEN 1 - 0.2 * 0.5 * (1 + cos(least({a}, {n - 1} - {a}) / {w}.0 * pi())) ELSE 1 END)" for a, n, w in (("ix", NX, 3), ("iy", NY, 2), ("iz", NZ, 3))) + f", 6) + 0.0 AS v FROM {_VOLUME}")
def boundary_taper(spark: SparkSession, d: str) -> DataFrame:
    weight = F.lit(1.0)
    for a, n, w in (("ix", NX, 3), ("iy", NY, 2), ("iz", NZ, 3)):
        weight = weight * tapers.boundary(F.col(a), n, w, 0.8)
    return _volume(spark, d).select(*AXES, (F.round(F.col("v") * weight, 6) + 0.0).alias("v"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(CASE WHEN t < 5 THEN 0.5 * (1 - cos(t / 5.0 * pi())) WHEN l_linenumber < 4 THEN 0.5 * (1 - cos(l_linenumber / 4.0 * pi())) ELSE 1 END, 6) + 0.0 AS weight, round(pow(s, 3) * 10 - 15 * pow(s, 4) + 6 * pow(s, 5), 6) + 0.0 AS smooth FROM (SELECT *, l_partkey % 10 AS t, least(l_quantity / 40.0, 1) AS s FROM lineitem)")
def time_or_depth_taper(spark: SparkSession, d: str) -> DataFrame:
    weight, smooth = tapers.time_or_depth(F.col("l_partkey") % 10, 5, F.col("l_linenumber"), 4), tapers.smooth_step(F.col("l_quantity") / 40.0)
    return table(spark, d, "lineitem").select(*_KEYS, (F.round(weight, 6) + 0.0).alias("weight"), (F.round(smooth, 6) + 0.0).alias("smooth"))


# Ghosts, images and files


def _pair_sql(axis: str, at: str) -> str:
    return f"SELECT *, floor({at})::BIGINT + k AS c_{axis}, CASE k WHEN 1 THEN {at} - floor({at}) ELSE 1 - ({at} - floor({at})) END AS w_{axis} FROM"


_GHOSTS = f"(SELECT *, 1 AS sign, x_iz AS z FROM {_POINTS} UNION ALL SELECT *, -1, 2 * 1.5 - x_iz FROM {_POINTS})"


@query(f"""
    WITH a AS ({_pair_sql('ix', 'x_ix')} {_GHOSTS}, (SELECT unnest([0, 1]) AS k)), b AS (SELECT * EXCLUDE (k), m, floor(z)::BIGINT + m AS c_iz, CASE m WHEN 1 THEN z - floor(z) ELSE 1 - (z - floor(z)) END AS w_iz FROM a, (SELECT unnest([0, 1]) AS m))
    SELECT {_ID}, round(sum(sign * w_ix * w_iz * coalesce(v, 0)), 5) + 0.0 AS v FROM b LEFT JOIN (SELECT ix, iz, sum(v) AS v FROM {_VOLUME} GROUP BY 1, 2) ON ix = c_ix AND iz = c_iz GROUP BY {_ID}
""")
def receivers_less_ghost(spark: SparkSession, d: str) -> DataFrame:
    cells = _volume(spark, d).groupBy("ix", "iz").agg(F.sum("v").alias("v"))  # 23 places at most along ix, for each of the line numbers, which are few
    out = lookups.gather_less_ghost(_points(spark, d), _KEYS, {"ix": "x_ix", "iz": "x_iz"}, "iz", 1.5, cells, "v", few=True)
    return _rounded(out, 5, "v")


@query(f"""
    WITH s AS (SELECT x_ix, z, sign * l_quantity AS a FROM (SELECT l_quantity, l_quantity / 4.3 - 0.6 AS x_ix, l_tax / 0.0113 - 0.4 AS x_iz FROM lineitem), (SELECT unnest([1, -1]) AS sign), LATERAL (SELECT CASE sign WHEN 1 THEN x_iz ELSE 2 * 1.5 - x_iz END AS z)),
    t AS (SELECT floor(x_ix)::BIGINT + k AS ix, floor(z)::BIGINT + m AS iz, a * (CASE k WHEN 1 THEN x_ix - floor(x_ix) ELSE 1 - (x_ix - floor(x_ix)) END) * (CASE m WHEN 1 THEN z - floor(z) ELSE 1 - (z - floor(z)) END) AS a FROM s, (SELECT unnest([0, 1]) AS k), (SELECT unnest([0, 1]) AS m))
    SELECT ix, iz, round(sum(a) * pow(any_value(v) * 0.00213, 2), 4) + 0.0 AS added FROM t JOIN (SELECT ix, iz, avg(v) AS v FROM {_VOLUME} GROUP BY 1, 2) USING (ix, iz) GROUP BY 1, 2
""")
def inject_less_ghost(spark: SparkSession, d: str) -> DataFrame:
    velocity = _volume(spark, d).groupBy("ix", "iz").agg(F.avg("v").alias("v"))
    sources = table(spark, d, "lineitem").select("l_quantity", (F.col("l_quantity") / 4.3 - 0.6).alias("x_ix"), (F.col("l_tax") / 0.0113 - 0.4).alias("x_iz"))
    return _rounded(lookups.inject(sources, {"ix": "x_ix", "iz": "x_iz"}, "l_quantity", velocity, "v", 0.00213, "iz", 1.5), 4, "added")


@query(f"SELECT ix, iy, iz, a.v + coalesce(p.v, 0) AS added, coalesce(p.v, a.v) AS put FROM {_VOLUME} a LEFT JOIN (SELECT ix, iy, iz, sum(v) AS v FROM (SELECT ix * 2 AS ix, iy + 1 AS iy, iz, v FROM {_DENSITY}) GROUP BY 1, 2, 3) p USING (ix, iy, iz)")
def stack_onto_survey(spark: SparkSession, d: str) -> DataFrame:
    """A partial image with other line increments onto an image: lines of both are added up, or replaced."""
    image, partial = _volume(spark, d), _density(spark, d).withColumns({"ix": F.col("ix") * 2, "iy": F.col("iy") + 1})
    added, put = (reductions.stack_lines(image, partial, ["ix", "iy"], "iz", "v", a).withColumnRenamed("v", n) for a, n in ((True, "added"), (False, "put")))
    return added.join(put, AXES)


_SMOOTHED = _chain_sql(_VOLUME, AXES, [("ix", 1, "avg(v)"), ("iy", 1, "avg(v)"), ("iz", 1, "avg(v)")])


@query(f"SELECT ix, iy, iz, round(1e3 / (m * (v / m + 0.2 * exp(-v / m))) * {_EDGE.format(f'least(ix, {NX - 1} - ix)', 4)}, 5) + 0.0 AS damping FROM (SELECT *, pow(avg(v) OVER (), 0.8) AS m FROM {_SMOOTHED})")
def damping_smoothed(spark: SparkSession, d: str) -> DataFrame:
    """Weights of a smoothed illumination, tapered at the edges of one axis."""
    smooth = stencils.along_axes(_volume(spark, d), [], AXES, "v", [(a, stencils.mean_along("v", 1)) for a in AXES])
    out = reductions.damp(smooth, "v", 0.8, 0.2)
    return out.select(*AXES, (F.round(F.col("damping") * 1e3 * tapers.edges(F.col("ix"), NX, 4), 5) + 0.0).alias("damping"))


@query("""
    WITH s AS (SELECT vec_id, len(embedding) AS n, list_concat(embedding, list_reverse(embedding)) AS e FROM embeddings),
    x AS (SELECT vec_id, n, unnest(range(2 * n)) AS j, unnest(e)::DOUBLE AS x FROM s),
    k AS (SELECT n, d, sum(CASE WHEN m = 0 OR m = n THEN 0 ELSE -2 * (2 * pi() * m / (2 * n * 12.5)) * sin(2 * pi() * m * d / (2 * n)) END) / (2 * n) AS g FROM (SELECT n, unnest(range(2 * n)) AS d FROM (SELECT DISTINCT n FROM s)), (SELECT unnest(range(4096)) AS m) WHERE m <= n GROUP BY n, d)
    SELECT vec_id, i, round(sum(g * x), 7) + 0.0 AS x FROM x JOIN (SELECT n, unnest(range(n)) AS i FROM (SELECT DISTINCT n FROM s)) o USING (n) JOIN k ON k.n = x.n AND k.d = (i - j + 2 * x.n) % (2 * x.n) GROUP BY vec_id, i
""")
def cosine_slope(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("samples"))
    out = traces.map_traces(rows, ["vec_id"], "samples", traces.cosine_derivative(12.5))
    return _rounded(out.select("vec_id", F.posexplode("samples").alias("i", "x")), 7, "x").select("vec_id", big(F.col("i")).alias("i"), "x")


@query("SELECT o_orderkey, o_custkey, format AS format FROM orders, (SELECT unnest(['.dat', '.json', '.parquet']) AS format)")
def saved_indexes(spark: SparkSession, d: str) -> DataFrame:
    """The shot index written as text, JSON and Parquet, and read back from each."""
    index, out = table(spark, d, "orders").select("o_orderkey", "o_custkey"), None
    for suffix in (".dat", ".json", ".parquet"):
        path = shared_folder(spark, "index") + suffix
        save(index, path)
        one = load(spark, path, "o_orderkey bigint, o_custkey bigint").withColumn("format", F.lit(suffix))
        out = one if out is None else out.unionByName(one)
    return out


# Gathers by slowness

_SLOW, _GATHER_DT, _TIMES = [-4e-5, -1e-5, 0.0, 2e-5, 5e-5], 0.004, 50
_GATHER = "(SELECT l_suppkey % 6 AS gather, l_linenumber * 150.0 AS x, (l_quantity - 1)::BIGINT AS it, sum(round(l_extendedprice)::BIGINT) AS v FROM lineitem GROUP BY 1, 2, 3)"


def _gather(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 6).alias("gather"), (F.col("l_linenumber") * 150.0).alias("x"), (F.col("l_quantity") - 1).cast("bigint").alias("it")).agg(F.sum(F.round("l_extendedprice").cast("bigint")).alias("v"))


@query(f"""
    WITH u AS (SELECT gather, ip, v, it - p * x / {_GATHER_DT} AS u FROM {_GATHER}, (VALUES {', '.join(f'({i}, {p!r}::DOUBLE)' for i, p in enumerate(_SLOW))}) s(ip, p)),
    w AS (SELECT gather, ip, v, floor(u)::BIGINT + k AS itau, CASE k WHEN 0 THEN 1 - (u - floor(u)) ELSE u - floor(u) END AS w FROM u, (SELECT unnest([0, 1]) AS k))
    SELECT gather, ip::BIGINT AS ip, itau, round(sum(w * v), 3) + 0.0 AS v FROM w WHERE w > 0 AND itau BETWEEN 0 AND {_TIMES - 1} GROUP BY 1, 2, 3
""")
def slant_stack(spark: SparkSession, d: str) -> DataFrame:
    """The slant stack of gathers of line items."""
    return _rounded(gathers.slant_stack(_gather(spark, d), ["gather"], "x", "it", "v", _SLOW, _GATHER_DT, _TIMES), 3, "v")


@query()
def gathers_on_lattice(spark: SparkSession, d: str) -> DataFrame:
    """Gathers turned into events by least squares, less their ghosts, at the places of a regular lattice."""
    rows = _gather(spark, d)
    events = gathers.least_squares(rows, ["gather"], "x", "it", "v", _SLOW, _GATHER_DT, _TIMES, rounds=4)
    clean = gathers.deghost(events, ["gather"], "v", _SLOW, _GATHER_DT, _TIMES, 6.0, 1500.0)
    lattice = rows.select("gather").distinct().withColumn("x", F.explode(F.array(*(F.lit(100.0 * k) for k in range(1, 12)))))
    return _rounded(gathers.model(clean, ["gather"], "v", lattice, "x", "it", _SLOW, _GATHER_DT, _TIMES), 3, "v")


def _weave_sql(rows: str, axes: dict[str, int]) -> str:
    """Half-sample shifts by the kernel of the discrete spectrum, along one axis after another."""
    for axis, n in axes.items():
        keys = [a for a in axes if a != axis]
        others = ", ".join(keys)
        t = f"(i.i / 2.0 - j.{axis})"
        kernel = f"sin(pi() * {t}) / ({n} * {'tan' if n % 2 == 0 else 'sin'}(pi() * {t} / {n}))"
        own = f"CASE WHEN i.i % 2 = 0 THEN (CASE WHEN i.i // 2 = j.{axis} THEN 1.0 ELSE 0.0 END) ELSE {kernel} END"
        rows = f"(SELECT {others}, i.i AS {axis}, sum(({own}) * j.v) AS v FROM {rows} j, (SELECT unnest(range({2 * n})) AS i) i GROUP BY {others}, i.i)"
    return rows


@query(f"SELECT ix, iy, iz, round(v, 5) + 0.0 AS v FROM {_weave_sql(_VOLUME, {'ix': NX, 'iy': NY, 'iz': NZ})}")
def weave_3d(spark: SparkSession, d: str) -> DataFrame:
    """The volume on a grid twice as fine along all axes, woven of its half-sample shifts."""
    return _rounded(weave.weave(_volume(spark, d), [], {"ix": NX, "iy": NY, "iz": NZ}, "v"), 5, "v")


@query(f"SELECT ix, iy, round(v, 5) + 0.0 AS v FROM {_weave_sql(f'(SELECT ix, iy, sum(v) AS v FROM {_VOLUME} GROUP BY 1, 2)', {'ix': NX, 'iy': NY})}")
def weave_2d(spark: SparkSession, d: str) -> DataFrame:
    """A map on a grid twice as fine along both axes."""
    cells = _volume(spark, d).groupBy("ix", "iy").agg(F.sum("v").alias("v"))
    return _rounded(weave.weave(cells, [], {"ix": NX, "iy": NY}, "v"), 5, "v")


@query("SELECT xl, il, sum(v)::BIGINT AS v FROM (SELECT l_suppkey % 40 AS xl, (l_partkey % 300) * 2 + 3 AS il, round(l_extendedprice)::BIGINT AS v FROM lineitem WHERE l_returnflag <> 'N' UNION ALL SELECT l_suppkey % 40, (l_partkey % 150) * 4 + 7, l_quantity::BIGINT FROM lineitem WHERE l_returnflag = 'N') WHERE il < 3 + 250 * 2 GROUP BY 1, 2")
def accumulated_image(spark: SparkSession, d: str) -> DataFrame:
    """An image stored and added to by three batches of unlike lines, one of which runs twice, and folded in between."""
    rows, path, kinds = table(spark, d, "lineitem"), shared_folder(spark, "image"), "xl bigint, il bigint, v bigint"
    onto = (3, 2, 250)
    some = lambda flag, n, v: rows.filter(F.col("l_returnflag") == flag).select((F.col("l_suppkey") % 40).alias("xl"), (F.col("l_partkey") % n).alias("il"), v.cast("bigint").alias("v"))
    price = F.round("l_extendedprice")
    first, second, third = images.aligned(some("A", 300, price), {"il": ((3, 2), onto)}), images.aligned(some("R", 300, price), {"il": ((3, 2), onto)}), images.aligned(some("N", 150, F.col("l_quantity")), {"il": ((7, 4), onto)})
    images.accumulate(path, first, ["xl", "il"], "il", "v", 1)
    images.accumulate(path, second, ["xl", "il"], "il", "v", 2)
    images.fold(spark, path, kinds, ["xl", "il"], "v")
    images.accumulate(path, second, ["xl", "il"], "il", "v", 2)
    images.accumulate(path, third, ["xl", "il"], "il", "v", 3)
    return images.image(spark, path, kinds, ["xl", "il"], "v").select("xl", (F.col("il") * 2 + 3).alias("il"), "v")


_FINER = {"ix": (NX, [0.4 * i for i in range(28)]), "iy": (NY, [0.7 * i - 0.3 for i in range(8)]), "iz": (NZ, [0.0, 0.25, 0.6, 1.0, 1.5, 2.2, 3.0, 3.9, 4.9, 6.0, 6.2])}


def _sinc_grid_sql(rows: str, axes: dict[str, tuple[int, list[float]]], half: int) -> str:
    for axis, (n, places) in axes.items():
        others = ", ".join(a for a in axes if a != axis)
        table = ", ".join(f"({i}, {p!r}::DOUBLE)" for i, p in enumerate(places))
        rows = f"""(SELECT {others}, i AS {axis}, coalesce(sum(v * CASE WHEN p < 0 OR p > {n - 1} THEN 0 WHEN abs(p - {axis}) < 1e-12 THEN 1 WHEN abs(p - {axis}) >= h THEN 0
            ELSE sin(pi() * (p - {axis})) / (pi() * (p - {axis})) * sin(pi() * (p - {axis}) / h) / (pi() * (p - {axis}) / h) END), 0) AS v
            FROM {rows}, (SELECT i, p, least({half}, least(b, {n - 2} - b) + 1) AS h FROM (SELECT *, greatest(0, least({n - 2}, floor(p)::BIGINT)) AS b FROM (VALUES {table}) w(i, p))) GROUP BY {others}, i)"""
    return rows


@query(f"SELECT ix, iy, iz, round(v, 5) + 0.0 AS v FROM {_sinc_grid_sql(_VOLUME, _FINER, 9)}")
def regrid_sinc(spark: SparkSession, d: str) -> DataFrame:
    """The volume on a finer grid, uneven in depth, by windowed sincs along all axes."""
    return _rounded(weave.regrid_sinc(_volume(spark, d), [], _FINER, "v"), 5, "v")


_LINE, _DX, _SPEED, _BELOW = 8, 12.5, 1500.0, 7.0


@query(f"""
    WITH d AS (SELECT vec_id // {_LINE} AS line, vec_id % {_LINE} AS r, len(embedding) AS n, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE len(embedding) = 64),
    f AS (SELECT m, k, 2 * pi() * m / (64 * 0.004) AS w, 2 * pi() * least(k, {_LINE} - k) / ({_LINE} * {_DX}) AS kx FROM (SELECT unnest(range(33)) AS m), (SELECT unnest(range({_LINE})) AS k)),
    z AS (SELECT m, k, w, sqrt(greatest(pow(w / {_SPEED}, 2) - kx * kx, 0)) AS kz FROM f),
    g AS (SELECT a, b, sum((CASE WHEN m = 0 OR m = 32 THEN 1 ELSE 2 END) * (CASE WHEN kz > 0 THEN kz * {_SPEED} / w / greatest(abs(sin(kz * {_BELOW})), 0.2) ELSE 0 END) * cos(2 * pi() * m * b / 64) * cos(2 * pi() * k * a / {_LINE})) / (64 * {_LINE}) AS g FROM z, (SELECT unnest(range({_LINE})) AS a), (SELECT unnest(range(64)) AS b) GROUP BY 1, 2)
    SELECT line, o.r AS r, p.i AS i, round(sum(g * x), 6) + 0.0 AS x FROM d, (SELECT unnest(range({_LINE})) AS r) o, (SELECT unnest(range(64)) AS i) p JOIN g ON true WHERE g.a = (o.r - d.r + {_LINE}) % {_LINE} AND g.b = (p.i - d.i + 64) % 64 GROUP BY 1, 2, 3
""")
def receiver_obliquity(spark: SparkSession, d: str) -> DataFrame:
    """Lines of receivers by the cosine of the angle, over the ghost's sine with a floor, waves that don't propagate cut frequency by frequency."""
    rows = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / _LINE).alias("line"), F.pmod("vec_id", F.lit(_LINE)).cast("int").alias("r"), F.col("embedding").alias("samples"))
    out = receivers.filter_line(rows, ["line"], "r", "samples", _LINE, 64, _DX, 0.004, receivers.obliquity(_SPEED, 1.0, _BELOW, 0.2))
    return _rounded(out.select("line", big(F.col("r")).alias("r"), F.posexplode("samples").alias("i", "x")), 6, "x").withColumn("i", big(F.col("i")))


@query("""
    WITH o AS (SELECT o_orderstatus AS s, left(o_orderpriority, 1)::INT AS d, count(*) AS n_sources FROM orders GROUP BY 1, 2),
    t AS (SELECT *, i, (i - 64) * 0.004 AS t FROM o, (SELECT unnest(range(128)) AS i)),
    c AS (SELECT *, 4.0 AS a, 8.0 AS b, 30.0 + 5 * d AS c, 50.0 + 5 * d AS e, 20.0 + 3 * d AS peak FROM t),
    w AS (SELECT *, CASE s WHEN 'F' THEN (1 - 2 * pow(pi() * peak * t, 2)) * exp(-pow(pi() * peak * t, 2)) WHEN 'P' THEN CASE WHEN i = 64 THEN 1 ELSE 0 END
        ELSE (CASE WHEN t = 0 THEN pow(pi() * e, 2) ELSE pow(sin(pi() * e * t) / t, 2) END - CASE WHEN t = 0 THEN pow(pi() * c, 2) ELSE pow(sin(pi() * c * t) / t, 2) END) / (pi() * (e - c))
           - (CASE WHEN t = 0 THEN pow(pi() * b, 2) ELSE pow(sin(pi() * b * t) / t, 2) END - CASE WHEN t = 0 THEN pow(pi() * a, 2) ELSE pow(sin(pi() * a * t) / t, 2) END) / (pi() * (b - a)) END AS x FROM c)
    SELECT CASE s WHEN 'F' THEN 'ricker' WHEN 'P' THEN 'delta' ELSE 'ormsby' END AS kind, d::INT AS d, n_sources, i, round(100000 * x / CASE WHEN s = 'O' THEN max(abs(x)) OVER (PARTITION BY s, d) ELSE 1 END, 4) + 0.0 AS x FROM w
""")
def source_wavelets(spark: SparkSession, d: str) -> DataFrame:
    """A wavelet for each kind of source among the orders: by status its form, by priority its frequencies."""
    digit = F.substring("o_orderpriority", 1, 1).cast("int")
    form = F.when(F.col("o_orderstatus") == "F", "ricker").when(F.col("o_orderstatus") == "P", "delta").otherwise("ormsby")
    corners = F.when(form == "ricker", F.array(20.0 + 3 * digit, digit.cast("double"))).when(form == "delta", F.array(digit.cast("double"), digit.cast("double"))).otherwise(F.array(F.lit(4.0), F.lit(8.0), 30.0 + 5 * digit, 50.0 + 5 * digit))
    made = wavelets.design(table(spark, d, "orders").select(form.alias("kind"), corners.alias("corners")), "kind", "corners", 128, 0.004)
    which = F.when(F.col("kind") == "ormsby", (F.col("corners")[2] - 30) / 5).otherwise(F.col("corners")[1]).cast("int")
    out = made.select("kind", which.alias("d"), "n_sources", F.posexplode("samples").alias("i", "x"))
    return _rounded(out, 4, "x").withColumn("i", big(F.col("i")))


@query("SELECT p_partkey, round(pow(p_retailprice * 0.002, 2) * (1 - q * q / 4 + q * q * q * q / 48) / (1 - 0.37 * q), 6) AS factor, round(q / (1 - 0.37 * q), 9) AS inverse_q FROM (SELECT *, 1.0::DOUBLE / (p_size + 5) AS q FROM part)")
def step_attenuated(spark: SparkSession, d: str) -> DataFrame:
    """Time-step factors and attenuations of an attenuating model."""
    factor, inverse_q = models.step_attenuated(F.col("p_retailprice"), 1.0 / (F.col("p_size") + 5), 0.002, 0.37)
    return _rounded(table(spark, d, "part").select("p_partkey", F.round(factor, 6).alias("factor"), F.round(inverse_q, 9).alias("inverse_q")), 9, "inverse_q")


@query("""
    WITH v AS (SELECT p_partkey, p_size / 200.0 AS e, p_size / 500.0 AS dl, (p_partkey % 37 + 1)::DOUBLE AS x, (p_partkey % 11)::DOUBLE AS y, (p_partkey % 23 + 1)::DOUBLE AS z, 0.3 * sin(p_partkey) AS ax, 0.4 * cos(p_partkey) AS ay FROM part),
    a AS (SELECT *, pow(x * ax + y * ay + z * sqrt(1 - ax * ax - ay * ay), 2) AS z2 FROM v), b AS (SELECT *, greatest(0, x * x + y * y + z * z - z2) AS h2 FROM a)
    SELECT p_partkey, round(least(1.0, 0.5 * (1 + sqrt(greatest(0.0, 1 - 8 * (e - dl) * h2 * z2 / pow((1 + 2 * e) * h2 + z2, 2))))), 6) AS scale FROM b
""")
def tti_scale(spark: SparkSession, d: str) -> DataFrame:
    """The anisotropic scale about tilted axes."""
    k = F.col("p_partkey")
    vector = (k % 37 + 1).cast("double"), (k % 11).cast("double"), (k % 23 + 1).cast("double")
    return table(spark, d, "part").select("p_partkey", F.round(reductions.tti_scale(F.col("p_size") / 200.0, F.col("p_size") / 500.0, vector, (0.3 * F.sin(k), 0.4 * F.cos(k))), 6).alias("scale"))


@query("""
    WITH g AS (SELECT vec_id, len(embedding) AS n, list_transform(range(len(embedding)), lambda i: embedding[i + 1]::DOUBLE * i * 0.004) AS g FROM embeddings WHERE len(embedding) > 1),
    f AS (SELECT vec_id, g, unnest(range(2 * n - 1)) AS i FROM g)
    SELECT vec_id, i, round(CASE WHEN i = 0 THEN 0 ELSE (CASE WHEN i % 2 = 0 THEN g[i // 2 + 1] ELSE (g[i // 2 + 1] + g[i // 2 + 2]) / 2 END) / (i * 0.002) END, 6) + 0.0 AS x FROM f
""")
def gain_pair(spark: SparkSession, d: str) -> DataFrame:
    """Traces gained by their time, at half the step, and the gain taken off again."""
    rows = table(spark, d, "embeddings").filter(F.size("embedding") > 1).select("vec_id", traces.gain_by_time(F.col("embedding").cast("array<double>"), 0.004).alias("samples"))
    finer = traces.map_traces(rows, ["vec_id"], "samples", lambda x: traces.resample(1.0, 0.5, 2 * x.shape[1] - 1, "linear", 1)(x))
    out = finer.select("vec_id", F.posexplode(traces.undo_gain(F.col("samples"), 0.002)).alias("i", "x"))
    return _rounded(out, 6, "x").withColumn("i", big(F.col("i")))
