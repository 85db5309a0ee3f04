"""The registered queries of the wave-field operators, and SQL that gives the same rows.

The tables stand in for seismic ones: line items for traces (order = shot, line number = receiver, part
and supplier = coordinates), orders for shots and for a daily series, events for time series of sources
and receivers, parts for a depth model, embeddings for traces of samples.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wavefold.functions import codecs, images, traces
from wavefold.operators import frames, lookups, models, reductions, stencils
from wavefold.plans.registry import ORACLE_SQL, QUERIES, query
from wavefold.sources.tables import lattice, shared_folder, table
from wavefold.streaming.stacking import stack_stream

__all__ = ["ORACLE_SQL", "QUERIES"]


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def big(c: Column) -> Column:
    return c.cast("bigint")


# Scans and geometry


@query("SELECT l_orderkey, n_traces, f.b AS sx, f.c AS sy, f.a AS receiver FROM (SELECT l_orderkey, count(*) AS n_traces, min({'a': l_linenumber, 'b': l_partkey, 'c': l_suppkey}) AS f FROM lineitem GROUP BY l_orderkey)")
def frame_scan(spark: SparkSession, d: str) -> DataFrame:
    return frames.frame_scan(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], {"sx": "l_partkey", "sy": "l_suppkey", "receiver": "l_linenumber"})


@query("SELECT l_orderkey, count(*) AS n_traces, min(l_partkey) - 25.5 AS min_x, max(l_partkey) + 25.5 AS max_x, min(l_suppkey) - 25.5 AS min_y, max(l_suppkey) + 25.5 AS max_y, round(avg(l_partkey), 6) AS centre_x, round(avg(l_suppkey), 6) AS centre_y FROM lineitem GROUP BY l_orderkey")
def frame_bbox(spark: SparkSession, d: str) -> DataFrame:
    boxes = frames.bounding_box(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", "l_suppkey", 25.5)
    return boxes.withColumns({c: F.round(c, 6) for c in ("centre_x", "centre_y")})


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 100")
def shot_sort_limit(spark: SparkSession, d: str) -> DataFrame:
    return frames.first_shots(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"], 100)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'P') THEN o_custkey ELSE o_orderkey END AS source, CASE WHEN o_orderstatus IN ('F', 'P') THEN o_orderkey ELSE o_custkey END AS receiver FROM orders")
def swap_acquisition(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus").isin("F", "P"), "obn").otherwise("streamer")
    return frames.swap_ends(table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("source"), F.col("o_custkey").alias("receiver"), kind.alias("kind")), F.col("kind"), [("source", "receiver")]).drop("kind")


@query("SELECT o_orderkey, i AS source, CASE WHEN i = 0 THEN o_custkey ELSE l_partkey END::DOUBLE AS x, CASE WHEN i = 0 THEN 0.0 ELSE l_linenumber * 0.5 END::DOUBLE AS delay FROM (SELECT o_orderkey, o_custkey, 0 AS i, NULL AS l_partkey, NULL AS l_linenumber FROM orders UNION ALL SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber), l_partkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")
def delay_expand(spark: SparkSession, d: str) -> DataFrame:
    shots = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    source = F.struct(F.col("l_partkey").cast("double").alias("x"), F.col("l_suppkey").cast("double").alias("y"), (F.col("l_linenumber") * 0.5).cast("double").alias("delay"))
    delays = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    out = frames.expand_sources(shots, delays, "o_orderkey", source, "o_custkey", "o_orderkey")
    return out.select("o_orderkey", F.posexplode("sources").alias("source", "s")).select("o_orderkey", big(F.col("source")).alias("source"), "s.x", "s.delay")


@query("SELECT l_orderkey, l_linenumber, (round(((l_partkey - 100.0) * 0.8 + (l_suppkey - 10.0) * 0.6) / 12.5) + 1)::BIGINT AS inline, (round(((l_suppkey - 10.0) * 0.8 - (l_partkey - 100.0) * 0.6) / 12.5) + 1)::BIGINT AS crossline FROM lineitem")
def affine_to_local(spark: SparkSession, d: str) -> DataFrame:
    u, v = frames.to_local(F.col("l_partkey"), F.col("l_suppkey"), (100.0, 10.0), (0.8, 0.6))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", frames.to_line(u, 12.5, 1).alias("inline"), frames.to_line(v, 12.5, 1).alias("crossline"))


@query("SELECT l_orderkey, l_linenumber, l_partkey::DOUBLE AS x, l_suppkey::DOUBLE AS y FROM lineitem")
def affine_round_trip(spark: SparkSession, d: str) -> DataFrame:
    u, v = frames.to_local(F.col("l_partkey"), F.col("l_suppkey"), (100.0, 10.0), (0.8, 0.6))
    x, y = frames.to_world(u, v, (100.0, 10.0), (0.8, 0.6))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 5 AND 45 AND l_discount < 0.085 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def live_trace_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return frames.live_traces(table(spark, d, "lineitem"), F.col("l_quantity").between(5, 45) & (F.col("l_discount") < 0.085), kept, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN o >= 1500 THEN 0 WHEN o > 750 THEN 0.08 + 0.92 * cos((o - 750) / 750 * 1.5707963267948966) ELSE 1 END, 6)::DOUBLE AS weight FROM (SELECT *, sqrt((l_partkey * l_partkey + l_suppkey * l_suppkey)::DOUBLE) AS o FROM lineitem)")
def offset_taper(spark: SparkSession, d: str) -> DataFrame:
    offset = F.sqrt((F.col("l_partkey") * F.col("l_partkey") + F.col("l_suppkey") * F.col("l_suppkey")).cast("double"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(frames.offset_weight(offset, 1500.0), 6).alias("weight"))


@query("SELECT l_orderkey, l_linenumber, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) + 1000)::BIGINT AS receiver FROM lineitem")
def trace_renumber(spark: SparkSession, d: str) -> DataFrame:
    out = frames.renumber(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], 1001)
    return out.select("l_orderkey", "l_linenumber", big(F.col("receiver")).alias("receiver"))


@query("SELECT n_nationkey, ix, iy, n_nationkey * 100.0 + ix * 12.5 AS x, n_regionkey * 50.0 + iy * 25.0 AS y FROM nation, (SELECT unnest(range(8)) AS ix), (SELECT unnest(range(4)) AS iy)")
def receiver_lattice(spark: SparkSession, d: str) -> DataFrame:
    header = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 100.0).alias("x0"), (F.col("n_regionkey") * 50.0).alias("y0"), F.lit(12.5).alias("dx"), F.lit(25.0).alias("dy"), F.lit(8).alias("nx"), F.lit(4).alias("ny"))
    return lattice(header, "x0", "dx", "nx", "y0", "dy", "ny").select("n_nationkey", big(F.col("ix")).alias("ix"), big(F.col("iy")).alias("iy"), "x", "y")


# Gains and weights


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice / max(abs(l_extendedprice)) OVER (PARTITION BY l_orderkey), 6) AS amplitude FROM lineitem")
def trace_normalize(spark: SparkSession, d: str) -> DataFrame:
    traces = table(spark, d, "lineitem")
    most = F.max(F.abs("l_extendedprice")).over(Window.partitionBy("l_orderkey"))
    return traces.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") / most, 6).alias("amplitude"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * sqrt(pow(l_linenumber * 0.5, 2) + pow(2.0 * l_suppkey / 1500.0, 2)), 6) AS gained FROM lineitem")
def time_gain(spark: SparkSession, d: str) -> DataFrame:
    gain = F.hypot(F.col("l_linenumber") * 0.5, 2.0 * F.col("l_suppkey") / 1500.0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") * gain, 6).alias("gained"))


_CONE = "SELECT p_partkey, round(CASE WHEN o <= r THEN 1 WHEN r <= 0 OR o > 2 * r THEN 0 ELSE 0.5 + 0.5 * cos((o - r) / r * 3.141592653589793) END, 6)::DOUBLE AS weight FROM (SELECT p_partkey, p_partkey % 200 AS o, {} AS r FROM part)"


@query(_CONE.format("CASE WHEN p_size <= 20 THEN p_size * 2.0 - 10.0 ELSE 30.0 + (p_size - 20) * 1.5 END"))
def cone_mute(spark: SparkSession, d: str) -> DataFrame:
    radius = reductions.cone_radius(F.col("p_size"), [(0.0, -10.0), (20.0, 30.0), (40.0, 60.0)])
    return table(spark, d, "part").select("p_partkey", F.round(reductions.cone_weight(F.col("p_partkey") % 200, radius), 6).alias("weight"))


@query(_CONE.format("p_size * tan(radians(60)) + 5.0"))
def cone_mute_angle(spark: SparkSession, d: str) -> DataFrame:
    radius = reductions.cone_angle_radius(F.col("p_size"), 60.0, 5.0)
    return table(spark, d, "part").select("p_partkey", F.round(reductions.cone_weight(F.col("p_partkey") % 200, radius), 6).alias("weight"))


@query("SELECT p_partkey, round(least(1.0, 0.5 * (1 + sqrt(greatest(0.0, 1 - 8 * (e - dl) * h2 * z2 / pow((1 + 2 * e) * h2 + z2, 2))))), 6) AS scale FROM (SELECT p_partkey, p_size / 200.0 AS e, p_size / 500.0 AS dl, pow(p_partkey % 37 + 1, 2) AS h2, pow(p_partkey % 23 + 1, 2) AS z2 FROM part)")
def vti_scale(spark: SparkSession, d: str) -> DataFrame:
    h, z = (F.col("p_partkey") % 37 + 1).cast("double"), (F.col("p_partkey") % 23 + 1).cast("double")
    return table(spark, d, "part").select("p_partkey", F.round(reductions.vti_scale(F.col("p_size") / 200.0, F.col("p_size") / 500.0, h, z), 6).alias("scale"))


# Stacks, illumination and compensation


@query("SELECT l_partkey % 64 AS ix, l_suppkey % 16 AS iy, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS stack, count(*) AS fold FROM lineitem GROUP BY 1, 2")
def stack_bins(spark: SparkSession, d: str) -> DataFrame:
    return reductions.stack(table(spark, d, "lineitem"), [(F.col("l_partkey") % 64).alias("ix"), (F.col("l_suppkey") % 16).alias("iy")], cents("l_extendedprice"))


@query("WITH i AS (SELECT p_size AS il, count(*) * 1000 AS v FROM part GROUP BY 1), s AS (SELECT l_quantity::INT AS il, count(*) AS a FROM lineitem GROUP BY 1) SELECT il, (v + coalesce(a, 0))::BIGINT AS v FROM i LEFT JOIN s USING (il)")
def stack_onto_lines(spark: SparkSession, d: str) -> DataFrame:
    image = table(spark, d, "part").groupBy(F.col("p_size").alias("il")).agg((F.count(F.lit(1)) * 1000).alias("v"))
    partial = table(spark, d, "lineitem").select(F.col("l_quantity").cast("int").alias("il"), F.lit(1).cast("bigint").alias("v"))
    return reductions.stack_onto(image, partial, ["il"], "v")


def _illumination(spark: SparkSession, d: str) -> DataFrame:
    return reductions.illumination(table(spark, d, "events"), ["user_id", "event_type"], cents("value"))


_ILLUMINATION = "(SELECT user_id, event_type, sum(round(value * 100)::BIGINT * round(value * 100)::BIGINT)::BIGINT AS illumination FROM events GROUP BY 1, 2)"


@query(f"SELECT * FROM {_ILLUMINATION}")
def illumination(spark: SparkSession, d: str) -> DataFrame:
    return _illumination(spark, d)


@query(f"SELECT user_id, event_type, round(greatest(illumination, 0.2 * max(illumination) OVER ()), 1)::DOUBLE AS whitened FROM {_ILLUMINATION}")
def illum_whiten(spark: SparkSession, d: str) -> DataFrame:
    return reductions.whiten(_illumination(spark, d), "illumination", 0.2).select("user_id", "event_type", F.round("whitened", 1).alias("whitened"))


@query(f"SELECT user_id, event_type, round(sqrt(illumination) / greatest(illumination, 0.2 * max(illumination) OVER ()), 9) AS compensated FROM {_ILLUMINATION}")
def illum_comp(spark: SparkSession, d: str) -> DataFrame:
    cells = _illumination(spark, d).withColumn("image", F.sqrt("illumination"))
    return reductions.compensate(cells, "image", "illumination", 0.2).select("user_id", "event_type", F.round("compensated", 9).alias("compensated"))


@query(f"SELECT user_id, event_type, round(1e6 / (m * (illumination / m + 0.3 * exp(-illumination / m))), 6) AS damping FROM (SELECT *, pow(avg(illumination) OVER (), 0.9) AS m FROM {_ILLUMINATION})")
def damping(spark: SparkSession, d: str) -> DataFrame:
    return reductions.damp(_illumination(spark, d), "illumination", 0.9, 0.3).select("user_id", "event_type", F.round(F.col("damping") * 1e6, 6).alias("damping"))


# Correlations


def _hourly(spark: SparkSession, d: str, kind: str) -> DataFrame:
    at = F.floor(F.unix_timestamp("ts") / 3600).alias("hour")
    return table(spark, d, "events").filter(F.col("event_type") == kind).groupBy("user_id", at).agg(F.sum(cents("value")).alias("v"))


_HOURLY = "(SELECT user_id, floor(epoch(ts) / 3600)::BIGINT AS hour, sum(round(value * 100)::BIGINT)::BIGINT AS v FROM events WHERE event_type = '{}' GROUP BY 1, 2)"


@query(f"SELECT a.user_id, 0::INT AS lag, sum(a.v * b.v)::BIGINT AS correlation, count(*) AS n FROM {_HOURLY.format('click')} a JOIN {_HOURLY.format('view')} b ON a.user_id = b.user_id AND a.hour = b.hour GROUP BY 1")
def xcorr_zero_lag(spark: SparkSession, d: str) -> DataFrame:
    return lookups.lag_join(_hourly(spark, d, "click"), _hourly(spark, d, "view"), ["user_id"], "hour", 0, F.col("v"), F.col("v"))


@query(f"SELECT a.user_id, (b.hour - a.hour)::INT AS lag, sum(a.v * b.v)::BIGINT AS correlation, count(*) AS n FROM {_HOURLY.format('click')} a JOIN {_HOURLY.format('view')} b ON a.user_id = b.user_id AND b.hour BETWEEN a.hour - 2 AND a.hour + 2 GROUP BY 1, 2")
def lag_gathers(spark: SparkSession, d: str) -> DataFrame:
    return lookups.lag_join(_hourly(spark, d, "click"), _hourly(spark, d, "view"), ["user_id"], "hour", 2, F.col("v"), F.col("v"))


@query("WITH s AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT a.vec_id, round(sum(a.x * b.x), 6) + 0.0 AS product, round(sum(abs(a.x * b.x)), 6) AS magnitude, round(sum(greatest(a.x * b.x, 0)), 6) + 0.0 AS positive FROM s a JOIN s b ON b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY a.vec_id")
def embedding_correlate(spark: SparkSession, d: str) -> DataFrame:
    """Each trace with the next one: their product over the samples that both have, its magnitude and its positive part."""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    both = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id").filter(F.least(F.size("a"), F.size("b")) > 0)
    n = F.least(F.size("a"), F.size("b"))
    product = F.zip_with(F.slice("a", F.lit(1), n), F.slice("b", F.lit(1), n), lambda x, y: x * y)
    total = lambda x: F.round(F.aggregate(x, F.lit(0.0), lambda s, v: s + v), 6) + 0.0
    return both.select("vec_id", total(product).alias("product"), total(F.transform(product, F.abs)).alias("magnitude"), total(F.transform(product, lambda x: F.greatest(x, F.lit(0.0)))).alias("positive"))


# Stencils on the daily series of each order priority

_DAILY = "(SELECT o_orderpriority AS line, (epoch(o_orderdate) // 86400)::BIGINT AS day, sum(round(o_totalprice)::BIGINT)::BIGINT AS v FROM orders GROUP BY 1, 2)"


def _daily(spark: SparkSession, d: str) -> DataFrame:
    day = F.floor(F.unix_timestamp("o_orderdate") / 86400).alias("day")
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("line"), day).agg(F.sum(F.round("o_totalprice").cast("bigint")).alias("v"))


def around_sql(rows: str, keys: list[str], order: str, half: int) -> str:
    """(keys, order, k, v) of each place and those up to half steps away, edges repeated."""
    same = " AND ".join(f"n.{c} = a.{c}" for c in keys) or "true"
    by = f"PARTITION BY {', '.join(keys)}" if keys else ""
    return f"(SELECT {', '.join(f'a.{c}' for c in [*keys, order])}, k, a.v AS own, n.v FROM (SELECT *, min({order}) OVER ({by}) AS lo, max({order}) OVER ({by}) AS hi FROM {rows}) a CROSS JOIN (SELECT unnest(range({-half}, {half + 1})) AS k) JOIN {rows} n ON {same} AND n.{order} = least(greatest(a.{order} + k, lo), hi))"


def _weights_sql(weights: list[float]) -> str:
    half = len(weights) // 2
    return "CASE k " + " ".join(f"WHEN {k - half} THEN {w}::DOUBLE" for k, w in enumerate(weights)) + " END"


@query(f"SELECT line, day, round(avg(v), 4) AS mean FROM {around_sql(_DAILY, ['line'], 'day', 3)} GROUP BY 1, 2")
def box_mean(spark: SparkSession, d: str) -> DataFrame:
    return stencils.box_mean(_daily(spark, d), ["line"], "day", "v", 3).select("line", "day", F.round("mean", 4).alias("mean"))


@query(f"SELECT line, day, list_sort(list(v))[(count(*)::INT + 1) // 2] AS median FROM {around_sql(_DAILY, ['line'], 'day', 1)} GROUP BY 1, 2")
def median3(spark: SparkSession, d: str) -> DataFrame:
    return stencils.median3(_daily(spark, d), ["line"], "day", "v").select("line", "day", "median")


@query(f"SELECT line, day, list_sort(list(v))[(count(*)::INT + 1) // 2] AS median FROM {around_sql(_DAILY, ['line'], 'day', 2)} GROUP BY 1, 2")
def running_median(spark: SparkSession, d: str) -> DataFrame:
    return stencils.running_median(_daily(spark, d), ["line"], "day", "v", 2).select("line", "day", "median")


@query(f"SELECT line, day, round(sum({_weights_sql(stencils.QUARTERS)} * v) / sum({_weights_sql(stencils.QUARTERS)}), 3) AS smooth FROM {around_sql(_DAILY, ['line'], 'day', 1)} GROUP BY 1, 2")
def smooth121(spark: SparkSession, d: str) -> DataFrame:
    return stencils.weighted(_daily(spark, d), ["line"], "day", "v", stencils.QUARTERS, "smooth").select("line", "day", F.round("smooth", 3).alias("smooth"))


@query(f"SELECT line, day, round(sum({_weights_sql(stencils.SMOOTH_5)} * v) / sum({_weights_sql(stencils.SMOOTH_5)}), 3) AS smooth FROM {around_sql(_DAILY, ['line'], 'day', 2)} GROUP BY 1, 2")
def smooth5(spark: SparkSession, d: str) -> DataFrame:
    return stencils.weighted(_daily(spark, d), ["line"], "day", "v", stencils.SMOOTH_5, "smooth").select("line", "day", F.round("smooth", 3).alias("smooth"))


def difference_sql(rows: str, keys: list[str], order: str, accuracy: int, second: bool) -> str:
    """(keys, order, d): the central difference over true places, those that are not there counting as zero. Weights are derivatives of the polynomials through the places, in fractions, not a closed form."""
    half, weights = accuracy // 2, []
    for j in range(-half, half + 1):
        basis = [Fraction(1)]  # coefficients of the polynomial that is 1 at j and 0 at the other places
        for m in range(-half, half + 1):
            if m != j:
                basis = [(a - m * b) / (j - m) for a, b in zip([Fraction(0), *basis], [*basis, Fraction(0)], strict=True)]
        weights.append(float(basis[2] * 2 if second else basis[1]))
    same = " AND ".join(f"n.{c} = a.{c}" for c in [*keys])
    case = "CASE n.{0} - a.{0} ".format(order) + " ".join(f"WHEN {int(x)} THEN {float(w)!r}::DOUBLE" for x, w in zip(range(-half, half + 1), weights, strict=True)) + " END"
    return f"(SELECT {', '.join(f'a.{c}' for c in [*keys, order])}, sum({case} * n.v) AS d FROM {rows} a JOIN {rows} n ON {same} AND n.{order} BETWEEN a.{order} - {half} AND a.{order} + {half} GROUP BY {', '.join(f'a.{c}' for c in [*keys, order])})"


@query(f"SELECT line, day, round(d / 3.7, 3) + 0.0 AS slope FROM {difference_sql(_DAILY, ['line'], 'day', 8, False)}")
def stencil_d1(spark: SparkSession, d: str) -> DataFrame:
    return stencils.derivative(_daily(spark, d), ["line"], "day", "v", "slope", step=3.7).select("line", "day", (F.round("slope", 3) + 0.0).alias("slope"))


@query(f"SELECT line, day, round(d / (1.3 * 1.3), 3) + 0.0 AS curvature FROM {difference_sql(_DAILY, ['line'], 'day', 8, True)}")
def stencil_d2(spark: SparkSession, d: str) -> DataFrame:
    return stencils.derivative(_daily(spark, d), ["line"], "day", "v", "curvature", second=True, step=1.3).select("line", "day", (F.round("curvature", 3) + 0.0).alias("curvature"))


@query(f"SELECT line, day, round(d / (1.37 * 1.37), 1) + 0.0 AS curvature FROM {difference_sql(_DAILY, ['line'], 'day', 14, True)}")
def stencil_order_14(spark: SparkSession, d: str) -> DataFrame:
    return stencils.derivative(_daily(spark, d), ["line"], "day", "v", "curvature", second=True, step=1.37, accuracy=14).select("line", "day", (F.round("curvature", 1) + 0.0).alias("curvature"))


@query(f"SELECT a.line, 2 * a.day + h AS fine, CASE h WHEN 0 THEN a.v::DOUBLE ELSE (a.v + coalesce(b.v, a.v)) / 2 END AS v FROM {_DAILY} a LEFT JOIN {_DAILY} b ON b.line = a.line AND b.day = a.day + 1, (SELECT unnest([0, 1]) AS h)")
def refine_double(spark: SparkSession, d: str) -> DataFrame:
    return stencils.upsample(_daily(spark, d).withColumn("v", F.col("v").cast("double")), ["line"], "day", "v")


@query(f"SELECT a.line, a.day, CASE WHEN a.day < 10000 THEN coalesce(-b.v, 0) WHEN a.day = 10000 THEN 0 ELSE a.v END::DOUBLE AS v FROM {_DAILY} a LEFT JOIN {_DAILY} b ON a.line = b.line AND b.day = 20000 - a.day")
def mirror_odd(spark: SparkSession, d: str) -> DataFrame:
    return lookups.mirror(_daily(spark, d).withColumn("v", F.col("v").cast("double")), ["line"], "day", 10_000, "v", -1).select("line", "day", "v")


# Interpolation and lookups


@query(f"""
    WITH c AS (SELECT day::DOUBLE AS lo, day + 1.0 AS hi, v::DOUBLE AS v FROM (SELECT day, sum(v) AS v FROM {_DAILY} GROUP BY 1)),
    s AS (SELECT *, unnest(range(floor(lo / 7.5)::BIGINT, ceil(hi / 7.5)::BIGINT)) AS bin FROM c),
    l AS (SELECT bin, v, least(hi, (bin + 1) * 7.5) - greatest(lo, bin * 7.5) AS len FROM s)
    SELECT bin, round(sum(len * v) / sum(len), 4) AS average, sum(len) AS covered FROM l GROUP BY bin
""")
def interval_avg(spark: SparkSession, d: str) -> DataFrame:
    cells = _daily(spark, d).groupBy("day").agg(F.sum("v").cast("double").alias("v"))
    out = lookups.interval_average(cells, F.col("day").cast("double"), F.col("day") + 1.0, F.col("v"), 7.5)
    return out.select("bin", F.round("average", 4).alias("average"), "covered")


_GRID = "(SELECT p_size - 1 AS ix, replace(p_brand, 'Brand#', '')::INT - 1 AS iy, count(*)::BIGINT AS v FROM part GROUP BY 1, 2)"


_LINE_ID = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query(f"""
    WITH q AS (SELECT {_LINE_ID}, l_quantity * 1.1 - 2.5 AS x, l_discount * 250.0 AS y FROM lineitem),
    b AS (SELECT *, least(greatest(floor(x), 0), 48)::INT AS i, least(greatest(floor(y), 0), 23)::INT AS j FROM q),
    c AS (SELECT {_LINE_ID}, i + a AS ix, j + k AS iy, (CASE a WHEN 1 THEN x - i ELSE 1 - (x - i) END) * (CASE k WHEN 1 THEN y - j ELSE 1 - (y - j) END) AS w FROM b, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS k))
    SELECT {_LINE_ID}, CASE WHEN count(*) FILTER (v IS NULL) = 0 THEN round(sum(w * v), 6) + 0.0 END AS v FROM c LEFT JOIN {_GRID} g USING (ix, iy) WHERE w <> 0 GROUP BY {_LINE_ID}
""")
def bilinear_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every line item is a point of its own, whether or not another lies at its place."""
    keys = _LINE_ID.split(", ")
    cells = table(spark, d, "part").groupBy((F.col("p_size") - 1).alias("ix"), (F.regexp_replace("p_brand", "Brand#", "").cast("int") - 1).alias("iy")).agg(F.count(F.lit(1)).alias("v"))
    points = table(spark, d, "lineitem").select(*keys, (F.col("l_quantity") * 1.1 - 2.5).alias("x"), (F.col("l_discount") * 250.0).alias("y"))
    out = lookups.bilinear(points, keys, cells, "x", "y", (50, 25), "v")
    return out.select(*keys, (F.round("v", 6) + 0.0).alias("v"))


@query("WITH g AS (SELECT p_size AS ix, min(p_partkey) AS v FROM part GROUP BY 1), t AS (SELECT DISTINCT (l_suppkey - 10) AS target FROM lineitem) SELECT target, v FROM t LEFT JOIN g ON ix = least(greatest(target, 1), 50)")
def window_read_clamped(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "part").groupBy(F.col("p_size").cast("bigint").alias("ix")).agg(F.min("p_partkey").alias("v")).withColumn("iy", F.lit(0).cast("bigint"))
    targets = table(spark, d, "lineitem").select((F.col("l_suppkey") - 10).alias("ix")).distinct().withColumn("iy", F.lit(7).cast("bigint"))
    return frames.window_clamped(cells, targets, "ix", "iy", (1, 50, 0, 0), "v").select(F.col("ix").alias("target"), "v")


@query("SELECT event_id, o_orderdate AS at, o_orderkey FROM (SELECT event_id, (user_id % 5)::BIGINT AS k, (event_id % 2400 + 9131)::BIGINT AS day FROM events) e ASOF JOIN (SELECT (o_orderkey % 5)::BIGINT AS k, (epoch(o_orderdate) // 86400)::BIGINT AS day, max(o_orderkey) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY 1, 2) o ON e.k = o.k AND e.day >= o.day")
def depth_as_of(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", (F.col("user_id") % 5).alias("k"), (F.col("event_id") % 2400 + 9131).alias("day"))
    day = F.floor(F.unix_timestamp("o_orderdate") / 86400).alias("at_day")
    places = table(spark, d, "orders").groupBy((F.col("o_orderkey") % 5).alias("k"), day).agg(F.max("o_orderkey").alias("o_orderkey"), F.max("o_orderdate").alias("at"))
    return lookups.as_of(rows, ["k"], "day", places, "at_day", ["o_orderkey", "at"]).select("event_id", "at", "o_orderkey").filter("o_orderkey IS NOT NULL")


@query(f"SELECT line, day, round(sum(v * 0.001) OVER (PARTITION BY line ORDER BY day), 3) AS depth FROM {_DAILY}")
def time_to_depth(spark: SparkSession, d: str) -> DataFrame:
    return reductions.running_depth(_daily(spark, d), ["line"], "day", F.col("v"), 0.002).select("line", "day", F.round("depth", 3).alias("depth"))


_PLACES = "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_partkey + l_discount * 5 AS x FROM lineitem)"


def _places(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", (F.col("l_partkey") + F.col("l_discount") * 5).alias("x"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(sum((CASE k WHEN 0 THEN 1 - (x - i) ELSE x - i END) * coalesce(p_size, 0)), 6) + 0.0 AS p_size FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, x, floor(x)::BIGINT AS i FROM {_PLACES}), (SELECT unnest([0, 1]) AS k) LEFT JOIN part ON p_partkey = i + k GROUP BY 1, 2, 3, 4, 5")
def receiver_gather(spark: SparkSession, d: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    cells = table(spark, d, "part").select(F.col("p_partkey").alias("ix"), "p_size")
    return lookups.gather(_places(spark, d), keys, {"ix": "x"}, cells, "p_size").withColumn("p_size", F.round("p_size", 6) + 0.0)


@query(f"SELECT floor(x)::BIGINT + k AS ix, round(sum((CASE k WHEN 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) * l_quantity), 4) + 0.0 AS added FROM {_PLACES}, (SELECT unnest([0, 1]) AS k) GROUP BY 1")
def source_scatter(spark: SparkSession, d: str) -> DataFrame:
    return lookups.scatter(_places(spark, d), {"ix": "x"}, "l_quantity").select("ix", (F.round("added", 4) + 0.0).alias("added"))


# Models and checks


@query("SELECT p_size, min(p_partkey) AS least, max(p_partkey) AS largest, round(avg(p_partkey), 6) AS mean FROM part GROUP BY 1")
def depth_profile_min(spark: SparkSession, d: str) -> DataFrame:
    return reductions.profile(table(spark, d, "part"), "p_size", "p_partkey").withColumn("mean", F.round("mean", 6))


@query("SELECT round(min(2.0 / (0.05 * p_retailprice * sqrt(1 + 2 * p_size / 200.0))) * (1 - (3 + 2 / pi() * ln(3.0)) / 80.0), 9) AS dt FROM part")
def stable_dt(spark: SparkSession, d: str) -> DataFrame:
    """Vertical symmetry without direction, and attenuation."""
    rescale = reductions.attenuation_rescale(80.0, 45.0, 15.0)
    return reductions.stable_step(table(spark, d, "part"), 0.05, F.col("p_retailprice"), 1 + 2 * F.col("p_size") / 200.0, attenuation=rescale).select(F.round("dt", 9).alias("dt"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, count_if({c} IS NULL)::BIGINT AS nulls, count_if(isnan({c}::DOUBLE) OR isinf({c}::DOUBLE))::BIGINT AS not_finite, count_if({c} < 100)::BIGINT AS small FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_tax")))
def finite_check(spark: SparkSession, d: str) -> DataFrame:
    return reductions.checks(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"], 100.0)


@query("SELECT l_returnflag, sum(abs(round(l_extendedprice * 100)::BIGINT))::BIGINT AS magnitude, max(abs(l_extendedprice)) AS largest, count(*) AS n FROM lineitem GROUP BY 1")
def abs_checksum(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum(F.abs(cents("l_extendedprice"))).alias("magnitude"), F.max(F.abs("l_extendedprice")).alias("largest"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE ((l_partkey - 3) % 4 + 4) % 4 = 0 AND ((l_suppkey - 1) % 2 + 2) % 2 = 0")
def strided_read(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").filter((F.pmod(F.col("l_partkey") - 3, F.lit(4)) == 0) & (F.pmod(F.col("l_suppkey") - 1, F.lit(2)) == 0)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("WITH a AS (SELECT l_suppkey AS k, count(*) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_suppkey AS k, count(*) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, (coalesce(a.v, 0) - coalesce(b.v, 0))::BIGINT AS v FROM a FULL JOIN b ON a.k = b.k")
def direct_arrival_diff(spark: SparkSession, d: str) -> DataFrame:
    traces = table(spark, d, "lineitem")
    a, b = (traces.filter(F.col("l_returnflag") == f).groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.lit(1)).alias("v")) for f in "AR")
    return lookups.difference(a, b, ["k"], "v")


@query("WITH a AS (SELECT l_partkey AS k, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS k, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT k, a.v AS a, b.v AS b, round(abs(a.v - b.v) / greatest(abs(a.v), abs(b.v), 1e-12), 6) AS relative FROM a JOIN b USING (k) WHERE abs(a.v - b.v) / greatest(abs(a.v), abs(b.v), 1e-12) > 0.1")
def compare_tolerance(spark: SparkSession, d: str) -> DataFrame:
    traces = table(spark, d, "lineitem")
    a, b = (traces.filter(F.col("l_returnflag") == f).groupBy(F.col("l_partkey").alias("k")).agg(F.sum("l_quantity").alias("v")) for f in "AR")
    return lookups.mismatches(a, b, ["k"], "v", 0.1).withColumn("relative", F.round("relative", 6))


@query("SELECT l_linenumber AS iz, " + ", ".join(f"(sum(round(l_extendedprice * 100)::BIGINT) FILTER (l_returnflag = '{f}'))::BIGINT AS {f}" for f in "ANR") + " FROM lineitem GROUP BY 1")
def slice_pivot(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("iz")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum(cents("l_extendedprice")))


@query("SELECT l_suppkey, max(l_extendedprice) AS peak FROM lineitem GROUP BY 1 ORDER BY peak DESC, l_suppkey LIMIT 20")
def top_images(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.max("l_extendedprice").alias("peak")).orderBy(F.desc("peak"), "l_suppkey").limit(20)


@query("WITH a AS (SELECT DISTINCT l_partkey AS line FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT p_partkey AS line FROM part WHERE p_size BETWEEN 10 AND 30) SELECT line FROM a INTERSECT SELECT line FROM b")
def shared_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_partkey").alias("line"))
    return lines.intersect(table(spark, d, "part").filter("p_size BETWEEN 10 AND 30").select(F.col("p_partkey").alias("line")))


@query("SELECT p_partkey, round(-sin(radians(p_size)) * cos(radians(p_partkey % 360)), 6) + 0.0 AS ax, round(-sin(radians(p_size)) * sin(radians(p_partkey % 360)), 6) + 0.0 AS ay FROM part")
def symmetry_axis(spark: SparkSession, d: str) -> DataFrame:
    x, y = models.axis_from_angles(F.col("p_size"), F.col("p_partkey") % 360)
    return table(spark, d, "part").select("p_partkey", (F.round(x, 6) + 0.0).alias("ax"), (F.round(y, 6) + 0.0).alias("ay"))


@query("SELECT l_orderkey, l_linenumber, round(degrees(acos(z / sqrt(x * x + y * y + z * z))), 4) AS dip, round(degrees(atan2(y, x)), 4) AS azimuth FROM (SELECT l_orderkey, l_linenumber, l_partkey + 1.0 AS x, l_suppkey + 1.0 AS y, l_quantity AS z FROM lineitem)")
def vector_angles(spark: SparkSession, d: str) -> DataFrame:
    dip, azimuth = models.angles_of(F.col("l_partkey") + 1.0, F.col("l_suppkey") + 1.0, F.col("l_quantity"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(dip, 4).alias("dip"), F.round(azimuth, 4).alias("azimuth"))


@query("SELECT p_partkey, round(pow(p_retailprice * 0.002, 2), 6) AS factor, round(p_retailprice * pow(p_size, 1.5), 3) AS scaled FROM part")
def step_factor(spark: SparkSession, d: str) -> DataFrame:
    scaled = models.depth_power(F.col("p_retailprice"), F.col("p_size"), 1.5)
    return table(spark, d, "part").select("p_partkey", F.round(models.step_squared(F.col("p_retailprice"), 0.002), 6).alias("factor"), F.round(scaled, 3).alias("scaled"))


@query("SELECT round_even((l_extendedprice - m) / 250.0, 0)::BIGINT AS ix, round(avg(l_quantity), 6) AS l_quantity FROM lineitem, (SELECT min(l_extendedprice) AS m FROM lineitem) GROUP BY 1")
def snap_to_grid(spark: SparkSession, d: str) -> DataFrame:
    traces = table(spark, d, "lineitem").select("l_extendedprice", "l_quantity")
    return models.snap_to_grid(traces, "l_extendedprice", "l_quantity", 250.0).select("ix", F.round("l_quantity", 6).alias("l_quantity"))


@query(f"""
    WITH s AS (SELECT line, day, v, lead(day) OVER w AS nd, lead(v) OVER w AS nv FROM {_DAILY} WINDOW w AS (PARTITION BY line ORDER BY day)),
    e AS (SELECT *, unnest(range(day, coalesce(nd, day + 1))) AS place FROM s)
    SELECT line, place AS day, CASE WHEN nd IS NULL OR place - day <= nd - place THEN v ELSE nv END AS v FROM e
""")
def fill_holes(spark: SparkSession, d: str) -> DataFrame:
    return models.fill_holes(_daily(spark, d), ["line"], "day", "v").select("line", "day", "v")


_SLOW = f"(SELECT line, day, 1.0::DOUBLE / v AS v FROM {_DAILY} WHERE v > 0)"


@query(f"SELECT line, day, round(1 / avg(v), 3) AS v FROM {around_sql(_SLOW, ['line'], 'day', 2)} WHERE day % 4 = 0 GROUP BY 1, 2")
def coarsen_slowness(spark: SparkSession, d: str) -> DataFrame:
    return models.coarsen(_daily(spark, d).filter("v > 0"), ["line"], "day", "v", 4).select("line", "day", F.round("v", 3).alias("v"))


_CELLS = f"(SELECT ix, iy, v::DOUBLE AS v FROM {_GRID})"


@query(f"SELECT ix, iy, round(x.d / (12.7 * 12.7) + y.d / (10.3 * 10.3), 4) + 0.0 AS laplacian FROM {difference_sql(_CELLS, ['iy'], 'ix', 8, True)} x JOIN {difference_sql(_CELLS, ['ix'], 'iy', 8, True)} y USING (ix, iy)")
def image_laplacian(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "part").groupBy((F.col("p_size") - 1).alias("ix"), (F.regexp_replace("p_brand", "Brand#", "").cast("int") - 1).alias("iy")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    return models.laplacian(cells, "ix", "iy", "v", 12.7, 10.3).select("ix", "iy", (F.round("laplacian", 4) + 0.0).alias("laplacian"))


@query("SELECT l_linenumber, l_partkey % 64 AS ix, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS stack, count(*) AS fold FROM lineitem WHERE l_linenumber = 3 GROUP BY 1, 2")
def centre_slice(spark: SparkSession, d: str) -> DataFrame:
    return reductions.stack(models.centre_slice(table(spark, d, "lineitem"), "l_linenumber", 7), [F.col("l_linenumber"), (F.col("l_partkey") % 64).alias("ix")], cents("l_extendedprice"))


# Whole traces


def _traces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("samples"))


def _samples(rows: DataFrame, digits: int) -> DataFrame:
    """A row for each sample."""
    return rows.select("vec_id", F.posexplode("samples").alias("i", "x")).select("vec_id", big(F.col("i")).alias("i"), (F.round("x", digits) + 0.0).alias("x"))


def _sample_sql(samples: str) -> str:
    return f"SELECT vec_id, unnest(range(len(l))) AS i, unnest(l) AS x FROM (SELECT vec_id, {samples} AS l FROM embeddings)"


@query(_sample_sql("list_transform(range(len(embedding)), lambda i: round(embedding[(i - 3 + len(embedding)) % len(embedding) + 1]::DOUBLE, 5) + 0.0)"))
def time_shift(spark: SparkSession, d: str) -> DataFrame:
    return _samples(traces.map_traces(_traces(spark, d), ["vec_id"], "samples", traces.time_shift(3.0)), 5)


@query(_sample_sql("list_transform(range(127), lambda i: round(CASE WHEN i % 2 = 0 THEN embedding[i // 2 + 1]::DOUBLE ELSE (embedding[i // 2 + 1]::DOUBLE + embedding[i // 2 + 2]::DOUBLE) / 2 END, 5) + 0.0)"))
def resample_linear(spark: SparkSession, d: str) -> DataFrame:
    return _samples(traces.map_traces(_traces(spark, d), ["vec_id"], "samples", traces.resample(1.0, 0.5, 127, "linear", 1)), 5)


_SAMPLES = "(SELECT vec_id, len(embedding) AS n, unnest(range(len(embedding))) AS j, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def _circular(kernel: str, digits: int = 7) -> str:
    """A map by frequencies as a circular convolution: kernel is the sum over the frequencies m (of n samples) of each weight times its cosine at m d / n, for the distance d between samples."""
    return f"""WITH k AS (SELECT n, d, {kernel} AS g FROM (SELECT n, unnest(range(n)) AS d FROM (SELECT DISTINCT len(embedding) AS n FROM embeddings)), (SELECT unnest(range(4096)) AS m) WHERE m <= n // 2 GROUP BY n, d)
        SELECT vec_id, i, round(sum(g * x), {digits}) + 0.0 AS x FROM {_SAMPLES} s JOIN (SELECT n, unnest(range(n)) AS i FROM (SELECT DISTINCT len(embedding) AS n FROM embeddings)) o USING (n) JOIN k ON k.n = s.n AND k.d = (i - j + s.n) % s.n GROUP BY vec_id, i"""


#: Twice, but once for the first frequency and for the last of an even number of samples.
_TWICE = "(CASE WHEN m = 0 OR 2 * m = n THEN 1 ELSE 2 END)"
_BAND = "(CASE WHEN f <= 4 OR f >= 80 THEN 0 WHEN f < 8 THEN 0.5 - 0.5 * cos(pi() * (f - 4) / 4) WHEN f <= 60 THEN 1 ELSE 0.5 - 0.5 * cos(pi() * (80 - f) / 20) END)".replace("f ", "(m / (n * 0.004)) ").replace("(f", "((m / (n * 0.004))").replace("- f)", "- m / (n * 0.004))")


@query("""
    WITH o AS (SELECT vec_id, embedding, len(embedding) AS n, unnest(range(84)) AS i FROM embeddings),
    p AS (SELECT *, i * 0.003::DOUBLE / 0.004::DOUBLE AS pos, least(n - 2, floor(i * 0.003::DOUBLE / 0.004::DOUBLE))::INT AS b FROM o),
    q AS (SELECT *, least(9, least(b, n - 2 - b) + 1) AS h FROM p WHERE pos <= n - 1),
    w AS (SELECT vec_id, i, h, pos - j AS t, embedding[j + 1]::DOUBLE AS x FROM (SELECT *, unnest(range(b - h + 1, b + h + 1)) AS j FROM q)),
    s AS (SELECT vec_id, i, sum(x * CASE WHEN abs(t) < 1e-12 THEN 1 WHEN abs(t) >= h THEN 0 ELSE sin(pi() * t) / (pi() * t) * sin(pi() * t / h) / (pi() * t / h) END) AS x FROM w GROUP BY 1, 2)
    SELECT o.vec_id, o.i, round(coalesce(s.x, 0), 7) + 0.0 AS x FROM o LEFT JOIN s ON s.vec_id = o.vec_id AND s.i = o.i
""")
def resample_traces(spark: SparkSession, d: str) -> DataFrame:
    return _samples(traces.map_traces(_traces(spark, d), ["vec_id"], "samples", traces.resample(0.004, 0.003, 84, "lanczos", 9)), 7)


@query(_circular(f"sum({_TWICE} * {_BAND} * 2 * pi() * (m / (n * 0.004)) * cos(2 * pi() * m * d / n)) / n", 5))
def band_pass(spark: SparkSession, d: str) -> DataFrame:
    return _samples(traces.map_traces(_traces(spark, d), ["vec_id"], "samples", traces.band_pass(0.004, (4.0, 8.0, 60.0, 80.0), power=1.0)), 5)


@query(f"""
    WITH lens AS (SELECT DISTINCT len(embedding) AS n FROM embeddings),
    f AS (SELECT n, m, 2 / 0.004 * sin(least(pi() * m / n, pi() / 2)) * 0.004 AS w FROM lens, (SELECT unnest(range(4096)) AS m) WHERE m <= n // 2),
    g AS (SELECT n, i, j, sum({_TWICE} * cos(2 * pi() * m * i / n - w * j)) / n AS g FROM f, (SELECT n AS n2, unnest(range(n)) AS i FROM lens) a, (SELECT n AS n3, unnest(range(n)) AS j FROM lens) b WHERE n2 = n AND n3 = n GROUP BY n, i, j)
    SELECT vec_id, i, round(sum(g * x), 7) + 0.0 AS x FROM {_SAMPLES} s JOIN g USING (n, j) GROUP BY vec_id, i
""")
def phase_correction(spark: SparkSession, d: str) -> DataFrame:
    return _samples(traces.map_traces(_traces(spark, d), ["vec_id"], "samples", traces.phase_correction(0.004)), 7)


@query(_circular(f"sum({_TWICE} * -pow(2 * pi() * m / (n * 12.5), 2) * cos(2 * pi() * m * d / n)) / n"))
def spectral_curvature(spark: SparkSession, d: str) -> DataFrame:
    return _samples(traces.map_traces(_traces(spark, d), ["vec_id"], "samples", traces.spectral_derivative(12.5, 2)), 7)


@query(f"""
    WITH RECURSIVE s AS (SELECT vec_id, n, j AS i, x, lag(x) OVER w AS a, lead(x) OVER w AS b, lag(x, 2) OVER w AS aa, lead(x, 2) OVER w AS bb FROM {_SAMPLES} WINDOW w AS (PARTITION BY vec_id ORDER BY j)),
    t AS (
        SELECT vec_id, n, i, CASE WHEN i = 0 THEN -2.5 * x + 2 * b + 0.5 * bb WHEN i = n - 1 THEN 2.5 * x - 2 * a - 0.5 * aa ELSE 0.75 * (b - a) END / 12.5 AS r,
            CASE WHEN i = n - 1 THEN 2.0 ELSE 0.25 END AS low, CASE WHEN i = 0 THEN 2.0 ELSE 0.25 END AS high
        FROM s WHERE n >= 4
    ),
    down AS (
        SELECT vec_id, n, i, high, 1.0::DOUBLE AS mid, r FROM t WHERE i = 0
        UNION ALL SELECT t.vec_id, t.n, t.i, t.high, 1 - t.low / d.mid * d.high, t.r - t.low / d.mid * d.r FROM down d JOIN t ON t.vec_id = d.vec_id AND t.i = d.i + 1
    ),
    up AS (
        SELECT vec_id, i, r / mid AS x FROM down WHERE i = n - 1
        UNION ALL SELECT d.vec_id, d.i, (d.r - d.high * u.x) / d.mid FROM up u JOIN down d ON d.vec_id = u.vec_id AND d.i = u.i - 1
    )
    SELECT vec_id, i::BIGINT AS i, round(x, 9) + 0.0 AS x FROM up
""")
def compact_slope(spark: SparkSession, d: str) -> DataFrame:
    return _samples(traces.map_traces(_traces(spark, d), ["vec_id"], "samples", traces.compact_derivative(12.5)), 9)


@query(f"""
    WITH t AS (SELECT vec_id, n, j, x, max(abs(x)) OVER (PARTITION BY vec_id) AS most FROM {_SAMPLES}),
    c AS (SELECT vec_id, n, x, most, CASE WHEN most > 0 THEN round_even(x / most * 32767, 0) ELSE 0 END AS step FROM t)
    SELECT vec_id, max(n)::INT AS n, sum(step)::BIGINT AS steps, sum(abs(step))::BIGINT AS magnitude, count(*) FILTER (abs(step * most::FLOAT::DOUBLE / 32767 - x) > most / 32767 * 0.5001)::INT AS n_off FROM c GROUP BY vec_id
""")
def codec_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The 16-bit steps of each trace, summed up, and how many samples the round trip moves by more than half a step of the trace's range."""
    near = traces.map_traces(_traces(spark, d).withColumn("kept", F.col("samples")), ["vec_id", "kept"], "samples", codecs.CODECS["steps"], "decoded")
    most = F.array_max(F.transform("kept", F.abs))
    steps = F.transform("decoded", lambda x: F.when(most > 0, F.rint(x / most.cast("float").cast("double") * 32767)).otherwise(0.0))
    off = F.size(F.filter(F.zip_with("kept", "decoded", lambda a, b: F.abs(a - b)), lambda x: x > most / 32767 * 0.5001))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v).cast("bigint")
    return near.select("vec_id", F.size("kept").alias("n"), total(steps).alias("steps"), total(F.transform(steps, F.abs)).alias("magnitude"), off.alias("n_off"))


_POWER = "floor(log2(m))"


@query(f"""
    WITH t AS (SELECT vec_id, j, x, max(abs(x)) OVER (PARTITION BY vec_id) AS most FROM {_SAMPLES}),
    y AS (SELECT vec_id, x, most, CASE WHEN most > 1e-25 THEN abs(x) / most ELSE 0 END AS m FROM t),
    c AS (SELECT vec_id, x, most, sign(x) * most * CASE WHEN m >= pow(2, -4) AND m < 1 THEN floor(m * 16384) / 16384 WHEN m = 1 THEN 1 WHEN m >= pow(2, -20) THEN floor((m / pow(2, {_POWER}) - 1) * 1024) / 1024 * pow(2, {_POWER}) + pow(2, {_POWER}) WHEN m >= pow(2, -29) THEN floor(m * pow(2, 30)) / pow(2, 30) ELSE 0 END AS d FROM y)
    SELECT vec_id, round(sum(d), 7) + 0.0 AS total, round(max(abs(d - x)), 9) + 0.0 AS worst FROM c GROUP BY vec_id
""")
def codec_pseudo_float(spark: SparkSession, d: str) -> DataFrame:
    """What 16-bit pseudo-floats of each trace decode to, summed up, and by how much they are off at worst."""
    return _off(traces.map_traces(_traces(spark, d).withColumn("kept", F.col("samples")), ["vec_id", "kept"], "samples", codecs.CODECS["16"], "decoded"), 7)


def _off(near: DataFrame, digits: int) -> DataFrame:
    total = F.aggregate("decoded", F.lit(0.0), lambda s, v: s + v)
    worst = F.array_max(F.zip_with("kept", "decoded", lambda a, b: F.abs(a - b)))
    return near.select("vec_id", (F.round(total, digits) + 0.0).alias("total"), (F.round(worst, 9) + 0.0).alias("worst"))


def _pairs_sql(bits: int) -> str:
    return f"""
    WITH p AS (SELECT vec_id, j // 2 AS k, max(x) FILTER (j % 2 = 0) AS a, coalesce(max(x) FILTER (j % 2 = 1), max(x) FILTER (j % 2 = 0)) AS b, count(*) AS n FROM {_SAMPLES} GROUP BY 1, 2),
    r AS (SELECT vec_id, 2 * max(abs((a + b) / 2)) AS r1, 2 * max(abs((a - b) / 2)) AS r2 FROM p GROUP BY vec_id),
    e AS (SELECT vec_id, r1, r2, b1, r1 / pow(2, b1) + r2 / pow(2, {bits} - b1) AS e FROM r, (SELECT unnest(range({bits + 1})) AS b1)),
    s AS (SELECT vec_id, any_value(r1) AS r1, any_value(r2) AS r2, CASE WHEN any_value(r1) > 0 AND any_value(r2) > 0 THEN min_by(b1, (e, b1)) WHEN any_value(r1) > 0 THEN {bits} ELSE {bits // 2} END AS b1 FROM e GROUP BY vec_id),
    q AS (SELECT *, pow(2, b1) - 1 AS s1, pow(2, {bits} - b1) - 1 AS s2 FROM s),
    d AS (SELECT p.vec_id, a, b, n, CASE WHEN s1 > 0 AND r1 > 0 THEN round_even(((a + b) / 2 + r1 / 2) * (s1 / r1), 0) * (r1 / s1) - r1 / 2 ELSE 0 END AS u, CASE WHEN s2 > 0 AND r2 > 0 THEN round_even(((a - b) / 2 + r2 / 2) * (s2 / r2), 0) * (r2 / s2) - r2 / 2 ELSE 0 END AS w FROM p JOIN q USING (vec_id))
    SELECT vec_id, round(sum(CASE WHEN n = 1 THEN u ELSE u + w + u - w END), 6) + 0.0 AS total, round(max(greatest(abs(CASE WHEN n = 1 THEN u ELSE u + w END - a), CASE WHEN n = 1 THEN 0 ELSE abs(u - w - b) END)), 9) + 0.0 AS worst FROM d GROUP BY vec_id
    """


@query(_pairs_sql(32))
def codec_pairs_16(spark: SparkSession, d: str) -> DataFrame:
    """Sum and difference pairs in 32 bits, dealt by their ranges."""
    return _off(traces.map_traces(_traces(spark, d).withColumn("kept", F.col("samples")), ["vec_id", "kept"], "samples", codecs.CODECS["16p"], "decoded"), 6)


@query(_pairs_sql(16))
def codec_pairs_8(spark: SparkSession, d: str) -> DataFrame:
    """Sum and difference pairs in 16 bits."""
    return _off(traces.map_traces(_traces(spark, d).withColumn("kept", F.col("samples")), ["vec_id", "kept"], "samples", codecs.CODECS["8p"], "decoded"), 6)


@query(_sample_sql("list_transform(embedding, lambda x: round(x::DOUBLE / list_max(list_transform(embedding, lambda y: abs(y::DOUBLE))), 5) + 0.0)"))
def normalise_array(spark: SparkSession, d: str) -> DataFrame:
    return _samples(_traces(spark, d).select("vec_id", traces.normalise(F.col("samples")).alias("samples")), 5)


@query(_sample_sql("list_reverse(list_transform(range(len(embedding)), lambda i: round(embedding[i + 1]::DOUBLE * 0.5 * least(1.0, (i + 1) / 9.0), 6) + 0.0))"))
def ramp_reverse(spark: SparkSession, d: str) -> DataFrame:
    return _samples(_traces(spark, d).select("vec_id", traces.ramp_reversed(F.col("samples"), 8, 0.5).alias("samples")), 6)


@query(_sample_sql("list_transform(list_concat(embedding[11:30], list_transform(range(4), lambda i: embedding[30])), lambda x: round(x::DOUBLE, 6) + 0.0)"))
def cut_and_pad(spark: SparkSession, d: str) -> DataFrame:
    return _samples(_traces(spark, d).select("vec_id", traces.pad(traces.cut(F.col("samples"), 10, 20), 24).alias("samples")), 6)


@query("SELECT vec_id, len(list_filter(embedding, lambda x: x > 0.2)) > 0 AS any, list_position(list_transform(embedding, lambda x: x > 0.2), true)::INT - 1 AS first, (len(embedding) - list_position(list_reverse(list_transform(embedding, lambda x: x > 0.2)), true))::INT AS last FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.2)) > 0")
def nonzero_span(spark: SparkSession, d: str) -> DataFrame:
    clipped = F.transform("samples", lambda x: F.when(x > F.lit(0.2).cast("float"), x).otherwise(0.0))
    span = traces.nonzero_span(clipped)
    return _traces(spark, d).select("vec_id", F.lit(True).alias("any"), span.alias("s")).filter("s IS NOT NULL").select("vec_id", "any", "s.first", "s.last")


@query("SELECT i, count(*) AS n, sum(round(embedding[i + 1]::DOUBLE * 1e6)::BIGINT)::BIGINT AS total FROM embeddings, (SELECT unnest(range(64)) AS i) GROUP BY i")
def transpose_sum(spark: SparkSession, d: str) -> DataFrame:
    rows = _traces(spark, d).select(F.posexplode("samples").alias("i", "x"))
    return rows.groupBy(big(F.col("i")).alias("i")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("x") * 1e6).cast("bigint")).alias("total"))


@query("""
    WITH c AS (SELECT l_returnflag, l_linestatus, l_partkey % 64 AS ix, l_suppkey % 32 AS iz, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3, 4),
    f AS (SELECT a, b, 1 / greatest(sqrt(pow(2 * pi() * (CASE WHEN a < 32 THEN a ELSE a - 64 END) / (64 * 12.5), 2) + pow(2 * pi() * (CASE WHEN b < 16 THEN b ELSE b - 32 END) / (32 * 10.0), 2)), 0.01) AS w FROM (SELECT unnest(range(64)) AS a), (SELECT unnest(range(32)) AS b)),
    g AS (SELECT dx, dz, sum(w * cos(2 * pi() * (a * dx / 64 + b * dz / 32))) / 2048 AS g FROM f, (SELECT unnest(range(64)) AS dx), (SELECT unnest(range(32)) AS dz) GROUP BY 1, 2),
    p AS (SELECT px, pz FROM (SELECT unnest(range(64)) AS px), (SELECT unnest(range(32)) AS pz))
    SELECT l_returnflag, l_linestatus, px AS ix, pz AS iz, round(sum(g * v), 5) + 0.0 AS value FROM c CROSS JOIN p JOIN g ON dx = (px - ix + 64) % 64 AND dz = (pz - iz + 32) % 32 GROUP BY 1, 2, 3, 4
""")
def image_wavenumber_filter(spark: SparkSession, d: str) -> DataFrame:
    """An image for each return flag and line status, by depth and part, through the reciprocal wavenumber filter."""
    cells = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus", (F.col("l_partkey") % 64).alias("ix"), (F.col("l_suppkey") % 32).alias("iz")).agg(F.sum("l_quantity").alias("value"))
    out = images.filter_images(cells, ["l_returnflag", "l_linestatus"], (64, 32), (12.5, 10.0), images.reciprocal(0.01))
    return out.withColumn("value", F.round("value", 5) + 0.0)


@query("SELECT l_partkey % 64 AS ix, l_suppkey % 16 AS iy, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS stack, count(*)::BIGINT AS fold FROM lineitem GROUP BY 1, 2")
def stream_stack(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "lineitem").schema
    source = spark.readStream.schema(schema).parquet(f"{d}/lineitem.parquet*")
    keys = [(F.col("l_partkey") % 64).alias("ix"), (F.col("l_suppkey") % 16).alias("iy")]
    return stack_stream(spark, source, keys, cents("l_extendedprice"), shared_folder(spark, "stream-stack"))
