"""Gathers by slowness: slant stacks, their least-squares inverse, deghosting, and traces at other places.

A gather is a table of samples (keys, place, time index, value). Its slant stack adds up, for each slowness p, what lies along the lines
t = tau + p x, samples between times shared linearly among the two nearest; model() is the exact adjoint, laying events of given p and
tau along their lines. Both spread rows to keys and add up; neither compares rows by a band. The least-squares inverse takes a fixed number of
conjugate-gradient rounds, each a model() and a slant_stack(), with its state written to the shared folder after each, so
that lineage stays short and a lost executor costs one round. A gather of many traces is dealt by salts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavefold.sources.tables import shared_folder

SALTS = 16


def _shared(u: Column, samples: int, name: str) -> Column:
    """The two samples around a time, with their weights, as rows."""
    low = F.floor(u)
    pair = F.array(F.struct(low.cast("bigint").alias(name), (1 - (u - low)).alias("__w")), F.struct((low + 1).cast("bigint").alias(name), (u - low).alias("__w")))
    return F.explode(F.filter(pair, lambda s: (s["__w"] > 0) & s[name].between(0, samples - 1)))


def _slowness(slowness: list[float]) -> Column:
    return F.array(*(F.struct(F.lit(i).cast("bigint").alias("ip"), F.lit(float(p)).alias("p")) for i, p in enumerate(slowness)))


def slant_stack(rows: DataFrame, keys: list[str], x: str, time: str, value: str, slowness: list[float], dt: float, samples: int) -> DataFrame:
    """(keys, ip, itau, value): the sum over traces along each line, ip numbering the slownesses; times outside the trace are left out."""
    each = rows.select(*keys, F.col(x).cast("double").alias("__x"), F.col(time).alias("__t"), F.col(value).cast("double").alias("__v"), F.explode(_slowness(slowness)).alias("__s"))
    spread = each.select(*keys, "__s.ip", "__v", _shared(F.col("__t") - F.col("__s.p") * F.col("__x") / dt, samples, "itau").alias("__c"))
    return spread.groupBy(*keys, "ip", F.col("__c.itau").alias("itau")).agg(F.sum(F.col("__c.__w") * F.col("__v")).alias(value))


def model(events: DataFrame, keys: list[str], value: str, places: DataFrame, x: str, time: str, slowness: list[float], dt: float, samples: int) -> DataFrame:
    """(keys, x, time, value): events (keys, ip, itau, value) laid along their lines at the places (keys, x) of each gather."""
    dealt = events.select(*keys, "ip", "itau", F.col(value).alias("__v"), F.pmod(F.xxhash64("ip", "itau"), F.lit(SALTS)).cast("int").alias("__salt"))
    at = places.select(*keys, F.col(x).cast("double").alias(x)).distinct().withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    p = F.get(F.array(*(F.lit(float(s)) for s in slowness)), F.col("ip").cast("int"))
    laid = dealt.join(at, [*keys, "__salt"]).select(*keys, x, "__v", _shared(F.col("itau") + p * F.col(x) / dt, samples, time).alias("__c"))
    return laid.groupBy(*keys, x, F.col(f"__c.{time}").alias(time)).agg(F.sum(F.col("__c.__w") * F.col("__v")).alias(value))


def _stored(df: DataFrame) -> DataFrame:
    path = shared_folder(df.sparkSession, "gathers")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def least_squares(rows: DataFrame, keys: list[str], x: str, time: str, value: str, slowness: list[float], dt: float, samples: int, rounds: int = 8, damping: float = 1e-3) -> DataFrame:
    """(keys, ip, itau, value): the events whose model() comes closest to each gather, by conjugate gradients on the normal equations; damping is against the squared events. Each gather is solved by itself, all at once."""
    cells = [*keys, "ip", "itau"]
    rows = _stored(rows.groupBy(*keys, x, time).agg(F.sum(value).alias(value)))
    places = rows.select(*keys, x).distinct()
    zero = F.lit(0.0)
    first = slant_stack(rows, keys, x, time, value, slowness, dt, samples)
    state = _stored(first.select(*cells, zero.alias("m"), F.col(value).alias("s"), F.col(value).alias("p")))
    square = lambda c: F.sum(F.col(c) * F.col(c))
    for _ in range(rounds):
        q = _stored(model(state, keys, "p", places, x, time, slowness, dt, samples))
        sizes = state.groupBy(*keys).agg(square("s").alias("ss"), square("p").alias("pp")).join(q.groupBy(*keys).agg(square("p").alias("qq")), keys, "left")
        step = sizes.select(*keys, "ss", F.when(F.coalesce("qq", zero) + damping * F.col("pp") > 0, F.col("ss") / (F.coalesce("qq", zero) + damping * F.col("pp"))).otherwise(0.0).alias("alpha"))
        back = slant_stack(q, keys, x, time, "p", slowness, dt, samples)
        names = ["m", "s", "p", "a"]
        both = state.select(*cells, "m", "s", "p", zero.alias("a")).unionByName(back.select(*cells, zero.alias("m"), zero.alias("s"), zero.alias("p"), F.col("p").alias("a")))
        met = both.groupBy(*cells).agg(*(F.sum(c).alias(c) for c in names)).join(step, keys)
        moved = _stored(met.select(*cells, (F.col("m") + F.col("alpha") * F.col("p")).alias("m"), (F.col("s") - F.col("alpha") * (F.col("a") + damping * F.col("p"))).alias("s"), "p", "ss"))
        turn = moved.groupBy(*keys).agg((square("s") / F.max("ss")).alias("beta"))
        state = _stored(moved.join(turn, keys).select(*cells, "m", "s", (F.col("s") + F.coalesce("beta", zero) * F.col("p")).alias("p")))
    return state.select(*cells, F.col("m").alias(value))


def deghost(events: DataFrame, keys: list[str], value: str, slowness: list[float], dt: float, samples: int, depth: float, velocity: float, reflection: float = -1.0, water: float = 0.05) -> DataFrame:
    """Events less the ghost that the surface above receivers at a depth adds: each slowness' trace is divided by 1 + r exp(-i w delay), the delay being twice the vertical time to the surface; water is the least
    squared magnitude divided by. Slownesses beyond 1 / velocity don't propagate up and stay as they are."""
    vertical = np.sqrt(np.maximum(0.0, 1 / velocity**2 - np.array(slowness) ** 2))
    delays = 2 * depth * vertical
    table = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: F.coalesce(F.try_element_at("__m", k.cast("bigint")), F.lit(0.0)))
    lines = events.groupBy(*keys, "ip").agg(F.map_from_entries(F.collect_list(F.struct("itau", value))).alias("__m")).select(*keys, "ip", table.alias("samples"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 2 * samples  # so that what is shifted doesn't come round
        w = 2 * np.pi * np.fft.rfftfreq(n, dt)
        for batch in batches:
            if not batch.num_rows:
                continue
            data = batch.column(len(keys) + 1).flatten().to_numpy().reshape(-1, samples)
            delay = delays[batch.column(len(keys)).to_numpy()]
            ghost = 1 + reflection * np.exp(-1j * w[None, :] * delay[:, None])
            inverse = np.where(delay[:, None] > 0, np.conj(ghost) / np.maximum(np.abs(ghost) ** 2, water), 1.0)
            out = np.fft.irfft(np.fft.rfft(data, n, axis=1) * inverse, n, axis=1)[:, :samples]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(list(out), pa.list_(pa.float64()))], [*keys, "ip", "samples"])

    kinds = "".join(f"`{c}` {events.schema[c].dataType.simpleString()}, " for c in keys)
    found = lines.mapInArrow(run, f"{kinds}ip bigint, samples array<double>")
    return found.select(*keys, "ip", F.posexplode("samples").alias("itau", value)).withColumn("itau", F.col("itau").cast("bigint"))
