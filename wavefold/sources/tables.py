"""Tables of the engine, and generators of regular lattices."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; filters and columns reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one the cluster shares. On a cluster that must be named: a folder of one machine would lose rows."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="wavefold-")  # driver and executor are one process
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/wavefold/{name}-{uuid.uuid4().hex}"


def store_shots(traces: DataFrame, path: str, shot: str, buckets: int) -> None:
    """Writes traces by bucket of their shot, a folder each, so that a shot is read without the others; one shuffle deals a bucket's rows over tasks by shot."""
    traces.withColumn("bucket", bucket_of(F.col(shot), buckets)).repartition("bucket", shot).write.partitionBy("bucket").parquet(path)


def bucket_of(shot: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(shot.cast("bigint")), F.lit(buckets)).cast("int")


def extract_shots(spark: SparkSession, path: str, shot: str, shots: list[int] | None = None, buckets: int = 64) -> DataFrame:
    """Stored traces, of some shots or of all; for some, only their buckets' folders are read and the shot reaches the scan."""
    stored = spark.read.parquet(path)
    if shots is None:
        return stored.drop("bucket")
    wanted = {r[0] for r in spark.createDataFrame([(s,) for s in shots], "s bigint").select(bucket_of(F.col("s"), buckets)).collect()}
    return stored.filter(F.col("bucket").isin(*wanted) & F.col(shot).isin(*shots)).drop("bucket")


#: Formats by the suffix of a path.
FORMATS = {".parquet": ("parquet", {}), ".dat": ("csv", {"sep": " ", "header": True}), ".csv": ("csv", {"header": True}), ".js": ("json", {}), ".json": ("json", {})}


def _format(path: str) -> tuple[str, dict]:
    for suffix, found in FORMATS.items():
        if path.endswith(suffix):
            return found
    raise ValueError(f"no format is known for {path}: one of {', '.join(FORMATS)}")


def save(df: DataFrame, path: str) -> None:
    """Writes a table in the format that the path's suffix names, part files in parallel."""
    kind, options = _format(path)
    df.write.format(kind).options(**options).save(path)


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Reads what save() wrote; the schema is given, so nothing is read to infer it."""
    kind, options = _format(path)
    return spark.read.format(kind).options(**options).schema(schema).load(path)


def lattice(header: DataFrame, x0: str, dx: str, nx: str, y0: str, dy: str, ny: str) -> DataFrame:
    """A row (ix, iy, x, y) for each place of the lattice that each row of header describes."""
    rows = header.withColumn("ix", F.explode(F.sequence(F.lit(0), F.col(nx) - 1))).withColumn("iy", F.explode(F.sequence(F.lit(0), F.col(ny) - 1)))
    return rows.withColumns({"x": F.col(x0) + F.col("ix") * F.col(dx), "y": F.col(y0) + F.col("iy") * F.col(dy)})
