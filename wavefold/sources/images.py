"""Images that grow: partial images added to a stored one, each batch once.

A batch's sums are a folder of their own below the image's, dealt to folders of lines. A batch that runs again
replaces what it wrote, so it counts once. fold() adds batches up into one table of lines; it is in force when its list of batches is
written, the last thing it does, and a batch that it holds is not counted again if it comes once more.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines to a folder.
LINES = 64


def aligned(rows: DataFrame, grids: dict[str, tuple[tuple[int, int], tuple[int, int, int]]]) -> DataFrame:
    """Rows of a partial image by the line numbers of the stored one. grids: for each index column (first line, step) of the partial image and (first line, step, count) of the stored one. Lines that don't fall on
    the stored image's are an error, lines beyond its ends are left out."""
    for name, ((first, step), (onto, every, count)) in grids.items():
        if step % every or (first - onto) % every:
            raise ValueError(f"{name}: lines from {first} by {step} don't fall on lines from {onto} by {every}")
        place = F.col(name) * (step // every) + (first - onto) // every
        rows = rows.withColumn(name, place.cast("bigint")).filter(F.col(name).between(0, count - 1))
    return rows


def accumulate(path: str, rows: DataFrame, keys: list[str], line: str, value: str, batch: int) -> None:
    """Adds rows to the image at path, as batch so-and-so."""
    sums = rows.groupBy(*keys).agg(F.sum(value).alias(value)).withColumn("lines", F.floor(F.col(line) / LINES))
    sums.write.mode("overwrite").partitionBy("lines").parquet(f"{path}/batches/batch={int(batch)}")


def _folded(spark: SparkSession, path: str) -> tuple[str | None, list[int]]:
    """The folder of the last fold(), and the batches it holds."""
    try:
        last = spark.read.schema("folder string, batches array<bigint>, nth bigint").parquet(f"{path}/folded").orderBy(F.desc("nth")).first()
    except AnalysisException:
        return None, []
    return (last["folder"], list(last["batches"])) if last else (None, [])


def _parts(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, list[int]]:
    folder, held = _folded(spark, path)
    kinds = f"{schema}, lines bigint"
    try:
        fresh = spark.read.schema(f"{kinds}, batch bigint").option("basePath", f"{path}/batches").parquet(f"{path}/batches")
    except AnalysisException:
        fresh = spark.createDataFrame([], f"{kinds}, batch bigint")
    out = fresh.filter(~F.col("batch").isin(held)) if held else fresh
    batches = sorted({r[0] for r in out.select("batch").distinct().collect()})  # as many as there are batches not folded yet
    out = out.drop("batch")
    return (out.unionByName(spark.read.schema(kinds).parquet(folder)) if folder else out), [*held, *batches]


def image(spark: SparkSession, path: str, schema: str, keys: list[str], value: str) -> DataFrame:
    """The stored image: what fold() has, and the batches since; a filter on lines reads their folders only."""
    return _parts(spark, path, schema)[0].groupBy("lines", *keys).agg(F.sum(value).alias(value))


def fold(spark: SparkSession, path: str, schema: str, keys: list[str], value: str) -> None:
    """Adds up all batches so far into one table, in force as soon as its list of batches is written."""
    parts, batches = _parts(spark, path, schema)
    folder = f"{path}/images/{uuid.uuid4().hex}"
    parts.groupBy("lines", *keys).agg(F.sum(value).alias(value)).write.partitionBy("lines").parquet(folder)
    spark.createDataFrame([(folder, batches, len(batches))], "folder string, batches array<bigint>, nth bigint").write.mode("append").parquet(f"{path}/folded")
