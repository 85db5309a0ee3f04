"""Incremental stacking: partial images arrive as files, each micro-batch leaves its partial sums, readers add them up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stack_stream(spark: SparkSession, source: DataFrame, keys: list[Column], value: Column, folder: str) -> DataFrame:
    """Consumes what a streaming source has now and returns the stack of all batches so far (keys, stack, fold). A batch that is run again overwrites its own sums, so every row counts once."""

    def store(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.sum(value).alias("stack"), F.count(F.lit(1)).alias("fold")).write.mode("overwrite").parquet(f"{folder}/sums/batch={number}")

    running = source.writeStream.foreachBatch(store).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    running.awaitTermination()  # however long it takes: availableNow ends by itself, and a failed batch raises
    names = [c for c in spark.read.parquet(f"{folder}/sums").columns if c not in ("stack", "fold", "batch")]
    return spark.read.parquet(f"{folder}/sums").groupBy(*names).agg(F.sum("stack").alias("stack"), F.sum("fold").alias("fold"))
