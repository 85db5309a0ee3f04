"""Small helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares. On a cluster it must be named: a folder of one machine would lose rows."""
    named = spark.conf.get(SHARED, None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{SHARED} must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="wavefold-")  # driver and executor are one process
        spark.conf.set(SHARED, named)
    return named.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wavefold/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Parts into which the rows of a key that may be busy are dealt.
SALTS = 32


def salt(*names: str, parts: int = SALTS) -> Column:
    """Deals rows of one key by other columns, so that none of the parts has more than its share."""
    return F.pmod(F.xxhash64(*names), F.lit(parts)).cast("int")


def salts(name: str = "salt") -> Column:
    """Which salts a group's rows have, as bits: summed up before a shuffle, as counts are."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(name))).alias("salts")


def each_salt(name: str = "salt") -> Column:
    """A row for each of the salts."""
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.getbit("salts", k) == 1)).alias(name)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def own_id(*results: str) -> Callable:
    """For operators (df, id column, ...) with such columns of their own: an id column that bears one of these names comes back as <name>_id."""

    def around(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(operator)
        def run(df: DataFrame, id_col: str, *rest, **named) -> DataFrame:
            own = id_col
            while own in results or (own != id_col and own in df.columns):
                own += "_id"
            return operator(df if own == id_col else df.withColumnRenamed(id_col, own), own, *rest, **named)

        return run

    return around
