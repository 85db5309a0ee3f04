"""A training corpus from the documents table: classifier, rules, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. run() writes each stage's result as Parquet into the shared folder and reads it for the next.

A stage bounds the bytes that go to a Python worker at once, as a setting of the session, where it stays: the
frames that stages return run later. Results don't depend on it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavefold.llm import line_dedup, order_minhash, packing, quality_classifier, quality_rules
from wavefold.llm.common import materialise, table

#: Most bytes of rows handed to a Python worker at once, up to the row that reaches it. Spark's own bound is 64 MB, which the executor holds outside its heap and its workers again.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _in_small_batches(stage: Stage) -> Stage:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


def _alone(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns and all columns in one, so that columns of any names pass through an operator as they are."""
    return docs.select(F.struct("*").alias("__doc"), *names)


@_in_small_batches
def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the ordinal classifier, fitted on the labelled ones among docs, takes for good. Each row is judged by its own text; without labelled documents all stay."""
    labels = table(spark, sf_dir, "labels")
    model = quality_classifier.train(docs, labels, "doc_id", "text", quality_classifier.grade(F.col("quality"), F.col("toxic")))
    return quality_classifier.score(_alone(docs, "text"), "text", model).filter("kept").select("__doc.*")


@_in_small_batches
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the base rule and are close to a language. Verdicts come back by a digest of id, language and text, as ids may be null or repeated; rows alike in these have one verdict."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "lang", "text")]
    keyed = docs.withColumn("__row", F.sha2(F.concat_ws("\0", *said), 256))
    passed = quality_rules.judge(keyed, "__row", "text", "lang").filter("kept").select("__row")
    return keyed.join(passed, "__row", "left_semi").select(docs.columns)


@_in_small_batches
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; n_chars follows the text, a null text is an empty one. No document goes."""
    out = line_dedup.dedup_lines(_alone(docs, "doc_id", "text"), "doc_id", "text")
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)}
    return out.select(*(new.get(c, F.col("__doc").getField(c)).alias(c) for c in docs.columns))


@_in_small_batches
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, and all without an id, which are compared with nothing. Rows that share an id are one document; of those that share the text too one stays."""
    named = docs.filter(F.col("doc_id").isNotNull()).withColumn("__text", F.xxhash64("text"))
    kept = order_minhash.near_duplicates(named, "doc_id", "text").filter("kept").select("doc_id").distinct()
    return named.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "__text"]).select(docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))


@_in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: a row a piece, with its token ids and its place."""
    return packing.pack(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", classify),
    ("quality rules", rules),
    ("line dedup", lines),
    ("near-dedup", near),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
