"""A corpus made ready for training: five stages, each an operator applied to all that the one before kept.

Every stage's rows are written as Parquet in the shared folder and read again
as the next one's documents, so a lost executor costs at most a stage's tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spinweave.llm import common, decontam, linededup, neardup, packing, quality

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    common.small_batches(spark)
    return quality.sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines of at least 40 characters that 5 documents share, but in the largest id; n_chars follows the text."""
    out = linededup.dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    common.small_batches(spark)
    return neardup.dedup(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    common.small_batches(spark)
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences."""
    common.small_batches(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that remain. A stage's table goes once the next one is written; the last one stays."""
    df, last = common.read_docs(spark, sf_dir), None
    for k, (_, stage) in enumerate(STAGES):
        path = common.shared_path(spark, f"pipeline-{k}")
        stage(spark, df, sf_dir).write.parquet(path)
        df = spark.read.parquet(path)
        if last is not None:
            common.removed(spark, last)
        last = path
    return df
