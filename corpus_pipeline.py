"""The corpus pipeline: documents through five operators, each stage written and read again."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.llm.common import keep
from civicspark.llm.decontaminate import decontaminate
from civicspark.llm.line_dedup import line_dedup
from civicspark.llm.ngram_join import keep_one_per_component
from civicspark.llm.quality import CUT_SCORE, fit_quality, score_quality
from civicspark.llm.queries import held_out, language_mixture

#: Rows of a batch of texts that go to Python at once; an executor holds batches outside its heap.
BATCH_ROWS = 1_000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage`` with batches of BATCH_ROWS rows at most: a setting of the session that stays, as results are lazy."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rows = int(spark.conf.get(_BATCH_SETTING))
        if not 0 < rows <= BATCH_ROWS:
            spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run_stage


@_in_small_batches
def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(docs, labels.where(~held_out()))
    return score_quality(docs, model, score="__score").where(F.col("__score") >= CUT_SCORE).drop("__score")


@_in_small_batches
def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that five or more of them share, but for one keeper."""
    return line_dedup(docs).drop("n_lines", "n_dropped").withColumn("n_chars", F.length("text").cast("long"))


@_in_small_batches
def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    return keep_one_per_component(docs)


@_in_small_batches
def _benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its language posteriors and the rate at which to sample it."""
    return language_mixture(spark, docs, sf_dir).rated(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", _quality),
    ("line_dedup", _lines),
    ("near_duplicates", _near_duplicates),
    ("decontamination", _benchmark),
    ("mixing", _mixture),
]
#: SQL cannot express the learned stages; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's function on what the one before it kept, written and read between."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = keep(docs, f"stage-{name}")
    return docs
