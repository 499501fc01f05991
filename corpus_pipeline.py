"""A corpus pipeline of the operators in fieldsieve.llm, each stage written as Parquet and read again.

Defined results, stage by stage (the operators' docstrings have the details)
- null and empty texts fail the base rules of the first stage, so no later stage sees one of them
  from the input; a text that the third stage empties is packed as its end id alone.
- null doc_id: judged like any other row, kept by near dedup unless a copy has an id, left as it is
  by substring dedup, compared with the benchmark, packed.
- repeated rows: near dedup keeps one. Ties: the least doc_id stays.
- very long texts go through whole. An empty table gives no rows. Further columns, whatever their
  names, are kept as they are up to the last stage, which has columns of its own.
A stage owns the tables that it writes on its way. Its result must be written before the next stage is
called in the same thread, which deletes them; tables behind other results are not touched.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from fieldsieve.llm import decontamination, near_dedup, packing, quality_rules, substring_dedup
from fieldsieve.llm.common import drop, owned, scratch_path
from fieldsieve.llm.tokens import vocabulary


#: What the last stage of this thread has left.
_LEFT: ContextVar[list[str]] = ContextVar("left", default=[])  # noqa: B039  never changed in place


def stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that deletes the tables of the stage before it."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(spark, _LEFT.get())
        with owned() as paths:
            out = function(spark, docs, sf_dir)
        _LEFT.set(paths)
        return out

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality_rules.filter_quality(docs)


@stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dedup.deduplicated(docs)


@stage
def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat are cut from all documents but the first that has them."""
    return substring_dedup.without_repeats(docs)


@stage
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item or more go."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 2048 tokens; one row for each piece, with its ids."""
    return packing.packed(docs, vocabulary("word_bpe_49k.json"), False, with_ids=True)


STAGES = [("quality_rules", quality), ("near_dedup", near), ("substring_dedup", substrings), ("decontamination", benchmark), ("packing", sequences)]

#: Whole-text statistics with robust estimates and greedy packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    drop(spark, _LEFT.get())
    _LEFT.set([])
    return docs
