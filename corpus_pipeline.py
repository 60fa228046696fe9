"""From raw documents to token files: each stage works on what its predecessor has kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tarnfield.llm import mixing, simhash, tokenbin, toxicity, winnow
from tarnfield.llm.common import give_back, scratch, table
from tarnfield.llm.queries import tokenizer

#: A document goes if its toxicity score reaches this.
TOXIC_AT = 0.5
#: A document goes if it shares windows with so many items of the benchmark.
LEAKED_ITEMS = 1


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(f: Stage) -> Stage:
    """f, begun without what the stages before it have left in the driver's memory and in the executors' JVMs."""
    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back(spark)
        return f(spark, docs, sf_dir)

    return run


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"), TOXIC_AT)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return winnow.without_contaminated(docs, table(spark, sf_dir, "benchmark"), LEAKED_ITEMS)


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


@stage
def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokenbin.documents_of(docs, tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("tokens", write_tokens),
]

#: SQL can't express the stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, run_stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        run_stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
