"""A corpus pipeline: quality rules, near-duplicate removal, decontamination, mixing, sharding.

Each stage works on all rows that the one before it kept, and its result is written before the next one
begins; a stage that begins removes the tables that the stages before it stored for their own work.

Defined cases. Null and empty texts fail the base quality rules and go; rows with null ids are judged as
others and are never near duplicates; an id that repeats stands for rows of their own. Columns of any
name pass through, but for shard and slot, which the last stage adds. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sumline.llm.common import new_path, read_table, recorded, remove_path
from sumline.llm.decision_lists import keep_good
from sumline.llm.decontamination import decontaminate
from sumline.llm.jaccard_join import keep_one_of_each
from sumline.llm.sharding import hypergeometric_shuffle
from sumline.llm.source_mixing import sample_mix

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: What the stages so far have stored, by stage.
_stored: dict[str, list[str]] = {}


def stage(f: Stage) -> Stage:
    """f, which first removes what other stages stored, as all that they fed is written by then."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name in [n for n in _stored if n != f.__name__]:
            for path in _stored.pop(name):
                remove_path(spark, path)
        with recorded(_stored.setdefault(f.__name__, [])):
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs, k=5, percent=80)


@stage
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sample_mix(docs)


@stage
def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return hypergeometric_shuffle(docs, [docs.doc_id, docs.text])


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", benchmark), ("mixing", mixing), ("sharding", sharding)]

#: Learned rules and random draws have no SQL; tests/llm/test_pipeline.py holds the stages against their operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read_table(spark, sf_dir, "documents"), None
    for name, work in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        work(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        if last:
            remove_path(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
