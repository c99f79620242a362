"""The corpus operators over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decision_lists, decontamination, jaccard_join, pii, reply_trees, sharding, source_mixing, substring_dedup, token_counts, warc
from .common import read_table as table
from .oracles import ORACLES as ORACLES


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"), with_text=False)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source_mixing.measured(table(spark, sf_dir, "documents"))
    return source_mixing.mixed(rows).select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "kept")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digest(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    automaton = token_counts.Automaton.of_bytes(token_counts.read_vocabulary())
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), automaton)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_trees.formatted_digest(table(spark, sf_dir, "conversations"))


def op8_decision_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decision_lists.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded_digest(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_substring_dedup, op2_source_mixing, op3_decontamination, op4_pii, op5_token_counts, op6_warc, op7_reply_trees, op8_decision_lists, op9_sharding, op10_jaccard_join)}
