"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sortilege.llm import bpe, exactdup, mixing, neardup, quality
from sortilege.llm.queries import vocabulary
from sortilege.llm.scratch import Scratch


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts, with all their columns.

    Null and empty texts are judged as empty ones, texts of any length whole; rows that repeat an id or a text are judged each by its
    text, and a score of just the threshold stays. Without a usable label all stay; an empty table gives none; extra columns pass through.
    """
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def no_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text (white space made even), that of the smallest doc_id; null counts as empty.

    A null id stays only where its whole group has none. Of rows that repeat both the id and the text that stay, one stays.
    Texts of any length are compared whole; an empty table gives none; extra columns pass through, whatever their names.
    """
    return exactdup.without_copies(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, a Jaccard similarity of 0.8 or more, just 0.8 too.

    Null, empty and blank texts, and null ids, are near to nothing and stay; rows that repeat the id that stays all stay.
    Texts of any length count whole; an empty table gives none; extra columns pass through.
    """
    return neardup.one_of_each(docs, size=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, as often as it takes them, near the sources' target weights.

    Null texts have no size and stay once; a null source is a source of its own, weighed last; equal rows are dealt by a hash, the
    same on every run. An empty table gives none; extra columns pass through, whatever their names.
    """
    return mixing.mixed_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, repeated rows too.

    Null and empty texts have no ids and decode to nothing; texts of any length are encoded whole; other columns are left out;
    an empty table gives none.
    """
    return bpe.encode(docs, vocabulary(), scanned=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("quality", good_quality), ("exact_dedup", no_exact_copies), ("near_dedup", no_near_copies), ("mixing", mixed), ("bpe", encoded)]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
