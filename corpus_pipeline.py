"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark decontamination, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from noticemill.llm.bpe import bpe_round_trip
from noticemill.llm.common import Scratch, table
from noticemill.llm.decontaminate import drop_contaminated
from noticemill.llm.langid import keep_identified
from noticemill.llm.lines import without_repeated_lines
from noticemill.llm.simhash import drop_near_copies
from noticemill.stored import clearing


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be identified go, so those with a null text or without letters, too."""
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs are deleted from the texts; documents that were nothing else go.

    Null and empty texts and rows without doc_id stay as they are; repeated rows lose the same lines.
    """
    return without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id.

    Null, empty and blank texts are one group. A row without doc_id stays only where none of its group has one; of
    repeated rows one stays.
    """
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts stay, as do all for an empty benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of what is left, a row for each row; a null text counts as empty."""
    return bpe_round_trip(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("bpe", encode),
]

#: SQL can't express a trained model, XXH64 fingerprints or byte-pair merges; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored in the shared folder and read again; a stage's input is deleted after it.

    Empty tables give an empty result.
    """
    scratch, docs, kept = Scratch(spark), table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with clearing():  # what a stage has stored for itself
            docs = scratch.keep(stage(spark, docs, sf_dir))
        if kept is not None:
            scratch.drop(kept)
        kept = docs
    return docs
