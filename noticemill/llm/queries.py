"""The queries opN_<name>: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate
from .bpe import bpe_round_trip
from .chat import chat_digests
from .chat import oracle_sql as chat_sql
from .common import table
from .embeddings import ORACLE_SQL as EMBEDDINGS_SQL
from .embeddings import near_vectors
from .importance import ORACLE_SQL as IMPORTANCE_SQL
from .importance import resampled
from .langid import identify_languages
from .pii import personal_data
from .lines import ORACLE_SQL as LINES_SQL
from .lines import dedup_lines
from .secrets import secret_findings
from .sentences import drop_repeated_spans
from .simhash import simhash_groups
from .spelling import ORACLE_SQL as SPELLING_SQL
from .spelling import spelling_variants
from .suffixes import drop_repeats


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans, and those of further kinds that the trees accept."""
    return personal_data(table(spark, sf_dir, "documents"))


def op2_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentences that repeated spans cover."""
    return drop_repeated_spans(table(spark, sf_dir, "documents")).drop("kept")


def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, through a ledger that begins empty."""
    return secret_findings(table(spark, sf_dir, "documents"))


def op4_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that repeat from a smaller doc_id."""
    return drop_repeats(table(spark, sf_dir, "documents"))


def op5_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without later copies of line runs."""
    return dedup_lines(table(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links and component."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    return identify_languages(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that windows of benchmark items cover."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and group of near copies."""
    return simhash_groups(table(spark, sf_dir, "documents"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return bpe_round_trip(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, five in a hundred of those with 20 words or more drawn towards the benchmark's word runs."""
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of the documents with the word it is a variant of."""
    return spelling_variants(table(spark, sf_dir, "documents"))


#: A conversation that says control strings.
CONTROL_TURNS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that says control strings, formatted and read back."""
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat_digests(own.union(spark.createDataFrame(CONTROL_TURNS, own.schema)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_sentence_spans": op2_sentence_spans,
    "op3_secret_ledger": op3_secret_ledger,
    "op4_suffix_repeats": op4_suffix_repeats,
    "op5_line_runs": op5_line_runs,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_language_id": op7_language_id,
    "op8_decontaminate": op8_decontaminate,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_bpe_round_trip": op10_bpe_round_trip,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_chat_format": op13_chat_format,
}
ORACLE_SQL: dict[str, str] = {"op5_line_runs": LINES_SQL, "op6_embedding_near_dedup": EMBEDDINGS_SQL, "op8_decontaminate": decontaminate.ORACLE_SQL, "op11_importance_resampling": IMPORTANCE_SQL, "op12_spelling_variants": SPELLING_SQL, "op13_chat_format": chat_sql(CONTROL_TURNS)}
