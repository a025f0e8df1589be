"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, tokens.

Every stage works on all that its predecessor kept.  ``run`` applies them to ``documents``.

Edge cases, for every stage: stages return the columns of documents, so extra columns, whatever
their names, end with the first; null and empty texts fail the base rules and go with the first
stage, and a stage that is given some keeps them through line dedup and near-dedup (they have no
line and no shingle) and leaves them out of the mix (size 0); rows without id pass line dedup and
near-dedup and are mixed by their text; rows that repeat an id are judged each, one of them is kept
by near-dedup, and rows alike are repeated alike by the mix; ties go as the operators say; very
long texts are handled whole by every stage; empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigla.llm import bpe, linededup, minhash, mixing, quality
from sigla.llm.common import WORD_CLASS, table, write_shared
from sigla.llm.queries import RANKS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the likelihood ratio go."""
    return quality.rated(docs, table(spark, sf_dir, "labels")).where("kept").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; a document of nothing else stays as it is."""
    clean = linededup.without_boilerplate(docs, host="source")
    left = F.col("clean_text").rlike(WORD_CLASS)
    clean = clean.withColumn("text", F.when(left, F.col("clean_text")).otherwise(F.col("text")))
    changed = F.when(left & (F.col("n_dropped") > 0), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", changed).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return minhash.deduplicated(docs).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; one taken in part, the last of a source, stays whole."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels")).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes decoded from them."""
    return bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("mixing", mix_sources),
    ("byte BPE", tokens),
]

#: SQL can express neither the hash features of the first stage nor the last; tests hold the
#: pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
