"""Queries over the standard tables, one for each operator, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bpe, funnels, licenses, linededup, minhash, mixing, pii, quality, speculative, tokencounts, warc, whitening
from .common import table

#: The query's parameter; a cluster has this file installed with the tokenizers on each machine.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
FUNNELS = [
    funnels.Funnel("A", ("view", "click", "view", "purchase"), ("error",)),
    funnels.Funnel("B", ("signup", "view", "click", "purchase"), ("error",)),
    funnels.Funnel("C", ("click", "click", "purchase", "view"), ("signup",)),
]
TOKENIZERS = {
    "byte-bpe-multi-50k": (RANKS, public_tokenizers.PATTERN),
    "byte-bpe-50k": (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
}


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.described(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licensed(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.maintained(spark, sf_dir, TOKENIZERS)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.rated(docs, table(spark, sf_dir, "labels")).drop("text")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(linededup.without_boilerplate(table(spark, sf_dir, "documents"), host="source"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# The columns of three of them that SQL can express, from the same operators.


def audio_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_telephony_audio(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_quality_rules(spark, sf_dir).drop("score", "kept")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def op11_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speculative.round_trip(table(spark, sf_dir, "documents"), TOKENIZER, public_tokenizers.PATTERN)


def op12_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnels.counted(table(spark, sf_dir, "clicks"), FUNNELS)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whitened(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_telephony_audio": op2_telephony_audio,
    "op3_license_scan": op3_license_scan,
    "op4_token_counts": op4_token_counts,
    "op5_warc": op5_warc,
    "op6_quality_rules": op6_quality_rules,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_pii": op8_pii,
    "op9_line_dedup": op9_line_dedup,
    "op10_mixing": op10_mixing,
    "op11_speculative_bpe": op11_speculative_bpe,
    "op12_funnels": op12_funnels,
    "op13_whitening": op13_whitening,
    "audio_payloads": audio_payloads,
    "quality_base": quality_base,
    "pii_base": pii_base,
}
ORACLES: dict[str, str] = {
    "op5_warc": warc.SQL,
    "op9_line_dedup": linededup.SQL,
    "op10_mixing": mixing.SQL,
    "op12_funnels": funnels.sql(FUNNELS),
    "audio_payloads": audio.PAYLOAD_SQL,
    "quality_base": quality.BASE_SQL,
    "pii_base": pii.BASE_SQL,
}
