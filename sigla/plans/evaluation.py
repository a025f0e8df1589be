"""From stages and gold to scores: which texts belong together, then one pass of alignment."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lexicon, score
from ..operators.vita import KEY
from ..sources import tables

JUDGED = "gold string, resolution string, verdict string, index string"


def together(source: DataFrame, gold: DataFrame, stages: list[DataFrame]) -> DataFrame:
    """volume, entry, source, gold, stages of entries (volume, entry, text) that all tables have."""
    out = source.select(*KEY, F.col("text").alias("source")).join(gold.select(*KEY, F.col("text").alias("gold")), KEY)
    for k, stage in enumerate(stages, 1):
        out = out.join(stage.select(*KEY, F.col("text").alias(f"stage_{k}")), KEY)
    return out.select(*KEY, "source", "gold", F.array(*[f"stage_{k}" for k in range(1, len(stages) + 1)]).alias("stages"))


def missing(gold: DataFrame, stages: list[DataFrame]) -> DataFrame:
    """Keys of gold entries that some stage lacks, with the first such stage."""
    out = None
    for k, stage in enumerate(stages, 1):
        own = gold.select(*KEY).join(stage.select(*KEY).distinct(), KEY, "left_anti").withColumn("stage", F.lit(k))
        out = own if out is None else out.unionByName(own)
    return out.groupBy(*KEY).agg(F.min("stage").alias("stage"))


def anchors_of(glossary: DataFrame) -> dict[str, set[str]]:
    """What resolutions may start with, by abbreviation: a dictionary's worth, so it is collected."""
    found: dict[str, set[str]] = defaultdict(set)
    for r in lexicon.anchor_index(glossary).collect():
        found[r.abbr].add(r.key)
    return dict(found)


def evaluated(source: DataFrame, gold: DataFrame, stages: list[DataFrame], glossary: DataFrame, dioceses: DataFrame | None = None, gold_errors: DataFrame | None = None) -> DataFrame:
    """The long table with verdicts and steps.

    ``glossary``: abbr, resolution, stem, declension; dioceses add their adjectives' lemmas.
    """
    entries = glossary.select("resolution", "stem", "declension")
    if dioceses is not None:
        entries = entries.unionByName(lexicon.diocese_entries(dioceses))
    rows = score.aligned_occurrences(together(source, gold, stages), anchors_of(glossary))
    if gold_errors is not None:
        rows = score.without_gold_errors(rows, gold_errors)
    return score.with_steps(score.with_verdicts(rows, lexicon.lemma_index(entries)))


def digest_of(index: DataFrame) -> str:
    """Which lemma index it is: verdicts by another one are not its own."""
    rows = index.select("key", "lemma").distinct()
    got = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64("key", "lemma").cast("decimal(38,0)")).alias("s")).first()
    return f"{got.n}:{got.s}"


def judged_once(rows: DataFrame, index: DataFrame, path: str) -> DataFrame:
    """gold, resolution, verdict of all pairs of ``rows`` that the index decides, kept in ``path``.

    A run judges what no earlier run with the same index has; another index begins anew beside it.
    A run that is lost while it writes leaves nothing, and two at once repeat rows, not verdicts.
    """
    spark, of = rows.sparkSession, digest_of(index)

    def kept() -> DataFrame:
        own = spark.read.schema(JUDGED).parquet(path) if tables._exists(spark, path) else spark.createDataFrame([], JUDGED)
        return own.where(F.col("index") == of).select("gold", "resolution", "verdict").distinct()

    asked = score.undecided(rows)
    new = asked.join(kept(), ["gold", "resolution"], "left_anti")
    if not new.isEmpty():
        score.judged(new, index).withColumn("index", F.lit(of)).write.mode("append").parquet(path)
    return kept().join(asked, ["gold", "resolution"], "left_semi")


def counted(source: DataFrame, gold: DataFrame, stages: list[DataFrame], glossary: DataFrame, dioceses: DataFrame | None = None, kept: str | None = None) -> DataFrame:
    """As :func:`evaluated`, by facts: all that reports count, without a row for an occurrence.

    ``kept``: a folder for verdicts that later runs read again; the facts stay persisted then, as
    they are read for what has to be judged and for what is counted.
    """
    entries = glossary.select("resolution", "stem", "declension")
    if dioceses is not None:
        entries = entries.unionByName(lexicon.diocese_entries(dioceses))
    rows, index = score.occurrences(together(source, gold, stages), anchors_of(glossary)), lexicon.lemma_index(entries)
    known = None
    if kept is not None:
        rows = rows.groupBy(*score.FACT).agg(F.count("*").alias("n")).persist()
        known = judged_once(score.each_stage(rows), index, kept)
    return score.scored_facts(rows, index, known)
