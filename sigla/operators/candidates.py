"""Candidates of every entry at once, where they stand, and what is put in their place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import edits, matching, text
from . import rules, scan

KEY = ["volume", "entry"]


def listed_for_volumes(glossary: DataFrame) -> DataFrame:
    """volume (null: any), abbr, resolution of what may be offered.

    Complex entries are offered in every volume, simple ones where their volume has several.
    """
    simple = rules.by_volume(glossary.where(~F.col("complex")).withColumn("parts", text.parts_of(F.col("abbr"))))
    several = simple.withColumn("n", F.count("*").over(Window.partitionBy("volume", "abbr"))).where("n > 1")
    odd = glossary.where("complex").select(F.lit(None).cast("long").alias("volume"), "abbr", "resolution")
    return several.select("volume", "abbr", "resolution").unionByName(odd)


def of_entries(texts: DataFrame, glossary: DataFrame) -> DataFrame:
    """volume, entry, abbr, candidates (sorted): for all entries (volume, entry, text) together."""
    found = scan.distinct_abbreviations(texts, "text", keys=tuple(KEY)).withColumnRenamed("abbreviation", "abbr")
    offers = listed_for_volumes(glossary).select(F.col("volume").alias("of"), "abbr", "resolution")
    joined = found.join(offers, "abbr").where(F.col("of").isNull() | (F.col("of") == F.col("volume")))
    return joined.groupBy(*KEY, "abbr").agg(F.array_sort(F.collect_set("resolution")).alias("candidates"))


def clashes(glossary: DataFrame) -> DataFrame:
    """Abbreviations that are simple and complex at once, which a glossary must not have."""
    kinds = glossary.groupBy("abbr").agg(F.count_if("complex").alias("odd"), F.count("*").alias("n"))
    return kinds.where("odd > 0 and odd < n").select("abbr")


def with_occurrences(texts: DataFrame, offered: DataFrame) -> DataFrame:
    """Entries with candidates, as a map, the occurrences of their abbreviations, and ``found``: the
    script in which these stand."""
    item = F.struct("abbr", "candidates")
    own = offered.groupBy(*KEY).agg(F.map_from_entries(F.sort_array(F.collect_list(item))).alias("candidates"))
    keys = matching.spelled_keys(F.coalesce(F.map_keys("candidates"), F.array().cast("array<string>")))
    out = texts.join(own, KEY, "left").withColumn("found", keys)
    out = out.withColumn("found", matching.located(F.col("text"), F.col("found")))
    return out.withColumn("occurrences", edits.occurrences(F.col("found")))


def marked(entries: DataFrame) -> DataFrame:
    return entries.withColumn("marked", edits.marked(F.col("found")))


def prompts(entries: DataFrame, task: str = "Choose a resolution for every marked abbreviation.") -> DataFrame:
    """With ``prompt``: the marked text, then what is offered for each occurrence."""
    line = lambda o: F.concat(F.lit("- [["), o.id.cast("string"), F.lit("]] "), o.matched, F.lit(": "), F.coalesce(F.array_join(F.try_element_at("candidates", o.abbreviation), ", "), F.lit("(none)")))
    lists = F.array_join(F.transform("occurrences", line), "\n")
    ask = F.lit("Answer with a JSON object of ids and choices.")
    return marked(entries).withColumn("prompt", F.concat_ws("\n\n", F.lit(task), F.col("marked"), lists, ask))


def first_choices(entries: DataFrame) -> DataFrame:
    """With ``expanded``: every occurrence replaced by its first candidate."""
    first = lambda e: F.try_element_at(F.try_element_at("candidates", e.new), F.lit(1))
    put = F.transform("found", lambda e: F.concat(e.gap, F.coalesce(first(e), e.old)))
    return entries.withColumn("expanded", F.array_join(put, ""))
