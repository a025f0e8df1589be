"""Rows of headers and regests to the text of an entry, and back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["volume", "entry"]


def to_texts(rows: DataFrame) -> DataFrame:
    """volume, entry, text: the header line, then regests by line_no, joined by newlines.

    An entry without exactly one header raises.
    """
    line = F.coalesce("head_text", "body_text")
    is_header = F.col("head_text").isNotNull()
    # Header first, then by number; an entry's rows are few.
    item = F.struct((~is_header).alias("k"), F.col("line_no").alias("n"), F.coalesce(line, F.lit("")).alias("line"))
    grouped = rows.groupBy(*KEY).agg(F.sort_array(F.collect_list(item)).alias("items"), F.count_if(is_header).alias("headers"))
    text = F.array_join(F.transform("items", lambda i: i.line), "\n")
    wrong = F.raise_error(F.concat(F.lit("not exactly one header in entry "), F.col("volume").cast("string"), F.lit("/"), F.col("entry").cast("string")))
    return grouped.select(*KEY, F.when(F.col("headers") == 1, text).otherwise(wrong.cast("string")).alias("text"))


def to_rows(texts: DataFrame) -> DataFrame:
    """The rows of entries: numbers are positions, so lines must not have come or gone."""
    rows = texts.select(*KEY, F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    return rows.select(
        *KEY,
        F.col("i").cast("long").alias("line_no"),
        F.when(F.col("i") == 0, F.col("line")).alias("head_text"),
        F.when(F.col("i") > 0, F.col("line")).alias("body_text"),
        F.format_string("1%02d%05d-%d", F.col("volume"), F.col("entry"), F.col("i")).alias("line_id"),
    )


def of_subset(stage: DataFrame, subset: DataFrame) -> DataFrame:
    """The rows of a stage whose entries are in a subset (volume, entry)."""
    return stage.join(subset.select(*KEY).distinct(), KEY, "left_semi")


def still_to_do(work: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """Entries without a result yet, in order, at most ``limit``."""
    left = work.join(done.select(*KEY).distinct(), KEY, "left_anti")
    return left if limit is None else left.orderBy(*KEY).limit(limit)


def in_every_stage(stages: list[DataFrame]) -> DataFrame:
    """Keys of the entries that all stages have."""
    keys = [s.select(*KEY).distinct() for s in stages]
    return reduce(lambda a, b: a.join(b, KEY), keys)
