"""Order and rank over whole tables, without a window that is one task.

Scans go in two levels: rows are dealt by ranges of the order, each range is scanned on its own, and
what one hands to the next is a row for each range.  Ranks are found by counting ranges of values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import shared

#: Ranges that are counted at a time when a rank is looked for.
BUCKETS = 4096
_PART = "_range"


def ranges(df: DataFrame, order: Sequence[str], part: str = _PART) -> DataFrame:
    """``df`` dealt by ranges of ``order``, with each row's range; as a table, as the ranges are
    sampled and have to stay what they are."""
    return shared.settled(df.repartitionByRange(*[F.col(c) for c in order]).withColumn(part, F.spark_partition_id()))


def carried(df: DataFrame, order: Sequence[str], value: Column, into: str) -> DataFrame:
    """With ``into``: the last ``value`` that is not null, at a row or before it in the order."""
    rows = ranges(df.withColumn(into, value), order)
    own = Window.partitionBy(_PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = rows.where(F.col(into).isNotNull()).groupBy(_PART).agg(F.max_by(into, F.struct(*order)).alias("v"))
    handed = _handed(rows, last, F.last("v", ignorenulls=True))
    out = rows.withColumn(into, F.last(into, ignorenulls=True).over(own)).join(handed, _PART, "left")
    return out.withColumn(into, F.coalesce(into, "_handed")).drop(_PART, "_handed")


def _handed(rows: DataFrame, parts: DataFrame, of: Column) -> DataFrame:
    """What each range gets from all before it: a row for each range, of which there are as many as
    partitions, so one window over them is small whatever the table."""
    every = rows.select(_PART).distinct().join(parts, _PART, "left")
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    return every.select(_PART, of.over(before).alias("_handed"))


def numbered(df: DataFrame, order: Sequence[str], into: str) -> DataFrame:
    """With ``into``: each row's number in the order, from 1.  Rows keep their range in ``_range``."""
    rows = ranges(df, order)
    handed = _handed(rows, rows.groupBy(_PART).agg(F.count("*").alias("v")), F.sum("v"))
    number = F.row_number().over(Window.partitionBy(_PART).orderBy(*order)).cast("long")
    out = rows.withColumn(into, number).join(handed, _PART, "left")
    return out.withColumn(into, F.col(into) + F.coalesce("_handed", F.lit(0).cast("long"))).drop("_handed")


def running_max(numbered_rows: DataFrame, value: Column, order: str, into: str) -> DataFrame:
    """With ``into``: the greatest ``value`` up to each row; rows as :func:`numbered` leaves them."""
    rows = numbered_rows.withColumn(into, value)
    own = Window.partitionBy(_PART).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    handed = _handed(rows, rows.groupBy(_PART).agg(F.max(into).alias("v")), F.max("v"))
    out = rows.withColumn(into, F.max(into).over(own)).join(handed, _PART, "left")
    return out.withColumn(into, F.greatest(into, "_handed")).drop(_PART, "_handed")


def ranked_value(df: DataFrame, column: str, rank: int):
    """The value of a rank (from 0) among the values of a column of numbers that are not null.

    Ranges of values are counted, and the one with the rank is looked into, until it has one value:
    each pass brings a number for each range to the driver, and no group holds the values.
    """
    v = F.col(column).cast("double")
    rows = df.select(v.alias("v")).where("v is not null")
    low, high = rows.agg(F.min("v"), F.max("v")).first()
    while low is not None and low < high:
        width = high / BUCKETS - low / BUCKETS
        place = F.least(F.lit(BUCKETS - 1), F.floor(F.col("v") / width - low / width)) if width > 0 else F.when(F.col("v") > low, 1).otherwise(0)
        inside = rows.where(F.col("v").between(low, high)).groupBy(place.alias("k"))
        for k, n, least, most in sorted(inside.agg(F.count("*"), F.min("v"), F.max("v")).collect(), key=lambda r: r[2]):
            if rank < n:
                low, high = least, most
                break
            rank -= n
    return low


def median(df: DataFrame, column: str) -> float | None:
    """The exact median: the mean of the two values in the middle of an even number."""
    n = df.where(F.col(column).isNotNull()).count()
    if not n:
        return None
    low = ranked_value(df, column, (n - 1) // 2)
    return low if n % 2 else (low + ranked_value(df, column, n // 2)) / 2
