"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its share, by weight, of a multiple of all words; no target exceeds a cap of
the source's words, and what is above it is shared anew among the others.  A source that is asked
for more than it has is taken in complete epochs first.  For what remains, each document draws
an exponential key, -ln(u) / quality weight, with u from a hash of the document; in the order of
the keys, documents are taken until the words asked for are reached, the last one in part.

The prefix sums are in two levels: keys fall into ranges of a few thousand documents, in
proportion to a source's documents, so a source with a third of all rows is as many groups as its
size asks for; sums of ranges, then rows within a range, are added up.

Edge cases: null texts have size 0; null sources are one source, the last; sources of size 0 have
target 0; null ids draw from the text's hash; repeated rows draw the same key, and are each taken; ties of keys go by id, then by size, and rows alike in all that are interchangeable;
very long texts are only counted; an empty table gives no rows; extra columns are ignored, or pass
through :func:`mixed`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_CLASS, drop_shared, packed, unpacked, write_shared

WEIGHTS = (5, 2, 1)
TOTAL_PERCENT = 150
CAP = 2
#: Quality weight of a document: LOW to 1 by its labels' mean, UNLABELLED without any.
LOW, UNLABELLED = 0.25, 0.5
RANGE_ROWS = 4096
SALT = "mix"


def targets(sources: DataFrame) -> DataFrame:
    """Adds ``target`` to rows (source, source_size, docs), one for each source."""
    # Ranks in code point order, null last: ranges of sources, counts of ranges, rows in a range.
    ranged = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ranged = write_shared(ranged, "sources")
    offset = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(offset, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before")
    ranked = ranged.join(parts, "part").withColumn("rank", rank)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod("rank", F.lit(len(WEIGHTS))) + 1).cast("int"))
    own = write_shared(ranked.select("source", "source_size", "docs", weight.alias("weight")), "sources")
    drop_shared(ranged)
    # Each round finds the share of a unit of weight; sources above their cap leave, until none is.
    total = TOTAL_PERCENT / 100 * float(own.agg(F.sum("source_size")).first()[0] or 0)
    unit, capped = 0.0, F.lit(False)
    while total:
        full, free, n = own.agg(F.sum(F.when(capped, CAP * F.col("source_size")).otherwise(0)), F.sum(F.when(~capped, F.col("weight")).otherwise(0.0)), F.count_if(capped)).first()
        unit = (total - float(full)) / free
        capped = F.lit(unit) * F.col("weight") > CAP * F.col("source_size")
        if own.where(capped).count() == n:
            break
    return own.withColumn("target", F.least(F.lit(unit) * F.col("weight"), (CAP * F.col("source_size")).cast("double")))


def identity(doc_id: Column, text: Column) -> Column:
    """What tells documents apart: the id, or the text's hash where there is none."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("t"), F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)))


def draw(name: Column, size: Column) -> Column:
    """A number between 0 and 1, both excluded, by a hash of the document and 52 bits of it."""
    text = F.concat(name, F.lit("-"), size.cast("string"), F.lit(f"-{SALT}"))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def mix(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, and columns to carry, for each row of ``docs``."""
    quality = labels.where("doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("q")).withColumnRenamed("doc_id", "of")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_CLASS)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), identity(F.col("doc_id"), F.col("text")).alias("mix_name"), *carry)
    rows = rows.join(quality, F.col("doc_id") == F.col("of"), "left").drop("of")
    weight = F.coalesce(LOW + (1 - LOW) * F.col("q"), F.lit(UNLABELLED))
    key = -F.log(draw(F.col("mix_name"), F.col("size"))) / weight
    rows = write_shared(rows.select("doc_id", "source", "size", "mix_name", key.alias("key"), *carry), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    aims = targets(sources)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5).cast("long")
    aims = aims.withColumn("epochs", epochs).withColumn("rest", rest).select(F.col("source").alias("of"), "source_size", "docs", "target", "epochs", "rest")
    ranges = F.ceil(F.col("docs") / RANGE_ROWS)
    # Keys of weight UNLABELLED spread evenly over the ranges; any other weight keeps their order.
    spot = F.least(F.floor((1 - F.exp(-UNLABELLED * F.col("key"))) * ranges), ranges - 1).cast("long")
    rows = rows.join(aims, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("range", spot)
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col("source").alias("of"), F.col("range").alias("at"), F.coalesce(before, F.lit(0)).alias("before"))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("at")))
    inside = F.sum("size").over(Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", "mix_name").rowsBetween(Window.unboundedPreceding, -1))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.coalesce(inside, F.lit(0))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), *carry)


def mixed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix takes, repeated by epoch; a document begun is whole.

    Rows that share an id, or a text where they have none, are repeated alike.
    """
    key = identity(F.col("doc_id"), F.col("text"))
    keyed = docs.select(packed(docs).alias("row"), key.alias("key"))
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0)
    slim = docs.select("doc_id", "source", "text", key.alias("mix_key"))
    taken = mix(slim, labels, ("mix_key",)).groupBy("mix_key").agg(F.max(copies).cast("int").alias("copies")).where("copies > 0")
    out = keyed.join(taken, F.col("key") == F.col("mix_key")).select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return out.select(*unpacked("row", docs.columns))


_WEIGHT = " ".join(f"WHEN {i} THEN {w}.0" for i, w in enumerate(WEIGHTS))
#: The same in DuckDB SQL.
SQL = f"""
WITH quality AS (SELECT doc_id, avg(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
sized AS (SELECT d.doc_id, d.source, coalesce(d.doc_id::VARCHAR, 't' || sha256(coalesce(d.text, ''))) AS name, len(regexp_extract_all(coalesce(d.text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, coalesce({LOW} + {1 - LOW} * q.q, {UNLABELLED}) AS w
          FROM documents d LEFT JOIN quality q ON d.doc_id = q.doc_id),
rows AS (SELECT doc_id, source, size, name, -ln((('0x' || md5(name || '-' || size || '-{SALT}')[1:13])::BIGINT::DOUBLE + 0.5) / {float(1 << 52)!r}) / w AS key FROM sized),
sums AS (SELECT source, sum(size)::DOUBLE AS s FROM rows GROUP BY source),
weighed AS (SELECT source, s, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} {_WEIGHT} END AS w FROM sums),
ordered AS (SELECT *, row_number() OVER (ORDER BY {CAP} * s / w, source NULLS LAST) AS k FROM weighed),
run AS (SELECT *, coalesce(sum({CAP} * s) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
        sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free, sum(s) OVER () * {TOTAL_PERCENT / 100} AS total FROM ordered),
unit AS (SELECT coalesce((SELECT (total - full_before) / free FROM run WHERE (total - full_before) / free * w <= {CAP} * s ORDER BY k LIMIT 1), 0.0) AS u),
aims AS (SELECT source, s, least(u * w, {CAP} * s) AS target FROM weighed, unit),
split AS (SELECT source, s, target, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END AS epochs FROM aims),
placed AS (SELECT r.doc_id, r.size, a.s, a.target, a.epochs, floor(a.target - a.epochs * a.s + 0.5) AS rest,
           coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id, r.size, r.name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
           FROM rows r JOIN split a ON r.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(s AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target,
       CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM placed
"""
