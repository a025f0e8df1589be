"""Line dedup by site-relative frequency.

For each host, the pages that contain a line are divided by the host's pages; lines whose share
exceeds a boilerplate ratio are dropped from the host's pages.  Every page counts, copies too.  A
line on one page alone is not repeated, whatever its share.

Lines are counted by 128 bits of hash.  A page's distinct lines are told within its row, so counting
shuffles no text and no page: partial counts by line meet, and a line that stands on every page of a
host is as many rows as there are tasks.  Pages then meet the positions to drop by their own hash.

Edge cases: null and empty texts have no line and stay as they are (an empty text is a page, a null
one is none); an empty table gives no rows; lines without a word are neither counted nor dropped;
null hosts are one host; repeated rows are pages each; a share equal to the ratio does not exceed
it; a host of one page keeps its lines; very long pages and lines are handled whole, in time and
memory that grow with their length; extra columns pass through, whatever their names, and columns
that are added replace ones of the same name in whatever case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_CLASS, others, packed, unpacked

RATIO = 0.07


def _hashes(column: Column) -> list[Column]:
    return [F.xxhash64(column), F.xxhash64(F.lit(1), column)]


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out &= a[f"`{n}`"].eqNullSafe(b[f"`{n}`"])
    return out


def boilerplate(pages: DataFrame, host: str = "host", text: str = "text", ratio: float = RATIO) -> DataFrame:
    """host, line hashes h1 and h2, pages that contain the line, and the host's pages."""
    own = pages.select(F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text")).where("text is not null")
    totals = own.groupBy("host").agg(F.count("*").alias("host_pages"))
    h1, h2 = _hashes(F.col("line"))
    lines = own.select("host", F.explode(F.array_distinct(F.split("text", "\n", -1))).alias("line")).where(F.col("line").rlike(WORD_CLASS))
    counts = lines.select("host", h1.alias("h1"), h2.alias("h2")).groupBy("host", "h1", "h2").agg(F.count("*").alias("line_pages")).where("line_pages > 1")
    both = counts.join(totals.withColumnRenamed("host", "host_"), F.col("host").eqNullSafe(F.col("host_"))).drop("host_")
    return both.where(F.col("line_pages") > ratio * F.col("host_pages"))


def without_boilerplate(pages: DataFrame, host: str = "host", text: str = "text", ratio: float = RATIO) -> DataFrame:
    """``pages`` with clean_text, n_lines and n_dropped."""
    t1, t2 = _hashes(F.col("text"))
    bad = boilerplate(pages, host, text, ratio).select("host", "h1", "h2")
    slim = pages.select(F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text"))
    own = slim.where("text is not null").select("host", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"), t1.alias("t1"), t2.alias("t2"))
    h1, h2 = _hashes(F.col("line"))
    own = own.where(F.col("line").rlike(WORD_CLASS)).select("host", "i", h1.alias("h1"), h2.alias("h2"), "t1", "t2")
    hit = own.join(bad, _same(own, bad, "host", "h1", "h2"), "left_semi").select("host", "t1", "t2", "i").distinct()
    # A page's positions are at most its lines; copies of a page have been merged above.
    drop = hit.groupBy("host", "t1", "t2").agg(F.sort_array(F.collect_list("i")).alias("drop"))
    drop = drop.select(F.col("host").alias("of"), F.col("t1").alias("a"), F.col("t2").alias("b"), "drop")
    rows = pages.select(packed(pages).alias("row"), F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text"))
    rows = rows.select("row", "host", "text", t1.alias("t1"), t2.alias("t2"))
    on = F.col("host").eqNullSafe(F.col("of")) & (F.col("t1") == F.col("a")) & (F.col("t2") == F.col("b"))
    rows = rows.join(drop, on, "left")
    # Whether each line goes, up to the last that does: looked up by position in the next step.
    until = lambda i, k: F.array_repeat(F.lit(False), i - F.coalesce(F.get("drop", k - 1), F.lit(-1)) - 1)
    goes = F.flatten(F.transform("drop", lambda i, k: F.concat(until(i, k), F.array(F.lit(True)))))
    rows = rows.select("row", "text", goes.alias("goes"), F.size("drop").alias("n"))
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.coalesce(F.get("goes", i), F.lit(False)))
    # Unpacked in a step of its own, in which no name can be taken for one of these.
    done = rows.select(
        "row",
        F.when(F.col("goes").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("clean"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("all"),
        F.when(F.col("goes").isNull(), 0).otherwise(F.col("n")).cast("long").alias("gone"),
    )
    added = [F.col("clean").alias("clean_text"), F.col("all").alias("n_lines"), F.col("gone").alias("n_dropped")]
    return done.select(*unpacked("row", others(pages, "clean_text", "n_lines", "n_dropped")), *added)


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the cleaned text's SHA-256 (of the empty text for null)."""
    sha = F.sha2(F.coalesce("clean_text", F.lit("")).cast("binary"), 256)
    return rows.select("doc_id", "n_lines", "n_dropped", sha.alias("clean_sha256"))


#: The same in DuckDB SQL, for pages of documents whose host is their source.
SQL = f"""
WITH pages AS (SELECT source, list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) AS lines
               FROM documents WHERE text IS NOT NULL),
totals AS (SELECT source, count(*) AS n FROM pages GROUP BY source),
counts AS (SELECT source, line, count(*) AS k FROM (SELECT source, unnest(lines) AS line FROM pages) GROUP BY source, line),
bad AS (SELECT c.source, list(c.line) AS bad FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
        WHERE c.k > 1 AND c.k > {RATIO} * t.n GROUP BY c.source),
cut AS (SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS lines,
        list_filter(string_split(d.text, chr(10)), lambda x: NOT coalesce(list_contains(b.bad, x), false)) AS kept
        FROM documents d LEFT JOIN bad b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped,
       sha256(coalesce(array_to_string(kept, chr(10)), '')) AS clean_sha256 FROM cut
"""
