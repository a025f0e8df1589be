"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Words and word pairs are hashed to BUCKETS features.  Their counts over all documents make the
raw multinomial; those over documents labelled as good make the target's, smoothed towards the
raw one.  A document's score is the sum of log(target / raw) over its n-grams, divided by their
number; documents below THRESHOLD go.  Everything is a DataFrame expression: no row leaves the JVM.

The counts cover every document.  The labelled sample is bounded: TARGET_DOCS labelled ids, least
by hash, so the set of target ids that is broadcast has a fixed size (8 bytes each).

Edge cases: null and empty texts, and texts without words, have no n-gram, score 0, and fail the
base rules (fewer than MIN_WORDS words); rows that repeat a doc_id are scored each by its own
text; ties with a threshold are kept; very long texts are scored whole, in memory that grows with
their length; without any label every score is 0, and an empty table gives no rows; other columns
pass through, and columns that are added replace ones of the same name in whatever case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_CLASS, others, packed, unpacked

BUCKETS = 1 << 14
TARGET_DOCS = 20_000
#: Words of the raw multinomial that the target's counts are smoothed with.
PRIOR_NGRAMS = 200_000
THRESHOLD = -0.09

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8


def words_of(text: Column) -> Column:
    """The words of a text (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def _hashed(docs: DataFrame) -> DataFrame:
    """Adds q_words and q_hash, the words' hash values, to rows with q_text, one step at a time."""
    out = docs.withColumn("q_words", words_of(F.col("q_text")))
    return out.withColumn("q_hash", F.transform("q_words", lambda w: F.xxhash64(w)))


def _text(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`"), F.lit("")).alias("q_text")


def _pair(left: Column, right: Column) -> Column:
    return F.pmod(F.xxhash64(left, right), F.lit(BUCKETS))


def target_ids(labels: DataFrame) -> DataFrame:
    """doc_id of at most TARGET_DOCS documents that a label calls good, least by hash."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_DOCS)


def ngram_weights(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """One row: ``weights``, the log ratio of each bucket in order, from counts over all of ``docs``."""
    chosen = target_ids(labels).select(F.col("doc_id").alias("q_id"))
    flagged = docs.select("doc_id", _text(text)).join(F.broadcast(chosen), F.col("doc_id") == F.col("q_id"), "left")
    hashed = _hashed(flagged).select(F.col("q_id").isNotNull().cast("long").alias("own"), "q_hash")
    at = hashed.select("own", "q_hash", F.posexplode("q_hash").alias("i", "h"))
    following = F.get("q_hash", F.col("i") + 1)
    pair = F.when(following.isNotNull(), _pair(F.col("h"), following))
    grams = at.select("own", F.explode(F.array(F.pmod("h", F.lit(BUCKETS)), pair)).alias("bucket")).where("bucket is not null")
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("own").alias("target"))
    totals = F.struct(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    # A row for each bucket, so the array has a fixed size.
    every = counts.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("raw"), F.lit(0).cast("long").alias("target"))
    counts = counts.unionByName(every).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    listed = counts.agg(totals.alias("n"), F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("by"))
    share = lambda c: (c.raw + F.lit(1.0)) / (F.col("n.raw") + F.lit(float(BUCKETS)))
    smooth = lambda c: (c.target + PRIOR_NGRAMS * share(c)) / (F.col("n.target") + PRIOR_NGRAMS)
    weigh = lambda c: F.when(F.col("n.target") == 0, F.lit(0.0)).otherwise(F.log(smooth(c) / share(c)))
    return listed.select(F.transform("by", weigh).alias("weights"))


def rated(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    passed = others(docs, *names)
    # BUCKETS numbers, so collecting them takes the same space for any input; as text they become
    # one constant of the plan, which a lambda can look up.
    found = ngram_weights(docs, labels, text).first()["weights"]
    weights = F.split(F.lit(",".join(f"{w:.6f}" for w in found)), ",").cast("array<double>")
    out = _hashed(docs.select(packed(docs).alias("row"), _text(text)))
    lines = F.filter(F.split("q_text", "\n", -1), lambda x: x.rlike(WORD_CLASS))
    out = out.withColumn("q_lines", lines)
    # Windows of WINDOW words by a hash of their words' hash values.
    hash_at = lambda i: [F.get("q_hash", i + k) for k in range(WINDOW)]
    windows = F.transform(F.sequence(F.lit(0), F.size("q_hash") - WINDOW), lambda i: F.xxhash64(*hash_at(i)))
    out = out.withColumn("q_windows", F.when(F.size("q_hash") >= WINDOW, windows))
    twice = F.size(F.array_distinct("q_windows")) < F.size("q_windows")
    ordered = F.sort_array(F.transform("q_windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    out = out.withColumn("q_ordered", F.when(twice, ordered))
    # A window stands more than once if a neighbour in the order is equal; its start is kept.
    same = lambda e, k: F.coalesce(F.get("q_ordered", k).x == e.x, F.lit(False))
    starts = F.transform("q_ordered", lambda e, k: F.when(same(e, k - 1) | same(e, k + 1), e.i))
    out = out.withColumn("q_starts", F.sort_array(F.array_compact(starts)))
    covered = F.transform("q_starts", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("q_starts", k + 1) - p, F.lit(WINDOW))))
    weight = lambda b: F.get(weights, b.cast("int"))
    pair = lambda h, k: F.coalesce(weight(_pair(h, F.get("q_hash", k + 1))), F.lit(0.0))
    last = F.size("q_hash") - 1
    each = F.transform("q_hash", lambda h, k: F.coalesce(weight(F.pmod(h, F.lit(BUCKETS))), F.lit(0.0)) + F.when(k < last, pair(h, k)).otherwise(0.0))
    total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    out = out.select(
        "row",
        F.size("q_words").cast("long").alias("n_words"),
        F.length(F.array_join("q_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("q_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.when(F.size("q_hash") > 0, total / (2 * F.size("q_hash") - 1)).otherwise(0.0).alias("score"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    # A generator of one row: a filter on the verdict stays above it, where it is looked up.  Pushed
    # below, it would repeat all these steps in full within one another.
    verdict = ~F.col("base_failed") & (F.col("score") >= THRESHOLD)
    told = F.struct(*[F.col(n) for n in names if n != "kept"], verdict.alias("kept"))
    return out.select("row", F.explode(F.array(told)).alias("q")).select(*unpacked("row", passed), *[F.col("q").getField(n).alias(n) for n in names])


#: The base columns in DuckDB SQL.
BASE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD_CLASS}') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD_CLASS}')) AS l FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM windows) WHERE n > 1),
spread AS (SELECT doc_id, CAST(sum(least({WINDOW}, coalesce(next - i, {WINDOW}))) AS BIGINT) AS n FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM again) GROUP BY doc_id),
told AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN spread USING (doc_id))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM told"""
