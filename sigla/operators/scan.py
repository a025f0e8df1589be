"""Counting over corpora: abbreviations, vocabulary, what is left."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..functions.matching import Table


def abbreviation_counts(docs: DataFrame, *columns: str, most: int = 5) -> DataFrame:
    """abbreviation, parts, n over text columns, for abbreviations of 1 to ``most`` words."""
    found = F.concat(*[text.all_grams(F.col(c), most) for c in columns or ("text",)])
    rows = docs.select(F.explode(found).alias("abbreviation"))
    counts = rows.groupBy("abbreviation").agg(F.count("*").alias("n"))
    return counts.select("abbreviation", text.parts_of(F.col("abbreviation")).alias("parts"), "n")


def distinct_abbreviations(docs: DataFrame, *columns: str, most: int = 5, keys: tuple[str, ...] = ()) -> DataFrame:
    """The abbreviations of texts (within keys), with their spacing variants."""
    found = F.concat(*[text.all_grams(F.col(c), most) for c in columns or ("text",)])
    rows = docs.select(*keys, F.explode(found).alias("abbreviation")).distinct()
    both = F.array_distinct(F.array("abbreviation", text.spacing_variant(F.col("abbreviation"))))
    return rows.select(*keys, F.explode(both).alias("abbreviation")).distinct()


def vocabulary(docs: DataFrame, *columns: str, least: int = 3) -> DataFrame:
    """word, n of words that no period follows."""
    found = F.concat(*[text.vocabulary_words(F.col(c), least) for c in columns or ("text",)])
    return docs.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def remaining(docs: DataFrame, *keys: str, column: str = "text") -> DataFrame:
    """keys, id from 1, abbreviation of what is still abbreviated."""
    rows = docs.select(*keys, F.posexplode(text.remaining(F.col(column))).alias("at", "abbreviation"))
    return rows.select(*keys, (F.col("at") + 1).alias("id"), "abbreviation")


def counted_before_and_after(before: DataFrame, after: DataFrame, *columns: str) -> DataFrame:
    """volume, before, after: how many abbreviations texts hold."""
    total = lambda name: F.sum(sum((text.count_abbreviations(F.col(c)) for c in columns or ("text",)), F.lit(0))).cast("long").alias(name)
    old, new = before.groupBy("volume").agg(total("before")), after.groupBy("volume").agg(total("after"))
    return old.join(new, "volume", "left").select("volume", "before", F.coalesce("after", F.lit(0).cast("long")).alias("after"))


def top(df: DataFrame, count: str, name: str, k: int) -> DataFrame:
    """The k largest counts; of equal ones the first names."""
    return df.orderBy(F.desc(count), F.col(name)).limit(k)


def known_but_left(counts: DataFrame, known: DataFrame) -> DataFrame:
    """Counts of abbreviations that a dictionary has and that still stand."""
    return counts.join(known.select("abbreviation").where("abbreviation is not null").distinct(), "abbreviation")


def orthographic_groups(docs: DataFrame, column: str = "text") -> DataFrame:
    """key, spellings, n: how many spellings share a key, and how often they occur."""
    counts = docs.select(F.explode(text.tokens(F.col(column))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    keyed = counts.withColumn("key", text.orthographic_key(F.col("token")))
    return keyed.groupBy("key").agg(F.count("*").alias("spellings"), F.sum("n").alias("n"))


def mined_candidates(abbreviations: DataFrame, words: DataFrame, most: int = 10, least: int = 2) -> DataFrame:
    """abbreviation, rank, candidate, n: frequent words that go on where an abbreviation stops.

    A word is taken apart into its prefixes, so this is an equi-join, not a range join.  The best
    of each prefix are told first, in every task before rows are shuffled, so a short prefix
    carries ``most`` words into the join, not all that start with it.
    """
    stems = abbreviations.select("abbreviation").distinct().withColumn("stem", F.explode(text.prefixes(F.col("abbreviation"))))
    often = words.where(F.col("n") >= least)
    heads = often.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("k")).select("word", "n", F.substr("word", F.lit(1), F.col("k")).alias("stem"))
    best = lambda of: F.row_number().over(Window.partitionBy(of).orderBy(F.desc("n"), "word"))
    heads = heads.withColumn("rank", best("stem")).where(F.col("rank") <= most).drop("rank")
    found = stems.join(heads, "stem").select("abbreviation", "word", "n").distinct()
    return found.withColumn("rank", best("abbreviation")).where(F.col("rank") <= most).select("abbreviation", "rank", F.col("word").alias("candidate"), "n")


#: Rows of a dictionary, at most, where they come to the driver or go through one task.
MOST_ROWS = 200_000


def few(rows: DataFrame) -> DataFrame:
    """``rows``, or an error if they are more than a dictionary can have."""
    if rows.limit(MOST_ROWS + 1).count() > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows for a dictionary")
    return rows


def listed(rows: DataFrame, most: int = MOST_ROWS) -> list:
    """The rows of a dictionary, or an error if they are more than one can have."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows for a dictionary")
    return got


def corpus_volumes(docs: DataFrame, queries: DataFrame, column: str = "text", *keys: str) -> DataFrame:
    """query, volume, rows (and keys): in which volumes, and in how many texts of each, an
    abbreviation occurs.

    The spellings of all abbreviations, a dictionary's, are a constant of the plan, in which the
    runs of words of a text are looked up; what is not made of words, periods and blanks is looked
    for as a pattern.  Only what is found leaves a text.
    """
    names = [r.query for r in listed(queries.select("query").distinct())]
    of: dict[str, list[str]] = {}
    for name in names:
        for form in text.query_forms(name) or ():
            of.setdefault(form, []).append(name)
    odd = [n for n in names if text.query_forms(n) is None]
    whole = docs.select("volume", *keys, F.coalesce(F.col(column), F.lit("")).alias("t"))
    hits = F.array().cast("array<string>")
    if of:
        words = F.regexp_extract_all("t", F.lit(r"(?U)\w+"), F.lit(0))
        whole = whole.withColumns({"words": words, "gaps": F.split("t", r"(?U)\w+", -1)})
        table = Table({form: "\n".join(own) for form, own in of.items()})
        sizes = sorted({len(re.findall(r"\w+", f)) for f in of})
        firsts = Table({re.findall(r"\w+", f)[0]: "" for f in of if len(re.findall(r"\w+", f)) > 1})
        runs = F.concat(*[F.col("words") if n == 1 else text.word_runs(F.col("words"), F.col("gaps"), n, firsts.get) for n in sizes])
        hits = F.flatten(F.transform(F.array_compact(F.transform(F.array_distinct(runs), table.get)), lambda found: F.split(found, "\n")))
    patterns = [F.when(F.col("t").rlike("(?U)" + text.query_pattern(q)), F.lit(q)) for q in odd]
    hits = F.concat(hits, F.array_compact(F.array(*patterns))) if patterns else hits
    found = whole.select("volume", *keys, F.explode(F.array_distinct(hits)).alias("query"))
    return found.groupBy("query", "volume", *keys).agg(F.count("*").alias("rows"))


def fingerprinted(docs: DataFrame, into: str = "file") -> DataFrame:
    """A table read from files, with each row's file: its path, size and time of change."""
    m = lambda name: F.col(f"_metadata.{name}").cast("string")
    return docs.withColumn(into, F.concat_ws("|", m("file_path"), m("file_size"), F.unix_micros("_metadata.file_modification_time").cast("string")))


def cached_volumes(docs: DataFrame, queries: DataFrame, path: str, column: str = "text", file: str = "file") -> DataFrame:
    """As :func:`corpus_volumes`, with what was found in each file kept in ``path``.

    ``docs`` has each row's file (:func:`fingerprinted`).  A call asks new files for every query
    that was ever asked, and files that are known for new queries alone; files that have gone are
    withdrawn, and come back as new ones.  If nothing is new, no text is read.
    """
    spark = docs.sparkSession
    kept = {"found": f"query string, volume long, rows long, {file} string", "calls": "call long, kind string, name string"}

    def read(name: str) -> DataFrame:
        try:
            return spark.read.schema(kept[name]).parquet(f"{path}/{name}")
        except AnalysisException:  # nothing has been kept yet
            return spark.createDataFrame([], kept[name])

    calls = read("calls")
    last = calls.agg(F.max("call")).first()[0] or 0
    files = docs.select(F.col(file).alias("name")).distinct()
    asked = queries.select(F.col("query").alias("name")).distinct()
    known_files = calls.where((F.col("kind") == "file") & (F.col("call") == last)).select("name").distinct()
    known_asked = calls.where(F.col("kind") == "query").select("name").distinct()
    new_files, new_asked = files.join(known_files, "name", "left_anti"), asked.join(known_asked, "name", "left_anti")
    every = known_asked.unionByName(asked).distinct()
    some_files = not new_files.isEmpty()
    some_asked = not new_asked.isEmpty() and not files.join(known_files, "name", "left_semi").isEmpty()
    of = lambda rows: F.col(file) == rows["name"]
    asks = [(docs.join(new_files, of(new_files), "left_semi"), every)] if some_files else []
    asks += [(docs.join(new_files, of(new_files), "left_anti") if some_files else docs, new_asked)] if some_asked else []
    made = [corpus_volumes(d, q.withColumnRenamed("name", "query"), column, file) for d, q in asks]
    if made or known_files.count() != files.count():
        for rows in made:
            rows.select(*[F.col(f.split(" ")[0]).cast(f.split(" ")[1]) for f in kept["found"].split(", ")]).write.mode("append").parquet(f"{path}/found")
        call = lambda rows, kind: rows.select(F.lit(last + 1).cast("long").alias("call"), F.lit(kind).alias("kind"), "name")
        call(files, "file").unionByName(call(asked, "query")).coalesce(1).write.mode("append").parquet(f"{path}/calls")
    # A file that came back has been asked twice, with the same answers.
    found = read("found").distinct().join(files, F.col(file) == files["name"], "left_semi").join(asked.withColumnRenamed("name", "query"), "query", "left_semi")
    return found.groupBy("query", "volume").agg(F.sum("rows").alias("rows"))


def known_abbreviations(*lists: DataFrame) -> DataFrame:
    """All abbreviations (abbr) that any of the dictionaries lists."""
    both = reduce(DataFrame.unionByName, [d.select("abbr") for d in lists])
    return both.where("abbr is not null").distinct()
