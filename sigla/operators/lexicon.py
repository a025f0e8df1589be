"""Paradigms by joins of stems with ending tables; lexicons, ranks and indexes made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import morphology, text

GERUND = ("i", "o", "um")
LEAST_ANCHOR = 4


def endings(df: DataFrame) -> DataFrame:
    """table, class, plural, ending: some 150 rows."""
    return df.sparkSession.createDataFrame(list(morphology.ending_rows()), "table string, class string, plural boolean, ending string")


def suffixes(df: DataFrame) -> DataFrame:
    """class, stem_kind, ending, for_deponents: some 900 rows."""
    return df.sparkSession.createDataFrame(list(morphology.verb_rows()), "class string, stem_kind string, ending string, for_deponents boolean")


def _with_e(forms: DataFrame) -> DataFrame:
    """Every form with ae also in the spelling with e."""
    both = F.array_distinct(F.array("form", F.replace("form", F.lit("ae"), F.lit("e"))))
    return forms.withColumn("form", F.explode(both))


def entry_words(entries: DataFrame) -> DataFrame:
    """A row for each word of each entry (resolution, stem, declension) that can be interpreted."""
    own = entries.select("resolution", "stem", "declension").distinct()
    own = own.withColumn("w", F.explode(morphology.analysis("resolution", "stem", "declension")))
    return own.select("resolution", "stem", "declension", "w.*", F.col("w.stems").alias("w_stems")).drop("stems")


def entry_forms(entries: DataFrame) -> DataFrame:
    """resolution, stem, declension, pos, word, known, form (null for words of unknown morphology)."""
    words = entry_words(entries)
    key = ["resolution", "stem", "declension", "pos", "word", "kind"]
    tall = words.select(*key, "plural", "deponent", F.explode("classes").alias("class"), "w_stems")
    tall = tall.select(*key, "plural", "deponent", "class", F.explode("w_stems").alias("s")).select(*key, "plural", "deponent", "class", F.col("s.kind").alias("stem_kind"), F.col("s.stem").alias("root"))
    # The tables have a fixed size, so broadcasting them is bounded.
    nominal = tall.where(F.col("kind").isin("noun", "adjective"))
    table = endings(entries).withColumnRenamed("plural", "of_plural")
    declined = nominal.join(F.broadcast(table), (nominal.kind == table.table) & (nominal["class"] == table["class"]) & (~nominal.plural | table.of_plural))
    declined = declined.select(*key, F.concat("root", "ending").alias("form"))
    bare = nominal.where("root like '%r'").select(*key, F.col("root").alias("form"))
    verbs = tall.where("kind = 'verb'")
    more = suffixes(entries)
    conjugated = verbs.join(F.broadcast(more), (verbs["class"] == more["class"]) & (verbs.stem_kind == more.stem_kind) & (~verbs.deponent | more.for_deponents))
    conjugated = conjugated.select(*key, F.concat("root", "ending").alias("form"))
    gerunds = words.where("kind = 'gerund'").select(*key, F.explode("w_stems.stem").alias("root"))
    gerunds = gerunds.select(*key, F.explode(F.transform(F.lit(list(GERUND)), lambda e: F.concat("root", e))).alias("form"))
    itself = words.where("kind not in ('unknown', 'fixed')").select(*key, F.col("word").alias("form"))
    varied = _with_e(declined.unionByName(bare).unionByName(conjugated).unionByName(gerunds).unionByName(itself))
    fixed = words.where("kind = 'fixed'").select(*key, F.col("word").alias("form"))
    unknown = words.where("kind = 'unknown'").select(*key, F.lit(None).cast("string").alias("form"))
    rows = varied.unionByName(fixed).unionByName(unknown).withColumn("known", F.col("kind") != "unknown")
    return rows.drop("kind").distinct()


def _capitalised(word: Column) -> Column:
    return F.concat(F.upper(F.left(word, F.lit(1))), F.lower(F.substring(word, 2, 1_000_000)))


def lexicon(entries: DataFrame) -> DataFrame:
    """word, form: words with more than one form, and capitalised variants of lower-case ones."""
    forms = entry_forms(entries).where("known").select("resolution", "stem", "declension", "pos", "word", "form").distinct()
    several = Window.partitionBy("resolution", "stem", "declension", "pos")
    own = forms.withColumn("n", F.count("*").over(several)).where("n > 1").select("word", "form").distinct()
    small = own.where(F.left("word", F.lit(1)).rlike(r"^\p{Ll}"))
    return own.unionByName(small.select(_capitalised(F.col("word")).alias("word"), _capitalised(F.col("form")).alias("form"))).distinct()


def diocese_entries(dioceses: DataFrame) -> DataFrame:
    """resolution, stem, declension of diocese adjectives, which the list gives no morphology for."""
    cut = F.col("resolution").substr(F.lit(1), F.length("resolution") - 2)
    ending = F.right("resolution", F.lit(2))
    known = dioceses.where(ending.isin("is", "us"))
    return known.select(
        "resolution",
        F.concat(cut, F.when(ending == "is", " -is").otherwise(" -i")).alias("stem"),
        F.when(ending == "is", "i (Adj.)").otherwise("o/a (Adj.)").alias("declension"),
    )


def ranked_forms(words: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """word, form, n, rank: by corpus count, then by form; by form alone without a vocabulary."""
    if vocabulary is None:
        counted = words.withColumn("n", F.lit(0).cast("long"))
    else:
        counts = vocabulary.select(F.col("word").alias("form"), F.col("n"))
        counted = words.join(counts, "form", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    order = Window.partitionBy("word").orderBy(F.desc("n"), "form")
    return counted.select("word", "form", "n", F.row_number().over(order).alias("rank"))


def lemma_index(entries: DataFrame) -> DataFrame:
    """key, lemma: which base forms a spelling key can belong to."""
    forms = entry_forms(entries)
    rows = forms.select("word", F.col("word").alias("form")).union(forms.where("known").select("word", "form"))
    return rows.select(text.orthographic_key(F.col("form")).alias("key"), F.col("word").alias("lemma")).distinct()


def anchor_index(entries: DataFrame) -> DataFrame:
    """abbr, key: what a resolution of an abbreviation may start with, short words left out."""
    first = F.element_at(F.split(F.trim("resolution"), r"\s+"), 1)
    own = entries.where("abbr is not null and resolution is not null").withColumn("first_word", first)
    forms = entry_forms(entries).where("known").select(F.col("resolution").alias("of"), F.col("stem").alias("of_stem"), F.col("declension").alias("of_declension"), "word", "form")
    joined = own.join(forms, (own.resolution == forms.of) & (own.stem == forms.of_stem) & (own.declension == forms.of_declension) & (own.first_word == forms.word))
    keys = own.select("abbr", text.orthographic_key(F.col("first_word")).alias("key")).union(joined.select("abbr", text.orthographic_key(F.col("form")).alias("key")))
    return keys.where(F.length("key") >= LEAST_ANCHOR).distinct()


def inflectional(a: Column, b: Column, least: int = 3) -> Column:
    """Whether two keys share a stem of ``least`` letters with nothing but case endings after it."""
    # As a literal: Spark would work out an expression of constants anew for every pair.
    listed = F.lit(sorted({text.key_of(e) for e in (*morphology.CASE_ENDINGS_PLAIN, "")}))

    def fits(ending: Column) -> Column:  # the first key's, so what stands before it is the stem
        n = F.length(a) - F.length(ending)
        stem = F.substr(a, F.lit(1), n)
        return F.endswith(a, ending) & (n >= least) & F.startswith(b, stem) & F.array_contains(listed, F.substr(b, n + 1, F.greatest(F.length(b) - n, F.lit(0))))

    return F.coalesce((F.left(a, F.lit(least)) == F.left(b, F.lit(least))) & F.exists(listed, fits), F.lit(False))
