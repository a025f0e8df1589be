"""Scoring: verdicts of resolutions against gold, one abbreviation and stage at a time.

The long table has a row for an occurrence and a stage: volume, entry, pos, abbr, gold (null: not
aligned), stage (1 to 4), resolution (null: not aligned).

What is only counted does not need it.  Occurrences that agree in abbreviation, gold and what every
stage made of them are one fact (:func:`facts`), and facts are far fewer than occurrences: a
corpus is aggregated once, before anything is judged.  The table of facts (:func:`scored_facts`)
has the same columns with ``resolutions`` in place of a position and ``n``, how many occurrences a
row stands for; whatever counts takes either table.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import alignment, text
from ..functions.spans import EVALUATED
from ..sources import shared
from . import ordered, lexicon

OCCURRENCE = ["volume", "entry", "pos"]
FACT = ["abbr", "gold", "resolutions"]
STEPS = {1: "step 1 (rule)", 2: "step 2 (candidates)", 3: "step 3 (mined)", 4: "step 4 (normalized)"}
WORD = ["exact", "orthographic", "wrong_form", "wrong_form?"]
FORM = ["exact", "orthographic"]
#: Entries that are aligned at a time.
ENTRIES = 64
#: Golds that are listed for an abbreviation.
GOLDS = 5
SCOREABLE = [*WORD, "wrong_word", "not_expanded"]


def _occurrences_of(source: str | None, gold: str | None, stages: list[str | None], anchors: dict[str, set[str]] | None) -> list[dict]:
    """The abbreviations of one entry; a text that several columns share is aligned once, and one that
    is the source's own not at all."""
    source = source or ""
    words = EVALUATED.findall(source)
    places = [k for k, w in enumerate(words) if w.endswith(".")]
    if not places:
        return []

    def spelled(target: str | None) -> list[str | None]:
        if target == source:
            return [words[k] for k in places]
        own = EVALUATED.findall(target or "")
        found = alignment.align(words, own, anchors)
        return [None if found[k] is None else " ".join(own[slice(*found[k])]) for k in places]

    told = {t: spelled(t) for t in {gold, *stages}}
    return [{"pos": k, "abbr": words[k], "context": " ".join(words[max(0, k - 4) : k + 5]), "gold": told[gold][n], "resolutions": [told[t][n] for t in stages]} for n, k in enumerate(places)]


def occurrences(texts: DataFrame, anchors: dict[str, set[str]] | None = None) -> DataFrame:
    """volume, entry, pos, abbr, context, gold, resolutions (of every stage) of the abbreviations of
    entries (volume, entry, source, gold, stages array of texts)."""
    row = "pos int, abbr string, context string, gold string, resolutions array<string>"
    one = pa.struct([("pos", pa.int32()), ("abbr", pa.string()), ("context", pa.string()), ("gold", pa.string()), ("resolutions", pa.list_(pa.string()))])

    @F.arrow_udf(f"array<struct<{row}>>")
    def found_in(sources: pa.Array, golds: pa.Array, stages: pa.Array) -> pa.Array:
        # Some entries at a time: what a task holds as objects does not grow with its batches.
        cuts = [slice(at, at + ENTRIES) for at in range(0, len(sources), ENTRIES)]
        parts = [pa.array([_occurrences_of(*r, anchors) for r in zip(*(x[cut].to_pylist() for x in (sources, golds, stages)))], pa.list_(one)) for cut in cuts]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(one))

    return texts.select("volume", "entry", F.explode(found_in("source", "gold", "stages")).alias("o")).select("volume", "entry", "o.*")


def each_stage(rows: DataFrame) -> DataFrame:
    """A row for each of ``resolutions``, with ``stage``; the columns before them stay."""
    kept = [c for c in rows.columns if c != "resolutions"]
    return rows.select(*kept, F.posexplode("resolutions").alias("k", "resolution")).withColumn("stage", F.col("k") + 1).drop("k")


def aligned_occurrences(texts: DataFrame, anchors: dict[str, set[str]] | None = None) -> DataFrame:
    """The long table of entries (volume, entry, source, gold, stages array of texts), with context."""
    return each_stage(occurrences(texts, anchors))


def abbreviated(resolution: Column) -> Column:
    """Whether any token still ends in a period."""
    return F.exists(F.split(F.trim(resolution), r"\s+"), lambda w: w.endswith("."))


def same_lemma(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """gold, resolution, form: wrong_form, wrong_form? or null of pairs of different phrase keys.

    Words are compared one by one; the index is joined once for each side, so a word with many
    lemmas makes rows, not a product of lists.
    """
    words = lambda c: F.split(F.trim(c), r"\s+")
    pairs = pairs.select("gold", "resolution").distinct()
    even = pairs.where(F.size(words("gold")) == F.size(words("resolution")))
    each = even.select("gold", "resolution", F.posexplode(F.arrays_zip(words("gold").alias("a"), words("resolution").alias("b"))).alias("i", "w"))
    each = each.select("gold", "resolution", "i", text.orthographic_key(F.col("w.a")).alias("a"), text.orthographic_key(F.col("w.b")).alias("b")).where("a <> b")
    distinct = each.select("a", "b").distinct()
    left, right = index.select(F.col("key").alias("a"), "lemma"), index.select(F.col("key").alias("b"), F.col("lemma").alias("lemma_b"))
    shared = distinct.join(left, "a").join(right, "b").where("lemma = lemma_b").select("a", "b").distinct().withColumn("lemma", F.lit(True))
    judged = distinct.join(shared, ["a", "b"], "left").withColumn("how", F.when(F.col("lemma"), 2).when(lexicon.inflectional(F.col("a"), F.col("b")), 1).otherwise(0))
    least = each.join(judged.select("a", "b", "how"), ["a", "b"]).groupBy("gold", "resolution").agg(F.min("how").alias("how"))
    return least.select("gold", "resolution", F.when(F.col("how") == 2, "wrong_form").when(F.col("how") == 1, "wrong_form?").alias("form"))


def _early(gold: Column, own: Column) -> Column:
    """The verdict where no lemma has to be known; null for pairs that the index decides."""
    blank = lambda c: F.trim(c) == ""
    return (
        F.when(gold.isNull(), "unaligned")
        .when(blank(gold) | abbreviated(gold), "no_gold_label")
        .when(own.isNull(), "unaligned")
        .when(blank(own) | abbreviated(own), "not_expanded")
        .when(gold == own, "exact")
        .when(text.phrase_key(gold) == text.phrase_key(own), "orthographic")
    )


def undecided(rows: DataFrame) -> DataFrame:
    """Distinct gold, resolution of rows that only the index can judge."""
    return rows.where(_early(F.col("gold"), F.col("resolution")).isNull()).select("gold", "resolution").distinct()


def judged(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """gold, resolution, verdict of pairs that the index decides: what a later run can read again."""
    own = pairs.select("gold", "resolution").distinct()
    forms = same_lemma(own, index)
    return own.join(forms, ["gold", "resolution"], "left").select("gold", "resolution", F.coalesce("form", F.lit("wrong_word")).alias("verdict"))


def with_verdicts(rows: DataFrame, index: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The long table with ``verdict``; ``known``: pairs that have been judged (:func:`judged`), once
    each, so that only others are."""
    rows = rows.withColumn("early", _early(F.col("gold"), F.col("resolution")))
    open_ = rows.where("early is null")
    if known is None:
        told = same_lemma(open_, index).withColumnRenamed("form", "told")
    else:
        pair = ["gold", "resolution"]
        new = judged(open_.select(*pair).distinct().join(known, pair, "left_anti"), index)
        told = known.select(*pair, "verdict").unionByName(new).withColumnRenamed("verdict", "told")
    out = rows.join(told, ["gold", "resolution"], "left")
    return out.withColumn("verdict", F.coalesce("early", "told", F.lit("wrong_word"))).drop("early", "told")


def _settled(stages: Column, before: Column) -> Column:
    """The stage that settled a resolution, of an array of structs with stage and resolution."""

    def fold(a, s):
        now = F.when(a.step.isNull() & ~abbreviated(s.resolution), s.stage).when(a.step.isNotNull() & (s.resolution != a.before), s.stage).otherwise(a.step)
        return F.when(s.resolution.isNull(), a).otherwise(F.struct(now.cast("int").alias("step"), s.resolution.alias("before")))

    return F.aggregate(stages, F.struct(F.lit(None).cast("int").alias("step"), before.alias("before")), fold).step


def with_steps(rows: DataFrame) -> DataFrame:
    """With ``step``: the stage that settled the resolution, later ones that changed it included.

    An occurrence's rows, one for each stage, are brought together once and taken apart again.
    """
    rest = [c for c in rows.columns if c not in (*OCCURRENCE, "stage")]
    per = rows.groupBy(*OCCURRENCE).agg(F.array_sort(F.collect_list(F.struct("stage", *rest))).alias("stages"))
    steps = per.select(*OCCURRENCE, "stages", _settled(F.col("stages"), F.get("stages", 0).abbr).alias("step"))
    return steps.select(*OCCURRENCE, F.explode("stages").alias("s"), "step").select(*[c if c in OCCURRENCE else f"s.{c}" for c in rows.columns], "step")


def settled(rows: DataFrame) -> DataFrame:
    """Occurrences or facts (abbr, resolutions) with ``step``, as :func:`with_steps` has it: where a row
    still has every stage, nothing has to be brought together."""
    numbered = F.transform("resolutions", lambda r, k: F.struct((k + 1).alias("stage"), r.alias("resolution")))
    return rows.withColumn("step", _settled(numbered, F.col("abbr")))


def facts(rows: DataFrame) -> DataFrame:
    """abbr, gold, resolutions, step, n of occurrences (abbr, gold, resolutions: one for each stage, and
    perhaps n).

    Occurrences are counted before they leave their task, and nothing is brought together to find
    the step: what every stage made of a fact is one of its keys.  They become a table: reports read
    them several times, each for other columns, and texts would be read as often.
    """
    return shared.settled(settled(rows.groupBy(*FACT).agg(F.sum(_weight(rows)).alias("n"))))


def judged_facts(own: DataFrame, index: DataFrame, known: DataFrame | None = None, only: int | None = None) -> DataFrame:
    """:func:`facts` with stage, resolution, verdict: a row for each fact and stage, or for one stage alone."""
    rows = each_stage(own.withColumn("all", F.col("resolutions"))).withColumnRenamed("all", "resolutions")
    return with_verdicts(rows if only is None else rows.where(F.col("stage") == only), index, known)


def scored_facts(rows: DataFrame, index: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """abbr, gold, resolutions, step, n, stage, resolution, verdict: a row for each fact and stage."""
    return judged_facts(facts(rows), index, known)


def _weight(scored: DataFrame) -> Column:
    """How many occurrences a row stands for: ``n`` of a fact, else one."""
    return F.col("n") if "n" in scored.columns else F.lit(1).cast("long")


def _keys(scored: DataFrame) -> list[str]:
    return FACT if "resolutions" in scored.columns else OCCURRENCE


def _share(good: Column, of: Column) -> Column:
    return F.when(of == 0, 0.0).otherwise(good / of)


def _counted(rows: Column, which: Column) -> Column:
    return F.coalesce(F.sum(F.when(which, rows)), F.lit(0).cast("long"))


def _rates(rows: Column) -> list[Column]:
    """Counts and shares of verdicts; ``rows``: how many occurrences a row stands for."""
    counted = lambda which: _counted(rows, which)
    among = lambda names: counted(F.col("verdict").isin(names))
    n = among(SCOREABLE)
    return [
        counted(F.lit(True)).alias("occurrences"),
        n.alias("scoreable"),
        _share(among([v for v in SCOREABLE if v != "not_expanded"]), n).alias("expanded"),
        _share(among(WORD), n).alias("word_accuracy"),
        _share(among(FORM), n).alias("form_accuracy"),
        among(["no_gold_label"]).alias("no_gold_label"),
    ]


def by_stage(scored: DataFrame) -> DataFrame:
    return scored.groupBy("stage").agg(*_rates(_weight(scored)))


def by_step(scored: DataFrame) -> DataFrame:
    """Rates of the last stage's resolutions by the step that settled them."""
    last = scored.where(F.col("stage") == F.lit(max(STEPS)))
    return last.where("step is not null").groupBy("step").agg(*_rates(_weight(scored)))


def by_abbreviation(scored: DataFrame) -> DataFrame:
    """Rates of the last stage, the most frequent wrong resolution, up to five golds, and the gain left."""
    last = scored.where(F.col("stage") == F.lit(max(STEPS)))
    # Counted once by all that is asked about; what follows shares that exchange.
    counts = last.groupBy("abbr", F.coalesce("gold", F.lit("")).alias("gold"), "resolution", "verdict").agg(F.sum(_weight(scored)).alias("n"))
    golds = counts.groupBy("abbr", "gold").agg(F.sum("n").alias("n"))
    golds = golds.withColumn("k", F.row_number().over(Window.partitionBy("abbr").orderBy("gold"))).where(F.col("k") <= GOLDS)
    listed = golds.groupBy("abbr").agg(F.array_join(F.array_sort(F.collect_list("gold")), ", ").alias("gold_variants"))
    sums = counts.groupBy("abbr").agg(*_rates(F.col("n"))).join(listed, "abbr")
    wrong = counts.where(F.col("verdict").isin("wrong_word", "wrong_form", "wrong_form?")).groupBy("abbr", "resolution").agg(F.sum("n").alias("n"))
    mode = wrong.groupBy("abbr").agg(F.min(F.struct((-F.col("n")).alias("n"), "resolution")).alias("m")).select("abbr", F.col("m.resolution").alias("most_frequent_error"))
    out = sums.join(mode, "abbr", "left").withColumn("most_frequent_error", F.coalesce("most_frequent_error", F.lit("")))
    rounded = {c: F.round(c, 4) for c in ("word_accuracy", "form_accuracy")}
    out = out.withColumns(rounded)
    out = out.drop("occurrences", "expanded").withColumnRenamed("scoreable", "occurrences")
    return out.withColumn("potential_gain", F.round(F.col("occurrences") * (1 - F.col("form_accuracy")), 4))


def covered(scored: DataFrame, candidates: DataFrame, index: DataFrame) -> DataFrame:
    """Keys, step, own, n, covered: whether any candidate (abbr, step, candidate) would have been right.

    Candidates are judged once for each gold of their abbreviation, however often it occurs.
    """
    keys = _keys(scored)
    last = scored.where(F.col("stage") == F.lit(max(STEPS))).where(F.col("verdict").isin(SCOREABLE) & F.col("step").isNotNull())
    last = last.select(*keys, *[c for c in ("abbr", "gold") if c not in keys], "step", F.col("verdict").alias("own"), _weight(scored).alias("n"))
    listed = candidates.select("abbr", "step", F.col("candidate").alias("resolution")).distinct()
    pairs = last.select("abbr", "step", "gold").distinct().join(listed, ["abbr", "step"])
    told = with_verdicts(pairs, index).groupBy("abbr", "step", "gold").agg(F.max(F.col("verdict").isin(WORD)).alias("covered"))
    return last.join(told, ["abbr", "step", "gold"]).select(*keys, "step", "own", "n", "covered")


def candidate_summary(scored: DataFrame, candidates: DataFrame, index: DataFrame) -> DataFrame:
    """For each step: how often a right candidate was offered, and how often it was then chosen."""
    right, there = F.col("own").isin(WORD), F.col("covered")
    counted = lambda which: _counted(F.col("n"), which)
    sums = covered(scored, candidates, index).groupBy("step").agg(
        F.sum("n").alias("offered"),
        counted(there).alias("n_covered"),
        counted(there & right).alias("chosen"),
        counted(~there & ~right).alias("candidate_misses"),
        counted(~there & right).alias("beyond"),
    )
    return sums.withColumns({"ceiling": _share(F.col("n_covered"), F.col("offered")), "choice_accuracy": _share(F.col("chosen"), F.col("n_covered"))})


def worst_misses(scored: DataFrame, candidates: DataFrame, index: DataFrame, most: int = 5) -> DataFrame:
    """step, rank, abbr, n: abbreviations for which most often nothing right was offered or found."""
    told = covered(scored, candidates, index).where(~F.col("covered") & ~F.col("own").isin(WORD))
    if "abbr" not in told.columns:
        names = scored.where(F.col("stage") == F.lit(max(STEPS))).select(*OCCURRENCE, "abbr")
        told = told.join(names, OCCURRENCE)
    counts = told.groupBy("step", "abbr").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("step").orderBy(F.desc("n"), "abbr"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most).select("step", "rank", "abbr", "n")


def mismatches(scored: DataFrame, candidates: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """Occurrences that the last stage did not get exactly, with what every stage made of them.

    With candidates (abbr, step, candidate) also what the deciding step had to choose from, and
    whether nothing of it would have been right (candidate_miss; null without a list).
    """
    last, earlier = max(STEPS), [k for k in STEPS if k != max(STEPS)]
    at = lambda k, c: F.max(F.when(F.col("stage") == k, F.col(c)))
    columns = [at(last, "resolution").alias("system"), at(last, "verdict").alias("verdict")]
    for k in earlier:
        columns += [at(k, "resolution").alias(f"resolution_{k}"), at(k, "verdict").alias(f"verdict_{k}")]
    keys = [*OCCURRENCE, "abbr", "gold", "step", *(c for c in scored.columns if c == "context")]
    out = scored.groupBy(*keys).agg(*columns).where("verdict <> 'exact'")
    if candidates is None:
        return out
    lists = candidates.groupBy("abbr", "step").agg(F.array_join(F.array_sort(F.collect_set("candidate")), "; ").alias("candidates"))
    told = covered(scored, candidates, index).select(*OCCURRENCE, (~F.col("covered")).alias("candidate_miss"))
    return out.join(lists, ["abbr", "step"], "left").join(told, OCCURRENCE, "left")


def without_gold_errors(rows: DataFrame, errors: DataFrame) -> DataFrame:
    """Without occurrences (volume, entry, abbr, gold) known to be wrong in the gold; stale ones raise."""
    keys = ["volume", "entry", "abbr", "gold"]
    stale = errors.select(*keys).distinct().join(rows.select(*keys).distinct(), keys, "left_anti").limit(5).collect()
    if stale:
        raise ValueError(f"known gold errors that match nothing: {[tuple(r) for r in stale]}")
    return rows.join(errors.select(*keys).distinct(), keys, "left_anti")


def headline(scored: DataFrame) -> DataFrame:
    """stage and accuracies with six decimals: what a baseline keeps."""
    return by_stage(scored).select("stage", F.round("word_accuracy", 6).alias("word_accuracy"), F.round("form_accuracy", 6).alias("form_accuracy"))


def baseline_difference(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """stage, and percentage points of word and form accuracy won since a baseline."""
    old = baseline.select("stage", F.col("word_accuracy").alias("w"), F.col("form_accuracy").alias("f"))
    points = lambda a, b: F.round(100 * (F.col(a) - F.col(b)), 4)
    return now.join(old, "stage").select("stage", points("word_accuracy", "w").alias("word_points"), points("form_accuracy", "f").alias("form_points"))


def compared_runs(runs: list[DataFrame]) -> DataFrame:
    """run, stage, accuracies of the last stage that each run (run, stage, word_accuracy, form_accuracy) reached."""
    both = reduce(DataFrame.unionByName, runs)
    last = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("stage")))
    return both.withColumn("k", last).where("k = 1").drop("k").orderBy(F.desc("form_accuracy"), F.desc("word_accuracy"), "run")


def step_section(outputs: DataFrame, step: int) -> DataFrame:
    """run, output, accuracy, gained of a step: a row for each file written, however many runs list it.

    ``outputs``: run, step, input, output, word_accuracy, form_accuracy.  What is gained is
    against the file that was read, wherever that was scored, else the run's step before.
    """
    measure = F.when(F.lit(step == 4), F.col("form_accuracy")).otherwise(F.col("word_accuracy"))
    scored = outputs.withColumn("accuracy", measure)
    own = scored.where(F.col("step") == step)
    once = F.row_number().over(Window.partitionBy("output").orderBy("run"))
    own = own.withColumn("k", once).where("k = 1").drop("k")
    files = scored.groupBy("output").agg(F.max("accuracy").alias("read")).withColumnRenamed("output", "file")
    before = scored.where(F.col("step") == step - 1).groupBy("run").agg(F.max("accuracy").alias("before")).withColumnRenamed("run", "of")
    out = own.join(files, own.input == files.file, "left").join(before, own.run == before.of, "left")
    return out.select("run", "output", "accuracy", F.round(F.col("accuracy") - F.coalesce("read", "before"), 6).alias("gained"))


def effort(rows: DataFrame) -> DataFrame:
    """One row of sums and spreads of (seconds, tries, server_retries, readable).

    The median is found by counting ranges of values, in passes over ``rows``.
    """
    return rows.agg(
        F.count("*").alias("vitae"),
        F.sum("seconds").alias("total"),
        F.avg("seconds").alias("mean"),
        F.lit(ordered.median(rows, "seconds")).cast("double").alias("median"),
        F.max("seconds").alias("worst"),
        F.sum("server_retries").cast("long").alias("server_retries"),
        F.count_if(F.col("tries") > 1).alias("asked_again"),
        F.count_if(~F.col("readable")).alias("unreadable"),
    )


def tiers(details: DataFrame) -> DataFrame:
    """tier, n of how answers were taken."""
    return details.groupBy("tier").agg(F.count("*").alias("n"))


def error_kinds(errors: DataFrame) -> DataFrame:
    """kind, n: errors by what stands before their colon."""
    return errors.select(F.split("message", ":")[0].alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
