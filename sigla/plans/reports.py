"""Reports as markdown: a few aggregated rows each, put together on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rules, scan, score, tei
from ..sources.tables import markdown


def percent(column: str):
    return F.concat(F.format_number(100 * F.col(column), 1), F.lit(" %")).alias(column)


def resolution(before: DataFrame, after: DataFrame, listed: DataFrame, glossary: DataFrame, *columns: str, most: int = 20) -> str:
    """What the rules did, by volume, and what is left although the dictionary knows it."""
    totals = scan.counted_before_and_after(before, after, *columns)
    left = scan.abbreviation_counts(after, *columns)
    known = scan.known_but_left(left, glossary.select(F.col("abbr").alias("abbreviation")))
    parts = [
        markdown(totals.orderBy("volume"), "Abbreviations by volume"),
        markdown(rules.per_volume(listed).orderBy("volume"), "Rules by volume"),
        markdown(scan.top(left.where("parts = 1"), "n", "abbreviation", most), "Most frequent, one part"),
        markdown(scan.top(left.where("parts > 1"), "n", "abbreviation", most), "Most frequent, several parts"),
        markdown(scan.top(known, "n", "abbreviation", most), "Still standing although known"),
    ]
    return "\n".join(parts)


def preview(decisions: DataFrame, most: int = 3) -> str:
    """What a step would ask: entries, marks and candidates, and the first prompts."""
    asked = F.col("prompt").isNotNull()
    offers = F.map_values("candidates")
    counts = decisions.agg(
        F.count("*").alias("entries"),
        F.count_if(asked).alias("asked about"),
        F.coalesce(F.sum(F.size("candidates")), F.lit(0)).alias("abbreviations"),
        F.coalesce(F.sum(F.size(F.filter(offers, lambda c: F.size(c) == 0))), F.lit(0)).alias("without candidates"),
        F.coalesce(F.sum(F.length("prompt")), F.lit(0)).alias("characters of prompts"),
    )
    shown = [f"{r.volume}/{r.entry}:\n\n{r.prompt}" for r in decisions.where(asked).orderBy("volume", "entry").limit(most).collect()]
    return "\n\n".join([markdown(counts, "Preview"), *shown])


def extraction(log: DataFrame, most: int = 200) -> str:
    """What the stages of a dictionary did, counted and then listed."""
    log = log.persist()  # all stages of a dictionary are behind each of its rows
    try:
        counts = log.groupBy("stage").agg(F.count("*").alias("n")).orderBy("stage")
        parts = [markdown(counts, "Decisions")]
        for r in counts.collect():  # a row for each stage
            own = log.where(F.col("stage") == r.stage).select("abbr", "resolution", "detail").orderBy("abbr", "resolution", "detail")
            parts.append(markdown(own, r.stage.capitalize(), most))
        return "\n".join(parts)
    finally:
        log.unpersist()


def evaluation(scored: DataFrame, candidates: DataFrame, index: DataFrame, baseline: DataFrame | None = None, most: int = 20) -> str:
    """Rates by stage, by deciding step, of candidates, and where most is to be won."""
    rates = ("expanded", "word_accuracy", "form_accuracy")
    by_stage = score.by_stage(scored).orderBy("stage").select("stage", "scoreable", *map(percent, rates), "no_gold_label")
    by_step = score.by_step(scored).orderBy("step").select("step", "scoreable", *map(percent, rates[1:]))
    gains = score.by_abbreviation(scored).orderBy(F.desc("potential_gain"), "abbr").limit(most)
    parts = [
        markdown(by_stage, "Stages"),
        markdown(by_step, "Deciding steps"),
        markdown(score.candidate_summary(scored, candidates, index).orderBy("step"), "Candidates"),
        markdown(score.worst_misses(scored, candidates, index).orderBy("step", "rank"), "Most frequent candidate misses"),
        markdown(gains, "Potential gains"),
    ]
    if baseline is not None:
        parts.append(markdown(score.baseline_difference(score.headline(scored), baseline).orderBy("stage"), "Against the baseline"))
    return "\n".join(parts)


def step(decisions: DataFrame) -> str:
    """Effort, tiers, errors and the most frequent choices of a step's decisions."""
    details = decisions.select(F.explode("details").alias("d")).select("d.*")
    errors = decisions.select(F.explode("errors").alias("message"))
    chosen = details.where("resolution is not null").groupBy("abbreviation", "resolution").agg(F.count("*").alias("n"))
    parts = [
        markdown(score.effort(decisions.select("effort.*")), "Effort"),
        markdown(score.tiers(details).orderBy("tier"), "Answers"),
        markdown(score.error_kinds(errors).orderBy(F.desc("n"), "kind"), "Errors"),
        markdown(chosen.orderBy(F.desc("n"), "abbreviation", "resolution").limit(20), "Choices"),
    ]
    return "\n".join(parts)


def markup(rows: DataFrame) -> str:
    return markdown(tei.report(rows).orderBy("status"), "Markup")
