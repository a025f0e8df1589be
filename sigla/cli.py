"""The steps from a command line: ``python -m sigla <step> ...``.

Every step reads files, prints its report, and writes only with ``--write``.
"""

from __future__ import annotations

import argparse
import json
import time
from importlib import import_module
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.morphology import Manual
from .operators import candidates, glossary, lexicon, rules, runs, score, tei, vita
from .plans import evaluation, models, reports, steps
from .schema import CLEAN_GLOSSARY
from .sources import tables

DIOCESES = "abbreviation string, resolution string"
SUBSET = "volume long, entry long"


def _json(path: str | None) -> list[dict]:
    return json.loads(Path(path).read_text(encoding="utf-8")) if path else []


def _listed(spark: SparkSession, path: str) -> DataFrame:
    return tables.read_csv(spark, path, CLEAN_GLOSSARY)


def extract(spark: SparkSession, a: argparse.Namespace) -> str:
    """A raw dictionary and a corpus to a glossary; corrections and decisions are JSON lists."""
    edits = [glossary.Correction(**c) for c in _json(a.corrections)]
    docs = vita.to_texts(tables.read_regests(spark, a.corpus)).select("volume", "text")
    out = glossary.extracted(tables.read_raw_glossary(spark, a.raw), docs, edits, _json(a.additions), Manual.of_rows(_json(a.decisions)))
    tables.write_csv(out.glossary, a.out, a.write, one_file=True)
    tables.write_csv(out.review, f"{a.out}-review", a.write, one_file=True)
    return reports.extraction(out.log)


def expand(spark: SparkSession, a: argparse.Namespace) -> str:
    """A corpus by the rules of its volumes."""
    corpus, known = tables.read_regests(spark, a.corpus), _listed(spark, a.glossary)
    listed = rules.by_volume(rules.load(known, tables.read_csv(spark, a.dioceses, DIOCESES)))
    done = rules.expand(corpus, rules.unambiguous(listed))
    tables.write_csv(done, a.out, a.write)
    return reports.resolution(corpus.where(F.col("volume") < 10), done, listed, known, "head_text", "body_text")


def _chooser(a: argparse.Namespace) -> steps.Chooser:
    if a.answers:
        return steps.Replay({r["text"]: r["answer"] for r in _json(a.answers)})
    if not a.sender:
        return steps.FirstCandidate()
    if a.patience <= 0:
        raise ValueError("an answer needs some time: --patience has to be above 0")
    module, name = a.sender.split(":")
    switch = {"on": True, "off": False}.get(a.thinking)
    settings = models.thinking(a.model, switch, None if switch is not None else a.thinking)
    model = models.Model(getattr(import_module(module), name), a.model, settings, a.spacing, patience=a.patience)
    return steps.Asking(model, a.workers)


def step(spark: SparkSession, a: argparse.Namespace) -> str:
    """One of the steps that choose, 2 to 4, over what the one before has written."""
    texts = vita.to_texts(tables.read_regests(spark, a.input))
    work = vita.of_subset(texts, tables.read_csv(spark, a.subset, SUBSET)) if a.subset else texts
    chooser = _chooser(a)
    by = steps.chooser_name(chooser, a.number)
    until = time.time() + a.time_limit if a.time_limit else None
    if a.preview:
        a.write, chooser = False, steps.Preview()
    elif until is not None:
        chooser = steps.Until(chooser, until)
    place = steps.one_caller if a.sender else lambda df: df
    if a.number == 2:
        process = lambda df: steps.step2(place(df), _listed(spark, a.glossary), chooser)
    else:
        corpus = vita.to_texts(tables.read_regests(spark, a.corpus))
        if a.number == 3:
            process = lambda df: steps.step3(place(df), corpus, chooser)
        else:
            entries = _listed(spark, a.glossary).select("resolution", "stem", "declension")
            process = lambda df: steps.step4(place(df), corpus, entries, corpus, chooser)
    if a.limit:
        work = vita.still_to_do(work, tables.done_in(spark, a.checkpoint, by), a.limit)
    if a.preview:
        return reports.preview(process(vita.still_to_do(work, tables.done_in(spark, a.checkpoint, by))))
    done, failures = steps.worked_off(work, process, a.checkpoint, a.batches, a.most_failures, by, a.write, a.every, until)
    stage = vita.to_rows(steps.assembled(texts, done))
    tables.write_csv(stage, a.out, a.write)
    settings = {"step": a.number, "run": a.run, "model": a.model, "prompt_sha1": steps.prompt_digest(a.number), "input": a.input, "written": time.strftime("%Y-%m-%dT%H:%M:%S")}
    tables.write_dump(spark, f"{a.out}-dump", done, a.write, **settings)
    if a.write and a.manifests:
        tables.record_manifest(steps.entry_of(a.run, a.number, a.model, settings["written"], a.out, a.input, done), a.manifests)
    left = tables.markdown(failures.orderBy("volume", "entry"), "Failures")
    return reports.step(done) + ("\n" + left if not failures.isEmpty() else "")


def evaluate(spark: SparkSession, a: argparse.Namespace) -> str:
    """Stages against gold, by stage, by deciding step, and by abbreviation."""
    texts = lambda path: tables.read_vitae(spark, path)
    known = _listed(spark, a.glossary).select("abbr", "resolution", "stem", "declension")
    dioceses = tables.read_csv(spark, a.dioceses, DIOCESES) if a.dioceses else None
    found = evaluation.evaluated(texts(a.source), texts(a.gold), [texts(s) for s in a.stages], known, dioceses)
    offers = candidates.listed_for_volumes(_listed(spark, a.glossary)).select("abbr", F.lit(2).alias("step"), F.col("resolution").alias("candidate")).distinct()
    tables.write_csv(score.by_abbreviation(found), f"{a.out}-by-abbreviation", a.write, one_file=True)
    tables.write_csv(score.mismatches(found), f"{a.out}-mismatches", a.write, one_file=True)
    baseline = tables.read_csv(spark, a.baseline, "stage int, word_accuracy double, form_accuracy double") if a.baseline else None
    return reports.evaluation(found, offers, lexicon.lemma_index(known.select("resolution", "stem", "declension")), baseline)


def markup(spark: SparkSession, a: argparse.Namespace) -> str:
    """A source and its stages as TEI."""
    line = F.coalesce("head_text", "body_text")
    keys = [*vita.KEY, "line_no"]
    rows = tables.read_regests(spark, a.source).select(*keys, "line_id", line.alias("old"))
    for k, path in enumerate(a.stages):
        rows = rows.join(tables.read_regests(spark, path).select(*keys, line.alias(f"stage_{k}")), keys, "left")
    marked = tei.lines(rows, "old", [f"stage_{k}" for k in range(len(a.stages))])
    who = tei.responsible(tables.read_manifests(spark, a.manifests), a.run) if a.manifests else []
    if a.write:
        tei.document_lines(tei.entries(marked), a.title, who).select("value").write.mode("overwrite").text(a.out)
    return reports.markup(marked)


def lineage(spark: SparkSession, a: argparse.Namespace) -> str:
    """What every recorded step was built on."""
    return tables.markdown(runs.lineage(tables.read_manifests(spark, a.manifests)).orderBy("run", "step", "depth"), "Lineage")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="sigla", description=__doc__)
    commands = out.add_subparsers(required=True)

    def command(run, *positional: str, **options) -> argparse.ArgumentParser:
        own = commands.add_parser(run.__name__, help=run.__doc__)
        for name in positional:
            own.add_argument(name, **({"nargs": "+"} if name == "stages" else {"type": int, "choices": (2, 3, 4)} if name == "number" else {}))
        for name, default in options.items():
            own.add_argument(f"--{name.replace('_', '-')}", default=default, **({"type": type(default)} if default is not None else {}))
        own.add_argument("--write", action="store_true", help="write; without it, only the report is made")
        own.set_defaults(run=run)
        return own

    command(extract, "raw", "corpus", "out", corrections=None, additions=None, decisions=None)
    command(expand, "corpus", "glossary", "dioceses", "out")
    own = command(step, "number", "input", "out", "checkpoint", glossary=None, corpus=None, subset=None, answers=None, sender=None, model=None, thinking=None, spacing=4.1, patience=360.0, workers=1, batches=1, time_limit=0.0, limit=0, manifests=None)
    own.add_argument("--run", dest="run_name", default="run")
    own.add_argument("--most-failures", type=int)
    own.add_argument("--every", type=int, help="entries that go into the checkpoint at a time, in place of --batches")
    own.add_argument("--preview", action="store_true", help="tell what would be asked, ask nobody, and write nothing")
    command(evaluate, "source", "gold", "stages", out="evaluation", glossary=None, dioceses=None, baseline=None)
    own = command(markup, "source", "stages", out="tei", title="Entries", manifests=None)
    own.add_argument("--run", dest="run_name", default="run")
    command(lineage, "manifests")
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> str:
    a = parser().parse_args(arguments)
    chosen, a.run = a.run, getattr(a, "run_name", None)
    spark = spark or SparkSession.builder.appName("sigla").getOrCreate()
    try:
        told = chosen(spark, a)
    except (steps.Interrupted, steps.TooManyFailures) as stopped:
        raise SystemExit(str(stopped)) from stopped
    print(told)
    return told
