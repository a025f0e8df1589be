"""The steps that choose: what is offered, who chooses, what is accepted, what comes out.

A chooser gets a batch of requests and answers each with a string; it never returns text.  The
answers are parsed and judged against what was offered, so any chooser can be put in.  A request
that fails fails alone: its entry carries the failure, stays as it is, and is left to the next run.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import NamedTuple, Protocol

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import alignment, answers, matching, spans
from ..operators import candidates as offers
from ..operators import lexicon, scan, vita
from ..sources import tables
from .models import Model, ThinkingUnsupported, worth_another
from .stopping import Interrupted, Stopping

ATTEMPTS = 5
#: Requests that a chooser gets at a time.
BATCH = 32
EFFORT = "tries int, server_retries int, readable boolean, seconds double"
DETAIL = "id int, abbreviation string, resolution string, tier string"
RESULT = f"volume long, entry long, text string, processed string, prompt string, candidates map<string, array<string>>, choices map<string, string>, details array<struct<{DETAIL}>>, errors array<string>, effort struct<{EFFORT}>, failure string"
_DETAIL = pa.struct([("id", pa.int32()), ("abbreviation", pa.string()), ("resolution", pa.string()), ("tier", pa.string())])
_EFFORT = pa.struct([("tries", pa.int32()), ("server_retries", pa.int32()), ("readable", pa.bool_()), ("seconds", pa.float64())])
#: What a decision adds to its entry, as Arrow has it.
_MADE = pa.schema([("processed", pa.string()), ("prompt", pa.string()), ("candidates", pa.map_(pa.string(), pa.list_(pa.string()))), ("choices", pa.map_(pa.string(), pa.string())), ("details", pa.list_(_DETAIL)), ("errors", pa.list_(pa.string())), ("effort", _EFFORT), ("failure", pa.string())])
#: Entries are taken out of a batch in slices of so many, or of about so many bytes of text: what a
#: task holds as objects does not grow with its batches.
SLICE, SLICE_BYTES = 8 * BATCH, 1 << 20
#: What every step says about its texts and its answers.
SETTING = "The texts are summaries of late medieval church records in Latin, full of abbreviations. Marked places look like [[number|word]]. Judge each by its own sentence: case, number and gender follow from the words around it."
ANSWER = "Answer with one JSON object whose keys are the numbers, as strings, and whose values are strings. No other text."
TASKS = {
    2: "Choose one of the candidates for every marked abbreviation. Use a candidate exactly as it is listed, even where its form would have to change.",
    3: "Expand every marked abbreviation to one word that starts with its letters. Candidates from other texts are listed, most frequent first; any other word that goes on with the abbreviation's letters may be given too. Answer SKIP for names, and where you cannot tell.",
    4: "Choose the form of every marked word that its sentence asks for, among the forms listed. Repeat the word itself where it is right as it stands.",
}


class Request(NamedTuple):
    step: int
    text: str
    occurrences: list[spans.Occurrence]
    candidates: dict[str, list[str]]
    prompt: str
    attempt: int

    @property
    def system(self) -> str:
        return "\n\n".join([SETTING, TASKS[self.step], ANSWER])


class Chooser(Protocol):
    """Answers to requests, in order; in place of one that failed, its exception."""

    def choose(self, requests: list[Request]) -> list[str | Exception]: ...


class FirstCandidate:
    """The first of what is offered; as lists are ranked by count, the most frequent in steps 3 and 4."""

    def choose(self, requests: list[Request]) -> list[str]:
        return [json.dumps({str(o.id): r.candidates[o.abbreviation][0] for o in r.occurrences if r.candidates.get(o.abbreviation)}) for r in requests]


class Scripted:
    """Given answers, one after the other, for each text."""

    def __init__(self, given: dict[str, list[str]], otherwise: str = "{}"):
        self.given, self.otherwise = given, otherwise

    def choose(self, requests: list[Request]) -> list[str]:
        found = (self.given.get(r.text, []) for r in requests)
        return [own[min(r.attempt, len(own)) - 1] if own else self.otherwise for r, own in zip(requests, found)]


class Replay(Scripted):
    """Answers recorded before, by text; a text without one stays as it is."""

    def __init__(self, recorded: dict[str, str]):
        super().__init__({t: [a] for t, a in recorded.items()})


@dataclass
class Asking:
    """A chooser that asks a model (or anything else with ``ask``), several requests at a time.

    It must run in one place (see ``one_caller``): a limiter on each executor would multiply the
    budget of calls.
    """

    model: Model
    workers: int = 1
    repeated: tuple[int, ...] = ()

    def _one(self, request: Request) -> tuple[str | Exception, int]:
        try:
            return self.model.ask(request.system, request.prompt)
        except ThinkingUnsupported:  # every other request would fail alike
            raise
        except Exception as error:
            return error, self.model.again if worth_another(error) else 0

    def choose(self, requests: list[Request]) -> list[str | Exception]:
        with ThreadPoolExecutor(self.workers) as pool:
            got = list(pool.map(self._one, requests))
        self.repeated = tuple(n for _, n in got)
        return [answer for answer, _ in got]


class NotAsked(Exception):
    """A request that was left to the next run."""


@dataclass
class Until:
    """A chooser that is asked nothing more from a time on (as of ``time.time``)."""

    chooser: Chooser
    until: float
    repeated: tuple[int, ...] = ()

    def choose(self, requests: list[Request]) -> list[str | Exception]:
        self.repeated = ()
        if time.time() >= self.until:
            return [NotAsked("the step's time was up")] * len(requests)
        got = self.chooser.choose(requests)
        self.repeated = getattr(self.chooser, "repeated", ())
        return got


class Preview:
    """Asks nobody, so what would be asked can be looked at."""

    def choose(self, requests: list[Request]) -> list[Exception]:
        return [NotAsked("a preview")] * len(requests)


def one_caller(entries: DataFrame) -> DataFrame:
    """Entries in one partition, for a chooser with one budget of calls for all; it waits anyway."""
    return entries.coalesce(1)


def prompt_of(step: int, text: str, occurrences, listed: dict[str, list[str]]) -> str:
    """The marked text, and what is offered for each mark."""
    rows = [f"- [[{o.id}]] {o.matched}: {', '.join(listed.get(o.abbreviation) or []) or '(none)'}" for o in occurrences]
    return "\n\n".join([spans.mark(text, occurrences), "\n".join(rows)])


def prompt_digest(step: int) -> str:
    return hashlib.sha1("\n\n".join([SETTING, TASKS[step], ANSWER]).encode()).hexdigest()


class _Work:
    """An entry that is being decided on."""

    def __init__(self, step: int, text: str, occurrences, listed):
        self.step, self.text, self.occurrences, self.listed = step, text, occurrences, listed
        self.prompt = prompt_of(step, text, occurrences, listed) if occurrences else None
        self.judged, self.why, self.failure = None, None, None
        self.tries = self.repeated = 0
        self.seconds = 0.0

    def open(self, attempts: int) -> bool:
        return bool(self.occurrences) and self.judged is None and self.failure is None and self.tries < attempts

    def take(self, answer: str | Exception, repeated: int, seconds: float) -> None:
        self.seconds += seconds
        self.repeated += repeated
        if isinstance(answer, Exception):
            self.failure = f"{type(answer).__name__}: {answer}"
        else:
            self.judged, self.why = answers.judge(self.step, answer, self.occurrences, self.listed)

    def result(self) -> dict:
        judged = self.judged or answers.Judged({}, [], [self.why] if self.why else [])
        return {
            "processed": spans.substitute(self.text, self.occurrences, judged.choices),
            "prompt": self.prompt,
            "candidates": {a: self.listed.get(a) or [] for a in dict.fromkeys(o.abbreviation for o in self.occurrences)},
            "choices": {str(k): v for k, v in judged.choices.items()},
            "details": judged.details,
            "errors": judged.errors,
            "effort": {"tries": self.tries, "server_retries": self.repeated, "readable": self.why is None and self.failure is None, "seconds": self.seconds},
            "failure": self.failure,
        }


def _answers(chooser: Chooser, requests: list[Request]) -> list[str | Exception]:
    """The chooser's answers; if it gives up on a batch, each request is put to it alone."""
    try:
        got = list(chooser.choose(requests))
    except ThinkingUnsupported:
        raise
    except Exception as error:
        return [error] if len(requests) == 1 else [a for r in requests for a in _answers(chooser, [r])]
    if len(got) != len(requests):
        raise ValueError(f"{len(got)} answers to {len(requests)} requests")
    return got


def asked(step: int, chooser: Chooser, items: list[tuple[str, list, dict]], attempts: int = ATTEMPTS) -> list[dict]:
    """Decisions on (text, occurrences, candidates): asked again while an answer cannot be read.

    A text without occurrences is not asked about.
    """
    works = [_Work(step, *item) for item in items]
    while pending := [w for w in works if w.open(attempts)]:
        for at in range(0, len(pending), BATCH):
            part, began = pending[at : at + BATCH], time.monotonic()
            for w in part:
                w.tries += 1
            got = _answers(chooser, [Request(step, w.text, w.occurrences, w.listed, w.prompt, w.tries) for w in part])
            repeated = getattr(chooser, "repeated", ()) or [0] * len(part)
            each = (time.monotonic() - began) / len(part)
            for w, answer, again in zip(part, got, [*repeated, *[0] * len(part)]):
                w.take(answer, again, each)
    return [w.result() for w in works]


def _slices(*texts: pa.Array) -> Iterator[slice]:
    """Rows of a batch, some at a time, by their number and the bytes of its ``texts``."""
    sizes = [sum(n or 0 for n in row) for row in zip(*(pa.compute.binary_length(t).to_pylist() for t in texts))]
    start = held = 0
    for i, n in enumerate(sizes, 1):
        held += n
        if held >= SLICE_BYTES or i - start == SLICE:
            yield slice(start, i)
            start, held = i, 0
    if start < len(sizes):
        yield slice(start, len(sizes))


def _as_listed(text: str, where: list[dict] | None, listed: dict) -> list[spans.Occurrence] | None:
    return None if where is None else spans._rows(where)


def _pieces(script: str) -> Column:
    """A script as lists of its fields, with the lengths of its gaps in place of their text: lists
    of plain values are much faster to take out of a batch than a list of structs."""
    each = lambda of: F.transform(script, of)
    return F.struct(each(lambda e: F.length(e.gap)).alias("gaps"), each(lambda e: e.old).alias("olds"), each(lambda e: e.new).alias("news"))


def _in_pieces(text: str, where: dict, listed: dict) -> list[spans.Occurrence]:
    """What :func:`edits.occurrences` tells of a script, which :func:`_pieces` has taken apart."""
    out, at = [], 0
    for gap, old, new in zip(where["gaps"], where["olds"], where["news"]):
        at += gap
        if old or new:
            out.append(spans.Occurrence(len(out) + 1, new, old, at, at + len(old)))
        at += len(old)
    return out


def _put_in(text: str, where: str | None, listed: dict) -> list[spans.Occurrence] | None:
    """Words of a lexicon that stand in a text in the place of others in the original, ``where``."""
    found = alignment.inserted_spans(where or "", text)
    return None if found is None else spans.locate_words(text, listed, found)


def chosen(entries: DataFrame, step: int, chooser: Chooser, attempts: int = ATTEMPTS, where: str = "occurrences", located: Callable = _as_listed) -> DataFrame:
    """Decisions for entries (volume, entry, text, occurrences, candidates).

    A null list of occurrences means that the entry must not be touched (its alignment failed).
    In place of a list, ``where`` can name what ``located`` reads the occurrences off, given an
    entry's text, that column and the candidates: a task then has one Python worker, not two.
    """
    own = entries.select(F.col("volume").cast("long"), F.col("entry").cast("long"), "text", F.col(where).alias("where"), "candidates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in _slices(*(batch.column(c) for c in ("text", "where") if pa.types.is_string(batch.column(c).type))):
                part = batch.slice(cut.start, cut.stop - cut.start)
                given = part.select(["text", "where", "candidates"]).to_pylist()
                listed = [dict(r["candidates"] or []) for r in given]
                found = [located(r["text"] or "", r["where"], c) for r, c in zip(given, listed)]
                rows = asked(step, chooser, [(r["text"] or "", f or [], c) for r, f, c in zip(given, found, listed)], attempts)
                for row, f in zip(rows, found):
                    if f is None:
                        row["errors"] = ["Alignment failed: the text was not made by substitution alone"]
                made = pa.RecordBatch.from_pylist(rows, _MADE)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *made.columns], names=[*part.schema.names[:3], *_MADE.names])

    return own.mapInArrow(run, RESULT)


def step2(texts: DataFrame, glossary: DataFrame, chooser: Chooser) -> DataFrame:
    """Choose among the dictionary's candidates."""
    found = offers.with_occurrences(texts, offers.of_entries(texts, glossary))
    return chosen(found.withColumn("pieces", _pieces("found")), 2, chooser, where="pieces", located=_in_pieces)


def step3(texts: DataFrame, corpus: DataFrame, chooser: Chooser) -> DataFrame:
    """Choose among corpus words that go on where an abbreviation stops."""
    found = texts.withColumn("found", matching.remaining(F.col("text"))).withColumn("pieces", _pieces("found"))
    own = scan.remaining(texts, *vita.KEY).select(*vita.KEY, "abbreviation").distinct()
    mined = scan.mined_candidates(own, scan.vocabulary(corpus))
    listed = mined.groupBy("abbreviation").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "candidate"))), lambda c: c.candidate).alias("c"))
    maps = own.join(listed, "abbreviation").groupBy("volume", "entry").agg(F.map_from_entries(F.collect_list(F.struct("abbreviation", "c"))).alias("candidates"))
    return chosen(found.join(maps, vita.KEY, "left"), 3, chooser, where="pieces", located=_in_pieces)


def step4(texts: DataFrame, originals: DataFrame, entries: DataFrame, corpus: DataFrame, chooser: Chooser) -> DataFrame:
    """Choose the form of words that were put in, among their paradigms by corpus count."""
    ranked = lexicon.ranked_forms(lexicon.lexicon(entries), scan.vocabulary(corpus))
    pairs = ranked.groupBy("word").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "form"))), lambda c: c.form).alias("forms"))
    # Words are looked up where they are read: all words of all texts are never shuffled.  The lexicon is as large as a dictionary.
    words = texts.select(*vita.KEY, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?U)\b([A-Za-z]+)\b"), 1))).alias("word"))
    own = words.join(F.broadcast(pairs), "word").groupBy(*vita.KEY).agg(F.map_from_entries(F.collect_set(F.struct("word", "forms"))).alias("candidates"))
    both = texts.join(originals.select(*vita.KEY, F.col("text").alias("original")), vita.KEY).join(own, vita.KEY, "left")
    return chosen(both, 4, chooser, where="original", located=_put_in)


def assembled(stage: DataFrame, decisions: DataFrame) -> DataFrame:
    """The next stage (volume, entry, text): processed texts, and entries that were not among them.

    Decisions are read once, so a step that has not been written is not worked out again.
    """
    done = decisions.select(*vita.KEY, F.col("processed").alias("text"), F.lit(True).alias("done"))
    rows = done.unionByName(stage.select(*vita.KEY, "text", F.lit(False).alias("done")))
    decided = F.max("done").over(Window.partitionBy(*vita.KEY)) & F.col("volume").isNotNull() & F.col("entry").isNotNull()
    return rows.withColumn("decided", decided).where("done or not decided").select(*vita.KEY, "text")


def resumed(work: DataFrame, done: DataFrame, process: Callable[[DataFrame], DataFrame], limit: int | None = None) -> DataFrame:
    """Decisions of a checkpoint and of what it lacks."""
    return done.unionByName(process(vita.still_to_do(work, done, limit)), allowMissingColumns=True)


class TooManyFailures(Exception):
    """A step was stopped: what it had decided is in its checkpoint."""


def chooser_name(chooser: Chooser, step: int) -> str:
    """Who decides, and what it is told: a checkpoint's decisions by another one are not its own."""
    model = getattr(chooser, "model", None)
    who = f"{model.name} {json.dumps(model.settings, sort_keys=True)}" if model is not None else type(chooser).__name__
    return f"{who} {prompt_digest(step)}"


def worked_off(
    work: DataFrame,
    process: Callable[[DataFrame], DataFrame],
    path: str,
    batches: int = 1,
    most_failures: int | None = None,
    by: str | None = None,
    write: bool = True,
    every: int | None = None,
    until: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Decide on the entries that a checkpoint lacks, batch by batch; decisions, and failures.

    A batch is written to the checkpoint before the next begins, so no answer is lost when a later
    one fails.  Entries that failed are not in it and come again in the next run; a step with more
    than ``most_failures`` of them stops after their batch.  ``by`` names who decides
    (:func:`chooser_name`): only its own decisions count as done.  Without ``write`` nothing goes
    into the checkpoint: what it has, and what would be decided, is returned.

    ``every``: about how many entries a batch has, in place of a number of batches.  An interrupt,
    or the time ``until``, ends the step with :class:`Interrupted` (see :mod:`stopping`); with a
    chooser that minds the time too (:class:`Until`), within its batch.
    """
    spark, failed, left_out = work.sparkSession, 0, 0
    failure = lambda rows: (rows.where("failure is null"), rows.where("failure is not null").select(*vita.KEY, "failure"))
    if not write:
        made = process(vita.still_to_do(work, tables.done_in(spark, path, by)))
        return failure(tables.read_checkpoint(spark, path, RESULT, by).where("failure is null").unionByName(made) if tables._exists(spark, path) else made)
    # Keys only, read once: what is decided below is in other batches than those to come.
    done = tables.done_in(spark, path, by).persist()
    try:
        work = vita.still_to_do(work, done)
        if every is not None:
            batches = max(1, -(-work.select(*vita.KEY).distinct().count() // every))
        kept = f"what was decided is in {path}"
        unasked = F.coalesce(F.col("failure").startswith(f"{NotAsked.__name__}:"), F.lit(False))
        with Stopping(until) as stop:
            for number in range(batches):
                if stop.why:
                    raise Interrupted(f"{stop.why} after {number} of {batches} batches; {kept}")
                told = Observation()
                made = process(work.where(F.pmod(F.xxhash64(*vita.KEY), F.lit(batches)) == number))
                made = made.observe(told, F.count_if(F.col("failure").isNotNull() & ~unasked).alias("n"), F.count_if(unasked).alias("unasked"))
                with stop.batch(kept):
                    tables.append_checkpoint(made.withColumn("decided_by", F.lit(by).cast("string")), path)
                    failed += told.get.get("n") or 0
                    left_out += told.get.get("unasked") or 0
                if most_failures is not None and failed > most_failures:
                    raise TooManyFailures(f"{failed} entries failed; {kept}")
        if left_out:
            raise Interrupted(f"{left_out} entries were not asked about; {kept}")
    finally:
        done.unpersist()
    return failure(tables.read_checkpoint(spark, path, RESULT, by))


def entry_of(run: str, step: int, model: str | None, written: str, output: str, source: str, decisions: DataFrame) -> DataFrame:
    """The manifest row of a finished step."""
    n = decisions.agg(F.count("*").alias("vitae"))
    literals = {"run": run, "step": step, "model": model, "prompt_sha1": prompt_digest(step) if step in TASKS else None, "input": source, "output": output, "written": written}
    return n.select("vitae", *[F.lit(v).cast("int" if k == "step" else "string").alias(k) for k, v in literals.items()])
