"""Edit scripts: a text and what became of it, as the pieces that both are made of.

A script is an array of (gap, old, new, steps) in the order of the text: ``gap`` stands in both
texts, then ``old`` in the first where the second has ``new``; ``steps`` names what decided it.  The
last piece may be a gap alone.  All texts, offsets, spans of words and marks are read off a script,
and scripts of successive stages are composed; nothing is aligned again.

Borders of edits are borders of words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .alignment import dealt
from .matching import SCRIPT, let
from .spans import EVALUATED
from .text import TOKEN

LETTERS = r"[A-Za-z]+\.?"
#: A word that is still abbreviated.
ABBREVIATED = r"\.(\s|$)"


def source(script: Column) -> Column:
    """The text before."""
    return F.array_join(F.transform(script, lambda e: F.concat(e.gap, e.old)), "")


def result(script: Column) -> Column:
    """The text after."""
    return F.array_join(F.transform(script, lambda e: F.concat(e.gap, e.new)), "")


def none(text: Column) -> Column:
    """The script of a text that stays as it is."""
    empty = F.lit("")
    return F.array(F.struct(F.coalesce(text, empty).alias("gap"), empty.alias("old"), empty.alias("new"), empty.alias("steps")))


def edited(e: Column) -> Column:
    """Whether a piece is more than a gap."""
    return (e.old != "") | (e.new != "")


#: What stands before a mark within a joined script; texts that hold it are escaped.
_ESC = "\x10"


def merged(script: Column) -> Column:
    """The same script, in which a piece that is a gap alone is part of the next one's gap."""
    put = lambda x: F.replace(x, F.lit(_ESC), F.lit(_ESC + "e"))
    back = lambda x: F.coalesce(F.replace(x, F.lit(_ESC + "e"), F.lit(_ESC)), F.lit(""))
    field = lambda x: F.concat(F.lit(_ESC + "f"), x)
    piece = lambda e: F.when(edited(e), F.concat(put(e.gap), field(put(e.old)), field(put(e.new)), field(put(e.steps)), F.lit(_ESC + "p"))).otherwise(put(e.gap))
    cut = lambda p: let(F.split(p, _ESC + "f", -1), lambda f: F.struct(*[back(F.get(f, F.lit(k))).alias(n) for k, n in enumerate(("gap", "old", "new", "steps"))]))
    return F.transform(F.split(F.array_join(F.transform(script, piece), ""), _ESC + "p", -1), cut)


def within_gaps(script: Column, further: Callable[[Column], Column]) -> Column:
    """A script in which what is left between edits is edited further: ``further`` makes the script
    of a gap, which ends with what follows its last edit.  What has been put in is not looked at."""

    def piece(e: Column) -> Column:
        last = lambda sub: F.element_at(sub, -1).gap.alias("gap")
        own = lambda sub: F.array(F.struct(last(sub), e.old.alias("old"), e.new.alias("new"), e.steps.alias("steps")))
        return let(further(e.gap), lambda sub: F.concat(F.slice(sub, 1, F.size(sub) - 1), own(sub)))

    return F.flatten(F.transform(merged(script), piece))


def running(lengths: Column) -> Column:
    """What stands before each element of an array of whole numbers, as sums."""

    @F.arrow_udf("array<int>")
    def sums(lists: pa.Array) -> pa.Array:
        sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        flat = pa.compute.fill_null(lists.flatten(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        before = np.concatenate([[0], np.cumsum(flat)])
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        own = before[:-1] - np.repeat(before[offsets[:-1]], sizes)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(own, pa.int32()))

    return sums(lengths)


def occurrences(script: Column) -> Column:
    """What a script has found, numbered from 1: ``new`` is the abbreviation that ``old`` matched."""
    lengths = F.transform(script, lambda e: F.length(e.gap) + F.length(e.old))
    place = lambda e, at: F.struct(e.alias("e"), (at + F.length(e.gap)).alias("start"))
    found = F.filter(F.zip_with(script, running(lengths), place), lambda x: edited(x.e))
    row = lambda x, k: F.struct((k + 1).cast("int").alias("id"), x.e.new.alias("abbreviation"), x.e.old.alias("matched"), x.start.cast("int").alias("start"), (x.start + F.length(x.e.old)).cast("int").alias("end"))
    return F.transform(found, row)


def marked(script: Column) -> Column:
    """The text with what was found in numbered marks."""
    before = running(F.transform(script, lambda e: edited(e).cast("int")))
    mark = lambda e, k: F.concat(e.gap, F.when(edited(e), F.concat(F.lit("[["), (k + 1).cast("string"), F.lit("|"), e.old, F.lit("]]"))).otherwise(F.lit("")))
    return F.array_join(F.zip_with(script, before, mark), "")


def _word_starts(text: Column, pattern: str) -> Column:
    """Words of a short text, each with where it starts."""
    words, around = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    size = lambda xs, n: F.aggregate(F.slice(xs, 1, n), F.lit(0), lambda acc, x: acc + F.length(x))
    both = F.struct(words.alias("w"), around.alias("o"))
    return let(both, lambda b: F.transform(b.w, lambda w, k: F.struct((size(b.o, k + 1) + size(b.w, k)).alias("at"), w.alias("word"))))


def inserted(script: Column) -> Column:
    """Spans (start, end) in the text after of the words that were put in; a word's period is not in it."""
    lengths = F.transform(script, lambda e: F.length(e.gap) + F.length(e.new))
    spans = lambda e, at: F.transform(_word_starts(e.new, LETTERS), lambda w: F.struct((at + F.length(e.gap) + w.at).cast("int").alias("start"), (at + F.length(e.gap) + w.at + F.length(F.rtrim(w.word, F.lit(".")))).cast("int").alias("end")))
    return F.flatten(F.zip_with(script, running(lengths), spans))


@lru_cache(maxsize=100_000)
def _dealt(old: str, new: str) -> tuple[tuple[int | None, int | None], ...]:
    source_, target = EVALUATED.findall(old), EVALUATED.findall(new)
    return tuple(s or (None, None) for s in dealt(source_, target, {}))


def _spans_within(olds: Column, news: Column) -> Column:
    """For each edit the spans of new words that its old words stand for: the same for equal edits,
    of which there are as many as a dictionary has."""

    @F.arrow_udf("array<array<struct<start int, end int>>>")
    def spans(old: pa.Array, new: pa.Array) -> pa.Array:
        rows = [[[{"start": s, "end": e} for s, e in _dealt(a, b)] for a, b in zip(x or [], y or [])] for x, y in zip(old.to_pylist(), new.to_pylist())]
        return pa.array(rows, pa.list_(pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))

    return spans(olds, news)


def aligned(script: Column) -> Column:
    """Each word of the text before, with its span of words of the text after (nulls: none can be
    told) and their text."""
    words = lambda t: F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))
    pieces = F.transform(script, lambda e: F.struct(words(e.gap).alias("gap"), words(e.old).alias("old"), words(e.new).alias("new")))
    before = running(F.transform(pieces, lambda p: F.size(p.gap) + F.size(p.new)))
    within = _spans_within(F.transform(script, lambda e: e.old), F.transform(script, lambda e: e.new))
    row = lambda token, start, end, text: F.struct(token.alias("token"), start.cast("int").alias("start"), end.cast("int").alias("end"), text.alias("text"))

    def each(p: Column, at: Column, dealt_: Column) -> Column:
        same = F.transform(p.gap, lambda t, k: row(t, at + k, at + k + 1, t))
        base = at + F.size(p.gap)
        span = lambda k: F.get(dealt_, k)
        put = F.transform(p.old, lambda t, k: row(t, base + span(k).start, base + span(k).end, F.when(span(k).start.isNotNull(), F.array_join(F.slice(p.new, span(k).start + 1, span(k).end - span(k).start), " "))))
        return F.concat(same, put)

    both = F.zip_with(before, within, lambda a, d: F.struct(a.alias("at"), d.alias("dealt")))
    return F.flatten(F.zip_with(pieces, both, lambda p, b: each(p, b.at, b.dealt)))


@lru_cache(maxsize=100_000)
def _put_in(old: str, new: str) -> tuple[list[str], list[int | None], list[int | None], list[str | None], int]:
    """An edit's old words, where each starts and ends among the new ones, their text, and how many are new."""
    spans, words = _dealt(old, new), EVALUATED.findall(new)
    texts = [None if s is None else " ".join(words[s:e]) for s, e in spans]
    return EVALUATED.findall(old), [s for s, _ in spans], [e for _, e in spans], texts, len(words)


def _aligned_words(scripts: pa.ListArray) -> tuple[np.ndarray, list[pa.Array]]:
    """Of which text each word is, and of all words one after the other: pos, token, start, end, text.

    A word that stays stands as many words further on as edits before it have put in more than they
    took; only the words of edits are told one by one.
    """
    pieces = pa.compute.fill_null(pa.compute.list_value_length(scripts), 0).to_numpy(zero_copy_only=False)
    tokens, texts, told, own, more = [], [], [], [], []
    for gap, old, new in zip(*(x.to_pylist() for x in scripts.flatten().flatten())):
        same = EVALUATED.findall(gap)
        tokens += same
        texts += same
        n = further = 0
        if old or new:
            words, lows, highs, put, count = _put_in(old, new)
            told += zip(range(len(tokens), len(tokens) + len(words)), range(len(words)), lows, highs)
            tokens += words
            texts += put
            n, further = len(words), count - len(words)
        own.append(len(same) + n)
        more.append(further)
    own, more = np.array(own, dtype=np.int64), np.array(more, dtype=np.int64)
    of = np.repeat(np.repeat(np.arange(len(pieces)), pieces), own)
    first = np.searchsorted(of, np.arange(len(pieces)))
    pos = np.arange(len(of)) - first[of]
    shift, begins = np.cumsum(more) - more, np.cumsum(pieces) - pieces
    shift -= np.repeat(shift[np.minimum(begins, max(0, len(shift) - 1))] if len(shift) else begins, pieces)
    start = pos + np.repeat(shift, own)
    end, none = start + 1, np.zeros(len(of), dtype=bool)
    for k, back, low, high in told:
        if low is None:
            none[k] = True
        else:
            start[k], end[k] = start[k] - back + low, start[k] - back + high
    columns = [pa.array(pos, pa.int32()), pa.array(tokens, pa.string()), pa.array(start, pa.int32(), mask=none), pa.array(end, pa.int32(), mask=none), pa.array(texts, pa.string())]
    return of, columns


#: Texts whose words are told at a time.
TEXTS = 64


def aligned_rows(df: DataFrame, script: str, *keys: str) -> DataFrame:
    """keys, pos and what :func:`aligned` tells, a row for each word of the text before.

    Rows are made where the words are: no array of all words of a text leaves its task.
    """
    fields = [("pos", T.IntegerType()), ("token", T.StringType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("text", T.StringType())]
    schema = T.StructType([*(df.schema[k] for k in keys), *(T.StructField(n, t) for n, t in fields)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                of, told = _aligned_words(part.column(len(keys)))
                own = [part.column(k).take(pa.array(of)) for k in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*own, *told], names=schema.names)

    pieces = F.transform(script, lambda e: F.struct(e.gap.alias("gap"), e.old.alias("old"), e.new.alias("new")))
    return df.select(*keys, pieces.alias("script")).mapInArrow(rows, schema)


class _Cut:
    """A script being read, by characters of one of its two texts."""

    def __init__(self, script: list[dict], side: str):
        # Pieces as (text on this side, text on the other, steps); gaps are equal on both.
        self.rows = [row for e in script for row in ((e["gap"], e["gap"], None), (e[side], e["new" if side == "old" else "old"], e["steps"] or "")) if row[2] is not None or row[0]]
        self.rows = [r for r in self.rows if r[2] is None or r[0] or r[1]]

    def intervals(self) -> list[tuple[int, int, str, str]]:
        """Edits as (start, end on this side, text on the other, steps)."""
        out, at = [], 0
        for own, other, steps in self.rows:
            if steps is not None:
                out.append((at, at + len(own), other, steps))
            at += len(own)
        return out


def compose(first: list[dict], second: list[dict]) -> list[dict]:
    """The script from the text before ``first`` to the one after ``second``.

    Edits that share characters of the text between become one.  A step counts if it left nothing
    abbreviated, and later ones if they changed that.
    """
    between = "".join(e["gap"] + e["new"] for e in first)
    if between != "".join(e["gap"] + e["old"] for e in second):
        raise ValueError("the second script does not start from the text that the first one made")
    made, then = _Cut(first, "new").intervals(), _Cut(second, "old").intervals()
    out: list[dict] = []
    at, i, j = 0, 0, 0
    while i < len(made) or j < len(then):
        start = min(x[k][0] for x, k in ((made, i), (then, j)) if k < len(x))
        end, a, b = start, i, j
        while True:  # all that hangs together, by characters of the text between
            if i < len(made) and (made[i][0] < end or made[i][0] == start):
                end, i = max(end, made[i][1]), i + 1
            elif j < len(then) and (then[j][0] < end or then[j][0] == start):
                end, j = max(end, then[j][1]), j + 1
            else:
                break
        old = _patched(between, start, end, made[a:i])
        new = _patched(between, start, end, then[b:j])
        out.append({"gap": between[at:start], "old": old, "new": new, "steps": _settled(made[a:i], then[b:j], _text_of(between, start, end, made[a:i]))})
        at = end
    if between[at:] or not out:
        out.append({"gap": between[at:], "old": "", "new": "", "steps": ""})
    return out


def _patched(text: str, start: int, end: int, edits: list[tuple[int, int, str, str]]) -> str:
    parts = []
    for low, high, other, _ in edits:
        parts += [text[start:low], other]
        start = high
    return "".join([*parts, text[start:end]])


def _text_of(text: str, start: int, end: int, edits: list) -> str:
    return text[start:end] if edits else ""


def _settled(first: list, second: list, shown: str) -> str:
    before = " ".join(dict.fromkeys(s for e in first for s in e[3].split()))
    after = " ".join(dict.fromkeys(s for e in second for s in e[3].split()))
    settled = bool(first) and not re.search(ABBREVIATED, shown)
    return " ".join(x for x in ((before, after) if settled or not second else (after,)) if x)


def composed(first: Column, second: Column) -> Column:
    """:func:`compose`, for columns of a frame (not expressions); a null script counts as none at all."""

    @F.arrow_udf(SCRIPT)
    def both(a: pa.Array, b: pa.Array) -> pa.Array:
        rows = [y if x is None else x if y is None else compose(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())]
        return pa.array(rows, pa.list_(pa.struct([(n, pa.string()) for n in ("gap", "old", "new", "steps")])))

    return both(first, second)
