"""Many abbreviations looked up in a text at a time, inside the JVM.

A dictionary is one constant of the plan: a hash table, an array of small maps, in which a key is
found in the same time however many there are.  A text is cut at its runs of words with periods;
within a run, windows of words are looked up, the longest first.  What comes out is an edit script
(see :mod:`edits`): what was found, what is put in its place, and the text between.

An abbreviation is regular if it is words that each end in a period (or may not, but for the last
one), glued or with a blank between them.  Only such ones are in tables.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

SCRIPT = "array<struct<gap string, old string, new string, steps string>>"
_REGULAR = re.compile(r"\w+\.?(?: ?\w+\.?)*(?<=\.)")
_TOKEN = re.compile(r" ?\w+\.?")
BLANKS = " \t"


def regular(abbreviation: str) -> bool:
    return bool(_REGULAR.fullmatch(abbreviation)) and "".join(_TOKEN.findall(abbreviation)) == abbreviation


def spellings(abbreviation: str) -> list[str]:
    """How an abbreviation may stand, runs of blanks as one: a blank is optional."""
    first, *rest = abbreviation.split(" ")
    out = [first]
    for part in rest:
        out = [x + blank + part for x in out for blank in ("", " ")]
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Table:
    """Strings by key, as a constant."""

    def __init__(self, entries: dict[str, str]):
        self.size = len(entries)
        n = 1 << max(0, len(entries) - 1).bit_length()
        buckets: list[dict[str, str]] = [{} for _ in range(n)]
        for key, value in sorted(entries.items()):
            buckets[zlib.crc32(key.encode()) % n][key] = value
        self._buckets, self._n = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,string>>"), n

    def get(self, key: Column) -> Column:
        """The value of a key, null where there is none."""
        bucket = F.pmod(F.crc32(key.cast("binary")), F.lit(self._n)).cast("int")
        return F.try_element_at(F.get(self._buckets, bucket), key)


class Matcher:
    """Finds the longest keys of windows of words; ``lookup`` gives a window's value or null."""

    def __init__(self, lookup: Callable[[Column], Column], most: int, least: int = 1, bare_words: bool = False):
        self.lookup, self.most, self.least = lookup, most, least
        # A word that ends in its period can be read in one way only, so nothing has to be given back.
        word = r"\w+\.?" if bare_words else r"\w++\."
        self.token = rf"(?U)[ \t]*{word}"
        more = rf"(?:[ \t]*{word})" + (f"{{{least - 1},}}" if least > 1 else "*") + ("" if bare_words else "+")
        self.run = rf"(?U)\b{word}{more}"

    def script(self, text: Column, step: str = "") -> Column:
        """The edit script of a text: everything found, replaced by its value."""
        return let(F.coalesce(text, F.lit("")), lambda t: self._cut(t, step))

    def _cut(self, text: Column, step: str) -> Column:
        around = F.split(text, self.run, -1)
        runs = F.regexp_extract_all(text, F.lit(self.run), F.lit(0))
        pieces = F.flatten(F.zip_with(around, runs, lambda gap, run: self._run(gap, run, step)))
        return pieces

    def _run(self, gap: Column, run: Column, step: str) -> Column:
        """The pieces of a run and of what stands before it; no run: the end of the text."""
        end = F.array(_piece(gap, F.lit(""), F.lit(None).cast("string"), step))
        tokens = F.regexp_extract_all(run, F.lit(self.token), F.lit(0))
        if self.most == 1:
            piece = lambda t, i, w: let(self.lookup(w), lambda v: _piece(F.concat(F.when(i == 0, gap).otherwise(F.lit("")), _before(t, w)), w, v, step))
            each = F.transform(tokens, lambda t, i: let(F.ltrim(t, F.lit(BLANKS)), lambda w: piece(t, i, w)))
            return F.when(run.isNull(), end).otherwise(each)
        return F.when(run.isNull(), end).otherwise(let(tokens, lambda ts: self._windows(gap, ts, step)))

    def _tried(self, tokens: Column, i: Column, n: int) -> Column:
        key = F.ltrim(F.array_join(F.slice(tokens, i + 1, n), "")) if n > 1 else F.ltrim(F.get(tokens, i))
        found = let(let(key, self.lookup), lambda v: F.when(v.isNotNull(), F.struct(F.lit(n).alias("n"), v.alias("value"))))
        return F.when(F.size(tokens) >= i + n, found)

    def _windows(self, gap: Column, tokens: Column, step: str) -> Column:
        # Runs of blanks count as one blank.
        plain = F.transform(tokens, lambda t: let(F.ltrim(t, F.lit(BLANKS)), lambda w: F.when(F.length(w) < F.length(t), F.concat(F.lit(" "), w)).otherwise(w)))

        def best(ts: Column, i: Column) -> Column:
            """How many words the longest key at a place has, and its value."""
            tries = [self._tried(ts, i, n) for n in range(self.most, self.least - 1, -1)]
            return F.coalesce(*tries, F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("value")))

        def pieces(found: Column) -> Column:
            start = F.struct(F.lit(0).alias("left"), F.array().cast("array<struct<at int, n int>>").alias("taken"))
            step_on = lambda acc, i: F.when(acc.left > 0, F.struct((acc.left - 1).alias("left"), acc.taken.alias("taken"))).otherwise(
                F.struct((F.greatest(F.get(found, i).n, F.lit(1)) - 1).alias("left"), F.array_append(acc.taken, F.struct(i.alias("at"), F.get(found, i).n.alias("n"))).alias("taken"))
            )
            places = F.sequence(F.lit(0), F.size(tokens) - 1)
            alone = F.transform(found, lambda f, i: F.struct(i.alias("at"), f.n.alias("n")))
            taken = F.when(F.exists(found, lambda f: f.n > 1), F.aggregate(places, start, step_on, lambda acc: acc.taken)).otherwise(alone)
            return F.transform(taken, piece(found))

        def piece(found: Column) -> Callable[[Column], Column]:
            def of(x: Column) -> Column:
                whole = F.array_join(F.slice(tokens, x.at + 1, F.greatest(x.n, F.lit(1))), "")
                return let(whole, lambda t: let(F.ltrim(t, F.lit(BLANKS)), lambda w: _piece(F.concat(F.when(x.at == 0, gap).otherwise(F.lit("")), _before(t, w)), w, F.get(found, x.at).value, step)))

            return of

        return let(plain, lambda ts: let(F.transform(ts, lambda _, i: best(ts, i)), pieces))


class Patterned:
    """Finds what a pattern matches; ``lookup`` gives a match's value, or null if it is none."""

    def __init__(self, pattern: str, lookup: Callable[[Column], Column]):
        self.pattern, self.lookup = pattern, lookup

    def script(self, text: Column, step: str = "") -> Column:
        return let(F.coalesce(text, F.lit("")), lambda t: self._cut(t, step))

    def _cut(self, text: Column, step: str) -> Column:
        # Looked up before gaps are known: Spark takes no Python function out of an expression in which
        # a lambda within another one uses the other one's variable.
        found = F.transform(F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0)), lambda m: F.struct(m.alias("old"), self.lookup(m).alias("value")))
        return F.zip_with(F.split(text, self.pattern, -1), found, lambda gap, x: _piece(gap, F.coalesce(x.old, F.lit("")), x.value, step))


def _before(token: Column, word: Column) -> Column:
    return F.left(token, F.length(token) - F.length(word))


def _piece(gap: Column, old: Column, value: Column, step: str) -> Column:
    """Found: old and what is put in its place.  Not found: all of it is gap."""
    there = value.isNotNull()
    return F.struct(
        F.when(there, gap).otherwise(F.concat(gap, old)).alias("gap"),
        F.when(there, old).otherwise(F.lit("")).alias("old"),
        F.coalesce(value, F.lit("")).alias("new"),
        F.when(there, F.lit(step)).otherwise(F.lit("")).alias("steps"),
    )


def dictionary(rows: Iterable[tuple[str, str]]) -> dict[str, str]:
    """Every spelling of regular abbreviations with their values; of several the first."""
    out: dict[str, str] = {}
    for abbreviation, value in rows:
        for spelling in spellings(abbreviation):
            out.setdefault(spelling, value)
    return out


def words_of(abbreviation: str) -> int:
    return len(_TOKEN.findall(abbreviation))


def has_bare_words(abbreviation: str) -> bool:
    return any(not t.endswith(".") for t in _TOKEN.findall(abbreviation))


#: Words of the longest abbreviation that is cut out of a text as one.
MOST_WORDS = 5


def spelled_keys(names: Column) -> Column:
    """A map from every spelling of abbreviations (an array) to the abbreviation: of several, the least."""
    parts = lambda a: F.split(a, " ")
    longer = lambda acc, part: F.flatten(F.transform(acc, lambda x: F.array(F.concat(x, part), F.concat(x, F.lit(" "), part))))
    ways = lambda a: let(parts(a), lambda p: F.aggregate(F.slice(p, 2, F.size(p)), F.slice(p, 1, 1), longer))
    rows = F.flatten(F.transform(names, lambda a: F.transform(ways(a), lambda x: F.struct(x.alias("spelling"), a.alias("name")))))
    first = lambda rows: F.filter(rows, lambda r, k: (k == 0) | (F.get(rows, k - 1).spelling != r.spelling))
    return F.map_from_entries(let(F.array_sort(F.array_distinct(rows)), first))


def located(text: Column, keys: Column) -> Column:
    """The script of a text's own abbreviations (``keys``: a column made by :func:`spelled_keys`),
    each put in its own place under the name it is listed by."""
    return Matcher(lambda key: F.try_element_at(keys, key), MOST_WORDS).script(text)


def remaining(text: Column) -> Column:
    """The script of abbreviations of one word that are no Roman numeral, each put in its own place."""
    return Patterned(r"(?U)\b[A-Za-z]{2,}\.", lambda m: F.when(~m.rlike(r"^[IVXLCDM]+\.$"), m)).script(text)
