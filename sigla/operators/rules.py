"""Rule resolution: abbreviations with one reading in a volume are replaced throughout it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import edits, matching
from ..functions.text import occurrence_pattern, parts_of
from ..schema import PLACES, VOLUMES
from . import scan


def load(glossary: DataFrame, dioceses: DataFrame) -> DataFrame:
    """Simple entries and diocese adjectives; columns that the latter lack are null."""
    simple = glossary.where(~F.col("complex")).drop("complex")
    both = simple.unionByName(dioceses.select(F.col("abbreviation").alias("abbr"), "resolution"), allowMissingColumns=True)
    return both.withColumn("parts", parts_of(F.col("abbr")))


def by_volume(rules: DataFrame) -> DataFrame:
    """volume, abbr, resolution, parts: a row for each volume that a rule is listed for.

    A rule without any volume is for all of them if its abbreviation has no other rule.
    """
    alone = F.count("*").over(Window.partitionBy("abbr")) == 1
    nowhere = F.lit(True)
    for c in PLACES:
        nowhere &= F.col(c).isNull()
    cells = F.array(*[F.when(F.col(c).contains(F.col("abbr")), F.lit(v)) for v, c in zip(VOLUMES, PLACES)])
    listed = F.when(alone & nowhere, F.lit(list(VOLUMES))).otherwise(F.array_compact(cells))
    return rules.withColumn("volumes", listed.cast("array<long>")).select(F.explode("volumes").alias("volume"), "abbr", "resolution", "parts")


def flagged(listed: DataFrame) -> DataFrame:
    """With ``applies``: whether an abbreviation has one reading in its volume."""
    return listed.withColumn("applies", F.count("*").over(Window.partitionBy("volume", "abbr")) == 1)


def unambiguous(listed: DataFrame) -> DataFrame:
    return flagged(listed).where("applies").drop("applies")


def per_volume(listed: DataFrame) -> DataFrame:
    """volume, rules, applied, left."""
    counts = flagged(listed).groupBy("volume").agg(F.count("*").alias("rules"), F.count_if("applies").alias("applied"))
    return counts.withColumn("left", F.col("rules") - F.col("applied"))


def _ordered(rules: list[tuple[str, str, int]]) -> list[tuple[str, str, int]]:
    """Most parts first, then longest, then by name: an order without ties."""
    return sorted(rules, key=lambda r: (-r[2], -len(r[0]), r[0]))


def passes(rules: list[tuple[str, str, int]]):
    """One alternation for each number of parts, with a way from what it matched to the rule."""
    out = []
    for parts in sorted({r[2] for r in rules}, reverse=True):
        own = [r for r in _ordered(rules) if r[2] == parts]
        bare = {"".join(a.split()): e for a, e, _ in reversed(own)}
        out.append((re.compile("|".join(occurrence_pattern(a) for a, *_ in own)), bare))
    return out


def expand_text(text: str, compiled) -> str:
    """Pass after pass: what :func:`expand` does, on one text; for tests."""
    for pattern, bare in compiled:
        text = pattern.sub(lambda m, bare=bare: bare["".join(m[0].split())], text)
    return text


def expand_in_turn(text: str, rules: list[tuple[str, str, int]]) -> str:
    """Rule after rule: the definition, for tests."""
    for abbr, resolution, _ in _ordered(rules):
        text = re.sub(occurrence_pattern(abbr), lambda m, e=resolution: e, text)
    return text


def _levels(rules: DataFrame, volume: Column) -> list:
    """Matchers of a dictionary, those of most parts first; within as many parts, the few that are
    not made of words with periods come first, by a pattern."""
    rows = scan.listed(rules.select("volume", "abbr", "resolution", "parts"), len(VOLUMES) * scan.MOST_ROWS)
    out = []
    for parts in sorted({r.parts for r in rows}, reverse=True):
        own = sorted(((r.abbr, r.volume, r.resolution) for r in rows if r.parts == parts), key=lambda r: (-len(r[0]), r[0]))
        odd = [r for r in own if not matching.regular(r[0])]
        plain = [r for r in own if matching.regular(r[0])]
        if odd:
            names = list(dict.fromkeys(r[0] for r in odd))
            ways = "|".join(r"[ \t]*".join(rf"\Q{part}\E" for part in name.split(" ")) for name in names)
            look = _lookup(volume, {v: {"".join(a.split()): e for a, w, e in reversed(odd) if w == v} for v in VOLUMES})
            out.append(matching.Patterned(rf"(?U)\b(?:{ways})", lambda m, look=look: look(F.regexp_replace(m, r"\s", ""))))
        if plain:
            words = [matching.words_of(a) for a, *_ in plain]
            look = _lookup(volume, {v: matching.dictionary((a, e) for a, w, e in plain if w == v) for v in VOLUMES})
            out.append(matching.Matcher(look, max(words), min(words), any(matching.has_bare_words(a) for a, *_ in plain)))
    return out


def _lookup(volume: Column, of: dict[int, dict[str, str]]):
    """A key's value in a volume; values that all volumes share are kept once."""
    everywhere = dict(set.intersection(*(set(d.items()) for d in of.values())))
    own = {f"{v}|{k}": e for v, d in of.items() for k, e in d.items() if k not in everywhere}
    tables = [(matching.Table(own), lambda k: F.concat(volume.cast("string"), F.lit("|"), k))] if own else []
    tables += [(matching.Table(everywhere), lambda k: k)] if everywhere else []
    return lambda key: F.coalesce(*[t.get(spelled(key)) for t, spelled in tables])


def script_of(text: Column, levels: list, step: str = "#step1") -> Column:
    """The edit script of a text, level after level; what a level has put in stays as it is."""
    out = levels[0].script(text, step) if levels else edits.none(text)
    for level in levels[1:]:
        out = edits.within_gaps(out, lambda gap, level=level: level.script(gap, step))
    return out


def expand(stage: DataFrame, rules: DataFrame, *columns: str) -> DataFrame:
    """``stage`` with the rules (volume, abbr, resolution, parts) of its volume applied to columns.

    The rules, a dictionary's, become a constant of the plan: one pass over the corpus, without a
    join or a Python worker.  Volumes that no rule can exist for are dropped.
    """
    known = stage.where(F.col("volume").isin(list(VOLUMES)))
    levels = _levels(rules, F.col("volume"))
    done = lambda c: F.when(F.col(c).isNotNull(), edits.result(script_of(F.col(c), levels)))
    return known.withColumns({c: done(c) for c in columns or ("head_text", "body_text")})


def expand_with_script(stage: DataFrame, rules: DataFrame, column: str, script: str = "script", step: str = "#step1") -> DataFrame:
    """As :func:`expand` for one column, with the edit script from the old text to the new one."""
    known = stage.where(F.col("volume").isin(list(VOLUMES)))
    known = known.withColumn(script, script_of(F.col(column), _levels(rules, F.col("volume")), step))
    return known.withColumn(column, F.when(F.col(column).isNotNull(), edits.result(F.col(script))))
