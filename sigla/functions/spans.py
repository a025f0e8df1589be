"""Spans within one text: locating, marking, substituting.

Plain functions on one text: what :mod:`matching` and :mod:`edits` do for columns, and what the
steps need for the few texts that are being decided on.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from .text import occurrence_pattern

EVALUATED = re.compile(r"[A-Za-z]+\.?|\d+")
LETTERED = re.compile(r"[A-Za-z]+\.?")
WORD = re.compile(r"\b[A-Za-z]+\b")


class Occurrence(NamedTuple):
    id: int
    abbreviation: str
    matched: str
    start: int
    end: int


@lru_cache(maxsize=50_000)
def _compiled(abbreviation: str) -> re.Pattern:
    return re.compile(occurrence_pattern(abbreviation))


def locate(text: str, abbreviations: list[str]) -> list[Occurrence]:
    """Leftmost, then longest, then first listed; numbered from 1."""
    found = [(m.start(), -m.end(), k) for k, a in enumerate(abbreviations) for m in _compiled(a).finditer(text)]
    out: list[Occurrence] = []
    for start, end, k in sorted(found):
        if not out or start >= out[-1].end:
            out.append(Occurrence(len(out) + 1, abbreviations[k], text[start:-end], start, -end))
    return out


def locate_remaining(text: str) -> list[Occurrence]:
    """Abbreviations of one word that are no Roman numeral, with offsets."""
    found = [m for m in re.finditer(r"\b([A-Za-z]{2,})\.", text) if not re.fullmatch("[IVXLCDM]+", m[1])]
    return [Occurrence(i, m[0], m[0], *m.span()) for i, m in enumerate(found, 1)]


def locate_words(text: str, lexicon, spans=None) -> list[Occurrence]:
    """Words of a lexicon that no period follows, within given spans only if there are any."""
    if spans is None:
        places = WORD.finditer(text)
    else:  # a word starts where its letters do, so it is found from there
        inside = sorted({tuple(s) for s in spans})
        places = (m for at, end in inside if text[at:end] in lexicon and (m := WORD.match(text, at)) and m.span() == (at, end))
    found = [m for m in places if m[0] in lexicon and text[m.end() : m.end() + 1] != "."]
    return [Occurrence(i, m[0], m[0], *m.span()) for i, m in enumerate(found, 1)]


def _rebuilt(text: str, occurrences, new) -> str:
    cuts = [0, *(x for o in occurrences for x in (o.start, o.end)), len(text)]
    pieces = [text[a:b] for a, b in zip(cuts[::2], cuts[1::2])]
    return "".join(p + r for p, r in zip(pieces, [*map(new, occurrences), ""]))


def mark(text: str, occurrences) -> str:
    return _rebuilt(text, occurrences, lambda o: f"[[{o.id}|{o.matched}]]")


def substitute(text: str, occurrences, choices: dict[int, str]) -> str:
    """The text with choices put in; an occurrence without one stays."""
    return _rebuilt(text, occurrences, lambda o: choices.get(o.id, o.matched))


def token_spans(text: str) -> list[tuple[str, int, int]]:
    return [(m[0], *m.span()) for m in EVALUATED.finditer(text)]


def _rows(cells) -> list[Occurrence]:
    return [Occurrence(c["id"], c["abbreviation"], c["matched"], c["start"], c["end"]) for c in cells]
