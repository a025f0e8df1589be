"""Parsing and judging what a chooser answers: an object of occurrence ids and strings.

A chooser never hands over text, only choices, and each is held against what it was offered.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd

from . import vectorised
from .spans import Occurrence

TIERS = {"changed", "choice", "suggestion", "free"}  # those that are put into the text


class Judged(NamedTuple):
    choices: dict[int, str]
    details: list[dict]
    errors: list[str]


def object_of(answer: str | None) -> tuple[dict | None, str | None]:
    """The object between the first and the last brace, or why there is none."""
    answer = answer or ""
    body = answer[answer.find("{") : answer.rfind("}") + 1] if "{" in answer else ""
    if not body:
        return None, "No JSON object found in the answer"
    try:
        found = json.loads(body)
    except ValueError:
        return None, "The answer is not valid JSON"
    return (found, None) if isinstance(found, dict) else (None, "The answer is not a JSON object")


def prefixes_of(abbreviation: str) -> list[str]:
    stem = abbreviation.rstrip(".")
    return [stem, stem[:-1]] if stem[-1:] and stem[-1:] == stem[-2:-1] else [stem]


def extends(abbreviation: str, word: str) -> bool:
    """Whether a word of letters goes on where the abbreviation stops."""
    return word.isalpha() and any(word != p and word.startswith(p) for p in prefixes_of(abbreviation))


def _choice(o, value: str, offered: list[str]) -> str:
    return "choice" if value in offered else "rejected"


def _resolution(o, value: str, offered: list[str]) -> str:
    if value.upper() == "SKIP":
        return "skip"
    return "suggestion" if value in offered else "free" if extends(o.abbreviation, value) else "rejected"


def _form(o, value: str, offered: list[str]) -> str:
    return "kept" if value == o.matched else "changed" if value in offered else "rejected"


#: The rule of each step that chooses.
RULES: dict[int, Callable] = {2: _choice, 3: _resolution, 4: _form}


def judge(step: int, answer: str | None, occurrences, candidates: dict[str, list[str]]) -> tuple[Judged | None, str | None]:
    """What of an answer is accepted; None and a reason if it cannot be read at all."""
    found, why = object_of(answer)
    if found is None:
        return None, why
    out = Judged({}, [], [])
    for o in occurrences:
        raw = found.get(str(o.id))
        value = None if raw is None else str(raw).strip().strip("`")
        tier = "missing" if value is None else RULES[step](o, value, candidates.get(o.abbreviation) or [])
        if tier in TIERS:
            out.choices[o.id] = value
        accepted = value if tier in TIERS or tier == "kept" else None
        out.details.append({"id": o.id, "abbreviation": o.matched, "resolution": accepted, "tier": tier})
        if tier in ("missing", "rejected"):
            out.errors.append(f"{tier.capitalize()}: [[{o.id}]] {o.matched!r}" + (f" -> {value!r}" if value is not None else ""))
    known = {str(o.id) for o in occurrences}
    out.errors.extend(f"Unknown id: {k!r}" for k in found if k not in known)
    return out, None


def tiers(step: int, occurrences: list[Occurrence], candidates: dict[str, list[str]]):
    """A vectorised function of answers to the same occurrences: the tier of each; null if unreadable."""

    @vectorised("array<struct<id int, tier string>>")
    def judged(given: pd.Series) -> pd.Series:
        found = (judge(step, a, occurrences, candidates)[0] for a in given)
        return pd.Series([f and [{"id": d["id"], "tier": d["tier"]} for d in f.details] for f in found], dtype=object)

    return judged
