"""Alignment of a text with a later stage of it, token by token.

Both sides are cut at what they have in common, from the outside in: what they start and end with,
then the tokens that each side has exactly once, in the longest order that both agree on, and so
on within each gap.  A gap without such tokens is small as a rule; there, the longest common
subsequence decides, or, where a table of it would be large, its rarest common token.  A gap of as
many tokens on either side, each going on as its counterpart, is paired without a search.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd

from . import vectorised
from .spans import EVALUATED, LETTERED

Span = tuple[int, int] | None
#: Cells up to which a gap's longest common subsequence is looked for in a table.
TABLE = 40_000
_DOUBLED, _ALIKE = re.compile(r"(.)\1+"), str.maketrans("jvy", "iui")


@lru_cache(maxsize=100_000)
def key_of(word: str) -> str:
    """The spelling-insensitive key of text.orthographic_key, for use within a function."""
    word = word.lower().strip(".,;:?!()[]").replace("ae", "e").replace("oe", "e")
    return _DOUBLED.sub(r"\1", word.translate(_ALIKE))


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs in order of their first number, a longest choice in which the second rises too."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tails, b)
        back.append(ends[at - 1] if at else -1)
        tails[at : at + 1], ends[at : at + 1] = [b], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _goes_on(old: str, new: str) -> bool:
    return old == new or (old.endswith(".") and bool(stem := key_of(old)) and key_of(new).startswith(stem))


def _subsequence(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence: of several, one in which most other tokens stand
    beside one that goes on as they do.  A table of weights from the end."""
    stems = [key_of(t) if t.endswith(".") else "" for t in old]
    keys = [key_of(t) for t in new]
    equal, width = len(old) + len(new) + 1, len(new) + 1
    best = [[0] * width for _ in range(len(old) + 1)]
    for i in range(len(old) - 1, -1, -1):
        row, below, token, stem = best[i], best[i + 1], old[i], stems[i]
        for j in range(len(new) - 1, -1, -1):
            beside = equal if token == new[j] else stem != "" and keys[j].startswith(stem)
            row[j] = max(below[j + 1] + beside, below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < len(old) and j < len(new):
        if old[i] == new[j] and best[i][j] == best[i + 1][j + 1] + equal:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i][j + 1]:
            j += 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            i, j = i + 1, j + 1
    return out


def _anchors(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal tokens that cut a gap; none if nothing is common."""
    here, there = Counter(old), Counter(new)
    once = {t: j for j, t in enumerate(new) if there[t] == 1}
    found = _rising([(i, once[t]) for i, t in enumerate(old) if here[t] == 1 and t in once])
    if found or len(old) * len(new) <= TABLE:
        return found or _subsequence(old, new)
    common = sorted((here[t] + there[t], t) for t in here.keys() & there.keys())
    if not common:
        return []
    rarest = common[0][1]
    return list(zip((i for i, t in enumerate(old) if t == rarest), (j for j, t in enumerate(new) if t == rarest)))


def matched(old: list[str], new: list[str]) -> dict[int, int]:
    """Places in ``old`` to places of equal tokens in ``new``, in the same order on both sides."""
    out: dict[int, int] = {}
    gaps = [(0, len(old), 0, len(new))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and old[a] == new[c]:
            out[a] = c
            a, c = a + 1, c + 1
        while a < b and c < d and old[b - 1] == new[d - 1]:
            b, d = b - 1, d - 1
            out[b] = d
        if a == b or c == d:
            continue
        if b - a == d - c and all(map(_goes_on, old[a:b], new[c:d])):
            out.update((a + k, c + k) for k in range(b - a) if old[a + k] == new[c + k])
            continue
        cuts = [(a + i, c + j) for i, j in _anchors(old[a:b], new[c:d])]
        out.update(cuts)
        edges = [(a - 1, c - 1), *cuts, (b, d)]
        gaps += [(i + 1, m, j + 1, n) for (i, j), (m, n) in zip(edges, edges[1:]) if cuts]
    return out


def _touching(words: list[str], put_in: set[int], way: int) -> Iterator[int]:
    """Matched tokens next to an equal one that was put in, whatever else was put in between; ``way``
    is 1 or -1.  Only what follows something put in is looked at."""
    k = -1 if way > 0 else len(words)
    for start in sorted(put_in, reverse=way < 0):
        if (start - k) * way <= 0:  # passed already
            continue
        near: set[str] = set()
        k = start
        while 0 <= k < len(words):
            if k in put_in:
                near.add(words[k])
            else:
                near &= {words[k]}
                if not near:
                    break
                yield k
            k += way


def inserted_spans(original: str, expanded: str) -> list[tuple[int, int]] | None:
    """Spans of the words in ``expanded`` that were put in; None if a word of the original is gone.

    A matched word next to an equal inserted one cannot be told from it, so both count.
    """
    if original == expanded:
        return []
    old, new = LETTERED.findall(original), list(LETTERED.finditer(expanded))
    words = [m[0] for m in new]
    pairs = matched(old, words)
    if any(not w.endswith(".") for k, w in enumerate(old) if k not in pairs):
        return None
    put_in = set(range(len(words))).difference(pairs.values())
    marked = put_in.union(*(_touching(words, put_in, way) for way in (1, -1)))
    return [(new[k].start(), new[k].end() - words[k].endswith(".")) for k in sorted(marked)]


def align(source: list[str], target: list[str], anchors: dict[str, set[str]] | None = None) -> list[Span]:
    """For each source token its span of target tokens; None where it cannot be told.

    An equal token is one token; what is gone is an empty span; the target tokens of a gap are
    dealt to its source tokens.
    """
    pairs = matched(source, target)
    out: list[Span] = [None] * len(source)
    edges = [(-1, -1), *sorted(pairs.items()), (len(source), len(target))]
    for (a, c), (b, d) in zip(edges, edges[1:]):
        if b < len(source):
            out[b] = (d, d + 1)
        if b - a > 1:
            gap = dealt(source[a + 1 : b], target[c + 1 : d], anchors or {}) if d - c > 1 else [(0, 0)] * (b - a - 1)
            out[a + 1 : b] = [s and (s[0] + c + 1, s[1] + c + 1) for s in gap]
    return out


def _heads(source: list[str], keys: list[str], listed: dict[str, set[str]]) -> list[int | None]:
    """Where each source token starts in the target: at the first free token that goes on with its
    letters, or whose key is listed for it."""
    starting: dict[str, list[int]] = defaultdict(list)
    spelled: dict[str, list[int]] = defaultdict(list)
    for j, key in enumerate(keys):
        spelled[key].append(j)
        starting[key[:1]].append(j)
    out: list[int | None] = []
    free = 0
    for token in source:
        stem = key_of(token)
        places: list[int] = []
        if stem:
            same = starting.get(stem[0], [])
            places += [j for j in same[bisect_left(same, free) :] if keys[j].startswith(stem)][:1]
            for key in listed.get(token, ()):
                at = spelled.get(key, [])
                places += at[bisect_left(at, free) :][:1]
        out.append(min(places, default=None))
        free = free if out[-1] is None else out[-1] + 1
    return out


def dealt(source: list[str], target: list[str], listed: dict[str, set[str]]) -> list[Span]:
    """The target tokens of a gap, dealt to its source tokens.

    A token with a head goes on to the next token's head, or is its head alone if the next one has
    none.  A lone token without a head takes what lies between its neighbours; several in a row
    are not aligned.
    """
    if len(source) == len(target) == 1:
        return [(0, 1)]
    heads = _heads(source, [key_of(t) for t in target], listed)
    out: list[Span] = []
    for k, head in enumerate(heads):
        later = heads[k + 1] if k + 1 < len(heads) else len(target)
        if head is not None:
            out.append((head, head + 1 if later is None else later))
        elif later is None or (k and heads[k - 1] is None):
            out.append(None)
        else:
            low = heads[k - 1] + 1 if k else 0
            out.append((low, max(low, later)))
    return out


@vectorised("array<struct<start int, end int>>")
def inserted(originals: pd.Series, expandeds: pd.Series) -> pd.Series:
    """Inserted spans; null where the alignment fails."""
    found = (inserted_spans(a or "", b or "") for a, b in zip(originals, expandeds))
    return pd.Series([None if s is None else [{"start": x, "end": y} for x, y in s] for s in found], dtype=object)


@vectorised("array<struct<token string, start int, end int, text string>>")
def aligned(sources: pd.Series, targets: pd.Series) -> pd.Series:
    """Each source token with its span of target tokens (nulls: not aligned) and their text."""
    out = []
    for a, b in zip(sources, targets):
        old, new = EVALUATED.findall(a or ""), EVALUATED.findall(b or "")
        rows = zip(old, align(old, new))
        out.append([{"token": t, "start": s and s[0], "end": s and s[1], "text": None if s is None else " ".join(new[s[0] : s[1]])} for t, s in rows])
    return pd.Series(out)
