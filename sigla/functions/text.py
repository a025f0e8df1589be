"""Text scans as Column functions.

Word characters and boundaries are those of Unicode everywhere: Java needs (?U) for that.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ONE = r"(?U)\b(\w+\.)"
#: A token of the evaluation: ASCII letters with an optional period, or digits.
TOKEN = r"(?U)([A-Za-z]+\.?|\d+)"
ROMAN = r"^[IVXLCDM]+$"
STRIPPED = ".,;:?!()[]"


def gram_pattern(parts: int) -> str:
    """Abbreviations of ``parts`` words; those of several words may overlap, hence the lookahead."""
    return ONE if parts == 1 else r"(?U)(?=(\b" + " ?".join([r"\w+\."] * parts) + "))"


def grams(text: Column, parts: int) -> Column:
    """All abbreviations of a number of parts in a text; null texts have none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(gram_pattern(parts)), 1)


def all_grams(text: Column, most: int = 5) -> Column:
    """All abbreviations of 1 to ``most`` parts, in one pass for the runs of words with periods.

    Within a run, any neighbouring parts are an abbreviation.
    """
    if most == 1:
        return grams(text, 1)
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\b(\w+\.(?: ?\w+\.)*)"), 1)
    parts = lambda run: F.regexp_extract_all(run, F.lit(r"(?U)( ?\w+\.)"), 1)
    sizes = lambda p, i: F.sequence(F.lit(1), F.least(F.lit(most), F.size(p) - i + 1))
    at = lambda p, i: F.transform(sizes(p, i), lambda n: F.ltrim(F.array_join(F.slice(p, i, n), "")))
    windows = lambda p: F.flatten(F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: at(p, i)))
    # The array around the parts makes them a variable of the function, cut out once for each run.
    return F.flatten(F.transform(runs, lambda run: F.flatten(F.transform(F.array(parts(run)), windows))))


def count_abbreviations(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\b\w+\.")), F.lit(0))


def count_left(text: Column) -> Column:
    """The other count, of the step reports: two ASCII letters and a period."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[a-zA-Z]{2,}\.")), F.lit(0))


def parts_of(abbreviation: Column) -> Column:
    return F.size(F.split(abbreviation, " "))


def spacing_variant(abbreviation: Column) -> Column:
    """The spelling with a blank after each inner period."""
    return F.regexp_replace(abbreviation, r"(?U)\.(\w)", r". $1")


def remaining(text: Column) -> Column:
    """Abbreviations of two letters or more that are no Roman numeral, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\b([A-Za-z]{2,})\."), 1)
    return F.transform(F.filter(found, lambda w: ~w.rlike(ROMAN)), lambda w: F.concat(w, F.lit(".")))


def vocabulary_words(text: Column, least: int = 3) -> Column:
    """Words of ASCII letters that no period follows."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?U)\b([A-Za-z]{{{least},}})\b(?!\.)"), 1)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 1)


def squeezed(text: Column) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def orthographic_key(word: Column) -> Column:
    """A spelling-insensitive key: the order of the steps matters."""
    key = F.btrim(F.lower(word), F.lit(STRIPPED))
    key = F.replace(F.replace(key, F.lit("ae"), F.lit("e")), F.lit("oe"), F.lit("e"))
    return F.regexp_replace(F.translate(key, "jvy", "iui"), r"(.)\1+", "$1")


def key_of(word: str) -> str:
    """:func:`orthographic_key` of one word of ASCII letters."""
    key = word.lower().strip(STRIPPED).replace("ae", "e").replace("oe", "e")
    return re.sub(r"(.)\1+", r"\1", key.translate(str.maketrans("jvy", "iui")))


def phrase_key(phrase: Column) -> Column:
    words = F.filter(F.split(F.trim(phrase), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, orthographic_key), " ")


def shared_prefix(a: Column, b: Column) -> Column:
    """How many characters two strings have in common from their start."""
    upto = F.least(F.length(a), F.length(b))
    long = F.filter(F.sequence(F.lit(0), upto), lambda n: F.substr(a, F.lit(1), n) == F.substr(b, F.lit(1), n))
    return F.array_max(long)


def context(all_tokens: Column, index: Column, around: int = 4) -> Column:
    """The token at ``index`` (from 0) with its neighbours, joined by blanks."""
    start = F.greatest(F.lit(0), index - around)
    return F.array_join(F.slice(all_tokens, start + 1, index + around + 1 - start), " ")


def prefixes(abbreviation: Column) -> Column:
    """What a resolution may start with; a doubled last letter (a plural) may be single."""
    stem = F.rtrim(abbreviation, F.lit("."))
    doubled = (F.length(stem) >= 2) & (F.right(stem, F.lit(1)) == F.substring(stem, -2, 1))
    return F.when(doubled, F.array(stem, F.left(stem, F.length(stem) - 1))).otherwise(F.array(stem))


def occurrence_pattern(abbreviation: str) -> str:
    """Where an abbreviation stands: a boundary on the left only, blanks optional."""
    return r"\b" + r"[ \t]*".join(re.escape(part) for part in abbreviation.split(" "))


def query_pattern(abbreviation: str) -> str:
    """How the corpus is asked for an abbreviation: periods optional, boundaries on both sides."""
    body = abbreviation[:-1] if abbreviation.endswith(".") else abbreviation
    parts = [r"\.?".join(re.escape(x) for x in word.split(".")) for word in body.split(" ")]
    return r"\b" + " ".join(parts) + ("" if body.endswith(")") else r"\b")


def query_forms(abbreviation: str, most: int = 256) -> list[str] | None:
    """The spellings, as they stand between word boundaries, that :func:`query_pattern` finds.

    None where it cannot be told by words, periods and single blanks, or there are too many.
    """
    if not re.fullmatch(r"\w+(?:\.\w+)*\.?(?: \w+(?:\.\w+)*\.?)*", abbreviation):
        return None
    forms = [""]
    for piece in re.findall(r"\w+|\. |\.| ", abbreviation.removesuffix(".")):
        ways = {".": [".", ""], ". ": [". ", " "]}.get(piece, [piece])
        forms = [f + w for f in forms for w in ways]
        if len(forms) > most:
            return None
    return forms


def word_runs(words: Column, gaps: Column, n: int, first: Callable[[Column], Column] | None = None) -> Column:
    """All runs of ``n`` words with periods, blanks, or both between them, as they stand; those
    whose first word ``first`` knows.

    ``words`` and ``gaps`` (before, between and after them) have to be columns, not expressions.
    """
    joined = lambda i: [x for k in range(n) for x in ([F.get(gaps, i + k)] if k else []) + [F.get(words, i + k)]]
    good = lambda i: F.when(sum([F.get(gaps, i + k).isin(".", " ", ". ").cast("int") for k in range(1, n)], F.lit(0)) == n - 1, F.concat(*joined(i)))
    known = lambda i: good(i) if first is None else F.when(first(F.get(words, i)).isNotNull(), good(i))
    return F.when(F.size(words) >= n, F.array_compact(F.transform(F.sequence(F.lit(0), F.size(words) - n), known))).otherwise(F.array().cast("array<string>"))
