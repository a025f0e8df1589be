"""Functions on single texts, and their agreement with the column expressions."""

import pytest
from pyspark.sql import functions as F

from sigla.functions import alignment, answers, morphology, spans, text
from sigla.functions.spans import Occurrence
from sigla.operators import lexicon


def column(spark, values, expression, schema="value string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(expression(F.col("value"))).collect()]


def test_grams_overlap_and_null_texts_have_none(spark):
    got = column(spark, ["par. eccl. s. x", "e.m. a", None, "ñá. ü."], lambda c: text.all_grams(c, 3))
    assert sorted(got[0]) == ["eccl.", "eccl. s.", "par.", "par. eccl.", "par. eccl. s.", "s."]
    assert sorted(got[1]) == ["e.", "e.m.", "m."]
    assert got[2] == [] and sorted(got[3]) == sorted(["ü.", "ñá.", "ñá. ü."])


def test_two_counts_differ(spark):
    assert column(spark, ["a. bc. d1. é."], text.count_abbreviations) == [4]
    assert column(spark, ["a. bc. d1. é."], text.count_left) == [1]


def test_remaining_leaves_roman_numerals_and_single_letters(spark):
    assert column(spark, ["eccl. XIV. a. Bremen. xiv. 3."], text.remaining) == [["eccl.", "Bremen.", "xiv."]]
    found = spans.locate_remaining("eccl. XIV. Bremen.")
    assert [(o.id, o.matched, o.start, o.end) for o in found] == [(1, "eccl.", 0, 5), (2, "Bremen.", 11, 18)]


def test_vocabulary_words_are_not_abbreviations(spark):
    assert column(spark, ["ecclesia eccl. in domus. Decanus"], text.vocabulary_words) == [["ecclesia", "Decanus"]]


WORDS = ["viccarius", "Vicarius,", "portae", "horreum", "juvenca", "(coena)", "Kyrie!", "aa", "", "...", "aae"]


def test_orthographic_key_is_the_same_in_both_forms(spark):
    assert column(spark, WORDS, text.orthographic_key) == [alignment.key_of(w) for w in WORDS]
    assert alignment.key_of("viccarius") == alignment.key_of("Vicarius,") and alignment.key_of("Juvenca") == "iuenca"
    assert column(spark, ["ecclesiae  maioris"], text.phrase_key) == ["eclesie maioris"]


def test_prefixes_of_plurals(spark):
    names = ["eccll.", "dec.", "b.", "bb."]
    assert column(spark, names, text.prefixes) == [answers.prefixes_of(n) for n in names] == [["eccll", "eccl"], ["dec"], ["b"], ["bb", "b"]]


def test_shared_prefix_and_context(spark):
    row = spark.createDataFrame([("abcd", "abxd"), ("", "a"), ("x", "x")], "a string, b string").select(text.shared_prefix(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in row] == [2, 0, 1]
    tokens = spark.createDataFrame([(list("abcdefghijk"),)], "t array<string>")
    got = tokens.select(*[text.context(F.col("t"), F.lit(i)).alias(str(i)) for i in (0, 5, 10)]).first()
    assert tuple(got) == ("a b c d e", "b c d e f g h i j", "g h i j k")


def test_patterns():
    import re

    assert re.findall(text.occurrence_pattern("e. m."), "e. m. e.m. fe. m. e.\tm.") == ["e. m.", "e.m.", "e.\tm."]
    assert re.search(text.query_pattern("e. m."), "in e m x") and not re.search(text.query_pattern("dec."), "decanus")
    assert re.search(text.query_pattern("x. (s.)"), "x (s)y")


def test_leftmost_longest():
    found = spans.locate("in abb. et conv. et abb.", ["abb.", "abb. et conv.", "conv."])
    assert [(o.id, o.abbreviation) for o in found] == [(1, "abb. et conv."), (2, "abb.")]
    assert spans.mark("in abb. x", spans.locate("in abb. x", ["abb."])) == "in [[1|abb.]] x"
    assert spans.substitute("abb. abb.", spans.locate("abb. abb.", ["abb."]), {2: "abbas"}) == "abb. abbas"
    assert spans.locate("Abb. episcopus.", ["abb.", "s."]) == []
    assert [o.abbreviation for o in spans.locate("a.b.", ["a. b.", "a.b."])] == ["a. b."]


OCCURRENCES = [Occurrence(1, "eccl.", "eccl.", 0, 5), Occurrence(2, "dioc.", "dioc.", 6, 11)]


@pytest.mark.parametrize(
    "step, answer, tiers",
    [
        (2, '{"1": "ecclesia", "2": "no"}', ["choice", "rejected"]),
        (2, 'Here:\n```json\n{"1": " `ecclesia` ", "7": "x"}\n```', ["choice", "missing"]),
        (3, '{"1": "ecclesiasticus", "2": "skip"}', ["free", "skip"]),
        (3, '{"1": "eccl", "2": "dio1"}', ["rejected", "rejected"]),
        (4, '{"1": "eccl.", "2": null}', ["kept", "missing"]),
        (4, '{"1": "ecclesia", "2": true}', ["changed", "rejected"]),
    ],
)
def test_judging(step, answer, tiers):
    judged, why = answers.judge(step, answer, OCCURRENCES, {"eccl.": ["ecclesia"], "dioc.": ["diocesis"]})
    assert why is None and [d["tier"] for d in judged.details] == tiers
    assert set(judged.choices) == {d["id"] for d in judged.details if d["tier"] in answers.TIERS}
    assert ("Unknown id: '7'" in judged.errors) == ('"7"' in answer)


@pytest.mark.parametrize("answer", [None, "", "no object", "{broken", "[1, 2]", "{not json}"])
def test_unreadable_answers(answer):
    judged, why = answers.judge(2, answer, OCCURRENCES, {})
    assert judged is None and why


@pytest.mark.parametrize(
    "original, expanded, found",
    [
        ("ex 12 d. et porta Luce", "ex 12 dies et porta Luce", ["dies"]),
        ("sub lig. vir. posita", "sub ligno viridi posita", ["ligno", "viridi"]),
        ("hortus Lub. et mol. suo", "hortus Lub. et molendinum suo", ["molendinum"]),
        ("in porta port. nova", "in porta porta nova", ["porta", "porta"]),
        ("nothing 30. here", "nothing 30. here", []),
        ("ponte Gard. iuxta Rivum", "ponte Gardensis iuxta Ripam", None),
        ("beate Luce Novi", "beate Luce", None),
        ("", "", []),
    ],
)
def test_inserted_spans(original, expanded, found):
    got = alignment.inserted_spans(original, expanded)
    assert (got if got is None else [expanded[a:b] for a, b in got]) == found


def words(source, target, anchors=None):
    a, b = source.split(), target.split()
    return [None if s is None else " ".join(b[slice(*s)]) for s in alignment.align(a, b, anchors)]


def test_alignment():
    assert words("ad mol. novum", "ad molendinum novum") == ["ad", "molendinum", "novum"]
    assert words("v. dom. hort.", "venditio domus hortulani") == ["venditio", "domus", "hortulani"]
    assert words("Joh. mgr. item Lub", "Johannes magister rector et notarius Lub", {"mgr.": {"magister"}}) == ["Johannes", "magister", "rector et notarius", "Lub"]
    assert words("vend. dom. nova", "vend.") == ["vend.", "", ""]
    assert alignment.dealt(["x.", "y."], ["alpha", "beta", "gamma"], {}) == [None, None]
    assert alignment.dealt(["x."], ["alpha"], {}) == [(0, 1)]
    assert words("x q.v.r. y", "x q.v.r. y") == ["x", "q.v.r.", "y"]


def test_spans_of_a_changed_block_never_overlap():
    import random

    rng = random.Random(6)
    for _ in range(500):
        source = [rng.choice("ab") * rng.randrange(1, 3) + "." for _ in range(rng.randrange(1, 6))]
        target = [rng.choice("abc") * rng.randrange(1, 5) for _ in range(rng.randrange(1, 7))]
        found = [s for s in alignment.dealt(source, target, {}) if s]
        assert all(0 <= a <= b <= len(target) for a, b in found)
        assert all(x[1] <= y[0] for x, y in zip(found, found[1:]) if x[0] < x[1])


@pytest.mark.parametrize(
    "part, clean",
    [("port -(a)e", "port -e"), ("notari-i", "notari -i"), ("t(h)esaur -i", "tesaur/thesaur -i"), ("a -i/b -i", "a/b -i"), ("a -i/b -e", None), ("bare", None), ("hort -us ?", "hort -us ?"), ("m[iy]rr -is", "mirr/myrr -is")],
)
def test_noun_parts(part, clean):
    assert morphology.noun_part(part) == clean


def test_verb_parts_and_conjugations():
    assert morphology.verb_part("prefic, prefect") == "prefic, prefect, -"
    assert morphology.verb_part("aufer, abstul, ablat (aublat)") == "aufer, abstul, ablat/aublat"
    assert morphology.verb_part("one") is None and morphology.verb_part("a, b c d") is None
    got = [morphology.conjugation_of(w, s) for w, s in (("taxare", "tax, x, y"), ("audire", "audi, x, y"), ("valere", "vale, x, y"), ("capere", "capi, x, y"), ("mittere", "mitt, x, y"), ("conferre", "confer, x, y"), ("a b", "x, y, z"))]
    assert got == ["a-Konj.", "i-Konj.", "e-Konj.", "halbkons.-Konj.", "kons.-Konj.", None, None]


def test_clean_rows():
    none = morphology.Manual()
    assert morphology.clean_row("porta magna", "port -(a)e; magn -(a)e", "a; a (Adj.)", None, none) == ("port -e; magn -e", "a; o/a (Adj.)", None, None)
    assert morphology.clean_row("munera regum", "muner -um (bereits Pl.)", "konsonantisch (n.)", "x", none) == ("muner -um; regum", "kons. (n.) (Pl.); -", "x", None)
    assert morphology.clean_row("x", "only stem", "a", None, none)[3] == "stem not automatically cleanable"
    assert morphology.clean_row("annus", "ann -i", "weird", None, none) == ("ann -i", "weird", None, "declension not automatically cleanable")
    assert morphology.clean_row("et", None, None, None, none) == (None, None, None, None)
    manual = morphology.Manual(by_entry={("a b", "q"): ("a -e; b", "a; -")}, by_stem={"odd": ("ann -i", "o")}, notes={"o!": "irregular"}, by_declension={"o!": "o"})
    assert morphology.clean_row("a b", " q", "z", None, manual) == ("a -e; b", "a; -", None, None)
    assert morphology.clean_row("annus mundi", "odd", None, None, manual) == ("ann -i; mundi", "o; -", None, None)
    assert morphology.clean_row("annus", "ann -i", "o!", "n", manual) == ("ann -i", "o", "n; irregular", None)


def test_analysis_of_entries():
    assert morphology.analysed("a b", "x -e", "a") is None and morphology.analysed(None, "x", "y") is None
    kinds = [w["kind"] for w in morphology.analysed("et silva antiqua litterae ire", "et; silv -e; antiqu -e; ?; i, -, it", "-; a; o/a (Adj.); ?; kons.-Konj.")]
    assert kinds == ["fixed", "noun", "adjective", "unknown", "verb"]
    assert morphology.words_of("notarius (nur: Bd. 1), (denuo) ponere ?;") == ["notarius", "denuo", "ponere"]


def test_key_of_one_word_is_that_of_a_column(spark):
    words = ["", "ae", "Oeconomia", "jvys", "(Tullius),", "aae", "oae", "ii.", "VV", *morphology.CASE_ENDINGS_PLAIN]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.orthographic_key(F.col("w")).alias("k"))
    assert {r.w: r.k for r in got.collect()} == {w: text.key_of(w) for w in words}


def test_inflectional_pairs_by_brute_force(spark):
    endings = {text.key_of(e) for e in (*morphology.CASE_ENDINGS_PLAIN, "")}
    parts = ["", "ab", "abe", "abeo", "ba"]
    words = [a + e for a in parts for e in ("", "a", "em", "arum", "ibus", "x", "is")] + [None]
    rows = [(a, b) for a in words for b in words]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", lexicon.inflectional(F.col("a"), F.col("b")).alias("v")).collect()
    for r in got:
        fits = None not in (r.a, r.b) and any(r.a[:n] == r.b[:n] and r.a[n:] in endings and r.b[n:] in endings for n in range(3, min(len(r.a), len(r.b)) + 1))
        assert r.v == fits, r
