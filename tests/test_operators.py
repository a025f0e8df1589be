"""Operators on small tables."""

import random
import shutil
import statistics

import pytest
from pyspark.sql import functions as F

from sigla import stand_in
from sigla.functions import edits, morphology
from sigla.operators import candidates, glossary, lexicon, ordered, rules, runs, scan, score, tei, vita
from sigla.schema import RAW, REGESTS, PLACES


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def raw(spark, *given):
    cells = [(*(g.get(c) for c in RAW), k) for k, g in enumerate(given)]
    return glossary.raw(spark.createDataFrame(cells, ", ".join(f"{c} string" for c in RAW) + ", row_order long"))


# --- entries and rules ------------------------------------------------------------------------


def test_texts_and_rows_are_inverse(spark):
    given = [(1, 37, 0, "head", None, "10100037-0"), (1, 37, 2, None, "second", "10100037-2"), (1, 37, 1, None, "first", "10100037-1"), (9, 5, 0, "only", None, "10900005-0")]
    df = spark.createDataFrame(given, REGESTS)
    texts = vita.to_texts(df)
    assert rows(texts) == [(1, 37, "head\nfirst\nsecond"), (9, 5, "only")]
    assert rows(vita.to_rows(texts)) == sorted(given, key=str)
    with pytest.raises(Exception, match="not exactly one header"):
        vita.to_texts(df.where("line_no > 0")).collect()


def in_turn(text, *given):
    return rules.expand_in_turn(text, list(given)), rules.expand_text(text, rules.passes(list(given)))


@pytest.mark.parametrize(
    "text, given, wanted",
    [
        ("mol. par.", [("mol.", "molendinum", 1)], "molendinum par."),
        ("in t. f. in t.f.", [("t. f.", "terra ferma", 2)], "in terra ferma in terra ferma"),
        ("de q. v. r. Q", [("q.", "quartus", 1), ("q. v. r.", "quod vide retro", 3)], "de quod vide retro Q"),
        ("l. den.", [("l.", "$ libra", 1)], "$ libra den."),
        ("l. den.", [("l.", r"\1 libra", 1)], r"\1 libra den."),
        ("molendinum mol.", [("mol.", "molendinum", 1)], "molendinum molendinum"),
        ("a. b. c. d.", [("b. c. d.", "BCD", 3), ("a. b.", "AB", 2)], "a. BCD"),
        ("a. b. c.", [("b. c.", "BC", 2), ("a. b.", "AB", 2)], "AB c."),
    ],
)
def test_rules(spark, text, given, wanted):
    assert in_turn(text, *given) == (wanted, wanted)
    df = spark.createDataFrame([(1, text), (10, text), (2, None)], "volume long, text string")
    table = spark.createDataFrame([(1, *g) for g in given], "volume long, abbr string, resolution string, parts int")
    want = [(1, wanted), (2, None)]
    assert rows(rules.expand(df, table, "text")) == want
    done = rules.expand_with_script(df, table, "text")
    assert rows(done, "volume", "text") == want
    assert rows(done.select("volume", edits.source(F.col("script")))) == [(1, text), (2, "")]
    assert "Python" not in rules.expand(df, table, "text")._jdf.queryExecution().executedPlan().toString()


def test_glued_abbreviations_are_all_replaced_by_passes():
    """One rule after the other leaves what has lost its left boundary; a pass does not."""
    given = [("a.", "alpha", 1), ("b.", "beta", 1), ("c.", "gamma", 1)]
    assert rules.expand_text("a.b.c.", rules.passes(given)) == "alphabetagamma"
    assert rules.expand_in_turn("a.b.c.", given) == "alphab.gamma"


def test_passes_equal_turns_without_overlaps():
    rng = random.Random(8)
    names = ["a.", "ab.", "b.", "a. b.", "c. d.", "ab. a. b.", "e. e."]
    for _ in range(300):
        given = [(n, f"<{k}>", len(n.split(" "))) for k, n in enumerate(rng.sample(names, 4))]
        text = " ".join(rng.choice(["a. b.", "ab.", "b.", "c. d.", "x", "e. e. x"]) for _ in range(12))
        one, other = in_turn(text, *given)
        assert one == other, (text, given)


def test_passes_take_overlapping_rules_of_one_length_from_the_left():
    """In turn, the first rule by length and name takes all its places before the next has any."""
    given = [("a. b.", "AB", 2), ("b. a.", "BA", 2)]
    assert in_turn("b. a. b.", *given) == ("b. AB", "BA b.")


# --- dictionary -------------------------------------------------------------------------------


def normal(spark, **given):
    return glossary.normalised(raw(spark, given)).collect()


def test_unusable_rows_and_marks(spark):
    assert normal(spark, abbr="a. ", resolution="?") == [] == normal(spark, abbr="b.", resolution="cf.: c.")
    (r,) = normal(spark, abbr="fer.  qu.", resolution=" Feria  quinta ;")
    assert (r.abbr, r.resolution, r.multi) == ("fer. qu.", "Feria quinta", True)
    assert [(r.resolution, r.multi) for r in normal(spark, abbr="port.", resolution="porta; portus")] == [("porta", True), ("portus", True)]
    (r,) = normal(spark, abbr="lig.", resolution="lignum ?", notes="n")
    assert r.resolution == "lignum" and r.notes.startswith("n; ") and "?" in r.notes
    (r,) = normal(spark, abbr="flum.", resolution="flumen (dekliniert)")
    assert (r.resolution, r.forced) == ("flumen", True) and "dekliniert" in r.notes
    assert normal(spark, abbr="silv.", resolution="(silva)")[0].resolution == "silva"


@pytest.mark.parametrize(
    "abbr, resolution, wanted, notes",
    [
        ("hort.", "hortulanus (cog.)", "hortulanus", "cog."),
        ("lect.", "(bina) lectio", "lectio", "bina"),
        ("vic.", "vic(c)arius", "vic(c)arius", ""),
        ("tes.", "t(h)esaurus (pl.)", "t(h)esaurus", "pl."),
        ("m. v. q. d.", "mons vetus (quondam dictus)", "mons vetus quondam dictus", ""),
    ],
)
def test_brackets(spark, abbr, resolution, wanted, notes):
    (r,) = normal(spark, abbr=abbr, resolution=resolution)
    assert (r.resolution, r.notes) == (wanted, notes)


def test_volume_cells(spark):
    given = [
        {"abbr": "agr.", "resolution": "agricola", "in_1": "agr.", "in_2": "agr.; agricola"},
        {"abbr": "nov.", "resolution": "novembris", "in_4": "nov.; novemb.", "in_5": "nov."},
        {"abbr": "vend.", "resolution": "vendere", "in_1": "venditio", "in_2": "ve."},
        {"abbr": "mag.", "resolution": "magister", "in_1": "Mg."},
    ]
    got = rows(glossary.volume_cells(raw(spark, *given)), "abbr", "resolution", "foreign", "in_1", "in_2", "in_4", "in_5")
    assert got == [
        ("Mg.", "Magister", False, "Mg.", "", "", ""),
        ("agr.", "agricola", False, "agr.", "agr.", "", ""),
        ("mag.", "magister", False, "", "", "", ""),
        ("nov.", "novembris", False, "", "", "nov.", "nov."),
        ("novemb.", "novembris", False, "", "", "novemb.", ""),
        ("vend.", "vendere", True, "venditio", "ve.", "", ""),
    ]


@pytest.mark.parametrize(
    "abbr, resolution, counts, wanted",
    [
        ("vicc.", "vic(c)arius", {}, ["viccarius"]),
        ("myrr.", "m[iy]rra", {}, ["myrra"]),
        ("arenar.", "(h)arenarius", {}, ["(h)arenarius"]),
        ("tesaur.", "t(h)esaurus", {}, ["tesaurus"]),
        ("vic.", "vic(c)arius", {"vicarius": 8, "viccarius": 3}, ["vicarius"]),
        ("vic.", "vic(c)arius", {"vica": 5, "vicca": 40, "vic": 999}, ["viccarius"]),
        ("vic.", "vic(c)arius", {}, ["vicarius"]),
        ("fratribus", "fratr(ibus)", {}, ["fratribus"]),
        ("hort.", "ortus/hortus", {}, ["hortus"]),
        ("mon.", "monte/montis", {}, ["monte", "montis"]),
        ("q.", "quarta feria/quinta feria", {}, ["quarta feria", "quinta feria"]),
        ("vet. mon.", "mons vetus", {}, ["vetus mons"]),
        ("m. m.", "mons minor", {}, ["mons minor"]),
    ],
)
def test_variants(abbr, resolution, counts, wanted):
    assert glossary.resolve(abbr, resolution, counts) == wanted


def test_merging(spark):
    given = [
        {"abbr": "S.", "resolution": "sanctus", "in_1": "S.", "notes": ""},
        {"abbr": "S.", "resolution": "Sanctus", "in_1": "S.; x.", "in_2": "S.", "notes": "n"},
        {"abbr": "s.", "resolution": "sanctus"},
    ]
    got = rows(glossary.merged(raw(spark, *given)), "abbr", "resolution", "in_1", "in_2", "notes")
    assert got == [("S.", "Sanctus", "S.; x.", "S.", "n"), ("s.", "sanctus", "", "", "")]


def test_corrections_go_in_turn_and_must_fit(spark):
    base = raw(spark, {"abbr": "a.", "resolution": "x"}, {"abbr": "", "resolution": "y"}, {"abbr": "b.", "resolution": "z"})
    edits = [
        glossary.Correction({"abbr": "a."}, put={"resolution": "xx"}),
        glossary.Correction({"resolution": "xx"}, put={"notes": "twice"}, insert=[{"abbr": "c.", "resolution": "new"}], complex=True),
        glossary.Correction({"abbr": "b."}, delete=True),
    ]
    got = glossary.corrected(base, edits, [{"abbr": "d.", "resolution": "last"}]).orderBy("row_order").collect()
    assert [(r.abbr, r.resolution, r.notes, r.forced, r.added) for r in got] == [("a.", "xx", "twice", True, False), ("c.", "new", "", False, False), ("", "y", "", False, False), ("d.", "last", "", False, True)]
    with pytest.raises(ValueError, match="stale"):
        glossary.corrected(base, [glossary.Correction({"abbr": "gone"})])


def test_whole_extraction(spark):
    docs = spark.createDataFrame([(1, "eccl. dioc. op. s. S. prep. SS."), (3, "eccl. s. oppidum oppidi"), (10, "d. nat.")], "volume long, text string")
    clean, review = glossary.extract(stand_in.raw_glossary(spark), docs)
    got = {(r.abbr, r.resolution): r for r in clean.collect()}
    assert got["eccl.", "ecclesia"].volumes == "1|3" and not got["eccl.", "ecclesia"].complex
    assert got["prep.", "prepositura"].declension == "a" and got["nat.", "navalis"].notes == "def."
    assert ("th.", "theologia") not in got and ("d.", "dictus") in got and got["d.", "dictus"].complex
    assert got["s.", "Sanctus" if ("s.", "Sanctus") in got else "sanctus"].in_3 == "s."
    assert ("SS.", "Sanctus") in got or ("SS.", "sanctus") in got
    assert review.count() == 0


# --- paradigms --------------------------------------------------------------------------------


def forms_of(spark, *entry):
    df = spark.createDataFrame([entry], "resolution string, stem string, declension string")
    return {r.form for r in lexicon.entry_forms(df).collect()}


def test_paradigms(spark):
    assert forms_of(spark, "ecclesia", "ecclesi -e", "a") == {"ecclesia", *("ecclesi" + e for e in "a ae am arum is as e".split())}
    assert "presbiter" in forms_of(spark, "presbiterus", "presbiter -i", "o")
    assert forms_of(spark, "arma", "arm -orum", "o (n.) (Pl.)") == {"arma", "armorum", "armis"}
    assert {"taxat", "taxabantur", "taxavit", "taxatus", "taxaturus", "taxans", "taxantis", "taxandi"} <= forms_of(spark, "taxare", "tax, taxav, taxat", "a-Konj.")
    deponent = forms_of(spark, "progredi", "progred, -, progress", "halbkons.-Konj. (Dep.)")
    assert {"progreditur", "progrediuntur", "progressus", "progrediens"} <= deponent and not {"progredit", "progredio", "progrediunt"} & deponent
    assert forms_of(spark, "et", "et", "-") == {"et"} and forms_of(spark, "x", "?", "?") == {None}
    assert forms_of(spark, "gem", "gem -is", "gem. (Adj.)") == {None}


def test_every_conjugation_has_all_persons():
    for c in (*morphology.ACTIVE, "gem"):
        assert len(morphology.present_suffixes(c)) > 40


def test_lexicon_and_ranks(spark):
    words = lexicon.lexicon(stand_in.morphology(spark))
    found = {r.word for r in words.collect()}
    assert {"ecclesia", "Ecclesia", "ordo", "silva"} <= found and not {"et", "litterae"} & found
    counts = spark.createDataFrame([("ecclesiam", 5), ("ecclesie", 9)], "word string, n long")
    ranked = lexicon.ranked_forms(words.where("word = 'ecclesia'"), counts).orderBy("rank").collect()
    assert [r.form for r in ranked][:3] == ["ecclesie", "ecclesiam", "ecclesia"]


def test_inflectional_variants(spark):
    pairs = [("horto", "hortus", True), ("lubicensem", "lubicensis", True), ("donatio", "donandi", False), ("bremis", "bremensis", False), ("ab", "ab", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert df.where(lexicon.inflectional(F.col("a"), F.col("b")) != F.col("want")).count() == 0


# --- candidates -------------------------------------------------------------------------------


def test_candidates_and_choices(spark):
    texts = spark.createDataFrame([(3, 1, "of. de. of. the."), (1, 2, "of. de."), (5, 3, None)], "volume long, entry long, text string")
    offered = candidates.of_entries(texts, stand_in.glossary(spark))
    assert rows(offered) == [(1, 2, "de.", ["decanus"]), (3, 1, "de.", ["decanus"]), (3, 1, "of.", ["officialis", "officium"])]
    own = candidates.first_choices(candidates.prompts(candidates.with_occurrences(texts, offered)))
    got = {r.entry: r for r in own.collect()}
    assert got[1].expanded == "officialis decanus officialis the." and got[1].marked == "[[1|of.]] [[2|de.]] [[3|of.]] the."
    assert "- [[2]] de.: decanus" in got[1].prompt and got[3].expanded == ""
    assert rows(candidates.clashes(stand_in.glossary(spark))) == [("de.",)] or candidates.clashes(stand_in.glossary(spark)).count() == 0


def test_mined_candidates(spark):
    words = spark.createDataFrame([("molendini", 12), ("molendinum", 5), ("molere", 1), ("portus", 100), ("porta", 90), ("portarum", 20), ("port", 50)], "word string, n long")
    abbrs = spark.createDataFrame([("molend.",), ("portt.",), ("zz.",)], "abbreviation string")
    got = rows(scan.mined_candidates(abbrs, words, most=2), "abbreviation", "rank", "candidate")
    assert got == [("molend.", 1, "molendini"), ("molend.", 2, "molendinum"), ("portt.", 1, "portus"), ("portt.", 2, "porta")]


# --- scores -----------------------------------------------------------------------------------

STAGES = ["vend. dom. ecclesia vet. 3 nov. 1402", "venditio domus ecclesia vetus 3 novembris 1402", "venditio domus ecclesia vetus 3 novembris 1402", "venditio domuum ecclesiae veteri 3 novembris 1402"]


@pytest.fixture
def scored(spark):
    texts = spark.createDataFrame([(2, 41, "vend. dom. eccl. vet. 3 nov. 1402", "venditio domuum ecclesie veteri 3 nov. 1402", STAGES)], "volume long, entry long, source string, gold string, stages array<string>")
    entries = spark.createDataFrame([("ecclesia", "ecclesi -e", "a"), ("ordo", "ordin -is", "kons.")], "resolution string, stem string, declension string")
    index = lexicon.lemma_index(entries)
    return score.with_steps(score.with_verdicts(score.aligned_occurrences(texts), index)).cache(), index


def test_verdicts_and_steps(scored):
    rows_, _ = scored
    got = {(r.abbr, r.stage): (r.verdict, r.step) for r in rows_.collect()}
    assert len(got) == 20
    assert [got["eccl.", k][0] for k in (1, 2, 3, 4)] == ["wrong_form", "wrong_form", "wrong_form", "orthographic"]
    assert [got["vend.", k][0] for k in (1, 2)] == ["not_expanded", "exact"]
    assert {got["nov.", k][0] for k in (1, 2, 3, 4)} == {"no_gold_label"}
    assert (got["eccl.", 1][1], got["vend.", 1][1], got["nov.", 1][1]) == (4, 2, 2)


def test_rollups(scored, spark):
    rows_, index = scored
    by_stage = {r.stage: r for r in score.by_stage(rows_).collect()}
    assert by_stage[4].scoreable == 4 and by_stage[4].form_accuracy == 1.0 and by_stage[1].expanded == 0.25 and by_stage[4].no_gold_label == 1
    offers = spark.createDataFrame([("eccl.", 4, "ecclesia"), ("dom.", 4, "aliud"), ("vend.", 2, "nothing")], "abbr string, step int, candidate string")
    got = {r.step: r for r in score.candidate_summary(rows_, offers, index).collect()}
    assert (got[4].offered, got[4].n_covered, got[4].beyond) == (2, 1, 1) and got[2].choice_accuracy == 0.0
    errors = spark.createDataFrame([(2, 41, "eccl.", "ecclesie")], "volume long, entry long, abbr string, gold string")
    assert score.without_gold_errors(rows_, errors).where("abbr = 'eccl.'").count() == 0
    with pytest.raises(ValueError, match="match nothing"):
        score.without_gold_errors(rows_, errors.withColumn("abbr", F.lit("x.")))


VERDICTS = [("ordinis", "ordo", "wrong_form"), ("ecclesiis", "ecclesia", "wrong_form"), ("Lubicensem", "Lubicensis", "wrong_form?"), ("ordinem", "silvam", "wrong_word"), ("et porta", "porta", "wrong_word"), ("viccarius", "vicarius", "orthographic"), ("ecclesia", "", "not_expanded"), ("ecclesia", None, "unaligned"), (None, "x", "unaligned"), ("", "x", "no_gold_label"), ("etc.", "x", "no_gold_label"), ("ordo ecclesie", "ordinis ecclesia", "wrong_form"), ("ordo Lubicensem", "ordinis Lubicensis", "wrong_form?")]


def test_single_verdicts(spark, scored):
    _, index = scored
    df = spark.createDataFrame([(k, g, e, v) for k, (g, e, v) in enumerate(VERDICTS)], "pos int, gold string, resolution string, want string")
    assert rows(score.with_verdicts(df, index).where("verdict <> want")) == []


# --- runs and markup --------------------------------------------------------------------------


def test_lineage_follows_files(spark):
    own = stand_in.manifests(spark)
    got = {(r.run, r.step): (r.by_run, r.by_step, r.depth, r.first, r.circular) for r in runs.lineage(own).collect()}
    assert got["fork", 3] == ("base", 2, 2, "base/step1.csv", False) and got["base", 4] == ("base", 3, 3, "base/step1.csv", False)
    assert got["base", 1] == (None, None, 0, "base/step1.csv", False) and got["lost", 3] == (None, None, 0, "runs/lost/step3.csv", False)
    assert got["loop", 3] == ("loop", 2, None, None, True) and got["loop", 2][4]
    assert rows(runs.behind(own, "fork", 3), "depth", "run", "step") == [(0, "fork", 3), (1, "base", 2), (2, "base", 1)]
    assert rows(runs.behind(own, "loop", 3), "depth", "run", "step") == [(0, "loop", 3), (1, "loop", 2)]
    assert rows(runs.behind(own, "lost", 3), "depth", "run", "step") == [(0, "lost", 3)]
    assert runs.lineage(own.limit(0)).count() == 0


def test_lineage_of_long_chains(spark):
    n = 10_000
    chain = [("r", k, f"f{k - 1}", f"f{k}") for k in range(n)] + [("c", k, f"c{(k - 1) % 1000}", f"c{k}") for k in range(1000)] + [("t", 0, "c500", "t0"), ("t", 1, "t0", "t1")]
    own = spark.createDataFrame(chain, "run string, step int, input string, output string")
    got = runs.lineage(own)
    assert got.count() == len(chain)
    line = got.where("run = 'r'")
    assert line.where("depth = step and first = 'f0' and not circular").count() == n
    assert got.where("run in ('c', 't') and circular and depth is null").count() == 1002
    assert runs.behind(own, "r", 300).agg(F.max("depth"), F.count("output")).first()[:] == (300, 301)


def test_order_goes_by_ranges_and_no_window_is_one_task(spark):
    rng = random.Random(5)
    values = [(k, rng.choice([None, None, f"v{k}"]), rng.randrange(1000)) for k in range(500)]
    df = spark.createDataFrame(values, "k long, v string, t long").repartition(7)
    out = ordered.carried(df, ["k"], F.col("v"), "above")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Window", 1)[0]
    last, want = None, []
    for k, v, _ in values:
        last = v or last
        want.append((k, last))
    assert rows(out, "k", "above") == sorted(want, key=str)
    numbered = ordered.numbered(df, ["k"], "i")
    assert rows(numbered, "k", "i") == sorted([(k, k + 1) for k, *_ in values], key=str)
    top = ordered.running_max(numbered, F.col("t"), "i", "most")
    assert rows(top, "k", "most") == sorted([(k, max(t for *_, t in values[: k + 1])) for k, *_ in values], key=str)


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0] * 9, [0.0, 1e-300, 1e300, -1e300, 7.0], [], [None, 2.0, None]])
def test_median_is_exact(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    own = [v for v in values if v is not None]
    assert ordered.median(df, "v") == (statistics.median(own) if own else None)


def test_ranks_of_many_values(spark):
    rng = random.Random(9)
    values = [rng.choice([rng.gauss(0, 1), rng.expovariate(1e-6), 2.5]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for rank in (0, 1, 1499, 1500, 2999):
        assert ordered.ranked_value(df, "v", rank) == sorted(values)[rank]
    assert "median(" not in score.effort(df.selectExpr("v as seconds", "1 as tries", "0 as server_retries", "true as readable"))._jdf.queryExecution().optimizedPlan().toString()


def test_runs(spark):
    own = stand_in.manifests(spark)
    assert runs.only_run(own.where("run = 'base'")) == "base" and runs.only_run(own, "fork") == "fork"
    for name, said in ((None, "several"), ("nope", "no run")):
        with pytest.raises(LookupError, match=said):
            runs.only_run(own, name)
    path, inherited = runs.with_inherited(own, "new", 3, "base")
    assert path == "runs/base/step2.csv" and rows(inherited, "run", "step") == [("new", 1), ("new", 2)]
    with pytest.raises(LookupError, match="to build on"):
        runs.with_inherited(own, "fork", 5)
    with pytest.raises(ValueError):
        runs.with_inherited(own, "base", 2, "fork")
    new = spark.createDataFrame([("base", 2, "m9", "i", "o")], own.schema)
    assert rows(runs.recorded(own, inherited, new).where("run = 'base' and step = 2"), "model") == [("m9",)]


def test_slots_equal_the_loop(spark):
    rng = random.Random(1)
    times = sorted(rng.randrange(60_000) for _ in range(40))
    df = spark.createDataFrame([(t,) for t in times], "at long")
    got = [r.slot for r in runs.slots(df.repartition(5), 4100).orderBy("i").collect()]
    assert got == [r.slot for r in runs.slots(df.selectExpr("at", "1 as k"), 4100, within=("k",)).orderBy("i").collect()]
    want, free = [], 0
    for t in times:
        want.append(max(t, free))
        free = want[-1] + 4100
    assert got == want


@pytest.mark.parametrize(
    "source, final, held",
    [
        ("ad mol.", "ad molendina", '<abbr>mol.</abbr><expan resp="#step1">molendina</expan>'),
        ("sub lig. vir.", "sub ligno viridi", "<abbr>vir.</abbr>"),
        ("ad rip. sup", "ad rip. sup", "ad <abbr>rip.</abbr> sup"),
        ("venerunt.", "venerunt.", "venerunt."),
        ("R 12 88v.", "R 12 88v.", "88v."),
        ("Joh. mgr. Lub", "Johannes magister, Lub", "magister,</expan>"),
        ("ex q.v.r. T", "ex quodvideretro T", "<choice><abbr>q.v.r.</abbr>"),
        ("ad <mol.> & vet.", "ad <molendinum> & vetus", "&lt;"),
    ],
)
def test_markup_reads_back(source, final, held):
    got = tei.check(source, [final], {"mgr.": {"magister"}}, {"rip."})
    assert got["status"] == "accepted" and held in got["markup"]
    assert tei.readings(got["markup"]) == (source, final)


def test_steps_of_an_resolution_and_entries(spark):
    got = tei.check("ad mol.", ["ad mol.", "ad molendinum", "ad molendinum", "ad molendina"])
    assert 'resp="#step2 #step4"' in got["markup"]
    given = [(1, 5, 0, "10100005-0", "ad mol.", "ad molendinum"), (1, 5, 1, "10100005-1", "x", "x"), (1, 6, 0, "10100006-0", "y", "")]
    df = spark.createDataFrame(given, "volume long, entry long, line_no long, line_id string, old string, new string")
    marked = tei.lines(df, "old", ["new"])
    assert rows(tei.report(marked), "status", "regests") == [("accepted", 2), ("empty", 1)]
    document = tei.document_lines(tei.entries(marked), "A <title>", [{"step": 1, "model": None}])
    xml = "\n".join(r.value for r in document.collect())
    from xml.etree import ElementTree

    root = ElementTree.fromstring(xml)
    assert root.tag == f"{{{tei.NAMESPACE}}}TEI" and xml.count("<p xml:id=") == 1 and xml.count("<head xml:id=") == 1


def test_schema_has_nine_volumes():
    assert len(PLACES) == 9


def test_corpus_volumes_equal_patterns(spark):
    import re

    from sigla.functions import text

    rng = random.Random(4)
    names = ["e.", "e. m.", "e.m.", "ex. m.", "m", "e m.", "a.e. m.", "x. (s.)", "ü.", "e. m. a.", "9."]
    bits = ["e", "m", "a", "ex", "ü", "s", "9", ".", ". ", " ", "  ", ",", "(s)", "x", "_"]
    docs = [(k % 3, "".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for k in range(400)] + [(1, None), (2, "")]
    want = {}
    for name in names:
        for volume, body in docs:
            if re.search(text.query_pattern(name), body or ""):
                want[name, volume] = want.get((name, volume), 0) + 1
    df = spark.createDataFrame(docs, "volume long, text string")
    queries = spark.createDataFrame([(n,) for n in names + names[:2]], "query string")
    assert {(r.query, r.volume): r.rows for r in scan.corpus_volumes(df, queries).collect()} == want


def test_cached_volumes_ask_each_file_once(spark, tmp_path, monkeypatch):
    path, corpus = str(tmp_path / "cache"), tmp_path / "corpus"
    write = lambda name, *texts: spark.createDataFrame([(v, t) for v, t in texts], "volume long, text string").coalesce(1).write.mode("overwrite").parquet(str(corpus / name))
    write("one", (1, "a. b"), (2, "a"))
    looked = []
    plain = scan.corpus_volumes
    monkeypatch.setattr(scan, "corpus_volumes", lambda docs, queries, *rest: looked.append((docs.select("file").distinct().count(), sorted(r.query for r in queries.collect()))) or plain(docs, queries, *rest))

    def asked(*names):
        looked.clear()
        docs = scan.fingerprinted(spark.read.schema("volume long, text string").option("recursiveFileLookup", True).parquet(str(corpus)))
        return rows(scan.cached_volumes(docs, spark.createDataFrame([(n,) for n in names], "query string"), path))

    assert asked("a.") == [("a.", 1, 1), ("a.", 2, 1)] and looked == [(1, ["a."])]
    assert asked("a.") == [("a.", 1, 1), ("a.", 2, 1)] and looked == []  # nothing new: no text is read
    assert asked("a.", "b.", "q.") == [("a.", 1, 1), ("a.", 2, 1), ("b.", 1, 1)] and looked == [(1, ["b.", "q."])]
    write("two", (1, "b. b"), (3, "q"))  # a new file is asked for all that was ever asked
    assert asked("b.") == [("b.", 1, 2)] and looked == [(1, ["a.", "b.", "q."])]
    assert asked("q.") == [("q.", 3, 1)] and looked == []
    write("two", (3, "a"))  # a changed one too, and what it had is withdrawn
    assert asked("a.", "b.") == [("a.", 1, 1), ("a.", 2, 1), ("a.", 3, 1), ("b.", 1, 1)] and len(looked) == 1
    shutil.rmtree(corpus / "two")
    assert asked("a.", "q.") == [("a.", 1, 1), ("a.", 2, 1)] and looked == []


def test_mined_candidates_are_few_before_they_are_joined(spark):
    words = spark.createDataFrame([(f"ab{chr(97 + k % 26)}{k}", k) for k in range(2, 500)], "word string, n long")
    abbreviations = spark.createDataFrame([("ab.",), ("abb.",)], "abbreviation string")
    got = scan.mined_candidates(abbreviations, words)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    want = [("ab.", k + 1, f"ab{chr(97 + (499 - k) % 26)}{499 - k}", 499 - k) for k in range(10)]
    assert [tuple(r) for r in got.where("abbreviation = 'ab.'").orderBy("rank").collect()] == want


def test_extraction_log(spark):
    docs = spark.createDataFrame([(1, "eccl. dioc. op. s. S. prep. SS. d. nat."), (10, "ecl. x")], "volume long, text string")
    out = glossary.extracted(stand_in.raw_glossary(spark), docs)
    log = {(r.stage, r.abbr, r.resolution) for r in out.log.collect()}
    assert ("unusable", "x.", "?") in log and ("alternatives", "d.", "dictus") in log and ("merged", "s.", "Sanctus") in log
    assert ("not in corpus", "th.", "theologia") in log and ("volume cells", "ecl.", "ecclesia") in log and ("note", "nat.", "navalis") in log


def test_lineages_have_every_step_behind_each(spark):
    """Against a walk through every kind of graph: branches, circles entered from outside, files written twice."""
    rng = random.Random(8)
    for case in range(4):
        given = list(stand_in.MANIFESTS) if case == 0 else []
        for k in range(60 if case else 0):
            given.append((f"r{rng.randrange(9)}", k, None, rng.choice([None, *(f"f{rng.randrange(40)}" for _ in range(9))]) if rng.random() < 0.4 else f"f{k - 1}", f"f{k}" if rng.random() < 0.9 else f"f{rng.randrange(60)}"))
        wrote = {}
        for r, k, _, i, o in sorted(given, key=lambda x: (x[0], x[1])):
            wrote.setdefault(o, (r, k, i))
        want, circular = [], set()
        for r, k, _, i, o in given:
            seen, at, depth = {o}, i, 0
            want.append((r, k, 0, r, k, o))
            while at in wrote and at not in seen:
                depth += 1
                seen.add(at)
                want.append((r, k, depth, *wrote[at][:2], at))
                at = wrote[at][2]
        own = spark.createDataFrame(given, "run string, step int, model string, input string, output string")
        got = runs.lineages(own)
        assert rows(got, "run", "step", "depth", "from_run", "from_step", "output") == sorted(want, key=str)
        ends = {(r.run, r.step): r for r in runs.lineage(own).collect()}
        assert all(ends[r.run, r.step].circular == r.circular for r in got.collect())
        assert all(ends[r, k].by_run == fr and ends[r, k].by_step == fs for r, k, d, fr, fs, _ in want if d == 1)
