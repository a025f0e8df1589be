"""Texts to scores to reports."""

from pyspark.sql import functions as F

from sigla import stand_in
from sigla.operators import lexicon, rules, score, tei
from sigla.plans import evaluation, reports, steps

SOURCE = "vend. mgr. item. eccl. vet. 3 nov. 1402"
GOLD = "venditio magister rector et notarius ecclesie veteri 3 nov. 1402"
STAGES = [
    "vend. magister, rector et notarius ecclesia vet. 3 nov. 1402",
    "venditio magister rector et notarius ecclesia vetus 3 nov. 1402",
    "venditio magister rector et notarius ecclesia vetus 3 novembris 1402",
    "venditio magistri rector et notarius ecclesiae veteri 3 novembris 1402",
]


def frame(spark, text):
    return spark.createDataFrame([(2, 41, text), (2, 42, "only here")], "volume long, entry long, text string")


def scored(spark):
    glossary = spark.createDataFrame([("mgr.", "magister", "magistr -i", "o"), ("eccl.", "ecclesia", "ecclesi -e", "a")], "abbr string, resolution string, stem string, declension string")
    stages = [frame(spark, s).where("entry = 41 or " + str(k == 0).lower()) for k, s in enumerate(STAGES)]
    found = evaluation.evaluated(frame(spark, SOURCE), frame(spark, GOLD), stages, glossary, stand_in.dioceses(spark))
    return found, glossary, stages


def test_texts_to_verdicts(spark):
    found, glossary, stages = scored(spark)
    got = {(r.abbr, r.stage): (r.resolution, r.verdict, r.step) for r in found.collect()}
    assert {k[0] for k in got} == {"vend.", "mgr.", "item.", "eccl.", "vet.", "nov."}
    assert got["mgr.", 1] == ("magister", "exact", 4) and got["mgr.", 4][1] == "wrong_form"
    assert got["item.", 2][:2] == ("rector et notarius", "exact")
    assert got["eccl.", 4][1] == "orthographic" and got["nov.", 4][1] == "no_gold_label"
    assert [tuple(r) for r in evaluation.missing(frame(spark, GOLD), stages).collect()] == [(2, 42, 2)]
    assert "magistri" in evaluation.anchors_of(glossary)["mgr."]


def test_reports(spark):
    found, glossary, _ = scored(spark)
    offers = spark.createDataFrame([("eccl.", 4, "ecclesia")], "abbr string, step int, candidate string")
    index = lexicon.lemma_index(glossary)
    baseline = spark.createDataFrame([(4, 0.5, 0.5)], "stage int, word_accuracy double, form_accuracy double")
    told = reports.evaluation(found, offers, index, baseline)
    assert all(f"## {t}" in told for t in ("Stages", "Deciding steps", "Candidates", "Potential gains", "Against the baseline")) and " %" in told
    texts = spark.createDataFrame([(3, 1, "of. de. x")], "volume long, entry long, text string")
    done = steps.step2(texts, stand_in.glossary(spark), steps.FirstCandidate())
    assert "officialis" in reports.step(done) and "| choice | 2 |" in reports.step(done)
    listed = rules.by_volume(rules.load(stand_in.glossary(spark), stand_in.dioceses(spark)))
    after = rules.expand(texts, rules.unambiguous(listed), "text")
    assert "| de. | 1 | 1 |" in reports.resolution(texts, after, listed, stand_in.glossary(spark), "text")
    lines = tei.lines(texts.withColumn("new", F.replace("text", F.lit("de."), F.lit("decanus"))), "text", ["new"])
    assert "| accepted | 1 | 1 |" in reports.markup(lines)


def rows_of(frame):
    columns = sorted(frame.columns)
    return sorted((tuple(str(r[c]) for c in columns) for r in frame.collect()))


def made_up(spark):
    """Occurrences with nulls, blanks and repeated facts, and offers for some of them."""
    rows = [
        (1, k, p, abbr, gold, list(stages))
        for k in range(30)
        for p, (abbr, gold, stages) in enumerate(
            [
                ("mgr.", "magister", ("mgr.", "magister", "magister", "magistri" if k % 3 else "magister")),
                ("eccl.", "ecclesia" if k % 2 else None, ("eccl.", None, "ecclesiam", "ecclesie")),
                ("vet.", "", ("vet.", "vetus", "vetus", "vetus")),
                ("x.", "x.", ("x.", "x.", "x.", "x.")),
                ("vend.", "venditio", (None, None, "aliud" if k % 5 else " ", "aliud")),
                ("dom.", "dominus", ("dom.", "dom.", "dom.", "dom." if k % 4 else None)),
            ]
        )
    ]
    own = spark.createDataFrame(rows, "volume long, entry long, pos int, abbr string, gold string, resolutions array<string>")
    index = spark.createDataFrame([("magister", "magister"), ("magistri", "magister"), ("eclesia", "ecclesia"), ("eclesiam", "ecclesia")], "key string, lemma string")
    offers = spark.createDataFrame([("mgr.", 2, "magister"), ("mgr.", 4, "magistri"), ("mgr.", 4, "magistri"), ("eccl.", 4, "aliter"), ("vend.", 3, "vendere"), ("vend.", 3, "aliud")], "abbr string, step int, candidate string")
    return own, index, offers


def test_facts_count_as_occurrences_do(spark):
    own, index, offers = made_up(spark)
    long = score.with_steps(score.with_verdicts(score.each_stage(own), index)).cache()
    short = score.scored_facts(own.repartition(5), index).cache()
    assert 0 < short.count() < long.count() / 5
    for report in (score.by_stage, score.by_step, score.by_abbreviation):
        assert rows_of(report(short)) == rows_of(report(long))
    for report in (score.candidate_summary, score.worst_misses):
        got = rows_of(report(short, offers, index))
        assert got and got == rows_of(report(long, offers, index))
    again = own.groupBy("abbr", "gold", "resolutions").agg(F.count("*").alias("n"))
    assert rows_of(score.by_stage(score.scored_facts(again, index))) == rows_of(score.by_stage(long))
    assert score.scored_facts(own.limit(0), index).count() == 0


def test_reports_read_facts_and_not_the_texts_again(spark, tmp_path):
    own, index, offers = made_up(spark)
    long = score.with_steps(score.with_verdicts(score.each_stage(own), index))
    own.write.parquet(str(tmp_path / "own"))
    own = spark.read.parquet(str(tmp_path / "own"))
    assert any("/own/" in f for f in own.inputFiles())
    facts = score.facts(own)
    last = score.judged_facts(facts, index, only=4)
    for got in (score.by_stage(score.scored_facts(own, index)), score.candidate_summary(last, offers, index), score.worst_misses(last, offers, index)):
        assert not any("/own/" in f for f in got.inputFiles())
    assert rows_of(score.worst_misses(last, offers, index)) == rows_of(score.worst_misses(long, offers, index))


def test_pairs_are_judged_once(spark, tmp_path, monkeypatch):
    own, index, _ = made_up(spark)
    path, asked = str(tmp_path / "judged"), []
    judge = score.judged
    monkeypatch.setattr(score, "judged", lambda pairs, i: asked.append({tuple(r) for r in pairs.collect()}) or judge(pairs, i))
    rows = score.each_stage(own)
    part = rows.where("abbr = 'mgr.'")
    first = {tuple(r) for r in evaluation.judged_once(part, index, path).collect()}
    assert first == {("magister", "magistri", "wrong_form")} and asked == [{("magister", "magistri")}]
    second = evaluation.judged_once(rows, index, path)
    assert asked[1:] == [{("ecclesia", "ecclesiam"), ("ecclesia", "ecclesie"), ("venditio", "aliud")}] and second.count() == 4
    evaluation.judged_once(rows, index, path)
    assert len(asked) == 2
    known = rows_of(score.with_verdicts(rows, index, second))
    assert known == rows_of(score.with_verdicts(rows, index)) and known == rows_of(score.with_verdicts(rows, index, second.limit(1)))
    other = index.where("key <> 'magistri'")
    assert ("magister", "magistri", "wrong_word") in {tuple(r) for r in evaluation.judged_once(rows, other, path).collect()}
    assert {tuple(r) for r in evaluation.judged_once(part, index, path).collect()} == first


def test_texts_to_facts(spark, tmp_path):
    found, glossary, stages = scored(spark)
    for kept in (str(tmp_path / "j"), str(tmp_path / "j")):
        short = evaluation.counted(frame(spark, SOURCE), frame(spark, GOLD), stages, glossary, stand_in.dioceses(spark), kept)
        columns = ["abbr", "stage", "resolution", "verdict", "step"]
        assert rows_of(short.where("n = 1").select(columns)) == rows_of(found.select(columns))


def test_a_text_of_several_stages_is_aligned_once(monkeypatch):
    from sigla.functions import alignment

    asked, align = [], alignment.align
    monkeypatch.setattr(alignment, "align", lambda *a: asked.append(a) or align(*a))
    got = score._occurrences_of("the of. an.", "the officium annum", ["the of. an.", "the officium an.", "the officium annum", None], None)
    assert len(asked) == 3  # gold is the third stage, the first is the source; a null text is empty
    assert [(o["pos"], o["abbr"], o["gold"], o["resolutions"][:3]) for o in got] == [(1, "of.", "officium", ["of.", "officium", "officium"]), (2, "an.", "annum", ["an.", "an.", "annum"])]
    assert score._occurrences_of(None, "x", ["y"], None) == []


def test_steps_are_told_before_stages_are_taken_apart(spark):
    given = [(1, k, 0, "ab.", "abia", r) for k, r in enumerate((["ab.", "abia", "abia", "abie"], ["ab.", None, "abia", "abia"], ["ab."] * 4, [None] * 4, ["abia", None, "abus", "abus"]))]
    own = spark.createDataFrame(given, "volume long, entry long, pos int, abbr string, gold string, resolutions array<string>")
    told = score.each_stage(score.settled(own))
    assert sorted(map(str, told.select("entry", "stage", "step").collect())) == sorted(map(str, score.with_steps(score.each_stage(own)).select("entry", "stage", "step").collect()))
    assert [r.step for r in score.settled(own).orderBy("entry").collect()] == [4, 3, None, None, 3]
    assert "Aggregate" not in told._jdf.queryExecution().executedPlan().toString()
