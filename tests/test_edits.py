"""The matcher and edit scripts, against the same on one text."""

import random

import pytest
from pyspark.sql import functions as F
from sigla.functions import edits, matching, spans
from sigla.operators import candidates, rules, tei


def scripts(spark, rows, column):
    return [[tuple(e) for e in r[0]] for r in spark.createDataFrame(rows, "k int, text string").orderBy("k").select(column).collect()]


def test_a_table_finds_all_its_keys_and_no_others(spark):
    entries = {f"k{i}": f"v{i}" for i in range(3000)} | {"": "empty", "é": "accent", 'q"\\': "odd"}
    table = matching.Table(entries)
    df = spark.createDataFrame([(k,) for k in [*entries, "k3000", "K1", "x"]], "k string")
    assert {r.k: r.v for r in df.select("k", table.get(F.col("k")).alias("v")).collect()} == entries | {"k3000": None, "K1": None, "x": None}


@pytest.mark.parametrize("name, regular", [("a.", True), ("a. b.", True), ("a.b.", True), ("S. Crucis in Jerus.", True), ("a", False), ("(a.)", False), ("a.-b.", False), ("a.  b.", False), ("é.", True), ("", False)])
def test_regular_abbreviations(name, regular):
    assert matching.regular(name) is regular


def test_random_texts_equal_the_passes(spark):
    rng = random.Random(11)
    names = ["a.", "ab.", "b.", "a.b.", "a. b.", "c. d.", "ab. a. b.", "e. in f.", "(x.)", "é.", "b.c. d."]
    for n in range(12):
        given = [(name, f"<{k}>", len(name.split(" "))) for k, name in enumerate(rng.sample(names, 6))]
        texts = [" ".join(rng.choice(["a. b.", "a.b.", "ab.", "b.  c. d.", "x", "e. in f.", "(x.)", "é.", "xa.", "a.\tb."]) for _ in range(12)) for _ in range(25)]
        table = spark.createDataFrame([(1, *g) for g in given], "volume long, abbr string, resolution string, parts int")
        df = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "volume long, k int, text string")
        got = {r.k: (r.text, r.s, r.back) for r in rules.expand_with_script(df.withColumn("s", F.col("text")), table, "text").withColumn("back", edits.source(F.col("script"))).collect()}
        for k, t in enumerate(texts):
            assert got[k] == (rules.expand_text(t, rules.passes(given)), t, t), (given, t)


def test_what_has_been_put_in_is_not_looked_at_again(spark):
    table = spark.createDataFrame([(1, "a. b.", "s. x", 2), (1, "s.", "sanctus", 1)], "volume long, abbr string, resolution string, parts int")
    df = spark.createDataFrame([(1, "a. b. s. \x10e\x10p")], "volume long, text string")
    (got,) = rules.expand_with_script(df, table, "text").collect()
    assert got.text == "s. x sanctus \x10e\x10p"
    assert [(e.old, e.new) for e in got.script if e.old] == [("a. b.", "s. x"), ("s.", "sanctus")]


def test_located_equals_locating_one_text(spark):
    rng = random.Random(3)
    names = ["abb.", "abb. et.", "et.", "a. b.", "a.b.", "b.", "q. v. r.", "r."]
    for _ in range(8):
        own = sorted(rng.sample(names, 4))
        texts = [" ".join(rng.choice(["abb.", "et.", "a.b.", "a. b.", "b.", "x", "q.v. r.", "q. v.r.", "r. ", "abb. \t et."]) for _ in range(10)) for _ in range(20)]
        df = spark.createDataFrame([(k, t, own) for k, t in enumerate(texts)], "k int, text string, names array<string>").withColumn("keys", matching.spelled_keys(F.col("names")))
        out = df.withColumn("s", matching.located(F.col("text"), F.col("keys"))).select("text", edits.occurrences(F.col("s")).alias("o"), edits.marked(F.col("s")).alias("m"))
        for r in out.collect():
            want = spans.locate(r.text, own)
            assert [tuple(o) for o in r.o] == [tuple(o) for o in want] and r.m == spans.mark(r.text, want)


def test_remaining_equals_locating_one_text(spark):
    texts = ["dom. XIV. a. ab. Ab.cd. é ab.", "", None, "xéab. 9ab. ab.ab."]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    for r in df.select("text", edits.occurrences(matching.remaining(F.col("text"))).alias("o")).collect():
        assert [tuple(o) for o in r.o] == [tuple(o) for o in spans.locate_remaining(r.text or "")]


def script(*pieces):
    return [dict(zip(("gap", "old", "new", "steps"), p)) for p in pieces]


FIRST = script(("in ", "eccl.", "ecclesia", "#step1"), (" et ", "a. b.", "alpha beta.", "#step1"), (" fin.", "", "", ""))


@pytest.mark.parametrize(
    "second, wanted",
    [
        # Untouched by the second; what was put in is changed; what was left is put in.
        (script(("in ecclesia et alpha beta. ", "fin.", "finis", "#step3")), [("in ", "eccl.", "ecclesia", "#step1"), (" et ", "a. b.", "alpha beta.", "#step1"), (" ", "fin.", "finis", "#step3")]),
        (script(("in ", "ecclesia", "ecclesiam", "#step4"), (" et alpha beta. fin.", "", "", "")), [("in ", "eccl.", "ecclesiam", "#step1 #step4"), (" et ", "a. b.", "alpha beta.", "#step1"), (" fin.", "", "", "")]),
        # A part of what was put in: what the first step left abbreviated is the second's.
        (script(("in ecclesia et alpha ", "beta.", "betam", "#step2"), (" fin.", "", "", "")), [("in ", "eccl.", "ecclesia", "#step1"), (" et ", "a. b.", "alpha betam", "#step2"), (" fin.", "", "", "")]),
        # Over a border of edits, and over two of them.
        (script(("in eccles", "ia et", "iam atque", "#step4"), (" alpha beta. fin.", "", "", "")), [("in ", "eccl. et", "ecclesiam atque", "#step1 #step4"), (" ", "a. b.", "alpha beta.", "#step1"), (" fin.", "", "", "")]),
        (script(("in ", "ecclesia et alpha", "E", "#step4"), (" beta. fin.", "", "", "")), [("in ", "eccl. et a. b.", "E beta.", "#step4"), (" fin.", "", "", "")]),
    ],
)
def test_scripts_are_composed(spark, second, wanted):
    got = edits.compose(FIRST, second)
    assert [tuple(e.values()) for e in got] == wanted
    before, after = ("".join(e["gap"] + e[k] for e in got) for k in ("old", "new"))
    assert before == "in eccl. et a. b. fin." and after == "".join(e["gap"] + e["new"] for e in second)
    df = spark.createDataFrame([(FIRST, second), (FIRST, None), (None, second)], f"a {matching.SCRIPT}, b {matching.SCRIPT}")
    one, other, third = (r.c for r in df.select(edits.composed(F.col("a"), F.col("b")).alias("c")).collect())
    assert [tuple(e) for e in one] == wanted and len(other) == 3 and len(third) == len(second)


def test_scripts_of_other_texts_are_refused():
    with pytest.raises(ValueError, match="does not start"):
        edits.compose(FIRST, script(("another text", "", "", "")))


def test_random_compositions_keep_both_texts():
    rng = random.Random(7)

    def edit(text, step):
        out, at = [], 0
        while at < len(text):
            gap, old = rng.randrange(0, 6), rng.randrange(0, 5)
            new = "".join(rng.choice("xyz .") for _ in range(rng.randrange(0, 5)))
            piece = (text[at : at + gap], text[at + gap : at + gap + old], new, step)
            at += gap + old
            out.append(piece if piece[1] or piece[2] else (piece[0], "", "", ""))
        return script(*out, ("", "", "", ""))

    for _ in range(500):
        text = "".join(rng.choice("ab. ") for _ in range(rng.randrange(0, 40)))
        first = edit(text, "#step1")
        between = "".join(e["gap"] + e["new"] for e in first)
        second = edit(between, "#step2")
        both = edits.compose(first, second)
        assert "".join(e["gap"] + e["old"] for e in both) == text
        assert "".join(e["gap"] + e["new"] for e in both) == "".join(e["gap"] + e["new"] for e in second)


def test_words_of_an_edit_are_dealt(spark):
    rows = [(script(("ad ", "Rom. imp.", "Romanorum sacri Imperatoris", "#step1"), (" x ", "q.v.", "quod vide", "#step1"), (" 12", "", "", "")),)]
    df = spark.createDataFrame(rows, f"s {matching.SCRIPT}")
    (got,) = df.select(edits.aligned(F.col("s")).alias("a"), edits.inserted(F.col("s")).alias("i"), edits.result(F.col("s")).alias("t")).collect()
    assert [tuple(a) for a in got.a] == [("ad", 0, 1, "ad"), ("Rom.", 1, 3, "Romanorum sacri"), ("imp.", 3, 4, "Imperatoris"), ("x", 4, 5, "x"), ("q.", 5, 6, "quod"), ("v.", 6, 7, "vide"), ("12", 7, 8, "12")]
    assert [got.t[a:b] for a, b in got.i] == ["Romanorum", "sacri", "Imperatoris", "quod", "vide"]


@pytest.mark.parametrize(
    "pieces, markup, status",
    [
        ([("ad ", "mol.", "molendina", "#step1"), (" rip. the. 88the.", "", "", "")], 'ad <choice><abbr>mol.</abbr><expan resp="#step1">molendina</expan></choice> rip. <abbr>the.</abbr> 88the.', "accepted"),
        ([("<&> ", "a. b.", "A & <B>", "#step1 #step4"), ("", "", "", "")], '&lt;&amp;&gt; <choice><abbr>a. b.</abbr><expan resp="#step1 #step4">A &amp; &lt;B&gt;</expan></choice>', "accepted"),
        ([("same ", "x.", "x.", "#step2")], "same x.", "accepted"),
        ([("", "x.", "", "#step2")], None, "empty"),
        ([("bell \x07 ", "x.", "y", "")], None, "not well formed"),
        ([("line\r ", "x.", "y", "")], None, "source reading differs"),
    ],
)
def test_markup_is_read_off_a_script_and_read_back(spark, pieces, markup, status):
    old = "".join(g + o for g, o, *_ in pieces)
    df = spark.createDataFrame([(old, script(*pieces))], f"old string, script {matching.SCRIPT}")
    (got,) = tei.lines_of(df, "old", known=["the."]).collect()
    assert (got.markup, got.status) == (markup, status)
    if markup:
        assert tei.readings(markup) == (old, "".join(g + n for g, _, n, _ in pieces))
    (other,) = tei.lines_of(df.withColumn("old", F.lit("another source")), "old").collect()
    assert other.status in ("source reading differs", "empty", "not well formed")


def test_candidates_are_put_in_without_python_over_texts(spark):
    texts = spark.createDataFrame([(1, 1, "a. b. x a.b. c.")], "volume long, entry long, text string")
    offered = spark.createDataFrame([(1, 1, "a. b.", ["AB"]), (1, 1, "c.", [])], "volume long, entry long, abbr string, candidates array<string>")
    out = candidates.first_choices(candidates.marked(candidates.with_occurrences(texts, offered)))
    (got,) = out.collect()
    assert (got.expanded, got.marked) == ("AB x AB c.", "[[1|a. b.]] x [[2|a.b.]] [[3|c.]]")
    assert [o.abbreviation for o in got.occurrences] == ["a. b.", "a. b.", "c."]


def test_rows_of_aligned_words_are_told_without_an_array_of_them(spark):
    e = lambda gap, old="", new="": (gap, old, new, "#step1")
    scripts = [
        [e("In the ", "a. b.", "alium xx bonum"), e(" and ", "c.", "cum"), e(" 12 end.")],
        [e("no word of it goes on: ", "q. r. s.", "zz yy"), e(" here", "", " more words"), e(" x. ", "gone.", ""), e(" y.")],
        [],
        [e("")],
        [e("", "a. b.", "alium xx bonum"), e(" ... "), e("last")],
        None,
    ]
    rows = [(1, k, s) for k, s in enumerate(scripts)] + [(2, k, scripts[k % 2]) for k in range(2 * edits.TEXTS + 3)]
    df = spark.createDataFrame(rows, f"volume long, entry long, script {edits.SCRIPT}").coalesce(1)
    told = edits.aligned_rows(df, "script", "volume", "entry")
    assert "Generate" not in told._jdf.queryExecution().executedPlan().toString()
    want = df.select("volume", "entry", F.posexplode(edits.aligned(F.col("script"))).alias("pos", "a")).select("volume", "entry", "pos", "a.*")
    key = lambda r: (r.volume, r.entry, r.pos)
    assert told.columns == want.columns and sorted(told.collect(), key=key) == sorted(want.collect(), key=key)


def test_the_text_after_is_put_together_once_for_markup(spark):
    import re

    df = spark.createDataFrame([("an a. b", [("an ", "a.", "annum", "#step1"), (" b", "", "", "")])], f"old string, script {edits.SCRIPT}")
    told = tei.lines_of(df, "old", known=["the."])
    assert told.first().status == "accepted"
    plan = told.where("status <> ''")._jdf.queryExecution().analyzed().toString()
    assert len(re.findall(r"array_join\(transform\(script#\d+, lambdafunction\(concat\(", plan)) == 1


def test_a_script_of_patterns_can_be_given_to_a_python_function_where_it_is_made(spark):
    """Whatever ids columns have: Spark takes the function out of the expression, under a generator too."""
    texts = ["dom. XIV. a. ab. Ab.cd. é ab.", "", None, "II. zz."]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    rows = df.select("k", F.explode(edits.occurrences(matching.remaining(F.col("text")))).alias("o")).select("k", "o.*")
    assert sorted(map(tuple, rows.collect())) == [(k, *o) for k, t in enumerate(texts) for o in spans.locate_remaining(t or "")]
    upper = matching.Patterned("[a-z]", lambda m: F.when(m != "b", F.upper(m))).script(F.col("text"), "#s")
    (got,) = spark.createDataFrame([("ab1cb",)], "text string").select(edits.marked(upper).alias("m"), edits.inserted(upper).alias("i"), edits.result(upper).alias("t"), upper.alias("s")).collect()
    assert (got.m, got.t, [tuple(i) for i in got.i]) == ("[[1|a]]b1[[2|c]]b", "Ab1Cb", [(0, 1), (3, 4)])
    assert [tuple(e) for e in got.s] == [("", "a", "A", "#s"), ("b", "", "", ""), ("1", "c", "C", "#s"), ("b", "", "", ""), ("", "", "", "")]
