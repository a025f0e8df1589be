"""The command line, from a raw dictionary to marked-up entries."""

import json
import os

from sigla import cli, stand_in
from sigla.schema import PLACES, RAW
from sigla.sources import tables


def test_steps_from_the_command_line(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    rows = [(3, 1, 0, "of. the. op.", None, "10300001-0"), (3, 1, 1, None, "decanus mol. x. mol", "10300001-1"), (4, 2, 0, "the. molendinum molendinum", None, "10400002-0")]
    corpus = spark.createDataFrame(rows, "volume long, entry long, line_no long, head_text string, body_text string, line_id string")
    tables.write_csv(corpus, at("corpus"), write=True)
    spark.createDataFrame(stand_in.RAW_ROWS, ", ".join(f"{c} string" for c in RAW)).coalesce(1).write.options(header=True).csv(at("raw"))
    (tmp_path / "edits.json").write_text(json.dumps([{"match": {"abbr": "op.", "resolution": "oppidum ?"}, "put": {"notes": "edited"}}]))
    told = cli.main(["extract", at("raw"), at("corpus"), at("glossary"), "--corrections", at("edits.json")], spark)
    assert "## Decisions" in told and "Not in corpus" in told and not os.path.exists(at("glossary"))

    names = [*RAW, "volumes", "complex"]
    known = [("the.", "theologus", "theolog -i", "o", False), ("of.", "officium", "offici -i", "o", True), ("of.", "officialis", "official -is", "i", True)]
    cells = [tuple({"abbr": a, "resolution": r, "stem": s, "declension": d, "complex": c}.get(n) for n in names) for a, r, s, d, c in known]
    listed = spark.createDataFrame(cells, ", ".join(f"{n} {'boolean' if n == 'complex' else 'string'}" for n in names))
    tables.write_csv(listed, at("known"), write=True, one_file=True)
    tables.write_csv(stand_in.dioceses(spark), at("dioceses"), write=True)
    assert "Rules by volume" in cli.main(["expand", at("corpus"), at("known"), at("dioceses"), at("one"), "--write"], spark)
    assert {r.head_text for r in tables.read_regests(spark, at("one")).collect()} == {"of. theologus op.", None, "theologus molendinum molendinum"}

    told = cli.main(["step", "2", at("one"), at("two"), at("check2"), "--glossary", at("known"), "--run", "r", "--manifests", at("runs"), "--write"], spark)
    assert "| choice | 1 |" in told
    cli.main(["step", "3", at("two"), at("three"), at("check3"), "--corpus", at("corpus"), "--run", "r", "--manifests", at("runs"), "--write"], spark)
    lines = {r.line_id: r.head_text or r.body_text for r in tables.read_regests(spark, at("three")).collect()}
    assert lines["10300001-0"] == "officialis theologus op." and lines["10300001-1"] == "decanus molendinum x. mol"
    assert tables.read_dump(spark, at("three-dump")).count() == 2 and "| r | 3 |" in cli.main(["lineage", at("runs")], spark)

    told = cli.main(["markup", at("corpus"), at("one"), at("two"), at("three"), "--out", at("tei"), "--manifests", at("runs"), "--run", "r", "--write"], spark)
    xml = "\n".join(r.value for r in spark.read.text(at("tei")).collect())
    assert "| accepted | 3 |" in told and '<expan resp="#step2">officialis</expan>' in xml and 'xml:id="step3"' in xml
    assert len(PLACES) == 9


def test_scores_from_the_command_line(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    for name, text in (("source", "the. of. x"), ("gold", "theologi officium x"), ("one", "theologus of. x"), ("two", "theologus officium x"), ("three", "theologus officium x"), ("four", "theologi officium x")):
        tables.write_csv(spark.createDataFrame([(1, 1, text)], "volume long, entry long, text string"), at(name), write=True)
    names = [*RAW, "volumes", "complex"]
    cells = [tuple({"abbr": "the.", "resolution": "theologus", "stem": "theolog -i", "declension": "o", "complex": True}.get(n) for n in names)]
    tables.write_csv(spark.createDataFrame(cells, ", ".join(f"{n} {'boolean' if n == 'complex' else 'string'}" for n in names)), at("known"), write=True)
    told = cli.main(["evaluate", at("source"), at("gold"), at("one"), at("two"), at("three"), at("four"), "--glossary", at("known"), "--out", at("out"), "--write"], spark)
    assert "## Stages" in told and "100.0 %" in told and os.path.exists(at("out-by-abbreviation"))


def test_sender_of_a_model(tmp_path):
    a = cli.parser().parse_args(["step", "2", "i", "o", "c", "--sender", "json:dumps", "--model", "gemma-4-x", "--thinking", "off", "--spacing", "0"])
    chooser = cli._chooser(a)
    assert chooser.model.settings == {"extra_body": {"chat_template_kwargs": {"enable_thinking": False}}} and chooser.model.send is json.dumps
    (tmp_path / "answers.json").write_text('[{"text": "t", "answer": "{}"}]')
    a = cli.parser().parse_args(["step", "2", "i", "o", "c", "--answers", str(tmp_path / "answers.json")])
    assert cli._chooser(a).given == {"t": ["{}"]}
