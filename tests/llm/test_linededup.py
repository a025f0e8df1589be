from collections import Counter, defaultdict

from sigla.llm import linededup


def plain(rows, ratio):
    """(host, text) rows to (text, lines, dropped), by the definition."""
    pages = defaultdict(list)
    for host, text in rows:
        if text is not None:
            pages[host].append(text)
    worded = lambda x: any(c not in " \t\n\v\f\r" for c in x)
    bad = {}
    for host, texts in pages.items():
        counts = Counter(x for t in texts for x in set(t.split("\n")) if worded(x))
        bad[host] = {x for x, c in counts.items() if c > 1 and c > ratio * len(texts)}
    out = []
    for host, text in rows:
        lines = [] if text is None else text.split("\n")
        kept = [x for x in lines if x not in bad[host]]
        out.append((host, text, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_equals_definition(spark):
    rows = [("a", f"menu\nbody {i}\n\nmenu\nfoot") for i in range(10)] + [("a", "menu")] * 4 + [("a", "one\nother")]
    rows += [("b", f"menu\nonly {i}") for i in range(2)] + [(None, f"x\ny {i % 7}\n \n") for i in range(30)]
    rows += [("a", None), ("b", ""), (None, None), ("c", "\n" * 1000), ("d", "same\n" * 5000), ("b", " \n\t")]
    df = spark.createDataFrame([(h, t, 1, 2) for h, t in rows], "host string, text string, line int, n_dropped int")
    for ratio in (0.07, 0.5, 0.95):
        got = linededup.without_boilerplate(df, ratio=ratio)
        assert got.columns == ["host", "text", "line", "clean_text", "n_lines", "n_dropped"]
        assert sorted(((r.host, r.text, r.clean_text, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == plain(rows, ratio)
    assert linededup.without_boilerplate(df.limit(0)).count() == 0


def test_copies_weigh_in_both_counts(spark):
    rows = [("a", f"common\npage {i}") for i in range(8)] + [("a", "copied\nbody")] * 92
    df = spark.createDataFrame(rows, "host string, text string")
    got = {r.text: r.clean_text for r in linededup.without_boilerplate(df, ratio=0.07).collect()}
    assert got["copied\nbody"] == "" and got["common\npage 3"] == "page 3"  # 92 and 8 pages of 100
    rows = rows[:7] + rows[8:] + [("a", "other")]
    got = {r.text: r.clean_text for r in linededup.without_boilerplate(spark.createDataFrame(rows, "host string, text string")).collect()}
    assert got["common\npage 3"] == "common\npage 3" and got["other"] == "other"  # 7 of 100 do not exceed 0.07


def test_any_name_passes_through(spark):
    names = ["goes", "GOES2", "drop", "of", "row", "clean", "all", "gone", "n", "t1", "h1", "host_", "i", "line_pages"]
    df = spark.createDataFrame([("s", "x\ny", *names), ("s", "x\nz", *names)], ", ".join(f"`{c}` string" for c in ["host", "text", *names]))
    got = linededup.without_boilerplate(df, ratio=0.5)
    assert got.columns == ["host", "text", *names, "clean_text", "n_lines", "n_dropped"]
    assert sorted((r.clean_text, tuple(r[c] for c in names)) for r in got.collect()) == [("y", tuple(names)), ("z", tuple(names))]


def test_very_long_lines(spark):
    long = "word " * 400_000
    rows = [("a", f"{long}\n{i}") for i in range(3)] + [("a", long + "x\nother")]
    got = linededup.without_boilerplate(spark.createDataFrame(rows, "host string, text string"), ratio=0.5)
    assert sorted(r.clean_text for r in got.collect()) == ["0", "1", "2", long + "x\nother"]
