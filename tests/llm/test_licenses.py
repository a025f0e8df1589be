import math
import random
import time
from collections import Counter

from pyspark.sql import functions as F
from sigla.llm import licenses
from sigla.llm.queries import op3_license_scan

SF = "/root/testdata/sf0.001"


def plain(files):
    """(id, path, text) to own license and score, by dense comparison of every header."""
    holders = Counter(t for _, _, x in files for t in set(licenses.terms(x or "")))
    idf = lambda t: 1 + math.log((1 + len(files)) / (1 + (holders[t] if t in licenses.VOCABULARY else 0)))

    def cosine(a, b):
        a, b = Counter(licenses.terms(a)), Counter(licenses.terms(b))
        dot = sum(a[t] * b[t] * idf(t) ** 2 for t in a)
        norm = lambda v: math.sqrt(sum((n * idf(t)) ** 2 for t, n in v.items()))
        return dot / norm(a) / norm(b) if a and b else 0.0

    notices = [(name, t) for name, ts in licenses.TEMPLATES.items() for t in ts]
    keyed = licenses.KEY_TERMS.search
    out = {}
    for i, path, text in files:
        heads = set()
        for line in filter(keyed, (text or "").split("\n")):
            own = licenses.terms(line)
            runs = [" ".join(own[k : k + n]) for _, t in notices for n in [len(licenses.terms(t))] for k in range(max(1, len(own) - n + 1))]
            heads |= {line, *filter(keyed, runs), *filter(keyed, line.split(". "))}
        pairs = [(h, name, t) for h in heads for name, t in notices]
        if text and licenses.LICENSE_FILE.search(path or ""):
            full = [(text, name, t) for name, t in licenses.TEXTS.items()]
            pairs = full if max(cosine(h, t) for h, _, t in full) >= 0.9 else [*pairs, *full, *((text, *x) for x in notices)]
        best = max(((round(cosine(h, t), 6), name) for h, name, t in pairs), default=(0.0, None), key=lambda m: m[0])
        out[i, path] = best[::-1] if best[0] >= licenses.THRESHOLD else (None, 0.0)
    return out


def test_query_equals_dense_scan_and_walk_up(spark):
    rows = op3_license_scan(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    own = plain([(r.doc_id, r.path, texts[r.doc_id]) for r in rows])
    assert any(name for name, _ in own.values())
    told = {}
    for (_, path), (name, score) in own.items():
        if name:
            folder = path.rpartition("/")[0]
            told[folder] = min(told.get(folder, (0, "~")), (-score, name))
    for r in rows:
        name, score = own[r.doc_id, r.path]
        assert r.own_license == name and abs(r.own_score - score) < 2e-6
        folder = r.path
        while name is None and "/" in folder:
            folder = folder.rpartition("/")[0]
            name = told.get(folder, (0, None))[1]
        assert r.license == name and r.license_from == (None if name is None else r.path if r.own_license else folder)


def test_nulls_names_and_clashing_columns(spark):
    mit = "\n".join(licenses.TEMPLATES["MIT"])
    rows = [(1, "a/LICENSE", mit), (2, "a/b/c.py", "x = 1"), (3, "a/b/d.py", "# Licensed under the Apache License, Version 2.0.\nx"), (4, None, None), (5, "top.py", ""), (2, "a/b/c.py", "x = 1"), (6, "q/r/s", "licensed " + "word " * 50_000), (7, "ab/c", "")]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, path string, text string, license int")
    files = licenses.scanned(df).withColumn("told", F.col("path").rlike("LICENSE$"))
    got = sorted(((r.doc_id, r.own_license, r.license, r.license_from) for r in licenses.inherited(files, "told").collect()), key=str)
    assert got == [
        (1, "MIT", "MIT", "a/LICENSE"),
        (2, None, "MIT", "a"),
        (2, None, "MIT", "a"),
        (3, "Apache-2.0", "Apache-2.0", "a/b/d.py"),
        (4, None, None, None),
        (5, None, None, None),
        (6, None, None, None),
        (7, None, None, None),
    ]
    assert licenses.inherited(licenses.scanned(df.limit(0)).withColumn("told", F.col("path").isNotNull()), "told").count() == 0


def test_notices_in_long_lines_without_a_sentence_end(spark):
    words = " ".join(f"word{k}" for k in range(120))
    notices = [(name, x) for name, texts in licenses.TEMPLATES.items() for x in texts]
    files, wanted = [], []
    for left, right in (("! ", "! "), ("; ", "? "), (" ", " "), (". Then ", " "), (" ", " and that. ")):
        for name, notice in notices:
            files.append((len(files), f"f{len(files)}", words + left + notice + right + words))
            wanted.append(name)
    files += [(len(files), "none", words + " licensed! " + words), (len(files) + 1, "end", words + " copyright")]
    # Apart from headers(): every run of terms as long as a template is compared, wherever it is.
    for (*_, text), name in zip(files, wanted):
        own = licenses.terms(text)
        runs = {(n, tuple(t)) for n, x in notices for t in [licenses.terms(x)] if any(own[i : i + len(t)] == t for i in range(len(own)))}
        assert name in {n for n, _ in runs}
    df = spark.createDataFrame(files, "doc_id long, path string, text string")
    got = {r.doc_id: (r.own_license, r.own_score) for r in licenses.scanned(df).collect()}
    assert [got[i][0] for i in range(len(wanted))] == wanted
    assert {got[i][1] for i in range(3 * len(notices))} == {1.0}  # "v. 2.0" ends a sentence where there are others
    assert got[len(wanted)] == got[len(wanted) + 1] == (None, 0.0)


def test_whole_license_files(spark):
    files = [(k, f"p{k}/LICENSE", text.replace("(c)", f"(c) 20{k + 10} Some Body and others")) for k, text in enumerate(licenses.TEXTS.values())]
    files += [(100 + k, f"p{k}/src/deep/x.py", "print(1)") for k in range(len(files))]
    files += [(200, "q/COPYING", "word " * 300), (201, "q/y.py", "")]
    df = spark.createDataFrame(files, "doc_id long, path string, text string")
    found = licenses.scanned(df).withColumn("told", F.col("path").rlike("LICENSE$|COPYING$"))
    got = {r.doc_id: (r.license, r.own_score) for r in licenses.inherited(found, "told").collect()}
    for k, name in enumerate(licenses.TEXTS):
        assert got[k][0] == name and got[k][1] > 0.95
        assert got[100 + k] == (name, 0.0)
    assert got[200] == got[201] == (None, 0.0)


def test_license_in_a_very_long_line(spark):
    matcher = licenses.Matcher(10, {})
    notice = licenses.TEMPLATES["Apache-2.0"][0]
    for filler in ("word ", "license ", "mit apache "):
        text = filler * (2_500_000 // len(filler)) + notice + " " + filler * (2_500_000 // len(filler))
        began = time.process_time()
        score, name = matcher.scan(text, False)
        assert (name, score) == ("Apache-2.0", 1.0)
        assert time.process_time() - began < 20  # some seconds; by a slice for each term it was hours


def test_windows_equal_all_windows():
    rng = random.Random(2)
    matcher = licenses.Matcher(50, {t: rng.randrange(50) for t in licenses.VOCABULARY})
    pool = ["license", "mit", "the", "released", "under", "zero", "word", "apache", "2.0", "version"]
    for _ in range(60):
        own = [rng.choice(pool) for _ in range(rng.randrange(1, 120))]
        runs = {" ".join(own[k : k + n]) for n in licenses.LENGTHS for k in range(max(1, len(own) - n + 1))}
        want = max((matcher.best(r, matcher.notices)[0] for r in runs if licenses.KEY_TERMS.search(r)), default=0.0)
        assert abs(matcher.best_window(" ".join(own))[0] - want) < 2e-6


def test_clashing_names_in_any_case(spark):
    df = spark.createDataFrame([(1, "a/LICENSE", "Released under the MIT License", 7, "x", "y")], "doc_id long, path string, text string, li_dir int, Of string, LICENSE string")
    files = licenses.scanned(df).withColumn("told", F.col("path").isNotNull())
    got = licenses.inherited(files, "told").first()
    assert (got["li_dir"], got["Of"], got["license"], got["license_from"]) == (7, "x", "MIT", "a/LICENSE")


def test_a_notice_counts_wherever_it_stands_in_a_line(spark):
    notice = "Released under the MIT License"
    files = [(n, f"f{n}", "foo bar " * n + notice + " baz" * (n % 3)) for n in (0, 1, 10, 45, 60, 400)]
    got = licenses.scanned(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()
    assert {(r.own_license, r.own_score) for r in got} == {("MIT", 1.0)}


def test_full_texts_of_any_length_are_license_files_of_the_query(spark):
    texts = dict(enumerate(licenses.TEXTS.values(), 1000)) | {1100: "just a text\nof two lines", 1101: ""}
    docs = spark.createDataFrame([(k, t, "src", "en") for k, t in texts.items()], "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r for r in licenses.licensed(docs).collect()}
    for k, name in enumerate(licenses.TEXTS, 1000):
        assert got[k].own_license == name and got[k].own_score > 0.95 and "/LICENSE-" in got[k].path
    assert got[1100].own_license is None and got[1100].path.endswith("/1100.txt")
