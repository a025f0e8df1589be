"""Stand-ins for the corpus, its dictionary and its gold, made from the standard tables.

Each has a DataFrame form and a DuckDB form of the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import text
from .schema import RAW, PLACES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, volumes: int = 10) -> DataFrame:
    """documents as entries of ten volumes, or of nine: rules exist for nine, and resolution drops others."""
    return table(spark, sf_dir, "documents").select((F.col("doc_id") % volumes + 1).alias("volume"), F.col("doc_id").alias("entry"), "text")


CORPUS = "(SELECT doc_id % 10 + 1 AS volume, doc_id AS entry, text FROM documents)"


def regests(spark: SparkSession, sf_dir: str, volumes: int = 10) -> DataFrame:
    """conversations as headers and regests, without newlines in them, of ten volumes or nine."""
    line = F.regexp_replace("text", "\n", " ")
    rows = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") % volumes + 1).alias("volume"),
        F.col("conv_id").alias("entry"),
        F.col("turn").alias("line_no"),
        F.when(F.col("turn") == 0, line).alias("head_text"),
        F.when(F.col("turn") > 0, line).alias("body_text"),
    )
    return rows.withColumn("line_id", F.format_string("1%02d%05d-%d", "volume", "entry", "line_no"))


LINE = "replace(text, chr(10), ' ')"


def _cells(**given: str) -> tuple:
    return tuple(given.get(c, "") for c in RAW)


#: A dictionary of toy rows: continuation rows, alternatives, marks, volumes, other abbreviations.
RAW_ROWS = [
    _cells(abbr="eccl.", resolution="ecclesia", stem="ecclesi -e", declension="a", in_1="eccl.", in_2="eccl.; ecl.", in_3="eccl."),
    _cells(abbr="", resolution="ecclesiasticus", in_4="eccl."),
    _cells(abbr="dioc.", resolution="diocesis", stem="dioces -is", declension="i"),
    _cells(abbr="d.", resolution="dominus; dictus", in_1="d.", in_5="d."),
    _cells(abbr="nat.", resolution="navalis (def.)", in_2="nat."),
    _cells(abbr="def. nat. s. c.", resolution="defectus natalium (de soluto)", in_7="def. nat. s. c."),
    _cells(abbr="op.", resolution="oppidum ?", in_1="op.", in_2="oppidum"),
    _cells(abbr="decl.", resolution="declinare (dekliniert)", in_1="decl."),
    _cells(abbr="x.", resolution="?"),
    _cells(abbr="y.", resolution="cf.: z."),
    _cells(abbr="S.", resolution="sanctus", in_1="S.; SS."),
    _cells(abbr="s.", resolution="sanctus", in_2="s."),
    _cells(abbr="s.", resolution="Sanctus", in_3="s.", notes="again"),
    _cells(abbr="prep.", resolution="prepositus", stem="preposit -i", declension="o", in_1="prep.", in_2="prep."),
    _cells(abbr="prep.", resolution="prepositura", stem="prepositur -e", declension="a", in_2="prep.", in_3="prep."),
    _cells(abbr="th.", resolution="theologia", in_1="th.", in_8="th."),
    _cells(abbr="en.", resolution="enim", in_2="en."),
    _cells(abbr="the.", resolution="theologus", stem="theolog -i", declension="o", in_1="the.", in_2="the."),
    _cells(abbr="of.", resolution="officium", stem="only stem", declension="o", in_2="of."),
    _cells(abbr="de.", resolution="decanus; decretum", in_3="de."),
    _cells(abbr="and.", resolution="andreas", stem="andre -e", declension="weird"),
    _cells(abbr="la.", resolution="latus (lat.)", in_4="la.; lat."),
    _cells(abbr="que.", resolution="quedam", stem="?", declension="?", in_5="que.; quedam"),
]


#: Rows of the dictionaries that are made from the documents' abbreviations.
MINED_ROWS = 500


def _mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, abbr, word of the most frequent abbreviations of ASCII letters, by count and name."""
    from .operators import scan

    counts = scan.abbreviation_counts(corpus(spark, sf_dir), "text", most=1).where(F.col("abbreviation").rlike(r"^[a-z]{2,}\.$"))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "abbreviation"))
    best = scan.top(counts, "n", "abbreviation", MINED_ROWS).withColumn("k", rank.cast("long"))
    return best.select("k", F.col("abbreviation").alias("abbr"), F.rtrim("abbreviation", F.lit(".")).alias("word"))


_MINED = rf"""(SELECT row_number() OVER (ORDER BY n DESC, a) AS k, a AS abbr, rtrim(a, '.') AS word FROM (
    SELECT a, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}_]+\.')) AS a FROM documents) WHERE regexp_full_match(a, '[a-z]{{2,}}\.') GROUP BY a ORDER BY n DESC, a LIMIT {MINED_ROWS}))"""
#: Cells of a mined row, in SQL that both engines read: rows that go on, alternatives, marks, volumes, other spellings.
_RAW_CELLS = {
    "abbr": "CASE WHEN k % 6 = 0 THEN '' ELSE abbr END",
    "resolution": "CASE k % 5 WHEN 0 THEN concat(word, 'us') WHEN 1 THEN concat(word, 'a; ', word, 'um') WHEN 2 THEN concat(word, 'is ?') WHEN 3 THEN concat(word, 'are (dekliniert)') ELSE concat(word, 'ia') END",
    "notes": "CASE WHEN k % 7 = 0 THEN 'seen' ELSE '' END",
    **{c: f"CASE WHEN (k + {v}) % 4 = 0 THEN abbr WHEN (k + {v}) % 9 = 0 THEN concat(abbr, '; ', word, 'x.') WHEN (k + {v}) % 31 = 0 THEN concat(word, 'us') ELSE '' END" for v, c in enumerate(PLACES, 1)},
}


def raw_glossary(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    """The toy rows, then a row for each frequent abbreviation of the documents, if there are any."""
    schema = ", ".join(f"{c} string" for c in RAW) + ", row_order long"
    toy = spark.createDataFrame([(*r, k) for k, r in enumerate(RAW_ROWS)], schema)
    if not sf_dir:
        return toy
    own = [F.expr(_RAW_CELLS.get(c, "''")).alias(c) for c in RAW]
    return toy.unionByName(_mined(spark, sf_dir).select(*own, (F.col("k") + len(RAW_ROWS)).alias("row_order")))


def values(rows, names: list[str]) -> str:
    """Rows as a DuckDB table expression."""
    spell = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(map(spell, r)) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(names)}))"


_TOY_RAW = values([(*r, k) for k, r in enumerate(RAW_ROWS)], [*RAW, "row_order"])
RAW_SQL = f"(SELECT * FROM {_TOY_RAW} UNION ALL BY NAME SELECT {', '.join(f'{_RAW_CELLS.get(c, chr(39) * 2)} AS {c}' for c in RAW)}, k + {len(RAW_ROWS)} AS row_order FROM {_MINED} AS mined)"


def _clean(abbr: str, resolution: str, volumes: str, complex_: bool, *rg: int, stem=None, declension=None) -> tuple:
    return (abbr, resolution, stem, declension, *[abbr if v in rg else None for v in range(1, 10)], volumes, complex_)


#: A clean glossary: rules for every volume, for some, ambiguous ones, and complex entries.
CLEAN_NAMES = ["abbr", "resolution", "stem", "declension", *PLACES, "volumes", "complex"]
CLEAN_ROWS = [
    _clean("the.", "theologus", "1|2", False),
    _clean("of.", "officium", "1|2|3", False, 1, 2, 3),
    _clean("of.", "officialis", "3|4", False, 3, 4),
    _clean("and.", "andreas", "1", False, 1, 2, 9),
    _clean("en.", "enim", "2", True, 2),
    _clean("en.", "encomium", "2|5", True),
    _clean("de.", "decanus", "", True, 1),
    _clean("is.", "is", "4", False),
    _clean("is.", "iste", "4", False, 4),
    _clean("er.", "erat", "", False, 5, 6, 7),
    _clean("que.", "quedam", "1|9", False, 8),
]
DIOCESES = [("th.", "Thoruniensis"), ("an.", "Andegavensis"), ("the. an.", "Theatinus")]


#: Cells of a clean row that is made from an abbreviation: one reading or two, in every volume or in some.
_CLEAN_CELLS = {
    "abbr": "abbr",
    "resolution": "CASE WHEN j = 1 THEN concat(word, 'us') ELSE concat(word, 'ia') END",
    "stem": "CAST(NULL AS string)",
    "declension": "CAST(NULL AS string)",
    **{c: f"CASE WHEN k % 8 <> 0 AND ((k + {v} + j) % 3 = 0 OR (k + {v}) % 5 = 0) THEN abbr END" for v, c in enumerate(PLACES, 1)},
    "volumes": "CASE WHEN k % 3 = 0 THEN '1|2|5' WHEN k % 3 = 1 THEN '3|4|7|9' ELSE '' END",
    "complex": "k % 10 = 3",
}


def glossary(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    """The toy rows, then one or two rows for each frequent abbreviation of the documents, if there are any."""
    schema = ", ".join(f"{c} {'boolean' if c == 'complex' else 'string'}" for c in CLEAN_NAMES)
    toy = spark.createDataFrame(CLEAN_ROWS, schema)
    if not sf_dir:
        return toy
    taken = [r[0] for r in CLEAN_ROWS] + [a for a, _ in DIOCESES]
    both = _mined(spark, sf_dir).where(~F.col("abbr").isin(taken)).withColumn("j", F.explode(F.sequence(F.lit(1), F.when(F.col("k") % 4 == 1, 2).otherwise(1))))
    return toy.unionByName(both.select(*[F.expr(_CLEAN_CELLS[c]).alias(c) for c in CLEAN_NAMES]))


def dioceses(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    return spark.createDataFrame(DIOCESES, "abbreviation string, resolution string")


_TOY_CLEAN = values(CLEAN_ROWS, CLEAN_NAMES)
_TAKEN = ", ".join(f"'{a}'" for a in [r[0] for r in CLEAN_ROWS] + [a for a, _ in DIOCESES])
CLEAN_SQL = f"(SELECT * FROM {_TOY_CLEAN} UNION ALL BY NAME SELECT {', '.join(f'{_CLEAN_CELLS[c]} AS {c}' for c in CLEAN_NAMES)} FROM (SELECT *, unnest(range(1, CASE WHEN k % 4 = 1 THEN 3 ELSE 2 END)) AS j FROM {_MINED} WHERE abbr NOT IN ({_TAKEN})))"
DIOCESE_SQL = values(DIOCESES, ["abbreviation", "resolution"])

MORPHOLOGY = [
    ("ecclesia", "ecclesi -e", "a"),
    ("ordo", "ordin -is", "kons."),
    ("annus", "ann -i", "o"),
    ("altare", "altar -is", "i (n.)"),
    ("silva antiqua", "silv -e; antiqu -e", "a; o/a (Adj.)"),
    ("presbiter", "presbiter -i", "o"),
    ("arma", "arm -orum", "o (n.) (Pl.)"),
    ("providere", "provide, provid, provis", "e-Konj."),
    ("progredi", "progred, -, progress", "halbkons.-Konj. (Dep.)"),
    ("taxare", "tax, taxav, taxat", "a-Konj."),
    ("et", "et", "-"),
    ("litterae", "?", "?"),
    (None, None, None),
]


def morphology(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    return spark.createDataFrame(MORPHOLOGY, "resolution string, stem string, declension string")


#: Rules of the stand-in dictionaries, of one part and of two.
RULES, PAIRS = 2000, 500


def mined_rules(spark: SparkSession, sf_dir: str, most: int = RULES) -> DataFrame:
    """The most frequent abbreviations as rules of every volume: upper case between brackets."""
    from .operators import scan

    counts = scan.abbreviation_counts(corpus(spark, sf_dir), "text", most=1)
    best = scan.top(counts, "n", "abbreviation", most).select("abbreviation")
    word = F.rtrim(F.col("abbreviation"), F.lit("."))
    return best.select(F.explode(F.sequence(F.lit(1).cast("long"), F.lit(9).cast("long"))).alias("volume"), F.col("abbreviation").alias("abbr"), F.concat(F.lit("<"), word, F.lit(">")).alias("resolution"), F.lit(1).alias("parts"))


def plain_rules(spark: SparkSession, sf_dir: str, most: int = RULES) -> DataFrame:
    """The most frequent abbreviations of ASCII letters as rules of every volume: an ending and a hyphen."""
    from .operators import scan

    counts = scan.abbreviation_counts(corpus(spark, sf_dir), "text", most=1).where(F.col("abbreviation").rlike(r"^[A-Za-z]+\.$"))
    best = scan.top(counts, "n", "abbreviation", most).select("abbreviation")
    full = F.concat(F.rtrim(F.col("abbreviation"), F.lit(".")), F.lit("um-"))
    return best.select(F.explode(F.sequence(F.lit(1).cast("long"), F.lit(9).cast("long"))).alias("volume"), F.col("abbreviation").alias("abbr"), full.alias("resolution"), F.lit(1).alias("parts"))


def paired_rules(spark: SparkSession, sf_dir: str, most: int = PAIRS) -> DataFrame:
    """Plain rules, and the most frequent abbreviations of two parts, each with three words in its place.

    The first part has an even number of characters and the second an odd one, so no two overlap.
    """
    from .operators import scan

    counts = scan.abbreviation_counts(corpus(spark, sf_dir), "text", most=2).where(F.col("abbreviation").rlike(PAIR))
    first, second = F.split_part("abbreviation", F.lit(" "), F.lit(1)), F.split_part("abbreviation", F.lit(" "), F.lit(2))
    best = scan.top(counts.where((F.length(first) % 2 == 0) & (F.length(second) % 2 == 1)), "n", "abbreviation", most)
    full = F.concat(F.rtrim(first, F.lit(".")), F.lit("um xx "), F.rtrim(second, F.lit(".")), F.lit("um-"))
    pairs = best.select(F.explode(F.sequence(F.lit(1).cast("long"), F.lit(9).cast("long"))).alias("volume"), F.col("abbreviation").alias("abbr"), full.alias("resolution"), F.lit(2).alias("parts"))
    return plain_rules(spark, sf_dir).unionByName(pairs)


PAIR = r"^[A-WYZa-wyz][A-Za-z]*\. [A-WYZa-wyz][A-Za-z]*\.$"
PLAIN_SQL = r"(SELECT a AS abbr, rtrim(a, '.') || 'um-' AS resolution FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+\.')) AS a FROM documents) WHERE regexp_full_match(a, '[A-Za-z]+\.') GROUP BY a ORDER BY count(*) DESC, a LIMIT " + f"{RULES})"

W = r"[\p{L}\p{M}\p{N}_]"
MINED_SQL = f"(SELECT a AS abbr, '<' || rtrim(a, '.') || '>' AS resolution FROM (SELECT unnest(regexp_extract_all(text, '{W}+\\.')) AS a FROM documents) GROUP BY a ORDER BY count(*) DESC, a LIMIT {RULES})"


def occurrence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of abbreviations of documents with gold and four stages made from their words.

    Which stage settles an occurrence, and how well, follows from a word's length and letters.
    """
    docs = corpus(spark, sf_dir)
    rows = docs.select("volume", "entry", F.posexplode(text.remaining(F.col("text"))).alias("pos", "abbr"))
    stem = F.rtrim(F.col("abbr"), F.lit("."))
    n = F.length("abbr") + F.col("pos")
    gold = F.when(n % 11 == 0, F.lit(None)).when(n % 13 == 0, F.col("abbr")).otherwise(F.concat(stem, F.lit("ia")))
    good = F.when(n % 5 == 0, F.concat(stem, F.lit("ie"))).when(n % 7 == 0, F.concat(stem, F.lit("ya"))).when(n % 17 == 0, F.lit("aliud")).otherwise(F.concat(stem, F.lit("ia")))
    stage = lambda k: F.when(n % 4 < k, F.when(F.lit(k == 4), good).otherwise(F.concat(stem, F.lit("ia")))).when(n % 19 == 0, F.lit(None)).otherwise(F.col("abbr"))
    return rows.withColumn("gold", gold).withColumn("resolutions", F.array(*[stage(k) for k in range(1, 5)]))


def long_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a row for each stage."""
    from .operators import score

    return score.each_stage(occurrence_table(spark, sf_dir)).select("volume", "entry", "pos", "abbr", "gold", "stage", "resolution")


def lemmas(spark: SparkSession) -> DataFrame:
    """A lemma index that knows some of the stand-in's words."""
    words = ["theia", "theie", "isia", "isie", "ofia", "ofie", "enia", "enie", "andia", "andie"]
    rows = [(w, w[:-1] + "a") for w in words]
    return spark.createDataFrame(rows, "key string, lemma string")


MANIFESTS = [
    ("base", 1, None, None, "base/step1.csv"),
    ("base", 2, "m1", "base/step1.csv", "runs/base/step2.csv"),
    ("base", 3, "m1", "runs/base/step2.csv", "runs/base/step3.csv"),
    ("base", 4, "m1", "runs/base/step3.csv", "runs/base/step4.csv"),
    ("fork", 2, "m2", "base/step1.csv", "runs/fork/step2.csv"),
    ("fork", 3, "m2", "runs/base/step2.csv", "runs/fork/step3.csv"),
    ("lost", 3, "m3", "runs/gone/step2.csv", "runs/lost/step3.csv"),
    ("loop", 2, "m4", "runs/loop/step3.csv", "runs/loop/step2.csv"),
    ("loop", 3, "m4", "runs/loop/step2.csv", "runs/loop/step3.csv"),
]
MANIFEST_NAMES = ["run", "step", "model", "input", "output"]


def manifests(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    """The toy entries, for tests."""
    return spark.createDataFrame(MANIFESTS, "run string, step int, model string, input string, output string")


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step for each event: a user's events are a run, each reading what the one before wrote.

    A run's first step reads the first output of the user before, seven users in a row; some runs
    read their own last output, so that their files lead in a circle.
    """
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").where("user_id is not null").withColumn("step", F.row_number().over(own)).withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    file = lambda user, step: F.concat(F.lit("u"), user.cast("string"), F.lit("/s"), step.cast("string"))
    u, k = F.col("user_id"), F.col("step")
    start = F.when(u % 11 == 3, file(u, F.col("n"))).when(u % 7 != 0, file(u - 1, F.lit(1)))
    return rows.select(
        F.concat(F.lit("u"), u.cast("string")).alias("run"),
        k.cast("int").alias("step"),
        F.col("event_type").alias("model"),
        F.when(k == 1, start).otherwise(file(u, k - 1)).alias("input"),
        file(u, k).alias("output"),
        F.col("value").alias("word_accuracy"),
        (F.col("value") / 2).alias("form_accuracy"),
    )


#: The same, with what lies behind a user's first step: users in a row (island), and whether it is a circle.
EVENT_RUNS = """
WITH steps AS (SELECT user_id AS u, event_type AS model, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE user_id IS NOT NULL),
users AS (SELECT DISTINCT u FROM steps),
islands AS (SELECT u, u - row_number() OVER (PARTITION BY u // 7 ORDER BY u) AS island FROM users),
back AS (SELECT u, row_number() OVER w - 1 AS users_behind, min(u) OVER (PARTITION BY u // 7, island) AS origin, bool_or(u % 11 = 3) OVER w AS circular FROM islands WINDOW w AS (PARTITION BY u // 7, island ORDER BY u)),
runs AS (SELECT s.*, b.users_behind, b.origin, b.circular, 'u' || u AS run, 'u' || u || '/s' || k AS output FROM steps s JOIN back b USING (u))"""


MANIFEST_SQL = values(MANIFESTS, MANIFEST_NAMES)
PAIRS_SQL = rf"""(SELECT a AS abbr, rtrim(string_split(a, ' ')[1], '.') || 'um xx ' || rtrim(string_split(a, ' ')[2], '.') || 'um-' AS resolution FROM (
    SELECT ltrim(p[i]) || ' ' || ltrim(p[i + 1]) AS a, p[i + 1][1] = ' ' AS apart FROM (SELECT p, unnest(range(1, len(p))) AS i FROM (SELECT regexp_extract_all(r, ' ?{W}+\.') AS p FROM (SELECT unnest(regexp_extract_all(text, '{W}+\.(?: ?{W}+\.)*')) AS r FROM documents))))
    WHERE apart AND regexp_full_match(a, '{PAIR[1:-1]}') AND length(string_split(a, ' ')[1]) % 2 = 0 AND length(string_split(a, ' ')[2]) % 2 = 1 GROUP BY a ORDER BY count(*) DESC, a LIMIT {PAIRS})"""
