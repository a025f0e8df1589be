"""Queries over the standard tables, one for each operator, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stand_in as S
from .functions import answers, edits, matching, spans, text
from .operators import candidates, glossary, lexicon, rules, runs, scan, score, tei, vita
from .plans import evaluation, steps
from .schema import PLACES
from .sources import shared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
W = S.W


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- SQL building blocks ----------------------------------------------------------------------

def grams_sql(of: str = "documents", column: str = "text", keys: str = "") -> str:
    """All grams of a text: windows of 1 to 5 parts over runs of words with periods."""
    return f"""
WITH runs AS (SELECT {keys} unnest(regexp_extract_all({column}, '{W}+\\.(?: ?{W}+\\.)*')) AS r FROM {of}),
parts AS (SELECT {keys} regexp_extract_all(r, ' ?{W}+\\.') AS p FROM runs),
starts AS (SELECT {keys} p, k, unnest(range(1, len(p) - k + 2)) AS i FROM parts, range(1, 6) AS a(k)),
grams AS (SELECT {keys} ltrim(array_to_string(list_slice(p, i, i + k - 1), '')) AS abbreviation FROM starts)"""


TOKENS = f"unnest(regexp_extract_all(text, '{W}+\\.?'))"
VOCABULARY = f"(SELECT t AS word, count(*) AS n FROM (SELECT {TOKENS} AS t FROM documents) WHERE regexp_full_match(t, '[A-Za-z]{{3,}}') GROUP BY t)"


def remaining_sql(keys: str, of: str) -> str:
    picked = f"list_filter(regexp_extract_all(text, '{W}+\\.?'), lambda t: regexp_full_match(t, '[A-Za-z]{{2,}}\\.') AND NOT regexp_full_match(t, '[IVXLCDM]+\\.'))"
    return f"(SELECT {keys}, unnest(l) AS abbreviation, unnest(range(1, len(l) + 1)) AS id FROM (SELECT {keys}, {picked} AS l FROM {of}))"


def key_sql(word: str) -> str:
    plain = f"translate(replace(replace(trim(lower({word}), '.,;:?!()[]'), 'ae', 'e'), 'oe', 'e'), 'jvy', 'iui')"
    return f"(SELECT array_to_string(list_filter(s, lambda c, i: i = 1 OR c <> s[i - 1]), '') FROM (SELECT string_split(CASE WHEN {plain} = '' THEN NULL ELSE {plain} END, '') AS s))"


# --- scans ------------------------------------------------------------------------------------


@query(f"SELECT a AS abbreviation, 1 AS parts, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{W}+\\.')) AS a FROM documents) GROUP BY a")
def abbrev_counts_1gram(spark, sf_dir):
    return scan.abbreviation_counts(S.table(spark, sf_dir, "documents"), "text", most=1)


@query(grams_sql() + " SELECT abbreviation, len(string_split(abbreviation, ' ')) AS parts, count(*) AS n FROM grams GROUP BY ALL")
def abbrev_counts_ngram(spark, sf_dir):
    return scan.abbreviation_counts(S.table(spark, sf_dir, "documents"), "text")


@query(f"SELECT volume, CAST(sum(len(regexp_extract_all(text, '{W}+\\.'))) AS BIGINT) AS n, CAST(sum(len(regexp_extract_all(text, '[a-zA-Z]{{2,}}\\.'))) AS BIGINT) AS n_left FROM {S.CORPUS} GROUP BY volume")
def abbrev_total_by_volume(spark, sf_dir):
    docs = S.corpus(spark, sf_dir)
    return docs.groupBy("volume").agg(F.sum(text.count_abbreviations(F.col("text"))).alias("n"), F.sum(text.count_left(F.col("text"))).alias("n_left"))


@query(grams_sql() + f" SELECT DISTINCT unnest([abbreviation, regexp_replace(abbreviation, '\\.({W})', '. \\1', 'g')]) AS abbreviation FROM grams")
def abbrev_distinct(spark, sf_dir):
    return scan.distinct_abbreviations(S.table(spark, sf_dir, "documents"), "text")


@query(grams_sql() + " SELECT abbreviation, count(*) AS n FROM grams GROUP BY abbreviation ORDER BY n DESC, abbreviation LIMIT 20")
def abbrev_top20(spark, sf_dir):
    return scan.top(scan.abbreviation_counts(S.table(spark, sf_dir, "documents"), "text").select("abbreviation", "n"), "n", "abbreviation", 20)


@query(f"SELECT word, n FROM {VOCABULARY}")
def vocabulary(spark, sf_dir):
    return scan.vocabulary(S.table(spark, sf_dir, "documents"))


@query(f"SELECT doc_id, CAST(id AS INTEGER) AS id, abbreviation FROM {remaining_sql('doc_id', 'documents')}")
def remaining_occurrences(spark, sf_dir):
    return scan.remaining(S.table(spark, sf_dir, "documents"), "doc_id")


PIECES = f"regexp_extract_all(text, '(?s){W}+\\.|{W}+|[^\\p{{L}}\\p{{M}}\\p{{N}}_]+')"
STANDS = "regexp_full_match(t, '[A-Za-z]{2,}\\.') AND NOT regexp_full_match(t, '[IVXLCDM]+\\.')"


@query(f"""
WITH p AS (SELECT doc_id, i, l[i] AS t FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, {PIECES} AS l FROM documents))),
placed AS (SELECT doc_id, i, t, CAST(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS stop FROM p)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS id, t AS abbreviation, CAST(stop - length(t) AS INTEGER) AS start, stop AS "end" FROM placed WHERE {STANDS}""")
def remaining_offsets(spark, sf_dir):
    found = S.table(spark, sf_dir, "documents").select("doc_id", matching.remaining(F.col("text")).alias("found"))
    docs = found.select("doc_id", F.explode(edits.occurrences(F.col("found"))).alias("o"))
    return docs.select("doc_id", "o.id", "o.abbreviation", "o.start", "o.end")


@query(f"""
WITH words AS (SELECT * FROM {VOCABULARY} WHERE n >= 2), abbrs AS (SELECT DISTINCT abbreviation FROM {remaining_sql('doc_id', 'documents')}),
stems AS (SELECT abbreviation, unnest(CASE WHEN length(s) >= 2 AND s[-1] = s[-2] THEN [s, s[:-2]] ELSE [s] END) AS stem FROM (SELECT abbreviation, rtrim(abbreviation, '.') AS s FROM abbrs)),
heads AS (SELECT word, n, word[1:k] AS stem FROM (SELECT word, n, unnest(range(1, length(word))) AS k FROM words)),
found AS (SELECT DISTINCT abbreviation, word, n FROM stems JOIN heads USING (stem)),
ranked AS (SELECT abbreviation, CAST(row_number() OVER (PARTITION BY abbreviation ORDER BY n DESC, word) AS INTEGER) AS rank, word AS candidate, n FROM found)
SELECT * FROM ranked WHERE rank <= 10""")
def prefix_candidates(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents")
    return scan.mined_candidates(scan.remaining(docs, "doc_id"), scan.vocabulary(docs))


@query(f"""
SELECT coalesce(key, '') AS key, count(*) AS spellings, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT {key_sql('token')} AS key, n FROM (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+\\.?|\\p{{Nd}}+')) AS token FROM documents) GROUP BY token))
GROUP BY 1""")
def orthographic_groups(spark, sf_dir):
    return scan.orthographic_groups(S.table(spark, sf_dir, "documents"))


@query(f"""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, l[i] AS token, array_to_string(l[greatest(1, i - 4):i + 4], ' ') AS context
FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+\\.?|\\p{{Nd}}+') AS l FROM documents)) WHERE ends_with(l[i], '.')""")
def token_contexts(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents").withColumn("tokens", text.tokens(F.col("text")))
    rows = docs.select("doc_id", "tokens", F.posexplode("tokens").alias("pos", "token")).where("token like '%.'")
    return rows.select("doc_id", "pos", "token", text.context(F.col("tokens"), F.col("pos")).alias("context"))


# --- entries ----------------------------------------------------------------------------------


@query(f"SELECT conv_id % 10 + 1 AS volume, conv_id AS entry, string_agg({S.LINE}, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def vita_texts(spark, sf_dir):
    return vita.to_texts(S.regests(spark, sf_dir))


@query(f"""
SELECT conv_id % 10 + 1 AS volume, conv_id AS entry, turn AS line_no, CASE WHEN turn = 0 THEN {S.LINE} END AS head_text, CASE WHEN turn > 0 THEN {S.LINE} END AS body_text,
       printf('1%02d%05d-%d', conv_id % 10 + 1, conv_id, turn) AS line_id FROM conversations""")
def vita_rows(spark, sf_dir):
    return vita.to_rows(vita.to_texts(S.regests(spark, sf_dir)))


@query("SELECT count(*) AS rows, count(*) AS same FROM conversations")
def vita_roundtrip(spark, sf_dir):
    old = S.regests(spark, sf_dir)
    new = vita.to_rows(vita.to_texts(old))
    same = old.intersectAll(new.select(old.columns)).agg(F.count("*").alias("same"))
    return new.agg(F.count("*").alias("rows")).join(same)


@query(f"SELECT c.volume, c.entry, md5(c.text) AS text_md5 FROM {S.CORPUS} c SEMI JOIN (SELECT doc_id AS entry FROM labels WHERE quality = 1) USING (entry)")
def subset_join(spark, sf_dir):
    subset = S.table(spark, sf_dir, "labels").where("quality = 1").select((F.col("doc_id") % 10 + 1).alias("volume"), F.col("doc_id").alias("entry"))
    return vita.of_subset(S.corpus(spark, sf_dir), subset).select("volume", "entry", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"SELECT c.volume, c.entry FROM {S.CORPUS} c ANTI JOIN (SELECT doc_id AS entry FROM labels) USING (entry)")
def resume_todo(spark, sf_dir):
    done = S.table(spark, sf_dir, "labels").select((F.col("doc_id") % 10 + 1).alias("volume"), F.col("doc_id").alias("entry"))
    return vita.still_to_do(S.corpus(spark, sf_dir), done).select("volume", "entry")


@query(f"SELECT volume, entry FROM {S.CORPUS} WHERE text IS NOT NULL AND NOT contains(text, 'a. ')")
def stale_dump_guard(spark, sf_dir):
    stage = S.corpus(spark, sf_dir)
    entries = stage.withColumn("text", F.replace("text", F.lit("a. "), F.lit("a ")))
    return runs.current_dump(entries, stage).select("volume", "entry")


# --- rules ------------------------------------------------------------------------------------

RULES = f"""
WITH r AS (SELECT abbr, resolution, {', '.join(PLACES)} FROM {S.CLEAN_SQL} WHERE NOT complex UNION ALL BY NAME SELECT abbreviation AS abbr, resolution FROM {S.DIOCESE_SQL}),
u AS (SELECT *, count(*) OVER (PARTITION BY abbr) = 1 AND coalesce({', '.join(PLACES)}) IS NULL AS everywhere FROM r),
listed AS (SELECT CAST(v AS BIGINT) AS volume, abbr, resolution, CAST(len(string_split(abbr, ' ')) AS INTEGER) AS parts FROM u, range(1, 10) AS t(v)
           WHERE everywhere OR contains([{', '.join(PLACES)}][v], abbr)),
flagged AS (SELECT *, count(*) OVER (PARTITION BY volume, abbr) = 1 AS applies FROM listed)"""


def _listed(spark, sf_dir):
    return rules.by_volume(rules.load(S.glossary(spark, sf_dir), S.dioceses(spark)))


@query(f"SELECT abbr, resolution, {', '.join(PLACES)}, CAST(len(string_split(abbr, ' ')) AS INTEGER) AS parts FROM (SELECT abbr, resolution, {', '.join(PLACES)} FROM {S.CLEAN_SQL} WHERE NOT complex UNION ALL BY NAME SELECT abbreviation AS abbr, resolution FROM {S.DIOCESE_SQL})")
def rules_diagonal(spark, sf_dir):
    return rules.load(S.glossary(spark, sf_dir), S.dioceses(spark)).select("abbr", "resolution", *PLACES, "parts")


@query(RULES + " SELECT volume, abbr, resolution, parts FROM listed")
def rules_every_volume(spark, sf_dir):
    return _listed(spark, sf_dir)


@query(RULES + " SELECT volume, count(*) AS rules, count_if(applies) AS applied, count_if(NOT applies) AS \"left\" FROM flagged GROUP BY volume")
def rules_per_volume(spark, sf_dir):
    return rules.per_volume(_listed(spark, sf_dir))


@query(RULES + " SELECT volume, abbr, resolution, parts FROM flagged WHERE applies")
def rules_unambiguous(spark, sf_dir):
    return rules.unambiguous(_listed(spark, sf_dir))


EXPANDED = f"""
WITH rules AS (SELECT map_from_entries(list((abbr, resolution))) AS m FROM {S.MINED_SQL}),
expanded AS (SELECT volume, entry, text, array_to_string(list_transform(regexp_extract_all(text, '(?s){W}+\\.|{W}+|[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda t: coalesce(m[t], t)), '') AS new FROM (SELECT doc_id % 9 + 1 AS volume, doc_id AS entry, text FROM documents), rules)"""


@query(EXPANDED + " SELECT volume, entry, md5(new) AS text_md5, new <> text AS changed FROM expanded")
def expand_rules(spark, sf_dir):
    docs = S.corpus(spark, sf_dir, len(PLACES)).withColumn("old", F.col("text"))
    done = rules.expand(docs, S.mined_rules(spark, sf_dir), "text")
    return done.select("volume", "entry", F.md5(F.col("text").cast("binary")).alias("text_md5"), (F.col("text") != F.col("old")).alias("changed"))


@query(EXPANDED + f" SELECT volume, CAST(sum(len(regexp_extract_all(text, '{W}+\\.'))) AS BIGINT) AS before, CAST(sum(len(regexp_extract_all(new, '{W}+\\.'))) AS BIGINT) AS after FROM expanded GROUP BY volume")
def expand_report(spark, sf_dir):
    docs = S.corpus(spark, sf_dir, len(PLACES))
    return scan.counted_before_and_after(docs, rules.expand(docs, S.mined_rules(spark, sf_dir), "text"), "text")


@query(EXPANDED + f", {grams_sql('expanded', 'new').replace('WITH runs', 'runs')}, known AS (SELECT a AS abbreviation FROM (SELECT unnest(regexp_extract_all(text, '{W}+\\.')) AS a FROM documents) GROUP BY a HAVING count(*) > 1) SELECT abbreviation, len(string_split(abbreviation, ' ')) AS parts, count(*) AS n FROM grams SEMI JOIN known USING (abbreviation) GROUP BY ALL")
def unrealised_potential(spark, sf_dir):
    """A dictionary of all that occurs twice, of which the rules have the most frequent."""
    docs = S.corpus(spark, sf_dir, len(PLACES))
    left = scan.abbreviation_counts(rules.expand(docs, S.mined_rules(spark, sf_dir), "text"), "text")
    known = scan.abbreviation_counts(S.table(spark, sf_dir, "documents"), "text", most=1).where("n > 1")
    return scan.known_but_left(left, known.select("abbreviation"))


@query(RULES + f""",
own AS (SELECT conv_id % 9 + 1 AS volume, conv_id AS entry, turn AS line_no, {S.LINE} AS text FROM conversations),
long AS (SELECT DISTINCT volume, resolution, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])' || replace(replace(abbr, '.', '\\.'), ' ', '[ \\t]*') AS p FROM flagged WHERE applies AND parts = 2),
first AS (SELECT o.*, coalesce(regexp_replace(o.text, l.p, '\\1' || l.resolution, 'g'), o.text) AS done FROM own o LEFT JOIN long l USING (volume)),
short AS (SELECT volume, map_from_entries(list((abbr, resolution))) AS m FROM flagged WHERE applies AND parts = 1 GROUP BY volume),
spelled AS (SELECT f.volume, entry, line_no, array_to_string(list_transform({PIECES.replace('text', 'done')}, lambda t: coalesce(m[t], t)), '') AS new FROM first f LEFT JOIN short USING (volume))
SELECT volume, entry, line_no, CASE WHEN line_no = 0 THEN new END AS head_text, CASE WHEN line_no > 0 THEN new END AS body_text FROM spelled""")
def expand_multiword(spark, sf_dir):
    """Rules of several parts, by volume, over headers and regests."""
    done = rules.expand(S.regests(spark, sf_dir, len(PLACES)), rules.unambiguous(_listed(spark, sf_dir)))
    return done.select("volume", "entry", "line_no", "head_text", "body_text")


# --- dictionary -------------------------------------------------------------------------------

INHERITED = f"(SELECT * REPLACE (coalesce(last_value(nullif(abbr, '') IGNORE NULLS) OVER (ORDER BY row_order), '') AS abbr) FROM {S.RAW_SQL})"


def _inherited(spark, sf_dir):
    return glossary.inherited(glossary.raw(S.raw_glossary(spark, sf_dir)))


@query(f"SELECT row_order, abbr, resolution FROM {INHERITED}")
def glossary_inherit(spark, sf_dir):
    return _inherited(spark, sf_dir).select(F.element_at("row_order", 1).alias("row_order"), "abbr", "resolution")


#: Resolutions without marks and remarks; brackets are part of them where the abbreviation has parts for them.
NORMAL = f"""
WITH usable AS (SELECT *, trim(regexp_replace(regexp_replace(resolution, ' \\?$', ''), ' \\((dekliniert|ungekürzt, dekl\\.)\\)$', '')) AS plain FROM {INHERITED} WHERE resolution NOT IN ('', '?') AND NOT starts_with(resolution, 'cf.:')),
cut AS (SELECT *, trim(regexp_replace(regexp_replace(plain, '\\([^()]*\\)', ' ', 'g'), ' +', ' ', 'g')) AS outside FROM usable),
told AS (SELECT * EXCLUDE (resolution, plain, outside), CASE WHEN NOT contains(plain, '(') THEN plain WHEN len(string_split(abbr, ' ')) > len(string_split(outside, ' ')) THEN regexp_replace(plain, '[()]', '', 'g') ELSE outside END AS whole FROM cut),
rows AS (SELECT * EXCLUDE (whole), trim(part) AS resolution, contains(whole, ';') AS multi FROM (SELECT *, unnest(string_split(whole, ';')) AS part FROM told))"""


@query(NORMAL + " SELECT row_order, abbr, resolution, multi FROM rows")
def split_alternatives(spark, sf_dir):
    return glossary.normalised(_inherited(spark, sf_dir)).select(F.element_at("row_order", 1).alias("row_order"), "abbr", "resolution", "multi")


CELLS = NORMAL + f""",
cells AS (SELECT row_order, abbr, resolution, c.name AS name, trim(v) AS value FROM (SELECT *, unnest([{', '.join(f"struct_pack(name := '{c}', v := {c})" for c in PLACES)}]) AS c FROM rows), LATERAL (SELECT unnest(string_split(c.v, ';')) AS v)),
said AS (SELECT * FROM cells WHERE value <> '' AND value <> resolution),
odd AS (SELECT DISTINCT row_order, resolution FROM said WHERE value <> abbr AND NOT contains(value, '.'))"""
_ODD = "EXISTS (SELECT 1 FROM odd o WHERE o.row_order = p.row_order AND o.resolution = p.resolution)"


def _place_sql(c: str) -> str:
    own = f"EXISTS (SELECT 1 FROM said t WHERE t.row_order = p.row_order AND t.resolution = p.resolution AND t.name = '{c}' AND t.value = p.abbr)"
    return f"CASE WHEN {_ODD} THEN p.{c} WHEN {own} THEN p.abbr ELSE '' END AS {c}"


def _depth():
    """How long the order of a row is that no cell has made: two numbers for an alternative."""
    return F.when(F.col("multi"), 2).otherwise(1)


@query(CELLS + f" SELECT p.row_order, p.abbr, p.resolution, {_ODD} AS foreign, " + ", ".join(map(_place_sql, PLACES)) + " FROM rows p")
def volume_cells(spark, sf_dir):
    rows = glossary.volume_cells(glossary.normalised(_inherited(spark, sf_dir))).where(F.size("row_order") == _depth())
    return rows.select(F.element_at("row_order", 1).alias("row_order"), "abbr", "resolution", "foreign", *PLACES)


@query(CELLS + " SELECT row_order, value AS abbr, CASE WHEN regexp_matches(value, '^[A-Z]') AND regexp_matches(resolution, '^[a-z]') THEN upper(resolution[1]) || resolution[2:] ELSE resolution END AS resolution, string_agg(name, '|' ORDER BY name) AS named FROM said WHERE value <> abbr AND contains(value, '.') AND (row_order, resolution) NOT IN (SELECT (row_order, resolution) FROM odd) GROUP BY row_order, value, resolution")
def derived_rows(spark, sf_dir):
    rows = glossary.volume_cells(glossary.normalised(_inherited(spark, sf_dir))).where(F.size("row_order") > _depth())
    named = F.array_join(F.array_compact(F.array(*[F.when(F.col(c) != "", F.lit(c)) for c in PLACES])), "|")
    return rows.select(F.element_at("row_order", 1).alias("row_order"), "abbr", "resolution", named.alias("named"))


_FIRST = [c for c in S.RAW if c not in ("abbr", "resolution", *PLACES)]
_UNITED = ", ".join(f"coalesce((SELECT string_agg(v, '; ' ORDER BY k) FROM (SELECT v, min(row_order * 100 + i) AS k FROM (SELECT row_order, unnest(list_transform(string_split({c}, ';'), lambda x: trim(x))) AS v, unnest(range(1, len(string_split({c}, ';')) + 1)) AS i FROM r WHERE r.abbr = g.abbr AND lower(r.resolution) = g.k) WHERE v <> '' GROUP BY v)), '') AS {c}" for c in PLACES)


@query(f"""
WITH r AS (SELECT * FROM {INHERITED}),
g AS (SELECT abbr, lower(resolution) AS k, coalesce(CASE WHEN regexp_matches(abbr, '^[A-Z]') THEN arg_min(resolution, row_order) FILTER (regexp_matches(resolution, '^[A-Z]')) END, arg_min(resolution, row_order)) AS resolution,
      {', '.join(f"coalesce(arg_min({c}, row_order) FILTER ({c} <> ''), '') AS {c}" for c in _FIRST)} FROM r GROUP BY abbr, lower(resolution))
SELECT g.abbr, g.resolution, {', '.join(f'g.{c}' for c in _FIRST)}, {_UNITED} FROM g""")
def merge_duplicates(spark, sf_dir):
    return glossary.merged(_inherited(spark, sf_dir)).select("abbr", "resolution", *_FIRST, *PLACES)


@query(f"""
WITH r AS (SELECT abbr, resolution, {', '.join(PLACES)}, concat_ws('', {', '.join(PLACES)}) AS cells FROM {INHERITED})
SELECT DISTINCT abbr, bool_or(contains(abbr, ';') OR contains(cells, ';')) OVER w OR (count(*) OVER w > 1 AND bool_or(cells = '') OVER w) AS complex FROM r WINDOW w AS (PARTITION BY abbr)""")
def complex_split(spark, sf_dir):
    return glossary.with_complex(_inherited(spark, sf_dir)).select("abbr", "complex").distinct()


@query(f"""
SELECT abbr, string_agg(DISTINCT CAST(volume AS VARCHAR), '|' ORDER BY CAST(volume AS VARCHAR)) AS volumes
FROM (SELECT DISTINCT abbr FROM {S.CLEAN_SQL}) JOIN (SELECT DISTINCT volume, {TOKENS} AS t FROM {S.CORPUS}) ON rtrim(t, '.') = rtrim(abbr, '.') GROUP BY abbr""")
def corpus_volumes(spark, sf_dir):
    rows = S.glossary(spark, sf_dir).select("abbr").distinct().withColumn("added", F.lit(False))
    found = glossary.in_corpus(rows, S.corpus(spark, sf_dir))
    order = F.array_join(F.array_sort(F.split("volumes", r"\|")), "|")
    return found.select("abbr", order.alias("volumes"))


CHANGED = f"(SELECT * REPLACE (CASE WHEN abbr = 'de.' THEN 'decretum' ELSE resolution END AS resolution) FROM {S.CLEAN_SQL} WHERE abbr <> 'er.')"
KEYS = ", ".join(f"coalesce({c}, '') AS {c}" for c in ["abbr", "resolution", *PLACES, "volumes"])


def _changed(spark, sf_dir):
    new = S.glossary(spark, sf_dir).where("abbr <> 'er.'")
    return new.withColumn("resolution", F.when(F.col("abbr") == "de.", "decretum").otherwise(F.col("resolution")))


@query(f"SELECT {KEYS} FROM {CHANGED} EXCEPT SELECT {KEYS} FROM {S.CLEAN_SQL}")
def diff_added(spark, sf_dir):
    return glossary.difference(_changed(spark, sf_dir), S.glossary(spark, sf_dir))[0]


@query(f"SELECT {KEYS} FROM {S.CLEAN_SQL} EXCEPT SELECT {KEYS} FROM {CHANGED}")
def diff_removed(spark, sf_dir):
    return glossary.difference(_changed(spark, sf_dir), S.glossary(spark, sf_dir))[1]


@query(f"SELECT abbr, resolution, CAST(v AS BIGINT) AS volume, volumes AS found_in FROM {S.CLEAN_SQL}, range(1, 10) AS t(v) WHERE coalesce([{', '.join(PLACES)}][v], '') <> '' AND NOT list_contains(string_split(coalesce(volumes, ''), '|'), CAST(v AS VARCHAR))")
def volume_mismatch(spark, sf_dir):
    return glossary.volume_mismatches(S.glossary(spark, sf_dir))


@query(f"SELECT min(abbr) AS abbr, word FROM (SELECT abbr, unnest(string_split(resolution, ' ')) AS word FROM {S.CLEAN_SQL}) ANTI JOIN {VOCABULARY} USING (word) GROUP BY word")
def unattested_words(spark, sf_dir):
    return glossary.unattested_words(S.glossary(spark, sf_dir), scan.vocabulary(S.table(spark, sf_dir, "documents"))).select("abbr", "word")


@query()
def glossary_extract(spark, sf_dir):
    """All stages of the toy dictionary over the documents."""
    return glossary.extract(S.raw_glossary(spark), S.corpus(spark, sf_dir))[0]


@query()
def morphology_review(spark, sf_dir):
    return glossary.extract(S.raw_glossary(spark), S.corpus(spark, sf_dir))[1]


# --- paradigms --------------------------------------------------------------------------------

# Written out here on their own, so that a wrong table or a wrong reading of an entry is seen.
# Endings of classes, singular and plural.
_ENDINGS = [
    ("noun", "a", False, ["a", "ae", "am"]),
    ("noun", "a", True, ["ae", "arum", "is", "as"]),
    ("noun", "o", False, ["us", "i", "o", "um", "e"]),
    ("noun", "o", True, ["i", "orum", "is", "os"]),
    ("noun", "o_n", False, ["um", "i", "o"]),
    ("noun", "o_n", True, ["a", "orum", "is"]),
    ("noun", "u", False, ["us", "ui", "um", "u"]),
    ("noun", "u", True, ["us", "uum", "ibus"]),
    ("noun", "e", False, ["es", "ei", "em", "e"]),
    ("noun", "e", True, ["es", "erum", "ebus"]),
    ("noun", "kons", False, ["is", "i", "em", "e"]),
    ("noun", "kons", True, ["es", "um", "ibus"]),
    ("noun", "kons_n", False, ["is", "i", "e"]),
    ("noun", "kons_n", True, ["a", "um", "ibus"]),
    ("noun", "gem", False, ["is", "i", "em", "e"]),
    ("noun", "gem", True, ["es", "ium", "ibus"]),
    ("noun", "gem_n", False, ["is", "i", "e"]),
    ("noun", "gem_n", True, ["ia", "ium", "ibus"]),
    ("noun", "i", False, ["is", "i", "em", "im", "e"]),
    ("noun", "i", True, ["es", "ium", "ibus", "is"]),
    ("noun", "i_n", False, ["is", "i"]),
    ("noun", "i_n", True, ["ia", "ium", "ibus"]),
    ("adjective", "i", False, ["is", "i", "em", "e"]),
    ("adjective", "i", True, ["es", "ia", "ium", "ibus"]),
    ("adjective", "kons", False, ["is", "i", "em", "e"]),
    ("adjective", "kons", True, ["es", "a", "um", "ibus"]),
    ("adjective", "o/a", False, ["us", "i", "o", "um", "e", "a", "ae", "am"]),
    ("adjective", "o/a", True, ["i", "orum", "is", "os", "ae", "arum", "as", "a"]),
]
ENDINGS = S.values([(t, c, p, e) for t, c, p, own in _ENDINGS for e in own], ["tab", "class", "plural", "ending"])
# Endings of the stand-in's verbs in the present system, active and passive.
_ACTIVE = {
    "a": ["o", "as", "at", "amus", "atis", "ant", "abam", "abas", "abat", "abamus", "abatis", "abant", "abo", "abis", "abit", "abimus", "abitis", "abunt", "em", "es", "et", "emus", "etis", "ent", "arem", "ares", "aret", "aremus", "aretis", "arent", "are", "a", "ate"],
    "e": ["o", "s", "t", "mus", "tis", "nt", "bam", "bas", "bat", "bamus", "batis", "bant", "bo", "bis", "bit", "bimus", "bitis", "bunt", "am", "as", "at", "amus", "atis", "ant", "rem", "res", "ret", "remus", "retis", "rent", "re", "", "te"],
    "halbkons": ["io", "is", "it", "imus", "itis", "iunt", "iebam", "iebas", "iebat", "iebamus", "iebatis", "iebant", "iam", "ies", "iet", "iemus", "ietis", "ient", "ias", "iat", "iamus", "iatis", "iant", "erem", "eres", "eret", "eremus", "eretis", "erent", "ere", "e", "ite"],
}
_PASSIVE = {
    "a": ["or", "aris", "atur", "amur", "amini", "antur", "abar", "abaris", "abatur", "abamur", "abamini", "abantur", "er", "eris", "etur", "emur", "emini", "entur", "arer", "areris", "aretur", "aremur", "aremini", "arentur", "abor", "aberis", "abitur", "abimur", "abimini", "abuntur", "ari"],
    "e": ["or", "ris", "tur", "mur", "mini", "ntur", "bar", "baris", "batur", "bamur", "bamini", "bantur", "ar", "aris", "atur", "amur", "amini", "antur", "rer", "reris", "retur", "remur", "remini", "rentur", "bor", "beris", "bitur", "bimur", "bimini", "buntur", "ri"],
    "halbkons": ["ior", "iris", "itur", "imur", "imini", "iuntur", "iebar", "iebaris", "iebatur", "iebamur", "iebamini", "iebantur", "iar", "iaris", "iatur", "iamur", "iamini", "iantur", "erer", "ereris", "eretur", "eremur", "eremini", "erentur", "eris", "ieris", "ietur", "iemur", "iemini", "ientur", "i"],
}
# Their participles and gerunds.
_VERBAL = {
    "a": ["ans", "antis", "anti", "antem", "ante", "antes", "antium", "antibus", "antia", "andus", "andi", "ando", "andum", "ande", "anda", "andae", "andam", "andorum", "andis", "andos", "andarum", "andas"],
    "e": ["ns", "ntis", "nti", "ntem", "nte", "ntes", "ntium", "ntibus", "ntia", "ndus", "ndi", "ndo", "ndum", "nde", "nda", "ndae", "ndam", "ndorum", "ndis", "ndos", "ndarum", "ndas"],
    "halbkons": ["iens", "ientis", "ienti", "ientem", "iente", "ientes", "ientium", "ientibus", "ientia", "iendus", "iendi", "iendo", "iendum", "iende", "ienda", "iendae", "iendam", "iendorum", "iendis", "iendos", "iendarum", "iendas"],
}
# Endings of the perfect system, and of the supine's participles.
_PERFECT = ["i", "isti", "it", "imus", "istis", "erunt", "ere", "eram", "eras", "erat", "eramus", "eratis", "erant", "ero", "eris", "erit", "erimus", "eritis", "erint", "erim", "issem", "isses", "isset", "issemus", "issetis", "issent", "isse"]
_SUPINE = ["us", "i", "o", "um", "e", "a", "ae", "am", "orum", "is", "os", "arum", "as", "urus", "uri", "uro", "urum", "ure", "ura", "urae", "uram", "urorum", "uris", "uros", "urarum", "uras", "u"]
SUFFIXES = S.values(
    [(c, "present", e, False) for c, own in _ACTIVE.items() for e in own]
    + [(c, "present", e, True) for table in (_PASSIVE, _VERBAL) for c, own in table.items() for e in own]
    + [(c, "perfect", e, False) for c in _ACTIVE for e in _PERFECT]
    + [(c, "supine", e, True) for c in _ACTIVE for e in _SUPINE],
    ["class", "stem_kind", "ending", "for_deponents"],
)
# The stand-in's entries, read by hand.
_CLASSES = """(SELECT * FROM (VALUES ('ecclesia', 0, 'ecclesia', 'noun', false, false, 'a'), ('ordo', 0, 'ordo', 'noun', false, false, 'kons'), ('annus', 0, 'annus', 'noun', false, false, 'o'),
    ('altare', 0, 'altare', 'noun', false, false, 'i_n'), ('silva antiqua', 0, 'silva', 'noun', false, false, 'a'), ('silva antiqua', 1, 'antiqua', 'adjective', false, false, 'o/a'),
    ('presbiter', 0, 'presbiter', 'noun', false, false, 'o'), ('arma', 0, 'arma', 'noun', true, false, 'o_n'), ('providere', 0, 'providere', 'verb', false, false, 'e'), ('progredi', 0, 'progredi', 'verb', false, true, 'halbkons'),
    ('taxare', 0, 'taxare', 'verb', false, false, 'a'), ('et', 0, 'et', 'fixed', false, false, ''), ('litterae', 0, 'litterae', 'unknown', false, false, '')) AS t(resolution, pos, word, kind, plural, deponent, class))"""
_STEMS = """(SELECT * FROM (VALUES ('ecclesia', 0, 'noun', 'ecclesi'), ('ordo', 0, 'noun', 'ordin'), ('annus', 0, 'noun', 'ann'), ('altare', 0, 'noun', 'altar'), ('silva antiqua', 0, 'noun', 'silv'),
    ('silva antiqua', 1, 'noun', 'antiqu'), ('presbiter', 0, 'noun', 'presbiter'), ('arma', 0, 'noun', 'arm'), ('providere', 0, 'present', 'provide'), ('providere', 0, 'perfect', 'provid'), ('providere', 0, 'supine', 'provis'),
    ('progredi', 0, 'present', 'progred'), ('progredi', 0, 'supine', 'progress'), ('taxare', 0, 'present', 'tax'), ('taxare', 0, 'perfect', 'taxav'), ('taxare', 0, 'supine', 'taxat')) AS t(resolution, pos, stem_kind, root))"""
FORMS = f"""
WITH w AS (SELECT * FROM {_CLASSES}), s AS (SELECT * FROM {_STEMS}),
made AS (
    SELECT w.resolution, w.pos, w.word, s.root || e.ending AS form FROM w JOIN s USING (resolution, pos) JOIN {ENDINGS} e ON e.tab = w.kind AND e.class = w.class AND (NOT w.plural OR e.plural)
    UNION ALL SELECT w.resolution, w.pos, w.word, s.root FROM w JOIN s USING (resolution, pos) WHERE w.kind IN ('noun', 'adjective') AND ends_with(s.root, 'r')
    UNION ALL SELECT w.resolution, w.pos, w.word, s.root || e.ending FROM w JOIN s USING (resolution, pos) JOIN {SUFFIXES} e ON w.kind = 'verb' AND e.class = w.class AND e.stem_kind = s.stem_kind AND (NOT w.deponent OR e.for_deponents)
    UNION ALL SELECT resolution, pos, word, word FROM w WHERE kind NOT IN ('fixed', 'unknown')),
forms AS (SELECT DISTINCT resolution, CAST(pos AS INTEGER) AS pos, word, form FROM (SELECT resolution, pos, word, unnest([form, replace(form, 'ae', 'e')]) AS form FROM made
          UNION ALL SELECT resolution, pos, word, word FROM w WHERE kind = 'fixed' UNION ALL SELECT resolution, pos, word, NULL FROM w WHERE kind = 'unknown'))"""


@query(FORMS + " SELECT * FROM forms")
def entry_forms(spark, sf_dir):
    return lexicon.entry_forms(S.morphology(spark)).select("resolution", "pos", "word", "form")


LEXICON = FORMS + """, several AS (SELECT word, form FROM (SELECT *, count(*) OVER (PARTITION BY resolution, pos) AS n FROM forms WHERE form IS NOT NULL) WHERE n > 1),
lexicon AS (SELECT word, form FROM several UNION SELECT upper(word[1]) || lower(word[2:]), upper(form[1]) || lower(form[2:]) FROM several WHERE regexp_matches(word, '^[a-z]'))"""


@query(LEXICON + " SELECT * FROM lexicon")
def lexicon_forms(spark, sf_dir):
    return lexicon.lexicon(S.morphology(spark))


@query(LEXICON + f" SELECT word, form, coalesce(n, 0) AS n, CAST(row_number() OVER (PARTITION BY l.word ORDER BY coalesce(n, 0) DESC, form) AS INTEGER) AS rank FROM lexicon l LEFT JOIN (SELECT word AS form, n FROM {VOCABULARY}) USING (form)")
def ranked_forms(spark, sf_dir):
    return lexicon.ranked_forms(lexicon.lexicon(S.morphology(spark)), scan.vocabulary(S.table(spark, sf_dir, "documents")))


@query(f"SELECT resolution, resolution[:-3] || CASE WHEN ends_with(resolution, 'is') THEN ' -is' ELSE ' -i' END AS stem, CASE WHEN ends_with(resolution, 'is') THEN 'i (Adj.)' ELSE 'o/a (Adj.)' END AS declension FROM {S.DIOCESE_SQL} WHERE regexp_matches(resolution, '(is|us)$')")
def diocese_entries(spark, sf_dir):
    return lexicon.diocese_entries(S.dioceses(spark))


@query(FORMS + f" SELECT DISTINCT {key_sql('form')} AS key, word AS lemma FROM (SELECT word, form FROM forms WHERE form IS NOT NULL UNION SELECT word, word FROM forms)")
def lemma_index(spark, sf_dir):
    return lexicon.lemma_index(S.morphology(spark))


@query(FORMS + f""", firsts AS (SELECT DISTINCT resolution, resolution[:2] || '.' AS abbr, string_split(resolution, ' ')[1] AS first FROM w),
keys AS (SELECT abbr, {key_sql('first')} AS key FROM firsts UNION SELECT abbr, {key_sql('form')} FROM firsts JOIN forms USING (resolution) WHERE first = word AND form IS NOT NULL)
SELECT abbr, key FROM keys WHERE length(key) >= 4""")
def anchor_index(spark, sf_dir):
    return lexicon.anchor_index(S.morphology(spark).withColumn("abbr", F.concat(F.left("resolution", F.lit(2)), F.lit("."))))


# --- candidates and choices -------------------------------------------------------------------

OFFERED = RULES.replace(f"UNION ALL BY NAME SELECT abbreviation AS abbr, resolution FROM {S.DIOCESE_SQL}", "") + f""",
offers AS (SELECT volume, abbr, resolution FROM flagged WHERE NOT applies UNION ALL SELECT NULL, abbr, resolution FROM {S.CLEAN_SQL} WHERE complex)"""


@query(OFFERED + f""", {grams_sql(S.CORPUS, 'text', 'volume, entry,').replace('WITH runs', 'runs')},
mine AS (SELECT DISTINCT volume, entry, unnest([abbreviation, regexp_replace(abbreviation, '\\.({W})', '. \\1', 'g')]) AS abbr FROM grams)
SELECT m.volume, m.entry, m.abbr, array_to_string(list_sort(list(DISTINCT o.resolution)), '|') AS candidates FROM mine m JOIN offers o ON m.abbr = o.abbr AND (o.volume IS NULL OR o.volume = m.volume) GROUP BY ALL""")
def candidates_step2(spark, sf_dir):
    found = candidates.of_entries(S.corpus(spark, sf_dir), S.glossary(spark, sf_dir))
    return found.select("volume", "entry", "abbr", F.array_join("candidates", "|").alias("candidates"))


#: Pieces of the documents, those that something is offered for with the first of it, numbered.
CHOSEN = OFFERED + f""",
firsts AS (SELECT c.volume, abbr, min(resolution) AS r FROM (SELECT DISTINCT volume FROM {S.CORPUS}) c JOIN offers o ON o.volume IS NULL OR o.volume = c.volume GROUP BY ALL),
cut AS (SELECT volume, entry, i, l[i] AS t FROM (SELECT volume, entry, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT volume, entry, {PIECES} AS l FROM {S.CORPUS}))),
hits AS (SELECT cut.*, r, sum(CASE WHEN r IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY cut.volume, entry ORDER BY i) AS k FROM cut LEFT JOIN firsts f ON f.volume = cut.volume AND f.abbr = t)"""
_ALL = f"FROM {S.CORPUS} LEFT JOIN made USING (volume, entry)"


@query(CHOSEN + f", made AS (SELECT volume, entry, max(k) AS n, string_agg(CASE WHEN r IS NULL THEN t ELSE '[[' || CAST(k AS INTEGER) || '|' || t || ']]' END, '' ORDER BY i) AS marked FROM hits GROUP BY ALL) SELECT volume, entry, CAST(coalesce(n, 0) AS INTEGER) AS n, coalesce(marked, '') AS marked {_ALL}")
def occurrences_marked(spark, sf_dir):
    docs = S.corpus(spark, sf_dir)
    own = candidates.marked(candidates.with_occurrences(docs, candidates.of_entries(docs, S.glossary(spark, sf_dir))))
    return own.select("volume", "entry", F.size("occurrences").alias("n"), "marked")


@query(CHOSEN + f", made AS (SELECT volume, entry, string_agg(coalesce(r, t), '' ORDER BY i) AS expanded FROM hits GROUP BY ALL) SELECT volume, entry, coalesce(expanded, '') AS expanded {_ALL}")
def expanded_by_choice(spark, sf_dir):
    docs = S.corpus(spark, sf_dir)
    own = candidates.first_choices(candidates.with_occurrences(docs, candidates.of_entries(docs, S.glossary(spark, sf_dir))))
    return own.select("volume", "entry", "expanded")


@query(CHOSEN + f", made AS (SELECT volume, entry, max(k) AS n, string_agg(coalesce(r, t), '' ORDER BY i) AS processed FROM hits GROUP BY ALL) SELECT volume, entry, coalesce(processed, '') AS processed, CAST(coalesce(n, 0) AS INTEGER) AS choices, CAST(0 AS INTEGER) AS errors {_ALL}")
def step2_decisions(spark, sf_dir):
    got = steps.step2(S.corpus(spark, sf_dir), S.glossary(spark, sf_dir), steps.FirstCandidate())
    return got.select("volume", "entry", "processed", F.size("choices").alias("choices"), F.size("errors").alias("errors"))


@query(ORACLES["prefix_candidates"].replace("SELECT * FROM ranked WHERE rank <= 10", f""", best AS (SELECT map_from_entries(list((abbreviation, candidate))) AS m FROM ranked WHERE rank = 1),
cut AS (SELECT volume, entry, {PIECES} AS l FROM {S.CORPUS})
SELECT volume, entry, coalesce(array_to_string(list_transform(l, lambda t: CASE WHEN {STANDS} THEN coalesce(m[t], t) ELSE t END), ''), '') AS processed,
       CAST(len(list_filter(l, lambda t: {STANDS} AND m[t] IS NOT NULL)) AS INTEGER) AS choices, CAST(len(list_filter(l, lambda t: {STANDS} AND m[t] IS NULL)) AS INTEGER) AS errors FROM cut, best"""))
def step3_decisions(spark, sf_dir):
    docs = S.corpus(spark, sf_dir)
    got = steps.step3(docs, docs, steps.FirstCandidate())
    return got.select("volume", "entry", "processed", F.size("choices").alias("choices"), F.size("errors").alias("errors"))


@query()
def step4_decisions(spark, sf_dir):
    """The dictionary and the stage before are tables, as they are for the command: nothing is made twice."""
    docs, words = S.corpus(spark, sf_dir), shared.settled(S.glossary(spark, sf_dir))
    third = shared.settled(steps.assembled(docs, steps.step2(docs, words, steps.FirstCandidate())), small_batches=True)
    entries = S.morphology(spark).unionByName(words.select("resolution", F.concat(F.left("resolution", F.lit(4)), F.lit(" -i")).alias("stem"), F.lit("o").alias("declension")))
    got = steps.step4(third, docs, entries, docs, steps.FirstCandidate())
    return got.select("volume", "entry", "processed", F.size("choices").alias("choices"), F.size("errors").alias("errors"))


@query("""
WITH a AS (SELECT doc_id, regexp_extract(text, '[A-Za-z]+') AS w FROM documents), b AS (SELECT * FROM a WHERE w <> '' AND doc_id % 7 > 0)
SELECT doc_id, CAST(1 AS INTEGER) AS id, CASE WHEN w IN ('the', 'that') THEN 'suggestion' WHEN starts_with(w, 'th') AND length(w) > 2 THEN 'free' WHEN upper(w) = 'SKIP' THEN 'skip' ELSE 'rejected' END AS tier FROM b
UNION ALL SELECT doc_id, 2, CASE WHEN doc_id % 2 = 0 THEN 'skip' ELSE 'missing' END FROM b""")
def parse_tiers(spark, sf_dir):
    """An answer for each document, of its first word; every seventh cannot be read."""
    docs = S.table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("text", "[A-Za-z]+", 0).alias("w"))
    second = F.when(F.col("doc_id") % 2 == 0, F.lit(', "2": "skip"')).otherwise("")
    given = F.when((F.col("w") == "") | (F.col("doc_id") % 7 == 0), F.lit("no object")).otherwise(F.concat(F.lit('So: {"1": "`'), "w", F.lit('`"'), second, F.lit("} done")))
    found = [spans.Occurrence(1, "th.", "th.", 0, 3), spans.Occurrence(2, "dioc.", "dioc.", 4, 9)]
    judged = answers.tiers(3, found, {"th.": ["the", "that"]})
    return docs.select("doc_id", F.explode(judged(given)).alias("d")).select("doc_id", "d.id", "d.tier")


# --- alignment and scores ---------------------------------------------------------------------


#: Documents and what plain rules make of them: pieces, and a resolution where there is one.
MADE = f"""
WITH rules AS (SELECT map_from_entries(list((abbr, resolution))) AS m FROM {S.PLAIN_SQL}),
cut AS (SELECT doc_id % 9 + 1 AS volume, doc_id AS entry, text, l, list_transform(l, lambda t: coalesce(m[t], t)) AS made, len(list_filter(l, lambda t: m[t] IS NOT NULL)) AS hits FROM (SELECT doc_id, text, {PIECES} AS l FROM documents), rules),
done AS (SELECT *, array_to_string(made, '') AS new FROM cut)"""
#: The same with rules of two parts: kind 2 is a pair with a blank, 1 a glued one; what a pair takes up is empty.
PAIRED = f"""
WITH rules AS (SELECT map_from_entries(list((abbr, resolution))) AS m FROM {S.PLAIN_SQL}), pairs AS (SELECT map_from_entries(list((abbr, resolution))) AS p FROM {S.PAIRS_SQL}),
cut AS (SELECT doc_id % 9 + 1 AS volume, doc_id AS entry, text, l, m, p, list_transform(l, lambda t, i: CASE WHEN regexp_full_match(l[i + 1], '[ \\t]+') AND p[t || ' ' || l[i + 2]] IS NOT NULL THEN 2 WHEN p[t || ' ' || l[i + 1]] IS NOT NULL THEN 1 ELSE 0 END) AS kind
        FROM (SELECT doc_id, text, {PIECES} AS l FROM documents), rules, pairs),
made AS (SELECT volume, entry, text,
    list_transform(l, lambda t, i: CASE WHEN kind[i] = 2 THEN t || l[i + 1] || l[i + 2] WHEN kind[i] = 1 THEN t || l[i + 1] WHEN i > 1 AND kind[i - 1] > 0 OR i > 2 AND kind[i - 2] = 2 THEN '' ELSE t END) AS old,
    list_transform(l, lambda t, i: CASE WHEN kind[i] > 0 THEN p[t || ' ' || l[i + kind[i]]] WHEN i > 1 AND kind[i - 1] > 0 OR i > 2 AND kind[i - 2] = 2 THEN '' ELSE coalesce(m[t], t) END) AS made FROM cut),
done AS (SELECT *, array_to_string(made, '') AS new, CAST(len(list_filter(range(1, len(old) + 1), lambda i: old[i] <> made[i])) AS INTEGER) AS hits FROM made)"""
TOKEN = "[A-Za-z]+\\.?|\\p{Nd}+"


def _expanded(spark, sf_dir):
    """Documents, their texts before (old) and after (text) rules of one part and of two, and the script between."""
    docs = S.corpus(spark, sf_dir, len(PLACES)).withColumn("old", F.col("text"))
    return rules.expand_with_script(docs, S.paired_rules(spark, sf_dir), "text")


@query(PAIRED + """, placed AS (SELECT volume, entry, old[i] AS t, made[i] AS r, i FROM (SELECT *, unnest(range(1, len(old) + 1)) AS i FROM done)),
ends AS (SELECT *, sum(length(r)) OVER (PARTITION BY entry ORDER BY i) - length(r) AS low, string_split(r, ' ') AS w FROM placed),
spans AS (SELECT entry, unnest(CASE WHEN contains(r, ' ') THEN [(low, low + length(w[1])), (low + length(w[1]) + 1, low + length(w[1]) + 3), (low + length(r) - length(w[3]), low + length(r) - 1)] ELSE [(low, low + length(r) - 1)] END) AS s FROM ends WHERE t <> r)
SELECT volume, entry, CAST(s[1] AS INTEGER) AS start, CAST(s[2] AS INTEGER) AS "end" FROM done LEFT JOIN spans USING (entry)""")
def inserted_spans(spark, sf_dir):
    docs = _expanded(spark, sf_dir)
    return docs.select("volume", "entry", F.explode_outer(edits.inserted(F.col("script"))).alias("s")).select("volume", "entry", "s.start", "s.end")


@query(PAIRED + f""", placed AS (SELECT volume, entry, i, old[i] <> made[i] AS hit, regexp_extract_all(old[i], '{TOKEN}') AS a, regexp_extract_all(made[i], '{TOKEN}') AS b FROM (SELECT *, unnest(range(1, len(old) + 1)) AS i FROM done)),
counted AS (SELECT *, sum(len(a)) OVER w - len(a) AS before, sum(len(b)) OVER w - len(b) AS base FROM placed WINDOW w AS (PARTITION BY entry ORDER BY i)),
each AS (SELECT *, unnest(range(1, len(a) + 1)) AS k, hit AND len(a) = 2 AS pair FROM counted),
spans AS (SELECT *, CASE WHEN pair AND k = 2 THEN 3 ELSE k END AS first, CASE WHEN pair THEN k + 1 ELSE k END AS last FROM each)
SELECT volume, entry, CAST(before + k - 1 AS INTEGER) AS pos, a[k] AS token, CAST(base + first - 1 AS INTEGER) AS start, CAST(base + last AS INTEGER) AS "end", array_to_string(b[first:last], ' ') AS text FROM spans""")
def aligned_spans(spark, sf_dir):
    """A rule of one part puts a word in the place of one; one of two parts puts three, of which the
    first two are the first part's."""
    return edits.aligned_rows(_expanded(spark, sf_dir), "script", "volume", "entry")


LONG = f"""
WITH o AS (SELECT volume, entry, CAST(id - 1 AS INTEGER) AS pos, abbreviation AS abbr, rtrim(abbreviation, '.') AS stem, length(abbreviation) + id - 1 AS n FROM {remaining_sql('volume, entry', S.CORPUS)}),
g AS (SELECT *, CASE WHEN n % 11 = 0 THEN NULL WHEN n % 13 = 0 THEN abbr ELSE stem || 'ia' END AS gold,
      CASE WHEN n % 5 = 0 THEN stem || 'ie' WHEN n % 7 = 0 THEN stem || 'ya' WHEN n % 17 = 0 THEN 'aliud' ELSE stem || 'ia' END AS good FROM o),
rows AS (SELECT volume, entry, pos, abbr, gold, CAST(k AS INTEGER) AS stage, CASE WHEN n % 4 < k THEN CASE WHEN k = 4 THEN good ELSE stem || 'ia' END WHEN n % 19 = 0 THEN NULL ELSE abbr END AS resolution FROM g, range(1, 5) AS t(k)),
index(key, lemma) AS (SELECT w, w[:-2] || 'a' FROM (SELECT unnest(['theia', 'theie', 'isia', 'isie', 'ofia', 'ofie', 'enia', 'enie', 'andia', 'andie']) AS w)),
pairs AS (SELECT DISTINCT gold, resolution, {key_sql('gold')} AS gk, {key_sql('resolution')} AS ek FROM rows WHERE gold IS NOT NULL AND resolution IS NOT NULL),
judged AS (SELECT gold, resolution, gk, ek, EXISTS (SELECT 1 FROM index a JOIN index b USING (lemma) WHERE a.key = gk AND b.key = ek) AS lemma,
           len(list_filter(range(3, 1 + len(list_filter(range(1, 1 + least(length(gk), length(ek))), lambda i: gk[:i] = ek[:i]))),
               lambda i: list_contains(ends, gk[i + 1:]) AND list_contains(ends, ek[i + 1:]))) > 0 AS ending FROM pairs, (SELECT list(DISTINCT e) AS ends FROM (SELECT coalesce({key_sql('ending')}, '') AS e FROM {ENDINGS} UNION SELECT ''))),
scored AS (SELECT r.*, CASE WHEN r.gold IS NULL THEN 'unaligned' WHEN r.gold LIKE '%.' THEN 'no_gold_label' WHEN r.resolution IS NULL THEN 'unaligned' WHEN r.resolution LIKE '%.' THEN 'not_expanded'
           WHEN r.gold = r.resolution THEN 'exact' WHEN gk = ek THEN 'orthographic' WHEN lemma THEN 'wrong_form' WHEN ending THEN 'wrong_form?' ELSE 'wrong_word' END AS verdict
           FROM rows r LEFT JOIN judged j ON r.gold = j.gold AND r.resolution = j.resolution),
settled AS (SELECT volume, entry, pos, min(stage) FILTER (resolution NOT LIKE '%.') AS first_stage FROM rows WHERE resolution IS NOT NULL GROUP BY ALL),
stepped AS (SELECT s.*, CASE WHEN f.first_stage IS NULL THEN NULL WHEN f.first_stage < 4 AND (SELECT max(resolution) FROM rows r WHERE r.volume = s.volume AND r.entry = s.entry AND r.pos = s.pos AND r.stage = 4) <> rtrim(s.abbr, '.') || 'ia' THEN 4 ELSE f.first_stage END AS step
            FROM scored s LEFT JOIN settled f USING (volume, entry, pos))"""
_GOOD, _FORM = "('exact', 'orthographic', 'wrong_form', 'wrong_form?')", "('exact', 'orthographic')"
_SCORED = "('exact', 'orthographic', 'wrong_form', 'wrong_form?', 'wrong_word', 'not_expanded')"


def rates_sql() -> str:
    share = lambda x: f"CASE WHEN count_if(verdict IN {_SCORED}) = 0 THEN 0.0::DOUBLE ELSE count_if({x}) / count_if(verdict IN {_SCORED}) END"
    return f"count(*) AS occurrences, count_if(verdict IN {_SCORED}) AS scoreable, {share(f'verdict IN {_SCORED} AND verdict <> ' + chr(39) + 'not_expanded' + chr(39))} AS expanded, {share(f'verdict IN {_GOOD}')} AS word_accuracy, {share(f'verdict IN {_FORM}')} AS form_accuracy, count_if(verdict = 'no_gold_label') AS no_gold_label"


def _scored(spark, sf_dir):
    rows = score.each_stage(score.settled(S.occurrence_table(spark, sf_dir)))
    return score.with_verdicts(rows, S.lemmas(spark)).select("volume", "entry", "pos", "abbr", "gold", "stage", "resolution", "verdict", "step")


def _counted(spark, sf_dir):
    return score.scored_facts(S.occurrence_table(spark, sf_dir), S.lemmas(spark))


@query(LONG + " SELECT volume, entry, pos, stage, verdict, CAST(step AS INTEGER) AS step FROM stepped")
def verdicts(spark, sf_dir):
    return _scored(spark, sf_dir).select("volume", "entry", "pos", "stage", "verdict", "step")


@query(LONG + f" SELECT stage, {rates_sql()} FROM stepped GROUP BY stage")
def verdict_rates(spark, sf_dir):
    return score.by_stage(_counted(spark, sf_dir))


@query(LONG + f" SELECT CAST(step AS INTEGER) AS step, {rates_sql()} FROM stepped WHERE stage = 4 AND step IS NOT NULL GROUP BY step")
def by_step(spark, sf_dir):
    return score.by_step(_counted(spark, sf_dir))


@query(LONG + f""", sums AS (SELECT abbr, {rates_sql()}, array_to_string(list_sort(list(DISTINCT coalesce(gold, '')))[:5], ', ') AS gold_variants FROM stepped WHERE stage = 4 GROUP BY abbr),
wrong AS (SELECT abbr, resolution, row_number() OVER (PARTITION BY abbr ORDER BY n DESC, resolution) AS k FROM (SELECT abbr, resolution, count(*) AS n FROM stepped WHERE stage = 4 AND verdict IN ('wrong_word', 'wrong_form', 'wrong_form?') GROUP BY abbr, resolution))
SELECT s.abbr, scoreable AS occurrences, round(word_accuracy, 4) AS word_accuracy, round(form_accuracy, 4) AS form_accuracy, no_gold_label, gold_variants, coalesce(w.resolution, '') AS most_frequent_error, round(scoreable * (1 - round(form_accuracy, 4)), 4) AS potential_gain
FROM sums s LEFT JOIN wrong w ON s.abbr = w.abbr AND w.k = 1""")
def by_abbreviation(spark, sf_dir):
    return score.by_abbreviation(_counted(spark, sf_dir))


def _offers(rows):
    """What is offered for the abbreviations of occurrences or facts."""
    ending = F.when(F.length("abbr") % 2 == 0, "ia").otherwise("um")
    own = rows.select("abbr").distinct()
    return own.select("abbr", F.explode(F.array(F.lit(2), F.lit(3), F.lit(4))).alias("step"), F.concat(F.rtrim(F.col("abbr"), F.lit(".")), ending).alias("candidate"))


def _offered(spark, sf_dir, report):
    """A report of offers: of the last stage, and of facts that are counted once."""
    own, index = score.facts(S.occurrence_table(spark, sf_dir)), S.lemmas(spark)
    return report(score.judged_facts(own, index, only=max(score.STEPS)), _offers(own), index)


OFFERS = "(SELECT DISTINCT abbr, CAST(s AS INTEGER) AS step, rtrim(abbr, '.') || CASE WHEN length(abbr) % 2 = 0 THEN 'ia' ELSE 'um' END AS candidate FROM o, range(2, 5) AS t(s))"


#: Occurrences that something was offered for (told): whether the answer was right (ok), whether any offer was.
TOLD = LONG + f""", offered AS (SELECT volume, entry, pos, s.abbr, s.step, s.gold, s.verdict AS own, c.candidate, {key_sql('s.gold')} AS gk, {key_sql('c.candidate')} AS ek FROM stepped s JOIN {OFFERS} c ON s.abbr = c.abbr AND s.step = c.step
           WHERE stage = 4 AND s.verdict IN {_SCORED}),
ends AS (SELECT list(DISTINCT e) AS ends FROM (SELECT coalesce({key_sql('ending')}, '') AS e FROM {ENDINGS} UNION SELECT '')),
told AS (SELECT abbr, step, own IN {_GOOD} AS ok, gold = candidate OR gk = ek OR EXISTS (SELECT 1 FROM index a JOIN index b USING (lemma) WHERE a.key = gk AND b.key = ek)
         OR len(list_filter(range(3, 1 + len(list_filter(range(1, 1 + least(length(gk), length(ek))), lambda i: gk[:i] = ek[:i]))), lambda i: list_contains(ends, gk[i + 1:]) AND list_contains(ends, ek[i + 1:]))) > 0 AS covered FROM offered, ends)"""


@query(TOLD + """
SELECT CAST(step AS INTEGER) AS step, count(*) AS offered, count_if(covered) AS n_covered, count_if(covered AND ok) AS chosen, count_if(NOT covered AND NOT ok) AS candidate_misses, count_if(NOT covered AND ok) AS beyond,
       count_if(covered) / count(*) AS ceiling, CASE WHEN count_if(covered) = 0 THEN 0.0::DOUBLE ELSE count_if(covered AND ok) / count_if(covered) END AS choice_accuracy FROM told GROUP BY step""")
def candidate_summary(spark, sf_dir):
    return _offered(spark, sf_dir, score.candidate_summary)


@query(TOLD + """, missed AS (SELECT CAST(step AS INTEGER) AS step, abbr, count(*) AS n FROM told WHERE NOT covered AND NOT ok GROUP BY ALL),
ranked AS (SELECT step, CAST(row_number() OVER (PARTITION BY step ORDER BY n DESC, abbr) AS INTEGER) AS rank, abbr, n FROM missed) SELECT * FROM ranked WHERE rank <= 5""")
def worst_misses(spark, sf_dir):
    return _offered(spark, sf_dir, score.worst_misses)


BASELINE = [(1, 0.1, 0.05), (2, 0.3, 0.2), (3, 0.5, 0.4), (4, 0.9, 0.6)]


@query(LONG + f", now AS (SELECT stage, {rates_sql()} FROM stepped GROUP BY stage) SELECT stage, round(100 * (round(now.word_accuracy, 6) - b.w), 4) AS word_points, round(100 * (round(now.form_accuracy, 6) - b.f), 4) AS form_points FROM now JOIN {S.values(BASELINE, ['stage', 'w', 'f'])} b USING (stage)")
def baseline_diff(spark, sf_dir):
    baseline = spark.createDataFrame(BASELINE, "stage int, word_accuracy double, form_accuracy double")
    return score.baseline_difference(score.headline(_counted(spark, sf_dir)), baseline)


@query(LONG + """ SELECT volume, entry, pos, abbr, gold, CAST(step AS INTEGER) AS step, max(resolution) FILTER (stage = 4) AS system, max(verdict) FILTER (stage = 4) AS verdict, """ + ", ".join(f"max(resolution) FILTER (stage = {k}) AS resolution_{k}, max(verdict) FILTER (stage = {k}) AS verdict_{k}" for k in (1, 2, 3)) + " FROM stepped GROUP BY ALL HAVING max(verdict) FILTER (stage = 4) <> 'exact'")
def mismatches(spark, sf_dir):
    return score.mismatches(_scored(spark, sf_dir))


@query(LONG + f""", offered AS (SELECT volume, entry, pos, s.abbr, s.step, s.gold, s.verdict AS own, c.candidate, {key_sql('s.gold')} AS gk, {key_sql('c.candidate')} AS ek FROM stepped s JOIN {OFFERS} c ON s.abbr = c.abbr AND s.step = c.step
           WHERE stage = 4 AND s.verdict IN {_SCORED}),
ends AS (SELECT list(DISTINCT e) AS ends FROM (SELECT coalesce({key_sql('ending')}, '') AS e FROM {ENDINGS} UNION SELECT '')),
told AS (SELECT volume, entry, pos, NOT (gold = candidate OR gk = ek OR EXISTS (SELECT 1 FROM index a JOIN index b USING (lemma) WHERE a.key = gk AND b.key = ek)
         OR len(list_filter(range(3, 1 + len(list_filter(range(1, 1 + least(length(gk), length(ek))), lambda i: gk[:i] = ek[:i]))), lambda i: list_contains(ends, gk[i + 1:]) AND list_contains(ends, ek[i + 1:]))) > 0) AS miss FROM offered, ends)
SELECT s.volume, s.entry, s.pos, c.candidate AS candidates, t.miss AS candidate_miss FROM stepped s LEFT JOIN {OFFERS} c ON s.abbr = c.abbr AND s.step = c.step LEFT JOIN told t ON t.volume = s.volume AND t.entry = s.entry AND t.pos = s.pos
WHERE s.stage = 4 AND s.verdict <> 'exact'""")
def mismatch_candidates(spark, sf_dir):
    return score.mismatches(_scored(spark, sf_dir), _offers(S.occurrence_table(spark, sf_dir)), S.lemmas(spark)).select("volume", "entry", "pos", "candidates", "candidate_miss")


@query(MADE + f""", sums AS (SELECT sum(hits) AS hits, sum(len(list_filter(regexp_extract_all(text, '{TOKEN}'), lambda t: ends_with(t, '.')))) AS n FROM done)
SELECT CAST(stage AS INTEGER) AS stage, verdict, CAST(k AS BIGINT) AS n FROM (SELECT unnest([1, 2, 1, 2]) AS stage, unnest(['not_expanded', 'exact', 'no_gold_label', 'no_gold_label']) AS verdict, unnest([hits, hits, n - hits, n - hits]) AS k FROM sums)""")
def evaluated_texts(spark, sf_dir):
    """Documents against their own resolution, from texts to verdicts."""
    docs = S.corpus(spark, sf_dir, len(PLACES)).withColumn("old", F.col("text"))
    done = rules.expand(docs, S.plain_rules(spark, sf_dir), "text")
    rows = score.aligned_occurrences(done.select("volume", "entry", F.col("old").alias("source"), F.col("text").alias("gold"), F.array("old", "text").alias("stages")))
    return score.with_verdicts(rows, S.lemmas(spark)).groupBy("stage", "verdict").agg(F.count("*").alias("n"))


@query(MADE + f""", sums AS (SELECT sum(hits) AS hits, sum(len(list_filter(regexp_extract_all(text, '{TOKEN}'), lambda t: ends_with(t, '.')))) AS n FROM done)
SELECT CAST(stage AS INTEGER) AS stage, verdict, CAST(step AS INTEGER) AS step, CAST(k AS BIGINT) AS n FROM (SELECT unnest([1, 2, 1, 2]) AS stage, unnest(['not_expanded', 'exact', 'no_gold_label', 'no_gold_label']) AS verdict, unnest([2, 2, NULL, NULL]) AS step, unnest([hits, hits, n - hits, n - hits]) AS k FROM sums)""")
def evaluated_stages(spark, sf_dir):
    """The same from tables of entries, one for each stage, to verdicts and the steps that settled them."""
    docs = S.corpus(spark, sf_dir, len(PLACES))
    done = rules.expand(docs, S.plain_rules(spark, sf_dir), "text")
    known = S.morphology(spark).withColumn("abbr", F.concat(F.left("resolution", F.lit(2)), F.lit(".")))
    rows = evaluation.counted(docs, done, [docs, done], known, S.dioceses(spark))
    return rows.groupBy("stage", "verdict", "step").agg(F.sum("n").alias("n"))


# --- runs -------------------------------------------------------------------------------------

@query(S.EVENT_RUNS + " SELECT run, CAST(k AS INTEGER) AS stage, value AS word_accuracy, value / 2 AS form_accuracy FROM runs WHERE k = n")
def run_comparison(spark, sf_dir):
    return score.compared_runs([S.event_runs(spark, sf_dir).select("run", F.col("step").alias("stage"), "word_accuracy", "form_accuracy")])


@query(S.EVENT_RUNS + " SELECT run, output, value AS accuracy, round(value - was, 6) AS gained FROM (SELECT *, lag(value) OVER (PARTITION BY u ORDER BY k) AS was FROM runs) WHERE k = 3")
def step_section(spark, sf_dir):
    return score.step_section(S.event_runs(spark, sf_dir), 3)


@query(S.EVENT_RUNS.replace("WITH", "WITH RECURSIVE", 1) + """,
m AS (SELECT run, k AS step, output, circular, CASE WHEN k > 1 THEN run || '/s' || (k - 1) WHEN u % 11 = 3 THEN run || '/s' || n WHEN u % 7 <> 0 THEN 'u' || (u - 1) || '/s1' END AS input FROM runs),
behind(run, step, depth, from_run, from_step, output, input, circular, seen) AS (
    SELECT run, step, 0, run, step, output, input, circular, CASE WHEN circular THEN [output] ELSE [] END FROM m
    UNION ALL SELECT b.run, b.step, b.depth + 1, m.run, m.step, m.output, m.input, b.circular, CASE WHEN b.circular THEN list_append(b.seen, m.output) ELSE [] END FROM behind b JOIN m ON b.input = m.output WHERE NOT list_contains(b.seen, m.output))
SELECT run, CAST(step AS INTEGER) AS step, CAST(depth AS INTEGER) AS depth, from_run, CAST(from_step AS INTEGER) AS from_step, output, circular FROM behind""")
def lineage(spark, sf_dir):
    return runs.lineages(S.event_runs(spark, sf_dir))


@query(S.EVENT_RUNS + " SELECT output, run AS by_run, CAST(k AS INTEGER) AS by_step FROM runs")
def producers(spark, sf_dir):
    own = S.event_runs(spark, sf_dir)
    return runs.producers(own.select("output").distinct(), own)


@query("SELECT CASE WHEN user_id % 3 = 0 THEN concat('m', user_id % 5, '-high') WHEN user_id % 3 = 1 THEN concat('m', user_id % 5, '-nothink') ELSE concat('m', user_id % 5) END AS name, count(*) AS n FROM events GROUP BY 1")
def run_names(spark, sf_dir):
    model = F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string"))
    effort = F.when(F.col("user_id") % 3 == 0, "high")
    own = S.table(spark, sf_dir, "events").select(runs.name(model, F.when(F.col("user_id") % 3 == 1, False), effort).alias("name"))
    return own.groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS vitae, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, median(value) AS median, max(value) AS worst, CAST(sum(user_id % 2) AS BIGINT) AS server_retries, count_if(event_id % 3 > 0) AS asked_again, count_if(event_id % 7 = 0) AS unreadable FROM events")
def effort_stats(spark, sf_dir):
    own = S.table(spark, sf_dir, "events").select(F.col("value").alias("seconds"), (F.col("event_id") % 3 + 1).alias("tries"), (F.col("user_id") % 2).alias("server_retries"), (F.col("event_id") % 7 != 0).alias("readable"))
    return score.effort(own).withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6)})


@query("""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
SELECT event_id, i * 4100000 + max(t - i * 4100000) OVER (PARTITION BY user_id ORDER BY i) AS slot FROM e""")
def rate_slots(spark, sf_dir):
    own = S.table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return runs.slots(own, 4_100_000, order=("at", "event_id"), within=("user_id",)).select("event_id", F.col("slot").cast("long").alias("slot"))


@query("SELECT string_split(event_type || ': ' || event_id, ':')[1] AS kind, count(*) AS n FROM events GROUP BY 1")
def error_kinds(spark, sf_dir):
    return score.error_kinds(S.table(spark, sf_dir, "events").select(F.concat("event_type", F.lit(": "), F.col("event_id").cast("string")).alias("message")))


@query("SELECT CASE WHEN event_id % 4 = 0 THEN 'choice' WHEN event_id % 4 = 1 THEN 'skip' ELSE 'rejected' END AS tier, count(*) AS n FROM events GROUP BY 1")
def tier_counts(spark, sf_dir):
    tier = F.when(F.col("event_id") % 4 == 0, "choice").when(F.col("event_id") % 4 == 1, "skip").otherwise("rejected")
    return score.tiers(S.table(spark, sf_dir, "events").select(tier.alias("tier")))


@query(S.EVENT_RUNS + " SELECT run, CAST(k AS INTEGER) AS step FROM runs WHERE model IS NOT NULL AND k % 5 = 0")
def changed_prompts(spark, sf_dir):
    """Every fifth step of a run has another prompt now."""
    own = S.event_runs(spark, sf_dir).withColumn("prompt_sha1", F.sha1(F.col("model").cast("binary")))
    now = own.withColumn("prompt_sha1", F.when(F.col("step") % 5 == 0, "new").otherwise(F.col("prompt_sha1")))
    return runs.changed_prompts(now.select("run", "step", "prompt_sha1"), own)


@query(S.EVENT_RUNS + " SELECT DISTINCT run FROM runs WHERE k = 3")
def runs_with_step(spark, sf_dir):
    return runs.having(S.event_runs(spark, sf_dir), 3)


@query(f"SELECT volume, entry FROM {S.CORPUS} SEMI JOIN (SELECT doc_id AS entry FROM labels WHERE quality = 1) USING (entry) SEMI JOIN (SELECT doc_id AS entry FROM labels WHERE toxic = 0) USING (entry)")
def entries_in_every_stage(spark, sf_dir):
    docs, labels = S.corpus(spark, sf_dir), S.table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "entry")
    return vita.in_every_stage([docs, *(docs.join(labels.where(c), "entry", "left_semi") for c in ("quality = 1", "toxic = 0"))])


@query(f"SELECT DISTINCT abbr FROM {S.CLEAN_SQL} UNION SELECT abbreviation FROM {S.DIOCESE_SQL}")
def known_abbreviations(spark, sf_dir):
    return scan.known_abbreviations(S.glossary(spark, sf_dir), S.dioceses(spark).withColumnRenamed("abbreviation", "abbr"))


@query(FORMS + f", counted AS (SELECT f.resolution, f.pos, f.word, count(*) AS forms, sum(v.n) AS n FROM forms f LEFT JOIN {VOCABULARY} v ON v.word = f.form WHERE f.form IS NOT NULL GROUP BY ALL) SELECT resolution, word, forms FROM counted WHERE forms > 1 AND n IS NULL")
def unattested_paradigms(spark, sf_dir):
    return glossary.unattested_paradigms(S.morphology(spark), scan.vocabulary(S.table(spark, sf_dir, "documents")))


# --- markup -----------------------------------------------------------------------------------


_XML = lambda x: f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(PAIRED + f""", spelled AS (SELECT *, array_to_string(list_transform(range(1, len(old) + 1), lambda i: CASE WHEN made[i] <> old[i]
    THEN '<choice><abbr>' || {_XML('old[i]')} || '</abbr><expan resp="#step1">' || {_XML('made[i]')} || '</expan></choice>'
    ELSE regexp_replace({_XML('old[i]')}, '(^|[^\\p{{Nd}}A-Za-z])(the\\.)', '\\1<abbr>\\2</abbr>', 'g') END), '') AS markup FROM done)
SELECT volume, entry, CASE WHEN coalesce(new, '') = '' THEN 'empty' ELSE 'accepted' END AS status, CAST(coalesce(hits, 0) AS INTEGER) AS choices,
CAST(coalesce(len(regexp_extract_all(new, '(?:^|[^\\p{{Nd}}A-Za-z])the\\.')), 0) AS INTEGER) AS kept, CAST(0 AS INTEGER) AS unplaced, CASE WHEN coalesce(new, '') <> '' THEN md5(markup) END AS markup_md5 FROM spelled""")
def tei_roundtrip(spark, sf_dir):
    docs = _expanded(spark, sf_dir).select("volume", "entry", "old", "script")
    rows = tei.lines_of(docs, "old", known=["the."])
    return rows.select("volume", "entry", "status", "choices", "kept", "unplaced", F.md5(F.col("markup").cast("binary")).alias("markup_md5"))


@query()
def tei_entries(spark, sf_dir):
    rows = S.regests(spark, sf_dir, len(PLACES)).withColumn("old", F.coalesce("head_text", "body_text"))
    done = rules.expand_with_script(rows.withColumn("new", F.col("old")), S.plain_rules(spark, sf_dir), "new")
    return tei.entries(tei.lines_of(done.select("volume", "entry", "line_no", "line_id", "old", "script"), "old"))


@query("SELECT doc_id, regexp_extract(t, '[A-Za-z]+\\.') AS token FROM (SELECT doc_id, unnest(regexp_extract_all(replace(text, ' of', ' 7of'), '\\p{Nd}[A-Za-z]+\\.')) AS t FROM documents)")
def tei_shelfmarks(spark, sf_dir):
    """Folios are made of some words: a number is put before them."""
    docs = S.table(spark, sf_dir, "documents")
    return tei.shelfmarks(docs.withColumn("text", F.replace("text", F.lit(" of"), F.lit(" 7of"))), "doc_id")


