"""Explicit schemas of the data model; nothing is inferred at a read."""

VOLUMES = range(1, 10)
PLACES = [f"in_{v}" for v in VOLUMES]

#: A corpus and every stage: one row for a header (line_no 0) or a regest.
REGESTS = "volume long, entry long, line_no long, head_text string, body_text string, line_id string"
VITAE = "volume long, entry long, text string"
#: A raw dictionary row; row_order keeps the file's order, which carries meaning.
RAW = ["abbr", "resolution", "translation", "notes", "stem", "declension", *PLACES, "remark_1", "remark_2"]
RAW_GLOSSARY = ", ".join(f"{c} string" for c in RAW) + ", row_order long"
FLAGS = ["multi", "foreign", "forced", "added"]
CLEAN_GLOSSARY = ", ".join(f"{c} string" for c in RAW) + ", volumes string, complex boolean"
OCCURRENCE = "struct<id int, abbreviation string, matched string, start int, end int>"
MANIFEST = "run string, step int, model string, thinking boolean, effort string, prompt_sha1 string, input string, output string, dump string, vitae long, written string, produced_by string"
