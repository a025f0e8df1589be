"""Personal data by weak supervision.

Four kinds of spans have exact base rules.  Wider patterns propose further candidates: numbers in
other layouts, addresses that are spelled out, and secrets (values that are assigned to a name, and
long codes), a kind without base rules.  Labelers look at each candidate, and at the base spans,
and vote for, against, or not at all: the regex labeler (layout), the gazetteer labeler (known
top-level domains, calling codes, issuer prefixes, special address ranges, names and prefixes of
secrets), the context labeler (words before the span), the checksum labeler (check digits, ranges,
variety of characters) and the border labeler.

Expectation-maximisation over the counts of vote patterns, a kind at a time, estimates each
labeler's reliability and each pattern's posterior.  Base spans are known to be true; rows that all
labelers agree on, and near misses, are added as seeds, so a kind is never without either side and
small tables are judged like large ones.  These soft labels train a logistic classifier on votes and shape, which decides on the candidates.

One pass over the texts keeps spans only.  Counts cover all candidates; their key is whether a base
rule found the span, a kind, five votes of three values and three small shape numbers, so there
are at most 2 * 5 * 3^5 * SHAPES of them however large the corpus, and collecting them is bounded.

Edge cases: null and empty texts have no span; very long texts are searched whole, in time that
grows with their length, in the memory of one text; rows that repeat an id, and equal rows, are
each searched; ties between overlapping candidates go to the one that starts first, then the
longest, then the first kind; without candidates nothing is added, and an empty table gives no
rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8, write_shared

KINDS = ("email", "ip", "card", "phone", "secret")
SECRET = 4
SHAPES = 4 * 4 * 3
#: A candidate is added from this probability on.
ACCEPT = 0.9
#: Rows of each kind that all labelers are for, as many that all are against, and as many of each
#: near miss: votes that look like a kind but for the one labeler that its definition rests on.
SEEDS = 6
NEAR_MISSES = {0: ("+-0++", "-+0++"), 1: ("++0-+",), 2: ("++0-+",), 3: ("-00++",), 4: ("-00++", "+-0++")}


_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@=:]|[([](?:at|AT)[)\]]")
_NUMBER = re.compile(r"(?<![0-9])\+?\(?[0-9]++(?:[ ().-]{1,2}[0-9]++)*+")
_SPELLED = re.compile(r"([A-Za-z0-9._%+-]{1,64}) ?[(\[](?:at|AT)[)\]] ?([A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[](?:dot|DOT)[)\]]) ?[A-Za-z0-9-]{1,63}){1,8})")
_ASSIGNED = re.compile(r"[=:][ ]{0,2}[\"']?([A-Za-z0-9+/_~-]{16,}+=*+)")
_NAME = re.compile(r"([A-Za-z][A-Za-z0-9_-]{0,40})[\"']? {0,2}:?\Z")
_CODE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+")
_LOCAL_PHONE = re.compile(r"\([0-9]{2,5}\) ?[0-9]{3,4}(?:[ .-][0-9]{3,4})?|[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}|0[0-9]{2,4}[ -][0-9]{3,4}[ -]?[0-9]{3,4}")
_WORD = re.compile(r"[^\W\d_]+")

# Public assignments that the gazetteer labeler knows.
DOMAINS = frozenset("com org net edu gov int info biz io eu de fr es it uk us ca nl be ch at pl se no dk fi pt ie au nz jp cn in br mx ru".split())
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "351", "352", "353", "358", "380", "420", "421")
ISSUERS = ("4", "51", "52", "53", "54", "55", "2221", "2720", "34", "37", "36", "38", "6011", "65", "35")
SECRET_NAMES = frozenset("token secret password passwd pwd apikey api_key api-key access_key secret_key private_key client_secret auth credential credentials bearer".split())
SECRET_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "sk-", "eyJ")
PUBLIC_NAMES = frozenset("sha sha1 sha256 md5 hash commit checksum digest etag integrity revision rev uuid id version url href src path file".split())
FOR_WORDS = {
    "email": frozenset("mail email e contact write courriel correo adresse address".split()),
    "ip": frozenset("ip host server address client addr peer from".split()),
    "card": frozenset("card visa mastercard amex credit debit karte carte tarjeta payment".split()),
    "phone": frozenset("tel phone telephone call fax mobile cell telefon téléphone teléfono ruf".split()),
    "secret": frozenset("token secret password passwd key auth credential credentials bearer login api".split()),
}
AGAINST_WORDS = frozenset("version v release section chapter isbn issn article figure page pages id sha hash build no number commit digest checksum".split())
NUMBER_AGAINST = AGAINST_WORDS | {"token", "key"}


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the base rules, by kind and start."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        low = at
        while low > done and (text[low - 1].isascii() and (text[low - 1].isalnum() or text[low - 1] in "._%+-")):
            low -= 1
        if low < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, low, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 40 and 16 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def candidates(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of what the wider patterns propose."""
    for m in _SPELLED.finditer(text):
        yield 0, m.start(), m.end()
    for m in _NUMBER.finditer(text):
        size = m.end() - m.start()
        if not 7 <= size <= 40:
            continue
        n = len(_digits(m[0]))
        if m[0].count(".") == 3 and _IP.fullmatch(m[0]):
            yield 1, m.start(), m.end()
        elif 13 <= n <= 19:
            yield 2, m.start(), m.end()
        if 8 <= n <= 15:
            yield 3, m.start(), m.end()
    assigned = set()
    for m in _ASSIGNED.finditer(text):
        assigned.add(m.start(1))
        yield SECRET, m.start(1), m.end(1)
    for m in _CODE.finditer(text):
        if m.start() not in assigned and any("0" <= c <= "9" for c in m[0]):
            yield SECRET, m.start(), m.end()


def _named(text: str, start: int) -> str:
    """The name that a value at ``start`` is assigned to, in lower case."""
    m = _NAME.search(text[max(0, start - 48) : start].rstrip("\"' ").rstrip("=:"))
    return m[1].lower() if m else ""


def _votes_on_secret(text: str, start: int, end: int) -> tuple[bool, bool, bool, bool, bool, bool]:
    """For and against by layout, gazetteer and checksum."""
    value, name = text[start:end], _named(text, start)
    given = text[max(0, start - 4) : start].rstrip("\"' ")[-1:] in ("=", ":") and bool(name)
    parts = set(re.split("[_-]", name)) | {name}
    known = bool(parts & SECRET_NAMES) or name.endswith(("token", "secret", "password", "key")) or value.startswith(SECRET_STARTS)
    kinds = sum(bool(re.search(p, value)) for p in ("[0-9]", "[a-z]", "[A-Z]"))
    varied = len(set(value[:256])) >= 10 and kinds >= 2
    given = given or value.startswith(SECRET_STARTS)
    return given, not given, known, bool(parts & PUBLIC_NAMES) or "/" in value[:1], varied, not varied


def votes_and_shape(text: str, kind: int, start: int, end: int) -> str:
    """The candidate's key: kind, a vote (+, - or 0) of each labeler, and its shape."""
    span = text[start:end]
    before = _WORD.findall(text[max(0, start - 40) : start].lower())[-4:]
    mark = lambda yes, no: "+" if yes else "-" if no else "0"
    if kind == 0:
        layout = mark("@" in span or re.search(r"\.[A-Za-z]|(?i:dot)", span), True)
        known = mark(re.split(r"[^A-Za-z]+", span.rstrip("])"))[-1].lower() in DOMAINS, True)
        check = mark(span[0].isalnum() and ".." not in span, True)
    elif kind == 1:
        parts = span.split(".")
        layout = mark(all(len(p) <= 3 for p in parts), True)
        known = mark(0 < int(parts[0][:9]) < 224, parts[0].lstrip("0") in ("", "255"))
        check = mark(all(map(_small, parts)), True)
    elif kind == 2:
        digits = _digits(span)
        layout = mark(len(set(re.sub("[0-9]", "", span))) <= 1 and not set(span) & set("().+"), True)
        known = mark(digits.startswith(ISSUERS), False)
        check = mark(len(digits) >= 13 and _luhn(digits), True)
    elif kind == 3:
        digits = _digits(span)
        layout = mark(span.startswith("+") or _LOCAL_PHONE.fullmatch(span), True)
        known = mark(span.startswith("+") and digits.startswith(CALLING_CODES), span.startswith("+"))
        check = mark(8 <= len(digits) <= 15 and len(set(digits)) >= 3, True)
    else:
        *pairs, yes, no = _votes_on_secret(text, start, end)
        layout, known, check = mark(*pairs[:2]), mark(*pairs[2:]), mark(yes, no)
    against = AGAINST_WORDS if kind == SECRET else NUMBER_AGAINST
    context = mark(any(w in FOR_WORDS[KINDS[kind]] for w in before), any(w in against for w in before))
    around = (text[start - 1 : start] or " ") + (text[end : end + 1] or " ")
    border = mark(not any(c.isalnum() or c in ("_/#" if kind == SECRET else "_/=#\"'") for c in around), True)
    others = len(set(c for c in span[:256] if not c.isalnum()))
    shape = f"{min(3, (end - start) // 8)}{min(3, others)}{min(2, len(before))}"
    return f"{kind}{layout}{known}{context}{check}{border}{shape}"


def _merged(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of spans."""
    starts: list[int] = []
    ends: list[int] = []
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def search(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, base spans, and candidates that no base span meets (secrets may hold one); all with their keys."""
    span = "array<struct<kind int, start int, end int, key string>>"
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {span}, found {span}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "start", "end", "key")
        kind = pa.list_(pa.struct(list(zip(names, (pa.int32(), pa.int32(), pa.int32(), pa.string())))))
        for batch in slices(batches, "utf8"):
            rows: tuple[list, list] = ([], [])
            for raw in batch.column(1).to_pylist():
                t = raw.decode("utf-8", "replace")
                base = base_spans(t) if _ANY.search(t) else []
                found = []
                if _ANY.search(t):
                    starts, ends = _merged(base)
                    for c in candidates(t):
                        k = bisect_left(starts, c[2])  # the spans before it start before its end
                        if c[0] == SECRET or not k or ends[k - 1] <= c[1]:
                            found.append(c)
                for out, spans in zip(rows, (base, found)):
                    out.append([dict(zip(names, (*x, votes_and_shape(t, *x)))) for x in spans])
            columns = [batch.column(0), *(pa.array(x, kind) for x in rows)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "base", "found"])

    return docs.select("doc_id", utf8(f"`{text}`").alias("utf8")).mapInArrow(run, schema)


def posteriors(counts: dict[str, int], rounds: int = 50) -> tuple[dict[str, float], dict[int, np.ndarray]]:
    """P(true) of each key's origin, kind and votes, and each labeler's P(+ | true), P(- | false), by EM.

    Keys of spans of the base rules, which are true, have ``=`` before them.  Votes are independent given the truth; a labeler that abstains says nothing.  The
    seeds keep reliabilities and the prior of candidates off 0 and 1.
    """
    by_kind: dict[int, dict[str, int]] = defaultdict(lambda: defaultdict(int))
    for key, n in sorted(counts.items()):
        origin, key = key[: key.startswith("=")], key.removeprefix("=")
        by_kind[int(key[0])][origin + key[1:6]] += n
    out, reliable = {}, {}
    for kind, found in sorted(by_kind.items()):
        patterns = [*found, "=+++++", *("!" + x for x in ("-----", *NEAR_MISSES[kind]))]
        votes = np.array([["-0+".index(c) - 1 for c in p[-5:]] for p in patterns], dtype=np.float64)
        n = np.array([*found.values(), *[SEEDS] * (len(patterns) - len(found))], dtype=np.float64)
        sure, false = np.array([p[0] == "=" for p in patterns]), np.array([p[0] == "!" for p in patterns])
        open_ = ~sure & ~false
        p = np.where(sure, 1.0, np.where(false, 0.0, 1 / (1 + np.exp(-(votes.sum(axis=1) - 1.5)))))
        plus, minus = votes > 0, votes < 0
        for _ in range(rounds):
            yes = ((n * p) @ plus + 1) / ((n * p) @ (plus | minus) + 2)
            no = ((n * (1 - p)) @ minus + 1) / ((n * (1 - p)) @ (plus | minus) + 2)
            # The prior is that of candidates: how many base spans there are says nothing about them.
            prior = ((n * p)[open_].sum() + SEEDS) / (n[open_].sum() + 2 * SEEDS)
            score = np.log(prior / (1 - prior)) + plus @ np.log(yes / (1 - no)) + minus @ np.log((1 - yes) / no)
            p = np.where(open_, 1 / (1 + np.exp(-np.clip(score, -30, 30))), p)
        out |= {f"{v[:-5]}{kind}{v[-5:]}": float(x) for v, x in zip(patterns, p)}
        reliable[kind] = np.stack([yes, no])
    return out, reliable


def _features(key: str) -> list[float]:
    """Of a key's kind alone: each vote for and against, the shape, and a constant."""
    key = key.removeprefix("=")
    own = [float(c == v) for c in key[1:6] for v in "+-"]
    own += [float(key[6 + i] == str(k)) for i, n in enumerate((4, 4, 3)) for k in range(n)] + [1.0]
    out = [0.0] * (len(own) * len(KINDS))
    at = int(key[0]) * len(own)
    out[at : at + len(own)] = own
    return out


def train(counts: dict[str, int], steps: int = 25, penalty: float = 0.05) -> dict[str, float]:
    """P(true) of each key by a logistic classifier that soft labels train, by Newton's method."""
    if not counts:
        return {}
    soft, _ = posteriors(counts)
    keys = sorted(counts)
    seeds = {f"{k}{votes}{shape}": float(votes == "+++++") for k in range(len(KINDS)) for votes in ("+++++", "-----", *NEAR_MISSES[k]) for shape in ("000", "122", "202", "302")}
    x = np.array([_features(k) for k in [*keys, *seeds]])
    y = np.array([soft[k[:-3]] for k in keys] + [*seeds.values()])
    n = np.array([counts[k] for k in keys] + [SEEDS / 4] * len(seeds), dtype=np.float64)
    n = n / n.sum() * min(n.sum(), 1e6)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + penalty * w
        curvature = (x * (n * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        w -= np.linalg.solve(curvature, gradient)
    return dict(zip(keys, (1 / (1 + np.exp(-np.clip(x[: len(keys)] @ w, -30, 30)))).tolist()))


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, base and added spans (arrays of kind, start, end) of each row of ``docs``."""
    found = write_shared(search(docs, text), "spans")
    # Base spans vote too: they are what the labelers' reliabilities are estimated against.
    known = F.transform("base", lambda s: F.concat(F.lit("="), s.key))
    keys = found.select(F.explode(F.concat(known, F.transform("found", lambda s: s.key))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    accepted = sorted(k for k, p in train({r.key: r.n for r in keys.collect()}).items() if not k.startswith("=") and p >= ACCEPT)
    good = F.filter("found", lambda s: s.key.isin(accepted)) if accepted else F.slice("found", 1, 0)
    # Of candidates that overlap, the one that starts first stays, and of those the longest.
    ordered = F.array_sort(F.transform(good, lambda s: F.struct(s.start.alias("start"), (-s.end).alias("less"), s.kind.alias("kind"))))
    empty = F.expr("named_struct('end', 0, 'kept', cast(array() as array<struct<kind:int,start:int,end:int>>))")
    one = lambda s: F.array(F.struct(s.kind.alias("kind"), s.start.alias("start"), (-s.less).alias("end")))
    step = lambda a, s: F.when(s.start >= a.end, F.struct((-s.less).alias("end"), F.concat(a.kept, one(s)).alias("kept"))).otherwise(a)
    base = F.transform("base", lambda x: F.struct(x.kind.alias("kind"), x.start.alias("start"), x.end.alias("end")))
    return found.select("doc_id", base.alias("base"), F.aggregate(ordered, empty, step).kept.alias("added"))


def digest(rows: DataFrame) -> DataFrame:
    """The counts of base spans, their digest, all spans, and how many of them the method added."""
    name = F.array(*[F.lit(k) for k in KINDS])
    spell = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(name, s.kind), s.start, s.end)), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long")
    return rows.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:SECRET])],
        F.sha2(spell(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        spell(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        F.size(F.filter("added", lambda s: s.kind == SECRET)).cast("long").alias("n_secret"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )


def _found_sql(kind: int, pattern: str, good: str) -> str:
    """Leftmost matches that are good, with their places: matches are marked, and texts cut there."""
    return f"""SELECT doc_id, {kind} AS kind, place AS start, place + length(m) AS stop FROM (
    SELECT doc_id, m, regexp_replace(m, '[^0-9]', '', 'g') AS d, CAST(coalesce(list_sum(list_transform(p[:i - 1], lambda x: length(replace(x, chr(57345), '')))), 0) AS BIGINT) AS place
    FROM (SELECT doc_id, p, i, split_part(p[i], chr(57345), 1) AS m FROM (SELECT doc_id, p, unnest(range(2, len(p) + 1)) AS i
          FROM (SELECT doc_id, string_split(regexp_replace(text, '({pattern})', chr(57344) || '\\1' || chr(57345), 'g'), chr(57344)) AS p FROM documents))))
WHERE {good}"""


_LUHN = "list_sum(list_transform(range(0, length(d)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(d[length(d) - i] AS INTEGER) WHEN d[length(d) - i] > '4' THEN 2 * CAST(d[length(d) - i] AS INTEGER) - 9 ELSE 2 * CAST(d[length(d) - i] AS INTEGER) END)) % 10 = 0"
_BYTES = "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(x AS INTEGER), 256) > 255)) = 0"
#: The base rules in DuckDB SQL.
BASE_SQL = f"""
WITH found AS ({_found_sql(0, "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+", "true")} UNION ALL {_found_sql(1, "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", _BYTES)}
UNION ALL {_found_sql(2, "[0-9](?:[ -]?[0-9])+", "CASE WHEN length(d) BETWEEN 16 AND 19 THEN " + _LUHN + " ELSE false END")} UNION ALL {_found_sql(3, "[+][0-9][ ().0-9-]+[0-9]", "length(d) BETWEEN 8 AND 15")}),
told AS (SELECT doc_id, count_if(kind = 0) AS n_email, count_if(kind = 1) AS n_ip, count_if(kind = 2) AS n_card, count_if(kind = 3) AS n_phone,
         string_agg(['email', 'ip', 'card', 'phone'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY kind, start) AS spans FROM found GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_email, 0) AS BIGINT) AS n_email, CAST(coalesce(n_ip, 0) AS BIGINT) AS n_ip, CAST(coalesce(n_card, 0) AS BIGINT) AS n_card, CAST(coalesce(n_phone, 0) AS BIGINT) AS n_phone, sha256(coalesce(spans, '')) AS base_sha256
FROM documents LEFT JOIN told USING (doc_id)"""
