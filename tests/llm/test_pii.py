import random
import re
from hashlib import sha256

from sigla.llm import pii
from sigla.llm.queries import op8_pii

SF = "/root/testdata/sf0.001"


def plain(text):
    """The base rules, pattern by pattern."""
    text, out = text or "", []
    out += [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return out


def spelled(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)


def test_base_rules_on_noise():
    rng = random.Random(4)
    for n in range(4000):
        text = "".join(rng.choice("a.b@@--1234 45 +()é%_٣x") for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == plain(text), text
    card = "4111 1111-1111 1111"
    assert pii.base_spans(f"x {card} 1.2.3.4.5.6.7.8 a@b@c.d.e")[0][0] == 0
    assert spelled(pii.base_spans(card)) == "card:0:19"


def test_query_on_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op8_pii(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, *_ in want) for i in range(4)]
        assert r.base_sha256 == sha256(spelled(want).encode()).hexdigest()
        assert set(spelled(want).split(",")) <= set(r.spans.split(","))


def test_nulls_empty_long_repeated(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "a@b.c", 0), (3, "7" * 100_000, 0), (4, "1." * 20_000, 0), (4, "ü mail x.y@z.org", 0), (5, "a@" * 20_000, 0)]
    got = pii.digest(pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string, base int"))).collect()
    assert sorted((str(r.doc_id), r.spans) for r in got) == sorted((str(i), spelled(plain(t)) if i in (None, 4) else "") for i, t, _ in rows)
    assert pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string, base int").limit(0)).count() == 0


def test_labelers_classifier_on_held_out_spans():
    """The classifier, trained without labels, is held against labels it never saw."""
    rng = random.Random(9)

    def luhn_card():
        body = "4" + "".join(str(rng.randrange(10)) for _ in range(13))
        return next(body + str(c) for c in range(10) if pii._luhn(body + str(c)))

    truth, counts = {}, {}
    for n in range(3000):
        good = n % 2 == 0
        number = luhn_card() if good else "".join(str(rng.randrange(10)) for _ in range(15))
        text = f"{'card' if good and rng.random() < 0.7 else 'word'} {number} end" if good else f"token = \"{number}\""
        for c in pii.candidates(text):
            if c[0] == 2:
                key = pii.votes_and_shape(text, *c)
                counts[key] = counts.get(key, 0) + 1
                truth.setdefault(key, []).append(good)
    p = pii.train(counts)
    right = sum(sum(g == (p[k] >= 0.5) for g in truth[k]) for k in truth)
    assert right / sum(map(len, truth.values())) > 0.95
