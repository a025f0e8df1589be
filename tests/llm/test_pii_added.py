"""Spans that the method adds, held against planted personal data and decoys."""

import random

from sigla.llm import pii

WORDS = "the quick brown clerk wrote about his orchard and a river bank near some old town".split()


def planted(n, seed):
    """Texts, each with the span that has to be added (None for decoys) and its kind."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    code = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    name = lambda: rng.choice(WORDS) + "." + rng.choice(WORDS)

    def failing():
        while pii._luhn(d := "4" + digits(15)):
            pass
        return d

    good = [
        lambda: (0, f"{name()} (at) mail{digits(1)} (dot) {rng.choice(['com', 'org', 'de'])}"),
        lambda: (3, f"({digits(3)}) {digits(3)}-{digits(4)}"),
        lambda: (3, f"{digits(3)}-{digits(3)}-{digits(4)}"),
        lambda: (4, f'token = "{code(40)}"'),
        lambda: (4, f"api_key: {code(24)}"),
    ]
    decoys = [failing, lambda: f"2024-0{rng.randint(1, 9)}-1{digits(1)} 10", lambda: f'sha256: "{code(64)}"', lambda: f"commit {code(40)}", lambda: f"300.{digits(3)}.1.2", lambda: f"{digits(11)}"]
    out = []
    for _ in range(n):
        left, right = (" ".join(rng.choices(WORDS, k=6)) for _ in range(2))
        if rng.random() < 0.5:
            kind, what = rng.choice(good)()
            value = what.split(" = ")[-1].split(": ")[-1].strip('"') if kind == 4 else what
            out.append((f"{left} {what} {right}", (kind, value)))
        else:
            out.append((f"{left} {rng.choice(decoys)()} {right}", None))
    return out


def test_added_spans_against_planted_ones(spark):
    rows = planted(1500, 3)
    known = [f"write to a{k}@mail.example.com or 10.0.{k % 256}.7, +1 (017) 555-{1000 + k}, 4111111111111111" for k in range(100)]
    docs = spark.createDataFrame([*((i, t) for i, (t, _) in enumerate(rows)), *((10_000 + i, t) for i, t in enumerate(known))], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, rows[r.doc_id][0][s.start : s.end]) for s in r.added] for r in pii.personal_data(docs).collect() if r.doc_id < 10_000}
    added = sum(map(len, got.values()))
    right = sum(want is not None and want in got[i] for i, (_, want) in enumerate(rows))
    wanted = sum(want is not None for _, want in rows)
    assert wanted > 600 and added > 0
    assert right / wanted > 0.95, (right, wanted)
    assert right / added > 0.95, (right, added)
    for kind in (0, 3, 4):
        assert sum(w is not None and w[0] == kind and w in got[i] for i, (_, w) in enumerate(rows)) > 50


def test_base_spans_of_every_kind_are_believed():
    counts = {}
    for k in range(200):
        text = f"Some words a{k}@mail.example.com here 129.38.82.{k} and +1 (974) 555-{3000 + k} then 4111111111111111 end"
        spans = pii.base_spans(text)
        assert [s[0] for s in spans] == [0, 1, 2, 3]
        for s in spans:
            key = "=" + pii.votes_and_shape(text, *s)
            counts[key] = counts.get(key, 0) + 1
    p = pii.train(counts)
    assert {k[1] for k in p} == set("0123") and min(p.values()) >= pii.ACCEPT


def test_secrets_of_small_and_odd_tables(spark):
    secret = "9a" * 20
    rows = [(1, f'password = "{secret}qwertz"'), (1, None), (2, ""), (3, "x" * 300_000 + f' token = "{secret[:30]}cdefghij"'), (4, "plain words only"), (4, "plain words only")]
    df = spark.createDataFrame([(*r, 7, "k") for r in rows], "doc_id long, text string, n_spans int, KEY string")
    out = sorted((r.doc_id, r.n_secret, r.n_added, r.n_spans) for r in pii.digest(pii.personal_data(df)).collect())
    assert out == [(1, 0, 0, 0), (1, 1, 1, 1), (2, 0, 0, 0), (3, 1, 1, 1), (4, 0, 0, 0), (4, 0, 0, 0)]
    assert pii.digest(pii.personal_data(df.limit(0))).count() == 0
