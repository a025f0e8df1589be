import random

import numpy as np
from sigla.llm import minhash
from sigla.llm.queries import op1_minhash

SF = "/root/testdata/sf0.001"


def plain_sets(texts):
    out = []
    for t in texts:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ")
        for c in "\n\v\f\r":
            words = words.replace(c, " ")
        words = [w for w in words.split(" ") if w]
        n = min(5, len(words))
        out.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set())
    return out


def plain_components(rows):
    """Smallest reachable id by comparing all pairs."""
    ids, sets = [r[0] for r in rows], plain_sets([r[1] for r in rows])
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def link(a, b):
        a, b = sorted((find(a), find(b)))
        parent[b] = a

    holders = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    for k, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j < k}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                link(ids[k], ids[j])
    return [(i, len(s), find(i) if s else i) for i, s in zip(ids, sets)]


def test_query_equals_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = op1_minhash(spark, SF).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(plain_components(rows))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_chains_hubs_and_short_texts(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(50))
    rows, base = [], [word() for _ in range(120)]
    for i in range(200):  # a chain: each text changes a little more
        rows.append((1000 - i, " ".join(base)))
        base[rng.randrange(120)] = word()
    rows += [(2000 + i, " ".join(["x", "y", "z", str(i % 3)][: 1 + i % 4])) for i in range(12)]
    tail = [word() for _ in range(60)]
    for i in range(300):  # texts of their own around a shared passage
        rows.append((3000 + i, " ".join([word() for _ in range(30)] + tail)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, _, c in plain_components(rows)}


def test_nulls_repeats_and_clashing_columns(spark):
    text = "one two three four five six seven eight"
    rows = [(1, None, 0), (2, "", 0), (3, " \n", 0), (9, text, 0), (7, text.upper(), 0), (7, "other words entirely in this one row", 0), (8, "Other words entirely in this one row", 0), (None, text, 0), (4, "a b", 0), (5, "A\tb", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int").withColumnRenamed("node", "component_id")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (7, 3, 7, True), (7, 4, 7, True), (8, 3, 7, False), (9, 4, 7, False), (None, 4, None, True)]
    assert got == sorted(want, key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_estimate_is_unbiased():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.75, 0.9):
        errors = []
        for _ in range(200):
            union = rng.integers(0, 2**63, 400, dtype=np.uint64)
            common = union[: int(400 * share)]
            rest = union[len(common) :]
            a, b = np.concatenate([common, rest[::2]]), np.concatenate([common, rest[1::2]])
            agree = (minhash.registers(a) == minhash.registers(b)).mean()
            errors.append(minhash.estimate(agree, len(a), len(b)) - len(common) / 400)
        assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 1.3 * (share * (1 - share) / minhash.REGISTERS) ** 0.5


def test_large_groups_are_divided_without_loss(spark, monkeypatch):
    """Texts around a shared passage, some just above the threshold, in groups of many blocks."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    tail = [word() for _ in range(90)]
    rows = [(k, " ".join(tail + [word() for _ in range(60)])) for k in range(150)]
    for k in range(0, 150, 5):  # partners that differ in a word or a few more, some on either side
        other = rows[k][1].split()
        for at in range(0, 4 * (1 + k % 4), 4):
            other[95 + at] = word()
        rows.append((1000 + k, " ".join(other)))
    got = lambda: {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: c for i, _, c in plain_components(rows)}
    assert len(set(want.values())) > 140 and len(want) > len(set(want.values()))
    assert got() == want
    monkeypatch.setattr(minhash, "BLOCK", 4)
    assert got() == want


def test_deduplicated_keeps_odd_columns_and_rows(spark):
    text = "one two three four five six seven eight"
    rows = [(3, text, 1, "a"), (2, text.upper(), 2, "b"), (2, "another text that is first by its hash or not", 3, "c"), (None, text, 4, "d"), (None, None, 5, "e"), (7, None, 6, "f"), (7, None, 6, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, mh_once int, KEPT string")
    got = minhash.deduplicated(df)
    assert got.columns == df.columns
    out = sorted(((r.doc_id, r.mh_once) for r in got.collect()), key=str)
    assert [i for i, _ in out] == [2, 7, None, None] and {m for i, m in out if i is None} == {4, 5}
    assert minhash.deduplicated(df.limit(0)).count() == 0


def test_very_long_text(spark):
    long = " ".join(f"w{k % 70_001}" for k in range(300_000))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, "w1 w2 w3")], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()}
    assert got == {1: (70_001, 1), 2: (70_002, 1), 3: (1, 3)}
