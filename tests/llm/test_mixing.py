import hashlib
import math
import re
from collections import defaultdict

from sigla.llm import mixing
from sigla.llm.queries import op10_mixing

SF = "/root/testdata/sf0.001"


def plain(docs, labels):
    q = defaultdict(list)
    for i, quality in labels:
        q[i].append(quality)
    rows = []
    for i, source, text in docs:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        w = 0.25 + 0.75 * sum(q[i]) / len(q[i]) if i is not None and i in q else 0.5
        u = (int(hashlib.md5(f"{'' if i is None else i}-{size}-mix".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        rows.append((i, source, size, -math.log(u) / w))
    total = defaultdict(int)
    for _, s, n, _ in rows:
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, free, target = 1.5 * sum(total.values()), set(order), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        above = {s for s in free if unit * weight[s] > 2 * total[s]}
        if not above:
            break
        for s in above:
            target[s] = 2.0 * total[s]
            left -= target[s]
        free -= above
    target |= {s: unit * weight[s] for s in free}
    out, used = [], defaultdict(int)
    for i, s, n, key in sorted(rows, key=lambda r: (r[3], -1 if r[0] is None else r[0], r[2])):
        epochs = int(target[s] // total[s]) if total[s] else 0
        rest = math.floor(target[s] - epochs * total[s] + 0.5)
        out.append((i, n, total[s], round(target[s], 6), epochs * n + max(0, min(n, rest - used[s]))))
        used[s] += n
    return sorted(out, key=str), target


def rows_of(df):
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=str)


def test_query_equals_sequential_sampling(spark, monkeypatch):
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    want, target = plain(docs, labels)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 3)
    got = rows_of(op10_mixing(spark, SF))
    assert got == want == rows_of(op10_mixing(spark, SF))
    assert abs(sum(r[4] for r in got) - sum(target.values())) <= len(target)


def test_nulls_ties_repeats_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 2)
    docs = [(k, f"s{k % 4}" if k % 5 else None, " ".join("w" * (k % 7 + 1))) for k in range(60)]
    docs += [(None, "s1", "a b c")] * 3 + [(7, "s1", "a b c")] * 2 + [(100, "empty", None), (101, "empty", " \n"), (102, "big", "x " * 20_000), (103, "é", "y"), (104, "z", "y")]
    labels = [(7, 1), (7, 0), (8, 0), (None, 1)]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, source string, text string, target int, range int")
    lab = spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int")
    assert rows_of(mixing.mix(df, lab)) == plain(docs, labels)[0]
    assert mixing.mix(df.limit(0), lab.limit(0)).count() == 0
    assert rows_of(mixing.mix(df.where("source = 'empty'"), lab)) == [(100, 0, 0, 0.0, 0), (101, 0, 0, 0.0, 0)]


def test_rows_without_id_are_drawn_by_their_text_whatever_the_partitions(spark):
    rows = [(None, f"{chr(97 + i % 26)}{i} two three", "s") for i in range(40)] + [(k, "one two three", "r") for k in range(30)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    taken = []
    for n in (1, 5, 9):
        docs = spark.createDataFrame(rows[::-1] if n == 5 else rows, "doc_id long, text string, source string").repartition(n)
        taken.append(sorted((r.text, r.source, r.doc_id) for r in mixing.mixed(docs, labels).where("doc_id is null").collect()))
    assert taken[0] == taken[1] == taken[2] and 0 < len(taken[0]) != 40
