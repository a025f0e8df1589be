import math
import re
from collections import Counter

import xxhash
from sigla.llm import quality
from sigla.llm.queries import op6_quality_rules

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def grams(text):
    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in WORD.findall(text or "")]
    # A hash of two values starts the second with the first's hash as its seed.
    number = lambda x, seed: xxhash.xxh64_intdigest((x % (1 << 64)).to_bytes(8, "little"), seed)
    pairs = [signed(number(b, number(a, 42))) for a, b in zip(h, h[1:])]
    return [x % quality.BUCKETS for x in h + pairs]


def plain(docs, good):
    raw, target = Counter(), Counter()
    for i, t in docs:
        raw.update(grams(t))
        target.update(grams(t) if i in good else [])
    n, m = sum(raw.values()), sum(target.values())
    share = lambda b: (raw[b] + 1) / (n + quality.BUCKETS)
    weight = lambda b: round(math.log((target[b] + quality.PRIOR_NGRAMS * share(b)) / (m + quality.PRIOR_NGRAMS) / share(b)), 6) if m else 0
    out = []
    for i, t in docs:
        words, g = WORD.findall(t or ""), grams(t)
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        often = {w for w, c in Counter(windows).items() if c > 1}
        repeated = len({k + j for k, w in enumerate(windows) if w in often for j in range(8)})
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        failed = len(words) < 20 or 100 * repeated > 30 * len(words)
        score = sum(map(weight, g)) / len(g) if g else 0.0
        symbols = sum((t or "").count(c) for c in "#*$%&|<>")
        out.append((i, len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), repeated, failed, score))
    return out


def compare(got, want):
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.score, r.kept) for r in got), key=str)
    want = sorted(want, key=str)
    assert [x[:7] for x in got] == [x[:7] for x in want]
    for g, w in zip(got, want):
        assert abs(g[7] - w[7]) < 2e-6
        if abs(w[7] - quality.THRESHOLD) > 1e-5:
            assert g[8] == (not w[6] and w[7] >= quality.THRESHOLD)


def test_query_equals_counting_by_hand(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 1}
    compare(op6_quality_rules(spark, SF).collect(), plain(docs, good))


def test_nulls_repeats_long_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    again = "a b c d e f g h " * 3 + "x\x0by\x0cz q " * 4
    docs = [(1, None), (2, ""), (None, "a b"), (3, long), (3, again), (4, "l one\nl one\n \n \nl two\n"), (4, "l one\nl one\n \n \nl two\n")]
    df = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (None, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    compare(quality.rated(df, labels).collect(), plain(docs, {3}))
    compare(quality.rated(df, labels.limit(0)).collect(), plain(docs, set()))
    assert quality.rated(df.limit(0), labels).count() == 0
