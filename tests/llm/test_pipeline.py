"""The pipeline against the operators' brute-force versions, stage after stage."""

import hashlib
import math
from collections import Counter

import corpus_pipeline
import tiktoken
from public_tokenizers import PATTERN
from sigla.llm import bpe, linededup, quality
from sigla.llm.queries import RANKS

import test_linededup
import test_minhash
import test_mixing
import test_quality

SF = "/root/testdata/sf0.001"


def staged(spark, docs=None):
    df = spark.read.parquet(f"{SF}/documents.parquet") if docs is None else docs
    out = []
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SF).cache()
        out.append(df.collect())
    return out


def test_every_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    first, second, third, fourth, last = staged(spark)

    good = {r.doc_id for r in labels if r.quality == 1}
    judged = {r[0]: not r[6] and r[7] >= quality.THRESHOLD for r in test_quality.plain([(d.doc_id, d.text) for d in docs], good)}
    assert sorted(first) == sorted(d for d in docs if judged[d.doc_id])

    cut = {(s, t): c for s, t, c, *_ in test_linededup.plain([(d.source, d.text) for d in first], linededup.RATIO, linededup.MIN_PAGES)}
    texts = {d.doc_id: cut[d.source, d.text] if cut[d.source, d.text].split() else d.text for d in first}
    assert {d.doc_id: d.text for d in second} == texts and all(d.n_chars == len(d.text) for d in second)

    components = {i: c for i, _, c in test_minhash.plain_components([(d.doc_id, d.text) for d in second])}
    assert sorted(third) == sorted(d for d in second if components[d.doc_id] == d.doc_id)

    taken, _ = test_mixing.plain([(d.doc_id, d.source, d.text) for d in third], [(r.doc_id, r.quality) for r in labels])
    copies = Counter({i: math.ceil(t / n) if n else 0 for i, n, *_, t in taken})
    assert Counter(d.doc_id for d in fourth) == +copies

    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    want = Counter((d.doc_id, len(ids := encoding.encode_ordinary(d.text)), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(d.text.encode()).hexdigest()) for d in fourth)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in last) == want
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(last)


def test_odd_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    words = " ".join(f"word{k}" for k in range(40))
    rows = [(1, None, None, None, None), (None, words, "en", None, 0), (5, words, "en", "s", 9), (5, words, "en", "s", 9), (4, words + " more", "en", "t", 1), (None, "x " * 9, "en", "s", 0)]
    extra = spark.createDataFrame(rows, schema)
    first, second, third, fourth, last = staged(spark, extra)
    assert Counter(d.doc_id for d in first) == {None: 1, 5: 2, 4: 1}
    assert Counter(d.doc_id for d in third) == {None: 1, 4: 1}
    assert {d.doc_id for d in fourth} == {None, 4} and len(last) == len(fourth)
    assert [len(x) for x in staged(spark, extra.limit(0))] == [0] * 5


def test_stages_keep_the_columns(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    names = df.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, SF)
        assert df.columns == names
