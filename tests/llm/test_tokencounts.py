import tiktoken
from pyspark.sql import functions as F
from sigla.llm import bpe, tokencounts
from sigla.llm.queries import TOKENIZERS, op4_token_counts

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, version string, tokens long, docs int"


def totals(rollup):
    return {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in rollup.totals().collect()}


def test_deltas_and_idempotence(spark):
    rows = [(1, "a", "en", "v", 5, 0), (2, "a", "en", "v", 7, 0), (2, "a", "en", "v", 7, 0), (3, None, None, "v", 0, 0), (None, "b", "en", "v", 2, 0)]
    rollup = tokencounts.Rollup(spark)
    assert totals(rollup) == {}
    frame = lambda x: spark.createDataFrame(x, SCHEMA)
    assert rollup.commit("a", inserts=frame(rows)) and not rollup.commit("a", inserts=frame(rows))
    assert totals(rollup) == {("a", "en", "v"): (3, 19), (None, None, "v"): (1, 0), ("b", "en", "v"): (1, 2)}
    assert rollup.commit("b", revised=frame([(1, "a", "en", "v", 6, 0), (9, "a", "en", "v", 100, 0), (2, "c", "en", "v", 1, 0)]))
    assert totals(rollup) == {("a", "en", "v"): (1, 6), ("c", "en", "v"): (1, 1), (None, None, "v"): (1, 0), ("b", "en", "v"): (1, 2)}
    gone = frame([(2, "", "", "", 0, 0), (2, "", "", "", 0, 0), (None, "", "", "", 0, 0), (77, "", "", "", 0, 0)])
    assert rollup.commit("c", deletes=gone) and rollup.commit("d", deletes=gone) and rollup.commit("e", inserts=frame([]))
    assert totals(rollup) == {("a", "en", "v"): (1, 6), (None, None, "v"): (1, 0), ("b", "en", "v"): (1, 2)}
    # A batch that broke off before its success mark does not count, and can be committed again.
    frame([(5, "z", "en", "v", 1, 0)]).drop("docs").selectExpr("*", "1L as docs").write.parquet(f"{rollup.folder}/ledger/batch=f")
    assert rollup.batches() == ["a", "b", "c", "d", "e"]
    assert rollup.commit("f", inserts=frame([(5, "z", "en", "v", 4, 0)]))
    assert totals(rollup)["z", "en", "v"] == (1, 4)
    assert {tuple(r) for r in rollup.documents().collect()} == {(1, "a", "en", "v", 1, 6), (None, "b", "en", "v", 1, 2), (3, None, None, "v", 1, 0), (5, "z", "en", "v", 1, 4)}


def test_compaction_changes_nothing(spark):
    frame = lambda x: spark.createDataFrame(x, SCHEMA)
    rollup = tokencounts.Rollup(spark)
    rollup.compact()
    assert totals(rollup) == {} and rollup.batches() == []
    for k in range(4):
        rollup.commit(f"b{k}", inserts=frame([(i, "a", None, "v", i + k, 0) for i in range(5)]), deletes=frame([(k, "", "", "", 0, 0)]))
        before = totals(rollup), sorted(map(tuple, rollup.documents().collect()))
        if k != 2:
            rollup.compact()
        assert (totals(rollup), sorted(map(tuple, rollup.documents().collect()))) == before
    assert rollup.batches() == ["b0", "b1", "b2", "b3"] and not rollup.commit("b1", inserts=frame([(1, "a", None, "v", 1, 0)]))
    # A compaction that broke off before its names were written does not count.
    frame([(5, "z", "en", "v", 1, 0)]).drop("docs").selectExpr("*", "1L as docs").write.parquet(f"{rollup.folder}/ledger/snapshot=000000009")
    assert (totals(rollup), sorted(map(tuple, rollup.documents().collect()))) == before
    rollup.compact()
    assert totals(rollup) == before[0]


def test_query_equals_counting_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    toxic, bad = {r.doc_id for r in labels if r.toxic == 1}, {r.doc_id for r in labels if r.quality == 0}
    first, second = TOKENIZERS
    want = {}
    for version, (path, pattern) in TOKENIZERS.items():
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
        for d in docs:
            if d.doc_id not in toxic:
                text = "".join(c for c in d.text if c not in "#*$%&|<>") if version == first and d.doc_id in bad else d.text
                n, t = want.get((d.source, d.lang, version), (0, 0))
                want[d.source, d.lang, version] = n + 1, t + len(own.encode_ordinary(text))
    got = {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in op4_token_counts(spark, SF).collect()}
    assert got == want and bad and toxic and len({k[2] for k in got}) == 2


def test_counts_of_odd_rows(spark):
    rows = [(1, None, None, None, 1), (2, "s", "", None, 2), (None, "s", "ab " * 300_000, "en", 3), (3, "s", "a#b", "en", 4), (3, "s", "a#b", "en", 4)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, lang string, Version int").withColumn("TOKENS", F.lit(1))
    got = tokencounts.counted(df, TOKENIZERS).collect()
    assert len(got) == 10 and {(r.doc_id, r.tokens) for r in got if r.doc_id in (1, 2)} == {(1, 0), (2, 0)}
    assert all(r.tokens >= 300_000 and r.tokens == r.bare for r in got if r.doc_id is None)
    assert all(r.bare < r.tokens for r in got if r.doc_id == 3)
    assert tokencounts.counted(df.limit(0), TOKENIZERS).count() == 0
