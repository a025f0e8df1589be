"""The columns that SQL can express, held against it, and names that clash in every stage."""

import corpus_pipeline
import duckdb
import pytest
from sigla.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name]).fetchdf()
    got = QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) > 0
    columns = sorted(got.columns)
    plain = lambda df: sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).round(6).itertuples(index=False, name=None)))
    assert plain(got) == plain(want)


def test_stages_with_clashing_and_odd_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, Clean_Text string, SCORE int, q_text string, row int, mx_key string, hash string, n_words int"
    words = " ".join(f"word{k}" for k in range(40))
    long = " ".join(f"w{k}" for k in range(60_000))
    docs = [(1, words, "en", "s", 9), (2, long, "de", None, 1), (3, words, "en", "s", 9), (4, None, None, None, None), (5, "", "en", "s", 0), (None, words + " x", "fr", "t", 0)]
    df = spark.createDataFrame([(*d, "c", 7, "q", 3, "m", "h", 4) for d in docs], schema)
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == names and {r.doc_id for r in out.collect()} <= {1, 2, 3, 4, 5, None}
    kept = corpus_pipeline.near_dedup(spark, df, SF).collect()
    assert sorted((str(r.doc_id) for r in kept)) == ["1", "2", "4", "5", "None"]
    assert corpus_pipeline.tokens(spark, df, SF).count() == 6
