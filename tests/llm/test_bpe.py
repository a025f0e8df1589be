import hashlib
import pickle
import random
import tracemalloc
from array import array
from itertools import product

import public_tokenizers
import pyarrow as pa
import tiktoken
from sigla.llm import bpe, common
from sigla.llm.queries import RANKS, op7_byte_bpe

SF = "/root/testdata/sf0.001"


def reference_encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_replay_equals_word_by_word_merging():
    encoding, replayer = reference_encoding(), bpe.Replayer(bpe.load_ranks(RANKS))
    rng = random.Random(3)
    words = ["".join(rng.choice("abeinrst'!0é") for _ in range(rng.randrange(1, 60))) for _ in range(500)] + ["a" * 5000, "ab" * 3000]
    for w, ids in zip(words, replayer.replay([w.encode() for w in words])):
        assert b"".join(replayer.bytes_of[i] for i in ids) == w.encode()
        whole = replayer.ranks.get(w.encode())
        assert list(ids) == ([whole] if whole is not None else encoding._core_bpe.encode_single_piece(w.encode()))


def test_waves_equal_replay():
    replayer = bpe.Replayer(bpe.load_ranks(RANKS))
    rng = random.Random(8)
    words = ["".join(rng.choice("abeinrst'!0é ") for _ in range(rng.randrange(1, 130))).encode() for _ in range(3000)]
    words += [b"a" * k for k in range(1, 300)] + [b"ab" * 70, bytes(range(256)), b"\xff" * 9]
    merged = bpe.Waves(replayer).merge(words)
    assert [tuple(memoryview(x).cast("i")) for x in merged] == replayer.replay(words)
    assert bpe.Waves(replayer).merge([]) == []


def test_query_on_whole_table(spark):
    encoding = reference_encoding()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op7_byte_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_nulls_empty_long_repeated_and_clashing_columns(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, "a  b\n", None), (3, "ab" * 100_000, "z"), (3, "ab" * 100_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, utf8 string")
    out = bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "text", "utf8", "ids"]
    back = bpe.decode(out, RANKS).collect()
    assert sorted(bytes(r.decoded).decode() for r in back) == sorted(r[1] or "" for r in rows)
    assert sorted((r.utf8 or "") for r in back) == ["", "x", "y", "z", "z"]
    assert bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    again = bpe.encode(df.withColumnRenamed("utf8", "ids"), RANKS, public_tokenizers.PATTERN)
    assert again.columns == ["doc_id", "text", "ids"] and again.count() == 5


def test_vocabulary_and_tail_give_the_same_ids(spark, monkeypatch):
    encoding = reference_encoding()
    texts = [f"common words {k % 7} and rare{k}x{k * k} \n" + "long" * (k % 40) for k in range(300)] + [None, "", "é\u0000"]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id int, text string, N int, words string").repartition(5)
    want = {k: hashlib.sha256(",".join(map(str, encoding.encode_ordinary(t or ""))).encode()).hexdigest() for k, t in enumerate(texts)}
    monkeypatch.setattr(common, "SLICE_BYTES", 500)
    for most, longest in ((bpe.VOCABULARY, bpe.LONGEST), (3, 64), (50, 4), (0, 0)):
        monkeypatch.setattr(bpe.vocabulary, "__defaults__", (most, longest))
        rows = bpe.round_trip(df, RANKS, public_tokenizers.PATTERN).collect()
        assert {r.doc_id: r.ids_sha256 for r in rows} == want and len(rows) == len(texts)
    parts = bpe.sliced(df, public_tokenizers.PATTERN).cache()
    assert parts.count() > 3
    known = bpe.vocabulary(parts, RANKS, 20, 5).collect()
    assert 5 < len(known) <= 20 and all(len(r.word) <= 5 for r in known)
    assert len({r.word for r in known}) == len(known)
    assert bpe.round_trip(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_the_driver_has_no_object_for_each_known_word(spark):
    words = list(map("".join, product("abcdefghijklm", repeat=4)))
    df = spark.createDataFrame([(k, " ".join(words)) for k in range(4)], "doc_id int, text string")
    assert bpe.vocabulary(bpe.sliced(df, public_tokenizers.PATTERN), RANKS).count() >= len(words)
    tracemalloc.start()
    try:
        bpe.round_trip(df, RANKS, public_tokenizers.PATTERN)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 200 * len(words), peak


def test_known_words_are_unpickled_as_a_dictionary():
    known = bpe.Known(pa.table({"word": [b"ab", b" c"], "ids": [array("i", x).tobytes() for x in ((5, 70000), (9,))]}))
    assert pickle.loads(pickle.dumps(known)) == {b"ab": (array("i", (5, 70000)).tobytes(), "5,70000"), b" c": (array("i", (9,)).tobytes(), "9")}
