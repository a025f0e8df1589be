import hashlib
import random
import sys

import numpy as np
import public_tokenizers
import pytest
from sigla.llm import speculative
from sigla.llm.queries import TOKENIZER, op11_speculative_bpe
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "\n\n  x", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext|", "don't we'll", "١٢٣ x²", "é" * 300, "a" * 3000, "ab" * 2000, "՘ა꟔ new letters \U00031350", "é​᠎\x1c\x85 z", "🤷🏽‍♀️ ok", "\x00\x01", "漢字かな交じり文" * 40]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


@pytest.fixture(scope="module")
def coder():
    return speculative.Speculator(TOKENIZER, public_tokenizers.PATTERN, speculative.younger_letters())


def expected(library, texts):
    out = []
    for x in library.encode_batch(texts, add_special_tokens=False):
        text = library.decode(x.ids, skip_special_tokens=False)
        out.append((len(x.ids), hashlib.sha256(np.array(x.ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return out


def test_query_equals_the_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in op11_speculative_bpe(spark, SF).collect()}
    assert got == dict(zip([r.doc_id for r in docs], expected(library, [r.text or "" for r in docs])))


def test_odd_texts(spark, library):
    rows = [(k, t) for k, t in enumerate([*ODD, "x y"])] + [(None, "twice"), (None, "twice"), (99, None)]
    df = speculative.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER, public_tokenizers.PATTERN)
    want = sorted(expected(library, [t or "" for _, t in rows]))
    assert sorted(tuple(r)[1:] for r in df.collect()) == want
    assert speculative.round_trip(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER, public_tokenizers.PATTERN).count() == 0


def test_encode_and_decode_keep_columns(spark, library):
    rows = [(k, t, "kept", "old") for k, t in enumerate(ODD)] + [(98, None, "kept", "old")]
    df = spark.createDataFrame(rows, "doc_id long, text string, utf8 string, IDS string")
    coded = speculative.encode(df, TOKENIZER, public_tokenizers.PATTERN)
    back = speculative.decode(coded, TOKENIZER, public_tokenizers.PATTERN).collect()
    assert coded.columns == ["doc_id", "text", "utf8", "ids"]
    for r in back:
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "") and r.utf8 == "kept"


def test_words_are_cut_as_the_library_cuts_them(coder, library):
    letters = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    doubt = set(speculative.younger_letters())
    for at in range(0, len(letters), 40_000):
        clear = [c for c in letters[at : at + 40_000] if c not in doubt]
        text = "".join(f"a{c}1 {c} ." for c in clear)
        assert coder._cut(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_pairs_stay_apart_as_merging_says(coder):
    merges, rng = coder.merges, np.random.default_rng(2)
    reached = np.flatnonzero(merges.reached)
    a, b = rng.choice(reached, 6000), rng.choice(reached, 6000)
    # Neighbours that merging makes, and cuts of tokens, are likelier to be near a border's edge.
    whole = rng.choice(reached[reached >= 256], 3000)
    a = np.concatenate([a, merges.left[whole], merges.right[whole]])
    b = np.concatenate([b, merges.right[whole], merges.left[whole]])
    for x, y, apart in zip(a.tolist(), b.tolist(), merges.apart(a, b).tolist()):
        assert apart == (coder.exact._alone(merges.bytes_of[x] + merges.bytes_of[y]) == [x, y])


def test_failing_words_are_merged_exactly(coder, library):
    rng = random.Random(6)
    words = ["".join(rng.choice("aeinrstüß ") for _ in range(rng.randrange(1, 200))).strip() or "x" for _ in range(3000)]
    words = [w for t in words for w in coder._cut(t)]
    before = coder.failed
    got = coder.tokens([w.encode() for w in words])
    assert coder.failed > before
    for w, ids in zip(words, got):
        assert np.frombuffer(ids, dtype=np.uint32).tolist() == library.encode(w, add_special_tokens=False).ids


def test_other_tokenizers_are_refused(tmp_path):
    with pytest.raises(ValueError):
        speculative.Merges(public_tokenizers.path("word_bpe_49k.json"))
