import zlib
from hashlib import sha256

import numpy as np
from pyspark.sql import functions as F
from sigla.llm import audio, common
from sigla.llm.queries import op2_telephony_audio

SF = "/root/testdata/sf0.001"


def expand_mulaw(code):
    code = ~code & 0xFF
    size = (((code & 15) * 2 + 33) << (code >> 4 & 7)) - 33
    return (-size if code & 0x80 else size) * 4


def expand_alaw(code):
    code ^= 0x55
    exponent, mantissa = code >> 4 & 7, code & 15
    size = mantissa * 2 + 1 if not exponent else (mantissa * 2 + 33) << (exponent - 1)
    return (size if code & 0x80 else -size) * 8


def decode_block(block):
    """IMA ADPCM, one code after another."""
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            change = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                change += part if code & bit else 0
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
            out.append(value)
    return out


def test_tables_and_blocks():
    assert audio.MULAW.tolist() == [expand_mulaw(c) for c in range(256)]
    assert audio.ALAW.tolist() == [expand_alaw(c) for c in range(256)]
    assert len(audio.STEPS) == 89 and audio.MULAW[0] == -32124 and audio.ALAW[0x2A] == -32256
    blocks = np.random.default_rng(2).integers(0, 256, (7, 4 + audio.UNIT), dtype=np.uint8)
    assert audio.decode_adpcm(blocks).tolist() == [decode_block(b.tobytes()) for b in blocks]


def test_resampling():
    x = (8000 * np.sin(np.arange(400) / 20)).astype(np.int16)
    y = audio.resample(x)
    assert len(y) == 800 and (y[::2] == x).all()
    assert np.abs(y[101:-101] - 8000 * np.sin(np.arange(800) / 40)[101:-101]).max() < 4


def test_query_round_trip_and_features(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op2_telephony_audio(spark, SF).collect()
    assert len(rows) == len(texts) and {r.feature.split(":")[0] for r in rows} == set(audio.CODECS)
    for r in rows:
        data = texts[r.doc_id].encode()
        payload = audio.pad(data)
        assert len(payload) % 576 == 0 and payload.startswith(data) and set(payload[len(data) :]) <= {255}
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        codec = r.feature.split(":")[0]
        media = audio.wave(payload, codec)
        assert (r.media_bytes, r.media_sha256) == (len(media), sha256(media).hexdigest())
        if codec == "adpcm":
            pcm = [x for k in range(0, len(payload), 576) for x in decode_block(bytes(4) + payload[k : k + 576])]
        else:
            pcm = [(expand_mulaw if codec == "mulaw" else expand_alaw)(b) for b in payload]
        square, changes = sum(x * x for x in pcm) // len(pcm), sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:]))
        again = zlib.crc32(audio.resample(np.array(pcm, dtype=np.int16)).tobytes())
        assert r.feature == f"{codec}:{len(pcm)}:{square}:{max(map(abs, pcm))}:{changes}:{again:08x}"


def test_nulls_empty_long_repeated_and_clashing_columns(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "x" * 576, 5), (3, "é" * 400_000, 5), (3, "é" * 400_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media int")
    out = audio.measured(audio.stored(df)).collect()
    assert sorted((r.n_bytes, r.payload_bytes) for r in out) == [(0, 576), (0, 576), (576, 576), (800_000, 800_064), (800_000, 800_064)]
    assert len({r[2:] for r in out}) == 3
    assert audio.measured(audio.stored(df.limit(0))).count() == 0
    pcm = audio.resampled(audio.stored(df)).collect()
    assert all(len(r.pcm) == 4 * int(o.feature.split(":")[1]) for r, o in zip(pcm, out))


def test_query_stores_the_pcm_and_measures_what_is_read_back(spark, monkeypatch):
    tables = {}

    def kept(df, name, *options):
        tables[name] = common.write_shared(df, name, *options)
        return tables[name]

    monkeypatch.setattr(audio, "write_shared", kept)
    crcs = {r.doc_id: r.feature.rpartition(":")[2] for r in op2_telephony_audio(spark, SF).collect()}
    pcm = {r.doc_id: bytes(r.pcm) for r in audio.unpacked(tables["pcm"]).collect()}
    want = {r.doc_id: bytes(r.pcm) for r in audio.resampled(tables["media"]).collect()}
    assert pcm == want and crcs == {i: f"{zlib.crc32(x):08x}" for i, x in pcm.items()}
    silent = tables["pcm"].withColumn("pcm", F.lit(bytearray(audio.pack(np.zeros(4, dtype=np.int16)))))
    assert {r.feature.split(":", 1)[1] for r in audio.heard(silent).collect()} == {f"2:0:0:0:{zlib.crc32(bytes(8)):08x}"}


def test_packed_pcm_is_lossless():
    rng = np.random.default_rng(5)
    noise = rng.integers(-32768, 32768, 70_000).astype(np.int16)
    walk = np.cumsum(rng.integers(-3, 4, 60_000)).astype(np.int16)
    for pcm in (noise, audio.resample(walk), np.repeat(walk, 2), np.zeros(2, np.int16), noise[:0], audio.resample(noise[:3])):
        assert (audio.unpack(audio.pack(pcm)) == pcm).all()
    assert len(audio.pack(audio.resample(walk))) < 0.3 * 2 * 2 * len(walk)


def test_clashing_names_in_any_case(spark):
    df = spark.createDataFrame([(1, "a", "x", 2, 3.0)], "doc_id long, text string, MEDIA string, Utf8 int, N_bytes double")
    got = audio.heard(audio.digested(audio.stored(df)))
    assert {"Utf8", "feature", "n_bytes"} <= set(got.columns) and not {"MEDIA", "N_bytes"} & set(got.columns)
    assert got.first().Utf8 == 2


def test_pieces_of_long_values_join(monkeypatch):
    x = np.random.default_rng(1).integers(-32768, 32768, 5000).astype(np.int16)
    whole = audio.resample(x), audio._feature("c", x, x)
    monkeypatch.setattr(audio, "PIECE", 7)
    assert (audio.resample(x) == whole[0]).all() and audio._feature("c", x, x) == whole[1]


def test_python_gets_small_batches_whatever_the_size_of_a_partition(spark, monkeypatch):
    def counted(batches, column):
        def seen():
            for batch in batches:
                assert batch.nbytes < 2 * common.SLICE_BYTES, batch.nbytes
                yield batch

        return common.slices(seen(), column)

    monkeypatch.setattr(audio, "slices", counted)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.md5(F.col("id").cast("string")), 100).alias("text"))
    got = audio.described(docs)
    assert spark.conf.get(key) == before
    monkeypatch.undo()
    want = audio.measured(audio.stored(docs)).select(*got.columns)
    assert got.count() == 2000 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
