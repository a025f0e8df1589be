"""Telephony audio columns: G.711 mu-law and A-law, and IMA ADPCM, in WAVE containers.

Bytes are stored without loss as 8-bit companded samples, or as the 4-bit codes of ADPCM blocks;
which of the three a value is stored as follows from its CRC-32, so equal values are stored alike.
Mu-law and A-law are expanded by lookup tables.  ADPCM is sequential within a block, so numpy
takes one step in all blocks of a slice at a time.  PCM is resampled from 8 to 16 kHz with a
four-point integer filter, and stored.  Each value is handled in one task: nothing is shuffled.

PCM is stored in a lossless form of its own (:func:`pack`): every second sample as what it departs
from the interpolation of its neighbours by, the others as codes for the values, or for the
differences, that occur.  It takes any PCM; :func:`unpack` gives every sample back.

Edge cases: null and empty texts are payloads of padding alone; repeated rows give equal values;
empty tables give none; very long texts are whole values: a text of n bytes takes up to 8 n bytes
of PCM in its task, and slices of samples beside it; extra columns pass through, and columns that
are added replace ones of the same name in whatever case; bytes that are not such a container
raise.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, others, slices, small_batches, utf8, with_columns, write_shared

UNIT = 576
RATE = 8000
#: Zstandard level of the stored media and PCM, and the bytes that are compressed at a time.
LEVEL, PAGE_BYTES = 12, 8 << 20
#: Samples that are handled at a time within a value.
PIECE = 1 << 20
CODECS = ("mulaw", "alaw", "adpcm")
#: Format tags of the container.
TAGS = {"mulaw": 7, "alaw": 6, "adpcm": 17}
# Fixed values of the IMA ADPCM format: quantiser steps and changes of their index.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    dtype=np.int32,
)
INDEX_CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exponent, mantissa = (code & 0x70) >> 4, (code & 0x0F) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = _mulaw_table(), _alaw_table()


def pad(data: bytes) -> bytes:
    """``data`` and bytes 255 up to a positive multiple of UNIT."""
    return data + b"\xff" * (UNIT - len(data) % UNIT if len(data) % UNIT or not data else 0)


def wave(payload: bytes, codec: str) -> bytes:
    """A WAVE file that holds ``payload`` (a multiple of UNIT) as codes of ``codec``."""
    if codec == "adpcm":
        blocks = np.zeros((len(payload) // UNIT, 4 + UNIT), dtype=np.uint8)  # state at 0, index 0
        blocks[:, 4:] = np.frombuffer(payload, dtype=np.uint8).reshape(-1, UNIT)
        data, per_block, samples = blocks.tobytes(), 2 * UNIT + 1, len(blocks) * (2 * UNIT + 1)
        align, bits, extra = 4 + UNIT, 4, struct.pack("<HH", 2, per_block)
    else:
        data, samples, align, bits, extra = payload, len(payload), 1, 8, struct.pack("<H", 0)
    rate = RATE * align // (per_block if codec == "adpcm" else 1)
    form = struct.pack("<HHIIHH", TAGS[codec], 1, RATE, rate, align, bits) + extra
    chunks = b"".join(k + struct.pack("<I", len(v)) + v for k, v in ((b"fmt ", form), (b"fact", struct.pack("<I", samples)), (b"data", data)))
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def unwave(media: bytes) -> tuple[str, bytes]:
    """Codec and data of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    chunks, at = {}, 12
    while at + 8 <= len(media):
        size = struct.unpack_from("<I", media, at + 4)[0]
        chunks[media[at : at + 4]] = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    tag = struct.unpack_from("<H", chunks[b"fmt "])[0]
    return next(c for c, t in TAGS.items() if t == tag), chunks[b"data"]


def payload_of(codec: str, data: bytes) -> bytes:
    """The codes that the data of a file hold."""
    return np.frombuffer(data, dtype=np.uint8).reshape(-1, 4 + UNIT)[:, 4:].tobytes() if codec == "adpcm" else data


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM (blocks, samples) of IMA ADPCM blocks (blocks, bytes), all blocks a step at a time."""
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((2 * len(codes) + 1, len(blocks)), dtype=np.int16)
    out[0] = value = head
    for k in range(2 * len(codes)):
        code = (codes[k // 2] >> (4 * (k % 2)) & 15).astype(np.int32)
        step = STEPS[index]
        change = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGES[code & 7], 0, 88)
        out[k + 1] = value
    return out.T


def _between(pcm: np.ndarray) -> np.ndarray:
    """After each sample its interpolation: weights -1, 9, 9, -1 (of 16) of the nearest four."""
    out = np.empty(len(pcm), dtype=np.int16)
    for at in range(0, len(pcm), PIECE):
        end = min(at + PIECE, len(pcm))
        near = np.clip(np.arange(at - 1, end + 2), 0, len(pcm) - 1)
        x = pcm[near].astype(np.int32)
        out[at:end] = np.clip(9 * (x[1:-2] + x[2:-1]) - x[:-3] - x[3:] + 8 >> 4, -32768, 32767)
    return out


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: the samples, and between them what they are interpolated to."""
    out = np.empty(2 * len(pcm), dtype=np.int16)
    out[::2], out[1::2] = pcm, _between(pcm)
    return out


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their counts."""
    if len(x) < 1 << 14:
        return np.unique(x, return_counts=True)
    counts = np.bincount(x.view(np.uint16), minlength=1 << 16)
    values = np.flatnonzero(counts)
    return values.astype(np.uint16).view(np.int16), counts[values]


def _places(values: np.ndarray) -> np.ndarray:
    """For up to 255 sorted values a code each, by a hash: in files that share most of their values
    most codes are the same, so that a compressor finds one file's runs in the next."""
    out, taken = [], [False] * 255
    for h in ((values.astype(np.uint16) * np.uint32(40503) >> np.uint32(7)) % 255).tolist():
        while taken[h]:
            h = (h + 1) % 255
        taken[h] = True
        out.append(h)
    return np.array(out, dtype=np.uint8)


def pack(pcm: np.ndarray) -> bytes:
    """PCM of an even number of samples without loss.

    Head: samples, whether they are differences, whether departures follow, sizes of the palette
    and of the escapes.  Then the palette in order, a code for each even sample (255: the next
    escape), the escapes, and what odd samples depart from the interpolation by, if any does.
    """
    even = np.ascontiguousarray(pcm[::2])
    departs = pcm[1::2] - _between(even)
    steps = np.diff(even, prepend=np.int16(0))
    (values, counts), (other, other_counts) = _counted(even), _counted(steps)
    stepped = len(values) > 255 and len(other) < len(values)
    if stepped:
        even, values, counts = steps, other, other_counts
    palette = np.sort(values[np.lexsort((values, -counts))][:255])
    place = np.minimum(np.searchsorted(palette, even), len(palette) - 1)
    odd = palette[place] != even
    codes = np.where(odd, np.uint8(255), _places(palette)[place])
    escapes = even[odd]
    head = struct.pack("<IBBHI", len(even), stepped, bool(departs.any()), len(palette), len(escapes))
    parts = (palette, codes, escapes, *([departs] if departs.any() else []))
    return head + b"".join(x.astype(x.dtype.newbyteorder("<")).tobytes() for x in parts)


def unpack(data: bytes) -> np.ndarray:
    """The PCM that :func:`pack` was given."""
    n, stepped, departed, colours, escaped = struct.unpack_from("<IBBHI", data)
    palette = np.frombuffer(data, "<i2", colours, 12)
    codes = np.frombuffer(data, np.uint8, n, 12 + 2 * colours)
    value = np.zeros(256, dtype=np.int16)
    value[_places(palette)] = palette
    even = value[codes]
    even[codes == 255] = np.frombuffer(data, "<i2", escaped, 12 + 2 * colours + n)
    if stepped:
        even = np.cumsum(even, dtype=np.int16)
    out = resample(even)
    if departed:
        out[1::2] += np.frombuffer(data, "<i2", n, 12 + 2 * colours + n + 2 * escaped)
    return out


def decode_all(media: list[bytes]) -> list[tuple[str, bytes, np.ndarray]]:
    """Codec, payload and PCM of each file; the ADPCM blocks of all of them go together."""
    parsed = [unwave(m) for m in media]
    blocks = [np.frombuffer(d, dtype=np.uint8).reshape(-1, 4 + UNIT) for c, d in parsed if c == "adpcm"]
    pcm = decode_adpcm(np.concatenate(blocks)) if blocks else None
    out, at = [], 0
    for codec, data in parsed:
        if codec == "adpcm":
            n = len(data) // (4 + UNIT)
            samples, at = pcm[at : at + n].ravel(), at + n
        else:
            samples = (MULAW if codec == "mulaw" else ALAW)[np.frombuffer(data, dtype=np.uint8)]
        out.append((codec, payload_of(codec, data), samples))
    return out


def _mapped(df: DataFrame, kept: list[str], raw: str, fields: list[T.StructField], make) -> DataFrame:
    schema = T.StructType([df.schema[c] for c in kept] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, raw):
            rows = make(batch.column(batch.schema.get_field_index(raw)).to_pylist())
            arrays = {f.name: pa.array(v, pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for f, v in zip(fields, zip(*rows))}
            yield with_columns(batch, (raw,), **arrays)

    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{raw}`")).mapInArrow(run, schema)


def stored(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without ``text``, with n_bytes and ``media``, the WAVE file of the padded text."""
    raw = free_name(df, "utf8")
    kept = others(df, text, "n_bytes", "media")

    def make(values: list[bytes]) -> list[tuple]:
        payloads = [pad(v) for v in values]
        return [(len(v), wave(p, CODECS[zlib.crc32(p) % len(CODECS)])) for v, p in zip(values, payloads)]

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]
    return _mapped(df.withColumn(raw, utf8(f"`{text}`")), kept, raw, fields, make)


def resampled(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with codec and ``pcm``, little-endian 16-bit samples at 16 kHz."""
    kept = others(df, media, "codec", "pcm")
    make = lambda values: [(c, resample(x).astype("<i2").tobytes()) for c, _, x in decode_all(values)]
    return _mapped(df, kept, media, [T.StructField("codec", T.StringType()), T.StructField("pcm", T.BinaryType())], make)


def _digests(media: bytes, payload: bytes) -> tuple:
    return len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), sha256(media).hexdigest()


def _feature(codec: str, x: np.ndarray, pcm: np.ndarray) -> str:
    square = peak = changes = 0
    for at in range(0, len(x), PIECE):
        part = x[at : at + PIECE].astype(np.int64)
        square, peak = square + int(np.dot(part, part)), max(peak, int(np.abs(part).max()))
        below = x[max(0, at - 1) : at + PIECE] < 0
        changes += int(np.count_nonzero(below[1:] != below[:-1]))
    return f"{codec}:{len(x)}:{square // len(x)}:{peak}:{changes}:{zlib.crc32(pcm.astype('<i2', copy=False).data):08x}"


DIGESTS = [T.StructField(n, t) for n, t in (("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()))]


def measured(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with what the stored files hold: digests, and features of the samples.

    ``feature`` is codec, samples, mean square, peak, sign changes, and the CRC-32 of the
    resampled PCM, joined by colons.
    """
    kept = others(df, media, "feature", *(f.name for f in DIGESTS))
    make = lambda values: [(*_digests(m, p), _feature(c, x, resample(x))) for m, (c, p, x) in zip(values, decode_all(values))]
    return _mapped(df, kept, media, [*DIGESTS, T.StructField("feature", T.StringType())], make)


def digested(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with what the stored files hold: digests, codec, and ``pcm``, resampled and packed."""
    kept = others(df, media, "codec", "pcm", *(f.name for f in DIGESTS))
    make = lambda values: [(*_digests(m, p), c, pack(resample(x))) for m, (c, p, x) in zip(values, decode_all(values))]
    return _mapped(df, kept, media, [*DIGESTS, T.StructField("codec", T.StringType()), T.StructField("pcm", T.BinaryType())], make)


def unpacked(df: DataFrame, pcm: str = "pcm") -> DataFrame:
    """``df`` with packed PCM as little-endian 16-bit samples at 16 kHz."""
    kept = others(df, pcm)
    return _mapped(df, kept, pcm, [T.StructField(pcm, T.BinaryType())], lambda values: [(unpack(v).astype("<i2").tobytes(),) for v in values])


def heard(df: DataFrame, pcm: str = "pcm") -> DataFrame:
    """``df`` (with codec) with the ``feature`` of :func:`measured` of its packed PCM instead of both."""
    kept = others(df, pcm, "feature")

    def make(values: list[bytes]) -> list[tuple]:
        return [(_feature("", x[::2], x),) for x in map(unpack, values)]  # even samples: those before resampling

    rows = _mapped(df, kept, pcm, [T.StructField("feature", T.StringType())], make)
    return rows.withColumn("feature", F.concat("codec", "feature")).drop("codec")


def described(docs: DataFrame) -> DataFrame:
    """Documents' texts stored as media in the shared folder, read back, resampled to PCM that is
    stored there too, and measured as both are read back.

    What is measured is stored as well, so that all three passes run here, in batches of a few MB.
    """
    with small_batches(docs.sparkSession):
        media = write_shared(stored(docs.select("doc_id", "text")), "media", LEVEL, PAGE_BYTES)
        pcm = write_shared(digested(media), "pcm", LEVEL, PAGE_BYTES)
        return write_shared(heard(pcm), "features", LEVEL, PAGE_BYTES)


#: What is told of the payload in DuckDB SQL, which has no CRC-32 and no media.
PAYLOAD_SQL = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
p AS (SELECT doc_id, octet_length(raw) AS n, CASE WHEN octet_length(raw) = 0 THEN repeat('\\xFF'::BLOB, {UNIT}) ELSE raw || repeat('\\xFF'::BLOB, ({UNIT} - octet_length(raw) % {UNIT}) % {UNIT}) END AS payload FROM d)
SELECT doc_id, n AS n_bytes, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_sha256 FROM p"""
