"""Byte-level BPE encoding and decoding by corpus-level merge replay.

1. Texts are cut into pre-tokens once.  Each slice of the corpus becomes a row: its distinct words,
   and for every document the places of its words in that list.
2. The distinct words of the corpus are counted by how many slices have them; those that most
   slices have, VOCABULARY at most, are replayed once, dealt to tasks by hash.
3. Replaying: the words of a task form one flat sequence of byte symbols; an inverted index lists
   for every adjacent pair that has a rank the positions where it stands.  Merges are applied in
   rank order, each at all its positions at once, and only the neighbours of a merged position are
   looked up again.
4. The replayed vocabulary, whose size is bounded, goes to all tasks.  The tail of words that are
   rare or longer than LONGEST is merged where it stands: short words in waves, in each of which
   every word has its merge of the lowest rank, as words do not touch; long ones by replay.
   Documents' ids are put together by places.  Ids are the same whichever way a word took.

Edge cases: null and empty texts have no ids; very long texts are slices of their own, and a very
long word is replayed whole; invalid ids in decoding raise; repeated rows and ties of counts change
nothing; empty tables give none; extra columns pass through, and columns that an operator adds
replace ones of the same name in whatever case.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, others, slices, utf8, with_columns, write_shared

#: Entries of a worker's memo; beyond it, only words of the last slices stay, which costs time
#: and changes nothing.
MEMO_WORDS = 300_000
#: Words that are replayed once for the whole corpus and sent to all tasks, and their longest, in
#: bytes; together they bound what is sent.
VOCABULARY, LONGEST = 200_000, 64
#: Bytes up to which a word of the tail is merged in waves, and bytes that are at a time.
WAVE_WORD, WAVE_BYTES = 128, 1 << 18


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 token and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Replayer:
    """Encodes pre-tokens by replaying the merges of ``ranks`` over many of them together."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        # What stands between words: no token holds it, so no pair with it has a rank.
        self.border = b"\xff"
        while any(self.border in token for token in ranks):
            self.border += b"\xff"
        self.byte_or_border = [*(bytes([b]) for b in range(256)), self.border]
        self.first = np.full((257, 257), -1, dtype=np.int64)
        for a in range(256):
            for b in range(256):
                self.first[a, b] = ranks.get(bytes([a, b]), -1)

    def replay(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each word.  A word that is a token as a whole is that token."""
        whole = [self.ranks.get(w) for w in words]
        open_words = [w for w, got in zip(words, whole) if got is None and w]
        merged = iter(self._replay(open_words)) if open_words else iter(())
        return [(got,) if got is not None else (next(merged) if w else ()) for w, got in zip(words, whole)]

    def _replay(self, words: list[bytes]) -> Iterator[tuple[int, ...]]:
        # One sequence: a border symbol (256) before, between and after the words.
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw = np.full(int(lengths.sum()) + len(words) + 1, 256, dtype=np.int64)
        starts = np.cumsum(lengths + 1) - lengths
        inside = np.ones(len(raw), dtype=bool)
        inside[0] = False
        inside[starts + lengths] = False
        raw[inside] = np.frombuffer(b"".join(words), dtype=np.uint8)
        ranks = np.append(self.first[raw[:-1], raw[1:]], -1)
        symbol = list(map(self.byte_or_border.__getitem__, raw.tolist()))
        at = np.flatnonzero(ranks >= 0)
        at = at[np.argsort(ranks[at], kind="stable")]
        found, begin = np.unique(ranks[at], return_index=True)
        index = {r: p.tolist() for r, p in zip(found.tolist(), np.split(at, begin[1:]))}
        heap, pair_rank = list(index), ranks.tolist()
        heapify(heap)
        after, before = list(range(1, len(raw) + 1)), list(range(-1, len(raw) - 1))
        rank_of, bytes_of = self.ranks.get, self.bytes_of
        while heap:
            rank = heappop(heap)
            positions = index.pop(rank, None)
            if positions is None:
                continue
            positions.sort()
            token = bytes_of[rank]
            for k, p in enumerate(positions):
                if pair_rank[p] != rank:
                    continue  # a neighbour has been merged since
                q = after[p]
                n = after[q]
                m = before[p]
                symbol[p], after[p], before[n], pair_rank[q] = token, n, p, -1
                right, left = rank_of(token + symbol[n], -1), rank_of(symbol[m] + token, -1)
                pair_rank[p], pair_rank[m] = right, left
                if right >= 0:
                    if right in index:
                        index[right].append(p)
                    else:
                        index[right] = [p]
                        heappush(heap, right)
                if left >= 0:
                    if left in index:
                        index[left].append(m)
                    else:
                        index[left] = [m]
                        heappush(heap, left)
                if 0 <= right < rank or 0 <= left < rank:  # that comes before what is left here
                    index[rank] = positions[k + 1 :]
                    heappush(heap, rank)
                    break
        for p in starts.tolist():
            ids = []
            while symbol[p] is not self.border:
                ids.append(self.ranks[symbol[p]])
                p = after[p]
            yield tuple(ids)


class Waves:
    """Encodes many short words side by side, a merge in each of them at a time."""

    def __init__(self, replayer: Replayer):
        self.replayer, ranks = replayer, replayer.ranks
        self.border = max(replayer.bytes_of) + 1
        self.width = self.border + 1
        # Every pair of tokens that together are one, as a number, with the rank of what they make.
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = rank
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.bytes_ = np.array([*(ranks[bytes([b])] for b in range(256)), self.border], dtype=np.int64)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as 32-bit integers."""
        out: list[bytes | None] = [None] * len(words)
        short, size, long = [], 0, []
        for k, w in enumerate(words):
            whole = self.replayer.ranks.get(w)
            if whole is not None:
                out[k] = array("i", (whole,)).tobytes()
            elif len(w) > WAVE_WORD:
                long.append(k)
            else:
                short.append(k)
                size += len(w)
                if size >= WAVE_BYTES:
                    self._fill(out, short, words)
                    short, size = [], 0
        self._fill(out, short, words)
        for k, ids in zip(long, self.replayer.replay([words[k] for k in long])):
            out[k] = array("i", ids).tobytes()
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], self.border)

    def _fill(self, out: list, chosen: list[int], words: list[bytes]) -> None:
        if not chosen or not len(self.keys):
            for k in chosen:
                out[k] = array("i", (self.replayer.ranks[bytes([b])] for b in words[k])).tobytes()
            return
        # A border symbol before, between and after the words.
        lengths = np.fromiter((len(words[k]) for k in chosen), dtype=np.int64, count=len(chosen))
        ends = np.cumsum(lengths + 1)
        symbol = np.full(int(ends[-1]) + 1, self.border, dtype=np.int64)
        inside = np.ones(len(symbol), dtype=bool)
        inside[0] = inside[ends] = False
        symbol[inside] = self.bytes_[np.frombuffer(b"".join(words[k] for k in chosen), dtype=np.uint8)]
        after, before = np.arange(1, len(symbol) + 1), np.arange(-1, len(symbol) - 1)
        rank = np.append(self._ranks(symbol[:-1], symbol[1:]), self.border)
        word = np.repeat(np.arange(len(chosen)), lengths)
        live = np.flatnonzero(inside)  # where a symbol starts, in words that may still change
        while len(live):
            # The first of the lowest ranks of each word.
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank[live] << 32 | live, first)
            lowest, p = best >> 32, best & 0xFFFFFFFF
            goes_on = lowest < self.border
            lowest, p = lowest[goes_on], p[goes_on]
            if not len(p):
                break
            q, m = after[p], before[p]
            n = after[q]
            symbol[p], symbol[q], after[p], before[n] = lowest, -1, n, p
            rank[p], rank[q] = self._ranks(lowest, symbol[n]), self.border
            rank[m] = self._ranks(symbol[m], lowest)
            stays = np.repeat(goes_on, np.diff(np.append(first, len(live)))) & (symbol[live] >= 0)
            live, word = live[stays], word[stays]
        kept = (symbol >= 0) & inside
        counts = np.add.reduceat(kept.astype(np.int64), ends - lengths)
        data, at = symbol[kept].astype(np.int32).tobytes(), 0
        for k, c in zip(chosen, (4 * counts).tolist()):
            out[k], at = data[at : at + c], at + c


class Decoder:
    """Bytes of token ids."""

    def __init__(self, tokens: dict[int, bytes]):
        size = max(tokens) + 1
        self.length = np.full(size, -1, dtype=np.int64)
        self.length[list(tokens)] = list(map(len, tokens.values()))
        self.start = np.concatenate([[0], np.cumsum(np.maximum(self.length, 0))])[:-1]
        self.blob = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ids in a row, and where those of each id end."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.length) or (self.length[ids] < 0).any()):
            raise ValueError("an id is not in the vocabulary")
        n = self.length[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        narrow = np.int32 if total < 1 << 31 else np.int64
        at = np.repeat((self.start[ids] - (ends - n)).astype(narrow), n)
        at += np.arange(total, dtype=narrow)
        return self.blob[at], ends

class Codec(Decoder):
    """Encoding and decoding of slices of texts; it remembers the words of the last ones."""

    def __init__(self, path: str):
        self.replayer = Replayer(load_ranks(path))
        self.waves = Waves(self.replayer)
        self.memo: dict[str, bytes] = {}  # ids as 32-bit integers
        self.last: set[str] = set()
        super().__init__(self.replayer.bytes_of)

    def encode(self, texts: list[bytes], pattern: str) -> list[np.ndarray]:
        """Ids of each text."""
        split, memo = regex.compile(pattern).findall, self.memo
        pieces = [split(t.decode("utf-8", "replace")) for t in texts]
        words = set().union(*pieces)
        if len(memo) > MEMO_WORDS:
            self.memo = memo = {w: memo[w] for w in words | self.last if w in memo}
        self.last = words
        new = [w for w in words if w not in memo]
        for w, own in zip(new, self.replayer.replay([w.encode() for w in new])):
            memo[w] = array("i", own).tobytes()
        return [np.frombuffer(b"".join(map(memo.__getitem__, found)), dtype=np.int32) for found in pieces]


@lru_cache(maxsize=2)
def _codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the token ids of ``text`` as an array of integers; special tokens do not exist.

    Parameters: the rank file (each worker reads it, so it must be installed on every machine) and
    the pattern whose matches are encoded one by one.
    """
    raw = free_name(df, "utf8")
    kept = others(df, ids)
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, raw):
            flat = _codec(ranks_path).encode(batch.column(batch.schema.get_field_index(raw)).to_pylist(), pattern)
            offsets = np.zeros(len(flat) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in flat], out=offsets[1:])
            yield with_columns(batch, (raw,), **{ids: pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat)))})

    return df.select(*[F.col(f"`{c}`") for c in kept], utf8(f"`{text}`").alias(raw)).mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the bytes that ``ids`` stand for (null ids: no bytes); unknown ids raise."""
    kept = others(df, decoded)
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(decoded, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                lists = batch.column(batch.schema.get_field_index(ids))
                counts = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                data, ends = _codec(ranks_path).decode(lists.flatten().to_numpy(zero_copy_only=False))
                last = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
                out = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(last.astype(np.int64)), pa.py_buffer(data)])
                yield with_columns(batch, (decoded,), **{decoded: out.cast(pa.binary())})

    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def sliced(df: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """A row for each slice of the corpus: doc_id and number of pre-tokens of its documents, the
    distinct words among them, and every pre-token's place in that list (16 bits where they do)."""
    schema = T.StructType([T.StructField("doc_id", T.ArrayType(df.schema["doc_id"].dataType)), *T._parse_datatype_string("n array<int>, words array<binary>, places binary")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern).findall
        for batch in slices(batches, "utf8"):
            found = [split(t.decode("utf-8", "replace")) for t in batch.column(1).to_pylist()]
            n = [len(x) for x in found]
            places, words = pd.factorize(np.fromiter(chain.from_iterable(found), dtype=object, count=sum(n)))
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
            columns = [ids, pa.array([n], pa.list_(pa.int32())), pa.array([[w.encode() for w in words]], pa.list_(pa.binary())), pa.array([_narrow(places, len(words)).tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "words", "places"])

    return df.select("doc_id", utf8(f"`{text}`").alias("utf8")).mapInArrow(run, schema)


def _narrow(places: np.ndarray, words: int) -> np.ndarray:
    return places.astype(np.uint16 if words <= 1 << 16 else np.int32)


def replayed(words: DataFrame, ranks_path: str) -> DataFrame:
    """word and ids (32-bit integers) of rows with distinct words, each replayed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = _codec(ranks_path).replayer.replay
        for batch in slices(batches, "word"):
            ids = [array("i", x).tobytes() for x in replay(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["word", "ids"])

    return words.select("word").repartition("word").mapInArrow(run, "word binary, ids binary")


def vocabulary(parts: DataFrame, ranks_path: str, most: int = VOCABULARY, longest: int = LONGEST) -> DataFrame:
    """The words that most slices have (two at least), replayed: ``most`` of them at most, as all
    words with the same count, or above 64 with one in the same sixteenth of a power of two, are
    taken or left together."""
    words = parts.select(F.explode("words").alias("word")).where(F.octet_length("word") <= longest)
    often = words.groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    level = F.when(F.col("n") <= 64, F.col("n")).otherwise(F.floor(16 * F.log2("n")) - 32).cast("int")
    often = write_shared(often.withColumn("level", level), "words")
    sizes = often.groupBy("level").agg(F.count("*").alias("n")).collect()  # some thousand levels at most
    total, least = 0, 1 << 30
    for level, n in sorted(sizes, reverse=True):
        total += n
        if total > most:
            break
        least = level
    return replayed(often.where(F.col("level") >= least), ranks_path)


def _told(ids: bytes) -> tuple[bytes, str]:
    """A word's ids (32-bit integers), and the same in figures."""
    return bytes(ids), ",".join(map(str, array("i", bytes(ids))))


def _looked_up(words: pa.Table) -> dict[bytes, tuple[bytes, str]]:
    return {w: _told(ids) for w, ids in zip(words["word"].to_pylist(), words["ids"].to_pylist())}


class Known:
    """Words and ids in Arrow columns, which are pickled as they are and unpickled as a dictionary.

    So only workers hold an object for each word; the driver holds the bytes.
    """

    def __init__(self, words: pa.Table):
        self.words = words

    def __reduce__(self):
        return _looked_up, (self.words,)


def round_trip(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of documents: encoded, then decoded from the ids.

    Both ways and the digests in one pass, so that ids need not leave the worker.
    """
    parts = write_shared(sliced(df, pattern), "pieces")
    known = vocabulary(parts, ranks_path)
    shared = df.sparkSession.sparkContext.broadcast(Known(known.toArrow()))  # VOCABULARY words at most
    schema = T.StructType([df.schema["doc_id"], *T._parse_datatype_string("n_tokens long, ids_sha256 string, decoded_sha256 string")])
    names = schema.names

    def ids_of(words: list[bytes]) -> list[tuple[bytes, str]]:
        ready = shared.value
        found = [ready.get(w) for w in words]
        rare = iter(_codec(ranks_path).waves.merge([w for w, got in zip(words, found) if got is None]))
        return [_told(next(rare)) if got is None else got for got in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_path)
        for batch in batches:
            for k in range(batch.num_rows):
                docs, counts, words, places = (c[k] for c in batch.columns)
                words = words.as_py()
                places = np.frombuffer(places.as_buffer(), dtype=np.uint16 if len(words) <= 1 << 16 else np.int32)
                own, told = zip(*ids_of(words)) if words else ((), ())
                size, spelled, back, start = [], [], [], 0
                for n in counts.as_py():
                    at = places[start : start + n].tolist()
                    start += n
                    ids = np.frombuffer(b"".join(map(own.__getitem__, at)), dtype=np.int32)
                    size.append(len(ids))
                    spelled.append(sha256(",".join(map(told.__getitem__, at)).encode()).hexdigest())
                    back.append(sha256(codec.decode(ids)[0].data).hexdigest())
                yield pa.RecordBatch.from_arrays([docs.values, pa.array(size, pa.int64()), pa.array(spelled, pa.string()), pa.array(back, pa.string())], names=names)

    return parts.mapInArrow(run, schema)
