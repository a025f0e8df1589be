"""Byte-level BPE by speculation: propose greedily, verify pairs, merge only what fails.

A tokenizer is read from its ``tokenizer.json``.  Texts are cut at added tokens and then into words;
the distinct new words of a slice are encoded together:

1. Propose: the longest token at every place, found in a trie for all places at a time; a word's
   proposal goes from its start in steps of these.  Only tokens that merging reaches are in the trie.
2. Verify: a row of tokens is what merging makes if no two neighbours would have merged across
   their border.  Going back in time on both sides of a border, from the tokens to their last and
   first parts down to single bytes, no two parts may have had a merge that came before either was
   taken up; this is asked for all distinct pairs of neighbours at a time.
3. Words with a pair that fails are merged exactly, rank by rank, many side by side.

The walk back in time needs that a token's parts have lower ranks than the token, and that a token
has one merge; a tokenizer without that is refused, as is one with a normalizer, a prefix space, an
unknown token, dropout, or added tokens that take up white space.

Words follow the library's own Unicode tables.  Where those can differ from this process's (letters
and digits that are younger than Unicode 3.2), a text is cut by the library's cutter.

Edge cases: null and empty texts have no ids; very long texts are slices of their own and very long
words go through the same three steps; the texts of added tokens are those tokens wherever they
stand; repeated rows and rows without id are each encoded; empty tables give none; extra columns
pass through, and columns that an operator adds replace ones of the same name in whatever case.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import MEMO_WORDS, Decoder, Waves
from .common import free_name, others, slices, utf8, with_columns

#: Words of which fewer are left than this are followed one by one, not side by side.
FEW = 16
#: Bytes up to which a failing word is merged beside others.
SIDE_BY_SIDE = 128


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 characters
    for themselves, those from U+0100 on for the others in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=1)
def younger_letters() -> str:
    """The characters whose kind (letter, digit, space, other) has changed since Unicode 3.2."""
    kinds = [regex.compile(p) for p in (r"\p{L}", r"\p{N}", r"\s")]
    whole = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    now = np.zeros(0x110000, dtype=np.int8)
    for k, kind in enumerate(kinds, 1):
        for m in regex.finditer(kind.pattern + "+", whole):
            first, last = ord(whole[m.start()]), ord(whole[m.end() - 1])
            now[first : last + 1] = k
    then = np.zeros(0x110000, dtype=np.int8)
    old = unicodedata.ucd_3_2_0.category
    for c in whole:
        got = old(c)[0]
        if got == "L" or got == "N":
            then[ord(c)] = 1 if got == "L" else 2
    then[now == 3] = 3  # white space has been stable but for characters that are now none
    for c in "᠎​":
        then[ord(c)] = 3
    changed = now != then
    changed[0xD800:0xE000] = False
    return "".join(map(chr, np.flatnonzero(changed).tolist()))


class Merges:
    """Merge ranks, the trie of reachable tokens, and what a token was made of.

    Inside, a byte is its own number and the token of merge k is 256 + k; ``ids`` has the ids.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = _checked(spec)
        of = byte_alphabet()
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        number = {c: b for c, b in of.items()}
        for k, (a, b) in enumerate(merges):
            if a + b in number or a not in number or b not in number:
                raise ValueError(f"merge {k} makes a token that is there, or needs one that is not yet")
            number[a + b] = 256 + k
        size = self.size = 256 + len(merges)
        self.ids = np.zeros(size, dtype=np.int64)
        self.bytes_of: list[bytes] = [b""] * size
        for text, k in number.items():
            self.ids[k] = vocab[text]
            self.bytes_of[k] = bytes(of[c] for c in text)
        # Of what a token was made; a byte is its own part on either side.
        self.left, self.right = np.arange(size), np.arange(size)
        self.left[256:] = [number[a] for a, _ in merges]
        self.right[256:] = [number[b] for _, b in merges]
        self.born = np.maximum(np.arange(size) - 255, 0)  # 0: a byte, from 1 on in order of ranks
        keys = self.left[256:] * (size + 1) + self.right[256:]
        order = np.argsort(keys)
        self.keys, self.made = keys[order], order + 256
        self.width, self.never = size + 1, size + 1
        self.lengths = np.fromiter(map(len, self.bytes_of), dtype=np.int64, count=size)
        self._reach()
        self._plant()

    def _reach(self) -> None:
        """Tokens that merging their own bytes makes."""
        reached = np.ones(self.size, dtype=bool)
        a, b = self.left[256:], self.right[256:]
        reached[256:] = self.apart(a, b, whole=False)
        for k in range(256, self.size):  # in order, as parts come first
            if reached[k] and not (reached[self.left[k]] and reached[self.right[k]]):
                reached[k] = False
        self.reached = reached

    def _plant(self) -> None:
        nodes: dict[tuple[int, int], int] = {}
        accept = [-1]
        for k in np.flatnonzero(self.reached).tolist():
            node = 0
            for byte in self.bytes_of[k]:
                found = nodes.get((node, byte))
                if found is None:
                    found = nodes[node, byte] = len(accept)
                    accept.append(-1)
                node = found
            accept[node] = k
        edges = np.array([a * 257 + b for a, b in nodes], dtype=np.int64)
        to = np.fromiter(nodes.values(), dtype=np.int64, count=len(nodes))
        order = np.argsort(edges)
        self.edges, self.to, self.accept = edges[order], to[order], np.array(accept)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """When the two would merge (see ``born``), ``never`` where they do not."""
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at] - 255, self.never)

    def apart(self, a: np.ndarray, b: np.ndarray, whole: bool = True) -> np.ndarray:
        """Whether tokens a and b stay apart when their bytes are merged together.  ``whole`` False:
        up to the moment when both are there, so that their own merge may follow."""
        out = np.ones(len(a), dtype=bool)
        at, a, b = np.arange(len(a)), a.copy(), b.copy()
        a_taken, b_taken = np.full(len(a), self.never), np.full(len(a), self.never)
        first = True
        while len(at):
            if whole or not first:
                # Of equal ranks the merge that stands first is made first.
                merge = self.rank(a, b)
                meets = (merge < a_taken) & (merge <= b_taken)
                out[at[meets]] = False
            else:
                meets = np.zeros(len(at), dtype=bool)
            first = False
            goes_on = ~meets & ((a >= 256) | (b >= 256))
            at, a, b, a_taken, b_taken = at[goes_on], a[goes_on], b[goes_on], a_taken[goes_on], b_taken[goes_on]
            back = self.born[a] > self.born[b]  # undo what was made last; of equals the one that stands last
            a_taken, b_taken = np.where(back, self.born[a], a_taken), np.where(back, b_taken, self.born[b])
            a, b = np.where(back, self.right[a], a), np.where(back, b, self.left[b])
        return out

    def longest(self, symbols: np.ndarray) -> np.ndarray:
        """The longest token from each place of a row of bytes; 256 is in no token."""
        found = np.full(len(symbols), -1, dtype=np.int64)
        start = np.flatnonzero(symbols < 256)
        node, p = np.zeros(len(start), dtype=np.int64), start.copy()
        while len(start):
            key = node * 257 + symbols[p]
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            goes_on = self.edges[at] == key
            start, node, p = start[goes_on], self.to[at[goes_on]], p[goes_on] + 1
            token = self.accept[node]
            found[start] = np.where(token >= 0, token, found[start])
        return found


def _checked(spec: dict) -> dict[str, int]:
    """Added tokens and their ids; raises for what this encoder does not do."""
    model, cutter = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if model.get("type") != "BPE" or odd or spec.get("normalizer") or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True):
        raise ValueError("not a plain byte-level BPE tokenizer")
    if any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("an added token takes up what is beside it")
    return {t["content"]: t["id"] for t in spec["added_tokens"]}


class Exact(Waves):
    """Merges words rank by rank."""

    def __init__(self, merges: Merges):
        self.border = merges.size
        self.width = merges.size + 1
        self.keys, self.made = merges.keys, merges.made
        self.bytes_ = np.append(np.arange(256), self.border)
        self.merges = merges
        self.pairs = dict(zip(merges.keys.tolist(), merges.made.tolist()))

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Tokens (numbers of :class:`Merges`) of each word."""
        out: list[bytes | None] = [None] * len(words)
        held, size = [], 0
        for k, w in enumerate(words):
            if len(w) > SIDE_BY_SIDE or not len(self.keys):
                out[k] = np.array(self._alone(w), dtype=np.int32).tobytes()
                continue
            held.append(k)
            size += len(w)
            if size >= 1 << 18:
                self._fill(out, held, words)
                held, size = [], 0
        self._fill(out, held, words)
        return [np.frombuffer(x, dtype=np.int32) for x in out]

    def _alone(self, word: bytes) -> list[int]:
        symbols, get, width = list(word), self.pairs.get, self.width
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap = [(m, p, a, b) for p, (a, b) in enumerate(zip(symbols, symbols[1:])) if (m := get(a * width + b)) is not None]
        heapify(heap)
        while heap:
            made, p, a, b = heappop(heap)
            q = after[p]
            if symbols[p] != a or q >= len(symbols) or symbols[q] != b:
                continue
            n, m = after[q], before[p]
            symbols[p], symbols[q], after[p] = made, -1, n
            if n < len(symbols):
                before[n] = p
                if (k := get(made * width + symbols[n])) is not None:
                    heappush(heap, (k, p, made, symbols[n]))
            if m >= 0 and (k := get(symbols[m] * width + made)) is not None:
                heappush(heap, (k, m, symbols[m], made))
        return [s for s in symbols if s >= 0]


class Speculator(Decoder):
    """Encodes and decodes slices of texts; it remembers the words of the last ones."""

    def __init__(self, path: str, pattern: str, doubtful: str):
        from tokenizers import Tokenizer

        self.merges = Merges(path)
        self.exact = Exact(self.merges)
        self.cutter = Tokenizer.from_file(path).pre_tokenizer
        self.split, self.doubtful = regex.compile(pattern).findall, frozenset(doubtful)
        added = self.merges.added
        longest_first = sorted(added, key=lambda t: (-len(t), t))
        self.added = regex.compile("|".join(map(regex.escape, longest_first))) if added else None
        ids = self.merges.ids.tolist()
        super().__init__(dict(zip(ids, self.merges.bytes_of)) | {i: t.encode() for t, i in added.items()})
        # Added tokens are known by their ids, which no word can be.
        self.fixed: dict[str | int, bytes] = {i: np.uint32(i).tobytes() for i in added.values()}
        self.memo = dict(self.fixed)
        self.last: set[str] = set()
        self.proposed = self.failed = 0

    def words(self, text: str) -> list[str | int]:
        """Words of a text, and ids for added tokens."""
        if not any(t in text for t in self.merges.added):
            return self._cut(text)
        out, at = [], 0
        for m in self.added.finditer(text):
            out += self._cut(text[at : m.start()])
            out.append(self.merges.added[m.group()])
            at = m.end()
        return out + self._cut(text[at:])

    def _cut(self, text: str) -> list[str]:
        if not text.isascii() and not self.doubtful.isdisjoint(text):
            return [text[a:b] for _, (a, b) in self.cutter.pre_tokenize_str(text)]
        return self.split(text)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers."""
        pieces = [self.words(t.decode("utf-8", "replace")) for t in texts]
        words, memo = set().union(*pieces), self.memo
        if len(memo) > MEMO_WORDS:
            self.memo = memo = {w: memo[w] for w in words | self.last if w in memo} | self.fixed
        self.last = words
        new = [w for w in words if w not in memo]
        for w, tokens in zip(new, self.tokens([w.encode() for w in new])):
            memo[w] = tokens
        return [np.frombuffer(b"".join(map(memo.__getitem__, found)), dtype=np.uint32) for found in pieces]

    def tokens(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (one byte at least), unsigned and 32 bits wide."""
        if not words:
            return []
        word, token = self.proposals(words)
        inner = np.flatnonzero(word[1:] == word[:-1])
        pairs, of = np.unique(token[inner] * self.merges.width + token[inner + 1], return_inverse=True)
        good = self.merges.apart(pairs // self.merges.width, pairs % self.merges.width)
        fails = np.zeros(len(words), dtype=bool)
        fails[word[inner[~good[of]]]] = True
        self.proposed, self.failed = self.proposed + len(words), self.failed + int(fails.sum())
        data = self.merges.ids[token].astype(np.uint32).tobytes()
        ends = (4 * np.cumsum(np.bincount(word, minlength=len(words)))).tolist()
        out = [data[a:b] for a, b in zip([0, *ends], ends)]
        failing = np.flatnonzero(fails).tolist()
        for k, own in zip(failing, self.exact.merge([words[k] for k in failing])):
            out[k] = self.merges.ids[own].astype(np.uint32).tobytes()
        return out

    def proposals(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy tokens of all words in order, each with its word's place."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths + 1) - 1
        symbols = np.full(int(ends[-1]) + 1, 256, dtype=np.int64)
        inside = np.ones(len(symbols), dtype=bool)
        inside[ends] = False
        symbols[inside] = np.frombuffer(b"".join(words), dtype=np.uint8)
        longest = self.merges.longest(symbols)
        step = np.where(longest >= 0, self.merges.lengths[longest], 0)
        of, at = np.arange(len(words)), ends - lengths
        words_of, tokens = [], []
        while len(of) > FEW:
            words_of.append(of)
            tokens.append(longest[at])
            at = at + step[at]
            goes_on = at < ends[of]
            of, at = of[goes_on], at[goes_on]
        for k, p in zip(of.tolist(), at.tolist()):
            end, own = int(ends[k]), []
            while p < end:
                own.append(int(longest[p]))
                p += int(step[p])
            words_of.append(np.full(len(own), k))
            tokens.append(np.array(own, dtype=np.int64))
        word, token = np.concatenate(words_of), np.concatenate(tokens)
        order = np.argsort(word, kind="stable")
        return word[order], token[order]


@lru_cache(maxsize=2)
def _speculator(path: str, pattern: str, doubtful: str) -> Speculator:
    return Speculator(path, pattern, doubtful)


def encode(df: DataFrame, tokenizer: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the token ids of ``text`` as an array of longs.

    Parameters: the ``tokenizer.json`` (each worker reads it, so it must be installed on every
    machine) and its cutter's pattern.
    """
    raw, doubtful = free_name(df, "utf8"), younger_letters()
    kept = others(df, ids)
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(ids, T.ArrayType(T.LongType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _speculator(tokenizer, pattern, doubtful)
        for batch in slices(batches, raw):
            flat = coder.encode(batch.column(batch.schema.get_field_index(raw)).to_pylist())
            offsets = np.zeros(len(flat) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in flat], out=offsets[1:])
            yield with_columns(batch, (raw,), **{ids: pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat).astype(np.int64)))})

    return df.select(*[F.col(f"`{c}`") for c in kept], utf8(f"`{text}`").alias(raw)).mapInArrow(run, schema)


def decode(df: DataFrame, tokenizer: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the text that ``ids`` stand for (null ids: the empty text); unknown ids raise."""
    doubtful, kept = younger_letters(), others(df, decoded)
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(decoded, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _speculator(tokenizer, pattern, doubtful)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
                texts = [coder.decode(np.array(x or [], dtype=np.int64))[0].tobytes().decode("utf-8", "replace") for x in lists]
                yield with_columns(batch, (decoded,), **{decoded: pa.array(texts, pa.string())})

    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def round_trip(df: DataFrame, tokenizer: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of documents: encoded, then decoded from the ids."""
    doubtful = younger_letters()
    schema = T.StructType([df.schema["doc_id"], *T._parse_datatype_string("n_tokens long, ids_sha256 string, decoded_sha256 string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _speculator(tokenizer, pattern, doubtful)
        for batch in slices(batches, "utf8"):
            size, spelled, back = [], [], []
            for ids in coder.encode(batch.column(1).to_pylist()):
                size.append(len(ids))
                spelled.append(sha256(ids.astype("<u4").tobytes()).hexdigest())
                text = coder.decode(ids.astype(np.int64))[0].tobytes().decode("utf-8", "replace")
                back.append(sha256(text.encode()).hexdigest())
            columns = [batch.column(0), pa.array(size, pa.int64()), pa.array(spelled, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select("doc_id", utf8("text").alias("utf8")).mapInArrow(run, schema)
