"""Near-duplicate documents by HyperMinHash.

A document is its set of distinct five-word shingles.  Each bucket of a sketch keeps, of the
smallest hash value in it, the count of leading zeros and the mantissa bits that follow: 16 bits.
Every shingle is hashed once into each bucket, so that short texts leave no bucket empty and the
chance that two registers agree is the Jaccard similarity whatever the size of the sets.

1. Documents with equal sets are one class; its smallest id stands for it from here on.
2. Runs of registers (bands) are keys.  In each key's group every class is paired with the
   smallest and with the largest class only, so pairs grow with rows, not with their square.
3. Pairs go on if the similarity estimated from their registers, less the agreement expected of
   unequal minima, is not clearly below the threshold; then the full sets decide.
4. Links give components.  Groups that still hold several components are compared once more, in
   blocks of bounded size, spread over as many tasks: registers are compared in memory, each pair
   of different components once, in the first band it shares.  Only rows with a candidate leave a
   block; they come back with their texts, full sets decide, and a block returns no more links
   than its components need.
5. In a group, one component holds most rows as a rule.  Its rows are compared with the other
   components' only, and go to as many blocks as those fill; so a group of copies with a few rows
   of its own costs its rows once, and only rows outside the largest component meet each other.

The chance that two documents just at the threshold meet in no band is below 2 in 100,000; those
above it are found with more certainty still.

Edge cases: a text without words (null and empty ones too) has an empty set and no link; with
fewer than five words the whole sequence is its one shingle; very long texts are hashed whole, a
slice of hashes at a time; rows that repeat a doc_id are one document, linked if any of its texts
is; equal texts and ties are one class; rows without doc_id take no part, are kept and have no
component; an empty table gives no rows; extra columns are ignored, or pass through
:func:`deduplicated`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_shared, packed, slices, unpacked, utf8, write_shared

WORDS = 5
SHARE = 75  # of 100
BANDS, ROWS = 31, 4
REGISTERS = BANDS * ROWS
MANTISSA_BITS = 10
#: Estimates this many standard deviations below the threshold are trusted to be below it.
DEVIATIONS = 4.5
LEAST = SHARE / 100 - DEVIATIONS * (SHARE / 100 * (1 - SHARE / 100) / REGISTERS) ** 0.5
#: Rows, and shingles together, of a chunk of a group; a block is two chunks.
BLOCK, BLOCK_SHINGLES = 512, 400_000
MEMO_WORDS = 250_000


def _constants(n: int, salt: bytes) -> np.ndarray:
    return np.frombuffer(b"".join(blake2b(salt + bytes([i]), digest_size=4).digest() for i in range(n)), dtype=np.uint32)


_XOR = _constants(REGISTERS, b"xor")
_TIMES = _constants(REGISTERS, b"times") | np.uint32(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_WORDS = _WordHashes()


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; A-Z count as a-z."""
    words = text.lower().split()
    w = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(WORDS, len(w))
    if not n:
        return w
    h = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - n + 1 + i]
        h ^= h >> np.uint64(31)
    return np.unique(h * np.uint64(0xD6E8FEB86659FD93))


def registers(hashes: np.ndarray) -> np.ndarray:
    """Leading zeros (upper bits) and mantissa (lower bits) of each bucket's least value."""
    halves = np.ascontiguousarray(hashes).view(np.uint32).reshape(-1, 2)
    least = np.full(REGISTERS, 0xFFFFFFFF, dtype=np.uint32)
    half = REGISTERS // 2
    for at in range(0, len(halves), 1024):
        part = halves[at : at + 1024]
        for k, cut in ((0, slice(0, half)), (1, slice(half, None))):
            x = (part[:, k, None] ^ _XOR[cut]) * _TIMES[cut]
            np.minimum(least[cut], x.min(axis=0), out=least[cut])
    bits = np.frexp(least.astype(np.float64))[1].astype(np.uint64)
    zeros = 32 - bits
    mantissa = ((least.astype(np.uint64) << (zeros + 1)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - MANTISSA_BITS)
    return (zeros << np.uint64(MANTISSA_BITS) | mantissa).astype(np.uint16)


def expected_agreement(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The chance that registers of unequal minima of sets of n and m members agree."""
    n, m = np.asarray(n, dtype=np.float64), np.asarray(m, dtype=np.float64)
    total = np.zeros(np.broadcast(n, m).shape)
    for zeros in range(32):
        low, high = 0.5 ** (zeros + 1), 0.5**zeros
        total += ((1 - low) ** n - (1 - high) ** n) * ((1 - low) ** m - (1 - high) ** m)
    return total / 2**MANTISSA_BITS


def estimate(agree: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of registers that agree, corrected for chance."""
    by_chance = expected_agreement(n, m)
    return (agree - by_chance) / (1 - by_chance)


def _may_link(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    fits = 100 * np.minimum(n, m) >= SHARE * np.maximum(n, m)
    fits[fits] = estimate((a[fits] == b[fits]).mean(axis=1), n[fits], m[fits]) >= LEAST
    return fits


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two full sets are similar enough."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < SHARE * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= SHARE * (len(a) + len(b) - common)


def sketch(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, set digest and registers (null ones for an empty set)."""
    schema = "doc_id long, n_shingles long, digest binary, registers binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "utf8"):
            n, digests, regs = [], [], []
            for t in batch.column(1).to_pylist():
                h = shingles(t)
                n.append(len(h))
                digests.append(blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                regs.append(registers(h).tobytes() if len(h) else None)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(regs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "digest", "registers"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(f"`{text}`").alias("utf8")).mapInArrow(run, schema)


def band_keys() -> Column:
    """The keys of a sketch's bands: the band's number and its registers."""
    width = 2 * ROWS
    return F.array(*[F.xxhash64(F.lit(i), F.substring("registers", i * width + 1, width)) for i in range(BANDS)])


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of the nodes that links (a, b) hold.

    Edges are turned towards smaller nodes in alternating star steps, which take a number of
    rounds that grows with the logarithm of a component's size.  A hub costs a partial minimum
    and a join whose large keys can be split, never a group in one task.
    """
    edges = write_shared(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        # Large star: every larger neighbour, and the node itself, goes to the least neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        # Small star: the smaller neighbours of a node go to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = write_shared(small.select("e.*").where("u <> v").distinct(), "edges")
        drop_shared(edges)
        edges = after
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    # Every edge leads from a node to the least of its component now.
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out._sigla_path = edges._sigla_path
    return out


def _estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose sketches may be of sets similar enough."""
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("registers").alias(f"r_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {SHARE} * greatest(n_a, n_b)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ra, rb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for k in (4, 5))
            keep = _may_link(ra, rb, batch.column(2).to_numpy(), batch.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose full shingle sets are similar enough."""
    b = texts.select(F.col("node").alias("b"), F.col("t").alias("t_b"))
    a = texts.select(F.col("node").alias("a"), F.col("t").alias("t_a"))
    both = pairs.join(b, "b").join(a, "a").select("a", "b", "t_a", "t_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            keep = []
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for ta, tb in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    if ta != last:
                        last, own = ta, shingles(ta)
                    keep.append(linked(own, shingles(tb)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return write_shared(both.mapInArrow(run, "a long, b long").distinct(), "links")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole blocks (key, i, j) of a sorted stream, one after another."""
    held: pa.Table | None = None  # the block that the next batch may go on with
    for batch in batches:
        part = pa.Table.from_batches([batch])
        held = part if held is None else pa.concat_tables([held, part])
        key, i, j = (held.column(c).to_numpy() for c in ("key", "i", "j"))
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist()]
        for start, end in zip(cuts, cuts[1:]):
            yield held.slice(start, end - start)
        held = held.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held


def _candidates(block: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a block, each with the rows before it (by size) that it may be linked with.

    Only pairs of different components count, and a pair only in the first band that it shares.
    """
    label, n = block.column("label").to_numpy(), block.column("n_shingles").to_numpy()
    band = block.column("band")[0].as_py()
    regs = np.frombuffer(b"".join(block.column("registers").to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
    order = np.argsort(n, kind="stable")
    label, n, regs = label[order], n[order], regs[order]
    least = np.searchsorted(n, -(-SHARE * n // 100), side="left")  # the smallest set that fits
    for k in range(1, len(n)):
        other = np.flatnonzero(label[least[k] : k] != label[k]) + least[k]
        if not len(other):
            continue
        same = regs[other] == regs[k]
        first = same.reshape(-1, BANDS, ROWS).all(axis=2)[:, :band].any(axis=1)
        fits = ~first & (estimate(same.mean(axis=1), n[other], np.broadcast_to(n[k], len(other))) >= LEAST)
        if fits.any():
            yield int(order[k]), order[other[fits]]


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of blocks that have a candidate."""
    for block in _blocks(batches):
        wanted = np.zeros(block.num_rows, dtype=bool)
        for k, others in _candidates(block):
            wanted[k] = True
            wanted[others] = True
        if wanted.any():
            yield from block.filter(pa.array(wanted)).combine_chunks().to_batches()


def _linked_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between components within blocks by the full sets, as few as connect the same."""
    for block in _blocks(batches):
        node, label = block.column("node").to_numpy(), block.column("label").to_numpy()
        own = [shingles(t) for t in block.column("t").to_pylist()]
        n = np.array([len(s) for s in own], dtype=np.int64)
        starts = np.cumsum(n) - n
        values, place = np.unique(np.concatenate(own), return_inverse=True)
        mark = np.zeros(len(values), dtype=np.int64)
        parent = {x: x for x in label.tolist()}

        def root(x: int, parent: dict[int, int] = parent) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        links = []
        for k, others in _candidates(block):
            if all(root(int(label[o])) == root(int(label[k])) for o in others):
                continue
            mark[:] = 0
            mark[place[starts[k] : starts[k] + n[k]]] = 1
            common = np.add.reduceat(mark[place], starts)[others]
            for o in others[100 * common >= SHARE * (n[others] + n[k] - common)]:
                x, y = root(int(label[o])), root(int(label[k]))
                if x != y:
                    parent[x] = y
                    links.append((int(node[k]), int(node[o])))
        if links:
            a, b = zip(*links)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _chunks(rows: Column, size: Column) -> Column:
    """How many chunks a group of so many rows and shingles is cut into."""
    return F.greatest(F.ceil(rows / BLOCK), F.least(rows, F.ceil(size / BLOCK_SHINGLES)))


def _between_components(banded: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between different components that share a band, by blocks."""
    labelled = banded.join(labels.select("node", F.col("component").alias("c")), "node", "left").withColumn("label", F.coalesce("c", "node")).drop("c")
    rows = labelled.join(nodes.select("node", "n_shingles", "registers"), "node")
    held = rows.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    most = F.max(F.struct("n", "size", "label"))
    groups = held.groupBy("key").agg(most.alias("main"), F.sum("n").alias("rows"), F.sum("size").alias("all")).where("rows > main.n")
    groups = groups.select("key", F.col("main.label").alias("main"), _chunks(F.col("rows") - F.col("main.n"), F.col("all") - F.col("main.size")).alias("others"), _chunks(F.col("main.n"), F.col("main.size")).alias("mains"))
    # Chunks of the other components come first, then those of the main one.  Each pair of other
    # chunks is a block, and so is each pair of one of them and a main one.
    rows = rows.join(groups, "key").withColumn("apart", F.col("label") != F.col("main"))
    own = F.when(F.col("apart"), F.pmod(F.xxhash64("node"), "others")).otherwise(F.col("others") + F.pmod(F.xxhash64("node"), "mains"))
    last = F.when(F.col("apart"), F.col("others") + F.col("mains")).otherwise(F.col("others"))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last - 1)))
    dealt = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "band", "node", "label", "n_shingles", "registers")
    schema = dealt.schema
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    needed = write_shared(dealt.mapInArrow(_needed, schema), "blocks")
    both = needed.join(texts, "node").select(*needed.columns, "t").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    links = write_shared(both.mapInArrow(_linked_in_blocks, "a long, b long").distinct(), "links")
    drop_shared(needed)
    return links


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``."""
    own = write_shared(sketch(docs, text), "sketches")
    known = own.where("doc_id is not null and digest is not null")
    nodes = known.groupBy("digest").agg(F.min("doc_id").alias("node"), F.min("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    nodes = write_shared(nodes, "nodes")
    banded = nodes.select("node", F.posexplode(band_keys()).alias("band", "key"))
    groups = banded.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most")
    met = write_shared(banded.join(groups, "key"), "banded")
    pairs = met.select(F.explode(F.array(F.struct(F.col("least").alias("a"), F.col("node").alias("b")), F.struct(F.col("node").alias("a"), F.col("most").alias("b")))).alias("p"))
    pairs = write_shared(_estimated(pairs.select("p.*").where("a <> b").distinct(), nodes), "pairs")
    # The corpus is shuffled by id once, for the texts of classes that share a band with another.
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), utf8(f"`{text}`").alias("t"))
    texts = write_shared(texts.join(met.select("node").distinct().hint("merge"), "node", "left_semi"), "texts")
    links = [_verified(pairs, texts)]
    # Rows of one doc_id with different texts are one document.
    member = known.select("doc_id", "digest").join(nodes.select("digest", "node"), "digest").select("doc_id", "node")
    several = member.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a <> most").select("doc_id", "a")
    links.append(member.join(several, "doc_id").select("a", F.col("node").alias("b")).where("a <> b"))
    first = components(reduce(DataFrame.unionByName, links))
    late = _between_components(met.select("key", "band", "node"), first, nodes, texts)
    labels = components(reduce(DataFrame.unionByName, [*links, late]))
    for done in (pairs, met, texts, first, links[0], late):
        drop_shared(done)
    rows = own.join(nodes.select("digest", "node"), "digest", "left").join(labels, "node", "left")
    component = F.coalesce("component", "node", "doc_id")
    rows = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one row of each group: of the smallest id, and of rows that repeat it the first
    by text (null first); rows without id stay."""
    kept = near_duplicates(docs, text).where("kept and doc_id is not null").select(F.col("doc_id").alias("kept")).distinct()
    rows = docs.select(packed(docs).alias("row"), F.col("doc_id").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("hash"), F.col(f"`{text}`").alias("text"))
    own = rows.join(kept, F.col("id") == F.col("kept"), "left_semi")
    once = F.row_number().over(Window.partitionBy("id").orderBy("hash", "text"))
    own = own.withColumn("place", once).where("place = 1").select("row")
    return own.unionByName(rows.where("id is null").select("row")).select(*unpacked("row", docs.columns))
