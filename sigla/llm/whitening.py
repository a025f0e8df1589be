"""Whitening of embeddings by matrix-free block Lanczos.

Vectors become whole numbers x = floor(1024 c) + 100000, kept as one shared table that every pass
reads.  The covariance matrix is never made: a pass multiplies a narrow block of directions by it,
as the sum over rows of (x - mean) times the products of (x - mean) with the block; tasks send one
narrow matrix each, which Spark adds up by row.  On the driver there is what has the vectors' width
times the basis, never anything that grows with their number.

- Lanczos: each new block is what the product of the last one adds to the basis, orthogonalised
  against the whole basis twice (full reorthogonalisation).
- Breakdown: directions in which a block has nothing new are replaced by random ones (a restart in
  the space that is left), so that eigenvalues that occur more than once are all found.
- Convergence: the residual norm of each wanted Ritz pair, from the block's own product.  A basis of
  BASIS_BLOCKS blocks without convergence restarts from its best Ritz vectors (thick restart).
- Differences from the mean are exact: n x - S in whole numbers, divided once.  The trace is the sum
  of the exact deviations.

Edge cases: rows whose vector is null, or holds null, NaN or infinite entries, or entries of 2**30
and more (which x would not hold), are left out, as are empty vectors and, should lengths differ,
those not of the commonest length (the longer one of equals); rows with repeated or null ids are
all kept; components without variance are left out, so fewer rows than dimensions or equal vectors
give fewer components, and no variance at all gives no rows; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import write_shared

COMPONENTS, BLOCK, BASIS_BLOCKS, MOST_RESTARTS = 8, 16, 24, 50
#: Residual norms, as shares of the largest eigenvalue: at which a component is done, and at which
#: one that gets no smaller is down to rounding.  The share of the trace that counts as no variance.
TOLERANCE, ROUNDING, NOTHING = 1e-13, 1e-11, 1e-12
SCALE, SHIFT, LARGEST = 1024, 100_000, 1 << 30


def whole_numbers(df: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The key and x (whole numbers) of the rows with a full and finite vector of the common length."""
    c = F.col(vector)
    fine = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < LARGEST)
    full = df.where(c.isNotNull() & (F.size(c) > 0)).where(F.forall(c, fine))
    x = F.transform(c, lambda e: F.floor(e.cast("double") * SCALE) + SHIFT)
    rows = full.select(F.col(key).alias("key"), x.alias("x"))
    rows = write_shared(rows, "vectors")
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("x") == sizes[0].d) if sizes else rows


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column(batch.schema.get_field_index("x"))
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def exact_differences(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """n x - S in whole numbers: 64 bits where they do, Python's otherwise."""
    if n * (SCALE * LARGEST + SHIFT) < 1 << 62 or (len(x) and n * int(np.abs(x).max()) < 1 << 62 and max(map(abs, total), default=0) < 1 << 62):
        return x * np.int64(n) - np.array(total, dtype=np.int64)
    return x.astype(object) * n - np.array(total, dtype=object)


def deviations(differences: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    largest = int(np.abs(differences).max()) if differences.size else 0
    if largest * largest * max(1, differences.shape[1]) < 1 << 63:
        d = differences.astype(np.int64)
        return (d * d).sum(axis=1).tolist()
    d = differences.astype(object)
    return (d * d).sum(axis=1).tolist()


class Covariance:
    """The covariance matrix of ``rows.x`` as something that multiplies blocks."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        sums = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
        found = sorted(sums.collect())  # one row for each dimension
        self.total = [int(r.s) for r in found]
        self.n = int(found[0].n) if found else 0
        self.passes = 0

    def times(self, block: np.ndarray) -> np.ndarray:
        """V @ block in one pass over the rows."""
        n, total, width = self.n, self.total, block.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = np.zeros(block.shape)
            for batch in batches:
                if batch.num_rows:
                    centred = (exact_differences(_matrix(batch), n, total) / n).astype(np.float64)
                    part += centred.T @ (centred @ block)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(part)), pa.int32()), pa.array(part.tolist(), pa.list_(pa.float64()))], names=["i", "part"])

        parts = self.rows.select("x").mapInArrow(run, "i int, part array<double>")
        sums = parts.groupBy("i").agg(*[F.sum(F.col("part")[k]).alias(f"c{k}") for k in range(width)])
        self.passes += 1
        return np.array([r[1:] for r in sorted(sums.collect())]) / n  # one row for each dimension

    def trace(self) -> float:
        """The sum of all variances, from the exact deviations."""
        n, total = self.n, self.total

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = sum(sum(deviations(exact_differences(_matrix(b), n, total))) for b in batches if b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array([str(own)])], names=["own"])

        got = self.rows.select("x").mapInArrow(run, "own string").agg(F.sum(F.col("own").cast("decimal(38,0)"))).first()[0]
        return float(Decimal(got or 0) / (Decimal(n) ** 3))


def _orthonormal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator, scale: float) -> np.ndarray:
    """An orthonormal block orthogonal to ``basis``; columns with nothing new restart at random."""
    room = block.shape[0] - basis.shape[1]
    out = np.zeros((block.shape[0], 0))
    for k in range(min(block.shape[1], room)):
        v, least = block[:, k], NOTHING * scale
        for _ in range(20):
            size = np.linalg.norm(v)
            if size > least:
                v = v / size
                for _ in range(3):
                    v = v - basis @ (basis.T @ v) - out @ (out.T @ v)
                left = np.linalg.norm(v)
                if left > 1e-8:
                    v = v / left
                    v = v - basis @ (basis.T @ v) - out @ (out.T @ v)
                    out = np.column_stack([out, v / np.linalg.norm(v)])
                    break
            v, least = rng.standard_normal(block.shape[0]), 0.0  # breakdown
    return out


def eigenpairs(covariance: Covariance, dimensions: int, wanted: int = COMPONENTS, block: int = BLOCK, basis_blocks: int = BASIS_BLOCKS) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest eigenvalues, falling, their unit vectors as columns, and the largest residual
    norm as a share of the first eigenvalue."""
    rng = np.random.default_rng(13)
    wanted = min(wanted, dimensions)
    block = min(max(block, wanted), dimensions)
    most = min(dimensions, max(basis_blocks * block, wanted + 2 * block))
    basis, image = np.zeros((dimensions, 0)), np.zeros((dimensions, 0))
    fresh = _orthonormal(rng.standard_normal((dimensions, block)), basis, rng, 0.0)
    restarts, best_yet, stalled = 0, np.inf, 0
    while True:
        product = covariance.times(fresh)
        basis, image = np.column_stack([basis, fresh]), np.column_stack([image, product])
        small = basis.T @ image
        values, inner = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)[:wanted]
        values, inner = values[order], inner[:, order]
        vectors = basis @ inner
        residual = image @ inner - vectors * values
        scale = max(float(values[0]), 0.0)
        worst = float(np.linalg.norm(residual, axis=0).max() / scale) if scale > 0 else 0.0
        stalled = stalled + 1 if worst > best_yet / 2 and worst < ROUNDING else 0
        best_yet = min(best_yet, worst)
        if worst <= TOLERANCE or basis.shape[1] == dimensions or stalled > 2 or restarts > MOST_RESTARTS:
            return values, vectors / np.linalg.norm(vectors, axis=0), worst
        following = product - basis @ (basis.T @ product)
        if basis.shape[1] + block > most:  # thick restart: the best Ritz vectors and what they lack
            restarts += 1
            values_all, inner_all = np.linalg.eigh((small + small.T) / 2)
            best = np.argsort(-values_all)[: wanted + block]
            lacking = image @ inner_all[:, best] - (basis @ inner_all[:, best]) * values_all[best]
            following = lacking[:, np.argsort(-np.linalg.norm(lacking[:, :wanted], axis=0))]
            basis, image = basis @ inner_all[:, best], image @ inner_all[:, best]
            basis, turn = np.linalg.qr(basis)
            image = np.linalg.solve(turn.T, image.T).T
        fresh = _orthonormal(following[:, :block], basis, rng, scale)


def whitened(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """A row per remaining vector and component: key, component (from 1), n, deviation (decimal, the
    exact sum of squares of n x - S), whitened, explained, identity_error."""
    rows = whole_numbers(df, vector, key)
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *T._parse_datatype_string("component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")])
    covariance = Covariance(rows)
    n, total, d = covariance.n, covariance.total, len(covariance.total)
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    values, vectors, _ = eigenpairs(covariance, d, components)
    trace = covariance.trace()
    some = values > NOTHING * max(trace, 0.0)
    values, vectors = values[some], vectors[:, some]
    if not len(values):
        return df.sparkSession.createDataFrame([], schema)
    project = vectors / np.sqrt(values)
    explained = (values / trace).tolist()
    error = _identity_error(rows, n, total, project)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(explained)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                apart = exact_differences(_matrix(batch), n, total)
                far = [Decimal(v) for v in deviations(apart)]
                white = (apart / n).astype(np.float64) @ project
                keys = batch.column(batch.schema.get_field_index("key")).take(pa.array(np.repeat(np.arange(batch.num_rows), k)))
                columns = [
                    keys,
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)),
                    pa.array(np.full(k * batch.num_rows, n, dtype=np.int64)),
                    pa.array(far, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(batch.num_rows), k))),
                    pa.array(white.reshape(-1)),
                    pa.array(np.tile(explained, batch.num_rows)),
                    pa.array(np.full(k * batch.num_rows, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def _identity_error(rows: DataFrame, n: int, total: list[int], project: np.ndarray) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    k = project.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = np.zeros((k + 1, k))
        for batch in batches:
            if batch.num_rows:
                white = (exact_differences(_matrix(batch), n, total) / n).astype(np.float64) @ project
                part[:k] += white.T @ white
                part[k] += white.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(k + 1), pa.int32()), pa.array(part.tolist(), pa.list_(pa.float64()))], names=["i", "part"])

    parts = rows.select("x").mapInArrow(run, "i int, part array<double>")
    sums = parts.groupBy("i").agg(*[F.sum(F.col("part")[j]).alias(f"c{j}") for j in range(k)])
    got = np.array([r[1:] for r in sorted(sums.collect())]) / n  # one row for each component, and their means
    return float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())
