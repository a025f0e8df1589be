import math
import random

import numpy as np
import pytest
from sigla.llm import whitening
from sigla.llm.queries import op13_whitening

SCHEMA = "vec_id long, embedding array<float>"


def by_hand(rows):
    """Exact deviations and the dense eigendecomposition, in one process."""
    full = [(k, v) for k, v in rows if v and all(e is not None and math.isfinite(e) for e in v)]
    x = [[math.floor(1024 * float(np.float32(e))) + 100_000 for e in v] for _, v in full]
    n = len(x)
    total = [sum(c) for c in zip(*x)]
    far = [sum((n * e - s) ** 2 for e, s in zip(r, total)) for r in x]
    centred = np.array([[(n * e - s) / n for e, s in zip(r, total)] for r in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return [k for k, _ in full], n, far, centred, values[::-1], vectors[:, ::-1]


def check(rows, got, components):
    keys, n, far, centred, values, vectors = by_hand(rows)
    assert len(got) == n * components
    trace = sum(far) / n**3
    by_key = {(r.vec_id, r.component): r for r in got}
    for j in range(components):
        own = np.array([by_key[k, j + 1].whitened for k in keys])
        expected = centred @ vectors[:, j] / math.sqrt(values[j])
        sign = np.sign(own @ expected)
        assert np.abs(sign * own - expected).max() < 1e-6
        assert by_key[keys[0], j + 1].explained == pytest.approx(values[j] / trace, rel=1e-8)
    assert all(by_key[k, 1].deviation == d and by_key[k, 1].n == n for k, d in zip(keys, far))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8


def test_query_equals_the_dense_decomposition(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    df = op13_whitening(spark, sf)
    assert dict(df.dtypes)["deviation"] == "bigint"
    check(rows, df.collect(), 8)


def test_incomplete_vectors_are_left_out(spark):
    rng = random.Random(1)
    rows = [(k, [rng.gauss(0, j + 1) for j in range(10)]) for k in range(60)]
    broken = [(100, None), (101, [None] * 10), (102, [float("nan")] + [0.0] * 9), (103, [float("-inf")] + [0.0] * 9), (104, []), (105, [1.0])]
    df = spark.createDataFrame([(k, v, "c") for k, v in rows + broken], SCHEMA + ", x string")
    check(rows, whitening.whitened(df).collect(), 8)


def test_repeated_rows_null_ids_and_few_dimensions(spark):
    rng = random.Random(2)
    rows = [(k, [rng.gauss(0, 1), rng.gauss(0, 2), rng.gauss(0, 3)]) for k in range(30)]
    check(rows, whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect(), 3)
    again = [(None, rows[0][1]), (None, rows[0][1]), *rows]
    assert whitening.whitened(spark.createDataFrame(again, SCHEMA)).where("vec_id is null").count() == 6


def test_components_without_variance_are_left_out(spark):
    rng = random.Random(3)
    flat = [(k, [a := rng.gauss(0, 1), a, 1.0, rng.gauss(0, 1)]) for k in range(40)]
    assert whitening.whitened(spark.createDataFrame(flat, SCHEMA)).select("component").distinct().count() == 2
    same = [(k, [0.5, 0.25]) for k in range(10)]
    for rows in (same, same[:1], []):
        df = whitening.whitened(spark.createDataFrame(rows, SCHEMA))
        assert df.count() == 0 and df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


class Dense:
    """A matrix that counts its products."""

    def __init__(self, matrix):
        self.matrix, self.passes = matrix, 0

    def times(self, block):
        self.passes += 1
        return self.matrix @ block


@pytest.mark.parametrize("spectrum", ["falling", "equal", "pairs", "low rank"])
def test_lanczos_converges_with_restarts_and_breakdowns(spectrum):
    rng = np.random.default_rng(5)
    d = 300
    values = {"falling": 1 / np.arange(1, d + 1), "equal": np.ones(d), "pairs": np.repeat(1 / np.arange(1, d // 2 + 1), 2), "low rank": np.where(np.arange(d) < 5, 1.0, 0.0)}[spectrum]
    turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
    dense = Dense((turn * values) @ turn.T)
    got, vectors, worst = whitening.eigenpairs(dense, d, 8, block=8, basis_blocks=6)
    assert worst <= whitening.ROUNDING and np.abs(got - values[:8]).max() < 1e-11
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-11
    assert np.linalg.norm(dense.matrix @ vectors - vectors * got) < 1e-10


def test_exact_whole_numbers_beyond_64_bits():
    x = np.array([[1 << 40, 3], [5, 1 << 39]], dtype=np.int64)
    n, total = 1 << 30, [1 << 69, 1 << 68]
    apart = whitening.exact_differences(x, n, total)
    expected = [[int(e) * n - s for e, s in zip(r, total)] for r in x.tolist()]
    assert apart.tolist() == expected
    assert whitening.deviations(apart) == [sum(e * e for e in r) for r in expected]
    small = whitening.exact_differences(x[:, 1:] % 7, 3, [5])
    assert small.dtype == np.int64 and whitening.deviations(small) == [int(e) ** 2 for e in small[:, 0]]
