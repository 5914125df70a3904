import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.whitening import Slices, fit_whitening, leading_eigenpairs, op13_whitening, with_whitened

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def symmetric(values, seed=1):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    a = (q * np.array(values, float)) @ q.T
    return (a + a.T) / 2


SPECTRA = {
    "apart": list(range(1, 21)),
    "one": [3.0],
    "two": [3.0, 1.0],
    "equal": [5.0, 5.0, 5.0, 5.0, 1.0, 1.0, 0.5],
    "near": [5.0, 5.0 + 1e-13, 5.0 - 1e-9, 5.0 + 1e-6, 2.0, 1.0],
    "all equal": [2.0] * 9,
    "low rank": [9.0, 4.0, 0.0, 0.0, 0.0, 0.0],
    "graded": [10.0**-k for k in range(9)],
    "wide": list(np.linspace(1, 50, 120) ** 2),
}


@pytest.mark.parametrize("name", SPECTRA)
def test_leading_pairs(name):
    spectrum = SPECTRA[name]
    a = symmetric(spectrum)
    values, vectors = leading_eigenpairs(a, 8)
    want = np.sort([v for v in spectrum if v > 1e-11 * sum(spectrum)])[::-1][:8]
    assert np.allclose(values, want, rtol=0, atol=1e-13 * sum(spectrum))
    assert np.abs(vectors.T @ vectors - np.eye(len(want))).max() < 1e-12
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * max(spectrum)


def test_diagonal_matrix_and_zeros():
    values, vectors = leading_eigenpairs(np.diag([1.0, 7.0, 7.0, 0.0]), 8)
    assert values.tolist() == pytest.approx([7, 7, 1]) and np.allclose(np.abs(vectors[1:3, :2]).sum(axis=1) ** 2 > 0, True)
    assert leading_eigenpairs(np.zeros((3, 3)), 8)[0].size == 0


def test_counts():
    slices = Slices(symmetric([1, 2, 2, 3, 10]))
    assert [slices.above(s) for s in (0.5, 1.5, 2.5, 5, 11)] == [5, 4, 2, 1, 0]


def by_hand(rows, components=8):
    """Rows ``(vec_id, x)`` of whole numbers: the result by plain NumPy and Python integers."""
    x = np.array([r[1] for r in rows], dtype=np.int64)
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    y = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    white = y @ vectors / np.sqrt(values)
    deviation = [sum((n * int(c) - s) ** 2 for c, s in zip(r[1], sums)) for r in rows]
    return n, deviation, white, values / (y.T @ y / n).trace()


def check(got, rows):
    n, deviation, white, explained = by_hand(rows)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    signs = {}
    assert len(got) == len(rows) * white.shape[1]
    for (vec_id, _), dev, w in zip(rows, deviation, white):
        for k in range(len(w)):
            r = by[vec_id][k + 1][0]
            assert r["n"] == n and r["deviation"] == dev and r["identity_error"] < 1e-9
            assert r["explained"] == pytest.approx(explained[k], rel=1e-9)
            sign = signs.setdefault(k, math.copysign(1, r["whitened"] * w[k]))
            assert r["whitened"] * sign == pytest.approx(w[k], abs=1e-7)


def entries(vector):
    return [math.floor(1024 * c) + 100_000 for c in vector]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    check(op13_whitening(spark, folder).collect(), [(r["vec_id"], entries(r["embedding"])) for r in rows])


def test_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(5)
    good = [(i, [float(np.float32(c)) for c in rng.standard_normal(10) * range(1, 11)], 0) for i in range(80)]
    good += [(None, good[0][1], 1), (80, [0.0] * 10, 1)]
    nan, inf = float("nan"), float("inf")
    bad = [(90, None, 1), (91, [1.0] * 9 + [None], 1), (92, [nan] * 10, 1), (93, [1.0] * 9 + [-inf], 1), (94, [], 1), (95, [1.0] * 4, 1)]
    df = spark.createDataFrame(good + [good[3]] + bad, SCHEMA).repartition(4)
    df.withColumn("component", F.lit("x")).withColumn("n", F.lit("x")).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op13_whitening(spark, str(tmp_path)).collect()
    check(got, [(i, entries(v)) for i, v, _ in good + [good[3]]])


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5])
def test_vectors_that_do_not_vary(spark, tmp_path, vectors):
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], SCHEMA)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert op13_whitening(spark, str(tmp_path)).collect() == []


def test_clashing_columns(spark):
    df = spark.createDataFrame([(i, [float(i), float(i * i % 7)]) for i in range(9)], "vec_id bigint, embedding array<float>")
    odd = df.select("*", *[F.lit("x").alias(c) for c in ("deviation", "whitened", "projected", "n", "i", "length")])
    got = with_whitened(odd, fit_whitening(odd))
    assert set(got.columns) == set(odd.columns) and dict(got.dtypes)["whitened"] == "array<double>"
    assert got.where("size(whitened) = 2").count() == 9
