import numpy as np
import pytest

from wayfold.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string, n string"


def plain(vectors: np.ndarray) -> dict:
    """Deviations, eigenvalues, components and whitened rows from the covariance matrix itself."""
    x = np.floor(64 * vectors.astype(float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    kept = min(32, int((values > 1e-9 * values[0]).sum()))
    return {"deviation": [sum(int(n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x], "explained": values / values.sum(), "whitened": (centred @ axes)[:, :kept] / np.sqrt(values[:kept]), "kept": kept}


def held(rows: list, vectors: np.ndarray, distinct: bool = True) -> None:
    want, n = plain(vectors), len(vectors)
    rows = sorted(rows, key=lambda r: (r.vec_id, r.component))
    kept = want["kept"]
    assert len(rows) == n * kept and [r.component for r in rows[:kept]] == list(range(1, kept + 1)) and {r.n for r in rows} == {n}
    assert [r.deviation for r in rows[::kept]] == want["deviation"]
    assert np.allclose([r.explained for r in rows[:kept]], want["explained"][:kept], rtol=1e-9)
    w = np.array([r.whitened for r in rows]).reshape(n, kept)
    error = np.abs(w.T @ w / n - np.eye(kept)).max()
    assert error < 1e-9 and all(r.identity_error < 1e-9 for r in rows)
    if distinct:
        assert np.allclose(w * np.sign((w * want["whitened"]).sum(0)), want["whitened"], atol=1e-7)


def test_op13_against_the_covariance_matrix(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    held(whitening.op13_lanczos_whitening(spark, sf).collect(), np.array([r.embedding for r in table]))


@pytest.mark.parametrize("seed", range(2))
def test_dependent_and_repeated_directions(spark, seed):
    """Two equal columns, one constant column, and rows that make two eigenvalues equal."""
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((60, 3)).astype(np.float32)
    vectors = np.concatenate([a, a[:, :1], np.ones((60, 1), np.float32)], axis=1)
    table = spark.createDataFrame([(k, v, "x", "y") for k, v in enumerate(vectors.tolist())], SCHEMA)
    held(whitening.whiten(table).collect(), vectors)
    square = np.array([[1, 0], [-1, 0], [0, 1], [0, -1]] * 5, np.float32)
    table = spark.createDataFrame([(k, v, "x", "y") for k, v in enumerate(square.tolist())], SCHEMA)
    held(whitening.whiten(table).collect(), square, distinct=False)


def test_odd_rows(spark):
    good = [[1.0, 2.0], [3.0, -1.0], [0.5, 0.5], [3.0, -1.0], [0.0, 9.0]]
    bad = [None, [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0], []]
    table = spark.createDataFrame([(k, v, "x", None) for k, v in enumerate(good + bad)], SCHEMA)
    held(whitening.whiten(table).collect(), np.array(good))
    assert whitening.whiten(table.limit(0)).count() == 0
    assert whitening.whiten(table.filter("vec_id = 0")).count() == 0  # one row has no spread
    assert whitening.whiten(table.filter("vec_id in (1, 3)")).count() == 0
    nulls = spark.createDataFrame([(None, v, "x", None) for v in good], SCHEMA)
    assert whitening.whiten(nulls).filter("vec_id is null").count() == 10
    assert whitening.whiten(nulls).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_great_deviations_are_decimals(spark):
    vectors = np.array([[1e11, 0.0], [-1e11, 3.0], [5.0, 1e10]])
    table = spark.createDataFrame([(k, v, "x", None) for k, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>, component string, n string")
    out = whitening.whiten(table)
    assert out.schema["deviation"].dataType.simpleString() == "decimal(38,0)"
    got = {r.vec_id: int(r.deviation) for r in out.collect()}
    assert [got[k] for k in range(3)] == plain(vectors)["deviation"]


def test_bidiagonal_factors(spark):
    """X V = U B with B bidiagonal and V orthonormal: B has the singular values of X."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1000, (300, 12))
    blocks = spark.createDataFrame([(bytearray(x[k : k + 50].astype(np.int64).tobytes()),) for k in range(0, 300, 50)], "x binary")
    b, v = whitening.bidiagonalise(whitening.Centred(blocks, 12))
    assert np.allclose(v.T @ v, np.eye(12), atol=1e-13) and np.allclose(b, np.triu(np.tril(b, 1)))
    assert np.allclose(np.linalg.svd(b)[1], np.linalg.svd(x - x.mean(0))[1], rtol=1e-12)
