"""Exact similarity search and thinning against all pairs."""

import numpy as np
import pytest

from wayfold.operators import selection, similarity


def table(spark, vectors, classes=1, first=0):
    return spark.createDataFrame([(first + k, k % classes, first + k, None if v is None else [float(x) for x in v]) for k, v in enumerate(vectors)], "id long, klass long, rank long, embedding array<double>")


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def clustered(n, clusters, spread, seed=0, size=16):
    rng = np.random.default_rng(seed)
    return unit(unit(rng.standard_normal((clusters, size)))[rng.integers(0, clusters, n)] + spread * rng.standard_normal((n, size)))


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(similarity, "CELL", 40)
    monkeypatch.setattr(similarity, "BLOCK", 16)


@pytest.mark.parametrize(("spread", "limit"), [(0.05, 0.9), (0.2, 0.8), (1.0, 0.5), (0.3, 0.0)])
def test_pairs_against_all(spark, small, spread, limit):
    x = clustered(400, 12, spread)
    cosine = x @ x.T
    rows = table(spark, x, 2)
    got = {(r.a, r.b) for r in similarity.near_pairs(rows, rows, ["klass"], limit).filter("a < b").collect()}
    assert got == {(a, b) for a in range(400) for b in range(a + 1, 400) if a % 2 == b % 2 and cosine[a, b] > limit} and got
    other = clustered(90, 12, spread, 5)
    want = {a for a in range(400) if any(a % 2 == b % 2 and x[a] @ other[b] > limit for b in range(90))}
    found = [r.a for r in similarity.near_pairs(rows, table(spark, other, 2, 1000), ["klass"], limit, some=True).collect()]
    assert set(found) == want and len(found) == len(want)


def test_clustered_vectors_meet_few_others(spark, small):
    """What is compared is far below all pairs."""
    x = clustered(3000, 40, 0.03)
    rows = table(spark, x)
    pivots = similarity._pivots(rows, ["klass"])
    assert 30 <= len(pivots[0,]) <= 200
    placed = similarity._placed(rows, ["klass"], pivots, None, None)
    radii = {((0,), r.cell): r.angle for r in placed.groupBy("cell").agg({"angle": "max"}).withColumnRenamed("max(angle)", "angle").collect()}
    homes = {r.cell: r["count"] for r in placed.groupBy("cell").count().collect()}
    visits = {r.cell: r["count"] for r in similarity._placed(rows, ["klass"], pivots, np.arccos(0.9), radii).groupBy("cell").count().collect()}
    assert sum(visits[c] * homes.get(c, 0) for c in visits) < 0.2 * 3000**2


def plain_thin(x, classes, limit):
    kept = []
    for k, v in enumerate(x):
        if v is None or not any(x[o] is not None and o % classes == k % classes and x[o] @ v > limit for o in kept):
            kept.append(k)
    return kept


@pytest.mark.parametrize("first", [8192, 30])
def test_thinning_in_parts_against_one_by_one(spark, small, first):
    x = list(clustered(500, 25, 0.1, 3))
    x[100:160] = [x[7]] * 60  # copies
    x[3] = x[300] = None
    got = sorted(r.id for r in selection.thin(table(spark, x, 2), ["klass"], 0.9, first=first).collect())
    assert got == plain_thin(x, 2, 0.9) and len(got) < 250


def test_a_large_cluster_meets_its_kept_members_only(spark, monkeypatch):
    """One cluster of all rows: the pairs that are kept in hand grow as the parts, not as the square of the rows."""
    x = clustered(2000, 1, 0.02, 4)
    sizes, real = [], selection.cut_lineage
    monkeypatch.setattr(selection, "cut_lineage", lambda df, name: (lambda out: (sizes.append(out.count()) if name == "pairs" else None, out)[1])(real(df, name)))
    assert selection.thin(table(spark, x), ["klass"], 0.9, first=50).count() == len(plain_thin(list(x), 1, 0.9))
    assert sum(sizes) < 10_000


def test_odd_vectors(spark):
    rows = table(spark, [[2.0, 0.0], [1.0, 0.0], [0.0, 0.0], [0.0, 3.0], None])
    assert sorted(r.id for r in selection.thin(rows, ["klass"], 0.9).collect()) == [0, 2, 3, 4]
    assert selection.thin(rows.limit(0), ["klass"], 0.9).count() == 0
    marked = rows.selectExpr("*", "id = 1 AS accepted")
    assert sorted(r.id for r in selection.far_from(marked, rows.filter("id = 0"), ["klass"], 0.9, "accepted").collect()) == [1, 2, 3, 4]
