"""Whitening against numpy, and the eigensolver on awkward matrices."""

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"


def expected(vectors, k=32):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors])
    sums = x.sum(0)
    n = len(x)
    y = x - sums / n
    v = y.T @ y / n
    values, components = np.linalg.eigh(v)
    values, components = values[::-1][:k], components[:, ::-1][:, :k]
    deviations = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return n, deviations, np.abs(y @ components / np.sqrt(values)), values / np.trace(v)


def test_embeddings(spark):
    from tidelog.llm.queries import op12_whitening

    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    own = [r for r in rows if r["embedding"] and all(c is not None and np.isfinite(c) for c in r["embedding"])]
    n, deviations, whitened, explained = expected([r["embedding"] for r in own])
    df = op12_whitening(spark, SF)
    assert dict(df.dtypes)["deviation"] == "bigint"
    got = df.toPandas()
    assert set(got["n"]) == {n} and len(got) == 32 * n
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[[r["vec_id"] for r in own]].to_numpy()
    assert np.allclose(np.abs(wide), whitened, atol=1e-8)
    first = got[got["component"] == 1].set_index("vec_id")["deviation"]
    assert [int(first[r["vec_id"]]) for r in own] == deviations
    share = got[got["vec_id"] == own[0]["vec_id"]].sort_values("component")["explained"].to_numpy()
    assert np.allclose(share, explained, rtol=1e-9)
    assert got["identity_error"].nunique() == 1
    assert got["identity_error"][0] <= 1e-9
    assert np.max(np.abs(wide.T @ wide / n - np.eye(32))) <= 1e-9


def test_odd_vectors(spark):
    from tidelog.llm.whitening import whiten

    nan, inf = float("nan"), float("inf")
    good = [[0.5, -1.0, 3.0], [0.0, 0.0, 0.0], [1e9, 2.0, -3.25], [0.5, -1.0, 3.0]]
    odd = [None, [], [1.0], [1.0, None, 2.0], [nan, 1.0, 1.0], [1.0, -inf, 1.0]]
    rows = [(i, v, 1, 2, "x") for i, v in enumerate([*good, *odd])] + [(None, [2.0, 2.0, 2.0], 1, 2, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int, n int, i string")
    got = whiten(df).toPandas()
    # The two smaller variances are beneath the least share of the first.
    n, deviations, whitened, explained = expected([*good, [2.0, 2.0, 2.0]], 1)
    assert set(got["n"]) == {n} and set(got["component"]) == {1} and len(got) == 5
    assert sorted(map(int, got["deviation"])) == sorted(deviations)
    assert np.allclose(np.sort(np.abs(got["whitened"])), np.sort(whitened[:, 0]), rtol=1e-9)
    assert whiten(df.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<float>")
    assert whiten(same).count() == 0 and whiten(same.limit(1)).count() == 0


def test_deviations_beyond_longs():
    from tidelog.llm.whitening import Centre

    x = np.array([[2**40, 5], [-(2**40), 6]])
    sums = [int(s) + 2 * 1_000_000 for s in x.sum(0)]
    assert Centre(2, sums).deviations(x) == [(2 * 2**40) ** 2 + 1, (2 * 2**40) ** 2 + 1]


def matrices():
    random = np.random.default_rng(3)
    turn = np.linalg.qr(random.standard_normal((48, 48)))[0]
    yield "one", np.array([[3.0]])
    yield "two", np.array([[2.0, 1.0], [1.0, 2.0]])
    yield "same", np.eye(40) * 7
    yield "diagonal", np.diag(np.arange(40.0))
    yield "clusters", turn @ np.diag(np.repeat([9.0, 9 - 1e-12, 4, 1], 12)) @ turn.T
    yield "spread", turn @ np.diag(10.0 ** -np.arange(48)) @ turn.T
    yield "blocks", np.kron(np.eye(2), np.ones((20, 20)))
    few = random.standard_normal((6, 40))
    yield "few rows", few.T @ few
    many = random.standard_normal((500, 130)) * np.exp(random.standard_normal(130))
    yield "many", many.T @ many


@pytest.mark.parametrize("name, matrix", list(matrices()), ids=lambda m: m if isinstance(m, str) else "")
def test_eigenpairs(name, matrix):
    from tidelog.llm.eigen import leading_eigenpairs

    values, vectors = leading_eigenpairs(matrix, 32)
    k, norm = min(32, len(matrix)), np.linalg.norm(matrix, 2)
    assert np.max(np.abs(values - np.linalg.eigvalsh(matrix)[::-1][:k])) <= 1e-14 * norm
    assert np.max(np.abs(matrix @ vectors - vectors * values)) <= 1e-13 * norm
    assert np.max(np.abs(vectors.T @ vectors - np.eye(k))) <= 1e-13
