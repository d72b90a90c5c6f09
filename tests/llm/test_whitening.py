import numpy as np
import pytest

from varioflow.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, n long, x double, component int"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 0, 1, 0.5, 2) for i, v in vectors], SCHEMA)


def spectra():
    rng = np.random.RandomState(2)
    basis, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    yield "spread", np.linspace(1, 200, 40), basis
    yield "clusters", np.repeat([1.0, 5.0, 5.0 + 1e-9, 90.0], 10), basis
    yield "one cluster", np.full(40, 3.0), basis
    yield "low rank", np.concatenate((np.zeros(35), [1, 2, 3, 4, 5])), basis
    yield "steep", 10.0 ** np.linspace(-9, 6, 40), basis


@pytest.mark.parametrize("name,e,basis", list(spectra()), ids=lambda x: x if isinstance(x, str) else "")
def test_contours_give_the_eigenpairs_that_inertia_counts(spark, name, e, basis):
    v = (basis * e) @ basis.T
    v = (v + v.T) / 2
    for s in (0.5, 2.5, 4.5, 50.0):
        assert W.inertia(v - s * np.eye(40)) == (e > s).sum()
    got, u = W.components(spark, v, 32)
    expected = np.sort(e)[::-1][:32]
    expected = expected[expected > 16 * 40 * W.EPS * expected[0]]
    assert len(got) == len(expected)
    assert np.abs(got - expected).max() <= 1e-13 * expected[0]
    assert np.abs(u.T @ u - np.eye(len(got))).max() < 1e-9
    assert np.abs(v @ u - u * got).max() <= 1e-12 * expected[0]


def test_intervals_hold_all_wanted():
    rng = np.random.RandomState(3)
    a = rng.normal(size=(64, 64))
    v = a @ a.T
    parts = W.intervals(v, 32)
    e = np.linalg.eigvalsh(v)
    assert sum(k for *_, k in parts) >= 32
    assert all(((e > low) & (e < high)).sum() == k for low, high, k in parts)
    with pytest.raises(ArithmeticError):
        low, high, k = parts[0]
        W.contour(v, low, high, k + 1)


def test_zero_diagonals_need_pivots_of_two_rows():
    assert W.inertia(np.array([[0.0, 1], [1, 0]])) == 1
    assert W.inertia(np.zeros((3, 3))) == 0


@pytest.mark.parametrize("d,rows", [(48, 700), (5, 300)])
def test_against_whole_matrices(spark, d, rows):
    rng = np.random.RandomState(7)
    mix = rng.normal(size=(d, d)) * np.linspace(0.2, 2, d)
    data = (rng.normal(size=(rows, d)) @ mix + 3).astype(np.float32)
    good = [(i, [float(c) for c in row]) for i, row in enumerate(data)]
    odd = [(rows, None), (rows + 1, []), (rows + 2, [None] * d), (rows + 3, [float("nan")] * d), (rows + 4, [float("inf")] * d), (rows + 5, [1.0] * (d - 1)), (rows + 6, [1e30] * d)]
    got = W.whiten(table(spark, good + odd).repartition(3)).toPandas()
    x = np.floor(64 * data.astype(np.float64)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:32], u[:, ::-1][:, :32]
    k = min(d, 32)
    assert sorted(set(got["vec_id"])) == list(range(rows)) and len(got) == rows * k
    assert set(got["n"]) == {n}
    assert max(got["identity_error"]) < 1e-9
    w = np.zeros((rows, k))
    w[got["vec_id"], got["component"] - 1] = got["whitened"]
    plain = centred @ u[:, :k] / np.sqrt(e[:k])
    plain *= np.sign((plain * w).sum(axis=0))
    assert np.abs(w - plain).max() < 1e-7
    share = got.groupby("component")["explained"].agg(["min", "max"])
    assert np.allclose(share["min"], e[:k] / np.trace(v), rtol=1e-9) and (share["min"] == share["max"]).all()
    exact = {i: sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total)) for i, row in enumerate(x)}
    assert all(exact[i] == int(t) for i, t in zip(got["vec_id"], got["deviation"]))


def test_far_entries_stay_exact(spark):
    rows = [(1, [1e7, 0.0]), (2, [-1e7, 0.25]), (3, [1e7, 1.0]), (None, [5.0, 2.0]), (None, [5.0, 2.0])]
    got = W.whiten(table(spark, rows)).toPandas()
    x = [[int(64 * c) + 1_000_000 for c in v] for _, v in rows]
    total = [sum(c) for c in zip(*x)]
    assert {(i if i == i else None, int(t)) for i, t in zip(got["vec_id"], got["deviation"])} == {(i, sum((5 * a - s) ** 2 for a, s in zip(v, total))) for (i, _), v in zip(rows, x)}
    assert len(got) == 10


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]])
def test_nothing_to_whiten(spark, rows):
    got = W.whiten(table(spark, rows))
    assert got.collect() == [] and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_query(spark):
    got = W.op12_embedding_whitening(spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes)["deviation"] == "bigint"
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count() * 32
