"""Whitening against numpy's eigenvectors of the exact covariance."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import DATA

from lumenweir.llm import queries, whitening


def exact(vectors, most):
    """Ids, whole numbers, covariance, its eigenvalues in falling order, and exact deviations of the usable rows."""
    rows = [(i, v) for i, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(1024 * np.float64(c))) + 100_000 for c in v] for _, v in rows], object)
    n, sums = len(x), x.sum(0)
    away = n * x - sums
    a = (away / n).astype(float)
    values, vectors = np.linalg.eigh(a.T @ a / n)
    return [i for i, _ in rows], a, values[::-1][:most], vectors[:, ::-1][:, :most], values.sum(), [int(d) for d in (away * away).sum(1)]


def held(got, vectors, most=8):
    ids, a, values, components, trace, deviations = exact(vectors, most)
    values = values[values > 1e-12 * values[0]]
    got = got.sort_values(["vec_id", "component"])
    assert len(got) == len(ids) * len(values) and set(got.n) == {len(ids)}
    assert sorted(got.component.unique()) == list(range(1, len(values) + 1))
    by_id = dict(zip(ids, deviations, strict=True))
    assert all(int(d) == by_id[i] for i, d in zip(got.vec_id, got.deviation, strict=True))
    first = got.drop_duplicates("component").sort_values("component")
    assert np.allclose(first.explained, values / trace, rtol=1e-9)
    w = got.pivot_table(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    error = np.abs(w.T @ w / len(w) - np.outer(w.mean(0), w.mean(0)) - np.eye(len(values))).max()
    assert error < 1e-9 and set(got.identity_error) == {got.identity_error.iloc[0]} and got.identity_error.iloc[0] < 1e-9
    back = a.T @ w / len(w)  # the covariance times a component, over its deviation: the component times its deviation
    assert np.allclose(np.linalg.norm(back, axis=0), np.sqrt(values), rtol=1e-9)
    assert np.allclose((a.T @ (a @ back) / len(w)), back * values, rtol=1e-9, atol=1e-7 * values[0] * np.sqrt(values[0]))
    return w, a, components, values


def test_query(spark):
    got = queries.queries()["op12_embedding_whitening"](spark, DATA)
    assert dict(got.dtypes)["deviation"] == "bigint"
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{DATA}/embeddings.parquet").to_pylist()]
    w, a, components, values = held(got.toPandas(), rows)
    want = a @ components / np.sqrt(values)
    assert np.allclose(w * np.sign((w * want).sum(0)), want, atol=1e-9)


@pytest.mark.parametrize("kind", ["repeated", "poor", "few", "one", "large"])
def test_shapes(spark, kind):
    """Repeated eigenvalues, fewer dimensions than entries, fewer rows than entries, one entry, and values that exceed longs."""
    rng = np.random.default_rng(5)
    v = {
        "repeated": np.vstack([np.eye(6), -np.eye(6), 2 * np.eye(6)[:1], -2 * np.eye(6)[:1]]),
        "poor": rng.integers(-9, 9, (40, 3)) @ rng.integers(-3, 4, (3, 12)) * 1.0,
        "few": rng.standard_normal((4, 20)),
        "one": rng.standard_normal((9, 1)),
        "large": rng.standard_normal((30, 5)) * 1e9,
    }[kind]
    rows = [(i, r.tolist()) for i, r in enumerate(v)]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    held(got, rows)


def test_edges(spark):
    """Null, ragged and non-finite vectors go; repeated ids and clashing columns stay; equal rows and no rows have no components."""
    good = [(i % 5 if i else None, [float(i), float(i * i % 7), 1.0]) for i in range(20)]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [1.0, float("nan"), 2.0]), (94, [float("inf"), 0.0, 0.0]), (95, [1.0, 2.0])]
    docs = spark.createDataFrame([(*r, 1, 0.5, "x") for r in good + bad], "vec_id int, embedding array<float>, component int, WHITENED double, x string")
    got = whitening.whitened(docs).toPandas()
    assert len(got) == 2 * len(good) and set(got.n) == {len(good)} and got.vec_id.isna().sum() == 2 and not {90, 95} & set(got.vec_id)
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    for none in (same, same.limit(1), same.limit(0), spark.createDataFrame(bad[:2], "vec_id long, embedding array<double>")):
        out = whitening.whitened(none)
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
