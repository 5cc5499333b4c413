"""The threshold join of vectors against all pairs."""

import numpy as np
import pytest
from test_linking import components

from lumenweir.operators import similarity


def brute(rows, least):
    """(id, class_id, n_links) of rows (id, vector)."""
    some = [i for i, (_, v) in enumerate(rows) if v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([rows[i][1] for i in some], float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= least) & ~np.eye(len(u), dtype=bool)
    root = components(range(len(some)), zip(*np.nonzero(near), strict=True))
    least_id = {}
    for k, i in enumerate(some):
        least_id[root[k]] = min(rows[i][0], least_id.get(root[k], rows[i][0]))
    out = {i: (rows[i][0], least_id[root[k]], int(near[k].sum())) for k, i in enumerate(some)}
    return sorted(out.get(i, (r[0], r[0], 0)) for i, r in enumerate(rows))


@pytest.mark.parametrize(("least", "most"), [(0.9, 1024), (0.9, 40), (0.99, 40), (0.5, 25), (-0.2, 1000)])
def test_all_pairs(spark, least, most):
    """Groups of near copies, a chain, copies, strangers, and rows that can have no links."""
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((6, 8))
    v = [c + 0.25 * rng.standard_normal(8) * rng.random() for c in centers for _ in range(40)]
    v += [np.r_[np.cos(t), np.sin(t), np.zeros(6)] for t in np.linspace(0, 1.5, 30)]
    v += [v[0]] * 25 + [2 * v[1]] + list(rng.standard_normal((60, 8)))
    rows = [(int(i), [float(c) for c in x]) for i, x in zip(rng.permutation(len(v)), v, strict=True)]
    rows += [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0] * 7 + [float("nan")]), (904, [1.0] * 7), (905, [1.0] * 7 + [None]), (5, rows[3][1])]
    got = similarity.similar_vectors(spark.createDataFrame(rows, "id long, vec array<double>"), least, most).toPandas()
    assert sorted(got[["id", "class_id", "n_links"]].itertuples(index=False, name=None)) == brute(rows, least)
    pairs, n = got.n_compared.sum() / 2, len(v)
    if least == 0.99:
        assert pairs < 0.25 * n * n / 2  # the bounds discard most


def test_regions_bound_what_is_sent(spark):
    """However many cells of a region a vector is a guest of, it is sent there once; each pair within the bound meets once."""
    rng = np.random.default_rng(4)
    units = rng.standard_normal((600, 8))
    units /= np.linalg.norm(units, axis=1)[:, None]
    refs, radius = similarity.references(units, 24), float(np.sqrt(2 - 2 * 0.9))
    members = spark.createDataFrame([(i, u.astype("<f8").tobytes()) for i, u in enumerate(units)], "rep long, unit binary")
    rows = {k: [tuple(r) for r in similarity._placed(members, refs, radius, k).collect()] for k in (1, 6)}
    assert len(rows[6]) <= 4 * len(units) and len(rows[6]) < 0.5 * len(rows[1])
    held = {}
    for rep, _, region, guest in rows[6]:
        held.setdefault(region, ([], []))[guest].append(rep)
    met = {}
    for homes, guests in held.values():
        for i, a in enumerate(homes):
            for b in homes[i + 1 :] + guests:
                met[frozenset((a, b))] = met.get(frozenset((a, b)), 0) + 1
    near = units @ units.T >= 0.9
    assert all(met[frozenset((a, b))] == 1 for a, b in zip(*map(np.ndarray.tolist, np.nonzero(np.triu(near, 1))), strict=True))


def test_none(spark):
    for rows in ([], [(1, None), (2, [0.0])]):
        got = similarity.similar_vectors(spark.createDataFrame(rows, "id long, vec array<float>"), 0.9)
        assert sorted(tuple(r) for r in got.collect()) == [(i, i, 0, 0) for i, _ in rows]
