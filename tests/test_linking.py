"""Links within groups against all pairs, with groups that are cut into cells."""

import random

import numpy as np
import pytest

from lumenweir.operators.components import connected_components
from lumenweir.operators.linking import JaccardOfSets, groups_of_keys, spanning_links


def components(nodes, links):
    root = {i: i for i in nodes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in nodes}


@pytest.mark.parametrize(("most", "most_bytes"), [(1024, 1 << 30), (8, 1 << 30), (1024, 3000)])
def test_all_pairs(spark, most, most_bytes):
    """Near copies, chains (each near the next only) and strangers in one large group, others in small and overlapping ones."""
    rng = random.Random(7)
    sets, base = [], rng.sample(range(10**6), 40)
    for k in range(60):  # near copies
        sets.append({*base[: 40 - k % 3], *rng.sample(range(10**6), k % 3)})
    chain = [rng.randrange(10**9) for _ in range(200)]
    sets += [set(chain[i * 3 : i * 3 + 40]) for i in range(40)]
    sets += [set(rng.sample(range(10**6), 30)) for _ in range(40)] + [set(), set()]
    rng.shuffle(sets)
    near = lambda x, y: bool(x | y) and len(x & y) >= 0.8 * len(x | y) - 1e-9
    group = {i: [0] if i < 110 else [i % 5 + 1, i % 3 + 10] for i in range(len(sets))}
    want = components(range(len(sets)), [(i, j) for i in group for j in range(i) if set(group[i]) & set(group[j]) and near(sets[i], sets[j])])
    groups = spark.createDataFrame([(g, i) for i, x in group.items() for g in x], "group long, rep long")
    payloads = spark.createDataFrame([(i, bytearray(np.sort(np.array(list(s), "<u8")).tobytes())) for i, s in enumerate(sets)], "rep long, payload binary")
    links = [tuple(r) for r in spanning_links(groups, payloads, JaccardOfSets(0.8), most, most_bytes).collect()]
    assert components(range(len(sets)), links) == want
    assert len(links) < 4 * len(sets)


def test_groups_of_keys(spark):
    keys = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (2, 6), (3, 7), (4, 6), (4, 8)], "key long, rep long")
    assert {tuple(r) for r in groups_of_keys(keys).collect()} == {(5, 5), (5, 6), (6, 6), (6, 8)}


def test_none(spark):
    groups, payloads = spark.createDataFrame([], "group long, rep long"), spark.createDataFrame([], "rep long, payload binary")
    links = spanning_links(groups, payloads, JaccardOfSets(0.8))
    assert links.count() == 0 and connected_components(links).count() == 0
