"""Stars of a block's components against union-find, and a dense block in time."""

import time

import numpy as np
import pytest

from trajlake.llm import embedding_dedup
from trajlake.llm.components import block_stars, forest


def classes(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = {}
    for n in nodes:
        groups.setdefault(find(n), set()).add(n)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("density", [0.0, 0.01, 0.05, 0.5, 1.0])
def test_stars_span_the_components(density):
    rng = np.random.default_rng(int(density * 100))
    for same in (False, True):
        links = rng.random((40, 40 if same else 30)) < density
        if same:
            links |= links.T
            np.fill_diagonal(links, False)
        name = lambda k, column: k if same or not column else 1000 + k  # noqa: E731, B023
        nodes = [name(k, False) for k in range(40)] + ([] if same else [name(k, True) for k in range(30)])
        index, column, stands = block_stars(links, same)
        stars = [(name(i, c), s) for i, c, s in zip(index.tolist(), column.tolist(), stands.tolist(), strict=True)]
        a, b = np.nonzero(links)
        assert classes(stars, nodes) == classes([(name(i, False), name(j, True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)], nodes)
        assert len(stars) == len(nodes) - len(classes(stars, nodes)) == len(forest(a, b if same else b + 1000))


def test_a_dense_block_takes_no_time():
    began = time.perf_counter()
    index, _, _ = block_stars(np.ones((4000, 4000), bool), False)
    assert len(index) == 7999 and time.perf_counter() - began < 5


def test_dense_group_of_vectors(spark):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=16)
    vectors = [(k, (centre + rng.normal(0, 0.05, 16)).tolist(), 0) for k in range(3000)]
    out = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").repartition(8)).collect()
    x = embedding_dedup.unit(np.array([v[1] for v in vectors]))
    links = (x @ x.T >= 0.93).sum(axis=1) - 1
    assert {r["id"]: r["n_links"] for r in out} == dict(enumerate(links.tolist()))
    assert {r["component_id"] for r in out if r["n_links"]} == {0}
