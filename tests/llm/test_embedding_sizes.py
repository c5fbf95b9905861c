"""Links of embeddings don't depend on how many rows there are."""

import numpy as np

from meridian.llm.embedding_dedup import cell_keys, near_duplicate_vectors


def _pairs(n, cosine, seed=5):
    g = np.random.default_rng(seed)
    u, v = g.normal(size=(2, n, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v -= (v * u).sum(axis=1, keepdims=True) * u
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return u, cosine * u + np.sqrt(1 - cosine * cosine) * v


def _meet(u, v, lattice):
    a, b = (cell_keys(x, *lattice, 2.5) for x in (u, v))
    return (a[:, :, None] == b[:, None, :]).any(axis=(1, 2))


def test_what_cells_of_large_tables_find_is_found_in_small_ones(spark):
    """These pairs were linked where a label had more than 100,000 vectors and not where it had fewer."""
    u, v = _pairs(6000, 0.9301)
    some = np.flatnonzero(~_meet(u, v, (6, 2, 2)))
    some = some[_meet(u[some], v[some], (10, 3, 3))]
    assert len(some) > 3
    rows = [(2 * int(i) + k, x[i].tolist(), 1) for i in some for k, x in enumerate((u, v))]
    alone = near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    want = {int(2 * i + k): (1, int(2 * i)) for i in some for k in (0, 1)}
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in alone} == want
    others = np.random.default_rng(8).normal(size=(3000, 64))
    rows += [(100_000 + i, x.tolist(), 1) for i, x in enumerate(others)]
    among = near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).where("vec_id < 100000").collect()
    assert sorted(map(tuple, among)) == sorted(map(tuple, alone))
