"""Near vectors where lists are skipped."""

from __future__ import annotations

import numpy as np

from dialmart.llm import vectors


def test_one_way_probes_find_pairs(spark):
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a = unit(rng.normal(size=(1500, 32)))
    side = rng.normal(size=a.shape)
    side = unit(side - (side * a).sum(1, keepdims=True) * a)
    cos = rng.uniform(0.905, 0.95, (1500, 1))
    x = np.concatenate([a, cos * a + np.sqrt(1 - cos**2) * side])
    s = vectors.Settings(per_list=10, probes=4)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    index = vectors._fit(x, len(x), s)
    assert len(index.lists) == 300
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    rows = {r.vec_id: r for r in vectors.near_vectors(df, s).collect()}
    top = vectors._near(x, index.lists).argsort(1)[:, :4]
    probed = (top[:, :, None] == top[:, 0]).any(1)  # row probes the own list of column
    both = (near & probed & probed.T).sum() / near.sum()
    got = sum(r.n_links for r in rows.values()) / near.sum()
    assert got >= 0.995 > both and all(r.n_links <= near[i].sum() for i, r in rows.items())


def clusters(rng, n, dim):
    """Vectors in clusters of 1 to 80 with cosines around 0.9 inside, and lone ones."""
    out = []
    while len(out) < n:
        base = rng.normal(size=dim)
        size = int(rng.choice([1, 2, 3, 8, 80], p=[0.5, 0.25, 0.15, 0.09, 0.01]))
        spread = rng.uniform(0.1, 0.45)
        out += [base + spread * rng.normal(size=dim) for _ in range(size)]
    return np.array(out[:n])


def recall(spark, x, settings):
    """The share of all pairs of cosine 0.9 that are found, and whether all counts are at most the true ones."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.concatenate([(u[i : i + 1000] @ u.T >= 0.9).sum(1) - 1 for i in range(0, len(u), 1000)])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    rows = {r.vec_id: r.n_links for r in vectors.near_vectors(df, settings).collect()}
    assert all(rows[i] <= near[i] for i in rows)
    return sum(rows.values()) / near.sum()


def test_recall_with_many_more_lists_than_probes(spark):
    x = clusters(np.random.default_rng(6), 20_000, 32)
    found = recall(spark, x, vectors.Settings())
    assert len(vectors._fit(x, len(x), vectors.Settings()).lists) == 200
    print(f"200 lists, 16 probes: recall {found:.4f}")
    assert found >= 0.9


def test_recall_where_lists_are_cut_again(spark):
    x = clusters(np.random.default_rng(7), 12_000, 32)
    settings = vectors.Settings(per_list=20, max_lists=64)
    index = vectors._fit(x, len(x), settings)
    assert (len(index.lists), len(index.parts)) == (64, 10)
    found = recall(spark, x, settings)
    print(f"64 lists in 10 parts each: recall {found:.4f}")
    assert found >= 0.9


def test_lengths_and_ids_are_kept_apart(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.1, 0.0]), (4, [0.0, 0.0, 1.0]), (9, [0.0, 0.1, 1.0]), (5, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in vectors.near_vectors(df).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False), (4, 1, 4, True), (5, 0, 5, True), (9, 1, 4, False)]
