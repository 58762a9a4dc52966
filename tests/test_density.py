"""Clusters by density against a plain implementation over all pairs, and the reduction against numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from interlake.operators import density


def plain_clusters(x: np.ndarray, least: int, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels and probabilities of rows: all pairs, Kruskal, one recursive tree. Equal rows are rows of their own."""
    n = len(x)
    d = np.sqrt(np.square(x[:, None, :] - x[None, :, :]).sum(-1))
    core = np.sort(d, axis=1)[:, min(samples, n - 1)]
    kinds, first = np.unique(x, axis=0, return_index=True)
    rep = {tuple(k): int(np.flatnonzero((x == k).all(1))[0]) for k in kinds}
    ids = [rep[tuple(r)] for r in x]
    edges = []
    for i in range(n):  # copies join at their core distance before anything else
        for j in range(i):
            if ids[i] != ids[j]:
                edges.append((max(d[i, j], core[i], core[j]), 1, min(ids[i], ids[j]), max(ids[i], ids[j]), i, j))
            elif ids[i] == j:
                edges.append((core[i], 0, j, j, i, j))
    edges.sort()
    root, members, top = list(range(n)), {i: [i] for i in range(n)}, {}
    parent, area, size, death, fall = {}, {}, {}, {}, {}
    copies = {}
    for i in ids:
        copies[i] = copies.get(i, 0) + 1

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def leave(points, cluster, level):
        for p in points:
            fall[p] = (cluster, level)
            size[cluster] = size.get(cluster, 0) + 1
            area[cluster] = area.get(cluster, 0.0) + level
            death[cluster] = max(death.get(cluster, 0.0), level)

    number = 0
    whole = {}
    for w, kind, _, _, i, j in edges:
        a, b = find(i), find(j)
        if a == b:
            continue
        level = 1 / max(w, density.LEAST)
        root[b] = a
        both = members[a] + members[b]
        if kind == 0 and len(both) < copies[ids[i]]:  # all copies of a row join as one
            members[a] = both
            continue
        ca, cb = top.get(a), top.get(b)
        if ca is not None and cb is not None:
            number += 1
            for c in (ca, cb):
                parent[c] = (number, level)
            size[number], area[number], death[number] = len(both), len(both) * level, level
            top[a] = number
        elif ca is None and cb is None:
            if len(both) >= least:
                number += 1
                leave(both, number, level)
                top[a] = number
        else:
            keep, lost = (ca, members[b]) if ca is not None else (cb, members[a])
            leave(lost, keep, level)
            top[a] = keep
        members[a] = both
    stable = {c: area[c] - size[c] * parent.get(c, (0, 0.0))[1] for c in size}
    children = {c: [k for k, (p, _) in parent.items() if p == c] for c in size}
    value, best = {}, {}
    for c in sorted(size):  # children have smaller numbers
        below = sum(value[k] for k in children[c])
        best[c] = c in parent and stable[c] >= below
        value[c] = stable[c] if best[c] else below
    labels, probs = np.full(n, -1), np.zeros(n)
    names = {}
    for p in range(n):
        if p not in fall:
            continue
        c, level = fall[p]
        chosen = None
        while True:
            chosen = c if best[c] else chosen
            if c not in parent:
                break
            c = parent[c][0]
        if chosen is not None:
            labels[p] = names.setdefault(chosen, len(names))
            probs[p] = min(level, death[chosen]) / death[chosen]
    return labels, probs


def blobs(seed: int, n: int = 500, dims: int = 6) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((7, dims)) * 6
    x = np.concatenate([centres[rng.integers(0, 7, n - 60)] + rng.standard_normal((n - 60, dims)) * rng.uniform(0.2, 1.5, (n - 60, 1)), rng.uniform(-12, 12, (60, dims))])
    return np.round(x, 6)


@pytest.mark.parametrize(("seed", "least", "samples"), [(1, 15, 5), (2, 30, 10), (3, 8, 3)])
def test_equals_all_pairs(spark, seed, least, samples):
    x = blobs(seed)
    if seed == 3:  # copies: few of some, more than a cluster of one
        x = np.concatenate([x[:420], x[:30], np.repeat(x[100:101], 25, 0), np.repeat(x[450:451], 20, 0)])
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, embedding array<double>").repartition(3)
    got = {r["id"]: r for r in density.density_clusters(table, min_cluster_size=least, min_samples=samples).collect()}
    labels, probs = plain_clusters(x, least, samples)
    found = np.array([got[i]["cluster"] for i in range(len(x))])
    assert len(set(labels)) > 4 and (labels == -1).any()
    assert found.tolist() == labels.tolist()
    assert np.abs(np.array([got[i]["prob"] for i in range(len(x))]) - probs).max() < 1e-9


def test_windows_find_separate_groups_beyond_one_window(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 16)) * 20
    own = rng.integers(0, 6, 900)
    x = centres[own] + rng.standard_normal((900, 16))
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, embedding array<double>").repartition(4)
    got = {r["id"]: r["cluster"] for r in density.density_clusters(table, min_cluster_size=30, min_samples=5, window=200, tables=6).collect()}
    pairs = {(int(own[i]), c) for i, c in got.items() if c >= 0}
    assert len(pairs) == 6 and len({c for _, c in pairs}) == 6 and sum(c < 0 for c in got.values()) < 90


def test_unusable_few_and_no_rows(spark):
    schema = "id long, embedding array<double>, cluster string, x string"
    rows = [(1, None), (2, []), (3, [math.nan, 1.0]), (4, [None, 1.0]), (5, [1.0]), (6, [1.0, 2.0]), (7, [1.0, 2.0]), (None, [5.0, 5.0])]
    got = density.density_clusters(spark.createDataFrame([(*r, "c", "x") for r in rows], schema), min_cluster_size=2, min_samples=1).collect()
    assert len(got) == 8 and {(r["cluster"], r["prob"]) for r in got if r["id"] in (1, 2, 3, 4, 5)} == {(-1, 0.0)}
    assert density.density_clusters(spark.createDataFrame([], schema)).collect() == []
    alike = spark.createDataFrame([(i, [1.0, 2.0], "c", "x") for i in range(9)], schema)
    assert {r["cluster"] for r in density.density_clusters(alike, min_cluster_size=3, min_samples=2).collect()} == {-1}  # one tree's root is no cluster


def test_reduction_equals_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 20)) * np.linspace(5, 0.1, 20) + 3
    table = spark.createDataFrame([*[(i, v) for i, v in enumerate(x.tolist())], (999, None)], "id long, embedding array<double>").repartition(3)
    got = {r["id"]: r["embedding"] for r in density.reduced(table, dims=7).collect()}
    assert got[999] is None and len(got[0]) == 7
    y = np.array([got[i] for i in range(300)])
    centre = x - x.mean(0)
    values, vectors = np.linalg.eigh(centre.T @ centre)
    want = centre @ vectors[:, ::-1][:, :7]
    assert np.abs(np.linalg.norm(y[:150] - y[150:], axis=1) - np.linalg.norm(want[:150] - want[150:], axis=1)).max() < 1e-6
    assert np.abs(np.array(density.explained_variance(table, dims=7)) - values[::-1][:7] / values.sum()).max() < 1e-6
    assert density.reduced(table, dims=20) is table


def test_rows_that_stand_for_many_equal_ones(spark):
    """A vector with a count is that many rows of it, in the clusters and in the reduction; nearest rows are those that count."""
    x = blobs(5, 300)
    times = np.random.default_rng(5).integers(1, 9, len(x))
    few = spark.createDataFrame([(i * 10, v, int(n)) for i, (v, n) in enumerate(zip(x.tolist(), times, strict=True))], "id long, embedding array<double>, times long").repartition(3)
    many = spark.createDataFrame([(i * 10 + j, v) for i, (v, n) in enumerate(zip(x.tolist(), times, strict=True)) for j in range(n)], "id long, embedding array<double>")
    a = {r["id"]: (r["cluster"], round(r["prob"], 9)) for r in density.density_clusters(few, times="times", min_cluster_size=20, min_samples=6).collect()}
    b = {r["id"]: (r["cluster"], round(r["prob"], 9)) for r in density.density_clusters(many, min_cluster_size=20, min_samples=6).collect()}
    assert {i: b[i] for i in a} == a and len({c for c, _ in a.values()}) > 3
    a = {r["id"]: r["embedding"] for r in density.reduced(few, 3, times="times").collect()}
    b = {r["id"]: r["embedding"] for r in density.reduced(many, 3).collect()}
    far = lambda got: [math.dist(got[i], got[i + 10]) for i in range(0, 2990, 10)]  # noqa: E731  signs are free
    assert np.abs(np.array(far(a)) - np.array(far(b))).max() < 1e-9


def test_nearest_rows_of_windows_hold_the_core_distance():
    """No more than what a core distance needs is sent: nothing for rows with enough copies."""
    rng = np.random.default_rng(7)
    x, n, ids = rng.standard_normal((700, 4)), rng.integers(1, 14, 700), np.arange(700) * 3
    got = {r["id"]: r["near"] for r in density.nearest(ids, n, np.zeros(700), x, k=24, least=10).to_pylist()}
    assert set(got) == set(ids[n <= 10].tolist())
    for i in np.flatnonzero(n <= 10):
        d = np.sqrt(np.square(x - x[i]).sum(1))
        order = [j for j in np.argsort(d) if j != i]
        last = int(np.flatnonzero(np.cumsum(n[order]) >= 10 - (n[i] - 1))[0])
        assert [r["other"] for r in got[i * 3]] == ids[order[: last + 1]].tolist() and got[i * 3][-1]["d"] == d[order[last]]
