from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptloom.llm import clusters, topk
from scriptloom.llm.vectors import LONG_MAX, LONG_MIN

SCHEMA = "vec_id long, embedding array<double>, cluster int, v string, rank int"


def whole(x: float) -> int:
    return min(max(math.floor(64 * x), LONG_MIN), LONG_MAX)


def fine(v) -> bool:
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def vectors(rng: random.Random, n: int, size: int = 64) -> list:
    """Vectors of lengths that differ, a third of them around one direction, with copies, ties and rows that can't be used."""
    hot = [rng.gauss(0, 1) for _ in range(size)]
    rows = []
    for i in range(n):
        v = [x + rng.gauss(0, 0.05) for x in hot] if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(size)]
        scale = rng.choice([0.02, 0.5, 1, 1, 30]) / math.sqrt(sum(x * x for x in v))
        rows.append((i, [x * scale for x in v]))
    rows += [(5, rows[5][1]), (5, rows[5][1]), (n, rows[0][1]), (None, rows[3][1]), (None, None), (n + 1, None), (n + 2, [None] * size), (n + 3, []), (n + 4, [math.nan] + [0.0] * (size - 1))]
    rows += [(n + 5, [math.inf] + [1.0] * (size - 1)), (n + 6, [0.0] * size), (n + 7, [1.0, 2.0]), (n + 8, [3.0, -1.0]), (40, [0.5] * (size + 1)), (n + 9, []), (60, []), (80, [1.0, 1.0])]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", None) for i, v in rows], SCHEMA)


def brute_top(rows: list, k: int, every: int = 20) -> list:
    have = [(i, [whole(x) for x in v]) for i, v in rows if fine(v)]
    out = []
    for a, (i, q) in enumerate(have):
        if i is None or i % every:
            continue
        scores = [(-min(max(sum(x * y for x, y in zip(q, v, strict=True)), LONG_MIN), LONG_MAX), j is None, j or 0) for b, (j, v) in enumerate(have) if a != b and len(v) == len(q)]
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("cell, seeds, limits", [(8192 * 64, 4096, None), (40 * 64, 30, None), (25 * 64, 25, [0.0])])
def test_products_equal_brute_force(spark, rng, monkeypatch, cell, seeds, limits):
    from pyspark.sql import functions as F

    monkeypatch.setattr(topk, "CELL", cell)  # one bucket of a class, or many
    monkeypatch.setattr(topk, "SEEDS", seeds)
    if limits:
        monkeypatch.setattr(topk, "LIMITS", np.array(limits))
        monkeypatch.setattr(topk, "SHARE", 2.0)  # every query by its coordinates
    rows = vectors(rng, 300)
    got = topk.top_products(frame(spark, rows), F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, got), key=repr) == brute_top(rows, topk.K)


def test_products_beyond_64_bits_and_no_vectors(spark):
    from pyspark.sql import functions as F

    rows = [(0, [1e30, 1.0]), (20, [1e30, -1e30]), (1, [-1e30, 2.0]), (2, [1e17, 3.0]), (3, [0.25, -0.5])]
    got = topk.top_products(frame(spark, rows), F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, got), key=repr) == brute_top(rows, topk.K)
    for none in ([], [(0, None)], [(1, [1.0, 2.0])], [(0, [1.0])]):
        assert topk.top_products(frame(spark, none), F.col("vec_id") % 20 == 0).collect() == []


def test_coordinates_never_lose_an_answer(rng):
    r = np.random.default_rng(3)
    v = r.normal(0, 1, (400, 8))
    v[:150] = v[0] + r.normal(0, 0.02, (150, 8))
    norm = np.sqrt((v * v).sum(axis=1))
    index, unit = topk._Coordinates(v, norm), v / norm[:, None]
    for i in range(0, 400, 7):
        for cosine in (0.1, 0.5, 0.9, 0.99, 1.0):
            near = set(np.flatnonzero(unit @ unit[i] >= cosine + 1e-12).tolist())
            found = set(index.within(unit[i], cosine).tolist())
            assert near <= found
    assert topk.local_limit(index, unit[200:232]) <= 1.0  # some threshold prunes by coordinates
    assert len(index.within(unit[300], 0.95)) < 60


def brute_clusters(rows: list, k: int = 16, rounds: int = 3) -> list:
    have = [(i, tuple(whole(x) for x in v)) for i, v in rows if fine(v) and len(v) == 64]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centroids = [list(v) for _, v in sorted(have, key=lambda r: (name(r[0]), r[1]))[:k]]
    place = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [place(v)[1] for _, v in have]
        for j in range(len(centroids)):
            if members := [v for (_, v), o in zip(have, own, strict=True) if o == j]:
                centroids[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    found = [(i, *place(v)) for i, v in have]
    clip = lambda x: min(x, LONG_MAX)
    each = [clip(sum(clip(d) for _, d, c in found if c == j)) for j in range(len(centroids))]
    total = clip(sum(each))
    return sorted([(i, c, clip(d), each[c], total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, d, c in found], key=repr)


@pytest.mark.parametrize("n", [200, 4])
def test_clusters_equal_brute_force(spark, rng, n):
    rows = [r for r in vectors(rng, max(n, 10)) if n > 10 or (r[0] or 0) < n]
    found = clusters.with_inertia(*clusters.centroid_clusters(frame(spark, rows)))
    assert sorted(map(tuple, found.collect()), key=repr) == brute_clusters(rows)


def test_clusters_of_none_of_copies_and_of_large_numbers(spark):
    same = [(i, [0.1] * 64) for i in range(40)]
    large = [(i, [10.0 ** (i % 20)] + [-(10.0 ** (i % 17))] * 63) for i in range(50)]
    for rows in ([], [(1, None)], same, large):
        found = clusters.with_inertia(*clusters.centroid_clusters(frame(spark, rows)))
        assert sorted(map(tuple, found.collect()), key=repr) == brute_clusters(rows)


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_nearest_equals_all_distances(data):
    r = np.random.default_rng(data.draw(st.integers(0, 10**6)))
    top = data.draw(st.sampled_from([1, 2, 50, 2**25, 2**40]))
    v, c = r.integers(-top, top, (40, 64), endpoint=True), r.integers(-top, top, (data.draw(st.integers(1, 16)), 64), endpoint=True)
    c[len(c) // 2] = c[0]  # equal centroids
    v[: len(c)] = c[: len(v)]
    number, distance = clusters.nearest(v, c, r.permutation(64))
    for row, j, d in zip(v.tolist(), number, distance, strict=True):
        assert (d, j) == min((sum((x - y) ** 2 for x, y in zip(row, own, strict=True)), i) for i, own in enumerate(c.tolist()))
