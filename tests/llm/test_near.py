from __future__ import annotations

from math import comb

import numpy as np
import pytest

from scriptloom.llm import near
from scriptloom.llm.components import components


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    n = len(rows)
    links = {i: set() for i in range(n)}
    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                links[i].add(j)
                links[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        keys = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], min(keys) if keys else None, len(links[i])))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.key, r.class_id, r.n_links) for r in near.near_duplicates(df).collect()), key=str)


def test_against_brute_force(docs, corpus):
    assert got(docs) == brute(corpus)
    assert max(x[2] for x in brute(corpus)) >= 8


@pytest.mark.parametrize("blocks", [(2, 2), (3, 5)])
def test_blocks_lose_nothing(docs, corpus, blocks, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", blocks[0])
    monkeypatch.setattr(near, "EXACT_BLOCK", blocks[1])
    monkeypatch.setattr(near, "BROADCAST_KEYS", 0)
    assert got(docs) == brute(corpus)


def test_odd_rows(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(4, t, 1), (4, t, 2), (None, t + " end", 3), (7, None, 4), (None, "", 5), (2, "a b", 6), (3, " a  b ", 7), (9, t.replace("w39", "x"), 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int")
    assert got(df) == brute(rows)
    left = near.one_of_each(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == [2, 4, 7, None]


def test_one_of_each(docs, corpus):
    keys = [r.doc_id for r in near.one_of_each(docs).collect()]
    assert sorted(keys) == sorted({c for _, c, _ in brute(corpus)})


def test_empty_table(no_docs):
    assert near.near_duplicates(no_docs).count() == 0
    assert near.one_of_each(no_docs).count() == 0


def test_thresholds_are_the_posterior():
    for k, least in near.least_matches():
        tail = lambda m: sum(comb(k + 1, j) * 0.8**j * 0.2 ** (k + 1 - j) for j in range(m + 1))  # noqa: E731, B023
        assert tail(least) >= near.TOLERANCE and (least == 0 or tail(least - 1) < near.TOLERANCE)


def test_pairs_of_large_sets_by_incidence():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: 60 - i % 9], rng.integers(0, 2**63, i % 9).astype(np.uint64)])) for i in range(20)]
    want = {(i, j) for j in range(20) for i in range(j) if 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))}
    assert set(zip(*(x.tolist() for x in near.linked(sets, sets, True)))) == want
    assert set(zip(*(x.tolist() for x in near.linked(sets[:9], sets[9:], False)))) == {(i, j - 9) for i, j in want if i < 9 <= j}


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (7, 7), (200, 201), (201, 200)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 200: 200, 201: 200}
