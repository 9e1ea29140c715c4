from __future__ import annotations

import re

import numpy as np

from scriptloom.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """doc_id -> (kept words, removed) by comparing every window's words."""
    split = [(r[0], WORD.findall(r[1] or "")) for r in rows]
    first = {}
    for i, w in split:
        if i is not None:
            for p in range(len(w) - 49):
                k = tuple(w[p : p + 50])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in split:
        gone = set()
        if i is not None:
            for p in range(len(w) - 49):
                if first[tuple(w[p : p + 50])] < i:
                    gone.update(range(p, p + 50))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in substrings.without_repeats(df).collect()), key=str)


def test_against_brute_force(docs, corpus):
    assert got(docs) == brute(corpus)
    assert any(r[2] for r in brute(corpus))


def test_both_ways_of_joining(docs, corpus, monkeypatch):
    monkeypatch.setattr(substrings, "BROADCAST_KEYS", 0)
    assert got(docs) == brute(corpus)


def test_repeats_within_one_document_and_odd_rows(spark):
    run = " ".join(f"w{i}" for i in range(70))
    rows = [(5, f"{run} x {run}", 1), (3, run + " y", 2), (3, run, 3), (None, run, 4), (9, "x " + run, 5), (None, None, 6), (1, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, starts int")
    assert got(df) == brute(rows)
    assert substrings.without_repeats(df).columns[0] == "text"


def test_common_words(spark):
    rows = [(i, " ".join(["the"] * n)) for i, n in enumerate([49, 50, 51, 200, 3])]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_empty_table(no_docs):
    assert substrings.without_repeats(no_docs).count() == 0


def test_intervals_are_maximal():
    starts, ends = substrings.merged(np.array([3, 0, 1, 53, 200]))
    assert starts.tolist() == [0, 200] and ends.tolist() == [103, 250]
