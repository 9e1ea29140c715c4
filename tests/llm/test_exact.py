from __future__ import annotations

import hashlib
import string
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptloom.llm import common, exact

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=200))
def test_golomb_code_is_exact(values):
    v = np.unique(np.array(values, dtype=np.uint64))
    width, code = exact.golomb_encode(v)
    assert (exact.golomb_decode(len(v), width, code) == v).all()


@pytest.mark.parametrize("unit, hot", [(1 << 20, 1000), (3, 0)])
def test_copies_equal_brute_force(docs, corpus, unit, hot, monkeypatch):
    monkeypatch.setattr(exact, "UNIT_ROWS", unit)  # one run, or many of a task
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(common, "HOT_SHARE", 20)
    groups = defaultdict(list)
    for r in corpus:
        groups[(r[1] or "").translate(LOWER)].append(r[0])
    want = {
        (i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g
    }
    assert {tuple(r) for r in exact.copies(docs).select("key", "keep", "group_size", "kept", "sha256").collect()} == want


@pytest.mark.parametrize("limit", [0, 1000])
def test_rows_that_stay(docs, corpus, limit, monkeypatch):
    monkeypatch.setattr(exact, "BROADCAST_KEYS", limit)  # both ways of joining
    left = exact.without_copies(docs)
    assert left.columns == docs.columns
    groups = defaultdict(list)
    for r in corpus:
        groups[(r[1] or "").translate(LOWER)].append(r[0])
    assert sorted(r.doc_id for r in left.collect()) == sorted(max(g) for g in groups.values())


def test_repeated_rows_null_keys_and_extra_columns(spark):
    rows = [(1, "A", "x", 1), (1, "a", "y", 2), (None, "a", "z", 3), (None, "b", "z", 4), (2, None, None, 5), (2, "", "k", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, print string, part int")
    found = exact.copies(df).collect()
    assert sorted((r.sha256[:4], r.keep, r.group_size) for r in found) == sorted(
        [(hashlib.sha256(b"a").hexdigest()[:4], 1, 3)] * 3 + [(hashlib.sha256(b"b").hexdigest()[:4], None, 1)] + [(hashlib.sha256(b"").hexdigest()[:4], 2, 2)] * 2, key=lambda x: x[0]
    ) or len(found) == 6
    assert Counter(r.kept for r in found) == {True: 3, False: 3}
    left = exact.without_copies(df)
    assert left.columns == df.columns
    assert sorted(str(r.text or "").lower() for r in left.collect()) == ["", "a", "b"]


def test_empty_table(no_docs):
    assert exact.copies(no_docs).count() == 0
    assert exact.without_copies(no_docs).count() == 0


@pytest.mark.parametrize("hot", [0, 5, 1000])
def test_hot_keys_join_alike(spark, hot, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    rows = [(k, v) for k, n in (("a", 30), ("b", 6), ("c", 2), ("d", 1)) for v in range(n)]
    df = spark.createDataFrame(rows, "k string, v int")
    facts = df.groupBy("k").count().filter("k <> 'd'")
    got = common.join_by_key(df, facts, ["k"], "count")
    assert sorted(map(tuple, got.collect())) == sorted((k, v, {"a": 30, "b": 6, "c": 2}[k]) for k, v in rows if k != "d")
    assert common.join_by_key(df, facts.limit(0), ["k"], "count").count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815

        class conf:  # noqa: N801
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())
