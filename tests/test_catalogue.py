"""Every query against its DuckDB oracle on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from scriptloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(cell(v) for v in r) for r in frame[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_oracle(spark, tables, name):
    assert rows(catalogue.queries()[name](spark, DATA).toPandas()) == rows(tables.sql(catalogue.oracle_sql()[name]).df())


def test_only_similarity_of_found_passages_has_no_oracle():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"fuzzy_grounding"}


def test_passages_with_a_changed_word(spark, tables):
    """Against difflib, window by window."""
    from difflib import SequenceMatcher

    from scriptloom.functions.similarity import normalize

    got = {(r.item_id, r.doc_id): (round(r.ratio, 6), r.result) for r in catalogue.queries()["fuzzy_grounding"](spark, DATA).collect()}
    want = {}
    for item, doc, claim, text in tables.sql("SELECT item_id, doc_id, b.text, d.text FROM benchmark b JOIN documents d ON contains(d.text, b.text)").fetchall():
        words = claim.split()[:15]
        probe = normalize(" ".join([*words[:4], "changed", *words[5:]]))
        have, n, best = normalize(text).split(), len(words), 0.0
        for i in range(len(have) - n + 1):
            r = SequenceMatcher(None, probe, " ".join(have[i : i + n])).ratio()
            if r > best and r >= 0.85:
                best = r
                if r >= 0.98:
                    break
        want[(item, doc)] = (round(best, 6), "VALID" if best >= 0.95 else "PARTIAL" if best >= 0.8 else "INVALID")
    assert got == want and got
