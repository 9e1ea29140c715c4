"""Queries and operators over inputs where less than the whole job would show."""

from __future__ import annotations

import pytest

from scriptloom.operators import grounding
from scriptloom.plans import catalogue


def test_prompts_hold_whole_texts(spark, tmp_path):
    texts = [(1, "word " * 300 + "\n\nlast paragraph of all"), (2, "x" * 5000), (3, "short text")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.output_tokens for r in catalogue.queries()["offline_completion"](spark, str(tmp_path)).collect()}
    assert got == {1: len("lastparagraphofall") // 4, 2: 5000 // 4, 3: len("shorttext") // 4}


@pytest.mark.parametrize("everywhere", [10_000, 0])
def test_claims_are_found_wherever_texts_hold_them(spark, everywhere, monkeypatch):
    monkeypatch.setattr(grounding, "EVERYWHERE", everywhere)
    claims = ["Where are the keys now", "Where are", "keys", " padded claim", "padded claim ", "a\u2003b c", "", None, "ey", "k", "the the the", "Where are the keys now"]
    texts = ['He asked "Where are the keys now?"', "(Where are the keys nowhere)", "-Where are the  keys now", "monkeyskin", "x padded claim y", "xpadded claimy", "za\u2003b cz", "", None, "bathe the them", "Where are"]
    left = spark.createDataFrame(list(enumerate(claims)), "item_id long, claim string")
    right = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.item_id, r.doc_id) for r in grounding.exact_grounding(left, right, "claim").collect())
    assert got == sorted((i, j) for i, c in enumerate(claims) for j, t in enumerate(texts) if c is not None and t is not None and c in t)
