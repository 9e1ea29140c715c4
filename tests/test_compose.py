from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scriptloom.functions import compose as C


def one(spark, value, column, schema="text string"):
    return spark.createDataFrame([(value,)], schema).select(column.alias("x")).first().x


def test_key_points(spark):
    assert one(spark, "The speaker explains how families react.", C.key_point(F.col("text"))) == "Explains how families react"
    assert one(spark, "He left here.", C.key_point(F.col("text"))) is None
    text = "Short one. This describes the way in which triangles form. It is about the balance of two forces! " + "x" * 300 + "."
    assert one(spark, text, C.key_points(F.col("text"))) == ["Describes the way in which triangles form", "Is about the balance of two forces!"]
    docs = spark.createDataFrame([(1, "## Section 1 a\nPlain words. The key concept is balance.\n## Section 2 b\nIt is obviously about two forces in life.\n## Section 3 c\nThe key thing is out.", "1-2")], "doc_id long, text string, sections string")
    assert C.section_points(docs).first().points == ["The key concept is balance", "Is obviously about two forces in life"]


def test_quotes(spark):
    long = " ".join(["filler"] * 100) + ". Lee said that it is one. " + " ".join(["tail"] * 100) + "."
    assert one(spark, long, C.compact_quote(F.col("text"), "Lee")).startswith("Lee said that it is one. tail")
    assert one(spark, "a  b", C.compact_quote(F.col("text"), "Lee")) == "a b"
    assert one(spark, "w " * 200, C.compact_quote(F.col("text"), "Lee")).endswith("w...")
    assert one(spark, "## References\n\n---\n1. first\n> - second\n\n", C.quote_block(F.col("text"), "References")) == "> first\n> second"
    got = one(spark, [("A ", 'he said "x"'), ("", "y")], C.quote_lines(F.col("q")), "q array<struct<label:string,quote:string>>")
    assert got == "> **Reference - A:** \"he said 'x'\""


def test_summary_and_names(spark):
    assert one(spark, "---\na: b\n---\n# Summary\n\nBody here.\n\n## Next\nx", C.summary_body(F.col("text"))) == "Body here."
    m = one(spark, "A - B.txt", C.loose_metadata(F.col("text")))
    assert (m.title, m.presenter, m.date) == ("A", "B", "")
    assert one(spark, ["a word about life, on love? on x. z"], C.question_types(F.col("c")), "c array<string>") == ["life", "love"]


@pytest.mark.parametrize("kind, text, ok", [("Topics", "### A\nx", True), ("topics", "", False), ("themes", "1. **A**: b", True), ("Key Terms", "**A**: b", True), ("Key Terms", "a b", False), ("other", "x", True), ("other", "Please provide the full document", False), ("structural themes", "### x", True)])
def test_valid_sections(spark, kind, text, ok):
    df = spark.createDataFrame([(kind, text)], "k string, t string")
    assert df.select(C.valid_section(F.col("k"), F.col("t")).alias("x")).first().x is ok


def test_joins(spark):
    quotes = spark.createDataFrame([(1, 0, "emphasis", "the family is a unit"), (1, 1, "emphasis", "nothing alike at all")], "doc_id long, ordinal int, category string, quote string")
    marks = spark.createDataFrame([(1, "emphasis", "family is a unit"), (1, "other", "nothing alike at all")], "doc_id long, type string, text string")
    got = {r.ordinal: (r.matched, r.best_text) for r in C.best_highlights(quotes, marks).collect()}
    assert got[0] == (True, "family is a unit") and got[1][0] is False
    parts = spark.createDataFrame([(1, "p", "is a"), (1, "q", "zzz")], "doc_id long, label string, quote string")
    wholes = spark.createDataFrame([(1, 1, "second", "that is a fact"), (1, 0, "first", "this is a fact")], "doc_id long, ordinal int, label string, quote string")
    assert {r.label: r.into for r in C.first_container(parts, wholes).collect()} == {"p": "first", "q": None}


def test_verdicts_and_canonical_quotes(spark):
    v = one(spark, 'ok {"valid": true, "issues": [], "top_lens": {"name": "L", "hooks": ["h"]}}', C.lens_verdict(F.col("text")))
    assert v.valid and v.top_lens.hooks == ["h"]
    assert one(spark, "junk", C.lens_verdict(F.col("text"))).valid is False
    rows = [("s", "refs", '> **A:** "x"'), ("s", "all", '> **B:** "y"'), ("t", "all", '## References\n> **C:** "z"\n## Other\n> **D:** "w"'), ("u", "all", "none")]
    got = C.canonical_quotes(spark.createDataFrame(rows, "stem string, kind string, text string"), "refs", "all", "References").collect()
    assert {(r.stem, r.label) for r in got} == {("s", "A"), ("t", "C")}
