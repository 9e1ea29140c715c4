from __future__ import annotations

import html
import re

import pytest
from pyspark.sql import functions as F

from scriptloom.functions import parse, similarity
from scriptloom.functions import text as X


def one(spark, value, column, schema="text string"):
    return spark.createDataFrame([(value,)], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, plain, aggressive",
    [
        ("Tom &amp; Anna: <b>Hello</b>", "tom & anna: hello", "tom & anna hello"),
        ("[00:00:00] Start", "start", "start"),
        ("at 10:00am we 1:10:10 met", "at we met", "at we met"),
        ("**Dr. Who:** Speaker 12: yes, no", "**dr. who:** speaker 12: yes, no", "yes no"),
        ("a\u00a0b\t\nc", "a b c", "a b c"), ("", "", ""),
    ],
)
def test_normalize(spark, text, plain, aggressive):
    assert one(spark, text, X.normalize(F.col("text"))) == plain
    assert one(spark, text, X.normalize(F.col("text"), True)) == aggressive
    assert similarity.normalize(text) == plain and similarity.normalize(text, True) == aggressive


def test_words_and_keys(spark):
    assert one(spark, " a\u00a0b  c ", X.words(F.col("text"))) == ["a", "b", "c"]
    assert one(spark, "**Hello,**", X.normalize_word(F.col("text"))) == "hello"
    assert one(spark, "The Theory of theory really grows, grows schön", X.keywords(F.col("text"))) == ["theory", "grows"]
    assert one(spark, "Talk_v2_validated", X.logical_key(F.col("text"))) == "Talk"
    assert one(spark, "Talk_v12", X.version(F.col("text"))) == 12


@pytest.mark.parametrize(
    "name, want",
    [
        ("A - B - May 2020.txt", ("A", "B", "May 2020", "2020")), ("On x - y - Ann Lee - 2019-01-02 - formatted.md", ("On x - y", "Ann Lee", "2019-01-02", "2019")),
        ("no parts.txt", None), ("A - B - May.txt", None),
    ],
)
def test_file_metadata(spark, name, want):
    got = one(spark, name, X.file_metadata(F.col("text")))
    assert (got and (got.title, got.presenter, got.date, got.year)) == want


@pytest.mark.parametrize("name, want", [("../../etc/passwd", "passwd"), ("/a/b.txt", "b.txt"), ("a\x00b", "ab"), ("..", None), ("", None), ("x" * 256, None), ("Ünïcode.md", "Ünïcode.md"), ("c:\\x\\y.txt", "y.txt")])
def test_safe_file_names(spark, name, want):
    assert one(spark, name, X.safe_file_name(F.col("text"))) == want


def loop_chunks(n, size, overlap):
    out, start = [], 0
    while start < n:
        last = n - start < size * 1.3  # under 30 % of a chunk would be left
        out.append((len(out), start, n if last else start + size))
        if last:
            break
        start += size - overlap
    return out


@pytest.mark.parametrize("size, overlap", [(100, 20), (10, 3), (1500, 200)])
def test_chunks_equal_a_loop(spark, size, overlap):
    df = spark.range(0, 4000, 7).select("id", X.chunk_spans(F.col("id"), size, overlap).alias("c"))
    for r in df.collect():
        got = [(c.chunk, c.start, c.end) for c in r.c]
        assert got == loop_chunks(r.id, size, overlap), r.id


def test_fill_sizes_and_markup(spark):
    t = X.fill("Hi {{ Name }}, {{name}} $1 \\ {{other}}", {"name": F.lit("$2 x"), "other": F.lit(None)})
    assert one(spark, "", t) == "Hi $2 x, $2 x $1 \\ "
    assert [one(spark, n, X.size_label(F.col("text")), "text long") for n in (10, 2048, 5 * 1024**2)] == ["10.0 B", "2.0 KB", "5.0 MB"]
    assert one(spark, "# T\n\nsome **bold** and *it*\n\n## U", X.markdown_to_html(F.col("text"))) == "<h1>T</h1>\n<p>some <strong>bold</strong> and <em>it</em></p>\n<h2>U</h2>"
    assert one(spark, "<a href='x'>&</a>", X.unescape(X.escape(F.col("text")))) == "<a href='x'>&</a>"
    assert one(spark, "---\nk: v\n---\n\nbody", X.strip_front_matter(F.col("text"))) == "body"
    assert one(spark, "body --- x", X.strip_front_matter(F.col("text"))) == "body --- x"
    text, n = X.strip_annotations(F.col("text"))
    assert one(spark, "he goed [sic] home [SIC]", text) == "he goed home" and one(spark, "he goed [sic] home [SIC]", n) == 2


DOC = "# Title\n\n## Topics\n\nfirst\n\n### Deeper\n\nmore\n\n## Interpretive Themes\n\nthemes here\n\n# End\nlast"


@pytest.mark.parametrize("name, want", [("Topics", "first\n\n### Deeper\n\nmore"), ("Interpretive Themes", "themes here"), ("Deeper", "more"), ("Absent", ""), ("End", "last")])
def test_sections(spark, name, want):
    assert one(spark, DOC, parse.section(F.col("text"), name)) == want


def test_section_under_a_bold_heading(spark):
    assert one(spark, "intro\n**Key Terms**\nA: b\n## Next\nx", parse.section(F.col("text"), "Key Terms")) == "A: b"
    assert one(spark, "**topics:**\n1. Key Terms\nx", parse.normalize_headers(F.col("text"))) == "## Topics\n## Key Terms\nx"


def test_numbered_sections(spark):
    got = one(spark, "## Section 1 Start\nA\n\n## Section 2\nB # not a heading\n", parse.numbered_sections(F.col("text")))
    assert [(s.number, s.heading, s.content.strip()) for s in got] == [(1, "Start", "A"), (2, "", "B # not a heading")]
    assert one(spark, "## Section 1\n## Section 2\n", parse.section_count(F.col("text"))) == 2


def test_topics(spark):
    strict = "### Alpha\nabout alpha\n*_(~40% of text; Sections 1-3)_*\n\n### Beta\nabout beta\n[~3% of text; Sections 4]\n"
    got = one(spark, strict, parse.topics(F.col("text")))
    assert [(t.name, t.percentage) for t in got] == [("Alpha", 40)]
    got = one(spark, "### One\nx\n### Two\ny\n", parse.topics(F.col("text")))
    assert [(t.name, t.percentage) for t in got] == [("One", 100), ("Two", 90)]
    got = one(spark, "- First: a\n- Second\n", parse.topics(F.col("text")))
    assert [(t.name, t.percentage) for t in got] == [("First", 100), ("Second", 90)]
    df = spark.createDataFrame([([("a", 5), ("b", 9), ("c", 5), ("d", 9)],)], "t array<struct<name:string,percentage:int>>")
    assert [t.name for t in df.select(parse.top_topics(F.col("t"), 3).alias("x")).first().x] == ["b", "d", "a"]


def test_themes_terms_quotes_items(spark):
    got = one(spark, "1. **Unity**: all is one. *Source Sections: 2-4*\n2. **Change:** all flows.\n", parse.themes(F.col("text")))
    assert [(t.name, t.sections) for t in got] == [("Unity", "2-4"), ("Change", "")]
    got = one(spark, "### Anxiety\nfear\n\n**anxiety**: again\n**Triangle**: three\n", parse.key_terms(F.col("text")))
    assert [t.term for t in got] == ["Anxiety", "Triangle"]
    got = one(spark, '> **Calm:** "be still"\n- **Care:** “go on”\n**No:** "x"\n', parse.labelled_quotes(F.col("text")))
    assert [(q.label, q.quote) for q in got] == [("Calm", "be still"), ("Care", "go on")]
    got = one(spark, '[Core - A1 - Rank: 87-96%] Concept: unity\n"all is one"\n', parse.scored_items(F.col("text")))
    assert [(i.type, i.category, i.score, i.concept, i.quote) for i in got] == [("Core", "A1", 91, "unity", "all is one")]


@pytest.mark.parametrize("text, want", [("6-9", [6, 7, 8, 9]), ("6-8, 20", [6, 7, 8]), ("2, 6-8", [2, 6, 8]), ("none", []), ("9-6", [])])
def test_section_ranges(spark, text, want):
    assert one(spark, text, parse.section_range(F.col("text"))) == want


def test_json(spark):
    array = parse.json_array(F.col("text"), "struct<a:int>")
    assert [r.a for r in one(spark, '```json\n[{"a": 1}, {"a": 2}]\n```', array)] == [1, 2]
    assert [r.a for r in one(spark, 'Here: [{"a": 3}] done', array)] == [3]
    assert one(spark, "nothing", array) == []
    assert one(spark, 'x {"a": 4} y', parse.json_object(F.col("text"), "a int")).a == 4
    assert one(spark, "x", parse.json_object(F.col("text"), "a int")) is None
    assert one(spark, "Yes (Read 120)", parse.cache_tokens(F.col("text"), "Read")) == 120


def test_paragraphs(spark):
    t = "# Head\n\nShort title\n\nOne sentence here.\n\nTwo.\n\nThree."
    assert one(spark, t, parse.paragraphs(F.col("text"))) == ["One sentence here.", "Two.", "Three."]
    got = one(spark, t, parse.opening_body_closing(parse.paragraphs(F.col("text"))))
    assert (got.opening, got.body, got.closing) == ("One sentence here.", "Two.", "Three.")


def test_find(spark):
    text = "It was a bright cold day in April, and the clocks were striking thirteen."
    assert similarity.find("the clocks were striking", text) == (39, 63, 1.0)
    start, end, ratio = similarity.find("the clocks were strikng thirteen.", text)
    assert ratio > 0.9 and similarity.normalize(text)[start:end].strip().startswith("the clocks")
    assert similarity.find("nothing of the sort is here", text) == (None, None, 0.0)
    assert similarity.find("", text) == similarity.find(" \n", text) == (None, None, 0.0) and similarity.find("x " * 50, "x") == (None, None, 0.0)
    df = spark.createDataFrame([("bright cold day", text), (None, text), ("a", None)], "a string, b string")
    got = df.select(similarity.find_text()("a", "b").alias("f"), similarity.ratio("a", "b").alias("r")).collect()
    assert [x.f.ratio for x in got] == [1.0, 0.0, 0.0] and got[1].r is None
    assert spark.createDataFrame([("&eacute;&amp;",)], "a string").select(similarity.html_unescape("a").alias("x")).first().x == html.unescape("&eacute;&amp;")


def test_pruned_windows_change_nothing():
    from difflib import SequenceMatcher

    words = re.findall(r"\w+", "the quick brown fox jumps over the lazy dog and the quick brown cat naps under a lazy log " * 3)
    for needle in ("quick brown fax jumps", "lazy dog and teh quick", "zzz yyy xxx"):
        best, place = 0.0, None
        for i in range(len(words) - len(needle.split()) + 1):
            r = SequenceMatcher(None, needle, " ".join(words[i : i + len(needle.split())])).ratio()
            if r > best and r >= 0.85:
                best, place = r, i
                if r >= 0.98:
                    break
        assert similarity.best_window(needle, words, 0.85, 0.98) == (place, best)


@pytest.mark.parametrize(
    "text, form, want",
    [
        ("**A b:** One, <STRONG>C:</STRONG> two [sic] (to) [01:02:03](x)", "quote", "one two x"), ("[SIC] - it's", "quote", "[sic] it s"),
        ("Dr. Kerr: a-b, Unknown Speaker: c", "plain", "ab c"), ("no label; 1:2", "plain", "no label2"), ("x" * 100_000, "plain", "x" * 100_000),
        ("So I mean it, you  know; alike", "spoken", "it you know alike"), ("", "plain", ""), ("", "quote", ""), (None, "spoken", None), (None, "plain", None),
    ],
)
def test_comparable_forms(spark, text, form, want):
    assert one(spark, text, X.comparable(F.col("text"), form)) == want


def test_unknown_forms_of_comparison_raise(spark):
    with pytest.raises(ValueError):
        X.comparable(F.col("text"), "loud")
