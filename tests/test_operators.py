from __future__ import annotations

import html
import re

import pytest
from hypothesis import given
from hypothesis import settings as hypothesis_settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptloom.functions import offsets, parse, similarity
from scriptloom.operators import alignment, completion, coverage, generation, grounding, pages, patching, patterns, questions, settings, usage
from scriptloom.sources import artifacts
from scriptloom.streaming import usage as stream


@pytest.mark.parametrize("a, b, n", [("we livel here", "we live here", 0), ("we alpha here", "we zeta here", 1), ("one two three four", "one three four", 1), ("", "x", 0), ("a b", "", 1), ("**Bold** (word)", "bold word", 0)])
def test_alignment(a, b, n):
    got = alignment.align(a, b, stop_ratio=1.0)
    assert len(got.mismatches) == n


def test_alignment_of_columns(spark):
    df = spark.createDataFrame([("a b c d e", "a b c d e"), (None, "x"), ("a b c d e f g h", "q r s t u v w x")], "a string, b string")
    got = alignment.alignment_report(df, "a", "b").collect()
    assert [r.passes for r in got] == [True, True, False] and got[2].alignment.stopped == "mismatch_ratio"
    assert got[2].alignment.mismatches[0].reason == "Mismatch"
    assert alignment.align("a x b", "a b", frozenset({"x"})).mismatches == []


def test_patching():
    text = "The quick brown fox. The lazy dog sleeps."
    assert patching.patch(text, [("quick brown", "slow red")]) == ("The slow red fox. The lazy dog sleeps.", 1, [])
    out, n, skipped = patching.patch(text, [("quick brown fox", "A"), ("brown fox.", "B")])
    assert (out, n, len(skipped)) == ("The quick B The lazy dog sleeps.", 1, 1)  # of overlapping ones the later stays
    assert patching.patch("x y x", [("x", "z")])[1:] == (0, ["ambiguous: 'x' occurs 2 times"])
    long = "one two three four five six seven"
    assert patching.patch(f"{long}. {long}.", [(long, "L")])[:2] == ("L. L.", 2)
    assert patching.patch(text, [("completely different words", "q")])[1] == 0
    assert patching.patch_in_turn("abcdefghijklmnopqrstuvwxyz twice abcdefghijklmnopqrstuvwxyz", [("abcdefghijklmnopqrstuvwxyz", "A")])[0] == "A twice A"


def test_findings(spark):
    rows = [(1, 0, "spelling", "a b c d e", "a b c d f", "high"), (1, 1, "spelling", "a b c d e", "a b c d f", "high"), (1, 2, "odd", "a b c d e", "x", "low"), (1, 3, "grammar", "a b", "x", "medium"),
            (1, 4, "grammar", "a b c d e", "a b c d e", "high"), (1, 5, "grammar", "not in the text at all", "x", "high"), (1, 6, None, "a", "b", "high")]
    df = spark.createDataFrame(rows, "doc_id long, ordinal int, error_type string, original_text string, suggested_correction string, confidence string")
    assert sorted(r.ordinal for r in patching.first_findings(df).collect()) == [0, 2, 3, 4, 5, 6]
    got = {r.ordinal: (r.f, r.r) for r in df.select("ordinal", patching.fault().alias("f"), patching.route().alias("r")).collect()}
    assert got == {0: (None, "apply"), 1: (None, "apply"), 2: ("unknown error type", "drop"), 3: ("context too short", "review"), 4: ("identical", "apply"), 5: (None, "apply"), 6: ("missing field", "apply")}
    docs = spark.createDataFrame([(1, "start a b c d e end"), (2, "other")], "doc_id long, text string")
    kept = patching.grounded(df, docs).collect()
    assert 5 not in {r.ordinal for r in kept} and {r.hallucination_score for r in kept if r.ordinal == 0} == {1.0}
    out = {r.doc_id: r.patched for r in patching.patched(docs, df.filter("ordinal = 0")).collect()}
    assert out[1].text == "start a b c d f end" and out[2].text == "other" and out[2].applied == 0


def test_rounds_until_settled(spark):
    docs = spark.createDataFrame([(1, "teh cat sat on teh mat today"), (2, "fine text stays as it is")], "doc_id long, text string")

    def find(d):
        bad = d.filter(F.contains("text", F.lit("teh cat sat on")))
        return bad.select("doc_id", F.lit(0).alias("ordinal"), F.lit("teh cat sat on").alias("original_text"), F.lit("the cat sat on").alias("suggested_correction"), F.lit("high").alias("confidence"))

    out, history = patching.until_settled(docs, find)
    assert {r.doc_id: r.text for r in out.collect()} == {1: "the cat sat on teh mat today", 2: "fine text stays as it is"}
    assert sorted((r.doc_id, r.round, r.findings, r.applied, r.ended) for r in history.collect()) == [(1, 1, 1, 1, None), (1, 2, 0, 0, "converged"), (2, 1, 0, 0, "converged")]


def test_documents_end_by_themselves(spark):
    """A document ends as it would alone, whatever the others' findings are."""
    docs = spark.createDataFrame([(1, "a sentence stands here with 4"), (2, "five six seven eight"), (3, "read this again please"), (4, None), (5, "never never land ahead")], "doc_id long, text string")

    def find(d):
        """Document 1 has as many findings as its last word says, of which the first halves it; 2 always has 20; 3 one to review."""
        level = F.element_at(F.split("text", " "), -1)
        row = lambda rows, n, original, correction, how: rows.select(
            "doc_id", F.explode(F.sequence(F.lit(1), n)).alias("ordinal"), original.alias("original_text"), correction.alias("suggested_correction"), F.lit(how).alias("confidence"))
        falling = d.filter("doc_id = 1").filter(level != "0")
        falling = row(falling, level.cast("int"), F.concat(F.lit("here with "), level), F.concat(F.lit("here with "), F.floor(level.cast("int") / 2).cast("string")), "high")
        falling = falling.withColumn("suggested_correction", F.when(F.col("ordinal") == 1, F.col("suggested_correction")).otherwise(F.concat(F.lit("none "), F.col("ordinal").cast("string"))))
        falling = falling.withColumn("original_text", F.when(F.col("ordinal") == 1, F.col("original_text")).otherwise("a sentence stands"))
        stuck = row(d.filter("doc_id = 2"), F.lit(20), F.lit("six seven eight"), F.lit("six seven eight"), "high").withColumn("suggested_correction", F.concat(F.lit("six seven eight"), F.repeat(F.lit(" "), F.col("ordinal"))))
        return falling.unionByName(stuck).unionByName(row(d.filter("doc_id = 3"), F.lit(1), F.lit("read this again please"), F.lit("read"), "medium"))

    spent = lambda d: d.select("doc_id", F.lit(10).cast("long").alias("tokens_in"), F.lit(2).cast("long").alias("tokens_out"))
    alone = patching.until_settled(docs.filter("doc_id = 2"), find)[1]
    out, history = patching.until_settled(docs, find, spent=spent)
    ends = {r.doc_id: (r.round, r.ended) for r in history.collect() if r.ended}
    assert {2: ends[2]} == {r.doc_id: (r.round, r.ended) for r in alone.collect() if r.ended} and ends[2] == (3, "stalled")
    assert ends[3] == ends[4] == ends[5] == (1, "converged") and ends[1][1] == "converged"
    assert {r.doc_id: r.text for r in out.filter("doc_id > 2").collect()} == {3: "read this again please", 4: None, 5: "never never land ahead"}
    first = {r.doc_id: r for r in history.collect() if r.round == 1}
    assert (first[3].findings, first[3].to_apply, first[3].to_review, first[3].applied, first[3].tokens_in) == (1, 0, 1, 0, 10) and first[2].skipped > 0
    totals = {r["round"]: r for r in patching.round_totals(history).collect()}
    assert totals[1].documents == 5 and totals[1].converged == 3 and totals[1].tokens_out == 10


EMPHASIS = [
    ("This is a very important insight.", "1"), ("Now emphasize the rest.", "1"), ("The key concept is near.", "1"), ("It is obviously so.", "2"), ("This was Author's idea.", "2"),
    ("This illustrates the point.", "2"), ("It is my pride and joy.", "2"), ("Now review the list.", "2"), ("Another Author quote.", "3"), ("Author wrote it.", "3"),
    ("I think it rains.", None), ("I remember a very important point of old.", None), ("Okay, so this was clearly it.", None), ("You know it is obviously so.", None), ("Thank you, clearly.", None), ("A plain line.", None),
]


def test_tiers(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(EMPHASIS)], "i int, sentence string")
    got = {r.i: r.tier for r in patterns.classified(df).collect()}
    assert got == {i: t for i, (_, t) in enumerate(EMPHASIS) if t}


def test_sentences_keep_places(spark):
    text = "One here.  Two (x)!\n\"Three\" is it? four stays. Dr. Five"
    rows = patterns.sentence_rows(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).orderBy("doc_id", "ordinal").collect()
    assert [r.sentence for r in rows] == ["One here.", "Two (x)!", '"Three" is it? four stays.', "Dr.", "Five"]
    assert all(text[r.start : r.end] == r.sentence for r in rows)
    assert (rows[1].before, rows[1].after) == ("One here.", '"Three" is it? four stays.')


@pytest.mark.parametrize("quote, keep", [("Lee said that all is one", True), ("Lee theory is old", False), ("Lee theorists wrote much", False), ("as in Lee theory, Lee wrote so", True), ("nobody spoke", False), ("to quote Lee on this", True), (None, False), ("I remember talking to Ann and he said no", True)])
def test_attribution(spark, quote, keep):
    df = spark.createDataFrame([(quote,)], "q string")
    assert df.select(patterns.attributed(F.col("q"), "Lee", "Ann").alias("x")).first().x is keep


def test_item_faults_refusals_lexicon(spark):
    df = spark.createDataFrame([("This, is a vague start of it", 50, 85, 100), ("a fine quote of five words", 90, 85, 100), ("short", 90, 85, 100)], "q string, s int, lo int, hi int")
    got = [len(r.x) for r in df.select(patterns.item_faults(F.col("q"), F.col("s"), F.col("lo"), F.col("hi")).alias("x")).collect()]
    assert got == [2, 0, 1]
    df = spark.createDataFrame([("Please provide the full document",), ("",), (None,), ("All good",)], "t string")
    assert [r.x for r in df.select(patterns.refused(F.col("t")).alias("x")).collect()] == [True, True, True, False]
    assert df.select(patterns.lexicon_hits(F.lit("Miscellaneous Other"), ["misc", "other", "none"]).alias("x")).first().x == ["misc", "other"]


def test_usage(spark, tmp_path):
    (tmp_path / "u.csv").write_text('Timestamp,Script Name,Items,Status,Cache,Tokens Sent,Tokens Response,Cache Creation Tokens,Cache Read Tokens,Estimated Cost ($)\n2026-01-02 03:04:05,a,large-x,ok,Yes (Read 10),100,20,0,0,0.1\nbad,b,unknown,ok,No,x,5,,7,\n')
    rows = usage.read_usage(spark, str(tmp_path / "u.csv"))
    got = rows.orderBy("script").collect()
    assert (got[0].tokens_in, got[0].cache_read_tokens, got[1].ts, got[1].tokens_in, got[1].cache_read_tokens) == (100, 10, None, 0, 7)
    book = spark.createDataFrame(list(usage.TIERS), usage.PRICE_BOOK)
    priced = usage.priced(rows, book, families=((("tiny", "x"), "small"),)).orderBy("script").collect()
    assert [(r.rate_input, r.matched_by) for r in priced] == [(15.0, "contains"), (3.0, "default")]
    c = usage.priced(rows, book).orderBy("script").select(usage.cost(F.col("tokens_in"), F.col("tokens_out"), F.col("cache_created"), F.col("cache_read_tokens")).alias("c"), usage.cost(F.col("tokens_in"), F.col("tokens_out"), F.col("cache_created"), F.col("cache_read_tokens"), net=False).alias("g")).collect()
    assert c[0].c == pytest.approx((90 * 15 + 20 * 75 + 10 * 1.5) / 1e6) and c[0].g == pytest.approx((100 * 15 + 20 * 75 + 10 * 1.5) / 1e6)


def test_coverage(spark):
    df = spark.createDataFrame([("art of war", ["party", "wars"]), ("art party of war", ["art", "war", "x"]), ("a", []), ("nothing", ["one"])], "t string, k array<string>")
    got = [(r.c.hits, r.c.covered, r.c.confidence) for r in df.select(coverage.covered(F.col("t"), F.col("k")).alias("c")).collect()]
    assert got == [(0, False, "low"), (2, True, "high"), (0, True, "high"), (0, False, "low")]
    checked = spark.createDataFrame([(1, True, True, "high"), (1, False, False, "low"), (2, True, None, "low")], "doc_id long, required boolean, covered boolean, confidence string")
    got = {r.doc_id: (r.passes, r.required_coverage, r.to_review) for r in coverage.rollup(checked).collect()}
    assert got == {1: (True, "1/1", 1), 2: (False, "0/1", 1)}


@pytest.mark.parametrize("qa, required", [(21, False), (35, True), (10, None)])
def test_items(spark, qa, required):
    schema = "doc_id long, presenter string, title string, topics array<struct<name:string,percentage:int,description:string>>, themes array<struct<name:string,description:string>>, purpose string, conclusion string, qa_percentage int, qa_topics array<string>"
    plan = spark.createDataFrame([(1, "Ann Lee", "T", [("Alpha", 20, "words about alpha"), ("Beta", 5, "")], [("Unity", "x"), ("Change", "y")], "explain families", None, qa, ["family roles"])], schema)
    got = {(r.category, r.label): r.required for r in coverage.items(plan).collect()}
    assert got.get(("qa", "questions")) is required
    assert got[("topic", "Alpha")] and not got[("topic", "Beta")] and got[("theme", "Unity")] and not got[("theme", "Change")] and ("conclusion", "conclusion") not in got


def test_structure_and_budget(spark):
    df = spark.createDataFrame([("As in Section 4 it is valuable.\n- item",), ("word " * 150,)], "t string")
    issues, warnings = coverage.structure_messages(F.col("t"), F.lit(150))
    got = df.select(issues.alias("i"), warnings.alias("w")).collect()
    assert got[0].i == ["section reference", "list"] and "judges: valuable" in got[0].w and got[1].i == [] and got[1].w == []
    b = df.select(coverage.word_budget(F.lit(750), F.array(F.lit(50), F.lit(30)), F.lit(10)).alias("b")).first().b
    assert (b.opening, b.closing, b.qa, b.body, list(b.topics)) == (105, 45, 75, 525, [328, 196])
    assert df.select(usage.allocate(F.lit(10), F.array(F.lit(0), F.lit(0))).alias("x")).first().x == [5, 5]
    p = df.select(coverage.proportion(F.lit(100.0), F.lit(139.0), F.lit(False)).alias("p"), coverage.proportion(F.lit(40.0), F.lit(120.0), F.lit(True)).alias("q")).first()
    assert p.p.within and p.q.within


def test_grounding(spark):
    docs = spark.createDataFrame([(1, "The family is an emotional unit. Anxiety moves through the triangle of three people in time."), (2, "Nothing here.")], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, "anxiety moves through the TRIANGLE"), (1, "Anxiety moved through the triangle of three people"), (1, "wholly invented words are here"), (2, "Nothing here")], "doc_id long, quote string")
    got = {r.quote[:20]: r.result for r in grounding.quotes_grounded(quotes, docs).collect()}
    assert list(got.values()).count("VALID") >= 2 and got["wholly invented word"] == "INVALID"
    refs = grounding.references_kept(quotes, docs).collect()
    assert {r.quote for r in refs if r.doc_id == 1} == {q for q in (r.quote for r in quotes.collect()) if q.lower().startswith("anxiety")}
    terms = spark.createDataFrame([(1, "emotional unit", "The family is an emotional unit"), (1, "quantum foam", "bubbles of space")], "doc_id long, term string, definition string")
    assert {r.term: r.result for r in grounding.terms_grounded(terms, docs).collect()} == {"emotional unit": "EXACT", "quantum foam": "FAIL"}
    topics = spark.createDataFrame([(1, "Family anxiety", "anxiety moves in the family", "anxiety moves in the family"), (1, "Rocket fuel", "liquid oxygen burns", "")], "doc_id long, name string, description string, section_text string")
    got = {r.name: (r.result, r.sections_fit) for r in grounding.topics_grounded(topics, docs).collect()}
    assert got["Family anxiety"] == ("EXACT", True) and got["Rocket fuel"] == ("FAIL", False)
    known = spark.createDataFrame([("ANXIETY moves through the triangle",)], "quote string")
    assert grounding.anti_quotes(quotes, known).count() == 3


def test_pages(spark):
    html = "<html><head><title>T &amp; U</title><style>.emphasis{} .sidebar{}</style></head><body><h1>T</h1><p>one <b>two</b></p><div class='x emphasis'>in <p>ner</p></div></body></html>"
    df = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    got = df.select(pages.first_of(F.col("html"), "title").alias("t"), pages.select("p")("html").alias("p"), pages.select(css="emphasis")("html").alias("e"), pages.missing_classes(F.col("html")).alias("m")).collect()
    assert got[0].t == "T &amp; U" and got[0].p == ["one two", "ner"] and got[0].e == ["in ner"] and "." + "emphasis" not in got[0].m and got[1].p == []
    text, n = pages.highlight("Alpha beta gamma delta epsilon zeta", [("reference", "r", "gamma delta"), ("emphasis", "e", "beta gamma"), ("reference", "s", "absent words here")])
    assert n == 1 and text == 'Alpha <mark class="emphasis" title="e; r">beta gamma</mark> delta epsilon zeta'
    out = pages.rendered(spark.createDataFrame([("A<b", "# Hi\n\ntext", "side")], "t string, b string, s string"), "t", "b", "s").first().page
    assert "<title>A&lt;b</title>" in out and "<aside><p>side</p></aside>" in out
    share = df.select(pages.sampled_coverage(F.array(F.lit("Anna"), F.lit("Bob"), F.lit("x"), F.lit("y")), F.array(F.lit("anna lee"))).alias("x")).first().x
    assert share == 0.5


def test_questions(spark):
    text = "\n".join(f"## Section {i} h\n" + body for i, body in enumerate(["My intent here is to explain it. More.", "plain", "**Ann:** a question about family roles today. **Bob:** comment", "In conclusion all is well. End."], 1))
    df = spark.createDataFrame([(text,), ("no sections",)], "t string")
    got = df.select(questions.purpose(F.col("t")).alias("p"), questions.conclusion(F.col("t")).alias("c"), questions.qa_percentage(F.col("t")).alias("q"), questions.qa_topics(F.col("t")).alias("k")).collect()
    assert (got[0].p, got[0].c, got[0].q, got[0].k) == ("My intent here is to explain it.", "In conclusion all is well.", 25, ["family roles today"])
    assert (got[1].p, got[1].c, got[1].q) == (questions.NO_PURPOSE, questions.NO_CONCLUSION, 0)
    turns = "**Dr Who:** " + "x" * 300 + ". **Ann:** " + "long words. " * 30
    assert df.select(questions.notable_exchanges(F.lit(turns)).alias("x")).first().x == ["long words."]


def test_completion(spark):
    class Flaky:
        calls = 0

        def complete(self, prompts):
            Flaky.calls += 1
            if Flaky.calls < 3:
                raise TimeoutError
            return [{"text": "x"} for _ in prompts]

    waits = []
    assert completion.Retrying(Flaky(), 3, 1.0, waits.append).complete(["a"]) == [{"text": "x"}] and waits == [1.0, 2.0]
    df = spark.createDataFrame([(1, "a\n\nlast words here"), (2, None)], "doc_id long, prompt string")
    got = completion.completed(df, "prompt", key="doc_id").orderBy("doc_id")
    assert [r.answer.text for r in got.collect()] == ["last words here", ""]
    assert [r.f for r in got.select(completion.answer_fault(F.col("answer")).alias("f")).collect()] == [None, "no text"]
    items = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "doc_id long, ordinal int")
    answers = spark.createDataFrame([(1, "1. YES\n\n2. NO")], "doc_id long, answer string")
    assert [r.verdict for r in completion.verdicts(items, answers, "doc_id").orderBy("ordinal").collect()] == [True, False, False]
    asked = completion.until_valid(df.select("doc_id"), lambda d, n: d.withColumn("a", F.lit(n)), F.col("a") >= F.col("doc_id"), 3)
    assert {r.doc_id: (r.a, r.accepted) for r in asked.collect()} == {1: (1, True), 2: (2, True)}


def test_settings(spark):
    assert settings.violations(spark, settings.Settings()).count() == 0
    broken = settings.asdict(settings.Settings()) | {"fuzzy_threshold": 1.5, "chunk_overlap": 2000, "abstract_min_words": -1, "lookahead": "ten"}
    got = {(r.rule, r.name) for r in settings.violations(spark, broken).collect()}
    assert got == {("range", "fuzzy_threshold"), ("order", "fuzzy_threshold"), ("order", "chunk_overlap"), ("positive", "abstract_min_words"), ("number", "lookahead")}


def test_artifacts(spark, tmp_path):
    for n, t in (("A - B - 2020.txt", "\ufeffhello"), ("A - B - 2020_v2.txt", "two\nlines\n"), ("A - B - 2020_v10.txt", "ten"), ("note.md", "x")):
        (tmp_path / n).write_text(t)
    files = artifacts.read_texts(spark, str(tmp_path), "*.txt")
    assert {r.name: r.text for r in files.collect()}["A - B - 2020.txt"] == "hello"
    assert {r.name: r.text for r in files.collect()}["A - B - 2020_v2.txt"] == "two\nlines\n" and files.count() == 3
    assert [(r.base, r.version, r.text) for r in artifacts.latest(files).collect()] == [("A - B - 2020", 10, "ten")]
    assert [r.name for r in artifacts.listing(spark, str(tmp_path), "*.md").collect()] == ["note.md"]
    assert [r.base for r in artifacts.base_names(files).collect()] == ["A - B - 2020"]
    rows = spark.createDataFrame([("s", "terms", "body"), ("s", "topics", "t")], "stem string, kind string, text string")
    artifacts.write_artifacts(rows, str(tmp_path / "store"))
    assert artifacts.read_artifacts(spark, str(tmp_path / "store"), "terms").count() == 1
    places = spark.createDataFrame([("k", "old", 1), ("k", "new", 2), ("j", "old", 3)], "key string, place string, v int")
    assert {r.key: r.v for r in artifacts.preferred(places, "key", ["new", "old"]).collect()} == {"k": 2, "j": 3}
    (tmp_path / "terms.lst").write_text("# comment\nMisc\n\n other \n")
    assert [r.term for r in artifacts.lexicon(spark, str(tmp_path / "terms.lst")).collect()] == ["misc", "other"]
    with pytest.raises(Exception, match="empty input"):
        artifacts.checked(spark.createDataFrame([("p", " ")], "path string, text string")).collect()
    doc = artifacts.with_front_matter(spark.createDataFrame([("---\na: b\n---\nbody",)], "text string"), {"title": F.lit("T")}).first().text
    assert doc == "---\ntitle: T\n---\n\nbody"
    report = artifacts.markdown_report(spark.createDataFrame([(1, "b|c", 2), (1, "a", 1)], "g int, x string, o int"), "g", ["x"], "o").first().report
    assert report == "| x |\n| --- |\n| a |\n| b\\|c |"
    moved = artifacts.moves(spark.createDataFrame([("p1", "f.txt"), ("p2", "g.txt")], "path string, name string"), "done/", spark.createDataFrame([("f.txt",), ("f_1.txt",)], "name string"))
    assert {r.path: r.target for r in moved.collect()} == {"p1": "done/f_2.txt", "p2": "done/g.txt"}


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-01 0{h}:10:00", "a", 1.0) for h in (1, 1, 2)], "t string, event_type string, value double").selectExpr("timestamp(t) AS ts", "event_type", "value")
    rows.write.parquet(str(tmp_path / "in"))
    q = stream.windowed_usage(stream.stream_events(spark, str(tmp_path / "in"), rows.schema)).writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.calls, r.total) for r in spark.table("w").collect()) == [(1, 1.0), (2, 2.0)]


def test_marks_stand_at_raw_places():
    text = "I don't know. A well-known fact isn't new. The red fox ran home fast today again."
    quote = ("reference", "r", "The red fox ran home fast")
    marked = lambda t: pages.highlight(t, [quote])
    assert marked(text) == (text.replace("The red fox ran home fast", '<mark class="reference" title="r">The red fox ran home fast</mark>'), 1)
    lines = "I don't\nknow.\n\nThe red\nfox <b>ran</b> home &amp; fast.\nEnd."
    out, n = pages.highlight(lines, [("emphasis", "e", "red fox ran home")])
    assert n == 1 and out == lines.replace("red\nfox <b>ran</b> home", '<mark class="emphasis" title="e">red\nfox <b>ran</b> home</mark>')
    assert marked("nothing of the kind") == ("nothing of the kind", 0) and marked("") == ("", 0)


def test_fuzzy_patches_cut_raw_places():
    text = "[12:30] &quot;Some&quot; <b>some</b> long lead   text here. the quik brown fox jumped over the lazy dog tonight ok."
    out, n, _ = patching.patch(text, [("the quick brown fox jumped over the lazy dog tonight ok.", "CORRECTED")])
    assert (out, n) == ("[12:30] &quot;Some&quot; <b>some</b> long lead   text here. CORRECTED", 1)
    assert patching.patch_in_turn(text, [("the quick brown fox jumped over the lazy dog tonight ok.", "CORRECTED")])[0] == out


@given(st.text(alphabet="ab .&;<>\n'İß[]:1234-*", max_size=60), st.booleans())
@hypothesis_settings(max_examples=400, deadline=None)
def test_located_text_equals_the_normal_form(text, aggressive):
    got = offsets.normalized(text, aggressive)
    assert got.text == similarity.normalize(text, aggressive)
    plain = Plain(text)
    for pattern, by in ([(offsets._ENTITY, html.unescape)] if "&" in text else []) + [(p, " ") for p in (similarity.TAGS, *similarity.TIMES)]:
        plain.replace(pattern, by)
    if aggressive:
        plain.replace(similarity.LABEL, "").replace(similarity.SPEAKER, "").replace(similarity.PUNCTUATION, " ")
    plain.replace(re.compile(r"\s+"), " ").strip().lower()
    assert [(got.start(i), got.end(i)) for i in range(len(got.text))] == plain.spans and plain.text == got.text


class Plain:
    """A text with the raw span of each character, one by one."""

    def __init__(self, raw):
        self.text, self.spans = raw, [(i, i + 1) for i in range(len(raw))]

    def replace(self, pattern, by):
        text, spans, at = "", [], 0
        for m in pattern.finditer(self.text):
            a, z = m.span()
            new = by if isinstance(by, str) else by(m[0])
            same = self.spans[a:z] if new == m[0] else [(self.spans[a][0], self.spans[z - 1][1])] * len(new)
            text, spans, at = text + self.text[at:a] + new, spans + self.spans[at:a] + same, z
        self.text, self.spans = text + self.text[at:], spans + self.spans[at:]
        return self

    def strip(self):
        a, z = len(self.text) - len(self.text.lstrip()), len(self.text.rstrip())
        self.text, self.spans = self.text[a:z], self.spans[a:z]
        return self

    def lower(self):
        low = self.text.lower()
        if len(low) != len(self.text):
            self.spans = [s for s, c in zip(self.spans, self.text, strict=True) for _ in c.lower()]
            low = "".join(c.lower() for c in self.text)
        self.text = low
        return self


def test_places_of_long_texts_take_little_memory():
    import tracemalloc

    text = "It isn't so, <b>really</b> not &amp; never.\n\nWords go on and on and on without an end " * 8_000
    tail = "the red fox ran home at last today"
    tracemalloc.start()
    known = similarity.Haystack(text + tail, True)
    assert known.find("red fox ran home")[:2] == (len(text) + 4, len(text) + 20) and known.word_span("fox ran home at once today now")
    size = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    kept = sum(x.itemsize * len(x) for x in (known.located.at, known.located.raw_at, known.located.stop))
    assert kept < 2 * len(text) and size < 25 * len(text), (kept, size)


@given(st.lists(st.sampled_from("abcdef"), min_size=1, max_size=60), st.lists(st.sampled_from("abcdefz"), min_size=1, max_size=9))
@hypothesis_settings(max_examples=300, deadline=None)
def test_clusters_of_words_equal_a_whole_comparison(have, want):
    from difflib import SequenceMatcher

    joined, quote = " ".join(have), " ".join(want)
    run = next((i for i in range(len(have)) if have[i : i + len(want)] == want), None)
    if run is not None:
        expected = (run, run + len(want), 1.0)
    else:
        blocks = [b for b in SequenceMatcher(None, have, want, autojunk=False).get_matching_blocks() if b.size]
        best = (0, 0, 0)
        for j, last in enumerate(blocks):
            i = min(i for i in range(j + 1) if last.a + last.size - blocks[i].a <= 3 * len(want) or i == j)
            total = sum(b.size for b in blocks[i : j + 1])
            best = best if best[0] >= total else (total, blocks[i].a, last.a + last.size)
        expected = (best[1], best[2], best[0] / len(want)) if best[0] / len(want) >= 0.7 else None
    assert similarity.word_span(quote, joined) == expected


def test_marks_that_overlap():
    text = "a1 b1 c1 d1 e1 f1 g1"
    mark = lambda kind, title, part: f'<mark class="{kind}" title="{title}">{part}</mark>'
    two = [("emphasis", "x", "a1 b1 c1"), ("emphasis", "y", "c1 d1 e1")]
    assert pages.highlight(text, two) == (f"a1 b1 {mark('emphasis', 'y', 'c1 d1 e1')} f1 g1", 1)
    assert pages.highlight(text, [("reference", "r", "c1 d1 e1"), ("emphasis", "e", "a1 b1 c1")]) == (f"{mark('emphasis', 'e; r', 'a1 b1 c1')} d1 e1 f1 g1", 1)
    assert pages.highlight(text, [("emphasis", "e (92%)", "c1 d1 e1"), ("reference", "r", "a1 b1 c1")]) == (f"a1 b1 {mark('emphasis score-90', 'e (92%); r', 'c1 d1 e1')} f1 g1", 1)
    assert pages.highlight(text, [("emphasis", "e", None), ("emphasis", "e", ""), ("reference", "r", "no such words")]) == (text, 0) and pages.highlight(text, []) == (text, 0)


def test_headings_are_judged_by_place_with_their_contents(spark):
    asked = []

    class Judge:
        def complete(self, prompts):
            out = []
            for p in prompts:
                asked.append(p)
                parts = p.split("SECTION ")[1:]
                out.append({"text": "\n".join("YES" if "good" in x.split("Content: ")[1] else "NO" for x in parts if "lost" not in x), "stop_reason": "end_turn", "model": "m", "input_tokens": 1, "output_tokens": 1})
            return out

    rows = [(1, 1, "a", "good"), (1, 2, "b", "good"), (1, 4, "c", "bad"), (1, 5, "d", "good"), (2, 7, "e", None), (2, None, None, "good"), (2, 9, "g", "good"), (2, 30, "h", "bad"), (2, 31, "i", "good"), (2, 90, "j", "good\n\nmore")]
    df = spark.createDataFrame(rows, "doc_id long, number int, heading string, content string")
    got = generation.headers_judged(df, backend=Judge())
    assert {(r.doc_id, r.number): r.fits for r in got.collect()} == {(1, 1): True, (1, 2): True, (1, 4): False, (1, 5): True, (2, 7): False, (2, None): True, (2, 9): True, (2, 30): False, (2, 31): True, (2, 90): True}
    report = {r.doc_id: r.report for r in generation.header_report(got, ["a", "i"]).collect()}
    assert report[1] == "# Headings\n\n## Terms\n- **Section 1**: a holds a\n\n## Answers\n\n### Batch 1\nYES\nYES\nNO\nYES\n"
    assert "### Batch 2\nYES\n" in report[2] and "without an answer" not in report[2]
    lost = generation.headers_judged(df.withColumn("content", F.lit("lost")), backend=Judge())
    assert generation.header_report(lost).filter("doc_id = 2").first().report.endswith("## Batches without an answer\n1, 2\n")
    assert generation.headers_judged(df.limit(0), backend=Judge()).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_moves_take_the_first_free_names(spark, seed):
    import random

    rng = random.Random(seed)
    names = lambda n: [rng.choice(["a.txt", "a_1.txt", "a_2.txt", "a_01.txt", "a", "b_3.md", "b.md", "b_3_1.md"]) for _ in range(n)]
    files, taken = [(f"p{i:02}", x) for i, x in enumerate(names(25))], [*names(4), "a_4.txt", "a_5.txt"]
    got = {r.path: r.target for r in artifacts.moves(spark.createDataFrame(files, "path string, name string"), "old", spark.createDataFrame([(t,) for t in taken], "name string")).collect()}
    used, first = set(taken) | {n for _, n in files}, set(taken)
    for path, name in sorted(files):
        if name not in first:  # the first file of a name keeps it
            first.add(name)
            assert got[path] == f"old/{name}"
            continue
        stem, dot, ending = name.rpartition(".") if "." in name else (name, "", "")
        n = next(n for n in range(1, 99) if f"{stem}_{n}{dot}{ending}" not in used)
        used.add(f"{stem}_{n}{dot}{ending}")
        assert got[path] == f"old/{stem}_{n}{dot}{ending}"
    assert len(set(got.values())) == len(files) and not {t.removeprefix("old/") for t in got.values()} & set(taken)


def test_null_and_blank_claims_are_nowhere(spark):
    docs = spark.createDataFrame([(1, "Some words stand here."), (2, None)], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, None), (1, ""), (1, " \n"), (1, "words stand"), (2, "words"), (3, "no document"), (None, "x")], "doc_id long, quote string")
    got = {(r.doc_id, r.quote): (r.ratio, r.result) for r in grounding.quotes_grounded(quotes, docs).collect()}
    assert got == {(1, None): (0.0, "INVALID"), (1, ""): (0.0, "INVALID"), (1, " \n"): (0.0, "INVALID"), (1, "words stand"): (1.0, "VALID"), (2, "words"): (0.0, "INVALID")}
    terms = spark.createDataFrame([(1, None, None), (1, "some words", None)], "doc_id long, term string, definition string")
    assert {(r.term, r.result) for r in grounding.terms_grounded(terms, docs).collect()} == {(None, "FAIL"), ("some words", "WEAK")}
    topics = spark.createDataFrame([(1, None, None, None)], "doc_id long, name string, description string, section_text string")
    assert grounding.topics_grounded(topics, docs).first().result == "FAIL"


def test_many_claims_of_a_document_travel_in_parts(spark, monkeypatch):
    monkeypatch.setattr(grounding, "TOGETHER", 3)
    docs = spark.createDataFrame([(1, "one two three four five six seven")], "doc_id long, text string")
    claims = spark.createDataFrame([(1, i, f"{w} {x}") for i, (w, x) in enumerate([("one", "two"), ("two", "three"), ("nine", "ten"), ("six", "seven")] * 5)], "doc_id long, n int, claim string")
    got = grounding.match(claims, docs, {"r": "claim", "s": F.lit("three")}, of_text={"size": F.length("text_")}).orderBy("n").collect()
    assert [r.r for r in got] == [1.0, 1.0, 0.0, 1.0] * 5 and {(r.s, r["size"]) for r in got} == {(1.0, 33)} and got[0].asDict().keys() == {"doc_id", "n", "claim", "r", "s", "size"}


def test_patches_of_many_findings_are_put_together_once():
    import random
    import time

    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    text = " ".join(words)
    wrong = lambda i: " ".join([*words[i : i + 5], words[i + 5][:-1] + "z", *words[i + 6 : i + 9]])
    some, many = ([(wrong(i * 25), f"C{i}") for i in range(n)] for n in (3, 100))
    seconds = []
    for findings in (some, many):
        began = time.process_time()
        out, applied, skipped = patching.patch(text, findings)
        seconds.append(time.process_time() - began)
        assert applied == len(findings) and not skipped
    assert out.split()[:2] == ["C0", words[9]] and out.count("C") == 100



@pytest.mark.parametrize("quote, keep", [
    ("As Lee said, all is one", True), ("Lee, in the end, once observed it", True), ("to quote Lee on this", True), ("this was noted by Lee", False), ("Lee was tall", False), (None, False), ("Bradlee said so", False),
])
def test_loose_attribution(spark, quote, keep):
    df = spark.createDataFrame([(quote,)], "q string")
    assert df.select(patterns.loosely_attributed(F.col("q"), "Lee").alias("x")).first().x is keep


@pytest.mark.parametrize("quote, keep", [
    ("Dr. Lee, in those years, used to talk of it", True), ("Lee " + "x" * 81 + " said", False), ("Lee " + "x" * 70 + " said", True), ("Lee was here. He said no", False),
    ("Lee's comment was short", True), ("Lee theory says much", False), ("Lee theory, which Ann described", True), ("i remember Ann walking, and then he said no", True), ("leeway said", False),
])
def test_attribution_by_sentence(spark, quote, keep):
    df = spark.createDataFrame([(quote,)], "q string")
    assert df.select(patterns.attributed(F.col("q"), "Lee", "Ann").alias("x")).first().x is keep


def test_cleaned_before_alignment(spark):
    raw = "Ann Lee  0:12\nWelcome all. [00:01:05] Transcribed by someone\nSpeaker 2: yes, go on"
    df = spark.createDataFrame([(raw,), (None,)], "t string").select(alignment.cleaned(F.col("t"), phrases=("go on",)).alias("x"))
    assert [r.x for r in df.collect()] == ["Welcome all. yes,", ""]


def test_bands_of_items(spark):
    items = spark.createDataFrame([("A22", 84, "five words are enough here"), ("B1", 40, "five words are enough here"), (None, 90, "five words are enough here")], "category string, score int, quote string")
    got = {r.category: r.faults for r in patterns.judged_items(items, patterns.band_table(spark, {"A22": (85, 100), "B1": (30, 50)})).collect()}
    assert got == {"A22": ["score outside its band"], "B1": [], None: []}


def test_answers_by_kind_and_role(spark):
    df = spark.createDataFrame([("message", "assistant", 1), ("error", "assistant", 2), ("message", "user", 3), (None, "assistant", 4), ("message", None, 5)], "k string, r string, i int")
    answer = F.struct(F.lit("a b c").alias("text"), F.lit("end_turn").alias("stop_reason"), F.lit("m").alias("model"), F.lit(1).alias("input_tokens"), F.lit(1).alias("output_tokens"))
    got = [r.x for r in df.select(completion.answer_fault(answer, kind=F.col("k"), role=F.col("r")).alias("x")).collect()]
    assert got == [None, "no message", "other role", "no message", "other role"]
    assert df.limit(1).select(completion.answer_fault(answer, least_words=4).alias("x")).first().x == "too few words"


def test_time_grows_after_time_outs():
    class Slow:
        timeout, seen = 10.0, []

        def complete(self, prompts):
            self.seen.append(self.timeout)
            if len(self.seen) < 3:
                raise TimeoutError
            return ["done"]

    waits, inner = [], Slow()
    assert completion.Retrying(inner, tries=3, wait=1.0, sleep=waits.append).complete(["p"]) == ["done"]
    assert inner.seen == [10.0, 15.0, 22.5] and waits == [1.0, 2.0] and inner.timeout == 10.0


def test_fixed_rounds_keep_versions(spark):
    docs = spark.createDataFrame([(1, "aaaa bbbb cccc dddd"), (2, None)], "doc_id long, text string")
    found = lambda now: spark.createDataFrame([(1, 0, "bbbb", "xx"), (1, 1, "xx", "yy")], "doc_id long, ordinal int, original_text string, suggested_correction string")
    got = {(r.doc_id, r.version): r.text for r in patching.fixed_rounds(docs, found, settle=lambda df: df).collect()}
    assert got == {(1, 0): "aaaa bbbb cccc dddd", (1, 1): "aaaa yy cccc dddd", (1, 2): "aaaa yy cccc dddd", (2, 0): None, (2, 1): "", (2, 2): ""}


def test_doubtful_settings_and_paths(spark):
    got = {(r.rule, r.name) for r in settings.doubts(spark, {"chunk_size": 100, "lookahead": 2.5, "summary_words": 650, "blog_min_words": "x"}).collect()}
    assert got == {("usual", "chunk_size"), ("whole", "lookahead")}
    paths = spark.createDataFrame([("a", True, True, True, True), ("b", False, False, False, True), ("c", False, False, False, False), ("d", True, False, True, True), ("e", True, True, False, True)], "name string, exists boolean, folder boolean, writable boolean, needed boolean")
    assert {(r.name, r.severity, r.message) for r in settings.path_violations(paths).collect()} == {("b", "error", "missing"), ("c", "warning", "missing"), ("d", "error", "no folder"), ("e", "warning", "not writable")}


def test_audits_and_report_heads(spark, tmp_path):
    audits = spark.createDataFrame([(1, ("good", 3)), (2, None)], "doc_id long, audit struct<verdict:string,score:int>")
    artifacts.write_audits(audits, f"{tmp_path}/audits")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/audits").collect()) == ['{"doc_id":1,"audit":{"verdict":"good","score":3}}', '{"doc_id":2}']
    assert audits.limit(1).select(artifacts.report_header(F.lit("Title"), {"rows": F.col("doc_id")}).alias("x")).first().x == "# Title\n\n- rows: 1\n"


def test_paragraphs_end_where_the_next_begins(spark):
    df = spark.createDataFrame([("<div><p>one<p>two <b>x</b></p><p class='c'>three",), (None,)], "h string")
    assert [r.x for r in df.select(pages.select(tag="p")("h").alias("x")).collect()] == [["one", "two x", "three"], []]


def test_lists_of_quotes_become_one_with_kinds(spark):
    schema = "doc_id long, ordinal int, label string, quote string"
    told = spark.createDataFrame([(1, 5, "b", "x"), (1, 2, "a", "y"), (2, 0, "c", None)], schema)
    cited = spark.createDataFrame([(1, 0, "d", "z"), (3, 9, "e", "w")], schema)
    got = sorted(map(tuple, pages.typed_quotes({"emphasis": told, "reference": cited}).collect()))
    assert got == [(1, 0, "emphasis", "a", "y"), (1, 1, "emphasis", "b", "x"), (1, 2, "reference", "d", "z"), (2, 0, "emphasis", "c", None), (3, 0, "reference", "e", "w")]
    assert pages.typed_quotes({"emphasis": told.limit(0), "reference": cited.limit(0)}).count() == 0


def test_elements_that_end_by_themselves(spark):
    html = "<ul><li>a<li>b<ol><li>c</ol>d<li>e</ul><table><tr><td>1<td>2<tr><th>3<td><table><tr><td>4</td></table>5</table><dl><dt>t<dd>u<br>v<dt>w</dl></p><p>x<div>y</div>z<img src=q><p>s<b>t</p>u</b><hr>v"
    of = lambda tag: pages.select(tag)("h")
    got = spark.createDataFrame([(html,), ("<td>lone</table></li>",), ("",), (None,)], "h string").select(*(of(t).alias(t) for t in ("li", "td", "tr", "dt", "dd", "p", "b", "img"))).collect()
    assert got[0].asDict() == {"li": ["a", "c", "bcd", "e"], "td": ["1", "2", "4", "45"], "tr": ["12", "4", "345"], "dt": ["t", "w"], "dd": ["uv"], "p": ["x", "st"], "b": ["t"], "img": [""]}
    assert got[1].td == ["lone"] and all(x == [] for r in got[2:] for x in r)


def test_deep_pages_and_long_ones(spark):
    deep = "<div>" * 3000 + "x" + "<li>" * 3000
    df = spark.createDataFrame([(deep,)], "h string").select(pages.select("div")("h").alias("d"), pages.select("li")("h").alias("l")).first()
    assert df.d == ["x"] * 3000 and df.l == [""] * 3000


def test_sections_of_all_levels(spark):
    text = "before\n# A\nbody a\n### B\nb\n## C\n#not one\n####### nor this\n# D"
    got = spark.createDataFrame([(text,), ("none",), ("",), (None,), ("## X",)], "t string").select(parse.all_sections(F.col("t")).alias("s")).collect()
    assert [(s.ordinal, s.level, s.heading, s.parent, s.body, s.whole) for s in got[0].s] == [
        (0, 1, "A", None, "body a\n", "body a\n### B\nb\n## C\n#not one\n####### nor this\n"), (1, 3, "B", 0, "b\n", "b\n"),
        (2, 2, "C", 0, "#not one\n####### nor this\n", "#not one\n####### nor this\n"), (3, 1, "D", None, "", "")]
    assert [r.s for r in got[1:4]] == [[], [], None] and len(got[4].s) == 1


def test_prompts_are_asked_once_even_if_a_run_is_lost(spark, tmp_path):
    class Counting:
        """Notes each prompt in a file; breaks at one of them as long as a file says so."""

        def complete(self, prompts):
            out = []
            for p in prompts:
                if p == "p7" and (tmp_path / "break").exists():
                    raise ConnectionError("lost")
                with open(tmp_path / f"asked-{p}", "a") as f:
                    f.write("x")
                out.append({"text": p.upper(), "stop_reason": "end_turn", "model": "m", "input_tokens": 1, "output_tokens": 1})
            return out

    rows = spark.createDataFrame([(i, f"p{i % 10}") for i in range(60)] + [(99, None)], "doc_id long, prompt string")
    store = str(tmp_path / "answers")
    (tmp_path / "break").write_text("")
    with pytest.raises(Exception, match="lost"):
        completion.answered_once(rows, "prompt", store, backend=Counting(), parts=4).collect()
    kept = {r.answer.text for r in spark.read.parquet(store).collect()}
    (tmp_path / "break").unlink()
    got = completion.answered_once(rows, "prompt", store, backend=Counting(), parts=4)
    assert {r.doc_id: r.answer.text for r in got.collect()} == {i: f"P{i % 10}" for i in range(60)} | {99: ""}
    times = {p: (tmp_path / f"asked-{p}").read_text() for p in [*(f"p{i}" for i in range(10)), ""]}
    assert all(times[p.lower()] == "x" for p in kept) and kept
    before = dict(times)
    again = completion.answered_once(rows.unionByName(rows), "prompt", store, backend=Counting())
    assert again.count() == 122 and {p: (tmp_path / f"asked-{p}").read_text() for p in before} == before
    other = completion.answered_once(rows.limit(1), "prompt", store, model="other", backend=Counting())
    assert other.first().answer.text == "P0" and (tmp_path / "asked-p0").read_text() == before["p0"] + "x"
    assert completion.answered_once(rows.limit(0), "prompt", store).count() == 0


def test_settings_of_many_profiles(spark):
    rows = spark.createDataFrame([("a", "chunk_size", "100"), ("a", "chunk_overlap", "100"), ("b", "chunk_size", "200"), ("b", "chunk_overlap", "100"), ("c", "fuzzy_threshold", "NaN"), ("c", "lookahead", None), ("d", "fuzzy_threshold", "-0.5")], "p string, name string, value string")
    got = {(r.profile, r.rule, r.name) for r in settings.table_violations(rows, "p").collect()}
    assert got == {("a", "order", "chunk_overlap"), ("c", "number", "fuzzy_threshold"), ("c", "number", "lookahead"), ("d", "range", "fuzzy_threshold")}


def test_bands_and_books_of_any_size(spark):
    bands = spark.range(12_000).select(F.format_string("K%d", "id").alias("category"), F.lit(10).alias("low"), F.lit(20).alias("high"))
    items = spark.createDataFrame([("a fine quote of five words", 15, "K11999"), ("a fine quote of five words", 15, "K12001")], "quote string, score int, category string")
    assert [len(r.faults) for r in patterns.judged_items(items, bands).orderBy("category").collect()] == [0, 1]
    book = spark.range(12_000).select(F.format_string("m%05d", "id").alias("model"))
    models = spark.createDataFrame([("x", "m11999", 100, 60), ("y", "none", 100, 60)], "name string, model string, max_tokens int, timeout int")
    assert [(r.name, r.rule) for r in settings.model_violations(models, book).collect()] == [("y", "model")]


def test_orders_shares_sets_and_files_of_settings(spark):
    equal = settings.asdict(settings.Settings()) | {"fuzzy_review": 0.95, "fuzzy_reject": 0.95, "chunk_overlap": 1500, "max_stalled": 1.5, "temperature_creative": 1.2, "tokens_audit": 0}
    assert {(r.rule, r.name) for r in settings.violations(spark, equal).collect()} == {("order", "chunk_overlap"), ("whole", "max_stalled"), ("range", "temperature_creative"), ("positive", "tokens_audit")}
    odd = settings.asdict(settings.Settings()) | {"opening_share": 0.4, "tokens_summary": 250_000, "timeout_default": 5}
    assert {(r.rule, r.name) for r in settings.doubts(spark, odd).collect()} == {("shares", "opening_share"), ("usual", "tokens_summary"), ("usual", "timeout_default")}
    assert settings.doubts(spark, settings.Settings()).count() == 0
    sets = spark.createDataFrame([("apply", ["high"]), ("review", ["medium", "odd"]), ("types", []), ("skip", None), ("free", ["any"])], "name string, values array<string>")
    levels = {"apply": ("high", "medium", "low"), "review": ("high", "medium", "low")}
    assert {(r.name, r.severity, r.message) for r in settings.set_violations(sets, levels).collect()} == {("review", "error", "unknown: odd"), ("types", "warning", "empty"), ("skip", "error", "no set")}
    assert settings.set_violations(sets).count() == 2
    wanted = spark.createDataFrame([("format", "a.md"), ("terms", "b.md"), ("none", None)], "name string, file string")
    found = settings.missing_files(wanted, spark.createDataFrame([("a.md",), ("a.md",), ("c.md",)], "name string"))
    assert {(r.name, r.message) for r in found.collect()} == {("terms", "missing: b.md"), ("none", "missing: null")}


def test_sentences_and_quotes_keep_letters_at_their_ends(spark):
    """White space is trimmed, the vertical tab too; the letter v, which DuckDB reads for E'\\v', is no white space."""
    docs = spark.createDataFrame([(1, "\x0bvery well v. Vivid v! \x0b")], "doc_id long, text string")
    assert [(r.sentence, r.before, r.after) for r in patterns.sentence_rows(docs).orderBy("ordinal").collect()] == [
        ("very well v.", "", "Vivid v!"), ("Vivid v!", "very well v.", "")]
    assert [tuple(r) for r in docs.select(F.inline(parse.labelled_quotes(F.lit('> **A:** "very v"')))).collect()] == [("A", "very v")]
