"""Queries that put texts of a known form around the rows of a table, so that SQL can say what an operator has to find there.

The tables hold no transcripts. Each query composes, for every row, the sections, quotes, findings or answers that its operators read, from columns of the
row; the oracle states the result by hand, without the operators' own expressions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptloom.functions import compose, parse, similarity
from scriptloom.functions import text as X
from scriptloom.operators import alignment, completion, coverage, generation, grounding, pages, patching, patterns, questions, settings, usage
from scriptloom.plans.catalogue import query
from scriptloom.sources import artifacts
from scriptloom.sources.tables import scratch, spread, table

#: documents in SQL, as the functions below read them: s and l are source and language, i the number as text
_D = "(SELECT doc_id, coalesce(source, 'none') AS s, coalesce(lang, 'xx') AS l, doc_id::VARCHAR AS i, coalesce(text, '') AS text, n_chars FROM documents)"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang", "n_chars")


def _s():
    return F.coalesce("source", F.lit("none"))


def _l():
    return F.coalesce("lang", F.lit("xx"))


def _i():
    return F.col("doc_id").cast("string")


def _text(*parts):
    """Strings and columns, one after the other."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


@query(
    "text_forms",
    rf"""
    SELECT doc_id, 'tom&' || s || ' ' || l || ' **ann:** it''s — "no. ' || i || '" [sic], [sic]' AS plain, 'tom&' || s || ' ' || l || ' it s no ' || i || ' [sic] [sic]' AS aggressive,
           s AS word, 'a b ' || s AS compared, s || ' x' AS unmarked, 2::BIGINT AS marks, 'Body ' || i AS body, '---' || chr(10) || 'title: ' || s || chr(10) || 'n: ' || i || chr(10) || '---' || chr(10) || chr(10) AS front,
           '&lt;' || s || '&gt; &amp; &quot;x&quot; &#39;y&#39;' AS escaped, '<h1>' || s || '</h1>' || chr(10) || '<p>A <strong>b</strong> and <em>c</em></p>' || chr(10) || '<h2>Two</h2>' AS html,
           s || 'name' AS safe, s || '|' || l || '|May ' || i AS loose, 'Dear ' || s || ', ' || i || '!' AS filled,
           CASE WHEN b < 1024 THEN format('{{:.1f}} B', b) WHEN b < 1048576 THEN format('{{:.1f}} KB', b / 1024) WHEN b < 1073741824 THEN format('{{:.1f}} MB', b / 1048576) ELSE format('{{:.1f}} GB', b / 1073741824) END AS size
    FROM (SELECT *, (length(text) * 1000 + 1)::DOUBLE AS b FROM {_D})
    """,
)
def text_forms(spark, sf_dir):
    raw = _text("  &lt;b&gt;Tom&amp;", _s(), " [12:30] <i>", _l(), "</i> 10:00am **Ann:** It's — \"No. ", _i(), '" [sic], [SIC]  ')
    unmarked, marks = X.strip_annotations(_text(_s(), " [sic] x [SIC]"))
    loose = compose.loose_metadata(_text(_s(), " - ", _l(), " - May ", _i(), " - x.txt"))
    return _docs(spark, sf_dir).select(
        "doc_id", X.normalize(raw).alias("plain"), X.normalize(raw, True).alias("aggressive"), X.normalize_word(_text("**_", _s(), "._**")).alias("word"),
        X.normalize_comparison(_text("A,  B; ", _s(), "!")).alias("compared"), unmarked.alias("unmarked"), marks.cast("long").alias("marks"),
        X.strip_front_matter(_text("---\ntitle: ", _s(), "\n---\n\nBody ", _i())).alias("body"), X.front_matter({"title": _s(), "n": F.col("doc_id")}).alias("front"),
        X.escape(_text("<", _s(), "> & \"x\" 'y'")).alias("escaped"), X.markdown_to_html(_text("# ", _s(), "\n\nA **b** and *c*\n\n## Two")).alias("html"),
        X.safe_file_name(_text("../x/", _s(), "..name.")).alias("safe"), F.concat_ws("|", loose["title"], loose["presenter"], loose["date"]).alias("loose"),
        X.fill("Dear {{ Name }}, {{n}}!", {"name": _s(), "n": F.col("doc_id")}).alias("filled"),
        X.size_label((F.length(F.coalesce("text", F.lit(""))) * 1000 + 1).cast("double")).alias("size"),
    )


def _rows(names, *values):
    """An array of structs with the given names, a tuple of values each."""
    return F.array(*(F.struct(*((F.lit(v) if isinstance(v, (str, int)) else v).alias(n) for n, v in zip(names.split(), one, strict=True))) for one in values))


def _artifact():
    """A text with topics, terms and themes."""
    return _text("# T\n\n## Topics\n\n### ", _s(), " one\nFirst thing\n*_", (F.col("doc_id") % 20).cast("string"), "% of it; Sections 1-3_*\n\n### two\nSecond thing\n*_40% of it; Section 4_*\n\n## Key Terms\n\n### Alpha\nfirst\n\n**alpha**: other\n**",
             _s(), "**: second\n\n## Interpretive Themes\n\n1. **", _s(), "**: about it\nSource Sections: 2-3\n\n2. **b**: more\n\n3. **c**: most\n")


@query(
    "text_variants",
    rf"""
    WITH t AS (SELECT doc_id, s, i, nullif(regexp_replace(lower(text), '[^a-z ]', '', 'g'), '') AS body FROM {_D})
    SELECT doc_id, 'so it s ' || s || ' no ' || i AS quote, 'well ' || s || '  x yes ' || i AS plain, s || ' it s ' || i || ' sound' AS spoken,
           coalesce(trim(regexp_replace(regexp_replace(body, '\b(so|again|just|really|uh|um|you know|i mean|like|actually|basically)\b', ' ', 'g'), ' +', ' ', 'g')), '') AS whole FROM t
    """,
)
def text_variants(spark, sf_dir):
    """Forms for comparison: of composed sentences, and of whole texts, of which letters and blanks are kept."""
    quote = _text("**Ann:** So <strong>Bob:</strong> it's [sic] (sit) ", _s(), " [00:12:30] (no) [sic] ", _i())
    plain = _text("Ann Lee: Well, ", _s(), ' - "x" Dr. Kerr: yes; ', _i())
    spoken = _text("**Ann:** So, ", _s(), " you know, it's just -- like um \"", _i(), '" really; sound')
    letters = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z ]", "")
    return _docs(spark, sf_dir).select(
        "doc_id", X.comparable(quote, "quote").alias("quote"), X.comparable(plain, "plain").alias("plain"), X.comparable(spoken, "spoken").alias("spoken"),
        X.comparable(letters, "spoken").alias("whole"),
    )


@query(
    "parsed_artifacts",
    rf"""
    SELECT doc_id, CASE WHEN doc_id % 20 >= 5 THEN 'two:40,' || s || ' one:' || (doc_id % 20) ELSE 'two:40' END AS topics, s || '=about it=2-3;b=more=' AS themes, 'Alpha,' || s AS terms, '## Topics' || chr(10) || '## Key Terms' AS headers,
           s || '=body a;Two=body b' AS headed, (doc_id % 5 + 1) || ',' || (doc_id % 5 + 2) || ',' || (doc_id % 5 + 3) AS ranged, 'a|' || s || '|b' AS labels, doc_id AS cached,
           'Explicit/A1/' || floor((80 + 90 + doc_id % 10) / 2)::INTEGER || '/' || s || '/five words are in here' AS scored, 'Text ' || i AS summary, doc_id AS in_object, 1 + doc_id AS in_array, '{{"source":"' || s || '","n":' || i || '}}' AS serialised,
           doc_id % 101 AS voice, 3 AS n_sections
    FROM {_D}
    """,
)
def parsed_artifacts(spark, sf_dir):
    text = F.col("t")
    joined = lambda a, f, sep: F.array_join(F.transform(a, f), sep)
    scored = parse.scored_items(_text("[Explicit - A1 - Rank: 80-", (90 + F.col("doc_id") % 10).cast("string"), "%] Concept: ", _s(), '\n"five words are in here"'))
    headed = parse.headed_sections(_text("## 1. **", _s(), "**\nbody a\n## Two\nbody b"))
    themes = parse.first_themes(parse.themes(parse.section(text, "Interpretive Themes")))
    voice = parse.voice_audit(_text('Here: ```json\n{"overall_score": ', (F.col("doc_id") % 101).cast("string"), ', "verdict": "fine"}\n``` done'))
    return _docs(spark, sf_dir).withColumn("t", _artifact()).select(
        "doc_id", joined(parse.top_topics(parse.topics(parse.section(text, "Topics"))), lambda t: F.concat_ws(":", t["name"], t["percentage"].cast("string")), ",").alias("topics"),
        joined(themes, lambda t: F.concat_ws("=", t["name"], F.trim(t["description"], F.lit(" \n")), t["sections"]), ";").alias("themes"),
        joined(parse.key_terms(parse.section(text, "Key Terms")), lambda t: t["term"], ",").alias("terms"), parse.normalize_headers(F.lit("**Topics:**\n2. Key Terms")).alias("headers"),
        joined(headed, lambda x: F.concat_ws("=", x["heading"], F.trim(x["content"], F.lit(" \n"))), ";").alias("headed"),
        joined(parse.section_range(_text((F.col("doc_id") % 5 + 1).cast("string"), "-", (F.col("doc_id") % 5 + 3).cast("string"))), lambda n: n.cast("string"), ",").alias("ranged"),
        F.array_join(parse.labels(_text("a; ;", _s(), " ;b")), "|").alias("labels"), parse.cache_tokens(_text("Yes (Read ", _i(), ")"), "Read").alias("cached"),
        joined(scored, lambda x: F.concat_ws("/", x["type"], x["category"], x["score"].cast("string"), x["concept"], x["quote"]), ";").alias("scored"),
        compose.summary_body(_text("---\na: b\n---\n\n## Summary\n\nText ", _i(), "\n\n## Next\nmore")).alias("summary"),
        parse.json_object(_text('```json\n{"a": ', _i(), "}\n```"), "a long")["a"].alias("in_object"),
        F.aggregate(parse.json_array(_text("x [1, ", _i(), "] y"), "long"), F.lit(0).cast("long"), lambda a, x: a + x).alias("in_array"),
        F.to_json(F.struct(_s().alias("source"), F.col("doc_id").alias("n"))).alias("serialised"), voice["overall_score"].cast("long").alias("voice"),
        parse.section_count(_text("## Section 1\na\n## Section 2 ", _s(), "\n## Section 3")).alias("n_sections"),
    )


@query(
    "composed_texts",
    rf"""
    SELECT doc_id, 'Shows that ' || s || ' grows quickly' AS point, 'Shows that ' || s || ' grows quickly|The system of ' || l || ' is wide and old' AS points,
           trim(repeat('word ', 140)) || '...' AS cut, 'Lee said that ' || s || ' is new. ' || trim(repeat('b ', 100)) || '.' AS picked, '> ' || s || ' one' || chr(10) || '> two' AS block,
           '> **Reference - ' || s || ':** "it ''is'' so"' AS lines, l || ' systems emotional process' AS topics, s || ' and more|what ' || l || ' does' AS asked,
           'Opening of ' || s || '.' AS opening, 'Middle one.' || chr(10) || chr(10) || 'Middle two.' AS middle, 'Closing of ' || l || '.' AS closing
    FROM {_D}
    """,
)
def composed_texts(spark, sf_dir):
    long = _text("Nothing of ", _l(), " here at all. Lee said that ", _s(), " is new. ", F.lit("b " * 99 + "b. "), F.lit("c " * 60 + "c."))
    parts = parse.opening_body_closing(parse.paragraphs(_text("# Head\n\nA short title\n\nOpening of ", _s(), ".\n\nMiddle one.\n\nMiddle two.\n\nClosing of ", _l(), ".")))
    return _docs(spark, sf_dir).select(
        "doc_id", compose.key_point(_text("The speaker shows that ", _s(), " grows quickly.")).alias("point"),
        F.array_join(compose.key_points(_text("He shows that ", _s(), " grows quickly. Short one. The system of ", _l(), " is wide and old. This shows that ", _s(), " grows quickly.")), "|").alias("points"),
        compose.compact_quote(F.lit("word " * 150), "Lee").alias("cut"), compose.compact_quote(long, "Lee").alias("picked"), compose.quote_block(_text("# Quotes\n\n1. ", _s(), " one\n- two\n\n"), "Quotes").alias("block"),
        compose.quote_lines(_rows("label quote", (_s(), 'it  "is" so'), ("", "x"))).alias("lines"),
        F.array_join(questions.clean_topics(F.array(_text("the ", _l(), " systems of emotional process in families"), F.lit("it"))), "|").alias("topics"),
        F.array_join(compose.question_types(F.array(_text("They ask about ", _s(), " and more, thinking about what ", _l(), " does. And on x."))), "|").alias("asked"),
        parts["opening"].alias("opening"), parts["body"].alias("middle"), parts["closing"].alias("closing"),
    )


@query(
    "stated_aims",
    rf"""
    SELECT doc_id, 'Today we explore ' || s || '.' AS purpose, 'In conclusion ' || l || ' wins.' AS conclusion, 'In conclusion ' || l || ' wins.' AS closing, 'Question of ' || s || '?' AS open_question, 'Next we go to ' || l || '.' AS direction,
           s || ' begins.' AS exchanges, 'growing ' || l || ' question' AS qa_topics, 'Not explicitly stated' AS no_purpose
    FROM {_D}
    """,
)
def stated_aims(spark, sf_dir):
    text = _text("## Section 1\nToday we explore ", _s(), ". I want to rest.\n## Section 2\nA question, a comment: about growing ", _l(), " question.\n## Section 3\nIn conclusion ", _l(), " wins. So the answer is ", _i(), ". Question of ", _s(),
                 "? It goes. Next we go to ", _l(), ".\n")
    late = _text("## Section 1\nThis suggests ", _l(), " less.\n## Section 2\nNothing.\n## Section 3\nIn conclusion ", _l(), " wins.\n")
    closing = questions.closing(text)
    turns = _text("**Dr Lee:** ", F.lit("y" * 220), "\n**", _s(), ":** ", _s(), " begins. ", F.lit("x" * 210))
    return _docs(spark, sf_dir).select(
        "doc_id", questions.purpose(text).alias("purpose"), questions.conclusion(late).alias("conclusion"), closing["conclusion"].alias("closing"), closing["open_question"].alias("open_question"),
        closing["direction"].alias("direction"), F.array_join(questions.notable_exchanges(turns), "|").alias("exchanges"), F.array_join(questions.qa_topics(text), "|").alias("qa_topics"),
        questions.purpose(_text("## Section 1\n", _s(), " only.")).alias("no_purpose"),
    )


@query(
    "validity_flags",
    rf"""
    SELECT doc_id, doc_id % 3 = 0 AS refused, doc_id % 2 = 0 AS topics_valid, TRUE AS terms_valid, doc_id % 4 IN (0, 2) AS strict, doc_id % 4 IN (0, 1, 2) AS loose, 'misc,' || l AS lexicon,
           CASE WHEN doc_id % 2 = 0 THEN 'section reference;list' ELSE '' END AS issues, CASE doc_id % 6 WHEN 0 THEN 'no message' WHEN 1 THEN 'other role' WHEN 2 THEN 'cut off' WHEN 3 THEN 'too few words' WHEN 4 THEN 'other model' ELSE 'valid' END AS answer,
           '.abstract,.key-terms' AS classes, CASE WHEN doc_id % 2 = 0 THEN 'starts with a vague pronoun' WHEN doc_id % 10 < 5 THEN 'score outside its band' ELSE '' END AS item, doc_id % 5 < 2 AS proportional
    FROM {_D}
    """,
)
def validity_flags(spark, sf_dir):
    n = F.col("doc_id")
    pick = lambda m, *values: F.element_at(F.array(*(v if not isinstance(v, str) else F.lit(v) for v in values)), (n % m + 1).cast("int"))
    issues, _ = coverage.structure_messages(F.when(n % 2 == 0, _text("As Section 3 says\n- ", _s())).otherwise(_s()), F.lit(2))
    quote = pick(4, _text("Dr. Lee, of ", _s(), ", said that it holds"), "Lee " + "x" * 90 + " said", "to quote Lee on this one", "nobody spoke")
    answer = F.struct(pick(6, "a b", "a b", "a b", "a", "a b", "a b").alias("text"), pick(6, "end_turn", "end_turn", "max_tokens", "end_turn", "end_turn", "end_turn").alias("stop_reason"),
                      pick(6, "m-1", "m-1", "m-1", "m-1", "other", "m-1").alias("model"), F.lit(1).alias("input_tokens"), F.lit(1).alias("output_tokens"))
    fault = completion.answer_fault(answer, models=F.array(F.lit("m-")), kind=pick(6, "error", *["message"] * 5), role=pick(6, "assistant", "user", *["assistant"] * 4), least_words=2)
    items = _docs(spark, sf_dir).withColumns({
        "category": F.when(n % 2 == 0, "A1 long name").otherwise("B15"), "score": F.when(n % 2 == 0, 97).otherwise(F.when(n % 10 < 5, 95).otherwise(90)),
        "quote": F.when(n % 2 == 0, _text("This is what ", _s(), " means")).otherwise(_text("what ", _s(), " means to us")),
    })
    judged = patterns.judged_items(items, patterns.band_table(spark))
    page = F.lit("<style>.reference{} .emphasis{} .sidebar{} .metadata{}</style>")
    return judged.select(
        "doc_id", patterns.refused(pick(3, _text("Could you please provide the full document for ", _s()), _s(), _l())).alias("refused"),
        compose.valid_section(F.lit("Topics"), pick(2, _text("### ", _s(), "\nabout"), "nothing in it")).alias("topics_valid"), compose.valid_section(F.lit("key terms"), _text("**", _s(), "**: said")).alias("terms_valid"),
        patterns.attributed(quote, "Lee").alias("strict"), patterns.loosely_attributed(quote, "Lee").alias("loose"),
        F.array_join(F.concat(patterns.lexicon_hits(_text("Miscellaneous ", _l()), ["misc", "other"]), F.array(_l())), ",").alias("lexicon"), F.array_join(issues, ";").alias("issues"),
        F.coalesce(fault, F.lit("valid")).alias("answer"), F.array_join(pages.missing_classes(page), ",").alias("classes"), F.array_join("faults", ";").alias("item"),
        coverage.proportion(F.lit(100), 100 + (n % 5) * 40, F.lit(False))["within"].alias("proportional"),
    )


@query(
    "highlighted_documents",
    rf"""
    WITH t AS (SELECT doc_id, i, 'It isn''t so, ' || i || ': ' AS lead, 'the well-known' || chr(10) || '<b>mark</b> of source' AS part, text FROM {_D})
    SELECT doc_id, length(lead)::INTEGER AS start, length(lead || part)::INTEGER AS stop, 1.0::DOUBLE AS ratio, md5(lead || '<mark class="emphasis" title="e; r">' || part || '</mark> &amp; more. ' || text) AS marked, 1 AS marks FROM t
    """,
)
def highlighted_documents(spark, sf_dir):
    """FUZ-1 and marks at raw places, over whole texts."""
    docs = spread(_docs(spark, sf_dir)).withColumn("t", _text("It isn't so, ", _i(), ": the well-known\n<b>mark</b> of source &amp; more. ", F.coalesce("text", F.lit(""))))
    found = docs.withColumn("f", similarity.find_text(aggressive=True)(F.lit("The well known mark of source"), "t")).select("doc_id", "t", "f.*")
    one, other = (docs.select("doc_id", F.lit(0).alias("ordinal"), F.lit(a).alias("label"), F.lit(q).alias("quote")) for a, q in (("r", "known mark of"), ("e", "the well-known mark of source")))
    quotes = pages.typed_quotes({"reference": one, "emphasis": other})
    marked = pages.highlighted(found, quotes, text="t")
    return marked.select("doc_id", "start", F.col("end").alias("stop"), "ratio", F.md5(F.col("highlighted.text").cast("binary")).alias("marked"), "highlighted.marks")


@query(
    "correction_patching",
    rf"""
    WITH t AS (SELECT doc_id, i, text, 'It isn''t so, ' || i || ':' || chr(10) || chr(10) AS lead, ' <i>End</i> of it. ' AS tail FROM {_D})
    SELECT doc_id, 2 AS applied, 1 AS skipped, md5(lead || 'CORRECTED now CHANGED' || tail || text) AS patched, 2 AS in_turn, '- a -> b' AS changes, '- c -> ' || i AS review
    FROM t
    """,
)
def correction_patching(spark, sf_dir):
    """INT-1 and INT-3 with a misspelt original at its raw place, one that occurs word for word, and one that isn't there; change log and routes."""
    passage = "the quik brown fox jumped over the lazy dog and never looked back again"
    docs = _docs(spark, sf_dir).withColumn("t", _text("It isn't so, ", _i(), f":\n\n{passage} now zz<qq>zz <i>End</i> of it. ", F.coalesce("text", F.lit(""))))
    found = docs.select("doc_id", F.inline(_rows("ordinal original_text suggested_correction", (0, passage.replace("quik", "quick"), "CORRECTED"), (1, "zz<qq>zz", "CHANGED"), (2, "☃☃☃☃☃☃", "NEVER"))))
    both = patching.patched(docs, found, text="t").withColumnRenamed("patched", "p")
    both = patching.patched(both, found, text="t", rule=patching.patch_in_turn)
    routed = docs.select("doc_id", F.inline(_rows("ordinal confidence original_text suggested_correction", (0, "High", "a", "b"), (1, "medium", "c", _i()), (2, "low", "d", "e"))))
    return both.join(patching.change_log(docs, routed), "doc_id").select(
        "doc_id", "p.applied", F.size("p.skipped").alias("skipped"), F.md5(F.col("p.text").cast("binary")).alias("patched"), F.col("patched.applied").alias("in_turn"), "changes", "review",
    )


@query(
    "alignment_report",
    rf"""
    WITH n AS (SELECT *, len(list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda w: regexp_matches(w, '[\p{{L}}\p{{N}}]'))) AS n FROM {_D})
    SELECT doc_id, n AS same_checked, 0 AS same_mismatches, CASE WHEN n > 0 THEN n + 1 ELSE 0 END AS inserted_checked, 0 AS inserted_mismatches, n + 1 AS deleted_checked, 1 AS deleted_mismatches,
           CASE WHEN n > 0 THEN '0 ωωextra | ' || first || ' | Skipped in A (deletion in B)' ELSE '0 ωωextra |  | B exhausted' END AS shown, 'Welcome ' || s || ' and all.' AS cleaned
    FROM (SELECT *, coalesce(list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda w: regexp_matches(w, '[\p{{L}}\p{{N}}]'))[1], '') AS first FROM n)
    """,
)
def alignment_report(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    docs = spread(_docs(spark, sf_dir)).select("doc_id", text.alias("a"), _text("ωωextra ", text).alias("b"), alignment.cleaned(_text("Ann Lee  0:12\nWelcome ", _s(), " [00:01:05] and all.\nTranscribed by someone"), phrases=alignment.PROCEDURE).alias("cleaned"))
    out = docs
    for name, x, y in (("same", "a", "a"), ("inserted", "a", "b"), ("deleted", "b", "a")):
        out = alignment.alignment_report(out, x, y, stop_ratio=1.0).drop("passes").withColumnRenamed("alignment", name)
    return out.select(
        "doc_id", *(c for n in ("same", "inserted", "deleted") for c in (F.col(f"{n}.checked").alias(f"{n}_checked"), F.col(f"{n}.mismatch_count").alias(f"{n}_mismatches"))),
        F.array_join(alignment.shown(F.col("deleted.mismatches")), ";").alias("shown"), "cleaned",
    )


def _claimed(spark, sf_dir):
    """Documents that begin with a passage, and by their number a claim that they hold, hold misspelt, or don't hold."""
    n = F.col("doc_id") % 3
    docs = _docs(spark, sf_dir).select("doc_id", _text("Here ", _i(), " the quick brown fox jumped over the lazy dog and ran . ", F.coalesce("text", F.lit(""))).alias("text"))
    claim = F.when(n == 0, "the quick brown fox jumped over the lazy dog and ran").when(n == 1, "the quick brown fqx jumped over the lazy dog and ran").otherwise("☃☃☃ ☄☄☄☄")
    return docs, docs.select("doc_id", claim.alias("claim"))


@query(
    "grounded_claims",
    """
    WITH d AS (SELECT doc_id, doc_id % 3 AS n FROM documents)
    SELECT doc_id, CASE n WHEN 0 THEN 1.0 WHEN 1 THEN round(51 / 52, 6) ELSE 0.0 END::DOUBLE AS ratio, CASE WHEN n < 2 THEN 'VALID' ELSE 'INVALID' END AS quote, CASE WHEN n < 2 THEN 'EXACT' ELSE 'FAIL' END AS term,
           CASE WHEN n < 2 THEN 'EXACT' ELSE 'FAIL' END AS topic, n < 2 AS found, n < 2 AS kept FROM d
    """,
)
def grounded_claims(spark, sf_dir):
    """Quotes, terms, topics, references and findings against the documents they are of."""
    docs, claims = _claimed(spark, sf_dir)
    quotes = grounding.quotes_grounded(claims.withColumnRenamed("claim", "quote"), docs).select("doc_id", F.round("ratio", 6).alias("ratio"), F.col("result").alias("quote"))
    terms = grounding.terms_grounded(claims.select("doc_id", F.col("claim").alias("term"), F.col("claim").alias("definition")), docs).select("doc_id", F.col("result").alias("term"))
    topics = claims.select("doc_id", F.col("claim").alias("name"), F.col("claim").alias("description"), F.lit("").alias("section_text"))
    topics = grounding.topics_grounded(topics, docs).select("doc_id", F.col("result").alias("topic"))
    found = patching.grounded(claims.select("doc_id", F.col("claim").alias("original_text")), docs).select("doc_id", F.lit(True).alias("found"))
    two = claims.select("doc_id", F.col("claim").alias("quote")).unionByName(claims.select("doc_id", F.lit("the quick brown fox").alias("quote")))
    kept = grounding.references_kept(two, docs).groupBy("doc_id").agg((F.count("*") == 2).alias("kept"))
    out = quotes.join(terms, "doc_id").join(topics, "doc_id").join(found, "doc_id", "left").join(kept, "doc_id", "left")
    return out.na.fill(False, ["found", "kept"])


@query(
    "grounded_counts",
    """
    SELECT n AS kind, count(*) FILTER (n < 2) AS valid, 0::BIGINT AS partial, count(*) FILTER (n = 2) AS invalid, CASE WHEN n < 2 THEN 100.0 ELSE 0.0 END::DOUBLE AS accuracy FROM (SELECT doc_id % 3 AS n FROM documents) GROUP BY n
    """,
)
def grounded_counts(spark, sf_dir):
    docs, claims = _claimed(spark, sf_dir)
    got = grounding.quotes_grounded(claims.withColumnRenamed("claim", "quote"), docs).withColumn("kind", F.col("doc_id") % 3)
    return grounding.counts(got, "kind", ("VALID", "PARTIAL", "INVALID"))


@query(
    "joined_quotes",
    rf"""
    SELECT doc_id, 'one ' || s || ' two' AS best, TRUE AS alike, TRUE AS matched, 'whole' AS into_, doc_id % 2 = 0 AS verdict, CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS sampled, 'lost' AS missing FROM {_D}
    """,
)
def joined_quotes(spark, sf_dir):
    """Best highlight of a category, first container, verdicts by place, sampled names, and labels that are missing."""
    docs = _docs(spark, sf_dir)
    quotes = docs.select("doc_id", F.lit(0).alias("ordinal"), F.lit("emphasis").alias("category"), _text("one ", _s()).alias("quote"))
    lights = docs.select("doc_id", F.inline(_rows("type text", ("emphasis", _text("one ", _s(), " two")), ("sidebar", _text("one ", _s())), ("emphasis", "☃☃☃"))))
    best = compose.best_highlights(quotes, lights).select("doc_id", F.col("best_text").alias("best"), (F.col("ratio") >= 0.9).alias("alike"), "matched")
    wholes = docs.select("doc_id", F.inline(_rows("ordinal label quote", (0, "other", "☃"), (1, "whole", _text("so ONE ", _s(), " it is")), (2, "later", _text("one ", _s())))))
    into = compose.first_container(docs.select("doc_id", F.lit("part").alias("label"), _text("One  ", _s()).alias("quote")), wholes).select("doc_id", F.col("into").alias("into_"))
    answers = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "NO: first\n\nYES: second").otherwise("YES").alias("answer"))
    verdicts = completion.verdicts(docs.select("doc_id", F.lit(1).alias("ordinal")), answers, "doc_id").select("doc_id", "verdict")
    names = F.array(_s(), F.when(F.col("doc_id") % 2 == 0, _l()).otherwise("☃"), *(F.lit(f"n{i}") for i in range(4)))
    sampled = docs.select("doc_id", pages.sampled_coverage(names, F.array(F.upper(_s()), F.concat(_l(), F.lit(" text")))).alias("sampled"))
    labels = docs.select("doc_id", F.explode(F.array(F.lit("kept"), F.lit("lost"))).alias("label"))
    missing = coverage.missing_labels(labels, docs.select("doc_id", F.lit("kept").alias("label"))).select("doc_id", F.col("label").alias("missing"))
    out = best
    for part in (into, verdicts, sampled, missing):
        out = out.join(part, "doc_id")
    return out


@query(
    "planned_coverage",
    rf"""
    WITH n AS (SELECT doc_id, s, doc_id % 4 AS n FROM {_D})
    SELECT doc_id, n < 2 AS passes, CASE WHEN n < 2 THEN '4/4' ELSE '3/4' END AS required_coverage, CASE n WHEN 0 THEN '2/2' WHEN 1 THEN '1/2' WHEN 2 THEN '2/2' ELSE '1/2' END AS optional_coverage,
           CASE n WHEN 0 THEN 'PASSED - all required items covered' WHEN 1 THEN 'PASSED with 1 low-confidence items - human review recommended' ELSE 'FAILED - missing required: omega' END AS summary,
           CASE n WHEN 0 THEN '' WHEN 1 THEN 'missing:sigma ring' WHEN 2 THEN 'missing:omega' ELSE 'missing:omega;missing:sigma ring' END AS review
    FROM n
    """,
)
def planned_coverage(spark, sf_dir):
    """Items of a plan, what of them a text covers, the verdict and the list for review."""
    n = F.col("doc_id") % 4
    topic = lambda name, share: F.struct(F.lit(name).alias("name"), F.lit(share).alias("percentage"), F.lit("").alias("description"))
    theme = lambda name: F.struct(F.lit(name).alias("name"), F.lit("").alias("description"))
    plans = _docs(spark, sf_dir).select(
        "doc_id", F.lit("Speaker Name").alias("presenter"), F.array(topic("omega", 20), topic("kappa", 10)).alias("topics"), F.array(theme("delta wave"), theme("sigma ring")).alias("themes"),
        F.lit("show growth").alias("purpose"), F.lit(None).cast("string").alias("conclusion"), F.lit(0).alias("qa_percentage"), F.array().cast("array<string>").alias("qa_topics"),
        F.concat(F.lit("speaker name shows growth in kappa and the delta wave"), F.when(n < 2, " of omega").otherwise(""), F.when(n % 2 == 0, " in a sigma ring").otherwise("")).alias("body"),
    )
    items = coverage.items(plans).join(plans.select("doc_id", "body"), "doc_id").select("doc_id", "category", "label", "required", "keywords", coverage.covered(F.col("body"), F.col("keywords")).alias("c"))
    order = F.array_position(F.array(*map(F.lit, ("speaker", "omega", "kappa", "delta wave", "sigma ring", "purpose"))), F.col("label"))
    checked = items.select("doc_id", "label", "required", "keywords", order.alias("ordinal"), F.col("label").alias("source_text"), "c.covered", "c.confidence")
    review = coverage.review_list(checked).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", F.concat_ws(":", "state", "label").alias("x")))), lambda x: x["x"]), ";").alias("review"))
    return coverage.rollup(checked).drop("to_review").join(coverage.verdict_line(checked), "doc_id").join(review, "doc_id", "left").na.fill("", ["review"])


@query(
    "usage_log",
    """
    WITH u AS (SELECT event_type AS script, floor(abs(value) * 100) AS i, floor(floor(abs(value) * 100) / 5) AS c, ts FROM events)
    SELECT script, count(*) AS calls, sum(i)::BIGINT AS tokens_in, sum(c)::BIGINT AS created FROM u WHERE date_trunc('second', ts) >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY script
    """,
)
def usage_log(spark, sf_dir):
    """Calls as rows of the log, written as CSV, read back, filtered by time and rolled up."""
    e = table(spark, sf_dir, "events", "event_type", "ts", "value")
    n = F.floor(F.abs("value") * 100)
    calls = e.select(F.col("event_type").alias("script"), F.lit("m").alias("model"), F.lit("ok").alias("status"), n.alias("tokens_in"), F.floor(n / 3).alias("tokens_out"), F.floor(n / 5).alias("created"), F.lit(0).alias("read"), "ts",
                     *(F.lit(1.0).alias(f"rate_{r}") for r in usage.RATES))
    path = scratch(spark, "usage")
    artifacts.append_usage(usage.log_rows(calls, F.col("ts")), path)
    rows = usage.since(usage.read_usage(spark, path), F.lit("2024-01-10 00:00:00").cast("timestamp"))
    return rows.groupBy("script").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("cache_created").alias("created"))


@query(
    "artifact_files",
    rf"SELECT doc_id::VARCHAR AS stem, l AS kind, md5('---' || chr(10) || 'source: ' || s || chr(10) || '---' || chr(10) || chr(10) || text) AS text_md5, md5(text) AS section_md5 FROM {_D} WHERE l IN ('en', 'fr') AND NOT starts_with(text, '---')",
)
def artifact_files(spark, sf_dir):
    """Texts with front matter, written as artifacts by kind and read back for two of them."""
    docs = _docs(spark, sf_dir).select(_i().alias("stem"), _l().alias("kind"), F.coalesce("text", F.lit("")).alias("text"), "source").filter(~F.col("text").startswith("---"))
    path = scratch(spark, "artifacts")
    artifacts.write_artifacts(artifacts.with_front_matter(docs, {"source": F.coalesce("source", F.lit("none"))}), path)
    got = artifacts.read_artifacts(spark, path, "en", "fr")
    return got.select("stem", "kind", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.md5(X.strip_front_matter(F.col("text")).cast("binary")).alias("section_md5"))


@query(
    "file_plans",
    r"""
    WITH f AS (SELECT doc_id, coalesce(source, 'none') AS s, doc_id % 3 AS v, row_number() OVER (PARTITION BY coalesce(source, 'none'), doc_id % 3 ORDER BY 'p/' || doc_id) - 1 AS j FROM documents),
    m AS (SELECT s, max(v) AS top FROM f GROUP BY s)
    SELECT 'p/' || doc_id AS path, 'old/' || s || CASE WHEN v = 0 THEN '' ELSE '_v' || v END || CASE WHEN j = 0 THEN '' ELSE '_' || j END || '.txt' AS target, v < top AS outdated, CASE WHEN doc_id % 2 = 0 THEN 'project' ELSE 'direct' END AS place FROM f JOIN m USING (s)
    """,
)
def file_plans(spark, sf_dir):
    """Which files would move or go, and the place that each is read from."""
    v = F.col("doc_id") % 3
    files = _docs(spark, sf_dir).select("doc_id", _text("p/", _i()).alias("path"), F.concat(_s(), F.when(v > 0, F.concat(F.lit("_v"), v.cast("string"))).otherwise(""), F.lit(".txt")).alias("name"))
    moved = artifacts.moves(files, "old", spark.createDataFrame([("another.txt",)], "name string"))
    gone = artifacts.outdated(files).select("path", F.lit(True).alias("outdated"))
    places = files.select("path", F.explode(F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("legacy"), F.lit("project"))).otherwise(F.array(F.lit("legacy"), F.lit("direct")))).alias("place"))
    chosen = artifacts.preferred(places, "path", ["direct", "project", "legacy"]).select("path", "place")
    return moved.join(gone, "path", "left").join(chosen, "path").na.fill(False, ["outdated"])


@query(
    "generated_texts",
    r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    p AS (SELECT *, trim('Format this transcript.' || chr(10) || chr(10) || t, E' \t\n\r\f\v') AS p, len(list_filter(string_split_regex(t, '[ \t\n\r\f\v]+'), lambda w: w <> '')) AS n FROM d),
    a AS (SELECT *, list_filter(string_split_regex(string_split(p, chr(10) || chr(10))[-1], '[ \t\n\r\f\v]+'), lambda w: w <> '')[1:50] AS w FROM p)
    SELECT doc_id, md5(array_to_string(w, ' ')) AS formatted, CASE WHEN len(w) = 0 THEN 'no text' WHEN len(w) < 0.5 * n THEN 'lost words' ELSE 'valid' END AS fault FROM a
    """,
)
def generated_texts(spark, sf_dir):
    """Every text formatted by the offline backend, which echoes; answers that lose words are told."""
    got = generation.formatted(_docs(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    return got.select("doc_id", F.md5(F.col("formatted").cast("binary")).alias("formatted"), F.coalesce("fault", F.lit("valid")).alias("fault"))


@query(
    "generated_parts",
    rf"""SELECT doc_id, TRUE AS accepted, '### ' || s || ' about it' AS section, '{{"source":"' || s || '","n":' || i || '}}' AS written, '' AS issues, doc_id % 50 AS voice, (n - (n > 1)::INTEGER - (n > 2)::INTEGER)::INTEGER AS fits, (n > 2)::INTEGER AS doubtful FROM (SELECT *, length(text) % 8 + 1 AS n FROM {_D})""",
)
def generated_parts(spark, sf_dir):
    """A section, a text from a plan and an audit of voice, each echoed by the offline backend, and judged headings of as many sections as the text's length says, without the second."""
    docs = _docs(spark, sf_dir)
    section = generation.section_of(docs.select("doc_id", _text("### ", _s(), "\nabout it").alias("text")), "key terms").select("doc_id", "accepted", "section")
    plans = docs.select("doc_id", _s().alias("source"), F.col("doc_id").alias("n"))
    written = generation.structured(plans, ["source", "n"], F.lit(1)).select("doc_id", "written", F.array_join("issues", ";").alias("issues"))
    voice = generation.voice_audited(docs.select("doc_id", _text('{"overall_score": ', (F.col("doc_id") % 50).cast("string"), "}").alias("text"))).select("doc_id", F.col("audit.overall_score").cast("long").alias("voice"))
    sections = docs.select("doc_id", F.explode(F.sequence(F.lit(1), F.length(F.coalesce("text", F.lit(""))) % 8 + 1)).alias("number")).filter("number <> 2")
    sections = sections.withColumns({"heading": F.when(F.col("number") == 3, "No").otherwise("Yes"), "content": F.lit("oh yes\n\nof course")})
    heads = generation.headers_judged(sections, backend=generation.HeadingBackend()).groupBy("doc_id").agg(F.count_if("fits").cast("int").alias("fits"), F.count_if(~F.col("fits")).cast("int").alias("doubtful"))
    return section.join(written, "doc_id").join(voice, "doc_id").join(heads, "doc_id")


@query(
    "page_checks",
    r"""
    WITH p AS (SELECT page_id, html, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h FROM pages)
    SELECT page_id, 1.0::DOUBLE AS rate, FALSE AS low, 2::BIGINT AS in_text, len(regexp_extract_all(html, '<h2[ >]')) AS on_page, len(regexp_extract_all(html, '<h2[ >]')) = 2 AS agree, '<h1>' || page_id || '</h1>' AS printed FROM p
    """,
)
def page_checks(spark, sf_dir):
    """Quotes that pages show, rates of them, numbers of sections, and a page for print."""
    p = table(spark, sf_dir, "pages", "page_id", "html")
    body = pages.page_text(F.col("html"))
    quotes = p.select("page_id", F.lit("head").alias("kind"), F.array_join(F.slice(X.words(body), 1, 5), " ").alias("quote"))
    rates = pages.audit_rates(pages.quotes_present(p, quotes)).select("page_id", "rate", "low")
    agree = p.select("page_id", pages.sections_agree(F.lit("## One\na\n## Two\nb"), F.col("html")).alias("a")).select("page_id", F.col("a.text").alias("in_text"), F.col("a.page").alias("on_page"), "a.agree")
    printed = pages.printable(p.select("page_id", F.col("page_id").cast("string").alias("title"), F.lit("Body").alias("body")), "title", "body").select("page_id", F.regexp_extract("page", "<h1>.*?</h1>", 0).alias("printed"))
    return rates.join(agree, "page_id").join(printed, "page_id")


@query(
    "model_settings",
    """
    WITH m AS (SELECT DISTINCT p_brand AS name, CASE WHEN p_brand < 'Brand#3' THEN 'large' ELSE 'unknown' END AS model, CASE WHEN p_brand < 'Brand#2' THEN 250000 WHEN p_brand < 'Brand#4' THEN 4096 ELSE 0 END AS n FROM part)
    SELECT name, 'model' AS rule, 'error' AS severity FROM m WHERE model = 'unknown' UNION ALL SELECT name, 'tokens', 'error' FROM m WHERE n <= 0 UNION ALL SELECT name, 'tokens', 'warning' FROM m WHERE n > 200000 UNION ALL SELECT name, 'timeout', 'warning' FROM m
    """,
)
def model_settings(spark, sf_dir):
    """Limits of models against a price book, a model for each brand."""
    b = F.col("p_brand")
    models = table(spark, sf_dir, "part", "p_brand").distinct().select(
        b.alias("name"), F.when(b < "Brand#3", "large").otherwise("unknown").alias("model"), F.when(b < "Brand#2", 250_000).when(b < "Brand#4", 4096).otherwise(0).alias("max_tokens"), F.lit(5).alias("timeout"))
    book = spark.createDataFrame(list(usage.TIERS), usage.PRICE_BOOK)
    return settings.model_violations(models, book).select("name", "rule", "severity")
