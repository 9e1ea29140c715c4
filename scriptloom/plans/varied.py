"""Queries whose texts differ in structure from row to row: in lengths, orders, gaps, overlaps and missing parts.

They read the tables' own texts where they can. The oracle states the result by hand, without the operators' own expressions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptloom.functions import parse
from scriptloom.functions import text as X
from scriptloom.operators import completion, generation, grounding, pages, patching, settings
from scriptloom.plans.catalogue import query
from scriptloom.plans.derived import _D, _docs, _i, _rows, _s, _text
from scriptloom.sources import artifacts
from scriptloom.sources.tables import scratch, table

#: A text of nothing but small letters, with one blank between words, in SQL and in Spark.
_LETTERS = "trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z \n]', '', 'g'), '[ \n]+', ' ', 'g'))"


def _letters():
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z \n]", ""), "[ \n]+", " "))


@query(
    "templates_filled",
    rf"""
    SELECT doc_id, md5('Write {{{{ text }}}} terms of ' || text || ' {{{{ kind }}}} {{{{TEXT}}}}' || chr(10) || 'for ' || s || ': {{{{ other }}}} {{{{ text }}}} terms.') AS filled,
           md5('<main><h1>' || '{{{{body}}}} ' || s || '</h1><p>' || 'x {{{{title}}}} ' || i || '</p></main>') AS page FROM {_D}
    """,
)
def templates_filled(spark, sf_dir):
    """Whole texts with placeholders of their own in a template that has them twice, and a page of such texts."""
    text = _text(F.coalesce("text", F.lit("")), " {{ kind }} {{TEXT}}")
    docs = _docs(spark, sf_dir).withColumns({"title": _text("{{body}} ", _s()), "body": _text("x {{title}} ", _i())})
    page = F.regexp_extract(F.col("page"), "<main>.*</main>", 0)
    return pages.rendered(docs, "title", "body").select(
        "doc_id", F.md5(X.fill("Write {{ kind }} of {{text}}\nfor {{ Name }}: {{ other }} {{KIND}}.", {"kind": F.lit("{{ text }} terms"), "text": text, "name": _s()}).cast("binary")).alias("filled"),
        F.md5(page.cast("binary")).alias("page"),
    )


#: Lines of texts as sections with gaps in their numbers: the first word is the heading, the rest the content.
_SECTIONS = rf"""
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS number FROM {_D}),
    t AS (SELECT doc_id, number, split_part(line, ' ', 1) AS heading, substr(line, length(split_part(line, ' ', 1)) + 2) AS content FROM l WHERE length(line) % 3 <> 0),
    j AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY number) - 1 AS place,
                 list_contains(string_split_regex(lower(content), '[\s\p{{Z}}]+'), lower(heading)) OR heading = '' AS fits FROM t)
"""


def _sections(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line")).filter("length(line) % 3 <> 0")
    first = F.split_part("line", F.lit(" "), F.lit(1))
    return docs.select("doc_id", (F.col("at") + 1).alias("number"), first.alias("heading"), F.expr("substr(line, length(split_part(line, ' ', 1)) + 2)").alias("content"))


@query("headings_judged", f"WITH {_SECTIONS} SELECT doc_id, number::INTEGER AS number, (place // 5)::INTEGER AS batch, (place % 5)::INTEGER AS at, fits FROM j")
def headings_judged(spark, sf_dir):
    """Headings of whole documents against their contents, five a prompt, whatever gaps their numbers have."""
    judged = generation.headers_judged(_sections(spark, sf_dir), backend=generation.HeadingBackend())
    return judged.select("doc_id", "number", "batch", "at", "fits")


@query(
    "header_reports",
    f"""WITH {_SECTIONS} SELECT doc_id, count(*) FILTER (contains(lower(heading), 'th') OR contains(lower(heading), 'es')) AS flagged, max(place // 5 + 1) AS batches, count(*) FILTER (fits) AS fit,
        count(*) FILTER (NOT fits) AS unfit FROM j GROUP BY doc_id""",
)
def header_reports(spark, sf_dir):
    """Markdown reports of judged headings, counted line by line."""
    report = generation.header_report(generation.headers_judged(_sections(spark, sf_dir), backend=generation.HeadingBackend()), ["th", "es"])
    many = lambda p: F.regexp_count("report", F.lit(p)).cast("long")  # noqa: E731
    return report.select("doc_id", many(r"(?m)^- \*\*Section").alias("flagged"), many("(?m)^### Batch").alias("batches"), many("(?m)^SECTION [0-9]+: YES$").alias("fit"), many("(?m)^SECTION [0-9]+: NO$").alias("unfit"))


@query(
    "file_moves",
    r"""
    WITH f AS (SELECT 'p/' || doc_id AS path, coalesce(source, 'none') AS s, n_chars % 7 AS v FROM documents),
    u AS (SELECT s, list(DISTINCT v) AS used FROM f WHERE v IN (1, 2, 4) GROUP BY s), own AS (SELECT DISTINCT s FROM f WHERE v = 0),
    n AS (SELECT f.path, f.s, row_number() OVER (PARTITION BY f.s ORDER BY path) - CASE WHEN own.s IS NULL THEN 1 ELSE 0 END AS j, count(*) OVER (PARTITION BY f.s) AS c FROM f LEFT JOIN own USING (s))
    SELECT path, 'old/' || s || CASE WHEN j = 0 THEN '' ELSE '_' || list_filter(range(1, c + 6), lambda x: NOT list_contains(coalesce(used, []::BIGINT[]), x))[j] END || '.txt' AS target FROM n LEFT JOIN u USING (s)
    """,
)
def file_moves(spark, sf_dir):
    """Files of one name a source, moved to where some names are taken, with gaps between their numbers."""
    docs = _docs(spark, sf_dir).withColumn("v", F.col("n_chars") % 7)
    taken = docs.filter("v IN (0, 1, 2, 4)").select(F.concat(_s(), F.when(F.col("v") > 0, F.concat(F.lit("_"), F.col("v").cast("string"))).otherwise(""), F.lit(".txt")).alias("name"))
    return artifacts.moves(docs.select(_text("p/", _i()).alias("path"), _text(_s(), ".txt").alias("name")), "old", taken)


@query(
    "settled_documents",
    rf"""
    WITH RECURSIVE d AS (SELECT doc_id, length(text) % 30 AS n, length(text) // 30 % 4 AS kind FROM {_D}),
    r AS (
        SELECT doc_id, kind, 0 AS round, n, NULL::BIGINT AS before, 0 AS stalled, 0::BIGINT AS f, 0::BIGINT AS a, NULL::VARCHAR AS ended FROM d
        UNION ALL
        SELECT doc_id, kind, round + 1, CASE WHEN e IS NULL AND kind < 2 THEN n - f ELSE n END, a, s, f, a, CASE WHEN e IS NULL AND round = 4 THEN 'rounds' ELSE e END
        FROM (SELECT *, CASE WHEN a = 0 THEN 'converged' WHEN s >= 2 THEN 'stalled' END AS e
              FROM (SELECT doc_id, kind, round, n, x AS f, y AS a, CASE WHEN before IS NOT NULL AND (before - y) / before < 0.2 THEN stalled + 1 ELSE 0 END AS s
                    FROM (SELECT *, CASE WHEN kind = 3 THEN 0 ELSE x END AS y FROM (SELECT *, CASE WHEN kind = 1 THEN (n + 1) // 2 ELSE n END AS x FROM r WHERE ended IS NULL AND round < 5))))),
    z AS (SELECT doc_id, n AS left_open FROM r WHERE ended IS NOT NULL)
    SELECT doc_id, round, f AS findings, a AS to_apply, CASE WHEN kind = 3 THEN f ELSE 0 END AS to_review, CASE WHEN ended IS NULL OR ended = 'rounds' THEN a ELSE 0 END::INTEGER AS applied, 0 AS skipped, ended, left_open
    FROM r JOIN z USING (doc_id) WHERE round > 0
    """,
)
def settled_documents(spark, sf_dir):
    """Rounds of finding and patching over whole texts; documents converge, stall or spend their rounds, each by itself and in different rounds."""
    size = F.length(F.coalesce("text", F.lit("")))
    docs = _docs(spark, sf_dir).select("doc_id", (size % 30).alias("n"), (F.floor(size / 30) % 4).alias("kind"), F.coalesce("text", F.lit("")).alias("body"))
    items = F.transform(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), lambda k: _text("item ", k.cast("string"), " of doc ", _i(), " is open"))
    docs = docs.select("doc_id", "kind", F.concat(F.when(F.col("n") > 0, F.array_join(items, "\n")).otherwise(""), F.lit("\n"), F.col("body")).alias("text"))

    def find(now):
        """All open items, half of them for kind 1; those of kind 2 stay open, those of kind 3 are for review."""
        found = F.regexp_extract_all("text", F.lit(r"(item \d+ of doc \d+ is open)"), F.lit(1))
        some = F.when(F.col("kind") == 1, F.slice(found, F.lit(1), F.ceil(F.size(found) / 2).cast("int"))).otherwise(found)
        rows = now.select("doc_id", "kind", F.posexplode(some).alias("ordinal", "original_text"))
        fixed = F.when(F.col("kind") == 2, _text(F.col("original_text"), " still")).otherwise(F.replace("original_text", F.lit("open"), F.lit("done")))
        return rows.select("doc_id", "ordinal", "original_text", fixed.alias("suggested_correction"), F.when(F.col("kind") == 3, "medium").otherwise("high").alias("confidence"))

    out, history = patching.until_settled(docs, find)
    left = out.select("doc_id", F.regexp_count("text", F.lit(r"item \d+ of doc \d+ is open")).cast("long").alias("left_open"))
    return history.drop("tokens_in", "tokens_out", "seconds").join(left, "doc_id")


@query(
    "marked_overlaps",
    rf"""
    WITH t AS (SELECT doc_id, text, doc_id % 5 AS k, regexp_extract(text, '^(\p{{L}}+(?: \p{{L}}+){{{{4}}}})(?:[ .,;!?\n]|$)', 1) AS q FROM {_D}),
    m AS (SELECT *, CASE k WHEN 0 THEN 'a1 b1 <mark class="emphasis" title="y">c1 d1 e1</mark> f1 g1 h1. '
        WHEN 1 THEN 'a1 b1 <mark class="emphasis score-95" title="e (95%); r">c1 d1 e1</mark> f1 g1 h1. '
        WHEN 2 THEN '<mark class="emphasis" title="e; r2; r1">a1 b1 c1 d1 e1 f1</mark> g1 h1. '
        WHEN 3 THEN 'a1 <mark class="emphasis score-90" title="e (91%); r">b1 c1 d1</mark> e1 <mark class="reference" title="s">f1 g1</mark> h1. ' ELSE 'a1 b1 c1 d1 e1 f1 g1 h1. ' END AS lead FROM t)
    SELECT doc_id, md5(lead || CASE WHEN q = '' THEN text ELSE '<mark class="reference" title="own">' || q || '</mark>' || substr(text, length(q) + 1) END) AS marked,
           (CASE k WHEN 3 THEN 2 WHEN 4 THEN 0 ELSE 1 END + CASE WHEN q = '' THEN 0 ELSE 1 END)::INTEGER AS marks FROM m
    """.replace("{{4}}", "{4}"),
)
def marked_overlaps(spark, sf_dir):
    """Marks of one kind and of two that overlap, also three at once, beside one of the text's own first words; a quote that is null, and one that isn't there."""
    own = F.regexp_extract("text", r"^(\p{L}+(?: \p{L}+){4})(?:[ .,;!?\n]|$)", 1)
    docs = _docs(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    names = "ordinal kind label quote"
    sets = [
        _rows(names, (0, "emphasis", "x", "a1 b1 c1"), (1, "emphasis", "y", "c1 d1 e1")), _rows(names, (0, "reference", "r", "a1 b1 c1"), (1, "emphasis", "e (95%)", "c1 d1 e1")),
        _rows(names, (0, "emphasis", "e", "a1 b1 c1 d1 e1 f1"), (1, "reference", "r1", "b1 c1"), (2, "reference", "r2", "e1 f1 g1")),
        _rows(names, (0, "reference", "r", "a1 b1"), (1, "reference", "s", "f1 g1"), (2, "emphasis", "e (91%)", "b1 c1 d1"), (3, "reference", "r", "d1 e1")),
        _rows(names, (0, "emphasis", "none", F.lit(None).cast("string")), (1, "emphasis", "lost", "☃ ☄ ☂ nowhere in it")),
    ]
    k = F.col("doc_id") % 5
    chosen = F.when(k == 0, sets[0]).when(k == 1, sets[1]).when(k == 2, sets[2]).when(k == 3, sets[3]).otherwise(sets[4])
    quotes = docs.select("doc_id", F.inline(chosen)).unionByName(docs.filter(own != "").select("doc_id", F.lit(9).alias("ordinal"), F.lit("reference").alias("kind"), F.lit("own").alias("label"), own.alias("quote")))
    marked = pages.highlighted(docs.withColumn("text", _text("a1 b1 c1 d1 e1 f1 g1 h1. ", F.col("text"))), quotes)
    return marked.select("doc_id", F.md5(F.col("highlighted.text").cast("binary")).alias("marked"), "highlighted.marks")


@query(
    "quote_clusters",
    rf"""
    WITH t AS (SELECT doc_id, string_split({_LETTERS}, ' ') AS w, length(coalesce(text, '')) % 8 + 3 AS cut FROM documents)
    SELECT doc_id, md5(CASE WHEN len(w) < 20 OR len(list_distinct(w[1:15])) < 15 THEN array_to_string(w, ' ') ELSE array_to_string(w[1:2], ' ') || ' <mark class="reference" title="q">' || array_to_string(w[3:14], ' ') || '</mark> ' || array_to_string(w[15:], ' ') END) AS marked
    FROM t
    """,
)
def quote_clusters(spark, sf_dir):
    """The third to fourteenth word of every text that begins with 15 different ones, as a quote that has lost one word and got another, found as the densest cluster."""
    docs = _docs(spark, sf_dir).select("doc_id", _letters().alias("text"), (F.length(F.coalesce("text", F.lit(""))) % 8 + 3).alias("cut"))
    w = F.split("text", " ")
    kept = F.concat(F.slice(w, F.lit(3), F.col("cut") - 2), F.array(F.lit("zzzzz")), F.slice(w, F.col("cut") + 2, 13 - F.col("cut")))
    quotes = docs.filter((F.size(w) >= 20) & (F.size(F.array_distinct(F.slice(w, 1, 15))) == 15)).select("doc_id", F.lit(0).alias("ordinal"), F.lit("reference").alias("kind"), F.lit("q").alias("label"), F.array_join(kept, " ").alias("quote"))
    return pages.highlighted(docs, quotes).select("doc_id", F.md5(F.col("highlighted.text").cast("binary")).alias("marked"))


@query(
    "graded_claims",
    rf"""
    WITH t AS (SELECT doc_id, string_split({_LETTERS}, ' ') AS w, length(coalesce(text, '')) % 16 AS k FROM documents),
    q AS (SELECT doc_id, k, len(w) >= 20 AS there, array_to_string(w[1:3], ' ') = '' AS empty, length(array_to_string(w[5:12], ' ')) AS n FROM t),
    g AS (SELECT *, CASE WHEN there AND 2 * n / (2 * n + k) >= 0.85 THEN 2 * n / (2 * n + k) ELSE 0.0 END AS ratio, there AND k % 2 = 0 AS defined FROM q)
    SELECT doc_id, round(ratio, 6) AS ratio, CASE WHEN ratio >= 0.95 THEN 'VALID' WHEN ratio >= 0.8 THEN 'PARTIAL' ELSE 'INVALID' END AS quote,
           CASE WHEN ratio >= 0.95 AND defined THEN 'EXACT' WHEN ratio >= 0.85 AND defined THEN 'PARTIAL' WHEN ratio >= 0.75 OR defined THEN 'WEAK' ELSE 'FAIL' END AS term,
           ratio >= 0.9 OR doc_id % 2 = 0 OR empty AS kept
    FROM g
    """,
)
def graded_claims(spark, sf_dir):
    """Eight words of every text with up to fifteen letters more, null where the text is short: as a quote, as a term whose definition is there or null, and as a reference beside a found one or alone."""
    docs = _docs(spark, sf_dir).select("doc_id", _letters().alias("text"), (F.length(F.coalesce("text", F.lit(""))) % 16).alias("k"))
    w = F.split("text", " ")
    quote = F.concat(F.array_join(F.slice(w, 5, 8), " "), F.repeat(F.lit("☃"), F.col("k")))
    claims = docs.select("doc_id", F.when(F.size(w) >= 20, quote).alias("quote"), F.when((F.col("k") % 2 == 0) & (F.size(w) >= 20), F.array_join(F.slice(w, 2, 9), " ")).alias("definition"))
    quotes = grounding.quotes_grounded(claims, docs).select("doc_id", F.round("ratio", 6).alias("ratio"), F.col("result").alias("quote"))
    terms = grounding.terms_grounded(claims.withColumnRenamed("quote", "term"), docs).select("doc_id", F.col("result").alias("term"))
    beside = docs.filter("doc_id % 2 = 1").select("doc_id", F.array_join(F.slice(w, 1, 3), " ").alias("quote"), F.lit(True).alias("beside"))
    references = claims.select("doc_id", "quote", F.lit(False).alias("beside")).unionByName(beside)
    kept = grounding.references_kept(references, docs).filter("NOT beside").select("doc_id", F.lit(True).alias("kept"))
    return quotes.join(terms, "doc_id").join(kept, "doc_id", "left").na.fill(False, ["kept"])


@query(
    "all_sections",
    rf"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {_D}),
    h AS (SELECT *, CASE WHEN length(line) % 4 > 0 AND regexp_matches(line, '^[A-Za-z]') THEN (length(line) % 4)::INTEGER END AS level FROM l),
    n AS (SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS o, lead(i) OVER (PARTITION BY doc_id, level IS NULL ORDER BY i) AS next FROM h),
    s AS (SELECT * FROM n WHERE level IS NOT NULL),
    p AS (SELECT a.doc_id, a.o, max(b.o) AS parent FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.o < a.o AND b.level < a.level GROUP BY ALL),
    z AS (SELECT a.doc_id, a.o, min(b.i) AS stop FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.o > a.o AND b.level <= a.level GROUP BY ALL),
    x AS (SELECT s.doc_id, s.o, sum(CASE WHEN n.level IS NULL THEN length(n.line) ELSE length(n.line) + n.level + 1 END) AS n FROM s LEFT JOIN z USING (doc_id, o) JOIN n ON n.doc_id = s.doc_id AND n.i > s.i AND (stop IS NULL OR n.i < stop) GROUP BY ALL),
    y AS (SELECT doc_id, o, sum(length(line)) AS n FROM n WHERE level IS NULL GROUP BY ALL)
    SELECT s.doc_id, s.o::INTEGER AS ordinal, s.level, trim(s.line) AS heading, coalesce(parent, -1)::INTEGER AS parent, coalesce(y.n, 0)::INTEGER AS body, coalesce(x.n, 0)::INTEGER AS whole
    FROM s LEFT JOIN p USING (doc_id, o) LEFT JOIN x USING (doc_id, o) LEFT JOIN y ON y.doc_id = s.doc_id AND y.o = s.o
    """,
)
def all_sections(spark, sf_dir):
    """Every section of every level of whole texts, whose lines are headings of a level by their lengths; bodies by the characters of their lines."""
    mark = lambda x: F.when((F.length(x) % 4 > 0) & x.rlike("^[A-Za-z]"), F.concat(F.repeat(F.lit("#"), F.length(x) % 4), F.lit(" "), x)).otherwise(x)  # noqa: E731
    docs = _docs(spark, sf_dir).select("doc_id", F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), mark), "\n").alias("text"))
    letters = lambda c: F.length(F.replace(c, F.lit("\n")))  # noqa: E731
    rows = docs.select("doc_id", F.inline(parse.all_sections(F.col("text"))))
    return rows.select("doc_id", "ordinal", "level", "heading", F.coalesce("parent", F.lit(-1)).alias("parent"), letters("body").alias("body"), letters("whole").alias("whole"))


@query(
    "implied_elements",
    r"""
    WITH p AS (SELECT page_id, page_id % 4 + 1 AS n, page_id::VARCHAR AS i FROM pages)
    SELECT page_id, array_to_string(list_transform(range(1, n + 1), lambda k: 'item ' || k) || ['inner', 'outer ' || i || 'inner', 'last'], '|') AS items, 'term ' || i || '|other' AS terms, 'meaning|more said' AS meanings,
           'a ' || i || '|in|c|b inc d|' || 'e' AS cells, 'inc|a ' || i || 'b inc d|e' AS lines, 'One ' || i || '|two|three' AS paragraphs, 'one|two' AS options FROM p
    """,
)
def implied_elements(spark, sf_dir):
    """Lists, definitions, tables within tables, paragraphs and choices without end tags, of as many items as the page's number says, in front of the page."""
    p = table(spark, sf_dir, "pages", "page_id", "html")
    i = F.col("page_id").cast("string")
    items = F.array_join(F.transform(F.sequence(F.lit(1), F.col("page_id") % 4 + 1), lambda k: F.concat(F.lit("<li class=x>item "), k.cast("string"))), "\n")
    html = _text(
        "<ul>", items, "<li class=x>outer ", i, "<ul><li class=x>inner</ul><li class=x>last</ul><dl><dt class=x>term ", i, "<dd class=x>mean<b>ing<dt class=x>other<dd class=x>more<br>\nsaid</dl>",
        "<table><tr class=x><td class=x>a ", i, "<td class=x>b <table><tr class=x><td class=x>in<td class=x>c</table> d<tr class=x><td class=x>e</table>",
        "<p class=x>One ", i, "<p class=x>two<div><p class=x>three</div></p>", "<select><option class=x>one<option class=x>two</select>", F.coalesce("html", F.lit("")))
    of = lambda tag, css="x": F.array_join(pages.select(tag, css)("html"), "|")  # noqa: E731
    return p.select("page_id", html.alias("html")).select(
        "page_id", of("li").alias("items"), of("dt").alias("terms"), of("dd").alias("meanings"), of("td").alias("cells"), of("tr").alias("lines"), of("p").alias("paragraphs"), of("option").alias("options"))


@query(
    "answers_once",
    rf"""
    WITH p AS (SELECT doc_id, trim('Which language is ' || l || '?' || chr(10) || chr(10) || left(string_split(text, chr(10))[1], 20), E' 	

') AS p FROM {_D}),
    a AS (SELECT *, list_filter(string_split_regex(string_split(p, chr(10) || chr(10))[-1], '[ 	

]+'), lambda w: w <> '')[1:50] AS w FROM p)
    SELECT doc_id, array_to_string(w, ' ') AS answer, (SELECT count(DISTINCT 'Which language is ' || l || '?' || chr(10) || chr(10) || left(string_split(text, chr(10))[1], 20)) FROM {_D}) AS asked FROM a
    """,
)
def answers_once(spark, sf_dir):
    """Prompts of which many are equal, answered twice over: the second time none is asked."""
    docs = _docs(spark, sf_dir)
    rows = docs.select("doc_id", _text("Which language is ", F.coalesce("lang", F.lit("xx")), "?\n\n", F.left(F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)), F.lit(20))).alias("prompt"))
    store = scratch(spark, "answers")
    completion.answered_once(rows, "prompt", store, parts=2)
    again = completion.answered_once(rows, "prompt", store, parts=2)
    asked = spark.read.parquet(store).agg(F.count("*").alias("asked"))
    return again.select("doc_id", F.col("answer.text").alias("answer")).crossJoin(F.broadcast(asked))


_WORDS_OF = f"(SELECT doc_id, list_filter(string_split({_LETTERS}, ' '), lambda w: w <> '') AS w, length(coalesce(text, '')) AS c FROM documents)"


def _worded(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.filter(F.split(_letters(), " "), lambda x: x != "").alias("w"), F.length(F.coalesce("text", F.lit(""))).alias("c"))


def _lines(n, line):
    """``line(i)`` for i from 0 on, ``n`` times, as one text."""
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), line), "")).otherwise(F.lit(""))


@query(
    "varied_topics",
    rf"""
    WITH t AS (SELECT doc_id, doc_id % 3 AS f, list_transform(range(0, least(c % 7, len(w))), lambda i: {{'i': i, 'name': 'T' || i || ' ' || w[i + 1], 'p': (length(w[i + 1]) * 7 + i * 3) % 40}}) AS t FROM {_WORDS_OF}),
    r AS (SELECT doc_id, f, list_filter(t, lambda x: x.p >= 5) AS strict, list_transform(t, lambda x: {{'i': x.i, 'name': x.name, 'p': greatest(5, 100 - x.i * 10)}}) AS ranked FROM t),
    x AS (SELECT doc_id, CASE WHEN f = 0 AND len(strict) > 0 THEN strict ELSE ranked END AS x FROM r)
    SELECT doc_id, array_to_string(list_transform(x, lambda y: y.name || ':' || y.p), ',') AS topics,
           array_to_string(list_transform(list_sort(list_transform(x, lambda y: {{'k': -y.p, 'i': y.i, 'name': y.name}}))[1:5], lambda y: y.name || ':' || -y.k), ',') AS largest FROM x
    """,
)
def varied_topics(spark, sf_dir):
    """Topics in one of three formats, none to six of them, named after the text's words; shares that are too small, and ranks for shares."""
    n = F.least(F.col("c") % 7, F.size("w"))
    word = lambda i: F.get("w", i)  # noqa: E731
    name = lambda i: F.concat(F.lit("T"), i.cast("string"), F.lit(" "), word(i))  # noqa: E731
    share = lambda i: ((F.length(word(i)) * 7 + i * 3) % 40).cast("string")  # noqa: E731
    strict = _lines(n, lambda i: F.concat(F.lit("### "), name(i), F.lit("\nAbout "), word(i), F.lit("\n*_"), share(i), F.lit("% of it; Sections 1-3_*\n\n")))
    heads = _lines(n, lambda i: F.concat(F.lit("### "), name(i), F.lit("\nAbout "), word(i), F.lit("\n\n")))
    entries = _lines(n, lambda i: F.concat(F.lit("- **"), name(i), F.lit("**: about "), word(i), F.lit("\n")))
    f = F.col("doc_id") % 3
    text = _text("## Topics\n\n", F.when(f == 0, strict).when(f == 1, heads).otherwise(entries), "\n## Next\n\n### Not one\n")
    found = parse.topics(parse.section(F.col("t"), "Topics"))
    told = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["name"], x["percentage"].cast("string"))), ",")  # noqa: E731
    return _worded(spark, sf_dir).withColumn("t", text).select("doc_id", told(found).alias("topics"), told(parse.top_topics(found)).alias("largest"))


@query(
    "varied_terms",
    rf"""
    WITH t AS (SELECT doc_id, c, w[1:c % 6] AS head, list_transform(w[c % 4 + 1:c % 9], lambda x: upper(x)) AS bold FROM {_WORDS_OF}),
    a AS (SELECT doc_id, c, list_concat(head, bold) AS all_, head FROM t)
    SELECT doc_id, array_to_string(list_filter(all_, lambda x, i: list_position(list_transform(all_, lambda y: lower(y)), lower(x)) = i), ',') AS terms,
           array_to_string(list_transform(head, lambda x, i: x || '=about ' || i || '=' || CASE WHEN i % 2 = 1 THEN i || '-' || (i + c % 3) ELSE '' END), ';') AS themes,
           array_to_string(list_transform(head, lambda x, i: CASE WHEN i % 2 = 1 THEN array_to_string(range(i, i + c % 3 + 1), ' ') ELSE '' END), ';') AS sections
    FROM a
    """,
)
def varied_terms(spark, sf_dir):
    """Key terms as headings and bold lines, of which some name the same term in capitals; themes with and without the sections that they come from."""
    head = F.slice("w", F.lit(1), F.col("c") % 6)
    bold = F.slice("w", F.col("c") % 4 + 1, F.greatest(F.col("c") % 9 - F.col("c") % 4, F.lit(0)))
    terms = _text(F.array_join(F.transform(head, lambda x: F.concat(F.lit("### "), x, F.lit("\nfirst\n"))), ""), F.array_join(F.transform(bold, lambda x: F.concat(F.lit("**"), F.upper(x), F.lit("**: second\n"))), ""))
    source = lambda i: F.when(i % 2 == 0, F.concat(F.lit("Source Sections: "), (i + 1).cast("string"), F.lit("-"), (i + 1 + F.col("c") % 3).cast("string"), F.lit("\n"))).otherwise("")  # noqa: E731
    themes = F.array_join(F.transform(head, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". **"), x, F.lit("**: about "), (i + 1).cast("string"), F.lit("\n"), source(i))), "")
    rows = _worded(spark, sf_dir).withColumn("t", _text("# Plan\n\n## Key Terms\n", terms, "\n## Interpretive Themes\n", themes, "\n# End\n**Not**: here\n"))
    got = parse.themes(parse.section(F.col("t"), "Interpretive Themes"))
    trimmed = lambda c: F.trim(c, F.lit(" \n"))  # noqa: E731
    return rows.select(
        "doc_id", F.array_join(F.transform(parse.key_terms(parse.section(F.col("t"), "Key Terms")), lambda x: x["term"]), ",").alias("terms"),
        F.array_join(F.transform(got, lambda x: F.concat_ws("=", x["name"], trimmed(x["description"]), x["sections"])), ";").alias("themes"),
        F.array_join(F.transform(got, lambda x: F.array_join(F.transform(parse.section_range(x["sections"]), lambda n: n.cast("string")), " ")), ";").alias("sections"),
    )


@query(
    "whole_files",
    rf"SELECT l AS lang, sum(length(text) + 1)::BIGINT AS n_chars, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS n_lines, count(*) FILTER (contains(text, 'the '))::BIGINT AS n_the, TRUE AS listed FROM {_D} GROUP BY l",
)
def whole_files(spark, sf_dir):
    """Texts written as files, read whole, checked and listed: characters and lines of each language, and a folder of names without texts."""
    folder = scratch(spark, "files")
    docs = _docs(spark, sf_dir).select(F.coalesce("lang", F.lit("xx")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    docs.write.partitionBy("lang").text(folder)
    files = artifacts.checked(artifacts.read_texts(spark, folder, "*.txt"))
    lang = F.regexp_extract("path", "/lang=([^/]*)/", 1)
    sums = files.groupBy(lang.alias("lang")).agg(F.sum(F.length("text")).alias("n_chars"), F.sum(F.length(F.regexp_replace("text", "[^\n]", ""))).cast("long").alias("n_lines"))
    the = docs.groupBy("lang").agg(F.count_if(F.contains("text", F.lit("the "))).alias("n_the"))
    listed = artifacts.listing(spark, folder, "*.txt").select(lang.alias("lang")).distinct().withColumn("listed", F.lit(True))
    return sums.join(the, "lang").join(listed, "lang", "left")


@query(
    "lexicon_terms",
    """
    WITH l AS (SELECT DISTINCT CASE WHEN p_partkey % 4 = 0 THEN '# ' ELSE '  ' END || p_name || CASE WHEN p_partkey % 4 = 1 THEN '.' ELSE '' END AS line FROM part),
    t AS (SELECT lower(trim(line)) AS term FROM l WHERE NOT starts_with(trim(line), '#'))
    SELECT term, regexp_replace(term, '[.]$', '') IN (SELECT regexp_replace(regexp_replace(term, '[#*_`]', '', 'g'), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g') FROM t) AS skipped FROM t
    """,
)
def lexicon_terms(spark, sf_dir):
    """A lexicon and a list of words to skip, from lines with comments, blanks and punctuation."""
    key = F.col("p_partkey") % 4
    lines = table(spark, sf_dir, "part", "p_partkey", "p_name").select(F.concat(F.when(key == 0, "# ").otherwise("  "), F.col("p_name"), F.when(key == 1, ".").otherwise("")).alias("value")).distinct()
    lines.write.text(folder := scratch(spark, "lexicon"))
    words = artifacts.skip_words(spark, folder).withColumn("skipped", F.lit(True))
    terms = artifacts.lexicon(spark, folder)
    return terms.withColumn("word", F.regexp_replace("term", "[.]$", "")).join(words, "word", "left").select("term", F.coalesce("skipped", F.lit(False)).alias("skipped"))


@query(
    "kept_versions",
    rf"""
    WITH d AS (SELECT doc_id, text, length(text) % 3 AS k FROM {_D})
    SELECT doc_id, v::INTEGER AS version, md5(CASE WHEN v = 0 OR k = 2 THEN 'draft ' || doc_id || ' one' WHEN v = 1 OR k = 1 THEN 'draft ' || doc_id || ' two' ELSE 'draft ' || doc_id || ' three' END || chr(10) || text) AS version_md5 FROM d, range(0, 3) t(v)
    """,
)
def kept_versions(spark, sf_dir):
    """Two rounds of patching in turn over whole texts, of which some change twice, some once and some never; every version is kept."""
    docs = _docs(spark, sf_dir).select("doc_id", (F.length(F.coalesce("text", F.lit(""))) % 3).alias("k"), _text("draft ", _i(), " one\n", F.coalesce("text", F.lit(""))).alias("text"))

    def find(now):
        head = F.substring_index(F.col("text"), "\n", 1)
        new = F.when(head.endswith(" one") & (F.col("k") < 2), F.replace(head, F.lit(" one"), F.lit(" two"))).when(head.endswith(" two") & (F.col("k") == 0), F.replace(head, F.lit(" two"), F.lit(" three")))
        return now.select("doc_id", F.lit(0).alias("ordinal"), head.alias("original_text"), new.alias("suggested_correction")).filter("suggested_correction IS NOT NULL")

    versions = patching.fixed_rounds(docs, find)
    return versions.select("doc_id", "version", F.md5(F.col("text").cast("binary")).alias("version_md5"))


class _Unsteady(completion.OfflineBackend):
    """Fails at every second call: what Retrying is for."""

    calls = 0

    def complete(self, prompts):
        _Unsteady.calls += 1
        if _Unsteady.calls % 2:
            raise ConnectionError("not now")
        return super().complete(prompts)


def _no_wait(_seconds):
    return None


@query(
    "retried_answers",
    r"""
    SELECT doc_id, array_to_string(list_filter(string_split_regex(string_split(trim('Tell.' || chr(10) || chr(10) || coalesce(text, ''), E' \t\n\r\f\v'), chr(10) || chr(10))[-1], '[ \t\n\r\f\v]+'), lambda w: w <> '')[1:3], ' ') AS said FROM documents
    """,
)
def retried_answers(spark, sf_dir):
    """Answers of a backend that fails at every second call, asked again until it answers."""
    rows = _docs(spark, sf_dir).select("doc_id", X.fill("Tell.\n\n{{ text }}", {"text": F.col("text")}).alias("prompt"))
    got = completion.completed(rows, "prompt", completion.Retrying(_Unsteady(), 3, 0.0, _no_wait))
    return got.select("doc_id", F.array_join(F.slice(F.filter(F.split("answer.text", " "), lambda w: w != ""), 1, 3), " ").alias("said"))


@query(
    "written_audits",
    rf"""SELECT doc_id, CASE WHEN length(text) % 4 = 0 THEN -1 ELSE length(text) % 101 END AS score, CASE WHEN length(text) % 4 = 0 THEN '' ELSE s || ' "so"' END AS verdict FROM {_D}""",
)
def written_audits(spark, sf_dir):
    """Audits read from answers, of which some can't be read, written as JSON lines and read back."""
    size = F.length(F.coalesce("text", F.lit("")))
    answer = F.when(size % 4 == 0, F.lit("no verdict")).otherwise(_text("So: ```json\n", F.to_json(F.struct((size % 101).alias("overall_score"), _text(_s(), ' "so"').alias("verdict"))), "\n```"))
    audits = _docs(spark, sf_dir).select("doc_id", parse.voice_audit(answer).alias("audit"))
    artifacts.write_audits(audits, folder := scratch(spark, "audits"))
    read = spark.read.schema("doc_id long, audit struct<overall_score: double, verdict: string>").json(folder)
    return read.select("doc_id", F.coalesce(F.col("audit.overall_score").cast("long"), F.lit(-1)).alias("score"), F.coalesce("audit.verdict", F.lit("")).alias("verdict"))


@query(
    "paths_and_sets",
    """
    WITH p AS (SELECT s_name AS name, s_suppkey % 5 <> 0 AS there, s_suppkey % 7 <> 0 AS folder, s_suppkey % 3 <> 0 AS writable, s_suppkey % 2 = 0 AS needed FROM supplier),
    b AS (SELECT p_brand AS name, list_sort(list(DISTINCT CASE WHEN p_size <= 3 THEN 'level ' || p_size END)) AS v FROM part WHERE p_size <= 4 GROUP BY p_brand)
    SELECT 'path' AS rule, CASE WHEN NOT there AND needed OR there AND NOT folder THEN 'error' ELSE 'warning' END AS severity, name, CASE WHEN NOT there THEN 'missing' WHEN NOT folder THEN 'no folder' ELSE 'not writable' END AS message
    FROM p WHERE NOT (there AND folder AND writable)
    UNION ALL SELECT 'set', CASE WHEN len(list_filter(v, lambda x: x IS NOT NULL)) = 0 THEN 'warning' ELSE 'error' END, name, CASE WHEN len(list_filter(v, lambda x: x IS NOT NULL)) = 0 THEN 'empty' ELSE 'unknown: level 3' END
    FROM b WHERE len(list_filter(v, lambda x: x IS NOT NULL)) = 0 OR substr(name, 7)::INTEGER <= 12 AND list_contains(v, 'level 3')
    UNION ALL SELECT 'file', 'warning', s_name, 'missing: ' || s_suppkey % 40 FROM supplier WHERE s_suppkey % 40 NOT IN (SELECT n_nationkey FROM nation)
    """,
)
def paths_and_sets(spark, sf_dir):
    """Paths, sets of levels and named files that settings may not have: of suppliers, brands and nations."""
    n = F.col("s_suppkey")
    supplier = table(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    paths = supplier.select(F.col("s_name").alias("name"), (n % 5 != 0).alias("exists"), (n % 7 != 0).alias("folder"), (n % 3 != 0).alias("writable"), (n % 2 == 0).alias("needed"))
    levels = F.collect_set(F.when(F.col("p_size") <= 3, F.concat(F.lit("level "), F.col("p_size").cast("string"))))
    brands = table(spark, sf_dir, "part", "p_brand", "p_size").filter("p_size <= 4").groupBy(F.col("p_brand").alias("name")).agg(levels.alias("values"))
    known = {f"Brand#{i}": ("level 1", "level 2") for i in range(1, 13)}
    wanted = supplier.select(F.col("s_name").alias("name"), (n % 40).cast("string").alias("file"))
    there = table(spark, sf_dir, "nation", "n_nationkey").select(F.col("n_nationkey").cast("string").alias("name"))
    return settings.path_violations(paths).unionByName(settings.set_violations(brands, known)).unionByName(settings.missing_files(wanted, there))
