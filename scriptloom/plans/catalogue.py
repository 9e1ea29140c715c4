"""The catalogue: one Spark query and, where SQL can express it, one DuckDB oracle per name.

Queries run over whole tables. The test tables hold no transcripts, so some queries first give rows the form that their operator reads
(headings, file names, usage columns), in the query and the oracle alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptloom.functions import parse
from scriptloom.functions import text as X
from scriptloom.operators import completion, coverage, grounding, pages, patching, patterns, questions, settings, usage
from scriptloom.sources import artifacts
from scriptloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
#: SQL of the words and keywords of a column
_WORDS = r"list_filter(string_split_regex(coalesce({0}, ''), '[ \t\n\r\f\v]+'), lambda w: w <> '')"
_KEYS = f"list_filter(regexp_extract_all(lower({{0}}), '([a-z]+)', 1), lambda w: length(w) >= 4 AND w NOT IN ({_STOP}))"
_DISTINCT_KEYS = f"list_filter({_KEYS}, lambda w, i: list_position({_KEYS}, w) = i)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and its oracle under one name."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents", *(columns or ("doc_id", "text")))


# -- documents: counts, forms, keywords, sentences, chunks


@query(
    "document_quality",
    f"""
    SELECT doc_id, len({_WORDS.format('text')}) AS n_words, CAST(floor(length(coalesce(text, '')) / 4) AS BIGINT) AS n_tokens,
           floor(length(coalesce(text, '')) / 4) > 8000 * 0.8 AS over_budget, length(coalesce(text, '')) > 10000 AS large,
           regexp_matches(trim(right(coalesce(text, ''), 100)), '[.!?"'']$') AS ends_well,
           contains(lower(coalesce(text, '')), '...[truncated]') OR contains(lower(coalesce(text, '')), '[content cut off]')
           OR contains(lower(coalesce(text, '')), '...(continued)') OR contains(lower(coalesce(text, '')), '[output limit reached]') AS cut_off
    FROM documents
    """,
)
def document_quality(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    return _docs(spark, sf_dir).select(
        "doc_id", X.word_count(text).alias("n_words"), X.token_estimate(text).alias("n_tokens"), X.over_budget(text, 8000).alias("over_budget"),
        X.is_large(text).alias("large"), X.ends_well(text).alias("ends_well"), X.cut_off(text).alias("cut_off"),
    )


@query("token_budget", "SELECT lang, count(*) AS n_docs, CAST(sum(floor(length(text) / 4)) AS BIGINT) AS n_tokens, count(*) FILTER (floor(length(text) / 4) > 800) AS n_over, max(least(floor(length(text) / 4), 4096)) AS most_output FROM documents GROUP BY lang")
def token_budget(spark, sf_dir):
    n = X.token_estimate(F.col("text"))
    docs = _docs(spark, sf_dir, "lang", "text").select("lang", n.alias("n"), X.over_budget(F.col("text"), 1000).alias("over"))
    capped = X.output_cap(F.col("n"), F.col("lang"), {"en": 4096, "fr": 4096, "de": 4096, "es": 4096})
    return docs.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"), F.count_if("over").alias("n_over"), F.max(capped).cast("double").alias("most_output"))


@query(
    "abstract_target_words",
    f"""SELECT doc_id, greatest(CAST(floor(n * 0.03) AS INTEGER), 150) AS target, CASE WHEN n < 4000 THEN 6 WHEN n < 8000 THEN 9 ELSE 12 END AS lenses
        FROM (SELECT doc_id, len({_WORDS.format('text')}) AS n FROM documents)""",
)
def abstract_target_words(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", X.word_count(F.col("text")).alias("n"))
    return docs.select("doc_id", X.target_words(F.col("n")).alias("target"), X.lens_count(F.col("n")).alias("lenses"))


@query("normalized_documents", r"SELECT doc_id, regexp_replace(trim(regexp_replace(lower(coalesce(text, '')), '[ \t\n\r\f\v]+', ' ', 'g')), '[,;:.!?]', '', 'g') AS form FROM documents")
def normalized_documents(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.normalize_comparison(F.coalesce("text", F.lit(""))).alias("form"))


@query(
    "sentence_context",
    r"""
    WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \t\n\r\f\v]+([A-Z"''(])', '\1' || chr(31) || '\2', 'g'), chr(31)) AS s FROM documents),
    r AS (SELECT doc_id, unnest(range(len(s))) AS i, trim(unnest(s), E' \t\n\r\f\v') AS sentence FROM s),
    k AS (SELECT * FROM r WHERE sentence <> '')
    SELECT doc_id, row_number() OVER w - 1 AS ordinal, sentence, coalesce(lag(sentence) OVER w, '') AS before, coalesce(lead(sentence) OVER w, '') AS after
    FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)
    """,
)
def sentence_context(spark, sf_dir):
    return patterns.sentence_rows(_docs(spark, sf_dir)).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "sentence", "before", "after")


@query(
    "emphasis_sentences",
    r"""
    WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \t\n\r\f\v]+([A-Z"''(])', '\1' || chr(31) || '\2', 'g'), chr(31)) AS s FROM documents),
    r AS (SELECT doc_id, unnest(range(len(s))) AS i, trim(unnest(s), E' \t\n\r\f\v') AS sentence FROM s),
    k AS (SELECT * FROM r WHERE sentence <> ''),
    c AS (SELECT *, coalesce(lag(sentence) OVER w, '') AS before, coalesce(lead(sentence) OVER w, '') AS after FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i))
    SELECT doc_id, sentence, before, after, CASE WHEN regexp_matches(sentence, '(?i)(?:licensed|license)') THEN '1' WHEN regexp_matches(sentence, '(?i)that[ ,]+this') THEN '2' ELSE '3' END AS tier
    FROM c WHERE NOT regexp_matches(sentence, '(?i)password|token') AND regexp_matches(sentence, '(?i)(?:licensed|license)|that[ ,]+this|with[ ,]+it')
    """,
)
def emphasis_sentences(spark, sf_dir):
    tiers = (("1", "terms", "(?:licensed|license)"), ("2", "pointing", "that[ ,]+this"), ("3", "joining", "with[ ,]+it"))
    rows = patterns.sentence_rows(_docs(spark, sf_dir))
    return patterns.classified(rows, tiers=tiers, exclusions=("password|token",)).select("doc_id", "sentence", "before", "after", "tier")


@query(
    "document_keywords",
    f"""
    WITH k AS (SELECT doc_id, {_KEYS.format('text')} AS k FROM documents), u AS (SELECT doc_id, unnest(k) AS k, unnest(range(len(k))) AS i FROM k),
    f AS (SELECT doc_id, k, min(i) AS i FROM u GROUP BY ALL)
    SELECT d.doc_id, count(k) AS n, coalesce(string_agg(k, ' ' ORDER BY i), '') AS keywords FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id
    """,
)
def document_keywords(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", X.keywords(F.col("text")).alias("k"))
    return docs.select("doc_id", F.size("k").cast("long").alias("n"), F.array_join("k", " ").alias("keywords"))


@query("keyword_document_frequency", f"SELECT keyword, count(*) AS n_docs FROM (SELECT DISTINCT doc_id, unnest({_KEYS.format('text')}) AS keyword FROM documents) GROUP BY keyword")
def keyword_document_frequency(spark, sf_dir):
    return _docs(spark, sf_dir).select(F.explode(X.keywords(F.col("text"))).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n_docs"))


@query(
    "keyword_overlap_pairs",
    f"""
    WITH d AS (SELECT DISTINCT doc_id, unnest({_KEYS.format('text')}) AS k FROM documents), b AS (SELECT DISTINCT item_id, unnest({_KEYS.format('text')}) AS k FROM benchmark),
    n AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id)
    SELECT doc_id, item_id, round(count(*) / any_value(n), 6) AS ratio FROM d JOIN b USING (k) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) / any_value(n) >= 0.5
    """,
)
def keyword_overlap_pairs(spark, sf_dir):
    pairs = grounding.keyword_pairs(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return pairs.withColumn("ratio", F.round("ratio", 6))


@query(
    "chunk_documents",
    f"""
    WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), n AS (SELECT doc_id, w, len(w) AS n FROM w WHERE len(w) > 0),
    k AS (SELECT doc_id, w, n, CAST(greatest(0, floor((n - 130) / 80) + 1) AS INTEGER) AS k FROM n), c AS (SELECT *, unnest(range(k + 1)) AS chunk FROM k)
    SELECT doc_id, chunk, chunk * 80 AS start, CASE WHEN chunk < k THEN chunk * 80 + 100 ELSE n END AS stop,
           array_to_string(list_slice(w, chunk * 80 + 1, CASE WHEN chunk < k THEN chunk * 80 + 100 ELSE n END), ' ') AS text FROM c
    """,
)
def chunk_documents(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", X.words(F.coalesce("text", F.lit(""))).alias("w"))
    spans = docs.select("doc_id", "w", F.explode(X.chunk_spans(F.size("w"), 100, 20)).alias("c"))
    text = F.array_join(F.slice("w", F.col("c.start") + 1, F.col("c.end") - F.col("c.start")), " ")
    return spans.select("doc_id", F.col("c.chunk").cast("long").alias("chunk"), F.col("c.start").cast("long").alias("start"), F.col("c.end").cast("long").alias("stop"), text.alias("text"))


@query(
    "repeated_phrases",
    f"""
    WITH w AS (SELECT doc_id, {_WORDS.format('lower(text)')} AS w FROM documents)
    SELECT doc_id, len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS n_repeated FROM w
    """,
)
def repeated_phrases(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", X.words(F.lower("text")).alias("w"))
    ahead = F.slice("w", F.lit(2), F.size("w"))
    return docs.select("doc_id", F.size(F.filter(F.zip_with("w", ahead, lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x)).cast("long").alias("n_repeated"))


@query("finding_dedup", "SELECT text_hash, doc_id FROM (SELECT md5(text) AS text_hash, doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def finding_dedup(spark, sf_dir):
    found = _docs(spark, sf_dir).select(F.lit(0).alias("all"), F.md5(F.col("text").cast("binary")).alias("original_text"), F.lit("").alias("suggested_correction"), "doc_id")
    return patching.first_findings(found, "all", "doc_id").select(F.col("original_text").alias("text_hash"), "doc_id")


@query(
    "finding_validity",
    f"""
    WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(31), 'g'), chr(31))) AS s FROM documents)
    SELECT doc_id, CASE WHEN n < 5 THEN 'context too short' WHEN n > 30 THEN 'context too long' ELSE 'ok' END AS fault, CASE doc_id % 3 WHEN 0 THEN 'apply' WHEN 1 THEN 'review' ELSE 'drop' END AS route, count(*) AS n
    FROM (SELECT doc_id, len({_WORDS.format("s")}) AS n FROM s) GROUP BY ALL
    """,
)
def finding_validity(spark, sf_dir):
    """Every sentence as a finding."""
    level = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("doc_id") % 3 + 1).cast("int"))
    found = _docs(spark, sf_dir).select("doc_id", F.explode(X.sentences(F.coalesce("text", F.lit("")))).alias("original_text"), F.lit("spelling").alias("error_type"), F.lit("☃").alias("suggested_correction"), level.alias("confidence"))
    return found.groupBy("doc_id", F.coalesce(patching.fault(), F.lit("ok")).alias("fault"), patching.route().alias("route")).agg(F.count("*").alias("n"))


# -- grounding and joins


@query("exact_grounding", "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def exact_grounding(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("claim"))
    return grounding.exact_grounding(items, _docs(spark, sf_dir), "claim").select("item_id", "doc_id")


@query(
    "left_anti_quotes",
    r"""
    WITH q AS (SELECT doc_id, coalesce(source, 'none') || ' says: "' || (doc_id % 5) || '"' AS quote FROM documents), k AS (SELECT 'SRC0  says:  "1"' AS quote UNION ALL SELECT 'src1 says: "2" [12:30]')
    SELECT doc_id FROM q WHERE NOT EXISTS (SELECT 1 FROM k WHERE lower(trim(regexp_replace(regexp_replace(k.quote, '\[12:30\]', '', 'g'), ' +', ' ', 'g'))) = lower(q.quote))
    """,
)
def left_anti_quotes(spark, sf_dir):
    """Quotes that are none of the known ones, by their normal form."""
    quotes = _docs(spark, sf_dir, "doc_id", "source").select("doc_id", F.concat(F.coalesce("source", F.lit("none")), F.lit(' says: "'), (F.col("doc_id") % 5).cast("string"), F.lit('"')).alias("quote"))
    known = spark.createDataFrame([('SRC0  says:  "1"',), ('src1 says: "2" [12:30]',)], "quote string")
    return grounding.anti_quotes(quotes, known).select("doc_id")


@query("fuzzy_grounding")
def fuzzy_grounding(spark, sf_dir):
    """Passages with a changed word, in the documents that hold them: result bands by similarity."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("claim"))
    held = grounding.exact_grounding(items, _docs(spark, sf_dir), "claim").select("item_id", "doc_id", "claim")
    probe = F.array_join(F.transform(F.slice(X.words(F.col("claim")), 1, 15), lambda w, i: F.when(i == 4, F.lit("changed")).otherwise(w)), " ")
    got = grounding.quotes_grounded(held.select("item_id", "doc_id", probe.alias("quote")), _docs(spark, sf_dir))
    return got.select("item_id", "doc_id", F.round("ratio", 6).alias("ratio"), "result")


@query(
    "coverage_rollup",
    f"""
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p, length(coalesce(text, '')) AS n FROM documents), e AS (SELECT doc_id, lower(p[1]) AS t, n, unnest(p) AS line FROM d),
    i AS (SELECT doc_id, t, length(line) * 100 >= n * 15 AS required, list_slice({_DISTINCT_KEYS.format('line')}, 1, 10) AS k FROM e),
    h AS (SELECT doc_id, required, len(list_filter(k, lambda x: contains(t, x))) AS n, len(k) AS m FROM i), c AS (SELECT *, m = 0 OR n >= 2 OR n / m >= 0.5 AS high, n >= 1 AS medium FROM h)
    SELECT doc_id, bool_and(high OR medium OR NOT required) AS passes, count(*) FILTER (required AND (high OR medium)) || '/' || count(*) FILTER (required) AS required_coverage,
           count(*) FILTER (NOT required AND (high OR medium)) || '/' || count(*) FILTER (NOT required) AS optional_coverage, count(*) FILTER (NOT high) AS to_review FROM c GROUP BY doc_id
    """,
)
def coverage_rollup(spark, sf_dir):
    """Does a document's first line cover what all its lines are about? Lines of 15 % of the text or more have to be covered."""
    text = F.coalesce("text", F.lit(""))
    lines = _docs(spark, sf_dir).select("doc_id", F.length(text).alias("n"), F.split(text, "\n").alias("p")).select("doc_id", "n", F.get("p", F.lit(0)).alias("first"), F.explode("p").alias("line"))
    got = lines.select("doc_id", (F.length("line") * 100 >= F.col("n") * 15).alias("required"), coverage.covered(F.col("first"), F.slice(X.keywords(F.col("line")), 1, 10)).alias("c"))
    return coverage.rollup(got.select("doc_id", "required", "c.*"))


@query(
    "label_quality_rollup",
    "SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic, round(100 * count(*) FILTER (quality = 1) / count(*), 6) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY lang",
)
def label_quality_rollup(spark, sf_dir):
    both = _docs(spark, sf_dir, "doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return both.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.round(100 * F.count_if(F.col("quality") == 1) / F.count("*"), 6).alias("accuracy"))


@query(
    "artifact_status",
    "WITH s AS (SELECT DISTINCT source FROM documents), k AS (SELECT unnest(['en', 'fr', 'it']) AS kind) SELECT source AS stem, kind, EXISTS (SELECT 1 FROM documents d WHERE d.source = s.source AND d.lang = k.kind) AS present FROM s, k",
)
def artifact_status(spark, sf_dir):
    rows = _docs(spark, sf_dir, "source", "lang").select(F.col("source").alias("stem"), F.col("lang").alias("kind"))
    return artifacts.status(rows.select("stem").distinct(), rows, ["en", "fr", "it"])


@query(
    "missing_artifacts",
    """
    WITH s AS (SELECT DISTINCT source FROM documents), d AS (SELECT source, lang, max(length(trim(text))) AS n FROM documents GROUP BY ALL),
    k AS (SELECT * FROM (VALUES ('en', 'en'), ('it', 'it'), ('pt', 'pt'), ('pt', 'es')) v(kind, alias)), b AS (SELECT s.source, kind, max(n) AS n FROM s CROSS JOIN k LEFT JOIN d ON d.source = s.source AND d.lang = k.alias GROUP BY ALL)
    SELECT source AS stem, kind, CASE WHEN n IS NULL THEN 'missing' WHEN n < 40 THEN 'too short' ELSE 'ok' END AS status FROM b
    """,
)
def missing_artifacts(spark, sf_dir):
    rows = _docs(spark, sf_dir, "source", "lang", "text").select(F.col("source").alias("stem"), F.col("lang").alias("kind"), "text")
    return coverage.missing_kinds(rows, rows.select("stem").distinct(), [("en",), ("it",), ("pt", "es")])


@query(
    "package_selection",
    """
    WITH a AS (SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY ALL),
    w AS (SELECT * FROM (VALUES (0, 0, 'it'), (0, 1, 'fr'), (1, 0, 'en'), (1, 1, 'de')) v(slot, r, lang))
    SELECT source AS stem, lang AS kind, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, slot ORDER BY r) AS n FROM a JOIN w USING (lang)) WHERE n = 1
    """,
)
def package_selection(spark, sf_dir):
    rows = _docs(spark, sf_dir, "source", "lang", "doc_id").groupBy(F.col("source").alias("stem"), F.col("lang").alias("kind")).agg(F.min("doc_id").alias("doc_id"))
    return artifacts.package(rows, [("it", "fr"), ("en", "de")])


# -- names, versions, structure


_NAMES = "source || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '_v' || (doc_id % 7) END || CASE WHEN doc_id % 11 = 0 THEN '_validated' ELSE '' END || '.txt'"


def _names(spark, sf_dir):
    v = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("_v"), (F.col("doc_id") % 7).cast("string")))
    return _docs(spark, sf_dir, "doc_id", "source").select("doc_id", F.concat("source", v, F.when(F.col("doc_id") % 11 == 0, "_validated").otherwise(""), F.lit(".txt")).alias("name"))


@query(
    "latest_versions",
    rf"WITH n AS (SELECT regexp_replace({_NAMES}, '\.txt$', '') AS stem FROM documents) SELECT regexp_replace(stem, '_v[0-9]+$', '') AS base, max(coalesce(TRY_CAST(nullif(regexp_extract(stem, '_v([0-9]+)$', 1), '') AS INTEGER), 0)) AS version FROM n WHERE NOT ends_with(stem, '_validated') GROUP BY base",
)
def latest_versions(spark, sf_dir):
    return artifacts.latest(_names(spark, sf_dir)).select("base", "version")


@query("base_names", rf"SELECT DISTINCT regexp_replace(regexp_replace({_NAMES}, '\.txt$', ''), '(?:_validated|_v[0-9]+)+$', '') AS base FROM documents")
def base_names(spark, sf_dir):
    return artifacts.base_names(_names(spark, sf_dir), _names(spark, sf_dir))


@query(
    "file_metadata",
    "SELECT doc_id, 'On ' || lang || ' - part ' || (doc_id % 5) AS title, source AS presenter, 'May ' || (2000 + doc_id % 20) AS date, CAST(2000 + doc_id % 20 AS VARCHAR) AS year FROM documents",
)
def file_metadata(spark, sf_dir):
    docs = _docs(spark, sf_dir, "doc_id", "lang", "source")
    name = F.concat(F.lit("On "), "lang", F.lit(" - part "), (F.col("doc_id") % 5).cast("string"), F.lit(" - "), "source", F.lit(" - May "), (2000 + F.col("doc_id") % 20).cast("string"), F.lit(" - formatted.md"))
    return docs.select("doc_id", X.file_metadata(name).alias("m")).select("doc_id", "m.title", "m.presenter", "m.date", "m.year")


_PARTS = r"string_split(coalesce(text, ''), chr(10))"


def _sectioned(spark, sf_dir):
    """Each line of a text as a numbered section."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return _docs(spark, sf_dir).select("doc_id", F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("## Section "), (i + 1).cast("string"), F.lit(" Part\n"), x)), "\n").alias("text"))


@query(
    "numbered_sections",
    f"SELECT doc_id, i AS number, 'Part' AS heading, trim(p[i], E' \\t\\n') AS content FROM (SELECT doc_id, {_PARTS} AS p, unnest(range(1, len({_PARTS}) + 1)) AS i FROM documents)",
)
def numbered_sections(spark, sf_dir):
    rows = _sectioned(spark, sf_dir).select("doc_id", F.inline(parse.numbered_sections(F.col("text"))))
    return rows.select("doc_id", F.col("number").cast("long").alias("number"), "heading", F.trim("content", F.lit(" \t\n")).alias("content"))


@query(
    "section_batches",
    f"SELECT doc_id, CAST(floor((i - 1) / 5) AS INTEGER) AS batch, count(*) AS n, sum(length(trim(p[i], E' \\t\\n'))) AS n_chars FROM (SELECT doc_id, {_PARTS} AS p, unnest(range(1, len({_PARTS}) + 1)) AS i FROM documents) GROUP BY ALL",
)
def section_batches(spark, sf_dir):
    rows = _sectioned(spark, sf_dir).select("doc_id", F.inline(parse.numbered_sections(F.col("text"))))
    return completion.batches_of(rows).groupBy("doc_id", "batch").agg(F.count("*").alias("n"), F.sum(F.length(F.trim("content", F.lit(" \t\n")))).alias("n_chars"))


@query(
    "question_share",
    f"""
    WITH s AS (SELECT doc_id, len({_PARTS}) AS n, unnest({_PARTS}) AS t FROM documents),
    q AS (SELECT doc_id, n, len(regexp_extract_all(t, '(?i)question')) + len(regexp_extract_all(t, '(?i)comment')) + len(regexp_extract_all(t, '(?i)\\*\\*Audience')) + len(regexp_extract_all(t, '(?i)\\*\\*[A-Z][a-z]+[ \\t]*:\\*\\*')) AS c FROM s)
    SELECT doc_id, CAST(floor(100 * count(*) FILTER (c >= 2) / any_value(n)) AS INTEGER) AS qa_percentage FROM q GROUP BY doc_id
    """,
)
def question_share(spark, sf_dir):
    return _sectioned(spark, sf_dir).select("doc_id", questions.qa_percentage(F.col("text")).alias("qa_percentage"))


@query(
    "labelled_quotes",
    f"SELECT doc_id, coalesce(source, '') AS label, trim(p, E' \\t\\r\\f\\v') AS quote FROM (SELECT doc_id, source, unnest({_PARTS}) AS p FROM documents) WHERE trim(p, E' \\t\\r\\f\\v') <> '' AND coalesce(source, '') <> ''",
)
def labelled_quotes(spark, sf_dir):
    """Every line of a text as a quote that its source labels."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x, F.lit(" \t\r\f\x0b"))), lambda x: x != "")
    block = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("> **"), F.col("source"), F.lit(':** "'), x, F.lit('"'))), "\n")
    return _docs(spark, sf_dir, "doc_id", "text", "source").select("doc_id", F.inline(parse.labelled_quotes(F.concat(F.lit("# Quotes\n\n"), block, F.lit("\n\nno **bold:** here\n")))))


@query(
    "structure_checks",
    f"""
    WITH n AS (SELECT doc_id, text, len({_WORDS.format('text')}) AS n, len(list_filter(string_split_regex(text, '\\n[ \\t\\n\\r\\f\\v]*\\n'), lambda p: trim(p) <> '')) AS p FROM documents)
    SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '(?i)\\bSections? [0-9]+') THEN 'section reference' END, CASE WHEN regexp_matches(text, '(?m)^[ \\t]*[-*•][ \\t]') THEN 'list' END,
             CASE WHEN p < 3 THEN 'fewer than 3 paragraphs' END], lambda x: x IS NOT NULL), '; ') AS issues,
           array_to_string(list_filter([CASE WHEN n < 600 THEN 'fewer than 600 words' END, CASE WHEN n < 650 * 0.85 THEN 'under 85 % of the target' END, CASE WHEN contains(lower(text), 'valuable') THEN 'judges: valuable' END,
             CASE WHEN contains(lower(text), 'insightful') THEN 'judges: insightful' END, CASE WHEN contains(lower(text), 'excellent') THEN 'judges: excellent' END], lambda x: x IS NOT NULL), '; ') AS warnings FROM n
    """,
)
def structure_checks(spark, sf_dir):
    issues, warnings = coverage.structure_messages(F.col("text"), F.lit(650), summary=True)
    return _docs(spark, sf_dir).select("doc_id", F.array_join(issues, "; ").alias("issues"), F.array_join(warnings, "; ").alias("warnings"))


@query(
    "completeness_checks",
    f"""
    WITH n AS (SELECT doc_id, coalesce(text, '') AS t, len({_WORDS.format('text')}) AS n, trim(right(coalesce(text, ''), 100)) AS e FROM documents)
    SELECT doc_id, n < 1500 AS too_short, n >= 1500 AND n < 2000 AS shorter_than_usual, NOT contains(t, '## ') AS no_headings, e <> '' AND NOT regexp_matches(e, '[.!?"'']$') AS open_end FROM n
    """,
)
def completeness_checks(spark, sf_dir):
    errors, warnings = coverage.completeness(F.col("text"))
    has = F.array_contains
    return _docs(spark, sf_dir).select("doc_id", has(errors, "too short").alias("too_short"), has(warnings, "shorter than usual").alias("shorter_than_usual"), has(warnings, "no headings").alias("no_headings"), has(warnings, "may end within a sentence").alias("open_end"))


@query(
    "word_budget",
    """
    SELECT doc_id, o AS opening, t - o - c - q AS body, q AS qa, c AS closing, array_to_string([CAST(floor((t - o - c - q) * p / 100.0) AS INTEGER) for p in [50, 30, 20]], ',') AS topics
    FROM (SELECT doc_id, 500 + doc_id % 500 AS t, CAST(floor((500 + doc_id % 500) * 0.14) AS INTEGER) AS o, CAST(floor((500 + doc_id % 500) * 0.06) AS INTEGER) AS c,
                 CASE WHEN doc_id % 10 > 5 THEN CAST(floor((500 + doc_id % 500) * 0.10) AS INTEGER) ELSE 0 END AS q FROM documents)
    """,
)
def word_budget(spark, sf_dir):
    budget = coverage.word_budget(500 + F.col("doc_id") % 500, F.array(F.lit(50), F.lit(30), F.lit(20)), F.col("doc_id") % 10)
    rows = _docs(spark, sf_dir, "doc_id").select("doc_id", budget.alias("b")).select("doc_id", "b.*")
    return rows.withColumn("topics", F.array_join(F.transform("topics", lambda x: x.cast("string")), ","))


@query("top_topics", "SELECT source, lang, n FROM (SELECT source, lang, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS r FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)) WHERE r <= 2")
def top_topics(spark, sf_dir):
    counts = _docs(spark, sf_dir, "source", "lang").groupBy("source", "lang").agg(F.count("*").alias("n"))
    lists = counts.groupBy("source").agg(F.sort_array(F.collect_list(F.struct(F.col("lang").alias("name"), F.col("n").alias("percentage")))).alias("t"))
    top = parse.top_topics(F.col("t"), 2)
    return lists.select("source", F.inline(top)).select("source", F.col("name").alias("lang"), F.col("percentage").alias("n"))


# -- usage


def _usage(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_type", "user_id", "ts", "value")
    n = F.floor(F.abs("value") * 100)
    return e.select(F.col("event_type").alias("script"), F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("model"), "ts", n.alias("tokens_in"), F.floor(n / 3).alias("tokens_out"), F.floor(n / 5).alias("created"), F.floor(n / 7).alias("read"))


_BOOK = ((0, "m0", 15.0, 75.0, 18.75, 1.5), (1, "m1", 3.0, 15.0, 3.75, 0.3), (2, "m", 0.8, 4.0, 1.0, 0.08))
_USAGE_SQL = """
u AS (SELECT event_type AS script, 'm' || (user_id % 4) AS model, ts, floor(abs(value) * 100) AS i, floor(floor(abs(value) * 100) / 3) AS o, floor(floor(abs(value) * 100) / 5) AS c, floor(floor(abs(value) * 100) / 7) AS r FROM events),
p AS (SELECT *, CASE model WHEN 'm0' THEN 15.0 WHEN 'm1' THEN 3.0 ELSE 0.8 END AS pi, CASE model WHEN 'm0' THEN 75.0 WHEN 'm1' THEN 15.0 ELSE 4.0 END AS po,
      CASE model WHEN 'm0' THEN 18.75 WHEN 'm1' THEN 3.75 ELSE 1.0 END AS pc, CASE model WHEN 'm0' THEN 1.5 WHEN 'm1' THEN 0.3 ELSE 0.08 END AS pr FROM u),
x AS (SELECT script, model, ts, i AS tokens_in, greatest(0, i - r - c) / 1e6 * pi + o / 1e6 * po + c / 1e6 * pc + r / 1e6 * pr AS cost FROM p)
"""


def _costed(spark, sf_dir):
    book = spark.createDataFrame(list(_BOOK), usage.PRICE_BOOK)
    rows = usage.priced(_usage(spark, sf_dir), book, default="m")
    c = F.col
    return rows.withColumn("cost", usage.cost(c("tokens_in"), c("tokens_out"), c("created"), c("read"))).withColumn("tokens_in", c("tokens_in").cast("double"))


@query("usage_by_script", f"WITH {_USAGE_SQL} SELECT script, count(*) AS calls, round(sum(cost), 4) AS cost, round(sum(tokens_in), 4) AS tokens_in FROM x GROUP BY script")
def usage_by_script(spark, sf_dir):
    return usage.rollup(_costed(spark, sf_dir), [["script"]], ["cost", "tokens_in"], 4)


@query("usage_by_model", f"WITH {_USAGE_SQL} SELECT model, count(*) AS calls, round(sum(cost), 4) AS cost FROM x GROUP BY model")
def usage_by_model(spark, sf_dir):
    return usage.rollup(_costed(spark, sf_dir), [["model"]], ["cost"], 4)


@query("usage_totals", f"WITH {_USAGE_SQL} SELECT count(*) AS calls, round(sum(cost), 4) AS cost, round(sum(tokens_in), 4) AS tokens_in FROM x")
def usage_totals(spark, sf_dir):
    return _costed(spark, sf_dir).agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 4).alias("cost"), F.round(F.sum("tokens_in"), 4).alias("tokens_in"))


@query("usage_since", f"WITH {_USAGE_SQL} SELECT script, count(*) AS calls, round(sum(cost), 4) AS cost FROM x WHERE ts >= (SELECT min(ts) + INTERVAL 10 DAY FROM events) GROUP BY script")
def usage_since(spark, sf_dir):
    rows = _costed(spark, sf_dir)
    start = table(spark, sf_dir, "events", "ts").agg((F.min("ts") + F.expr("INTERVAL 10 DAYS")).alias("start"))
    return usage.rollup(usage.since(rows.crossJoin(F.broadcast(start)), F.col("start")), [["script"]], ["cost"], 4)  # the start is one row


@query("usage_rollup", f"WITH {_USAGE_SQL} SELECT script, model, count(*) AS calls, round(sum(cost), 4) AS cost FROM x GROUP BY GROUPING SETS ((script), (model), ())")
def usage_rollup(spark, sf_dir):
    return usage.rollup(_costed(spark, sf_dir), [["script"], ["model"], []], ["cost"], 4)


@query(
    "cost_estimates",
    """
    WITH t AS (SELECT doc_id, CAST(floor(length(text) / 4) AS BIGINT) AS n FROM documents),
    s AS (SELECT * FROM (VALUES ('format', 1.0, 1.1, 3.0), ('headers', 1.0, 0.1, 3.0), ('core extraction', 1.0, 0.25, 3.75), ('emphasis', 1.0, 0.1, 0.3), ('references', 1.0, 0.1, 0.3), ('summary', 0.2, 0.05, 0.3), ('terms', 1.0, 0.1, 0.3)) v(step, a, b, rate))
    SELECT step, CAST(sum(floor(n * CAST(a AS DOUBLE))) AS BIGINT) AS tokens_in, CAST(sum(floor(n * CAST(a AS DOUBLE) * CAST(b AS DOUBLE))) AS BIGINT) AS tokens_out,
           round(sum(floor(n * CAST(a AS DOUBLE)) / 1e6 * rate + floor(n * CAST(a AS DOUBLE) * CAST(b AS DOUBLE)) / 1e6 * 15.0), 4) AS cost FROM t, s GROUP BY step
    """,
)
def cost_estimates(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", X.token_estimate(F.col("text")).alias("n_tokens"))
    lines = usage.estimates(docs, {"input": 3.0, "output": 15.0, "cache_write": 3.75, "cache_read": 0.3})
    return lines.groupBy("step").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum("cost"), 4).alias("cost"))


# -- conversations


@query("turn_share", "SELECT conv_id, count(*) AS n_turns, CAST(floor(100 * count(*) FILTER (role = 'user') / count(*)) AS INTEGER) AS user_share FROM conversations GROUP BY conv_id")
def turn_share(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations", "conv_id", "role")
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.floor(100 * F.count_if(F.col("role") == "user") / F.count("*")).cast("int").alias("user_share"))


@query(
    "notable_exchanges",
    r"""
    SELECT conv_id, r AS ordinal, left(string_split(regexp_replace(trim(text, E' \n'), '([.!?])[ \t\n\r\f\v]+', '\1' || chr(31), 'g'), chr(31))[1], 100) AS opening
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r FROM conversations WHERE role = 'user' AND length(trim(text, E' \n')) > 200) WHERE r < 3
    """,
)
def notable_exchanges(spark, sf_dir):
    """Openings of long turns of those who ask, in conversations as texts whose other speakers are doctors."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = F.trim(F.coalesce("text", F.lit("")), F.lit(" \n"))
    line = F.concat(F.lit("**"), F.when(F.col("role") == "user", "Guest").otherwise("Dr Lee"), F.lit(":** "), said, F.lit("\n\n"))
    texts = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "").alias("t"))  # of one conversation
    rows = texts.select("conv_id", F.posexplode(questions.notable_exchanges(F.col("t"))).alias("ordinal", "opening"))
    return rows.withColumn("ordinal", F.col("ordinal").cast("long"))


# -- pages

_PAGE = "html"
for _entity, _char in X.ENTITIES.items():
    _PAGE = f"replace({_PAGE}, '{_entity}', '{_char.replace(chr(39), chr(39) * 2)}')"
_PAGE = rf"lower(trim(regexp_replace(regexp_replace(replace({_PAGE}, '&amp;', '&'), '<[^>]*>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')))"


@query("page_text", f"SELECT page_id, {_PAGE} AS body FROM pages")
def page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages", "page_id", "html").select("page_id", pages.page_text(F.col("html")).alias("body"))


@query("page_headings", "SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h1 FROM pages")
def page_headings(spark, sf_dir):
    return table(spark, sf_dir, "pages", "page_id", "html").select("page_id", pages.first_of(F.col("html"), "title").alias("title"), pages.first_of(F.col("html"), "h1").alias("h1"))


@query("page_tag_counts", "SELECT page_id, len(regexp_extract_all(html, '<p[ >]')) AS n_p, len(regexp_extract_all(html, '<a[ >]')) AS n_a, len(regexp_extract_all(html, '<li[ >]')) AS n_li FROM pages")
def page_tag_counts(spark, sf_dir):
    return table(spark, sf_dir, "pages", "page_id", "html").select("page_id", *(pages.tag_count(F.col("html"), t).alias(f"n_{t}") for t in ("p", "a", "li")))


@query("title_matches_h1", "SELECT page_id, trim(lower(t)) = trim(lower(h)) AS same, contains(lower(t), lower(h)) OR contains(lower(h), lower(t)) AS alike FROM (SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS t, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h FROM pages)")
def title_matches_h1(spark, sf_dir):
    rows = page_headings(spark, sf_dir).select("page_id", F.lower("title").alias("t"), F.lower("h1").alias("h"))
    return rows.select("page_id", (F.trim("t") == F.trim("h")).alias("same"), (F.contains("t", "h") | F.contains("h", "t")).alias("alike"))


@query(
    "page_audit",
    f"""
    WITH p AS (SELECT page_id, {_PAGE} AS b, len(regexp_extract_all(html, '<h2[ >]')) AS h2, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages),
    w AS (SELECT *, len({_WORDS.format('b')}) AS n FROM p)
    SELECT page_id, 'title' AS "check", 'error' AS severity FROM w WHERE NOT contains(b, lower(title || ' x'))
    UNION ALL SELECT page_id, 'sections', 'warning' FROM w WHERE h2 < 2 UNION ALL SELECT page_id, 'length', 'warning' FROM w WHERE n < 100
    """,
)
def page_audit(spark, sf_dir):
    p = table(spark, sf_dir, "pages", "page_id", "html")
    expected = p.select("page_id", F.concat(pages.first_of(F.col("html"), "title"), F.lit(" x")).alias("title"), F.lit("").alias("presenter"), F.lit(2).alias("n_sections"), F.lit(200).alias("n_words"), F.array().cast("array<string>").alias("quotes"))
    return pages.audit(p, expected).select("page_id", "check", "severity")


_P = r"string_split_regex(html, '(?i)<p(?:[ \t\n\r][^>]*)?>')[2:]"
_INNER = "p"
for _entity, _char in X.ENTITIES.items():
    _INNER = f"replace({_INNER}, '{_entity}', '{_char.replace(chr(39), chr(39) * 2)}')"


#: What ends a paragraph besides its own end: the start or end of an element around text.
_BLOCK = "body|html|" + "|".join(b for b in pages.BLOCKS if b != "p")


@query("page_elements", rf"SELECT page_id, ordinal, trim(regexp_replace(replace({_INNER}, '&amp;', '&'), '[ \t\n\r\f\v\x{{A0}}]+', ' ', 'g')) AS body FROM (SELECT page_id, generate_subscripts({_P}, 1) - 1 AS ordinal, regexp_replace(string_split_regex(unnest({_P}), '(?i)</p>|</?(?:{_BLOCK})[ />]')[1], '<[^>]*>', '', 'g') AS p FROM pages)")
def page_elements(spark, sf_dir):
    """Texts of paragraphs, nested markup included."""
    p = table(spark, sf_dir, "pages", "page_id", "html")
    return p.select("page_id", F.posexplode(pages.select(tag="p")("html")).alias("ordinal", "body")).withColumn("ordinal", F.col("ordinal").cast("long"))


# -- text against text: no SQL for these


@query(
    "offline_completion",
    r"""
    WITH p AS (SELECT doc_id, trim('Summarise ' || doc_id || '.' || chr(10) || chr(10) || coalesce(text, ''), E' \t\n\r\f\v') AS p FROM documents),
    a AS (SELECT doc_id, list_filter(string_split_regex(string_split(p, chr(10) || chr(10))[-1], '[ \t\n\r\f\v]+'), lambda w: w <> '')[1:50] AS w FROM p)
    SELECT doc_id, coalesce(list_sum([length(x) for x in w]), 0) // 4 AS output_tokens, CASE WHEN len(w) = 0 THEN 'no text' ELSE 'valid' END AS state FROM a
    """,
)
def offline_completion(spark, sf_dir):
    """A prompt for each document to the offline backend, with the answer's first fault."""
    docs = _docs(spark, sf_dir).select("doc_id", X.fill("Summarise {{ name }}.\n\n{{ text }}", {"name": F.col("doc_id"), "text": F.col("text")}).alias("prompt"))
    got = completion.completed(docs, "prompt")
    return got.select("doc_id", "answer.output_tokens", F.coalesce(completion.answer_fault(F.col("answer")), F.lit("valid")).alias("state"))


@query(
    "settings_violations",
    """
    WITH s AS (SELECT s_suppkey AS profile, s_acctbal / 10000 AS threshold, s_nationkey * 100 AS overlap, s_suppkey % 3 - 1 AS least, s_suppkey % 5 = 0 AS word FROM supplier)
    SELECT profile, 'number' AS rule, 'lookahead' AS name FROM s WHERE word
    UNION ALL SELECT profile, 'range', 'fuzzy_threshold' FROM s WHERE threshold NOT BETWEEN 0 AND 1
    UNION ALL SELECT profile, 'positive', 'abstract_min_words' FROM s WHERE least <= 0
    UNION ALL SELECT profile, 'order', 'fuzzy_threshold' FROM s WHERE threshold > 0.9
    UNION ALL SELECT profile, 'whole', 'summary_words' FROM s WHERE profile % 4 <> 0
    UNION ALL SELECT profile, 'order', 'chunk_overlap' FROM s WHERE overlap >= 1500
    UNION ALL SELECT profile, 'positive', 'chunk_overlap' FROM s WHERE overlap <= 0
    """,
)
def settings_violations(spark, sf_dir):
    """What is wrong with the settings of each supplier, some of which come from its row."""
    rows = table(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal", "s_nationkey").withColumn("profile", F.col("s_suppkey"))
    own = {
        "fuzzy_threshold": F.col("s_acctbal").cast("double") / 10_000, "fuzzy_early_stop": F.lit(0.9), "summary_words": F.lit(600) + F.col("profile") / 4, "chunk_overlap": F.col("s_nationkey") * 100, "chunk_size": F.lit(1500),
        "abstract_min_words": F.col("profile") % 3 - 1, "lookahead": F.when(F.col("profile") % 5 == 0, "ten").otherwise("10"),
    }
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), v.cast("string").alias("value")) for n, v in own.items()))).alias("p")
    return settings.table_violations(rows.select("profile", pairs).select("profile", "p.*")).select("profile", "rule", "name")


from scriptloom.plans import derived, varied  # noqa: E402, F401  (they register their queries here)
