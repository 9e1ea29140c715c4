"""Coverage of planned items by a text, structural checks, and completeness: rows of items and checks, and their rollups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.functions import text as X

#: Words that judge, and the parts of a summary.
EVALUATIVE = ("valuable", "insightful", "excellent")
OPENING_SHARE, CLOSING_SHARE, QA_SHARE, QA_LEAST = 0.14, 0.06, 0.10, 5
TERMINALS = (".", "!", "?", '"', "'")
#: (share of keywords for covered, for medium)
ABSTRACT_LEVELS, SUMMARY_LEVELS = (0.5, 0.25), (0.4, 0.2)


def covered(text: Column, keywords: Column, levels: tuple[float, float] = ABSTRACT_LEVELS) -> Column:
    """Struct of hits, covered and confidence: by how many keywords occur in the text, as parts of words too."""
    t = F.lower(F.coalesce(text, F.lit("")))
    n = F.size(F.filter(keywords, lambda k: F.contains(t, F.lower(k))))
    share = F.when(F.size(keywords) > 0, n / F.size(keywords)).otherwise(F.lit(1.0))
    high = (F.size(keywords) == 0) | (n >= 2) | (share >= levels[0])
    medium = (n >= 1) | (share >= levels[1])
    return F.struct(
        n.cast("long").alias("hits"), (high | medium).alias("covered"), F.when(high, "high").when(medium, "medium").otherwise("low").alias("confidence")
    )


def items(plans: DataFrame, key: str = "doc_id", topic_required: int = 15, qa_optional: int = 15, qa_required: int = 30) -> DataFrame:
    """key, category, label, required, keywords: what a text has to cover.

    ``plans`` has presenter, title, topics (name, percentage, description), themes (name, description), purpose, conclusion, qa_percentage
    and qa_topics.
    """

    def of(category: str, label: Column, required: Column, source: Column, n: int, rows: DataFrame = plans) -> DataFrame:
        return rows.select(key, F.lit(category).alias("category"), label.alias("label"), required.alias("required"), F.slice(X.keywords(source), 1, n).alias("keywords"))

    t = plans.select(key, F.explode("topics").alias("x"))
    h = plans.select(key, F.posexplode("themes").alias("i", "x"))
    text = lambda *c: F.concat_ws(" ", *c)
    found = [
        of("metadata", F.lit("speaker"), F.lit(True), F.col("presenter"), 6, plans.filter("presenter IS NOT NULL")),
        of("topic", F.col("x.name"), F.col("x.percentage") >= topic_required, text("x.name", "x.description"), 10, t),
        of("theme", F.col("x.name"), F.col("i") == 0, text("x.name", "x.description"), 8, h),
        of("purpose", F.lit("purpose"), F.lit(True), F.col("purpose"), 8, plans.filter("purpose IS NOT NULL")),
        of("conclusion", F.lit("conclusion"), F.lit(True), F.col("conclusion"), 8, plans.filter("conclusion IS NOT NULL")),
        of("qa", F.lit("questions"), F.col("qa_percentage") >= qa_required, F.array_join("qa_topics", " "), 6, plans.filter(F.col("qa_percentage") >= qa_optional)),
    ]
    return reduce(DataFrame.unionByName, found)


def rollup(checked: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a document: passes iff every required item is covered (null isn't), with the counts as text, and how many items ``review_list`` holds."""
    got = F.coalesce(F.col("covered"), F.lit(False))
    required, optional = F.col("required"), ~F.col("required")
    n = lambda c: F.count_if(c).cast("string")
    return checked.groupBy(key).agg(
        F.bool_and(got | optional).alias("passes"),
        F.concat_ws("/", n(got & required), n(required)).alias("required_coverage"),
        F.concat_ws("/", n(got & optional), n(optional)).alias("optional_coverage"),
        F.count_if(~got | F.coalesce(F.col("confidence").isin("low", "medium"), F.lit(False))).alias("to_review"),
    )


def structure_messages(text: Column, target: Column, summary: bool = False) -> tuple[Column, Column]:
    """(issues, warnings) of an abstract, or of a summary: length, references to sections, lists, paragraphs, words that judge."""
    n = F.size(X.words(F.coalesce(text, F.lit(""))))
    issues = [F.when(text.rlike(r"(?i)\bSections? \d+"), "section reference"), F.when(text.rlike(r"(?m)^[ \t]*[-*•][ \t]"), "list")]
    if summary:
        parts = F.size(F.filter(F.split(text, r"\n\s*\n"), lambda p: F.trim(p) != ""))
        issues.append(F.when(parts < 3, "fewer than 3 paragraphs"))
        warnings = [F.when(n < 600, "fewer than 600 words"), F.when(n < target * 0.85, "under 85 % of the target")]
    else:
        warnings = [F.when((n < target * 0.8) | (n > target * 1.2), "length off target by a fifth")]
    warnings += [F.when(F.contains(F.lower(text), F.lit(w)), f"judges: {w}") for w in EVALUATIVE]
    return F.array_compact(F.array(*issues)), F.array_compact(F.array(*warnings))


def proportion(expected: Column, actual: Column, closing: Column) -> Column:
    """(deviation, within tolerance): small parts may deviate more."""
    deviation = F.abs(actual - expected) / expected
    allowed = F.when(closing & (expected < 50), 2.5).when(expected < 100, 0.5).when(expected < 200, 0.4).otherwise(0.3)
    return F.struct(deviation.alias("deviation"), (deviation <= allowed).alias("within"))


def word_budget(target: Column, percentages: Column, qa: Column) -> Column:
    """Words of a summary's parts: opening, closing, questions if they take more than 5 %, and topics by their shares."""
    from scriptloom.operators.usage import allocate

    part = lambda share: (target * share).cast("int")
    asks = F.when(qa > QA_LEAST, part(QA_SHARE)).otherwise(0)
    body = target - part(OPENING_SHARE) - part(CLOSING_SHARE) - asks
    return F.struct(part(OPENING_SHARE).alias("opening"), body.alias("body"), asks.alias("qa"), part(CLOSING_SHARE).alias("closing"), allocate(body, percentages).alias("topics"))


def completeness(text: Column, least: int = 1500, usual: int = 2000, front: bool = False) -> tuple[Column, Column]:
    """(errors, warnings) of a formatted text: length, front matter, headings, signs of a cut, a last sentence that ends."""
    body = F.coalesce(text, F.lit(""))
    n = F.size(X.words(body))
    tail = F.trim(F.right(body, F.lit(100)))
    ends = reduce(lambda a, b: a | b, (tail.endswith(t) for t in TERMINALS))
    errors = [F.when(n < least, "too short")] + [F.when(F.contains(F.lower(body), F.lit(m.lower())), f"cut: {m}") for m in X.TRUNCATION_MARKERS]
    if front:
        errors.append(F.when(~body.startswith("---"), "front matter missing"))
    warnings = [F.when((n >= least) & (n < usual), "shorter than usual"), F.when(~F.contains(body, F.lit("## ")), "no headings"), F.when((tail != "") & ~ends, "may end within a sentence")]
    return F.array_compact(F.array(*errors)), F.array_compact(F.array(*warnings))


def missing_kinds(artifacts: DataFrame, stems: DataFrame, kinds: Sequence[tuple[str, ...]], least: int = 40, stem: str = "stem") -> DataFrame:
    """stem, kind, status of each expected kind (a tuple of alternatives, the first names it): ok, too short or missing."""
    wanted = stems.select(stem, F.explode(F.array(*(F.array(*map(F.lit, k)) for k in kinds))).alias("k_")).select(stem, F.get("k_", F.lit(0)).alias("kind"), F.explode("k_").alias("alias_"))
    have = artifacts.groupBy(stem, F.col("kind").alias("alias_")).agg(F.max(F.length(F.trim("text"))).alias("n_"))
    best = wanted.join(have, [stem, "alias_"], "left").groupBy(stem, "kind").agg(F.max("n_").alias("n_"))
    return best.select(stem, "kind", F.when(F.col("n_").isNull(), "missing").when(F.col("n_") < least, "too short").otherwise("ok").alias("status"))


def missing_labels(source: DataFrame, found: DataFrame, key: str = "doc_id", label: str = "label") -> DataFrame:
    """Labels of the source that are not among those found of the same document."""
    return source.select(key, label).distinct().join(found.select(key, label).distinct(), [key, label], "left_anti")


def review_list(checked: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, ordinal and what is to be looked at by a person: items that are missing or uncertain, with the beginning of their source and keywords."""
    got = F.coalesce(F.col("covered"), F.lit(False))
    source = F.when(F.length("source_text") > 100, F.concat(F.left("source_text", F.lit(100)), F.lit("..."))).otherwise(F.coalesce("source_text", F.lit("")))
    return checked.filter(~got | F.col("confidence").isin("low", "medium")).select(
        key, "ordinal", F.when(got, "uncertain").otherwise("missing").alias("state"), "required", "label", source.alias("source"), F.array_join(F.slice("keywords", 1, 5), ", ").alias("keywords"),
    )


def verdict_line(checked: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, summary: one line on each document; the first three required items that are missing are named."""
    got = F.coalesce(F.col("covered"), F.lit(False))
    lost = F.array_compact(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", F.when(F.col("required") & ~got, F.col("label")).alias("l")))), lambda x: x["l"]))
    rows = checked.groupBy(key).agg(F.bool_and(got | ~F.col("required")).alias("passes"), F.count_if(F.col("confidence").isin("low", "medium")).alias("weak"), lost.alias("lost"))
    passed = F.when(F.col("weak") > 0, F.format_string("PASSED with %d low-confidence items - human review recommended", "weak")).otherwise("PASSED - all required items covered")
    return rows.select(key, F.when(F.col("passes"), passed).otherwise(F.concat(F.lit("FAILED - missing required: "), F.array_join(F.slice("lost", 1, 3), ", "))).alias("summary"))
