"""Composed texts: key points, bounded quotes, quote blocks, cleaned summaries, and validity of sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.functions import parse, similarity
from scriptloom.functions import text as X
from scriptloom.operators import patterns

#: Beginnings and phrases that say nothing; {who} is the speaker.
FILLERS = (r"^The speaker\s+", r"^{who}\s+", r"^He\s+", r"^She\s+", r"^This\s+", r"^It\s+", r"in this section,?\s*", r"here,?\s*")
QUOTE_WORDS, POINT_CHARS = 140, 15


def key_point(sentence: Column, who: str = "Speaker") -> Column:
    """A sentence as a point: no filler, a capital first, no full stop; null if 15 characters or less are left."""
    for filler in FILLERS:
        sentence = F.regexp_replace(sentence, "(?i)" + filler.replace("{who}", who), "")
    point = F.regexp_replace(F.concat(F.upper(F.left(sentence, F.lit(1))), F.substring(sentence, F.lit(2), F.length(sentence))), r"\.+$", "")
    return F.when(F.length(point) > POINT_CHARS, point)


def key_points(description: Column, from_sections: Column | None = None, most: int = 5, who: str = "Speaker") -> Column:
    """Points of the description's sentences of 21 to 199 characters; where there are fewer than 3, those of the sections follow."""
    sentences = F.transform(X.sentences(description), lambda s: F.trim(s))
    own = F.array_distinct(F.array_compact(F.transform(F.filter(sentences, lambda s: (F.length(s) > 20) & (F.length(s) < 200)), lambda s: key_point(s, who))))
    if from_sections is not None:
        own = F.when(F.size(own) < 3, F.array_distinct(F.concat(own, F.coalesce(from_sections, F.array().cast("array<string>"))))).otherwise(own)
    return F.slice(own, 1, most)


def section_points(docs: DataFrame, key: str = "doc_id", text: str = "text", ranges: str = "sections", who: str = "Speaker") -> DataFrame:
    """key, points: emphasised sentences of the sections that ``ranges`` names, as points in order."""
    numbers = parse.section_range(F.col(ranges))
    rows = docs.select(key, numbers.alias("n_"), F.explode(parse.numbered_sections(F.col(text))).alias("s")).filter(F.array_contains("n_", F.col("s.number")))
    rows = rows.select(F.struct(key, F.array_position("n_", F.col("s.number")).alias("at")).alias("k"), F.col("s.content").alias("content"))
    found = patterns.classified(patterns.sentence_rows(rows, "k", "content"), who=who)
    placed = found.select(F.col(f"k.{key}").alias(key), F.struct(F.col("k.at"), "ordinal", key_point(F.col("sentence"), who).alias("p")).alias("x")).filter("x.p IS NOT NULL")
    return placed.groupBy(key).agg(F.array_distinct(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["p"])).alias("points"))


def compact_quote(quote: Column, who: str, most: int = QUOTE_WORDS) -> Column:
    """A quote of ``most`` words at most: the sentence that credits ``who`` and one neighbour that fits, else cut with dots."""
    q = X.collapse(quote)
    n = lambda s: F.size(F.split(s, " "))
    cut = lambda s: F.when(n(s) > most, F.concat(F.regexp_replace(F.array_join(F.slice(F.split(s, " "), 1, most), " "), "[ ,;:]+$", ""), F.lit("..."))).otherwise(s)
    parts = X.sentences(q)
    credit = rf"(?i)\b(?:{who}(?:'s)?|he\s+said)\b"
    at = F.coalesce(F.get(F.filter(F.transform(parts, lambda s, i: F.when(s.rlike(credit), i)), lambda i: i.isNotNull()), F.lit(0)), F.lit(0))
    main, after, before = F.get(parts, at), F.get(parts, at + 1), F.when(at > 0, F.get(parts, at - 1))
    joined = lambda other: F.concat_ws(" ", main, other)
    picked = F.when(after.isNotNull() & (n(joined(after)) <= most), joined(after)).when(before.isNotNull() & (n(joined(before)) <= most), joined(before)).otherwise(main)
    return F.when(n(q) <= most, q).otherwise(cut(picked))


def quote_block(text: Column, heading: str) -> Column:
    """Lines as a quote block: a leading heading, list marks and blank lines go."""
    body = F.regexp_replace(F.trim(text), rf"(?i)\A\s*#+\s*{heading}[^\n]*\n(?:\s*(?:---)?\s*\n)*", "")
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    clean = F.transform(lines, lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, "^>", "")), r"^(?:\d+[.)]|[-*])\s+", ""))
    return F.array_join(F.transform(clean, lambda x: F.concat(F.lit("> "), x)), "\n")


def quote_lines(quotes: Column, title: str = "Reference") -> Column:
    """An array of (label, quote) as ``> **Title - Label:** "quote"`` lines; quotation marks within become single."""
    clean = F.transform(quotes, lambda x: F.struct(X.collapse(x["label"]).alias("label"), F.replace(X.collapse(x["quote"]), F.lit('"'), F.lit("'")).alias("quote")))
    full = F.filter(clean, lambda x: (x["label"] != "") & (x["quote"] != ""))
    return F.array_join(F.transform(full, lambda x: F.concat(F.lit(f"> **{title} - "), x["label"], F.lit(':** "'), x["quote"], F.lit('"'))), "\n")


def summary_body(text: Column) -> Column:
    """A summary without front matter, its own heading, and what follows from the next section on."""
    body = F.trim(F.regexp_replace(X.strip_front_matter(text), r"(?i)\A#+\s*Summary\s*", ""))
    return F.trim(F.get(F.split(body, r"(?m)^##\s+", 2), F.lit(0)), F.lit(" \t\n"))


def valid_section(kind: Column, text: Column) -> Column:
    """Whether a section of this kind holds what it should."""
    k = F.lower(kind)
    bold = text.rlike(r"(?:^|\n)\s*\d+\.\s+\*\*.+?\*\*")
    heads = text.rlike(r"(?:^|\n)###\s+")
    body = F.coalesce(text, F.lit(""))
    return (F.trim(body) != "") & ~patterns.refused(body) & (
        F.when(k.isin("topics", "key topics"), F.size(parse.topics(body)) > 0).when(k.isin("interpretive themes", "themes", "key themes"), (F.size(parse.themes(body)) > 0) | bold)
        .when(k == "structural themes", bold | heads).when(k == "key terms", heads | text.rlike(r"(?:^|\n)\*\*[^*\n]+\*\*\s*[:\-]|(?:^|\n)\*\*[^*\n]+:\*\*")).otherwise(True)
    )


def loose_metadata(name: Column) -> Column:
    """title, presenter and date by position, for names that needn't be whole."""
    p = F.split(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), " - ")
    part = lambda i: F.coalesce(F.trim(F.get(p, F.lit(i))), F.lit(""))
    return F.struct(part(0).alias("title"), part(1).alias("presenter"), part(2).alias("date"))


def question_types(content: Column, most: int = 6) -> Column:
    """Phrases after about, on or regarding: two of a section, 50 characters each; ``content`` is an array of sections."""
    found = F.flatten(F.transform(content, lambda c: F.slice(F.regexp_extract_all(c, F.lit(r"(?i)(?:about|on|regarding|thinking about)\s+([^.,?]+)"), F.lit(1)), 1, 2)))
    return F.slice(F.array_distinct(F.transform(found, lambda t: F.left(F.trim(t), F.lit(50)))), 1, most)


def best_highlights(quotes: DataFrame, highlights: DataFrame, doc: str = "doc_id", accept: float = 0.85, floor: float = 0.9, overlapping: Sequence[str] = ("reference",)) -> DataFrame:
    """quotes (doc, ordinal, category, quote) with their most similar highlight (doc, type, text) of the same or an overlapping category.

    Pairs meet within a document and are reduced to the best of each quote at once.
    """
    q = quotes.withColumn("qn_", X.normalize(F.col("quote")))
    h = highlights.select(doc, F.col("type").alias("type_"), F.col("text").alias("best_text"), X.normalize(F.col("text")).alias("hn_"))
    both = q.join(h, doc).filter((F.col("type_") == F.col("category")) | F.col("type_").isin(*overlapping))
    inside = F.contains(F.col("qn_"), F.col("hn_")) | F.contains(F.col("hn_"), F.col("qn_"))
    r = similarity.ratio("qn_", "hn_")
    both = both.withColumn("r_", r).withColumn("r_", F.when(inside, F.greatest("r_", F.lit(floor))).otherwise(F.col("r_")))
    best = both.groupBy(doc, "ordinal").agg(F.max_by("best_text", "r_").alias("best_text"), F.max("r_").alias("ratio"))
    return quotes.join(best, [doc, "ordinal"], "left").withColumn("matched", F.coalesce(F.col("ratio") > accept, F.lit(False)))


def first_container(parts: DataFrame, wholes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """parts (doc, label, quote) with the label of the first whole (doc, ordinal, label, quote) of the document that contains them."""
    w = wholes.select(doc, "ordinal", F.col("label").alias("into"), X.normalize(F.col("quote")).alias("wn_"))
    p = parts.withColumn("pn_", X.normalize(F.col("quote")))
    hits = p.join(w, doc).filter(F.contains("wn_", F.col("pn_"))).groupBy(doc, "label").agg(F.min_by("into", "ordinal").alias("into"))
    return parts.join(hits, [doc, "label"], "left")


#: Shape of a verdict on lenses.
VERDICT = "valid boolean, issues array<string>, ranked array<struct<lens:string,rank:int,score:int>>, top_lens struct<name:string,hooks:array<string>>"


def lens_verdict(answer: Column) -> Column:
    """The verdict in a model's answer; one that says so where it can't be read."""
    got = parse.json_object(answer, VERDICT)
    return F.coalesce(got, F.from_json(F.lit('{"valid": false, "issues": ["unreadable"], "ranked": []}'), VERDICT))


def canonical_quotes(artifacts: DataFrame, own_kind: str, other_kind: str, heading: str, stem: str = "stem") -> DataFrame:
    """stem, label, quote: from the artifact of its own kind, else from the section of the other artifact, else from all of that."""
    own = parse.labelled_quotes(F.max(F.when(F.col("kind") == own_kind, F.col("text"))))
    other = F.max(F.when(F.col("kind") == other_kind, F.col("text")))
    part, whole = parse.labelled_quotes(parse.section(other, heading)), parse.labelled_quotes(other)
    some = lambda a: F.when(F.size(a) > 0, a)
    rows = artifacts.groupBy(stem).agg(F.coalesce(some(own), some(part), some(whole)).alias("q"))
    return rows.select(stem, F.inline("q"))
