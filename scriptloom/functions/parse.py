"""Parsers of semi-structured text as Column expressions: sections, topics, themes, terms, quotes, ranges and JSON.

Where a text may come in several formats, each format has its own expression and the first that finds anything wins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptloom.functions.text import let

_QUOTE_OPEN, _QUOTE_CLOSE = '["“]', '["”]'


def _all(text: Column, pattern: str, *names: str, cast: dict[str, str] | None = None) -> Column:
    """Array of structs: a field for each group of every match, blanks trimmed."""
    groups = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i + 1)).alias(n) for i, n in enumerate(names)]
    cast = cast or {}
    return F.transform(
        F.arrays_zip(*groups),
        lambda x: F.struct(*(F.trim(x[n]).cast(cast[n]).alias(n) if n in cast else F.trim(x[n]).alias(n) for n in names)),
    )


def _first(*arrays: Column) -> Column:
    """The first array that isn't empty."""
    out = arrays[-1]
    for a in reversed(arrays[:-1]):
        out = F.when(F.size(a) > 0, a).otherwise(out)
    return out


def numbered_sections(text: Column) -> Column:
    """Array of (number, heading, content) of ``## Section N ...`` headings."""
    return _all(text, r"(?ms)^## Section (\d+)([^\n]*)\n?(.*?)(?=^## Section \d+|\z)", "number", "heading", "content", cast={"number": "int"})


def section_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"## Section \d+"))


def headed_sections(text: Column) -> Column:
    """Array of (heading, content) of second-level headings; markup of the heading is dropped."""
    found = _all(text, r"(?ms)^##[ \t]+([^\n]+)\n?(.*?)(?=^##[ \t]|\z)", "heading", "content")
    return F.transform(found, lambda s: F.struct(F.trim(F.regexp_replace(s["heading"], r"[*_#]|^\d+[.)]\s*", "")).alias("heading"), s["content"].alias("content")))


def _nearest(levels: Column, more: int) -> Column:
    """For each level of an array the place of the nearest one before it that is lower (or as low, with ``more`` 1), -1 if there is none; one pass."""
    start = F.struct(F.array_repeat(F.lit(-1), 6).alias("last"), F.array().cast("array<int>").alias("out"))
    step = lambda seen, x: F.struct(
        F.transform(seen["last"], lambda v, p: F.when(p == x["level"] - 1, x["place"]).otherwise(v)).alias("last"),
        F.concat(seen["out"], F.array(F.coalesce(F.array_max(F.slice(seen["last"], F.lit(1), x["level"] - 1 + more)), F.lit(-1)))).alias("out"),
    )
    return F.aggregate(F.transform(levels, lambda v, i: F.struct(v.alias("level"), i.alias("place"))), start, step, lambda seen: seen["out"])


def all_sections(text: Column) -> Column:
    """Array of (ordinal, level, heading, parent, body, whole) of all headings with one to six hashes, in one scan of the text.

    ``parent`` is the ordinal of the nearest heading before with fewer hashes, null if there is none; ``body`` ends at the next heading, ``whole`` at the next one of as many hashes or fewer.
    What stands before the first heading isn't in it. The text is cut at its headings once; parents and ends come from one pass each over the levels.
    """
    cut = F.filter(F.split(text, r"(?m)^(?=#{1,6}[ \t]+\S)"), lambda p: p.rlike(r"\A#{1,6}[ \t]+\S"))
    body = lambda p: F.regexp_replace(p, r"\A[^\n]*\n?", "")

    def found(pieces: Column, levels: Column, parents: Column, ends: Column) -> Column:
        n = F.size(pieces)
        stop = lambda i: F.when(F.get(ends, n - 1 - i) < 0, n).otherwise(n - 1 - F.get(ends, n - 1 - i))
        return F.transform(pieces, lambda p, i: F.struct(
            i.alias("ordinal"), F.get(levels, i).alias("level"), F.trim(F.regexp_extract(p, r"\A#{1,6}[ \t]+([^\n]*)", 1)).alias("heading"),
            F.when(F.get(parents, i) >= 0, F.get(parents, i)).alias("parent"), body(p).alias("body"), F.concat(body(p), F.array_join(F.slice(pieces, i + 2, stop(i) - i - 1), "")).alias("whole"),
        ))

    return let(cut, lambda pieces: let(
        F.transform(pieces, lambda p: F.length(F.regexp_extract(p, r"\A(#{1,6})", 1))),
        lambda levels: let(_nearest(levels, 0), lambda parents: let(_nearest(F.reverse(levels), 1), lambda ends: found(pieces, levels, parents, ends))),
    ))


def section(text: Column, name: str) -> Column:
    """Body of the section called ``name``, up to the next heading of its level or a higher one; empty where there is none.

    A heading has hashes, or is bold or numbered; one without hashes counts as of the second level. Deeper headings belong to the body.
    """
    start = r"[ \t]*(?:\d+[.)][ \t]*)?(?:\*\*)?[ \t]*(?:\d+[.)][ \t]*)?\Q" + name.replace("\\E", "") + r"\E\b[^\n]*\n?"
    found = None
    for level in (1, 2, 3, 4, 5, 6):
        body = F.regexp_extract(text, rf"(?msi)^#{{{level}}}{start}(.*?)(?=^#{{1,{level}}}[ \t]|\z)", 1)
        has = text.rlike(rf"(?mi)^#{{{level}}}{start}")
        found = F.when(has, body) if found is None else found.when(has, body)
    bare = F.regexp_extract(text, rf"(?msi)^(?:\*\*|\d+[.)])?{start}(.*?)(?=^#{{1,2}}[ \t]|\z)", 1)
    return F.trim(F.regexp_replace(found.otherwise(bare), r"^\n+|\n+$", ""))


def normalize_headers(text: Column) -> Column:
    """Headings of the known sections in their one canonical form."""
    for name in ("Topics", "Interpretive Themes", "Key Terms"):
        text = F.regexp_replace(text, rf"(?im)^(?:#+[ \t]*)?(?:\*\*)?(?:\d+[.)][ \t]*)?{name}:?(?:\*\*)?:?[ \t]*$", f"## {name}")
    return text


def topics(text: Column, least: int = 5) -> Column:
    """Array of (name, percentage, sections, description): strict metadata, else headings, else list entries with ranks for shares."""
    meta = r"(?ms)^###[ \t]+([^\n]+)\n(.*?)\n?[*_\[]+[^\n\d]*?(\d+)[ \t]*%[^\n;]*;[ \t]*Sections?[ \t:]*([^\]*_\n]+)[\]*_]+"
    strict = _all(text, meta, "name", "description", "percentage", "sections", cast={"percentage": "int"})
    strict = F.filter(strict, lambda t: t["percentage"] >= least)
    strict = F.transform(strict, lambda t: F.struct(t["name"].alias("name"), t["percentage"].alias("percentage"), t["sections"].alias("sections"), t["description"].alias("description")))

    def ranked(found: Column) -> Column:
        return F.transform(found, lambda t, i: F.struct(t["name"].alias("name"), F.greatest(F.lit(5), F.lit(100) - i * 10).cast("int").alias("percentage"), F.lit("").alias("sections"), t["description"].alias("description")))

    heads = ranked(_all(text, r"(?ms)^###[ \t]+([^\n]+)\n(.*?)(?=^#|\z)", "name", "description"))
    entries = ranked(_all(text, r"(?m)^[ \t]*(?:[-*]|\d+[.)])[ \t]+(?:\*\*)?([^*\n:]+)(?:\*\*)?:?[ \t]*([^\n]*)$", "name", "description"))
    return _first(strict, heads, entries)


def top_topics(found: Column, most: int = 5) -> Column:
    """Largest shares first; equal ones keep their order."""
    placed = F.transform(found, lambda t, i: F.struct((-t["percentage"]).alias("k"), i.alias("i"), t.alias("t")))
    return F.slice(F.transform(F.array_sort(placed), lambda x: x["t"]), 1, most)


def themes(text: Column) -> Column:
    """Array of (name, description, sections): numbered bold entries, else headings."""
    listed = _all(text, r"(?ms)^\d+[.)][ \t]+\*\*([^*\n]+?):?\*\*:?[ \t]*(.*?)(?=^\d+[.)][ \t]+\*\*|^#|\z)", "name", "description")
    headed = _all(text, r"(?ms)^###[ \t]+(?:\d+[.)][ \t]*)?([^\n]+)\n(.*?)(?=^#|\z)", "name", "description")
    found = _first(listed, headed)
    source = r"(?i)\*{0,2}_?Source Sections?:?_?\*{0,2}:?[ \t]*([^\n*_]+)[*_]*"
    return F.transform(
        found,
        lambda t: F.struct(t["name"].alias("name"), F.trim(F.regexp_replace(t["description"], source, "")).alias("description"), F.trim(F.regexp_extract(t["description"], source, 1)).alias("sections")),
    )


def key_terms(text: Column) -> Column:
    """Array of (term, definition): headings and ``**Term**: text`` merged, the first spelling of a term wins."""
    headed = _all(text, r"(?ms)^###[ \t]+([^\n]+)\n(.*?)(?=^#|\z)", "term", "definition")
    bold = _all(text, r"(?m)^(?:[-*][ \t]+)?\*\*([^*\n:]+):?\*\*:?[ \t]*([^\n]*)$", "term", "definition")
    placed = F.array_sort(F.transform(F.concat(headed, bold), lambda t, i: F.struct(F.lower(t["term"]).alias("k"), i.alias("i"), t.alias("t"))))
    firsts = let(placed, lambda all_: F.filter(all_, lambda x, j: (j == 0) | (F.get(all_, j - 1)["k"] != x["k"])))  # of equal terms the first in its order
    return F.transform(F.array_sort(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["t"].alias("t")))), lambda x: x["t"])


def labelled_quotes(text: Column) -> Column:
    """Array of (label, quote) of lines such as ``> **Label:** "quote"``."""
    return _all(text, rf"(?m)^[ \t]*[>\-*][ \t]*\*\*([^*\n]+?):\*\*[ \t]*{_QUOTE_OPEN}([^\n]+?){_QUOTE_CLOSE}[ \t]*$", "label", "quote")


def scored_items(text: Column) -> Column:
    """Array of (type, category, score, concept, quote) of ``[Type - Category - Rank: NN%] Concept: ... "quote"``; a range gives its mean."""
    pattern = rf"(?s)\[([^\[\]\n]+?) - ([^\[\]\n]+?) - Rank: ([\d\-– ]+)%\][ \t]*Concept:[ \t]*([^\n]*?)\s*{_QUOTE_OPEN}(.*?){_QUOTE_CLOSE}"
    found = _all(text, pattern, "type", "category", "rank", "concept", "quote")
    numbers = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), lambda n: n.cast("int"))
    return F.transform(
        found,
        lambda x: F.struct(
            x["type"].alias("type"), x["category"].alias("category"),
            F.floor(F.aggregate(numbers(x["rank"]), F.lit(0), lambda a, n: a + n) / F.greatest(F.size(numbers(x["rank"])), F.lit(1))).cast("int").alias("score"),
            x["concept"].alias("concept"), x["quote"].alias("quote"),
        ),
    )


def section_range(text: Column) -> Column:
    """Numbers meant by ``6-14`` (at the start) or by a list."""
    low, high = (F.regexp_extract(text, r"^\s*(\d+)\s*[-–]\s*(\d+)", i).cast("int") for i in (1, 2))
    ranged = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    return F.when(text.rlike(r"^\s*\d+\s*[-–]\s*\d+"), ranged).otherwise(F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), lambda n: n.cast("int")))


def labels(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != "")


def cache_tokens(text: Column, word: str) -> Column:
    """``Yes (Read N)`` or ``(Created N)`` as a number, 0 where there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(text, rf"{word} (\d+)", 1), F.lit("")).cast("long"), F.lit(0))


def _unfenced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"```(?:json)?\s*|\s*```", ""))


def json_object(text: Column, schema: str) -> Column:
    """Struct of the JSON object in ``text``: without fences, else from the first brace to the last; else null."""
    part = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    bare = _unfenced(text)
    return F.coalesce(F.when(bare.startswith("{") & bare.endswith("}"), F.from_json(bare, schema)), F.when(part != "", F.from_json(part, schema)))


def json_array(text: Column, element: str) -> Column:
    """Array of the JSON list in ``text``: without fences, else from the first bracket to the last; else empty."""
    part = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    bare, kind = _unfenced(text), f"array<{element}>"
    found = F.coalesce(F.when(bare.startswith("[") & bare.endswith("]"), F.from_json(bare, kind)), F.when(part != "", F.from_json(part, kind)))
    return F.coalesce(found, F.array().cast(kind))


def paragraphs(text: Column) -> Column:
    """Paragraphs without headings and without a short title in front."""
    every = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: (p != "") & ~p.startswith("#"))
    titled = (F.size(every) > 0) & (F.size(F.split(F.get(every, F.lit(0)), r"\s+")) < 10) & ~F.get(every, F.lit(0)).rlike(r"[.!?]$")
    return F.when(titled, F.slice(every, F.lit(2), F.size(every))).otherwise(every)


def opening_body_closing(found: Column) -> Column:
    """Struct of three texts: first, middle and last paragraphs where there are three at least, else all as body."""
    n = F.size(found)
    return F.when(
        n >= 3,
        F.struct(F.get(found, F.lit(0)).alias("opening"), F.array_join(F.slice(found, F.lit(2), n - 2), "\n\n").alias("body"), F.element_at(found, -1).alias("closing")),
    ).otherwise(F.struct(F.lit("").alias("opening"), F.array_join(found, "\n\n").alias("body"), F.lit("").alias("closing")))


def first_themes(found: Column, most: int = 2) -> Column:
    """The first themes, as the inputs of an abstract take them."""
    return F.slice(found, 1, most)


#: Shape of an audit of voice.
VOICE = "overall_score int, strengths array<string>, issues array<struct<quote:string,problem:string>>, verdict string"


def voice_audit(answer: Column) -> Column:
    """The audit in a model's answer, fenced or with text around it; null where there is none."""
    return json_object(answer, VOICE)
