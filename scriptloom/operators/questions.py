"""Purpose, conclusion and questions of a sectioned text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptloom.functions import parse

#: Cues in their order.
PURPOSE = (r"my intent[^.]+is[^.]+\.", r"I'm going to[^.]+\.", r"today[^.]+explore[^.]+\.", r"purpose[^.]+is[^.]+\.", r"goal[^.]+is[^.]+\.", r"I want to[^.]+\.")
CONCLUSION = (r"I think we can safely say[^.]+\.", r"in conclusion[^.]+\.", r"to conclude[^.]+\.", r"the answer[^.]+\.", r"I conclude[^.]+\.", r"this suggests[^.]+\.")
ASKS = (r"\*\*[A-Z][a-z]+\s*:\*\*", r"\*\*Dr[.\s]+\w+:\*\*", r"\*\*Audience", r"question", r"comment")
#: Cues of a summary's closing, of questions left open, and of what is to come.
CLOSING = (r"I think we can safely say[^.]+\.", r"In conclusion[^.]+\.", r"To conclude[^.]+\.", r"So[,]? (?:the |my )?(?:answer|conclusion|point)[^.]+\.")
OPEN = (r"Question[^.]+\?", r"Whether[^.]+\.", r"I don't know[^.]+\.", r"Remains to be seen[^.]+\.")
FUTURE = (r"Future[^.]+\.", r"Next[^.]+\.", r"Path forward[^.]+\.", r"Will (?:ultimately |eventually )?[^.]+\.")
NO_PURPOSE, NO_CONCLUSION = "Not explicitly stated", "No explicit conclusion stated"
#: Words that say nothing in a topic phrase.
QUIET = (
    "a", "about", "an", "and", "as", "at", "be", "but", "by", "for", "from", "how", "i", "if", "in", "is", "it", "my", "of", "on", "or", "our", "so", "that", "regarding",
    "the", "their", "them", "there", "these", "they", "this", "those", "to", "we", "what", "when", "where", "which", "who", "why", "you", "your",
)


def first_cue(text: Column, cues: tuple[str, ...], default: str) -> Column:
    """The first match of the first cue that matches."""
    found = [F.nullif(F.trim(F.regexp_extract(text, f"(?i){c}", 0)), F.lit("")) for c in cues]
    return F.coalesce(*found, F.lit(default))


def _joined(sections: Column, keep) -> Column:
    return F.array_join(F.transform(F.filter(sections, keep), lambda s: s["content"]), " ")


def purpose(text: Column) -> Column:
    """Stated in the first tenth of the sections, one at least."""
    sections = parse.numbered_sections(text)
    most = F.greatest(F.lit(1), F.floor(F.size(sections) / 10))
    return first_cue(_joined(sections, lambda s: s["number"] <= most), PURPOSE, NO_PURPOSE)


def conclusion(text: Column) -> Column:
    """Stated in the last tenth of the sections, the last two at least."""
    sections = parse.numbered_sections(text)
    n = F.size(sections)
    tenth = F.floor(n / 10)
    start = F.when(n - tenth > 0, F.when(tenth > 0, n - tenth).otherwise(n)).otherwise(n - 1)
    return first_cue(_joined(sections, lambda s: s["number"] >= start), CONCLUSION, NO_CONCLUSION)


def _either_case(cue: str) -> str:
    """The cue with its first letter in either case, and nothing else."""
    return f"[{cue[0].upper()}{cue[0].lower()}]{cue[1:]}"


def closing(text: Column) -> Column:
    """Struct of conclusion, open_question and direction, each by the first of its cues that fits.

    The closing begins at the later of the last tenth and the fourth section from the end.
    """
    sections = parse.numbered_sections(text)
    n = F.size(sections)
    start = F.greatest(n - F.floor(n / 10), n - 3)
    body = F.array_join(F.transform(F.filter(sections, lambda s: s["number"] >= start), lambda s: F.concat(s["content"], F.lit(" "))), "")

    def cue(cues: tuple[str, ...], default: str) -> Column:
        return F.coalesce(*(F.nullif(F.trim(F.regexp_extract(body, _either_case(c), 0)), F.lit("")) for c in cues), F.lit(default))

    return F.struct(cue(CLOSING, NO_CONCLUSION).alias("conclusion"), cue(OPEN, "").alias("open_question"), cue(FUTURE, "").alias("direction"))


def _asks(content: Column) -> Column:
    total = F.lit(0)
    for p in ASKS:
        total = total + F.regexp_count(content, F.lit(f"(?i){p}"))
    return total


def qa_percentage(text: Column) -> Column:
    """Share of the sections, in percent, with two signs of questions or more."""
    sections = parse.numbered_sections(text)
    asking = F.size(F.filter(sections, lambda s: _asks(s["content"]) >= 2))
    return F.when(F.size(sections) > 0, F.floor(100 * asking / F.size(sections)).cast("int")).otherwise(0)


def clean_topics(phrases: Column, most: int = 5) -> Column:
    """Up to four words that say something of each phrase with two at least; distinct, in order."""
    words = lambda p: F.filter(F.regexp_extract_all(F.lower(p), F.lit("([a-z]+)"), F.lit(1)), lambda w: ~w.isin(*QUIET))
    lists = F.filter(F.transform(phrases, words), lambda w: (F.size(w) >= 2) & F.exists(w, lambda x: F.length(x) >= 4))
    return F.slice(F.array_distinct(F.transform(lists, lambda w: F.array_join(F.slice(w, 1, 4), " "))), 1, most)


def qa_topics(text: Column) -> Column:
    phrase = r"(?i)(?:about|on|regarding)\s+([A-Za-z][^.,;:!?\n]{2,80})"
    sections = F.filter(parse.numbered_sections(text), lambda s: _asks(s["content"]) >= 2)
    return clean_topics(F.flatten(F.transform(sections, lambda s: F.slice(F.regexp_extract_all(s["content"], F.lit(phrase), F.lit(1)), 1, 3))))


def notable_exchanges(text: Column, most: int = 3) -> Column:
    """First sentences (100 characters) of long turns of speakers without a doctor's title."""
    groups = [F.regexp_extract_all(text, F.lit(r"(?s)\*\*([^*\n]+?):\*\*(.*?)(?=\*\*[^*\n]+?:\*\*|\z)"), F.lit(i)).alias(n) for i, n in ((1, "who"), (2, "said"))]
    strip = lambda c: F.trim(c, F.lit(" \t\n\r\f\x0b"))
    turns = F.filter(F.arrays_zip(*groups), lambda t: (F.length(strip(t["said"])) > 200) & ~F.contains(t["who"], F.lit("Dr")))
    return F.slice(F.transform(turns, lambda t: F.left(F.get(F.split(strip(t["said"]), r"(?<=[.!?])\s+"), F.lit(0)), F.lit(100))), 1, most)
