"""Text functions as Column expressions: normal forms, words, keys, names, tokens, chunks, markup."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out of keywords.
STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was",
    "are", "were", "been", "be", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may",
    "might", "must", "that", "this", "these", "those", "it", "its", "they", "their", "them", "he", "she", "his", "her",
    "we", "our", "you", "your", "i", "my", "me", "what", "which", "who", "whom", "how", "when", "where", "why", "about",
    "into", "through", "during", "before", "after", "above", "below", "between", "under", "again", "further", "then",
    "once", "here", "there", "all", "each", "few", "more", "most", "other", "some", "such", "only", "own", "same", "than",
    "too", "very", "just", "also", "now", "being", "think", "says", "going", "really", "thing", "things", "something", "anything",
)
#: Entities of markup.
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&#x27;": "'", "&nbsp;": " ", "&copy;": "©",
    "&middot;": "·", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&ldquo;": "“", "&rdquo;": "”",
    "&lsquo;": "‘", "&rsquo;": "’",
}
#: Markers of a text that was cut off.
TRUNCATION_MARKERS = ("...[truncated]", "[content cut off]", "...(continued)", "[OUTPUT LIMIT REACHED]")
CHARS_PER_TOKEN, BUDGET_SHARE, LARGE_TEXT = 4, 0.8, 10_000
_BLANK = r"(?U)\s+"
_STOPS = "[.,!?;:—\\-'\"()]"
#: Words of speech that mean nothing.
SPOKEN_FILLERS = ("so", "again", "just", "really", "uh", "um", "you know", "i mean", "like", "actually", "basically")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often the body, or a lambda in it, uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pieces(text: Column) -> Column:
    """What white space (Unicode) parts, with an empty piece before it at the start and after it at the end."""
    return F.split(text, _BLANK, -1)


def words(text: Column) -> Column:
    """Maximal runs without white space (Unicode)."""
    return F.filter(F.split(text, _BLANK), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit("")))).cast("long")


def collapse(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, _BLANK, " "), "^ | $", "")


def unescape(text: Column) -> Column:
    """Common entities as characters; ``&amp;`` last, so that nothing is unescaped twice."""
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def escape(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def normalize(text: Column, aggressive: bool = False) -> Column:
    """Comparable form: no entities, tags or times; with ``aggressive`` no speakers and punctuation; blanks collapsed, lower case."""
    t = F.regexp_replace(unescape(text), "<[^>]+>", " ")
    t = F.regexp_replace(t, r"(?iU)[\[(]?\b\d+:\d{2}(?:\d{2})?(?:[ap]m)?[\])]?", " ")
    t = F.regexp_replace(t, r"(?U)(?:^|\s)[\[(]?:\d{2}\b[\])]?", " ")
    if aggressive:
        t = F.regexp_replace(t, r"(?U)\*\*[^*]+:\*\*\s*", "")
        t = F.regexp_replace(t, r"(?iU)(Speaker \d+|Unknown Speaker):\s*", "")
        t = F.regexp_replace(t, _STOPS, " ")
    return F.lower(collapse(t))


def normalize_word(word: Column) -> Column:
    """A word for alignment: no markup, no punctuation around it, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(word, "[#*_`]", ""), r"(?U)^[\W_]+|[\W_]+$", ""))


def normalize_comparison(text: Column) -> Column:
    return F.regexp_replace(collapse(F.lower(text)), "[,;:.!?]", "")


def comparable(text: Column, form: str) -> Column:
    """A form of a text for one kind of comparison, lower case; null stays null.

    ``quote``: no names of speakers in markup, ``[sic]`` marks, times of day or punctuation, for quotes that are looked for in a source.
    ``plain``: no labels before colons, and nothing but words and blanks, for quotes that are looked for in a page.
    ``spoken``: no names of speakers, punctuation or filler words, for what is said and then written down.
    """
    if form == "plain":
        unlabelled = F.regexp_replace(text, r"(?U)(?<![\w\s.])[\w\s.]++:", "")
        return F.lower(F.trim(F.regexp_replace(collapse(unlabelled), r"(?U)[^\w\s]", "")))
    if form == "quote":
        text = F.regexp_replace(text, r"(?U)(?:\*\*[^*]+:\*\*|(?i:<strong>)[^<]+:(?i:</strong>))\s*", "")
        text = F.regexp_replace(F.regexp_replace(text, r"(?U)\[sic\](?:\s*\([^)]+\))?", ""), r"\[\d{2}:\d{2}:\d{2}\]", " ")
    elif form == "spoken":
        text = F.regexp_replace(text, r"(?U)\*\*[^*]+:\*\*\s*", "")
    else:
        raise ValueError(f"no form of comparison: {form}")
    text = F.regexp_replace(F.lower(text), _STOPS, " ")
    return collapse(F.regexp_replace(text, rf"(?U)\b(?:{'|'.join(SPOKEN_FILLERS)})\b", " ") if form == "spoken" else text)


def strip_annotations(text: Column) -> tuple[Column, Column]:
    """(text without ``[sic]`` marks, their number)."""
    pattern = r"(?i)\s*\[sic\]"
    return F.regexp_replace(text, pattern, ""), F.regexp_count(text, F.lit(pattern))


def strip_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---[ \t]*\n.*?\n---[ \t]*\n+", "")


def front_matter(fields: Mapping[str, Column]) -> Column:
    """A front-matter block of the given fields, in their order."""
    lines = [F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit(""))) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"))


def logical_key(stem: Column) -> Column:
    """The key of a document, whatever versions its name carries."""
    return F.regexp_replace(stem, r"(?:_validated|_v\d+)+$", "")


def version(stem: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(stem, r"_v(\d+)$", 1), F.lit("")).cast("int"), F.lit(0))


def file_metadata(name: Column, suffixes: Sequence[str] = (" - formatted", "_yaml", " - yaml")) -> Column:
    """Struct of title, presenter, date, year and stem of ``Title - Presenter - Date``; null where the name has another form."""
    stem = F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")
    known = "|".join(r"\Q" + s + r"\E" for s in suffixes)
    stem = F.regexp_replace(F.regexp_replace(stem, f"(?:{known})$", ""), r" - copy \d+$", "")
    parts = F.split(stem, " - ")
    n = F.size(parts)
    date = F.trim(F.element_at(parts, -1))
    year = F.regexp_extract(date, r"(\d{4})", 1)
    whole = F.struct(
        F.trim(F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 2, F.lit(0))), " - ")).alias("title"),
        F.trim(F.get(parts, n - 2)).alias("presenter"), date.alias("date"), year.alias("year"), stem.alias("stem"),
    )
    return F.when((n >= 3) & (year != ""), whole)


def safe_file_name(name: Column) -> Column:
    """Base name without control characters and traversal; null where nothing is left or it is too long."""
    t = F.regexp_replace(F.element_at(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), -1), r"[\x00-\x1F/\\]", "")
    t = F.regexp_replace(F.trim(F.replace(t, F.lit(".."), F.lit(""))), r"^\.+|\.+$", "")
    return F.when((t != "") & (F.length(t) <= 255), t)


def size_label(size: Column) -> Column:
    out = F.format_string("%.1f TB", size / F.lit(1024.0**4))
    for i, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        out = F.when(size < 1024.0 ** (i + 1), F.format_string(f"%.1f {unit}", size / F.lit(1024.0**i))).otherwise(out)
    return out


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / CHARS_PER_TOKEN).cast("long")


def is_large(text: Column) -> Column:
    """A text that is worth a cache of its own."""
    return F.length(text) > LARGE_TEXT


def ends_well(text: Column) -> Column:
    """The last hundred characters end a sentence."""
    return F.trim(F.right(text, F.lit(100))).rlike(r"""[.!?"']\z""")


def cut_off(text: Column) -> Column:
    """The text holds a marker of a text that was cut off, in any case."""
    return let(F.lower(text), lambda low: F.exists(F.array(*(F.lit(m.lower()) for m in TRUNCATION_MARKERS)), lambda m: F.contains(low, m)))


def over_budget(text: Column, most: int) -> Column:
    return token_estimate(text) > most * BUDGET_SHARE


def output_cap(requested: Column, model: Column, limits: Mapping[str, int], default: int = 32_000) -> Column:
    known = F.create_map(*(x for k, v in limits.items() for x in (F.lit(k), F.lit(v)))) if limits else F.lit(None)
    return F.least(requested, F.coalesce(known[model], F.lit(default)) if limits else F.lit(default))


def fill(template: str, values: Mapping[str, Column]) -> Column:
    """``{{ name }}`` placeholders, in any case, replaced by values; those without a value stay.

    The template is cut when the plan is made, so that a value is never read again, whatever it holds.
    """
    known = {k.lower(): v for k, v in values.items()}
    names = "|".join(re.escape(k) for k in sorted(known, key=len, reverse=True))
    pieces = re.split(rf"\{{\{{\s*({names})\s*\}}\}}", template, flags=re.I) if known else [template]
    parts = [F.coalesce(known[p.lower()].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(pieces)]
    return F.concat(*parts)


def keywords(text: Column, least: int = 4, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Distinct words of letters, in order, without short and common ones."""
    every = F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))
    return F.array_distinct(F.filter(every, lambda w: (F.length(w) >= least) & ~w.isin(*stopwords)))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def chunk_spans(n_words: Column, size: int = 1500, overlap: int = 200, tail: float = 0.3) -> Column:
    """Array of (chunk, start, end) in words: overlapping chunks, the last one stretched over a short tail.

    The number of chunks follows from the length: a further one begins as long as more than ``tail`` of a chunk would be left over.
    """
    step = size - overlap
    last = F.greatest(F.lit(0), F.floor((n_words - (1 + tail) * size) / step).cast("int") + 1)
    span = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(i.alias("chunk"), (i * step).alias("start"), F.when(i < last, i * step + size).otherwise(n_words.cast("int")).alias("end")),
    )
    return F.when(n_words > 0, span).otherwise(F.array().cast("array<struct<chunk:int,start:int,end:int>>"))


def target_words(n_words: Column, share: float = 0.03, least: int = 150) -> Column:
    return F.greatest((n_words * share).cast("int"), F.lit(least))


def lens_count(n_words: Column) -> Column:
    """How many lenses a text of this length gets."""
    return F.when(n_words < 4000, 6).when(n_words < 8000, 9).otherwise(12)


def markdown_to_html(text: Column) -> Column:
    """Headings of three levels, bold, italic and paragraphs."""
    t = text
    for level in (3, 2, 1):
        t = F.regexp_replace(t, f"(?m)^{'#' * level} (.+)$", f"<h{level}>$1</h{level}>")
    t = F.regexp_replace(F.regexp_replace(t, r"\*\*(.+?)\*\*", "<strong>$1</strong>"), r"\*(.+?)\*", "<em>$1</em>")
    blocks = F.filter(F.transform(F.split(t, r"\n\n+"), lambda b: F.trim(b)), lambda b: b != "")
    return F.array_join(F.transform(blocks, lambda b: F.when(b.startswith("<h"), b).otherwise(F.concat(F.lit("<p>"), b, F.lit("</p>")))), "\n")


def grounded_share(claim: Column, source: Column) -> Column:
    """Share of the distinct keywords of ``claim`` that ``source`` (an array of keywords) has; 0 without any."""
    own = F.array_distinct(claim)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, source)) / F.size(own)).otherwise(F.lit(0.0))
