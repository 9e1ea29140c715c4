"""Pages: text and features of HTML, audits against the expected, highlighting of quotes, and rendering."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptloom.functions import parse, similarity
from scriptloom.functions import text as X
from scriptloom.functions.similarity import Haystack
from scriptloom.operators import grounding
from scriptloom.sources.tables import by_key

CLASSES = ("reference", "emphasis", "sidebar", "metadata", "abstract", "key-terms")


def page_text(html: Column) -> Column:
    """Visible text, lower case: entities as characters, tags as blanks, blanks collapsed."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(X.unescape(html), "<[^>]*>", " "), r"[ \t\n\r\f\x0B]+", " ")))


def first_of(html: Column, tag: str) -> Column:
    return F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)


def tag_count(html: Column, tag: str) -> Column:
    return F.regexp_count(html, F.lit(rf"<{tag}[ >]")).cast("long")


def missing_classes(html: Column, names=CLASSES) -> Column:
    """Class names that the page's style sheet lacks."""
    style = F.regexp_extract(html, r"(?is)<style[^>]*>(.*?)</style>", 1)
    return F.filter(F.array(*(F.lit(f".{n}") for n in names)), lambda n: ~F.contains(style, n))


#: Fixed values of HTML: elements without an end; elements that a start tag ends (of each group those that are open within the bound); what ends a paragraph.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
ENDED_BY = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select", "datalist")), "optgroup": (("optgroup", "option"), ("select",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)), "thead": (("tbody", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tfoot": (("thead", "tbody", "tr", "td", "th", "caption", "colgroup"), ("table",)), "rt": (("rt", "rp"), ("ruby",)), "rp": (("rt", "rp"), ("ruby",)),
}
BLOCKS = (
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dd", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul",
)
#: Fixed values of HTML: an end tag doesn't reach beyond these.
WALLS = ("html", "table", "td", "th", "caption", "button", "object", "template")


class _Selector(HTMLParser):
    """Text of elements with a tag, a class or both, nested ones included, in the order of their ends.

    Open elements are a stack, on which start tags end what they imply to have ended, end tags what is open up to theirs, and the page everything.
    """

    def __init__(self, tag: str | None, css: str | None):
        super().__init__(convert_charrefs=True)
        self.tag, self.css, self.stack, self.pieces, self.found = tag, css, [], [], []

    def _end(self, depth: int) -> None:
        """Elements from ``depth`` on end."""
        while len(self.stack) > depth:
            start = self.stack.pop()[1]
            if start is not None:
                self.found.append(" ".join("".join(self.pieces[start:]).split()))

    def _within(self, tags, walls) -> int | None:
        """The outermost open element of ``tags`` above the nearest of ``walls``."""
        at = None
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] in tags:
                at = depth
            elif self.stack[depth][0] in walls:
                break
        return at

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS and (at := self._within(("p",), WALLS)) is not None:
            self._end(at)
        if tag in ENDED_BY and (at := self._within(*ENDED_BY[tag])) is not None:
            self._end(at)
        classes = (dict(attrs).get("class") or "").split()
        chosen = self.tag in (None, tag) and (self.css is None or self.css in classes)
        self.stack.append((tag, len(self.pieces) if chosen else None))
        if tag in VOID:
            self._end(len(self.stack) - 1)

    def handle_endtag(self, tag):
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] == tag:
                return self._end(depth)
            if self.stack[depth][0] in WALLS and not (tag in ("table", "tr", "tbody", "thead", "tfoot") and self.stack[depth][0] in ("td", "th", "caption")) and tag not in ("html", "body"):
                return None  # an end tag of what isn't open
        return None

    def handle_data(self, data):
        self.pieces.append(data)

    def close(self):
        super().close()
        self._end(0)


def select(tag: str | None = None, css: str | None = None):
    """A function of the page that gives the texts of the elements chosen."""

    @F.pandas_udf("array<string>")
    def udf(pages: pd.Series) -> pd.Series:
        out = []
        for p in pages:
            parser = _Selector(tag, css)
            parser.feed(p or "")
            parser.close()
            out.append(parser.found)
        return pd.Series(out)

    return udf


def audit(pages: DataFrame, expected: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, check, severity, message: what the page lacks of the expected (title, presenter, n_sections, n_words, quotes)."""
    body = page_text(F.col(html))
    p = pages.select(key, body.alias("body_"), F.size(X.words(body)).alias("words_"), tag_count(F.col(html), "h2").alias("h2_"))
    both = p.join(expected, key)
    contains = lambda c: F.contains(F.col("body_"), F.lower(F.col(c)))
    row = lambda name, severity, message, bad: F.when(bad, F.struct(F.lit(name).alias("check"), F.lit(severity).alias("severity"), message.alias("message")))
    lost = F.filter("quotes", lambda q: ~F.contains(F.col("body_"), F.lower(q)))
    checks = F.array_compact(F.array(
        row("title", "error", F.col("title"), ~contains("title")), row("presenter", "warning", F.col("presenter"), ~contains("presenter")),
        row("sections", "warning", F.concat_ws("/", F.col("h2_").cast("string"), F.col("n_sections").cast("string")), F.col("h2_") < F.col("n_sections")),
        row("length", "warning", F.col("words_").cast("string"), F.col("words_") < 0.5 * F.col("n_words")),
        row("quotes", "error", F.array_join(F.transform(lost, lambda q: F.left(q, F.lit(40))), "; "), F.size(lost) > 0),
    ))
    return both.select(key, F.inline(checks))


QUOTE_RATIO, RATE_FLOOR = 0.85, 0.5


def quotes_present(pages: DataFrame, quotes: DataFrame, key: str = "page_id", html: str = "html", quote: str = "quote") -> DataFrame:
    """Rows of quotes with ``ratio`` on their page and ``present`` (from QUOTE_RATIO on); the text of a page is made, shuffled and normalised once for all its quotes."""
    shown = pages.select(key, page_text(F.col(html)).alias("body_"))
    return grounding.match(quotes, shown, {"ratio": quote}, key, "body_").withColumn("present", F.col("ratio") >= QUOTE_RATIO)


def audit_rates(found: DataFrame, key: str = "page_id", group: str = "kind", floor: float = RATE_FLOOR) -> DataFrame:
    """key, group, n, rate and ``low``: the share of the quotes of a kind that are present is below ``floor``."""
    rates = found.groupBy(key, group).agg(F.count("*").alias("n"), F.avg(F.col("present").cast("double")).alias("rate"))
    return rates.withColumn("low", F.col("rate") < floor)


def sections_agree(text: Column, html: Column) -> Column:
    """Struct of the numbers of second-level headings of a text and its page, and whether they are equal."""
    a, b = F.size(parse.headed_sections(text)).cast("long"), tag_count(html, "h2")
    return F.struct(a.alias("text"), b.alias("page"), (a == b).alias("agree"))


def sampled_coverage(names: Column, found: Column, share: float = 0.3) -> Column:
    """Share of the first ``share`` of names that equal, contain or are part of one found."""
    head = F.slice(names, F.lit(1), F.ceil(F.size(names) * share).cast("int"))
    hit = F.filter(head, lambda a: F.exists(found, lambda b: F.contains(F.lower(a), F.lower(b)) | F.contains(F.lower(b), F.lower(a))))
    return F.when(F.size(head) > 0, F.size(hit) / F.size(head))


#: From which scores on a mark has a class of its own. A score stands in percent at the end of a label.
SCORE_CLASSES = ((95, "score-95"), (90, "score-90"))
_SCORE = re.compile(r"\((\d+)%\)$")


def _kept(spans: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, list[str]]]:
    """Of (start, end, kind, label) the spans that are marked, from the back of the text, without overlaps, each with its labels.

    Of overlapping spans of one kind the one further back stays. Across kinds emphasis stays and takes the reference's label.
    """
    out: list[tuple[int, int, str, list[str]]] = []
    for a, z, kind, label in sorted(spans, key=lambda s: (-s[0], -s[1])):
        first = len(out)
        while first and out[first - 1][0] < z:  # those kept are disjoint, so that the ones it overlaps are the last
            first -= 1
        labels, beaten = [label], []
        for other in out[first:]:
            if other[2] == kind:
                break
            if kind != "emphasis":
                if label not in other[3]:
                    other[3].append(label)
                break
            labels += [x for x in other[3] if x not in labels]
            beaten.append(other)
        else:
            out[first:] = [x for x in out[first:] if x not in beaten]
            out.append((a, z, kind, labels))
    return out


def highlight(text: str, quotes: list[tuple[str, str, str]]) -> tuple[str, int]:
    """(text with marks, how many) of quotes (kind, label, quote), emphasis and references; see ``_kept`` for those that overlap.

    Marks are put at raw places; nothing else of the text changes. A mark with a score in its label has a class for it.
    """
    if not quotes:
        return text, 0
    known, spans = Haystack(text, True), []
    for kind, label, quote in quotes:
        if quote is not None and (got := known.word_span(quote)) is not None:
            spans.append((*known.span(got[0], got[1]), kind, label or ""))
    parts, at, kept = [], len(text), _kept(spans)
    for a, z, kind, labels in kept:
        score = _SCORE.search(labels[0]) if kind == "emphasis" else None
        css = " ".join([kind, *[c for least, c in SCORE_CLASSES if score and int(score[1]) >= least][:1]])
        title = "; ".join(labels).replace('"', "&quot;")
        parts += [text[z:at], "</mark>", text[a:z], f'<mark class="{css}" title="{title}">']
        at = a
    return "".join(reversed([*parts, text[:at]])), len(kept)


def typed_quotes(lists: Mapping[str, DataFrame], key: str = "doc_id", quote: str = "quote", label: str = "label") -> DataFrame:
    """Lists of quotes as one: key, ordinal, kind, label, quote. ``lists`` maps kinds to lists; ordinals of a key count through them, list by list."""
    parts = [q.select(key, F.struct(F.lit(n).alias("list"), F.col("ordinal").cast("long").alias("place")).alias("o_"), F.lit(kind).alias("kind"), label, quote) for n, (kind, q) in enumerate(lists.items())]
    every = reduce(DataFrame.unionByName, parts)
    rank = F.row_number().over(W.partitionBy(key).orderBy("o_", label, quote)) - 1
    return every.select(key, rank.alias("ordinal"), "kind", F.col(label).alias("label"), F.col(quote).alias("quote"))


def highlighted(docs: DataFrame, quotes: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with a struct ``highlighted`` (text, marks); quotes (key, ordinal, kind, label, quote) travel with their document."""
    lists = quotes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ordinal", "kind", "label", "quote"))).alias("q_"))
    both = by_key(docs, key).join(lists, key, "left")

    @F.pandas_udf("text string, marks int")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, qs in batches:
            got = [highlight(t or "", [(x["kind"], x["label"], x["quote"]) for x in (q if q is not None else [])]) for t, q in zip(texts, qs, strict=True)]
            yield pd.DataFrame({"text": [g[0] for g in got], "marks": [g[1] for g in got]})

    return both.withColumn("highlighted", run(text, "q_")).drop("q_")


PAGE = "<!DOCTYPE html><html><head><meta charset='utf-8'><title>{{title}}</title><style>{{style}}</style></head><body>{{sidebar}}<main><h1>{{title}}</h1>{{body}}</main></body></html>"


PRINT_STYLE = "@page{margin:2cm} main{font:12pt serif} mark{background:none;font-weight:bold}"


def printable(docs: DataFrame, title: str, body: str, out: str = "page") -> DataFrame:
    """``docs`` with a page for print: no sidebar, and marks that need no colour."""
    return rendered(docs, title, body, None, PRINT_STYLE, out)


def rendered(docs: DataFrame, title: str, body: str, sidebar: str | None = None, style: str = "mark{background:#fe8}", out: str = "page") -> DataFrame:
    """``docs`` with a page in ``out``: Markdown as HTML in a template, with or without a sidebar."""
    side = F.concat(F.lit("<aside>"), X.markdown_to_html(F.col(sidebar)), F.lit("</aside>")) if sidebar else F.lit("")
    return docs.withColumn(out, X.fill(PAGE, {"title": X.escape(F.col(title)), "style": F.lit(style), "sidebar": side, "body": X.markdown_to_html(F.col(body))}))
