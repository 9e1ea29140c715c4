"""Texts that a model writes, as operators: a prompt for each row, the answer parsed and judged, and asked again where it isn't valid.

The backend is replaceable (see ``completion``); everything around the call is declared as columns, so that the plan holds one Arrow step a call.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptloom.functions import compose, parse
from scriptloom.functions import text as X
from scriptloom.operators import completion, coverage, patterns

#: A formatted text has at least this share of the raw text's words.
LEAST_SHARE = 0.5
#: Prompts; callers give their own. ``{{ name }}`` is filled from the columns that are named.
FORMAT, SECTION = "Format this transcript.\n\n{{ text }}", "Write the section {{ kind }} of this text.\n\n{{ text }}"
STRUCTURED, VOICE, HEADERS = "Write a text from this plan.\n\n{{ plan }}", "Judge the voice of this text.\n\n{{ text }}", "Do these headings fit?\n\n{{ sections }}"
#: Sections that go into one prompt, and the line below each.
SECTIONS, RULE = 5, "-" * 40
_BLOCK = re.compile(rf"^SECTION ([^\n]*):\nHeading: ([^\n]*)\nContent: (.*?)\n{RULE}$", re.M | re.S)


def asked(rows: DataFrame, template: str, values: Mapping[str, Column], backend: completion.Backend | None = None, key: str | None = None) -> DataFrame:
    """``rows`` with the struct ``answer`` to the filled template."""
    prompt = rows.withColumn("prompt_", X.fill(template, values))
    return completion.completed(prompt, "prompt_", backend, key).drop("prompt_")


def formatted(docs: DataFrame, text: str = "text", template: str = FORMAT, backend: completion.Backend | None = None) -> DataFrame:
    """``docs`` with ``formatted`` (the answer's text) and ``fault``: an invalid answer, or one of fewer than half of the words."""
    got = asked(docs, template, {"text": F.col(text)}, backend)
    few = X.word_count(F.col("answer.text")) < LEAST_SHARE * X.word_count(F.col(text))
    return got.withColumns({"formatted": F.col("answer.text"), "fault": F.coalesce(completion.answer_fault(F.col("answer")), F.when(few, "lost words"))}).drop("answer")


def section_of(docs: DataFrame, kind: str, text: str = "text", template: str = SECTION, backend: completion.Backend | None = None, tries: int = 3) -> DataFrame:
    """``docs`` with ``section`` (headers in their canonical form) and ``accepted``: asked again until a section of this kind is valid, ``tries`` times at most."""
    done = completion.until_valid(
        docs, lambda left, _: asked(left, template, {"text": F.col(text), "kind": F.lit(kind)}, backend),
        completion.answer_fault(F.col("answer")).isNull() & compose.valid_section(F.lit(kind), F.col("answer.text")), tries,
    )
    return done.withColumn("section", parse.normalize_headers(F.col("answer.text"))).drop("answer")


def plan_text(*columns: str) -> Column:
    """The named columns, nested as they are, as one JSON object."""
    return F.to_json(F.struct(*columns))


def structured(plans: DataFrame, columns: list[str], target: Column, summary: bool = False, template: str = STRUCTURED, backend: completion.Backend | None = None) -> DataFrame:
    """``plans`` with the text written from them, its issues and warnings."""
    got = asked(plans, template, {"plan": plan_text(*columns)}, backend)
    issues, warnings = coverage.structure_messages(F.col("answer.text"), target, summary)
    return got.withColumns({"written": F.col("answer.text"), "issues": issues, "warnings": warnings, "fault": completion.answer_fault(F.col("answer"))}).drop("answer")


def voice_audited(docs: DataFrame, text: str = "text", template: str = VOICE, backend: completion.Backend | None = None) -> DataFrame:
    """``docs`` with the struct ``audit`` read from the answer, null where it can't be read."""
    got = asked(docs, template, {"text": F.col(text)}, backend)
    return got.withColumn("audit", parse.voice_audit(F.col("answer.text"))).drop("answer")


def headers_judged(sections: DataFrame, key: str = "doc_id", template: str = HEADERS, backend: completion.Backend | None = None) -> DataFrame:
    """Rows of sections (key, number, heading, content) with ``batch``, ``at`` (the place in it), ``said`` (the answer's line) and ``fits``.

    Sections go by their places, whatever gaps their numbers have: five into one prompt, headings with contents, and a line of the answer says YES or NO to each in turn. A line that is missing
    is a NO. Sections without a number come first.
    """
    place = F.row_number().over(W.partitionBy(key).orderBy("number", "heading")) - 1
    rows = sections.withColumn("place_", place).withColumns({"batch": F.floor(F.col("place_") / SECTIONS).cast("int"), "at": (F.col("place_") % SECTIONS).cast("int")}).drop("place_")
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    block = F.concat(F.lit("SECTION "), part("number"), F.lit(":\nHeading: "), part("heading"), F.lit("\nContent: "), part("content"), F.lit("\n" + RULE))
    lists = F.sort_array(F.collect_list(F.struct("at", block.alias("block"))))
    batches = rows.groupBy(key, "batch").agg(F.array_join(F.transform(lists, lambda x: x["block"]), "\n").alias("sections"))  # five of a document
    got = asked(batches, template, {"sections": F.col("sections")}, backend)
    lines = got.select(F.col(key).alias("key_"), F.col("batch").alias("batch_"), F.posexplode(F.filter(F.split("answer.text", "\n"), lambda x: F.trim(x) != "")).alias("at_", "said"))
    both = rows.join(lines, F.col(key).eqNullSafe(F.col("key_")) & (F.col("batch") == F.col("batch_")) & (F.col("at") == F.col("at_")), "left").drop("key_", "batch_", "at_")
    return both.withColumn("fits", F.coalesce(F.upper("said").rlike(r"\bYES\b"), F.lit(False)))


class HeadingBackend:
    """Says YES to a section whose content holds all words of its heading, NO to others: what can be judged without a model."""

    def complete(self, prompts: list[str]) -> list[dict]:
        out = []
        for prompt in prompts:
            said = []
            for number, heading, content in _BLOCK.findall(prompt):
                have = set(content.lower().split())
                said.append(f"SECTION {number}: {'YES' if set(heading.lower().split()) <= have else 'NO'}")
            text = "\n".join(said)
            out.append({"text": text, "stop_reason": "end_turn", "model": "headings", "input_tokens": len(prompt) // 4, "output_tokens": len(text) // 4})
        return out


def header_report(judged: DataFrame, terms: Sequence[str] = (), key: str = "doc_id", title: str = "Headings") -> DataFrame:
    """key, report: Markdown of ``headers_judged``: headings that hold one of ``terms``, what was said to each batch, and the batches without an answer."""
    hits = patterns.lexicon_hits(F.col("heading"), list(terms)) if terms else F.array().cast("array<string>")
    section = F.concat(F.lit("- **Section "), F.coalesce(F.col("number").cast("string"), F.lit("")), F.lit("**: "), F.coalesce("heading", F.lit("")))
    rows = judged.select(
        key, F.struct("batch", "at").alias("o"), F.col("batch"), F.coalesce("said", F.lit("(no answer)")).alias("said"), F.col("said").isNull().alias("lost"),
        F.when(F.size(hits) > 0, F.concat(section, F.lit(" holds "), F.array_join(hits, ", "))).alias("flag"),
    )
    lists = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("o", "batch", "said", "lost", "flag"))).alias("x"), F.max("batch").alias("last"))  # the headings of a document
    joined = lambda a, none: F.when(F.size(a) > 0, F.array_join(a, "\n")).otherwise(none)
    batch = lambda b: F.concat(F.lit("\n### Batch "), (b + 1).cast("string"), F.lit("\n"), F.array_join(F.transform(F.filter("x", lambda r: r["batch"] == b), lambda r: r["said"]), "\n"), F.lit("\n"))
    every = F.sequence(F.lit(0), F.col("last"))
    failed = F.filter(every, lambda b: F.forall(F.filter("x", lambda r: r["batch"] == b), lambda r: r["lost"]))
    return lists.select(key, F.concat(
        F.lit(f"# {title}\n\n## Terms\n"), joined(F.array_compact(F.transform("x", lambda r: r["flag"])), F.lit("None found.")), F.lit("\n\n## Answers\n"), F.array_join(F.transform(every, batch), ""),
        F.when(F.size(failed) > 0, F.concat(F.lit("\n## Batches without an answer\n"), F.array_join(F.transform(failed, lambda b: (b + 1).cast("string")), ", "), F.lit("\n"))).otherwise(F.lit("")),
    ).alias("report"))
