"""Findings about texts: deduplication, validity, routing, grounding, and conflict-free patching."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptloom.functions import similarity
from scriptloom.functions.text import words
from scriptloom.operators import grounding
from scriptloom.sources.tables import by_key, settled

#: Kinds of errors, and how sure a finding is.
ERROR_TYPES = ("spelling", "homophone", "proper_noun", "word_boundary", "capitalization", "repetition", "punctuation", "incomplete", "grammar")
APPLY, REVIEW = ("high",), ("medium",)
CONTEXT_MIN, CONTEXT_MAX, UNIQUE_WORDS = 5, 30, 7
FUZZY_PATCH, FUZZY_SEQUENTIAL, SHORT, HALLUCINATION = 0.95, 0.90, 20, 0.85


def first_findings(findings: DataFrame, doc: str = "doc_id", order: str = "ordinal") -> DataFrame:
    """Of findings with the same original and correction in a document, the first."""
    w = W.partitionBy(doc, "original_text", "suggested_correction").orderBy(order)
    return findings.withColumn("n_", F.row_number().over(w)).filter("n_ = 1").drop("n_")


def fault(error_types=ERROR_TYPES) -> Column:
    """Why a finding is invalid: the first fault, null if it has none."""
    needed = ("error_type", "original_text", "suggested_correction", "confidence")
    out = F.when(F.greatest(*(F.col(c).isNull().cast("int") for c in needed)) == 1, "missing field")
    n = F.size(words(F.col("original_text")))
    return (
        out.when(~F.col("error_type").isin(*error_types), "unknown error type").when(F.col("original_text") == F.col("suggested_correction"), "identical")
        .when(n < CONTEXT_MIN, "context too short").when(n > CONTEXT_MAX, "context too long")
    )


def route() -> Column:
    level = F.lower("confidence")
    return F.when(level.isin(*APPLY), "apply").when(level.isin(*REVIEW), "review").otherwise("drop")


def grounded(findings: DataFrame, docs: DataFrame, doc: str = "doc_id", text: str = "text", accept: float = HALLUCINATION) -> DataFrame:
    """Findings whose original occurs in its document, with ``hallucination_score``; the findings of a document meet its text once."""
    got = grounding.match(findings.filter(F.coalesce(F.col("original_text"), F.lit("")) != ""), docs, {"hallucination_score": "original_text"}, doc, text, raw=True)
    return got.filter(F.col("hallucination_score") >= accept)


# -- patching: rows of (text, findings) in, (text, applied, skipped) out; places are found per row, no shuffle

Finding = tuple[str, str]


def _occurrences(text: str, part: str) -> list[int]:
    out, at = [], text.find(part) if part else -1
    while at >= 0:
        out.append(at)
        at = text.find(part, at + len(part))
    return out


def patch(text: str, findings: list[Finding]) -> tuple[str, int, list[str]]:
    """Apply (original, correction) pairs at their places, from the end of the text; of overlapping places the later one stays.

    An original that occurs once is replaced; one that occurs more often only with UNIQUE_WORDS words or more, everywhere; one that
    doesn't occur, at its most similar place from FUZZY_PATCH on. The text is normalised once for all that have to be looked for so, and put together once.
    """
    places, skipped, known = [], [], None
    for original, correction in findings:
        at = _occurrences(text, original)
        if len(at) == 1 or (at and len(original.split()) >= UNIQUE_WORDS):
            places += [(a, a + len(original), correction) for a in at]
        elif at:
            skipped.append(f"ambiguous: {original[:20]!r} occurs {len(at)} times")
        else:
            known = known or similarity.Haystack(text)
            start, end, ratio = known.find(original, FUZZY_PATCH)
            if start is not None:
                places.append((start, end, correction))
            else:
                skipped.append(f"not found: {original[:20]!r} ({ratio:.2f})")
    parts, border, applied = [], len(text), 0
    for start, end, correction in sorted(places, key=lambda p: -p[0]):
        if end > border:
            skipped.append(f"overlap at {start}-{end}")
            continue
        parts += [text[end:border], correction]
        border, applied = start, applied + 1
    return "".join(reversed([*parts, text[:border]])), applied, skipped


def patch_in_turn(text: str, findings: list[Finding]) -> tuple[str, int, list[str]]:
    """The older rule: one finding after the other on the text as it is by then, which is normalised anew only when it has changed."""
    applied, skipped, known = 0, [], None
    for original, correction in findings:
        n = len(_occurrences(text, original))
        if n == 0:
            known = known if known and known.raw is text else similarity.Haystack(text)
            start, end, _ = known.find(original, FUZZY_SEQUENTIAL)
            if start is None:
                skipped.append(f"not found: {original[:20]!r}")
                continue
            text = text[:start] + correction + text[end:]
        elif n > 1 and len(original) < SHORT:
            skipped.append(f"ambiguous: {original[:20]!r}")
            continue
        else:
            text = text.replace(original, correction)
        applied += 1
    return text, applied, skipped


PATCHED = "text string, applied int, skipped array<string>"


def patched(docs: DataFrame, findings: DataFrame, doc: str = "doc_id", text: str = "text", order: str = "ordinal", rule: Callable = patch) -> DataFrame:
    """``docs`` with a struct ``patched``; the findings of a document travel with it as one array."""
    lists = findings.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(order, "original_text", "suggested_correction"))).alias("f_"))
    both = by_key(docs, doc).join(lists, doc, "left")
    pairs = F.transform(F.coalesce("f_", F.array().cast(lists.schema["f_"].dataType)), lambda x: F.struct(x["original_text"].alias("a"), x["suggested_correction"].alias("b")))

    @F.pandas_udf(PATCHED)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, lists_ in batches:
            got = [rule(t or "", [(x["a"], x["b"]) for x in f if x["a"]]) for t, f in zip(texts, lists_, strict=True)]
            yield pd.DataFrame({"text": [g[0] for g in got], "applied": [g[1] for g in got], "skipped": [g[2] for g in got]})

    return both.withColumn("patched", run(text, pairs)).drop("f_")


#: Why the rounds of a document end: nothing left to apply, rounds that improve too little, or as many rounds as there are.
CONVERGED, STALLED, SPENT = "converged", "stalled", "rounds"


def until_settled(
    docs: DataFrame, find: Callable[[DataFrame], DataFrame], rounds: int = 5, stall: float = 0.2, stalled_rounds: int = 2, doc: str = "doc_id", text: str = "text",
    settle: Callable[[DataFrame], DataFrame] = settled, spent: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Find, ground and apply, each document by itself, until it has nothing to apply, ``stalled_rounds`` rounds in a row improve less than ``stall``, or ``rounds`` are over.

    ``find`` gives the findings of the texts that are still in work, and ``spent`` their tokens (doc, tokens_in, tokens_out) if they are counted. A round reads only those
    texts; a document that has ended leaves with the text that it has. Only findings to apply count for the end. Returns the texts, and a row of numbers for each document and round:
    findings, to_apply, to_review, applied, skipped, tokens_in, tokens_out, seconds (of the whole round) and ``ended`` in its last. ``settle`` cuts the lineage of each round:
    by default a table in the shared folder of ``spark.checkpoint.dir``, which has to be set on a cluster. Rows of documents need different keys.
    """
    work = docs.withColumns({"before_": F.lit(None).cast("long"), "stalled_": F.lit(0)})
    done, history = [], []
    for n in range(1, rounds + 1):
        began = time.monotonic()
        found = settle(first_findings(grounded(find(work.select(*docs.columns)), work, doc, text), doc).withColumn("route", route()))
        of = lambda r: F.count_if(F.col("route") == r)
        counts = found.groupBy(doc).agg(F.count("*").alias("findings_"), of("apply").alias("apply_"), of("review").alias("review_"))
        step = work.join(counts, doc, "left").na.fill(0, ["findings_", "apply_", "review_"])
        gain = F.when(F.col("before_").isNull(), 1.0).otherwise((F.col("before_") - F.col("apply_")) / F.col("before_"))
        step = step.withColumn("stalled_", F.when(gain < stall, F.col("stalled_") + 1).otherwise(0))
        ended = F.when(F.col("apply_") == 0, CONVERGED).when(F.col("stalled_") >= stalled_rounds, STALLED)
        step = step.withColumn("ended_", ended)
        # ended documents have nothing applied; the others' findings meet their texts
        use = found.filter("route = 'apply'").join(step.filter("ended_ IS NULL").select(doc), doc, "left_semi")
        step = settle(patched(step, use, doc, text))
        last = F.coalesce("ended_", F.lit(SPENT)) if n == rounds else F.col("ended_")
        row = step.select(doc, F.lit(n).alias("round"), F.col("findings_").alias("findings"), F.col("apply_").alias("to_apply"), F.col("review_").alias("to_review"),
                          F.col("patched.applied").alias("applied"), F.size("patched.skipped").alias("skipped"), last.alias("ended"))
        if spent:
            row = row.join(spent(work.select(*docs.columns)), doc, "left")
        else:
            row = row.withColumns({"tokens_in": F.lit(None).cast("long"), "tokens_out": F.lit(None).cast("long")})
        history.append(settle(row.withColumn("seconds", F.lit(round(time.monotonic() - began, 3)))))
        step = step.withColumn(text, F.when(F.col("ended_").isNull() & F.col(text).isNotNull(), F.col("patched.text")).otherwise(F.col(text)))
        done.append(step.filter(F.lit(n == rounds) | F.col("ended_").isNotNull()).select(*docs.columns))
        work = step.filter("ended_ IS NULL").select(*docs.columns, F.col("apply_").alias("before_"), "stalled_")
        if n == rounds or work.isEmpty():
            break
    return reduce(DataFrame.unionByName, done), reduce(DataFrame.unionByName, history)


def round_totals(history: DataFrame) -> DataFrame:
    """round, documents, findings, applied, skipped, tokens and seconds over all documents, and how many ended for each reason."""
    ends = {e: F.count_if(F.col("ended") == e) for e in (CONVERGED, STALLED, SPENT)}
    sums = {c: F.sum(c) for c in ("findings", "applied", "skipped", "tokens_in", "tokens_out")}
    return history.groupBy("round").agg(F.count("*").alias("documents"), *(c.alias(n) for n, c in (sums | ends).items()), F.max("seconds").alias("seconds"))


def fixed_rounds(docs: DataFrame, find: Callable[[DataFrame], DataFrame], rounds: int = 2, doc: str = "doc_id", text: str = "text", settle: Callable[[DataFrame], DataFrame] = settled) -> DataFrame:
    """The older loop: ``rounds`` rounds of finding and patching in turn, each text kept as a version (0 is the text given). See ``until_settled`` for ``settle``."""
    now, versions = docs, docs.withColumn("version", F.lit(0))
    for n in range(1, rounds + 1):
        new = patched(now, first_findings(find(now), doc), doc, text, rule=patch_in_turn)
        now = settle(new.withColumn(text, F.col("patched.text")).drop("patched"))
        versions = versions.unionByName(now.withColumn("version", F.lit(n)))
    return versions


def change_log(docs: DataFrame, findings: DataFrame, doc: str = "doc_id", order: str = "ordinal") -> DataFrame:
    """doc, changes, review: what was applied and what a person has to look at, as Markdown lists in order."""
    line = F.concat(F.lit("- "), F.coalesce("original_text", F.lit("")), F.lit(" -> "), F.coalesce("suggested_correction", F.lit("")))
    rows = findings.select(doc, order, route().alias("r_"), line.alias("l_"))
    lines = lambda r: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("r_") == r, F.struct(order, "l_")))), lambda x: x["l_"]), "\n")
    return docs.select(doc).join(rows.groupBy(doc).agg(lines("apply").alias("changes"), lines("review").alias("review")), doc, "left").na.fill("", ["changes", "review"])
