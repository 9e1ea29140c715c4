"""A language model as an operator: prompts in, answers out, behind a backend that callers replace.

The default backend needs no network and answers the same at every run. Answers are checked level by level, and retried within the
backend; prompts of one document stay together, so that a backend may reuse what it knows of the document.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.functions import text as X


class Backend(Protocol):
    def complete(self, prompts: list[str]) -> list[dict]:
        """For each prompt: text, stop_reason, model, input_tokens, output_tokens."""


class OfflineBackend:
    """Echoes the first words of the prompt's last paragraph."""

    def complete(self, prompts: list[str]) -> list[dict]:
        out = []
        for p in prompts:
            words = p.strip().split("\n\n")[-1].split()[:50]
            out.append({"text": " ".join(words), "stop_reason": "end_turn", "model": "offline", "input_tokens": len(p) // 4, "output_tokens": sum(map(len, words)) // 4})
        return out


class EchoBackend(OfflineBackend):
    """Gives the prompt's last paragraph back, line by line."""

    def complete(self, prompts: list[str]) -> list[dict]:
        return [{**answer, "text": p.strip().split("\n\n")[-1]} for answer, p in zip(super().complete(prompts), prompts, strict=True)]


class Retrying:
    """A backend around another: waits twice as long after each failure, and allows half as much time again after each that ran out of it.

    The inner backend's ``timeout``, if it has one, is what grows; it is given back its first value afterwards.
    """

    def __init__(self, inner: Backend, tries: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep, growth: float = 1.5):
        self.inner, self.tries, self.wait, self.sleep, self.growth = inner, tries, wait, sleep, growth

    def complete(self, prompts: list[str]) -> list[dict]:
        first = getattr(self.inner, "timeout", None)
        try:
            for n in range(self.tries):
                try:
                    return self.inner.complete(prompts)
                except (TimeoutError, ConnectionError) as failure:
                    if n + 1 == self.tries:
                        raise
                    if first is not None and isinstance(failure, TimeoutError):
                        self.inner.timeout *= self.growth
                    self.sleep(self.wait * 2**n)
        finally:
            if first is not None:
                self.inner.timeout = first
        return []


ANSWER = "text string, stop_reason string, model string, input_tokens long, output_tokens long"
STORED = "hash string, model string, answer struct<text: string, stop_reason: string, model: string, input_tokens: bigint, output_tokens: bigint>"


def completed(rows: DataFrame, prompt: str, backend: Backend | None = None, key: str | None = None, batch: int = 16) -> DataFrame:
    """``rows`` with a struct ``answer``; with ``key`` the prompts of one document are sorted next to each other."""
    backend = backend or OfflineBackend()
    if key:
        rows = rows.repartition(key).sortWithinPartitions(key)

    @F.pandas_udf(ANSWER)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for prompts in batches:
            got = []
            for at in range(0, len(prompts), batch):
                got += backend.complete([p or "" for p in prompts[at : at + batch]])
            yield pd.DataFrame(got, columns=["text", "stop_reason", "model", "input_tokens", "output_tokens"])

    return rows.withColumn("answer", run(prompt))


def answered_once(rows: DataFrame, prompt: str, store: str, model: str = "offline", backend: Backend | None = None, batch: int = 16, parts: int = 1) -> DataFrame:
    """``rows`` with the struct ``answer``, from the lasting table of answers at ``store`` (a folder that all executors share): each prompt is asked once a model, ever.

    Prompts are known by a hash of model and text. Only those without an answer are asked, equal ones once, in ``parts`` that are written one after the other: what is written is
    never asked again, by whatever run, and a task that is lost takes none but its own answers with it. A null prompt counts as the empty one.
    """
    spark = rows.sparkSession
    key = F.sha2(F.concat(F.lit(f"{model}\x00"), F.coalesce(F.col(prompt), F.lit(""))), 256)
    wanted = rows.select(key.alias("hash_"), F.coalesce(F.col(prompt), F.lit("")).alias("prompt_")).dropDuplicates(["hash_"])
    spark.createDataFrame([], STORED).write.mode("append").parquet(store)  # so that there is a table
    known = lambda: spark.read.parquet(store)
    for part in range(parts):
        some = wanted.filter(F.pmod(F.xxhash64("hash_"), F.lit(parts)) == part) if parts > 1 else wanted
        left = some.join(known().select(F.col("hash").alias("hash_")), "hash_", "left_anti")
        completed(left, "prompt_", backend, batch=batch).select(F.col("hash_").alias("hash"), F.lit(model).alias("model"), "answer").write.mode("append").parquet(store)
    return rows.withColumn("hash_", key).join(known().select(F.col("hash").alias("hash_"), "answer").dropDuplicates(["hash_"]), "hash_", "left").drop("hash_")


def answer_fault(answer: Column, least_chars: int = 1, models: Column | None = None, kind: Column | None = None, role: Column | None = None, least_words: int = 0) -> Column:
    """The first level at which an answer is invalid, null if it is valid: its kind and role (where given), how it ended, content, text, usage, model."""
    text, stop = answer["text"], answer["stop_reason"]
    out = F.when(answer.isNull(), "no answer")
    if kind is not None:
        out = out.when(kind.isNull() | (kind != "message"), "no message")
    if role is not None:
        out = out.when(role.isNull() | (role != "assistant"), "other role")
    out = (
        out.when(stop.isNull(), "no stop reason").when(stop == "max_tokens", "cut off").when(~stop.isin("end_turn", "stop_sequence"), "stopped")
        .when(text.isNull() | (F.trim(text) == ""), "no text").when(F.length(text) < least_chars, "too short")
        .when(F.size(X.words(text)) < least_words, "too few words").when(answer["output_tokens"].isNull(), "no usage")
    )
    return out.when(~F.exists(models, lambda m: answer["model"].startswith(m)), "other model") if models is not None else out


def verdicts(items: DataFrame, answers: DataFrame, key: str, ordinal: str = "ordinal", answer: str = "answer") -> DataFrame:
    """``items`` with ``verdict``: the YES or NO of the line at their place in the document's answer, false where it is missing."""
    lines = answers.select(key, F.posexplode(F.filter(F.split(answer, "\n"), lambda x: F.trim(x) != "")).alias(ordinal, "line_"))
    return items.join(lines, [key, ordinal], "left").withColumn("verdict", F.coalesce(F.upper("line_").rlike(r"\bYES\b"), F.lit(False))).drop("line_")


def batches_of(rows: DataFrame, number: str = "number", size: int = 5) -> DataFrame:
    return rows.withColumn("batch", F.floor((F.col(number) - 1) / size).cast("int"))


def until_valid(rows: DataFrame, ask: Callable[[DataFrame, int], DataFrame], valid: Column, tries: int = 3) -> DataFrame:
    """Ask again for the rows whose answer isn't valid, ``tries`` times at most; the last answer stays, with ``accepted``.

    Each round is a checkpoint, so the session needs a checkpoint folder that all executors share.
    """
    done, left = None, rows
    for n in range(tries):
        asked = ask(left, n).withColumn("accepted", F.coalesce(valid, F.lit(False))).checkpoint()
        keep = asked if n + 1 == tries else asked.filter("accepted")
        done = keep if done is None else done.unionByName(keep)
        if n + 1 == tries or asked.filter("NOT accepted").isEmpty():
            break
        left = asked.filter("NOT accepted").select(*rows.columns)
    return done
