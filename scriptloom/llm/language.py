"""Language identification by prediction by partial matching over bytes.

For each language the byte contexts of up to ``MAX_ORDER`` bytes are counted on labelled texts. With the statistics frozen, a byte
costs log2((n + t) / c) bits in the longest known context that has seen it (c of n times, t different bytes there); each
longer known context that has not costs its escape, log2((n + t) / t); a byte that no context has seen costs 8
bits at the end. A text's exact code length is the sum over all its bytes; the language with the shortest code is predicted.
A gram's cost for every language is worked out once, so that scoring is one look-up for most bytes.

Defined results: null and texts without a letter are ``und`` with score 0; so is every text if nothing could be learned; ties go to the
first language in order; long texts are scored whole; the added columns replace columns of the same name, others stay.
An empty table gives no rows, repeated rows each get the same answer; of languages with equal code lengths the first by name wins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptloom.llm.common import agreed, fold, ranked_sample, read, slices, tidy

#: Learning takes at most this many texts a language, of at most this many characters each.
SAMPLE_ROWS, SAMPLE_CHARS = 500, 20_000
MAX_ORDER = 3
UNKNOWN_BITS = 8.0
_LETTER = regex.compile(r"\p{L}")
_PAD = b"\n" * MAX_ORDER


class _Lookup:
    """Row numbers of sorted distinct 32-bit keys: open addressing, whole arrays at a time."""

    def __init__(self, keys: np.ndarray):
        bits = max(8, int(math.ceil(math.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = np.uint32(32 - bits), (1 << bits) - 1
        self.key = np.zeros(1 << bits, dtype=np.uint32)
        self.row = np.full(1 << bits, -1, dtype=np.int32)
        left, slot = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.row[slot] < 0
            first = np.zeros(len(slot), dtype=bool)
            first[np.unique(np.where(free, slot, -1), return_index=True)[1]] = True
            put = first & free
            self.key[slot[put]], self.row[slot[put]] = keys[left[put]], left[put]
            left, slot = left[~put], (slot[~put] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435769) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        slot = self._home(keys)
        row = self.row[slot]
        todo = np.flatnonzero((self.key[slot] != keys) & (row >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            row[todo] = self.row[slot[todo]]
            todo = todo[(self.key[slot[todo]] != keys[todo]) & (row[todo] >= 0)]
        return row


@dataclass
class LanguageModel:
    languages: list[str]
    grams: list[np.ndarray] = field(default_factory=list)  # by order: keys of context and byte
    bits: list[np.ndarray] = field(default_factory=list)  # their cost for each language
    contexts: list[np.ndarray] = field(default_factory=list)
    escapes: list[np.ndarray] = field(default_factory=list)

    def ready(self) -> LanguageModel:
        self._grams = [_Lookup(k) for k in self.grams]
        self._contexts = [_Lookup(k) for k in self.contexts]
        return self

    def code_lengths(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of each text for each language. raw: the texts' bytes, each text after MAX_ORDER pad bytes; starts: where pads begin."""
        keys = _keys(raw)
        cost = np.empty((len(raw), len(self.languages)))
        todo, above = None, None
        for k in range(MAX_ORDER, -1, -1):
            key = keys[k] if todo is None else keys[k][todo]
            row = self._grams[k].find(key)
            known = row >= 0
            got = self.bits[k][row]
            if todo is None:
                cost[:] = got
                todo, above = np.flatnonzero(~known), 0.0
            else:
                cost[todo[known]] = above[known] + got[known]
                todo, above = todo[~known], above[~known]
            if not len(todo):
                break
            at = self._contexts[k].find(_context(keys, k, todo))
            above = above + np.where((at >= 0)[:, None], self.escapes[k][at], 0.0)
        if len(todo):
            cost[todo] = above + UNKNOWN_BITS
        for j in range(MAX_ORDER):
            cost[starts + j] = 0.0
        return np.add.reduceat(cost, starts, axis=0)


def _keys(raw: np.ndarray) -> list[np.ndarray]:
    """keys[k][i]: the byte i and the k bytes before it. (The first bytes of ``raw`` are pads.)"""
    keys = [raw.astype(np.uint32)]
    for k in range(1, MAX_ORDER + 1):
        key = keys[-1].copy()
        key[k:] |= keys[0][:-k] << np.uint32(8 * k)
        keys.append(key)
    return keys


def _context(keys: list[np.ndarray], k: int, at: np.ndarray) -> np.ndarray:
    """The k bytes before each place (0 for order 0)."""
    return keys[k][at] >> np.uint32(8)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    whole = b"".join(_PAD + t for t in texts)
    sizes = np.array([len(t) + MAX_ORDER for t in texts])
    return np.frombuffer(whole, dtype=np.uint8), np.cumsum(sizes) - sizes


def learn(texts: dict[str, list[bytes]]) -> LanguageModel:
    """Frozen statistics of the texts of each language."""
    model = LanguageModel(sorted(texts))
    counts = []  # by language and order: keys, counts
    for lang in model.languages:
        raw, starts = _joined(texts[lang])
        own = np.ones(len(raw), dtype=bool)
        for j in range(MAX_ORDER):
            own[starts + j] = False
        counts.append([np.unique(k[own], return_counts=True) for k in _keys(raw)])
    for k in range(MAX_ORDER + 1):
        grams = np.unique(np.concatenate([c[k][0] for c in counts]))
        contexts = np.unique(grams >> np.uint32(8))
        bits, escapes = np.empty((len(grams), len(counts))), np.zeros((len(contexts), len(counts)))
        if k:
            # the cost one order below, of every gram without its first byte
            low = model.bits[k - 1][np.searchsorted(model.grams[k - 1], grams & np.uint32((1 << (8 * k)) - 1))]
        else:
            low = np.full((len(grams), len(counts)), UNKNOWN_BITS)
        home = np.searchsorted(contexts, grams >> np.uint32(8))
        for j, c in enumerate(counts):
            key, n = c[k]
            at = np.searchsorted(contexts, key >> np.uint32(8))
            total = np.bincount(at, weights=n, minlength=len(contexts))
            kinds = np.bincount(at, minlength=len(contexts))
            seen = total > 0
            escapes[seen, j] = np.log2((total[seen] + kinds[seen]) / kinds[seen])
            bits[:, j] = low[:, j] + escapes[home, j]
            place = np.searchsorted(grams, key)
            bits[place, j] = np.log2((total[at] + kinds[at]) / n)
        model.grams.append(grams)
        model.bits.append(bits)
        model.contexts.append(contexts)
        model.escapes.append(escapes)
    return model


def predict(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """(languages, scores) of the texts; the score is the share of 2^(-bits / sqrt(bytes)) that the language has."""
    scored = [i for i, t in enumerate(texts) if t and model.languages and _LETTER.search(t)]
    langs, scores = ["und"] * len(texts), np.zeros(len(texts))
    if scored:
        raw, starts = _joined([texts[i].encode("utf-8", "surrogatepass") for i in scored])
        bits = model.code_lengths(raw, starts)
        size = np.diff(starts, append=len(raw)) - MAX_ORDER
        part = np.exp2(-(bits - bits.min(axis=1, keepdims=True)) / np.sqrt(size)[:, None])
        best = bits.argmin(axis=1)
        scores[scored] = 1 / part.sum(axis=1)
        for i, b in zip(scored, best, strict=True):
            langs[i] = model.languages[b]
    return langs, scores


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id") -> LanguageModel:
    """Learn from the texts with a language, a bounded sample of them (see SAMPLE_ROWS)."""
    rows = ranked_sample(docs, agreed(docs.select(key, lang), lang, key), SAMPLE_ROWS, SAMPLE_CHARS, text, key)
    texts: dict[str, list[bytes]] = {}
    for label, _, body in rows:
        texts.setdefault(label, []).append(body.encode("utf-8", "surrogatepass"))
    return learn(texts) if texts else LanguageModel([])


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, with ``lang_pred`` and ``score``."""
    kept = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    rows = docs.select(F.col(text).cast("string"), *kept)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of the size of the sample's contexts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = shared.value.ready()
        for b in slices(batches, 0, 1 << 20):
            langs, scores = predict(ready, b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(langs, type=pa.string()), pa.array(scores)], names=[*kept, "lang_pred", "score"])

    schema = T.StructType([*rows.schema.fields[1:], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(tidy(run), schema)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold(3) == 1
    model = fit(docs.filter(~held))
    return identify(docs.select("doc_id", "text", held.alias("held_out")), model)
