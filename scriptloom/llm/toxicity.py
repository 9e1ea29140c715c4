"""Toxicity: bags of subword embeddings, averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (hashed, with marks at its ends), a passage of ``WINDOW`` words the
mean of its words, and a softmax over two classes reads the passage. A misspelling or inflection that learning never saw shares
most of its n-grams with what it did see. A label belongs to a whole text, while a few words may earn it; so learning
goes in rounds over the passage of each text that looks most toxic so far (at first by how unevenly words are spread over the labels)
and others of clean texts, and a text's evidence is its most toxic passage, over the whole text. A logistic curve on texts that the vectors did not
learn from turns the evidence into a score.

Defined results: null, empty and blank texts have the evidence of a middling clean text; without labels of both kinds every
score is the prior, 0.5 without any; the added columns replace columns of the same name, others stay. Very long texts are read whole; a score at the threshold counts as toxic; repeated rows each get the same score; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptloom.llm.common import agreed, fold, labelled_sample, read, slices, tidy
from scriptloom.llm.quality import _logistic

#: Learning takes at most this many texts of each label, of at most this many characters each.
SAMPLE_ROWS, SAMPLE_CHARS = 1500, 20_000
BUCKETS, DIM, SIZES = 1 << 17, 8, (3, 4, 5, 6)
WINDOW, ROUNDS, EPOCHS, BATCH, RATE = 2, 4, 3, 256, 0.3
THRESHOLD = 0.7
#: Words whose evidence a worker remembers, about 200 bytes each.
MEMO = 200_000


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams of all words one after the other, where each word's begin)."""
    marked = "".join(f"\x02{w}\x03" for w in words)
    code = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    ends = np.repeat(np.cumsum(size), size)
    word = np.repeat(np.arange(len(words)), size)
    ids, owner = [], []
    place = np.arange(len(code))
    h = np.zeros(len(code), dtype=np.uint64)
    prime, mix = np.uint64(1099511628211), np.uint64(0x9E3779B97F4A7C15)
    for n in range(1, SIZES[-1] + 1):
        h = h[: len(code) - n + 1] * prime + code[n - 1 :] + np.uint64(1)
        if n in SIZES:
            inside = place[: len(h)] + n <= ends[: len(h)]
            hashed = ((h[inside] + np.uint64(n)) * mix) >> np.uint64(64 - int(math.log2(BUCKETS)))
            ids.append(hashed.astype(np.int64))
            owner.append(word[: len(h)][inside])
    owner, ids = np.concatenate(owner), np.concatenate(ids)
    order = np.argsort(owner, kind="stable")
    return ids[order], np.searchsorted(owner[order], np.arange(len(words)))


def _split(text: str | None) -> list[str]:
    return (text or "").lower().split()


@dataclass(frozen=True)
class ToxicityModel:
    """weight: each n-gram bucket's evidence (its vector times the difference of the softmax rows); then the curve."""

    weight: np.ndarray | None
    slope: float
    offset: float
    blank: float

    def scorer(self):
        memo: dict[str, float] = {}

        def score(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
            if self.weight is None:
                x = np.zeros(len(texts))
            else:
                words = [_split(t) for t in texts]
                if len(memo) > MEMO:
                    memo.clear()
                new = list({w for own in words for w in own if w not in memo})
                for at in range(0, len(new), 20_000):
                    part = new[at : at + 20_000]
                    memo.update(zip(part, _word_evidence(self.weight, *grams(part)).tolist(), strict=True))
                x = np.array([_top(np.fromiter(map(memo.__getitem__, w), dtype=np.float64, count=len(w)), self.blank)[0] for w in words])
            return 1 / (1 + np.exp(-np.clip(self.slope * x + self.offset, -60, 60))), x

        return score


def _word_evidence(weight: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weight[ids], starts) / np.diff(starts, append=len(ids))


def _top(evidence: np.ndarray, blank: float) -> tuple[float, int]:
    """(mean, place) of the passage with the most evidence."""
    n = len(evidence)
    if n == 0:
        return blank, 0
    width = min(WINDOW, n)
    total = np.concatenate([[0.0], np.cumsum(evidence)])
    means = (total[width:] - total[:-width]) / width
    at = int(means.argmax())
    return float(means[at]), at


def train(texts: list[list[str]], labels: np.ndarray, seed: int = 7) -> np.ndarray:
    """The evidence of each n-gram bucket, from vectors and softmax trained jointly."""
    rng = np.random.default_rng(seed)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
    ids, starts = grams(list(vocabulary))
    lengths = np.diff(starts, append=len(ids))
    docs = [np.array([vocabulary[w] for w in t]) for t in texts]
    # first guess: how unevenly a word is spread over the labels
    held = {k: Counter(w for d, y in zip(docs, labels, strict=True) if y == k for w in set(d.tolist())) for k in (0, 1)}
    n = [max(1, int((labels == k).sum())) for k in (0, 1)]
    evidence = np.array([math.log((held[1][i] + 0.5) / (n[1] + 1)) - math.log((held[0][i] + 0.5) / (n[0] + 1)) for i in range(len(vocabulary))])
    vectors, softmax, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, 2)), np.zeros(2)
    past_v, past_s, past_b = np.full(BUCKETS, 1e-6), np.full((DIM, 2), 1e-6), np.full(2, 1e-6)
    for _ in range(ROUNDS):
        bags, y = [], []
        for d, label in zip(docs, labels, strict=True):
            width = min(WINDOW, len(d))
            at = _top(evidence[d], 0.0)[1]
            bags.append(d[at : at + width])
            y.append(label)
            if label == 0:  # of clean texts any passage is clean
                for at in rng.integers(0, len(d) - width + 1, 3):
                    bags.append(d[at : at + width])
                    y.append(0)
        y = np.array(y)
        share = np.array([1.0, 1.0]) * len(y) / (2 * np.maximum(1, np.bincount(y, minlength=2)))
        for _ in range(EPOCHS):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                words = np.concatenate([bags[i] for i in pick])
                bag = np.repeat(np.arange(len(pick)), [len(bags[i]) for i in pick])
                count = np.bincount(bag)
                flat = np.concatenate([ids[starts[w] : starts[w] + lengths[w]] for w in words])
                owner = np.repeat(bag, lengths[words])
                part = np.repeat(1 / (lengths[words] * count[bag]), lengths[words])
                firsts = np.searchsorted(owner, np.arange(len(pick)))
                mean = np.add.reduceat(vectors[flat] * part[:, None], firsts, axis=0)
                logit = mean @ softmax + bias
                p = np.exp(logit - logit.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(pick)), y[pick]] -= 1
                g = p * share[y[pick]][:, None]  # per passage, so that rare n-grams move at once
                back = g @ softmax.T
                touched, inverse = np.unique(flat, return_inverse=True)
                step = np.stack([np.bincount(inverse, weights=part * back[owner, j], minlength=len(touched)) for j in range(DIM)], axis=1)
                past_v[touched] += (step * step).mean(axis=1)
                vectors[touched] -= RATE * step / np.sqrt(past_v[touched])[:, None]
                gs, gb = mean.T @ g / len(pick), g.mean(axis=0)
                past_s += gs * gs
                past_b += gb * gb
                softmax -= RATE * gs / np.sqrt(past_s)
                bias -= RATE * gb / np.sqrt(past_b)
        weight = vectors @ (softmax[:, 1] - softmax[:, 0])
        evidence = _word_evidence(weight, ids, starts)
    return weight


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id") -> ToxicityModel:
    """Learn from labelled rows (1 toxic, 0 clean), a bounded sample of them (see SAMPLE_ROWS)."""
    known = agreed(labels.filter(F.col(label).isin(0, 1)), label, key)
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rows = [(r[0], w) for r in labelled_sample(docs, known, sorted(n), SAMPLE_ROWS, SAMPLE_CHARS, text, key) if (w := _split(r[2]))]
    prior = math.log((n.get(1, 0) + 0.5) / (n.get(0, 0) + 0.5)) if n else 0.0
    if min(sum(r[0] == k for r in rows) for k in (0, 1)) < 4:
        return ToxicityModel(None, 0.0, prior, 0.0)
    learn, hold = [r for i, r in enumerate(rows) if i % 4], [r for i, r in enumerate(rows) if i % 4 == 0]
    weight = train([w for _, w in learn], np.array([k for k, _ in learn]))
    first = ToxicityModel(weight, 1.0, 0.0, 0.0)
    x = first.scorer()([" ".join(w) for _, w in hold])[1]
    y = np.array([k for k, _ in hold], dtype=np.float64)
    w = np.where(y == 1, n[1] / max(1.0, y.sum()), n[0] / max(1.0, (1 - y).sum()))
    slope, offset = _logistic(x, y, w / w.sum())
    return ToxicityModel(weight, slope, offset, float(np.median(x[y == 0])) if (y == 0).any() else 0.0)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, with ``score`` (0 to 1, higher: more toxic) and ``evidence``."""
    kept = [c for c in docs.columns if c not in (text, "score", "evidence")]
    rows = docs.select(F.col(text).cast("string"), *kept)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number a bucket: 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for b in slices(batches, 0, 2 << 20):
            s, x = score(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(s), pa.array(x)], names=[*kept, "score", "evidence"])

    schema = T.StructType([*rows.schema.fields[1:], T.StructField("score", T.DoubleType()), T.StructField("evidence", T.DoubleType())])
    return rows.mapInArrow(tidy(run), schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold(3) == 1
    model = fit(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held))
    out = score_toxicity(docs.withColumn("held_out", held), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
