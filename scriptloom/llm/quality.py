"""Quality classifier by compression: two zstandard dictionaries, one of good and one of bad labelled text.

A text is compressed with either dictionary; the difference of the sizes, divided by the text's bytes, is
the evidence, which a logistic curve fitted on labelled rows turns into a score. Nothing but the text
takes part in a score.

Defined results: a null or empty text has no evidence and gets the curve's value at zero evidence, as bad as
the prior makes it; a very long text is compressed in blocks, whole; without labelled rows of both kinds every score
is the prior (0.5 without any label). Extra columns are left alone; the names that the operator adds replace
columns of the same name. A score at the threshold counts as good; repeated rows each get the same score; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptloom.llm.common import agreed, fold, labelled_sample, read, slices, tidy

#: Learning takes at most this many rows of each label, of at most this many characters each.
SAMPLE_ROWS, SAMPLE_CHARS = 1500, 20_000
#: All learning texts of a label share its dictionary of at most DICT_BYTES, each in PIECES spread over it; texts are compressed in blocks.
DICT_BYTES, PIECES, LEVEL, BLOCK = 1 << 19, 3, 6, 4 << 10
THRESHOLD = 0.3


@dataclass(frozen=True)
class QualityModel:
    """The two dictionaries as raw content, and the curve: score = 1 / (1 + exp(-(slope x + offset)))."""

    good: bytes
    bad: bytes
    slope: float
    offset: float

    def scorer(self):
        if not self.good or not self.bad:
            p = 1 / (1 + math.exp(-self.offset))
            return lambda texts: (np.full(len(texts), p), np.zeros(len(texts)))
        sides = [_compressor(x) for x in (self.good, self.bad)]

        def score(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
            x = np.array([_evidence(t, sides) for t in texts], dtype=np.float64)
            return 1 / (1 + np.exp(-np.clip(self.slope * x + self.offset, -60, 60))), x

        return score


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def _evidence(text: str | None, sides: list) -> float:
    """(bytes with the bad dictionary - bytes with the good one) / bytes of the text, over blocks of the whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return 0.0
    good = bad = 0
    for at in range(0, len(raw), BLOCK):
        block = raw[at : at + BLOCK]
        good += len(sides[0].compress(block))
        bad += len(sides[1].compress(block))
    return (bad - good) / len(raw)


def _content(texts: list[bytes]) -> bytes:
    """Raw dictionary content of all texts: short ones whole, of longer ones as many bytes each as fit, in pieces from start to end."""
    left, share = DICT_BYTES, 0
    for done, n in enumerate(sorted(map(len, texts))):
        share = left // (len(texts) - done) - 1  # less the line end
        left -= min(n, share) + 1
    return b"\n".join(_spread(t, share) for t in texts)


def _spread(text: bytes, size: int) -> bytes:
    if len(text) <= size:
        return text
    piece = size // PIECES
    step = (len(text) - piece) / (PIECES - 1)
    return b"".join(text[at : at + piece] for at in (round(i * step) for i in range(PIECES)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id") -> QualityModel:
    """Learn from labelled rows (label 1 good, 0 bad), a bounded sample of them (see SAMPLE_ROWS)."""
    known = agreed(labels.filter(F.col(label).isin(0, 1)), label, key)
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rows = labelled_sample(docs, known, sorted(n), SAMPLE_ROWS, SAMPLE_CHARS, text, key)
    by = {k: [r[2].encode("utf-8", "surrogatepass") for r in rows if r[0] == k] for k in (0, 1)}
    prior = math.log((n.get(1, 0) + 0.5) / (n.get(0, 0) + 0.5)) if n else 0.0
    if len(by[0]) < 4 or len(by[1]) < 4:
        return QualityModel(b"", b"", 0.0, prior)
    # the dictionaries learn from three of four rows, the curve from the others
    learn = {k: [t for i, t in enumerate(v) if i % 4] for k, v in by.items()}
    hold = {k: [t for i, t in enumerate(v) if i % 4 == 0] for k, v in by.items()}
    good, bad = _content(learn[1]), _content(learn[0])
    sides = [_compressor(good), _compressor(bad)]
    x = np.array([_evidence(t.decode("utf-8", "surrogatepass"), sides) for k in (0, 1) for t in hold[k]])
    y = np.array([k for k in (0, 1) for _ in hold[k]], dtype=np.float64)
    w = np.where(y == 1, n[1] / max(1, len(hold[1])), n[0] / max(1, len(hold[0])))
    slope, offset = _logistic(x, y, w / w.sum())
    return QualityModel(good, bad, slope, offset)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-4) -> tuple[float, float]:
    """Weighted logistic curve of one variable, by Newton steps on the scaled variable."""
    mean, scale = float(x.mean()), float(x.std()) or 1.0
    z = np.stack([(x - mean) / scale, np.ones_like(x)], axis=1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (w * (y - p)) - ridge * b
        h = (z * (w * p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        b += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0] / scale), float(b[1] - b[0] * mean / scale)


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, with ``score`` (0 to 1, higher: better) and ``evidence``."""
    kept = [c for c in docs.columns if c not in (text, "score", "evidence")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most DICT_BYTES each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for b in slices(batches, 0):
            s, x = score(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(s), pa.array(x)], names=[*kept, "score", "evidence"])

    rows = docs.select(F.col(text).cast("string"), *kept)
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("score", T.DoubleType()), T.StructField("evidence", T.DoubleType())])
    return rows.mapInArrow(tidy(run), schema)


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for b in slices(batches, at):
            yield b.filter(pa.array(score(b.column(at).to_pylist())[0] >= threshold))

    return docs.mapInArrow(tidy(run), docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold(5) == 0
    model = fit(docs, read(spark, sf_dir, "labels").select("doc_id", "quality").filter(~held))
    out = score_quality(docs.withColumn("held_out", held), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
