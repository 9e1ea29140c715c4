"""Substring deduplication: repeated windows of ``WINDOW`` words, by Rabin-Karp hashes counted in Spark.

A word is a run without ASCII white space, taken as it is. A window of a document is repeated when its words also start
somewhere in a document with a smaller key; every word that a repeated window covers goes. Windows are judged on the input.

1. Of texts that are equal as a whole (told by MD5) only the one with the smallest key goes on: it has the windows of all of them, and the others
   are removed whole if they have a window. Each window is represented by the least hash among its sub-windows of ``SEED`` words. Equal windows have equal
   representatives, and neighbours mostly share theirs, so a fourteenth of the rows tells which windows can't be
   repeated: those whose representative only one document has. Every window of every document takes part.
2. The Rabin-Karp hashes (96 bits) of the windows that are left are counted: the smallest key of each, aggregated
   before the shuffle; windows of larger keys are repeated. Windows of equal hashes count as equal without a look at their words: of a
   trillion windows some pair collides with a probability of 6e-6. Windows that very many documents share stay where they lie, and what is known of them goes there.
3. Overlapping and touching repeated windows of a document merge into maximal intervals, whose words go.

Defined results: null text has no words, an empty table no rows; very long texts are read whole, one at a time; texts shorter than a window stay; rows with a null key stay and are no reason for others to
go; rows with the same key don't make each other go; kept words are joined by one space; extra columns stay, and the
added ones replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptloom.llm.common import join_by_key, read, settle, slices, text_of, tidy

WINDOW, SEED = 50, 25
#: Keys, or ends of intervals, up to this many are broadcast (8 bytes each); beyond, both sides are shuffled.
BROADCAST_KEYS = 200_000
_BASES = (np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F | 1))
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Word hashes that a worker remembers, about 200 bytes each.
MEMO = 150_000


class _Words(dict):
    """Hash of each word, memoised."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Roller:
    """Rolling hashes over the words of many texts, whole arrays at a time."""

    def __init__(self):
        self.words = _Words()
        self.powers = [(np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)) for _ in _BASES]

    def load(self, texts: list[str]) -> None:
        """Hash the words of ``texts``; places count through all of them, ``ends`` is where the text of each place ends."""
        if len(self.words) > MEMO:
            self.words.clear()
        split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        self.sizes = np.array([len(s) for s in split], dtype=np.int64)
        n = int(self.sizes.sum())
        flat = (w for s in split for w in s)
        self.hashes = np.fromiter(map(self.words.__getitem__, flat), dtype=np.uint64, count=n)
        self.stops = np.cumsum(self.sizes)
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        self.ends = np.repeat(self.stops, self.sizes)
        for i, base in enumerate(_BASES):
            if len(self.powers[i][0]) <= n:
                inverse = np.uint64(pow(int(base), -1, 1 << 64))
                self.powers[i] = tuple(
                    np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(n + n // 4 + 1, b, dtype=np.uint64))]) for b in (base, inverse)
                )

    def rolled(self, size: int, which: int = 0) -> np.ndarray:
        """Rabin-Karp hash, modulo 2^64 and mixed, of the ``size`` words from each place on, whatever text they are of."""
        n = len(self.hashes)
        if n < size:
            return np.empty(0, dtype=np.uint64)
        up, down = self.powers[which]
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(self.hashes * up[:n], dtype=np.uint64)])
        h = (total[size:] - total[:-size]) * down[: n - size + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    def windows(self) -> np.ndarray:
        """Places where a window begins that lies within one text."""
        n = len(self.hashes) - WINDOW + 1
        return np.flatnonzero(np.arange(n) + WINDOW <= self.ends[:n]) if n > 0 else np.empty(0, dtype=np.int64)

    def seeds(self, places: np.ndarray) -> np.ndarray:
        """Least seed hash of the window at each place."""
        if not len(places):
            return np.empty(0, dtype=np.uint64)
        least, span, want = self.rolled(SEED), 1, WINDOW - SEED + 1
        while span * 2 <= want:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < want:
            least = np.minimum(least[: len(least) - (want - span)], least[want - span :])
        return least[places]


def _seed_rows(rows: DataFrame) -> DataFrame:
    """key, print, seed: the representatives of each document's windows (rows: text, key, print)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Roller()
        for b in slices(batches, 0, 1 << 20):
            roll.load(b.column(0).to_pylist())
            at = roll.windows()
            if not len(at):
                continue
            seed, doc = roll.seeds(at), roll.doc[at]
            first = np.ones(len(at), dtype=bool)
            first[1:] = (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1])
            take = pa.array(doc[first])
            yield pa.RecordBatch.from_arrays([b.column(1).take(take), b.column(2).take(take), pa.array(seed[first].view(np.int64))], names=["key", "print", "seed"])

    return rows.select("text", "key", "print").mapInArrow(tidy(run), "key long, print long, seed long")


def _window_rows(rows: DataFrame) -> DataFrame:
    """key, print, place, h1, h2: the windows whose representative is among ``seeds`` (rows: text, key, print, seeds)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Roller()
        for b in slices(batches, 0, 1 << 20):
            roll.load(b.column(0).to_pylist())
            at = roll.windows()
            if not len(at):
                continue
            seed, doc = roll.seeds(at), roll.doc[at]
            lists = b.column(3)
            shared = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            owner = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            # a seed of another text of the batch does no harm: the window is counted, and that is all
            shared = np.unique(shared)
            slot = np.minimum(np.searchsorted(shared, seed), len(shared) - 1)
            keep = shared[slot] == seed if len(shared) else np.zeros(len(seed), dtype=bool)
            keep &= np.isin(doc, owner)
            at, doc = at[keep], doc[keep]
            begin = roll.stops - roll.sizes
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [b.column(1).take(take), b.column(2).take(take), pa.array((at - begin[doc]).astype(np.int32)),
                 pa.array(roll.rolled(WINDOW)[at].view(np.int64)), pa.array((roll.rolled(WINDOW, 1)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32))],
                names=["key", "print", "place", "h1", "h2"],
            )

    return rows.select("text", "key", "print", "seeds").mapInArrow(tidy(run), "key long, print long, place int, h1 long, h2 int")


def merged(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals [start, end) covered by the windows that begin at ``places``."""
    places = np.unique(places)
    cut = np.flatnonzero(np.diff(places) > WINDOW)
    return places[np.concatenate([[0], cut + 1])], places[np.concatenate([cut, [len(places) - 1]])] + WINDOW


def _intervals(repeated: DataFrame) -> DataFrame:
    lists = repeated.groupBy("key", "print").agg(F.collect_list("place").alias("places"))  # the places of one document

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [merged(np.array(x)) for x in b.column(2).to_pylist()]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in both], type=kind), pa.array([x[1] for x in both], type=kind)],
                                             names=["key", "print", "starts", "ends"])

    return lists.mapInArrow(tidy(run), "key long, print long, starts array<int>, ends array<int>")


def _side(df: DataFrame, values: str | None = None) -> DataFrame:
    """Broadcast ``df`` up to BROADCAST_KEYS numbers: its rows, and those in its column ``values`` of arrays."""
    n = df.agg(F.count("*") + (F.coalesce(F.sum(F.size(values)), F.lit(0)) if values else 0)).first()[0]
    return F.broadcast(df) if n <= BROADCAST_KEYS else df


#: The end of an interval that stands for the end of the text, however many words it has.
ALL = (1 << 31) - 1


def _copies(rows: DataFrame) -> DataFrame:
    """key, print of rows whose whole text a row with a smaller key has too (rows: text, key, print)."""
    narrow = settle(rows.select("key", "print", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest")))
    groups = narrow.groupBy("digest").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count("*").alias("n"))
    groups = settle(groups.filter("least < most").select("digest", "least", "n"))
    return settle(join_by_key(narrow, groups, ["digest"], "n").filter("key > least").select("key", "print").distinct())


def repeated_intervals(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, print (hash of the text), starts, ends: the maximal intervals of words to remove of each document that has any.

    One interval from 0 to ALL is that of a copy, to be removed whole if it has a window at all.
    """
    rows = docs.select(text_of(text).alias("text"), F.col(key).cast("long").alias("key")).filter("key IS NOT NULL")
    rows = rows.withColumn("print", F.xxhash64("text"))
    copies = _copies(rows)
    seeds = settle(_seed_rows(rows).join(_side(copies), ["key", "print"], "left_anti"))
    shared = settle(seeds.groupBy("seed").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count("*").alias("n")).filter("least < most").select("seed", "n"))
    lists = settle(join_by_key(seeds, shared, ["seed"], "n").groupBy("key", "print").agg(F.collect_set("seed").alias("seeds")))  # of one document
    ids = _side(lists.select("key", "print"))
    windows = settle(_window_rows(rows.join(ids, ["key", "print"], "left_semi").join(lists, ["key", "print"])))
    least = windows.groupBy("h1", "h2").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count("*").alias("n"))
    least = settle(least.filter("least < most").drop("most"))
    found = _intervals(join_by_key(windows, least, ["h1", "h2"], "n").filter(F.col("least") < F.col("key")).select("key", "print", "place"))
    return settle(found.unionByName(copies.select("key", "print", F.array(F.lit(0)).alias("starts"), F.array(F.lit(ALL)).alias("ends"))))


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with what is left of each text, its n_words and n_removed, and the removed intervals (starts, ends; in words)."""
    added = ("n_words", "n_removed", "starts", "ends")
    kept = [c for c in docs.columns if c != text and c not in added]
    found = repeated_intervals(docs, text, key).select(F.col("key").alias("\x00k"), F.col("print").alias("\x00p"), "starts", "ends")
    body = text_of(text)
    own = docs.select(body.alias("\x00t"), *kept)
    own = own.join(_side(found, "starts"), (own[key].cast("long") == F.col("\x00k")) & (F.xxhash64("\x00t") == F.col("\x00p")), "left")
    own = own.select("\x00t", "starts", "ends", *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0):
            texts, sizes, gone, begun, ended = [], [], [], [], []
            for t, starts, ends in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = t.encode("utf-8", "surrogatepass").split()
                sizes.append(len(words))
                if ends == [ALL]:
                    starts, ends = ([0], [len(words)]) if len(words) >= WINDOW else (None, None)
                for s, e in zip(reversed(starts or ()), reversed(ends or ()), strict=True):
                    del words[s:e]
                gone.append(sizes[-1] - len(words))
                texts.append(b" ".join(words))
                begun.append(starts)
                ended.append(ends)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, type=pa.binary()).cast(pa.string()), pa.array(sizes, type=pa.int64()), pa.array(gone, type=pa.int64()), pa.array(begun, type=kind), pa.array(ended, type=kind), *b.columns[3:]],
                names=[text, "n_words", "n_removed", "starts", "ends", *kept],
            )

    fields = [T.StructField(text, T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    return own.mapInArrow(tidy(run), T.StructType([*fields, *own.schema.fields[1:]]))


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, len(words) AS n, unnest(range(1, len(words) - 48)) AS pos, words FROM w),
h AS (SELECT doc_id, pos, md5(array_to_string(words[pos : pos + 49], ' ')) AS h FROM p),
first AS (SELECT h, min(doc_id) AS least FROM h GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS i FROM h JOIN first USING (h) WHERE least < doc_id),
lists AS (SELECT doc_id, list(i) AS places FROM gone GROUP BY doc_id),
k AS (SELECT w.doc_id, words, coalesce(places, []) AS places FROM w LEFT JOIN lists ON w.doc_id = lists.doc_id)
SELECT doc_id, len(words) AS n_words, len(places) AS n_removed,
       sha256(array_to_string(list_filter(words, lambda x, i: NOT list_contains(places, i)), ' ')) AS kept_sha256 FROM k
"""


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
