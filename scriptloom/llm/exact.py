"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Every row gets a 64-bit fingerprint and the SHA-256 of its normalised text (A-Z lower-cased, nothing else);
   these narrow rows are kept as a table.
2. In the same pass each run of rows codes its distinct fingerprints where they lie, a code for each owner of a fingerprint range: sorted, their gaps
   Golomb-Rice coded, with one bit each for those that it holds more than once. A fingerprint that half of all
   rows share is sent once a run. Only the codes are shuffled.
3. An owner decodes what it got and answers each run with a bitmap of the fingerprints that occur again; code and bitmap name the suspects.
4. Only the texts of suspects are shuffled, grouped by their very bytes (equal bytes are collapsed before the shuffle), which
   verifies each group; the group's row with the largest key stays. Rows of a large group stay where they lie, and the group's facts go to them.

Defined results: a null text counts as empty and empty texts equal each other; a null key is smaller than any
other; of rows with the same key and text one stays; repeated rows count; an empty table gives no rows; extra
columns take no part, and names that the operator adds replace columns of the same name; very long texts are hashed and compared whole.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptloom.llm.common import join_by_key, read, settle, text_of, tidy

#: Fingerprints that one owner may hold, on average (32 MB of them), and rows that send their codes together.
OWNER_ROWS, UNIT_ROWS = 4 << 20, 1 << 20
#: Keys up to this many are broadcast (8 to 72 bytes each); beyond, both sides are shuffled.
BROADCAST_KEYS = 200_000


def normalised(text: str = "text") -> Column:
    """Null as empty; A-Z, and nothing else, lower-cased."""
    return F.translate(text_of(text), string.ascii_uppercase, string.ascii_lowercase)


# -- Golomb-Rice code of sorted distinct unsigned 64-bit numbers


def golomb_encode(values: np.ndarray) -> tuple[int, bytes]:
    """(width of the remainders, code) of sorted distinct values: unary quotients, then fixed-width remainders."""
    n = len(values)
    if n == 0:
        return 0, b""
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    mean = float(gaps.astype(np.float64).mean())
    width = max(0, min(63, int(np.log2(max(mean, 1.0)))))
    quotient = (gaps >> np.uint64(width)).astype(np.int64)
    unary = np.zeros(int(quotient.sum()) + n, dtype=np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 1
    shifts = np.arange(width - 1, -1, -1, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
    return width, np.packbits(np.concatenate([unary, rest])).tobytes()


def golomb_decode(n: int, width: int, code: bytes) -> np.ndarray:
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    bits = np.unpackbits(np.frombuffer(code, dtype=np.uint8))
    ends = np.flatnonzero(bits)[:n]  # the first n set bits end the unary numbers
    quotient = np.diff(ends, prepend=-1) - 1
    at = int(ends[-1]) + 1
    rest = bits[at : at + n * width].reshape(n, width).astype(np.uint64)
    value = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        value = (value << np.uint64(1)) | rest[:, j]
    return np.cumsum((quotient.astype(np.uint64) << np.uint64(width)) | value, dtype=np.uint64)


def _owners(prints: np.ndarray, owners: int) -> np.ndarray:
    """Ranges of equal size of the unsigned fingerprints."""
    return ((prints >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def _coded(rows: DataFrame, owners: int) -> DataFrame:
    """``rows`` (key, print, sha256, row) as they are, and among them what their task sends: unit, owner, n, width, code, again.

    A unit is a run of UNIT_ROWS rows of one task. Its distinct fingerprints are sorted, dealt to their owners' ranges and coded where the rows lie;
    ``again`` has a bit for each that the unit holds more than once.
    """
    fields = [*(T.StructField(f.name, f.dataType) for f in rows.schema.fields), *(T.StructField(n, k) for n, k in _SENT)]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, size, kinds = TaskContext.get().partitionId() << 33, [], 0, None

        def send() -> pa.RecordBatch:
            prints, counts = np.unique(np.concatenate(held), return_counts=True)
            own = _owners(prints, owners)
            cuts, sent = np.flatnonzero(np.diff(own, prepend=-1)), []
            for a, b in zip(cuts, [*cuts[1:], len(prints)], strict=True):
                width, code = golomb_encode(prints[a:b])
                sent.append((first, int(own[a]), int(b - a), width, code, np.packbits(counts[a:b] > 1).tobytes()))
            columns = [pa.array(c, type=k) for c, k in zip(zip(*sent, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(sent), k) for k in kinds), *columns], names=names)

        names = [f.name for f in fields]
        for b in batches:
            if not b.num_rows:
                continue
            kinds = [c.type for c in b.columns]
            held.append(b.column(1).to_numpy().view(np.uint64))
            size += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.nulls(b.num_rows, k) for k in types)], names=names)
            if size >= UNIT_ROWS:
                yield send()
                first, held, size = first + 1, [], 0
        if held:
            yield send()

    return rows.mapInArrow(tidy(run), T.StructType(fields))


_SENT = (("unit", T.LongType()), ("owner", T.LongType()), ("n", T.LongType()), ("width", T.IntegerType()), ("code", T.BinaryType()), ("again", T.BinaryType()))


def _answer(t: pa.Table) -> pa.Table:
    """An owner's bitmaps: for each unit, which of the fingerprints it sent occur again."""
    got = t.to_pylist()
    each = [golomb_decode(r["n"], r["width"], r["code"]) for r in got]
    again = [np.unpackbits(np.frombuffer(r["again"], dtype=np.uint8))[: r["n"]].astype(bool) for r in got]
    _, inverse, counts = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
    twice = counts > 1
    twice[inverse[np.concatenate(again)]] = True
    bitmaps = [np.packbits(twice[i]).tobytes() for i in np.split(inverse, np.cumsum([len(x) for x in each])[:-1])]
    return pa.table({"unit": t.column("unit"), "owner": t.column("owner"), "bitmap": pa.array(bitmaps, type=pa.binary())})


def _suspect_prints(codes: DataFrame) -> DataFrame:
    """The distinct fingerprints that occur again, told to each unit by its owners' bitmaps. Only codes and bitmaps are shuffled."""
    bitmaps = codes.groupBy("owner").applyInArrow(_answer, "unit long, owner long, bitmap binary")
    both = codes.select("unit", "owner", "n", "width", "code").join(bitmaps.filter(F.ltrim(F.hex("bitmap"), F.lit("0")) != ""), ["unit", "owner"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                set_ = np.unpackbits(np.frombuffer(r["bitmap"], dtype=np.uint8))[: r["n"]].astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array(golomb_decode(r["n"], r["width"], r["code"])[set_].view(np.int64))], names=["print"])

    return both.select("n", "width", "code", "bitmap").mapInArrow(tidy(run), "print long").distinct()


def copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, keep (key of the row that stays), group_size, kept, sha256."""
    norm = normalised(text)
    rows = docs.select(F.col(key).alias("key"), norm.alias("norm"))
    owners = max(1, -(-docs.count() // OWNER_ROWS), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    narrow = rows.select(
        "key", F.xxhash64("norm").alias("print"), F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha256"), F.monotonically_increasing_id().alias("row"),
    )
    coded = settle(_coded(narrow, owners))
    prints = settle(_suspect_prints(coded.filter("code IS NOT NULL")))
    prints = F.broadcast(prints) if prints.count() <= BROADCAST_KEYS else prints
    narrow = coded.filter("code IS NULL").select("key", "print", "sha256", "row")
    suspects = settle(narrow.join(prints, "print", "left_semi"))
    # equal bytes meet before and in the shuffle: what is left are the different texts of suspects
    texts = rows.select("norm", F.xxhash64("norm").alias("print")).join(prints, "print", "left_semi").groupBy("print", "norm").agg(F.count("*").alias("seen"))
    verified = (
        texts.select("print", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha256"))
        .groupBy("print", "sha256").agg(F.count("*").alias("texts"))
    )
    groups = (
        suspects.groupBy("print", "sha256").agg(F.max(F.struct("key", "row")).alias("keep"), F.count("*").alias("group_size"))
        .join(verified, ["print", "sha256"])
        .withColumn("group_size", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share both hashes"))))
    )
    found = join_by_key(suspects, settle(groups.drop("texts")), ["print", "sha256"], "group_size").select(
        "key", F.col("keep.key").alias("keep"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "sha256"
    )
    alone = narrow.join(prints, "print", "left_anti").select("key", F.col("key").alias("keep"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha256")
    return alone.unionByName(found).withColumn("sha256", F.lower(F.hex("sha256")))


def without_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    gone = settle(copies(docs, text, key).filter(~F.col("kept")))
    twin = F.col("key").eqNullSafe(F.col("keep"))  # same key and text as the row that stays
    apart = gone.filter(~twin).select("key", "sha256").distinct()
    twins = gone.filter(twin).select("key", "sha256").distinct()
    own = docs.withColumns({"\x00sha": F.sha2(normalised(text).cast("binary"), 256), "\x00key": F.col(key)})

    def side(d: DataFrame) -> DataFrame:
        return F.broadcast(d) if d.count() <= BROADCAST_KEYS else d

    def same(d: DataFrame) -> Column:
        return (own["\x00sha"] == d["sha256"]) & own["\x00key"].eqNullSafe(d["key"])

    left = own.join(d := side(apart), same(d), "left_anti")
    if not twins.isEmpty():
        once = left.join(d := side(twins), same(d), "left_semi").dropDuplicates(["\x00sha", "\x00key"])
        left = left.join(d, same(d), "left_anti").unionByName(once)
    return left.drop("\x00sha", "\x00key")


ORACLE = """
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents) d
JOIN (SELECT translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm,
             max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1) g ON d.norm = g.norm
"""


def op5_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = copies(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("key").alias("doc_id"), F.col("keep").alias("keep_id"), "group_size", "kept", F.col("sha256").alias("text_sha256"))
