"""What the corpus operators share: tables, folds, arrow helpers and shared-folder tables."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words of the window and shingle operators: maximal runs without ASCII white space, unchanged.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text column, with null read as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold(modulus: int, key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's setting, or a local one where none is set and the master is local."""
    set_ = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scriptloom-checkpoint-"))
        set_ = spark.sparkContext.getCheckpointDir()
    return set_.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has gone; the folder's owner cleans it
        pass


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    It cuts the lineage, survives lost executors, and makes values such as row numbers lasting.
    The table goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scriptloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table.settled_at = path
    return table


def drop(table: DataFrame) -> None:
    """Remove a table of ``settle`` that nothing reads any more."""
    if path := getattr(table, "settled_at", None):
        _remove(table.sparkSession, path)


#: A key is hot when it has more than one of HOT_SHARE rows, and HOT_ROWS at least; so there are fewer than HOT_SHARE of them.
HOT_SHARE, HOT_ROWS = 1000, 1000


def join_by_key(rows: DataFrame, facts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Inner join of ``rows`` with the one row that ``facts`` has of each key; its column ``n`` is the number of ``rows`` with the key.

    Hot keys, fewer than HOT_SHARE, are broadcast, so that their rows stay where they are; the others are shuffled. ``rows`` is read
    twice where there are hot keys, and should be a table.
    """
    state = facts.agg(F.sum(n).alias("total"), F.max(n).alias("most")).first()
    cut = max((state["total"] or 0) // HOT_SHARE, HOT_ROWS)
    if (state["most"] or 0) <= cut:
        return rows.join(facts, keys)
    hot = F.broadcast(facts.filter(F.col(n) > cut))
    rest = rows.join(F.broadcast(facts.filter(F.col(n) > cut).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(facts.filter(F.col(n) <= cut), keys))


def release() -> None:
    """Give freed memory back to the system: workers live on from task to task, and the executor's memory is shared."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable) -> Callable:
    """``run`` (a function of Arrow batches), with its memory released when the task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return wrapped


def slices(batches: Iterable[pa.RecordBatch], text: int, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``max_bytes`` of the text column, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        step = max(1, int(batch.num_rows * max_bytes // max(1, batch.column(text).nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


#: What a sample of labelled texts may bring to the driver at most, in characters.
SAMPLE_TOTAL = 64_000_000


def agreed(labels: DataFrame, label: str, key: str = "doc_id") -> DataFrame:
    """key and label, narrow, one row per key; keys with null or two different labels are left out."""
    one = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key"))
    one = one.agg(F.min(label).alias("label"), F.max(label).alias("most"))
    return one.filter(F.col("label") == F.col("most")).select("key", "label")


def labelled_sample(
    docs: DataFrame, agreed_labels: DataFrame, values: list, per_label: int, max_chars: int, text: str = "text", key: str = "doc_id"
) -> list[tuple]:
    """At most ``per_label`` (label, key, text) rows of each label, the same ones at every run.

    The keys are chosen on the narrow label rows, in the order of a hash; only their texts are read. Texts over
    ``max_chars`` are not learned from. What reaches the driver is at most per_label x values x max_chars, and SAMPLE_TOTAL characters: with many
    values each gets fewer rows.
    """
    from functools import reduce

    if not values:
        return []
    per_label = max(1, min(per_label, SAMPLE_TOTAL // (len(values) * max_chars)))
    picked = reduce(
        DataFrame.union,
        (
            agreed_labels.filter(F.col("label") == F.lit(v)).orderBy(F.xxhash64(F.col("key").cast("string")), "key").limit(per_label)
            for v in values
        ),
    )
    ids = picked.collect()
    if not ids:
        return []
    spark = docs.sparkSession
    side = F.broadcast(spark.createDataFrame(ids, agreed_labels.schema))  # at most per_label x values rows
    rows = docs.filter(F.length(text).between(1, max_chars)).select(F.col(key).alias("key"), F.col(text).alias("body"))
    got = rows.join(side, "key").select("label", "key", "body").collect()
    return sorted(((r["label"], r["key"], r["body"]) for r in got), key=lambda r: (str(r[0]), r[1], r[2]))


def ranked_sample(docs: DataFrame, agreed_labels: DataFrame, per_label: int, max_chars: int, text: str = "text", key: str = "doc_id") -> list[tuple]:
    """``labelled_sample`` of any number of labels, which are never collected: the first rows of each label in the order of a hash, round by round through the labels, until ``per_label`` of each or SAMPLE_TOTAL characters are reached.

    With more labels than rows that fit, some have none.
    """
    order = F.xxhash64(F.col("key").cast("string"))
    rank = F.row_number().over(W.partitionBy("label").orderBy(order, "key"))
    picked = agreed_labels.withColumn("rank", rank).filter(F.col("rank") <= per_label)
    ids = picked.orderBy("rank", order, "label", "key").limit(max(1, SAMPLE_TOTAL // max_chars)).select("label", "key").collect()
    if not ids:
        return []
    chosen = docs.sparkSession.createDataFrame(ids, agreed_labels.select("label", "key").schema)
    rows = docs.filter(F.length(text).between(1, max_chars)).select(F.col(key).alias("key"), F.col(text).alias("body"))
    got = rows.join(F.broadcast(chosen), "key").select("label", "key", "body").collect()
    return sorted(((r["label"], r["key"], r["body"]) for r in got), key=lambda r: (str(r[0]), r[1], r[2]))
