"""Centroids of integer vectors, by partial-distance search.

Squared differences are summed over the dimensions of the greatest variance first. Each vector's first guess is the centroid that
is nearest over the first STEP dimensions; a centroid is abandoned as soon as its sum is above the distance to the guess, and
those that are left finish all dimensions. All sums are integers, so the nearest centroid is exact, ties included.

A round is one pass over the vectors: tasks keep sums of their own, one number per centroid and dimension, which Spark adds up;
the driver sees ``k * size`` numbers a round, however many vectors there are. One centroid may hold all rows.

Defined results: vectors that are null, hold a null or a component that isn't finite, or have another number of components take no
part. Fewer vectors than centroids: each is a centroid. No vectors: no rows. A null key counts as the empty text in the hash that
picks the first centroids; rows with the same key are ordered by their components there, and each gets a row. Equal distances go to the
smaller number. A distance or sum beyond the range of long is the range's end. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.llm.common import read, settle, tidy
from scriptloom.llm.vectors import LONG_MAX, as_long, integer_vectors, largest, matrix

#: Dimensions that are added at a time, and vectors that are compared at a time.
STEP, ROWS = 8, 4096
K, ROUNDS, SIZE = 16, 3, 64
#: Sums of so many squares of differences of values up to this fit 64 bits.
NARROW = 2**26


def nearest(v: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each vector, the smaller number of equally near ones."""
    if max(largest(v), largest(centroids)) >= NARROW or v.shape[1] > 256:
        v, centroids = v.astype(object), centroids.astype(object)
    v, c = v[:, order], centroids[:, order]
    difference = v[:, None, :STEP] - c[None, :, :STEP]
    head = (difference * difference).sum(axis=2)
    guess = head.argmin(axis=1)
    rest = v[:, STEP:] - c[guess][:, STEP:]
    best = head[np.arange(len(v)), guess] + (rest * rest).sum(axis=1)
    alive = (head <= best[:, None]).astype(bool)
    alive[np.arange(len(v)), guess] = False
    row, centroid = np.nonzero(alive)
    total = head[row, centroid]
    for at in range(STEP, v.shape[1], STEP):
        if not len(row):
            break
        difference = v[row, at : at + STEP] - c[centroid, at : at + STEP]
        total = total + (difference * difference).sum(axis=1)
        left = (total <= best[row]).astype(bool)  # those strictly above are abandoned
        row, centroid, total = row[left], centroid[left], total[left]
    number, distance = guess.astype(np.int64), best.copy()
    rank = np.lexsort((centroid, total, row))
    row, centroid, total = row[rank], centroid[rank], total[rank]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.array([], dtype=np.int64)
    for i in first:  # the best survivor of each vector
        r = row[i]
        if (total[i], centroid[i]) < (distance[r], number[r]):
            distance[r], number[r] = total[i], centroid[i]
    return number, distance


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, matrix(part.column("v"), size)


def by_variance(vectors: DataFrame, size: int = SIZE) -> np.ndarray:
    """Dimensions in the order of falling variance. It decides how soon a centroid is abandoned, never which is the nearest."""
    x = [F.get("v", F.lit(i)).cast("double") for i in range(size)]
    spread = vectors.agg(F.array(*(F.var_pop(c) for c in x)).alias("s")).first()["s"]
    return np.argsort([-(s or 0.0) for s in spread], kind="stable")


def first_centroids(vectors: DataFrame, k: int = K, seed: int = 1) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of seed and key, in the order of the hashes."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")))
    rows = vectors.select(F.sha2(name.cast("binary"), 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """One round: each centroid at the floor of the mean of the vectors that are nearest to it; without any it stays."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, size), dtype=object), np.zeros(k, dtype=np.int64)
        for _, v in _blocks(batches, size):
            number, _ = nearest(v, centroids, order)
            if largest(v) >= 2**50:
                v = v.astype(object)
            for j in np.unique(number):
                sums[j] += v[number == j].sum(axis=0)
            counts += np.bincount(number, minlength=k)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(some, size), pa.int32()), pa.array(np.tile(np.arange(size), len(some)), pa.int32()),
                pa.array([Decimal(int(x)) for j in some for x in sums[j]], pa.decimal128(38, 0)), pa.array(np.repeat(counts[some], size), pa.int64()),
            ],
            names=["cluster", "place", "total", "n"],
        )

    parts = vectors.select("v").mapInArrow(tidy(run), "cluster int, place int, total decimal(38,0), n long")
    out = centroids.copy()
    for r in parts.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # k * size rows
        out[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray) -> DataFrame:
    """key, cluster, distance."""
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, v in _blocks(batches, size):
            number, distance = nearest(v, centroids, order)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(number, pa.int32()), pa.array(as_long(distance), pa.int64())], names=["key", "cluster", "distance"])

    return vectors.mapInArrow(tidy(run), "key long, cluster int, distance long")


def centroid_clusters(table: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = 1, size: int = SIZE, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance) of each usable vector, and the centroids after ``rounds`` rounds."""
    vectors = integer_vectors(table, key, vector, size)
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return vectors.select("key", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), centroids.reshape(0, size)
    order = by_variance(vectors, size)
    for _ in range(rounds):
        centroids = moved(vectors, centroids, order)
    return assigned(vectors, centroids, order), centroids


def with_inertia(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``rows`` of ``centroid_clusters`` with the sums of distances, over the cluster and over all, and a hash of the centroid."""
    rows = settle(rows)
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row for each centroid
    clip = lambda x: min(int(x), LONG_MAX)
    total = clip(sum(r["s"] for r in sums))
    name = lambda j: hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()
    facts = rows.sparkSession.createDataFrame([(r["cluster"], clip(r["s"]), total, name(r["cluster"])) for r in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("key", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = centroid_clusters(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return with_inertia(rows, centroids).withColumnRenamed("key", "vec_id")


def _round(n: int, last: bool = False) -> str:
    near = f"""
    a{n} AS (SELECT vec_id, min_by(c, d * 100 + c) AS cluster, min(d) AS distance FROM (
        SELECT v.vec_id, c.c, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM cells v JOIN c{n} c ON c.p = v.p GROUP BY ALL) GROUP BY vec_id),"""
    move = f"""
    m{n} AS (SELECT cluster AS c, p, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM cells JOIN a{n} USING (vec_id) GROUP BY ALL),
    c{n + 1} AS (SELECT c.c, c.p, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.x) AS x FROM c{n} c LEFT JOIN m{n} m ON m.c = c.c AND m.p = c.p),"""
    return near if last else near + move


ORACLE = f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS MATERIALIZED (SELECT vec_id, generate_subscripts(v, 1) AS p, unnest(v) AS x FROM kept),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY h) - 1 AS c FROM (SELECT vec_id, sha256('1:' || vec_id::VARCHAR) AS h FROM kept ORDER BY h LIMIT 16)),
c0 AS (SELECT c, p, x FROM firsts JOIN cells USING (vec_id)),
{"".join(_round(n) for n in range(ROUNDS))}{_round(ROUNDS, True)}
names AS (SELECT c AS cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY p)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN names USING (cluster)
"""
