"""Exact search for the largest inner products, in buckets of similar length.

Vectors fall into classes by length (each up to CLASS times as long as the one before), and classes into buckets of bounded size by
a hash of the row, so that a length which a third of all vectors share is many buckets. Queries fall into groups of bounded size. A
first pass over the queries alone compares them with SEEDS of the longest vectors and gives each a score that its k-th answer reaches
at least. Then every group meets the buckets that are long enough for one of its queries, a bucket and a group at a time:

* a query's local threshold is the cosine that a vector of the bucket's greatest length needs to reach the score; above 1 the bucket is left out;
* up to the bucket's own limit, the bucket is pruned by length: its vectors are compared from the longest on, in blocks, as far as the score can still be reached;
* beyond the limit it is pruned by coordinates: on the query's greatest coordinates a vector has to lie in the range which the threshold leaves, and only those that do are compared.

The limit is the least threshold at which, for queries of the group, coordinates leave a small part of the bucket. Products are of integers and exact,
scores rise as answers are found, and the k best of each bucket meet in a window over the query.

Defined results: vectors that are null or hold a null or a component that isn't finite take no part; vectors of different numbers of components don't meet; empty ones
score 0. A query's own row isn't among its answers, others with its key are. Rows that repeat are rows of their own: a query that occurs twice is answered twice. Null
keys come after all others of a score. Components and scores beyond the range of long are the range's ends, and tie there. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptloom.llm.common import read, settle, tidy
from scriptloom.llm.vectors import EXACT, LONG_MAX, LONG_MIN, as_long, integers, largest, matrix, usable

K = 20
#: How many of the longest vectors give the first scores; components that a bucket, or a group of queries, holds at most; the ratio of lengths in a class.
SEEDS, CELL, CLASS = 4096, 8192 * 64, 1.05
#: Queries and vectors that are multiplied at a time; coordinates looked at; queries that set a bucket's limit; the part of a bucket that coordinates have to leave.
ROWS, BLOCK, FOCUS, SAMPLE, SHARE = 1024, 2048, 3, 32, 1 / 5
#: Slack of lengths and cosines, which are rounded; scores aren't.
EPS = 1e-9
LIMITS = np.array([*np.arange(0.3, 0.96, 0.05), 0.97, 0.98, 0.99])
_VECTOR = "row long, key long, v array<bigint>, norm double"


def _classes(rows: DataFrame) -> list[dict]:
    """For each number of components and class of length: buckets and groups, numbered so that the longest of a size come first. A row for each class comes to the driver."""
    found = rows.groupBy("n", "class").agg(F.count("*").alias("all"), F.max("norm").alias("longest"), F.count_if("asked").alias("asked")).collect()
    asked: dict[int, int] = {}
    for r in found:
        asked[r["n"]] = asked.get(r["n"], 0) + r["asked"]
    out, bucket, group, groups = [], 0, 0, {}
    for n, k in sorted(asked.items()):
        groups[n] = (group, -(-k * max(n, 1) // CELL))
        group += groups[n][1]
    for r in sorted(found, key=lambda r: (r["n"], -r["longest"])):
        parts = -(-r["all"] * max(r["n"], 1) // CELL)
        out.append({"n": r["n"], "class": r["class"], "longest": r["longest"], "bucket": bucket, "parts": parts, "group": groups[r["n"]][0], "groups": groups[r["n"]][1]})
        bucket += parts
    return out


def _packed(table: pa.Table, reach: list[tuple[int, float, int, int]]) -> tuple:
    """Rows of vectors as one row of bytes, in the smallest integers that hold them; and the buckets, first to last, that are long enough for one of the queries."""
    n = len(table.column("v")[0])
    m = matrix(table.column("v"), n)
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if not m.size or (m.min() >= np.iinfo(t).min and m.max() <= np.iinfo(t).max))
    key = table.column("key").combine_chunks()
    missing = key.is_null().to_numpy(zero_copy_only=False)
    norm = table.column("norm").to_numpy()
    theta = table.column("theta").to_numpy() if "theta" in table.column_names else np.empty(0)
    need = 0.0
    if len(theta):
        with np.errstate(divide="ignore", invalid="ignore"):
            need = float(np.where(theta > 0, theta / norm, 0.0).min())
    own = [(first, first + parts - 1) for size, longest, first, parts in reach if size == n and longest * (1 + EPS) >= need]
    bytes_ = (table.column("row").to_numpy().tobytes(), key.fill_null(0).to_numpy(zero_copy_only=False).tobytes(), missing.astype(np.int8).tobytes(), norm.tobytes(), theta.tobytes(), m.astype(kind).tobytes())
    return n, np.dtype(kind).name, *bytes_, min((a for a, _ in own), default=0), max((z for _, z in own), default=-1)


_PACKED = "n long, kind string, rows binary, keys binary, missing binary, norms binary, thetas binary, data binary, first long, last long"


def _pack(frame: DataFrame, by: str, reach: list) -> DataFrame:
    names = [by, *(x.split()[0] for x in _PACKED.split(", "))]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({name: [x] for name, x in zip(names, (key[0].as_py(), *_packed(table, reach)), strict=True)})

    return frame.groupBy(by).applyInArrow(run, f"{by} long, {_PACKED}")


class _Rows:
    """One packed row, opened; the longest vectors first."""

    def __init__(self, row: dict):
        self.row, self.key, self.missing = np.frombuffer(row["rows"], np.int64), np.frombuffer(row["keys"], np.int64), np.frombuffer(row["missing"], np.int8)
        self.norm, self.theta = np.frombuffer(row["norms"], np.float64), np.frombuffer(row["thetas"], np.float64)
        self.v = np.frombuffer(row["data"], row["kind"]).reshape(len(self.row), row["n"])
        order = np.argsort(-self.norm, kind="stable")
        for name in ("row", "key", "missing", "norm", "v"):
            setattr(self, name, getattr(self, name)[order])
        if len(self.theta):
            self.theta = self.theta[order].copy()


def numbers(*parts: np.ndarray) -> list[np.ndarray]:
    """Integers as the fastest kind in which their inner products are exact."""
    most = [largest(p) for p in parts]
    kind = np.float64 if most[0] * most[-1] * max(1, parts[0].shape[1]) < EXACT else object
    return [p.astype(kind) for p in parts]


class _Coordinates:
    """A bucket's directions, each coordinate sorted when it is first asked for."""

    def __init__(self, v: np.ndarray, norm: np.ndarray):
        self.unit = v.astype(np.float64) / np.where(norm > 0, norm, 1.0)[:, None]
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _range(self, unit: np.ndarray, focus: int, cosine: float) -> tuple[int, int, float, float]:
        if focus not in self.sorted:
            order = np.argsort(self.unit[:, focus], kind="stable")
            self.sorted[focus] = self.unit[order, focus], order
        alpha, phi = np.arccos(np.clip(unit[focus], -1, 1)), np.arccos(min(1.0, cosine))
        low, high = np.cos(min(np.pi, alpha + phi)) - EPS, np.cos(max(0.0, alpha - phi)) + EPS
        values = self.sorted[focus][0]
        return int(np.searchsorted(values, low)), int(np.searchsorted(values, high, "right")), low, high

    def share(self, unit: np.ndarray, cosine: float) -> float:
        a, z, _, _ = self._range(unit, int(np.abs(unit).argmax()), cosine)
        return (z - a) / len(self.unit)

    def within(self, unit: np.ndarray, cosine: float) -> np.ndarray:
        """Vectors whose coordinates a cosine to ``unit`` of ``cosine`` or more allows."""
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        ranges = [self._range(unit, int(f), cosine) for f in focus]
        best = min(range(len(ranges)), key=lambda i: ranges[i][1] - ranges[i][0])
        found = self.sorted[int(focus[best])][1][ranges[best][0] : ranges[best][1]]
        for i, f in enumerate(focus):
            if i != best and len(found):
                x = self.unit[found, f]
                found = found[(x >= ranges[i][2]) & (x <= ranges[i][3])]
        return found


def local_limit(coordinates: _Coordinates, units: np.ndarray) -> float:
    """The least cosine from which coordinates leave SHARE of the bucket at most, for the queries given; above 1 if there is none."""
    if not len(units) or not units.shape[1]:
        return 2.0
    for limit in LIMITS:
        if np.mean([coordinates.share(u, float(limit)) for u in units]) <= SHARE:
            return float(limit)
    return 2.0


class _Best:
    """The k best answers of each query so far, and the score that a new one has to reach."""

    def __init__(self, theta: np.ndarray, place: np.ndarray, k: int):
        self.theta, self.place, self.k = theta, place, k
        self.q = self.v = np.empty(0, np.int64)
        self.s = None

    def add(self, q: np.ndarray, v: np.ndarray, s: np.ndarray) -> None:
        if not len(q):
            return
        if s.dtype == object:
            s = np.minimum(np.maximum(s, LONG_MIN), LONG_MAX)
        if self.s is not None:
            q, v, s = np.concatenate([self.q, q]), np.concatenate([self.v, v]), np.concatenate([self.s, s])
        order = np.lexsort((self.place[v], -s, q))
        q, v, s = q[order], v[order], s[order]
        starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(starts, append=len(q)))
        kth = rank == self.k - 1
        self.theta[q[kth]] = np.maximum(self.theta[q[kth]], s[kth].astype(np.float64) * (1 - 1e-15 * np.sign(s[kth].astype(np.float64))))
        self.q, self.v, self.s = q[rank < self.k], v[rank < self.k], s[rank < self.k]


def search(bucket: _Rows, group: _Rows, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of the bucket's answers: the k best of each query, as far as they reach its score."""
    place = np.empty(len(bucket.row), np.int64)
    place[np.lexsort((bucket.key, bucket.missing))] = np.arange(len(bucket.row))
    v, q = numbers(bucket.v, group.v)
    best = _Best(group.theta.copy(), place, k)
    longest = bucket.norm[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(best.theta > 0, best.theta / (group.norm * longest), -1.0)
    live = np.flatnonzero(cosine <= 1 + EPS)
    if not len(live):
        return best.q, best.v, np.empty(0)
    unit = group.v.astype(np.float64) / np.where(group.norm > 0, group.norm, 1.0)[:, None]
    coordinates = _Coordinates(bucket.v, bucket.norm)
    limit = local_limit(coordinates, unit[live[:: max(1, len(live) // SAMPLE)]])
    narrow = cosine > limit
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in live[narrow[live]]:
        at = coordinates.within(unit[i], cosine[i])
        at = at[bucket.row[at] != group.row[i]]
        s = v[at] @ q[i] if len(at) else np.empty(0, v.dtype)
        hit = (s >= best.theta[i]).astype(bool)
        found.append((np.full(int(hit.sum()), i), at[hit], s[hit]))
    if found:
        best.add(*(np.concatenate([f[j] for f in found]) for j in range(3)))
    wide = live[~narrow[live]]
    for a in range(0, len(wide), ROWS):
        some = wide[a : a + ROWS]
        for at in range(0, len(v), BLOCK):
            theta = best.theta[some]
            some = some[(theta <= 0) | (theta <= group.norm[some] * bucket.norm[at] * (1 + EPS))]
            if not len(some):
                break  # no vector further on is long enough
            s = q[some] @ v[at : at + BLOCK].T
            hit = (s >= best.theta[some][:, None]).astype(bool) & (group.row[some][:, None] != bucket.row[at : at + BLOCK][None, :])
            x, y = np.nonzero(hit)
            best.add(some[x], y + at, s[x, y])
    return best.q, best.v, best.s if best.s is not None else np.empty(0)


def _first_scores(asked: DataFrame, seeds: pa.Table, k: int) -> DataFrame:
    """Queries with ``theta``, the k-th best score among the seeds, a score that the k-th answer reaches; without so many, none."""
    sizes = np.array([len(x) for x in seeds.column("v")]) if seeds.num_rows else np.empty(0, np.int64)
    by_size = {int(n): (matrix(seeds.column("v").combine_chunks().filter(pa.array(sizes == n)), int(n)), seeds.column("row").to_numpy()[sizes == n]) for n in np.unique(sizes)}
    shared = asked.sparkSession.sparkContext.broadcast(by_size)  # SEEDS vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                size, row = part.column("n").to_numpy(), part.column("row").to_numpy()
                theta = np.full(len(row), -np.inf)
                for n in np.unique(size):
                    have, own = shared.value.get(int(n), (np.empty((0, int(n)), np.int64), np.empty(0, np.int64)))
                    if len(own) <= k:
                        continue
                    mine = np.flatnonzero(size == n)
                    q, v = numbers(matrix(part.column("v").take(pa.array(mine)), int(n)), have)
                    s = (q @ v.T).astype(np.float64)
                    s[row[mine][:, None] == own[None, :]] = -np.inf
                    kth = np.clip(np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k], LONG_MIN, LONG_MAX)
                    theta[mine] = kth - np.abs(kth) * (0 if q.dtype == np.float64 else EPS)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "key", "v", "norm", "group")), pa.array(theta)], names=["row", "key", "v", "norm", "group", "theta"])

    return asked.select("row", "key", "v", "norm", "n", "group").mapInArrow(tidy(run), f"{_VECTOR}, group long, theta double")


def top_products(table: DataFrame, asked: Column, k: int = K, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query, rank, key, score: for each row for which ``asked`` holds, the k other rows with the greatest inner products."""
    spark = table.sparkSession
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = table.filter(usable(vector)).select(F.col(key).cast("long").alias("key"), F.coalesce(asked, F.lit(False)).alias("asked"), integers(vector).alias("v"))
    rows = rows.withColumns({"row": F.monotonically_increasing_id(), "n": F.size("v"), "norm": length})
    rows = settle(rows.withColumn("class", F.when(F.col("norm") > 0, F.ceil(F.log("norm") / F.log(F.lit(CLASS))).cast("int")).otherwise(-1)))
    classes = _classes(rows)
    reach = [(c["n"], c["longest"], c["bucket"], c["parts"]) for c in classes]
    facts = spark.createDataFrame([tuple(c[x] for x in ("n", "class", "bucket", "parts", "group", "groups")) for c in classes], "n int, class int, bucket0 long, parts long, group0 long, groups long")
    rows = rows.join(F.broadcast(facts), ["n", "class"])  # a row for each class of length
    spread = lambda salt, m: F.pmod(F.xxhash64("row", F.lit(salt)), m)
    seeds = rows.orderBy(F.desc("norm"), "row").limit(SEEDS).select("row", "v").toArrow()
    vectors = rows.select("row", "key", "v", "norm", (F.col("bucket0") + spread(0, F.col("parts"))).alias("bucket"))
    queries = _first_scores(rows.filter("asked").withColumn("group", F.col("group0") + spread(1, F.col("groups"))), seeds, k)
    groups = settle(_pack(queries, "group", reach))
    pairs = groups.filter("last >= first").withColumn("bucket", F.explode(F.sequence("first", "last")))
    met = spark.read.schema(groups.schema).parquet(groups.settled_at).filter("last >= first").select("group", F.explode(F.sequence("first", "last")).alias("bucket"))  # columns of its own
    buckets = _pack(vectors, "bucket", reach).join(met, "bucket")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = {"query_row": [], "query": [], "key": [], "score": []}
        if left.num_rows and right.num_rows:
            bucket, group = _Rows(left.to_pylist()[0]), _Rows(right.to_pylist()[0])
            q, v, s = search(bucket, group, k)
            mask = lambda x: x.astype(bool)
            columns = {
                "query_row": group.row[q], "query": pa.array(group.key[q], mask=mask(group.missing[q])), "key": pa.array(bucket.key[v], mask=mask(bucket.missing[v])), "score": as_long(s),
            }
        return pa.table(columns, schema=pa.schema([(n, pa.int64()) for n in columns]))

    found = buckets.groupBy("bucket", "group").cogroup(pairs.groupBy("bucket", "group")).applyInArrow(run, "query_row long, query long, key long, score long")
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("key")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "rank", "key", "score")


def op11_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_products(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("key").alias("vec_id"), "score")


ORACLE = """
WITH v AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.v, v.v)::BIGINT AS score FROM v q JOIN v ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
