"""N-gram Jaccard join: near-duplicates of 0.8 or more on shingles of five words, with Bayesian pruning.

A word is a run without ASCII white space, taken as it is; a text of one to four words is one shingle. Texts
with equal sets of shingles form a class, found by hash, and take part once.

1. ``BANDS`` x ``ROWS`` MinHash values of 16 bits a class; classes that agree on a band are candidates: a pair of
   similarity 0.8 is missed with probability (1 - 0.8^4)^32 = 5e-8.
2. A candidate pair is looked at in the first band on which it agrees. Its MinHash values are compared ``STEP`` at a time, and it is
   dropped once the posterior probability that its similarity reaches 0.8 (uniform prior, binomial matches) is below ``TOLERANCE``.
   Pairs never leave the task: what does are the edges of a spanning forest, at most one a class.
3. The forests' components hold all pairs that are left. Within each, shingle sets are intersected exactly, and each class gets its
   number of linked documents and one edge to its group.
Buckets and components are cut into blocks of ``BLOCK`` and ``EXACT_BLOCK`` classes, and a task holds two blocks at most, so that neither a
hot bucket nor a large group of copies meets in one task.

Defined results: texts without words are in no class but their own and have no links; null keys are kept and don't name
a class unless it has no other; repeated rows are copies of each other; very long texts are shingled whole, one at a time; an empty table gives no rows; extra columns take no part.
Of classes whose texts share a 64-bit hash without being equal, each keeps its own text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.llm.common import read, settle, slices, text_of, tidy
from scriptloom.llm.components import components
from scriptloom.llm.substrings import Roller

SHINGLE = 5
#: similarity of at least 4 / 5, as a fraction, so that the comparison is exact
NUMERATOR, DENOMINATOR = 4, 5
BANDS, ROWS, STEP, TOLERANCE = 32, 4, 16, 1e-9
HASHES = BANDS * ROWS
BLOCK, EXACT_BLOCK, STRIPE = 1024, 256, 64
BROADCAST_KEYS = 200_000
_MULTIPLIERS = np.random.default_rng(20240229).integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(roll: Roller, texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    roll.load(texts)
    rolled, begin = roll.rolled(SHINGLE), roll.stops - roll.sizes
    out = []
    for t, a, n in zip(texts, begin, roll.sizes, strict=True):
        if n >= SHINGLE:
            out.append(np.unique(rolled[a : a + n - SHINGLE + 1]))
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(b"\n".join(t.encode("utf-8", "surrogatepass").split()), 5)], dtype=np.uint64))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of non-empty sets, 16 bits each."""
    flat = np.concatenate(sets)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), HASHES), dtype=np.uint16)
    for k in range(HASHES):
        least = np.minimum.reduceat(flat * _MULTIPLIERS[k], starts)
        out[:, k] = (least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    return out


@lru_cache
def least_matches() -> tuple[tuple[int, int], ...]:
    """(values compared, matches below which a pair is dropped) at each step.

    With a uniform prior the similarity after m matches of k is Beta(m + 1, k - m + 1); the probability that it is at least s is the
    binomial sum over j <= m of C(k + 1, j) s^j (1 - s)^(k + 1 - j).
    """
    s, out = NUMERATOR / DENOMINATOR, []
    for k in range(STEP, HASHES + 1, STEP):
        tail = np.cumsum([comb(k + 1, j) * s**j * (1 - s) ** (k + 1 - j) for j in range(k + 1)])
        out.append((k, int(np.searchsorted(tail, TOLERANCE))))
    return tuple(out)


def surviving(a: np.ndarray, b: np.ndarray, band: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of ``a`` and ``b`` (signatures) that first agree in ``band`` and are not dropped; of one block, each pair once."""
    ka, kb = (np.ascontiguousarray(x).view(np.uint64).reshape(len(x), BANDS) for x in (a, b))
    found = []
    for lo in range(0, len(a), STRIPE):  # some rows at a time, for little memory
        i, j = (x.ravel() for x in np.indices((min(STRIPE, len(a) - lo), len(b)), dtype=np.int32))
        i = i + np.int32(lo)
        keep = ka[i, band] == kb[j, band]
        if same:
            keep &= i < j
        i, j = i[keep], j[keep]
        for t in range(band):
            if not len(i):
                break
            new = ka[i, t] != kb[j, t]
            i, j = i[new], j[new]
        matches, at = np.zeros(len(i), dtype=np.int32), 0
        for k, least in least_matches():
            if not len(i):
                break
            matches += (a[i, at:k] == b[j, at:k]).sum(axis=1, dtype=np.int32)
            keep = matches >= least
            i, j, matches, at = i[keep], j[keep], matches[keep], k
        if len(i):
            found.append((i, j))
    if not found:
        return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int32)
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least place of the component of each of ``n`` places under the pairs."""
    label = np.arange(n)
    while len(i):
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def linked(a: list[np.ndarray], b: list[np.ndarray], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of sets whose similarity reaches the threshold; of one block, each pair once."""
    na, nb = (np.array([len(x) for x in s]) for s in (a, b))
    fits = (DENOMINATOR * np.minimum.outer(na, nb) >= NUMERATOR * np.maximum.outer(na, nb))
    if same:
        fits = np.triu(fits, 1)
    i, j = np.nonzero(fits)
    if not len(i):
        return i, j
    if len(i) <= 2 * (len(a) + len(b)):
        both = np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i, j, strict=True)])
    else:  # incidence of the shingles that more than one set has, some columns at a time
        sets = a if same else a + b
        ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
        rank = np.cumsum(counts > 1) - 1
        keep = counts[ids] > 1
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[keep]
        col = rank[ids[keep]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        product, width, total = np.zeros((len(a), len(b)), dtype=np.float32), 4096, int(rank[-1]) + 1
        for at in range(0, total, width):
            lo, hi = np.searchsorted(col, [at, at + width])
            x = np.zeros((len(sets), min(width, total - at)), dtype=np.float32)
            x[row[lo:hi], col[lo:hi] - at] = 1
            product += x[: len(a)] @ (x if same else x[len(a) :]).T
        both = product[i, j].astype(np.int64)
    close = (NUMERATOR + DENOMINATOR) * both >= NUMERATOR * (na[i] + nb[j])
    return i[close], j[close]


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows that agree on the first ``width`` columns, from sorted batches: a table of some, and where each begins."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        rest.append(b)
        table = pa.Table.from_batches(rest)
        keys = np.stack([table.column(c).to_numpy() for c in range(width)])
        cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1])
        if len(cuts) > 1:
            yield table.slice(0, cuts[-1]), cuts[:-1]
            rest = table.slice(cuts[-1]).to_batches()
    if rest:
        yield pa.Table.from_batches(rest), np.array([0])


def _blocks(rows: DataFrame, key: str, block: int) -> DataFrame:
    """``rows`` (node, n: size of the key's group) with x, y and own: each block meets itself and every other once, in the group (key, x, y)."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    rows = rows.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    rows = rows.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("other", "n")
    first = [key, "x", "y", "own"]
    return rows.repartition(key, "x", "y").sortWithinPartitions(*first).select(*first, *(c for c in rows.columns if c not in first))


def _side(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def _mapped(rows: DataFrame, work: Callable[[pa.Table, int, int, int], tuple | None], schema: str, names: list[str], types: list) -> DataFrame:
    """Run ``work(table, first row, row of the second block, end)`` on each group of blocked ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in _groups(batches, 3):
            own, y, x = (table.column(c).to_numpy() for c in (3, 2, 1))
            found = []
            for a, z in zip(cuts, [*cuts[1:], table.num_rows], strict=True):
                m = z if x[a] == y[a] else a + int(np.searchsorted(own[a:z], y[a]))
                if m > a and (got := work(table, a, m, z)) is not None:
                    found.append(got)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), type=t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=names)

    return rows.mapInArrow(tidy(run), schema)


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, row-wise: class_id (least key of the group of near-duplicates) and n_links (other documents of similarity 0.8 or more); print: the text's hash."""
    rows = docs.select(text_of(text).alias("text"), F.col(key).cast("long").alias("key"))
    rows = rows.withColumns({"print": F.xxhash64("text"), "row": F.monotonically_increasing_id()})

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Roller()
        for b in slices(batches, 0, 1 << 20):
            sets = shingle_sets(roll, b.column(0).to_pylist())
            full = [s for s in sets if len(s)]
            sig = iter(signatures(full)) if full else iter(())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[1:], pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], type=pa.binary()),
                 pa.array([next(sig).tobytes() if len(s) else None for s in sets], type=pa.binary())],
                names=["key", "print", "row", "set", "sig"],
            )

    signed = settle(rows.mapInArrow(tidy(sign), "key long, print long, row long, set binary, sig binary"))
    whole = signed.filter("set IS NOT NULL")
    # one node a class, named by its least row
    classes = settle(
        whole.groupBy("set").agg(F.min("row").alias("node"), F.min("key").alias("least"), F.count("*").alias("size"), F.min("print").alias("print"), F.min("sig").alias("sig"))
    )

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint64).reshape(-1, BANDS)
                which = np.arange(BANDS, dtype=np.uint64)
                mixed = (keys ^ (which + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
                mixed ^= mixed >> np.uint64(32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((mixed * np.uint64(0xD6E8FEB86659FD93)).ravel().view(np.int64)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(keys))),
                     pa.array(np.repeat(b.column(0).to_numpy(), BANDS))],
                    names=["bucket", "band", "node"],
                )

    banded = classes.select("node", "sig").mapInArrow(tidy(band), "bucket long, band int, node long")
    shared = banded.groupBy("bucket", "band").agg(F.count("*").alias("n")).filter("n > 1")
    postings = settle(banded.join(shared, ["bucket", "band"]))

    def prune(t: pa.Table, a: int, m: int, z: int) -> tuple | None:
        sig = np.frombuffer(b"".join(t.column(6).slice(a, z - a).to_pylist()), dtype=np.uint16).reshape(-1, HASHES)
        node, which = t.column(5).slice(a, z - a).to_numpy(), t.column(4)[a].as_py()
        same = m == z
        left, right = (sig, sig) if same else (sig[: m - a], sig[m - a :])
        if len(right) == 0 or (same and len(left) < 2):
            return None
        i, j = surviving(left, right, which, same)
        label = forest(len(node), i, j if same else j + (m - a))
        tied = np.flatnonzero(label != np.arange(len(node)))
        return (node[tied], node[label[tied]]) if len(tied) else None

    with_sig = postings.join(classes.select("node", "sig"), "node").select("bucket", "band", "node", "sig", "n")
    edges = _mapped(_blocks(with_sig, "bucket", BLOCK), prune, "a long, b long", ["a", "b"], [pa.int64(), pa.int64()])
    coarse = settle(components(edges))

    # exact sets of the classes that have candidates left, from one text of each
    chosen = settle(coarse.join(classes.select("node", "set", "print", "size"), "node"))
    want = chosen.select("print").distinct()
    texts = docs.select(text_of(text).alias("text")).withColumn("print", F.xxhash64("text")).join(_side(want), "print", "left_semi")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Roller()
        for b in slices(batches, 0, 1 << 20):
            sets = shingle_sets(roll, b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(1), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], type=pa.binary()), pa.array([s.tobytes() for s in sets], type=pa.binary())],
                names=["print", "set", "shingles"],
            )

    each = texts.select("text", "print").groupBy("print", F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.min("text").alias("text")).select("text", "print")
    each = each.mapInArrow(tidy(sets_of), "print long, set binary, shingles binary")
    sizes = coarse.groupBy("root").agg(F.count("*").alias("n"))
    exact = chosen.join(sizes, "root").join(each, ["print", "set"]).select("root", "node", "size", "shingles", "n")

    def verify(t: pa.Table, a: int, m: int, z: int) -> tuple | None:
        node, size = (t.column(c).slice(a, z - a).to_numpy() for c in (4, 5))
        sets = [np.frombuffer(x, dtype=np.uint64) for x in t.column(6).slice(a, z - a).to_pylist()]
        same, cut = m == z, m - a
        i, j = linked(sets, sets, True) if same else linked(sets[:cut], sets[cut:], False)
        if not len(i):
            return None
        j = j if same else j + cut
        links = np.bincount(i, weights=size[j], minlength=len(node)) + np.bincount(j, weights=size[i], minlength=len(node))
        label = forest(len(node), i, j)
        some = np.flatnonzero(links)
        return node[some], node[label[some]], links[some].astype(np.int64)

    verified = settle(_mapped(_blocks(exact, "root", EXACT_BLOCK), verify, "a long, b long, links long", ["a", "b", "links"], [pa.int64()] * 3))
    groups = components(verified.select("a", "b"))
    links = verified.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    nodes = classes.select("set", "node", "least", "size").join(groups, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = nodes.groupBy("root").agg(F.min("least").alias("class_id"))
    facts = nodes.join(named, "root").select("set", "class_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    found = whole.select("key", "print", "row", "set").join(facts, "set").select("key", "print", "row", "class_id", "n_links")
    empty = signed.filter("set IS NULL").select("key", "print", "row", F.col("key").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return found.unionByName(empty)


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose key names their group: one document of each group of near-duplicates."""
    found = settle(near_duplicates(docs, text, key))
    gone = found.filter(~F.col("key").eqNullSafe(F.col("class_id"))).select("key", "print").distinct()
    # rows with the key that names the group: of several, one stays
    names = found.filter(F.col("key").eqNullSafe(F.col("class_id")) & (F.col("n_links") > 0)).groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("print")).alias("stay"))
    names = names.filter("n > 1")
    own = docs.withColumns({"\x00print": F.xxhash64(text_of(text)), "\x00key": F.col(key).cast("long")})

    def same(d: DataFrame):
        return (own["\x00print"] == d["print"]) & own["\x00key"].eqNullSafe(d["key"])

    left = own.join(d := _side(gone), same(d), "left_anti")
    if not names.isEmpty():
        several = left.join(d := _side(names.select("key")), left["\x00key"].eqNullSafe(d["key"]), "left_semi")
        once = several.join(d := _side(names.select("key", F.col("stay.print").alias("print"))), same(d), "left_semi").dropDuplicates(["\x00key", "\x00print"])
        left = left.join(d := _side(names.select("key")), left["\x00key"].eqNullSafe(d["key"]), "left_anti").unionByName(once)
    return left.drop("\x00print", "\x00key")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(words[i : i + 4], ' ')) AS s
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 9 * common.n >= 4 * (a.n + b.n)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
class AS (SELECT x, min(y) AS class_id FROM reach GROUP BY x),
links AS (SELECT x, count(*) AS n_links FROM link GROUP BY x)
SELECT w.doc_id, class_id, coalesce(n_links, 0) AS n_links FROM w JOIN class ON class.x = w.doc_id LEFT JOIN links ON links.x = w.doc_id
"""


def op2_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("key").alias("doc_id"), "class_id", "n_links")
