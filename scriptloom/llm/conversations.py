"""Conversations with the wrong structure: faults counted, the cheapest repair found, the repaired turns written.

A conversation's roles should begin like ``(s?(ua)+)?``: a system turn at most, then user and assistant in turn. The edits of a repair form a
lattice of nodes (rows read, state of the grammar), which is never built: Dijkstra's search grows it from the start, with the key (cost,
edits so far as text), and stops at the first accepting node of the end that it takes out. The text of edits tells its node, so that keys never
tie, and the search is exact in costs and in the least text of equal costs. Over LONG rows texts of edits aren't strings, but nodes of a
tree that are compared where they part, so that memory stays in proportion to the rows.

Faults and places are found by Spark; the search sees one byte a row. Conversations pass through tasks as sorted streams: what a task holds of a
conversation are a byte and an edit of each row, the length of the text of edits that its result carries anyway, never its texts.

Defined results: null roles and texts are one space, ids are whole numbers. Rows of a conversation go by turn, null turns first; those of one turn by role,
then text (repeated rows lie side by side). A null id is a conversation of its own. A role counts by its first character; an empty one fits nowhere. A row's text may
be of any length. Of no rows after damage: zeros, no edits, the hash of the empty text. No conversations: no rows. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptloom.llm.common import read, settle, tidy

#: Costs of edits; a truncated row that stays costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANK_ROW, COPY_ROW, CUT_ROW = 1, 2, 3
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn. EXPECTED: the state after the role that may come; accepting: the first and the last.
EXPECTED, ACCEPTING = (2, 2, 3, 2), (True, False, False, True)
NAMES = {2: "user", 3: "assistant"}
#: Kinds of roles (0: others), and the state that a kind leads to from each state.
KINDS = {"u": 1, "a": 2, "s": 3}
KEPT = ((None,) * 4, (2, 2, None, 2), (None, None, 3, None), (1, None, None, None))
LEGAL = ("su", "ua", "au")
#: Rows from which edits so far are kept as a tree; conversations up to SHORT rows are remembered by their bytes.
LONG, SHORT = 4096, 64
_SEEN = r"[^\x20\x09-\x0D]"
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"


class Edits:
    """A text of edits as a node of a tree: equal beginnings are the same nodes, and jumps lead to where two of them part."""

    __slots__ = ("before", "jump", "size", "letter")

    def __init__(self, before: Edits | None = None, letter: str = ""):
        self.before, self.letter = before, letter
        self.size = before.size + 1 if before else 0
        if before is None:
            self.jump = self
        else:
            far = before.jump
            self.jump = far.jump if before.size - far.size == far.size - far.jump.size else before

    def __add__(self, letter: str) -> Edits:
        return Edits(self, letter)

    def _first(self, size: int) -> Edits:
        node = self
        while node.size > size:
            node = node.jump if node.jump.size >= size else node.before
        return node

    def __lt__(self, other: Edits) -> bool:
        size = min(self.size, other.size)
        a, b = self._first(size), other._first(size)
        if a is b:
            return self.size < other.size
        while a.before is not b.before:
            a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.before, b.before)
        return a.letter < b.letter

    def __str__(self) -> str:
        out, node = [], self
        while node.before is not None:
            out.append(node.letter)
            node = node.before
        return "".join(reversed(out))


def cheapest(rows: bytes, long: int = LONG) -> tuple[int, str]:
    """(cost, edits) of the cheapest repair of rows (kind of role * 4 + fault), the least text of equal costs."""
    done = bytearray(4 * len(rows) + 4)
    heap = [(0, Edits() if len(rows) > long else "", 0, 0)]
    while True:
        cost, edits, at, state = heappop(heap)
        if done[4 * at + state]:
            continue
        done[4 * at + state] = 1
        if at == len(rows):
            if ACCEPTING[state]:
                return cost, str(edits)
        else:
            kind, fault = divmod(rows[at], 4)
            heappush(heap, (cost + DELETE, edits + "D", at + 1, state))
            if fault not in (BLANK_ROW, COPY_ROW):
                stay = cost + (TRUNCATED if fault == CUT_ROW else 0)
                if (new := KEPT[kind][state]) is not None:
                    heappush(heap, (stay, edits + "K", at + 1, new))
                heappush(heap, (stay + REROLE, edits + "R", at + 1, EXPECTED[state]))
        if not done[4 * at + EXPECTED[state]]:
            heappush(heap, (cost + INSERT, edits + "I", at, EXPECTED[state]))


@lru_cache(1 << 16)
def remembered(rows: bytes) -> tuple[int, str]:
    return cheapest(rows)


def lines(table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None) -> DataFrame:
    """A table of all rows with their ``place`` in the conversation, kind of role, fault, and whether turn and pair of roles are new and legal.

    Rows for which the column ``present`` is false are there only to name their conversation.
    """
    rows = table.select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"), (F.col(present) if present else F.lit(True)).alias("present"),
    )
    order = W.partitionBy("conv").orderBy(F.desc("present"), F.asc_nulls_first("turn"), "role", "text")
    pair = F.concat(F.left(F.lag("role").over(order), F.lit(1)), F.left("role", F.lit(1)))
    rows = rows.withColumns({
        "place": F.row_number().over(order).cast("long"), "illegal": F.col("present") & F.coalesce(~pair.isin(*LEGAL), F.lit(False)),
        "fresh": F.col("present") & F.col("turn").isNotNull() & ~F.coalesce(F.col("turn") == F.lag("turn").over(order), F.lit(False)),
    })
    again = W.partitionBy("conv", "present", "role", F.sha2("text", 256)).orderBy("place")
    start = F.left("role", F.lit(1))
    kind = F.when(start == "u", 1).when(start == "a", 2).when(start == "s", 3).otherwise(0)
    fault = F.when(~F.col("text").rlike(_SEEN), BLANK_ROW).when(F.row_number().over(again) > 1, COPY_ROW).when(~F.col("text").rlike(_ENDED), CUT_ROW).otherwise(0)
    return settle(rows.withColumns({"fault": fault, "code": (kind * 4 + fault).cast("int")}))


def counted(rows: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal of every conversation of ``lines``."""
    here = F.col("present")
    turn = F.when(here, F.col("turn"))
    of = lambda f: F.count_if(here & (F.col("fault") == f))
    return rows.groupBy("conv").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_if("fresh"), F.lit(0)).cast("long").alias("gaps"), of(BLANK_ROW).alias("blank"), of(COPY_ROW).alias("duplicate"),
        of(CUT_ROW).alias("truncated"), F.count_if("illegal").alias("illegal"),
    )


def _cuts(column: pa.Array) -> np.ndarray:
    """Where a column of sorted ids changes."""
    missing, ids = column.is_null().to_numpy(zero_copy_only=False), column.fill_null(0).to_numpy(zero_copy_only=False)
    return np.flatnonzero((ids[1:] != ids[:-1]) | (missing[1:] != missing[:-1])) + 1


def plans(rows: DataFrame, long: int = LONG) -> DataFrame:
    """A table of conv, cost, audit (the edits' initials) of the conversations of ``lines`` that have rows."""
    narrow = rows.filter("present").select("conv", "place", "code").repartition("conv").sortWithinPartitions("conv", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, codes, begun = None, bytearray(), False
        solve = lambda b: remembered(bytes(b)) if len(b) <= SHORT else cheapest(bytes(b), long)
        for batch in batches:
            out = []
            code = batch.column(2).to_numpy().astype(np.uint8).tobytes()
            ends = [0, *_cuts(batch.column(0)).tolist(), batch.num_rows]
            for a, z in zip(ends, ends[1:], strict=False):
                if a == z:
                    continue
                own = batch.column(0)[a].as_py()
                if begun and own != conv:
                    out.append((conv, *solve(codes)))
                    codes = bytearray()
                conv, begun = own, True
                codes += code[a:z]
            yield _batch(out)
        if begun:
            yield _batch([(conv, *solve(codes))])

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["conv", "cost", "audit"])

    return settle(narrow.mapInArrow(tidy(run), "conv long, cost long, audit string"))


_REPAIRED = pa.schema([("conv", pa.int64()), ("at", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv, at, edit (K, R or I), role, text: the turns of each conversation after the edits of ``plans``; rows of a conversation lie together in their order."""
    texts = rows.filter("present").select("conv", "place", "role", "text", F.lit(None).cast("string").alias("audit"))
    heads = found.select("conv", F.lit(0).cast("long").alias("place"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
    both = texts.unionByName(heads).repartition("conv").sortWithinPartitions("conv", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, edit, at, state = None, "", 0, 0, 0

        def inserted(out: dict) -> None:
            nonlocal edit, state, at
            while edit < len(audit) and audit[edit] == "I":
                state = EXPECTED[state]
                for name, x in zip(_REPAIRED.names, (conv, at, "I", NAMES[state], ""), strict=True):
                    out[name].append(x)
                edit, at = edit + 1, at + 1

        for batch in batches:
            out = {n: [] for n in _REPAIRED.names}
            for own, place, role, text, plan in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place == 0:
                    inserted(out)  # after the last row of the one before
                    conv, audit, edit, at, state = own, plan, 0, 0, 0
                    continue
                inserted(out)
                letter = audit[edit]
                edit += 1
                if letter == "D":
                    continue
                state = EXPECTED[state] if letter == "R" else KEPT[KINDS.get(role[:1], 0)][state]
                for name, x in zip(_REPAIRED.names, (conv, at, letter, NAMES[state] if letter == "R" else role, text), strict=True):
                    out[name].append(x)
                at += 1
            yield pa.RecordBatch.from_pydict(out, schema=_REPAIRED)
        out = {n: [] for n in _REPAIRED.names}
        inserted(out)
        yield pa.RecordBatch.from_pydict(out, schema=_REPAIRED)

    return both.mapInArrow(tidy(run), "conv long, at long, edit string, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """conv, sha256 of the lines ``role:text`` of ``repaired``, of the conversations that have some; a stream, no text is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha = None, None
        for batch in batches:
            out = []
            for own, at, role, text in zip(*(batch.column(j).to_pylist() for j in (0, 1, 3, 4)), strict=True):
                if at == 0:
                    if sha:
                        out.append((conv, sha.hexdigest()))
                    conv, sha = own, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            yield _batch(out)
        if sha:
            yield _batch([(conv, sha.hexdigest())])

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string())], names=["conv", "sha256"])

    return turns.mapInArrow(tidy(run), "conv long, sha256 string")


def repair(rows: DataFrame, long: int = LONG) -> DataFrame:
    """A row for each conversation of ``lines``: the counts, the cheapest repair, and the hash of what it gives."""
    found = plans(rows, long)
    hashes = digests(repaired(rows, found)).withColumnRenamed("conv", "conv_")
    whole = counted(rows).join(found.withColumnRenamed("conv", "conv_"), F.col("conv").eqNullSafe(F.col("conv_")), "left").drop("conv_")
    whole = whole.join(hashes, F.col("conv").eqNullSafe(F.col("conv_")), "left").drop("conv_")
    return whole.withColumns({"cost": F.coalesce("cost", F.lit(0)).cast("long"), "audit": F.coalesce("audit", F.lit("")), "sha256": F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest()))})


def damaged(table: DataFrame) -> DataFrame:
    """``conversations`` with the test's damage, by the hash of id and turn: rows that are dropped are there as not ``present``, repeated ones twice."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = table.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("d"))
    copies = F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("copy", copies).select(
        "conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"), (F.col("d") != 0).alias("present"),
    )


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(damaged(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), present="present")
    return repair(rows).withColumnsRenamed({"conv": "conv_id", "sha256": "repaired_sha256"})


_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
#: A key of the search as text: the cost in nine digits, then the edits.
_PLUS = lambda k, cost, letter: f"(lpad((left({k}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({k}, 10) || '{letter}')"
_IN = {0: "k0", 1: "k1", 2: f"least(k2, {_PLUS('k0', 5, 'I')}, {_PLUS('k1', 5, 'I')}, {_PLUS('k3', 5, 'I')})", 3: f"least(k3, {_PLUS('k2', 5, 'I')})"}


def _step(state: int) -> str:
    """The best key in ``state`` after a row, from the keys before it, an insertion or none included."""
    stay = "(CASE WHEN fault = 3 THEN 5 ELSE 0 END)"
    ways = [_PLUS(f"i{state}", 2, "D")]
    kept = {1: [("i0", "s")], 2: [("i0", "u"), ("i1", "u"), ("i3", "u")], 3: [("i2", "a")]}.get(state, [])
    ways += [f"(CASE WHEN fault IN (0, 3) AND r = '{r}' THEN {_PLUS(k, stay, 'K')} END)" for k, r in kept]
    ways += [f"(CASE WHEN fault IN (0, 3) THEN {_PLUS(k, f'1 + {stay}', 'R')} END)" for k in {2: ("i0", "i1", "i3"), 3: ("i2",)}.get(state, ())]
    return f"least({', '.join(ways)}, NULL) AS k{state}"


ORACLE = f"""
WITH RECURSIVE d AS MATERIALIZED (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS d
    FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations)),
w AS (
    SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
           CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM d JOIN (VALUES (0), (1)) c(copy) ON d <> 0 AND (copy = 0 OR d = 3)),
n AS (SELECT *, left(role, 1) AS r, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM w),
f AS MATERIALIZED (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 2
                   WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 3 ELSE 0 END AS fault,
           coalesce(lag(r) OVER (PARTITION BY conv_id ORDER BY place) || r NOT IN ('su', 'ua', 'au'), false) AS illegal
    FROM n),
p AS (
    SELECT conv_id, 0::BIGINT AS place, '000000000' AS k0, NULL::VARCHAR AS k1, NULL::VARCHAR AS k2, NULL::VARCHAR AS k3 FROM (SELECT DISTINCT conv_id FROM f)
    UNION ALL
    SELECT conv_id, place, {", ".join(_step(s) for s in range(4))}
    FROM (SELECT f.conv_id, f.place, f.fault, f.r, {", ".join(f"{sql} AS i{s}" for s, sql in _IN.items())} FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.place = p.place + 1)),
e AS MATERIALIZED (SELECT conv_id, least(arg_max(k0, place), arg_max(coalesce({_IN[3]}, 'x'), place)) AS k FROM p GROUP BY conv_id),
a AS (SELECT conv_id, left(k, 9)::BIGINT AS cost, substr(k, 10) AS audit FROM e),
l AS (SELECT conv_id, unnest(string_split(audit, '')) AS letter, generate_subscripts(string_split(audit, ''), 1) AS i FROM a WHERE audit <> ''),
m AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS place, count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id ORDER BY i) AS o FROM l),
o AS (
    SELECT m.conv_id, m.o, m.letter, f.role, f.text, (first_value(m.letter = 'K' AND f.r = 's') OVER (PARTITION BY m.conv_id ORDER BY m.o))::BIGINT AS s
    FROM m LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND f.place = m.place AND m.letter <> 'I' WHERE m.letter <> 'D'),
h AS (
    SELECT conv_id, sha256(string_agg((CASE WHEN letter = 'K' THEN role WHEN (o - s) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || (CASE WHEN letter = 'I' THEN '' ELSE text END), chr(10) ORDER BY o)) AS sha
    FROM o GROUP BY conv_id),
c AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 1)::BIGINT AS blank, count(*) FILTER (fault = 2)::BIGINT AS duplicate,
           count(*) FILTER (fault = 3)::BIGINT AS truncated, count(*) FILTER (illegal)::BIGINT AS illegal FROM f GROUP BY conv_id)
SELECT x.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) x LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM x.conv_id
LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM x.conv_id
"""
