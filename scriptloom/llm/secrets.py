"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Every text is scanned for assigned values, access keys, long hexadecimal runs, and for long mixed tokens that no
pattern names. The hashes of all candidates are aggregated over the corpus by distinct owners and repositories: a
value held by ``WIDE_OWNERS`` owners or ``WIDE_REPOSITORIES`` repositories or more is a copied example, whoever owns them; any other that looks live is a
credential of its owner. Mixed tokens of the latter sort are added to the spans as kind ``owned``, unless they overlap
a span that the patterns found. Values themselves are never stored, only their SHA-256.

Offsets are code points, end exclusive. Defined results: null text is empty and has no spans; null owners and
repositories count as one value each; very long texts are scanned whole; repeated rows each get a row and count as one repository; extra columns are left out by selecting what is
needed; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptloom.llm.common import join_by_key, read, settle, text_of


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Kinds in their order: name, pattern, group that is the value, shortest value. ``owned`` is a candidate until its owners are counted.
ASSIGN = (
    "(" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key") + ")"
    + r"""["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)"""
)
KINDS = (
    ("assign", ASSIGN, 2, 6),
    ("access", "AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
    ("owned", "[A-Za-z0-9+/_=-]{20,}", 0, 20),
)
OWNED = len(KINDS) - 1
WIDE_OWNERS, WIDE_REPOSITORIES, LEAST_DISTINCT = 3, 10, 8
PLACEHOLDER = "example|sample|dummy|changeme|placeholder|redacted|xxxx|0000|1234567"


def looks_live(value: Column) -> Column:
    """Letters and digits, enough different characters, and no placeholder's word."""
    return (
        value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= LEAST_DISTINCT)
        & ~F.lower(value).rlike(PLACEHOLDER)
    )


def _matches(text: Column, kind: int) -> Column:
    """Array of the kind's matches in order: text before it, own length, whether it counts, hash, live."""
    _, pattern, group, shortest = KINDS[kind]
    zipped = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
        F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("pre"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"),
    )

    def one(x: Column, i: Column) -> Column:
        live = looks_live(x["v"])
        fits = F.length(x["v"]) >= shortest
        return F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), x["pre"].alias("pre"), F.length(x["m"]).alias("len"),
            (fits & live if kind == OWNED else fits).alias("ok"), F.sha2(x["v"].cast("binary"), 256).alias("hash"), live.alias("live"),
        )

    every = F.transform(F.filter(zipped, lambda x: x["m"].isNotNull()), one)
    none = F.array().cast("array<struct<kind:int,i:int,pre:int,len:int,ok:boolean,hash:string,live:boolean>>")
    return F.when(text.rlike(pattern), every).otherwise(none)


def candidates(docs: DataFrame, text: str, key: str, owner: str, repository: str) -> DataFrame:
    """A narrow table of one row per document: its matches of all kinds, without any text."""
    body = text_of(text)
    return settle(
        docs.select(
            F.col(key).alias("key"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
            F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"),
            F.monotonically_increasing_id().alias("row"), F.concat(*(_matches(body, k) for k in range(len(KINDS)))).alias("found"),
        )
    )


def copied(fact: Column) -> Column:
    """Whether a value (a struct with n_owners and n_repositories) is widely copied."""
    return (fact["n_owners"] >= WIDE_OWNERS) | (fact["n_repositories"] >= WIDE_REPOSITORIES)


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_owners, n_repositories and n (matches) of the candidates that count; distinct holders first, so a hot value is one row each."""
    each = found.filter("ok").groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = each.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("n").alias("n"))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Per document: key, base and spans (arrays of kind, start, end, n_owners, live), found by patterns, and with the owned ones."""
    table = candidates(docs, text, key, owner, repository)
    found = table.select("row", "owner", "repository", F.inline("found"))
    # offsets: running lengths of what lies before, per document and kind; both windows use one shuffle by document
    by_kind = W.partitionBy("row", "kind").orderBy("i")
    spans = found.repartition("row").withColumn("end", F.sum(F.col("pre") + F.col("len")).over(by_kind)).filter("ok")
    spans = spans.withColumn("start", F.col("end") - F.col("len"))
    base = F.col("kind") < OWNED
    order = W.partitionBy("row").orderBy("start", "kind")
    before = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(0, W.unboundedFollowing))
    overlaps = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))
    spans = spans.withColumn("overlaps", overlaps).filter(base | ~F.col("overlaps"))
    spans = settle(spans.select("row", "kind", "start", "end", "hash", "live"))
    held = join_by_key(spans, settle(ownership(found)), ["hash"], "n")
    held = held.filter(base | (F.col("live") & ~copied(F.struct("n_owners", "n_repositories"))))
    span = F.struct("start", "kind", "end", "n_owners", "n_repositories", "live")
    lists = held.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))  # those of one document
    return table.select("row", "key").join(lists, "row", "left").select(
        "key", F.coalesce("spans", F.array().cast(lists.schema["spans"].dataType)).alias("spans")
    )


def _joined(spans: Column) -> Column:
    name = F.array(*(F.lit(k[0]) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    count = lambda f: F.size(F.filter("spans", f)).cast("long")
    of_kind = lambda k: lambda s: s["kind"] == k
    return found.select(
        F.col("key").alias("doc_id"),
        *(count(of_kind(k)).alias(f"n_{KINDS[k][0]}") for k in range(OWNED)),
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"] < OWNED)).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        count(lambda s: s["live"] & ~copied(s)).alias("n_live"),
        count(copied).alias("n_copied"),
        *(F.coalesce(F.array_max(f"spans.{c}"), F.lit(0)).alias(c.replace("n_", "most_")) for c in ("n_owners", "n_repositories")),
    )


def _oracle() -> str:
    arms = "\nUNION ALL ".join(
        f"""SELECT doc_id, source, {k} AS kind, regexp_extract_all(text, '{p.replace("'", "''")}', 0) AS m,
        string_split_regex(text, '{p.replace("'", "''")}') AS p, regexp_extract_all(text, '{p.replace("'", "''")}', {g}) AS v, {n} AS shortest FROM d"""
        for k, (_, p, g, n) in enumerate(KINDS)
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
a AS ({arms}),
e AS (SELECT doc_id, source, kind, shortest, i, m[i] AS m, v[i] AS v, length(p[i]) AS pre
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM a)),
o AS (SELECT *, sum(pre + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop,
             regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= {LEAST_DISTINCT}
             AND NOT regexp_matches(lower(v), '{PLACEHOLDER}') AS live FROM e),
s AS (SELECT doc_id, source, kind, stop - length(m) AS start, stop, sha256(v) AS hash, live FROM o
      WHERE length(v) >= shortest AND (kind < {OWNED} OR live)),
n AS (SELECT hash, count(DISTINCT source) AS owners, count(DISTINCT (source, doc_id)) AS repositories FROM s GROUP BY hash),
k AS (SELECT s.*, owners, repositories, owners >= {WIDE_OWNERS} OR repositories >= {WIDE_REPOSITORIES} AS wide FROM s JOIN n USING (hash)
      WHERE kind < {OWNED} OR (owners < {WIDE_OWNERS} AND repositories < {WIDE_REPOSITORIES} AND NOT EXISTS (
        SELECT 1 FROM s b WHERE b.doc_id = s.doc_id AND b.kind < {OWNED} AND b.start < s.stop AND b.stop > s.start))),
t AS (SELECT *, CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'owned' END || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS word FROM k),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
             coalesce(string_agg(word, ',' ORDER BY start, kind) FILTER (kind < {OWNED}), '') AS base, string_agg(word, ',' ORDER BY start, kind) AS spans,
             count(*) FILTER (live AND NOT wide) AS n_live, count(*) FILTER (wide) AS n_copied, max(owners) AS most_owners, max(repositories) AS most_repositories FROM t GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(most_owners, 0) AS most_owners, coalesce(most_repositories, 0) AS most_repositories
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""


ORACLE = _oracle()
