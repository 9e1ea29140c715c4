"""URL filter: rules of hosts and paths, and for the rest a tree of path templates with labelled purity.

The rules decide the urls that they fit and label them for the method. For each host a tree is built over all
urls, segment by segment to the full depth of the paths: a segment of digits, of hex digits, or digits with an ending becomes a typed wildcard;
so does any segment of a node with more than ``MAX_CHILDREN`` different ones that is seen in less than one of ``MAX_CHILDREN`` of the node's urls.
Sibling branches whose distribution of next segments is close (Hellinger) to that of all siblings together, and whose labels
don't speak against it, merge into one, and their children are pooled. A branch of one path is not followed further. The purity of a node is its share of blocked
urls, smoothed with its parent's; a host's is smoothed with that of the whole table. A url without a rule is blocked when its own template holds
labelled urls and its purity reaches ``REJECT``: without labels of its own a template passes, whatever its parents hold.

DataFrame functions only; equal templates are counted before anything is shuffled, the tree is joined level by level and never collected. It is a radix tree: segments that
all paths of a node have in common are passed in one step, so that the number of levels is that of branchings on a way, not of segments. Rows of hot children stay where they are. Nodes are
named by 64-bit hashes of their templates.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, and the verdict of that template (allow, as no rule labels it);
of rules of equal length the first declared wins; an empty table gives no rows; repeated rows each get a row and count each; very long urls are followed
only as far as others share their way; extra columns are kept out of the way by selecting the key and the url.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.llm import common
from scriptloom.llm.common import join_by_key, read, settle

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
MAX_CHILDREN, CLOSE, PURITY_GAP, WEIGHT, REJECT = 50, 0.25, 0.25, 2.0, 0.5
#: Templates are broadcast up to so many characters of hosts and paths; beyond, both sides are shuffled.
BROADCAST_CHARS = 16 << 20


def parts(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(u, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(u, pattern, 2)


def rule_of(rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) for the columns host and path: the longest rule that fits, else null."""
    rule = verdict = None
    for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def typed(segment: Column) -> Column:
    """Wildcards that the segment's own form shows."""
    return (
        F.when(segment.rlike(r"^[0-9]+$"), "{n}")
        .when(segment.rlike(r"^[0-9]+\.[A-Za-z0-9]+$"), F.concat(F.lit("{n}"), F.regexp_extract(segment, r"(\.[A-Za-z0-9]+)$", 1)))
        .when(segment.rlike(r"^[0-9a-f-]{16,}$"), "{x}")
        .otherwise(segment)
    )


def segments(path: Column) -> Column:
    """Typed segments of a path; none for the empty path."""
    return F.transform(F.slice(F.split(path, "/", -1), F.lit(2), F.greatest(F.size(F.split(path, "/", -1)) - 1, F.lit(0))), typed)


def _ends(rest: Column) -> list[Column]:
    """First and last of the ways that lie ahead, as ``lo`` and ``hi``; all others lie between."""
    return [F.min(rest).alias("lo"), F.max(rest).alias("hi")]


def _shared(paths: str) -> tuple[Column, Column]:
    """``common`` (null for none) and ``names``: the segments that all paths of a node have in common, by its ``lo`` and ``hi``."""
    least = F.least(F.size("lo"), F.size("hi"))
    n = F.array_min(F.filter(F.sequence(F.lit(0), least), lambda i: (i == least) | (F.get("lo", i) != F.get("hi", i))))
    n = F.when((F.col(paths) > 1) & (n > 0), n)
    return n.alias("common"), F.concat_ws("/", F.slice("lo", F.lit(1), F.coalesce(n, F.lit(0)))).alias("names")


def _passed(now: DataFrame) -> DataFrame:
    """``now`` (paths with the node they have reached, its ``common`` and ``names``) moved on over the segments that all paths of a node have in common.

    A node of one child changes nothing but the smoothing of its purity, which is repeated for each segment; so a chain of such nodes is one step, however long it is.
    """
    smooth = F.aggregate(F.sequence(F.lit(1), F.col("common")), F.col("purity"), lambda p, _: (F.col("all_bad") + WEIGHT * p) / (F.col("seen") + WEIGHT))
    on = F.col("common").isNotNull()
    return now.withColumns({
        "node": F.when(on, F.xxhash64("node", "names")).otherwise(F.col("node")), "template": F.when(on, F.concat_ws("/", "template", "names")).otherwise(F.col("template")),
        "purity": F.when(on, smooth).otherwise(F.col("purity")), "depth": F.col("depth") + F.coalesce("common", F.lit(0)),
    }).drop("common", "names")


def _grown(now: DataFrame) -> DataFrame:
    """``now`` one branching further down, and over what its new nodes have in common.

    The paths are read twice: counted by the two segments ahead, and joined with the facts of their child. All else is worked out on the counts, each
    table written once: the driver holds the plan of every table that is derived anew.
    """
    ahead = now.withColumns({"s": F.get("segments", F.col("depth")), "b": F.coalesce(F.concat(F.lit("/"), F.get("segments", F.col("depth") + 1)), F.lit(""))})
    sums = lambda *names: [F.sum(c).alias(c) for c in names]
    rest = F.slice("segments", F.col("depth") + 2, F.size("segments") - F.col("depth") - 1)
    cells = settle(ahead.groupBy("node", "s", "b").agg(*sums("n", "bad", "known"), F.count("*").alias("paths"), *_ends(rest)))
    kids = settle(cells.groupBy("node", "s").agg(*sums("n"), F.sum("paths").alias("rows"), F.count("*").alias("cells")))
    tops = settle(kids.groupBy("node").agg(F.sum("n").alias("total"), F.count("*").alias("children")))
    rare = (F.col("children") > MAX_CHILDREN) & (F.col("n") * MAX_CHILDREN < F.col("total"))
    named = kids.join(tops, "node").select("node", "s", "rows", "cells", "total", F.when(rare, "{*}").otherwise(F.col("s")).alias("t"))
    size = kids.agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("rows", "cells") for f in (F.sum, F.max))).first()

    def meet(rows: DataFrame, facts: DataFrame, n: str) -> DataFrame:
        hot = size[f"max_{n}"] > max(size[f"sum_{n}"] // common.HOT_SHARE, common.HOT_ROWS)
        return join_by_key(rows, settle(facts), ["node", "s"], n) if hot else rows.join(facts, ["node", "s"])

    facts = named.select("node", "s", "cells", "t", "total")
    by_end = settle(meet(cells, facts, "cells").groupBy("node", "t", "b", "total").agg(*sums("n", "bad", "known", "paths"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    pooled = by_end.groupBy("node", "b").agg(F.sum("n").alias("pooled"))
    branch = settle(by_end.groupBy("node", "t").agg(*(F.sum(c).alias(f"t_{c}") for c in ("n", "bad", "known", "paths")), F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    every = branch.groupBy("node").agg(F.sum("t_bad").alias("sum_bad"), F.sum("t_known").alias("sum_known"))
    # Bhattacharyya overlap of a branch's next segments with all siblings': 1 - overlap is the squared Hellinger distance
    overlap = (
        by_end.select("node", "t", "b", "total", "n").join(pooled, ["node", "b"]).join(branch.select("node", "t", "t_n"), ["node", "t"])
        .groupBy("node", "t").agg(F.sum(F.sqrt(F.col("n") / F.col("t_n") * F.col("pooled") / F.col("total"))).alias("overlap"))
    )
    gap = F.abs(F.try_divide(F.col("t_bad"), F.col("t_known")) - F.try_divide(F.col("sum_bad"), F.col("sum_known")))
    close = (1 - F.col("overlap") <= CLOSE * CLOSE) & ((F.col("t_known") == 0) | (gap <= PURITY_GAP))
    merged = settle(branch.join(overlap, ["node", "t"]).join(every, "node").withColumn("m", F.when(close, "{~}").otherwise(F.col("t"))).drop("overlap", "sum_bad", "sum_known", "t_n"))
    group = merged.groupBy("node", "m").agg(
        F.count("*").alias("members"), F.min("t").alias("only"), *(F.sum(f"t_{c}").alias(f"m_{c}") for c in ("bad", "known", "paths")), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    )
    group = settle(group.select("node", "m", F.when(F.col("members") == 1, F.col("only")).otherwise(F.col("m")).alias("name"), "m_bad", "m_known", "m_paths", *_shared("m_paths")))
    child = named.select("node", "s", "t", "rows").join(merged.select("node", "t", "m"), ["node", "t"]).join(group, ["node", "m"]).drop("t", "m")
    return _passed(meet(ahead, child, "rows").select(
        "host", "segments", "n", "bad", "known", F.xxhash64("node", "name").alias("node"), F.concat_ws("/", "template", "name").alias("template"),
        ((F.col("m_bad") + WEIGHT * F.col("purity")) / (F.col("m_known") + WEIGHT)).alias("purity"), F.col("m_bad").alias("all_bad"), F.col("m_known").alias("seen"), F.col("m_paths").alias("paths"),
        (F.col("depth") + 1).alias("depth"), "common", "names",
    ))


def template_tree(urls: DataFrame) -> DataFrame:
    """Template, purity and seen (labelled urls) of each (host, segments): ``urls`` has host, segments (typed) and block (true, false or null)."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    leaf = settle(urls.groupBy("host", "segments").agg(F.count("*").alias("n"), count(F.col("block"))("bad"), count(F.col("block").isNotNull())("known")))
    hosts = leaf.groupBy("host").agg(F.sum("bad").alias("all_bad"), F.sum("known").alias("seen"), F.count("*").alias("paths"), *_ends(F.col("segments")))
    hosts = settle(hosts.select("host", "all_bad", "seen", "paths", *_shared("paths")))
    total = hosts.agg(F.coalesce(F.sum("all_bad"), F.lit(0)), F.coalesce(F.sum("seen"), F.lit(0))).first()  # two numbers
    prior = (total[0] + 1) / (total[1] + 2)
    now = join_by_key(leaf, hosts, ["host"], "paths").select(
        "host", "segments", "n", "bad", "known", F.xxhash64("host").alias("node"), F.col("host").alias("template"),
        ((F.col("all_bad") + WEIGHT * prior) / (F.col("seen") + WEIGHT)).alias("purity"), "all_bad", "seen", "paths", F.lit(0).alias("depth"), "common", "names",
    )
    ahead = (F.size("segments") > F.col("depth")) & (F.col("paths") > 1)
    done, now = [], settle(_passed(now))
    while True:
        done.append(now.filter(~ahead))
        now = now.filter(ahead)
        if now.isEmpty():
            break
        now = settle(_grown(now))
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    rest = F.slice("segments", F.col("depth") + 1, F.size("segments"))
    return whole.select("host", "segments", F.concat_ws("/", "template", rest).alias("template"), "purity", "seen")


def judge(pages: DataFrame, rules=RULES, url: str = "url", key: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity and n_labels (of the template) of every row."""
    host, path = parts(url)
    rule, by_rule = rule_of(rules)
    rows = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"rule": rule, "by_rule": by_rule, "segments": segments(F.col("path"))})
    tree = settle(template_tree(rows.select("host", "segments", (F.col("by_rule") == "block").alias("block"))))
    size = tree.agg(F.sum(F.length("host") + F.length("template") + F.length(F.concat_ws("/", "segments")) + 64)).first()[0]
    tree = F.broadcast(tree) if (size or 0) <= BROADCAST_CHARS else tree
    reject = (F.col("seen") > 0) & (F.col("purity") >= REJECT)
    return rows.join(tree, ["host", "segments"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(reject, "block").otherwise("allow")).alias("verdict"),
        "template", F.round("purity", 6).alias("purity"), F.col("seen").alias("n_labels"),
    )


#: Levels of the tree that the SQL has; more than any path of the test tables.
SQL_LEVELS = 6


def _oracle() -> str:
    def typed_sql(x: str) -> str:
        return (f"CASE WHEN regexp_matches({x}, '^[0-9]+$') THEN '{{n}}' WHEN regexp_matches({x}, '^[0-9]+\\.[A-Za-z0-9]+$') THEN '{{n}}' || regexp_extract({x}, '(\\.[A-Za-z0-9]+)$', 1) "
                f"WHEN regexp_matches({x}, '^[0-9a-f-]{{16,}}$') THEN '{{x}}' ELSE {x} END")

    levels = "".join(
        f"""
g{d} AS (SELECT *, segs[{d + 1}] AS s, coalesce('/' || segs[{d + 2}], '') AS b FROM n{d} WHERE len(segs) > {d} AND paths > 1),
k{d} AS (SELECT node, s, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY node) AS total, count(*) OVER (PARTITION BY node) AS children FROM g{d} GROUP BY node, s),
c{d} AS (SELECT node, s, total, CASE WHEN children > {MAX_CHILDREN} AND n * {MAX_CHILDREN} < total THEN '{{*}}' ELSE s END AS t FROM k{d}),
e{d} AS MATERIALIZED (SELECT node, t, b, total, sum(n) AS n, sum(bad) AS bad, sum(known) AS known, count(*) AS paths FROM g{d} JOIN c{d} USING (node, s) GROUP BY ALL),
f{d} AS (SELECT *, sum(n) OVER (PARTITION BY node, t) AS tn, sum(n) OVER (PARTITION BY node, b) AS pn FROM e{d}),
o{d} AS (SELECT node, t, sum(sqrt(n / tn * pn / total)) AS overlap, sum(bad) AS tbad, sum(known) AS tknown, sum(paths) AS tpaths FROM f{d} GROUP BY node, t),
q{d} AS (SELECT *, sum(tbad) OVER (PARTITION BY node) AS abad, sum(tknown) OVER (PARTITION BY node) AS aknown FROM o{d}),
m{d} AS (SELECT *, CASE WHEN 1 - overlap <= {CLOSE * CLOSE} AND (tknown = 0 OR abs(tbad / tknown - abad / aknown) <= {PURITY_GAP}) THEN '{{~}}' ELSE t END AS m FROM q{d}),
h{d} AS (SELECT node, t, CASE WHEN count(*) OVER w = 1 THEN t ELSE m END AS name, sum(tbad) OVER w AS gbad, sum(tknown) OVER w AS gknown, sum(tpaths) OVER w AS gpaths FROM m{d} WINDOW w AS (PARTITION BY node, m)),
n{d + 1} AS MATERIALIZED (SELECT host, segs, n, bad, known, g{d}.node || '/' || name AS node, (gbad + {WEIGHT} * purity) / (gknown + {WEIGHT}) AS purity, gknown AS seen, gpaths AS paths
     FROM g{d} JOIN c{d} ON g{d}.node = c{d}.node AND g{d}.s = c{d}.s JOIN h{d} ON h{d}.node = c{d}.node AND h{d}.t = c{d}.t),"""
        for d in range(SQL_LEVELS)
    )
    done = "\nUNION ALL ".join(f"SELECT host, segs, array_to_string(list_concat([node], segs[{d + 1}:]), '/') AS template, purity, seen FROM n{d} WHERE NOT (len(segs) > {d} AND paths > 1)" for d in range(SQL_LEVELS + 1))
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return rf"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
rules(verdict, rhost, rpath) AS (VALUES {rules}),
best AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS by_rule
  FROM (SELECT DISTINCT host, path FROM u) x JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path),
r AS (SELECT u.*, rule, by_rule, list_transform(string_split(u.path, '/')[2:], lambda x: {typed_sql('x')}) AS segs FROM u LEFT JOIN best ON u.host = best.host AND u.path = best.path),
leaf AS (SELECT host, segs, count(*) AS n, count(*) FILTER (by_rule = 'block') AS bad, count(by_rule) AS known FROM r GROUP BY ALL),
prior AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(known), 0) + 2) AS prior FROM leaf),
hosts AS (SELECT host, (sum(bad) + {WEIGHT} * any_value(prior)) / (sum(known) + {WEIGHT}) AS purity, sum(known) AS seen, count(*) AS paths FROM leaf, prior GROUP BY host),
n0 AS MATERIALIZED (SELECT host, segs, n, bad, known, host AS node, purity, seen, paths FROM leaf JOIN hosts USING (host)),{levels}
tree AS ({done})
SELECT page_id, r.host, path, rule, coalesce(by_rule, CASE WHEN seen > 0 AND purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity, 6) AS purity, seen AS n_labels
FROM r JOIN tree ON r.host = tree.host AND r.segs = tree.segs
"""


ORACLE = _oracle()


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages").select("page_id", "url"))
