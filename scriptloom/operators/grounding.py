"""Grounding: do the terms, topics and quotes of an artifact occur in its source, and how well?

The claims of a document travel together and meet its text once, which is normalised once for all of them. A claim that is null or blank is
in no text: its ratio is 0.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptloom.functions import similarity
from scriptloom.functions import text as X
from scriptloom.sources.tables import by_key, scratch

#: Fixed values: (EXACT, PARTIAL, WEAK) bounds of two ratios each; the third holds if either reaches it.
TERM_BANDS, TOPIC_BANDS = ((0.95, 0.90), (0.85, 0.75), (0.75, 0.65)), ((0.65, 0.55), (0.45, 0.35), (0.25, 0.20))
QUOTE_EXACT, QUOTE_PARTIAL = 0.95, 0.80
QUOTE_WORDS, DEFINITION_WORDS, DESCRIPTION_WORDS, SECTION_OVERLAP, REFERENCE_RATIO = 15, 20, 40, 0.60, 0.90


#: Claims of one document that travel as one row; further ones are further rows, so that no row grows without bound.
TOGETHER = 256


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(X.words(F.coalesce(text, F.lit(""))), 1, n), " ")


def match(claims: DataFrame, docs: DataFrame, probes: Mapping[str, Column | str], doc: str = "doc_id", text: str = "text", of_text: Mapping[str, Column] | None = None, raw: bool = False) -> DataFrame:
    """``claims`` of documents that there are, with a ratio in [0, 1] for each of ``probes`` (names of new columns, and what is looked for): 1 where it is contained after normalising.

    Texts are shuffled once, whatever the number of claims and probes. With ``raw`` what stands in the raw text has 1 too. ``of_text`` are further columns, worked out once a text from the column ``text_``.
    """
    names, extra = list(probes), dict(of_text or {})
    asked = claims.withColumn("probes_", F.array(*(F.col(c) if isinstance(c, str) else c for c in probes.values())))
    w = W.partitionBy(doc)
    slot = F.floor((F.row_number().over(w.orderBy(F.lit(0))) - 1) / TOGETHER)
    lists = asked.withColumn("slot_", slot).groupBy(doc, "slot_").agg(F.collect_list(F.struct(*(c for c in asked.columns if c != doc))).alias("claims_"))
    both = lists.join(by_key(docs.select(doc, F.col(text).alias("text_")), doc), doc)
    needles = F.flatten(F.transform("claims_", lambda c: c["probes_"]))
    both = both.select(doc, "claims_", similarity.ratios(raw=raw)(needles, "text_").alias("ratios_"), *(c.alias(n) for n, c in extra.items()))
    each = both.select(doc, F.posexplode("claims_").alias("n_", "claim_"), "ratios_", *extra)
    found = {n: F.get("ratios_", F.col("n_") * len(names) + i) for i, n in enumerate(names)}
    return each.select(*(F.col(doc) if c == doc else F.col("claim_")[c].alias(c) for c in claims.columns), *(c.alias(n) for n, c in found.items()), *extra)


#: Claims without an inner word are looked for in every text up to so many; beyond, texts and claims meet by GRAM characters first.
EVERYWHERE, GRAM = 10_000, 3


def exact_grounding(claims: DataFrame, docs: DataFrame, claim: str, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """Pairs of claims and documents that contain them word for word.

    A claim's longest word with white space on both sides is a whole word of every text that contains the claim, and keys the
    join: words meet on rows of key, hash and word alone, and the texts are joined once, for the pairs that are left. Claims without such a word are broadcast and looked
    for in every text if they are EVERYWHERE at most; if there are more, their first GRAM characters are their key in the same way, and only shorter ones, of which there are few different ones, are broadcast.
    """
    inner = F.filter(F.slice(X.pieces(F.col(claim)), 2, F.greatest(F.size(X.pieces(F.col(claim))) - 2, F.lit(0))), lambda w: w != "")
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = claims.withColumn("w_", longest)
    inside = F.contains(F.col(text), F.col(claim))
    found = _keyed_pairs(keyed.filter("w_ IS NOT NULL"), docs, X.words(F.col(text)), text, doc).filter(inside)
    bare = keyed.filter("w_ IS NULL").drop("w_")
    if bare.count() > EVERYWHERE:
        grams = F.transform(F.sequence(F.lit(1), F.length(text) - (GRAM - 1)), lambda i: F.substr(F.col(text), i, F.lit(GRAM)))
        long = bare.filter(F.length(claim) >= GRAM).withColumn("w_", F.left(claim, F.lit(GRAM)))
        found = found.unionByName(_keyed_pairs(long, docs, F.when(F.length(text) >= GRAM, grams), text, doc).filter(inside))
        bare = bare.filter(F.length(claim) < GRAM)
        few = bare.select(claim).distinct()  # of short claims the different ones meet the texts, then all with those words
        met = docs.join(F.broadcast(few), inside)
        return found.unionByName(met.withColumnRenamed(claim, "same_").join(bare, F.col("same_") == F.col(claim)).drop("same_"))
    return found.unionByName(docs.join(F.broadcast(bare), inside))


def _keyed_pairs(key: DataFrame, docs: DataFrame, words: Column, text: str, doc: str) -> DataFrame:
    """Documents beside the claims whose key ``w_`` is one of their ``words``."""
    each = docs.select(F.col(doc).alias("d_"), F.xxhash64(text).alias("h_"), F.explode(F.array_distinct(words)).alias("w_"))
    pairs = each.join(key.select("w_").distinct(), "w_", "left_semi").distinct().join(key, "w_").drop("w_")
    have = docs.withColumn("h2_", F.xxhash64(text))
    return have.join(pairs, have[doc].eqNullSafe(pairs["d_"]) & (have["h2_"] == pairs["h_"])).drop("d_", "h_", "h2_")


def band(first: Column, second: Column, bands: tuple) -> Column:
    (a, b), (c, d), (e, f) = bands
    return (
        F.when((first >= a) & (second >= b), "EXACT").when((first >= c) & (second >= d), "PARTIAL").when((first >= e) | (second >= f), "WEAK").otherwise("FAIL")
    )


def quote_result(ratio: Column) -> Column:
    return F.when(ratio >= QUOTE_EXACT, "VALID").when(ratio >= QUOTE_PARTIAL, "PARTIAL").otherwise("INVALID")


def quotes_grounded(quotes: DataFrame, docs: DataFrame, doc: str = "doc_id", quote: str = "quote", text: str = "text") -> DataFrame:
    """quotes with ratio and result, by their first words; a null or blank one is INVALID."""
    got = match(quotes, docs, {"ratio": first_words(F.col(quote), QUOTE_WORDS)}, doc, text)
    return got.withColumn("result", quote_result(F.col("ratio")))


def terms_grounded(terms: DataFrame, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """terms (term, definition) with both ratios and EXACT, PARTIAL, WEAK or FAIL; what is null or blank has the ratio 0."""
    got = match(terms, docs, {"term_ratio": "term", "definition_ratio": first_words(F.col("definition"), DEFINITION_WORDS)}, doc, text)
    return got.withColumn("result", band(F.col("term_ratio"), F.col("definition_ratio"), TERM_BANDS))


def topics_grounded(topics: DataFrame, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """topics (name, description, section_text) with the better of similarity and shared keywords, the result, and whether the sections fit; what is null or blank has the ratio 0."""
    probe = first_words(F.col("description"), DESCRIPTION_WORDS)
    got = match(topics, docs, {"name_ratio": "name", "description_ratio": probe}, doc, text, {"keys_": X.keywords(F.col("text_"))})
    keys = lambda c: X.keywords(F.coalesce(c, F.lit("")))
    got = got.withColumns({
        "name_ratio": F.greatest("name_ratio", X.grounded_share(keys(F.col("name")), F.col("keys_"))),
        "description_ratio": F.greatest("description_ratio", X.grounded_share(keys(probe), F.col("keys_"))),
        "section_ratio": X.grounded_share(keys(probe), keys(F.col("section_text"))),
    })
    return got.drop("keys_").withColumns({
        "result": band(F.col("name_ratio"), F.col("description_ratio"), TOPIC_BANDS), "sections_fit": F.col("section_ratio") >= SECTION_OVERLAP,
    })


def counts(results: DataFrame, by: str, names: tuple[str, ...], result: str = "result") -> DataFrame:
    """How many of each result, and the accuracy: the share in percent of the first two."""
    each = [F.count_if(F.col(result) == n).alias(n.lower()) for n in names]
    return results.groupBy(by).agg(*each, F.round(100 * F.count_if(F.col(result).isin(*names[:2])) / F.count("*"), 6).alias("accuracy"))


def references_kept(references: DataFrame, docs: DataFrame, doc: str = "doc_id", quote: str = "quote") -> DataFrame:
    """References from REFERENCE_RATIO on; of documents where none is left, all of them."""
    got = match(references, docs, {"ratio": quote}, doc)
    some = F.max(F.col("ratio") >= REFERENCE_RATIO).over(W.partitionBy(doc))
    return got.withColumn("any_", some).filter((F.col("ratio") >= REFERENCE_RATIO) | ~F.col("any_")).drop("any_")


def anti_quotes(quotes: DataFrame, known: DataFrame, quote: str = "quote", known_quote: str = "quote") -> DataFrame:
    """Quotes that equal none of the known ones after normalising."""
    return quotes.withColumn("n_", X.normalize(F.col(quote))).join(known.select(X.normalize(F.col(known_quote)).alias("n_")).distinct(), "n_", "left_anti").drop("n_")


def keyword_pairs(docs: DataFrame, items: DataFrame, least: float = 0.5, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """doc, item, ratio: pairs where the document has at least the share ``least`` of the item's keywords.

    Texts are read once, into a table of their keywords that items have. Such a document has one of the item's rarest keywords, as many of them as it may lack and
    one more; pairs that share one of those meet the document's own keywords, so that common keywords make no pairs.
    """
    wanted = items.select(item, X.keywords(F.col(text)).alias("w_")).filter(F.size("w_") > 0)
    words = wanted.select(item, F.size("w_").alias("n_"), F.explode("w_").alias("k"))
    every = words.select("k").distinct()
    each = docs.select(doc, F.explode(X.keywords(F.col(text))).alias("k")).join(every, "k", "left_semi")
    spark = docs.sparkSession
    each.write.parquet(path := scratch(spark, "keywords"))
    each = spark.read.schema(each.schema).parquet(path)
    often = each.groupBy("k").agg(F.count("*").alias("f_"))
    rank = F.row_number().over(W.partitionBy(item).orderBy(F.coalesce("f_", F.lit(0)), "k"))
    rare = words.join(often, "k", "left").withColumn("r_", rank).filter(F.col("r_") <= F.col("n_") - F.ceil(F.col("n_") * least) + 1).select(item, "k")
    pairs = each.join(rare, "k").select(doc, item).distinct().join(wanted, item)
    own = spark.read.schema(each.schema).parquet(path).groupBy(doc).agg(F.collect_set("k").alias("k_"))  # a document's own keywords, no more than items have
    return pairs.join(own, doc).select(doc, item, X.grounded_share(F.col("w_"), F.col("k_")).alias("ratio")).filter(F.col("ratio") >= least)
