"""Usage logs and cost: rollups by script and model, a price book as a table, and cost estimates by step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptloom.functions.parse import cache_tokens

RATES = ("input", "output", "cache_write", "cache_read")
PRICE_BOOK = "ordinal int, model string, input double, output double, cache_write double, cache_read double"
#: A price book of tiers, in USD a million tokens; callers give their own.
TIERS = ((0, "large", 15.0, 75.0, 18.75, 1.50), (1, "medium", 3.0, 15.0, 3.75, 0.30), (2, "small", 0.8, 4.0, 1.0, 0.08))
DEFAULT_MODEL = "medium"
#: Rows of a price book that are broadcast; beyond, the join shuffles.
BOOK_ROWS = 10_000

USAGE_SCHEMA = T.StructType([
    T.StructField(n, T.StringType())
    for n in ("Timestamp", "Script Name", "Items", "Status", "Cache", "Tokens Sent", "Tokens Response", "Cache Creation Tokens", "Cache Read Tokens", "Estimated Cost ($)")
])


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """The usage log (CSV) with typed columns; numbers that aren't are 0, times that aren't are null."""
    raw = spark.read.schema(USAGE_SCHEMA).option("header", True).csv(path)
    number = lambda c: F.coalesce(F.col(c).try_cast("long"), F.lit(0))
    return raw.select(
        F.try_to_timestamp("Timestamp", F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"), F.coalesce("Script Name", F.lit("unknown")).alias("script"), F.col("Items").alias("model"), F.col("Status").alias("status"),
        number("Tokens Sent").alias("tokens_in"), number("Tokens Response").alias("tokens_out"),
        F.greatest(number("Cache Creation Tokens"), cache_tokens(F.coalesce("Cache", F.lit("")), "Created")).alias("cache_created"),
        F.greatest(number("Cache Read Tokens"), cache_tokens(F.coalesce("Cache", F.lit("")), "Read")).alias("cache_read_tokens"),
    )


def priced(usage: DataFrame, book: DataFrame, families: Sequence[tuple[Sequence[str], str]] = (), default: str = DEFAULT_MODEL, model: str = "model") -> DataFrame:
    """``usage`` with the four rates and ``matched_by``: the model's own entry, else the first whose name it contains, else a family's, else the default's.

    Models are matched once each, so that the ranked match is done on distinct names.
    """
    names = usage.select(F.coalesce(F.col(model), F.lit("")).alias("m_")).distinct()
    side = F.broadcast(book) if book.count() <= BOOK_ROWS else book
    low = F.lower("m_")
    rank = F.when(F.col("m_") == F.col("model"), 0).when(F.contains(low, F.lower("model")), 1)
    for i, (parts, target) in enumerate(families):
        fits = F.lit(True)
        for p in parts:
            fits = fits & F.contains(low, F.lit(p))
        rank = rank.when(fits & (F.col("model") == target), 2 + i)
    rank = rank.when(F.col("model") == default, 2 + len(families))
    best = names.join(side.withColumnRenamed("model", "model"), rank.isNotNull(), "left").withColumn("rank_", rank)
    w = W.partitionBy("m_").orderBy("rank_", "ordinal")
    best = best.withColumn("n_", F.row_number().over(w)).filter("n_ = 1")
    by = F.when(F.col("rank_") == 0, "exact").when(F.col("rank_") == 1, "contains").when(F.col("rank_") < 2 + len(families), "family").otherwise("default")
    best = best.select("m_", *(F.col(r).alias(f"rate_{r}") for r in RATES), by.alias("matched_by"))
    return usage.join(best, F.coalesce(usage[model], F.lit("")) == best["m_"], "left").drop("m_")


def cost(tokens_in: Column, tokens_out: Column, created: Column, read: Column, net: bool = True) -> Column:
    """USD of one call; ``net`` charges the input without what the cache took, else all of it."""
    plain = F.greatest(F.lit(0), tokens_in - read - created) if net else tokens_in
    million = lambda n, rate: n / 1_000_000 * F.col(f"rate_{rate}")
    return million(plain, "input") + million(tokens_out, "output") + million(created, "cache_write") + million(read, "cache_read")


def rollup(usage: DataFrame, by: Sequence[Sequence[str]], measures: Sequence[str], digits: int = 6) -> DataFrame:
    """Sums of the measures and number of calls for each set of grouping columns, in one pass (GROUPING SETS)."""
    columns = list(dict.fromkeys(c for g in by for c in g))
    out = usage.groupingSets([[F.col(c) for c in g] for g in by], *(F.col(c) for c in columns))
    return out.agg(F.count("*").alias("calls"), *(F.round(F.sum(m), digits).alias(m) for m in measures))


#: Steps of an estimate: share of the text that goes in, of that which comes out, and whether the cache serves it.
STEPS = (
    ("format", 1.0, 1.1, "fresh"), ("headers", 1.0, 0.1, "fresh"), ("core extraction", 1.0, 0.25, "write"), ("emphasis", 1.0, 0.1, "read"),
    ("references", 1.0, 0.1, "read"), ("summary", 0.2, 0.05, "read"), ("terms", 1.0, 0.1, "read"),
)


def estimates(tokens: DataFrame, rates: dict[str, float], key: str = "doc_id", n: str = "n_tokens", steps: Sequence[tuple] = STEPS) -> DataFrame:
    """key, step, tokens and cost of each step for texts of ``n`` tokens."""
    plan = F.explode(F.array(*(F.struct(F.lit(i).alias("ordinal"), F.lit(s).alias("step"), F.lit(a).alias("in_"), F.lit(b).alias("out_"), F.lit(m).alias("mode")) for i, (s, a, b, m) in enumerate(steps))))
    rows = tokens.select(key, n, plan.alias("s")).select(key, "s.ordinal", "s.step", "s.mode", F.floor(F.col(n) * F.col("s.in_")).alias("tokens_in"), F.floor(F.col(n) * F.col("s.in_") * F.col("s.out_")).alias("tokens_out"))
    rate = F.when(F.col("mode") == "write", rates["cache_write"]).when(F.col("mode") == "read", rates["cache_read"]).otherwise(rates["input"])
    return rows.withColumn("cost", F.col("tokens_in") / 1e6 * rate + F.col("tokens_out") / 1e6 * rates["output"])


def allocate(total: Column, shares: Column) -> Column:
    """Array of whole numbers of ``total`` in proportion to ``shares`` (an array), cut off; equal parts where they sum to 0."""
    whole = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shares, lambda x: F.when(whole > 0, (total * x / whole).cast("int")).otherwise((total / F.size(shares)).cast("int")))


TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def log_rows(calls: DataFrame, at: Column | None = None) -> DataFrame:
    """Calls (script, model, status, tokens and rates) as rows of the usage log: time of writing as text, cost on the full input with four digits."""
    c = F.col
    full = cost(c("tokens_in"), c("tokens_out"), c("created"), c("read"), net=False)
    return calls.select(
        F.date_format(at if at is not None else F.current_timestamp(), TIME_FORMAT).alias("Timestamp"), c("script").alias("Script Name"), c("model").alias("Items"), c("status").alias("Status"),
        F.when(c("read") > 0, F.format_string("Yes (Read %d)", c("read").cast("long"))).when(c("created") > 0, F.format_string("Yes (Created %d)", c("created").cast("long"))).otherwise("No").alias("Cache"),
        *(c(x).cast("long").cast("string").alias(n) for x, n in (("tokens_in", "Tokens Sent"), ("tokens_out", "Tokens Response"), ("created", "Cache Creation Tokens"), ("read", "Cache Read Tokens"))),
        F.format_string("%.4f", full).alias("Estimated Cost ($)"),
    )


def since(usage: DataFrame, start: Column, ts: str = "ts") -> DataFrame:
    """Rows from ``start`` on; rows without a time are dropped."""
    return usage.filter(F.col(ts).isNotNull() & (F.col(ts) >= start))
