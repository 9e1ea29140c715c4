"""Settings and their rules: a table of values against a table of ranges, kinds and orders."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """Thresholds of the engine; the defaults are fixed values."""

    fuzzy_threshold: float = 0.85
    fuzzy_early_stop: float = 0.98
    fuzzy_prefix: int = 20
    chunk_size: int = 1500
    chunk_overlap: int = 200
    context_min_words: int = 5
    context_max_words: int = 30
    unique_words: int = 7
    fuzzy_auto_apply: float = 0.95
    fuzzy_review: float = 0.90
    fuzzy_reject: float = 0.85
    max_iterations: int = 5
    stall_threshold: float = 0.20
    mismatch_tolerance: float = 0.015
    lookahead: int = 10
    opening_share: float = 0.14
    closing_share: float = 0.06
    qa_share: float = 0.10
    abstract_share: float = 0.03
    abstract_min_words: int = 150
    summary_words: int = 650
    transcript_min_words: int = 1500
    blog_min_words: int = 800
    chars_per_token: int = 4
    budget_margin: float = 0.8
    usage_warning: float = 0.9
    max_stalled: int = 2
    fuzzy_hallucination: float = 0.85
    extracts_min_share: float = 0.04
    extracts_target_share: float = 0.07
    extracts_words: int = 150
    extracts_words_from: int = 1000
    extracts_words_least: int = 50
    extracts_chars: int = 500
    key_terms_chars: int = 100
    blog_chars: int = 1000
    abstract_chars: int = 50
    temperature_strict: float = 0.0
    temperature_analysis: float = 0.2
    temperature_balanced: float = 0.3
    temperature_creative: float = 0.4
    tokens_formatting: int = 32_000
    tokens_summary: int = 32_000
    tokens_extraction: int = 8192
    tokens_audit: int = 2000
    tokens_headers: int = 32_000
    timeout_formatting: int = 1200
    timeout_summary: int = 900
    timeout_default: int = 300


#: Shares, ratios and temperatures: from 0 to 1, both allowed. All other settings have to be positive.
RANGES = tuple((f.name, 0, 1) for f in fields(Settings) if f.type == "float")
#: (smaller, larger, whether they may be equal)
ORDERS = (
    ("fuzzy_threshold", "fuzzy_early_stop", True), ("chunk_overlap", "chunk_size", False), ("context_min_words", "context_max_words", False), ("fuzzy_reject", "fuzzy_review", True),
    ("fuzzy_review", "fuzzy_auto_apply", True), ("extracts_min_share", "extracts_target_share", True),
)
#: Shares that leave less than half for the rest if they sum to more than this.
PARTS, MOST_PARTS = ("opening_share", "closing_share", "qa_share"), 0.5


#: (name, low, high): beyond, a setting is allowed but doubtful
DOUBTS = (("chunk_size", 500, 10_000), ("transcript_min_words", 100, 100_000), ("blog_min_words", 100, 10_000), ("abstract_min_words", 50, 1_000), ("summary_words", 100, 5_000),
          *((f.name, 1, 200_000) for f in fields(Settings) if f.name.startswith("tokens_")), *((f.name, 10, 86_400) for f in fields(Settings) if f.name.startswith("timeout_")))
#: settings that count something
WHOLE = tuple(f.name for f in fields(Settings) if f.type == "int" and not f.name.startswith("timeout_"))
MOST_TOKENS, LEAST_TIMEOUT = 200_000, 10


def model_violations(models: DataFrame, book: DataFrame) -> DataFrame:
    """rule, severity, name, message: models (name, model, max_tokens, timeout) that the price book lacks, and limits that can't be or are doubtful."""
    known = models.join(book.select(F.col("model").alias("m_")).distinct(), F.col("model") == F.col("m_"), "left")
    row = lambda rule, severity, bad, message: F.when(bad, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), message.alias("message")))
    tokens, timeout = F.col("max_tokens"), F.col("timeout")
    found = F.array_compact(F.array(
        row("model", "error", F.col("m_").isNull(), F.concat(F.lit("no price for "), F.coalesce("model", F.lit("null")))),
        row("tokens", "error", tokens.isNull() | (tokens <= 0), F.lit("not above 0")), row("tokens", "warning", tokens > MOST_TOKENS, F.lit("above what models take")),
        row("timeout", "error", timeout.isNull() | (timeout <= 0), F.lit("not above 0")), row("timeout", "warning", (timeout > 0) & (timeout < LEAST_TIMEOUT), F.lit("very short")),
    ))
    return known.select("name", F.inline(found))


def path_violations(paths: DataFrame) -> DataFrame:
    """rule, severity, name, message of paths (name, exists, folder, writable, needed): a needed one that is missing or no folder is an error."""
    bad = (F.when(~F.col("exists"), F.struct(F.when(F.col("needed"), "error").otherwise("warning").alias("severity"), F.lit("missing").alias("message")))
           .when(~F.col("folder"), F.struct(F.lit("error").alias("severity"), F.lit("no folder").alias("message")))
           .when(~F.col("writable"), F.struct(F.lit("warning").alias("severity"), F.lit("not writable").alias("message"))))
    return paths.withColumn("b_", bad).filter("b_ IS NOT NULL").select(F.lit("path").alias("rule"), "b_.severity", "name", "b_.message")


def doubts(spark: SparkSession, settings: Settings | dict) -> DataFrame:
    """rule, name, message of settings that are allowed but unusual, and of counts that aren't whole numbers."""
    given = settings if isinstance(settings, dict) else asdict(settings)
    number = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
    values = spark.createDataFrame([(n, number(v)) for n, v in given.items()], "name string, value double")
    usual = spark.createDataFrame([(n, float(a), float(z)) for n, a, z in DOUBTS], "name string, low double, high double")
    out = values.join(F.broadcast(usual), "name").filter(~F.col("value").between(F.col("low"), F.col("high"))).select(F.lit("usual").alias("rule"), "name", F.format_string("outside [%s, %s]", "low", "high").alias("message"))
    shares = values.filter(F.col("name").isin(*PARTS)).agg(F.sum("value").alias("s")).filter(F.col("s") > MOST_PARTS)
    shares = shares.select(F.lit("shares").alias("rule"), F.lit(PARTS[0]).alias("name"), F.format_string("parts sum to %s", F.round("s", 6)).alias("message"))
    whole = values.filter(F.col("name").isin(*WHOLE) & (F.col("value") != F.floor("value"))).select(F.lit("whole").alias("rule"), "name", F.lit("not a whole number").alias("message"))
    return out.unionByName(whole).unionByName(shares)


def set_violations(sets: DataFrame, known: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """rule, severity, name, message of settings that are sets (name, values as an array): a missing one is an error, an empty one a warning; values that ``known`` lacks for the name are errors."""
    allowed = F.create_map(*(x for k, v in (known or {}).items() for x in (F.lit(k), F.array(*map(F.lit, v))))) if known else F.lit(None).cast("map<string,array<string>>")
    rows = sets.withColumns({"ok_": allowed[F.col("name")], "odd_": F.array_except(F.coalesce("values", F.array().cast("array<string>")), F.coalesce(allowed[F.col("name")], F.array().cast("array<string>")))})
    bad = (F.when(F.col("values").isNull(), F.struct(F.lit("error").alias("severity"), F.lit("no set").alias("message")))
           .when(F.size("values") == 0, F.struct(F.lit("warning").alias("severity"), F.lit("empty").alias("message")))
           .when(F.col("ok_").isNotNull() & (F.size("odd_") > 0), F.struct(F.lit("error").alias("severity"), F.concat(F.lit("unknown: "), F.array_join(F.array_sort("odd_"), ", ")).alias("message"))))
    return rows.withColumn("b_", bad).filter("b_ IS NOT NULL").select(F.lit("set").alias("rule"), "b_.severity", "name", "b_.message")


def missing_files(wanted: DataFrame, listing: DataFrame, name: str = "name", file: str = "file") -> DataFrame:
    """rule, severity, name, message of files that settings name (name, file) and a listing (name) lacks."""
    have = listing.select(F.col(name).alias(file)).distinct()
    return wanted.join(have, file, "left_anti").select(F.lit("file").alias("rule"), F.lit("warning").alias("severity"), "name", F.concat(F.lit("missing: "), F.coalesce(F.col(file), F.lit("null"))).alias("message"))


def violations(spark: SparkSession, settings: Settings | dict) -> DataFrame:
    """rule, name, message of every rule that the settings break."""
    given = settings if isinstance(settings, dict) else asdict(settings)
    text = lambda v: str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
    rows = spark.createDataFrame([(0, f.name, text(given.get(f.name))) for f in fields(Settings)], "profile int, name string, value string")
    return table_violations(rows).drop("profile")


def table_violations(rows: DataFrame, profile: str = "profile") -> DataFrame:
    """profile, rule, name, message of every rule that a table of settings (profile, name, value as text) breaks: one profile is one set of them.

    Names that there are no rules for count as positive numbers. The rules are a few rows and broadcast; an order is checked within the profile.
    """
    spark = rows.sparkSession
    values = rows.select(F.col(profile).alias("profile"), "name", F.expr("try_cast(value AS double)").alias("value"))
    values = values.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    ranges = F.broadcast(spark.createDataFrame([(n, float(a), float(b)) for n, a, b in RANGES], "name string, low double, high double"))
    orders = F.broadcast(spark.createDataFrame(list(ORDERS), "name string, other string, equal boolean"))
    no_number = values.filter("value IS NULL").select("profile", F.lit("number").alias("rule"), "name", F.lit("not a number").alias("message"))
    out = values.join(ranges, "name").filter(~F.col("value").between(F.col("low"), F.col("high")))
    out = out.select("profile", F.lit("range").alias("rule"), "name", F.format_string("%s is not in [%s, %s]", "value", "low", "high").alias("message"))
    positive = values.join(ranges, "name", "left_anti").filter("value <= 0").select("profile", F.lit("positive").alias("rule"), "name", F.format_string("%s", "value").alias("message"))
    pair = values.join(orders, "name").join(values.select("profile", F.col("name").alias("other"), F.col("value").alias("most")), ["profile", "other"]).filter("value > most OR (value = most AND NOT equal)")
    pair = pair.select("profile", F.lit("order").alias("rule"), "name", F.concat(F.when(F.col("equal"), "above ").otherwise("not below "), F.col("other")).alias("message"))
    whole = values.filter(F.col("name").isin(*WHOLE) & (F.col("value") != F.floor("value"))).select("profile", F.lit("whole").alias("rule"), "name", F.lit("not a whole number").alias("message"))
    return no_number.unionByName(out).unionByName(positive).unionByName(pair).unionByName(whole)
