"""Documents and their artifacts as tables: whole files in, a table partitioned by kind out.

An artifact is a row (stem, kind, text); kinds are file suffixes. Everything reads through Spark, so a path may be in any
store that it knows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptloom.functions import text as X


def read_texts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, text, length of whole files, without a byte-order mark."""
    raw = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    p = F.col("_metadata.file_path")
    return raw.select(p.alias("path"), F.url_decode(F.element_at(F.split(p, "/"), -1)).alias("name"), F.regexp_replace("value", "^﻿", "").alias("text"), F.col("_metadata.file_size").alias("length"))


def checked(files: DataFrame) -> DataFrame:
    """``files``; an empty one stops the job."""
    return files.withColumn("text", F.when(F.trim("text") != "", F.col("text")).otherwise(F.raise_error(F.concat(F.lit("empty input: "), F.col("path")))))


def listing(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """Names and sizes of files, sorted, without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.url_decode(F.element_at(F.split("path", "/"), -1)).alias("name"), "length", "modificationTime").orderBy("name")


def preferred(candidates: DataFrame, key: str, places: Sequence[str], place: str = "place") -> DataFrame:
    """Of each key's rows the one in the first of ``places`` that has it."""
    rank = F.array_position(F.array(*map(F.lit, places)), F.col(place))
    w = W.partitionBy(key).orderBy("r_")
    return candidates.withColumn("r_", rank).filter("r_ > 0").withColumn("n_", F.row_number().over(w)).filter("n_ = 1").drop("r_", "n_")


def latest(files: DataFrame, name: str = "name") -> DataFrame:
    """The highest version of each base name (``base`` is 0, ``base_vN`` is N; validated copies don't count)."""
    stem = F.regexp_replace(F.col(name), r"\.[A-Za-z0-9]+$", "")
    rows = files.withColumns({"stem_": stem}).filter(~F.col("stem_").endswith("_validated"))
    return rows.groupBy(F.regexp_replace("stem_", r"_v\d+$", "").alias("base")).agg(F.max_by(F.struct(*files.columns), X.version(F.col("stem_"))).alias("f"), F.max(X.version(F.col("stem_"))).alias("version")).select("base", "version", "f.*")


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """term: lines of a file, lower case, without comments and blanks."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("term")).filter("term <> '' AND NOT startswith(term, '#')")


def skip_words(spark: SparkSession, path: str) -> DataFrame:
    return lexicon(spark, path).select(X.normalize_word(F.col("term")).alias("word")).filter("word <> ''").distinct()


def status(stems: DataFrame, artifacts: DataFrame, kinds: Sequence[str], stem: str = "stem") -> DataFrame:
    """stem, kind, present of every expected kind."""
    wanted = stems.select(stem, F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    have = artifacts.select(stem, "kind").distinct().withColumn("present", F.lit(True))
    return wanted.join(have, [stem, "kind"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def base_names(*listings: DataFrame, name: str = "name") -> DataFrame:
    """Distinct logical keys of several listings."""
    out = None
    for one in listings:
        keys = one.select(X.logical_key(F.regexp_replace(F.col(name), r"\.[A-Za-z0-9]+$", "")).alias("base"))
        out = keys if out is None else out.unionByName(keys)
    return out.distinct().orderBy("base")


# -- sinks

_ENDING = r"\.[A-Za-z0-9]+$"


def write_artifacts(artifacts: DataFrame, path: str, mode: str = "append") -> None:
    """The artifact table, a folder for each kind."""
    artifacts.select("stem", "text", "kind").write.mode(mode).partitionBy("kind").parquet(path)


def read_artifacts(spark: SparkSession, path: str, *kinds: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.filter(F.col("kind").isin(*kinds)) if kinds else df


def append_usage(usage: DataFrame, path: str) -> None:
    usage.write.mode("append").option("header", True).csv(path)


def with_front_matter(docs: DataFrame, fields: dict[str, Column], text: str = "text") -> DataFrame:
    """``docs`` whose texts begin with the front matter; an older block is replaced."""
    return docs.withColumn(text, F.concat(X.front_matter(fields), X.strip_front_matter(F.col(text))))


def markdown_report(rows: DataFrame, by: str, columns: Sequence[str], order: str) -> DataFrame:
    """by, report: the rows of each group as a Markdown table."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in columns)), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns) + "\n"
    lists = rows.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("x"))
    return lists.select(by, F.concat(F.lit(head), F.array_join(F.transform("x", lambda r: r["l"]), "\n")).alias("report"))


def package(artifacts: DataFrame, kinds: Sequence[tuple[str, ...]], stem: str = "stem") -> DataFrame:
    """The rows that a package of each stem holds: of alternatives the first that exists."""
    names = F.array(*(F.array(*map(F.lit, k)) for k in kinds))
    wanted = artifacts.select(stem).distinct().select(stem, F.posexplode(names).alias("slot", "alts")).select(stem, "slot", F.posexplode("alts").alias("rank", "kind"))
    w = W.partitionBy(stem, "slot").orderBy("rank")
    got = artifacts.join(wanted, [stem, "kind"]).withColumn("n_", F.row_number().over(w)).filter("n_ = 1")
    return got.drop("n_", "slot", "rank")


def moves(files: DataFrame, target: str, taken: DataFrame, name: str = "name") -> DataFrame:
    """path, target: where files would move, one after the other by path, each to the first name that is free; all targets differ and none is taken.

    Of files with one name the first keeps it if it isn't taken; the others get the numbers from 1 on that neither a taken name nor the own name of another
    file has. A number is found from ranks alone: before the i-th used number u there are u - i free ones, so the j-th free number is j and as many as have fewer than j before them.
    """
    split = lambda c: (F.regexp_replace(c, _ENDING, ""), F.regexp_extract(c, f"({_ENDING})", 1))
    stem, ending = split(F.col(name))
    rows = files.select("path", F.col(name).alias("name_"), stem.alias("s_"), ending.alias("e_"))
    known = taken.select(F.col(name).alias("name_")).distinct()
    reserved = known.unionByName(rows.select("name_")).distinct()
    number = reserved.select(F.regexp_extract("name_", rf"^(.*)_([1-9]\d{{0,17}})({_ENDING})?$", 1).alias("s_"), F.nullif(F.regexp_extract("name_", rf"_([1-9]\d{{0,17}})(?:{_ENDING})?$", 1), F.lit("")).cast("long").alias("u_"), split(F.col("name_"))[1].alias("e_"))
    own = W.partitionBy("s_", "e_").orderBy("u_")
    used = number.filter("u_ IS NOT NULL").select("s_", "e_", (F.col("u_") - F.row_number().over(own) + 1).alias("at_"), F.lit(0).alias("kind_"), F.lit(None).cast("string").alias("path"))
    rows = rows.join(known.withColumn("t_", F.lit(True)), "name_", "left")
    j = F.row_number().over(W.partitionBy("s_", "e_").orderBy("path")) - F.when(F.col("t_"), 0).otherwise(1)
    asked = rows.select("s_", "e_", j.cast("long").alias("at_"), F.lit(1).alias("kind_"), "path")
    before = F.count_if(F.col("kind_") == 0).over(W.partitionBy("s_", "e_").orderBy("at_", "kind_", "path").rowsBetween(W.unboundedPreceding, 0))
    both = used.unionByName(asked).withColumn("free_", F.col("at_") + before).filter("kind_ = 1")
    free = F.when(F.col("at_") == 0, F.col("s_")).otherwise(F.concat_ws("_", "s_", F.col("free_").cast("string")))
    return both.select("path", F.concat(F.lit(target.rstrip("/") + "/"), free, F.col("e_")).alias("target"))


def outdated(files: DataFrame, name: str = "name") -> DataFrame:
    """path and name of the versions below the highest of each base name: what a cleanup would delete."""
    stem = F.regexp_replace(F.col(name), r"\.[A-Za-z0-9]+$", "")
    rows = files.withColumns({"base_": F.regexp_replace(stem, r"_v\d+$", ""), "v_": X.version(stem), "s_": stem}).filter(~F.col("s_").endswith("_validated"))
    top = rows.groupBy("base_").agg(F.max("v_").alias("top_"))
    return rows.join(top, "base_").filter("v_ < top_").select("path", name)


def write_audits(audits: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON line a row: its key and audit."""
    audits.select(F.to_json(F.struct(*audits.columns)).alias("value")).write.mode(mode).text(path)


def report_header(title: Column, counts: Mapping[str, Column]) -> Column:
    """The head of a Markdown report: its title and counters, a line each."""
    return F.concat(F.lit("# "), title, F.lit("\n\n"), F.concat_ws("\n", *(F.concat(F.lit(f"- {k}: "), v.cast("string")) for k, v in counts.items())), F.lit("\n"))
