"""Benchmark decontamination by templates, in DataFrame functions only.

Texts are canonicalised word by word: numbers, names and units become typed placeholders, other words lose case and
punctuation. Windows of ``SIZE`` canonical words of the benchmark items, each with ``LITERALS`` plain words at least, are joined by hash with those
of every document; of pairs that share enough of them the windows are compared word by word. Windows on one alignment of a document and an item form an occurrence; its slots must be
consistent: a value of the item always stands for the same value of the document. A document holds an item when the
consistent occurrences cover ``COVER`` of the item's windows; where values differ, the item was re-parameterised.

A number is a word with a digit before any letter; a unit is a word of ``UNITS`` after a number; a name is a capitalised
word that follows a word ending in a lower-case letter, comma or semicolon. In a second, wide form every capitalised word
is a name, wherever it stands, and number words are numbers too. Pairs that the first form doesn't find are found by windows of either form, whose
slots are compared without punctuation; a window left with fewer than ``LITERALS`` plain words must keep its names.

Items without an eligible window, short ones among them, are one window of all their words, found word for word without
case and punctuation.

Defined results: null texts hold nothing; items without any plain word (numbers alone, empty) are never found; a null key is a key like any other; equal rows count once; items of equal text are each found; extra columns
take no part; very long texts are read whole; an empty table of either side gives no rows; of equal alignments none is preferred, all count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.llm import common
from scriptloom.llm.common import read, settle, text_of

SIZE, LITERALS, COVER = 5, 2, 0.8
UNITS = "km|m|cm|mm|kg|g|mg|l|ml|h|min|s|ms|mph|kmh|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|metres?|meters?|grams?|litres?|liters?|dollars?|euros?|cents?|percent|degrees?"
#: Windows up to this many are broadcast (about 100 bytes each); beyond, a bitmap of their hashes sieves the documents' ones, and what is left is shuffled.
BROADCAST_WINDOWS, BROADCAST_KEYS = 100_000, 200_000
#: Items without an eligible window are keyed by so many words at most, and broadcast with their documents up to so many characters.
PREFIX, BROADCAST_CHARS = 8, 16 << 20

_ONES = "one|two|three|four|five|six|seven|eight|nine"
_TENS = "twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety"
_NAME, _NUMBER, _UNIT, _CAPITAL = "\x01", "\x02", "\x03", "\x04"
_NUMBER_WORDS = tuple(
    ["zero", *_ONES.split("|"), "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
     "hundred", "thousand", "million", "billion"] + [t + o for t in _TENS.split("|") for o in ("", *_ONES.split("|"))]
)
_UNIT_WORDS = tuple(x for u in UNITS.split("|") for x in ((u[:-2], u[:-1]) if u.endswith("s?") else (u,)))
# marks are put before words by what stands around them; nothing is consumed, so that neighbours don't share a blank
_MARKS = (
    ("(?<= )(?=[^ \\p{L}\\p{N}]*[0-9])", _NUMBER),
    (f"( {_NUMBER}[^ ]* )(?=(?:{UNITS})[^ \\p{{L}}\\p{{N}}]* )", f"$1{_UNIT}"),
    ("(?<=[\\p{Ll},;] )(?=\\p{Lu}\\p{Ll}+[^ \\p{L}]* )", _NAME),
    ("(?<= )(?=[^ \\p{L}\\p{N}\x01-\x03]*\\p{Lu}\\p{Ll}+(?:['\u2019]s)?[^ \\p{L}]* )", _CAPITAL),
)


def marked(text: Column) -> Column:
    """The text's words between single blanks, with a mark before numbers, units, names, and other capitalised words."""
    t = F.regexp_replace(F.translate(text, "\x01\x02\x03\x04", ""), "[\x20\x09-\x0D]+", " ")
    t = F.concat(F.lit(" "), F.trim(t), F.lit(" "))
    for pattern, mark in _MARKS:
        t = F.regexp_replace(t, pattern, mark)
    return t


def _words(joined: Column) -> Column:
    return F.split(F.substring(joined, F.lit(2), F.length(joined) - 2), " ", -1)


def _bare(mark: Column) -> Column:
    """Words of marked text, lower-cased and without punctuation, behind their marks. Words keep their places."""
    return _words(F.lower(F.regexp_replace(mark, "[^\\p{L}\\p{N} \x01-\x04]+", "")))


def _plain(word: Column) -> Column:
    return F.ltrim(word, F.lit("\x01\x02\x03\x04"))


def _first_form(word: Column) -> Column:
    """A placeholder for a slot, else the word."""
    return F.when(word < _CAPITAL, F.left(word, F.lit(1))).otherwise(F.ltrim(word, F.lit(_CAPITAL)))


def _wide_form(words: str) -> Column:
    """The words with placeholders of the wide form: number words and their units, and every capitalised word, too."""
    number = lambda w: w.startswith(_NUMBER) | (~w.startswith(_UNIT) & _plain(w).isin(*_NUMBER_WORDS))
    return F.transform(
        words,
        lambda w, i: F.when(number(w), _NUMBER).when(w.startswith(_CAPITAL), _NAME)
        .when(w.isin(*_UNIT_WORDS) & F.coalesce(number(F.get(words, i - 1)), F.lit(False)), _UNIT).otherwise(_first_form(w)),
    )


def _hashes(word_hashes: str) -> Column:
    """Hash of each window of ``SIZE`` words, from the words' hashes."""
    at = F.sequence(F.lit(0), F.size(word_hashes) - SIZE)
    each = F.transform(at, lambda i: F.xxhash64(*(F.get(word_hashes, i + k) for k in range(SIZE))))
    return F.when(F.size(word_hashes) >= SIZE, each)


def _hashed(rows: DataFrame) -> DataFrame:
    """``rows`` with a column bare (see ``_bare``), and window hashes in both forms: hashes and wide_hashes."""
    rows = rows.withColumns({"h1": F.transform("bare", lambda w: F.xxhash64(_first_form(w))), "h2": F.transform(_wide_form("bare"), lambda w: F.xxhash64(w))})
    return rows.withColumns({"hashes": _hashes("h1"), "wide_hashes": _hashes("h2")}).drop("h1", "h2")


def _prepared(df: DataFrame, key: str, text: str) -> DataFrame:
    rows = df.select(F.col(key).alias("key"), text_of(text).alias("text"))
    rows = rows.select("key", F.xxhash64("text").alias("print"), marked(F.col("text")).alias("mark"))
    return _hashed(rows.select("key", "print", "mark", _bare(F.col("mark")).alias("bare")))


def _worded(rows: DataFrame) -> DataFrame:
    """``rows`` of ``_prepared`` with their words as they are (raw) and in both forms (canon, wide)."""
    return rows.withColumns({"raw": _words(F.col("mark")), "canon": F.transform("bare", _first_form), "wide": _wide_form("bare")})


def _forms(rows: DataFrame, *columns: str) -> DataFrame:
    """A row for each window and form: ``columns``, at, hash, form (0, or 1 for the wide one where it differs), and its canonical words (own), those of the first form (plain) and the raw ones.

    Windows are cut before they become rows, so that a row holds no more than its own words.
    """
    cut = lambda c, i: F.slice(c, i + 1, SIZE).alias(c)
    window = F.transform(
        F.sequence(F.lit(0), F.size("canon") - SIZE),
        lambda i: F.struct(i.alias("at"), F.get("hashes", i).alias("h"), F.get("wide_hashes", i).alias("w"), cut("canon", i), cut("wide", i), cut("raw", i)),
    )
    # (outer: else the optimiser repeats the hashing in a filter)
    each = rows.select(*columns, F.inline_outer(F.when(F.size("canon") >= SIZE, window))).filter("at IS NOT NULL")
    each = each.select("*", F.explode(F.when(F.col("h") == F.col("w"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("form"))
    first = F.col("form") == 0
    return each.select(*columns, "at", F.when(first, F.col("h")).otherwise(F.col("w")).alias("hash"), "form", F.when(first, F.col("canon")).otherwise(F.col("wide")).alias("own"), F.col("canon").alias("plain"), "raw")


def _literals(canon: str | Column) -> Column:
    return F.size(F.filter(canon, lambda w: (w != "") & ~w.isin(_NAME, _NUMBER, _UNIT)))


def value(raw: Column) -> Column:
    """A slot's word without marks, punctuation at its ends, and possessive."""
    return F.regexp_replace(raw, "^[^\\p{L}\\p{N}]+|(?:['\u2019]s)?[^\\p{L}\\p{N}]*$", "")


def item_windows(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """Eligible windows of the items: item, its number of them, place, hash, canonical and raw words."""
    rows = _forms(_worded(_prepared(items, key, text)), "key", "print").select(
        F.col("key").alias("item"), "print", F.col("at").alias("item_at"), "hash", F.col("form").alias("item_form"),
        F.col("plain").alias("item_plain"), F.col("own").alias("item_canon"), F.col("raw").alias("item_raw"),
    ).distinct()
    rows = settle(rows.filter(_literals("item_plain") >= LITERALS).drop("item_plain"))
    count = rows.filter("item_form = 0").groupBy("item", "print").agg(F.count("*").alias("windows"))
    return rows.join(count.withColumnRenamed("item", "i").withColumnRenamed("print", "p"),
                     F.col("item").eqNullSafe(F.col("i")) & (F.col("print") == F.col("p"))).drop("i", "p")


def _whole(text: str = "text") -> Column:
    return F.transform(_bare(marked(text_of(text))), _plain)


def short_items(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """Items of plain words without an eligible window: item, item_print, n (of words), item_words."""
    rows = items.select(F.col(key).alias("item"), F.xxhash64(text_of(text)).alias("item_print"), _whole(text).alias("item_words"),
                        F.transform(_bare(marked(text_of(text))), _first_form).alias("canon")).distinct()
    at = F.sequence(F.lit(1), F.size("canon") - (SIZE - 1))
    eligible = F.when(F.size("canon") >= SIZE, F.exists(at, lambda i: _literals(F.slice("canon", i, SIZE)) >= LITERALS)).otherwise(False)
    return settle(rows.filter(~eligible & (_literals("canon") >= 1)).select("item", "item_print", F.size("item_words").alias("n"), "item_words"))


def _verbatim(docs: DataFrame, items: DataFrame, key: str, text: str) -> DataFrame | None:
    """Rows of ``leaks`` for short items, None if there are none.

    Documents and items meet by the hash of an item's first words, PREFIX at most; then the texts of those documents are searched for the whole items.
    """
    items = items.withColumn("k", F.least("n", F.lit(PREFIX)))
    sizes = sorted(r.k for r in items.select("k").distinct().collect())  # PREFIX numbers at most
    if not sizes:
        return None
    windows = lambda k: F.transform(F.sequence(F.lit(1), F.size("words") - k + 1), lambda i: F.xxhash64(F.lit(k), F.slice("words", i, k)))
    keyed = items.select("item", "item_print", F.xxhash64("k", F.slice("item_words", F.lit(1), F.col("k"))).alias("hash"))
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text_of(text)).alias("print"), _whole(text).alias("words"))
    none = F.array().cast("array<bigint>")
    every = F.concat(*(F.when(F.size("words") >= k, windows(k)).otherwise(none) for k in sizes))
    pairs = _met(rows.select("key", "print", F.explode_outer(F.array_distinct(every)).alias("hash")), keyed, items.count() <= BROADCAST_WINDOWS).select("key", "print", "item", "item_print").distinct()
    words = items.select(F.col("item").alias("i"), F.col("item_print").alias("ip"), F.concat(F.lit(" "), F.array_join("item_words", " "), F.lit(" ")).alias("body"))
    found = pairs.join(words, F.col("item").eqNullSafe(F.col("i")) & (F.col("item_print") == F.col("ip")))
    held = settle(found.groupBy(F.col("key").alias("k"), F.col("print").alias("p")).agg(F.collect_list(F.struct("item", "item_print", "body")).alias("some")))  # items of one document
    size = held.agg(F.count("*"), F.sum(F.aggregate("some", F.lit(0).cast("long"), lambda n, x: n + F.length(x["body"]) + 40))).first()
    side = F.broadcast(held) if (size[1] or 0) <= BROADCAST_CHARS else held
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text_of(text)).alias("print"))
    own = own.join(side, own["key"].eqNullSafe(F.col("k")) & (F.col("print") == F.col("p"))).withColumn("all", F.concat(F.lit(" "), F.array_join(_whole("text"), " "), F.lit(" ")))
    there = F.inline(F.filter("some", lambda x: F.contains(F.col("all"), x["body"])))
    one = F.lit(1).cast("long")
    return own.select("key", "print", there).select("key", "print", "item", "item_print").distinct().select(
        "key", "print", "item", one.alias("windows"), one.alias("matched"), F.lit(1.0).alias("cover"), F.lit(0).cast("long").alias("slots"), F.lit("verbatim").alias("kind"))


def _met(hashed: DataFrame, keyed: DataFrame, few: bool) -> DataFrame:
    """Join by hash: ``keyed`` is broadcast if it is small; else ``hashed`` is sieved, the keys of hashes that many rows have are broadcast, and only the rest is shuffled."""
    if few:
        return hashed.join(F.broadcast(keyed), "hash")
    rows = settle(_sieved(hashed, keyed))
    often = rows.groupBy("hash").agg(F.count("*").alias("n"))
    total = rows.count()
    hot = settle(often.filter(F.col("n") > max(total // common.HOT_SHARE, common.HOT_ROWS)).select("hash"))  # fewer than HOT_SHARE
    mine = keyed.join(F.broadcast(hot), "hash", "left_semi")
    if not 0 < mine.count() <= BROADCAST_WINDOWS:
        return rows.join(keyed, "hash")
    rest = rows.join(F.broadcast(hot), "hash", "left_anti").join(keyed.join(F.broadcast(hot), "hash", "left_anti"), "hash")
    return rows.join(F.broadcast(mine), "hash").unionByName(rest)


def _sieved(hashed: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose hash may be among ``known``, before any shuffle: its first 28 bits are looked up in a bitmap.

    The bitmap is broadcast, in 2^14 rows of 256 longs: 32 MB, however many hashes are known.
    """
    slot, word, bit = "shiftrightunsigned(hash, 50)", "cast(shiftrightunsigned(hash, 42) & 255 AS int)", "cast(shiftrightunsigned(hash, 36) & 63 AS int)"
    words = known.groupBy(F.expr(slot).alias("slot"), F.expr(word).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias("bits"))
    maps = words.groupBy("slot").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))  # 256 entries at most
    bitmap = maps.select("slot", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long"))).alias("bitmap"))
    left = hashed.withColumn("slot", F.expr(slot)).join(F.broadcast(bitmap), "slot")
    return left.filter(F.expr(f"getbit(bitmap[{word}], {bit}) = 1")).drop("slot", "bitmap")


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """key, print (hash of the text), item, windows, matched, cover, slots, kind: a row for each document and item that it holds."""
    of_items = item_windows(items, item_key, text).withColumnRenamed("print", "item_print")
    few = of_items.count() <= BROADCAST_WINDOWS

    def side(df: DataFrame, small: bool) -> DataFrame:
        return F.broadcast(df) if small else df

    # 1. by hashes alone: the pairs that share enough of the item's windows, on narrow rows
    # (outer: else the optimiser repeats the hashing in a filter)
    hashed = _prepared(docs, key, text).select("key", "print", F.explode_outer(F.array_distinct(F.concat("hashes", "wide_hashes"))).alias("hash"))
    shared = _met(hashed, of_items.select("hash", "item", "item_print", "item_at", "windows"), few).drop("hash").distinct()
    pairs = shared.groupBy("key", "print", "item", "item_print", "windows").agg(F.count("*").alias("n"))
    pairs = settle(pairs.filter(F.col("n") >= COVER * F.col("windows")).drop("n", "windows"))
    # 2. the words and slots of those documents
    small = pairs.count() <= BROADCAST_KEYS
    suspects = pairs.select(F.col("key").alias("k"), F.col("print").alias("p")).distinct()
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    own = own.join(side(suspects, small), own["key"].eqNullSafe(F.col("k")) & (F.xxhash64(text_of("text")) == F.col("p")), "left_semi")
    rows = _forms(_worded(_prepared(own, "key", "text")), "key", "print").drop("plain")
    hit = _met(rows, of_items, few).filter(F.col("own") == F.col("item_canon"))
    chosen = pairs.select(*(F.col(c).alias(f"c_{c}") for c in ("key", "print", "item", "item_print")))
    same = [hit["key"].eqNullSafe(F.col("c_key")), hit["print"] == F.col("c_print"), hit["item"].eqNullSafe(F.col("c_item")), hit["item_print"] == F.col("c_item_print")]
    hit = hit.join(side(chosen, small), same, "left_semi")
    slot = F.filter(
        F.arrays_zip(F.col("item_canon").alias("c"), F.col("item_raw").alias("a"), F.col("raw").alias("b")),
        lambda x: x["c"].isin(_NAME, _NUMBER, _UNIT),
    )
    hit = settle(hit.select("key", "print", "item", "item_print", "windows", "item_at", (F.col("at") - F.col("item_at")).alias("shift"),
                            ((F.col("form") == 0) & (F.col("item_form") == 0)).alias("strict"), (_literals("item_canon") >= LITERALS).alias("plain"), slot.alias("slots")))
    first = _held(hit.filter("strict").withColumn("slots", F.transform("slots", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))))
    bare = hit.withColumn("slots", F.transform("slots", lambda x: F.struct(value(x["a"]).alias("a"), value(x["b"]).alias("b"), x["c"].alias("c"))))
    renamed = F.exists("slots", lambda x: (x["c"] == _NAME) & (x["a"] != x["b"]))
    bare = bare.filter(F.col("strict") | F.col("plain") | ~renamed)
    either = _held(bare.withColumn("slots", F.transform("slots", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))))
    known = first.select(*(F.col(c).alias(f"k_{c}") for c in ("key", "print", "item", "item_print")))
    again = [either["key"].eqNullSafe(F.col("k_key")), either["print"] == F.col("k_print"), either["item"].eqNullSafe(F.col("k_item")), either["item_print"] == F.col("k_item_print")]
    found = first.unionByName(either.join(known, again, "left_anti")).drop("item_print")
    short = _verbatim(docs, short_items(items, item_key, text), key, text)
    return found if short is None else found.unionByName(short)


def _held(hit: DataFrame) -> DataFrame:
    """Pairs whose consistent occurrences cover enough windows, from windows that agree."""
    one = hit.groupBy("key", "print", "item", "item_print", "windows", "shift").agg(
        F.collect_set("item_at").alias("places"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots")  # of one item
    )
    values = F.size(F.array_distinct(F.transform("slots", lambda x: x["a"])))
    one = one.filter(values == F.size("slots"))
    every = one.groupBy("key", "print", "item", "item_print", "windows").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("matched"),
        F.flatten(F.collect_list("slots")).alias("slots"),
    )
    changed = F.exists("slots", lambda x: x["a"] != x["b"])
    return every.filter(F.col("matched") >= COVER * F.col("windows")).select(
        "key", "print", "item", "item_print", "windows", "matched", (F.col("matched") / F.col("windows")).alias("cover"),
        F.size("slots").cast("long").alias("slots"), F.when(changed, "reparameterised").otherwise("verbatim").alias("kind"),
    )


def without_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    held = settle(leaks(docs, items, key, item_key, text).select(F.col("key").alias("\x00k"), F.col("print").alias("\x00p")).distinct())
    side = F.broadcast(held) if held.count() <= BROADCAST_KEYS else held
    own = docs.withColumn("\x00print", F.xxhash64(text_of(text)))
    return own.join(side, (own["\x00print"] == side["\x00p"]) & own[key].eqNullSafe(side["\x00k"]), "left_anti").drop("\x00print")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), F.col("windows").alias("n_windows"), F.col("matched").alias("n_matched"),
                        F.col("cover"), F.col("slots").alias("n_slots"), "kind")


def _oracle() -> str:
    # the first form by consuming matches, since that dialect looks neither ahead nor behind: two blanks part words
    steps = (
        (" ([^ \\p{L}\\p{N}]*[0-9][^ ]*) ", " \x02\\1 "), (f"( \x02[^ ]*  )((?:{UNITS})[^ \\p{{L}}\\p{{N}}]*) ", "\\1\x03\\2 "),
        *((("([\\p{Ll},;]  )(\\p{Lu}\\p{Ll}+[^ \\p{L}]*) ", "\\1\x01\\2 "),) * 2),  # twice, for the second of neighbouring names
    )

    def mark(column: str) -> str:
        t = f"regexp_replace({column}, '[\x01-\x04]+', '', 'g')"
        t = f"regexp_replace(' ' || regexp_replace({t}, '[\x20\x09-\x0D]+', '  ', 'g') || ' ', '^ +| +$', ' ', 'g')"
        for pattern, out in steps:
            t = f"regexp_replace({t}, '{pattern}', '{out}', 'g')"
        return t

    def windows(table: str, key: str) -> str:
        return f"""
SELECT key, pos, list_slice(raw, pos + 1, pos + {SIZE}) AS raw, list_slice(canon, pos + 1, pos + {SIZE}) AS canon FROM (
  SELECT key, raw, canon, unnest(range(0, len(canon) - {SIZE - 1})) AS pos FROM (
    SELECT key, string_split(regexp_replace(mark, '^ | $', '', 'g'), '  ') AS raw,
           string_split(lower(regexp_replace(regexp_replace(regexp_replace(mark, '([\x01-\x03])[^ ]*', '\\1', 'g'), '[^\\p{{L}}\\p{{N}} \x01-\x03]+', '', 'g'), '^ | $', '', 'g')), '  ') AS canon
    FROM (SELECT {key} AS key, {mark("coalesce(text, '')")} AS mark FROM {table})))"""

    slots = "list_filter([{'c': i.canon[j], 'a': i.raw[j], 'b': d.raw[j]} for j in range(1, 6)], lambda x: x.c IN (chr(1), chr(2), chr(3)))"
    return f"""
WITH i0 AS ({windows("benchmark", "item_id")}),
i1 AS (SELECT * FROM i0 WHERE len(list_filter(canon, lambda w: w <> '' AND w NOT IN (chr(1), chr(2), chr(3)))) >= {LITERALS}),
i AS (SELECT *, count(*) OVER (PARTITION BY key) AS windows FROM i1),
d AS ({windows("documents", "doc_id")}),
hit AS (SELECT d.key AS doc, i.key AS item, i.windows, i.pos, d.pos - i.pos AS shift, {slots} AS slots FROM d JOIN i ON d.canon = i.canon),
pair AS (SELECT DISTINCT doc, item, shift, s.a AS a, s.b AS b FROM (SELECT doc, item, shift, unnest(slots) AS s FROM hit)),
bad AS (SELECT doc, item, shift FROM pair GROUP BY ALL HAVING count(DISTINCT a) < count(*)),
good AS (SELECT * FROM hit ANTI JOIN bad USING (doc, item, shift)),
total AS (SELECT doc, item, windows, count(DISTINCT pos) AS matched FROM good GROUP BY ALL),
slot AS (SELECT doc, item, count(*) AS slots, bool_or(a <> b) AS changed FROM pair ANTI JOIN bad USING (doc, item, shift) GROUP BY doc, item)
SELECT doc AS doc_id, item AS item_id, windows AS n_windows, matched AS n_matched, matched / windows AS cover, coalesce(slots, 0) AS n_slots,
       CASE WHEN changed THEN 'reparameterised' ELSE 'verbatim' END AS kind
FROM total LEFT JOIN slot USING (doc, item) WHERE matched >= {COVER} * windows
"""


ORACLE = _oracle()
