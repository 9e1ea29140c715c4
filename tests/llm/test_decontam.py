from __future__ import annotations

import re

import pytest

from scriptloom.llm import decontam

ITEMS = [
    (0, "A train leaves Paris with 120 people and Anna counts 45 km of track, then Anna walks 3 hours home."),
    (1, "the quick brown fox jumps over the lazy dog near the old river bank today"),
    (2, "too short item"), (3, None), (4, "1 2 3 4 5 6 7 8"), (5, "the quick brown fox jumps over the lazy dog near the old river bank today"),
]
DOCS = [
    (10, "intro words here. A train leaves London with 77 people and Maria counts 9 km of track, then Maria walks 12 hours home. And more."),
    (11, "intro words here. A train leaves London with 77 people and Maria counts 9 km of track, then Bob walks 12 hours home. And more."),
    (12, "Yes the QUICK brown fox; jumps over the lazy dog near the old river bank today!"), (13, "the quick brown fox jumps"), (14, None), (15, ""), (None, ITEMS[1][1]), (16, "1 2 3 4 5 6 7 8 9"),
    (12, "Yes the QUICK brown fox; jumps over the lazy dog near the old river bank today!"), (17, "word " * 30_000 + ITEMS[1][1]), (18, "word " * 300),
]


def windows(text):
    """Canonical and raw windows by a loop over the words."""
    words = re.sub("[\x01-\x03]+", "", text or "").split()
    canon, previous, kinds = [], "", []
    for w in words:
        if re.match(r"^[^\W\d_]*$", "") and re.match(r"^(?:[^\w]|_)*[0-9]", w):
            kinds.append("n")
        elif kinds and kinds[-1] == "n" and re.match(f"^(?:{decontam.UNITS})(?:[^\\w]|_)*$", w):
            kinds.append("u")
        elif previous and re.search(r"[a-zß-öø-ÿ,;]$", previous) and re.match(r"^[A-ZÀ-Þ][a-zß-öø-ÿ]+(?:[^\w]|_|\d)*$", w):
            kinds.append("p")
        else:
            kinds.append("")
        canon.append({"n": "\x02", "u": "\x03", "p": "\x01"}.get(kinds[-1]) or re.sub(r"[\W_]+", "", w).lower())
        previous = w
    return [(tuple(canon[i : i + 5]), tuple(words[i : i + 5])) for i in range(len(words) - 4)]


def brute(docs, items):
    found = set()
    for d, text in docs:
        own = {}
        for i, w in enumerate(windows(text)):
            own.setdefault(w[0], []).append((i, w[1]))
        for k, t in items:
            of_item = [(i, c, r) for i, (c, r) in enumerate(windows(t)) if sum(x not in ("", "\x01", "\x02", "\x03") for x in c) >= 2]
            by_shift = {}
            for i, c, r in of_item:
                for j, raw in own.get(c, ()):
                    places, pairs = by_shift.setdefault(j - i, (set(), set()))
                    places.add(i)
                    pairs |= {(a, b) for x, a, b in zip(c, r, raw) if x in ("\x01", "\x02", "\x03")}
            good = [(p, s) for p, s in by_shift.values() if len({a for a, _ in s}) == len(s)]
            places = set().union(*(p for p, _ in good))
            if of_item and len(places) >= 0.8 * len(of_item):
                changed = any(a != b for _, s in good for a, b in s)
                found.add((d, k, len(of_item), len(places), "reparameterised" if changed else "verbatim"))
    return found


@pytest.mark.parametrize("limit", [0, 100_000])
def test_against_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_KEYS", limit)
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", limit)
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r.key, r.item, r.windows, r.matched, r.kind) for r in decontam.leaks(docs, items).collect()}
    assert got == brute(DOCS, ITEMS)
    kinds = {(k, i): x for k, i, *_, x in got}
    assert kinds[(10, 0)] == "reparameterised" and (11, 0) not in kinds  # Anna is both Maria and Bob there
    assert kinds[(12, 1)] == kinds[(12, 5)] == kinds[(None, 1)] == kinds[(17, 1)] == "verbatim"


def test_rows_that_stay(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 AS hash", "'k' AS key")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    left = decontam.without_leaks(docs, items)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [11, 13, 14, 15, 16, 18]


def test_empty_tables(spark, docs, no_docs, corpus):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.leaks(no_docs, items).count() == 0
    assert decontam.leaks(docs, none).count() == 0
    assert decontam.without_leaks(docs, none).count() == len(corpus)


QUESTIONS = [
    (1, "Yesterday the shop sold 12 red apples to its customers. Anna bought 3 of them and gave 2 away. How many apples did Anna keep for herself?"),
    (2, "Three girls share twelve plums in the yard. \"Anna took two of them,\" says the oldest. How many plums are left in the yard?"),
    (3, "What is 7 times 8 plus 4?"), (4, "How many legs do spiders have?"), (5, "Anna is 7 8 9"),
]
ANSWERS = [
    (1, "Intro. Yesterday the shop sold 15 red apples to its customers. Maria bought 7 of them and gave 4 away. How many apples did Maria keep for herself? End."),
    (2, "Yesterday the shop sold 15 red apples to its customers. Maria bought 7 of them and gave 4 away. How many apples did Eva keep for herself?"),
    (3, "so 5 girls share 20 plums in the yard. \"Eva took seven of them,\" says the oldest. How many plums are left in the yard?"),
    (4, "and then. The next question What is 7 times 8 plus 4? is hard"), (5, "as asked here How many legs do spiders have? and more"),
    (6, "they say Anna is 7 8 9 here"), (7, "they say Maria is 1 2 3 here"),
]


def leaks_of(spark, docs, items):
    found = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return sorted((r.key, r.item, r.kind) for r in found.collect())


def test_names_that_open_sentences_and_number_words_are_slots(spark):
    found = leaks_of(spark, ANSWERS, QUESTIONS)
    assert (1, 1, "reparameterised") in found and (3, 2, "reparameterised") in found
    assert not [x for x in found if x[0] in (2, 7)]  # Anna is both Maria and Eva; and another name in a window of one plain word


def test_copies_after_any_word_are_found(spark):
    found = leaks_of(spark, ANSWERS, QUESTIONS)
    assert [x for x in found if x[0] in (4, 5, 6)] == [(4, 3, "verbatim"), (5, 4, "verbatim"), (6, 5, "verbatim")]


def test_items_without_a_window_are_found_word_for_word(spark):
    items = [(1, "Who was Ada?"), (2, "is 7 8 9 10 11"), (3, "1 2 3"), (4, ""), (5, None), (6, "Who was Ada?")]
    docs = [(1, 'They ask: "who was Ada" again'), (2, "Who was Adam?"), (3, "he is 7 8 9 10 11."), (4, "is 7 8 9 10 12"), (5, "1 2 3"), (6, ""), (7, None), (None, "who was ada")]
    found = leaks_of(spark, [d for d in docs if d[0]], items)
    assert found == [(1, 1, "verbatim"), (1, 6, "verbatim"), (3, 2, "verbatim")]
    assert decontam.leaks(spark.createDataFrame(docs[-1:], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count() == 2


UNIT_WORDS = {x for u in decontam.UNITS.split("|") for x in ((u[:-2], u[:-1]) if u.endswith("s?") else (u,))}


def both_forms(text):
    """(words, canonical words of the first form, of the wide form) by a loop over the words, which looks at each word and the one before."""
    words = re.sub("[\x01-\x04]+", "", text or "").strip("\x20\t\n\x0b\x0c\r")
    words = re.split("[\x20\x09-\x0D]+", words) if words else [""]
    first, wide, number, wide_number, before = [], [], False, False, ""
    for w in words:
        bare = re.sub(r"[\W_]+", "", w).lower()
        is_number = bool(re.match(r"^(?:\W|_)*[0-9]", w))
        is_unit = not is_number and number and bool(re.match(rf"^(?:{decontam.UNITS})(?:\W|_)*$", w))
        capital = bool(re.match(r"^[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?:\W|_|\d)*$", w))
        is_name = not is_number and not is_unit and capital and bool(re.search(r"[a-zß-öø-ÿ,;]$", before))
        loose = bool(re.match(r"^(?:\W|_)*[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?:['\u2019]s)?(?:\W|_|\d)*$", w))
        first.append("\x02" if is_number else "\x03" if is_unit else "\x01" if is_name else bare)
        said = is_number or (not is_unit and bare in decontam._NUMBER_WORDS)
        plain_unit = bare in UNIT_WORDS and not is_name and not loose and not is_unit
        wide.append("\x02" if said else "\x01" if is_name or (loose and not is_unit) else "\x03" if is_unit or (plain_unit and wide_number) else bare)
        number, wide_number, before = is_number, said, w
    return words, first, wide


def bare_value(w):
    return re.sub(r"(?:['\u2019]s)?(?:\W|_)*$", "", re.sub(r"^(?:\W|_)+", "", w))


def brute_wide(docs, items):
    """(document, item, windows, matched) found by windows of either form, whether or not the first form finds them."""
    slots = ("\x01", "\x02", "\x03")
    plain = lambda c: sum(x not in ("", *slots) for x in c)
    cut = lambda x, i: tuple(x[i : i + 5])
    out = set()
    for d, text in docs:
        raw, *forms = both_forms(text)
        for k, body in items:
            item_raw, *own = both_forms(body)
            eligible = [i for i in range(len(item_raw) - 4) if plain(cut(own[0], i)) >= 2]
            shifts = {}
            for i in eligible:
                for j in range(len(raw) - 4):
                    for a, mine in enumerate(own):
                        for b, theirs in enumerate(forms):
                            c = cut(mine, i)
                            if c != cut(theirs, j) or a == 1 and own[0][i : i + 5] == list(c) or b == 1 and forms[0][j : j + 5] == list(c):
                                continue  # the wide form counts where it differs
                            pairs = [(t, bare_value(x), bare_value(y)) for t, x, y in zip(c, cut(item_raw, i), cut(raw, j)) if t in slots]
                            if a == b == 0 or plain(c) >= 2 or not any(t == "\x01" and x != y for t, x, y in pairs):
                                places, held = shifts.setdefault(j - i, (set(), set()))
                                places.add(i)
                                held |= {(x, y) for _, x, y in pairs}
            good = [p for p, s in shifts.values() if len({x for x, _ in s}) == len(s)]
            places = set().union(*good)
            if eligible and len(places) >= 0.8 * len(eligible):
                out.add((d, k, len(eligible), len(places)))
    return out


@pytest.mark.parametrize("limit, seed", [(0, 1), (100_000, 2), (0, 3), (100_000, 4)])
def test_the_wide_form_against_brute_force(spark, limit, seed, monkeypatch):
    """Questions of names, numbers in digits and words, units and punctuation, copied, re-parameterised, and broken by one inconsistent slot."""
    import random

    from scriptloom.llm import common

    monkeypatch.setattr(decontam, "BROADCAST_KEYS", limit)
    if not limit:
        monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 60)  # the hot windows' keys are broadcast, the rest is shuffled
        monkeypatch.setattr(common, "HOT_ROWS", 2)
        monkeypatch.setattr(common, "HOT_SHARE", 30)
    rng = random.Random(seed)
    names, numbers = ["Anna", "Maria", "Eva", "Bob", "Ünal", "Zoë"], ["3", "12", "seven", "twelve", "twenty", "4.5"]
    shapes = [
        "{A} has {n} red apples. {B} takes {m} of them home. How many apples does {A} have now?", "Yesterday {A} ran {n} km in {m} hours. {A}'s friend {B} ran {m} miles. Who ran further?",
        "\"{A} and {B} share {n} plums,\" says the oldest girl in the yard; {A} eats {m}.", "A box of {n} kg costs {m} dollars at {A}'s shop, while {B} sells {n} boxes.", "{A} {n} {m} {B} is it so",
    ]
    make = lambda: {"A": rng.choice(names), "B": rng.choice(names), "n": rng.choice(numbers), "m": rng.choice(numbers)}
    items = [(i, rng.choice(shapes).format(**make())) for i in range(8)] + [(8, None), (9, "short one"), (10, ""), (11, shapes[0].format(**make()))]
    filler = ["Intro words here.", "and so on", "They say:", "(", ""]
    docs = [(i, f"{rng.choice(filler)} {rng.choice(shapes).format(**make())} {rng.choice(filler)}") for i in range(40)] + [(50, items[0][1]), (51, None), (52, ""), (None, items[1][1]), (53, items[2][1].upper())]
    docs += [(60 + i, rng.choice(filler) + " " + items[i % 8][1].replace("apples", "apples", 1).replace("Anna", "Bob", 1)) for i in range(8)]
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    strict, either = brute(docs, items), brute_wide(docs, items)
    known = {x[:2] for x in strict}
    want = {x[:4] for x in strict} | {x for x in either if x[:2] not in known}
    assert {(r.key, r.item, r.windows, r.matched) for r in got if r.item != 9} == want
    assert {x[:2] for x in either} - known, "some are found by the wide form alone"


def test_long_items_without_windows_are_keyed_by_their_first_words(spark, monkeypatch):
    numbers = " ".join(str(i) for i in range(500))
    items = [(1, numbers + " word"), (2, "9 9 9 9 9 9 9 9 9 9 word"), (3, "x")]
    docs = [(1, f"here {numbers} word, and more"), (2, f"{numbers} other"), (3, "9 " * 30 + "word"), (4, "X marks"), (5, "xx"), (6, None), (7, "9 9 9 word")]
    for limit in (100_000, 0):
        monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", limit)
        monkeypatch.setattr(decontam, "BROADCAST_CHARS", limit)
        assert leaks_of(spark, docs, items) == [(1, 1, "verbatim"), (3, 2, "verbatim"), (4, 3, "verbatim")]
