from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptloom.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, place string, fault int"


def brute(rows: list[tuple[str, int]], longest: int) -> tuple[int, str]:
    """The cheapest repair of (initial, fault) rows, of all texts of edits up to some length."""
    best = None
    todo = [(0, "", 0, "")]
    while todo:
        cost, audit, at, roles = todo.pop()
        if best and (cost, audit) > best and cost > best[0] or len(audit) > longest:
            continue
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best or (cost, audit), (cost, audit))
        for r in "ua":
            todo.append((cost + 5, audit + "I", at, roles + r))
        if at < len(rows):
            role, fault = rows[at]
            todo.append((cost + 2, audit + "D", at + 1, roles))
            if fault not in (1, 2):
                more = 5 if fault == 3 else 0
                todo.append((cost + more, audit + "K", at + 1, roles + (role or "?")))
                todo += [(cost + 1 + more, audit + "R", at + 1, roles + r) for r in "ua"]
    return best


def code(role: str, fault: int) -> int:
    return {"u": 1, "a": 2, "s": 3}.get(role, 0) * 4 + fault


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["u", "a", "s", "x", ""]), st.sampled_from([0, 0, 0, 1, 2, 3])), max_size=4))
def test_repairs_equal_all_repairs(rows):
    coded = bytes(code(*r) for r in rows)
    assert C.cheapest(coded) == brute(rows, len(rows) + 2) == C.cheapest(coded, -1)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["u", "a", "s", "x"]), st.sampled_from([0, 0, 0, 1, 2, 3])), max_size=60))
def test_trees_of_edits_order_as_texts(rows):
    coded = bytes(code(*r) for r in rows)
    assert C.cheapest(coded, -1) == C.cheapest(coded)


def test_long_conversations():
    rng = random.Random(5)
    coded = bytes(code(rng.choice("uuas"), rng.choice([0, 0, 0, 1, 3])) for _ in range(6000))
    cost, audit = C.cheapest(coded)
    assert len(audit.replace("I", "")) == 6000 and cost > 0
    state = 0
    spent = 0
    edits = iter(audit)
    for c in coded:
        while (e := next(edits)) == "I":
            state, spent = C.EXPECTED[state], spent + 5
        spent += {"D": 2, "R": 1, "K": 0}[e] + (5 if c % 4 == 3 and e != "D" else 0)
        if e != "D":
            state = C.EXPECTED[state] if e == "R" else C.KEPT[c // 4][state]
    for _ in edits:
        state, spent = C.EXPECTED[state], spent + 5
    assert C.ACCEPTING[state] and spent == cost


def want(table: list[tuple]) -> list[tuple]:
    rows, ids = defaultdict(list), {r[0] for r in table}
    for conv, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        rows[conv] += [(turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    out = []
    for conv in ids:
        own = sorted(rows[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen, n = [], set(), Counter()
        for _, role, text in own:
            body = text.strip("\x20\t\n\x0b\x0c\r")
            faults.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
            seen.add((role, text))
        n.update(faults)
        turns = [t for t, _, _ in own if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit = C.cheapest(bytes(code(r[:1], f) for (_, r, _), f in zip(own, faults, strict=True)))
        done, at = [], 0
        for e in audit:
            if e == "I":
                done.append((None, ""))
            else:
                if e != "D":
                    done.append((own[at][1] if e == "K" else None, own[at][2]))
                at += 1
        lead = bool(done) and (done[0][0] or "")[:1] == "s"
        text = "\n".join(f"{r if r is not None else ('user', 'assistant')[(i - lead) % 2]}:{t}" for i, (r, t) in enumerate(done))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, n[1], n[2], n[3], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("long", [C.LONG, -1])
def test_whole_tables_equal_a_plain_walk(spark, rng, long):
    texts = ["Yes.", "No!", "Why?", "cut off", " \t\n", "", None, "é日本. ", "Ends.\n", "Yes.", "x" * 50_000 + ".", " ", "two\nlines?"]
    roles = ["user", "assistant", "user", "assistant", "system", "User", "", None, "tool", "unknown"]
    table = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(120) for t in range(rng.randint(1, 9))]
    table += [(500, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(700)]  # one conversation of many rows
    table += [(None, 1, "user", "Hm."), (None, None, None, None), (7, None, "system", "First."), (7, 3, "user", "Twice."), (7, 3, "user", "Twice."), (7, 3, "assistant", "Twice."), (8, -5, "user", "Early.")]
    table += [(i, 0, "user", "Alone.") for i in range(1000, 1060)]  # some of them are dropped
    rng.shuffle(table)
    df = spark.createDataFrame([(*r, "p", 9) for r in table], SCHEMA)
    got = C.repair(C.lines(C.damaged(df), present="present"), long)
    assert sorted(map(tuple, got.collect()), key=repr) == want(table)
    assert any(r[7] == "" for r in want(table))


def test_repaired_turns_and_empty_tables(spark):
    rows = [(1, 0, "system", "Rules."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi."), (1, 3, "user", "And?"), (1, 4, "assistant", "So."), (2, 0, "user", " ")]
    df = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    lines = C.lines(df)
    found = C.plans(lines)
    assert {(r.conv, r.cost, r.audit) for r in found.collect()} == {(1, *C.cheapest(bytes([12, 8, 4, 4, 8]))), (2, 2, "D")}
    turns = [tuple(r) for r in C.repaired(lines, found).orderBy("conv", "at").collect()]
    assert re.fullmatch("(s?(ua)+)?", "".join(r[3][0] for r in turns)) and turns[0] == (1, 0, "K", "system", "Rules.")
    none = spark.createDataFrame([], SCHEMA)
    assert C.repair(C.lines(C.damaged(none), present="present")).collect() == []
