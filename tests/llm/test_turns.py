"""Conversation repair against a search over all cheap edits, and against SQL."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
from zlib import crc32

import oracle
import pytest

from patternmill.llm import turns
from patternmill.llm.queries import op13_turns

COLUMNS = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def fault_of(role, text, seen):
    inked = text.rstrip(" \t\n\x0b\x0c\r")
    return "blank" if not inked else "duplicate" if (role, text) in seen else "" if inked[-1] in ".!?" else "truncated"


def cheapest(rows):
    """Best first over whole strings of edits: (cost, audit, lines). Nothing of the fold's states, only the grammar at the end."""
    best: dict = {}
    heap = [(0, "", 0, "", ())]
    while heap:
        cost, audit, at, initials, lines = heapq.heappop(heap)
        if at == len(rows) and GRAMMAR.fullmatch(initials):
            return cost, audit, lines
        key = (at, initials[:1] == "s", initials[-1:])  # no more is needed to tell what may follow
        if best.setdefault(key, (cost, audit)) != (cost, audit):
            continue
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, initials, lines))
            if fault not in ("blank", "duplicate"):
                extra = int(fault == "truncated")
                for letter, new, more in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if new and re.fullmatch(r"(s?(ua)*u?)", initials + new[0]):
                        heapq.heappush(heap, (cost + more + extra, audit + letter, at + 1, initials + new[0], (*lines, f"{new}:{text}")))
        for new in ("user", "assistant"):
            if re.fullmatch(r"(s?(ua)*u?)", initials + new[0]):
                heapq.heappush(heap, (cost + 2, audit + "I", at, initials + new[0], (*lines, f"{new}:")))
    raise AssertionError


def brute(rows):
    """Damaged rows of several conversations to the columns of the query, by conv_id."""
    convs: dict = {}
    for r in rows:
        convs.setdefault(r[0], []).append(r[1:])
    out = {}
    for conv, of in convs.items():
        of.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, told = set(), []
        for _, role, text in of:
            told.append((role, text, fault_of(role, text, seen)))
            seen.add((role, text))
        numbers = [r[0] for r in of if r[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(told, told[1:])]
        cost, audit, lines = cheapest(told)
        faults = [sum(f == x for *_, f in told) for x in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *faults, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def whole(rows):
    told, none = brute(damage(rows)), (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return sorted(((c, *told.get(c, none)) for c in {r[0] for r in rows}), key=repr)


def got(df):
    return sorted(map(tuple, turns.report(df).collect()), key=repr)


def test_sql(llm, sf):
    assert not oracle.difference(op13_turns(llm, sf).toPandas(), oracle.connection(sf).execute(turns.ORACLE_SQL).df())


def test_conversations(llm, sf):
    df = llm.read.parquet(f"{sf}/conversations.parquet")
    assert got(df) == whole([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()])


def random_rows(seed, convs, most):
    rng = random.Random(seed)
    texts = ["Hello.", "Why?", "no end", "", " \n", "Yes!  \n", "a.b", "Fine. ok", None]
    roles = ["user", "assistant", "system", "tool", "User", "u", None, ""]
    out = []
    for c in range(convs):
        for _ in range(rng.randint(1, most)):
            out.append((c if c else None, rng.choice([None, *range(6)]) if rng.random() < 0.3 else rng.randint(0, 40), rng.choice(roles[:3]) if rng.random() < 0.7 else rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.randint(0, 99)}" + rng.choice([".", "", "!"])))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_any_conversations(llm, seed):
    """Nulls in any column, ties of turns, other roles, repeated rows."""
    rows = random_rows(seed, 60, 9)
    assert got(llm.createDataFrame(rows, COLUMNS).repartition(3)) == whole(rows)


def test_empty_table_and_clashing_columns(llm):
    assert got(llm.createDataFrame([], COLUMNS)) == []
    rows = random_rows(9, 10, 5)
    wide = llm.createDataFrame([(*r, 1, "x", 2.0) for r in rows], COLUMNS + ", n int, audit string, cost double")
    assert got(wide) == whole(rows)


def test_segments(llm, monkeypatch):
    """A conversation that is cut into segments and pieces gives what it gives whole."""
    rows = [(1, k, random.Random(k).choice(["user", "assistant", "system"]), f"t {k % 50}" + "."[: k % 4]) for k in range(300)] + random_rows(5, 20, 9)
    df = llm.createDataFrame(rows, COLUMNS)
    want = got(df)
    for n in (1, 2, 7):
        monkeypatch.setattr(turns, "SEGMENT", n)
        assert got(df) == want


def test_long_conversation(llm):
    """Time grows with the number of turns, nearly."""
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}.") for k in range(20_000)]
    r = turns.repaired(llm.createDataFrame(rows, COLUMNS)).first()
    assert (r["cost"], r["audit"], len(r["turns"])) == (0, "K" * 20_000, 20_000) and r["turns"][-1]["text"] == "Turn 19999."


def test_known_repairs(llm):
    talk = {
        1: ["system", "user", "assistant"], 2: ["user", "user", "assistant"], 3: ["assistant", "user"], 4: ["system"], 5: ["user", "assistant", "system", "user", "assistant"], 6: ["user"], 7: ["tool", "assistant"],
    }
    rows = [(c, k, role, f"{role} {k}.") for c, of in talk.items() for k, role in enumerate(of)]
    told = {r["conv_id"]: (r["cost"], r["audit"], [t["role"] for t in r["turns"]]) for r in turns.repaired(llm.createDataFrame(rows, COLUMNS)).collect()}
    assert told[1] == (0, "KKK", ["system", "user", "assistant"]) and told[2] == (2, "KIKK", ["user", "assistant", "user", "assistant"]) and told[4][0] == 3 and told[6] == (2, "KI", ["user", "assistant"])
    assert told[5] == (3, "KKDKK", ["user", "assistant", "user", "assistant"]) and told[7] == (2, "RK", ["user", "assistant"])
