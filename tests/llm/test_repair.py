"""Conversation repair next to a plain search over all edits."""
import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tabscout.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, kind int, pos int, audit string, cost int"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def conversations():
    deal = random.Random(5)
    rows = [
        (1, 0, "user", "hi."), (1, 1, "assistant", "yes?"), (2, 0, "assistant", "only."), (3, 0, None, None), (None, 0, "user", "x"),
        (None, None, "user", "y."), (None, None, "assistant", "z!"), (4, None, "tool", "t."), (4, None, "", "u."), (5, 3, "user", " \n"),
        (6, 1, "user", "same."), (6, 2, "assistant", "a."), (6, 3, "user", "same."), (6, 3, "user", "same."), (7, 9, "system", "s" * 30000 + "."),
        (8, 5, "user", ""), (9, -4, "user", "é."), (9, 2**40, "assistant", "ok\n"),
    ]
    for conv in range(20, 60):
        for turn in range(deal.randint(1, 9)):
            role = deal.choice(["user", "assistant", "user", "assistant", "system", "tool", None])
            rows.append((conv, deal.choice([turn, turn, turn, None]), role, deal.choice(["a.", "b", "c!", "", None, f"t {turn}."])))
    for turn in range(60):  # roles that never let two cost vectors become parallel
        rows.append((100, turn, "tool", f"t{turn}."))
    for turn in range(61):
        rows.append((101, turn, "user" if turn % 2 else "assistant", f"t{turn}" + "." * (turn % 3)))
    return rows


def spoiled(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def by_hand(rows):
    """As ``repair.repair``, by (cost, audit, repaired) of every reachable state, row by row."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest(), text))
    out = {}
    for conv, found in groups.items():
        found.sort(key=lambda r: r[:4])
        turns = {r[1] for r in found if r[0]}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        seen, faults, initials = set(), [], [r[2][:1] for r in found]
        for _, _, role, _, text in found:
            core = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else "" if core[-1] in ".!?" else "truncated")
            seen.add((role, text))
        states = {"": (0, "", ())}  # by the shortest initials that may go on likewise

        def better(into, key, value):
            key = key if key in ("", "s") else "u" if key[-1] == "u" else "ua"
            if key not in into or value < into[key]:
                into[key] = value

        def insert(states):
            for _ in range(2):
                for key, (cost, audit, lines) in list(states.items()):
                    for role in ("user", "assistant"):
                        if GRAMMAR.fullmatch(key + role[0]) or GRAMMAR.fullmatch(key + role[0] + "a"):
                            better(states, key + role[0], (cost + 2, audit + "I", lines + (f"{role}:",)))

        insert(states)
        for (_, _, role, _, text), fault in zip(found, faults):
            after = {}
            for key, (cost, audit, lines) in states.items():
                better(after, key, (cost + 3, audit + "D", lines))
                if fault in ("blank", "duplicate"):
                    continue
                for letter, new, price in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    now = key + new[:1]
                    if new and any(GRAMMAR.fullmatch(now + rest) for rest in ("", "a", "ua")):
                        better(after, now, (cost + price + (fault == "truncated"), audit + letter, lines + (f"{new}:{text}",)))
            insert(after)
            states = after
        cost, audit, lines = min(v for k, v in states.items() if GRAMMAR.fullmatch(k))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def chats(spark):
    return spark.createDataFrame([(*r, 1, 2, "a", 3) for r in conversations()], SCHEMA).repartition(3)


@pytest.mark.parametrize("chunk, fixups", [(4, 1), (2, 3), (1 << 14, 3)])
def test_repair(chats, monkeypatch, chunk, fixups):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    want = by_hand(spoiled(conversations()))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = {r.conv_id: tuple(r)[1:] for r in repair.report(chats, fixups).collect()}
    assert got == {conv: want.get(conv, nothing) for conv, *_ in conversations()}


def test_repair_without_damage(chats):
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in conversations()]
    assert {r.conv_id: tuple(r)[1:] for r in repair.repair(chats).collect()} == by_hand(rows)


def test_repair_nothing(spark):
    got = repair.report(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0 and got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_fix_up_stops_when_parallel():
    deal = random.Random(1)
    for _ in range(300):
        codes = bytes(deal.choice([0, 1, 2, 3, 5, 6, 8]) for _ in range(deal.randint(1, 30)))
        old, new = ([deal.randint(0, 5) for _ in range(4)] for _ in range(2))
        assert repair.mended(codes, old, new) == repair.costs(codes, new)[0]
