"""Conversation repair against a plain search over all edits."""

from __future__ import annotations

import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from auditlake.llm import dialogue
from auditlake.llm.dialogue import damaged, repair, repair_conversations


def plain_repair(codes):
    """Least (cost, audit) by trying every edit; 0 nothing out yet, 1 after s, 2 after u, 3 after a."""

    @lru_cache(maxsize=None)
    def best(i, state, inserts):
        found = [(0, "")] if i == len(codes) and state in (0, 3) else []
        after = lambda out: 2 if out == "u" else 3
        wanted = {0: "u", 1: "u", 2: "a", 3: "u"}[state]
        if inserts < 3:
            cost, audit = best(i, after(wanted), inserts + 1)
            found.append((cost + 3, "I" + audit))
        if i < len(codes):
            code, cut = codes[i].lower(), 3 if codes[i].isupper() else 0
            cost, audit = best(i + 1, state, 0)
            found.append((cost + 4, "D" + audit))
            if code != "d":
                if code == "s" and state == 0:
                    cost, audit = best(i + 1, 1, 0)
                    found.append((cost + cut, "K" + audit))
                cost, audit = best(i + 1, after(wanted), 0)
                found.append((cost + cut, "K" + audit) if code == wanted else (cost + 3 + cut, "R" + audit))
        return min(found, default=(1 << 50, ""))

    for i in range(len(codes), 0, -1):  # so that no call goes deep
        for state in range(4):
            best(i, state, 0)
    return best(0, 0, 0)


@pytest.mark.parametrize("block", [3, 7, 256])
def test_repair_finds_the_cheapest_and_least_audit(monkeypatch, block):
    monkeypatch.setattr(dialogue, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(500):
        codes = "".join(rng.choices("suaoSUAd", [2, 6, 6, 1, 1, 2, 2, 2], k=rng.randint(1, 14)))
        assert repair(codes) == plain_repair(codes), codes
    for codes in ("s", "ss", "S", "d", "ddd", "o", "au", "sdua", "aaaaaaaa", "uuuuuuu", "ssssss", "dddddddu", "addddddddd"):
        assert repair(codes) == plain_repair(codes), codes


def test_long_conversations_take_blocks():
    rng = random.Random(1)
    codes = "s" + "".join(("ua"[i % 2] if rng.random() < 0.85 else rng.choice("suaoUAd")) for i in range(900))
    assert repair(codes) == plain_repair(codes)


def plain(rows):
    """The contract, row by row."""
    blanks = " \t\n\x0b\x0c\r"
    s = lambda v: " " if v is None else str(v)
    convs = {}
    for conv, turn, role, text in rows:
        turns = convs.setdefault(conv, [])
        role, text, fate = s(role), s(text), zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else text.translate(str.maketrans("", "", ".!?")) if fate == 2 else text
        turns += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        codes, seen, faults = "", set(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in turns:
            kept = text.strip(blanks)
            fault = "blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else None
            seen.add((role, text))
            code = role[:1] if role[:1] and role[:1] in "sua" else "o"
            codes += "d" if fault in ("blank", "duplicate") else code.upper() if fault else code
            if fault:
                faults[fault] += 1
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        known = [t for t, *_ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        cost, audit = plain_repair(codes)
        done, left = [], iter(turns)
        for letter in audit:
            role = "assistant" if done and done[-1][0][:1] == "u" else "user"
            if letter == "I":
                done.append((role, ""))
                continue
            _, own, text = next(left)
            if letter != "D":
                done.append((role if letter == "R" else own, text))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()
        out[conv] = (conv, gaps, *faults.values(), illegal, cost, audit, sha)
    return out


COLUMNS = "conv_id bigint, turn bigint, role string, text string, cost string, audit string, key string, place string"


def test_conversations(spark):
    rng = random.Random(3)
    texts = ["Hello.", "yes", "Is it?", "", " \t", "no!  ", "a.b", "Ünïcode。", None, "x" * 5000 + "."]
    rows = []
    for conv in [None, *range(60)]:
        turns = sorted(rng.sample(range(12), rng.randint(1, 10))) if conv != 7 else [None, None, None]
        for i, turn in enumerate(turns):
            role = rng.choice([("system", "user")[i > 0], ("user", "assistant")[i % 2], ("user", "assistant")[i % 2], "tool", "", None])
            rows.append((conv, turn, role, rng.choice(texts)))
    rows += [(99, 3, "user", "Same."), (99, 3, "user", "Same."), (99, 3, "assistant", "Other."), (98, None, "user", None)]
    frame = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], COLUMNS)
    got = repair_conversations(damaged(frame)).collect()
    want = plain(rows)
    assert {r.conv_id: tuple(r) for r in got} == want and len(got) == len(want)


def test_no_conversations(spark):
    assert repair_conversations(damaged(spark.createDataFrame([], COLUMNS))).collect() == []
