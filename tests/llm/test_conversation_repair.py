"""Conversation repair against a plain search over all edits, on small, odd and long conversations."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from lurewatch.llm import conversation_repair as CR

ROWS = "conv_id long, turn long, role string, text string, place int, edits string"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        role, text, code = " " if role is None else role, " " if text is None else text, zlib.crc32(key.encode()) % 20
        if code:
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def plain_edits(marks):
    """(cost, audit, repaired) of (role, text, must go, truncated) turns: the least cost, then the least audit."""
    marks = tuple(marks)

    @lru_cache(None)
    def best(i, q, inserts):
        ways = []
        if i == len(marks) and q in "0a":
            ways.append((0, "", ()))
        new = "assistant" if q == "u" else "user"
        if inserts:
            c, a, r = best(i, new[0], inserts - 1)
            ways.append((c + 5, "I" + a, ((new, ""), *r)))
        if i < len(marks):
            role, text, must, cut = marks[i]
            c, a, r = best(i + 1, q, 3)
            ways.append((c + 2, "D" + a, r))
            if not must:
                extra = 5 if cut else 0
                if role[:1] == new[0] or (role[:1] == "s" and q == "0"):
                    c, a, r = best(i + 1, role[0], 3)
                    ways.append((c + extra, "K" + a, ((role, text), *r)))
                c, a, r = best(i + 1, new[0], 3)
                ways.append((c + extra + 1, "R" + a, ((new, text), *r)))
        return min(ways, key=lambda w: w[:2]) if ways else (10 ** 9, "", ())

    return best(0, "0", 3)


def plain(conversations, rows):
    out = []
    for conv in {c for c, *_ in conversations}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " ", r[3] or " "))
        seen, marks, count = set(), [], {"b": 0, "d": 0, "t": 0}
        for _, _, role, text in own:
            said = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                count[fault] += 1
            marks.append((role, text, fault in ("b", "d") and fault != "", fault == "t"))
        turns = [t for _, t, _, _ in own if t is not None]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, fixed = plain_edits(marks)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, count["b"], count["d"], count["t"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], ROWS)


def got(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def conversations():
    rng, rows = random.Random(3), []
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t\n", "a\x85.", "ends here. ", "é", "x.\x0b", "👍"]
    for conv in range(150):
        turn = rng.randrange(5)
        for i in range(rng.randrange(9)):
            role = rng.choice(("user", "assistant")) if rng.random() < 0.3 else ("user", "assistant")[i % 2]
            role = rng.choice(("system", "tool", None, "", "Assistant", "usher")) if rng.random() < 0.12 or (i == 0 and rng.random() < 0.5) else role
            text = rng.choice(texts) if rng.random() < 0.4 else f"turn {rng.randrange(60)}."
            rows.append((conv, None if rng.random() < 0.05 else turn, role, None if rng.random() < 0.05 else text))
            turn += rng.choice((0, 1, 1, 1, 1, 2, 4))
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (200, 1, "user", "same."), (200, 1, "user", "same."), (200, 1, "user", "same."), (201, None, None, None)]
    return rows


def test_repair(spark, conversations):
    df = frame(spark, conversations)
    assert got(CR.repair_report(df, CR.damaged(df))) == plain(conversations, plain_damage(conversations))
    assert got(CR.repair_report(df, df.select("conv_id", "turn", "role", "text"))) == plain(conversations, [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in conversations])


def test_chunks_of_two_turns(spark, conversations, monkeypatch):
    """Every conversation is cut into chunks, so stitching and the passes decide."""
    monkeypatch.setattr(CR, "BLOCK_BITS", 1)
    df = frame(spark, conversations)
    assert got(CR.repair_report(df, CR.damaged(df))) == plain(conversations, plain_damage(conversations))


@pytest.mark.parametrize("kind", ["users", "copies", "mixed"])
def test_one_long_conversation(spark, monkeypatch, kind):
    """Also where vectors never converge (only users) or nothing is left (copies)."""
    import sys
    sys.setrecursionlimit(20_000)
    monkeypatch.setattr(CR, "BLOCK_BITS", 4)
    rng = random.Random(8)
    say = {"users": lambda i: ("user", f"{i}."), "copies": lambda i: ("user", "Again."), "mixed": lambda i: (rng.choice(("user", "assistant", "system")), rng.choice(("cut", f"{i}.", f"{i}", "")))}[kind]
    rows = [(1, i, *say(i)) for i in range(700)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    df = frame(spark, rows)
    assert got(CR.repair_report(df, df.select("conv_id", "turn", "role", "text"))) == plain(rows, rows)


def test_directions_meet_or_are_told_apart():
    rng = random.Random(5)
    for _ in range(300):
        symbols = "".join(rng.choice(CR.FINE + CR.CUT + "bw") for _ in range(rng.randrange(1, 30)))
        first = CR.started(symbols, [CR.ZERO, CR.END], {})
        assert first == {v: CR.vectors(symbols, v)[0] for v in (CR.ZERO, CR.END)}
        other = rng.choice([(0, 10, 5, 0), (1, 1, 0, 2), (0, 2, 2, 5)])
        assert CR.started(symbols, [other], first) == {other: CR.vectors(symbols, other)[0]}


def test_repaired_turns(spark, conversations):
    df = frame(spark, conversations)
    fixed = CR.Repair(df.select("conv_id", "turn", "role", "text"))
    told = {}
    for r in sorted(fixed.repaired().collect(), key=lambda r: (r.conv, r.seq)):
        told.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
    digests = {r.conv: r.digest for r in fixed.digests().collect()}
    assert {c: hashlib.sha256("\n".join(v).encode()).hexdigest() for c, v in told.items()} == {c: d for c, d in digests.items() if c in told}
    assert all(re.fullmatch("s?(ua)+", "".join(x[0] for x in v)) for v in told.values())


def test_empty_table(spark):
    df = frame(spark, [])
    assert got(CR.repair_report(df, CR.damaged(df))) == []
