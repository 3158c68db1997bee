"""Repair of conversations against a table of all cheapest edits, on made and given conversations."""

import hashlib
import random
import re
import zlib

import pytest

from sortilege.llm import conversations

STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLE = {"u": "user", "a": "assistant"}


def plain(rows, damage):
    """Every conversation by hand: the cheapest and then least audit of each place and state, from the end."""
    by = {}
    for c, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kept = by.setdefault(c, [])
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20 if damage else 19
        if h == 0:
            continue
        role, text = "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        kept += [(turn, role, text)] * (2 if h == 3 else 1)
    for c, kept in by.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in kept:
            body = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        best = {(len(kept), 0): (0, "", ()), (len(kept), 3): (0, "", ())}
        for i in range(len(kept), -1, -1):
            if i < len(kept):
                _, role, text = kept[i]
                for s in range(4):
                    moves = [(3, "D", s, ())]
                    if faults[i] not in ("blank", "duplicate"):
                        cut = faults[i] == "truncated"
                        moves += [(cut, "K", STEP[s, role[:1]], ((role, text),))] if (s, role[:1]) in STEP else []
                        moves += [(2 + cut, "R", STEP[s, x], ((ROLE[x], text),)) for x in "ua" if (s, x) in STEP]
                    ways = [(w + best[i + 1, t][0], x + best[i + 1, t][1], out + best[i + 1, t][2]) for w, x, t, out in moves if (i + 1, t) in best]
                    if ways:
                        best[i, s] = min(ways)
            for _ in range(5):
                for s in range(4):
                    for x in "ua":
                        if (s, x) in STEP and (i, STEP[s, x]) in best:
                            b = best[i, STEP[s, x]]
                            best[i, s] = min(best.get((i, s), (10**9, "", ())), (2 + b[0], "I" + b[1], ((ROLE[x], ""),) + b[2]))
        cost, audit, out = best[0, 0]
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        yield (c, gaps, *[faults.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha), out


def made():
    rng = random.Random(5)
    texts = ["", " \t", None, "Yes.", "No", "Why? ", "End!\n", "so\x85", "ok..."]
    roles = ["user", "assistant", "system", "tool", None, "", "u", "sys", "User"]
    rows = []
    for c in range(250):
        for t in range(rng.randint(0, 12)):
            rows.append((c, None if rng.random() < 0.05 else t + rng.randint(0, 1), rng.choice(roles[: rng.choice([2, 3, 9])]), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.randint(0, 9)}{rng.choice(['.', '', '?'])}"))
    rows += [(None, 0, "user", "a."), (None, 1, "assistant", "b."), (-7, 2**62, "user", "x " * 40_000), (900, None, None, None), (900, None, None, None)]
    rows += [rows[i] for i in range(0, len(rows), 17)]  # repeated rows
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("damage, rows", [(True, 2000), (True, 3), (False, 1), (False, 2000)])
def test_repair(spark, damage, rows):
    """Also where every conversation lies in blocks of one or three rows."""
    data = made()
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in data], SCHEMA + ", seq int, times int, c string").repartition(5)
    before, conversations.BLOCK_ROWS = conversations.BLOCK_ROWS, rows
    try:
        got = conversations.repair(df, damage)
        assert got.columns == conversations.COLUMNS
        got = sorted(map(tuple, got.collect()), key=str)
        lines = conversations.repaired(df, damage).collect()
    finally:
        conversations.BLOCK_ROWS = before
    want = list(plain(data, damage))
    assert got == sorted((w for w, _ in want), key=str)
    by = {}
    for r in sorted(lines, key=lambda r: r.place):
        by.setdefault(r.conv_id, []).append((r.role, r.text))
    assert by == {w[0]: list(out) for w, out in want if out}


def test_given_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    want = plain([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()], True)
    assert sorted(map(tuple, conversations.repair(df, True).collect())) == sorted(w for w, _ in want)


def test_empty_and_all_dropped(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert conversations.repair(df, True).count() == 0
    gone = next((c, 0) for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = conversations.repair(spark.createDataFrame([(*gone, "user", "Hi.")], SCHEMA), True).collect()
    assert [tuple(r) for r in got] == [(gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_many_equal_rows(spark):
    """Half a million equal rows of one turn travel as one."""
    df = spark.range(500_000).selectExpr("cast(1 as long) conv_id", "cast(id % 2 as long) turn", "if(id % 2 = 0, 'user', 'assistant') role", "'Same.' text")
    r = conversations.repair(df).first()
    assert (r.duplicate, r.cost, r.audit == "K" + "D" * 249_999 + "K" + "D" * 249_999) == (499_998, 3 * 499_998, True)
