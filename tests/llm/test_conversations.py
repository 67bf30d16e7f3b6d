"""Conversation repair against a recursion over all edits, at block sizes that cut every conversation."""

from __future__ import annotations

import hashlib
import random
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from larder.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"
NEXT = {0: "su", 1: "u", 2: "a", 3: "u"}
TO = {"s": 1, "u": 2, "a": 3}
FULL = {"u": "user", "a": "assistant"}


def key(row):
    role, text = (v if v is not None else " " for v in row[2:4])
    return (row[1] is not None, row[1] or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest())


def brute(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, lines) of one conversation's rows."""
    rows = [(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in sorted(rows, key=key)]
    seen, faults, counts = set(), [], [0, 0, 0]
    for _, _, role, text in rows:
        blank, again = not text.strip(BLANKS), (role, text) in seen
        cut = not blank and text.rstrip(BLANKS)[-1] not in ".!?"
        seen.add((role, text))
        for i, fault in enumerate((blank, again, cut)):
            if fault:
                counts[i] += 1
                break
        faults.append((blank or again, cut))

    @lru_cache(None)
    def best(i, s, inserted):
        ways = []
        if i == len(rows):
            if s in (0, 3):
                ways.append((0, "", ()))
        else:
            c, a, lines = best(i + 1, s, 0)
            ways.append((c + 2, "D" + a, lines))
            must, cut = faults[i]
            if not must:
                _, _, role, text = rows[i]
                if role[:1] and role[0] in NEXT[s]:
                    c, a, lines = best(i + 1, TO[role[0]], 0)
                    ways.append((c + 5 * cut, "K" + a, ((role, text), *lines)))
                for x in "ua":
                    if x in NEXT[s]:
                        c, a, lines = best(i + 1, TO[x], 0)
                        ways.append((c + 1 + 5 * cut, "R" + a, ((FULL[x], text), *lines)))
        if inserted < 3:
            for x in "ua":
                if x in NEXT[s]:
                    c, a, lines = best(i, TO[x], inserted + 1)
                    ways.append((c + 5, "I" + a, ((FULL[x], ""), *lines)))
        return min(ways, key=lambda w: w[:2]) if ways else (1 << 40, "", ())

    turns = {r[1] for r in rows if r[1] is not None}
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, *best(0, 0, 0))


def random_rows(seed, conversations_, longest):
    rng, rows = random.Random(seed), []
    for c in range(conversations_):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", f"Word {t}?", "cut off", "", " \n", None, "Ünï \U0001f600."])
            rows.append((c, rng.choice([t, t, t + 3, None]), role, text))
    return rows


def check(got, rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert set(got) == set(by)
    for c, own in by.items():
        *numbers, lines = brute(own)
        assert got[c][:-1] == tuple(numbers), (c, own)
        assert got[c][-1] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


@pytest.mark.parametrize(("block", "longest"), [(1, 9), (3, 25), (1024, 12)])
def test_equals_all_edits(spark, block, longest):
    rows = random_rows(block, 40, longest)
    got = conversations.repaired(spark.createDataFrame(rows, SCHEMA), least_block=block)
    check({r[0]: tuple(r)[1:] for r in got.collect()}, rows)


def test_long_conversation_over_many_blocks(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"a{t}.", f"b{t}", f"c{t}?", "again."])) for t in range(300)]
    got = conversations.repaired(spark.createDataFrame(rows, SCHEMA).repartition(7), least_block=4)
    check({r[0]: tuple(r)[1:] for r in got.collect()}, rows)


def test_repaired_turns_are_what_the_digest_says(spark):
    docs = spark.createDataFrame(random_rows(9, 25, 10), SCHEMA)
    lines = {}
    for r in conversations.repaired_turns(docs, least_block=2).sort("conv_id", "place").collect():
        assert r.place == len(lines.setdefault(r.conv_id, []))
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    for r in conversations.repaired(docs).collect():
        own = lines.get(r.conv_id, [])
        assert r.repaired_sha256 == hashlib.sha256("\n".join(own).encode()).hexdigest()
        initials = "".join(x[0] for x in own)
        assert initials.removeprefix("s") == "ua" * (len(initials.removeprefix("s")) // 2) and initials != "s"


def test_odd_cases(spark):
    """A conversation without id, one of no rows, a hot group of equal rows, a very long text, clashing names, extreme turns."""
    long = "x" * 2_000_000 + "."
    rows = [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (2, 5, "user", "Gone."), *[(3, 4, "user", "Same.")] * 5, (3, 5, "assistant", long), (4, -(1 << 63), "user", "A."), (4, (1 << 63) - 1, "assistant", "B.")]
    df = spark.createDataFrame([(*r, "x", 7, False) for r in rows], SCHEMA + ", conv string, n int, first boolean")
    got = {r[0]: tuple(r)[1:] for r in conversations.repaired(df, copies=F.when(F.col("conv_id") == 2, 0).otherwise(1), least_block=2).collect()}
    assert got[2] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[3][:-1] == (0, 0, 4, 0, 4, 8, "KDDDDK") and got[4][0] == (1 << 63) - 1 and got[4][-2] == "KK"
    assert got[3][-1] == hashlib.sha256(f"user:Same.\nassistant:{long}".encode()).hexdigest()
    del got[2], got[4]
    check(got, [r for r in rows if r[0] not in (2, 4)])


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversations.repaired(none).collect() == [] and conversations.repaired_turns(none).collect() == []


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(20) for t in range(10)] + [(None, None, None, None)]
    out, copies = conversations.damaged(spark.createDataFrame(rows, SCHEMA))
    for r in out.withColumn("n", copies).collect():
        import zlib

        name = f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}"
        fault = zlib.crc32(name.encode()) % 20
        said = "One. Two!" if r.conv_id is not None else " "
        assert r.n == {0: 0, 3: 2}.get(fault, 1)
        assert r.text == ("" if fault == 1 else said.translate({ord(c): None for c in ".!?"}) if fault == 2 else said)
        assert r.role == ("user" if fault == 4 else "assistant" if r.conv_id is not None else " ")
