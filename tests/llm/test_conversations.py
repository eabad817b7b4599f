"""Conversation repair against a search over all edit scripts, and against SQL."""

import functools
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_texts import sql_of

from webquarry.llm import conversation_repair as R
from webquarry.llm.queries import OP13_SQL

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
NAMES = ["conv_id", "turn", "role", "text"]


def fixture(n=120):
    rng = random.Random(6)
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 2, 4, 7, 9])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Assistant"]) if c % 3 else ("system" if t == 0 and c % 2 else ("user", "assistant")[(t + c % 2) % 2])
            text = rng.choice(["Hello there.", "And so on", "What? Yes!", " \t\n", "", None, "Fine. \r\n", f"unique {c} {t}.", "…", "Who?\x0b "])
            rows.append((c, rng.choice([t, t, t, t + 3, None]) if c % 4 == 0 else t, role, text))
    rows += [(500, 1, "user", "Same."), (500, 1, "user", "Same."), (500, 1, "user", "Same."), (501, None, None, None), (501, None, "user", "x."), (None, 0, "user", "a."), (None, 1, "assistant", "b."), (None, None, "system", "c.")]
    rows += [(600, t, ("user", "assistant")[t % 2] if t % 7 else "system", f"turn {t}." if t % 5 else "cut off") for t in range(900)]  # long
    return rows


def damage(rows):
    out = {}
    for c, t, role, text in rows:
        out.setdefault(c, [])
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else text.translate(str.maketrans("", "", ".!?")) if h == 2 else text
        out[c] += [] if h == 0 else [(t, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, x in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    return out


def search(roles, bad):
    """Least (cost, script) by dynamic programming over scripts as strings: an account of its own."""
    due = {"": "u", "s": "u", "u": "a", "a": "u"}

    @functools.cache
    def best(i, state, spare):
        options = []
        if i == len(roles) and state in ("", "a"):
            options.append((0, ""))
        if spare:
            c, s = best(i, due[state], spare - 1)
            options.append((c + 2, "I" + s))
        if i < len(roles):
            c, s = best(i + 1, state, 2)
            options.append((c + 3, "D" + s))
            if bad[i] not in ("blank", "duplicate"):
                more, first = bad[i] == "truncated", roles[i][:1]
                if first == due[state] or (first == "s" and state == ""):
                    c, s = best(i + 1, first, 2)
                    options.append((c + more, "K" + s))
                c, s = best(i + 1, due[state], 2)
                options.append((c + 2 + more, "R" + s))
        return min(options, default=(10**9, ""))

    for i in range(len(roles), -1, -1):  # keeps the recursion shallow
        for state in due:
            for spare in (0, 1, 2):
                best(i, state, spare)
    return best(0, "", 2)


def brute(rows):
    out = []
    for c, own in damage(rows).items():
        bad, roles = faults(own), [r for _, r, _ in own]
        cost, script = search(roles, bad) if own else (0, "")
        lines, state, at = [], "", 0
        for x in script:
            if x in "IR":
                state = "a" if state == "u" else "u"
            if x == "I":
                lines.append({"u": "user", "a": "assistant"}[state] + ":")
                continue
            _, role, text = own[at]
            at += 1
            if x == "K":
                state = role[0]
                lines.append(f"{role}:{text}")
            elif x == "R":
                lines.append({"u": "user", "a": "assistant"}[state] + ":" + text)
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
        out.append((c, gaps, *[bad.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, script, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("limits", [{}, {"SEGMENT": 3, "CHUNK_ROWS": 4, "CHUNK_BYTES": 60, "HELD": 20}, {"SEGMENT": 1, "CHUNK_ROWS": 1, "HELD": 1}])
def test_against_all_scripts(spark, monkeypatch, limits):
    for name, v in limits.items():
        monkeypatch.setattr(R, name, v)
    rows = fixture()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).select("*", *[F.lit(1).alias(c) for c in ("n", "chunk", "letter", "hazard", "rows", "audit")])
    assert sorted((tuple(r) for r in R.repair_damaged(df).select(COLUMNS).collect()), key=repr) == brute(rows)


def test_sql_agrees():
    rows = [r for r in fixture() if r[0] is not None and r[0] < 600 and r[2] != ""]
    names, got = sql_of(OP13_SQL, conversations=(rows, NAMES))
    assert sorted([tuple(r[names.index(c)] for c in COLUMNS) for r in got], key=repr) == brute(rows)


def test_empty_table(spark):
    assert R.repair_damaged(spark.createDataFrame([], SCHEMA)).count() == 0
    assert R.repaired(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Again."), (1, 2, "assistant", "Yes."), (2, 0, "system", "Rules."), (2, 1, "user", "Go.")]
    got = sorted(tuple(r) for r in R.repaired(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 0, "user", "Hi.", "K"), (1, 1, "assistant", "", "I"), (1, 2, "user", "Again.", "K"), (1, 3, "assistant", "Yes.", "K"), (2, 0, "system", "Rules.", "K"), (2, 1, "user", "Go.", "K"), (2, 2, "assistant", "", "I")]


def test_runs_agree_with_whole_conversations():
    rng = np.random.default_rng(9)
    sizes = np.array([1, 5, 300, 17, 64, 2, 1000])
    letters = rng.integers(0, 16, sizes.sum())
    whole = R.solve(letters, sizes, segment=2000)
    for segment in (1, 2, 7, 64):
        for a, b in zip(whole, R.solve(letters, sizes, segment=segment), strict=True):
            assert (a == b).all()
