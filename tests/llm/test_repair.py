from __future__ import annotations

import random
import re
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from kartoteka.llm import repair, sql
from kartoteka.llm.queries import op12_repair
from oracle import TESTDATA, compare, connect

SCHEMA = "conv_id long, turn long, role string, text string, cost int, audit string"
NEXT = {"": ("u", "user"), "s": ("u", "user"), "u": ("a", "assistant"), "a": ("u", "user")}
KEEP = {"": "su", "s": "u", "u": "a", "a": "u"}


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        kept += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def closed(best):
    while True:
        before = dict(best)
        for s, (c, a, rows) in before.items():
            to, role = NEXT[s]
            new = (c + 3, a + "I", rows + ((role, ""),))
            if to not in best or new[:2] < best[to][:2]:
                best[to] = new
        if best == before:
            return best


def brute(rows):
    """Every conversation by a forward search that keeps the least cost and letters of each state."""
    out = []
    for conv, kept in damage(rows).items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in kept:
            body = re.sub(r"[ \t-\r]+$", "", text)
            faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in kept if t is not None}
        initials = [r[1][:1] for r in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        best = closed({"": (0, "", ())})
        for (_, role, text), fault in zip(kept, faults):
            after = {}

            def put(state, c, a, rows):
                if state not in after or (c, a) < after[state][:2]:
                    after[state] = (c, a, rows)

            for s, (c, a, done) in best.items():
                put(s, c + 4, a + "D", done)
                if fault in ("b", "d"):
                    continue
                extra = 3 if fault == "t" else 0
                if role[:1] and role[:1] in KEEP[s]:
                    put(role[:1], c + extra, a + "K", done + ((role, text),))
                put(NEXT[s][0], c + 3 + extra, a + "R", done + ((NEXT[s][1], text),))
            best = closed(after)
        cost, audit, done = min((best[s] for s in ("", "a") if s in best), key=lambda v: v[:2])
        digest = sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in "bdt"], illegal, cost, audit, digest))
    return sorted(out, key=repr)


def check(df):
    got = sorted(map(tuple, repair.audit(repair.damaged(df)).collect()), key=repr)
    assert got == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def frame(spark, rows):
    return spark.createDataFrame([(*r, -1, "clash") for r in rows], SCHEMA)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_against_sql(spark, scale):
    folder = TESTDATA / scale
    assert compare(op12_repair(spark, str(folder)), connect(folder), sql.CONVERSATION_REPAIR) == ([], [])


def test_random_conversations_short_and_long(spark):
    rng = random.Random(3)
    rows = []
    for conv in [None, 1, 2, 3, *range(10, 60)]:
        for t in range(rng.choice([1, 3, 8]) if conv and conv > 9 else rng.choice([300, 900])):
            rows.append((conv, rng.choice([t, t, t, None, rng.randrange(t + 1)]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
                         rng.choice(["a.", "b?", "c", "", "  \n", None, f"x{t}.", f"y{t}", f"z{t}! "])))
    check(frame(spark, rows))


@pytest.mark.parametrize("pattern", ["never converges", "alternates", "all blank", "all equal"])
def test_long_chains(spark, pattern):
    row = {"never converges": lambda t: ("tool", f"r{t}"), "alternates": lambda t: ("assistant" if t % 2 else "user", f"r{t}."),
           "all blank": lambda t: ("user", " "), "all equal": lambda t: ("user", "same.")}[pattern]
    check(frame(spark, [(78, t, *row(t)) for t in range(3000)] + [(79, 0, "system", "s.")]))


def test_edges(spark):
    long = "word " * 200_000
    dropped = [t for t in range(400) if zlib.crc32(f"5:{t}".encode()) % 20 == 0][:3]
    check(frame(spark, [(5, t, "user", "gone.") for t in dropped] + [(6, None, None, None), (None, None, "system", long), (7, 0, "user", long + "."),
                                                                     (7, 1, "assistant", "é ß　\u0085"), (8, 2 ** 62, "user", "x."), (8, -5, "assistant", "y.")]))
    check(frame(spark, []))


def test_repaired_rows_are_whole(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (2, 0, "system", "s."), (3, 0, "assistant", "")] + [(4, t, "user", f"t{t}.") for t in range(400)]
    out = repair.repaired_rows(repair.whole(frame(spark, rows)))
    by_conv = {}
    for r in out.orderBy("conv_id", "piece", "place").collect():
        by_conv.setdefault(r.conv_id, []).append((r.role, r.text))
    assert by_conv.pop(2) == [("system", "s."), ("user", ""), ("assistant", "")] if 2 in by_conv else True
    assert by_conv[1] == [("user", "a."), ("assistant", "b.")] and 3 not in by_conv
    assert [r for r, _ in by_conv[4]] == ["user", "assistant"] * 200 and [t for _, t in by_conv[4]] == [f"t{t}." for t in range(400)]


def test_vectors_of_other_constants_trace_alike():
    rng = random.Random(1)
    for _ in range(200):
        codes = bytes(rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8]) for _ in range(rng.randrange(30)))
        costs = repair.backward(codes, (0, 6, 3, 0))
        shifted = repair.backward(codes, (9, 15, 12, 9))
        for state in range(4):
            letters, end, paid = repair.trace(codes, costs, state)
            assert (letters, end, paid) == repair.trace(codes, shifted, state)
            assert paid + 3 * len(repair.tail(end)) == costs[0][state]


def test_damage_keeps_every_conversation(spark):
    df = frame(spark, [(c, t, "user", "x.") for c in range(50) for t in range(2)])
    assert repair.audit(repair.damaged(df)).agg(F.count_distinct("conv_id")).first()[0] == 50
