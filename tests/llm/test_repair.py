"""Conversation repair against a plain search."""

import re
import zlib
from functools import lru_cache
from hashlib import sha256
from random import Random

import numpy as np

from logwarden.llm import repair

BLANK = re.compile(r"[^\x20\x09-\x0D]")
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}
FIELDS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        out += [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    return out


def cheapest(rows, kinds):
    """(cost, audit, repaired): the least over all edit sequences."""

    @lru_cache(None)
    def best(i, state, inserted):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserted < 2:
            c, audit, rest = best(i, NEXT[state], inserted + 1)
            found.append((c + 3, "I" + audit, ((NAMES[NEXT[state]], ""), *rest)))
        if i < len(rows):
            role, text = rows[i][2:]
            c, audit, rest = best(i + 1, state, 0)
            found.append((c + 4, "D" + audit, rest))
            if kinds[i] not in ("blank", "duplicate"):
                extra = 3 * (kinds[i] == "truncated")
                if role[:1] == NEXT[state] or role[:1] == "s" and state == "":
                    c, audit, rest = best(i + 1, role[:1], 0)
                    found.append((c + extra, "K" + audit, ((role, text), *rest)))
                c, audit, rest = best(i + 1, NEXT[state], 0)
                found.append((c + 3 + extra, "R" + audit, ((NAMES[NEXT[state]], text), *rest)))
        return min(found, key=lambda x: x[:2]) if found else (10**9, "", ())

    return best(0, "", 0)


def plain(rows, ids):
    out = []
    for conv in ids:
        mine = [r for r in rows if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:100], sha256(r[3].encode()).hexdigest()))
        seen, kinds = set(), []
        for r in mine:
            last = r[3].rstrip("\x20\x09\x0a\x0b\x0c\x0d")[-1:]
            kinds.append("blank" if not BLANK.search(r[3]) else "duplicate" if r[2:] in seen else "truncated" if last not in ".!?" else "")
            seen.add(r[2:])
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, repaired = cheapest(mine, kinds)
        digest = sha256("\n".join(f"{a}:{b}" for a, b in repaired).encode()).hexdigest()
        out.append((conv, gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def random_rows(seed, convs, longest):
    r = Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", None, "tool", "", "u"]
    texts = ["Yes.", "no", "Why?", "", " \t", None, "Go on!  ", "a.b", "Ünï. "]
    out = []
    for c in range(convs):
        for t in range(r.randint(1, longest)):
            turn = r.choice([t, t, t, t + 1, None])
            out.append((c if c else None, turn, r.choice(roles), r.choice(texts) if r.random() < 0.4 else f"text {t}."))
    return out


SCHEMA = "conv_id long, turn long, role string, text string, conv string, idx int, kind string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, None) for r in rows], SCHEMA)


def result(df):
    return sorted((tuple(r[f] for f in FIELDS) for r in df.collect()), key=repr)


def test_against_plain_search(spark):
    rows = random_rows(1, 60, 14)
    df = frame(spark, rows).repartition(3)
    ids = list({r[0] for r in rows})
    want = plain(damage(rows), ids)
    assert result(repair.repair(repair.damaged(df), df)) == want
    # A conversation that is cut into segments has the same result.
    assert result(repair.repair(repair.damaged(df), df, block=3)) == want
    assert result(repair.repair(df)) == plain([(*r[:2], *(" " if x is None else x for x in r[2:])) for r in rows], ids)


def test_hand_computed(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "There."), (1, 4, "assistant", "Hello."),
            (2, 0, "assistant", "Hm."), (3, 0, "user", "  ")]
    got = {r["conv_id"]: r for r in repair.repair(frame(spark, rows)).collect()}
    assert (got[1]["gaps"], got[1]["illegal"], got[1]["cost"], got[1]["audit"]) == (2, 1, 3, "KIKK")
    assert (got[2]["cost"], got[2]["audit"]) == (3, "IK")
    assert got[2]["repaired_sha256"] == sha256(b"user:\nassistant:Hm.").hexdigest()
    assert (got[3]["cost"], got[3]["audit"], got[3]["repaired_sha256"]) == (4, "D", sha256(b"").hexdigest())


def test_empty_long_and_dropped(spark):
    none = frame(spark, [])
    assert repair.repair(none).collect() == []
    ids = spark.createDataFrame([(9,), (None,)], "conv_id long")
    got = {r["conv_id"]: r for r in repair.repair(none, ids).collect()}
    assert got[9]["audit"] == "" and got[None]["cost"] == 0
    big = "word " * 700_000 + "."
    long_rows = frame(spark, [(5, t, ("user", "assistant")[t % 2], f"{t}. {big if t < 2 else ''}.") for t in range(9_000)])
    got = repair.repair(long_rows, block=1_000).first()
    assert got["audit"] == "K" * 9_000 and got["cost"] == 0
    text = "\n".join(f"{('user', 'assistant')[t % 2]}:{t}. {big if t < 2 else ''}." for t in range(9_000))
    assert got["repaired_sha256"] == sha256(text.encode()).hexdigest()


def test_ranks_choose_among_equal_costs():
    codes, kinds = np.array([[2, 1, 1, 2, 2, 1]]), np.array([[0, 1, 0, 0, 2, 0]])
    names = "sua"
    rows = [(0, k, names[c], f"t{k}.") for k, c in enumerate(codes[0])]
    want = cheapest(rows, [["", "truncated", "duplicate", "blank"][k] for k in kinds[0]])
    found, _ = repair.audits(codes, kinds, np.array([6]), repair.END[None, :], np.array([True]))
    assert found[0][0] == want[1]


def test_damage_is_the_stated_one(spark):
    rows = random_rows(4, 30, 9)
    got = [tuple(r) for r in repair.damaged(frame(spark, rows)).select("conv_id", "turn", "role", "text").collect()]
    assert sorted(got, key=repr) == sorted(damage(rows), key=repr)
