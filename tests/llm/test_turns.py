"""Conversation repair against a plain program over (cost, audit), with NULLs, ties and conversations that cross partitions."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from spreadlens.llm import turn_repair as tr

SPACES = " \t\n\x0b\x0c\r"
FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}
SCHEMA = "conv_id bigint, turn bigint, role string, text string, place int, edits string"


def ordered(rows):
    return sorted(rows, key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), hashlib.md5(v[2].encode()).digest()))


def plain(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, lines) of one conversation's (turn, role, text) in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.rstrip(SPACES)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    best = {"": (0, "", ())}

    def better(into, state, way):
        if state not in into or way[:2] < into[state][:2]:
            into[state] = way

    def with_inserts():
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                for initial, role in (("u", "user"), ("a", "assistant")):
                    if initial in FOLLOWS[state]:
                        better(best, initial, (cost + 2, audit + "I", (*lines, (role, ""))))

    for (_, role, text), fault in zip(rows, faults):
        with_inserts()
        after = {}
        for state, (cost, audit, lines) in best.items():
            better(after, state, (cost + 3, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                extra = int(fault == "truncated")
                if role[:1] and role[:1] in FOLLOWS[state]:
                    better(after, role[0], (cost + extra, audit + "K", (*lines, (role, text))))
                for initial, told in (("u", "user"), ("a", "assistant")):
                    if initial in FOLLOWS[state]:
                        better(after, initial, (cost + extra + 2, audit + "R", (*lines, (told, text))))
        best = after
    with_inserts()
    cost, audit, lines = min((best[s] for s in ("", "a") if s in best), key=lambda w: w[:2])
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, lines)


def by_conversation(rows):
    out = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        out[conv].append((turn, " " if role is None else role, " " if text is None else text))
    return {conv: plain(ordered(own)) for conv, own in out.items()}


def summary(found):
    return {conv: (*own[:7], hashlib.sha256("\n".join(f"{r}:{t}" for r, t in own[7]).encode()).hexdigest()) for conv, own in found.items()}


def odd_rows():
    rng = random.Random(3)
    roles, texts = ["user", "user", "assistant", "assistant", "system", "tool", "", None, "u"], ["Yes.", "No!", "cut", "", " \n", None, "é?", "x. \t"]
    rows = [(conv, rng.randrange(6), rng.choice(roles), rng.choice(texts)) for conv in range(150) for _ in range(rng.randrange(1, 9))]
    rows += [(900, t // 3, rng.choice(roles[:5]), f"turn {t}{rng.choice(['.', ''])}") for t in range(2500)]
    rows += [(None, rng.choice([None, 1, 2**60, 2**60 + 1]), rng.choice(roles), f"{k % 7}.") for k in range(300)]
    rows += [(901, 1, "user", "the same.")] * 400 + [(902, None, "user", "long " * 40_000), (903, None, None, None)]
    rng.shuffle(rows)
    return [(*r, 1, "x") for r in rows]


def test_summary_of_odd_rows(spark):
    rows = odd_rows()
    named = spark.createDataFrame([(r[0],) for r in rows] + [(7777,)], "conv_id bigint")
    got = {r.conv_id: tuple(r)[1:] for r in tr.repair_summary(spark.createDataFrame(rows, SCHEMA), named).collect()}
    want = summary(by_conversation(rows))
    want[7777] = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == want


def test_conversations_cross_partitions(spark):
    rows = spark.createDataFrame(odd_rows(), SCHEMA)
    chains = tr._crossings(tr._symbols(rows))
    assert any(len(chain) > 2 for chain in chains)


def test_repaired_turns_follow_the_pattern(spark):
    rows = odd_rows()
    got = defaultdict(list)
    for r in tr.repaired_turns(spark.createDataFrame(rows, SCHEMA)).orderBy("place", "step").collect():
        got[r.conv_id].append((r.role, r.text))
    assert got == {conv: list(own[7]) for conv, own in by_conversation(rows).items() if own[7]}


def test_damage(spark):
    rows = [(c, t, r, x) for c in (None, *range(40)) for t in (None, 0, 1) for r, x in ((None, None), ("assistant", "One. Two!"))]
    want = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else "".join(ch for ch in text if ch not in ".!?") if kind == 2 else text
        want += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    got = tr.damage(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_runs_by_powers_equal_single_steps():
    rng = random.Random(5)
    for _ in range(300):
        pieces = tuple((rng.randrange(9), rng.choice([1, 1, 2, 5, 37])) for _ in range(rng.randrange(1, 6)))
        single = tr.ENDING
        for symbol, n in reversed(pieces):
            for _ in range(n):
                single = tr.onto(tr.power(symbol, 0), single)
        assert tr.before_all(pieces, tr.ENDING) == single == tr.onto(tr.matrix_of(pieces), tr.ENDING)
        done, state = tr.unroll(pieces, 0, tr.ENDING, True)
        assert sum(p[2] for p in done) == single[0] and state in (0, 3)


def test_no_rows(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert tr.repair_summary(none, none).collect() == [] and tr.repaired_turns(none).count() == 0
    named = spark.createDataFrame([(None,)], "conv_id bigint")
    assert tr.repair_summary(tr.damage(none), named).select("cost", F.length("audit")).collect() == [(0, 0)]
