"""Conversation repair against a plain search that carries whole edit strings."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from mapweave.llm import conversations, trails

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_rows(rows, damage):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        harm = zlib.crc32(name.encode()) % 20 if damage else 19
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        found[conv] += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in found.items()}


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = re.sub("[\x20\x09-\x0D]", "", text)
        out.append("b" if not body else "d" if (role, text) in seen else "-" if body[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def plain_repair(rows, faults):
    """state -> (cost, audit, rows left); the state is the last role's initial."""
    follows = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def put(at, state, value):
        if state not in at or value[:2] < at[state][:2]:
            at[state] = value

    def insert(at):
        at = dict(at)
        for _ in range(4):
            for state, (cost, audit, left) in list(at.items()):
                to = follows[state]
                put(at, to, (cost + 5, audit + "I", left + ((names[to], ""),)))
        return at

    at = {"": (0, "", ())}
    for (_, role, text), fault in zip(rows, faults):
        new = {}
        for state, (cost, audit, left) in insert(at).items():
            put(new, state, (cost + 2, audit + "D", left))
            if fault in "bd":
                continue
            cost += 5 * (fault == "t")
            to = follows[state]
            put(new, to, (cost + 1, audit + "R", left + ((names[to], text),)))
            if role[:1] == to or (role[:1] == "s" and state == ""):
                put(new, role[:1], (cost, audit + "K", left + ((role, text),)))
        at = new
    return min(v for k, v in insert(at).items() if k in ("", "a"))


def plain_report(rows, damage):
    after, out = plain_rows(rows, damage), {}
    for conv in {r[0] for r in rows}:
        own = after.get(conv, [])
        faults = plain_faults(own)
        cost, audit, left = plain_repair(own, faults)
        turns = {r[0] for r in own if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, digest)
    return out


def talks(seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system"] * 6 + ["tool", None, "", "sys", "Ux"]
    rows = []
    for conv in [*range(80), None]:
        for turn in range(rng.choice([0, 1, 2, 3, 6, 14])):
            text = rng.choice(["Hi.", "What?", "no end", "  ", "", "Ok!", "line.\n", None, "a? ", f"u{turn}.", f"v{turn}!"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(roles), text))
    # One conversation that holds most of the rows.
    return rows + [(999, t, rng.choice(roles[:3]), f"text {rng.randrange(300)}" + rng.choice([".", "", "?"])) for t in range(400)]


@pytest.mark.parametrize("damage, block_rows, joined", [(True, 256, 64), (False, 2, 2), (True, 3, 4)])
def test_repair(spark, damage, block_rows, joined):
    rows = talks(block_rows)
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as conv", "1 as harm", "2 as pos")
    report, _ = conversations.repair(frame, damage, block_rows, joined)
    assert report.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r)[1:] for r in report.collect()} == plain_report(rows, damage)


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Why?"), (1, 3, "user", " ")]
    report, fixed = conversations.repair(spark.createDataFrame(rows, SCHEMA))
    row = report.first()
    assert (row["audit"], row["cost"]) == ("KRRD", 4)
    assert [tuple(x) for x in fixed.first()["rows"]] == [("system", "Be kind."), ("user", "Hello."), ("assistant", "Why?")]


def test_no_rows_and_none_left(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.repair(empty, damage=True)[0].collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = conversations.repair(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA), damage=True)[0].first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("base", [1_000_003, 0, 1])
def test_trails_compare_like_strings(base):
    """Also with hashes that collide all the time."""
    rng = random.Random(5)
    trail, texts = trails.Trails(base), {0: ""}
    for _ in range(300):
        node, letter = rng.choice(list(texts)), rng.choice("DIKR")
        texts[trail.add(node, letter)] = texts[node] + letter
    for _ in range(3000):
        a, b = rng.choice(list(texts)), rng.choice(list(texts))
        assert trail.text(a) == texts[a]
        assert trail.less(a, b) == (texts[a] < texts[b])


def test_cut_gives_back_the_audit():
    edits = "IKKDIRKRIIDDKKI"
    for rows in (1, 2, 3, 5, 100):
        parts = trails.cut(edits, rows)
        assert "".join(p for p, _ in parts) == edits
        assert all(len(p) - p.count("I") <= rows for p, _ in parts)
