"""Conversation repair against a search over all edits."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from skeinwork.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, of string, part long, fault string"
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def damaged(rows):
    """The contract's damage, row by row: (conv_id, turn, role, text)."""
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    place = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:64], hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest())
    return sorted(out, key=place)


def all_edits(turns, must, cut):
    """(cost, audit, lines) of every way to edit turns (role, text), with up to three insertions at a place, that is legal."""
    runs = [[]] + [list(x) for n in (1, 2, 3) for x in product(("user", "assistant"), repeat=n)]
    ways = {("", ""): (0, [])}  # (audit, initials): cost and lines; of equal ones either
    for i in range(len(turns) + 1):
        new = {}
        for (audit, initials), (cost, lines) in ways.items():
            for run in runs:
                base = (audit + "I" * len(run), initials + "".join(r[0] for r in run), cost + 3 * len(run), lines + [f"{r}:" for r in run])
                if i == len(turns):
                    edits = [("", "", 0, [])]
                else:
                    role, text = turns[i]
                    more = 3 if cut[i] else 0
                    edits = [("D", "", 4, [])]
                    if not must[i]:
                        edits += [("K", role[:1] or "-", more, [f"{role}:{text}"]), ("R", "u", 3 + more, [f"user:{text}"]), ("R", "a", 3 + more, [f"assistant:{text}"])]
                for letter, initial, extra, made in edits:
                    if re.match(r"s?(ua)*u?\Z", base[1] + initial):
                        new[base[0] + letter, base[1] + initial] = min(new.get((base[0] + letter, base[1] + initial), (10**9, [])), (base[2] + extra, base[3] + made))
        ways = new
    return min((cost, audit, lines) for (audit, initials), (cost, lines) in ways.items() if LEGAL.match(initials))


def by_strings(turns, must, cut):
    """The same for longer conversations: the least (cost, audit) of each state, as strings."""
    moves = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    insert = lambda states: {q: min(x for x in [states.get(q), *((c + 3, a + "I", ls + [{"u": "user", "a": "assistant"}[q] + ":"]) for p, (c, a, ls) in states.items() if q in "ua" and q in moves[p])] if x) for q in {*states, *(m for p in states for m in moves[p] if m in "ua")}}
    states = {"": (0, "", [])}
    for (role, text), d, t in zip(turns, must, cut):
        for _ in range(3):
            states = insert(states)
        new = {}
        for p, (c, a, ls) in states.items():
            found = [(p, (c + 4, a + "D", ls))]
            if not d:
                more = 3 if t else 0
                found += [(moves[p][q], (c + 3 + more, a + "R", ls + [f"{n}:{text}"])) for q, n in (("u", "user"), ("a", "assistant")) if q in moves[p]]
                if role[:1] in moves[p]:
                    found.append((moves[p][role[:1]], (c + more, a + "K", ls + [f"{role}:{text}"])))
            for q, x in found:
                new[q] = min(new.get(q, x), x)
        states = new
    for _ in range(3):
        states = insert(states)
    return min(states[q] for q in ("", "a") if q in states)


def expected(rows, solve):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = damaged([r for r in rows if r[0] == conv])
        seen, kinds = set(), []
        for _, _, role, text in mine:
            bare = text.strip(" \t\n\x0b\x0c\r")
            kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for _, t, _, _ in mine if t is not None]
        cost, audit, lines = solve([r[2:] for r in mine], [k in ("blank", "duplicate") for k in kinds], [k == "truncated" for k in kinds])
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    got = repair.repair(spark, repair.damage(df)).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}


def made(rng, conv, n):
    texts = ["Yes.", "No!", "Why", "", " \n", "A long one. And more", "Ünd so?", "x" * 100, "x" * 100 + "y.", None]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]
    return [(conv, None if rng.random() < 0.08 else rng.randint(0, n + 1), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"text {rng.randint(0, 99)}.") for _ in range(n)]


@pytest.fixture
def spread(spark):
    """Many partitions of few rows, so that conversations cross them."""
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "9"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_short_conversations_equal_all_edits(spark):
    rng = random.Random(3)
    rows = [r for conv in range(60) for r in made(rng, conv, rng.randint(1, 3))] + [r for r in made(rng, None, 3)]
    assert found(spark, rows) == expected(rows, all_edits) == expected(rows, by_strings)


def test_conversations_across_partitions(spark, spread):
    rng = random.Random(4)
    rows = [r for conv, n in enumerate([400, 1, 2, 150, 7, 7, 3, 60]) for r in made(rng, conv, n)] + [(9, 5, "user", "same.")] * 70
    assert found(spark, rows) == expected(rows, by_strings)


def test_ranks_follow_the_order_of_audits():
    rng = random.Random(6)
    for _ in range(20):
        search = repair.Search([*range(4)])
        for _ in range(12):
            search.layer(repair.MOVES[rng.choice("sua") if rng.random() < 0.9 else "", rng.randint(0, 3)])
            now = {(e, q): "".join(repair.CODES[c] for c in repair.walk(search.back, [*range(4)], e, q)) for e, q in search.lanes}
            for a in now:
                for b in now:
                    assert (search.lanes[a][1] < search.lanes[b][1]) == (now[a] < now[b])


def test_nothing_left_and_empty_tables(spark):
    gone = next(k for k in range(10_000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert found(spark, [(gone, 0, "user", "Hi.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert found(spark, []) == {}
