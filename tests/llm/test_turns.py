"""Conversation repair against a search over all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from eventlane.llm import queries, turns

NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}
FULL = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, audit, lines) of the best edits of (initial, fault, line), by recursion from the front."""

    @lru_cache(maxsize=None)
    def best(i, last, inserted):
        ways = []
        if i == len(rows) and last in ("", "a"):
            ways.append((0, "", ()))
        if inserted < 3:
            for to in NEXT[last].replace("s", ""):
                c, a, r = best(i, to, inserted + 1)
                ways.append((c + 5, "I" + a, (FULL[to] + ":", *r)))
        if i < len(rows):
            initial, fault, line = rows[i]
            c, a, r = best(i + 1, last, 0)
            ways.append((c + 2, "D" + a, r))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if initial and initial in NEXT[last]:
                    c, a, r = best(i + 1, initial, 0)
                    ways.append((c + more, "K" + a, (line, *r)))
                for to in NEXT[last].replace("s", ""):
                    c, a, r = best(i + 1, to, 0)
                    ways.append((c + 1 + more, "R" + a, (FULL[to] + line[line.index(":") :], *r)))
        return min(ways) if ways else (10**9, "", ())

    return best(0, "", 0)


def expected(data):
    """The contract over plain (conv_id, turn, role, text) rows."""
    out = {}
    for conv, turn, role, text in data:
        name = " " if conv is None else conv
        harm = zlib.crc32(f"{name}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        rows = out.setdefault(conv, [])
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        rows += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    found = {}
    for conv, rows in out.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, judged = set(), []
        for _, role, text in rows:
            shown = re.sub("[\x20\x09-\x0d]", "", text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated"
            seen.add((role, text))
            judged.append((role[:1], fault, f"{role}:{text}"))
        known = [t for t, _, _ in rows if t is not None]
        cost, audit, lines = cheapest(tuple(judged))
        found[conv] = (
            max(known) - min(known) + 1 - len(set(known)) if known else 0,
            *(sum(f == fault for _, f, _ in judged) for fault in ("blank", "duplicate", "truncated")),
            sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:])),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return found


def repaired(spark, data, **more):
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    rows = turns.repair(turns.damaged(df)).collect()
    assert len(rows) == len({r.conv_id for r in rows})
    return {r.conv_id: tuple(r)[1:] for r in rows}


def made(seed, conversations, longest):
    draw = random.Random(seed)
    texts = ["yes.", "no", "well!", " ", "", "why?\n", "Ok. ", "x\ty", "é…", "."]
    roles = ["user", "assistant", "system", "tool", "", "unknown", None, "user", "assistant"]
    rows = []
    for conv in range(conversations):
        given = draw.choice([roles, ["user", "assistant"], ["tool"], ["system", "user"]])
        turn = 0
        for i in range(draw.randint(1, longest)):
            turn += draw.choice([1, 1, 1, 2, -1])
            text = draw.choice([*texts, None, f"text {i}.", f"text {i}", f"words {i}!"])
            rows.append((conv if conv else None, draw.choice([turn] * 12 + [None]), draw.choice(given), text))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_search(spark, seed):
    data = made(seed, 250, 14)
    got, want = repaired(spark, data), expected(data)
    assert got.keys() == want.keys()
    assert {c: (got[c], want[c]) for c in want if got[c] != want[c]} == {}


def test_scratch_file_and_early_results_change_nothing(monkeypatch):
    draw = random.Random(5)
    for case in range(200):
        rows = [(draw.choice(["sua", "t", "ua", "tu"][case % 4]), draw.choice(["", "", "", "truncated", "blank"])) for _ in range(draw.randint(1, 60))]
        results = []
        for held in (1 << 23, 40, 5):
            monkeypatch.setattr(turns, "HELD", held)
            own = turns._Conversation(1)
            for i, (initial, fault) in enumerate(rows):
                code = {"": turns.SOUND, "truncated": turns.TRUNCATED, "blank": turns.BLANK}[fault]
                own.add(i, initial, str(i).encode(), f"line {i}", code)
            results.append(own.result())
        assert results[0] == results[1] == results[2]
        cost, audit, lines = cheapest(tuple((r, f, f"{r}:line {i}") for i, (r, f) in enumerate(rows)))
        assert results[0][6:] == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_a_giant_conversation_spills(monkeypatch):
    monkeypatch.setattr(turns, "HELD", 1 << 14)
    own = turns._Conversation(1)
    spills = 0
    for i in range(60_000):
        # Neither parity ever wins: all rows must be given a role.
        own.add(i, "tool", str(i).encode(), "some text.", turns.SOUND)
        spills += own.spilled is not None
        assert own.size <= 1 << 15
    found = own.result()
    assert spills > 30_000 and found[6] == 60_000 and found[7] == "R" * 60_000
    lines = "\n".join(f"{('user', 'assistant')[i % 2]}:some text." for i in range(60_000))
    assert found[8] == hashlib.sha256(lines.encode()).hexdigest()


def test_costs_stay_few():
    """The search knows a bounded number of situations, whatever the rows."""
    draw = random.Random(9)
    places = turns.BEGIN[0]
    for _ in range(100_000):
        places, _, _ = turns._step(places, draw.choice("suat"), draw.choice([0, 0, 0, 1, 2, 3]))
    assert len(turns._steps) < 5000


def test_edges(spark):
    assert repaired(spark, []) == {}
    empty = hashlib.sha256(b"").hexdigest()
    dropped = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    assert repaired(spark, [(7, dropped, "user", "hi.")]) == {7: (0, 0, 0, 0, 0, 0, "", empty)}
    long = "many words. " * 300_000
    data = [(1, 5, "user", long), (1, 6, "assistant", long + "x"), (1, 6, "assistant", long + "x"), (None, None, None, None), (None, None, None, None)]
    assert repaired(spark, data) == expected(data)


def test_extra_columns_and_other_names(spark):
    df = spark.createDataFrame([("c", 1, "user", "Hi.", 3, 4), ("c", 2, "assistant", "Ho.", 5, 6)], "thread string, n int, who string, said string, digest int, kind int")
    rows = turns.repair(turns.damaged(df, "thread", "n", "who", "said"), "thread").collect()
    want = expected([("c", 1, "user", "Hi."), ("c", 2, "assistant", "Ho.")])
    assert [(r.thread, *tuple(r)[1:]) for r in rows] == [("c", *want["c"])]


def test_query(spark):
    data = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows = queries.op12_conversations(spark, "/root/testdata/sf0.01").collect()
    assert {r.conv_id: tuple(r)[1:] for r in rows} == expected(data) and len(rows) == len({d[0] for d in data})
