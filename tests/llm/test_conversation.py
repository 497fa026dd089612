"""Repairs of conversations against all ways side by side."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quirelight.llm import conversation_repair as C
from quirelight.llm import queries

START, SYSTEM, USER, ASSISTANT = range(4)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def best(rows):
    """(cost, audit, repaired text) of rows (role, text, fault): every state's cheapest way with the least audit."""
    after = lambda s: USER if s != USER else ASSISTANT
    name = {USER: "user", ASSISTANT: "assistant"}

    def with_inserts(ways):
        out = {}
        for s, w in ways.items():
            for k in range(4):
                if s not in out or w[:2] < out[s][:2]:
                    out[s] = w
                w, s = (w[0] + 3, w[1] + "I", [*w[2], f"{name[after(s)]}:"]), after(s)
        return out

    ways = {START: (0, "", [])}
    for role, text, fault in rows:
        new = {}

        def put(s, way, new=new):
            if s not in new or way[:2] < new[s][:2]:
                new[s] = way

        def all_with_inserts(ways):
            for s, w in ways.items():
                for _ in range(4):
                    yield s, w
                    w, s = (w[0] + 3, w[1] + "I", [*w[2], f"{name[after(s)]}:"]), after(s)

        for s, (cost, audit, told) in all_with_inserts(ways):
            put(s, (cost + 4, audit + "D", told))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                to = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(role[:1])
                if to == SYSTEM and s == START or to == USER and s != USER or to == ASSISTANT and s == USER:
                    put(to, (cost + more, audit + "K", [*told, f"{role}:{text}"]))
                put(after(s), (cost + more + 3, audit + "R", [*told, f"{name[after(s)]}:{text}"]))
        ways = new
    ends = [w for s, w in with_inserts(ways).items() if s in (START, ASSISTANT)]
    cost, audit, told = min(ends, key=lambda w: w[:2])
    return cost, audit, "\n".join(told)


def plain(table):
    """The query's rows from (conv_id, turn, role, text)."""
    spaced = lambda x: " " if x is None else str(x)
    convs = {}
    for conv, turn, role, text in table:
        own = convs.setdefault(conv, [])
        role, text = spaced(role), spaced(text)
        lot = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        if lot == 0:
            continue
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        own += [(turn, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(r[2])))
        seen, judged = set(), []
        for _, role, text in rows:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts = [sum(f == k for *_, f in judged) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False))
        cost, audit, text = best(judged)
        out[conv] = (gaps, *counts, illegal, cost, audit, sha(text))
    return out


@pytest.fixture(scope="module")
def table():
    rng = random.Random(8)
    text = lambda: rng.choice(["Yes.", "No", "", " \n", "Why?", "Oh!", "so\u2028", f"text {rng.random()}.", f"cut {rng.random()}"])
    role = lambda: rng.choices(["user", "assistant", "system", "tool", "", None, "Über"], [40, 40, 8, 3, 1, 2, 1])[0]
    rows = [(c, t, role(), text()) for c in range(150) for t in range(rng.randint(1, 9)) if rng.random() < 0.9]
    rows += [(1000, t, rng.choice(("user", "assistant")), text()) for t in range(1500)]  # across all partitions
    rows += [(1001, 5, role(), f"{k}.") for k in range(300)]  # one turn
    rows += [(1002, 3, "user", "same")] * 200 + [(1002, 4, "assistant", "same")] * 3
    rows += [(1003, None, role(), text()) for _ in range(30)] + [(None, t, role(), text()) for t in range(30)]
    rows += [(1004, 1, "user", "long " * 200_000), (1005, 1, None, None), (1006, 2, "system", "Only."), (1007, 1, "user", "Hi."), (1007, 9, "assistant", "Ho.")]
    rng.shuffle(rows)
    return rows


def test_query_against_all_ways(spark, table, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 4)
    spark.createDataFrame([(*r, "x") for r in table], "conv_id long, turn long, role string, text string, audit string").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    expected = plain(table)
    found = queries.op12_conversation_repair(spark, str(tmp_path)).collect()
    assert len(found) == len(expected)
    for r in found:
        assert tuple(r)[1:] == expected[r.conv_id], r.conv_id
    assert expected[1000][5] > 100


def test_pieces_of_long_conversations(spark, table, monkeypatch):
    """A digest over many pieces is that of the whole."""
    monkeypatch.setattr(C, "PIECE", 50)
    rows = [r for r in table if r[0] in (1000, 1001, 1004)]
    found = C.reports(C.repaired(C.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    expected = plain(rows)
    for r in found.collect():
        assert tuple(r)[1:] == expected[r.id], r.id


def test_halves_meet_as_the_whole_does():
    rng = np.random.default_rng(3)
    for size in (1, 2, 65, 300, 1000):
        kinds = rng.integers(0, 12, size)
        end = C.best_end(C.forward(C.start_vector(C.START), kinds))
        whole, halves = [], []
        C._leaf(kinds.tolist(), C.START, end, whole)
        C.solve(kinds, C.START, end, halves)
        assert whole == halves
        cuts = sorted(rng.integers(0, size + 1, 5).tolist())
        parts = [p for p in np.split(kinds, cuts) if len(p)]
        states = C.crossings([[C.forward(C.start_vector(s), p) for s in range(4)] for p in parts])
        joined = []
        for part, a, b in zip(parts, states, states[1:], strict=False):
            C.solve(part, a, b, joined)
        assert joined == whole


def test_empty_table(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert C.reports(C.repaired(spark.createDataFrame([], kind))).count() == 0


def test_edits_are_rows(spark):
    rows = [(1, 1, "system", "S."), (1, 2, "assistant", "Hi."), (1, 2, "assistant", "Hi."), (1, 3, "user", "No"), (1, 4, "tool", "Oh.")]
    found = C.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("run", "place").collect()
    assert [(r.edit, r.times, r.role, r.text, r.fault, r.illegal) for r in found] == [
        ("K", 1, "system", "S.", "", 0), ("I", 1, "user", "", None, 0), ("K", 1, "assistant", "Hi.", "", 2), ("D", 1, None, None, "duplicate", 0), ("K", 1, "user", "No", "truncated", 0), ("R", 1, "assistant", "Oh.", "", 1),
    ]
