"""Repair of conversations against a plain search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from vitalgrid.llm import turn_repair
from vitalgrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


def _order(r):
    return (r[1] is not None, r[1] or 0, r[2], r[3][:64], hashlib.sha256(r[3].encode()).hexdigest())


def _cheapest(kinds):
    """(cost, audit) by Dijkstra's search over (row, state), letters compared as text. States: '', s, u, a."""
    leads = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(kinds) and state in ("", "a"):
            return cost, audit
        for new in "ua":
            if (state, new) in leads:
                heapq.heappush(heap, (cost + 3, audit + "I", i, leads[state, new]))
        if i < len(kinds):
            must, initial, extra = kinds[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state))
            if not must:
                if (state, initial) in leads:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, leads[state, initial]))
                for new in "ua":
                    if (state, new) in leads:
                        heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, leads[state, new]))
    raise AssertionError


def _brute(rows):
    """The report's row of one conversation's rows (conv, turn, role, text)."""
    rows = sorted(((c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows), key=_order)
    known = {r[1] for r in rows if r[1] is not None}
    kinds, seen, n = [], set(), {"b": 0, "d": 0, "t": 0}
    for _, _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            n[fault] += 1
        kinds.append((fault in ("b", "d") and fault != "", role[:1], 3 * (fault == "t")))
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = _cheapest(kinds)
    out, state, i = [], "", 0
    for letter in audit:
        new = "assistant" if state == "u" else "user"
        if letter == "I":
            out.append(f"{new}:")
            state = new[0]
            continue
        if letter != "D":
            role = rows[i][2] if letter == "K" else new
            out.append(f"{role}:{rows[i][3]}")
            state = role[0]
        i += 1
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    return {"gaps": gaps, "blank": n["b"], "duplicate": n["d"], "truncated": n["t"], "illegal": illegal, "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest()}


def _groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def _made(n, seed):
    rng = random.Random(seed)
    out = []
    for conv in range(n):
        for _ in range(rng.choice([1, 2, 3, 5, 9, 14])):
            out.append((conv if conv % 17 else None, rng.choice([None, *range(8)]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "User", "u"]),
                        rng.choice(["Yes.", "No!", "cut off", "", " \t", None, "why? \n", "é.", f"own {rng.random()}.", f"own {rng.random()}"])))
    return out


@pytest.mark.parametrize("size, seed", [(4096, 1), (3, 2), (1, 3)])
def test_reports_equal_a_search_over_all_edits(spark, rows, size, seed):
    data = _made(130, seed)
    table = spark.createDataFrame(data, TURNS).select("*", *[F.lit("x").alias(c) for c in ("conv", "part", "chunk", "symbols", "copies", "audit", "digest")])
    fixed = turn_repair.repair(table, size=size)
    got = rows(turn_repair.with_all(table, fixed.report()))
    want = {c: _brute(r) for c, r in _groups(data).items()}
    assert len(got) == len(want)
    for r in got:
        assert {k: r[k] for k in want[r["conv_id"]]} == want[r["conv_id"]], r["conv_id"]
    turns = {}
    for r in rows(fixed.turns().orderBy("part", "chunk", "place")):
        turns.setdefault(r["conv"], []).append(f"{r['role']}:{r['text']}")
    for c, w in want.items():
        lines = turns.get(c, [])
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == w["repaired_sha256"]
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))


def test_one_hot_conversation_over_many_chunks(spark, rows):
    rng = random.Random(7)
    hot = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", f"{t} so", f"{t}."])) for t in range(700)]
    legal = [(2, t, "system" if t == 0 else "user" if t % 2 else "assistant", f"{t}.") for t in range(301)]
    same = [(3, 5, "user", "again.")] * 50 + [(3, None, "assistant", "x" * 100_000 + ".")]
    data = hot + legal + same
    fixed = turn_repair.repair(spark.createDataFrame(data, TURNS), size=40)
    assert fixed.passes >= 2 and fixed.tied.count() > 15
    got = {r["conv"]: r for r in rows(fixed.report())}
    for c, r in _groups(data).items():
        want = _brute(r)
        assert {k: got[c][k] for k in want} == want


def test_chunks_stop_where_vectors_differ_by_a_constant():
    walk, symbols = turn_repair.Walk(), "uaUAoxsu" * 50
    speculative = walk.backward(symbols, turn_repair.END)
    for right in [(0, 0, 0, 0), (5, 1, 0, 3), (0, 9, 6, 3)]:
        assert walk.backward(symbols, right)[0::2] == walk.backward(symbols, right, speculative[2])[0::2]


def test_damage_and_conversations_without_rows(spark, rows):
    dropped = next(t for t in range(999) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    kinds = {k: next(t for t in range(999) if zlib.crc32(f"8:{t}".encode()) % 20 == k) for k in (1, 2, 3, 4, 5)}
    table = spark.createDataFrame([(7, dropped, "user", "a."), *[(8, t, "assistant", "W. o?") for t in kinds.values()], (None, None, None, None)], TURNS)
    got = sorted((r["turn"], r["role"], r["text"]) for r in rows(turn_repair.damage(table)) if r["conv_id"] == 8)
    assert got == sorted([(kinds[1], "assistant", ""), (kinds[2], "assistant", "W o"), *[(kinds[3], "assistant", "W. o?")] * 2, (kinds[4], "user", "W. o?"), (kinds[5], "assistant", "W. o?")])
    out = {r["conv_id"]: r for r in rows(turn_repair.with_all(table, turn_repair.repair(turn_repair.damage(table)).report()))}
    assert set(out) == {7, 8, None}
    assert out[7] == {"conv_id": 7, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    assert turn_repair.repair(spark.createDataFrame([], TURNS)).report().count() == 0


def test_query_over_the_whole_table(spark, rows):
    data = pq.read_table(f"{SF}/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pylist()
    damaged = []
    for r in data:
        kind = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", r["text"]) if kind == 2 else r["text"]
        damaged += [(r["conv_id"], r["turn"], "user" if kind == 4 else r["role"], text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    want = {c: _brute(r) for c, r in _groups(damaged).items()}
    got = rows(QUERIES["op11_turn_repair"](spark, SF))
    assert len(got) == len({r["conv_id"] for r in data})
    for r in got:
        expected = want.get(r["conv_id"], _brute([]))
        assert {k: r[k] for k in expected} == expected
