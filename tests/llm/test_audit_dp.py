"""Conversation repair against brute force over all audits, in one chunk and in many."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import audit_dp

SCHEMA = "conv_id long, turn long, role string, text string, audit string, place long"
BLANK = " \t\n\x0b\x0c\r"


def faulty(rows):
    """Fault of each row (role, text), in order."""
    seen, out = set(), []
    for role, text in rows:
        trimmed = text.rstrip(BLANK)
        fault = "blank" if not trimmed else "duplicate" if (role, text) in seen else "truncated" if trimmed[-1] not in ".!?" else None
        seen.add((role, text))
        out.append(fault)
    return out


def all_audits(rows):
    """(cost, audit, repaired turns) of every audit with at most two inserts in a row that gives a legal conversation."""
    faults, out = faulty(rows), []
    for inserts in itertools.product(range(3), repeat=len(rows) + 1):
        for letters in itertools.product("DKR", repeat=len(rows)):
            cost, audit, turns, legal = 0, "", [], True
            for at in range(len(rows) + 1):
                for _ in range(inserts[at]):
                    turns.append(("assistant" if turns and turns[-1][0][:1] == "u" else "user", ""))
                    cost, audit = cost + 3, audit + "I"
                if at == len(rows):
                    break
                audit += letters[at]
                if letters[at] == "D":
                    cost += 4
                    continue
                legal &= faults[at] not in ("blank", "duplicate")
                cost += 3 * (faults[at] == "truncated") + 3 * (letters[at] == "R")
                to = "assistant" if turns and turns[-1][0][:1] == "u" else "user"
                turns.append((rows[at][0] if letters[at] == "K" else to, rows[at][1]))
            if legal and all(turn[0] for turn in turns) and re.fullmatch("(s?(ua)+)?", "".join(turn[0][0] for turn in turns)):
                out.append((cost, audit, turns))
    return min(out, key=lambda x: x[:2])


def conversation(random, length):
    roles = ["user", "assistant", "system", "assistant", "user", "tool", "u", "", " "]
    texts = ["Fine.", "Yes!", "cut off", "Why? ", " ", "", "ok.\n"]
    return [(str(random.choice(roles)), str(random.choice(texts))) for _ in range(length)]


def expected(rows):
    cost, audit, turns = all_audits(rows)
    faults, pairs = faulty(rows), [a[:1] + b[:1] for (a, _), (b, _) in itertools.pairwise(rows)]
    counts = [faults.count(x) for x in ("blank", "duplicate", "truncated")] + [sum(p not in ("su", "ua", "au") for p in pairs)]
    return counts, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest(), turns


@pytest.mark.parametrize("chunk", [1, 20_000])
def test_repair_against_all_audits(spark, monkeypatch, chunk):
    monkeypatch.setattr(audit_dp, "CHUNK_ROWS", chunk)
    random = np.random.default_rng(11)
    talks = {i: conversation(random, int(random.integers(1, 5))) for i in range(120)}
    rows = [(i, t, r, x, "clash", 1) for i, own in talks.items() for t, (r, x) in enumerate(own)]
    repaired, audits = audit_dp.repair(spark.createDataFrame(rows, SCHEMA))
    repaired = repaired.checkpoint()
    found = {r["conv_id"]: r for r in audits.collect()}
    digests = {r["conv_id"]: r["sha256"] for r in audit_dp.digests(repaired).collect()}
    turns = {}
    for r in repaired.orderBy("conv_id", "chunk", "step").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert len(found) == len(talks)
    for i, own in talks.items():
        counts, cost, audit, digest, left = expected(own)
        assert ([found[i][c] for c in audit_dp.COUNTS], found[i]["cost"], found[i]["audit"]) == (counts, cost, audit), own
        assert turns.get(i, []) == left and digests.get(i, hashlib.sha256().hexdigest()) == digest


def test_a_conversation_over_many_chunks(spark, monkeypatch):
    random = np.random.default_rng(12)
    rows = [(7, int(t) if t % 50 else None, *conversation(random, 1)[0], "x", 1) for t in range(700)]
    rows += [(i, 0, "user", "Hello.", "x", 1) for i in range(20)]
    turns = spark.createDataFrame(rows, SCHEMA)
    out = []
    for chunk in (10**9, 9):
        monkeypatch.setattr(audit_dp, "CHUNK_ROWS", chunk)
        if chunk > 9:
            spark.conf.set("spark.sql.shuffle.partitions", "1")
        repaired, audits = audit_dp.repair(turns)
        repaired = repaired.checkpoint()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        chunks = repaired.filter("conv_id = 7").select("chunk").distinct().count()
        assert (chunks == 1) == (chunk > 9) and (chunk > 9 or chunks > 5)
        digests = {r["conv_id"]: r["sha256"] for r in audit_dp.digests(repaired).collect()}
        out.append((sorted(map(tuple, audits.collect())), digests))
    assert out[0] == out[1] and len(out[0][1]) == 20


def test_prefix_search_tells_equal_costs_apart(monkeypatch):
    # A hash that is the same for everything: nodes still tell strings apart.
    monkeypatch.setattr(audit_dp, "MODULUS", 1)
    trail, random = audit_dp.Trail(), np.random.default_rng(3)
    strings = {"".join(random.choice(list("DIKR"), int(random.integers(0, 40)))) for _ in range(60)}
    strings |= {s + "I" for s in list(strings)[:20]} | {s[:5] for s in strings}
    nodes = {}
    for s in strings:
        node = 0
        for letter in s:
            node = trail.extended(node, letter)
        nodes[s] = node
    for a, b in itertools.product(strings, repeat=2):
        assert trail.less(nodes[a], nodes[b]) == (a < b)


def test_pieces_of_unlike_length():
    trail = audit_dp.Trail()
    paths = [("KD", "IK"), ("KDI", "D"), ("KDI", "K"), ("K", "DIR")]
    nodes = [trail.extended(trail.extended(0, a), b) for a, b in paths]
    for (one, x), (two, y) in itertools.product(zip(paths, nodes, strict=True), repeat=2):
        assert trail.less(x, y) == ("".join(one) < "".join(two))


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert audit_dp.structure_repair(empty).count() == 0 and all(f.count() == 0 for f in audit_dp.repair(empty))
    long = "word " * 400_000 + "end."
    rows = [
        (None, 1, "user", "Hi.", "x", 1), (None, 2, "assistant", "Yes.", "x", 1), (3, None, None, None, "x", 1), (4, 5, "user", long, "x", 1),
        (4, 6, "assistant", long, "x", 1), (5, 1, "user", "Same.", "x", 1), (5, 1, "user", "Same.", "x", 1), (6, 2, "assistant", "One.", "x", 1),
        (6, 2, "user", "Two.", "x", 1), (8, -(2**63), "user", "Far.", "x", 1), (8, 2**63 - 1, "assistant", "Away.", "x", 1),
    ]
    turns = spark.createDataFrame(rows, SCHEMA)
    repaired, audits = audit_dp.repair(turns)
    found = {r["conv_id"]: r for r in audits.collect()}
    assert {i: r["audit"] for i, r in found.items()} == {None: "KK", 3: "D", 4: "KK", 5: "KDI", 6: "IKKI", 8: "KK"}
    # Of one turn number, the role orders.
    assert found[5]["duplicate"] == 1 and found[3]["blank"] == 1
    digests = {r["conv_id"]: r["sha256"] for r in audit_dp.digests(repaired).collect()}
    assert digests[4] == hashlib.sha256(f"user:{long}\nassistant:{long}".encode()).hexdigest() and 3 not in digests
    assert {r["conv_id"]: r["gaps"] for r in audit_dp.gaps(turns).collect()} == {None: 0, 3: 0, 4: 0, 5: 0, 6: 0, 8: 2**63 - 1}
    assert {r["conv_id"] for r in audit_dp.structure_repair(turns).collect()} == {None, 3, 4, 5, 6, 8}


def test_conversations_without_a_turn_after_the_damage(spark):
    gone = next(i for i in range(10**6) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    rows = [(gone, 1, "user", "Hi.", "x", 1), (gone, 1, "assistant", "Yes.", "x", 1)]
    out = audit_dp.structure_repair(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [tuple(r) for r in out] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_damage(spark):
    rows = [(1, t, None if t % 7 == 0 else "assistant", "A. b? c!", "x", 1) for t in range(200)] + [(None, None, "system", None, "x", 1)]
    turns = spark.createDataFrame(rows, SCHEMA)
    found = audit_dp.damaged(turns).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).collect()
    out = {}
    for c, t, role, text, *_ in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out[c, t, "user" if k == 4 else role, text] = 2 if k == 3 else 1
    assert {tuple(r)[:4]: r["n"] for r in found} == out
