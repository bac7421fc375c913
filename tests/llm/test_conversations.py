"""Conversation repair against an exhaustive search over edits."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from pairloom.llm import conversation_repair
from pairloom.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = [" " if x is None else x for x in (conv, turn, role, text)]
        case = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = shown[2], shown[3]
        if case == 0:
            continue
        if case == 1:
            text = ""
        if case == 2:
            text = re.sub("[.!?]", "", text)
        if case == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if case == 3 else 1)
    return out


def fits(initials):
    return re.fullmatch("(s?(ua)+)?", initials) is not None


def could_fit(initials):
    return any(fits(initials + end) for end in ("", "a", "ua"))


def plain_plan(rows):
    """Uniform-cost search over (cost, audit): the first complete one is the answer. ``rows``: role, text, fault."""
    heap, seen = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, initials, out = heapq.heappop(heap)
        state = at, initials[-1:] if initials else ""
        if at == len(rows) and fits(initials):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
        if state in seen:
            continue
        seen.add(state)
        ways = [(2, "I", at, role, "") for role in ("user", "assistant")]
        if at < len(rows):
            role, text, fault = rows[at]
            ways.append((3, "D", at + 1, None, None))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                ways += [(extra, "K", at + 1, role, text)] + [(2 + extra, "R", at + 1, r, text) for r in ("user", "assistant")]
        for add, edit, then, role, text in ways:
            if role is None:
                heapq.heappush(heap, (cost + add, audit + edit, then, initials, out))
            elif role[:1] and could_fit(initials + role[0]):
                heapq.heappush(heap, (cost + add, audit + edit, then, initials + role[0], (*out, (role, text))))


def plain_repair(rows, damage=True):
    found = {}
    after = plain_damage(rows) if damage else [tuple(" " if x is None and i > 1 else x for i, x in enumerate(r)) for r in rows]
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, marked, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in mine:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            marked.append((role, text, fault))
        turns = {r[1] for r in mine if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        cost, audit, text = plain_plan(marked)
        found[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return found


def results(df):
    rows = df.collect()
    got = {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_over_the_given_table(spark, folder):
    path = f"/root/testdata/{folder}"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert results(QUERIES["op12_conversation_repair"](spark, path)) == plain_repair(rows)


def test_every_short_signature_has_the_least_cost_and_audit():
    suffixes = conversation_repair.Suffixes()
    names = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}
    every = ["".join(p) for n in range(4) for p in itertools.product("suaoSUAOx", repeat=n)]
    for signature in sorted(every, key=lambda s: s[::-1]):
        rows = [(names[c.lower()], str(i), "blank" if c == "x" else "truncated" if c.isupper() else None) for i, c in enumerate(signature)]
        assert suffixes.plan(signature) == plain_plan(rows)[:2], signature
    assert suffixes.made == sum(9**n for n in range(1, 4))  # one node for each distinct suffix


def random_rows(seed, n):
    draw = random.Random(seed)
    rows = []
    for conv in range(n):
        conv = None if conv == 3 else conv
        for _ in range(draw.randrange(1, 12)):
            role = draw.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "unknown"])
            text = draw.choice(["Yes.", "No", "", None, " \n", "Why?", "a. \t", "été", "x!\x1f", "Yes.", "𝒳."])
            rows.append((conv, draw.choice([None, *range(9), 40, -5]), role, text))
    return rows


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = random_rows(5, 150)
    frame = spark.createDataFrame([(*r, "x", 1, "k") for r in rows], SCHEMA + ", place string, cost int, signature string")
    assert results(conversation_repair.repair(conversation_repair.damaged(frame))) == plain_repair(rows)
    assert results(conversation_repair.repair(conversation_repair.unharmed(frame))) == plain_repair(rows, damage=False)


def test_pieces_of_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "PIECE", 7)
    draw = random.Random(2)
    rows = [(1, i, draw.choice(["user", "assistant", "system"]), f"{draw.randrange(400)}{draw.choice('.!ab')}") for i in range(900)]
    rows += [(2, 0, "user", "Hi " * 400_000 + "."), (2, 1, "assistant", "Yo.")]
    assert results(conversation_repair.repair(conversation_repair.damaged(spark.createDataFrame(rows, SCHEMA)))) == plain_repair(rows)


def test_conversation_without_rows_and_empty_table(spark):
    gone = next(i for i in range(1_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)
    assert results(conversation_repair.repair(conversation_repair.damaged(frame))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert conversation_repair.repair(conversation_repair.damaged(frame.where(F.lit(False)))).count() == 0
