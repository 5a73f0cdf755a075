"""Conversation repair against a search over all edit sequences."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from tallylog.llm import queries, repair
from tests.llm.test_operators import SF_DIR

BLANK = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(turns: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Least (cost, audit) by a search from the front that knows nothing of tables, lengths or blocks."""
    queue, done = [(0, "", 0, 0)], set()
    while queue:
        cost, audit, at, state = heapq.heappop(queue)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(turns) and state in (0, 3):
            return cost, audit
        if at < len(turns):
            initial, must_go, truncated = turns[at]
            heapq.heappush(queue, (cost + 3, audit + "D", at + 1, state))
            for char, after in (("s", 1), ("u", 2), ("a", 3)):
                fits = state == 0 if char == "s" else state in (0, 1, 3) if char == "u" else state == 2
                if fits and not must_go:
                    if initial == char:
                        heapq.heappush(queue, (cost + truncated, audit + "K", at + 1, after))
                    if char != "s":
                        heapq.heappush(queue, (cost + 2 + truncated, audit + "R", at + 1, after))
        heapq.heappush(queue, (cost + 2, audit + "I", at, 3 if state == 2 else 2))
    raise AssertionError


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        marks = BLANK.findall(text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def summary(turns):
    """turns: (turn, role, text), in any order."""
    turns = sorted(((t, r or " ", x or "" if x is not None else " ") for t, r, x in turns), key=lambda k: (k[0] is not None, k[0] or 0, k[1], k[2]))
    found = faults(turns)
    cost, audit = cheapest([(r[:1], f in ("blank", "duplicate"), f == "truncated") for (_, r, _), f in zip(turns, found, strict=True)])
    numbers = {t for t, _, _ in turns if t is not None}
    lines, at, wanted = [], iter(turns), "user"
    for edit in audit:
        turn = None if edit == "I" else next(at)
        if edit == "D":
            continue
        role, text = (wanted, "") if turn is None else (wanted if edit == "R" else turn[1], turn[2])
        lines.append(f"{role}:{text}")
        wanted = "assistant" if role[0] == "u" else "user"
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    return gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        case = zlib.crc32(key.encode()) % 20
        held = out.setdefault(conv, [])
        if case == 0:
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        held += [(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_query_against_search(spark):
    table = spark.read.parquet(f"{SF_DIR}/conversations.parquet")
    want = {conv: summary(turns) for conv, turns in damaged([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]).items()}
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in queries.op13_conversation_repair(spark, SF_DIR).collect()}
    assert got == want
    assert len(table.select("conv_id").distinct().collect()) == len(got)


@pytest.mark.parametrize("length", [0, 1, 2, 3, 7, 12])
def test_alignment_against_search(length):
    rng = random.Random(length)
    for _ in range(400):
        turns = tuple((rng.choice("ssuuuaaat"), rng.random() < 0.15, rng.random() < 0.2) for _ in range(length))
        found = repair.alignments(turns, repair.START, repair.ENDS)
        assert min(found.values()) == cheapest(list(turns))


def test_blocks_compose(spark, monkeypatch):
    """Conversations over many blocks and tasks, awkward rows, a clashing column; repaired turns follow the grammar."""
    rng = random.Random(5)
    rows = [(None, None, None, None, "x"), (None, 3, "user", "a.", "x"), (1, 1, "", "", "x"), (2, 1, "system", "x" * 300_000, "x"), (2, 1, "system", "x" * 300_000, "x")]
    for conv, size in ((3, 400), (4, 90), (5, 33), (6, 32), (7, 1)):
        for k in range(size):
            role = rng.choice(["user", "assistant", "assistant", "system", "tool", "user"])
            rows.append((conv, k if rng.random() < 0.9 else None, role, rng.choice([f"say {rng.randrange(50)}.", " \t", f"no end {k}", "Ok!"]), "x"))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, state string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        aligned = repair.blocks(table.repartition(5))
        got = {r.conv_id: r for r in repair.summaries(aligned).collect()}
        laid: dict = {}
        for r in sorted(repair.repaired_turns(aligned).collect(), key=lambda r: (r.part, r.seq, r.place)):
            laid.setdefault(r.conv_id, []).append((r.role, r.text))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert aligned.select("conv_id", "part").distinct().where("conv_id = 3").count() > 1
    by_conv: dict = {}
    for conv, *turn, _ in rows:
        by_conv.setdefault(conv, []).append(tuple(turn))
    for conv, turns in by_conv.items():
        assert tuple(got[conv][c] for c in COLUMNS) == summary(turns), conv
        lines = laid.get(conv, [])
        assert re.fullmatch("(s?(ua)+)?", "".join(role[:1] for role, _ in lines))
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines).encode()).hexdigest() == got[conv].repaired_sha256
    assert repair.repair(table.limit(0)).count() == 0
