"""Conversation structure repair: the cheapest edits that make the role initials of a conversation read ``(s?(ua)+)?``.

Turns are aligned to every feasible length of the alternating grammar string by Wagner-Fischer tables. A table only holds
the Ukkonen band that the incumbent cost leaves: c - r columns off the diagonal cost at least 2 an insertion or 3 a
deletion. Of the alignments of least cost the one whose audit (the initials of its edits) is least in ASCII order wins.

Costs: Keep 0, Rerole to user or assistant 2, Delete 3, Insert an empty user or assistant turn 2; a truncated turn that stays
adds 1; blank and duplicate turns must be deleted.

A conversation may be of any length, so it never meets in one task before it is aligned: turns are range-partitioned by
(conv_id, turn) and cut into blocks of BLOCK turns; a block is aligned for each grammar state it may be entered and left in.
Blocks compose: of equal cost and states no audit is a proper prefix of another (what is longer would only be insertions, which
cost), so the least audit of the whole is made of least audits. One task then streams a conversation's blocks in order,
holding one block, an audit and a running hash per state; the hash of the repaired text is sequential by nature.

Defined cases: turns are taken by turn (nulls first), then role, then text; null roles and texts are one space; a null conv_id is
a conversation of its own; rows equal in all four columns are repeated turns, the later ones duplicates; texts may be of
any length; an empty table gives an empty result; columns besides the four are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tallylog.llm.common import written

BLOCK = 32
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Grammar states: nothing yet, after s, after u, after a. A conversation may end in the first or the last.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: The alternating strings that may follow a state: first characters and the pair that repeats after them.
FOLLOW = {START: (("", "ua"), ("s", "ua")), SYSTEM: (("", "ua"),), USER: (("", "au"),), ASSISTANT: (("", "ua"),)}
ROLES = {"u": "user", "a": "assistant"}
STATE_OF = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NOT_BLANK = r"[^\x20\x09-\x0D]"
SUMMARY = "n_turns long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, path array<byte>"

#: A turn as the alignment sees it: role initial, whether it must go, whether it is truncated.
Seen = tuple[str, bool, bool]


def _target(first: str, pair: str, length: int) -> str:
    return (first + pair * (length // 2 + 1))[:length]


def _table(turns: tuple[Seen, ...], target: str, bound: int) -> dict[tuple[int, int], int]:
    """Least cost from (turns aligned, characters written) to the end, for the cells that a cost of ``bound`` can pass."""
    rows, columns = len(turns), len(target)
    off = columns - rows

    def detour(a: int, b: int) -> int:
        return INSERT * (b - a) if b > a else DELETE * (a - b)

    band = [d for d in range(-rows, columns + 1) if detour(0, d) + detour(d, off) <= bound]
    cost: dict[tuple[int, int], int] = {(rows, columns): 0}
    far = bound + 1
    for r in range(rows, -1, -1):
        for d in reversed(band):
            c = r + d
            if not 0 <= c <= columns or (r == rows and c == columns):
                continue
            best = far
            if r < rows:
                initial, must_go, truncated = turns[r]
                best = DELETE + cost.get((r + 1, c), far)
                if c < columns and not must_go and (initial == target[c] or target[c] != "s"):
                    stay = (KEEP if initial == target[c] else REROLE) + (TRUNCATED if truncated else 0)
                    best = min(best, stay + cost.get((r + 1, c + 1), far))
            if c < columns and target[c] != "s":
                best = min(best, INSERT + cost.get((r, c + 1), far))
            if best <= bound:
                cost[r, c] = best
    return cost


def _audit(turns: tuple[Seen, ...], target: str, cost: dict[tuple[int, int], int]) -> str:
    """The ASCII-least edits along a table's cheapest paths: in a cell every letter leads to a cell of its own."""
    rows, columns = len(turns), len(target)
    r = c = 0
    out = []
    while r < rows or c < columns:
        here = cost[r, c]
        if r < rows and cost.get((r + 1, c), here) + DELETE == here:
            out.append("D")
            r += 1
        elif c < columns and target[c] != "s" and cost.get((r, c + 1), here) + INSERT == here:
            out.append("I")
            c += 1
        else:
            out.append("K" if turns[r][0] == target[c] else "R")
            r, c = r + 1, c + 1
    return "".join(out)


@lru_cache(1 << 14)
def alignments(turns: tuple[Seen, ...], state: int, ends: tuple[int, ...]) -> dict[int, tuple[int, str]]:
    """Cheapest (cost, audit) from ``state`` over ``turns`` to each of the states ``ends`` that can be reached."""
    best: dict[int, tuple[int, str]] = {}
    most = DELETE * len(turns) + 2 * INSERT
    bound = 4
    while True:
        bound = min(bound, most)
        for first, pair in FOLLOW[state]:
            least, longest = len(turns) - bound // DELETE, len(turns) + bound // INSERT
            # nearest lengths first: their cost narrows the bands of the rest
            for length in sorted(range(max(0, least, len(first)), longest + 1), key=lambda n: abs(n - len(turns))):
                target = _target(first, pair, length)
                end = STATE_OF[target[-1]] if target else state
                if end not in ends:
                    continue
                limit = min(bound, best[end][0]) if end in best else bound
                cost = _table(turns, target, limit)
                if (0, 0) in cost:
                    found = cost[0, 0], _audit(turns, target, cost)
                    if end not in best or found < best[end]:
                        best[end] = found
        if bound == most or all(end in best for end in ends):
            return best
        bound *= 2


def seen(turn: dict) -> Seen:
    return turn["role"][:1], turn["fault"] in ("blank", "duplicate"), turn["fault"] == "truncated"


def repaired(turns: list[dict], state: int, audit: str) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of what an audit makes of turns entered in a grammar state."""
    at = iter(turns)
    for edit in audit:
        wanted = "a" if state == USER else "u"
        turn = None if edit == "I" else next(at)
        if edit == "D":
            continue
        role, text = (ROLES[wanted], "") if turn is None else (ROLES[wanted] if edit == "R" else turn["role"], turn["text"])
        state = STATE_OF[role[:1]]
        yield edit, role, text


def faulty_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies and fault (blank, duplicate, truncated or null) of the first of the copies."""
    given = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = given.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumn("said", F.sha2(F.concat_ws("\x00", "role", "text"), 256))
    firsts = rows.groupBy("conv_id", "said").agg(F.min(F.struct("turn")).alias("first"))
    firsts = firsts.select(F.col("conv_id").alias("of"), F.col("said").alias("same"), F.col("first.turn").alias("at"))
    on = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("said") == F.col("same")) & F.col("turn").eqNullSafe(F.col("at"))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = (
        F.when(~F.col("text").rlike(NOT_BLANK), "blank")
        .when(F.col("same").isNull(), "duplicate")
        .when(~last.isin(".", "!", "?"), "truncated")
    )
    return rows.join(firsts, on, "left").select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


def _blocks(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Blocks of at most BLOCK turns of one conversation, with the alignments of each way through."""
    part = TaskContext.get().partitionId()
    held: list[dict] = []
    now, seq, whole = None, 0, False

    def block(last: bool) -> pa.RecordBatch:
        turns = tuple(map(seen, held))
        ways = []
        for state in (START,) if seq == 0 and whole else range(4):
            # the conversation may go on in the next task
            for end, (cost, audit) in alignments(turns, state, ENDS if last else (START, SYSTEM, USER, ASSISTANT)).items():
                ways.append({"state": state, "end": end, "cost": cost, "audit": audit})
        return pa.RecordBatch.from_pylist([{"conv_id": now[0], "part": part, "seq": seq, "turns": held, "ways": ways}], schema)

    for batch in batches:
        done = []
        for row in batch.to_pylist():
            conv = row.pop("conv_id")
            copies = row.pop("copies")
            if now is None or now[0] != conv:
                if held:
                    done.append(block(True))
                # the first conversation of a task may have begun in the task before
                held, whole, seq = [], now is not None, 0
                now = (conv,)
            for k in range(copies):
                if len(held) == BLOCK:
                    done.append(block(False))
                    held, seq = [], seq + 1
                held.append(row if k == 0 or row["fault"] == "blank" else row | {"fault": "duplicate"})
        yield from done
    if held:
        yield block(False)


def blocks(turns: DataFrame) -> DataFrame:
    """conv_id, part, seq, turns, ways: the aligned blocks of all conversations, in the order (part, seq)."""
    rows = faulty_turns(turns)
    kind = rows.schema["turn"].dataType.simpleString()
    shape = (
        f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, part int, seq int,"
        f" turns array<struct<turn: {kind}, role: string, text: string, fault: string>>,"
        " ways array<struct<state: tinyint, end: tinyint, cost: long, audit: string>>"
    )
    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], shape).schema)
    order = ["conv_id", "turn", "role", "text"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(dealt.mapInArrow(lambda batches: _blocks(batches, schema), shape), "repair-blocks")


class _Conversation:
    """What the blocks of a conversation add up to, block by block."""

    def __init__(self):
        #: state: cost, audit, hash of the repaired text, whether it has a turn, states at the ends of blocks
        self.ways = {START: (0, "", hashlib.sha256(), False, ())}
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.n, self.distinct, self.least, self.most, self.turn, self.initial = 0, 0, None, None, None, None

    def add(self, turns: list[dict], ways: list[dict]) -> None:
        for turn in turns:
            if turn["fault"]:
                self.counts[turn["fault"]] += 1
            initial = turn["role"][:1]
            if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
                self.counts["illegal"] += 1
            self.initial = initial
            if turn["turn"] is not None:
                self.distinct += self.turn != turn["turn"]
                self.least = turn["turn"] if self.least is None else self.least
                self.turn = self.most = turn["turn"]
        self.n += len(turns)
        best: dict[int, tuple[int, str, int, str]] = {}
        for way in ways:
            if way["state"] in self.ways:
                cost, audit = self.ways[way["state"]][:2]
                found = cost + way["cost"], audit + way["audit"], way["state"], way["audit"]
                if way["end"] not in best or found[:2] < best[way["end"]][:2]:
                    best[way["end"]] = found
        after = {}
        for end, (cost, audit, state, edits) in best.items():
            _, _, digest, any_turn, path = self.ways[state]
            digest = digest.copy()
            for _, role, text in repaired(turns, state, edits):
                digest.update((f"\n{role}:{text}" if any_turn else f"{role}:{text}").encode())
                any_turn = True
            after[end] = cost, audit, digest, any_turn, (*path, state)
        self.ways = after

    def row(self, conv) -> dict:
        cost, audit, digest, _, path = min((self.ways[end] for end in ENDS if end in self.ways), key=lambda way: way[:2])
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return {"conv_id": conv, "n_turns": self.n, "gaps": gaps, **self.counts, "cost": cost, "audit": audit, "repaired_sha256": digest.hexdigest(), "path": list(path)}


def _composed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    now, whole = None, None
    for batch in batches:
        rows = []
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            if now is None or now[0] != row["conv_id"]:
                if now is not None:
                    rows.append(whole.row(now[0]))
                now, whole = (row["conv_id"],), _Conversation()
            whole.add(row["turns"], row["ways"])
        yield pa.RecordBatch.from_pylist(rows, schema)
    if now is not None:
        yield pa.RecordBatch.from_pylist([whole.row(now[0])], schema)


def summaries(aligned: DataFrame) -> DataFrame:
    """Per conversation of ``blocks``: counts of faults, cost, audit, hash of the repaired text, states at block borders."""
    shape = f"conv_id {aligned.schema['conv_id'].dataType.simpleString()}, {SUMMARY}"
    schema = to_arrow_schema(aligned.sparkSession.createDataFrame([], shape).schema)
    dealt = aligned.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return dealt.mapInArrow(lambda batches: _composed(batches, schema), shape)


def repair(turns: DataFrame) -> DataFrame:
    """A row per conv_id of ``turns`` (conv_id, turn, role, text): see ``SUMMARY``."""
    return summaries(blocks(turns))


def repaired_turns(aligned: DataFrame) -> DataFrame:
    """conv_id, part, seq, place, edit, role, text: the repaired turns themselves, in the order (part, seq, place)."""
    entered = summaries(aligned).select("conv_id", F.posexplode("path").alias("number", "state"))
    order = F.struct("part", "seq")
    starts = aligned.select("conv_id", order.alias("at"))
    numbered = starts.groupBy("conv_id").agg(F.sort_array(F.collect_list("at")).alias("ats")).select("conv_id", F.posexplode("ats").alias("number", "at"))
    path = numbered.alias("n").join(entered.alias("e"), F.expr("n.conv_id <=> e.conv_id AND n.number = e.number")).selectExpr("n.conv_id", "n.number", "n.at", "e.state")
    ahead = path.selectExpr("conv_id AS c", "number - 1 AS before", "state AS leaves")
    path = path.join(ahead, F.expr("conv_id <=> c AND number = before"), "left").selectExpr("conv_id AS of", "at", "state", "leaves")
    chosen = aligned.withColumn("at", order).join(path.withColumnRenamed("at", "place"), F.expr("conv_id <=> of AND at = place"))
    # the last block is left in the cheaper of the two states a conversation may end in
    way = F.expr(
        "array_min(transform(filter(ways, w -> w.state = state AND (w.end = leaves OR (leaves IS NULL AND w.end IN (0, 3)))),"
        " w -> struct(w.cost AS cost, w.audit AS audit)))"
    )
    rows = chosen.select("conv_id", "part", "seq", "turns", F.col("state").cast("int").alias("state"), way["audit"].alias("audit"))

    kind = aligned.schema["conv_id"].dataType.simpleString()
    shape = f"conv_id {kind}, part int, seq int, place int, edit string, role string, text string"
    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], shape).schema)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                key = {name: row[name] for name in ("conv_id", "part", "seq")}
                for place, (edit, role, text) in enumerate(repaired(row["turns"], row["state"], row["audit"])):
                    out.append(key | {"place": place, "edit": edit, "role": role, "text": text})
            yield pa.RecordBatch.from_pylist(out, schema)

    return rows.mapInArrow(lay, shape)
