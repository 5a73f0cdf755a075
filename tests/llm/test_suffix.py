"""Substring removal against brute force on short strings, suffix arrays against plain comparison."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tallylog.llm import suffix
from tests.llm.test_operators import AWKWARD, DOCS


def removed(docs: list[tuple], length: int, keep_first: bool) -> list[bytes]:
    """What stays of each text; docs in the order of their ids."""
    places = defaultdict(list)
    data = [(text or "").encode() for _, text in docs]
    for k, text in enumerate(data):
        for at in range(len(text) - length + 1):
            places[text[at : at + length]].append((k, at))
    gone = [set() for _ in data]
    for found in places.values():
        first = docs[found[0][0]]
        for k, at in found if len(found) > 1 else ():
            if not (keep_first and docs[k] == first and at == found[0][1]):
                gone[k].update(range(at, at + length))
    return [bytes(x for at, x in enumerate(text) if at not in cut) for text, cut in zip(data, gone, strict=True)]


def planted(rng: random.Random, n: int) -> list[tuple]:
    """Texts with shared passages in many surroundings, repeats inside a text, periodic stretches and equal texts."""
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(20, 90))) for _ in range(6)]
    docs = []
    for k in range(n):
        parts = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(0, 40))) for _ in range(3)]
        kind = rng.random()
        if kind < 0.5:
            parts.insert(1, passages[0])
        if kind < 0.3:
            parts.insert(rng.randrange(3), rng.choice(passages)[rng.randrange(10) :])
        if kind > 0.9:
            parts.append("ab" * rng.randrange(10, 40) + "x" * rng.randrange(40))
        if kind > 0.97:
            parts = [docs[rng.randrange(len(docs))][1]] if docs else parts
        docs.append((k, "".join(parts)))
    return docs


@pytest.mark.parametrize(("keep_first", "group"), [(False, 512), (True, 512), (False, 2), (True, 2)])
def test_against_brute_force(spark, keep_first, group):
    docs = planted(random.Random(group), 240)
    rows = [(None, None), (None, "")] + docs + [(300, "ab" * 30), (300, "ab" * 30), (301, None), (302, "short")]
    # null ids come first, equal rows are one text
    df = spark.createDataFrame([(*row, "x", "y") for row in rows], "doc_id long, text string, of string, kept string").repartition(6)
    got = suffix.without_repeats(df, 24, keep_first, gram=6, group=group)
    assert got.columns == ["doc_id", "text", "of", "spans", "kept"]
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "", bytes(r.kept)) for r in got.collect())
    want = removed(rows, 24, keep_first)
    assert found == sorted((doc if doc is not None else -1, text or "", kept) for (doc, text), kept in zip(rows, want, strict=True))


def test_awkward_rows(spark):
    rows = [(doc, text, None, "en", 1) for doc, text in AWKWARD] + [(50, "é" * 150_000, "", "", 0), (51, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS spans", "'x' AS at", "'x' AS start")
    got = suffix.without_repeats(df, keep_first=False)
    for r in got.collect():
        data, spans = (r.text or "").encode(), r.spans
        assert all(a.end < b.start for a, b in zip(spans, spans[1:], strict=False))
        assert len(data) - sum(s.end - s.start for s in spans) == len(r.kept)
        if r.doc_id in (10, 11, 50):  # one letter or word over and over
            assert bytes(r.kept) == b""
    assert suffix.without_repeats(df.limit(0)).count() == 0


def test_previous_factors_against_comparison():
    rng = np.random.default_rng(3)
    for trial in range(40):
        n = 150
        data = rng.integers(1, 3 if trial % 2 else 5, n)
        cut = 70
        data[cut] = data[-1] = 0
        starts = np.concatenate([np.arange(cut), np.arange(cut + 1, n - 1)])
        ends = np.where(starts < cut, cut, n - 1)
        longest, source = suffix.previous_factors(data, starts, ends, 80)
        for at, end, size, src in zip(starts, ends, longest, source, strict=True):
            best = 0
            for other in starts[starts < at]:
                room, k = min(end - at, (cut if other < cut else n - 1) - other), 0
                while k < room and data[at + k] == data[other + k]:
                    k += 1
                best = max(best, k)
            assert size == best
            assert size == 0 or (src < at and (data[src : src + size] == data[at : at + size]).all())


@pytest.mark.parametrize("length", [3, 40, 400])
def test_whole_factors_take_few_sorts(length):
    """Three ranks at a time: 7, 21, 63, 189 and 400 bytes; what repeats over ``length`` bytes is told by the last of them."""
    rng = np.random.default_rng(length)
    passage = rng.integers(1, 257, 3 * length)
    texts = [np.concatenate([rng.integers(1, 257, 20), passage[k:], rng.integers(1, 257, 20), passage[: length - 1], [0]]) for k in (0, 5, 2 * length, 2 * length + 1)]
    data, cuts = np.concatenate(texts), np.cumsum([len(t) for t in texts])
    starts = np.concatenate([np.arange(cut - len(t), cut - length) for t, cut in zip(texts, cuts, strict=True)])
    ends = np.repeat(cuts - 1, [len(t) - length for t in texts])
    _, levels = suffix.suffix_order(data, length)
    assert len(levels) <= 5 and levels[-1][0] <= max(length, suffix.FIRST)
    longest, source = suffix.previous_factors(data, starts, ends, length, whole=True)
    before = {}
    for at, end, size, src in zip(starts, ends, longest, source, strict=True):
        string = bytes(data[at : at + length] % 256)
        assert size == (length if string in before else 0), (at, end)
        assert size == 0 or (src < at and bytes(data[src : src + length] % 256) == string)
        before.setdefault(string, at)


def test_runs_hold_every_start_once(monkeypatch):
    """Pieces of long texts, texts end to end in a buffer: each start is in one run, equal strings have equal tokens."""
    monkeypatch.setattr(suffix, "PIECE", 50)
    docs = planted(random.Random(9), 60)
    texts = [text for _, text in docs]
    batch = pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in docs], "text": texts, "of": list(range(60))})
    schema = pa.schema([("doc_id", pa.int64()), ("of", pa.int64()), ("at", pa.int64()), ("starts", pa.int32()), ("reach", pa.int32()), ("token", pa.int64()), ("same", pa.binary())])
    tokens, seen = {}, set()
    for rows in suffix._find_runs(iter([batch]), schema, 24, 6):
        for r in rows.to_pylist():
            text = texts[r["of"]].encode()
            for k in range(r["at"], r["at"] + r["starts"]):
                assert (r["of"], k) not in seen
                seen.add((r["of"], k))
                key = r["token"], r["reach"] - (k - r["at"])
                assert tokens.setdefault(text[k : k + 24], key) == key
    assert len(seen) == sum(max(0, len(t.encode()) - 23) for t in texts)
