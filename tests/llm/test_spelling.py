"""Spelling variants against all pairs; the gram bounds against all edits."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from tallylog.llm import queries, spelling
from tests.llm import helpers
from tests.llm.test_operators import AWKWARD, DOCS


def edits(word: str, letters: str) -> set[str]:
    out = {word[:k] + word[k + 1 :] for k in range(len(word))}
    out |= {word[:k] + x + word[k + 1 :] for k in range(len(word)) for x in letters}
    out |= {word[:k] + x + word[k:] for k in range(len(word) + 1) for x in letters}
    return out - {word}


def grouped(counts: dict[str, int]) -> dict[str, tuple]:
    """word: form, root, n, n_near, form_n, by comparing each word with all that one edit makes of it."""
    letters = "".join(sorted({x for word in counts for x in word}))
    near = {word: sorted(edits(word, letters) & counts.keys()) for word in counts}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[word] = best if best is not None and counts[best] >= 2 * counts[word] else None

    def root(word):
        return word if form[word] is None else root(form[word])

    return {w: (form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts}


def corpus_counts(docs) -> dict[str, int]:
    counts: Counter = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(helpers.LOWER)
            code = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run if code % 97 else run[: code % len(run)] + run[code % len(run) + 1 :]] += 1
    return {word: n for word, n in counts.items() if len(word) >= 5 and n >= 3}


def as_dict(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("least", [spelling.LIST, 2, 0])
def test_variants_against_all_pairs(spark, least):
    rng = random.Random(least)
    words = {"".join(rng.choice("abà") for _ in range(rng.randrange(5, 9))): rng.randrange(3, 200) for _ in range(1500)}
    words |= {"internationally": 90, "internationaly": 30, "internatonaly": 9, "nternatonaly": 3, "aaaaa": 7, "aaaaaa": 70, "aaaaaaa": 700}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    got = as_dict(spelling.variants(table, least))
    assert got == grouped(words)
    assert got["nternatonaly"][:2] == ("internatonaly", "internationally")


def test_every_edit_leaves_a_sent_gram_alone():
    rng = random.Random(1)
    for trial in range(60):
        words = ["".join(rng.choice("ab") for _ in range(rng.randrange(5, 10))) for _ in range(30)]
        held = Counter(m[k : k + size] for m in map(spelling._marked, words) for size in (2, 3, 4) for k in range(len(m) - size + 1))
        frequent = {gram for gram, n in held.items() if n > trial}
        levels = rng.randbytes(spelling.BUCKETS)
        for word in words[:6]:
            own = spelling.sent_grams(word, frequent, levels)
            assert len(own) <= len(spelling.grams(word, frequent))
            lists = set(spelling.lists_of(word, own))
            for other in edits(word, "abc"):
                assert lists & set(spelling.lists_of(other, spelling.sent_grams(other, frequent, levels))), (word, other)
                assert (spelling.letter_parities(word) ^ spelling.letter_parities(other)).bit_count() <= 2


def test_awkward_documents(spark):
    docs = [*AWKWARD, (20, "Straße Straße strasse Élan élan ÀÉÎõÿ " * 3), (21, "Spelling spelling speling SPELING " * 40), (21, "speling " * 3)]
    rows = [(doc, text, None, "en", 1) for doc, text in docs]
    table = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS word", "'x' AS n", "'x' AS form")
    found = as_dict(spelling.variants(spelling.corpus_words(table.repartition(4), spelling.changed)))
    assert found == grouped(corpus_counts(docs))
    assert found["speling"][:3] == (None, "speling", 83)
    assert spelling.variants(spelling.corpus_words(table.limit(0))).count() == 0


def test_dictionary_is_bounded(spark):
    words = spark.range(3000).selectExpr("concat('word', lpad(CAST(id AS string), 4, '0')) AS word", "3L AS n")
    words = words.selectExpr("translate(word, '0123456789', 'abcdefghij') AS word", "n")
    counts = spelling.gram_counts(words)
    assert len(spelling.frequent_grams(counts, 1, 40)) <= 40 < len(spelling.frequent_grams(counts, 1, 4000))
    assert queries.ORACLES["op12_spelling_variants"]
