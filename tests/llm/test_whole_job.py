"""What operators once left out of their job, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallylog.llm import decontaminate, linededup, neardup, packing, wrapper
from tallylog.llm.queries import BYTE_BPE, WORD_BPE
from tallylog.llm.tokens import Encoder
from tests.llm import helpers
from tests.llm.test_operators import SF_DIR, _edited


def test_lines_match_by_lower_cased_words(spark):
    rng = random.Random(4)
    line = [f"v{k}" for k in range(20)]
    planted = [(40_000 + k, f"Start{k} of text number{k} here\n" + _edited(line, rng, rng.randrange(4))) for k in range(80)]
    planted += [(50_000, " ".join(line).upper()), (50_001, "alone " * 6 + "\nAlone x y z w\nw z y x alone")]
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()] + planted
    rows = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    got = {r.doc_id: r.text for r in rows}
    assert got == helpers.deduped_lines(docs)
    assert got[50_000] == "" and got[50_001] == "alone " * 6 + "\nAlone x y z w"


def test_short_lines_go_when_repeated(spark):
    docs = [(1, "All rights reserved.\n\nfoo\nb a\na b c d"), (2, "all RIGHTS  reserved.\n\n \nfoo foo foo foo foo\na b\na b c d"), (3, "Foo\na b c\nd c b a")]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: docs[0][1], 2: "\n \nfoo foo foo foo foo\na b", 3: "a b c\nd c b a"}


def test_lines_are_deduplicated_without_python_tasks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f\tg h"), (2, "A  b c d e f g h x\nleft"), (3, "no match in this line")], "doc_id long, text string")

    def refused(*_):
        raise AssertionError("Python on the executors")

    monkeypatch.setattr(type(docs), "mapInArrow", refused)
    got = {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()}
    assert got == {1: "a b c d e f\tg h", 2: "left", 3: "no match in this line"}


def test_benchmark_items_with_a_new_end_are_found(spark):
    rng = random.Random(11)
    items = [(k, [f"q{rng.randrange(3000)}" for _ in range(39)]) for k in range(400)]
    docs = [(k, " ".join(own[:34] + [f"z{rng.randrange(3000)}" for _ in range(5)])) for k, own in items]
    items = [(k, " ".join(own)) for k, own in items]
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + items[:9], "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.similarity for r in found.collect()}
    assert got == {(k, k): 0.75 for k, _ in items} == helpers.contaminated_pairs(docs, items)


def test_small_sets_lose_no_link(spark):
    rng = random.Random(8)
    hashes = [r.h for r in spark.range(2000).selectExpr("id", "xxhash64(concat('w', id)) AS h").orderBy("id").collect()]
    hashes = np.array(hashes, np.int64)
    rows, links = [], 0
    for _ in range(20_000):
        own = [rng.randrange(2000) for _ in range(8)]
        two = [neardup.minima(neardup.shingle_set(hashes[own[:k]])) for k in (7, 8)]
        bits = [np.unpackbits(np.frombuffer(neardup._signature(m), np.uint8)).reshape(1, neardup.BITS, -1) for m in two]
        # 3 of 4 shingles shared: ruled out by the estimate, though a band brings them together
        if neardup._agreement(*bits)[0, 0] < neardup._cut() and set(neardup._band_keys(two[0])) & set(neardup._band_keys(two[1])):
            rows += [(2 * links, " ".join(f"w{k}" for k in own[:7])), (2 * links + 1, " ".join(f"w{k}" for k in own))]
            links += 1
    assert links
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k - k % 2 for k in range(2 * links)} == helpers.near_duplicate_components(rows)


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_added_tokens_and_white_space(path):
    rng = random.Random(6)
    whole, cached = Tokenizer.from_file(path), Encoder(path)
    added = [token.content for token in whole.get_added_tokens_decoder().values()]
    pieces = [*added, *(x.upper() for x in added), added[0][:-1], " ", "\n", "\t", "\u00a0", "\u3000", "The", "x", "'s", "1", "É", "e\u0301", ".", "<|", "Σ", "İ"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(9))) for _ in range(20_000)]
    for text, ids in zip(texts, cached.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def _largest(one, two) -> int:
    """Simple tree matching by its definition."""
    if one.label != two.label:
        return 0
    table = [[0] * (len(two.kids) + 1) for _ in range(len(one.kids) + 1)]
    for i, x in enumerate(one.kids, 1):
        for j, y in enumerate(two.kids, 1):
            table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + _largest(x, y))
    return 1 + table[-1][-1]


def test_pages_match_as_much_as_they_can():
    rng = random.Random(12)

    def page(depth):
        return "".join(f"<{t}>{page(depth - 1) if depth else 'x'}</{t}>" for t in rng.choices(["div", "ul", "section", "b"], k=rng.randrange(4)))

    for _ in range(150):
        one, two = page(3), page(3)
        reference, tree = wrapper.Reference(two), wrapper.parse(one)
        wrapper.align(tree, reference)
        placed, stack = {}, [(reference.root, None)]
        while stack:
            node, above = stack.pop()
            placed[node.place] = node, above
            stack += [(kid, node.place) for kid in node.kids]
        found, stack = [], [(tree, None)]
        while stack:
            node, above = stack.pop()
            if node.place >= 0:
                match, parent = placed[node.place]
                assert match.label == node.label and parent == above
                found.append(node.place)
            stack += [(kid, node.place) for kid in node.kids]
        assert len(found) == len(set(found)) == _largest(tree, reference.root)


@pytest.mark.parametrize("html", ["<div>" * 5000 + "x", "<ul>" + "<li><b>x</b>y" * 20_000, "<a '" * 250_000, "<a '>'" * 150_000, "<!" * 400_000, "<p " * 300_000])
def test_hard_pages_take_no_time(html):
    reference = wrapper.Reference(html)
    wrapper.align(wrapper.parse(html + "<p>more</p>"), reference)


def test_names_inside_articles(spark):
    html = (
        '<div class="nav-top">menu</div><article><div class="entry-header">Title</div><p class="share-price">5</p><p id="related-work">Work</p>'
        '<p>See <math><mi>x</mi></math>.</p><div class="ad-slot">buy</div><div class="text comments">hm</div><div class="share-buttons">s</div></article>'
    )
    row = wrapper.main_text(spark.createDataFrame([(1, "http://a.b/", html)], "page_id long, url string, html string")).first()
    assert row.text == "Title 5 Work See x."


@pytest.mark.parametrize("hot", [0, 63])
def test_lines_meet_around_rare_and_frequent_tokens(spark, monkeypatch, hot):
    monkeypatch.setattr(linededup, "HOT", hot)
    rng = random.Random(21)
    first, second = ([f"{c}{k}" for k in range(24)] for c in "vw")
    docs = [(k, "\n".join(_edited(line, rng, rng.randrange(8)) for line in (first, second))) for k in range(90)]
    # half of one line and half of the other: candidates that fall short
    docs += [(100 + k, _edited(first[:12] + second[: 4 + k % 8], rng, k % 4)) for k in range(40)]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert got == helpers.deduped_lines(docs)


def test_whole_sets_are_sent_for_likely_lines_only(spark):
    """Sets of 200 tokens may pass 128 bits of parity though half of them differ."""
    rng = random.Random(4)
    one, other = ([f"{rng.getrandbits(60):x}" for _ in range(200)] for _ in range(2))
    near, far = one[:185] + other[:15], one[:100] + other[:100]
    rows = [(k, 0, line) for k, line in enumerate((one, near, far))]
    sets = spark.createDataFrame(rows, "doc_id long, seq long, w array<string>").selectExpr("doc_id", "seq", "transform(w, x -> shiftrightunsigned(xxhash64(x), 16)) AS tokens")
    pairs = spark.createDataFrame([(1, 0, 0, 0), (2, 0, 0, 0)], "doc_id long, seq long, to_doc long, to_seq long")
    assert [tuple(r) for r in linededup._likely(pairs, sets).collect()] == [(1, 0, 0, 0)]


@pytest.mark.parametrize("hot", [0, 63])
def test_sets_of_all_sizes_meet(spark, monkeypatch, hot):
    """The larger set may come first or last."""
    monkeypatch.setattr(linededup, "HOT", hot)
    rng = random.Random(33)
    line = [f"w{k}" for k in range(80)]
    docs = [(k, " ".join(rng.sample(line, rng.randrange(48, 80)))) for k in range(60)]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert got == helpers.deduped_lines(docs)


def test_rarity_levels_leave_plans_short(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    brief = linededup._in_brief(linededup._lines(docs), linededup.rarity_levels(docs))
    # the driver keeps the texts of a session's plans; strings of half a region of its heap are moved to it whole
    assert len(brief._jdf.queryExecution().executedPlan().toString()) < 400_000


def test_packing_gives_back_the_chunks_of_its_workers(spark):
    docs = spark.createDataFrame([(k, f"word{k} and more of them") for k in range(400)], "doc_id long, text string").repartition(4)
    packing.token_pieces(docs, WORD_BPE, release=True).collect()

    def held(batches):
        import pyarrow as pa

        from tallylog.llm.tokens import encoder

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([encoder(WORD_BPE).held], pa.int64())], ["held"])

    assert {r.held for r in spark.range(0, 4, 1, 4).mapInArrow(held, "held long").collect()} == {0}
