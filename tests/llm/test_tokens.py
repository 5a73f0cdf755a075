"""The encoder's chunks: each learned once, with the ids that the library gives whole texts."""

from __future__ import annotations

import public_tokenizers
import pytest

from tallylog.llm import tokens


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_of_a_split_are_learned_once(name, monkeypatch):
    # 2 million characters of different words, then the same words again
    words = ["q" + "".join("aeiou"[i // 5**k % 5] + "bdfgk"[i // 5**k % 5] for k in range(8)) for i in range(120_000)]
    texts = [" ".join(words[at : at + 2_000]) for at in range(0, len(words), 2_000)]
    path = public_tokenizers.path(name)
    coder, learned = tokens.Encoder(path), []
    learn = coder._learn
    monkeypatch.setattr(coder, "_learn", lambda new: (learned.extend(new), learn(new)))
    monkeypatch.setattr(tokens, "encoder", lambda _: coder)
    ids = [*tokens.batches_of(texts * 2, 1, path)]
    assert len(learned) == len(set(learned))
    whole = coder.tokenizer.encode_batch_fast(texts[:3], add_special_tokens=False)
    assert ids[:3] == [b"".join(i.to_bytes(4, "little") for i in [*e.ids, 1]) for e in whole] and ids[60:] == ids[:60]


def test_words_of_an_earlier_split_are_known(monkeypatch):
    # 2 million characters of different words in one task, and in the worker's next one
    words = ["q" + "".join("aeiou"[i // 5**k % 5] + "bdfgk"[i // 5**k % 5] for k in range(8)) for i in range(120_000)]
    texts = [" ".join(words[at : at + 2_000]) for at in range(0, len(words), 2_000)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    coder, learned = tokens.Encoder(path), []
    learn = coder._learn
    monkeypatch.setattr(coder, "_learn", lambda new: (learned.extend(new), learn(new)))
    monkeypatch.setattr(tokens, "encoder", lambda _: coder)
    first = [*tokens.batches_of(texts, 1, path)]
    assert [*tokens.batches_of(texts, 1, path)] == first
    assert len(learned) == len(set(learned))
