"""Token ids of whole texts through the tokenizers library, each distinct chunk encoded once per worker.

Both vocabularies cut a text into pieces that never reach over certain borders: between a word and the white space or plain
punctuation behind it, and before a single space that starts a word. A text is cut at such borders only, so its ids are the
ids of its chunks in order; the tests hold this against encoding whole texts. Chunks repeat, texts rarely do. The vocabulary's
added tokens are cut out of the raw text first, as the library does it: what is on their two sides is encoded apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np

#: White space as the vocabularies' patterns see it.
_SPACE = "\t-\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters that no normal form joins with what follows them, unless that is a mark; and punctuation other than the apostrophe.
_LETTER = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
_PUNCTUATION = r"!-&(-/:-@\[-`{-~"
_END = f"(?=[{_PUNCTUATION}{_SPACE}]|\\Z)"
#: Characters of the chunks kept per worker process; all go beyond it. Enough for the different words of a split of 16 MB,
#: and kept from task to task, since the next split has many of them again.
CACHE = 5_000_000
#: Letters whose lower case depends on more than themselves, or that lie outside the plain alphabets.
_UNSURE = re.compile("[\\u0130\\u0250-\\U0010ffff]").search


@cache
def _byte_letters() -> dict[int, str]:
    """The letters that stand for the UTF-8 bytes of a character in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    letters = dict(zip(plain + other, [*map(chr, plain), *(chr(256 + i) for i in range(len(other)))], strict=True))
    return {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}


class Encoder:
    """Ids of texts as bytes (little-endian unsigned 32-bit), under the tokenizers file at ``path``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.lowers = self.tokenizer.normalizer is not None
        word = f"[{_LETTER}]++{_END}"
        tail = f"[{_PUNCTUATION}]++(?=[{_SPACE}]|\\Z)"
        if self.lowers:  # white space is dropped and case folded: spaces need no chunk
            self.pattern = re.compile(f"{word}|{tail}|[^{_SPACE}]+")
        else:
            self.pattern = re.compile(f" ?{word}|{tail}| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
        self.simple = re.compile(f"[{_LETTER}]+" if self.lowers else f" ?[{_LETTER}]+").fullmatch
        contents = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(contents, key=len, reverse=True))) + ")") if contents else None
        #: the bytes of every id, so that a chunk's few ids need no array
        self.of_id = [id.to_bytes(4, "little") for id in range(max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=-1) + 1)]
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, new: list[str]) -> None:
        simple, letters, tokenize, known, of_id = self.simple, _byte_letters(), self.tokenizer.model.tokenize, self.known, self.of_id
        space, rest = letters[32], []
        for chunk in new:
            # a run of letters is one piece: the model alone decides its ids; plain ones stand for their own bytes
            if simple(chunk) and not (self.lowers and not chunk.islower()):
                if not chunk.isascii():
                    pieces = tokenize(chunk.translate(letters))
                else:
                    pieces = tokenize(space + chunk[1:] if chunk[0] == " " else chunk)
                known[chunk] = of_id[pieces[0].id] if len(pieces) == 1 else b"".join([of_id[t.id] for t in pieces])
            else:
                rest.append(chunk)
        for chunk, encoding in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            known[chunk] = b"".join([of_id[id] for id in encoding.ids])

    def _chunked(self, text: str) -> list[str]:
        """The chunks of a text without added tokens; those that only arise by lower-casing must not be taken for such."""
        if self.lowers and not _UNSURE(text):
            lower = text.lower()
            if self.added and self.added.search(lower):
                return [text]
            text = lower
        return self.pattern.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.known
        parts = [self.added.split(text) if self.added else [text] for text in texts]
        # what the added tokens leave at even places
        chunks = [
            self._chunked(pieces[0]) if len(pieces) == 1 else [*chain.from_iterable(self._chunked(piece) if k % 2 == 0 else [piece] for k, piece in enumerate(pieces))]
            for pieces in parts
        ]
        new = set().union(*chunks).difference(known)
        if new:
            self.held += sum(map(len, new))
            self._learn(list(new))
        out = [b"".join(map(known.__getitem__, own)) for own in chunks]
        if self.held > CACHE:
            self.forget()
        return out

    def forget(self) -> None:
        self.known.clear()
        self.held = 0


@cache
def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    return Encoder(path)


def batches_of(texts: Iterable[str | None], ends: int, path: str, size: int = 64, chars: int = 1 << 20) -> Iterator[bytes]:
    """The ids of every text (null: empty) with the end id appended; ``size`` texts or ``chars`` characters at a time."""
    coder, end = encoder(path), np.array([ends], "<u4").tobytes()
    held: list[str] = []
    room = chars
    for text in texts:
        held.append(text or "")
        room -= len(held[-1])
        if len(held) == size or room <= 0:
            for ids in coder.encode(held):
                yield ids + end
            held, room = [], chars
    for ids in coder.encode(held) if held else ():
        yield ids + end
