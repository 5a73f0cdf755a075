"""Plain Python versions of what the operators compute, for small inputs."""

from __future__ import annotations

import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingles(own: list[str], size: int = 5) -> list[tuple[str, ...]]:
    if not own:
        return []
    return [tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1))]


def near_duplicate_components(docs: list[tuple[int, str | None]]) -> dict[int, int]:
    sets = [(doc, set(shingles(words((text or "").translate(LOWER))))) for doc, text in docs]
    parent = {doc: doc for doc, _ in docs}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, one) in enumerate(sets):
        for b, two in sets[:i]:
            if one and two:
                shared = len(one & two)
                if 100 * shared >= 75 * (len(one) + len(two) - shared):
                    ra, rb = sorted((root(a), root(b)))
                    parent[rb] = ra
    return {doc: root(doc) for doc, _ in docs}


def contaminated_pairs(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]]) -> dict[tuple[int, int], float]:
    out: dict[tuple[int, int], float] = {}
    wanted = []
    for item, text in items:
        own = words((text or "").translate(LOWER))
        if own:
            wanted.append((item, len(own), Counter(shingles(own))))
    for doc, text in docs:
        own = words((text or "").translate(LOWER))
        for item, size, bag in wanted:
            for start in range(len(own) - size + 1):
                window = own[start : start + size]
                if not bag.keys() & set(shingles(window)):
                    continue
                other = Counter(shingles(window))
                shared = sum((bag & other).values())
                total = sum((bag | other).values())
                if 100 * shared >= 75 * total:
                    out[doc, item] = max(out.get((doc, item), 0), shared / total)
    return out


def deduped_lines(docs: list[tuple[int, str | None]], percent: int = 75, least: int = 5) -> dict[int, str | None]:
    """Texts without the lines whose lower-cased words match those of an earlier line; doc_ids must differ.

    Lines of fewer than ``least`` words match those of the same words in the same order.
    """
    seen: list[set] = []
    by_token: dict = {}
    out = {}
    for doc, text in sorted(docs):
        if text is None:
            out[doc] = None
            continue
        kept = []
        for line in text.split("\n"):
            words_ = words(line.lower())
            own = set(words_) if len(words_) >= least else {tuple(words_)} if words_ else set()
            shared = Counter(k for token in own for k in by_token.get(token, ()))
            if not any(100 * n >= percent * (len(own) + len(seen[k]) - n) for k, n in shared.items()):
                kept.append(line)
            for token in own:
                by_token.setdefault(token, []).append(len(seen))
            seen.append(own)
        out[doc] = "\n".join(kept)
    return out


def rule_counts(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    own = words(text)
    windows = Counter(tuple(own[i : i + 3]) for i in range(len(own) - 2))
    covered = {i + k for i in range(len(own) - 2) if windows[tuple(own[i : i + 3])] > 1 for k in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if words(line):
            dups += line in seen
            seen.add(line)
    return len(own), sum(map(len, own)), sum(text.count(c) for c in "#*$%&|<>"), dups, len(covered)


def url_models(known: list[tuple[str, str]], order: int = 4, alphabet: int = 128):
    """Score of a URL under character models of ``known`` (url, allow or block), by plain counting."""
    counts = {verdict: [Counter() for _ in range(order + 1)] for verdict in ("allow", "block")}

    def grams(url: str) -> list[str]:
        padded = "^" * order + url + "$"
        return [padded[i : i + order + 1] for i in range(len(padded) - order)]

    for url, verdict in known:
        for gram in grams(url):
            for k in range(order + 1):
                counts[verdict][k][gram[order - k :]] += 1
    seen = {v: [Counter() for _ in range(order + 1)] for v in counts}
    kinds = {v: [Counter() for _ in range(order + 1)] for v in counts}
    for v, tables in counts.items():
        for k, table in enumerate(tables):
            for tail, n in table.items():
                seen[v][k][tail[:k]] += n
                kinds[v][k][tail[:k]] += 1

    def probability(v: str, gram: str) -> float:
        p = 1 / alphabet
        for k in range(order + 1):
            tail = gram[order - k :]
            if seen[v][k][tail[:k]]:
                p = (counts[v][k][tail] + kinds[v][k][tail[:k]] * p) / (seen[v][k][tail[:k]] + kinds[v][k][tail[:k]])
        return p

    def score(url: str) -> float:
        own = grams(url)
        return sum(math.log(probability("allow", g)) - math.log(probability("block", g)) for g in own) / len(own)

    return score
