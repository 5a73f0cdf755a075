"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its emission score comes from features of the line and of the lines before and after it; a
transition score joins neighbours. Forward-backward marginals of the lines, weighted by their length, give the document's score.

Training: the lines of a labelled document carry its label. Weights are fitted by gradient ascent on the conditional
likelihood, on at most SAMPLE labelled documents of at most SAMPLE_CHARS characters (smallest hashes of doc_id; the bound keeps
the driver's work fixed). Rows with crc32(doc_id) mod FOLDS = 0 are held out and never learned from. The score sees the text
alone, not label, language, source or id.

Scoring runs over whole texts as Arrow batches: byte classes are counted per line with numpy, the chain is stepped for all
documents of a batch at once, so memory follows the batch. Null and empty texts are one empty line. Without usable labels all
scores are 0.5; repeated rows are scored alike; a label that occurs twice with different values counts as the lower one.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE, SAMPLE_CHARS = 4000, 20_000
FOLDS, THRESHOLD = 5, 0.3
STEPS, RATE, RIDGE = 80, 0.15, 1e-3

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#*$%&<>", b"|", b"!", b"0123456789", b"@=/:", b"abcdefghijklmnopqrstuvwxyz"]
_TABLE = np.zeros((len(_CLASSES), 256), np.uint8)
for _k, _bytes in enumerate(_CLASSES):
    _TABLE[_k, list(_bytes)] = 1
#: Features of a line that its neighbours see too.
_SHARED = slice(0, 8)
N_LOCAL = 13
N_FEATURES = 1 + 2 * N_LOCAL + 2 * 8


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths, and where each text's lines begin (one more entry than texts)."""
    lines: list[str] = []
    firsts, repeated = [0], []
    for text in texts:
        own = text.split("\n")
        seen: set[str] = set()
        for line in own:
            repeated.append(len(line) > 3 and line in seen)
            seen.add(line)
        lines += own
        firsts.append(len(lines))
    joined = "\n".join(lines).encode("utf-8", "surrogatepass") + b"\n"
    data = np.frombuffer(joined, np.uint8)
    ends = np.flatnonzero(data == 10)
    begins = np.concatenate([[0], ends[:-1] + 1])
    counts = np.stack([np.add.reduceat(_TABLE[k][data], begins, dtype=np.int64) for k in range(len(_CLASSES))], axis=1).astype(np.float64)
    upper, symbols, pipes, shouts, digits, marks, lower = counts.T
    size = (ends - begins).astype(np.float64)
    words, distinct, again, again2 = (np.zeros(len(lines)) for _ in range(4))
    for k, line in enumerate(lines):
        own = line.split()
        words[k] = len(own)
        distinct[k] = len(set(own))
        again[k] = sum(map(eq, own, own[1:]))
        again2[k] = sum(map(eq, own, own[2:]))
    per = 1 / np.maximum(words, 1)
    local = np.stack(
        [
            upper / np.maximum(upper + lower, 1),
            np.minimum(symbols * per, 3) / 3,
            np.minimum(pipes * per, 1),
            np.minimum(shouts * per, 2) / 2,
            np.where(words > 1, np.log(np.maximum(distinct, 1)) / np.log(np.maximum(words, 2)), 1.0),
            again * per,
            again2 * per,
            np.array(repeated, np.float64),
            np.minimum(np.log1p(size) / 8, 1.5),
            np.minimum(size * per / 20, 2),
            digits / np.maximum(size, 1),
            np.minimum(marks * per, 1),
            (size == 0).astype(np.float64),
        ],
        axis=1,
    )
    starts = np.array(firsts)
    shared = local[:, _SHARED]
    before, after = np.zeros_like(shared), np.zeros_like(shared)
    before[1:], after[:-1] = shared[:-1], shared[1:]
    before[starts[:-1]] = 0
    after[starts[1:] - 1] = 0
    return np.concatenate([np.ones((len(lines), 1)), local, np.sqrt(local), before, after], axis=1), np.maximum(size, 1), starts


def marginals(emission: np.ndarray, transition: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) per line, P(both equal) per step into a line (nan for first lines), log partition per text; labels 0 and 1.

    ``emission`` is the log odds of good per line, ``transition`` the 2 x 2 log scores from a line to the next.
    """
    count = np.diff(starts)
    order = np.argsort(-count, kind="stable")
    begin, count = starts[:-1][order], count[order]
    scores = np.stack([np.zeros(len(emission)), emission], axis=1)
    forward, backward = np.empty_like(scores), np.zeros_like(scores)
    longest = int(count[0]) if len(count) else 0
    active = [int(np.searchsorted(-count, -t, side="left")) for t in range(longest)]  # texts with more than t lines
    forward[begin] = scores[begin]
    for t in range(1, longest):
        at = begin[: active[t]] + t
        prior = forward[at - 1][:, :, None] + transition
        forward[at] = np.logaddexp(prior[:, 0], prior[:, 1]) + scores[at]
    for t in range(longest - 1, 0, -1):
        at = begin[: active[t]] + t
        later = (backward[at] + scores[at])[:, None, :] + transition
        backward[at - 1] = np.logaddexp(later[:, :, 0], later[:, :, 1])
    last = begin + count - 1
    partition = np.empty(len(count))
    partition[order] = np.logaddexp(forward[last, 0], forward[last, 1])
    both = forward + backward
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))
    pair = np.full((len(emission), 2, 2), np.nan)
    inner = np.ones(len(emission), bool)
    inner[starts[:-1]] = False
    at = np.flatnonzero(inner)
    whole = np.repeat(partition, np.diff(starts))
    pair[at] = np.exp(forward[at - 1][:, :, None] + transition + (scores[at] + backward[at])[:, None, :] - whole[at][:, None, None])
    return good, pair, partition


def fit(texts: list[str], labels: list[int]) -> dict[str, np.ndarray]:
    """Weights, feature means and scales, and transitions, from labelled texts."""
    model = {"mean": np.zeros(N_FEATURES), "scale": np.ones(N_FEATURES), "weights": np.zeros(N_FEATURES), "transition": np.zeros((2, 2))}
    if not texts or min(labels) == max(labels):
        return model
    features, _, starts = line_features(texts)
    model["mean"], model["scale"] = features.mean(axis=0), features.std(axis=0) + 1e-3
    model["mean"][0], model["scale"][0] = 0, 1
    x = (features - model["mean"]) / model["scale"]
    count = np.diff(starts)
    truth = np.repeat(np.array(labels, np.float64), count)
    inner = np.ones(len(x), bool)
    inner[starts[:-1]] = False
    # every document weighs the same, however many lines it has
    weight = np.repeat(1 / count, count)
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = weight[inner & (truth == label)].sum()
    params = np.zeros(N_FEATURES + 4)
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        good, pair, _ = marginals(x @ params[:N_FEATURES], params[N_FEATURES:].reshape(2, 2), starts)
        slope = np.concatenate([x.T @ (weight * (truth - good)), (seen - (weight[inner][:, None, None] * pair[inner]).sum(axis=0)).ravel()]) / len(texts) - RIDGE * params
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        params += RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return model | {"weights": params[:N_FEATURES], "transition": params[N_FEATURES:].reshape(2, 2)}


def score(texts: list[str], model: dict[str, np.ndarray]) -> np.ndarray:
    """Length-weighted mean of the lines' marginals, from 0 to 1."""
    if not texts:
        return np.empty(0)
    features, size, starts = line_features(texts)
    good, _, _ = marginals(((features - model["mean"]) / model["scale"]) @ model["weights"], model["transition"], starts)
    return np.clip(np.add.reduceat(good * size, starts[:-1]) / np.add.reduceat(size, starts[:-1]), 0, 1)


def train(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    """Fits the field on a bounded sample of labelled documents that are not held out."""
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    short = docs.where(F.length("text") <= SAMPLE_CHARS)
    # ids first: texts are read for the sample alone
    ids = short.select("doc_id").distinct().join(marked, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    chosen = docs.sparkSession.createDataFrame(ids.collect(), "doc_id long, quality int")
    rows = short.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").collect()
    # rows that share a doc_id: the first text
    texts = {row.doc_id: row for row in sorted(rows, key=lambda row: row.text, reverse=True)}
    rows = [texts[doc] for doc in sorted(texts)]
    return fit([row.text for row in rows], [int(row.quality) for row in rows])


def quality_scores(docs: DataFrame, labels: DataFrame, chunk: int = 64) -> DataFrame:
    """doc_id, score, predicted (1 if score >= THRESHOLD) for every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                scores = score([x or "" for x in part.column("text").to_pylist()], model.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
