"""Quality classifier: a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad. A line's score is linear in its own features and in
those of its neighbours, and a transition score ties the labels of successive lines. The text's
quality is the mean of its lines' marginals P(good), from the forward-backward algorithm, weighted
by the lines' lengths.

Learning starts from the text's label for all of its lines. Lines of bad texts are then relabelled
by the marginals of the model itself (the worst line of a bad text stays bad), and learning goes on.
The sample that is learned from holds at most SAMPLE labelled texts, chosen by a hash of their ids, and
of these, in that order, as many as come to SAMPLE_BYTES of features at the most.

Defined results
  null or empty text    one empty line
  no labelled rows      every score is 0.5
  very long text        all of its lines
  a text labelled twice the mean of its labels decides; a tie counts as bad
  repeated rows         each scored, equally
  empty table           no rows
  extra columns         not read
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SAMPLE = 4000
#: Bytes of the sample's features (FEATURES floats a line), all rows of a text counted.
SAMPLE_BYTES = 256 << 20
BAR = 0.7
#: Bytes of text worked on at once.
CHUNK = 1 << 20
PRIME = np.uint64(0x100000001B3)
INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))

# Features of a line

#: Counted characters: capitals, digits, symbols, stops, vertical bars, exclamation marks, blanks, bytes beyond ASCII.
KINDS = [
    bytes(range(65, 91)),
    b"0123456789",
    b"#*$%&<>",
    b".,;:?",
    b"|",
    b"!",
    b" \t\v\f\r",
    bytes(range(128, 256)),
]
OWN = len(KINDS) + 7
FEATURES = 3 * OWN


def class_table() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for kind, members in enumerate(KINDS, 1):
        table[list(members)] = kind
    return table


CLASS = class_table()


def line_features(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(lines, OWN) for the lines raw[start:end]; they don't overlap and are in order."""
    n = len(starts)
    data = np.frombuffer(raw, np.uint8)
    size = (ends - starts).astype(np.float64)
    kind = CLASS[data]
    counts = np.zeros((n, len(KINDS)))
    for k in range(len(KINDS)):
        upto = np.concatenate(([0], np.cumsum(kind == k + 1, dtype=np.int64)))
        counts[:, k] = upto[ends] - upto[starts]
    # Words: their starts and hashes, to find a word that equals the one before it.
    blank = (kind == 7) | (data == 10)
    word_starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    word_ends = np.flatnonzero(~blank & np.concatenate((blank[1:], [True]))) + 1
    line_of = np.searchsorted(starts, word_starts, side="right") - 1
    power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(data), PRIME))))
    back = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(data), INVERSE))))
    sums = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(977)) * power[:-1])))
    hashes = (sums[word_ends] - sums[word_starts]) * back[word_starts]
    words = np.bincount(line_of, minlength=n)
    again = np.zeros(len(hashes), bool)
    if len(hashes) > 1:
        again[1:] = (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])
    same = np.bincount(line_of, weights=again, minlength=n)
    safe, per_word = np.maximum(size, 1), np.maximum(words, 1)
    last = np.where(size > 0, kind[np.minimum(np.maximum(ends - 1, 0), max(len(data) - 1, 0))] if len(data) else 0, 0)
    own = [
        np.log1p(size) / 8,
        np.log1p(words) / 6,
        same / per_word,
        np.minimum((size - counts[:, 6]) / per_word, 40) / 20,
        np.minimum((counts[:, 2] + counts[:, 4] + counts[:, 5]) / per_word, 3) / 3,
        (last == 4).astype(float),
        (size == 0).astype(float),
    ]
    return np.column_stack([np.sqrt(counts / safe[:, None]), *own]).astype(np.float32)


class Lines(NamedTuple):
    features: np.ndarray  # (lines, FEATURES)
    sizes: np.ndarray  # bytes of each line
    counts: np.ndarray  # lines of each text


def lines(raws: list[bytes | None]) -> Lines:
    """Features of all lines of some texts, with those of the neighbours in the same text."""
    joined, texts_at, at = [], [], 0
    for raw in raws:
        raw = raw or b""
        joined.append(raw)
        texts_at.append((at, at + len(raw)))
        at += len(raw) + 1
    whole = b"\n".join(joined)
    breaks = np.flatnonzero(np.frombuffer(whole, np.uint8) == 10)
    starts, ends = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(whole)]))
    of = np.searchsorted([a for a, _ in texts_at], starts, side="right") - 1
    # A text that is empty shares its start with none: starts are distinct, one line each.
    counts = np.bincount(of, minlength=len(raws))
    own = line_features(whole, starts, ends)
    first = np.concatenate(([True], of[1:] != of[:-1]))
    last = np.concatenate((first[1:], [True]))
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    return Lines(np.concatenate((own, before, after), axis=1), ends - starts, counts)


# The chain


class Model(NamedTuple):
    weights: np.ndarray  # FEATURES + 1, for good against bad
    transitions: np.ndarray  # (2, 2)


def padded(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines by text -> (steps, texts) with longer texts first, and that order."""
    order = np.argsort(-counts, kind="stable")
    starts = np.cumsum(counts) - counts
    steps = np.arange(counts.max())[:, None]
    return np.where(steps < counts[order], values[np.minimum(starts[order] + steps, len(values) - 1)], 0.0), order


def marginals(scores: np.ndarray, transitions: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Line scores (good against bad) -> P(good) by line, expected transitions (2, 2), sum of log Z."""
    table, order = padded(scores, counts)
    sizes = counts[order]
    steps, n = table.shape
    t = transitions
    lse = np.logaddexp
    forward = np.zeros((steps, 2, n))
    forward[0, 1] = table[0]
    alive = [int((sizes > s).sum()) for s in range(steps)]
    for s in range(1, steps):
        k = alive[s]
        a, b = forward[s - 1, 0, :k], forward[s - 1, 1, :k]
        forward[s, 0, :k] = lse(a + t[0, 0], b + t[1, 0])
        forward[s, 1, :k] = lse(a + t[0, 1], b + t[1, 1]) + table[s, :k]
    backward = np.zeros((steps, 2, n))
    for s in range(steps - 2, -1, -1):
        k = alive[s + 1]
        a, b = backward[s + 1, 0, :k], backward[s + 1, 1, :k] + table[s + 1, :k]
        backward[s, 0, :k] = lse(a + t[0, 0], b + t[0, 1])
        backward[s, 1, :k] = lse(a + t[1, 0], b + t[1, 1])
    total = lse(forward[sizes - 1, 0, np.arange(n)], forward[sizes - 1, 1, np.arange(n)])
    good = np.exp(np.minimum(forward[:, 1] + backward[:, 1] - total, 0))
    expected = np.zeros((2, 2))
    for s in range(1, steps):
        k = alive[s]
        for i in (0, 1):
            for j in (0, 1):
                expected[i, j] += np.exp(forward[s - 1, i, :k] + t[i, j] + (table[s, :k] if j else 0) + backward[s, j, :k] - total[:k]).sum()
    out = np.empty(len(scores))
    starts = np.cumsum(counts) - counts
    at = starts[order] + np.arange(steps)[:, None]
    live = np.arange(steps)[:, None] < sizes
    out[at[live]] = good[live]
    return out, expected, float(total.sum())


def train(found: Lines, labels: np.ndarray, rounds: tuple[int, ...] = (60, 40, 40), rate: float = 0.2, ridge: float = 1e-4) -> Model:
    """labels: 0 or 1 of each text."""
    x = np.concatenate((found.features, np.ones((len(found.features), 1), np.float32)), axis=1)
    of = np.repeat(np.arange(len(found.counts)), found.counts)
    y = labels[of].astype(float)
    params, moment, square, step = np.zeros(x.shape[1] + 4), 0.0, 0.0, 0
    inner = np.concatenate((of[1:] == of[:-1], [False]))
    for turn, epochs in enumerate(rounds):
        if turn:  # lines of bad texts by the model's own view, one bad line at least
            good, _, _ = marginals(x @ params[:-4], params[-4:].reshape(2, 2), found.counts)
            worst = np.full(len(found.counts), np.inf)
            np.minimum.at(worst, of, good)
            y = np.where(labels[of] == 1, 1.0, ((good > 0.5) & (good > worst[of])).astype(float))
        pairs = np.zeros((2, 2))
        np.add.at(pairs, (y[:-1][inner[:-1]].astype(int), y[1:][inner[:-1]].astype(int)), 1)
        for _ in range(epochs):
            good, expected, _ = marginals(x @ params[:-4], params[-4:].reshape(2, 2), found.counts)
            grad = np.concatenate((x.T @ (y - good), (pairs - expected).ravel())) / len(x) - ridge * params
            step += 1
            moment, square = 0.9 * moment + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
            params = params + rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Model(params[:-4], params[-4:].reshape(2, 2))


def chunks(raws: list[bytes | None]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, raw in enumerate(raws):
        size += len(raw or b"") + 1
        if size >= CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(raws):
        yield start, len(raws)


def quality(raws: list[bytes | None], model: Model | None) -> np.ndarray:
    """P(good) of each text."""
    if model is None:
        return np.full(len(raws), 0.5)
    found = lines(raws)
    good, _, _ = marginals(found.features @ model.weights[:-1] + model.weights[-1], model.transitions, found.counts)
    of, weight = np.repeat(np.arange(len(raws)), found.counts), found.sizes + 1.0
    return np.clip(np.bincount(of, good * weight) / np.bincount(of, weight), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> Model | None:
    """docs (doc_id, text) and labels (doc_id, quality): whatever labels may be learned from."""
    by_text = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("q"))
    chosen = by_text.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    n_lines = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    sizes = docs.select("doc_id", F.coalesce(n_lines, F.lit(1)).alias("n")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "q").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over the sample's rows
    chosen = sizes.withColumn("upto", upto).where(F.col("upto") * 4 * FEATURES <= most).select("doc_id", "q")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raws, marks = common.texts(batch), batch.column("q").to_pylist()
        for a, b in chunks(raws):
            found = lines(raws[a:b])
            ends = np.cumsum(found.counts)
            parts = [(found.features[e - c : e].tobytes(), found.sizes[e - c : e].astype(np.int64).tobytes(), int(m > 0.5)) for c, e, m in zip(found.counts, ends, marks[a:b], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*parts, strict=True), (pa.binary(), pa.binary(), pa.int32()), strict=True)], names=["features", "sizes", "label"])

    # The sample is at most SAMPLE ids with a number each, and their features at most SAMPLE_BYTES.
    rows = common.map_arrow(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), run, "features binary, sizes binary, label int").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.label, bytes(r.features)))
    features = [np.frombuffer(r.features, np.float32).reshape(-1, FEATURES) for r in rows]
    sizes = np.concatenate([np.frombuffer(r.sizes, np.int64) for r in rows])
    return train(Lines(np.concatenate(features), sizes, np.array([len(f) for f in features])), np.array([r.label for r in rows]))


def scored(docs: DataFrame, model: Model | None, bar: float = BAR) -> DataFrame:
    """docs -> (doc_id, score, predicted)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raws = common.texts(batch)
        score = np.concatenate([quality(raws[a:b], model) for a, b in chunks(raws)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= bar).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return common.map_arrow(docs.select("doc_id", "text"), run, common.with_id(docs, "score double, predicted int"))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = common.crc32_mod("doc_id", 4) == 2
    model = fit(docs, labels.where(~held))
    return scored(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
