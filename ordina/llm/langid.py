"""Language ID by multilingual mixture inference.

Training counts hashed character trigrams per language over all labelled training texts. For a
text, expectation-maximisation estimates the proportions of all languages from the trigrams'
likelihoods; languages are then dropped, smallest share first, as long as the penalised likelihood
(half a log(n) a language, after Schwarz) does not fall. The language of the text is the one with
the largest share of what remains, and that share is its score.

Letters are lower-cased, and everything else counts as one blank between words.

Size of the model. A table of likelihoods for languages x BUCKETS, 256 KB a language, however many
documents there are. The language codes of a corpus are a closed list (ISO 639-1 has 183: 46 MB).

Defined results
  null text, no letter   lang_pred 'und', score 0, no shares
  very long text         all its trigrams, gathered by bucket
  ties                   the language that is first in code point order
  no training rows       'und' for every text
  repeated rows          each predicted, equally
  empty table            no rows
  null lang              not learned from
  extra columns          not read
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 16
#: Languages whose counts a task holds at once (512 KB each).
HELD = 64
SMOOTH = 0.5
ROUNDS = 12
BLANK = 32
#: Characters worked on at once.
BLOCK = 1 << 20


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Code point -> lower-case letter, or a blank."""
    table = np.full(0x110000, BLANK, np.uint32)
    for start, end in ((0, 0xD800), (0xE000, 0x110000)):
        for code in range(start, end):
            char = chr(code)
            if char.isalpha():
                table[code] = ord(char.lower()[0])
    return table


def trigram_blocks(raw: bytes | None, buckets: int) -> Iterator[np.ndarray]:
    """Buckets of the trigrams about each letter of the text, BLOCK characters at once."""
    text = common.decoded(raw)
    for at in range(0, len(text), BLOCK):
        codes = letters()[np.frombuffer(text[max(0, at - 1) : at + BLOCK + 1].encode("utf-32-le", "replace"), np.uint32)]
        codes = np.concatenate(([BLANK] * (at == 0), codes, [BLANK] * (at + BLOCK >= len(text)))).astype(np.uint32)
        a, b, c = codes[:-2], codes[1:-1], codes[2:]
        mixed = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        yield (mixed >> np.uint32(8))[b != BLANK].astype(np.int64) % buckets


def trigrams(raw: bytes | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, how often) of the text's trigrams; none if it has no letter. A text of more trigrams than
    buckets has each bucket once."""
    parts, total, counts = [], 0, None
    for ids in trigram_blocks(raw, buckets):
        parts.append(ids)
        total += len(ids)
        if total > buckets:
            held = np.bincount(np.concatenate(parts), minlength=buckets)
            counts, parts = held if counts is None else counts + held, []
    if counts is not None:
        ids = np.flatnonzero(counts)
        return ids, counts[ids]
    ids = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return ids, np.ones(len(ids), np.int64)


def count(train: DataFrame, buckets: int) -> DataFrame:
    """(text, lang) -> (lang, bucket, n): summed in each task over all of its rows, then by Spark."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}

        def summed():
            for lang, counts in sums.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], names=["lang", "bucket", "n"])
            sums.clear()

        for batch in batches:
            for raw, lang in zip(common.texts(batch), batch.column("lang").to_pylist(), strict=True):
                ids, often = trigrams(raw, buckets)
                if lang not in sums:
                    if len(sums) == HELD:
                        yield from summed()
                    sums[lang] = np.zeros(buckets, np.int64)
                np.add.at(sums[lang], ids, often)
        yield from summed()

    common.ship(train.sparkSession)
    common.small_batches(train.sparkSession)
    parts = train.select("text", "lang").mapInArrow(run, "lang string, bucket long, n long")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages in code point order and their likelihoods, buckets x languages."""

    def __init__(self, langs: list[str], likelihood: np.ndarray):
        self.langs, self.likelihood = langs, likelihood

    @property
    def buckets(self) -> int:
        return self.likelihood.shape[0]


def fit(train: DataFrame) -> Model:
    """train: (text, lang), all rows with a language count."""
    langs = sorted(r.lang for r in train.select("lang").distinct().collect())
    buckets = BUCKETS
    table = count(train, buckets).toArrow()  # at most languages x buckets rows
    place = {lang: i for i, lang in enumerate(langs)}
    counts = np.zeros((buckets, len(langs)))
    counts[table["bucket"].to_numpy(), [place[x] for x in table["lang"].to_pylist()]] = table["n"].to_numpy()
    counts += SMOOTH
    return Model(langs, (counts / counts.sum(axis=0, keepdims=True) * buckets).astype(np.float32))


def infer(model: Model, raw: bytes | None) -> tuple[list[int], np.ndarray]:
    """Chosen languages and their shares, largest first; nothing where there is no letter."""
    ids, often = trigrams(raw, model.buckets)
    if not len(ids) or not model.langs:
        return [], np.empty(0)
    return chosen(model.likelihood[ids], often.astype(np.float32))


def mixture(like: np.ndarray, weights: np.ndarray, shares: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Shares after some rounds of expectation-maximisation, and the log-likelihood."""
    total = weights.sum()
    for _ in range(rounds):
        fresh = shares * ((weights / (like @ shares)) @ like) / total
        done = np.abs(fresh - shares).max() < 1e-4
        shares = fresh
        if done:
            break
    return shares, float(weights @ np.log(like @ shares))


def chosen(like: np.ndarray, weights: np.ndarray) -> tuple[list[int], np.ndarray]:
    langs = list(range(like.shape[1]))
    n = float(weights.sum())
    shares, fit_now = mixture(like, weights, np.full(len(langs), 1 / len(langs), np.float32))
    penalty = 0.5 * np.log(max(n, 2.0))
    while len(langs) > 1:
        out = int(np.argmin(shares))
        kept = [k for k in range(len(langs)) if k != out]
        start = shares[kept] + 1e-6
        fresh, fit_next = mixture(like[:, kept], weights, (start / start.sum()).astype(np.float32))
        if fit_next + penalty < fit_now:
            break
        langs, like, shares, fit_now = [langs[k] for k in kept], like[:, kept], fresh, fit_next
    order = np.argsort(-shares, kind="stable")
    return [langs[k] for k in order], shares[order] / shares.sum()


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs -> (doc_id, lang_pred, score, shares)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        langs, scores, shares = [], [], []
        for raw in common.texts(batch):
            found, share = infer(model, raw)
            langs.append(model.langs[found[0]] if found else "und")
            scores.append(min(1.0, float(share[0])) if found else 0.0)
            shares.append([(model.langs[k], float(x)) for k, x in zip(found, share, strict=True)])
        kind = pa.map_(pa.string(), pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, kind)], names=["doc_id", "lang_pred", "score", "shares"])

    return common.map_arrow(docs.select("doc_id", "text"), run, common.with_id(docs, "lang_pred string, score double, shares map<string,double>"))


def accepted(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """docs whose main language has at least this share; all columns stay."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = (infer(model, raw) for raw in common.texts(batch))
        kept = [i for i, (langs, shares) in enumerate(found) if langs and shares[0] >= least]
        if kept:
            yield batch.take(pa.array(kept))

    return common.map_arrow(docs, run, docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: a language, and an id whose crc32 modulo 3 is not 1."""
    return docs.where(F.col("lang").isNotNull() & (common.crc32_mod("doc_id", 3) != 1)).select("text", "lang")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = common.crc32_mod("doc_id", 3) == 1
    return predict(docs, fit(training_rows(docs))).select("doc_id", held.alias("held_out"), "lang_pred", "score", "shares")
