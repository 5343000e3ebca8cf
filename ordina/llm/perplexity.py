"""Quality rules: n-gram perplexity within language-specific bands, besides base rules.

Model. Spark counts character 4-grams of all clean texts, per language; a text is clean if it has at
most CLEAN symbols for each word, whatever else it is. A model of all texts would learn junk as well and find it
likely. From the distinct 4-grams follow
the continuation counts of the lower orders, and from counts of counts the three discounts of
modified Kneser-Ney smoothing, per language and order. Characters are lower-cased, digits count as
0, white space as one blank, and a text has a blank before and after. A 4-gram is one long of four
16-bit characters (beyond those, U+FFFD), so no two n-grams are mixed up when counted.

Storage. Per language and order, all n-grams in sorted arrays with their probabilities, and all
contexts with their back-off weights: 12 bytes each, looked up by their full 64 bits, so that no two
share an entry. What is sent to executors grows with the number of distinct n-grams.

Rules. base_failed: fewer than 50 words, or over half of the words in 3-word windows that occur at
least twice. A text that passes is rejected if its log-perplexity lies outside of its language's
band, median -/+ BAND spreads, where the median and the spread (the larger of MIN_SPREAD and 1.4826
times the median absolute deviation) come from all texts of that language that pass the base rules.

Defined results
  null text      no words: base_failed, not kept
  empty text     likewise
  very long text read whole, in blocks
  null lang      a language of its own
  no clean text  a language without any gives every n-gram the same probability, so its texts pass
  repeated rows  each counted and each judged
  ties at a band kept
  empty table    no rows
  extra columns  not read
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

ORDER = 4
BLOCK = 1 << 20
BAND = 5.0
MIN_SPREAD = 0.015
STEP = 0.001
SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Symbols for each word of a text that the model learns from, at the most.
CLEAN = 0.1


# Characters and n-grams


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Code point -> 16-bit character of the model."""
    table = np.full(0x110000, 0xFFFD, np.uint64)
    for code in range(0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        char = chr(code)
        table[code] = ord("0") if char.isdigit() else 32 if char.isspace() else min(ord(char.lower()[0]), 0xFFFF)
    return table


def grams(raw: bytes | None) -> Iterator[np.ndarray]:
    """Blocks of the text's 4-grams as unsigned longs, first character highest."""
    text = common.decoded(raw)
    if not text:
        return
    for at in range(0, len(text) + 2 - (ORDER - 1), BLOCK):
        part = text[max(0, at - 1) : at + BLOCK + ORDER - 2]
        codes = classes()[np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32)]
        if at == 0:
            codes = np.concatenate(([np.uint64(32)], codes))
        if at + BLOCK + ORDER - 2 >= len(text):
            codes = np.concatenate((codes, [np.uint64(32)]))
        if len(codes) >= ORDER:
            yield codes[:-3] << np.uint64(48) | codes[1:-2] << np.uint64(32) | codes[2:-1] << np.uint64(16) | codes[3:]


def clean(raw: bytes | None) -> bool:
    """Whether the model learns from a text: it would else find strings of symbols as likely as words."""
    raw = raw or b""
    return sum(map(raw.count, b"#*$%&|<>")) <= CLEAN * len(raw.split())


def gram_counts(docs: DataFrame) -> DataFrame:
    """docs -> (lang, gram, n) over all clean texts; each task sums what it has read before the shuffle."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([p[0] for p in parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], np.concatenate([p[1] for p in parts])[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[first], np.add.reduceat(counts, first)

    def run(batches):
        held: dict[str, list] = {}
        raw_held: dict[str, tuple[list, int]] = {}

        def fold(lang):
            blocks, _ = raw_held.pop(lang)
            part = np.unique(np.concatenate(blocks), return_counts=True)
            held[lang] = [merged([*held.get(lang, []), part])]

        for batch in batches:
            for raw, lang in zip(common.texts(batch), map(lang_key, batch.column("lang").to_pylist()), strict=True):
                for block in grams(raw) if clean(raw) else ():
                    blocks, size = raw_held.get(lang, ([], 0))
                    blocks.append(block)
                    raw_held[lang] = (blocks, size + len(block))
                    if size + len(block) >= BLOCK:
                        fold(lang)
        for lang in list(raw_held):
            fold(lang)
        for lang, [(keys, counts)] in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])

    common.ship(docs.sparkSession)
    common.small_batches(docs.sparkSession)
    parts = docs.select("text", "lang").mapInArrow(run, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


# The model


def discounts(table: DataFrame) -> DataFrame:
    """(lang, c) -> d1, d2, d3 per language, after Chen and Goodman; bounded to sensible values."""
    few = [F.count(F.when(F.col("c") == i, True)).alias(f"n{i}") for i in range(1, 5)]
    y = F.when(F.col("n1") + 2 * F.col("n2") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
    level = lambda i: F.when(F.col(f"n{i}") > 0, F.least(F.greatest(i - (i + 1) * F.col("y") * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(0.1)), F.lit(float(i) - 0.1))).otherwise(0.5).alias(f"d{i}")
    return table.groupBy("lang").agg(*few).withColumn("y", y).select("lang", level(1), level(2), level(3))


def orders(counts: DataFrame) -> list[DataFrame]:
    """4-gram counts -> for orders 1 to 4: (lang, gram, c); lower orders hold continuation counts."""
    tables = [counts.select("lang", "gram", F.col("n").alias("c"))]
    for order in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND((1 << (16 * order)) - 1)
        lower = tables[-1].select("lang", suffix.alias("gram")).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("c"))
        tables.append(common.written(lower, f"order-{order}"))
    return tables[::-1]


def smoothed(counts: DataFrame) -> list[DataFrame]:
    """Per order a written table (lang, gram, context, p, w, kinds): the interpolated probability, and the
    context's weight of the order below and number of followers. A context has no more rows than
    there are characters."""
    out: list[DataFrame] = []
    for order, table in enumerate(orders(counts), 1):
        group = Window.partitionBy("lang", "context")
        d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        table = (
            table.join(common.written(discounts(table), "discounts"), "lang")
            .withColumn("context", F.shiftrightunsigned(F.col("gram"), 16))
            .withColumn("d", F.least(d, F.col("c")))
            .withColumn("total", F.sum("c").over(group))
            .withColumn("w", F.sum("d").over(group) / F.col("total"))
            .withColumn("kinds", F.count(F.lit(1)).over(group))
        )
        own = (F.col("c") - F.col("d")) / F.col("total")
        if order == 1:
            table = table.withColumn("p", own + F.col("w") / (F.col("kinds") + 1))  # one more for characters never seen
        else:
            below = out[-1].select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            suffix = F.col("gram").bitwiseAND((1 << (16 * (order - 1))) - 1)
            table = table.withColumn("suffix", suffix).join(below, ["lang", "suffix"]).withColumn("p", own + F.col("w") * F.col("lower"))
        out.append(common.written(table.select("lang", "gram", "context", "p", "w", "kinds"), f"smoothed-{order}"))
    return out


class Model:
    """Per order and language, n-grams in sorted arrays with probabilities, and contexts with weights."""

    def __init__(self, probabilities, weights, unseen: dict):
        self.probabilities, self.weights, self.unseen = probabilities, weights, unseen

    @staticmethod
    def look_up(table: dict, lang: str, gram: np.ndarray) -> np.ndarray:
        """A value for each n-gram, nan for those that the table does not hold."""
        if lang not in table:
            return np.full(len(gram), np.nan, np.float32)
        keys, values = table[lang]
        at = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
        return np.where(keys[at] == gram, values[at], np.float32(np.nan))

    def log_loss(self, lang: str, blocks) -> tuple[float, int]:
        """Sum of -log p and number of 4-grams."""
        loss, n, floor = 0.0, 0, self.unseen.get(lang, 1e-4)
        for block in blocks:
            p = self.look_up(self.probabilities[3], lang, block)
            scale, todo = np.ones(len(block), np.float32), np.flatnonzero(np.isnan(p))
            gram = block[todo]
            for order in range(ORDER, 0, -1):
                if not len(todo):
                    break
                # Not seen at this order: the context's weight times the order below.
                w = self.look_up(self.weights[order - 1], lang, gram >> np.uint64(16))
                scale[todo] *= np.where(np.isnan(w), 1, w)
                if order == 1:
                    p[todo] = scale[todo] * floor
                    break
                gram = gram & np.uint64((1 << (16 * (order - 1))) - 1)
                below = self.look_up(self.probabilities[order - 2], lang, gram)
                found = ~np.isnan(below)
                p[todo[found]] = scale[todo[found]] * below[found]
                todo, gram = todo[~found], gram[~found]
            loss -= float(np.log(np.maximum(p, 1e-12)).sum(dtype=np.float64))
            n += len(block)
        return loss, n


def lang_key(lang: str | None) -> str:
    """Languages as non-null keys: the null language is the empty key."""
    return "" if lang is None else f"={lang}"


def fit(docs: DataFrame) -> Model:
    tables = smoothed(common.written(gram_counts(docs), "grams"))

    def stored(table: DataFrame, gram: str, value: str) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        held = table.select("lang", F.col(gram).alias("k"), F.col(value).cast("float").alias("v")).toArrow().combine_chunks()
        langs, out = held["lang"].combine_chunks().dictionary_encode(), {}
        if isinstance(langs, pa.ChunkedArray):
            langs = langs.combine_chunks()
        codes, keys, values = langs.indices.to_numpy(), held["k"].to_numpy().view(np.uint64), held["v"].to_numpy()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            own = np.flatnonzero(codes == code)
            own = own[np.argsort(keys[own])]
            out[lang] = keys[own], values[own]
        return out

    rare = {r.lang: r.p for r in tables[0].groupBy("lang").agg(F.first(F.col("w") / (F.col("kinds") + 1)).alias("p")).collect()}  # a row per language
    weights = [t.select("lang", "context", "w").distinct() for t in tables]
    return Model([stored(t, "gram", "p") for t in tables], [stored(t, "context", "w") for t in weights], rare)


# Rules


def measures(raw: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = raw or b""
    words = raw.split()
    text = common.decoded(raw)
    blanks = sum(map(text.count, " \t\n\v\f\r"))
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if line in seen:
            dup += 1
        elif line.strip(" \t\n\v\f\r"):
            seen.add(line)
    repeat = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        often = Counter(windows)
        if len(often) < len(windows):
            covered = -1
            for i, window in enumerate(windows):
                if often[window] > 1:
                    repeat += i + 2 - max(covered, i - 1)
                    covered = i + 2
    return len(words), len(text) - blanks, len(SYMBOLS.findall(text)), dup, repeat


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs -> (doc_id, lang, measures, base_failed, log_ppl)."""
    schema = common.with_id(docs, "lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_ppl double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, losses = [], []
        for raw, lang in zip(common.texts(batch), batch.column("lang").to_pylist(), strict=True):
            rows.append(measures(raw))
            loss, n = shared.value.log_loss(lang_key(lang), grams(raw))
            losses.append(loss / n if n else None)
        columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("lang"), *columns, pa.array(losses, pa.float64())],
            names=["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_ppl"],
        )

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return common.map_arrow(docs.select("doc_id", "lang", "text"), run, schema).withColumn("base_failed", failed)


def bands(table: DataFrame) -> DataFrame:
    """Per language: lower and upper log-perplexity, from exact medians of values in steps of STEP."""

    def median(rows: DataFrame, name: str) -> DataFrame:
        steps = rows.groupBy("lang", "step").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("lang").orderBy("step"))
        half = F.sum("n").over(Window.partitionBy("lang")) / 2
        return steps.withColumn("upto", upto).withColumn("half", half).where("upto >= half").groupBy("lang").agg(F.min("step").alias(name))

    good = table.where(~F.col("base_failed") & F.col("log_ppl").isNotNull()).select("lang", F.round(F.col("log_ppl") / STEP).cast("long").alias("step"))
    middle = common.written(median(good, "mid"), "medians").withColumnRenamed("lang", "l")
    spread = common.written(median(good.join(middle, F.col("lang").eqNullSafe(F.col("l"))).select("lang", F.abs(F.col("step") - F.col("mid")).alias("step")), "mad"), "spreads")
    both = middle.join(spread, F.col("lang").eqNullSafe(F.col("l"))).drop("l")
    reach = BAND * F.greatest(F.lit(MIN_SPREAD), 1.4826 * F.col("mad") * STEP)
    return both.select("lang", (F.col("mid") * STEP - reach).alias("low"), (F.col("mid") * STEP + reach).alias("high"))


def judged(docs: DataFrame) -> DataFrame:
    """docs -> measures, log_ppl, base_failed and kept."""
    table = common.written(scored(docs, fit(docs)), "perplexities")
    limits = common.written(bands(table), "bands").withColumnRenamed("lang", "l")  # a row per language
    inside = F.col("log_ppl").between(F.col("low"), F.col("high"))
    return table.join(limits, F.col("lang").eqNullSafe(F.col("l")), "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))).drop("l", "low", "high")


def query(spark, sf_dir: str) -> DataFrame:
    found = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl")
