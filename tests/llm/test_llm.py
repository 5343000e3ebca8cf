"""The training-data operators against brute force, exact round trips and held-out labels."""

import hashlib
import itertools
import math
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ordina.llm import avi, bpe, chat, common, crf, langid, mixing, perplexity, simhash, suffix, warc

DATA = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "one", "en", "a", 3),
    (3, "one", "en", "a", 3),
    (None, "no id here at all", None, "b", 17),
    (5, "é漢字 🙂 \t\x0b x", "fr", None, 8),
    (6, "word " * 20_000, "en", "a", 100_000),
    (7, "12 34 !!", "de", "b", 8),
]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(AWKWARD)], DOCS + ", extra long")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return spark.read.parquet(f"{DATA}/documents.parquet")


def duck(sql, **frames):
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con.execute(sql).fetchall()


# Mixing


def test_mix_matches_sql(spark, docs):
    got = sorted(tuple(r) for r in mixing.query(spark, DATA).select("doc_id", "size", "source_size", "target", "taken").collect())
    assert got == sorted(duck(mixing.SQL))


def test_mix_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, None: 40, "z": 0}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    weights = dict(zip(["a", "b", "c", "z", None], itertools.cycle((5, 2, 1))))
    share, capped = dict.fromkeys(sizes, 0.0), set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        total = sum(w for s, w in weights.items() if s not in capped)
        share = {s: 3.0 * sizes[s] if s in capped else left * weights[s] / total for s in sizes}
        over = {s for s in sizes if s not in capped and share[s] >= 3 * sizes[s]}
        if not over:
            break
        capped |= over
    assert got == pytest.approx(share)


def test_mix_copies(spark, awkward, empty):
    plan = mixing.planned(awkward)
    assert plan.count() == len(AWKWARD)
    assert plan.where("copies > 3").isEmpty() and plan.where("doc.text is null and size <> 0").isEmpty()
    assert mixing.mix(awkward).columns == awkward.columns
    assert mixing.mix(awkward).count() == plan.agg(F.sum("copies")).first()[0]
    assert mixing.mix(empty).isEmpty()
    clashing = awkward.select("*", *[F.lit(9).alias(c) for c in ("size", "copies", "copy", "target", "doc", "_copy")])
    mixed = mixing.mix(clashing)
    assert mixed.columns == clashing.columns and mixed.where("copies <> 9 or copy <> 9 or _copy <> 9").isEmpty()
    assert sorted(r.extra for r in mixed.collect()) == sorted(r.extra for r in mixing.mix(awkward).collect())


# Language


def test_language_held_out(spark, docs):
    got = langid.query(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 200 and (got.lang == got.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_mixture(spark, docs, awkward, empty):
    model = langid.fit(langid.training_rows(docs))
    by_lang = {r.lang: r.text for r in docs.where("length(text) > 3000").groupBy("lang").agg(F.max("text").alias("text")).collect() if r.lang}
    both = (by_lang["en"][:2000] + "\n" + by_lang["fr"][:1000]).encode()
    langs, shares = langid.infer(model, both)
    assert [model.langs[k] for k in langs][:2] == ["en", "fr"] and 0.5 < shares[0] < 0.8
    long = langid.infer(model, by_lang["de"].encode() * 40)
    assert model.langs[long[0][0]] == "de"
    got = {(r.doc_id, r.lang_pred) for r in langid.predict(awkward, model).collect()}
    assert {(1, "und"), (2, "und"), (7, "und")} <= got
    assert langid.predict(empty, model).isEmpty()
    none = langid.fit(langid.training_rows(empty))
    assert {r.lang_pred for r in langid.predict(awkward, none).collect()} == {"und"}


def plain_mixture(like, weights):
    """Shares by plain expectation-maximisation, and the least-share language dropped while the penalised likelihood allows it."""
    def em(langs, shares):
        for _ in range(langid.ROUNDS):
            new = dict.fromkeys(langs, 0.0)
            for row, w in zip(like, weights, strict=True):
                total = sum(shares[k] * row[k] for k in langs)
                for k in langs:
                    new[k] += w * shares[k] * row[k] / total / sum(weights)
            done = max(abs(new[k] - shares[k]) for k in langs) < 1e-4
            shares = new
            if done:
                break
        return shares, sum(w * math.log(sum(shares[k] * row[k] for k in langs)) for row, w in zip(like, weights, strict=True))

    langs = list(range(len(like[0])))
    shares, now = em(langs, {k: 1 / len(langs) for k in langs})
    while len(langs) > 1:
        out = min(langs, key=lambda k: (shares[k], k))
        rest = [k for k in langs if k != out]
        total = sum(shares[k] + 1e-6 for k in rest)
        fresh, then = em(rest, {k: (shares[k] + 1e-6) / total for k in rest})
        if then + 0.5 * math.log(max(sum(weights), 2)) < now:
            break
        langs, shares, now = rest, fresh, then
    return {k: shares[k] / sum(shares[j] for j in langs) for k in langs}


def test_language_equals_plain_mixture():
    rnd = np.random.default_rng(2)
    for langs, rows in ((1, 5), (2, 40), (4, 120), (6, 200)):
        like = rnd.gamma(0.5, 1.0, (rows, langs)).astype(np.float32) + 0.01
        true = rnd.choice(langs, rows, p=np.array([2.0] * min(langs, 2) + [0.0] * (langs - 2)) / (2.0 * min(langs, 2)))
        like[np.arange(rows), true] *= 6
        weights = rnd.integers(1, 4, rows).astype(np.float32)
        order, shares = langid.chosen(like, weights)
        want = plain_mixture(like.astype(float).tolist(), weights.tolist())
        assert set(order) == set(want) and order == sorted(order, key=lambda k: -want[k])
        assert shares == pytest.approx([want[k] for k in order], abs=2e-3)


def test_language_blocks(monkeypatch):
    # Trigrams do not depend on how a text is cut into blocks, nor on how many there are.
    rnd = random.Random(12)
    text = "".join(rnd.choice("abcé .1漢") for _ in range(997)).encode()
    for raw in (text, b"", b"1 2", b"x", b"ab", text[:8]):
        whole = Counter(np.repeat(*langid.trigrams(raw, 1 << 16)).tolist())
        few = Counter(np.repeat(*langid.trigrams(raw, 16)).tolist())
        for block in (1, 2, 7, 100):
            monkeypatch.setattr(langid, "BLOCK", block)
            assert Counter(np.repeat(*langid.trigrams(raw, 1 << 16)).tolist()) == whole
            assert Counter(np.repeat(*langid.trigrams(raw, 16)).tolist()) == few
        monkeypatch.setattr(langid, "BLOCK", 1 << 20)
        letters = sum(c.isalpha() for c in raw.decode("utf-8", "replace"))
        assert whole.total() == few.total() == letters


def test_language_counts(spark):
    # More languages than a task holds at once, with few and many rows each.
    rows = [(f"l{i % 150}", "abc de " * (1 + i % 7)) for i in range(600)]
    table = spark.createDataFrame(rows, "lang string, text string")
    want = Counter()
    for lang, text in rows:
        for k, n in zip(*langid.trigrams(text.encode(), langid.BUCKETS), strict=True):
            want[lang, int(k)] += int(n)
    got = {(r.lang, r.bucket): r.n for r in langid.count(table, langid.BUCKETS).collect()}
    assert got == want and len(langid.fit(table).langs) == 150


def test_ids_of_any_type(spark, docs):
    few = docs.orderBy("doc_id").limit(30).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    model = langid.fit(langid.training_rows(few))
    tables = [langid.predict(few, model), avi.digests(few), avi.clips(avi.stored(few)), bpe.digests(few), perplexity.judged(few), simhash.near_duplicates(few), suffix.digests(few), crf.scored(few, None)]
    want = {r.doc_id for r in few.collect()}
    for table in tables:
        assert dict(table.dtypes)["doc_id"] == "string" and {r.doc_id for r in table.collect()} == want


# AVI


@pytest.mark.parametrize("n", [0, 1, 64, 255, 256, 257, 5000])
def test_avi_round_trip(n):
    raw = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    payload = avi.payload_of(raw)
    assert len(payload) % 64 == 0 and len(payload) >= 64
    stored, shots, media = avi.analysed(avi.write_avi(payload))
    assert stored == payload
    assert shots[0][0] == 0 and shots[-1][1] == len(media.frames)


def test_avi_decoders_agree():
    frames = avi.encode_frames(np.random.default_rng(1).integers(0, 256, (2, 256), dtype=np.uint8))
    for frame in frames:
        header, scan = avi.split_jpeg(frame)
        plane = avi.decode_general(header, scan).reshape(16, 8, 16, 8)
        assert (plane == avi.decode_frames([frame])[0].reshape(16, 1, 16, 1)).all()


def test_avi_general_frame_with_ac_terms():
    """A block with DC and one AC term, by tables of its own."""
    quantiser = avi.segment(0xDB, bytes([0]) + bytes([1] * 64))
    frame = avi.segment(0xC0, bytes([8, 0, 8, 0, 8, 1, 1, 0x11, 0]))
    dc = avi.segment(0xC4, bytes([0x00, 0, 1] + [0] * 14 + [8]))
    ac = avi.segment(0xC4, bytes([0x10, 0, 2] + [0] * 14 + [0x00, 0x06]))
    bits = "00" + f"{200:08b}" + "01" + f"{40:06b}" + "00"
    bits += "1" * (-len(bits) % 8)
    body = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    data = b"\xff\xd8" + quantiser + frame + dc + ac + avi.segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])) + body + b"\xff\xd9"
    plane = avi.decode_frames([data])[0].astype(float)
    x = np.arange(8)
    want = 128 + 200 / 8 + 40 / 4 * np.cos((2 * x + 1) * np.pi / 16) / np.sqrt(2)
    assert np.abs(plane - np.rint(want)).max() <= 1


def test_avi_without_index_and_shots():
    data = avi.write_avi(bytes(256 * 4) + bytes([255]) * 256 * 4)
    bare = data[: data.rindex(b"idx1")]
    assert avi.read_avi(bare).frames == avi.read_avi(data).frames
    assert avi.analysed(data)[1] == [(0, 4), (4, 8)]


def test_avi_shots_equal_a_plain_loop():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 30, 80):
        hists = rng.dirichlet(np.full(16, 0.3), n // 4 + 1).repeat(4, axis=0)[:n] if n > 3 else rng.dirichlet(np.full(16, 0.3), n)
        diffs = [float(np.abs(a - b).sum() / 2) for a, b in itertools.pairwise(hists)]
        edges = [0]
        for i, d in enumerate(diffs):
            before = diffs[max(0, i - avi.WINDOW) : i] or [0.0]
            if d > max(avi.MIN_CUT, np.mean(before) + avi.CUT_SPREADS * np.std(before)):
                edges.append(i + 1)
        assert avi.shots(hists) == (list(itertools.pairwise([*edges, n])) if n else [])
    assert avi.analysed(avi.write_avi(bytes(256) + bytes([255]) * 256 * 3))[1] == [(0, 1), (1, 4)]
    assert avi.analysed(avi.write_avi(bytes(256) + bytes([255]) * 256))[1] == [(0, 1), (1, 2)]


def test_avi_rows(spark, awkward, empty):
    rows = {(r.doc_id, r.n_bytes): r for r in avi.digests(awkward).collect()}
    assert rows[1, 0].payload_sha256 == rows[2, 0].payload_sha256 == hashlib.sha256(bytes(64)).hexdigest()
    assert rows[1, 0].media_sha256 == rows[2, 0].media_sha256
    assert avi.clips(avi.stored(awkward)).where("end_s <= start_s").isEmpty()
    assert avi.digests(empty).isEmpty()


# BPE


def test_bpe_pieces():
    enc, rnd = bpe.encoding(), random.Random(1)
    alphabet = ["a", "b", " ", "  ", "\n", "'s", "'ll", "1", "23", "!", "é", "漢", "—", "'", "🙂", "\t", " "]
    for _ in range(800):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(120)))
        ids = [i for piece in bpe.pieces(text, rnd.randrange(1, 30)) for i in enc.encode_ordinary(piece)]
        assert ids == enc.encode_ordinary(text)


def test_bpe_long_runs():
    for text in (" " * 300_000 + "a", "a" * 100_000, "1!" * 60_000, "x y" * 30_000):
        assert bpe.decode(bpe.encode(text)) == text.encode()


def test_bpe_rows(spark, awkward, empty):
    enc = bpe.encoding()
    for r in bpe.encoded(awkward).collect():
        assert r.token_ids == enc.encode_ordinary(r.text or "") if len(r.text or "") < 1000 else bpe.decode(r.token_ids) == r.text.encode()
    for r in bpe.digests(awkward).where("doc_id = 5").collect():
        assert r.decoded_sha256 == hashlib.sha256(AWKWARD[5][1].encode()).hexdigest()
    assert bpe.digests(empty).isEmpty()


# Perplexity


def kneser_ney(counts):
    tables = {4: counts}
    for order in (3, 2, 1):
        tables[order] = Counter(g[1:] for g in tables[order + 1])
    out = {}
    for order in (1, 2, 3, 4):
        n = [sum(1 for v in tables[order].values() if v == k) for k in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.5
        d = [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), k - 0.1) if n[k - 1] else 0.5 for k in (1, 2, 3)]
        by = defaultdict(list)
        for gram, c in tables[order].items():
            by[gram[:-1]].append((gram, c))
        out[order] = {}
        for rows in by.values():
            total = sum(c for _, c in rows)
            taken = sum(min(d[min(c, 3) - 1], c) for _, c in rows)
            for gram, c in rows:
                lower = 1 / (len(rows) + 1) if order == 1 else out[order - 1][gram[1:]]
                out[order][gram] = (c - min(d[min(c, 3) - 1], c)) / total + taken / total * lower
    return out[4]


def test_perplexity_model(spark):
    rows = [("abab cab a", "x"), ("abc abd 12", "x"), (None, "x"), ("zz top é", None), ("", "y"), ("abab abab", "x")]
    table = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(rows)], "doc_id long, text string, lang string")
    code = lambda t: [32, *[int(perplexity.classes()[ord(c)]) for c in t], 32]
    counts = defaultdict(Counter)
    for t, l in rows:
        if t:
            c = code(t)
            counts[l].update(tuple(c[i : i + 4]) for i in range(len(c) - 3))
    got = {r.doc_id: r for r in perplexity.judged(table).collect()}
    for i, (t, l) in enumerate(rows):
        if t:
            p, c = kneser_ney(counts[l]), code(t)
            grams = [tuple(c[k : k + 4]) for k in range(len(c) - 3)]
            assert got[i].log_ppl == pytest.approx(-sum(np.log(p[g]) for g in grams) / len(grams), abs=1e-4)
        assert got[i].base_failed and not got[i].kept


def test_perplexity_keeps_ngrams_apart(spark):
    # More distinct n-grams than 22 bits could hold without many sharing a place.
    rnd = random.Random(3)
    texts = ["".join(chr(rnd.randrange(0x4E00, 0x9FFF)) for _ in range(4000)) for _ in range(100)]
    table = spark.createDataFrame([(i, t, "zh") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = perplexity.fit(table)
    grams = np.unique(np.concatenate([g for t in texts for g in perplexity.grams(t.encode())]))
    keys, _ = model.probabilities[3]["=zh"]
    assert np.array_equal(keys, grams)
    unseen = np.setdiff1d(grams ^ np.uint64(1 << 20), grams)
    assert np.isnan(model.look_up(model.probabilities[3], "=zh", unseen)).all()


def test_perplexity_rules(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = perplexity.query(spark, DATA).collect()
    for r in rows[:300]:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in (texts[r.doc_id] or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), dup, len(covered))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    good, junk = ([r.kept for r in rows if not r.base_failed and quality.get(r.doc_id) == q] for q in (1, 0))
    assert len(good) > 200 and sum(good) > 0.97 * len(good)
    assert len(junk) > 10 and sum(junk) < 0.1 * len(junk)


def test_perplexity_bands(spark):
    # Exact medians of steps and their spreads, each side of the band cut alike.
    rnd = random.Random(8)
    rows = [(i, lang, False, rnd.gauss(mid, 0.1)) for i, (lang, mid) in enumerate([("a", 1.5), ("b", 2.0), (None, 1.0)] * 101)]
    rows += [(900, "a", True, 50.0), (901, "a", False, None)]
    table = spark.createDataFrame(rows, "doc_id long, lang string, base_failed boolean, log_ppl double")
    for r in perplexity.bands(table).collect():
        steps = sorted(round(x / perplexity.STEP) for _, l, failed, x in rows if l == r.lang and not failed and x is not None)
        mid = steps[len(steps) // 2]
        mad = sorted(abs(x - mid) for x in steps)[len(steps) // 2]
        reach = perplexity.BAND * max(perplexity.MIN_SPREAD, 1.4826 * mad * perplexity.STEP)
        assert (r.low, r.high) == pytest.approx((mid * perplexity.STEP - reach, mid * perplexity.STEP + reach))


def test_perplexity_learns_from_clean_texts(spark):
    rnd = random.Random(4)
    plain = [" ".join("".join(rnd.choice("aeioulnrst") for _ in range(rnd.randrange(2, 7))) for _ in range(80)) for _ in range(40)]
    noisy = [" ".join(w + "$$$" for w in text.split()) for text in plain[:8]]
    rows = [(i, t, "x") for i, t in enumerate(plain + noisy)] + [(100 + i, t, "y") for i, t in enumerate(noisy)]
    got = {r.doc_id: r for r in perplexity.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert all(got[i].kept for i in range(40)) and not any(got[i].kept for i in range(40, 48))
    assert all(got[100 + i].kept for i in range(8))


def test_perplexity_awkward(spark, awkward, empty):
    rows = perplexity.judged(awkward).collect()
    assert len(rows) == len(AWKWARD) and not any(r.kept for r in rows)
    assert perplexity.judged(empty).isEmpty()


# SimHash


def classes_of(prints):
    prints, parent = list(prints), {}
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = np.array([p & (2**64 - 1) for p in prints], np.uint64)
    for i, p in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 2):
            a, b = root(p), root(prints[j])
            parent[max(a, b)] = min(a, b)
    return {p: root(p) for p in prints}


@pytest.mark.parametrize("crowded", [64, 3])
def test_simhash_components(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash.links, "__defaults__", (2, 4, crowded))
    rnd, prints = random.Random(3), set()
    for spread, n, bits in ((12, 250, 5), (64, 8, 6)):
        for _ in range(4):
            base = rnd.getrandbits(64)
            for _ in range(n):
                x = base
                for _ in range(rnd.randrange(bits)):
                    x ^= 1 << rnd.randrange(spread)
                prints.add(simhash.signed(x))
    rows = list(enumerate(prints)) + [(10_000, next(iter(prints)))]
    want, first = classes_of(prints), {}
    for i, p in rows:
        first[want[p]] = min(i, first.get(want[p], i))
    got = {r.doc_id: r.component_id for r in simhash.classes(spark.createDataFrame(rows, "doc_id long, fp long")).collect()}
    assert got == {i: first[want[p]] for i, p in rows}


def test_simhash_manhattan(spark):
    rnd = random.Random(4)
    rows = [(simhash.signed(rnd.getrandbits(64)), simhash.signed(rnd.getrandbits(64))) for _ in range(100)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", simhash.manhattan(simhash.embedded(F.col("a")), simhash.embedded(F.col("b"))).alias("m"))
    counts = lambda x: [((x >> (2 * i)) & 3).bit_count() for i in range(32)]
    assert all(r.m == sum(abs(p - q) for p, q in zip(counts(r.a), counts(r.b), strict=True)) for r in got.collect())


def test_simhash_fingerprints(docs, awkward, empty):
    for raw in (t.encode() for t in [r.text or "" for r in docs.limit(40).collect()] + [r[1] or "" for r in AWKWARD]):
        words = [w.decode() for w in raw.lower().split()]
        shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert simhash.fingerprint(raw) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == len(AWKWARD) and {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    assert simhash.near_duplicates(empty).isEmpty()


def jaccard_components(texts, words=5, similarity=0.8):
    """Text number -> smallest number reachable over pairs of shingle sets of this similarity."""
    sets = []
    for text in texts:
        found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        sets.append({tuple(found[k : k + words]) for k in range(max(len(found) - words + 1, 1 if found else 0))})
    root = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] == sets[j] or both >= similarity * (len(sets[i]) + len(sets[j]) - both):
            old, new = max(root[i], root[j]), min(root[i], root[j])
            root = [new if r == old else r for r in root]
    return root


def changed(rnd, words, n):
    copy = list(words)
    for k in rnd.sample(range(len(copy)), n):
        copy[k] = f"w{rnd.randrange(10**9)}"
    return copy


def components_found(spark, texts):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar(table).collect()}
    return [got[i] for i in range(len(texts))]


def test_similar_equals_brute_force(spark, docs):
    # Families on both sides of the threshold: each changed word changes up to five shingles.
    base = [r.text for r in docs.where("length(text) between 600 and 5000").orderBy("doc_id").limit(60).collect()]
    rnd, texts = random.Random(7), [None, "", "a", "A ", "a b c d", "a b c d e", "a b c d e f"]
    for text in base:
        words = text.split()
        texts.append(text)
        for share in (0.002, 0.008, 0.03, 0.06):
            texts.append(" ".join(changed(rnd, words, int(share * len(words)))))
    want, got = jaccard_components(texts), components_found(spark, texts)
    assert len(set(want)) > len(base) + 20
    assert sum(a == b for a, b in zip(got, want, strict=True)) > 0.99 * len(texts)
    assert all(want[i] == want[c] for i, c in enumerate(got))  # nothing is linked that should not be


@pytest.mark.parametrize("block", [1024, 5])
def test_similar_crowded_cells(spark, monkeypatch, block):
    # One template: all texts share cells, most pairs are under the threshold, the smallest has no near copy.
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", block)
    monkeypatch.setattr(simhash, "COLUMNS", 64)
    rnd = random.Random(11)
    template = [f"t{k}" for k in range(300)]
    texts = [" ".join(template + changed(rnd, ["x"] * 60, 60))]
    for _ in range(50):
        own = template + changed(rnd, ["x"] * 60, 60)
        texts.append(" ".join(own))
        if rnd.random() < 0.4:
            texts.append(" ".join(changed(rnd, own, 2)))
    texts += [" ".join(template + texts[1].split()[300:] + [f"z{k}"]) for k in range(12)]
    want = jaccard_components(texts)
    assert 30 < len(set(want)) < len(texts) - 20
    assert components_found(spark, texts) == want


def test_similar_recall_at_the_threshold(spark):
    # Pairs of 104 shingles of which 12 differ: 92 / 116 is just under 0.8, 93 / 115 just above.
    rnd, texts = random.Random(5), []
    for _ in range(400):
        words = [f"w{rnd.randrange(10**9)}" for _ in range(108)]
        texts += [" ".join(words), " ".join([*words[:97], *changed(rnd, words[97:], 11)])]
    want, got = jaccard_components(texts), components_found(spark, texts)
    linked = [i for i, c in enumerate(want) if c != i]
    assert len(linked) == 400 and sum(got[i] == want[i] for i in linked) >= 0.98 * len(linked)
    # The chance of a shared sample depends on the similarity alone.
    assert 1 - (1 - 0.8**simhash.SAMPLE) ** simhash.PRINTS > 0.99


def test_dedup_rows(spark):
    # Rows that share an id are documents of their own; columns of any name stay; ids may be strings.
    texts = ["some words that are said here once more", "quite another text of eight words in it", "nothing of this kind was ever said before"]
    rows = [("a", texts[0], 1, 9), ("a", texts[1], 2, 9), ("b", texts[1], 3, 9), ("c", texts[2], 4, 9), (None, texts[2], 5, 9), (None, "a text without an id of its own", 6, 9)]
    table = spark.createDataFrame(rows, "doc_id string, text string, _n int, part int")
    got = simhash.deduplicated(table)
    assert got.columns == table.columns
    assert sorted(r["_n"] for r in got.collect()) == [1, 2, 4, 6]
    assert {r.component_id for r in simhash.similar(table).collect()} == {"a", "c", None}
    assert simhash.near_duplicates(table).count() == 6


def test_dedup_takes_the_links_of_simhash(spark):
    # Two texts within two bits whose five-word shingles are not similar, and a chain over such a link to a similar text.
    rnd, far, near = random.Random(13), None, None
    distance = lambda a, b: (simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count()
    while not (far and near):
        words = [f"w{rnd.randrange(10**9)}" for _ in range(300)]
        pair = " ".join(words), " ".join(changed(rnd, words, 8))
        if distance(*pair) <= 2:
            near = near or pair
        elif distance(*pair) > 4:
            far = far or pair
    texts = [*near, " ".join([*near[1].split(), "more", "words"]), *far]
    assert jaccard_components(texts) == [0, 1, 1, 3, 4]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.deduplicated(table).collect()) == [0, 3, 4]


def test_dedup_leaves_no_link_of_near_duplicates(spark, docs):
    # Families of copies, some with repeated lines: no two rows that stay are in one class of near_duplicates or similar.
    rnd, rows = random.Random(17), []
    for r in docs.where("length(text) between 600 and 3000").orderBy("doc_id").limit(30).collect():
        words = r.text.split()
        for share in (0, 0.01, 0.03):
            copy = changed(rnd, words, int(share * len(words)))
            rows += [" ".join(copy), " ".join(copy + words[:20] * 3)]
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    parent = list(range(len(rows)))
    for found in (simhash.near_duplicates(table), simhash.similar(table)):
        for r in found.collect():
            old, new = max(parent[r.doc_id], parent[r.component_id]), min(parent[r.doc_id], parent[r.component_id])
            parent = [new if x == old else x for x in parent]
    assert sorted(r.doc_id for r in simhash.deduplicated(table).collect()) == sorted(set(parent))


def test_dedup_awkward(spark, awkward, empty):
    kept = simhash.deduplicated(awkward)
    assert kept.columns == awkward.columns
    # Null and empty texts are one group, as are equal rows.
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 5), (False, 6), (False, 7), (True, 0)]
    assert simhash.deduplicated(empty).isEmpty()


# Chat


def test_chat_matches_sql(spark):
    got = sorted(tuple(r) for r in chat.query(spark, DATA).collect())
    assert got == sorted(duck(chat.SQL))


def test_chat_trees(spark):
    rows = [("t", 1, None, "user", "q<\\b", 0.0), ("t", 2, 1, "assistant", "a\nb", 1.0), ("t", 3, 1, "assistant", "c\\l</turn>", 3.0), ("t", 4, 3, "user", "x</turn>\n", 0.0), ("t", 5, 2, "user", "deep", 0.5), ("u", 1, 9, None, None, None), ("v", 1, 2, "user", "cycle", 1.0), ("v", 2, 1, "user", "cycle", 1.0)]
    table = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    done = chat.formatted(table).select("tree", "leaf", chat.parsed(F.col("formatted")).alias("turns"), chat.under_loss(F.col("segments")).alias("loss")).collect()
    got = {r.tree: r for r in done}
    assert set(got) == {"t", "u"} and got["t"].leaf == 4
    assert [(t.role, t.text) for t in got["t"].turns] == [("user", "q<\\b"), ("assistant", "c\\l</turn>"), ("user", "x</turn>\n")]
    assert got["t"].loss == "c\\l</turn>"
    assert chat.formatted(table, best=5).where("tree = 't'").count() == 2
    assert chat.formatted(table.where("false")).isEmpty()


def test_chat_deep_path(spark):
    n = 300
    table = spark.range(1, n + 1).select(F.lit("t").alias("tree"), F.col("id").alias("node"), F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"), F.lit(0.0).alias("score"))
    turns = chat.formatted(table).select(chat.parsed(F.col("formatted")).alias("t")).first().t
    assert [t.text for t in turns] == [str(i) for i in range(1, n + 1)]


# CRF


def test_crf_marginals():
    rng, counts = np.random.default_rng(0), np.array([3, 1, 4])
    scores, t = rng.normal(size=8), rng.normal(size=(2, 2))
    good, expected, total = crf.marginals(scores, t, counts)
    at, pairs, z = 0, np.zeros((2, 2)), 0.0
    for c in counts:
        weight, marked, own = 0.0, np.zeros(c), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=int(c)):
            w = np.exp(sum(scores[at + i] * labels[i] for i in range(c)) + sum(t[labels[i], labels[i + 1]] for i in range(c - 1)))
            weight, marked = weight + w, marked + w * np.array(labels)
            for i in range(c - 1):
                own[labels[i], labels[i + 1]] += w
        assert np.allclose(good[at : at + c], marked / weight)
        pairs, z, at = pairs + own / weight, z + np.log(weight), at + c
    assert np.allclose(pairs, expected) and np.isclose(z, total)


def test_crf_held_out(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = crf.query(spark, DATA).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 50 and (got.predicted == got.quality).mean() > 0.95


def test_crf_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(3, 1), (7, 0), (None, 1), (99, 1), (6, None)], "doc_id long, quality int")
    model = crf.fit(awkward, labels)
    rows = crf.scored(awkward, model).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    assert crf.fit(empty, labels) is None
    assert {r.score for r in crf.scored(awkward, None).collect()} == {0.5}


# Suffix


def removed(texts, threshold):
    seen = Counter(t[i : i + threshold] for t in texts for i in range(len(t) - threshold + 1))
    out = []
    for t in texts:
        mask = bytearray(len(t))
        for i in range(len(t) - threshold + 1):
            if seen[t[i : i + threshold]] > 1:
                mask[i : i + threshold] = b"\1" * threshold
        runs = sum(1 for i in range(len(mask)) if mask[i] and (not i or not mask[i - 1]))
        out.append((len(t), sum(mask), runs, hashlib.sha256(bytes(b for b, m in zip(t, mask, strict=True) if not m)).hexdigest()))
    return out


def passages(seed):
    rnd = random.Random(seed)
    words = lambda n: " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 8))) for _ in range(n))
    shared = [words(30) for _ in range(4)]
    texts = [None, "", "a" * 300, "a" * 1000, "ab" * 400]
    for _ in range(50):
        text = words(rnd.randrange(80))
        for _ in range(rnd.randrange(3)):
            p, a = rnd.choice(shared), rnd.randrange(40)
            text += p[a : a + rnd.randrange(30, 180)] + words(rnd.randrange(10))
        texts.append(text)
    return texts + texts[10:14]


def test_suffix_blocks(monkeypatch):
    raw = random.Random(2).randbytes(5000)
    whole = suffix.groups(raw, 100)
    monkeypatch.setattr(suffix, "BLOCK", 37)
    assert all(np.array_equal(a, b) for a, b in zip(whole, suffix.groups(raw, 100), strict=True))


@pytest.mark.parametrize("seed", [5, 6])
def test_suffix_brute_force(spark, seed):
    texts = passages(seed)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.digests(table, 50).collect()}
    assert [got[i] for i in range(len(texts))] == removed([(t or "").encode() for t in texts], 50)
    cut = suffix.deduplicated(table, 50)
    assert cut.columns == table.columns and cut.count() == len(texts)


def test_suffix_documents(spark, docs):
    part = docs.where("length(text) < 6000").orderBy("doc_id").limit(250).select("doc_id", "text")
    rows = part.orderBy("doc_id").collect()
    want = removed([(r.text or "").encode() for r in rows], 400)
    got = suffix.digests(part).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == want
    assert all(len(r.text.encode()) >= r.n_bytes - r.n_removed for r in got)
    assert all(r.text == (t.text or "") for r, t in zip(got, rows, strict=True) if not r.n_removed)


def test_suffix_equals_doubling(spark, docs):
    few = docs.where("length(text) < 4000").orderBy("doc_id").limit(60).select("text")
    for table, threshold in ((few, 400), (spark.createDataFrame([(t,) for t in passages(4)], "text string"), 50)):
        starts = defaultdict(set)
        for r in suffix.doubled(table, threshold).collect():
            starts[r.text].add(r.pos)
        found = {(r.u1, r.u2): {i for x in r.ranges for i in range(x["lo"], x["hi"] + 1)} for r in suffix.spans(table, threshold).collect()}
        assert found and found == {suffix.identity(t.encode()): where for t, where in starts.items()}


def test_suffix_empty(spark, awkward, empty):
    assert suffix.digests(empty).isEmpty()
    assert suffix.digests(awkward).count() == len(AWKWARD)


# WARC


def test_warc(spark):
    rows = [(3, "http://a.b.com/x", "same"), (1, "http://b.com/y", "same"), (2, None, None), (None, "http://c/", "same"), (7, "http://z.com", "é" * 100_000), (8, "http://z.com\r\nX: y", "other"), (9, "http://q.com/", ""), (9, "http://q.com/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write(pages)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.captures(index, pages).collect())
    digest = lambda t: warc.base32(hashlib.sha1((t or "").encode()).digest())
    want = Counter()
    for page, _, html in rows:
        first = min(p for p, _, h in rows if (h or "") == (html or "") and p is not None)
        revisit = page != first
        want[page, len((html or "").encode()), digest(html), "revisit" if revisit else "response", first if revisit else None] += 1
    assert got == want
    urls = spark.createDataFrame([("http://a.b.com/x",), ("http://z.com/",), ("http://nowhere/",)], "url string")
    found = warc.find(index, urls).collect()
    assert {(r.page_id, r.record_type) for r in found} == {(3, "revisit"), (7, "response")}
    none = pages.where("false")
    assert warc.captures(warc.write(none), none).isEmpty() and warc.find(warc.write(none), urls).isEmpty()
    assert warc.captures(warc.write(pages, least=100), pages).where("record_type = 'revisit'").isEmpty()


def test_warc_directory_look_ups(spark, monkeypatch):
    # Blocks of 7 lines; every third page shares one URL, so that its captures fill many blocks.
    monkeypatch.setattr(warc, "BLOCK", 7)
    url = F.when(F.col("id") % 3 == 0, F.lit("http://hot.org/")).otherwise(F.concat(F.lit("http://h"), (F.col("id") % 13).cast("string"), F.lit(".org/"), F.col("id").cast("string")))
    pages = spark.range(300).select(F.col("id").alias("page_id"), url.alias("url"), F.col("id").cast("string").alias("html"), F.lit(1).alias("key"))
    index = warc.write(pages)
    blocks = warc.Directory(index).between(b"", b"\xff")
    assert len(blocks) > 40 and sum(b["captures"] for b in blocks) == 300
    everything = [(r.page_id, r.payload_digest) for r in warc.captures(index, pages).collect()]
    assert sorted(everything) == [(i, warc.base32(hashlib.sha1(str(i).encode()).digest())) for i in range(300)]
    wanted = {r.url: set() for r in pages.where("page_id % 17 = 0").collect()} | {"http://none.org/": set()}
    for r in pages.collect():
        if r.url in wanted:
            wanted[r.url].add((r.page_id, str(r.page_id)))
    got = {u: set() for u in wanted}
    for r in warc.find(index, spark.createDataFrame([(u,) for u in wanted], "url string")).collect():
        got[r.url].add((r.page_id, bytes(r.payload).decode()))
    assert got == wanted
    # A look-up opens only the blocks that it hits.
    read = []
    monkeypatch.setattr(warc, "block_lines", lambda row, whole=warc.block_lines: read.append(row["offset"]) or whole(row))
    key = b"org,h1)/1"
    assert [page for _, page, _ in warc.search(blocks, [((key, False, 0), (key, True, 1 << 63))])] == [1]
    assert len(read) == 1


# Pipeline


def test_pipeline(spark, docs):
    import corpus_pipeline

    now, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        now = common.written(stage(spark, now, DATA), name)
        sizes.append(now.count())
        if name != "encoding":
            assert now.columns == docs.columns
        if name == "near_duplicates":
            assert now.count() == now.select("doc_id").distinct().count()
            kept_texts = now
        if name == "repeats":
            again = now.join(kept_texts.select("doc_id", F.length("text").alias("was")), "doc_id")
            assert again.where("n_chars > was").isEmpty()
    assert sizes[1] > 0.95 * sizes[0] and 0.8 * sizes[1] < sizes[2] <= sizes[1] and sizes[3] == sizes[2]
    assert now.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
