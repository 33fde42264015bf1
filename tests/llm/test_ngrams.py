"""Resampling, phrases and quality against plain Python, and their edge cases: nulls, empty and long texts, ties, repeated
rows, empty tables, and extra columns whose names clash with the operators' own."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sliceweave.llm import phrases, quality, resampling

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000)) + " " + "y" * 70_000 + " end"
FOLD = {c: c + 32 for c in range(65, 91)}


def near(a, b):
    return a == pytest.approx(b, abs=1e-12)


# ------------------------------------------------------------------------------------------ resampling

def gram_list(text, longest=2):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    return words, [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def test_crcs_of_runs_come_from_prefixes():
    rng = random.Random(4)
    texts = ["", None, "One", "ÀÉ naïve-Text_of 3 words", " ".join("ab" * rng.randrange(1, 400) for _ in range(300)), "z" * 70_000 + " q " + "é" * 300]
    crcs, sizes, counts = resampling.running_crcs(pa.array(texts))
    for n, (row, grams) in enumerate(resampling.gram_crcs(crcs, sizes, counts, 4), 1):
        got = defaultdict(list)
        for r, g in zip(row.tolist(), grams.tolist()):
            got[r].append(g)
        for r, text in enumerate(texts):
            words, _ = gram_list(text)
            assert got[r] == [zlib.crc32(" ".join(words[i:i + n]).encode()) for i in range(len(words) - n + 1)]


def brute_importance(docs, target, buckets, percent, least):
    place = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(place, gram_list(text)[1]))
    for text in target:
        t.update(map(place, gram_list(text)[1]))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        words, grams = gram_list(text)
        weight = sum(gain[place(g)] for g in grams) // len(grams) if grams else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words), len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    late = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = Counter(late[:percent * len(late) // 100])
    return out, drawn


def test_importance(spark):
    rng = random.Random(1)
    vocabulary = [f"v{i}" for i in range(300)] + ["été", "Ünder"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(60)))) for i in range(200)]
    items += [(1000, None), (1001, ""), (1002, " .,!- "), (1003, LONG), (None, "A b C d e " * 8), (None, None), (1004, "same text " * 12), (1004, "same text " * 12), (1005, "Ä-b\x00c__d" * 9)]
    target = [" ".join(rng.choices(vocabulary[:40], k=30)) for _ in range(20)] + [None, ""]
    given = spark.createDataFrame([(*x, 1, "r", b"c", 2, 3) for x in items], "doc_id long, text string, words int, id string, crcs binary, rank int, drawn int").repartition(5)
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, id int")
    got = resampling.importance(given, goal, buckets=500).collect()
    want, drawn = brute_importance(items, target, 500, 25, 20)
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, drawn.total() + 1)) and Counter(tuple(r)[:5] for r in ranked) == drawn
    assert all((-a["score"], a["doc_id"] or 9999) <= (-b["score"], b["doc_id"] or 9999) for a, b in zip(ranked, ranked[1:]))
    rows = resampling.resampled(given, goal, buckets=500)
    assert rows.columns == given.columns
    ids = {r["doc_id"] for r in ranked}
    assert Counter(r["doc_id"] for r in rows.collect()) == Counter(i for i, _ in items if i in ids)


def test_importance_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert resampling.importance(none, some).count() == 0
    got = {r["doc_id"]: r for r in resampling.importance(some, none, least_words=1, percent=100).collect()}
    assert got[1]["n_features"] == 5 and got[1]["weight"] < 0 and got[1]["rank"] == 1 and got[2]["rank"] is None


# ------------------------------------------------------------------------------------------ phrases

def brute_collocations(docs, support, longest=5, cover=100, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        wanted = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        covered = {p[i:j] for p, a in wanted.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= cover * counts[p[i:j]]}
        found = []
        for p, a in wanted.items():
            if p not in covered:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def texts_of_phrases():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)] + ["É", "x\x00y", "𝒳", "a b", "-"]
    fixed = ["new york city", "As Soon As Possible now", "to be or not to be", "É 𝒳 x\x00y"]
    out = []
    for i in range(400):
        parts = [" ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=rng.randrange(8))) for _ in range(rng.randrange(5))]
        parts.insert(rng.randrange(len(parts) + 1), rng.choice(fixed))
        out.append((rng.choice(["en", "en", "en", "de", None, "und"]), rng.choice([". ", ",", "\n", " ", "\t", ";\r"]).join(parts)))
    return out + [("en", None), ("en", ""), ("fr", "only here"), (None, " .,;\n"), ("en", "la " * 3000), ("de", "w1 w2 " * 400 + "q" * 50_000)] + [("de", "copied passage of words")] * 30


@pytest.mark.parametrize("cover", [100, 60])
def test_collocations(spark, cover):
    items = texts_of_phrases()
    given = spark.createDataFrame([(*x, 5, "k", 1) for x in items], "lang string, text string, phrase int, key string, n int").repartition(6)
    got = phrases.collocations(given, support=12, cover=cover)
    want = brute_collocations(items, 12, cover=cover)
    assert len(want) >= 40 and sorted(map(tuple, got.collect())) == want
    few = phrases.collocations(given, support=12, cover=cover, top=3)
    assert sorted(map(tuple, few.collect())) == brute_collocations(items, 12, cover=cover, top=3)


def test_key_filter_sends_blocks(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    sent = []

    def counted(self, *args, f=DataFrame.toLocalIterator, **more):
        for row in f(self, *args, **more):
            sent.append(row)
            yield row

    def refuse(*_, **__):
        raise AssertionError("a row for each word of bits reaches the driver")

    keys = spark.range(40_000).select(F.xxhash64("id").alias("k"))
    plain = keys.toPandas()["k"].to_numpy().view(np.uint64)
    monkeypatch.setattr(phrases.KeyFilter, "BLOCK", 1 << 10)
    monkeypatch.setattr(DataFrame, "toLocalIterator", counted)
    monkeypatch.setattr(DataFrame, "toPandas", refuse)
    monkeypatch.setattr(DataFrame, "collect", refuse)
    found = phrases.KeyFilter.of(keys, "k")
    assert 64 * len(found.bits) == 1 << 20 and len(sent) == 16
    bits = np.zeros(1 << 20, dtype=np.uint8)
    for at in phrases.KeyFilter.places(plain, np.uint64((1 << 20) - 1)):
        bits[at.astype(np.int64)] = 1
    assert np.array_equal(np.packbits(bits, bitorder="little").view(np.uint64), found.bits)
    assert found(plain).all() and not phrases.KeyFilter.of(keys.limit(0), "k")(plain).any()


def test_shards_lose_no_phrase(spark, monkeypatch):
    """Many small shards, whose supports differ, and a filter that lets nearly all through."""
    items = texts_of_phrases()
    given = spark.createDataFrame(items, "lang string, text string").repartition(7)
    want = brute_collocations(items, 12)
    monkeypatch.setattr(phrases, "SHARD_WORDS", 900)
    assert sorted(map(tuple, phrases.collocations(given, support=12).collect())) == want
    totals = {"en": 10 ** 6, "de": 10 ** 6, "und": 10 ** 6, "fr": 5}
    assert phrases.shard_candidates(given.fillna("und", "lang").fillna(""), totals, 5, 12).filter("key is null").count() > 4
    monkeypatch.setattr(phrases.KeyFilter, "MOST", 1 << 16)
    monkeypatch.setattr(phrases.KeyFilter, "places", staticmethod(lambda keys, mask: iter([keys & np.uint64(7)])))
    assert sorted(map(tuple, phrases.collocations(given, support=12).collect())) == want


def test_words_that_are_names_of_languages(spark):
    """A word of one language's name in another one is no word of that other's name in the first."""
    items = [("de", "en de. en fr en"), ("en", "de en en. fr"), ("fr", "fr en. en fr de")] * 30
    given = spark.createDataFrame(items, "lang string, text string").coalesce(1)
    frequent, _ = phrases.frequent_phrases(given, support=20)
    counts = {(r["lang"], r["phrase"]): r["n"] for r in frequent.collect()}
    assert {k: n for k, n in counts.items() if " " not in k[1]} == {
        ("de", "en"): 90, ("de", "de"): 30, ("de", "fr"): 30, ("en", "de"): 30, ("en", "en"): 60, ("en", "fr"): 30, ("fr", "fr"): 60, ("fr", "en"): 60, ("fr", "de"): 30}
    assert sorted(map(tuple, phrases.collocations(given, support=20).collect())) == brute_collocations(items, 20)


def test_texts_are_dealt_by_language(spark):
    """All rows, and a language in the parts of its own share only."""
    given = spark.createDataFrame([(lang, f"{lang} {i}") for i in range(600) for lang in ("de", "en", "es", "fr")], "lang string, text string").repartition(5)
    dealt = phrases.by_language(given, 8)
    parts = {(r["p"], r["lang"]) for r in dealt.select(F.spark_partition_id().alias("p"), "lang").distinct().collect()}
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, given.collect()))
    assert len({p for p, _ in parts}) >= 4 and len(parts) <= 8 + 3


def test_a_task_tells_a_phrase_once():
    """However many parts its texts come in."""
    salts, tally = np.array([7, 9], dtype=np.uint64), phrases.Tally()
    for texts, langs in ((["b a b", "c"], [0, 1]), (["a d", "a c b"], [0, 1]), (["d"], [1])):
        w = phrases.Words(pa.array(texts), np.array(langs, dtype=np.int32), salts)
        tally.add(w, 1, np.arange(len(w.hash)), w.hash)
    rows = [r for batch in tally.told(1, pa.array(["en", "fr"])) for r in batch.to_pylist()]
    assert sorted((r["lang"], r["phrase"], r["size"], r["n"]) for r in rows) == [
        ("en", "a", 1, 2), ("en", "b", 1, 2), ("en", "d", 1, 1), ("fr", "a", 1, 1), ("fr", "b", 1, 1), ("fr", "c", 1, 2), ("fr", "d", 1, 1)]
    assert not list(phrases.Tally().told(1, pa.array(["en"])))


def test_collocations_beyond_64_bits(spark):
    big = [("en", p, s, n) for p, s, n in (("a b", 2, 4 * 10 ** 12), ("a", 1, 5 * 10 ** 12), ("b", 1, 7 * 10 ** 12))]
    frequent = spark.createDataFrame(big, "lang string, phrase string, size int, n long")
    words = spark.createDataFrame([("en", 9 * 10 ** 14)], "lang string, n long")
    keep, phrases.frequent_phrases = phrases.frequent_phrases, lambda *_: (frequent, words)
    try:
        row = phrases.collocations(None).first()
    finally:
        phrases.frequent_phrases = keep
    assert row["score"] == 1000 * 4 * 10 ** 12 * 9 * 10 ** 14 // (35 * 10 ** 24)


def test_collocations_of_nothing(spark):
    for rows in ([], [("en", None)], [(None, "one two three")]):
        assert phrases.collocations(spark.createDataFrame(rows, "lang string, text string")).count() == 0


# ------------------------------------------------------------------------------------------ quality

def brute_places(text):
    """n-grams of a text as a counter: words, pairs, and words said again one or two words later."""
    words = re.findall(r"[0-9A-Za-z\x80-\U0010FFFF]+|[^0-9A-Za-z\x80-\U0010FFFF\x20\x09-\x0D]+", text or "")
    out = Counter(words) + Counter(zip(words, words[1:]))
    for gap in (1, 2):
        out[gap] += sum(a == b for a, b in zip(words, words[gap:]))
    return +out


def test_ngrams_of_quality():
    texts = ["", None, "It works; it works.", "THE!! the!! THE!!", "é ü é ü é", LONG, "one\ttwo\x0bthree###", "###"]
    places, counts = quality.places_of(pa.array(texts))
    for i, text in enumerate(texts):
        want = brute_places(text)
        mine = Counter(places[counts[:i].sum():counts[:i + 1].sum()].tolist())
        assert mine.total() == want.total() == counts[i]
        assert sorted(mine.values()) == sorted(want.values()) or text == LONG  # places may meet in a long text


def test_updates_match_a_plain_learner():
    """Follow-the-regularised-leader as a loop over places."""
    rng, size = random.Random(5), 12
    z, n = [0.0] * size, [0.0] * size
    learner = quality.Learner(np.zeros(size), np.zeros(size))

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return (math.copysign(quality.L1, z[i]) - z[i]) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(300):
        at = sorted(rng.sample(range(size), 4))
        x, y, c = [rng.random() for _ in at], rng.randrange(2), rng.choice([0.5, 3.0])
        w = [weight(i) for i in at]
        p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x))))
        for i, v, wi in zip(at, x, w):
            g = c * (p - y) * v
            s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA
            z[i], n[i] = z[i] + g - s * wi, n[i] + g * g
        learner.learn(np.array(at), np.array(x), float(y), c)
    assert learner.z == pytest.approx(z) and learner.weights() == pytest.approx([weight(i) for i in range(size)])


def quality_rows():
    rng = random.Random(6)
    words = ["".join(rng.choices("aeioulnrst", k=rng.randrange(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(700):
        text = " ".join(rng.choices(words, k=rng.randrange(20, 120)))
        good = i % 3 > 0
        kind = i % 4
        if not good:
            text = text.upper().replace(" ", "!! ") if kind == 0 else text.replace(" ", " | ") if kind == 1 else " ".join(w for w in text.split()[:12] for _ in range(9)) if kind == 2 else text.replace(" ", "### ")
        docs.append((i, text))
        labels.append((i, int(good)))
    return docs, labels


def test_quality(spark):
    docs, labels = quality_rows()
    docs += [(5000, None), (5001, ""), (5002, " \n"), (None, docs[1][1]), (1, docs[1][1]), (1, docs[0][1]), (5003, LONG)]
    labels += [(5000, 1), (5003, None), (None, 1), (1, 1), (9999, 0)]
    given = spark.createDataFrame([(*d, 1, "r", 0.5, True, 0) for d in docs], "doc_id long, text string, label int, learner string, score double, held_out boolean, place int").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    weights = quality.fit(given, marks)
    got = quality.score(given, weights).collect()
    assert len(got) == len(docs) and (weights != 0).sum() < quality.PLACES // 20
    assert np.array_equal(weights, quality.fit(given.repartition(2), marks))
    truth = dict(labels[:700])
    wrong = [r for r in got if r["held_out"] and r["doc_id"] in truth and r["predicted"] != truth[r["doc_id"]]]
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 100 and len(wrong) <= 0.05 * len(held)
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    bias = 1 / (1 + math.exp(-weights[-1]))
    assert all(near(by_id[i][0]["score"], bias) for i in (5000, 5001, 5002))
    assert by_id[None][0]["score"] in {r["score"] for r in by_id[1]}
    # a plain sparse dot product
    for i in (3, 4, 5003):
        places, counts = quality.places_of(pa.array([dict(docs)[i]]))
        raw = sum(weights[p] for p in places.tolist()) / math.sqrt(counts[0]) + weights[-1]
        assert by_id[i][0]["score"] == pytest.approx(1 / (1 + math.exp(-raw)), abs=1e-9)


def test_held_out_labels_teach_nothing(spark):
    docs, labels = quality_rows()
    given = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    a, b = (quality.fit(given, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, flipped))
    assert np.array_equal(a, b)


def test_quality_of_empty_tables(spark):
    none, marks = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")
    weights = quality.fit(none, marks)
    assert not weights.any() and quality.score(none, weights).count() == 0
