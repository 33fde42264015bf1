"""Vector search against brute force, language and toxicity by what they get right, URL rules, and the registered queries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sliceweave.llm import ann, language, topk, toxicity, url_rules
from sliceweave.llm.common import with_prefix_sums


def vectors():
    rng = np.random.default_rng(1)
    made = [(i, [float(x) for x in rng.integers(-60, 60, 12)]) for i in range(400)]
    made += [(i, made[7][1]) for i in range(400, 520)]  # one vector many times
    made += [(50, made[3][1]), (50, made[3][1]), (None, made[4][1]), (601, None), (602, [1.0, None, 2.0]), (603, [float("nan")] * 12),
             (604, [float("inf")] * 12), (700, []), (701, [0.0] * 12), (702, [5.0, 1.0])]
    return [(i, v, 1, 2.0, "x") for i, v in made]


SCHEMA = "vec_id long, embedding array<double>, rank int, score double, block string"


def usable(zero):
    out = []
    for i, v, *_ in vectors():
        if v is not None and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            out.append((-1 if i is None else i, np.array(v + [0.0] * (12 - len(v)))))
    return out


def brute(rows, every, k, score, sign):
    want = []
    for n, (q, v) in enumerate(rows):
        if q >= 0 and q % every == 0:
            best = sorted((sign * score(v, w), i) for m, (i, w) in enumerate(rows) if m != n)[:k]
            want += [(q, r + 1, i, round(sign * s, 6)) for r, (s, i) in enumerate(best)]
    return sorted(want)


def found(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(float(r["score"]), 6)) for r in df.collect())


def test_top_inner_products(spark):
    df = spark.createDataFrame(vectors(), SCHEMA).repartition(3)
    want = brute(usable(True), 50, 5, lambda a, b: float(a @ b), -1)
    assert found(topk.top_inner_products(df)) == want
    assert found(topk.top_inner_products(df, block=32, pack=4)) == want
    assert topk.top_inner_products(df.limit(0)).count() == 0
    few = df.filter("vec_id in (50, 7)").limit(2)
    assert topk.top_inner_products(few).count() <= 2


@pytest.mark.parametrize("scale", [10, 3 * 10 ** 6, 2 ** 50])
def test_whole_scores_are_exact(spark, scale):
    """Sums beyond the whole numbers that doubles hold, close scores and ties among them, against Python's integers."""
    rng = np.random.default_rng(2)
    rows = [(i, [int(x) for x in rng.integers(-scale, scale, 8)]) for i in range(300)]
    rows += [(300 + i, [x + (j == i % 8) for j, x in enumerate(rows[0][1])]) for i in range(40)] + [(400, rows[7][1]), (401, rows[7][1])]
    want = []
    for n, (q, v) in enumerate(rows):
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(rows) if m != n)[:5]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>").repartition(3)
    for options in ({}, {"block": 32, "pack": 2}):
        got = topk.top_inner_products(df, whole=True, **options).collect()
        assert sorted((r["query_id"], r["rank"], r["vec_id"], int(r["score"])) for r in got) == sorted(want)


def test_packs_meet_only_blocks_they_can_reach(spark):
    """With lengths that fall steeply, pairs of packs and blocks stay far below all of them."""
    rng = np.random.default_rng(3)
    made = [(i, [float(x) for x in rng.standard_normal(6) * 0.97 ** (i % 600)]) for i in range(3000)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>").repartition(3)
    visits, keep = spark.sparkContext.accumulator(0), topk._visit

    def counted(*args):
        inner = keep(*args)

        def visit(frames):
            for frame in frames:
                visits.add(len(frame))
                yield from inner(iter([frame]))

        return visit

    topk._visit = counted
    try:
        got = found(topk.top_inner_products(df, block=50, pack=4))
    finally:
        topk._visit = keep
    assert got == brute([(i, np.array(v)) for i, v in made], 50, 5, lambda a, b: float(a @ b), -1)
    assert visits.value < 60 // 4 * 60 * 0.6


def test_nearest_neighbours(spark):
    df = spark.createDataFrame(vectors(), SCHEMA).repartition(3)
    want = brute(usable(False), 100, 10, lambda a, b: float(np.sqrt(((a - b) ** 2).sum())), 1)
    for size in (16, 1024):
        got = found(ann.nearest_neighbours(df, block=size))
        pairs = lambda rows: {(q, i) for q, _, i, _ in rows}
        assert len(got) == len(want) and len(pairs(got) & pairs(want)) >= 0.9 * len(pairs(want))
    # sure of everything, the search is exact
    assert found(ann.nearest_neighbours(df, block=16, sure=1 - 1e-12)) == want
    assert ann.nearest_neighbours(df.limit(0)).count() == 0


def test_chi_square():
    assert ann.chi_square_cdf(ann.chi_square_point(0.9, 8), 8) == pytest.approx(0.9)
    assert ann.chi_square_point(0.95, 2) == pytest.approx(5.991, abs=1e-3)


def test_prefix_sums(spark):
    rows = [(i % 3 if i % 5 else None, i * 7919 % 1000, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, o long, v long").repartition(7)
    got = {(r["k"], r["o"], r["v"]): r["s"] for r in with_prefix_sums(df, ["k"], ["o", "v"], "v", "s").collect()}
    total = {}
    for k, o, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        total[k] = total.get(k, 0) + v
        assert got[(k, o, v)] == total[k]
    flat = with_prefix_sums(df, [], ["o", "v"], "v", "s").orderBy("o", "v").collect()
    assert [r["s"] for r in flat] == list(np.cumsum([r["v"] for r in flat]))


PAGES = [(1, "http://Blog.Example.NET/en/1?x"), (2, "http://example.net/de/1"), (3, "https://a.example.com/de/x"), (4, "https://a.example.com/fr/x"), (5, "ftp://x.org/fr/"),
         (6, "http://notexample.net"), (7, None), (8, "example.net/en/"), (9, ""), (10, "http://a.b/login?next=1"), (11, "http://a.b/x?replytocom=5"), (12, "http://ads.b/x"),
         (13, "http://net/"), (14, "http://fakeexample.com/de/"), (15, "http://x.org/fr/" + "y" * 5000), (1, "http://Blog.Example.NET/en/1?x"), (16, "http://example.com/de/"),
         (None, "http://x.net/"), (17, "http://net.b/x"), (18, "x://y://z.net/")]
WANT = {1: ("blog.example.net", "/en/1", "example.net/en/", "allow"), 2: ("example.net", "/de/1", "net/", "block"), 3: ("a.example.com", "/de/x", "example.com/de/", "block"),
        4: ("a.example.com", "/fr/x", None, "allow"), 5: ("x.org", "/fr/", "org/fr/", "allow"), 6: ("notexample.net", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("a.b", "/login", None, "block"), 11: ("a.b", "/x", None, "block"), 12: ("ads.b", "/x", None, "block"),
        13: ("net", "/", "net/", "block"), 14: ("fakeexample.com", "/de/", None, "allow"), 15: ("x.org", "/fr/" + "y" * 5000, "org/fr/", "allow"),
        16: ("example.com", "/de/", "example.com/de/", "block"), None: ("x.net", "/", "net/", "block"), 17: ("net.b", "/x", None, "allow"), 18: ("y:", "//z.net/", None, "allow")}


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, "h", "r", 1) for i, u in PAGES], "page_id long, url string, host string, rule string, token int")
    got = url_rules.judge_urls(df)
    assert sorted(got.columns) == ["host", "page_id", "path", "rule", "token", "url", "verdict"]
    rows = got.collect()
    assert len(rows) == len(PAGES)
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == WANT[r["page_id"]], r["page_id"]
    assert url_rules.judge_urls(df.limit(0)).count() == 0


def test_language(spark):
    say = {"en": "the house and the garden with some of those things", "de": "das haus und der garten mit einigen dieser dinge", "fr": "la maison et le jardin avec des choses"}
    rows = [(i, " ".join([say[x]] * (1 + i % 4)), x, x if i % 3 else "mixed", "c", 1.0) for i in range(240) for x in [list(say)[i % 3]]]
    odd = [(1000, None, "en", "en", "c", 1.0), (1001, "", None, None, "c", 1.0), (1002, "12345 !!! ---", "de", "de", "c", 1.0), (1003, say["fr"], "en", "fr", "c", 1.0),
           (1003, say["fr"], "en", "fr", "c", 1.0), (None, say["de"], None, None, "c", 1.0), (1004, say["de"] + " und" * 20_000, "de", "mixed", "c", 1.0)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, choice string, top double").repartition(3)
    got = language.of_documents(df).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {r[0]: r[2] for r in rows}
    assert all(r["language"] == truth[r["doc_id"]] and r["accepted"] for r in got if r["doc_id"] in truth)
    by_id = {r["doc_id"]: r for r in got}
    for i in (1000, 1001, 1002):
        assert by_id[i]["language"] == "und" and not by_id[i]["accepted"] and by_id[i]["letters"] == 0
    assert by_id[1003]["language"] == by_id[1003]["text_language"] == "fr" and by_id[None]["language"] == "de" and by_id[1004]["language"] == "de"
    kept = language.accepted(df)
    assert kept.columns == df.columns and kept.count() == len(got) - 3
    assert language.of_documents(df.limit(0)).count() == 0

    # a short text that could be either is settled by what comes with it
    pages = [(i, f"http://{x}.host.example/{x}/{i}", f'<html lang="{x}"><body><p>{say[x]}</p></body></html>') for i in range(120) for x in [list(say)[i % 3]]]
    pages += [(500, "http://fr.host.example/fr/9", '<html lang="fr"><script>the and with</script><p>garden</p></html>'), (501, None, None)]
    model = language.fit(df, "doc_id", "text", "lang")
    told = {r["page_id"]: r for r in language.of_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()}
    assert told[0]["language"] == "en" and told[1]["language"] == "de" and told[2]["language"] == "fr" and told[501]["language"] == "und"


def test_small_and_unknown_languages(spark):
    """A language of few rows is in the model; a text in none of its languages is und, also if it declares its own."""
    say = {"en": "the house and the garden with some of those things", "de": "das haus und der garten mit einigen dieser dinge"}
    few = "talo ja puutarha ovat kauniita kun aurinko paistaa"
    rows = [(i, " ".join([say[x]] * (1 + i % 4)), x, "a") for i in range(1200) for x in [list(say)[i % 2]]]
    rows += [(2000 + i, few + " hyvin" * i, "fi", "a") for i in range(4)]
    rows += [(3000, "zxqv wkpj qqzx jvwx kzqp xwvj zzkq pxqj", "xx", "a"), (3001, "zxqv wkpj qqzx jvwx kzqp xwvj zzkq pxqj", None, "a")]
    got = {r["doc_id"]: r for r in language.of_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)).collect()}
    for i, _, lang, _ in rows:
        if i < 3000:
            assert got[i]["language"] == lang and got[i]["accepted"], i
        else:
            assert got[i]["language"] == got[i]["text_language"] == "und" and not got[i]["accepted"], i


def test_host_levels(spark):
    row = spark.range(1).select(language.host_levels(F.lit("a.b.c")).alias("l")).first()
    assert row["l"] == ["a.b.c", "b.c", "c"]


def test_kernel_folds_into_a_table():
    marks, terms = ["idiot", "loser", "garden", "house"], ["idiiot", "losser", "gardener", "x", ""]
    kernel, alpha = toxicity.Kernel(marks), np.array([1.0, 0.5, -1.0, -0.25])
    assert np.allclose(kernel(terms) @ alpha, toxicity.term_scores(terms, kernel.table(alpha), 0.0), atol=1e-3)
    near = kernel(["id-iot", "idxiot", "house"])[:, 0]
    assert near[0] > 0.4 and near[1] > 0.4 and near[2] < 0.1


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    syllables = ["an", "er", "on", "re", "th", "st", "ed", "ou", "ti", "ha"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    docs, labels = [], []
    for i in range(1200):
        words, bad = [word() for _ in range(40)], i % 6 == 0
        if bad:
            words[int(rng.integers(40))] = ["idiot", "scumbag", "moron!", "Loser"][int(rng.integers(4))]
        docs.append((i, " ".join(words), "x", 1.0, 5))
        if i % 10:
            labels.append((i, int(bad), 7))
    labels += [(5, 1, 7), (None, 1, 7), (7, None, 7)]
    docs += [(9000, "you idxiot " + " ".join(word() for _ in range(30)), "x", 1.0, 5), (9001, "such a s c u m b a g here", "x", 1.0, 5), (9002, None, "x", 1.0, 5), (9003, "", "x", 1.0, 5),
             (9003, "", "x", 1.0, 5), (None, "mo.ron", "x", 1.0, 5), (9004, " ".join(word() for _ in range(50_000)), "x", 1.0, 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, term string, score double, toxic int").repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, score int")
    model = toxicity.fit(df, lab)
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    held = [got[i] for i in range(1200) if got[i]["held_out"]]
    assert len(held) > 200 and np.mean([r["predicted"] == (r["doc_id"] % 6 == 0) for r in held]) > 0.97
    assert got[9000]["predicted"] == got[9001]["predicted"] == got[None]["predicted"] == 1
    assert got[9002]["predicted"] == got[9003]["predicted"] == 0 and 0 <= got[9002]["score"] <= 1
    assert toxicity.score(df.limit(0), model).count() == 0
    assert toxicity.fit(df, lab.limit(0)).bias == -1.0


def test_queries_are_registered():
    from __spark_entry__ import oracle_sql, queries

    names = queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert {"op1_secret_scan", "op2_top_inner_products", "op7_url_filter"} <= set(oracle_sql())
