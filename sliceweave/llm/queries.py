"""One query for each operator over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from sliceweave.llm.common import step_folder, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# ------------------------------------------------------------------------------------------------ 1 secrets

_ASSIGN = ("([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
           "|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)")
_KINDS = [("assign", _ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24),
          ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
          ("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 0, 24)]
_FOUND = " UNION ALL ".join(f"""SELECT b, '{kind}' AS kind, {i} AS o, start, start + length(hit) AS stop FROM (
  SELECT b, hits[i] AS hit, kept[i] AS kept, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT b, regexp_extract_all(t, '{regex}') AS hits, regexp_extract_all(t, '{regex}', {group}) AS kept, string_split_regex(t, '{regex}') AS gaps FROM texts)))
WHERE length(kept) >= {least}""" for i, (kind, regex, group, least) in enumerate(_KINDS))


@query("op1_secret_scan", f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, sha256(coalesce(text, '')) AS b FROM documents),
texts AS (SELECT b, any_value(t) AS t FROM docs GROUP BY b),
found AS MATERIALIZED ({_FOUND}),
per AS (SELECT b, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  coalesce(string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, o) FILTER (o < 3), '') AS base,
  string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, o) AS spans FROM found GROUP BY b)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, docs.b AS blob FROM docs LEFT JOIN per USING (b)""")
def op1_secret_scan(spark, sf_dir):
    """A first load: the ledger of this run is new."""
    from sliceweave.llm.secrets import Ledger, digest, scan

    return digest(scan(table(spark, sf_dir, "documents"), Ledger(spark, step_folder(spark, "ledger"))))


# ------------------------------------------------------------------------------------------------ 3 mixing

@query("op3_mix_sources")
def op3_mix_sources(spark, sf_dir):
    from sliceweave.llm.mixing import mix

    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


# ------------------------------------------------------------------------------------------------ 7 URL filters

_HOST_SQL = r"translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op7_url_filter", rf"""WITH parts AS (SELECT page_id, coalesce({_HOST_SQL}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1), '') AS tail FROM pages),
ruled AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host || tail, '/login(?:[/?.]|$)')
    OR regexp_matches(host || tail, '/cart(?:[/?.]|$)') OR regexp_matches(host || tail, '(?:^|\.)casino[.-]')
    OR regexp_matches(host || tail, '(?:^|\.)ads\.[^/]*/')
    OR regexp_matches(host || tail, '[?&]replytocom=') THEN 'block' ELSE 'allow' END AS verdict FROM ruled""")
def op7_url_filter(spark, sf_dir):
    from sliceweave.llm.url_rules import judge_urls

    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


# ------------------------------------------------------------------------------------------------ 10 packing

@query("op10_pack")
def op10_pack(spark, sf_dir):
    from sliceweave.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------------------------------------------ 2 exact top-k

@query("op2_top_inner_products", """WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(CAST(256 AS DOUBLE) * x) AS HUGEINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.r AS qr, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score, c.r FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id, r) AS rank FROM s) WHERE rank <= 5""")
def op2_top_inner_products(spark, sf_dir):
    from sliceweave.llm.topk import top_inner_products

    whole = F.transform(F.col("embedding"), lambda x: F.floor(x.cast("double") * 256.0).cast("double"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), whole).alias("embedding"))
    return top_inner_products(vectors, whole=True).select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


# ------------------------------------------------------------------------------------------------ 4 repeated passages

@query("op4_sentence_spans")
def op4_sentence_spans(spark, sf_dir):
    from sliceweave.llm.spans import without_repeats

    return without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


# ------------------------------------------------------------------------------------------------ 5 toxicity

@query("op5_toxicity")
def op5_toxicity(spark, sf_dir):
    from sliceweave.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


# ------------------------------------------------------------------------------------------------ 6 near duplicates

@query("op6_near_duplicates")
def op6_near_duplicates(spark, sf_dir):
    from sliceweave.llm.near_dups import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


# ------------------------------------------------------------------------------------------------ 8 approximate neighbours

@query("op8_nearest")
def op8_nearest(spark, sf_dir):
    from sliceweave.llm.ann import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


# ------------------------------------------------------------------------------------------------ 9 language

@query("op9_language")
def op9_language(spark, sf_dir):
    from sliceweave.llm.language import of_documents

    return of_documents(table(spark, sf_dir, "documents")).drop("text_key")


@query("language_of_pages")
def language_of_pages(spark, sf_dir):
    """The same for web pages, which have an address and markup; the text model comes from the documents."""
    from sliceweave.llm.language import fit, of_pages

    model = fit(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    return of_pages(table(spark, sf_dir, "pages"), model)


# ------------------------------------------------------------------------------------------------ 11 importance resampling

# crc32 of the bytes of ``w``: a table of 256 steps made by the rule, then one step a byte
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(w))), lambda i: CAST('0x' || substr(hex(encode(w)), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))),
  lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) + 1 AS INTEGER)])))"""
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FEATURES = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"


@query("op11_importance_resampling", f"""WITH steps AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(CAST(b AS BIGINT), range(0, 8)),
  lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM range(0, 256) r(b))),
docs AS (SELECT doc_id, row_number() OVER () AS r, len(w) AS n_words, {_FEATURES} AS f FROM (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)),
goals AS (SELECT {_FEATURES} AS f FROM (SELECT regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)),
doc_counts AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(f) AS w FROM docs) GROUP BY r, w),
raw AS (SELECT w, sum(n) AS n FROM doc_counts GROUP BY w), target AS (SELECT w, count(*) AS n FROM (SELECT unnest(f) AS w FROM goals) GROUP BY w),
placed AS MATERIALIZED (SELECT w, {_CRC} % 10000 AS bucket FROM (SELECT w FROM raw UNION SELECT w FROM target), steps),
s AS (SELECT bucket, sum(n) AS s FROM raw JOIN placed USING (w) GROUP BY bucket), t AS (SELECT bucket, sum(n) AS t FROM target JOIN placed USING (w) GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket)),
weights AS (SELECT r, CAST(floor(sum(n * gain)::DOUBLE / sum(n)) AS BIGINT) AS weight, CAST(sum(n) AS BIGINT) AS n_features FROM doc_counts JOIN placed USING (w) JOIN gains USING (bucket) GROUP BY r),
scored AS (SELECT doc_id, r, n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM docs LEFT JOIN weights USING (r)),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, r) AS rank FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM ranked) * 25 // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)""")
def op11_importance_resampling(spark, sf_dir):
    from sliceweave.llm.resampling import importance

    drawn = importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


# ------------------------------------------------------------------------------------------------ 12 phrase collocations

_GRAMS = " UNION ALL ".join(f"SELECT lang, array_to_string(w[i:i + {n - 1}], ' ') AS phrase, {n} AS size FROM (SELECT lang, w, unnest(range(1, len(w) - {n - 2})) AS i FROM pieces WHERE len(w) >= {n})" for n in range(1, 6))


@query("op12_phrase_collocations", f"""WITH pieces AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang,
  unnest(string_split_regex({_FOLDED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
f AS MATERIALIZED (SELECT lang, phrase, any_value(size) AS size, count(*) AS f FROM ({_GRAMS}) GROUP BY lang, phrase HAVING count(*) >= 100),
cut AS (SELECT lang, phrase, size, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS x, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS y
  FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1)),
scores AS (SELECT cut.lang, cut.phrase, cut.size, a, k, l.f AS l, r.f AS r, CAST(n AS BIGINT) AS n, CAST(1000::HUGEINT * a * n::HUGEINT // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = x JOIN f r ON r.lang = cut.lang AND r.phrase = y JOIN totals ON totals.lang = cut.lang),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = b.lang AND f.size > b.size AND 100 * f.f >= 100 * b.a AND contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000""")
def op12_phrase_collocations(spark, sf_dir):
    from sliceweave.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------------------------------------------ 13 quality

@query("op13_quality")
def op13_quality(spark, sf_dir):
    from sliceweave.llm.quality import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
