"""Language identification by fusing evidence: text, declared language, address suffix and host."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from sliceweave.llm.common import as_rows, field, mix, slices, words_of
from sliceweave.session import materialize

#: Trigrams of words are hashed to so many places; a language needs so many documents that declare it, of all rows.
PLACES, LEAST_DOCS = 1 << 15, 3
#: The fit reads about so many documents of each declared language.
FIT_DOCS = 5_000
#: What each language takes from the background, as a share of its own trigrams and in trigrams at least.
FROM_BACKGROUND, LEAST_FROM_BACKGROUND = 0.1, 500.0
#: How likely a text is in a language that the model does not have.
UNKNOWN = 0.01
#: A text's evidence counts as that of so many words at most, since its words are not independent.
WORDS = 60
#: Weight of a parent's distribution in a host's, in documents.
HOST_PRIOR = 20.0
UNDETERMINED = "und"


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and places of all letter trigrams, word ends marked; what is no letter is left out."""
    plain = ["\x02" + re.sub(r"[\W\d_]+", "", w) + "\x03" for w in words]
    sizes = np.fromiter(map(len, plain), dtype=np.int64, count=len(plain))
    text = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(plain)), sizes)
    if len(text) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    ok = np.flatnonzero(owner[:-2] == owner[2:])
    code = text[ok] | (text[ok + 1] << np.uint64(21)) | (text[ok + 2] << np.uint64(42))
    return owner[ok], (mix(code) & np.uint64(PLACES - 1)).astype(np.int64)


class Model:
    """Languages, the background (``und``) as the last, and a log likelihood for each place and language."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Log likelihoods from trigram counts (places x languages), with a column for the background.

    The background is half all languages alike and half any trigram. Every language takes a part of it, so a text of
    trigrams that a language lacks is less likely there than in the background, however few documents the language has.
    """
    totals = counts.sum(axis=0)
    own = counts / np.maximum(totals, 1)
    background = 0.5 * own.mean(axis=1) + 0.5 / PLACES
    taken = np.maximum(FROM_BACKGROUND, LEAST_FROM_BACKGROUND / (totals + LEAST_FROM_BACKGROUND))
    return np.log(np.column_stack([(1 - taken) * own + taken * background[:, None], background]))


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> Model:
    """Trigram counts by declared language, over a sample by hash of about FIT_DOCS rows of each; tasks add up their own first.

    Every language that LEAST_DOCS rows declare is in the model, however small its share of the rows.
    """
    labelled = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull())
    labelled = labelled.filter(F.col("lang") != UNDETERMINED)
    known = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") >= LEAST_DOCS)
    known = materialize(known.select(F.col("lang").alias("of_lang"), F.ceil(F.lit(1e6 * FIT_DOCS) / F.col("rows")).alias("share")))
    drawn = labelled.join(known, F.col("lang") == F.col("of_lang"))
    sample = drawn.filter(F.pmod(F.xxhash64(F.lit(23), "id", "text"), F.lit(1_000_000)) < F.col("share")).select("lang", "text")

    def count(frames):
        held: dict[str, np.ndarray] = {}

        def sums():
            for lang, n in held.items():
                at = np.flatnonzero(n)
                yield pd.DataFrame({"lang": lang, "place": at, "n": n[at].astype(np.int64)})
            held.clear()

        for frame in frames:
            for lang, part in frame.groupby("lang"):
                codes, _, words = words_of(pa.array(part["text"], pa.string()), lower=True)
                who, where = trigrams(words)
                times = np.bincount(codes, minlength=len(words)) if len(words) else np.zeros(0)
                held.setdefault(lang, np.zeros(PLACES))
                held[lang] += np.bincount(where, weights=times[who], minlength=PLACES)
            if len(held) > 100:
                yield from sums()
        yield from sums()

    sums = materialize(sample.mapInPandas(count, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")))
    languages = sorted(r["lang"] for r in sums.select("lang").distinct().collect())
    if not languages:
        return Model([], np.zeros((PLACES, 0)))
    counts, at = np.zeros((PLACES, len(languages))), {x: i for i, x in enumerate(languages)}
    for r in sums.toLocalIterator():
        counts[r["place"], at[r["lang"]]] += r["n"]
    return Model([*languages, UNDETERMINED], smoothed(counts))


def evidence(docs: DataFrame, model: Model, text: Column, keep: dict[str, Column]) -> DataFrame:
    """The columns of ``keep`` with ``letters`` (trigrams of the text) and ``text_log`` (log likelihood by language)."""
    languages = len(model.languages)
    sent = docs.sparkSession.sparkContext.broadcast(model.table)  # PLACES x languages
    source = docs.select(text.alias("_text"), *[c.alias(n) for n, c in keep.items()])
    schema = StructType([*source.schema.fields[1:], StructField("letters", LongType()), StructField("text_log", ArrayType(DoubleType()))])

    def run(batches):
        table = sent.value
        for batch in batches:
            for a, b in slices(batch.column(0)):
                codes, counts, words = words_of(batch.column(0).slice(a, b - a), lower=True)
                who, where = trigrams(words)
                per_word = np.stack([np.bincount(who, weights=table[where, i], minlength=len(words)) for i in range(languages)], axis=1) if languages else np.zeros((len(words), 0))
                grams = np.bincount(who, minlength=len(words)).astype(np.int64)
                total, letters = np.zeros((b - a, languages)), np.zeros(b - a, dtype=np.int64)
                full = np.flatnonzero(counts)
                if len(full):
                    starts = (np.cumsum(counts) - counts)[full]
                    total[full] = np.add.reduceat(per_word[codes], starts, axis=0)
                    letters[full] = np.add.reduceat(grams[codes], starts)
                total *= np.minimum(1.0, WORDS / np.maximum(counts, 1))[:, None]
                if languages:
                    total[:, -1] += np.log(UNKNOWN)
                logs = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * languages), pa.array(total.ravel()))
                rest = [batch.column(i).slice(a, b - a) for i in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(letters), logs], names=[f.name for f in schema.fields])

    return source.mapInArrow(run, schema)


def _likelihood(rows: DataFrame, column: str, languages: list[str]) -> DataFrame:
    """(column, <column>_log): how likely each language is to come with that value, from joint counts with the text's own
    choice; 1 is added to every count, so a rare value says little."""
    pairs = rows.filter(F.col(column).isNotNull() & F.col("choice").isNotNull()).groupBy(column, "choice").agg(F.count(F.lit(1)).alias("n"))
    totals = {r["choice"]: r["n"] for r in pairs.groupBy("choice").agg(F.sum("n").alias("n")).collect()}
    each = [F.sum(F.when(F.col("choice") == i, F.col("n")).otherwise(0)) for i in range(len(languages))]
    logs = [F.log((n + 1.0) / (totals.get(i, 0) + len(languages))) for i, n in enumerate(each)]
    return pairs.groupBy(column).agg(F.array(*logs).alias(f"{column}_log"))


def host_levels(host: Column) -> Column:
    """A host with its parents, the narrowest first: a.b.c, b.c, c."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def _host_priors(rows: DataFrame, languages: list[str]) -> DataFrame:
    """(host, prior): a host's shares of languages, drawn to those of its parent domain, which are drawn to their parent's,
    up to all rows. Counts are sums by name at every level, so a host with any share of the rows is added up in its tasks."""
    size = len(languages)
    zero = [F.lit(0.0)] * size
    per_host = materialize(rows.filter(F.col("host").isNotNull() & F.col("choice").isNotNull()).groupBy("host").agg(
        F.array(*[F.count_if(F.col("choice") == i).cast("double") for i in range(size)]).alias("n")))
    whole = per_host.agg(*[F.sum(F.element_at("n", i + 1)) for i in range(size)]).first()
    totals = np.array([float(x or 0) for x in whole]) + 1.0
    base = F.array(*[F.lit(float(x)) for x in totals / totals.sum()]) if size else F.array(*zero).cast("array<double>")
    named = per_host.select("host", "n", F.posexplode(host_levels(F.col("host"))).alias("depth", "name"))
    by_name = materialize(named.groupBy("name").agg(F.array(*[F.sum(F.element_at("n", i + 1)) for i in range(size)]).alias("m")))
    # the widest parent first
    lines = named.select("host", "depth", "name").join(by_name, "name").groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "m"))).alias("line"))
    drawn = F.aggregate("line", base, lambda prior, level: F.zip_with(level["m"], prior, lambda n, p: (n + HOST_PRIOR * p)
                        / (F.aggregate(level["m"], F.lit(0.0), lambda s, x: s + x) + HOST_PRIOR)))
    return lines.select("host", drawn.alias("prior"))


def identify(docs: DataFrame, model: Model, text: Column, keep: dict[str, Column], declared: Column | None = None, suffix: Column | None = None,
             host: Column | None = None, least: float = 0.5) -> DataFrame:
    """The columns of ``keep`` with language, confidence, text_language, letters and accepted, for every row of ``docs``.

    The posterior is in proportion to the text's likelihood, those of the declared language and of the address suffix, and
    the host's prior. How far a declaration or suffix can be trusted, and what a host writes, is counted over all rows
    against the language that the text alone speaks for. Missing evidence (null) says nothing. A text without letters (null
    and empty ones too) has only the other evidence; it is ``und`` and not accepted, as is one whose best language stays
    under ``least``, and one that the background explains better than any language. Repeated rows are judged alike; an empty table gives no rows.
    """
    null = F.lit(None).cast("string")
    given = {"declared": declared if declared is not None else null, "suffix": suffix if suffix is not None else null, "host": host if host is not None else null}
    raw = evidence(docs, model, text, {**{f"k_{n}": c for n, c in keep.items()}, **given})
    best = (F.array_position("text_log", F.array_max("text_log")) - 1).cast("int")
    rows = materialize(raw.withColumn("choice", F.when((F.col("letters") > 0) & (F.size("text_log") > 0), best)))
    languages = model.languages
    names = F.array(*[F.lit(x) for x in languages]) if languages else F.array().cast("array<string>")
    out = rows
    total = F.col("text_log")
    add = lambda a, b: F.when(b.isNull(), a).otherwise(F.zip_with(a, b, lambda x, y: x + y))
    if languages:
        for column, used in (("declared", declared), ("suffix", suffix)):
            if used is not None:
                known = materialize(_likelihood(rows, column, languages)).withColumnRenamed(column, f"of_{column}")
                out = out.join(known, F.col(column) == F.col(f"of_{column}"), "left")
                total = add(total, F.col(f"{column}_log"))
        if host is not None:
            priors = materialize(_host_priors(rows, languages)).withColumnRenamed("host", "of_host")
            out = out.join(priors, F.col("host") == F.col("of_host"), "left")
            total = add(total, F.transform("prior", lambda p: F.log(p)))
    out = out.withColumn("log", total).withColumn("top", F.array_max("log"))
    sure = 1.0 / F.aggregate("log", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    pick = F.element_at(names, F.array_position("log", F.col("top")).cast("int"))
    clear = (F.col("letters") > 0) & (F.coalesce(sure, F.lit(0.0)) >= least) & (F.coalesce(pick, F.lit(UNDETERMINED)) != UNDETERMINED)
    return out.select(*[F.col(f"k_{n}").alias(n) for n in keep], F.when(clear, pick).otherwise(UNDETERMINED).alias("language"),
                      F.when(F.col("letters") > 0, sure).otherwise(0.0).alias("confidence"),
                      F.when(F.col("choice").isNotNull(), F.element_at(names, F.col("choice") + 1)).alias("text_language"), "letters",
                      F.coalesce(clear, F.lit(False)).alias("accepted"))


def of_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **options) -> DataFrame:
    """``identify`` for a table of texts with a declared language and a source that stands for the host."""
    model = fit(docs, id_col, text_col, lang_col)
    keep = {id_col: F.col(id_col), "text_key": F.xxhash64(F.col(text_col))}
    return identify(docs, model, F.col(text_col), keep, declared=F.col(lang_col), host=F.col(source_col), **options)


def text_of_markup(html: Column) -> Column:
    bare = F.regexp_replace(html, r"(?s)<(?:script|style)\b.*?</(?:script|style)>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_replace(bare, r"&[a-z#0-9]+;", " ")


def of_pages(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """``identify`` for web pages: text, ``lang`` attribute, the address's language suffix, and the host with its parents.

    The suffix is a two-letter first folder of the path, else the host's last label.
    """
    url, html = F.col(url_col), F.col(html_col)
    host = F.nullif(F.lower(F.regexp_extract(url, r"^[^:]*://([^/?#:]+)", 1)), F.lit(""))
    folder = F.nullif(F.regexp_extract(url, r"^[^:]*://[^/?#]+/([a-z]{2})(?:[/?#]|$)", 1), F.lit(""))
    suffix = F.coalesce(F.concat(F.lit("/"), folder), F.concat(F.lit("."), F.substring_index(host, ".", -1)))
    declared = F.nullif(F.lower(F.regexp_extract(html, r"""(?is)<html[^>]*\blang=["']?([a-z]{2,3})""", 1)), F.lit(""))
    return identify(pages, model, text_of_markup(html), {id_col: F.col(id_col)}, declared=declared, suffix=suffix, host=host, **options)


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents whose language could not be told, whatever their other columns are called."""
    judged = of_documents(docs, id_col, text_col, **options)
    gone = materialize(judged.filter("not accepted").select(F.col(id_col).alias("id"), "text_key").distinct())
    same = field(id_col).eqNullSafe(F.col("id")) & (F.xxhash64(field(text_col)) == F.col("text_key"))
    return as_rows(docs).join(gone, same, "left_anti").select("row.*")
