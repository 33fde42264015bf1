"""Repeated passages: runs of sentences and long runs of words that occur before, anywhere in the corpus, are cut out."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from sliceweave.llm.common import mix, slices
from sliceweave.session import materialize

#: Sentences of a span, the words it must have at least, and the words after which a long sentence is cut.
RUN, LEAST_WORDS, LONGEST = 3, 15, 20
#: A repeated passage of so many words loses at least one part, wherever it lies in its sentences.
SURE = 51
#: Words of a word span: wherever it lies, it holds a whole part of at most LONGEST words.
REACH = 2 * LONGEST - 1
#: Every so many words in turn choose a start among them, so SURE equal words have a word span in common: it is chosen by
#: words within SURE, and ends within them.
CHOICE = (SURE + 2 - REACH) // 2
_SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+(?=\s|$)\s*|[.!?]+|\n\s*|$)")
_LONG = re.compile(r"\s*(?:\S+\s*){1,%d}" % LONGEST)


def sentences(text: str) -> list[str]:
    """Parts of ``text`` in turn: sentences with what parts them from the next; long ones are cut every LONGEST words."""
    out, held = [], ""
    for part in _SENTENCE.findall(text):
        held += part
        # a mark inside a word, as in 3.14, ends nothing
        if not part or not (part[-1].isspace() or part[-1] in ".!?"):
            continue
        if not part[-1].isspace():
            continue
        out.append(held)
        held = ""
    if held:
        out.append(held)
    short = []
    for s in out:
        if len(s) > 2 * LONGEST and len(s.split()) > LONGEST:
            short += _LONG.findall(s)
        else:
            short.append(s)
    return short


def span_ends(sizes: list[int], run: int, least: int) -> list[int]:
    """Where the spans that start at each part in turn end: after ``run`` parts, and as many more as ``least`` words take.

    ``sizes`` are the words of the parts. The last starts, whose spans the text does not fill, are left out.
    """
    upto = np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype=np.int64))])
    ends = np.maximum(np.searchsorted(upto, upto[:-1] + least), np.arange(len(sizes)) + run)
    return ends[ends <= len(sizes)].tolist()


def span_hashes(words: list[list[str]], run: int, least: int) -> tuple[list[int], list[int]]:
    """Starts and 64-bit hashes of all spans of parts, given by their ``words``; white space does not matter."""
    keys = [" ".join(w) for w in words]
    ends = span_ends([len(w) for w in words], run, least)
    return list(range(len(ends))), [xxhash.xxh64_intdigest("\n".join(keys[i:e]).encode("utf-8", "surrogatepass")) - (1 << 63) for i, e in enumerate(ends)]


def word_spans(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text numbers, first words and 64-bit hashes of the spans of REACH words that start at chosen words.

    Of every CHOICE words in turn, the one with the least hash is chosen (the last of equal ones). The choice depends on
    these words alone, neither on sentences and lines nor on what comes before.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    none = np.zeros(0, dtype=np.int64)
    if not len(sizes) or sizes.max() < REACH:
        return none, none, none
    coded = pa.array([w.encode("utf-8", "surrogatepass") for t in texts for w in t], pa.large_binary()).dictionary_encode()
    each = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    hashes = each[coded.indices.to_numpy(zero_copy_only=False)]
    owner, first = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    windows = np.flatnonzero(owner[:-CHOICE + 1] == owner[CHOICE - 1:])
    least, at = hashes[windows], windows.copy()
    for k in range(1, CHOICE):
        lower = hashes[windows + k] <= least
        least[lower], at[lower] = hashes[windows[lower] + k], windows[lower] + k
    chosen = np.unique(at)
    chosen = chosen[chosen + REACH <= (first + sizes)[owner[chosen]]]
    spans = np.full(len(chosen), REACH, dtype=np.uint64)
    for k in range(REACH):
        spans = mix(spans + hashes[chosen + k])
    return owner[chosen], chosen - first[owner[chosen]], spans.view(np.int64)


def covered_parts(sizes: list[int], starts: list[int], run: int, least: int) -> list[int]:
    """Parts that repeated spans hold: all of a span of parts, and those of which word spans hold every word."""
    gone = set()
    ends = span_ends(sizes, run, least)
    for s in starts:
        if s >= 0:
            gone.update(range(s, ends[s]))
    firsts = np.array([-1 - s for s in starts if s < 0], dtype=np.int64)
    if len(firsts):
        upto = np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype=np.int64))])
        change = np.zeros(upto[-1] + 1, dtype=np.int64)
        np.add.at(change, firsts, 1)
        np.add.at(change, firsts + REACH, -1)
        held = np.concatenate([[0], np.cumsum(np.cumsum(change)[:-1] > 0)])
        words = np.diff(upto)
        gone.update(np.flatnonzero((words > 0) & (held[upto[1:]] - held[upto[:-1]] == words)).tolist())
    return sorted(gone)


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, run: int, least: int) -> DataFrame:
    """(id, text_key, starts): for each text the starts of its spans that occur earlier, in an earlier row by id (null last)
    or earlier in the same text. A start is a part's number, or -1 - n for the word span that starts at word n."""
    schema = StructType([StructField("id", docs.schema[id_col].dataType), StructField("text_key", LongType()),
                         StructField("start", ArrayType(IntegerType())), StructField("span", ArrayType(LongType()))])

    def cut(batches):
        for whole in batches:
            for a, b in slices(whole.column(2)):
                batch = whole.slice(a, b - a)
                starts, spans, words = [], [], []
                for text in batch.column(2):
                    parts = [p.split() for p in sentences(text.as_py() or "")]
                    firsts, hashes = span_hashes(parts, run, least)
                    starts.append(np.array(firsts, dtype=np.int32))
                    spans.append(np.array(hashes, dtype=np.int64))
                    words.append([w for p in parts for w in p])
                owner, first, more = word_spans(words)
                cuts = np.searchsorted(owner, np.arange(b - a + 1))
                starts = [np.concatenate([s, (-1 - first[i:j]).astype(np.int32)]) for s, i, j in zip(starts, cuts, cuts[1:])]
                spans = [np.concatenate([s, more[i:j]]) for s, i, j in zip(spans, cuts, cuts[1:])]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in starts])]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (starts, spans)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=[f.name for f in schema.fields])

    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    drawn = materialize(texts.mapInArrow(cut, schema))
    spans = drawn.select("id", "text_key", F.explode(F.arrays_zip("start", "span")).alias("s")).select("id", "text_key", "s.start", "s.span")
    often = spans.groupBy("span").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("span")
    again = materialize(spans.join(often, "span", "left_semi"))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "text_key", "start")
    first = again.groupBy("span").agg(F.min(place).alias("first"))
    later = again.join(first, "span").filter(place != F.col("first"))
    return later.groupBy("id", "text_key").agg(F.array_sort(F.collect_set("start")).alias("starts"))


def without_repeats(docs: DataFrame, run: int = RUN, least: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut from the text, and n_sentences, n_removed and removed (sentence numbers).

    From every sentence, a run of ``run`` sentences, or as many more as ``least`` words take, is hashed and joined over the
    whole corpus; a sentence goes if any run that covers it occurred before. A sentence of more than LONGEST words counts as
    several. So that no repeated passage of SURE words stays whole because its sentences begin or end elsewhere, runs of REACH
    words from words chosen by content are joined too; a sentence goes if such runs hold all of its words. What
    stays of a text is kept as it was. Null texts stay null, empty ones empty, without sentences. Rows alike in id and text
    are one document and are cut alike. Null ids come last. An empty table gives no rows; columns named like the added ones
    are replaced.

    A passage's hashes are counted before they are shuffled, so one that a third of all documents hold is no burden; of the
    texts, those with something to cut are met by their key, one row each.
    """
    added = ("n_sentences", "n_removed", "removed")
    base = docs.drop(*[c for c in added if c not in (id_col, text_col)])
    later = materialize(repeated_spans(docs, id_col, text_col, run, least).select(F.col("id").alias("_id"), F.col("text_key").alias("_key"), F.col("starts").alias("_starts")))
    keyed = base.withColumn("_text_key", F.xxhash64(F.col(text_col)))
    joined = keyed.join(later, keyed[id_col].eqNullSafe(later["_id"]) & (F.col("_text_key") == F.col("_key")), "left").select(*base.columns, "_starts")
    place = base.columns.index(text_col)
    fields = [StructField(f.name, StringType()) if f.name == text_col else f for f in base.schema.fields]
    schema = StructType([*fields, StructField("n_sentences", IntegerType()), StructField("n_removed", IntegerType()), StructField("removed", ArrayType(IntegerType()))])

    def rebuild(batches):
        for batch in batches:
            texts, total, gone = [], [], []
            for text, starts in zip(batch.column(place), batch.column(batch.num_columns - 1)):
                text, parts = text.as_py(), sentences(text.as_py() or "")
                starts = starts.as_py()
                drop = covered_parts([len(p.split()) for p in parts], starts, run, least) if starts else []
                if drop:
                    out = set(drop)
                    text = "".join(p for i, p in enumerate(parts) if i not in out)
                texts.append(text)
                total.append(len(parts))
                gone.append(drop)
            columns = [pa.array(texts, pa.string()) if i == place else batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.array(total, pa.int32()), pa.array([len(g) for g in gone], pa.int32()), pa.array(gone, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return joined.mapInArrow(rebuild, schema)
