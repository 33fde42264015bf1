"""Phrase collocations: shards mined completely at lowered support, then the union of their phrases counted exactly."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sliceweave.llm.common import KeyFilter, bytes_of, hash_of_bytes, mix, runs_of, slices
from sliceweave.session import materialize

#: Words of a phrase at most, and occurrences of a phrase at least.
LONGEST, SUPPORT = 5, 100
#: Words of a shard, about; a task holds no more than one and a half times as many at once.
SHARD_WORDS = 8_000_000
#: Languages of more shards than this have a first shard: what it finds is a candidate, and no other shard tells it again.
FIRST_FROM = 8
#: Words whose phrases are put together at once.
AT_ONCE = 1 << 20
#: Bytes of text whose candidates a task counts together.
PART_BYTES = 8 << 20
#: Phrases whose counts a task holds before it tells them.
HELD = 1 << 19
#: Parts of one word are met in so many groups.
SALTS = 16
#: A table with a row for each of so many languages is broadcast.
FEW_LANGUAGES = 10_000

# bytes of words, of breaks between pieces, and of white space within a piece; A-Z are lower-cased
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)
_KIND = np.array([0 if b in _BREAKS or b in b" \t" else 1 for b in range(256)], dtype=np.int8)
_IS_BREAK = np.array([b in _BREAKS for b in range(256)])
#: Java class of a word in a lower-cased or other text.
WORD = r"[^\x20\x09.,;:!?\x0A-\x0D]+"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Words of some texts in turn: hashes that also tell the language, language numbers, and whether a word goes on the
    piece of the one before it. ``spelt`` gives the words of given places."""

    def __init__(self, texts: pa.Array, langs: np.ndarray, salts: np.ndarray):
        data, ends = bytes_of(texts)
        data = _FOLD[data]
        coded, starts, counts = runs_of(data, ends, _KIND[data])
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = coded.dictionary.to_pylist()
        self.lang = np.repeat(langs, counts)
        hashes = hash_of_bytes(self.words)
        self.hash = mix(hashes[self.codes] ^ salts[self.lang]) if len(self.codes) else np.zeros(0, dtype=np.uint64)
        breaks = np.cumsum(_IS_BREAK[data])[starts] if len(starts) else np.zeros(0, dtype=np.int64)
        self.joined = np.zeros(len(starts), dtype=bool)
        self.joined[1:] = breaks[1:] == breaks[:-1]
        firsts = np.cumsum(counts) - counts
        self.joined[firsts[counts > 0]] = False

    def spelt(self, place: int, size: int) -> str:
        return b" ".join([self.words[c] for c in self.codes[place:place + size]]).decode("utf-8")


def grow(hashes: np.ndarray, joined: np.ndarray, longest: int, thin) -> None:
    """Level by level: ``thin(size, keys, alive)`` leaves those places alive whose phrases of ``size`` words go on. A longer
    phrase is looked at only where the phrases of one word less at its place and the next one are alive."""
    keys, alive = hashes.copy(), np.ones(len(hashes), dtype=bool)
    for size in range(1, longest + 1):
        if size > 1:
            alive[:-1] &= alive[1:]
            alive[-1:] = False
            if size == 2:
                alive[:-1] &= joined[1:]
            for a in range(0, len(keys), AT_ONCE):
                at = np.flatnonzero(alive[a:a + AT_ONCE]) + a
                with np.errstate(over="ignore"):
                    keys[at] = mix(keys[at] * _FACTOR + hashes[at + size - 1])
        thin(size, keys, alive)


def mine(hashes: np.ndarray, joined: np.ndarray, lang: np.ndarray, least: np.ndarray, longest: int):
    """All phrases that occur at least ``least[language]`` times, in parts: (language numbers, keys, counts)."""
    out = []

    def thin(_, keys, alive):
        # places whose keys begin alike are counted together, a part of all at a time
        part = np.empty(len(keys), dtype=np.uint8)
        for a in range(0, len(keys), AT_ONCE):
            part[a:a + AT_ONCE] = keys[a:a + AT_ONCE] >> np.uint64(60)
        for p in range(16):
            at = np.flatnonzero(alive & (part == p))
            if not len(at):
                continue
            ranked = keys[at]
            order = np.argsort(ranked)
            ranked, at = ranked[order], at[order]
            edge = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
            counts = np.diff(np.append(edge, len(ranked)))
            langs = lang[at[edge]]
            good = counts >= least[langs]
            alive[at] = np.repeat(good, counts)
            out.append((langs[good], ranked[edge[good]], counts[good]))

    grow(hashes, joined, longest, thin)
    return out


class Shard:
    """Words of the texts seen so far, in room for ``size`` of them or a few more."""

    def __init__(self, size: int):
        self.hash, self.joined, self.lang = np.empty(size, dtype=np.uint64), np.empty(size, dtype=bool), np.empty(size, dtype=np.int32)
        self.used = 0

    def add(self, words: Words) -> None:
        stop = self.used + len(words.hash)
        if stop > len(self.hash):
            for name in ("hash", "joined", "lang"):
                have = getattr(self, name)
                more = np.empty(stop + len(have) // 4, dtype=have.dtype)
                more[:self.used] = have[:self.used]
                setattr(self, name, more)
        for name in ("hash", "joined", "lang"):
            getattr(self, name)[self.used:stop] = getattr(words, name)
        self.used = stop

    def content(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.hash[:self.used], self.joined[:self.used], self.lang[:self.used]


def language_of(lang: Column) -> Column:
    return F.coalesce(lang.cast("string"), F.lit("und"))


def language_salts(names: list[str]) -> np.ndarray:
    """A number per language, mixed once more than words are: a word may be a language's name, and their hashes must not cancel out."""
    return mix(hash_of_bytes([n.encode("utf-8", "surrogatepass") for n in names]) ^ _FACTOR) if names else np.zeros(0, dtype=np.uint64)


def shard_candidates(texts: DataFrame, totals: dict[str, int], longest: int, support: float, known: KeyFilter | None = None) -> DataFrame:
    """(lang, key, excess): what each shard finds at its own support, by how much its count exceeds what an unfound phrase
    may have there; and rows without key, that most itself. A shard's support is to ``support`` as its words to all. What
    ``known`` holds is a candidate already and is not told again."""
    names = sorted(totals)
    number = {n: i for i, n in enumerate(names)}
    salts = language_salts(names)
    all_words = np.array([totals[n] for n in names], dtype=np.int64)
    sent = texts.sparkSession.sparkContext.broadcast(known)  # of bounded size

    def run(batches):
        held, told = Shard(SHARD_WORDS), sent.value

        def mined():
            hashes, joined, lang = held.content()
            words = np.bincount(lang, minlength=len(names))
            least = np.array([max(1, math.ceil(Fraction(support) * int(w) / max(int(n), 1))) for w, n in zip(words, all_words)], dtype=np.int64)
            present = np.flatnonzero(words)
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in present], pa.string()), pa.array([None] * len(present), pa.int64()), pa.array(least[present] - 1)],
                                             names=["lang", "key", "excess"])
            spelt = pa.array(names, pa.string())
            for langs, keys, counts in mine(hashes, joined, lang, least, longest):
                if told is not None:
                    new = ~told(keys)
                    langs, keys, counts = langs[new], keys[new], counts[new]
                for a in range(0, len(keys), 100_000):
                    part = slice(a, a + 100_000)
                    yield pa.RecordBatch.from_arrays([spelt.take(pa.array(langs[part].astype(np.int64))), pa.array(keys[part].view(np.int64)), pa.array(counts[part] - least[langs[part]] + 1)],
                                                     names=["lang", "key", "excess"])

        for batch in batches:
            lang = np.fromiter((number[x] for x in batch.column(0).to_pylist()), dtype=np.int32, count=batch.num_rows)
            for a, b in slices(batch.column(1)):
                w = Words(batch.column(1).slice(a, b - a), lang[a:b], salts)
                held.add(w)
                if held.used >= SHARD_WORDS * 3 // 2:
                    yield from mined()
                    held.used = 0
        if held.used:
            yield from mined()

    return texts.mapInArrow(run, "lang string, key long, excess long")


def a_row_per_language(df: DataFrame, languages: int) -> DataFrame:
    """``df``, to be sent to all tasks if that is known to be little."""
    return F.broadcast(df) if languages <= FEW_LANGUAGES else df


def possible(found: DataFrame, support: int, languages: int) -> DataFrame:
    """(lang, key): the phrases that shards found and that may reach ``support``. A shard that didn't find one has less of it
    than its own support, so a phrase reaches at most its excesses on top of what all shards may leave unfound."""
    unfound = found.filter("key is null").groupBy("lang").agg(F.sum("excess").alias("most"))
    union = found.filter("key is not null").groupBy("lang", "key").agg(F.sum("excess").alias("excess"))
    return union.join(a_row_per_language(unfound, languages), "lang").filter(F.col("excess") + F.col("most") >= support).select("lang", "key")


class Tally:
    """Counts of phrases of one size over the parts of a task, by their hashes; each is spelt once."""

    def __init__(self):
        self.keys, self.counts, self.place = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.phrases, self.langs = [], []

    def add(self, words: Words, size: int, at: np.ndarray, keys: np.ndarray) -> None:
        keys, first, counts = np.unique(keys, return_index=True, return_counts=True)
        where = np.searchsorted(self.keys, keys)
        old = where < len(self.keys)
        old[old] = self.keys[where[old]] == keys[old]
        self.counts[where[old]] += counts[old]
        new = at[first[~old]]
        self.phrases.append(pa.array([words.spelt(i, size) for i in new.tolist()], pa.string()))
        self.langs.append(words.lang[new])
        places = len(self.place) + np.arange(len(new))
        where = where[~old]
        self.keys, self.counts, self.place = (np.insert(have, where, more) for have, more in ((self.keys, keys[~old]), (self.counts, counts[~old]), (self.place, places)))

    def told(self, size: int, names: pa.Array):
        phrases, langs = pa.chunked_array(self.phrases, pa.string()), np.concatenate([np.zeros(0, dtype=np.int64), *self.langs])
        counts = np.empty_like(self.counts)
        counts[self.place] = self.counts
        for a in range(0, len(counts), 50_000):
            n = min(50_000, len(counts) - a)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(langs[a:a + n].astype(np.int64))), phrases.slice(a, n).combine_chunks(), pa.array(np.full(n, size, dtype=np.int32)),
                                              pa.array(counts[a:a + n])], names=["lang", "phrase", "size", "n"])


def exact_counts(texts: DataFrame, candidates: KeyFilter, languages: list[str], longest: int, support: int) -> DataFrame:
    """(lang, phrase, size, n) of all phrases that pass the filter and occur ``support`` times or more, counted by their text."""
    number = {n: i for i, n in enumerate(languages)}
    salts = language_salts(languages)
    sent = texts.sparkSession.sparkContext.broadcast(candidates)  # of bounded size

    def run(batches):
        test, names = sent.value, pa.array(languages, pa.string())
        held: dict[int, Tally] = {}

        def told():
            for size in sorted(held):
                yield from held.pop(size).told(size, names)

        for batch in batches:
            lang = np.fromiter((number[x] for x in batch.column(0).to_pylist()), dtype=np.int32, count=batch.num_rows)
            for a, b in slices(batch.column(1), PART_BYTES):
                w = Words(batch.column(1).slice(a, b - a), lang[a:b], salts)

                def thin(size, keys, alive):
                    at = np.flatnonzero(alive)
                    keep = test(keys[at])
                    alive[at[~keep]] = False
                    held.setdefault(size, Tally()).add(w, size, at[keep], keys[at[keep]])

                grow(w.hash, w.joined, longest, thin)
                if sum(len(t.keys) for t in held.values()) > HELD:
                    yield from told()
        yield from told()

    local = texts.mapInArrow(run, "lang string, phrase string, size int, n long")
    return local.groupBy("lang", "phrase").agg(F.first("size").alias("size"), F.sum("n").alias("n")).filter(F.col("n") >= support)


def by_language(texts: DataFrame, parts: int) -> DataFrame:
    """``texts`` in about so many parts of one size, each of few languages: so a phrase is told by the parts of its own language
    alone, and a shard's support is near the whole one."""
    return texts.withColumn("_at", F.rand(7)).repartitionByRange(parts, "lang", "_at").drop("_at") if parts > 1 else texts


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, support: int = SUPPORT, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Stored tables: (lang, phrase, size, n) of all phrases of 1 to ``longest`` words with ``support`` or more occurrences, and
    (lang, n) of all words, to be broadcast if languages are few."""
    texts = docs.select(language_of(F.col(lang_col)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = materialize(texts.groupBy("lang").agg(F.sum(F.regexp_count("text", F.lit(WORD))).cast("long").alias("n")))
    totals = {r["lang"]: r["n"] for r in words.collect()}
    shards = max(-(-sum(totals.values()) // SHARD_WORDS), 1)
    dealt = by_language(texts, shards)
    large = {lang: n for lang, n in totals.items() if n > FIRST_FROM * SHARD_WORDS}
    known = None
    if large:
        # a share of the rows, about as large as a shard, tells the common phrases once, so that not every shard has to
        first = texts.filter(F.col("lang").isin(list(large))).filter(F.rand(5) < SHARD_WORDS / sum(large.values())).repartition(1)
        known = materialize(shard_candidates(first, totals, longest, support).filter("key is not null").select("key"))
    found = materialize(shard_candidates(dealt if shards > 1 else texts.coalesce(1), totals, longest, support, None if known is None else KeyFilter.of(known, "key")))
    keys = possible(found, support, len(totals)).select("key")
    keys = materialize(keys if known is None else keys.unionByName(known))
    counted = exact_counts(dealt, KeyFilter.of(keys, "key"), sorted(totals), longest, support)
    return materialize(counted), a_row_per_language(words, len(totals))


def collocations(docs: DataFrame, longest: int = LONGEST, support: int = SUPPORT, cover: int = 100, top: int | None = 2000, text_col: str = "text",
                 lang_col: str = "lang") -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): phrases of 2 to ``longest`` words by how much more often they occur than
    their parts would by chance.

    Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and tabs.
    Everything counts within a language; a null one is ``und``. a is the phrase's occurrences, within pieces and overlaps
    included, n all words. Of the phrase's cuts in two parts with l and r occurrences, the one with the lowest floored
    1000 a n / (l r) counts, ties to the shortest first part. A phrase is left out if a longer one that holds it occurs in
    ``cover`` percent of its places or more. The first ``top`` of a language (None: all) are ranked by score, a and phrase.

    Null and empty texts have no words, long ones are taken whole, repeated rows count each, ids and other columns are not
    read, an empty table gives no rows. Scores are exact up to 10^15 occurrences of a phrase and 10^17 words.

    Shards are mined by 64-bit hashes, which can only add candidates. The exact count adds up by these hashes within a task, so
    two phrases of a task that share one would be counted as one; between tasks it goes by the phrases' texts.
    """
    frequent, words = frequent_phrases(docs, longest, support, text_col, lang_col)
    parts = F.split("phrase", " ")
    pairs = frequent.filter("size > 1").withColumn("words", parts)
    join = lambda first, many: F.array_join(F.slice("words", first, many), " ")
    cuts = pairs.select("lang", "phrase", "size", F.col("n").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    salt = lambda size: F.when(size == 1, F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).otherwise(0).cast("int")
    cuts = cuts.select("lang", "phrase", "a", "k", join(F.lit(1), F.col("k")).alias("first"), salt(F.col("k")).alias("first_salt"),
                       join(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"), salt(F.col("size") - F.col("k")).alias("rest_salt"))
    spread = F.when(F.col("size") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    known = materialize(frequent.select("lang", F.col("phrase").alias("part"), F.explode(spread).alias("salt"), "n"))
    left = known.select("lang", F.col("part").alias("first"), F.col("salt").alias("first_salt"), F.col("n").alias("l"))
    right = known.select("lang", F.col("part").alias("rest"), F.col("salt").alias("rest_salt"), F.col("n").alias("r"))
    met = cuts.join(left, ["lang", "first", "first_salt"]).join(right, ["lang", "rest", "rest_salt"]).join(words, "lang")
    exact = "cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(17,0)) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"
    met = met.withColumn("score", F.expr(exact).cast("long"))
    lowest = met.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut"))
    # what covers a phrase also covers it by the phrases of one word more in between
    longer = pairs.filter("size > 2").select("lang", "n", F.explode(F.array(join(F.lit(1), F.col("size") - 1), join(F.lit(2), F.col("size") - 1))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    left_over = lowest.join(longer, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < cover * F.col("cut.a")))
    flat = left_over.select("lang", "phrase", *[F.col(f"cut.{c}").alias(c) for c in ("a", "l", "r", "n", "score")])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    ranked = flat.withColumn("rank", rank)
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
