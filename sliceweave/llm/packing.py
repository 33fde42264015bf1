"""Best-fit packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import functools
import os
import zlib
from collections import defaultdict
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from sliceweave.llm.common import bytes_of, hashes_of, runs_of, slices
from sliceweave.session import materialize

#: Words whose ids a task remembers, some 35 bytes each; beyond that it forgets the half not used for longest.
KNOWN_WORDS = 600_000
#: Numbers by task and length that are sent to all tasks (16 MB); more are joined.
SENT_LIFTS = 1_000_000


# white space parts words; A-Z are lower-cased if the tokenizer does so
_KIND = np.array([0 if b == 0x20 or 9 <= b <= 13 else 1 for b in range(256)], dtype=np.int8)
_FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


class WordIds:
    """Ids of words under a tokenizer that never joins text over white space. Words are known by 64-bit hashes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.kind = id_kind(path)
        self.tails: dict[str, list[int]] = {"": []}
        same = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.folds = same("QWERTZ Abc") == same("qwertz abc")
        # a tokenizer that works otherwise sends every word down the plain road
        self.simple = self.folds and all(same(a + b) == self._model(a) + same(b) for a in ("thing", "größe", "añ") for b in ("", ".", ",,"))
        self.clear()

    def clear(self) -> None:
        """An empty table: hashes of words in order, and for each where its ids begin, how many there are, and its last use."""
        self.keys = np.zeros(0, dtype=np.uint64)
        self.starts, self.sizes, self.last = (np.zeros(0, dtype=np.int32) for _ in range(3))
        self.ids, self.turn = np.zeros(0, dtype=self.kind), 0

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes in the table, and whether they are there."""
        if not len(self.keys) or not len(hashes):
            return np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=bool)
        # in order, so that the search goes through the table once
        order, at = np.argsort(hashes), np.empty(len(hashes), dtype=np.int64)
        at[order] = np.searchsorted(self.keys, hashes[order])
        at = np.minimum(at, len(self.keys) - 1)
        return at, self.keys[at] == hashes

    def _keep(self, places: np.ndarray) -> None:
        starts, sizes = self.starts[places].astype(np.int64), self.sizes[places]
        stops = np.cumsum(sizes, dtype=np.int64)
        self.ids = self.ids[np.arange(int(stops[-1]) if len(stops) else 0) + np.repeat(starts - (stops - sizes), sizes)]
        self.keys, self.sizes, self.last, self.starts = self.keys[places], sizes, self.last[places], (stops - sizes).astype(np.int32)

    def _learn(self, words: list[str], hashes: np.ndarray) -> None:
        if len(self.keys) + len(words) > KNOWN_WORDS:
            # the half that was used last stays, and all that is in use
            many = max(KNOWN_WORDS // 2, int((self.last == self.turn).sum()))
            self._keep(np.sort(np.argsort(-self.last, kind="stable")[:many]))
        lists = self.words(words)
        sizes = np.fromiter(map(len, lists), dtype=np.int32, count=len(lists))
        flat = np.fromiter((i for ids in lists for i in ids), dtype=self.kind, count=int(sizes.sum()))
        starts = (len(self.ids) + np.cumsum(sizes, dtype=np.int64) - sizes).astype(np.int32)
        order = np.argsort(hashes)
        at = np.searchsorted(self.keys, hashes[order])
        self.keys = np.insert(self.keys, at, hashes[order])
        self.starts, self.sizes = np.insert(self.starts, at, starts[order]), np.insert(self.sizes, at, sizes[order])
        self.last = np.insert(self.last, at, self.turn)
        self.ids = np.concatenate([self.ids, flat])

    def _model(self, letters: str) -> list[int]:
        spelt = letters if letters.isascii() else self.bytes.pre_tokenize_str(letters)[0][0]
        return [t.id for t in self.tokenizer.model.tokenize(spelt)]

    def words(self, words: list[str]) -> list[list[int]]:
        """Ids of words. Lower-case letters with full stops or commas behind them, most of any text, skip the tokenizer's
        normaliser and splitter, which leave such letters as they are and part them from the marks."""
        cores = [w.rstrip(".,") for w in words]
        at, known = self._find(hashes_of(pa.array([c.encode("utf-8") for c in cores], pa.large_binary())))
        out = []
        for i, (word, core) in enumerate(zip(words, cores)):
            tail = word[len(core):]
            plain = self.simple and len(tail) <= 3 and core.isalpha() and core.islower() and (core.isascii() or core == core.lower() and is_normalized("NFC", core))
            if not plain:
                out.append(self.tokenizer.encode(word, add_special_tokens=False).ids)
                continue
            if tail and known[i]:
                ids = self.ids[self.starts[at[i]]:self.starts[at[i]] + self.sizes[at[i]]].tolist()
            else:
                ids = self._model(core)
            if tail not in self.tails:
                self.tails[tail] = self.tokenizer.encode(tail, add_special_tokens=False).ids
            out.append(ids + self.tails[tail])
        return out

    def numbers(self, words: pa.LargeBinaryArray) -> np.ndarray:
        """Places of the words in the table; unknown words are tokenised first."""
        hashes = hashes_of(words)
        self.turn += 1
        at, known = self._find(hashes)
        self.last[at[known]] = self.turn
        fresh = np.flatnonzero(~known)
        if len(fresh):
            self._learn(words.take(pa.array(fresh)).cast(pa.large_string()).to_pylist(), hashes[fresh])
            at, _ = self._find(hashes)
        return at

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, each closed by ``end_id``, and where each text's ids end."""
        data, text_ends = bytes_of(texts)
        data = _FOLD[data] if self.folds else data
        coded, _, counts = runs_of(data, text_ends, _KIND[data])
        places = self.numbers(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, dtype=np.int64)
        ends = np.cumsum(counts)
        places = np.insert(places, ends, -1)
        close = places < 0
        sizes = np.where(close, 1, self.sizes[places] if len(self.sizes) else 0).astype(np.int64)
        stops = np.cumsum(sizes)
        take = np.arange(int(stops[-1]) if len(stops) else 0) + np.repeat((self.starts[places] if len(self.starts) else places * 0) - (stops - sizes), sizes)
        last = stops[close] - 1
        take[last] = 0
        ids = self.ids[take].astype(np.uint32) if len(self.ids) else np.zeros(len(take), dtype=np.uint32)
        ids[last] = end_id
        return ids, last + 1


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def tokenizer_path(tokenizer: str) -> str:
    """A file's own path, or the name of one of the installed public tokenizers; found where the task runs."""
    if "/" in tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def id_kind(tokenizer: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer_path(tokenizer)).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def pieces(docs: DataFrame, tokenizer: str, max_tokens: int, end_id: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """A row per piece of at most ``max_tokens`` ids, numbered within its task and length; only longer documents are cut. Ids
    are stored in two bytes each if the vocabulary allows."""
    fields = [StructField(id_col, docs.schema[id_col].dataType), StructField("piece", IntegerType())]
    fields += [StructField(c, LongType()) for c in ("start", "length", "ids_crc32", "_part", "_nth")]
    fields += [StructField("ids", BinaryType())] * with_ids
    schema, kind = StructType(fields), id_kind(tokenizer)

    def cut(batches):
        from pyspark import TaskContext

        part, seen, encoder = TaskContext.get().partitionId(), defaultdict(int), word_ids(tokenizer_path(tokenizer))
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts):
                ids, ends = encoder.encode(texts.slice(a, b - a), end_id)
                ids = ids.astype("<u4")
                begins = np.concatenate([[0], ends[:-1]])
                per = -(-(ends - begins) // max_tokens)
                row = np.repeat(np.arange(b - a), per)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
                start = piece * max_tokens
                first = begins[row] + start
                length = np.minimum(ends[row] - first, max_tokens)
                crcs, nth = np.empty(len(row), dtype=np.int64), np.empty(len(row), dtype=np.int64)
                for i, (f, n) in enumerate(zip(first.tolist(), length.tolist())):
                    crcs[i] = zlib.crc32(ids[f:f + n])
                    nth[i] = seen[n]
                    seen[n] += 1
                columns = [keys.slice(a, b - a).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                           pa.array(length, pa.int64()), pa.array(crcs), pa.array(np.full(len(row), part, dtype=np.int64)), pa.array(nth)]
                if with_ids:
                    short = ids.astype(kind)
                    columns.append(pa.array([short[f:f + n].tobytes() for f, n in zip(first.tolist(), length.tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])
        encoder.clear()  # the worker goes on to other stages, which need the memory

    return docs.select(id_col, text_col).mapInArrow(cut, schema)


class CapacityTree:
    """Which remaining capacities have an open sequence: a binary tree of flags over 0 .. top."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.open = [False] * (2 * self.leaves)

    def set(self, capacity: int, value: bool) -> None:
        i = self.leaves + capacity
        self.open[i] = value
        while i > 1:
            i >>= 1
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest open capacity of at least ``need``, in logarithmic time."""
        i = self.leaves + need
        if self.open[i]:
            return need
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit_runs(lengths: dict[int, int], max_tokens: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counted lengths: (length, first, stop, first sequence, offset, pieces a sequence).

    Pieces of one length are alike, so the tree is asked once for a run of them: pieces ``first .. stop`` of that length go,
    so many to a sequence, to consecutive sequences that stand at the same offset. The outcome is that of placing piece by
    piece in order of falling length, since the sequence a piece went into stays the tightest for the next one if it has
    room. Work and runs are bounded by pairs of length and capacity, whatever the number of documents.
    """
    tree, held, fresh, runs = CapacityTree(max_tokens), defaultdict(list), 0, []

    def give(capacity: int, lo: int, hi: int) -> None:
        if hi > lo:
            held[capacity].append((lo, hi))
            tree.set(capacity, True)

    for size in sorted(lengths, reverse=True):
        done, count = 0, lengths[size]
        while done < count:
            capacity = tree.tightest(size)
            if capacity is None:
                more = -(-(count - done) // (max_tokens // size))
                give(max_tokens, fresh, fresh + more)
                fresh, capacity = fresh + more, max_tokens
            lo, hi = held[capacity].pop()
            tree.set(capacity, bool(held[capacity]))
            each = min(capacity // size, count - done)
            bins = min(hi - lo, (count - done) // each)
            runs.append((size, done, done + bins * each, lo, max_tokens - capacity, each))
            give(capacity - each * size, lo, lo + bins)
            give(capacity, lo + bins, hi)
            done += bins * each
    return runs


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", max_tokens: int = 2048, end_id: int = 0, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every document's ids, closed by ``end_id``, in as few sequences of ``max_tokens`` as best-fit decreasing finds.

    Returns a row per piece: the id column, piece, start, length, ids_crc32, sequence_id and offset, with ``with_ids`` also
    the ids. A null text is empty and is the end id alone; rows with a null or repeated id are packed like any other; an
    empty table gives no rows; other columns are not read.

    ``tokenizer`` must drop white space and never join text over it; then ids of words, looked up once, put
    together, are the ids of the text. Long texts are taken whole, in a task's own memory. Pieces are stored once and, unless tasks
    are very many, not shuffled. Only counts by length (at most ``max_tokens`` of them) reach
    the driver, where a segment tree over remaining capacities places runs of equal pieces; the placed runs, at most a few
    for each pair of length and capacity, go back to the tasks.
    """
    cut = materialize(pieces(docs, tokenizer, max_tokens, end_id, id_col, text_col, with_ids))
    by_task = cut.groupBy("length", "_part").agg(F.max("_nth").alias("_n"))
    before = F.sum(F.col("_n") + 1).over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    lifts = materialize(by_task.select("length", "_part", (F.col("_n") + 1).alias("_n"), F.coalesce(before, F.lit(0)).alias("_lift")))
    counts = lifts.groupBy("length").agg(F.sum("_n").alias("n")).collect()
    runs = np.array(sorted(best_fit_runs({r["length"]: r["n"] for r in counts}, max_tokens)), dtype=np.int64).reshape(-1, 6)
    keys = (runs[:, 0] << 44) + runs[:, 1]
    fields = [f for f in cut.schema.fields if not f.name.startswith("_") and f.name != "ids"]
    fields += [StructField("ids", ArrayType(IntegerType()))] * with_ids
    out = StructType([*fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    kind = id_kind(tokenizer)
    lifts = lifts.select("length", "_part", "_lift")
    few = lifts.count() <= SENT_LIFTS
    if few:
        table = lifts.orderBy("_part", "length").toPandas()
        order = (table["_part"].to_numpy(np.int64) << 32) + table["length"].to_numpy(np.int64)
        sent = docs.sparkSession.sparkContext.broadcast((order, table["_lift"].to_numpy(np.int64)))  # of SENT_LIFTS numbers at most

    def lift(batch: pa.RecordBatch) -> np.ndarray:
        if not few:
            return batch.column("_lift").to_numpy()
        order, values = sent.value
        return values[np.searchsorted(order, (batch.column("_part").to_numpy() << 32) + batch.column("length").to_numpy())]

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            nth = batch.column("_nth").to_numpy() + lift(batch)
            run = runs[np.searchsorted(keys, (length << 44) + nth, side="right") - 1].reshape(-1, 6)
            step = nth - run[:, 1]
            columns = [batch.column(f.name) for f in fields if f.name != "ids"]
            if with_ids:
                flat = np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype=kind).astype(np.int32)
                offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
            columns += [pa.array(run[:, 3] + step // run[:, 5]), pa.array(run[:, 4] + step % run[:, 5] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in out.fields])

    return (cut if few else cut.join(lifts, ["length", "_part"])).mapInArrow(place, out)
