"""Importance resampling towards a target distribution, over hashed n-grams whose CRCs come from running prefix CRCs."""

from __future__ import annotations

import math
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from sliceweave.llm.common import bytes_of, slices
from sliceweave.operators.position import with_position
from sliceweave.session import materialize

#: Places of the histograms, words of a feature at most, percent of the documents drawn, words a drawn document has at least.
BUCKETS, LONGEST, PERCENT, LEAST_WORDS, SEED = 10_000, 2, 25, 20, 7
#: Words whose prefix CRCs a task unfolds at once.
PART_WORDS = 1 << 18

# bytes of words stay, A-Z are lower-cased, all others part words
_WORD = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD else 0x20 for b in range(256))


# ------------------------------------------------------------------------------------------ CRCs of substrings

def _one_byte(crc: np.ndarray) -> np.ndarray:
    """The register after a zero byte, a linear map over GF(2)."""
    low, rest = crc & np.uint32(0xFF), crc >> np.uint32(8)
    for _ in range(8):
        low = np.where(low & np.uint32(1), (low >> np.uint32(1)) ^ np.uint32(0xEDB88320), low >> np.uint32(1))
    return low ^ rest


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map, given as its values for each of the four bytes."""
    out = tables[0][crc & np.uint32(0xFF)]
    for i in (1, 2, 3):
        out = out ^ tables[i][(crc >> np.uint32(8 * i)) & np.uint32(0xFF)]
    return out


def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """The maps for 0 to 255 zero bytes, and those for 256, 512, 1024 ... of them."""
    low = [np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])]
    for _ in range(256):
        low.append(_one_byte(low[-1]))
    high = [low.pop()]
    for _ in range(31):
        high.append(_apply(high[-1], high[-1]))
    return np.stack(low), high


_LOW, _HIGH = _shift_tables()
_FLAT = _LOW.reshape(-1)


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC registers after so many zero bytes each."""
    at = (length & 255) << 10
    out = _FLAT[at + (crc & np.uint32(0xFF))]
    for i in (1, 2, 3):
        out = out ^ _FLAT[at + (i << 8) + ((crc >> np.uint32(8 * i)) & np.uint32(0xFF))]
    more = length >> 8
    for tables in _HIGH:
        if not more.any():
            break
        odd = np.flatnonzero(more & 1)
        out[odd] = _apply(tables, out[odd])
        more = more >> 1
    return out


def running_crcs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One scan of every normalised text, in which a space leads each word: the CRC up to the end of each word, the words'
    sizes in bytes, and how many words each text has."""
    data, ends = bytes_of(texts)
    normal = data.tobytes().translate(_FOLD)
    crc32, crcs, sizes, counts, start = zlib.crc32, [], [], [], 0

    def on(crc: int, word: bytes) -> int:
        return crc32(word, crc32(b" ", crc))

    for end in ends.tolist():
        words = normal[start:end].split()
        start = end
        counts.append(len(words))
        if words:
            crcs.append(np.fromiter(accumulate(words, on, initial=0), dtype=np.uint32, count=len(words) + 1)[1:])
            sizes.append(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
    return (np.concatenate(crcs or [np.zeros(0, dtype=np.uint32)]), np.concatenate(sizes or [np.zeros(0, dtype=np.int64)]),
            np.array(counts, dtype=np.int64))


def gram_crcs(crcs: np.ndarray, sizes: np.ndarray, counts: np.ndarray, longest: int):
    """For 1, 2 ... ``longest`` words: text numbers and CRCs of all runs of so many words, from two prefix CRCs each.

    A prefix up to where the run ends is the one before it, shifted by the run's length, plus the run: the shifted one cancels.
    """
    ends = np.cumsum(counts)
    first = np.zeros(len(crcs), dtype=bool)
    first[(ends - counts)[counts > 0]] = True
    before = np.concatenate([np.zeros(1, dtype=np.uint32), crcs[:-1]])[:len(crcs)]
    before[first] = 0
    # the space that leads a run belongs to the prefix
    state = before ^ np.uint32(0xFFFFFFFF)
    before = _one_byte(state ^ np.uint32(0x20)) ^ np.uint32(0xFFFFFFFF)
    stop = np.cumsum(sizes + 1)
    start = stop - sizes
    row = np.repeat(np.arange(len(counts)), counts)
    for n in range(1, longest + 1):
        ok = np.flatnonzero(row[:len(row) - n + 1] == row[n - 1:]) if len(row) >= n else np.zeros(0, dtype=np.int64)
        last = ok + n - 1
        yield row[ok], crcs[last] ^ shifted(before[ok], stop[last] - start[ok])


def prefix_table(docs: DataFrame, key: Column, text: Column) -> DataFrame:
    """(id, words, crcs, sizes, long_sizes), stored: the only scan of the texts. Sizes take a byte; 255 stands for the next
    of ``long_sizes``."""
    source = docs.select(key.alias("id"), text.alias("text"))
    schema = StructType([source.schema["id"], StructField("words", LongType()), *[StructField(c, BinaryType()) for c in ("crcs", "sizes", "long_sizes")]])

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1)):
                crcs, sizes, counts = running_crcs(batch.column(1).slice(a, b - a))
                ends = np.cumsum(counts)
                crcs, short = crcs.astype("<u4"), np.minimum(sizes, 255).astype(np.uint8)
                out = ([], [], [])
                for s, e in zip((ends - counts).tolist(), ends.tolist()):
                    out[0].append(crcs[s:e].tobytes())
                    out[1].append(short[s:e].tobytes())
                    out[2].append(sizes[s:e][sizes[s:e] >= 255].astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts), *[pa.array(x, pa.binary()) for x in out]], names=[f.name for f in schema.fields])

    return materialize(source.mapInArrow(run, schema))


def _unfolded(batch: pa.RecordBatch):
    """Row ranges of a stored batch with their CRCs, sizes and counts, PART_WORDS words or one row at a time."""
    counts, start = batch.column("words").to_numpy(), 0
    while start < len(counts):
        held = np.cumsum(counts[start:])
        stop = start + max(1, int(np.searchsorted(held, PART_WORDS, side="right")))
        part = batch.slice(start, stop - start)
        join = lambda c, kind: np.frombuffer(b"".join(part.column(c).to_pylist()), dtype=kind)
        sizes = join("sizes", np.uint8).astype(np.int64)
        sizes[sizes == 255] = join("long_sizes", "<u4")
        yield start, stop, join("crcs", "<u4").astype(np.uint32), sizes, counts[start:stop]
        start = stop


def histogram(prefixes: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """Features in each bucket. Tasks add up their own; ``buckets`` rows reach the driver."""
    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, crcs, sizes, counts in _unfolded(batch):
                for _, grams in gram_crcs(crcs, sizes, counts, longest):
                    total += np.bincount(grams % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in prefixes.select("words", "crcs", "sizes", "long_sizes").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature in each bucket adds: the log ratio of the smoothed target and raw shares, in floored thousandths."""
    s_all, t_all, size = float(raw.sum()), float(target.sum()), float(len(raw))
    return np.array([math.floor(1000.0 * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size)))) for s, t in zip(raw.tolist(), target.tolist())], dtype=np.int64)


def gumbel(id_col: Column, seed: int) -> Column:
    """Floored thousandths of a Gumbel variate that the id determines; a null id is the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def importance(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, percent: int = PERCENT, least_words: int = LEAST_WORDS,
               seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """Rows (id, words, n_features, weight, score, rank) for every row of ``docs``.

    Features are all runs of 1 to ``longest`` words. weight is the floored mean of their gains, 0 without features; score
    adds the Gumbel variate of the id, so the highest scores are a sample without replacement in proportion to
    importance. rank is 1, 2, 3 ... for the drawn ones: ``percent`` of the documents of ``least_words`` words or more, ties
    to the smaller id, null for all others.

    Null and empty texts, and those without words, have no features and are never drawn; long ones are taken whole. A null
    id comes last among ties. Rows alike in id and text have one score and are drawn one by one. An empty table gives no
    rows, an empty target the smoothed gains. Other columns are not read.

    Texts are scanned once, for their running CRCs; histogram and weights unfold those. Only two histograms reach the
    driver, and ranks come from narrow rows in range partitions.
    """
    prefixes = prefix_table(docs, F.col(id_col), F.col(text_col))
    of_target = prefix_table(target, F.lit(0), F.col(target_text_col))
    table = gains(histogram(prefixes, buckets, longest), histogram(of_target, buckets, longest))
    sent = docs.sparkSession.sparkContext.broadcast(table)  # of ``buckets`` numbers
    schema = StructType([StructField("id", docs.schema[id_col].dataType), *[StructField(c, LongType()) for c in ("words", "n_features", "weight")]])

    def run(batches):
        gain = sent.value
        for batch in batches:
            for a, b, crcs, sizes, counts in _unfolded(batch):
                total, features = np.zeros(b - a, dtype=np.int64), np.zeros(b - a, dtype=np.int64)
                for row, grams in gram_crcs(crcs, sizes, counts, longest):
                    each = np.bincount(row, minlength=b - a)
                    running = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(gain[grams % np.uint32(len(gain))])])
                    ends = np.cumsum(each)
                    total += running[ends] - running[ends - each]
                    features += each
                weight = np.where(features > 0, total // np.maximum(features, 1), 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts), pa.array(features), pa.array(weight)], names=[f.name for f in schema.fields])

    scored = prefixes.mapInArrow(run, schema).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))
    late = F.col("words") < least_words
    placed = materialize(scored.withColumns({"late": late, "falling": -F.col("score"), "no_id": F.col("id").isNull()}))
    drawn = percent * placed.filter("not late").count() // 100
    placed = with_position(placed, ["late", "falling", "no_id", "id"], "pos")
    rank = F.when(F.col("pos") < drawn, F.col("pos") + 1).cast("long")
    return placed.select(F.col("id").alias(id_col), "words", "n_features", "weight", "score", rank.alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns. Rows of one id are drawn together if one of them is."""
    drawn = materialize(importance(docs, target, id_col=id_col, **options).filter("rank is not null").select(F.col(id_col).alias("drawn")).distinct())
    # the join's own column is gone in a semi join, so names cannot clash
    return docs.join(drawn, docs[id_col].eqNullSafe(drawn["drawn"]), "left_semi")
