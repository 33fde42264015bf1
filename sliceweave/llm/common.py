"""What several operators share: step tables, words of Arrow text, and 64-bit mixing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sliceweave.session import materialize, shared_folder

#: Java and Python class of the white space that parts words.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a task holds in its own arrays at once; a longer single text is a slice of its own.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def step_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's shared folder."""
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def discard(*tables: DataFrame) -> None:
    """Delete the files of step tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            if "/step-" in folder:
                path.getFileSystem(conf).delete(path, True)


def as_rows(docs: DataFrame) -> DataFrame:
    """``docs`` as one column ``row``, so that no name of theirs meets one of an operator's; ``row.*`` opens it again."""
    return docs.select(F.struct("*").alias("row"))


def field(name: str):
    return F.col("row").getField(name)


class KeyFilter:
    """A Bloom filter of bounded size over 64-bit keys, three bits a key: EACH bits for every key, and MOST (32 MB) in all. A
    fuller one lets more through, which an exact join or count behind it sorts out."""

    EACH, MOST = 16, 1 << 28
    #: Words of 64 bits that reach the driver as one row.
    BLOCK = 1 << 12

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(64 * len(bits) - 1)

    @staticmethod
    def places(keys: np.ndarray, mask: np.uint64) -> Iterator[np.ndarray]:
        yield keys & mask
        yield (keys >> np.uint64(21)) & mask
        yield mix(keys) & mask

    @classmethod
    def of(cls, keys: DataFrame, column: str) -> KeyFilter:
        """Bits are set in the tasks and put together there, first by words of 64, then in blocks of BLOCK words; the driver takes
        the blocks of one task after the other, MOST bits in all and no row for a word."""
        size, count = 1 << 16, keys.count()
        while size < min(cls.MOST, cls.EACH * count):
            size *= 2
        mask, many = np.uint64(size - 1), cls.BLOCK

        def run(frames):
            for frame in frames:
                k = frame[column].to_numpy().view(np.uint64)
                yield frame.__class__({"at": np.unique(np.concatenate(list(cls.places(k, mask)))).view(np.int64)})

        def blocks(batches):
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                word, bits = (batch.column(i).to_numpy() for i in (0, 1))
                order = np.argsort(word, kind="stable")
                word, bits = word[order], bits[order].view(np.uint64)
                starts = np.flatnonzero(np.diff(word // many, prepend=-1))
                for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(word)]):
                    block = held.setdefault(int(word[a]) // many, np.zeros(many, dtype=np.uint64))
                    block[word[a:b] % many] = bits[a:b]
            for at, block in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([block.tobytes()], pa.binary())], names=["block", "bits"])

        words = keys.select(column).mapInPandas(run, "at long").groupBy(F.shiftright("at", 6).alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
        parts = max(1, size // 64 // many // 32)  # of about 32 blocks, 1 MB
        bits = np.zeros(size // 64, dtype=np.uint64)
        for row in words.repartition(parts, F.floor(F.col("word") / many)).mapInArrow(blocks, "block long, bits binary").toLocalIterator():
            at = row["block"] * many
            bits[at:at + many] = np.frombuffer(row["bits"], dtype=np.uint64)[:len(bits) - at]
        return cls(bits)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        keep = np.ones(len(keys), dtype=bool)
        for at in self.places(keys, self.mask):
            keep &= (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return keep

    def column(self, spark: SparkSession, key):
        """Whether a column of keys may be among them."""
        sent = spark.sparkContext.broadcast(self)  # MOST bits at most

        @F.pandas_udf("boolean")
        def maybe(keys: pd.Series) -> pd.Series:
            return pd.Series(sent.value(keys.to_numpy().view(np.uint64)))

        return maybe(key)


def with_prefix_sums(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with running sums of ``value`` within ``keys`` along ``order``, the row's own value included.

    Rows are range-partitioned on keys and order, so a key with a third of all rows spreads over many tasks. Each task
    sums its own rows and is stored; a table of one row per task and key then lifts every task's sums.
    """
    from pyspark.sql import Window
    from pyspark.sql.types import LongType, StructField, StructType

    sort = [*keys, *order]
    ranged = df.repartitionByRange(*sort) if sort else df
    schema = StructType([*df.schema.fields, StructField("_part", LongType()), StructField("_local", LongType())])

    def running(batches):
        from pyspark import TaskContext

        part, last, total = TaskContext.get().partitionId(), None, 0
        for frame in batches:
            if not len(frame):
                continue
            values = frame[value].fillna(0).to_numpy(dtype=np.int64)
            sums = np.cumsum(values)
            if keys:
                key = frame[keys].astype(object).where(frame[keys].notna(), None)
                rows = list(map(tuple, key.to_numpy()))
                fresh = np.array([rows[0] != last, *(a != b for a, b in zip(rows[1:], rows[:-1]))])
                last, first = rows[-1], not fresh[0]
            else:
                fresh, first = np.zeros(len(frame), dtype=bool), True
            starts = np.flatnonzero(fresh)
            base = np.zeros(len(frame), dtype=np.int64)
            if len(starts):
                before = sums[starts] - values[starts]
                base[starts] = np.diff(before, prepend=0)
                base = np.cumsum(base)
            head = starts[0] if len(starts) else len(frame)
            sums = sums - base
            if first:
                sums[:head] += total
            total = int(sums[-1])
            frame["_part"], frame["_local"] = part, sums
            yield frame

    stored = materialize(ranged.sortWithinPartitions(*sort).mapInPandas(running, schema))
    ends = stored.groupBy("_part", *keys).agg(F.max("_local").alias("_end"))
    # one row per task and key; a key meets its own tasks only
    before = F.sum("_end").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    lifts = ends.select(F.col("_part").alias("_in"), *[F.col(k).alias(f"_of_{k}") for k in keys], F.coalesce(before, F.lit(0)).alias("_lift"))
    on = F.col("_part") == F.col("_in")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    joined = stored.join(lifts, on)
    return joined.select(*df.columns, (F.col("_local") + F.col("_lift")).alias(name))


# ------------------------------------------------------------------------------------- Arrow text

def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of ``texts`` of at most ``limit`` bytes, or one row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def words_of(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Word numbers of all rows in turn, words per row, and the distinct words; a null text has no words. ``lower`` folds A-Z."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = lists.offsets.to_numpy()
    flat = lists.flatten()
    full = pc.not_equal(pc.binary_length(flat), 0)
    keep = full.to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(keep)])
    counts = before[offsets[1:] - offsets[0]] - before[offsets[:-1] - offsets[0]]
    flat = flat.filter(full)
    coded = (pc.ascii_lower(flat) if lower else flat).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts.astype(np.int64), coded.dictionary.to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows in turn, and where each row ends; a null text has none."""
    whole = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(whole.buffers()[1], dtype=np.int64, count=len(whole) + 1, offset=8 * whole.offset) if len(whole) else np.zeros(1, dtype=np.int64)
    raw = whole.buffers()[2] if len(whole) else None
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0]:offsets[-1]] if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    return data, offsets[1:] - offsets[0]


def runs_of(data: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of one kind within a row, ``kind`` 0 parting them: the runs' contents as a dictionary of binary
    values, where each run starts, and how many each row has."""
    if not len(data):
        return pa.array([], pa.large_binary()).dictionary_encode(), np.zeros(0, dtype=np.int64), np.zeros(len(ends), dtype=np.int64)
    edge = np.empty(len(data), dtype=bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    begins = ends[:-1]
    edge[begins[begins < len(data)]] = True
    at = np.flatnonzero(edge)
    stops = np.append(at[1:], len(data))
    inside = kind[at] > 0
    starts, sizes = at[inside], (stops - at)[inside]
    offsets = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(sizes)])
    runs = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[kind > 0])])
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], ends])))
    return runs.dictionary_encode(), starts, counts.astype(np.int64)


def hash_of_bytes(values: list[bytes]) -> np.ndarray:
    """64-bit hashes."""
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, values), dtype=np.uint64, count=len(values))


def hashes_of(values: pa.LargeBinaryArray) -> np.ndarray:
    """64-bit hashes of binary values, from where each byte stands, without a Python object for each value."""
    if not len(values):
        return np.zeros(0, dtype=np.uint64)
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64, count=len(values) + 1, offset=8 * values.offset)
    data = np.frombuffer(values.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]].astype(np.uint64)
    sizes = np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    running = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(data + (place.astype(np.uint64) << np.uint64(8)) + np.uint64(1)))])
    ends = offsets - offsets[0]
    with np.errstate(over="ignore"):
        return mix(running[ends[1:]] - running[ends[:-1]] + sizes.astype(np.uint64))
