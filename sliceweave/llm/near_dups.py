"""Near duplicates by SetSketch registers: banded, compared by likelihood, confirmed on full shingle sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from sliceweave.llm.common import KeyFilter, as_rows, discard, field, mix, slices, words_of
from sliceweave.operators.position import with_position
from sliceweave.session import materialize

#: Words of a shingle, and the similarity of a link in hundredths.
SHINGLE, SIMILAR = 5, 75
#: Registers (a prime) with values floor(1 - log_BASE(minimum / RATE)), cut off at 0 and TOP + 1; bands of ROWS registers.
#: A pair at 0.75 shares no band with probability (1 - 0.75^5)^48 = 2e-6.
REGISTERS, BASE, RATE, TOP, BANDS, ROWS = 241, 1.001, 20.0, 65534, 48, 5
#: A pair is confirmed if its estimate is at most this far below the wanted similarity: 4.5 standard deviations.
SLACK = 4.5 * (0.75 * 0.25 / REGISTERS) ** 0.5
#: Pairs of a bucket's first members with all its members are tried before the rest of the bucket.
PIVOTS, CHUNK = 3, 128

_FACTORS = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of all rows in turn, sorted within a row, and how many each row has.

    Words are runs without ASCII white space, A-Z lower-cased. Fewer than five words make one shingle, none make none.
    """
    codes, counts, words = words_of(texts, lower=True)
    hashes = pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.zeros(0, dtype=np.uint64)
    w, ends = hashes[codes], np.cumsum(counts)
    many = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(counts)), many)
    first = np.repeat(ends - counts, many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    stop = ends[row] if len(row) else ends[:0]
    key = np.zeros(len(row), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(SHINGLE):
            at = first + j
            key += np.where(at < stop, w[np.minimum(at, len(w) - 1)] * _FACTORS[j], np.uint64(0)) if len(w) else np.uint64(0)
    key = mix(key)
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    key, row = key[fresh], row[fresh]
    return key, np.bincount(row, minlength=len(counts)).astype(np.int64)


def registers(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SetSketch registers of sets laid end to end: a row of ``REGISTERS`` numbers for each set, 0 for an empty one.

    Every element gives each register an exponential value, the smallest first: spacings of order statistics, registers
    along a walk without return. A register keeps its minimum over the elements. Values above all minima of a set change
    nothing, so elements stop at a level that fills every register with high probability, and a set left with an unfilled
    one goes on to twice that level.
    """
    low = np.full((len(counts), REGISTERS), np.inf)
    ends = np.cumsum(counts)
    level = (np.log(REGISTERS) + 4.0) / np.maximum(counts, 1)
    todo = np.flatnonzero(counts)
    while len(todo):
        owner = np.repeat(todo, counts[todo])
        at = np.arange(len(owner)) - np.repeat(np.cumsum(counts[todo]) - counts[todo], counts[todo]) + np.repeat((ends - counts)[todo], counts[todo])
        key = keys[at]
        place = (mix(key + np.uint64(1)) % np.uint64(REGISTERS)).astype(np.int64)
        stride = (mix(key + np.uint64(2)) % np.uint64(REGISTERS - 1)).astype(np.int64) + 1
        value, top = np.zeros(len(key)), level[owner]
        for j in range(REGISTERS):
            with np.errstate(over="ignore"):
                key = key + _GOLDEN
            value = value - np.log(((mix(key) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / (REGISTERS - j)
            alive = value < top
            key, place, stride, value, top, owner = key[alive], place[alive], stride[alive], value[alive], top[alive], owner[alive]
            if not len(key):
                break
            np.minimum.at(low.reshape(-1), owner * REGISTERS + place, value)
            place = (place + stride) % REGISTERS
        todo = todo[np.isinf(low[todo]).any(axis=1)]
        level[todo] *= 2
    with np.errstate(divide="ignore"):
        out = np.floor(1.0 - np.log(low / RATE) / np.log(BASE))
    return np.clip(out, 0, TOP + 1).astype("<u2")


def estimate(greater: np.ndarray, less: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of greatest likelihood, for pairs of sets of sizes ``a`` and ``b`` of which so many registers are greater
    on one side or the other. The likelihood is concave in the similarity and is maximised on a grid of 1/200."""
    grid = np.linspace(0.0, 1.0, 201)[None, :]
    u, v = (a / (a + b))[:, None], (b / (a + b))[:, None]
    chance = lambda x: -np.log1p(-np.clip(x, 1e-12, 1.0) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = chance(u - v * grid), chance(v - u * grid)
    same = np.clip(1.0 - up - down, 1e-12, 1.0)
    equal = REGISTERS - greater - less
    score = greater[:, None] * np.log(up) + less[:, None] * np.log(down) + equal[:, None] * np.log(same)
    score[grid.repeat(len(a), 0) > np.minimum(u / v, v / u) + 1e-9] = -np.inf
    return grid[0, np.argmax(score, axis=1)]


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A narrow row per document: id, key of the text, size and digest of the shingle set, registers (null if empty)."""
    schema = StructType([StructField("id", docs.schema[id_col].dataType), *[StructField(c, LongType()) for c in ("text_key", "n", "d1", "d2")],
                         StructField("regs", BinaryType())])

    def run(batches):
        for batch in batches:
            texts = batch.column(2)
            for at, to in slices(texts):
                keys, counts = shingles(texts.slice(at, to - at))
                ends = np.cumsum(counts)
                sums = []
                with np.errstate(over="ignore"):
                    for salt in (3, 5):
                        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(keys + np.uint64(salt)))])
                        sums.append((total[ends] - total[ends - counts]).view(np.int64))
                regs = registers(keys, counts)
                binary = pa.array([r.tobytes() if n else None for r, n in zip(regs, counts)], pa.binary())
                columns = [batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), pa.array(counts), *map(pa.array, sums), binary]
                yield pa.RecordBatch.from_arrays(columns, schema=None, names=[f.name for f in schema.fields])

    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, keys) for the rows (node, id, text_key): shingle sets made anew from the whole texts of those documents."""
    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_key"), F.col(text_col).alias("_text"))
    chosen = texts.join(wanted, texts["_id"].eqNullSafe(wanted["id"]) & (texts["_key"] == wanted["text_key"])).select("node", "_text")

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            for at, to in slices(texts):
                keys, counts = shingles(texts.slice(at, to - at))
                ends = np.cumsum(counts)
                raw = pa.array([keys[e - c:e].astype("<u8").tobytes() for e, c in zip(ends, counts)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), raw], names=["node", "keys"])

    # rows that repeat a document give its set again
    return chosen.mapInArrow(run, "node long, keys binary").dropDuplicates(["node"])


def _guess(pairs: DataFrame, regs: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb) that may be similar, with their estimate."""
    left, right = regs.select(F.col("node").alias("a"), F.col("regs").alias("ra")), regs.select(F.col("node").alias("b"), F.col("regs").alias("rb"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b, na, nb = (batch.column(i).to_numpy() for i in range(4))
                ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype="<u2").reshape(-1, REGISTERS) for i in (4, 5))
                guess = estimate((ra > rb).sum(axis=1), (ra < rb).sum(axis=1), na, nb)
                keep = guess >= SIMILAR / 100 - SLACK
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(guess[keep])], names=["a", "b", "guess"])

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ra", "rb")
    return both.mapInArrow(run, "a long, b long, guess double")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets reach the wanted similarity."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * shared >= SIMILAR * (len(x) + len(y) - shared)


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets are similar."""
    left, right = sets.select(F.col("node").alias("a"), F.col("keys").alias("ka")), sets.select(F.col("node").alias("b"), F.col("keys").alias("kb"))

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                keep[i] = similar(np.frombuffer(x.as_py(), dtype="<u8"), np.frombuffer(y.as_py(), dtype="<u8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ka", "kb")
    return both.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for all nodes of the links (a, b): the smallest node that is reachable.

    Every round takes the smallest label among a node and its neighbours, then the label's own label, which doubles the
    reach; labels are stored each round.
    """
    ends = materialize(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = materialize(ends.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")))
    while True:
        near = ends.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("old"))
        step = materialize(step)
        jump = step.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        new = materialize(step.join(jump, "comp").select("node", F.col("further").alias("comp"), (F.col("further") != F.col("old")).alias("moved")))
        discard(step, labels)
        labels = new.select("node", "comp")
        if not new.filter("moved").head(1):
            return labels


def joined_components(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: whole components take the place of their nodes, so only links between them count."""
    ca, cb = comps.select(F.col("node").alias("a"), F.col("comp").alias("ca")), comps.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    between = links.join(ca, "a", "left").join(cb, "b", "left").select(F.coalesce("ca", "a").alias("x"), F.coalesce("cb", "b").alias("y"))
    between = materialize(between.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    top = components(between)
    moved = comps.join(top.select(F.col("node").alias("comp"), F.col("comp").alias("new")), "comp", "left").select("node", F.coalesce("new", "comp").alias("comp"))
    return materialize(moved.union(top.join(comps.select("node"), "node", "left_anti")))


def _apart(pairs: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Pairs that are not in one component yet."""
    if comps is None:
        return pairs
    ca, cb = comps.select(F.col("node").alias("a"), F.col("comp").alias("ca")), comps.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    joined = pairs.join(ca, "a", "left").join(cb, "b", "left")
    return joined.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*pairs.columns)


def _rest_of_buckets(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members (key, band, node, n, comp, main, chunks, parts) of buckets that may still hide a link.

    That takes more members than the pivots cover, members in several components, and one of the pair outside the largest
    of these, ``main``.
    """
    big = members.filter(F.col("size") > PIVOTS + 1).select("key", "band", "node", "n")
    big = materialize(big.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    by_comp = big.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    keys = by_comp.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"), F.sum("c").alias("size"))
    outside = F.col("size") - F.col("main.c")
    keys = keys.filter("comps > 1").select("key", F.col("main.comp").alias("main"), F.ceil(outside / CHUNK).cast("long").alias("chunks"), F.ceil(F.col("size") / CHUNK).cast("long").alias("parts"))
    return materialize(big.join(keys, "key"))


def _links_in_rest(rest: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components in those buckets. Members outside the largest component are put in chunks, and every
    chunk meets every part of the bucket once. A pair is looked at in the first band that it shares only; the likelihood
    sorts out most, and the full sets decide."""
    whole = rest.join(nodes.select("node", "regs"), "node").join(sets, "node")
    item = F.struct("node", "comp", "n", "regs", "keys")
    chunk = F.pmod(F.xxhash64("node", "key"), F.col("chunks"))
    packs = whole.filter(F.col("comp") != F.col("main")).withColumn("chunk", chunk).groupBy("key", "band", "chunk").agg(F.collect_list(item).alias("pack"))
    parts = whole.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).groupBy("key", "part", "chunks").agg(F.collect_list(item).alias("all"))
    parts = parts.select("key", "all", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))

    def run(batches):
        def unpack(column):
            flat = column.flatten()
            regs = np.frombuffer(b"".join(flat.field("regs").to_pylist()), dtype="<u2").reshape(-1, REGISTERS)
            keys = [np.frombuffer(k, dtype="<u8") for k in flat.field("keys").to_pylist()]
            return (*(flat.field(c).to_numpy() for c in ("node", "comp", "n")), regs, keys)

        for batch in batches:
            for i, band in enumerate(batch.column("band").to_pylist()):
                pn, pc, pz, pr, pk = unpack(batch.column("pack").slice(i, 1))
                an, ac, az, ar, ak = unpack(batch.column("all").slice(i, 1))
                found = []
                for x in range(len(an)):
                    near = np.flatnonzero((pc != ac[x]) & (100 * np.minimum(pz, az[x]) >= SIMILAR * np.maximum(pz, az[x])))
                    if band and len(near):
                        same = (pr[near, :band * ROWS] == ar[x, :band * ROWS]).reshape(len(near), band, ROWS)
                        near = near[~same.all(axis=2).any(axis=1)]
                    if len(near):
                        guess = estimate((pr[near] > ar[x]).sum(axis=1), (pr[near] < ar[x]).sum(axis=1), pz[near], np.full(len(near), az[x]))
                        for y in near[guess >= SIMILAR / 100 - SLACK]:
                            if similar(pk[y], ak[x]):
                                found.append((min(pn[y], an[x]), max(pn[y], an[x])))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    return packs.join(parts, ["key", "chunk"]).select("band", "pack", "all").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text_key, n_shingles, component_id, kept) for every row of ``docs``.

    Two documents are linked if their sets of five-word shingles have a Jaccard similarity of 0.75 or more. component_id is
    the smallest id reachable over links; kept marks the documents whose own id that is. A null or empty text, or one of
    white space, has an empty set and no links. Rows alike in their shingle sets are one class, however many there are; a
    null id is larger than all others. A repeated id with different texts belongs to each text's component. An empty table
    gives no rows, other columns are not read. Sets are compared by 64-bit hashes of their shingles.

    Texts are sketched where they lie, and classes of equal sets enter the search once. Bands of registers file them in
    buckets; the first few members of each bucket are paired with all others, and what these links leave apart in larger
    buckets is compared chunk by chunk. A likelihood over both sketches sorts out most pairs. Each node's best pair
    is confirmed on full sets first, the others only where that has not joined their components yet.
    """
    judged = _judged(docs, id_col, text_col)
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return judged.select(F.col("id").alias(id_col), "text_key", F.col("n").alias("n_shingles"), component.alias("component_id"),
                         F.col("id").eqNullSafe(component).alias("kept"))


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, n, comp, component_id) for every row: comp numbers the components, whatever their ids; null for empty sets."""
    drawn = materialize(sketches(docs, id_col, text_col))
    full = drawn.filter("n > 0")
    first = F.min(F.struct(F.col("id").isNull(), "id", "text_key")).alias("first")
    classes = full.groupBy("d1", "d2", "n").agg(first, F.first("regs").alias("regs"))
    nodes = with_position(classes.select("d1", "d2", "n", F.col("first.id").alias("id"), F.col("first.text_key").alias("text_key"), "regs"), ["d1", "d2"], "node")
    nodes = materialize(nodes)

    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("regs", i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    bands = nodes.select("node", "n", F.posexplode(band).alias("band", "key"))
    sizes = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = materialize(bands.join(sizes, "key"))
    # one order for all buckets, so that a family of texts has the same pivots in every band
    order = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("node"), "node"))
    pivots = members.withColumn("turn", order).filter(F.col("turn") <= PIVOTS).select("key", F.col("node").alias("pivot"), F.col("n").alias("pn"))
    close = lambda x, y: 100 * F.least(x, y) >= SIMILAR * F.greatest(x, y)
    pairs = members.join(pivots, "key").filter((F.col("node") != F.col("pivot")) & close(F.col("n"), F.col("pn")))
    ahead = F.col("node") < F.col("pivot")
    pairs = pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"), F.when(ahead, F.col("n")).otherwise(F.col("pn")).alias("na"),
                         F.when(ahead, F.col("pn")).otherwise(F.col("n")).alias("nb")).distinct()
    guessed = materialize(_guess(pairs, nodes))

    ends = lambda p: p.select(F.col("a").alias("node")).union(p.select(F.col("b").alias("node"))).distinct()
    named = nodes.select("node", "id", "text_key")
    sets = materialize(_sets(docs, ends(guessed).join(named, "node"), id_col, text_col))
    each = guessed.select("a", "b", "guess", F.explode(F.array("a", "b")).alias("node"))
    best = each.groupBy("node").agg(F.max(F.struct("guess", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    comps = components(materialize(_confirm(best, sets)))
    comps = joined_components(comps, _confirm(_apart(guessed, comps), sets))

    rest = _rest_of_buckets(members, comps)
    if rest.head(1):
        missing = rest.select("node").distinct().join(sets.select("node"), "node", "left_anti").join(named, "node")
        sets = sets.union(materialize(_sets(docs, missing, id_col, text_col)))
        comps = joined_components(comps, _links_in_rest(rest, nodes, sets))

    owned = nodes.select("node", "d1", "d2", "n", "id").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    smallest = owned.groupBy("comp").agg(F.min("id").alias("component_id"))
    classes = materialize(owned.join(smallest, "comp").select(F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), F.col("n").alias("_n"), "comp", "component_id"))
    same = (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")) & (F.col("n") == F.col("_n"))
    return drawn.select("id", "text_key", "n", "d1", "d2").join(classes, same, "left").select("id", "text_key", "n", "comp", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the least by id (null last) and text hash, one of those alike
    in both. Texts without shingles stay; columns may have any names.

    Rows that go, and those with repeats, are few next to all; a filter of bounded size lets the others pass where they lie.
    """
    place = F.struct(F.col("id").isNull().alias("none"), "id", "text_key")
    keys = materialize(_judged(docs, id_col, text_col).filter("n > 0").groupBy("comp", "id", "text_key").agg(F.count(F.lit(1)).alias("copies")))
    first = keys.groupBy("comp").agg(F.min(place).alias("first"))
    marked = keys.join(first, "comp").select("id", "text_key", "copies", (place == F.col("first")).alias("stays")).filter("copies > 1 or not stays")
    marked = materialize(marked.withColumn("key", F.xxhash64("id", "text_key")))
    rows = as_rows(docs)
    text_key = F.xxhash64(field(text_col))
    maybe = KeyFilter.of(marked, "key").column(docs.sparkSession, F.xxhash64(field(id_col), text_key))
    same = field(id_col).eqNullSafe(F.col("id")) & (text_key == F.col("text_key"))
    out = rows.filter(~maybe).unionByName(rows.filter(maybe).join(marked, same, "left_anti"))
    repeated = marked.filter("stays").select("id", "text_key")
    if repeated.head(1):
        # rows alike in id and text, of which one stays
        kept = rows.filter(maybe).join(repeated, same).dropDuplicates(["id", "text_key"])
        out = out.unionByName(kept.select("row"))
    return out.select("row.*")
