"""Dense raster tiles: one row holds a square of packed pixels and is the unit of every operator here.

A tile table has ``img, ch, ty, tx, h, w, v``: the image's size and the values of one tile, row by row, as an array that is
cut where the image ends. A place without a pixel is null. Tiles are formed once, or read from where they are stored; after
that tiles move, never single pixels. A task handles a few tiles at a time, so memory depends on the tile side alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sliceweave.functions import geometry as G
from sliceweave.operators import neighbourhood as NB
from sliceweave.operators.raster import CHANNEL_COLOURS, image_size

TILE = 256
#: Rows of tiles that a task turns into numpy arrays at once.
AT_ONCE = 16
KEYS = ["img", "ch", "ty", "tx"]
COLUMNS = [*KEYS, "h", "w", "v"]


def _sides(ty: np.ndarray, tx: np.ndarray, h: np.ndarray, w: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(tile, h - ty * tile), np.minimum(tile, w - tx * tile)


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of all lists in turn (0 for nulls), which of them are there, and where lists begin and end."""
    flat = column.flatten()
    there = np.ones(len(flat), dtype=bool) if not flat.null_count else flat.is_valid().to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    return flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), there, offsets - offsets[0]


def _to_lists(values: np.ndarray, there: np.ndarray | None, offsets: np.ndarray) -> pa.ListArray:
    flat = pa.array(values.astype(np.int64), mask=None if there is None or there.all() else ~there)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat)


def _in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(a, AT_ONCE)


def _schema(source: DataFrame) -> T.StructType:
    kinds = {f.name: f.dataType for f in source.schema.fields}
    return T.StructType([T.StructField("img", kinds["img"]), T.StructField("ch", kinds["ch"]), T.StructField("ty", T.IntegerType()), T.StructField("tx", T.IntegerType()),
                         T.StructField("h", T.IntegerType()), T.StructField("w", T.IntegerType()), T.StructField("v", T.ArrayType(T.LongType()))])


def to_tiles(pixels: DataFrame, size: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """Tiles of a pixel table ``img, ch, y, x, v``: the one shuffle of pixels, by tile. Tiles without pixels are left out."""
    size = image_size(pixels) if size is None else size
    at = (F.col("y") % tile).cast("int") * tile + (F.col("x") % tile).cast("int")
    grouped = pixels.groupBy("img", "ch", F.floor(F.col("y") / tile).cast("int").alias("ty"), F.floor(F.col("x") / tile).cast("int").alias("tx")).agg(
        F.collect_list(at).alias("at"), F.collect_list(F.col("v").cast("long")).alias("v"))
    grouped = grouped.join(size.select("img", "h", "w"), "img").select(*KEYS, "h", "w", "at", "v")

    def run(batches):
        for batch in _in_parts(batches):
            ty, tx, h, w = _numbers(batch, "ty", "tx", "h", "w")
            rows, cols = _sides(ty, tx, h, w, tile)
            ends = np.concatenate([[0], np.cumsum(rows * cols)])
            values, there = np.zeros(ends[-1], dtype=np.int64), np.zeros(ends[-1], dtype=bool)
            at, _, offsets = _lists(batch.column("at"))
            given, known, _ = _lists(batch.column("v"))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            place = ends[owner] + at // tile * cols[owner] + at % tile
            values[place], there[place] = given, known
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in COLUMNS[:-1]], _to_lists(values, there, ends)], names=COLUMNS)

    return grouped.mapInArrow(run, _schema(pixels))


def from_tiles(tiles: DataFrame, tile: int = TILE) -> DataFrame:
    """The pixel table of tiles; places without a pixel give none."""
    spread = tiles.select(*KEYS, F.least(F.lit(tile), F.col("w") - F.col("tx") * tile).alias("cols"), F.posexplode("v").alias("at", "v")).filter(F.col("v").isNotNull())
    y, x = F.col("ty") * tile + F.floor(F.col("at") / F.col("cols")), F.col("tx") * tile + F.col("at") % F.col("cols")
    return spread.select("img", "ch", y.cast("int").alias("y"), x.cast("int").alias("x"), "v")


def map_values(tiles: DataFrame, fn: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Pixel algebra where the tiles lie: ``fn(values, channel of each)`` for all values of some tiles."""
    def run(batches):
        for batch in _in_parts(batches):
            values, there, offsets = _lists(batch.column("v"))
            channel = np.repeat(_numbers(batch, "ch")[0], np.diff(offsets))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in COLUMNS[:-1]], _to_lists(fn(values, channel), there, offsets)], names=COLUMNS)

    return tiles.select(*COLUMNS).mapInArrow(run, _schema(tiles))


def _blanked(joined: DataFrame, covered: Callable, drop: list[str], inverted: bool, blank: int) -> DataFrame:
    """Tiles with ``blank`` where ``covered(batch, rows, cols, ends)`` is false, or inverted true."""
    def run(batches):
        for batch in _in_parts(batches):
            values, there, offsets = _lists(batch.column("v"))
            on = covered(batch, offsets)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in COLUMNS[:-1]], _to_lists(np.where(on != inverted, values, blank), there, offsets)], names=COLUMNS)

    return joined.select(*COLUMNS, *drop).mapInArrow(run, _schema(joined))


def mask_by_raster(tiles: DataFrame, mask: DataFrame, limit: int = 127, inverted: bool = False) -> DataFrame:
    """Zero the pixels outside (or inside) ``mask > limit``, tile by tile; a mask of several channels covers what any of
    them covers. Where the mask has no tile or no pixel it covers nothing. Both have one tile side and image size."""
    layers = mask.groupBy("img", "ty", "tx").agg(F.collect_list("v").alias("_layers"))

    def covered(batch, offsets):
        on = np.zeros(offsets[-1], dtype=bool)
        for i, layers in enumerate(batch.column("_layers")):
            for layer in layers.values if layers.is_valid else ():
                on[offsets[i]:offsets[i + 1]] |= layer.values.fill_null(limit).to_numpy(zero_copy_only=False) > limit
        return on

    return _blanked(tiles.join(layers, ["img", "ty", "tx"], "left"), covered, ["_layers"], inverted, 0)


def polygon_runs(polygons: DataFrame, on: list[str] = ("img",), tile: int = TILE) -> DataFrame:
    """Pixels whose centre lies strictly in a polygon, as runs ``on, y, x0, x1`` (x1 exclusive) by scan lines.

    Edges are filed by the bands of ``tile`` lines that they cross, so a polygon as large as an image spreads over many
    tasks. On each line the edges that are active there are sorted by where they cross it and paired; centres on an edge
    are taken out again. Coordinates are pixels, the centre of pixel (0, 0) is at (0.5, 0.5). Polygons may have holes and
    parts; each is judged alone, and runs of several polygons may overlap.
    """
    on = list(on)
    digest = F.struct(F.xxhash64("geometry").alias("a"), F.xxhash64(F.lit(1), "geometry").alias("b"))
    edges = polygons.filter(~G.is_empty(F.col("geometry"))).select(*on, digest.alias("_pid"), F.col("geometry")).distinct()
    edges = edges.select(*on, "_pid", F.explode(G.edges(F.col("geometry"))).alias("e")).select(*on, "_pid", "e.*")
    band = lambda y: F.floor(y / tile).cast("int")
    # a band from a half line above to a half line below holds all lines that an edge can meet
    bands = F.sequence(band(F.least("y1", "y2") - 0.5), band(F.greatest("y1", "y2") + 0.5))
    filed = edges.withColumn("_band", F.explode(bands)).groupBy(*on, "_pid", "_band").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_edges"))

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                flat, lists = part.column("_edges").flatten(), part.column("_edges").offsets.to_numpy()
                owner = np.repeat(np.arange(part.num_rows), np.diff(lists))
                x1, y1, x2, y2 = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2"))
                who, y, x0, x1 = scan_lines(owner, _numbers(part, "_band")[0], x1, y1, x2, y2, tile)
                keys = [part.column(c).take(pa.array(who)) for c in on]
                yield pa.RecordBatch.from_arrays([*keys, *[pa.array(c.astype(np.int32)) for c in (y, x0, x1)]], names=[*on, "y", "x0", "x1"])

    schema = T.StructType([*[polygons.schema[c] for c in on], *[T.StructField(c, T.IntegerType()) for c in ("y", "x0", "x1")]])
    return filed.select(*on, "_band", "_edges").mapInArrow(run, schema)


def _left_of(x: np.ndarray, y: np.ndarray, x1, y1, x2, y2) -> tuple[np.ndarray, np.ndarray]:
    """How many pixel centres of the line ``y`` lie left of the edge, and how many left of it or on it.

    The crossing's rounded place is a first guess; the sign of the turn, the test that points in polygons take too, decides.
    """
    rising = np.where(y2 > y1, 1.0, -1.0)
    side = lambda k: rising * ((x2 - x1) * (y - y1) - (y2 - y1) * (k + 0.5 - x1))  # noqa: E731  above zero: left of the edge
    low = np.floor(x - 0.5).astype(np.int64) - 1
    for _ in range(4):
        low = np.where(side(low) > 0, low, low - 1)
    left = low + 1
    for _ in range(4):
        left = np.where(side(left) > 0, left + 1, left)
    return left, left + (side(left) == 0)


def scan_lines(owner, band, x1, y1, x2, y2, tile: int):
    """(owner, line, from, to) of the runs of all owners, from their edges. ``band`` is each owner's band of lines."""
    first = band[owner] * tile
    # lines whose centre is at or above the lower and under the upper end: each corner counts once
    lo = np.maximum(np.ceil(np.minimum(y1, y2) - 0.5).astype(np.int64), first)
    hi = np.minimum(np.ceil(np.maximum(y1, y2) - 0.5).astype(np.int64), first + tile)
    many = np.maximum(hi - lo, 0)
    e = np.repeat(np.arange(len(owner)), many)
    line = lo[e] + _count_up(many)
    x = x1[e] + (line + 0.5 - y1[e]) * (x2[e] - x1[e]) / (y2[e] - y1[e])
    left, upto = _left_of(x, line + 0.5, x1[e], y1[e], x2[e], y2[e])
    order = np.lexsort((x, upto, left, line, owner[e]))
    who, line, left, upto = owner[e][order], line[order], left[order], upto[order]

    # centres on an edge: where a line crosses it, at its ends, and along it
    met = upto > left
    found = [(who[met], line[met], left[met])]
    whole = lambda c: c - 0.5 == np.floor(c)
    here = lambda y: whole(y) & (y >= first) & (y < first + tile)
    for x, y in ((x1, y1), (x2, y2)):
        met = whole(x) & here(y)
        found.append((owner[met], np.floor(y[met]).astype(np.int64), np.floor(x[met]).astype(np.int64)))
    level = np.flatnonzero((y1 == y2) & here(y1))
    start = np.ceil(np.minimum(x1, x2)[level] - 0.5).astype(np.int64)
    many = np.maximum(np.floor(np.maximum(x1, x2)[level] - 0.5).astype(np.int64) + 1 - start, 0)
    k = np.repeat(level, many)
    found.append((owner[k], np.floor(y1[k]).astype(np.int64), np.repeat(start, many) + _count_up(many)))

    # every line is crossed an even number of times, so neighbours pair up
    who, line, start, stop = who[::2], line[::2], upto[::2], left[1::2]
    keep = stop > start
    return _without(who[keep], line[keep], start[keep], stop[keep], *(np.concatenate(c) for c in zip(*found)))


def _count_up(many: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... for each of the counts, one after another."""
    return np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)


def _without(who, line, start, stop, out_who, out_line, out_at):
    """Runs less single centres of the same owner and line."""
    gone: dict = {}
    for w, y, x in set(zip(out_who.tolist(), out_line.tolist(), out_at.tolist())):
        gone.setdefault((w, y), []).append(x)
    hit = np.isin((who << 32) + line, np.array([(w << 32) + y for w, y in gone], dtype=np.int64)) if gone else np.zeros(len(who), dtype=bool)
    split = []
    for w, y, a, b in zip(*(c[hit].tolist() for c in (who, line, start, stop))):
        for x in sorted(gone[w, y]):
            if a <= x < b:
                split.append((w, y, a, x))
                a = x + 1
        split.append((w, y, a, b))
    more = np.array([r for r in split if r[3] > r[2]], dtype=np.int64).reshape(-1, 4)
    return tuple(np.concatenate([c[~hit], more[:, i]]) for i, c in enumerate((who, line, start, stop)))


def mask_by_polygon(tiles: DataFrame, polygons: DataFrame, inverted: bool = False, white: bool = False, max_value: int = 255,
                    on: list[str] = ("img",), tile: int = TILE) -> DataFrame:
    """Blank the pixels whose centre lies in no polygon (or, inverted, in one). Runs of lines are cut at tile edges and meet
    the tiles there; equal runs count once, so a tile gets no more of them than it has places."""
    runs = polygon_runs(polygons, on, tile).filter("x1 > 0 and y >= 0")
    runs = runs.withColumn("tx", F.explode(F.sequence(F.floor(F.greatest("x0", F.lit(0)) / tile).cast("int"), F.floor((F.col("x1") - 1) / tile).cast("int"))))
    runs = runs.select(*on, F.floor(F.col("y") / tile).cast("int").alias("ty"), "tx", (F.col("y") % tile).alias("y"),
                       F.greatest(F.col("x0") - F.col("tx") * tile, F.lit(0)).alias("x0"), F.least(F.col("x1") - F.col("tx") * tile, F.lit(tile)).alias("x1")).distinct()
    per_tile = runs.groupBy(*on, "ty", "tx").agg(F.collect_list(F.struct("y", "x0", "x1")).alias("_runs"))

    def covered(batch, offsets):
        ty, tx, h, w = _numbers(batch, "ty", "tx", "h", "w")
        rows, cols = _sides(ty, tx, h, w, tile)
        # one step up where a run starts and one down where it stops, a line having a place to spare
        base = np.concatenate([[0], np.cumsum(rows * (cols + 1))])
        steps = np.zeros(base[-1], dtype=np.int64)
        lists = batch.column("_runs").fill_null([]) if batch.column("_runs").null_count else batch.column("_runs")
        flat = lists.flatten()
        owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        y, x0, x1 = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("y", "x0", "x1"))
        ok = (y < rows[owner]) & (x0 < cols[owner])
        owner, y, x0, x1 = owner[ok], y[ok], x0[ok], np.minimum(x1[ok], cols[owner[ok]])
        line = base[owner] + y * (cols[owner] + 1)
        np.add.at(steps, line + x0, 1)
        np.add.at(steps, line + x1, -1)
        on_ = np.cumsum(steps) > 0
        spare = np.zeros(base[-1], dtype=bool)
        last = np.repeat(base[:-1], rows) + (_count_up(rows) + 1) * (np.repeat(cols, rows) + 1) - 1
        spare[last] = True
        return on_[~spare]

    return _blanked(tiles.join(per_tile, [*on, "ty", "tx"], "left"), covered, ["_runs"], inverted, max_value if white else 0)


def value_range(tiles: DataFrame) -> DataFrame:
    """(img, ch, lo, hi): least and greatest value; a row per tile is what is added up."""
    return tiles.groupBy("img", "ch").agg(F.min(F.array_min("v")).alias("lo"), F.max(F.array_max("v")).alias("hi"))


def to_8bit(tiles: DataFrame) -> DataFrame:
    """Scale to 0..255 by the highest value of each image and channel, truncating."""
    joined = tiles.join(value_range(tiles).select("img", "ch", F.col("hi").alias("_top")), ["img", "ch"])

    def run(batches):
        for batch in _in_parts(batches):
            values, there, offsets = _lists(batch.column("v"))
            top = np.repeat(batch.column("_top").fill_null(0).to_numpy(zero_copy_only=False), np.diff(offsets)).astype(float)
            scaled = np.where(top > 0, np.floor(values / np.where(top > 0, top, 1.0) * 255), 0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in COLUMNS[:-1]], _to_lists(scaled, there, offsets)], names=COLUMNS)

    return joined.select(*COLUMNS, "_top").mapInArrow(run, _schema(tiles))


def blend_rgb(tiles: DataFrame, inverted: bool = False, colours: list[tuple] = CHANNEL_COLOURS) -> DataFrame:
    """Pseudo-coloured tiles ``img, ty, tx, h, w, r, g, b`` of up to ten channels.

    Every channel is scaled to 0..1 by its own range in single precision, multiplied by its colour and added in channel
    order; the sum is clipped, scaled to 255 and rounded half to even. A channel without a pixel adds nothing there; a
    place without a pixel in all channels has none. The channels of a tile meet as one row each.
    """
    ranged = tiles.join(value_range(tiles), ["img", "ch"])
    layers = ranged.groupBy("img", "ty", "tx", "h", "w").agg(F.array_sort(F.collect_list(F.struct("ch", "lo", "hi", "v"))).alias("_l"))
    palette = np.array(colours, dtype=float)
    f32 = np.float32

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                channels = batch.column("_l").slice(row, 1).flatten()
                total, there = None, None
                for i in range(len(channels)):
                    ch, lo, hi = (channels.field(c)[i].as_py() for c in ("ch", "lo", "hi"))
                    column = channels.field("v").slice(i, 1)
                    values, known, _ = _lists(column)
                    if total is None:
                        total, there = np.zeros((3, len(values)), dtype=f32), np.zeros(len(values), dtype=bool)
                    there |= known
                    if lo is None:
                        continue
                    span = f32(f32(hi) - f32(lo)) + f32(1e-8)
                    norm = ((values.astype(f32) - f32(lo)) / span).astype(float)
                    for k in range(3):
                        total[k] = np.where(known, (total[k].astype(float) + norm * palette[ch][k]).astype(f32), total[k])
                level = np.rint((np.clip(total, f32(0), f32(1)) * f32(255)).astype(float))
                level = 255 - level if inverted else level
                ends = np.array([0, level.shape[1]])
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(row, 1) for c in ("img", "ty", "tx", "h", "w")], *[_to_lists(c, there, ends) for c in level]],
                                                 names=["img", "ty", "tx", "h", "w", "r", "g", "b"])

    fields = [f for f in _schema(tiles).fields if f.name not in ("ch", "v")]
    out = T.StructType([*fields, *[T.StructField(c, T.ArrayType(T.LongType())) for c in "rgb"]])
    return layers.mapInArrow(run, out)


def rgb_pixels(tiles: DataFrame, tile: int = TILE) -> DataFrame:
    """``img, y, x, r, g, b`` of blended tiles."""
    spread = tiles.select("img", "ty", "tx", F.least(F.lit(tile), F.col("w") - F.col("tx") * tile).alias("cols"), F.posexplode(F.arrays_zip("r", "g", "b")).alias("at", "c"))
    y, x = F.col("ty") * tile + F.floor(F.col("at") / F.col("cols")), F.col("tx") * tile + F.col("at") % F.col("cols")
    return spread.filter("c.r is not null").select("img", y.cast("int").alias("y"), x.cast("int").alias("x"), "c.r", "c.g", "c.b")


def with_halo(tiles: DataFrame, halo: int, fn: Callable, tile: int = TILE) -> DataFrame:
    """Run ``fn`` on every tile of each image and channel, with ``halo`` more places on every side.

    ``fn(block, y0, x0, h, w)`` is as in ``neighbourhood.tile_apply``: it gets the values from ``y0`` and ``x0`` (tile corner
    less halo) on, 0 where there is no pixel, and returns the values of its own tile row by row. Each tile sends its
    neighbours the strips they need, so what moves is the tiles and their rims. Tiles that are absent are 0 and are made.
    """
    if halo > tile:
        raise ValueError("the halo must not be wider than a tile")
    known = tiles.select("img", "ch", "h", "w").distinct()
    span = lambda c: F.explode(F.sequence(F.lit(0), F.floor((F.col(c) - 1) / tile).cast("int")))
    frame = known.withColumn("ty", span("h")).withColumn("tx", span("w")).select(*KEYS, "h", "w", F.lit(None).cast("int").alias("oy"), F.lit(None).cast("int").alias("ox"),
                                                                                   F.lit(None).cast("int").alias("wide"), F.lit(None).cast("array<bigint>").alias("v"))
    source = _schema(tiles)
    sent = T.StructType([*source.fields[:-1], *[T.StructField(c, T.IntegerType()) for c in ("oy", "ox", "wide")], source.fields[-1]])

    def strips(batches):
        for batch in _in_parts(batches):
            ty, tx, h, w = _numbers(batch, "ty", "tx", "h", "w")
            rows, cols = _sides(ty, tx, h, w, tile)
            values, _, offsets = _lists(batch.column("v"))
            out: list[list] = [[] for _ in range(7)]
            for i in range(batch.num_rows):
                block = values[offsets[i]:offsets[i + 1]].reshape(rows[i], cols[i])
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        ny, nx = ty[i] + dy, tx[i] + dx
                        if ny < 0 or nx < 0 or ny * tile >= h[i] or nx * tile >= w[i] or (halo == 0 and (dy or dx)):
                            continue
                        # what of this tile is within the neighbour's rim
                        a, b = max(0, (ny * tile - halo) - ty[i] * tile), min(rows[i], (ny + 1) * tile + halo - ty[i] * tile)
                        c, d = max(0, (nx * tile - halo) - tx[i] * tile), min(cols[i], (nx + 1) * tile + halo - tx[i] * tile)
                        if a < b and c < d:
                            for to, value in zip(out, (i, ny, nx, ty[i] * tile + a, tx[i] * tile + c, d - c, block[a:b, c:d].ravel())):
                                to.append(value)
            if out[0]:
                take = pa.array(out[0])
                ends = np.concatenate([[0], np.cumsum([len(v) for v in out[6]])])
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in ("img", "ch")], *[pa.array(np.array(x, dtype=np.int32)) for x in out[1:3]],
                                                  *[batch.column(c).take(take) for c in ("h", "w")], *[pa.array(np.array(x, dtype=np.int32)) for x in out[3:6]],
                                                  _to_lists(np.concatenate(out[6]), None, ends)], names=[f.name for f in sent.fields])

    pieces = tiles.select(*COLUMNS).mapInArrow(strips, sent).unionByName(frame)
    # nine strips and a frame at most
    met = pieces.groupBy(*KEYS, "h", "w").agg(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("oy", "ox", "wide", "v"))).alias("_s"))

    def blocks(batches):
        for batch in _in_parts(batches):
            ty, tx, h, w = _numbers(batch, "ty", "tx", "h", "w")
            done = []
            for i in range(batch.num_rows):
                y0, x0 = int(ty[i]) * tile - halo, int(tx[i]) * tile - halo
                block = np.zeros((tile + 2 * halo, tile + 2 * halo), dtype=np.int64)
                strips_ = batch.column("_s").slice(i, 1).flatten()
                for j in range(len(strips_)):
                    oy, ox, wide = (strips_.field(c)[j].as_py() for c in ("oy", "ox", "wide"))
                    part = _lists(strips_.field("v").slice(j, 1))[0].reshape(-1, wide)
                    block[oy - y0:oy - y0 + part.shape[0], ox - x0:ox - x0 + wide] = part
                done.append(np.asarray(fn(block, y0, x0, int(h[i]), int(w[i]))))
            ends = np.concatenate([[0], np.cumsum([len(v) for v in done])])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in COLUMNS[:-1]], _to_lists(np.concatenate(done), None, ends)], names=COLUMNS)

    return met.mapInArrow(blocks, source)


def blur(tiles: DataFrame, ksize: int = 11, tile: int = TILE) -> DataFrame:
    """See ``neighbourhood.blur``."""
    return _neighbourhood(tiles, NB.blurred(ksize), tile)


def dilate(tiles: DataFrame, ksize: int, tile: int = TILE) -> DataFrame:
    """See ``neighbourhood.dilate``."""
    return _neighbourhood(tiles, NB.dilated(ksize), tile)


def close(tiles: DataFrame, ksize: int, tile: int = TILE) -> DataFrame:
    """See ``neighbourhood.close``."""
    return _neighbourhood(tiles, NB.closed(ksize), tile)


def _neighbourhood(tiles: DataFrame, work: tuple[int, Callable], tile: int) -> DataFrame:
    halo, fn = work
    return with_halo(tiles, halo, lambda *block: fn(*block)["v"].to_numpy(), tile)
