"""Pixel-wise raster operators.

A raster is a table ``img, ch, y, x, v`` of whole-number pixel values. Statistics per image and
channel are small tables; Spark broadcasts them when their measured size allows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sliceweave.operators.spatial_join import points_within

# Pseudo-colours of channels 0 to 9 (cyan, yellow, magenta, red, orange, purple,
# green, light green, blue, grey) as red, green, blue.
CHANNEL_COLOURS = [
    (0.0, 1.0, 1.0), (1.0, 1.0, 0.0), (1.0, 0.0, 1.0), (1.0, 0.0, 0.0), (1.0, 0.5, 0.0),
    (0.6, 0.0, 0.6), (0.0, 1.0, 0.0), (0.3, 1.0, 0.3), (0.0, 0.0, 1.0), (0.5, 0.5, 0.5),
]


def image_size(pixels: DataFrame) -> DataFrame:
    """Height and width per image, from the highest coordinates present."""
    return pixels.groupBy("img").agg((F.max("y") + 1).cast("int").alias("h"), (F.max("x") + 1).cast("int").alias("w"))


def stack_channels(channels: list[DataFrame], check: bool = True) -> DataFrame:
    """One raster from single-channel tables ``img, y, x, v`` in channel order; shapes must agree."""
    stacked = reduce(lambda a, b: a.unionByName(b), [c.withColumn("ch", F.lit(i)) for i, c in enumerate(channels)])
    if check:
        shapes = stacked.groupBy("img", "ch").agg(F.max("y").alias("y"), F.max("x").alias("x"))
        wrong = shapes.groupBy("img").agg(F.countDistinct("y", "x").alias("n")).filter("n > 1").limit(10).collect()
        if wrong:
            raise ValueError(f"channels differ in shape for images {[r['img'] for r in wrong]}")
    return stacked.select("img", "ch", "y", "x", "v")


def threshold(pixels: DataFrame, limits: list[int], invert: bool = False, max_value: int = 65535) -> DataFrame:
    """Keep ``v >= limit`` of the channel, else 0; inverted: keep ``v <= limit``, else the highest value.

    One limit serves all channels; otherwise there must be one for each, and any other number is an error.
    """
    if len(limits) > 1:
        channels = pixels.agg(F.max("ch")).first()[0]
        if channels is not None and channels + 1 != len(limits):
            raise ValueError(f"{len(limits)} limits for {channels + 1} channels")
    limit = F.element_at(F.array(*[F.lit(int(t)) for t in limits]), F.col("ch").cast("int") + 1) if len(limits) > 1 else F.lit(int(limits[0]))
    kept = F.when(F.col("v") <= limit, F.col("v")).otherwise(F.lit(max_value)) if invert else \
        F.when(F.col("v") >= limit, F.col("v")).otherwise(F.lit(0))
    return pixels.withColumn("v", kept.cast("long"))


def invert(pixels: DataFrame, max_value: int = 255) -> DataFrame:
    return pixels.withColumn("v", (F.lit(max_value) - F.col("v")).cast("long"))


def mask_by_raster(pixels: DataFrame, mask: DataFrame, limit: int = 127, inverted: bool = False) -> DataFrame:
    """Zero the pixels outside (or inside) ``mask > limit``; one mask serves every channel.

    A mask of several channels covers a pixel that any of them covers.
    """
    on = mask.filter(F.col("v") > limit).select("img", "y", "x").distinct().withColumn("_m", F.lit(True))
    joined = pixels.join(on, ["img", "y", "x"], "left")
    covered = F.coalesce("_m", F.lit(False))
    keep = ~covered if inverted else covered
    return joined.withColumn("v", F.when(keep, F.col("v")).otherwise(F.lit(0)).cast("long")).select(*pixels.columns)


def mask_by_polygon(pixels: DataFrame, polygons: DataFrame, inverted: bool = False, white: bool = False,
                    max_value: int = 255, on: list[str] = ("img",)) -> DataFrame:
    """Blank the pixels whose centre lies in no polygon (or, inverted, in one)."""
    centres = pixels.select("img", "y", "x").distinct()
    centres = centres.withColumns({"_px": F.col("x") + 0.5, "_py": F.col("y") + 0.5})
    hits = points_within(centres, polygons.select(*on, "geometry").distinct(), "_px", "_py", list(on))
    hits = hits.select("img", "y", "x").distinct().withColumn("_m", F.lit(True))
    covered = F.coalesce("_m", F.lit(False))
    keep = ~covered if inverted else covered
    blank = F.lit(max_value if white else 0)
    joined = pixels.join(hits, ["img", "y", "x"], "left")
    return joined.withColumn("v", F.when(keep, F.col("v")).otherwise(blank).cast("long")).select(*pixels.columns)


def flip(pixels: DataFrame, direction: str, size: DataFrame | None = None) -> DataFrame:
    """Mirror in the image plane: ``horizon`` swaps left and right, ``vertical`` top and bottom."""
    if direction not in ("horizon", "vertical"):
        raise ValueError("direction must be horizon or vertical")
    sized = pixels.join(image_size(pixels) if size is None else size, "img")
    moved = {"x": F.col("w") - 1 - F.col("x")} if direction == "horizon" else {"y": F.col("h") - 1 - F.col("y")}
    return sized.withColumns(moved).select(*pixels.columns)


def rotate90(pixels: DataFrame, turns: int, size: DataFrame | None = None) -> DataFrame:
    """Rotate counter-clockwise in the image plane by one to three quarter turns."""
    if turns not in (1, 2, 3):
        raise ValueError("turns must be 1, 2 or 3")
    sized = pixels.join(image_size(pixels) if size is None else size, "img")
    y, x, h, w = (F.col(c) for c in "yxhw")
    new = {1: (w - 1 - x, y), 2: (h - 1 - y, w - 1 - x), 3: (x, h - 1 - y)}[turns]
    return sized.select("img", "ch", new[0].alias("y"), new[1].alias("x"), "v").select(*pixels.columns)


def to_8bit(pixels: DataFrame) -> DataFrame:
    """Scale to 0..255 by the highest value of each image and channel, truncating."""
    top = pixels.groupBy("img", "ch").agg(F.max("v").alias("_top"))
    joined = pixels.join(top, ["img", "ch"])
    scaled = F.when(F.col("_top") > 0, F.floor(F.col("v").cast("double") / F.col("_top") * 255)).otherwise(F.lit(0))
    return joined.withColumn("v", scaled.cast("long")).select(*pixels.columns)


def intensity_histogram(pixels: DataFrame, channel: int = 0, breaks: int = 1000, min_intensity: int = 0,
                        scale: bool = False, log: bool = False) -> DataFrame:
    """Equal bins between the lowest and highest value per image: ``img, bin, lower, upper, n``.

    The last bin is closed. With ``min_intensity`` above zero only higher values count; ``scale``
    maps to 8 bits, ``log`` takes log10(v + 1e-6). Empty bins are left out.
    """
    kept = pixels.filter(F.col("ch") == channel)
    if min_intensity > 0:
        kept = kept.filter(F.col("v") > min_intensity)
    # distinct values first: the rest works on a table as small as the value range
    values = kept.groupBy("img", "ch", "v").agg(F.count(F.lit(1)).alias("n"))
    if scale:
        values = to_8bit(values)
    value = F.log10(F.col("v") + F.lit(1e-6)) if log else F.col("v").cast("double")
    values = values.select("img", value.alias("u"), "n")
    ends = values.groupBy("img").agg(F.min("u").alias("lo"), F.max("u").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    ends = ends.select("img", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                       F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(breaks))
    raw = F.least(F.floor((F.col("u") - F.col("lo")) * (F.lit(float(breaks)) / (F.col("hi") - F.col("lo")))), F.lit(breaks - 1))
    binned = values.join(ends, "img").withColumns({"_w": width, "_b": raw})
    edge = lambda i: F.col("lo") + i * F.col("_w")
    # a value next to a bin edge goes where the edge itself says
    fixed = F.when(F.col("u") < edge(F.col("_b")), F.col("_b") - 1).when(
        (F.col("u") >= edge(F.col("_b") + 1)) & (F.col("_b") < breaks - 1), F.col("_b") + 1).otherwise(F.col("_b"))
    counted = binned.withColumn("bin", fixed.cast("long")).groupBy("img", "bin", "lo", "_w").agg(F.sum("n").alias("n"))
    return counted.select("img", "bin", edge(F.col("bin")).alias("lower"), edge(F.col("bin") + 1).alias("upper"), "n")


def blend_rgb(pixels: DataFrame, inverted: bool = False, colours: list[tuple] = CHANNEL_COLOURS) -> DataFrame:
    """Pseudo-coloured image ``img, y, x, r, g, b`` of up to ten channels.

    Every channel is scaled to 0..1 by its own range in single precision, multiplied by its
    colour and added in channel order; the sum is clipped, scaled to 255 and rounded half to even.
    """
    ends = pixels.groupBy("img", "ch").agg(F.min("v").cast("float").alias("_lo"), F.max("v").cast("float").alias("_hi"))
    f32 = lambda c: c.cast("float")
    span = f32(f32(F.col("_hi") - F.col("_lo")) + F.lit(1e-8).cast("float"))
    norm = f32(f32(F.col("v").cast("float") - F.col("_lo")) / span)
    scaled = pixels.join(ends, ["img", "ch"]).withColumn("_n", norm)
    palette = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in colours])
    listed = scaled.groupBy("img", "y", "x").agg(F.array_sort(F.collect_list(F.struct("ch", "_n"))).alias("_l"))

    def level(i: int) -> Column:
        total = F.aggregate(
            "_l", F.lit(0.0).cast("float"),
            lambda acc, s: f32(acc.cast("double") + s["_n"].cast("double") * palette[s["ch"]][i]))
        clipped = F.least(F.greatest(total, F.lit(0.0).cast("float")), F.lit(1.0).cast("float"))
        v = F.rint(f32(clipped * F.lit(255).cast("float")).cast("double")).cast("long")
        return F.lit(255) - v if inverted else v

    return listed.select("img", "y", "x", *[level(i).cast("long").alias(c) for i, c in enumerate("rgb")])


def otsu(pixels: DataFrame) -> DataFrame:
    """Otsu threshold per image and channel of 8-bit values: ``img, ch, t``.

    Works on the at most 256 histogram rows of each image; the first of equal maxima wins.
    """
    hist = pixels.groupBy("img", "ch", "v").agg(F.count(F.lit(1)).cast("double").alias("n"))
    upto = Window.partitionBy("img", "ch").orderBy("v")
    whole = Window.partitionBy("img", "ch")
    value = F.col("v").cast("double")
    acc = hist.withColumns({
        "n1": F.sum("n").over(upto), "s1": F.sum(F.col("n") * value).over(upto),
        "nt": F.sum("n").over(whole), "st": F.sum(F.col("n") * value).over(whole)})
    n1, n2 = F.col("n1"), F.col("nt") - F.col("n1")
    gap = F.col("s1") / n1 - (F.col("st") - F.col("s1")) / n2
    between = F.when(F.least(n1, n2) / F.col("nt") >= F.lit(1.1920929e-07), n1 * n2 * gap * gap).otherwise(F.lit(0.0))
    scored = acc.withColumn("_s", between)
    # a value that does not occur splits like the one before it, so only occurring values need a look
    best = scored.groupBy("img", "ch").agg(F.max(F.struct("_s", (-F.col("v")).alias("_t"))).alias("_b"))
    return best.select("img", "ch", F.when(F.col("_b._s") > 0, -F.col("_b._t")).otherwise(F.lit(0)).cast("long").alias("t"))


def binarise(pixels: DataFrame, thresholds: DataFrame) -> DataFrame:
    """255 where the value exceeds the image's threshold, else 0."""
    joined = pixels.join(thresholds, ["img", "ch"])
    return joined.withColumn("v", F.when(F.col("v") > F.col("t"), 255).otherwise(0).cast("long")).select(*pixels.columns)
