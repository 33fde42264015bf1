"""Polygon overlay as joins over boundary edges.

Every edge is cut where other boundaries meet it, the pieces are located by their midpoints, and
the pieces that bound the result are joined to rings. Edges, cuts and pieces are rows; only the
rings of one result polygon, which become its geometry value, are put together in one place.

Polygon tables hold ``on`` columns, a text id ``pid`` and ``geometry``. Layer ``A`` is the layer
subtracted from, ``B`` the one subtracted.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sliceweave.functions import geometry as G
from sliceweave.operators import grid
from sliceweave.operators.spatial_join import candidate_pairs, points_within
from sliceweave.session import materialize

_BOX = ["bx0", "by0", "bx1", "by1"]


def _boxed_polygons(polygons: DataFrame) -> DataFrame:
    b = G.bounds(F.col("geometry"))
    return polygons.withColumns(dict(zip(_BOX, (b["xmin"], b["ymin"], b["xmax"], b["ymax"]))))


def _levels(df: DataFrame) -> list[int]:
    extent = F.greatest(F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0"))
    return grid.occurring_levels(df.select(grid.level_of(extent).alias("l")), "l") or [0]


def boundary_edges(polygons: DataFrame, keys: list[str]) -> DataFrame:
    """Edges with the interior on their left: ``keys, eid, x1, y1, x2, y2`` and their box."""
    parts = polygons.filter(~G.is_empty(F.col("geometry"))).select(*keys, F.posexplode("geometry.parts").alias("p", "part"))
    rings = parts.select(*keys, "p", F.posexplode("part").alias("r", "ring"))
    area = G.ring_moments(F.col("ring"))["area"]
    wrong = ((F.col("r") == 0) & (area < 0)) | ((F.col("r") > 0) & (area > 0))
    rings = rings.withColumn("ring", F.when(wrong, F.reverse("ring")).otherwise(F.col("ring")))
    out = rings.select(*keys, "p", "r", F.posexplode(G.ring_edges(F.col("ring"))).alias("i", "e"))
    # adding zero turns -0.0 into 0.0, so that equal places compare equal everywhere
    out = out.select(*keys, F.struct(*keys, "p", "r", "i").alias("eid"),
                     *[(F.col(f"e.{c}") + 0.0).alias(c) for c in ("x1", "y1", "x2", "y2")])
    out = out.filter((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))
    return out.withColumns({"bx0": F.least("x1", "x2"), "by0": F.least("y1", "y2"),
                            "bx1": F.greatest("x1", "x2"), "by1": F.greatest("y1", "y2")})


def _turn(a, b, c) -> Column:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _ends(side: int):
    return ((F.col(f"x1_{side}"), F.col(f"y1_{side}")), (F.col(f"x2_{side}"), F.col(f"y2_{side}")))


def _on_segment(turn: Column, a, b, c) -> Column:
    """c lies on the closed segment a-b, given the turn of a, b, c."""
    return ((turn == 0) & (c[0] >= F.least(a[0], b[0])) & (c[0] <= F.greatest(a[0], b[0]))
            & (c[1] >= F.least(a[1], b[1])) & (c[1] <= F.greatest(a[1], b[1])))


def _opposite(s: Column, t: Column) -> Column:
    return ((s > 0) & (t < 0)) | ((s < 0) & (t > 0))


def _cuts(edges: DataFrame, on: list[str]) -> DataFrame:
    """Points where an edge is met by an edge of another polygon: ``eid, x, y``.

    A crossing point is computed once per pair and given to both edges, so the pieces on either
    side share it bit for bit. Two edges of layer A never cut each other.
    """
    carry = ["layer", "pid", "x1", "y1", "x2", "y2"]
    other = lambda c: ((c("layer_1") != c("layer_2")) | (c("pid_1") != c("pid_2"))) & ~(
        (c("layer_1") == "A") & (c("layer_2") == "A"))
    pairs = grid.overlapping_boxes(edges, "eid", on, _BOX, carry, _levels(edges), other)
    (p1, p2), (q1, q2) = _ends(1), _ends(2)
    pairs = pairs.withColumns({"d1": _turn(q1, q2, p1), "d2": _turn(q1, q2, p2),
                               "d3": _turn(p1, p2, q1), "d4": _turn(p1, p2, q2)})
    d1, d2, d3, d4 = (F.col(f"d{i}") for i in range(1, 5))
    cross = _opposite(d1, d2) & _opposite(d3, d4)
    t = d1 / (d1 - d2)
    x, y = p1[0] + (p2[0] - p1[0]) * t, p1[1] + (p2[1] - p1[1]) * t
    point = lambda side, px, py: F.struct(F.col(f"eid_{side}").alias("eid"), (px + 0.0).alias("x"), (py + 0.0).alias("y"))
    found = F.array(
        F.when(cross, point(1, x, y)), F.when(cross, point(2, x, y)),
        F.when(_on_segment(d1, q1, q2, p1), point(2, *p1)), F.when(_on_segment(d2, q1, q2, p2), point(2, *p2)),
        F.when(_on_segment(d3, p1, p2, q1), point(1, *q1)), F.when(_on_segment(d4, p1, p2, q2), point(1, *q2)))
    return pairs.select(F.explode(F.array_compact(found)).alias("c")).select("c.*")


def _pieces(edges: DataFrame, on: list[str]) -> DataFrame:
    """Edges split at their cuts: ``on, layer, pid, sid, x1, y1, x2, y2`` with the piece's undirected ends ``lo, hi``."""
    at = F.array_sort(F.collect_set(F.struct(*[F.col(c) for c in ("x", "y")])))
    cuts = _cuts(edges, on).groupBy("eid").agg(at.alias("_cuts"))
    joined = edges.join(cuts, "eid", "left")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length = dx * dx + dy * dy
    place = lambda x, y: F.struct((((x - F.col("x1")) * dx + (y - F.col("y1")) * dy) / length).alias("t"),
                                  x.alias("x"), y.alias("y"))
    stops = F.concat(F.array(place(F.col("x1"), F.col("y1")), place(F.col("x2"), F.col("y2"))),
                     F.coalesce(F.transform("_cuts", lambda c: place(c["x"], c["y"])), F.array()))
    stops = F.array_sort(F.array_distinct(stops))
    n = F.size("_stops")
    walk = F.zip_with(F.slice("_stops", 1, n - 1), F.slice("_stops", 2, n - 1), lambda a, b: F.struct(
        a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    split = joined.withColumn("_stops", stops).select(*on, "layer", "pid", "eid", F.posexplode(walk).alias("k", "s"))
    split = split.select(*on, "layer", "pid", F.struct("eid", "k").alias("sid"), "s.*")
    end = lambda i: F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y"))
    return split.withColumns({"lo": F.least(end(1), end(2)), "hi": F.greatest(end(1), end(2))})


def _relations(polygons: DataFrame, pieces: DataFrame, on: list[str]):
    """How pieces lie to other polygons.

    ``shared``: pieces that coincide with a piece of another polygon, with ``same`` direction or
    not. ``inside``: pieces strictly inside another polygon. Both name the other as ``layer2, pid2``.
    """
    forward = (F.col("lo.x") == F.col("x1")) & (F.col("lo.y") == F.col("y1"))
    own = pieces.select(*on, "lo", "hi", "layer", "pid", "sid", forward.alias("f1"))
    others = pieces.select(*on, "lo", "hi", F.col("layer").alias("layer2"), F.col("pid").alias("pid2"), forward.alias("f2"))
    differ = (F.col("layer") != F.col("layer2")) | (F.col("pid") != F.col("pid2"))
    # outlines of layer A are never compared with each other: each keeps its own
    differ = differ & ~((F.col("layer") == "A") & (F.col("layer2") == "A"))
    shared = own.join(others, [*on, "lo", "hi"]).filter(differ).select(
        *on, "layer", "pid", "sid", "layer2", "pid2", (F.col("f1") == F.col("f2")).alias("same"))
    middle = pieces.select(*on, "layer", "pid", "sid", ((F.col("x1") + F.col("x2")) / 2).alias("mx"),
                           ((F.col("y1") + F.col("y2")) / 2).alias("my"))
    targets = polygons.select(*on, F.col("layer").alias("layer2"), F.col("pid").alias("pid2"), "geometry")
    near = candidate_pairs(middle, targets, "mx", "my", on, "geometry").filter(differ)
    inside = near.filter(G.location("_edges", "mx", "my") == 1).select(*on, "layer", "pid", "sid", "layer2", "pid2")
    shared = materialize(shared)
    return shared, materialize(inside.join(shared, [*on, "layer", "pid", "sid", "layer2", "pid2"], "left_anti"))


def _within(pieces: DataFrame, shared: DataFrame, inside: DataFrame, on: list[str], layer: str) -> DataFrame:
    """Pairs ``on, pid, pid2`` of polygons of ``layer`` that lie within one of the other layer.

    All of the boundary runs inside the other (or along it, interiors on the same side), and no
    boundary of the other runs inside.
    """
    pair = [*on, "layer", "pid", "layer2", "pid2"]
    covered = inside.select(*pair, "sid").unionByName(shared.filter("same").select(*pair, "sid")).filter(
        (F.col("layer") == layer) & (F.col("layer2") != layer)).distinct()
    hit = covered.groupBy(*pair).agg(F.count(F.lit(1)).alias("_hit"))
    whole = pieces.filter(F.col("layer") == layer).groupBy(*on, "layer", "pid").agg(F.count(F.lit(1)).alias("_all"))
    full = hit.join(whole, [*on, "layer", "pid"]).filter("_hit = _all")
    pierced = inside.select(*on, F.col("layer2").alias("layer"), F.col("pid2").alias("pid"),
                            F.col("layer").alias("layer2"), F.col("pid").alias("pid2")).distinct()
    return full.join(pierced, pair, "left_anti").select(*on, "pid", "pid2")


def _area2(ring) -> float:
    ox, oy = ring[0]
    return sum((x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy) for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]))


def _holds(ring, px, py) -> bool:
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def _simple_rings(pieces: np.ndarray) -> list:
    """Rings of the directed pieces of one polygon, cut apart wherever a walk meets itself."""
    leaving = {}
    for x1, y1, x2, y2 in pieces.tolist():
        leaving.setdefault((x1, y1), []).append((x2, y2))
    rings = []
    for origin in sorted(leaving):
        while leaving[origin]:
            path, place, at = [origin], {origin: 0}, leaving[origin].pop()
            before = origin
            while True:
                if at in place:  # close the loop and go on with what led to it
                    ring = path[place[at]:]
                    for p in ring[1:]:
                        del place[p]
                    path = path[: place[at] + 1]
                    if len(ring) > 2:
                        rings.append(ring)
                    if len(path) == 1 and not leaving.get(at):
                        break
                else:
                    place[at] = len(path)
                    path.append(at)
                ways = leaving.get(at)
                if not ways:
                    if len(path) > 1:
                        raise ValueError(f"a boundary from {origin} ends at {at} without closing")
                    break
                # the way most to the left keeps the same stretch of interior at hand
                heading = math.atan2(at[1] - before[1], at[0] - before[0])
                bend = lambda q: (math.atan2(q[1] - at[1], q[0] - at[0]) - heading + math.pi) % (2 * math.pi)
                nxt = max(ways, key=lambda q: (bend(q), q))
                ways.remove(nxt)
                before, at = at, nxt
    return rings


@F.pandas_udf(T.ArrayType(G.PARTS))
def stitch(pieces: pd.Series) -> pd.Series:
    """Parts of each polygon, as geometries of one part, from its directed pieces (flat x1, y1, x2, y2 runs).

    A walk that does not close and a hole outside every outline are errors, never dropped. Loops of two points enclose
    nothing.
    """
    return pd.Series([_parts(np.asarray(p).reshape(-1, 4)) for p in pieces])


def _parts(pieces: np.ndarray) -> list:
    rings = [(_area2(r), r) for r in _simple_rings(pieces)]
    shells = sorted(r for r in rings if r[0] > 0)
    parts = [[shell] for _, shell in shells]
    for area, ring in rings:
        if area < 0:
            mx, my = (ring[0][0] + ring[1][0]) / 2, (ring[0][1] + ring[1][1]) / 2
            home = next((part for part in parts if _holds(part[0], mx, my)), None)
            if home is None:
                raise ValueError(f"the hole at {ring[0]} has no outline around it")
            home.append(ring)
    place = lambda p: {"x": p[0], "y": p[1], "z": None}
    return [[[[place(p) for p in (*ring, ring[0])] for ring in part]] for part in parts]


def difference_exploded(a: DataFrame, b: DataFrame, on: list[str] = ()) -> DataFrame:
    """See :func:`harmonise`; plain difference without the containment rules."""
    return _overlay(a, b, list(on), rules=False)


def harmonise(neurons: DataFrame, nonneurons: DataFrame, on: list[str] = ()) -> DataFrame:
    """Neuron polygons freed of overlapping non-neurons: ``on, pid, part, geometry`` and the neurons' other columns.

    Neurons within a non-neuron go. Non-neurons within a neuron that stays are not subtracted
    from anything. All others are subtracted from every neuron; what is left comes as one row
    per part.
    """
    return _overlay(neurons, nonneurons, list(on), rules=True)


def polygons_within(a: DataFrame, b: DataFrame, on: list[str] = ()) -> DataFrame:
    """Inner join ``on, pid, pid2``: polygons of ``a`` that lie within a polygon of ``b``.

    Swap the tables for the join by containment.
    """
    on = list(on)
    _, _, pieces, shared, inside = _arrange(a, b, on)
    pairs = _within(pieces, shared, inside, on, "A")
    copies = _one_per_shape(b, on).select(*on, "geometry", F.col("pid").alias("pid2")).join(
        b.select(*on, "geometry", F.col("pid").cast("string").alias("copy")), [*on, "geometry"])
    return pairs.join(copies, [*on, "pid2"]).select(*on, "pid", F.col("copy").alias("pid2"))


def _one_per_shape(polygons: DataFrame, on: list[str]) -> DataFrame:
    """Each geometry once, under its lowest id: copies of one outline would meet each other in pairs."""
    return polygons.filter(~G.is_empty(F.col("geometry"))).groupBy(*on, "geometry").agg(
        F.min(F.col("pid").cast("string")).alias("pid"))


def _arrange(a: DataFrame, b: DataFrame, on: list[str]):
    """All polygons, those that meet the other layer, their boundary pieces, and how the pieces lie."""
    layer = lambda df, name: df.filter(~G.is_empty(F.col("geometry"))).select(
        *on, F.lit(name).alias("layer"), F.col("pid").cast("string").alias("pid"), "geometry")
    everything = materialize(_boxed_polygons(layer(a, "A").unionByName(layer(_one_per_shape(b, on), "B"))))
    keyed = everything.withColumn("key", F.struct("layer", "pid"))
    meets = grid.overlapping_boxes(keyed, "key", on, _BOX, ["layer"], _levels(everything),
                                   lambda c: c("layer_1") != c("layer_2"))
    active = meets.select(*on, F.explode(F.array("key_1", "key_2")).alias("k")).select(*on, "k.*").distinct()
    # only polygons whose boxes meet one of the other layer take part; the rest stay as they are
    near = materialize(everything.drop(*_BOX).join(active, [*on, "layer", "pid"], "left_semi"))
    edges = materialize(boundary_edges(near, [*on, "layer", "pid"]))
    pieces = materialize(_pieces(edges, on))
    return everything, near, pieces, *_relations(near, pieces, on)


def _overlay(a: DataFrame, b: DataFrame, on: list[str], rules: bool) -> DataFrame:
    everything, near, pieces, shared, inside = _arrange(a, b, on)

    ids = [*on, "layer", "pid"]
    second = lambda df: df.select(*on, F.col("layer").alias("layer2"), F.col("pid").alias("pid2"))
    alive = near.select(*ids)
    if rules:
        gone = _within(pieces, shared, inside, on, "A").select(*on, F.lit("A").alias("layer"), "pid").distinct()
        alive = materialize(alive.join(gone, ids, "left_anti"))
        held = _within(pieces, shared, inside, on, "B").join(
            alive.filter("layer = 'A'").select(*on, F.col("pid").alias("pid2")), [*on, "pid2"], "left_semi")
        alive = materialize(alive.join(held.select(*on, F.lit("B").alias("layer"), "pid").distinct(), ids, "left_anti"))
    live = lambda df: df.join(alive, ids, "left_semi").join(second(alive), [*on, "layer2", "pid2"], "left_semi")
    shared, inside = live(shared), live(inside)
    pieces = pieces.join(alive, ids, "left_semi")

    # own boundary: not inside what is subtracted, nor along it on the same side
    lost = inside.filter("layer = 'A'").select(*on, "sid").unionByName(
        shared.filter("layer = 'A' and layer2 = 'B' and same").select(*on, "sid")).distinct()
    mine = pieces.filter("layer = 'A'").join(lost, [*on, "sid"], "left_anti").select(*on, "pid", "x1", "y1", "x2", "y2")
    # foreign boundary inside: the outline of the union of what is subtracted, walked backwards
    hidden = inside.filter("layer = 'B' and layer2 = 'B'").select(*on, "sid").unionByName(
        shared.filter("layer = 'B' and layer2 = 'B' and (not same or pid > pid2)").select(*on, "sid")).distinct()
    outline = inside.filter("layer = 'B' and layer2 = 'A'").join(hidden, [*on, "sid"], "left_anti")
    theirs = outline.select(*on, "sid", F.col("pid2").alias("pid")).join(
        pieces.select(*on, "sid", "x1", "y1", "x2", "y2"), [*on, "sid"]).select(
        *on, "pid", F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"))

    changed = materialize(outline.select(*on, F.col("pid2").alias("pid")).unionByName(
        pieces.join(lost, [*on, "sid"], "left_semi").select(*on, "pid")).distinct())
    # one row per polygon before the rings are walked: that row is as large as its result geometry
    rows = mine.unionByName(theirs).join(changed, [*on, "pid"], "left_semi").groupBy(*on, "pid").agg(
        F.flatten(F.collect_list(F.array("x1", "y1", "x2", "y2"))).alias("_p"))
    cut = rows.select(*on, "pid", F.posexplode(stitch("_p")).alias("part", "_parts")).select(
        *on, "pid", "part", G.geometry(F.col("_parts")).alias("geometry"))

    # untouched neurons, in parts
    same = everything.filter("layer = 'A'").drop("layer", *_BOX).join(changed, [*on, "pid"], "left_anti")
    if rules:
        same = same.join(gone.select(*on, "pid"), [*on, "pid"], "left_anti")
    same = same.select(*on, "pid", F.posexplode("geometry.parts").alias("part", "_part"))
    out = cut.unionByName(same.select(*on, "pid", "part", G.geometry(F.array("_part")).alias("geometry")))
    rest = [c for c in a.columns if c not in (*on, "pid", "part", "geometry")]
    return out.join(a.select(*on, F.col("pid").cast("string").alias("pid"), *rest), [*on, "pid"], "left") if rest else out


def invalid_polygons(polygons: DataFrame, on: list[str] = ()) -> DataFrame:
    """Ids ``on, pid`` of polygons that are not valid.

    A ring with fewer than four places or no area, edges that cross or overlap, a ring that touches itself, or rings that
    nest or touch wrongly, see :func:`wrongly_nested`. Edges meet only edges of their own polygon, through the grid.
    """
    keys = [*on, "pid"]
    ring = F.explode(G.rings(F.col("geometry"))).alias("ring")
    flat = polygons.select(*keys, ring).filter(
        (F.size("ring") < 4) | (G.ring_moments(F.col("ring"))["area"] == 0)).select(*keys)
    edges = boundary_edges(polygons, keys)
    last = edges.groupBy(*keys, F.col("eid.p").alias("p"), F.col("eid.r").alias("r")).agg(F.max("eid.i").alias("last"))
    edges = materialize(edges.withColumns({"p": F.col("eid.p"), "r": F.col("eid.r"), "i": F.col("eid.i")}).join(
        last, [*keys, "p", "r"]))
    carry = ["p", "r", "i", "last", "x1", "y1", "x2", "y2"]
    pairs = grid.overlapping_boxes(edges, "eid", keys, _BOX, carry, _levels(edges))
    (p1, p2), (q1, q2) = _ends(1), _ends(2)
    d1, d2, d3, d4 = _turn(q1, q2, p1), _turn(q1, q2, p2), _turn(p1, p2, q1), _turn(p1, p2, q2)
    meets = [(_on_segment(d1, q1, q2, p1), p1), (_on_segment(d2, q1, q2, p2), p2), (_on_segment(d3, p1, p2, q1), q1), (_on_segment(d4, p1, p2, q2), q2)]
    place = lambda c, at: F.when(c, F.struct((at[0] + 0.0).alias("x"), (at[1] + 0.0).alias("y")))
    touch = F.array_distinct(F.array_compact(F.array(*[place(c, at) for c, at in meets])))
    cross = _opposite(d1, d2) & _opposite(d3, d4)
    one_ring = (F.col("p_1") == F.col("p_2")) & (F.col("r_1") == F.col("r_2"))
    gap = F.abs(F.col("i_1") - F.col("i_2"))
    neighbours = one_ring & ((gap == 1) | (gap == F.col("last_1")))
    # neighbours share one corner; straight edges with two places in common run along each other
    bad = cross | (F.size(touch) > F.when(one_ring & ~neighbours, 0).otherwise(1))
    found = pairs.select(*keys, *[c for side in (1, 2) for c in (f"p_{side}", f"r_{side}")], bad.alias("bad"),
                         F.when(~one_ring, touch).alias("touch"))
    found = materialize(found.filter(F.col("bad") | (F.size("touch") > 0)))
    wrong = found.filter("bad").select(*keys).unionByName(flat).distinct()
    touches = found.filter("not bad").select(*keys, *[c for side in (1, 2) for c in (f"p_{side}", f"r_{side}")], F.explode("touch").alias("at"))
    return wrong.unionByName(wrongly_nested(polygons, touches, on)).distinct()


def wrongly_nested(polygons: DataFrame, touches: DataFrame, on: list[str] = ()) -> DataFrame:
    """Ids ``on, pid`` of polygons whose rings don't cross and yet make no valid polygon.

    A hole outside its shell or in another hole, a shell inside another part but not in a hole of it, and rings of a part
    that touch in so many places that they part its interior. ``touches`` are places ``at`` where two rings meet.

    Most outlines are single rings and take no part. For the others, places of one ring that lie on no other ring are
    located in the other rings by a point join; one place speaks for a ring that touches none.
    """
    keys = [*on, "pid"]
    ring = [*keys, "p", "r"]
    several = polygons.filter(F.size(F.flatten(F.col("geometry.parts"))) > 1)
    parts = several.select(*keys, F.posexplode("geometry.parts").alias("p", "part"))
    rings = materialize(parts.select(*keys, "p", F.posexplode("part").alias("r", "ring")))
    each = lambda side: touches.select(*keys, F.col(f"p_{side}").alias("p"), F.col(f"r_{side}").alias("r"), "at")
    met = materialize(each(1).unionByName(each(2)).distinct())

    middle = F.transform(G.ring_edges(F.col("ring")), lambda e: F.struct(((e["x1"] + e["x2"]) / 2 + 0.0).alias("x"), ((e["y1"] + e["y2"]) / 2 + 0.0).alias("y")))
    corners = F.transform("ring", lambda v: F.struct((v["x"] + 0.0).alias("x"), (v["y"] + 0.0).alias("y")))
    places = rings.select(*ring, F.explode(F.array_distinct(F.concat(corners, middle))).alias("at")).join(met, [*ring, "at"], "left_anti")
    touching = met.select(*ring).distinct().withColumn("touching", F.lit(True))
    # any place of a ring apart, all places of a ring that touches others
    apart = rings.select(*ring, F.struct((F.col("ring")[0]["x"] + 0.0).alias("x"), (F.col("ring")[0]["y"] + 0.0).alias("y")).alias("at")).join(touching, ring, "left_anti")
    places = apart.unionByName(places.join(touching, ring, "left_semi").select(*apart.columns))
    places = materialize(places.select(*ring, F.col("at.x").alias("_x"), F.col("at.y").alias("_y")))
    targets = rings.select(*keys, F.col("p").alias("p2"), F.col("r").alias("r2"), G.polygon(F.col("ring")).alias("geometry"))
    hits = points_within(places, targets, "_x", "_y", keys).filter("p != p2 or r != r2")
    seen = hits.groupBy(*ring, "_x", "_y", "p2").agg(F.max(F.col("r2") == 0).alias("in_shell"), F.max(F.col("r2") > 0).alias("in_hole"))
    seen = materialize(seen)
    elsewhere = seen.filter("(p = p2 and r > 0 and in_hole) or (p != p2 and r = 0 and in_shell and not in_hole)")
    held = seen.filter("p = p2 and in_shell").select(*ring, "_x", "_y")
    loose = places.filter("r > 0").join(held, [*ring, "_x", "_y"], "left_anti")
    # a ring whose every place lies on others
    hidden = touching.join(places.select(*ring).distinct(), ring, "left_anti")

    # rings and the places where they touch are a graph; a circle in it cuts a piece off the interior
    in_part = touches.filter("p_1 = p_2")
    ends = in_part.select(*keys, F.col("p_1").alias("p"), F.explode(F.array("r_1", "r_2")).alias("r"), "at").distinct()

    def circles(frame: pd.DataFrame) -> pd.DataFrame:
        above: dict = {}

        def top(n):
            while above.setdefault(n, n) != n:
                above[n] = n = above[above[n]]
            return n

        for r, at in zip(frame["r"], frame["at"]):
            a, b = top(("ring", r)), top((at["x"], at["y"]))
            if a == b:
                return frame[keys].iloc[:1]
            above[a] = b
        return frame[keys].iloc[:0]

    # a group is the touches of one part, no larger than its geometry value
    cut_off = ends.groupBy(*keys, "p").applyInPandas(circles, T.StructType([polygons.schema[k] for k in keys]))
    return elsewhere.select(*keys).unionByName(loose.select(*keys)).unionByName(hidden.select(*keys)).unionByName(cut_off)


def valid_only(polygons: DataFrame, on: list[str] = ()) -> DataFrame:
    """Polygons that are neither empty nor invalid."""
    kept = polygons.filter(~G.is_empty(F.col("geometry")))
    return kept.join(invalid_polygons(kept, on), [*on, "pid"], "left_anti")
