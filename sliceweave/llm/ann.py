"""Approximate nearest neighbours: stable projections, a kd-tree over them, and a chi-square stopping test."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceweave.llm.vectors import FOUND, clean, matrix, merged, open_block, packed, width_of
from sliceweave.session import materialize

#: Rows of the bounded sample from which the tree's planes are taken; every row is filed in the tree.
TREE_SAMPLE = 20_000
#: Squared projected distances below this share of a query's own squared length may be rounding; copies of a vector meet so.
ROUNDING = 1e-9


def chi_square_cdf(x: float, dims: int) -> float:
    """P(chi-square of an even number of dimensions <= x)."""
    half, term, total = x / 2, 1.0, 0.0
    for i in range(dims // 2):
        term = term * half / i if i else 1.0
        total += term
    return 1.0 - math.exp(-half) * total


def chi_square_point(p: float, dims: int) -> float:
    lo, hi = 0.0, 10.0 * dims + 100.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, dims) < p else (lo, mid)
    return hi


def tree_planes(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """A kd-tree as a heap of (axis, cut): nodes split at the median of their widest axis. Node 0 is the root."""
    planes: list[tuple[int, float]] = [(0, math.inf)] * (2 ** depth - 1)

    def split(node: int, part: np.ndarray) -> None:
        if node >= len(planes) or not len(part):
            return
        axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        cut = float(np.median(part[:, axis]))
        planes[node] = (axis, cut)
        split(2 * node + 1, part[part[:, axis] <= cut])
        split(2 * node + 2, part[part[:, axis] > cut])

    split(0, points)
    return planes


def leaf_of(points: np.ndarray, planes: list[tuple[int, float]], depth: int) -> np.ndarray:
    """Leaf numbers from left to right."""
    node = np.zeros(len(points), dtype=np.int64)
    axes, cuts = np.array([a for a, _ in planes] or [0]), np.array([c for _, c in planes] or [math.inf])
    for _ in range(depth):
        right = points[np.arange(len(points)), axes[node]] > cuts[node]
        node = 2 * node + 1 + right
    return node - (2 ** depth - 1)


def _visit(width: int, planes: np.ndarray, k: int, reach: float):
    """Search one block for one pack: its points come by projected distance, and a query stops when the test holds."""
    def visit(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                ids, rows, m = open_block(r.ids, r.rows, r.mat, width)
                q_ids, q_rows, q = open_block(r.q_ids, r.q_rows, r.q_mat, width)
                limits = np.frombuffer(r.limits, dtype="<f8") if r.limits is not None else np.full(len(q), np.inf)
                near = m @ planes
                for i in range(len(q)):
                    here = q[i] @ planes
                    gaps = near - here
                    gaps = np.einsum("ij,ij->i", gaps, gaps) - ROUNDING * (here @ here)
                    order = np.argsort(gaps, kind="stable")
                    order = order[rows[order] != q_rows[i]]
                    sorted_gaps = gaps[order]
                    best_d, best_at, limit, at = np.zeros(0), np.zeros(0, dtype=np.int64), limits[i], 0
                    while at < len(order):
                        # stop: all points left are farther in the projection than a nearer neighbour would be
                        stop = np.searchsorted(sorted_gaps, limit * reach, side="right")
                        part = order[at:min(stop, at + 4 * k + at)]
                        if not len(part):
                            break
                        at += len(part)
                        diff = m[part] - q[i]
                        dist = np.einsum("ij,ij->i", diff, diff)
                        best_d, best_at = np.concatenate([best_d, dist]), np.concatenate([best_at, part])
                        keep = np.lexsort((rows[best_at], ids[best_at], best_d))[:k]
                        best_d, best_at = best_d[keep], best_at[keep]
                        if len(best_d) == k:
                            limit = min(limit, best_d[-1])
                    out.append(pd.DataFrame({"qrow": q_rows[i], "query_id": q_ids[i], "vec_id": ids[best_at], "row": rows[best_at], "score": np.sqrt(best_d)}))
            if out:
                yield pd.concat(out)

    return visit


def nearest_neighbours(vectors: DataFrame, k: int = 10, every: int = 100, dims: int = 8, sure: float = 0.98, id_col: str = "vec_id",
                       vec_col: str = "embedding", block: int = 1024, pack: int = 32, seed: int = 7) -> DataFrame:
    """For each query row (id divisible by ``every``) its ``k`` nearest other rows found: query_id, rank, vec_id, score.

    Score is the Euclidean distance of the original vectors in double precision; ties go to the smaller id. Vectors that are
    null, zero, or hold null or non-finite components take no part; shorter ones count as if zeros followed; a null id is
    never a query and stands as -1. Repeated rows are candidates and queries of their own. An empty table gives no rows.

    Gaussian projections to ``dims`` dimensions (even) keep distances in distribution: a projected squared distance over the
    true one is chi-square. A kd-tree, its planes from a bounded sample, files every row; leaves are cut into blocks with
    their boxes, so no leaf is too large. A pack of neighbouring queries first searches the block whose box is
    nearest. After that a block is visited only if its box is nearer than the test allows for the distance
    found so far, and points in it are verified by rising projected distance until the test holds: a true neighbour nearer
    than the k-th found one would lie farther out in the projection with probability below 1 - ``sure``.
    """
    nonzero = lambda v: F.exists(v, lambda x: x != 0)
    rows = materialize(clean(vectors, id_col, vec_col, nonzero).withColumn("row", F.monotonically_increasing_id()))
    width = max(width_of(rows), 1)
    planes = np.random.default_rng(seed).standard_normal((width, dims))
    total = rows.count()
    share = min(1.0, TREE_SAMPLE / max(total, 1))
    # the tree only steers the search; a sample by hash is the same in every run
    sample = rows.filter(F.pmod(F.xxhash64("id", "row"), F.lit(1_000_000)) < int(math.ceil(share * 1_000_000))).select("vec")
    points = matrix(sample.toPandas()["vec"].to_numpy(), width) @ planes
    depth = max(0, min(16, math.ceil(math.log2(max(total, 1) / block)))) if total > block else 0
    cuts = tree_planes(points, depth)

    def file(frames):
        for frame in frames:
            frame["leaf"] = leaf_of(matrix(frame["vec"].to_numpy(), width) @ planes, cuts, depth)
            yield frame

    filed = materialize(rows.mapInPandas(file, "id long, vec array<double>, row long, leaf long"))
    spread = filed.withColumn("mixed", F.xxhash64("row"))
    project = lambda m: m @ planes
    blocks = packed(spread, ["leaf", "mixed"], block, width, project)
    packs = packed(spread.filter(F.col("id") % every == 0), ["leaf", "mixed"], pack, width, project).select(
        F.col("block").alias("pack"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("mat").alias("q_mat"),
        F.col("low").alias("q_low"), F.col("high").alias("q_high"))
    count = blocks.count()
    if not count:
        return spark_empty(vectors)
    reach = chi_square_point(sure, dims)
    visit = _visit(width, planes, k, reach)

    # squared distance of the boxes of a pack and a block, for every pair of their numbers
    pairs = packs.select("pack", "q_low", "q_high", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("block"))
    pairs = pairs.join(blocks.select("block", "low", "high"), "block")
    outside = F.zip_with(F.zip_with("low", "q_high", lambda a, b: a - b), F.zip_with("q_low", "high", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    gap = F.aggregate(outside, F.lit(0.0), lambda s, x: s + x * x)
    middle = F.aggregate(F.zip_with(F.zip_with("low", "high", lambda a, b: a + b), F.zip_with("q_low", "q_high", lambda a, b: a + b), lambda a, b: a - b),
                         F.lit(0.0), lambda s, x: s + x * x)
    pairs = materialize(pairs.select("pack", "block", gap.alias("gap"), middle.alias("middle")))
    nearest = pairs.groupBy("pack").agg(F.min(F.struct("gap", "middle", "block")).alias("a"))
    start = materialize(nearest.select("pack", F.col("a.block").alias("block")))
    queries = packs.drop("q_low", "q_high")
    bodies = blocks.drop("low", "high", "n")
    first = start.join(queries, "pack").join(bodies, "block").withColumn("limits", F.lit(None).cast("binary"))
    found = materialize(first.drop("pack", "block").mapInPandas(visit, FOUND))
    nearest_k = merged(found, k, [F.asc("score"), F.asc("vec_id"), F.asc("row")]).filter(F.col("rank") == k)
    limits = nearest_k.select("qrow", (F.col("score") * F.col("score")).alias("limit"))

    def own(frames):
        for frame in frames:
            yield pd.DataFrame([(r.pack, int(x)) for r in frame.itertuples(index=False) for x in np.frombuffer(r.q_rows, dtype="<i8")], columns=["pack", "qrow"])

    known = packs.select("pack", "q_rows").mapInPandas(own, "pack long, qrow long").join(limits, "qrow")
    known = known.groupBy("pack").agg(F.collect_list(F.struct("qrow", "limit")).alias("known"))

    def with_limits(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                got = {f["qrow"]: f["limit"] for f in r.known} if r.known is not None else {}
                limit = np.array([got.get(int(x), np.inf) for x in np.frombuffer(r.q_rows, dtype="<i8")]) * (1 + 1e-9)
                here = np.frombuffer(r.q_mat, dtype="<f8").reshape(len(limit), width) @ planes
                far = limit * reach + ROUNDING * np.einsum("ij,ij->i", here, here)
                out.append((r.pack, r.q_ids, r.q_rows, r.q_mat, limit.astype("<f8").tobytes(), float(far.max())))
            yield pd.DataFrame(out, columns=["pack", "q_ids", "q_rows", "q_mat", "limits", "farthest"])

    ready = materialize(queries.join(known, "pack", "left").mapInPandas(
        with_limits, "pack long, q_ids binary, q_rows binary, q_mat binary, limits binary, farthest double"))
    rest = pairs.join(start, ["pack", "block"], "left_anti").join(ready, "pack").filter(F.col("gap") <= F.col("farthest"))
    more = rest.select("block", "q_ids", "q_rows", "q_mat", "limits").join(bodies, "block")
    found = found.unionByName(more.drop("block").mapInPandas(visit, FOUND))
    best = merged(found, k, [F.asc("score"), F.asc("vec_id"), F.asc("row")])
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def spark_empty(vectors: DataFrame) -> DataFrame:
    return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
