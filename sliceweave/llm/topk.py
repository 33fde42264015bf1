"""Exact top-k inner products: vectors by falling length, rotated partial sums, Cauchy-Schwarz bounds."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceweave.llm.common import with_prefix_sums
from sliceweave.llm.vectors import FOUND, PACK, BLOCK, clean, matrix, merged, moments, open_block, packed, width_of
from sliceweave.session import materialize


#: Up to here sums of whole products are exact in doubles.
EXACT = 2.0 ** 53


def whole_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact at any size."""
    q = [int(x) for x in query]
    return np.array([sum(int(x) * y for x, y in zip(v, q)) for v in vectors], dtype=object)


def top_scores(ids, rows, vectors, lengths, turned, qid, qrow, query, length, q_turned, floor, k, cuts, whole=False):
    """The ``k`` best candidates of one block for one query, as (score, id, row); scores under ``floor`` may be missing.

    Candidates come by falling length. Partial sums over the first ``cut`` rotated components plus the product of the
    residual lengths bound the score; a candidate whose bound stays under the floor is dropped before the next cut. What is
    left is scored on the original vectors, ``whole`` ones in exact integers. The floor itself is never dropped, so ties
    survive.
    """
    slack = 1e-9 * (1.0 + length * (lengths[0] if len(lengths) else 0.0))
    alive = np.arange(np.searchsorted(-lengths * length, -(floor - slack), side="right"))
    for cut in cuts:
        if not len(alive):
            break
        part = turned[alive, :cut] @ q_turned[:cut]
        rest = np.sqrt(np.maximum(lengths[alive] ** 2 - np.einsum("ij,ij->i", turned[alive, :cut], turned[alive, :cut]), 0))
        q_rest = np.sqrt(max(length ** 2 - q_turned[:cut] @ q_turned[:cut], 0))
        alive = alive[part + rest * q_rest >= floor - slack]
    alive = alive[rows[alive] != qrow]
    scores = vectors[alive] @ query
    near = scores >= floor - slack
    keep, scores = alive[near], scores[near]
    if whole and length * (lengths[0] if len(lengths) else 0.0) >= EXACT:
        if len(keep) > k:
            # rounding hides no more than the slack
            near = scores >= np.partition(scores, -k)[-k] - slack
            keep, scores = keep[near], scores[near]
        scores = whole_scores(vectors[keep], query)
        best = sorted(range(len(keep)), key=lambda i: (-scores[i], ids[keep[i]], rows[keep[i]]))[:k]
        return scores[best], ids[keep[best]], rows[keep[best]]
    best = np.lexsort((rows[keep], ids[keep], -scores))[:k]
    return scores[best], ids[keep[best]], rows[keep[best]]


def _visit(width: int, turn: np.ndarray, k: int, cuts: list[int], whole: bool):
    def visit(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                ids, rows, m = open_block(r.ids, r.rows, r.mat, width)
                lengths = np.sqrt(np.einsum("ij,ij->i", m, m))
                order = np.argsort(-lengths, kind="stable")
                ids, rows, m, lengths = ids[order], rows[order], m[order], lengths[order]
                turned = m @ turn
                q_ids, q_rows, q = open_block(r.q_ids, r.q_rows, r.q_mat, width)
                q_turned, q_lengths = q @ turn, np.sqrt(np.einsum("ij,ij->i", q, q))
                floors = np.frombuffer(r.floors, dtype="<f8") if r.floors is not None else np.full(len(q), -np.inf)
                for i in range(len(q)):
                    s, v, w = top_scores(ids, rows, m, lengths, turned, q_ids[i], q_rows[i], q[i], q_lengths[i], q_turned[i], floors[i], k, cuts, whole)
                    score = [Decimal(int(x)) for x in s] if whole else s
                    out.append(pd.DataFrame({"qrow": q_rows[i], "query_id": q_ids[i], "vec_id": v, "row": w, "score": score}))
            if out:
                yield pd.concat(out)

    return visit


def top_inner_products(vectors: DataFrame, queries: DataFrame | None = None, k: int = 5, every: int = 50, id_col: str = "vec_id",
                       vec_col: str = "embedding", block: int = BLOCK, pack: int = PACK, whole: bool = False) -> DataFrame:
    """For each query row its ``k`` greatest inner products among all other rows: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by ``every``, or those for which the column expression ``queries`` holds.
    Ties go to the smaller id. Vectors that are null or hold null or non-finite components take no part; shorter vectors
    count as if zeros followed; a null id is never a query and stands as -1. A repeated row is a candidate and a query of
    its own. An empty table gives no rows. Other columns are not read. With ``whole`` all components are whole numbers and
    scores are exact, as decimals of 38 digits.

    Candidates stand in blocks by falling length, queries in packs. The first block gives every query a floor; after that a
    pack meets only blocks whose longest vector could still reach a floor. Inside, rotation onto the principal axes (of a
    width x width moment matrix, summed by the tasks) makes short partial sums tell most, and Cauchy-Schwarz bounds what is
    left. Each pair of pack and block gives ``k`` rows a query at most.
    """
    rows = clean(vectors, id_col, vec_col)
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    width = width_of(rows)
    if not width:
        rows = rows.withColumn("vec", F.array(F.lit(0.0)))
        width = 1
    turn = np.linalg.eigh(moments(rows, width))[1][:, ::-1].copy()
    cuts = [c for c in (8, 24) if c < width]
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    long_first = rows.withColumn("shortness", -length)
    norms = lambda m: np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
    blocks = packed(long_first, ["shortness", "id", "row"], block, width, norms)
    asked = long_first.filter(F.col("id") % every == 0) if queries is None else long_first.filter(queries)
    packs = packed(asked, ["shortness", "id", "row"], pack, width, norms).select(
        F.col("block").alias("pack"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("mat").alias("q_mat"))
    visit = _visit(width, turn, k, cuts, whole)
    schema = FOUND.replace("score double", "score decimal(38,0)") if whole else FOUND

    # the first block alone, of at most ``block`` rows, goes to every pack
    every_pack = packs.select("*", F.lit(None).cast("binary").alias("floors"), F.lit(0).cast("long").alias("block"))
    first = every_pack.join(F.broadcast(blocks.filter("block = 0").drop("low", "high", "n")), "block")
    found = materialize(first.drop("pack", "block").mapInPandas(visit, schema))
    floors = merged(found, k, [F.desc("score"), F.asc("vec_id"), F.asc("row")]).filter(F.col("rank") == k).select("qrow", F.col("score").cast("double").alias("floor"))

    # floors go back into the packs, in the order of their rows
    def with_floors(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                q = np.frombuffer(r.q_rows, dtype="<i8")
                m = np.frombuffer(r.q_mat, dtype="<f8").reshape(len(q), width)
                known = {f["qrow"]: f["floor"] for f in r.known if f["qrow"] is not None} if r.known is not None else {}
                floor = np.array([known.get(int(x), -np.inf) for x in q])
                sizes = np.sqrt(np.einsum("ij,ij->i", m, m))
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(floor <= 0, 0.0, floor / sizes)
                out.append((r.pack, r.q_ids, r.q_rows, r.q_mat, floor.astype("<f8").tobytes(), float(np.nanmin(need)) * (1 - 1e-9)))
            yield pd.DataFrame(out, columns=["pack", "q_ids", "q_rows", "q_mat", "floors", "need"])

    # each pack's own queries: as many rows as a pack holds
    def spread(frames):
        for frame in frames:
            yield pd.DataFrame([(r.pack, int(x)) for r in frame.itertuples(index=False) for x in np.frombuffer(r.q_rows, dtype="<i8")], columns=["pack", "qrow"])

    own = packs.select("pack", "q_rows").mapInPandas(spread, "pack long, qrow long").join(floors, "qrow")
    own = own.groupBy("pack").agg(F.collect_list(F.struct("qrow", "floor")).alias("known"))
    ready = materialize(packs.join(own, "pack", "left").mapInPandas(with_floors, "pack long, q_ids binary, q_rows binary, q_mat binary, floors binary, need double"))
    # packs and blocks on one falling line of lengths: before a pack stand the blocks that can reach it
    line = ready.select("pack", F.col("need").alias("at"), F.lit(0).cast("long").alias("is_block")).unionByName(
        blocks.select(F.lit(None).cast("long").alias("pack"), F.element_at("high", 1).alias("at"), F.lit(1).cast("long").alias("is_block")))
    line = line.withColumns({"fall": -F.col("at"), "later": 1 - F.col("is_block")})
    reached = with_prefix_sums(line, [], ["fall", "later"], "is_block", "reached").filter("pack is not null and reached > 1")
    wanted = reached.select("pack", F.explode(F.sequence(F.lit(1).cast("long"), F.col("reached") - 1)).alias("block"))
    pairs = wanted.join(ready.drop("need"), "pack").join(blocks.drop("low", "high", "n"), "block")
    found = found.unionByName(pairs.drop("pack", "block").mapInPandas(visit, schema))
    best = merged(found, k, [F.desc("score"), F.asc("vec_id"), F.asc("row")])
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
