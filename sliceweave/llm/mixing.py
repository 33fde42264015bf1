"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceweave.llm.common import WORD, as_rows, field, with_prefix_sums
from sliceweave.operators.position import with_position
from sliceweave.session import materialize


def size_of(text):
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], budget: float, repeats: int) -> DataFrame:
    """Targets of the rows (source, source_size): shares of ``budget`` times all sizes by weight, none above ``repeats`` sizes.

    Sources in order of code points, null last, take the weights in turn. What a full source cannot take goes to the others
    by weight, until none is above its limit; each round is one sum over the source table, and only the two sums reach the
    driver.
    """
    ordered = with_position(sizes.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "rank")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    table = materialize(ordered.select("source", "source_size", "rank", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")).alias("weight"),
                                       (F.col("source_size") * float(repeats)).alias("limit")))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, None
    while True:
        over = (F.col("weight") * level > F.col("limit")) if full is not None else F.lit(False)
        sums = table.agg(F.count_if(over), F.sum(F.when(over, F.col("limit")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if sums[0] == full or not sums[2]:
            break
        full, level = sums[0], (budget * total - sums[1]) / sums[2]
    return table.withColumn("target", F.least("limit", F.col("weight") * level)).drop("limit")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, repeats: int = 2, seed: int = 42,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with size, source_size, target and copies: how often the mix takes the document (0 to ``repeats``).

    A source's documents stand in the order of a hash of id and text under ``seed``, and again for every repeat. A document
    finishes at the source's words so far over the source's target; the mix takes documents in order of finish until the
    budget, which is the sum of the targets, is used up. So every source ends within about one document of its target.

    Narrow rows alone are shuffled: running sums within sources, then over the whole queue, both range-partitioned, so one
    source may hold any share of the rows. The cut becomes a last hash for each source and repeat, and the
    documents are compared with it where they are.

    A null text has size 0; documents of size 0 are never taken and need no place in the queue. Null ids and sources are
    values like others. Rows alike in source, id and text stand or fall together. An empty table gives no rows. Columns named
    like the added ones are replaced.
    """
    added = ("size", "source_size", "target", "copies")
    rows = _mixed(docs, weights, budget, repeats, seed, id_col, text_col, source_col)
    return rows.select(*[field(c).alias(c) for c in docs.columns if c not in added or c in (id_col, text_col, source_col)], *added)


def _mixed(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, repeats: int = 2, seed: int = 42,
           id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """See :func:`mix`; the rows of ``docs`` are in one column ``row``."""
    keyed = as_rows(docs).withColumns({"size": size_of(field(text_col)), "_key": F.xxhash64(F.lit(seed), field(id_col), field(text_col))})
    narrow = materialize(keyed.select(field(source_col).alias("source"), "_key", "size"))
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = materialize(source_targets(sizes, weights, budget, repeats))
    total = sources.agg(F.sum("target")).first()[0] or 0.0

    units = narrow.filter("size > 0").groupBy("source", "_key").agg(F.sum("size").alias("size"))
    run = with_prefix_sums(units, ["source"], ["_key"], "size", "sofar")
    s = sources.select(F.col("source").alias("_source"), "rank", "source_size", "target")
    turns = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    queue = run.join(s, F.col("source").eqNullSafe(F.col("_source"))).select("rank", "_key", "size", "sofar", "source_size", "target", turns.alias("turn"))
    queue = queue.select("rank", "_key", "size", "turn", ((F.col("turn") * F.col("source_size") + F.col("sofar")) / F.col("target")).alias("finish"),
                         (F.col("turn") * F.col("source_size") + F.col("sofar")).alias("served"))
    queue = with_prefix_sums(queue, [], ["finish", "rank", "served"], "size", "queued").filter(F.col("queued") <= total)
    last = queue.groupBy("rank").pivot("turn", list(range(repeats))).agg(F.max("_key"))
    last = last.select("rank", F.array(*[F.col(str(i)) for i in range(repeats)]).alias("_last"))
    cuts = materialize(sources.join(last, "rank", "left").select(F.col("source").alias("_source"), "source_size", "target", "_last"))

    joined = keyed.join(cuts, field(source_col).eqNullSafe(F.col("_source")), "left")
    taken = F.aggregate("_last", F.lit(0), lambda n, k: n + F.when(F.col("_key") <= k, 1).otherwise(0))
    copies = F.when(F.col("size") > 0, F.coalesce(taken, F.lit(0))).otherwise(0)
    return joined.select("row", "size", "source_size", "target", copies.alias("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every taken document as often as it is taken, with the columns of ``docs``, whatever their names."""
    mixed = _mixed(docs, **options).filter("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
