"""Threads of links, the choice of links per thread, and the chains they form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceweave.session import materialize


def thread_links(edges: DataFrame) -> DataFrame:
    """Links with the head of their thread and their place in it: ``a, b, dist, ct, head, hop``.

    Every cell has at most one link to each side, so threads are paths. Each link finds its head
    by pointer doubling: after k rounds a link knows the link 2^k steps before it, so a thread
    over n sections takes log2(n) joins.
    """
    links = edges.select("a", "b", "dist", "ct")
    before = links.select(F.col("b").alias("a"), F.col("a").alias("_p"), "ct")
    state = links.join(before, ["a", "ct"], "left").select(
        "a", F.coalesce("_p", "a").alias("ptr"), F.col("_p").isNotNull().cast("long").alias("hop"))
    state = materialize(state)
    rounds = 0
    while True:
        nxt = state.select(F.col("a").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("hop").alias("_hop"))
        joined = state.join(nxt, "ptr", "left").select(
            "a", F.coalesce("_ptr", "ptr").alias("ptr"), (F.col("hop") + F.coalesce("_hop", F.lit(0))).alias("hop"),
            (F.coalesce("_hop", F.lit(0)) > 0).alias("_moved"))
        state = materialize(joined)
        rounds += 1
        if state.filter("_moved").isEmpty():
            break
        if rounds > 60:
            raise ValueError("links form a cycle; they must go from one section to the next")
        state = state.drop("_moved")
    return links.join(state.select("a", F.col("ptr").alias("head"), "hop"), "a")


def threads(edges: DataFrame) -> DataFrame:
    """One row per thread: ``ct, head, cells, dists``; a thread has at most one cell per section."""
    placed = thread_links(edges)
    rows = placed.groupBy("ct", "head").agg(F.array_sort(F.collect_list(F.struct("hop", "a", "b", "dist"))).alias("_l"))
    cells = F.concat(F.array(F.col("_l")[0]["a"]), F.transform("_l", lambda s: s["b"]))
    return rows.select("ct", "head", cells.alias("cells"), F.transform("_l", lambda s: s["dist"]).alias("dists"))


def choose_links(thread_table: DataFrame, radius: float = 30.0, max_sections: int = 3) -> DataFrame:
    """Add ``picks``: the links kept per thread.

    The choice maximises the sum of ``radius - dist`` with at most ``max_sections - 1`` kept
    links in a row. Folding over the links, the state holds the best score and picks for every
    length of the trailing run; equal scores keep the shorter run.
    """
    most = max_sections - 1
    dead = -1e18
    no_picks = F.expr("cast(array() as array<boolean>)")
    entry = lambda score, picks: F.struct(score.alias("score"), picks.alias("picks"))
    start = F.array(*[entry(F.lit(0.0 if c == 0 else dead), no_picks) for c in range(most + 1)])

    def first_best(state):
        best = F.array_max(F.transform(state, lambda s: s["score"]))
        return F.filter(state, lambda s: s["score"] == best)[0]

    def step(state, dist):
        top = first_best(state)
        skip = entry(top["score"], F.concat(top["picks"], F.array(F.lit(False))))
        taken = F.transform(
            F.slice(state, 1, most),
            lambda s: entry(F.when(s["score"] == dead, F.lit(dead)).otherwise(s["score"] + (F.lit(float(radius)) - dist)),
                            F.concat(s["picks"], F.array(F.lit(True)))))
        return F.concat(F.array(skip), taken)

    return thread_table.withColumn("picks", F.aggregate("dists", start, step, lambda s: first_best(s)["picks"]))


def selected_links(chosen: DataFrame) -> DataFrame:
    """The kept links as ``a, b, dist, ct``."""
    link = F.explode(F.filter(F.transform("picks", lambda p, i: F.struct(
        p.alias("p"), F.col("cells")[i].alias("a"), F.col("cells")[i + 1].alias("b"), F.col("dists")[i].alias("dist"))),
        lambda s: s["p"]))
    return chosen.select("ct", link.alias("l")).select("l.a", "l.b", "l.dist", "ct")


def chains(chosen: DataFrame) -> DataFrame:
    """Connected runs of kept links as sorted position lists: ``chain`` (its lowest position), ``members``."""
    # cells after a link that was not kept start a new run
    empty = F.expr("cast(array() as array<array<bigint>>)")
    first = F.array(F.array(F.col("cells")[0].cast("long")))

    def step(acc, link):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, F.array(link["b"].cast("long")))))
        return F.when(link["p"], joined).otherwise(F.concat(acc, F.array(F.array(link["b"].cast("long")))))

    steps = F.transform("picks", lambda p, i: F.struct(p.alias("p"), F.col("cells")[i + 1].alias("b")))
    runs = F.aggregate(steps, F.concat(empty, first), step)
    long_enough = F.filter(runs, lambda r: F.size(r) >= 2)
    out = chosen.select(F.explode(long_enough).alias("members")).withColumn("members", F.array_sort("members"))
    return out.select(F.col("members")[0].alias("chain"), "members")
