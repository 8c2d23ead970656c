"""Chains of single successors followed to their ends by pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.closure import held


def final_successor(edges: DataFrame, going: DataFrame | None = None) -> DataFrame:
    """node, final, cycle: following the smallest successor as long as there is one.

    edges has node, successor; going (node), if given, has the nodes that go on at all: any other node ends a
    chain although it has a successor. A chain that runs into a cycle ends at the first node it meets twice: a
    node of the cycle at itself, one before it where it enters; cycle marks both. One row per node that goes on;
    rows with a null end are ignored, repeated rows count once.

    Every round doubles the steps a pointer covers, so a chain of n nodes takes log2(n) rounds. No path is kept:
    distances along a chain have no gaps, so a round that ends no chain has only cycles left. Jumping on until
    the pointers' targets no longer grow fewer leaves just the nodes of the cycles, and with these as ends the
    nodes before them are an ordinary round of chains.
    """
    step = edges.where("node is not null and successor is not null").groupBy("node").agg(F.min("successor").alias("at"))
    if going is not None:
        step = step.join(going.select("node").distinct(), "node", "left_semi")
    step = held(step, "chains")
    ended, open_ = _ends(step)
    if open_ is None:
        return ended.withColumn("cycle", F.lit(False))
    on_cycle = _cycle_nodes(open_)
    before = step.join(open_.select("node").hint("merge"), "node", "left_semi").join(on_cycle.hint("merge"), "node", "left_anti")
    entered, _ = _ends(held(before, "chains"))
    out = ended.withColumn("cycle", F.lit(False))
    for more in (on_cycle.withColumn("final", F.col("node")), entered):
        out = out.unionByName(more.withColumn("cycle", F.lit(True)))
    return out


def _jump(rows: DataFrame, over: DataFrame) -> DataFrame:
    """node, at, through: each pointer of rows moved on by the pointer of its target, if that has one in over."""
    onward = over.select(F.col("node").alias("at"), F.col("at").alias("_next"), *[c for c in over.columns if c == "open"])
    return rows.select("node", "at").join(onward.hint("merge"), "at", "left")


def _ends(step: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(node, final of the chains that end; node, at of what runs into a cycle, None if nothing does)."""
    known = held(_jump(step, step.withColumn("open", F.lit(True))).select("node", "at", F.col("open").isNotNull().alias("open")), "chains")
    ended = known.where("not open").select("node", F.col("at").alias("final"))
    left = (open_ := known.where("open")).count()
    while left:
        lookup = open_.unionByName(ended.select("node", F.col("final").alias("at"), F.lit(False).alias("open")))
        now = held(_jump(open_, lookup).select("node", F.coalesce("_next", "at").alias("at"), F.coalesce("open", F.lit(False)).alias("open")), "chains")
        ended = ended.unionByName(now.where("not open").select("node", F.col("at").alias("final")))
        open_, last = now.where("open"), left
        left = open_.count()
        if left == last:
            return ended, open_.select("node", "at")
    return ended, None


def _cycle_nodes(open_: DataFrame) -> DataFrame:
    """The nodes on cycles: where the pointers of nodes that never end lead once the targets grow no fewer."""
    targets = held(open_.select(F.col("at").alias("node")).distinct(), "chains")
    n = targets.count()
    while True:
        open_ = held(_jump(open_, open_).select("node", F.col("_next").alias("at")), "chains")
        targets = held(open_.select(F.col("at").alias("node")).distinct(), "chains")
        if (now := targets.count()) == n:
            return targets
        n = now
