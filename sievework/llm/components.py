"""Connected components by randomised contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import Scratch


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node of edges (a, b: long); nodes share a root exactly if a path joins them.

    In each round every node points to the one of least random priority among itself and its neighbours, and edges are
    drawn between what their ends point to. Paths and stars shrink by a constant factor in expectation, so the number
    of rounds is logarithmic. Tables are stored between rounds: joins read both sides from files, so that adaptive
    execution can split the partition of a hub, and a lost executor costs no earlier round. All of them but the result
    are removed in the end. Edges that repeat, loops and an empty table are fine; null ends are dropped.
    """
    scratch = Scratch(edges.sparkSession)
    edges = scratch.store(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    while n := edges.count():  # edges never grow, and a step has two nodes an edge at most
        ranked = lambda c: F.struct(F.xxhash64(F.lit(len(steps)), F.col(c)).alias("rank"), F.col(c).alias("to"))  # noqa: B023, E731
        sides = edges.select(F.col("a").alias("node"), ranked("b").alias("near")).unionByName(edges.select(F.col("b").alias("node"), ranked("a").alias("near")))
        least = sides.groupBy("node").agg(F.min("near").alias("near"))
        step = scratch.store(least.select("node", F.least(ranked("node"), F.col("near"))["to"].alias("to")), "step", rows=2 * n)
        steps.append(step)
        ends = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").select("x", "b")
        ends = ends.join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").where("x <> y")
        before, edges = edges, scratch.store(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges", rows=n)
        scratch.drop(before)
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    follow = lambda found, step: found.join(step.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    out = scratch.store(reduce(follow, steps[1:], steps[0].select("node", F.col("to").alias("root"))), "components", rows=steps[0].count())
    scratch.close(out)
    return out
