"""Connected components of an edge list by alternating large and small stars.

Each round is two group-bys over the edges; the number of rounds grows with
the logarithm of the diameter. Rounds are written to the shared folder, so the
lineage stays short and lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axiomata.llm.scratch import Scratch


def _star(edges: DataFrame, scratch: Scratch, large: bool, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Link the neighbours of each node (the larger ones, or the others) to its least neighbour; with the table of these.

    ``before`` is the table of an earlier step, which is deleted.
    """
    if large:
        arcs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        arcs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = scratch.keep(arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", (before,))
    joined = arcs.join(least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct(), least


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 50) -> DataFrame:
    """(node, root) of every node with an edge; root is the least node of its component.

    ``edges`` has a and b of one orderable type; loops, repeats and either
    direction may occur, nulls may not. No edges give no rows. Raises
    RuntimeError if ``max_rounds`` do not suffice (they do for any graph that fits a cluster).
    """
    edges = scratch.keep(edges.select("a", "b").filter("a <> b"), "edges")
    last = least = None
    for _ in range(max_rounds):
        grown, least = _star(edges, scratch, True, least)
        grown = scratch.keep(grown, "large", (edges,))
        edges, least = _star(grown, scratch, False, least)
        edges = scratch.keep(edges, "small", (grown,))
        # 128 bits over the set of edges
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    else:
        raise RuntimeError("connected components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
