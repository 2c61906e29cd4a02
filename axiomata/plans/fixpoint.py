"""Fixpoints as driver loops over distributed deltas.

Every round joins only what the last round found (semi-naive), drops what is
known with an anti join and cuts the lineage by a table written to the folder that
the cluster names, so lost executors cost one round and plans stay small. Tables have known sizes:
small sides of joins are broadcast under Spark's own threshold, which checkpoints of RDDs never are.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables of deltas that a fixpoint reads side by side before it merges them.
PARTS = 6
#: Graphs of at most this many edges are sent to the driver, which finds their cycles.
LOCAL = 100_000
#: Members of a group that one task pairs with the others.
SHARE = 1000


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset a new local folder, which only a local master may use."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not root and held.isDefined():
        root = held.get()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="axiomata-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back; :func:`forget` deletes it."""
    at = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def forget(*tables: DataFrame) -> None:
    """Delete tables of :func:`checkpointed` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            at = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def loop_settings(spark: SparkSession):
    """Constraint propagation off: over unions of many tables it costs time and has given wrong plans."""
    key = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fixpoint(seed: DataFrame, step: Callable[[DataFrame, DataFrame, int], DataFrame], key: list[str], max_rounds: int = 10_000) -> DataFrame:
    """All rows reachable from ``seed``; ``step(delta, known, round)`` gives candidates of the same columns.

    One row is kept for each ``key``, the one of the earliest round and of
    these the smallest by all columns. Raises RuntimeError after ``max_rounds``.
    """
    spark = seed.sparkSession
    rest = [c for c in seed.columns if c not in key]

    def first(df: DataFrame) -> DataFrame:
        if not rest:
            return df.select(*key).distinct()
        return df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("__r")).select(*key, "__r.*").select(*seed.columns)

    with loop_settings(spark):
        delta = checkpointed(first(seed))
        parts = [delta]  # rounds so far; merged now and then, so that neither the plan nor what is written grows with the square of the rounds
        for n in range(1, max_rounds + 1):
            known = reduce(DataFrame.unionByName, parts)
            found = step(delta, known, n).join(known.select(*key), key, "left_anti")
            delta = checkpointed(first(found.select(*seed.columns)))
            if delta.isEmpty():
                return known
            parts.append(delta)
            if len(parts) > PARTS:
                merged = checkpointed(reduce(DataFrame.unionByName, parts))
                forget(*parts[:-1])  # the last one is still the delta
                parts = [merged]
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def closure(edges: DataFrame, source: str = "src", target: str = "dst", starts: DataFrame | None = None, double: bool = True) -> DataFrame:
    """(source, target) pairs joined by a path of one or more edges, without pairs of a node and itself.

    Cycles are fine. From given ``starts`` (one column ``source``) paths grow
    edge by edge. For all nodes cycles are first contracted; paths double then, so rounds are
    logarithmic in the diameter, and pairs within and between cycles are made at the end, when they are read.
    """
    e = checkpointed(edges.select(F.col(source).alias("src"), F.col(target).alias("dst")).filter("src <> dst").distinct())
    if starts is not None:
        seed = e.join(starts.select(F.col(starts.columns[0]).alias("src")).distinct(), "src", "left_semi")
        more = e.select(F.col("src").alias("dst"), F.col("dst").alias("far"))
        found = fixpoint(seed, lambda d, k, n: d.join(more, "dst").select("src", F.col("far").alias("dst")), ["src", "dst"])
    elif double:
        groups = strong_components(e)
        found = _doubled(e) if groups is None else paired(_doubled(checkpointed(contracted(e, groups))), groups)
    else:
        more = e.select(F.col("src").alias("dst"), F.col("dst").alias("far"))
        found = fixpoint(e, lambda d, k, n: d.join(more, "dst").select("src", F.col("far").alias("dst")), ["src", "dst"])
    return found.filter("src <> dst").select(F.col("src").alias(source), F.col("dst").alias(target))


def _doubled(e: DataFrame) -> DataFrame:
    """The closure of acyclic edges. Round k joins the paths shorter than 2^k to those of just 2^k edges, so a pair with one path is met once."""
    with loop_settings(e.sparkSession):
        exact, parts = e, [e]
        while True:
            ahead = exact.select(F.col("src").alias("dst"), F.col("dst").alias("far"))
            exact = checkpointed(exact.join(ahead, "dst").select("src", F.col("far").alias("dst")).distinct())
            if exact.isEmpty():
                return reduce(DataFrame.unionByName, parts)
            known = reduce(DataFrame.unionByName, parts)
            ahead = exact.select(F.col("src").alias("dst"), F.col("dst").alias("far"))
            longer = known.join(ahead, "dst").select("src", F.col("far").alias("dst")).unionByName(exact)
            parts.append(checkpointed(longer.distinct().join(known, ["src", "dst"], "left_anti")))


def contracted(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(src, dst) edges between groups; a node without a group stands for itself."""
    a, b = groups.select(F.col("node").alias("src"), F.col("root").alias("__a")), groups.select(F.col("node").alias("dst"), F.col("root").alias("__b"))
    x = edges.join(a, "src", "left").join(b, "dst", "left")
    return x.select(F.coalesce("__a", "src").alias("src"), F.coalesce("__b", "dst").alias("dst")).filter("src <> dst").distinct()


def paired(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """(src, dst): pairs of groups as pairs of their members, and all pairs within a group.

    There are as many as the square of a group, so they are never kept: the
    members of a group are dealt to several tasks, each of which meets all members of the other.
    """
    spark = pairs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = groups.groupBy("root").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    deals = most // SHARE + 1
    pairs = pairs.unionByName(groups.select(F.col("root").alias("src"), F.col("root").alias("dst")).distinct())
    left = pairs.join(groups.select(F.col("root").alias("src"), F.col("node").alias("__a")), "src", "left").select(F.coalesce("__a", "src").alias("src"), "dst")
    left = left.withColumn("__deal", F.pmod(F.xxhash64("src"), F.lit(deals))).repartition(n, "dst", "__deal")
    right = groups.select(F.col("root").alias("dst"), F.col("node").alias("__b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))).alias("__deal"))
    return left.join(right.repartition(n, "dst", "__deal"), ["dst", "__deal"], "left").select("src", F.coalesce("__b", "dst").alias("dst")).filter("src <> dst")


def strong_components(edges: DataFrame) -> DataFrame | None:
    """(node, root) of all nodes on cycles of the (src, dst) edges; None where there is no cycle.

    Nodes that nothing enters or leaves go. A node with one way in (or out)
    is on a cycle with that neighbour just if another neighbour of it is, so
    it is bridged and decided at the end; nodes that are not next to each
    other are bridged at once, so long chains and rings shrink by a part each
    round. Graphs of ``LOCAL`` edges go to the driver; where all nodes have several ways
    in and out, colours are spread instead.
    """
    spark = edges.sparkSession
    log, found, e, turn = [], [], edges, 0
    with loop_settings(spark):
        while True:
            turn += 1
            size = e.count()
            if size <= LOCAL:
                rows = _cycles((r["src"], r["dst"]) for r in e.collect())
                node = edges.schema["src"].dataType.simpleString()
                groups = checkpointed(reduce(DataFrame.unionByName, found, spark.createDataFrame(rows, f"node {node}, root {node}")))
                break
            inner = checkpointed(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            left = inner.count()
            nxt, bridged = (inner, None) if left < 0.9 * size else _bridged(inner, turn)  # bushy graphs are gone before they need bridges
            if bridged is not None:
                log.append(bridged)
            elif left == size:
                ring = _coloured(inner)
                found.append(ring)
                nxt = checkpointed(inner.join(ring.select(F.col("node").alias("src")), "src", "left_anti").join(ring.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
            if e is not edges:
                forget(e)
            e = nxt
        for bridged in reversed(log):
            a, b = groups.select(F.col("node").alias("by"), F.col("root").alias("__a")), groups.select(F.col("node").alias("other"), F.col("root").alias("__b"))
            x = bridged.join(a, "by", "left").join(b, "other", "left").withColumn("root", F.coalesce("__a", "by")).filter("root = coalesce(__b, other)")
            groups = checkpointed(groups.unionByName(x.select("node", "root")).unionByName(x.select(F.col("by").alias("node"), "root")).distinct())
    return None if groups.isEmpty() else groups


def _bridged(e: DataFrame, turn: int) -> tuple[DataFrame, DataFrame | None]:
    """Edges without the nodes that are bridged, and (node, by, other) of those: its one neighbour on a side, and those on the other."""
    way_in = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("src").alias("by")).filter("n = 1").select("node", "by", F.lit(True).alias("entered"))
    way_out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("dst").alias("by")).filter("n = 1").select("node", "by", F.lit(False).alias("entered"))
    thin = checkpointed(way_in.unionByName(way_out.join(way_in, "node", "left_anti")))
    if thin.isEmpty():
        return e, None
    draw = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)), F.col(c))
    ends = e.join(thin.select(F.col("node").alias("src")), "src", "left_semi").join(thin.select(F.col("node").alias("dst")), "dst", "left_semi")
    lost = ends.select(F.when(draw("src") < draw("dst"), F.col("dst")).otherwise(F.col("src")).alias("node")).distinct()
    chosen = checkpointed(thin.join(lost, "node", "left_anti"))
    entered, left = chosen.filter("entered"), chosen.filter("not entered")
    after = e.select(F.col("src").alias("node"), F.col("dst").alias("other")).join(entered, "node").select("node", "by", "other")
    before = e.select(F.col("dst").alias("node"), F.col("src").alias("other")).join(left, "node").select("node", "by", "other")
    over = after.select(F.col("by").alias("src"), F.col("other").alias("dst")).unionByName(before.select(F.col("other").alias("src"), F.col("by").alias("dst")))
    rest = e.join(chosen.select(F.col("node").alias("src")), "src", "left_anti").join(chosen.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
    return checkpointed(rest.unionByName(over).filter("src <> dst").distinct()), checkpointed(after.unionByName(before))


def _coloured(e: DataFrame) -> DataFrame:
    """(node, root): for each node that is the least of all that reach it, those it reaches and is reached from."""
    nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
    colours = checkpointed(nodes.select("node", F.col("node").alias("root")))
    while True:
        came = e.join(colours.select(F.col("node").alias("src"), "root"), "src").select(F.col("dst").alias("node"), "root")
        nxt = checkpointed(colours.unionByName(came).groupBy("node").agg(F.min("root").alias("root")))
        same = nxt.join(colours, ["node", "root"], "left_anti").isEmpty()
        forget(colours)
        colours = nxt
        if same:
            break
    own = e.join(colours.select(F.col("node").alias("src"), "root"), "src").join(colours.select(F.col("node").alias("dst"), "root"), ["dst", "root"])
    back = own.select(F.col("dst").alias("node"), "root", F.col("src").alias("far"))
    return fixpoint(colours.filter("node = root"), lambda d, k, n: d.join(back, ["node", "root"]).select(F.col("far").alias("node"), "root"), ["node", "root"])


def _cycles(edges: Iterable[tuple]) -> list[tuple]:
    """(node, least node of its component) for the nodes on cycles; Tarjan's algorithm with its own stack."""
    out: dict = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    order, low, held, stack, rows = {}, {}, set(), [], []
    for start in out:
        if start in order:
            continue
        work = [(start, iter(out[start]))]
        order[start] = low[start] = len(order)
        stack.append(start)
        held.add(start)
        while work:
            node, rest = work[-1]
            for b in rest:
                if b not in order:
                    order[b] = low[b] = len(order)
                    stack.append(b)
                    held.add(b)
                    work.append((b, iter(out.get(b, ()))))
                    break
                if b in held:
                    low[node] = min(low[node], order[b])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == order[node]:
                    group = []
                    while not group or group[-1] != node:
                        group.append(stack.pop())
                        held.discard(group[-1])
                    if len(group) > 1:
                        least = min(group)
                        rows += [(x, least) for x in group]
    return rows


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node of each node's component; two group-bys a round, rounds logarithmic."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            arcs = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            arcs = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = arcs.join(least, "u")
        if large:
            return checkpointed(joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        back = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        return checkpointed(joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(back).filter("a <> b").distinct())

    with loop_settings(edges.sparkSession):
        e = checkpointed(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct())
        while True:
            grown = star(e, True)
            nxt = star(grown, False)
            # settled when no edge is new and none is gone
            same = nxt.count() == e.count() and nxt.join(e, ["a", "b"], "left_anti").isEmpty()
            forget(grown, e)
            e = nxt
            if same:
                break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
