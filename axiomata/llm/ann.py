"""Approximate nearest neighbours over stable projections indexed by kd-trees.

Largest inner product is nearest distance after adding one coordinate:
``x' = (x, sqrt(M - |x|^2))``, ``q' = (q, 0)`` with ``M`` the largest squared norm, so
``|q' - x'|^2 = |q|^2 + M - 2 q.x``. Vectors are projected to a few dimensions
by a Gaussian (2-stable) matrix: a squared projected distance over the true one is
chi-square with as many degrees of freedom. A kd-tree fitted on a
bounded sample splits the projected space into cells; every vector is in its
cell's index, and each cell holds a kd-tree of its own. A query visits leaves in order of
projected distance and verifies their vectors exactly, until the chi-square
test says that a vector nearer than the k-th best would have shown up by now.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axiomata.llm.scratch import Scratch

LEAF = 128
#: A tile of the exact search: so many bytes of vectors (in 16 lanes at least) against so many blocks of queries.
LANES, LANE_BYTES, GROUP = 16, 64 << 20, 32


def chi_square_cdf(x: float, m: int) -> float:
    """P(chi-square with m degrees of freedom <= x), by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, h = m / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= h / k
        total += term
    return min(1.0, total * math.exp(-h + a * math.log(h) - math.lgamma(a)))


def chi_square_quantile(p: float, m: int) -> float:
    lo, hi = 0.0, 10.0 * m + 100
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, m) < p else (lo, mid)
    return hi


@dataclass
class Splits:
    """A balanced kd-tree over a sample: for each level the dimension and threshold of each node."""

    dims: list[np.ndarray]
    cuts: list[np.ndarray]

    @staticmethod
    def fit(sample: np.ndarray, depth: int) -> Splits:
        dims, cuts, groups = [], [], [np.arange(len(sample))]
        for _ in range(depth):
            d, c, nxt = [], [], []
            for rows in groups:
                part = sample[rows]
                k = int(np.ptp(part, axis=0).argmax()) if len(rows) else 0
                at = float(np.median(part[:, k])) if len(rows) else 0.0
                d.append(k)
                c.append(at)
                low = part[:, k] <= at
                nxt += [rows[low], rows[~low]]
            dims.append(np.array(d))
            cuts.append(np.array(c))
            groups = nxt
        return Splits(dims, cuts)

    def cell(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for d, c in zip(self.dims, self.cuts):
            at = 2 * at + (x[np.arange(len(x)), d[at]] > c[at])
        return at


def project(x: np.ndarray, lift: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Projections of vectors with their added coordinate."""
    return np.einsum("ij,jk->ik", x, planes[:-1]) + lift[:, None] * planes[-1]


class Cell:
    """A cell's vectors with a kd-tree of their own, split at medians down to leaves."""

    def __init__(self, x: np.ndarray, ids: list, big: float, planes: np.ndarray):
        self.x, self.ids = x, ids
        xp = project(x, np.sqrt(np.maximum(0, big - (x**2).sum(1))), planes)
        groups = [np.arange(len(x))]
        while max(map(len, groups)) > LEAF:
            nxt = []
            for rows in groups:
                if len(rows) <= LEAF:
                    nxt.append(rows)
                    continue
                d = int(np.ptp(xp[rows], axis=0).argmax())
                half = np.argpartition(xp[rows, d], len(rows) // 2)
                nxt += [rows[half[: len(rows) // 2]], rows[half[len(rows) // 2 :]]]
            groups = nxt
        self.groups = groups
        self.low = np.stack([xp[g].min(0) for g in groups])
        self.high = np.stack([xp[g].max(0) for g in groups])

    def gap(self, qp: np.ndarray) -> np.ndarray:
        """Least squared projected distance of each query to the cell."""
        return (np.maximum(0, np.maximum(self.low.min(0) - qp, qp - self.high.max(0))) ** 2).sum(1)

    def search(self, q: np.ndarray, qp: np.ndarray, bound: np.ndarray, big: float, k: int, quantile: float) -> tuple[np.ndarray, np.ndarray]:
        """The k best (row, inner product) for each query, by incremental projected search.

        ``bound`` holds for each query a squared distance that k vectors elsewhere are
        known not to exceed (infinite if none is known).
        """
        gap = np.maximum(0, np.maximum(self.low[None] - qp[:, None], qp[:, None] - self.high[None]))
        near = (gap**2).sum(2)  # query x leaf: least squared projected distance
        order = near.argsort(1, kind="stable")
        best = np.full((len(q), k), -np.inf)
        who = np.full((len(q), k), -1, np.int64)
        q2 = (q**2).sum(1)
        limit = bound.copy()
        active = np.arange(len(q))
        for rank in range(len(self.groups)):
            leaf = order[active, rank]
            go = near[active, leaf] <= quantile * limit[active]
            active, leaf = active[go], leaf[go]
            if not len(active):
                break
            for g in np.unique(leaf):
                own = active[leaf == g]
                rows = self.groups[g]
                score = q[own] @ self.x[rows].T
                both = np.concatenate([best[own], score], 1)
                ids = np.concatenate([who[own], np.broadcast_to(rows, score.shape)], 1)
                top = np.argpartition(-both, min(k, both.shape[1]) - 1, axis=1)[:, :k]
                best[own], who[own] = np.take_along_axis(both, top, 1), np.take_along_axis(ids, top, 1)
                kth = best[own].min(1)
                limit[own] = np.minimum(limit[own], np.where(np.isfinite(kth), np.maximum(0, q2[own] + big - 2 * kth), np.inf))
        return who, best


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.combine_chunks().values if isinstance(column, pa.ChunkedArray) else column.flatten())
    return flat.reshape(len(column), -1)


def _packed(df: DataFrame, by: list[str], most: int, width: int, extra: tuple[str, str]) -> DataFrame:
    """Rows (by..., id-like column, v) packed by key into (by..., data binary, extra array); at most ``most`` vectors a row.

    The rows come sorted by the key.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    name, kind = extra
    item = to_arrow_type(df.schema[name].dataType)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, own, held = None, [], [], 0

        def flush():
            x = np.concatenate(rows)
            return pa.RecordBatch.from_arrays([*[pa.array([k], pa.int64()) for k in key], pa.array([x.tobytes()], pa.binary()), pa.array([sum(own, [])], pa.list_(item))], names=[*by, "data", name])

        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(i).to_numpy() for i in range(len(by))], 1)
            x, ids = _matrix(b.column(len(by) + 1)), b.column(len(by))
            edges = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(edges, edges[1:]):
                at = lo
                while at < hi:
                    here = tuple(keys[at].tolist())
                    if key is not None and (key != here or held >= most):
                        yield flush()
                        rows, own, held = [], [], 0
                    key = here
                    to = min(hi, at + most - held)
                    rows.append(x[at:to])
                    own.append(ids[at:to].to_pylist())
                    held += to - at
                    at = to
        if held:
            yield flush()

    columns = ", ".join(f"{c} long" for c in by)
    return df.select(*by, name, "v").mapInArrow(pack, f"{columns}, data binary, {name} array<{kind}>")


def nearest(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 20, dims: int = 12, confidence: float = 0.95, cell_rows: int = 2048, sample: int = 16_384, query_block: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query row, without its own row.

    ``score`` is the inner product in double precision; ties go to the smaller
    id. Vectors that are null, zero, or hold null or non-finite components take
    no part, neither do rows without an id. Vectors of several lengths are searched length by
    length: a query's candidates are those of its own length. Equal vectors are indexed once with the k + 1 smallest of
    their ids, which is all that can be returned. Rows that repeat an id and
    vector count once; queries that repeat one too. Too few candidates: all of them.
    The tree is fitted on at most ``sample`` vectors, the smallest by a hash.

    Queries first meet their own cell, for a bound. Then tiles of cells and query blocks are searched:
    a tile holds ``LANE_BYTES`` of vectors and ``GROUP`` query blocks, so vectors and queries travel once for each tile, and
    in it the chi-square test leaves out cells and leaves.
    """
    kind = vectors.select(F.col(id_col)).dtypes[0][1]
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))

    def clean(df: DataFrame) -> DataFrame:
        ok = F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
        return df.select(F.col(id_col).alias("id"), v.alias("v")).filter(ok)

    found, good, asked = None, clean(vectors), clean(queries)
    for r in sorted(good.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).collect()):
        own = F.size("v") == r["w"]
        part = _nearest(spark, good.filter(own), asked.filter(own), r["w"], kind, k, dims, confidence, cell_rows, sample, query_block)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")


def _nearest(spark: SparkSession, good: DataFrame, asked: DataFrame, d: int, kind: str, k: int, dims: int, confidence: float, cell_rows: int, sample: int, query_block: int) -> DataFrame:
    """:func:`nearest` for vectors of one length, as (id, v)."""
    from pyspark.sql.pandas.types import to_arrow_type

    scratch = Scratch(spark, "nearest")
    by_vector = Window.partitionBy("v").orderBy("id")
    ranked = good.distinct().withColumn("rank", F.row_number().over(by_vector)).filter(F.col("rank") <= k + 1)
    base = ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # at most k + 1 each
    base = scratch.keep(base.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).withColumn("at", F.xxhash64("v")), "distinct")
    stats = base.agg(F.max("norm2").alias("big"), F.count("*").alias("n")).first()
    big, n = stats["big"], stats["n"]
    planes = np.random.default_rng(20).standard_normal((d + 1, dims))
    picked = _matrix(base.orderBy("at", "v").limit(sample).select("v").toArrow().column(0))
    lift = np.sqrt(np.maximum(0, big - (picked**2).sum(1)))
    depth = max(0, math.ceil(math.log2(max(1, n / cell_rows))))
    splits = Splits.fit(project(picked, lift, planes), min(depth, int(math.log2(max(1, len(picked) / 4)))))
    quantile = chi_square_quantile(confidence, dims)
    id_type = to_arrow_type(good.schema["id"].dataType)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def placed(df: DataFrame, raised: bool, rest: list[str], schema: str) -> DataFrame:
        """Rows (v, ...) with their cell before them; candidates have the added coordinate, queries 0."""

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = _matrix(b.column(0))
                    up = np.sqrt(np.maximum(0, big - (x**2).sum(1))) if raised else np.zeros(len(x))
                    yield pa.RecordBatch.from_arrays([pa.array(splits.cell(project(x, up, planes)), pa.int64()), *b.columns], names=["cell", *b.schema.names])

        return df.select("v", *rest).mapInArrow(place, f"cell long, v array<double>, {schema}")

    def crowded(df: DataFrame, most: int) -> DataFrame:
        """Rows with ``chunk``: a cell with more than ``most`` rows is dealt to several by the hash ``at``."""
        ways = df.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(float(most))).cast("long").alias("ways"))
        return df.join(F.broadcast(ways), "cell").withColumn("chunk", F.pmod(F.shiftright("at", 8), F.col("ways")))  # cells: bounded by the sample

    own = scratch.keep(placed(base, True, ["ids", "at"], f"ids array<{kind}>, at long"), "placed")
    own = crowded(own, 2 * cell_rows).repartition(parts, "cell", "chunk").sortWithinPartitions("cell", "chunk")
    packed = scratch.keep(_packed(own, ["cell", "chunk"], 4 * cell_rows, d, ("ids", f"array<{kind}>")), "cells")

    asked = asked.distinct().withColumn("at", F.xxhash64("id", "v"))
    home = scratch.keep(placed(asked, False, ["id", "at"], f"id {kind}, at long"), "home")
    total = home.count()
    blocks = max(1, -(-total // query_block))

    def rows_of(found: list[tuple]) -> pa.RecordBatch:
        a, e, s = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(a, id_type), pa.array(e, id_type), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    result = f"query_id {kind}, vec_id {kind}, score double"

    # first each query's own cell, for a bound
    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q = np.frombuffer(b.column(0)[i].as_py(), np.float64).reshape(-1, d)
                cell = Cell(np.frombuffer(b.column(2)[i].as_py(), np.float64).reshape(-1, d), b.column(3)[i].as_py(), big, planes)
                who, _ = cell.search(q, project(q, np.zeros(len(q)), planes), np.full(len(q), np.inf), big, k + 1, quantile)
                out = []
                for row, (w, mine) in enumerate(zip(who, b.column(1)[i].as_py())):
                    w = w[w >= 0]
                    exact = (cell.x[w] * q[row]).sum(1)  # the same sum for a vector wherever it is
                    found = [(mine, e, s) for r, s in zip(w, exact.tolist()) for e in cell.ids[r] if e != mine]
                    out += sorted(found, key=lambda f: (-f[2], f[1]))[:k]
                if out:
                    yield rows_of(out)

    lodgers = crowded(home, query_block).repartition(parts, "cell", "chunk").sortWithinPartitions("cell", "chunk")
    lodgers = _packed(lodgers, ["cell", "chunk"], 2 * query_block, d, ("id", kind)).select("cell", F.col("data").alias("q"), "id")
    near = lodgers.join(packed.select("cell", "data", "ids"), "cell").select("q", "id", "data", "ids").mapInArrow(at_home, result)
    near = scratch.keep(near, "near")
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = near.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))

    # then tiles of all cells and all query blocks; the cells lie in lanes in the order of the tree
    weights = {r["cell"]: (r["n"], r["ways"]) for r in packed.groupBy("cell").agg(F.sum(F.size("ids")).alias("n"), F.countDistinct("chunk").alias("ways")).collect()}
    lanes = max(LANES, -(-n * (8 * d + 16) // LANE_BYTES))
    share, at, first = max(1.0, n / lanes), 0.0, []
    for cell in range(1 << len(splits.dims)):
        size = weights.get(cell, (0, 1))[0]
        first.append((cell, min(lanes - 1, int(at / share)), max(1, min(weights.get(cell, (0, 1))[1], int(size / share)))))
        at += size
    dealt = F.broadcast(spark.createDataFrame(first, "cell long, lane0 long, over long"))  # one row a cell
    lane = F.least(F.lit(lanes - 1), F.col("lane0") + F.pmod("chunk", "over"))
    groups = -(-blocks // GROUP)
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    shelves = packed.join(dealt, "cell").select(lane.alias("lane"), each(groups).alias("group"), F.lit(0).alias("role"), "cell", "chunk", "data", "ids", F.lit(None).cast(f"array<{kind}>").alias("id"))
    blocked = home.join(kth, "id", "left").withColumn("block", F.pmod(F.shiftright("at", 8), F.lit(blocks)))
    # the k-th score travels as one more component of the query
    blocked = blocked.select("block", F.lit(0).cast("long").alias("zero"), "id", F.concat("v", F.array(F.coalesce("kth", F.lit(float("-inf"))), F.col("cell").cast("double"))).alias("v"))
    blocked = _packed(blocked.repartition(parts, "block").sortWithinPartitions("block"), ["block", "zero"], 2 * query_block, d + 2, ("id", kind))
    readers = blocked.select(each(lanes).alias("lane"), F.floor(F.col("block") / GROUP).cast("int").alias("group"), F.lit(1).alias("role"), F.col("block").alias("cell"), F.col("zero").alias("chunk"), "data", F.lit(None).cast(f"array<array<{kind}>>").alias("ids"), "id")
    tiles = lanes * groups
    spread = min(tiles, 100_000)
    stream = shelves.unionByName(readers.select(*shelves.columns)).withColumn("tile", F.col("lane") * groups + F.col("group"))
    stream = stream.repartitionById(spread, F.pmod("tile", F.lit(spread)).cast("int")).sortWithinPartitions("tile", "role", "cell", "chunk").select("tile", "role", "cell", "data", "ids", "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, cells = None, []
        for b in batches:
            for i in range(b.num_rows):
                if b.column(0)[i].as_py() != tile:
                    tile, cells = b.column(0)[i].as_py(), []
                if b.column(1)[i].as_py() == 0:
                    x = np.frombuffer(b.column(3)[i].as_py(), np.float64).reshape(-1, d)
                    cells.append((b.column(2)[i].as_py(), Cell(x, b.column(4)[i].as_py(), big, planes)))
                    continue
                wide = np.frombuffer(b.column(3)[i].as_py(), np.float64).reshape(-1, d + 2)
                q, kth, homes, who_asks = np.ascontiguousarray(wide[:, :d]), wide[:, d], wide[:, d + 1], b.column(5)[i].as_py()
                norms, qp = (q**2).sum(1), project(q, np.zeros(len(q)), planes)
                limit = np.where(np.isfinite(kth), np.maximum(0, norms + big - 2 * kth), np.inf)
                start, found = limit.copy(), [[] for _ in who_asks]
                gaps = [c.gap(qp) for _, c in cells]
                for j in sorted(range(len(cells)), key=lambda j: gaps[j].mean()):
                    number, cell = cells[j]
                    mine = np.flatnonzero((homes != number) & (gaps[j] <= quantile * limit))
                    if not len(mine):
                        continue
                    who, score = cell.search(q[mine], qp[mine], limit[mine], big, k + 1, quantile)
                    good = (who >= 0) & (norms[mine, None] + big - 2 * score <= start[mine, None] * (1 + 1e-9) + 1e-9)
                    for row in np.flatnonzero(good.any(1)):
                        at, w = mine[row], who[row][good[row]]
                        exact = (cell.x[w] * q[at]).sum(1)  # the same sum for a vector wherever it is
                        own = found[at]
                        own += [(s, e) for r, s in zip(w, exact.tolist()) for e in cell.ids[r] if e != who_asks[at]]
                        if len(own) >= k:
                            own.sort(key=lambda f: (-f[0], f[1]))
                            del own[k:]
                            limit[at] = min(limit[at], max(0.0, norms[at] + big - 2 * own[-1][0]))
                out = [(asks, e, s) for asks, own in zip(who_asks, found) for s, e in sorted(own, key=lambda f: (-f[0], f[1]))[:k]]
                if out:
                    yield rows_of(out)

    found = near.unionByName(stream.mapInArrow(search, result)).withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
