"""SimHash near-duplicates by meet-in-the-middle balls.

Fingerprints within ``radius`` bits of each other differ by at most half the
radius (rounded down) on one of their two 32-bit halves. Each distinct
fingerprint therefore emits, for both halves, the half itself and all its
variants within half the radius; variants are shuffled and fingerprints that
meet are verified on all 64 bits inside the join.

Where more than ``dense`` fingerprints meet at one variant (a large group of
near copies), joining them would grow with the square of the group. Those
fingerprints go through balls on all 64 bits instead: each emits its variants
within one bit and, if its own bit count is even, within two; all
fingerprints that meet at a variant ``x`` are then linked by the triangle
inequality, so a star per variant replaces the pairs. Both ways are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomata.llm.components import connected_components
from axiomata.llm.scratch import Scratch
from axiomata.llm.shingles import features, set_links

RADIUS, SHINGLE, SEED = 3, 3, 42


def fingerprint(text: str | None, n: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text; 0 for no words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < n:
        packed, count = xxhash.xxh64_digest(b" ".join(words), seed), 1
    else:
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-n])).tolist()
        digest = xxhash.xxh64_digest
        packed = b"".join([digest(line[a:b], seed) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist())])
        count = len(starts)
    ones = np.zeros(64, np.int64)
    raw = np.frombuffer(packed, np.uint8)
    for at in range(0, len(raw), 8 * 16384):  # long texts in slices, so that memory stays bounded
        ones += np.unpackbits(raw[at : at + 8 * 16384]).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > count).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of each whole text as a signed long with the same 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["id", "fp"])

    kind = docs.select(F.col(id_col)).dtypes[0][1]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _flips(bits: int, within: int) -> list[int]:
    """All masks over ``bits`` bits with 1 to ``within`` ones, as signed 64-bit numbers."""
    from itertools import combinations

    found = [sum(1 << b for b in c) for k in range(1, within + 1) for c in combinations(range(bits), k)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in found]


def _half_balls(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, half, variant, centre): both halves of each fingerprint and their variants within half the radius.

    A fingerprint of 8 bytes gives 66 rows, so the one or two files that hold
    millions of them would be one or two tasks with all the rows; they are dealt out first.
    """
    masks = [0, *_flips(32, radius // 2)]
    mask, half = F.lit(masks).cast("array<long>"), F.lit([0, 1])
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    balls = spread.select("fp", F.explode(half).alias("half")).select("fp", "half", F.explode(mask).alias("mask"))
    own = F.when(F.col("half") == 1, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    return balls.select("fp", "half", own.bitwiseXOR(F.col("mask")).alias("variant"), (F.col("mask") == 0).alias("centre"))


def near_links(fps: DataFrame, scratch: Scratch, radius: int = RADIUS, dense: int = 512) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within ``radius`` bits.

    ``fps`` has distinct non-null signed ``fp``. Edges of sparse variants are
    exactly the linked pairs that meet there, those of dense fingerprints a star.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the radius is 0 to 3")
    balls = _half_balls(fps, radius)
    crowd = balls.groupBy("variant", "half").agg(F.count("*").alias("n"), F.max("centre").alias("met")).filter("n > 1 and met")
    crowd = scratch.keep(crowd, "variants")
    balls = scratch.keep(balls.join(crowd, ["variant", "half"]), "balls")
    thin = balls.filter(F.col("n") <= dense)
    a = thin.filter("centre").select(F.col("variant").alias("v"), F.col("half").alias("h"), F.col("fp").alias("a"))
    b = thin.select(F.col("variant"), F.col("half"), F.col("fp").alias("b"))
    near = (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    links = a.join(b, (F.col("v") == F.col("variant")) & (F.col("h") == F.col("half")) & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    crowded = balls.filter(F.col("n") > dense).select("fp").distinct()
    if not crowded.isEmpty():
        links = links.unionByName(_ball_stars(scratch.keep(crowded, "dense"), scratch, radius))
    return links.distinct()


def _ball_stars(fps: DataFrame, scratch: Scratch, radius: int) -> DataFrame:
    """Stars over the variants of 64-bit balls; linear in the fingerprints whatever their distances.

    At most ``radius`` bits apart, two fingerprints share a variant at
    distances that add up to at most the radius. Near members (one bit at most) of a variant
    are within two of each other, near and far ones (two bits) within three.
    """
    ones, twos = _flips(64, min(1, radius)), [m for m in _flips(64, 2) if bin(m & (1 << 64) - 1).count("1") == 2]
    longs = lambda x: F.lit(x).cast("array<long>")
    reach = F.when(F.bit_count("fp") % 2 == 0, longs([0, *twos])).otherwise(longs(ones)) if radius == 3 else longs([0, *ones])
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = fps.repartition(n, "fp")
    balls = spread.select("fp", F.explode(reach).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("variant"), F.bit_count("m").alias("d"))
    # every pair must be within the radius at its variant: d + d' <= radius with the nearest member
    star = balls.groupBy("variant").agg(F.min(F.struct("d", "fp")).alias("hub"), F.count("*").alias("n")).filter("n > 1")
    star = scratch.keep(star, "hubs")
    joined = balls.join(star, "variant").filter((F.col("fp") != F.col("hub.fp")) & (F.col("d") + F.col("hub.d") <= radius))
    return joined.select(F.least("fp", "hub.fp").alias("a"), F.greatest("fp", "hub.fp").alias("b"))


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, dense: int = 512, similar: float | None = None) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links of at most ``radius`` bits.

    With ``similar``, five-word shingle sets of at least that Jaccard similarity are linked too.
    Null and empty texts have fingerprint 0 and link like any other. Rows that
    repeat an id keep their own fingerprints. Null ids take part in linking
    but never name a component unless no other id is there. An empty table
    gives no rows.
    """
    scratch = Scratch(spark, "simhash")
    if similar is None:
        own = scratch.keep(fingerprints(docs, id_col, text_col), "fingerprints")
    else:
        wide = scratch.keep(features(docs, id_col, text_col), "features")
        own = wide.select("id", "fp")
    least = scratch.keep(own.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    links = scratch.keep(near_links(least.select("fp"), scratch, radius, dense), "links")
    if similar is not None:
        links = links.unionByName(set_links(wide, scratch, similar))
    # same id, several fingerprints: the id joins them
    twice = own.filter("id is not null").groupBy("id").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count("*").alias("n")).filter("n > 1 and a <> b")
    if not twice.isEmpty():
        links = links.unionByName(twice.select("a", "b")).unionByName(own.join(twice, "id").select("a", F.col("fp").alias("b")).filter("a <> b"))
    classes = connected_components(links, scratch)  # (node, root)
    named = least.join(classes, least["fp"] == classes["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = scratch.keep(named, "classes")
    component = scratch.keep(named.groupBy("root").agg(F.min("first").alias("component")), "names")
    final = scratch.keep(named.join(component, "root").select(F.col("fp").alias("f"), "component"), "named")
    return own.join(final, own["fp"] == final["f"]).select("id", "fp", "component")


def deduplicate(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, similar: float | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, that lead their near-duplicate component.

    The leader has the smallest id; the others are dropped by an anti join
    with their ids, which are fewer than those that stay. Rows that repeat a
    leading id are all kept, and so are rows without an id, as nothing names them a copy.
    """
    found = near_duplicates(spark, docs, id_col, text_col, radius, similar=similar)
    copies = found.filter("id <> component").select(F.col("id").alias("__copy")).distinct()
    copies = Scratch(spark, "copies").keep(copies, "ids")
    return docs.join(copies, F.col(id_col) == F.col("__copy"), "left_anti")
