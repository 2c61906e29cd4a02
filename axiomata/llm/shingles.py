"""Near copies by the Jaccard similarity of their five-word shingles.

Each text's set of hashed shingles has 28 bands of five minima. Sets that
share a band are candidates, and all shingles of both decide (two sets of
similarity 0.8 share no band with probability 2e-5). Members of a band are
first compared with its least member; pairs that this has linked, directly or
through others, need no comparison. Bands that still hold several classes may be
large groups of copies too loose to link, whose pairs grow with the square of the
group. Their sets are joined by prefixes instead: with shingles in the order of
their frequency, two similar sets meet early in both, where loose copies hold
only shingles of their own. Sets that meet at a shingle are first compared with that
which has it earliest (the centre of the group), then those not linked by this
with each other. That finds all similar pairs of these sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axiomata.llm.components import connected_components
from axiomata.llm.scratch import Scratch

SHINGLE, BANDS, ROWS, SEED = 5, 28, 5, 42
_draw = np.random.default_rng(SEED)
_TIMES = _draw.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _draw.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; the whole text is one if it is shorter."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.array([], np.uint64)
    line, n = b" ".join(words), min(SHINGLE, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-n])).tolist()
    digest = xxhash.xxh64_digest
    packed = b"".join([digest(line[a:b], SEED) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist())])
    return np.unique(np.frombuffer(packed, np.uint64))


def band_keys(own: np.ndarray) -> list[int]:
    """One signed 64-bit key a band; none for an empty set."""
    if not len(own):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 4096):  # long texts in slices
        mixed = own[at : at + 4096] * _TIMES + _PLUS
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(1))
    return [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(least.reshape(BANDS, ROWS))]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, sig, bands, shingles): SimHash, hash of the set, band keys, and the set in 32 bits a shingle."""
    from axiomata.llm.simhash import fingerprint

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = batch.column(1).to_pylist()
                fps = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
                sets = [shingle_set(t) for t in texts]
                sigs = [xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63) for s in sets]
                short = [(s >> np.uint64(32)).astype(np.uint32).view(np.int32) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(fps), pa.array(sigs, pa.int64()), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64())), pa.array(short, pa.list_(pa.int32()))],
                    names=["id", "fp", "sig", "bands", "shingles"],
                )

    kind = docs.select(F.col(id_col)).dtypes[0][1]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long, sig long, bands array<long>, shingles array<int>")


def prefixes(known: DataFrame, sets: DataFrame, scratch: Scratch, similar: float) -> DataFrame:
    """(sig, n, p, e): the shingles e at which a set of n shingles may meet a similar one, p its place from 0, rarest first.

    ``known`` has one row (sig, n) a set, ``sets`` their (sig, shingles).
    """
    each = sets.join(known, "sig", "left_semi").select("sig", F.explode("shingles").alias("e"))
    often = scratch.keep(each.groupBy("e").agg(F.count("*").alias("df")).filter("df > 1"), "often")
    # shingles of one set alone come first and meet nothing: only their number counts
    order = each.join(often, "e").groupBy("sig").agg(F.array_sort(F.collect_list(F.struct("df", "e"))).alias("shared"))
    first = F.floor((1 - F.lit(similar)) * F.col("n") + 1e-9) + 1
    alone = F.col("n") - F.size("shared")
    lead = known.join(order, "sig").select("sig", "n", alone.alias("alone"), F.posexplode(F.slice("shared", F.lit(1), F.greatest(F.lit(0), first - alone).cast("int"))).alias("i", "s"))
    return scratch.keep(lead.select("sig", "n", (F.col("alone") + F.col("i")).alias("p"), F.col("s.e").alias("e")), "prefixes")


def _enough(similar: float):
    """Whether sets of n and m shingles whose first common one is at p and q may be similar: all they share is among the n - p and m - q from there."""
    return F.least(F.col("n") - F.col("p"), F.col("m") - F.col("q")) >= F.lit(similar / (1 + similar)) * (F.col("n") + F.col("m")) - 1e-9


def centre_pairs(lead: DataFrame, similar: float) -> DataFrame:
    """Candidates (a, n, b, m) of each set of :func:`prefixes` with the set that has one of its shingles earliest."""
    centre = lead.groupBy("e").agg(F.min(F.struct("p", "sig", "n")).alias("c")).select("e", F.col("c.sig").alias("b"), F.col("c.n").alias("m"), F.col("c.p").alias("q"))
    return lead.join(centre, "e").filter((F.col("sig") != F.col("b")) & _enough(similar)).select(F.col("sig").alias("a"), "n", "b", "m")


def class_pairs(lead: DataFrame, similar: float) -> DataFrame:
    """Candidates (a, n, b, m), repeats included, that hold every similar pair of different ``class`` of :func:`prefixes`."""
    other = lead.select(F.col("sig").alias("b"), F.col("n").alias("m"), F.col("class").alias("of"), F.col("p").alias("q"), F.col("e").alias("at"))
    meet = (F.col("e") == F.col("at")) & (F.col("sig") < F.col("b")) & (F.col("class") != F.col("of")) & _enough(similar)
    return lead.join(other, meet).select(F.col("sig").alias("a"), "n", "b", "m")


def set_links(wide: DataFrame, scratch: Scratch, similar: float) -> DataFrame:
    """Links (a, b) of fingerprints whose components join all sets at ``similar`` or more; ``wide`` as of :func:`features`."""
    held = wide.filter(F.size("shingles") > 0)
    lead = scratch.keep(held.groupBy("sig").agg(F.min("fp").alias("lead")), "leads")
    rows = held.select(F.explode("bands").alias("band"), "sig", F.size("shingles").alias("n")).distinct()
    hubs = rows.groupBy("band").agg(F.min(F.struct("sig", "n")).alias("hub"), F.count("*").alias("members")).filter("members > 1")
    banded = scratch.keep(rows.join(hubs, "band").select("band", "sig", "n", "hub"), "banded")
    sets = held.join(banded.select("sig").distinct(), "sig", "left_semi").select("sig", "shingles").dropDuplicates(["sig"])
    sets = scratch.keep(sets, "sets")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        near = F.least("n", "m") >= F.lit(similar) * F.greatest("n", "m")
        pairs = pairs.filter(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        left, right = sets.select(F.col("sig").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("sig").alias("b"), F.col("shingles").alias("y"))
        both = pairs.join(left, "a").join(right, "b")
        common = F.size(F.array_intersect("x", "y"))
        return scratch.keep(both.filter(common >= F.lit(similar) * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b"), name)

    star = banded.filter(F.col("sig") != F.col("hub.sig")).select(F.col("sig").alias("a"), "n", F.col("hub.sig").alias("b"), F.col("hub.n").alias("m"))
    links = verified(star, "stars")

    def classed(some: DataFrame) -> DataFrame:
        classes = connected_components(links, scratch)
        return some.join(classes, F.col("sig") == F.col("node"), "left").select(*some.columns, F.coalesce("root", "sig").alias("class"))

    known = scratch.keep(classed(banded.filter(F.col("sig") != F.col("hub.sig")).select("band", "sig", "n")), "known")
    mixed = known.groupBy("band").agg(F.min("class").alias("c"), F.max("class").alias("d")).filter("c <> d").select("band")
    mixed = scratch.keep(known.join(mixed, "band", "left_semi").select("sig", "n").distinct(), "mixed")
    early = prefixes(mixed, sets, scratch, similar)
    links = links.unionByName(verified(centre_pairs(early, similar), "centres"))
    early = scratch.keep(classed(early), "early")
    links = links.unionByName(verified(class_pairs(early, similar), "rest"))
    by = lambda c: lead.select(F.col("sig").alias(c), F.col("lead").alias(f"lead_{c}"))
    named = links.join(by("a"), "a").join(by("b"), "b").select(F.col("lead_a").alias("a"), F.col("lead_b").alias("b"))
    # equal sets may have several fingerprints
    same = held.select("sig", "fp").distinct().join(lead, "sig").filter("fp <> lead").select(F.col("lead").alias("a"), F.col("fp").alias("b"))
    return scratch.keep(named.unionByName(same), "set_links")
