"""Multiset differences, overlays and duplicates by canonical key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axiomata.functions import terms as t
from axiomata.model import Ontology


def multiset_difference(a: DataFrame, b: DataFrame, key: str = "canon", order: str = "idx") -> DataFrame:
    """Rows of ``a`` beyond the occurrences of their key in ``b``: the later ones in ``order``, as written.

    Keys that ``b`` lacks need no numbering, so only keys on both sides, and
    more often in ``a``, are put through a window.
    """
    counts = b.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__n"))
    absent = a.join(counts, F.col(key).eqNullSafe(F.col("__k")), "left_anti")
    excess = a.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__m")).join(counts, F.col("__key").eqNullSafe(F.col("__k"))).filter("__m > __n")
    both = a.join(excess.select("__key", "__n"), F.col(key).eqNullSafe(F.col("__key")))
    late = both.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("__rank > __n")
    return absent.unionByName(late.select(*a.columns))


def diff_axioms(before: Ontology, after: Ontology) -> tuple[DataFrame, DataFrame]:
    """(removed, added) axioms."""
    return multiset_difference(before.axioms, after.axioms), multiset_difference(after.axioms, before.axioms)


def diff_header(before: Ontology, after: Ontology) -> list[tuple[str, str, str]]:
    """(change, field, text) of version, imports and header annotations; annotations compare as written."""
    out = []
    for name in ("iri", "version"):
        a, b = getattr(before, name), getattr(after, name)
        if a != b:
            out += [("-", name, a)] * bool(a) + [("+", name, b)] * bool(b)
    for name, a, b in (("import", before.imports, after.imports), ("annotation", [t.render(x) for x in before.notes], [t.render(x) for x in after.notes])):
        for sign, own, other in (("-", list(a), list(b)), ("+", list(b), list(a))):
            left = list(other)
            for x in own:
                if x in left:
                    left.remove(x)
                else:
                    out.append((sign, name, x))
    return out


def diff(before: Ontology, after: Ontology) -> DataFrame:
    """(change, idx, kind, text): removed axioms with ``-``, added ones with ``+``."""
    removed, added = diff_axioms(before, after)
    pick = lambda df, sign: df.select(F.lit(sign).alias("change"), "idx", "kind", "text")
    return pick(removed, "-").unionByName(pick(added, "+"))


def touched(before: Ontology, after: Ontology) -> DataFrame:
    """(kind, iri): entities that changed axioms mention."""
    removed, added = diff_axioms(before, after)
    one = lambda o, df: o.rewrite(lambda _: df).mentions().select("kind", "iri")
    return one(before, removed).unionByName(one(after, added)).distinct()


def summary(before: Ontology, after: Ontology) -> str:
    """One line with the number of added and removed axioms and header changes."""
    n = {r["change"]: r["n"] for r in diff(before, after).groupBy("change").agg(F.count("*").alias("n")).collect()}
    head = len(diff_header(before, after))
    parts = [f"{n.get(s, 0)} {what}" for s, what in (("+", "added"), ("-", "removed"))] + [f"{head} header changes"] * bool(head)
    return ", ".join(parts) if n or head else "no difference"


def distinct_axioms(o: Ontology) -> Ontology:
    """Each canonical axiom once, the first as written: one aggregation, no window.

    Every column is an aggregate of its own, so those that nobody reads are never sorted.
    """
    cols = [c for c in o.axioms.columns if c not in ("idx", "canon")]
    first = o.axioms.groupBy("canon").agg(F.min("idx").alias("idx"), *[F.min_by(c, "idx").alias(c) for c in cols])
    return o.rewrite(lambda df: first.select(*df.columns))


def overlay(base: Ontology, *plans: Ontology, step: int | None = None) -> Ontology:
    """Union of ontologies with each canonical axiom once; the first wins."""
    return distinct_axioms(base.add(*plans, step=step))


def merge(iri: str, *parts: Ontology) -> Ontology:
    """As :func:`overlay`, under a new IRI that records the parts as imports."""
    table: dict[str, str] = {}
    for p in reversed(parts):
        table |= p.prefixes
    return overlay(*parts).header(iri=iri, version="", imports=tuple(dict.fromkeys(p.iri for p in parts if p.iri)), prefixes=table)


def duplicates(o: Ontology) -> DataFrame:
    """Axioms whose canonical key occurred before: all but the first of each key."""
    first = o.axioms.groupBy(F.col("canon").alias("__c")).agg(F.min("idx").alias("__first"), F.count("*").alias("__n")).filter("__n > 1")
    return o.axioms.join(first, F.col("canon") == F.col("__c")).filter("idx <> __first").select(*o.axioms.columns)


def multiset_overlap(items: DataFrame, owner: str, item: str) -> DataFrame:
    """(a, b, shared): for owners a < b with common items, the size of the multiset intersection.

    Equal copies are numbered within their owner, so an equi-join on (item,
    occurrence) counts them.
    """
    nth = items.select(F.col(owner).alias("o"), F.col(item).alias("i")).withColumn("k", F.row_number().over(Window.partitionBy("o", "i").orderBy(F.lit(0))))
    a, b = nth.select(F.col("o").alias("a"), "i", "k"), nth.select(F.col("o").alias("b"), "i", "k")
    return a.join(b, ["i", "k"]).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
