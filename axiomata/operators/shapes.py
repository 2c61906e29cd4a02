"""Shapes of types: multisets of fields, compared across types and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axiomata.functions import terms as t
from axiomata.model import Ontology
from axiomata.operators import asserted
from axiomata.operators.diff import multiset_overlap
from axiomata.operators.lint import INFO, WARNING
from axiomata.plans.fixpoint import components


def fields(o: Ontology) -> DataFrame:
    """(owner, field, held, is_object): properties with a named domain or range; null for the end not stated, the last statement wins."""

    def last(kinds: str, wanted: dict[str, int], name: str) -> DataFrame:
        x = o.kind(*kinds.split()).select("idx", F.col("kind").alias("k"), asserted.child(0).alias("p"), asserted.child(1).alias("n")).filter("p.op <> 'ObjectInverseOf'")
        ok = F.lit(False)
        for kind, entity in wanted.items():
            ok = ok | ((F.col("k") == kind) & (F.col("n.kind") == entity))
        return x.filter(ok).groupBy(F.col("p.iri").alias("field")).agg(F.max_by("n.iri", "idx").alias(name), F.max_by("k", "idx").alias(f"{name}_kind"))

    d = last("ObjectPropertyDomain DataPropertyDomain", {"ObjectPropertyDomain": t.CLASS, "DataPropertyDomain": t.CLASS}, "owner")
    r = last("ObjectPropertyRange DataPropertyRange", {"ObjectPropertyRange": t.CLASS, "DataPropertyRange": t.DATATYPE}, "held")
    return d.join(r, "field", "full").select("owner", "field", "held", F.coalesce(F.col("held_kind") == "ObjectPropertyRange", F.lit(False)).alias("is_object"))


def shapes(items: DataFrame, owner: str = "owner", field: str = "field") -> DataFrame:
    """(owner, shape, size): the sorted multiset of an owner's fields as text, repeats with a multiplier."""
    n = items.groupBy(F.col(owner).alias("owner"), F.col(field).alias("f")).agg(F.count("*").alias("n"))
    one = F.transform(F.array_sort(F.collect_list(F.struct("f", "n"))), lambda x: F.concat(x["f"], F.lit(" x"), x["n"].cast("string")))
    return n.groupBy("owner").agg(F.array_join(one, ", ").alias("shape"), F.sum("n").alias("size"))


def compared(items: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, how, shared): owners a < b of (owner, field, is_object) that share ``least`` fields, one of them an object, where one shape holds the other.

    ``how`` is same, superset (a holds b) or subset.
    """
    sizes = items.groupBy("owner").agg(F.count("*").alias("n"))
    both = multiset_overlap(items, "owner", "field").filter(F.col("shared") >= least)
    both = both.join(multiset_overlap(items.filter("is_object"), "owner", "field").select("a", "b"), ["a", "b"], "left_semi")
    both = both.join(sizes.select(F.col("owner").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("owner").alias("b"), F.col("n").alias("nb")), "b")
    how = F.when((F.col("shared") == F.col("na")) & (F.col("shared") == F.col("nb")), "same").when(F.col("shared") == F.col("nb"), "superset").when(F.col("shared") == F.col("na"), "subset")
    return both.withColumn("how", how).filter("how is not null").select("a", "b", "how", "shared", (F.col("na") + F.col("nb") - 2 * F.col("shared")).alias("extra"))


def held(o: Ontology) -> DataFrame:
    """(owner, field, is_object): what the complete fields of each type hold; names do not count."""
    return fields(o).filter("owner is not null and held is not null").select("owner", F.col("held").alias("field"), "is_object")


def _both_ways(pairs: DataFrame) -> DataFrame:
    back = F.when(F.col("how") == "superset", "subset").when(F.col("how") == "subset", "superset").otherwise("same")
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), back.alias("how"), "shared", "extra"))


def compare(before: Ontology, after: Ontology) -> DataFrame:
    """(rule, severity, subject, message): what new and changed types repeat, and new ones that stand alone.

    same-shape: a type added or changed since ``before`` holds the same as
    another, or all of it, or nothing else, and did not before. new-orphan: a component of types and the
    types their fields hold without any type known before.
    """
    known, now = before.entities(t.CLASS), after.entities(t.CLASS)
    added = now.join(known, "iri", "left_anti")
    was, has = shapes(held(before)), shapes(held(after))
    changed = has.join(was.select("owner", "shape"), ["owner", "shape"], "left_anti").select(F.col("owner").alias("a"))
    rank = F.when(F.col("how") == "same", 0).when(F.col("how") == "superset", 1).otherwise(2)
    own = _both_ways(compared(held(after))).join(changed, "a", "left_semi")
    own = own.join(_both_ways(compared(held(before))).select("a", "b", "how"), ["a", "b", "how"], "left_anti")
    best = own.groupBy("a").agg(F.min(F.struct(rank.alias("rank"), "extra", "b", "how")).alias("m"))
    verb = F.when(F.col("m.how") == "same", " holds the same as ").when(F.col("m.how") == "superset", " holds all and more than ").otherwise(" holds nothing beyond ")
    same = best.select(F.lit("same-shape").alias("rule"), F.lit(WARNING).alias("severity"), F.col("a").alias("subject"), F.concat(F.col("a"), verb, F.col("m.b")).alias("message"))
    links = fields(after).filter("is_object and owner is not null").select(F.col("owner").alias("a"), F.col("held").alias("b")).filter("a <> b")
    steps = asserted.hierarchy(after).select(F.col("sub").alias("a"), F.col("super").alias("b"))
    roots = now.join(components(links.unionByName(steps)), F.col("iri") == F.col("node"), "left").select("iri", F.coalesce("root", "iri").alias("root"))
    old = roots.join(known, "iri", "left_semi").select("root").distinct()
    lone = roots.join(old, "root", "left_anti").join(added, "iri", "left_semi")
    orphan = lone.select(F.lit("new-orphan").alias("rule"), F.lit(INFO).alias("severity"), F.col("iri").alias("subject"), F.concat(F.col("iri"), F.lit(" touches no type known before")).alias("message"))
    return same.unionByName(orphan)


XSD_OF = {
    "string": "string", "boolean": "boolean", "byte": "byte", "short": "short", "integer": "int", "long": "long", "float": "float", "double": "double", "decimal": "decimal", "date": "date",
    "timestamp": "dateTime", "timestamp_ntz": "dateTime", "binary": "base64Binary",
}


def describe(spark, schemas: dict, base: str, comments: dict[str, str] | None = None) -> Ontology:
    """An ontology of table schemas: tables and nested structs are classes, columns are properties.

    ``schemas`` maps a name to a StructType. Arrays are read through to their
    elements; maps to their values. Nested structs become classes named
    ``table.column``.
    """
    from pyspark.sql import types as T

    out: list = []

    def one(name: str, schema: T.StructType) -> None:
        own = t.cls(f"{base}{name}")
        out.append(t.make("Declaration", own))
        out.append(t.make("AnnotationAssertion", t.ann(f"{t.RDFS}label"), t.bare(own.iri), t.literal(name)))
        if comments and name in comments:
            out.append(t.make("AnnotationAssertion", t.ann(f"{t.RDFS}comment"), t.bare(own.iri), t.literal(comments[name])))
        for f in schema.fields:
            kind = f.dataType
            while isinstance(kind, (T.ArrayType, T.MapType)):
                kind = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType
            iri = f"{base}{name}.{f.name}"
            if isinstance(kind, T.StructType):
                p = t.obj(iri)
                out.extend([t.make("Declaration", p), t.make("ObjectPropertyDomain", p, own), t.make("ObjectPropertyRange", p, t.cls(iri))])
                one(f"{name}.{f.name}", kind)
            else:
                p = t.dat(iri)
                xsd = XSD_OF.get(kind.typeName(), "string")
                out.extend([t.make("Declaration", p), t.make("DataPropertyDomain", p, own), t.make("DataPropertyRange", p, t.datatype(f"{t.XSD}{xsd}"))])
                if not f.nullable and not isinstance(f.dataType, T.ArrayType):
                    out.append(t.make("FunctionalDataProperty", p))

    for name, schema in schemas.items():
        one(name, schema)
    return Ontology.of(spark, out, iri=base.rstrip("#/"))
