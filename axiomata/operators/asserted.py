"""Asserted facts: hierarchy, types, values and labels, as joins over the axioms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axiomata.functions import terms as t
from axiomata.model import Ontology
from axiomata.plans.fixpoint import closure


def child(pos: int) -> Column:
    """The direct part number ``pos`` of an axiom.

    Where all parts before it are leaves it is simply node ``pos + 1``. For
    axioms built from columns that is known to the optimizer, which then drops the
    array and computes only the fields that are used.
    """
    near = F.get(F.col("nodes"), F.lit(pos + 1))
    if pos == 0:
        return near
    far = F.get(F.filter("nodes", lambda n: (n["parent"] == 0) & (n["pos"] == pos)), F.lit(0))
    return F.when((near["parent"] == 0) & (near["pos"] == pos), near).otherwise(far)


def parts() -> Column:
    """The direct parts of an axiom, in order."""
    return F.filter("nodes", lambda n: n["parent"] == 0)


def named_subclasses(o: Ontology) -> DataFrame:
    """(idx, sub, super): SubClassOf axioms between named classes, as written."""
    x = o.kind("SubClassOf").select("idx", child(0).alias("a"), child(1).alias("b"))
    return x.filter(f"a.kind = {t.CLASS} and b.kind = {t.CLASS}").select("idx", F.col("a.iri").alias("sub"), F.col("b.iri").alias("super"))


def hierarchy(o: Ontology) -> DataFrame:
    """(sub, super): distinct direct steps between named classes.

    Equivalences add both directions between their named operands; a class
    stated below itself keeps that step, equivalences add none of the kind.
    """
    named = o.kind("EquivalentClasses").select(F.transform(F.filter(parts(), lambda n: n["kind"] == t.CLASS), lambda n: n["iri"]).alias("c"))
    pairs = named.select(F.explode("c").alias("sub"), "c").select("sub", F.explode("c").alias("super")).filter("sub <> super")
    return named_subclasses(o).select("sub", "super").unionByName(pairs).distinct()


def super_classes(o: Ontology, of: str | None = None) -> DataFrame:
    h = hierarchy(o)
    return h if of is None else h.filter(F.col("sub") == of)


def sub_classes(o: Ontology, of: str | None = None) -> DataFrame:
    h = hierarchy(o)
    return h if of is None else h.filter(F.col("super") == of)


def ancestors(o: Ontology, of: DataFrame | None = None) -> DataFrame:
    """(cls, ancestor) of all classes, or of those in the one column of ``of``; never the class itself."""
    return closure(hierarchy(o).select(F.col("sub").alias("cls"), F.col("super").alias("ancestor")), "cls", "ancestor", of)


def descendants(o: Ontology, of: DataFrame | None = None) -> DataFrame:
    """(cls, descendant), as :func:`ancestors` downwards."""
    return closure(hierarchy(o).select(F.col("super").alias("cls"), F.col("sub").alias("descendant")), "cls", "descendant", of)


def _assertions(o: Ontology, kind: str) -> DataFrame:
    return o.kind(kind).select("idx", child(0).alias("p"), child(1).alias("s"), child(2).alias("v"))


def types(o: Ontology) -> DataFrame:
    """(idx, individual, type, type_canon): asserted class expressions of individuals (``_:`` for anonymous ones)."""
    x = o.kind("ClassAssertion").select("idx", child(0).alias("c"), child(1).alias("i"))
    return x.select("idx", name_of("i").alias("individual"), F.col("c.text").alias("type"), F.col("c.canon").alias("type_canon"), F.when(F.col("c.kind") == t.CLASS, F.col("c.iri")).alias("class"))


def instances(o: Ontology, expression: str) -> DataFrame:
    """Individuals asserted in exactly this rendering of a class expression."""
    return types(o).filter(F.col("type") == expression).select("individual").distinct()


def name_of(c: str) -> Column:
    """An individual's IRI, or its label after ``_:``."""
    return F.when(F.col(f"{c}.op") == "Anonymous", F.concat(F.lit("_:"), F.col(f"{c}.iri"))).otherwise(F.col(f"{c}.iri"))


def object_values(o: Ontology) -> DataFrame:
    """(idx, subject, property, object): asserted object values; property as text, so inverses differ."""
    x = _assertions(o, "ObjectPropertyAssertion")
    return x.select("idx", name_of("s").alias("subject"), F.col("p.text").alias("property"), name_of("v").alias("object"))


def data_values(o: Ontology) -> DataFrame:
    """(idx, subject, property, value, datatype, lang): asserted literals."""
    x = _assertions(o, "DataPropertyAssertion")
    return x.select("idx", name_of("s").alias("subject"), F.col("p.iri").alias("property"), "v.value", "v.datatype", "v.lang")


def first_notes(o: Ontology, prop: str) -> DataFrame:
    """(iri, text): the first literal of an annotation property on each IRI, whatever its language."""
    x = _assertions(o, "AnnotationAssertion").filter((F.col("p.iri") == prop) & (F.col("v.op") == "Literal"))
    return x.groupBy(F.col("s.iri").alias("iri")).agg(F.min_by("v.value", "idx").alias("text"))


def labels(o: Ontology) -> DataFrame:
    """(iri, text): first rdfs:label; an empty one counts."""
    return first_notes(o, f"{t.RDFS}label")


def comments(o: Ontology) -> DataFrame:
    return first_notes(o, f"{t.RDFS}comment")


def referencing(o: Ontology, entities: DataFrame) -> DataFrame:
    """(idx, kind, iri): each axiom that mentions one of ``entities`` (kind, iri), once for each entity."""
    return o.mentions().select("idx", "kind", "iri").join(entities.distinct(), ["kind", "iri"], "left_semi").distinct()


def axiom_kinds(o: Ontology) -> DataFrame:
    """(kind, n): axioms by keyword; chains count as SubObjectPropertyOf."""
    kind = F.when(F.col("kind") == "SubPropertyChainOf", "SubObjectPropertyOf").otherwise(F.col("kind"))
    return o.axioms.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def statistics(o: Ontology) -> DataFrame:
    """(measure, n): axioms, and entities of each kind."""
    names = F.array(*map(F.lit, t.KINDS))
    kinds = o.signature().groupBy("kind").agg(F.count("*").alias("n")).select(F.get(names, F.col("kind")).alias("measure"), "n")
    return o.axioms.agg(F.count("*").alias("n")).select(F.lit("axioms").alias("measure"), "n").unionByName(kinds)
