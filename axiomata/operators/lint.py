"""Lint rules over asserted axioms: every rule maps an ontology to a table of findings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axiomata.functions import names
from axiomata.functions import terms as t
from axiomata.model import Ontology
from axiomata.operators import asserted, diff
from axiomata.plans.fixpoint import checkpointed, strong_components

INFO, WARNING, ERROR = 0, 1, 2
SEVERITIES = ("info", "warning", "error")


@dataclass(frozen=True)
class Rule:
    """A named check that gives (subject, message, idx) rows; idx is null where no axiom is meant."""

    name: str
    severity: int
    description: str
    check: Callable[[Ontology], DataFrame]


def severity(name: str) -> int:
    """The number of a severity's name; raises ValueError for another name."""
    return SEVERITIES.index(name.strip().lower())


def _kind_name(c: str = "kind"):
    return F.get(F.array(*map(F.lit, t.KINDS)), F.col(c))


def _found(df: DataFrame, subject, message, idx=None) -> DataFrame:
    return df.select(subject.alias("subject"), message.alias("message"), (F.lit(None) if idx is None else idx).cast("long").alias("idx"))


def _own(o: Ontology) -> DataFrame:
    return o.signature().filter(~names.is_builtin(F.col("iri")))


def undeclared_entity(o: Ontology) -> DataFrame:
    missing = _own(o).join(o.declared(), ["kind", "iri"], "left_anti")
    return _found(missing, F.col("iri"), F.concat(_kind_name(), F.lit(" "), F.col("iri"), F.lit(" has no declaration")))


def punned_entity(o: Ontology) -> DataFrame:
    kinds = _own(o).groupBy("iri").agg(F.array_sort(F.collect_set(_kind_name())).alias("k")).filter(F.size("k") > 1)
    return _found(kinds, F.col("iri"), F.concat(F.col("iri"), F.lit(" is at once "), F.array_join("k", ", ")))


def missing_label(o: Ontology) -> DataFrame:
    kinds = o.declared().filter(F.col("kind").isin(t.CLASS, t.OBJECT, t.DATA) & ~names.is_builtin(F.col("iri")))
    bare = kinds.join(asserted.labels(o), "iri", "left").filter(F.coalesce("text", F.lit("")) == "")
    return _found(bare, F.col("iri"), F.concat(_kind_name(), F.lit(" "), F.col("iri"), F.lit(" lacks a label")))


def deprecated_reference(o: Ontology) -> DataFrame:
    """One finding for each mention, but for declarations and annotations of deprecated terms."""
    x = o.kind("AnnotationAssertion").select("idx", asserted.child(0).alias("p"), asserted.child(1).alias("s"), asserted.child(2).alias("v"))
    gone = x.filter((F.col("p.iri") == f"{t.OWL}deprecated") & (F.col("v.op") == "Literal") & (F.col("v.value") == "true")).select(F.col("s.iri").alias("iri")).distinct()
    about = x.select("idx", F.col("s.iri").alias("iri")).join(gone, "iri", "left_semi").select("idx")
    hits = o.mentions().filter("axiom <> 'Declaration'").join(gone, "iri", "left_semi").join(about, "idx", "left_anti")
    texts = hits.join(o.axioms.select("idx", "text"), "idx")
    return _found(texts, F.col("iri"), F.concat(F.col("iri"), F.lit(" is deprecated, yet used in "), o.text()), F.col("idx"))


def duplicate_axiom(o: Ontology) -> DataFrame:
    return _found(diff.duplicates(o), F.lit(""), F.concat(F.lit("stated before: "), o.text()), F.col("idx"))


def trivial_axiom(o: Ontology) -> DataFrame:
    sets = F.size(F.array_distinct(F.transform(asserted.parts(), lambda n: n["canon"])))
    why = (
        F.when((F.col("kind") == "SubClassOf") & (asserted.child(0)["text"] == asserted.child(1)["text"]), F.lit("a class below itself"))
        .when((F.col("kind") == "EquivalentClasses") & (sets < 2), F.lit("equivalence of less than two classes"))
        .when((F.col("kind") == "DisjointClasses") & (sets < 2), F.lit("disjointness of less than two classes"))
        .when((F.col("kind") == "SameIndividual") & (sets < 2), F.lit("identity of less than two individuals"))
    )
    return _found(o.axioms.withColumn("why", why).filter("why is not null"), F.lit(""), F.concat(F.col("why"), F.lit(": "), o.text()), F.col("idx"))


def subclass_cycle(o: Ontology) -> DataFrame:
    """One finding for each strongly connected component of named SubClassOf steps: its classes in order.

    Which cycle a depth-first search meets first depends on its order; the
    component does not.
    """
    edges = asserted.named_subclasses(o).select("sub", "super").filter("sub <> super").distinct()
    groups = strong_components(checkpointed(edges.select(F.col("sub").alias("src"), F.col("super").alias("dst"))))
    if groups is None:
        return o.axioms.sparkSession.createDataFrame([], "subject string, message string, idx long")
    rings = groups.groupBy("root").agg(F.array_sort(F.collect_list("node")).alias("ring"))
    shown = F.transform("ring", lambda c: names.written(c, o.prefixes))
    path = F.array_join(F.concat(shown, F.slice(shown, 1, 1)), " -> ")
    return _found(rings, F.element_at("ring", 1), F.concat(F.lit("classes below each other: "), path))


def orphan_class(o: Ontology) -> DataFrame:
    sub = o.kind("SubClassOf").select(asserted.child(0).alias("n"))
    rest = o.kind("EquivalentClasses", "DisjointUnion").select(F.explode(asserted.parts()).alias("n"))
    held = sub.unionByName(rest).filter(f"n.kind = {t.CLASS}").select("n.iri").distinct()
    lone = o.entities(t.CLASS).filter(~names.is_builtin(F.col("iri"))).join(held, "iri", "left_anti")
    return _found(lone, F.col("iri"), F.concat(F.lit("class "), F.col("iri"), F.lit(" stands below nothing and equals nothing")))


def prefer_standard_terms(*references: DataFrame) -> Rule:
    """A rule that points out declared terms which a reference vocabulary names already.

    ``references`` are term tables (kind, iri, name, label), in order of
    preference. Within one kind the local name is compared first, then the label.
    """

    def check(o: Ontology) -> DataFrame:
        refs = reduce(DataFrame.unionByName, [r.select("kind", "iri", "name", "label").withColumn("ref", F.lit(i)) for i, r in enumerate(references)])
        local, label = names.fold(names.local_name(F.col("iri"))), names.fold(F.coalesce("label", F.lit("")))
        usable = lambda c: F.length(c) >= 3
        keys = refs.select("kind", F.col("iri").alias("other"), "name", "ref", F.explode(F.array_distinct(F.array(local, label))).alias("key")).filter(usable(F.col("key")))
        best = keys.groupBy("kind", "key").agg(F.min(F.struct("ref", "other", "name")).alias("best"))
        own = o.declared().filter(~names.is_builtin(F.col("iri"))).join(refs.select("kind", "iri").distinct(), ["kind", "iri"], "left_anti")
        own = own.join(asserted.labels(o), "iri", "left").withColumn("local", names.fold(names.local_name(F.col("iri")))).withColumn("label", names.fold(F.coalesce("text", F.lit(""))))
        by_name = own.filter(usable(F.col("local"))).join(best, (own["kind"] == best["kind"]) & (own["local"] == best["key"])).select(own["kind"], "iri", F.lit(0).alias("how"), F.col("text"), "best")
        by_label = own.filter(usable(F.col("label")) & (F.col("label") != F.col("local"))).join(best, (own["kind"] == best["kind"]) & (own["label"] == best["key"])).select(own["kind"], "iri", F.lit(1).alias("how"), F.col("text"), "best")
        hit = by_name.unionByName(by_label).groupBy("kind", "iri").agg(F.min_by(F.struct("how", "text", "best"), "how").alias("m")).select("kind", "iri", "m.*")
        hit = hit.withColumn("other", F.col("best.other"))
        # axioms that mention both of a pair: each side by itself, then the pair by axiom
        m = o.mentions().select("idx", "kind", "iri").distinct()
        here = m.join(hit.select("kind", "iri", "other"), ["kind", "iri"])
        there = m.select("idx", F.col("iri").alias("other")).distinct().join(hit.select("other").distinct(), "other", "left_semi")
        related = here.join(there, ["idx", "other"]).select("kind", "iri", "other").distinct()
        hit = hit.join(related, ["kind", "iri", "other"], "left_anti")
        how = F.when(F.col("how") == 0, F.lit("has the name of")).otherwise(F.concat(F.lit("is labelled like ")))
        return _found(hit, F.col("iri"), F.concat(F.lower(_kind_name()), F.lit(" "), names.written(F.col("iri"), o.prefixes), F.lit(" "), how, F.lit(" "), F.col("best.name")))

    return Rule("prefer-standard-term", INFO, "a term of its own where a standard vocabulary has one", check)


DEFAULT = (
    Rule("undeclared-entity", WARNING, "used entities are declared", undeclared_entity),
    Rule("punned-entity", WARNING, "an IRI names one kind of entity", punned_entity),
    Rule("missing-label", INFO, "declared classes and properties have labels", missing_label),
    Rule("deprecated-reference", WARNING, "deprecated terms are not used", deprecated_reference),
    Rule("duplicate-axiom", WARNING, "an axiom is stated once", duplicate_axiom),
    Rule("trivial-axiom", WARNING, "an axiom says something", trivial_axiom),
    Rule("subclass-cycle", ERROR, "the asserted hierarchy has no cycle", subclass_cycle),
    Rule("orphan-class", INFO, "a class has a place in the hierarchy", orphan_class),
)


def select(rules: tuple[Rule, ...], disabled: list[str]) -> tuple[tuple[Rule, ...], list[str]]:
    """The rules without those named, and the names that no rule has."""
    known = {r.name for r in rules}
    return tuple(r for r in rules if r.name not in disabled), sorted(set(disabled) - known)


def run(o: Ontology, rules: tuple[Rule, ...] = DEFAULT) -> DataFrame:
    """(rule, severity, subject, message, idx) of all rules; order by severity desc, rule, subject to show them."""
    parts = [r.check(o).select(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), "subject", "message", "idx") for r in rules]
    return reduce(DataFrame.unionByName, parts) if parts else o.axioms.sparkSession.createDataFrame([], "rule string, severity int, subject string, message string, idx long")


def sort_findings(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("severity"), "rule", "subject", "message", "idx")


def worst(found: DataFrame) -> int | None:
    """The greatest severity; None without findings."""
    return found.agg(F.max("severity")).first()[0]


def unseen(found: DataFrame, seen: DataFrame) -> DataFrame:
    """Findings whose (rule, subject, message) is not in a saved table."""
    return found.join(seen.select("rule", "subject", "message").distinct(), ["rule", "subject", "message"], "left_anti")


def numbered(found: DataFrame) -> DataFrame:
    """Findings with their place within the rule."""
    return found.withColumn("n", F.row_number().over(Window.partitionBy("rule").orderBy("subject", "message", "idx")))
