"""Reports as single JSON columns, built by aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axiomata.functions import terms as t
from axiomata.model import Ontology
from axiomata.operators import asserted, diff, el, lint, profiles


def _json(df: DataFrame, **fields) -> DataFrame:
    return df.select(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("report"))


def _listed(df: DataFrame, order: list[str], *cols: str) -> DataFrame:
    """One row with the rows of ``df`` as an ordered array of structs."""
    keys = F.struct(*order, F.struct(*cols).alias("row"))
    return df.agg(F.transform(F.array_sort(F.collect_list(keys)), lambda x: x["row"]).alias("items"))


def lint_report(o: Ontology, found: DataFrame) -> DataFrame:
    """Findings with a summary that has all three severities."""
    name = F.get(F.array(*map(F.lit, lint.SEVERITIES)), F.col("severity"))
    rows = found.withColumn("level", name).withColumn("worst", -F.col("severity"))
    items = _listed(rows, ["worst", "rule", "subject", "message"], "rule", "level", "subject", "message")
    counts = found.agg(*[F.count_if(F.col("severity") == i).alias(s) for i, s in enumerate(lint.SEVERITIES)])
    return _json(items.crossJoin(counts), ontology=F.lit(o.iri), findings=F.col("items"), summary=F.struct(*lint.SEVERITIES))  # two rows of one


def rules_report(spark, rules: tuple[lint.Rule, ...] = lint.DEFAULT) -> DataFrame:
    rows = spark.createDataFrame([(r.name, lint.SEVERITIES[r.severity], r.description) for r in rules], "name string, severity string, description string")
    return _json(_listed(rows, ["name"], "name", "severity", "description"), rules=F.col("items"))


def diff_report(before: Ontology, after: Ontology, details: bool = True) -> DataFrame:
    rows = diff.diff(before, after)
    counts = rows.agg(F.count_if(F.col("change") == "+").alias("added"), F.count_if(F.col("change") == "-").alias("removed"))
    head = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("change", "field", "text"), h)]) for h in diff.diff_header(before, after)])
    if not details:
        return _json(counts, header=head, added=F.col("added"), removed=F.col("removed"))
    items = _listed(rows, ["change", "idx", "text"], "change", "text")
    return _json(items.crossJoin(counts), header=head, added=F.col("added"), removed=F.col("removed"), axioms=F.col("items"))  # two rows of one


def profile_report(o: Ontology) -> DataFrame:
    rows = profiles.check(o)
    spark = o.axioms.sparkSession
    every = spark.createDataFrame([(p, i) for i, p in enumerate(("EL", "QL", "RL", "DL"))], "profile string, place int")
    per = every.join(rows.groupBy("profile").agg(F.array_sort(F.collect_list(F.struct("idx", "node", "reason"))).alias("violations")), "profile", "left")
    per = per.withColumn("ok", F.col("violations").isNull())
    return _json(_listed(per, ["place"], "profile", "ok", "violations"), ontology=F.lit(o.iri), profiles=F.col("items"))


def stats_report(o: Ontology) -> DataFrame:
    """Counts of entities and axioms; axiom kinds by count, then name."""
    kinds = asserted.axiom_kinds(o).withColumn("less", -F.col("n"))
    items = _listed(kinds, ["less", "kind"], "kind", "n")
    counts = asserted.statistics(o).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("measure", "n")))).alias("counts"))
    return _json(items.crossJoin(counts), ontology=F.lit(o.iri), counts=F.col("counts"), axioms=F.col("items"))  # two rows of one


def classify_report(c: el.Classification, axioms: bool = True) -> DataFrame:
    low = _listed(c.unsatisfiable(), ["iri"], "iri").select(F.transform("items", lambda x: x["iri"]).alias("low"))
    bad = _listed(c.unsupported(), ["idx"], "text").select(F.transform("items", lambda x: x["text"]).alias("bad"))
    both = low.crossJoin(bad)  # rows of one
    fields = {"ontology": F.lit(c.ontology.iri), "consistent": F.lit(c.consistent()), "unsatisfiable": F.col("low"), "unsupported": F.col("bad")}
    if axioms:
        both = both.crossJoin(_listed(c.inferred(), ["text"], "text").select(F.transform("items", lambda x: x["text"]).alias("axioms")))
        fields["axioms"] = F.col("axioms")
    return _json(both, **fields)


def explain_report(c: el.Classification, sub: str, sup: str) -> DataFrame:
    pair = c.facts.sparkSession.createDataFrame([(sub, sup)], "sub string, super string")
    yes = not c.is_subsumed(pair).isEmpty()
    rows = c.explain(sub, sup) if yes else c.ontology.axioms.limit(0)
    items = _listed(rows, ["text"], "text").select(F.transform("items", lambda x: x["text"]).alias("axioms"))
    return _json(items, sub=F.lit(sub), super=F.lit(sup), entailed=F.lit(yes), axioms=F.col("axioms"))


def findings_report(o: Ontology, found: DataFrame, **more) -> DataFrame:
    """Findings of comparisons and invariants with extra constant fields."""
    items = _listed(found.withColumn("worst", -F.col("severity")), ["worst", "rule", "subject", "message"], "rule", "severity", "subject", "message")
    return _json(items, ontology=F.lit(o.iri), findings=F.col("items"), **{k: F.lit(v) for k, v in more.items()})


KIND_NAMES = t.KINDS
