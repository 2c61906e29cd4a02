"""Closed vocabularies: term tables, tiered look-ups and validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axiomata.functions import names
from axiomata.functions import terms as t
from axiomata.model import Ontology
from axiomata.operators import asserted
from axiomata.sources import ofn

#: Order and headings of listings.
HEADINGS = ((t.CLASS, "Classes"), (t.OBJECT, "Object properties"), (t.DATA, "Data properties"), (t.ANNOTATION, "Annotation properties"), (t.INDIVIDUAL, "Individuals"), (t.DATATYPE, "Datatypes"))


@dataclass(frozen=True)
class Vocabulary:
    """``terms``: (kind, iri, name, label, comment), one row for each entity."""

    terms: DataFrame
    prefixes: dict[str, str]

    @staticmethod
    def of(o: Ontology, builtins: bool = False, declared_only: bool = False, kinds: tuple[int, ...] = ()) -> Vocabulary:
        """The signature of an ontology with names, first labels and first comments."""
        own = o.signature()
        if not builtins:
            own = own.filter(~names.is_builtin(F.col("iri")))
        if declared_only:
            own = own.join(o.declared(), ["kind", "iri"], "left_semi")
        if kinds:
            own = own.filter(F.col("kind").isin(*kinds))
        own = own.join(asserted.labels(o).withColumnRenamed("text", "label"), "iri", "left").join(asserted.comments(o).withColumnRenamed("text", "comment"), "iri", "left")
        name = F.coalesce(names.compact(F.col("iri"), o.prefixes), F.col("iri"))
        terms = own.select("kind", "iri", name.alias("name"), F.coalesce("label", F.lit("")).alias("label"), F.coalesce("comment", F.lit("")).alias("comment"))
        return Vocabulary(terms, o.prefixes)

    def of_kind(self, kind: int) -> DataFrame:
        return self.terms.filter(F.col("kind") == kind)

    def contains(self, entities: DataFrame) -> DataFrame:
        """The entities (kind, iri) that are terms."""
        return entities.join(self.terms, ["kind", "iri"], "left_semi")

    def candidates(self, asked: DataFrame, column: str = "name") -> DataFrame:
        """(asked, kind, iri, tier): terms that answer to each distinct name.

        Tier 0 is the term's name or full IRI, tier 1 the expanded name, tier
        2 the folded label; only the first tier with a hit counts.
        """
        q = asked.select(F.col(column).alias("asked")).filter("asked is not null").distinct()
        q = q.withColumn("expanded", names.expand(F.col("asked"), self.prefixes)).withColumn("folded", names.fold_label(F.col("asked")))
        x = self.terms.select("kind", "iri", "name", names.fold_label(F.col("label")).alias("key"))
        exact = q.join(x.select("kind", "iri", F.explode(F.array_distinct(F.array("name", "iri"))).alias("asked")), "asked").select("asked", "kind", "iri", F.lit(0).alias("tier"))
        wide = q.filter("expanded is not null").join(x, q["expanded"] == x["iri"]).select("asked", "kind", "iri", F.lit(1).alias("tier"))
        label = q.join(x.filter("key <> ''"), q["folded"] == x["key"]).select("asked", "kind", "iri", F.lit(2).alias("tier"))
        hits = exact.unionByName(wide).unionByName(label).distinct()
        best = hits.groupBy("asked").agg(F.min("tier").alias("tier"))
        return hits.join(best, ["asked", "tier"]).select("asked", "kind", "iri", "tier")

    def lookup(self, asked: DataFrame, column: str = "name", kind: int | None = None) -> DataFrame:
        """(asked, kind, iri): names that exactly one term (of the kind) answers to."""
        hits = self.candidates(asked, column)
        hits = hits if kind is None else hits.filter(F.col("kind") == kind)
        return hits.groupBy("asked").agg(F.count("*").alias("n"), F.min(F.struct("kind", "iri")).alias("t")).filter("n = 1").select("asked", "t.kind", "t.iri")

    def resolve(self, asked: DataFrame, column: str = "name") -> DataFrame:
        """(asked, kind, iri, status, suggestion): status is found, ambiguous or unknown."""
        hits = self.candidates(asked, column).groupBy("asked").agg(F.count("*").alias("n"), F.min(F.struct("kind", "iri")).alias("t"))
        q = asked.select(F.col(column).alias("asked")).filter("asked is not null").distinct().withColumn("near", names.simplify(F.col("asked")))
        order = F.struct("kind", "iri")
        keys = self.terms.select("name", order.alias("o"), F.explode(F.array_distinct(F.array(names.simplify(F.col("name")), names.simplify(F.col("label"))))).alias("near")).filter("near <> ''")
        nearest = keys.groupBy("near").agg(F.min_by("name", "o").alias("suggestion"))
        out = q.join(hits, "asked", "left").join(nearest, "near", "left")
        status = F.when(F.col("n") == 1, "found").when(F.col("n") > 1, "ambiguous").otherwise("unknown")
        one = F.when(F.col("n") == 1, F.col("t"))
        return out.select("asked", one["kind"].alias("kind"), one["iri"].alias("iri"), status.alias("status"), F.when(F.col("n").isNull(), F.col("suggestion")).alias("suggestion"))

    def unknown(self, o: Ontology) -> DataFrame:
        """(idx, kind, iri): entities of axioms that are neither terms nor builtin."""
        m = o.mentions().select("idx", "kind", "iri").distinct().filter(~names.is_builtin(F.col("iri")))
        return m.join(self.terms, ["kind", "iri"], "left_anti")

    def valid(self, o: Ontology) -> Ontology:
        """The axioms that use known terms only: a gate for axioms from elsewhere."""
        bad = self.unknown(o).select("idx").distinct()
        return o.rewrite(lambda df: df.join(bad, "idx", "left_anti"))

    def require(self, o: Ontology) -> None:
        """Raise ValueError that names up to 20 unknown terms."""
        rows = self.unknown(o).select("kind", "iri").distinct().orderBy("kind", "iri").limit(20).collect()
        if rows:
            raise ValueError("not in the vocabulary: " + ", ".join(f"{t.KINDS[r['kind']]} {r['iri']}" for r in rows))

    def parse_axiom(self, text: str) -> tuple[t.Term, tuple[t.Term, ...]]:
        """Read one axiom and refuse it (ValueError) where it names what the vocabulary does not have."""
        own = ofn.parse_axiom(text, self.prefixes)
        self.require(Ontology.of(self.terms.sparkSession, [own]))
        return own

    def parse_class(self, text: str) -> t.Term:
        """Read one class expression and refuse it (ValueError) where it names what the vocabulary does not have."""
        own = ofn.parse_class(text, self.prefixes)
        self.require(Ontology.of(self.terms.sparkSession, [t.make("SubClassOf", own, t.cls(t.THING))]))
        return own

    def listing(self) -> DataFrame:
        """(section, place, heading, line): the terms as text, to be ordered by section and place."""
        section = F.create_map(*[F.lit(x) for i, (k, _) in enumerate(HEADINGS) for x in (k, i)])
        heading = F.create_map(*[F.lit(x) for k, h in HEADINGS for x in (k, h)])
        flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
        note = F.concat(F.when(F.col("label") != "", F.concat(F.lit(" ("), flat(F.col("label")), F.lit(")"))).otherwise(""), F.when(F.col("comment") != "", F.concat(F.lit(": "), flat(F.col("comment")))).otherwise(""))
        place = F.row_number().over(Window.partitionBy("kind").orderBy("iri"))
        return self.terms.select(F.element_at(section, F.col("kind")).alias("section"), place.alias("place"), F.element_at(heading, F.col("kind")).alias("heading"), F.concat(F.lit("- "), F.col("name"), note).alias("line"))

    def prompt(self) -> str:
        """The listing as one text, with the prefixes it uses; for vocabularies that fit the driver."""
        rows = self.listing().orderBy("section", "place").collect()
        used = {r["line"][2:].split(":")[0] for r in rows if ":" in r["line"]}
        out = [f"{p}: <{self.prefixes[p]}>" for p in sorted(used & set(self.prefixes))]
        last = None
        for r in rows:
            if r["heading"] != last:
                out += ["", f"{r['heading']}:"]
                last = r["heading"]
            out.append(r["line"])
        return "\n".join(out).strip() + "\n"


def owner(iris: DataFrame, column: str, registry: DataFrame) -> DataFrame:
    """``iris`` with the registered (prefix, ns) whose namespace is the longest that starts the IRI.

    Candidates are the IRI's own beginnings up to each ``/``, ``#`` or ``:`` and
    the whole namespace lengths of the registry, so this is an equi-join, not a
    theta join; unregistered IRIs get null.
    """
    lengths = sorted(r[0] for r in registry.select(F.length("ns")).distinct().collect())  # few: one for each length
    if not lengths:
        return iris.withColumn("prefix", F.lit(None).cast("string"))
    c = F.col("__iri")
    starts = F.filter(F.array(*[F.when(F.length(c) >= n, F.substring(c, 1, n)) for n in lengths]), lambda s: s.isNotNull())
    keyed = iris.select(F.col(column).alias("__iri")).distinct().select("__iri", F.explode(starts).alias("ns"))
    best = keyed.join(registry.select("ns", "prefix"), "ns").groupBy("__iri").agg(F.max_by("prefix", F.struct(F.length("ns"), "prefix")).alias("prefix"))
    return iris.join(best, F.col(column) == F.col("__iri"), "left").drop("__iri")


def expanded(df: DataFrame, column: str, prefixes: dict[str, str]) -> DataFrame:
    """``df`` with ``iri`` and, where that is null, ``error``."""
    c: Column = F.col(column)
    return df.withColumn("iri", names.expand(c, prefixes)).withColumn("error", names.why_not_expanded(c, prefixes))
