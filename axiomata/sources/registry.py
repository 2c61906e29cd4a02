"""A registry of published vocabularies: prefixes, namespaces and, where files are given, their axioms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomata.model import Ontology
from axiomata.operators import diff
from axiomata.operators.vocabulary import Vocabulary
from axiomata.sources import ofn

#: Prefix and namespace of vocabularies in wide use, in order of preference.
W3, PURL = "http://www.w3.org/", "http://purl.org/dc/"
PUBLIC = {
    "skos": f"{W3}2004/02/skos/core#", "dcterms": f"{PURL}terms/", "dc": f"{PURL}elements/1.1/", "foaf": "http://xmlns.com/" + "foaf/0.1/", "schema": "http://schema.org/", "sosa": f"{W3}ns/sosa/", "ssn": f"{W3}ns/ssn/",
    "prov": f"{W3}ns/prov#", "org": f"{W3}ns/org#", "time": f"{W3}2006/time#", "dcat": f"{W3}ns/dcat#", "void": "http://rdfs.org/ns/void#", "vcard": f"{W3}2006/vcard/ns#",
}


@dataclass(frozen=True)
class Entry:
    """One vocabulary; ``path`` is a functional-style document, or None where only the namespace is known."""

    prefix: str
    namespace: str
    path: str | None = None

    def ontology(self, spark: SparkSession) -> Ontology:
        """Its axioms, read afresh; raises ValueError without a document."""
        if self.path is None:
            raise ValueError(f"no document for {self.prefix}")
        text = spark.read.text(self.path, wholetext=True).first()[0]
        return ofn.ontology(spark, text)

    def vocabulary(self, spark: SparkSession) -> Vocabulary:
        return Vocabulary.of(self.ontology(spark), declared_only=True)


class Registry:
    """Vocabularies by prefix."""

    def __init__(self, entries: list[Entry] | None = None):
        self.entries = entries if entries is not None else [Entry(p, ns) for p, ns in PUBLIC.items()]

    def all(self) -> list[Entry]:
        return list(self.entries)

    def by_prefix(self, prefix: str) -> Entry | None:
        return next((e for e in self.entries if e.prefix == prefix), None)

    def owner(self, iri: str) -> Entry | None:
        """The entry whose namespace is the longest that starts the IRI."""
        return max((e for e in self.entries if iri.startswith(e.namespace)), key=lambda e: len(e.namespace), default=None)

    def prefixes(self) -> dict[str, str]:
        from axiomata.functions.names import prefixes

        return prefixes(**{e.prefix: e.namespace for e in self.entries})

    def table(self, spark: SparkSession) -> DataFrame:
        """(prefix, ns, place), for joins with :func:`axiomata.operators.vocabulary.owner`."""
        return spark.createDataFrame([(e.prefix, e.namespace, i) for i, e in enumerate(self.entries)], "prefix string, ns string, place int")

    def merge(self, spark: SparkSession, iri: str, *prefixes: str) -> Ontology:
        """The documents of the named entries as one ontology that records them as imports."""
        return diff.merge(iri, *[e.ontology(spark) for e in self.entries if e.prefix in prefixes])


def skip_summary(skipped: DataFrame) -> DataFrame:
    """(reason, n) of statements that a conversion left out."""
    return skipped.groupBy("reason").agg(F.count("*").alias("n"))
