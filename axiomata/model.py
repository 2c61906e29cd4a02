"""An ontology as a DataFrame of axioms, with views derived from it.

``axioms`` has one row for each axiom: ``idx`` (document order, with gaps allowed), ``kind``
(without annotations), ``text`` and ``canon`` (full-IRI renderings, the second of the canonical form,
annotations included), ``notes`` (nodes of the annotations) and ``nodes`` (the expression tree in
preorder). Trees are nested in their row, so walking them is a narrow ``explode``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomata.functions import names
from axiomata.functions import terms as t
from axiomata.functions.terms import AXIOM, Term
from axiomata.plans.fixpoint import checkpointed


@dataclass(frozen=True)
class Ontology:
    """Axioms and header. Methods return new ontologies; nothing is changed in place."""

    axioms: DataFrame
    iri: str = ""
    version: str = ""
    imports: tuple[str, ...] = ()
    notes: tuple[Term, ...] = ()
    prefixes: dict[str, str] = field(default_factory=names.prefixes)

    # construction

    @staticmethod
    def of(spark: SparkSession, axioms: Iterable[Term | tuple[Term, tuple[Term, ...]]], **header) -> Ontology:
        """From terms of Python values, each alone or with its annotations."""
        rows = [t.row(i, *(a if isinstance(a, tuple) else (a,))) for i, a in enumerate(axioms)]
        return Ontology(spark.createDataFrame(rows, AXIOM), **header)

    @staticmethod
    def from_columns(df: DataFrame, idx: Column, axiom: Term, notes: tuple[Term, ...] = (), **header) -> Ontology:
        """One axiom for each row of ``df``; the leaves of ``axiom`` may be its columns. ``idx`` must be unique."""
        made = t.columns(axiom, notes)
        return Ontology(df.select(idx.cast("long").alias("idx"), *[made[c].alias(c) for c in made]), **header)

    def header(self, **changes) -> Ontology:
        return replace(self, **changes)

    def prefix(self, name: str, namespace: str) -> Ontology:
        return replace(self, prefixes=self.prefixes | {name.rstrip(":"): namespace})

    def importing(self, iri: str) -> Ontology:
        """Imports are recorded, never loaded."""
        return replace(self, imports=(*self.imports, iri))

    def annotate(self, prop: Term, value: Term) -> Ontology:
        return replace(self, notes=(*self.notes, t.make("Annotation", prop, value)))

    def add(self, *others: Ontology, step: int | None = None) -> Ontology:
        """Append other ontologies' axioms after this one's.

        With ``step`` all parts must have ``idx`` below it and no job is run;
        otherwise the largest ``idx`` of each part but the last is looked up.
        """
        out, base = self.axioms, 0
        parts = [self, *others]
        for before, part in zip(parts, parts[1:]):
            top = step if step is not None else (before.axioms.agg(F.max("idx")).first()[0] or 0) + 1
            base += top
            out = out.unionByName(part.axioms.withColumn("idx", F.col("idx") + base))
        return replace(self, axioms=out)

    def declare(self, *entities: Term) -> Ontology:
        """Append a declaration of each entity."""
        return self.add(Ontology.of(self.axioms.sparkSession, [t.make("Declaration", e) for e in entities]))

    def rewrite(self, f: Callable[[DataFrame], DataFrame]) -> Ontology:
        """Map the axioms with a DataFrame function."""
        return replace(self, axioms=f(self.axioms))

    def sort(self) -> Ontology:
        """Number the axioms by their text; equal texts keep their order. Ranks come from a range sort."""
        return replace(self, axioms=ranked(self.axioms, "text", "idx"))

    # views

    def kind(self, *kinds: str) -> DataFrame:
        return self.axioms.filter(F.col("kind").isin(*kinds))

    def walk(self) -> DataFrame:
        """All nodes of all axioms: (idx, axiom, and the fields of a node)."""
        return self.axioms.select("idx", F.col("kind").alias("axiom"), F.explode("nodes").alias("n")).select("idx", "axiom", "n.*")

    def mentions(self) -> DataFrame:
        """(idx, axiom, at, kind, iri): every mention of an entity, with repeats.

        Literals mention their datatype; annotations of axioms mention their
        properties and datatypes (``at`` is negative there). Bare IRIs, facets and
        anonymous individuals are not entities.
        """
        inner = self.axioms.select("idx", F.col("kind").alias("axiom"), F.explode(F.concat(
            F.transform("notes", lambda n, i: _mention(n, i - 1_000_000)), F.transform("nodes", lambda n, i: _mention(n, i)),
        )).alias("m")).filter("m.iri is not null")
        return inner.select("idx", "axiom", "m.at", "m.kind", "m.iri")

    def header_mentions(self) -> DataFrame:
        spark = self.axioms.sparkSession
        rows = [(kind, iri) for note in self.notes for *_, kind, iri in _entities(note)]
        return spark.createDataFrame(rows, "kind int, iri string")

    def signature(self) -> DataFrame:
        """(kind, iri): distinct entities of axioms and header, unordered."""
        own = self.mentions().select("kind", "iri")
        return (own.unionByName(self.header_mentions()) if self.notes else own).distinct()

    def entities(self, kind: int) -> DataFrame:
        return self.signature().filter(F.col("kind") == kind).select("iri")

    def declared(self) -> DataFrame:
        """(kind, iri): declared entities."""
        n = F.get(F.col("nodes"), F.lit(1))
        return self.kind("Declaration").select(n["kind"].alias("kind"), n["iri"].alias("iri")).distinct()

    def count(self) -> int:
        return self.axioms.count()

    def text(self, c: Column | str = "text") -> Column:
        """A full-IRI rendering rewritten with this ontology's prefixes."""
        return abbreviated(F.col(c) if isinstance(c, str) else c, self.prefixes)


def _mention(n: Column, at: Column) -> Column:
    lit = n["op"] == "Literal"
    iri = F.when(lit & (n["datatype"] != ""), n["datatype"]).when(n["kind"].isNotNull(), n["iri"])
    kind = F.when(lit, F.lit(t.DATATYPE)).otherwise(n["kind"])
    return F.struct(at.alias("at"), kind.alias("kind"), iri.alias("iri"))


def _entities(x: Term) -> Iterable[tuple]:
    for row in t.nodes(x):
        fields = dict(zip([f.name for f in t.NODE], row))
        if fields["kind"] is not None:
            yield fields["kind"], fields["iri"]
        elif fields["op"] == "Literal" and fields["datatype"]:
            yield t.DATATYPE, fields["datatype"]


def ranked(df: DataFrame, *by: str) -> DataFrame:
    """``df`` with ``idx`` replaced by the rank in the given order, from 0.

    A range sort and the sizes of its partitions, so no single task sees all
    rows (a window without partitions would). The sorted rows are written with their
    places: another run of the sort draws other bounds, which the sizes do not fit.
    """
    ordered = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__own", F.monotonically_increasing_id())
    ordered = checkpointed(ordered.withColumn("__part", F.shiftright("__own", 33)))
    sizes = sorted((r["__part"], r["n"]) for r in ordered.groupBy("__part").agg(F.count("*").alias("n")).collect())  # one row a partition
    starts, total = [], 0
    for part, n in sizes:
        starts += [F.lit(part), F.lit(total)]
        total += n
    if not starts:
        return df
    base = F.element_at(F.create_map(*starts), F.col("__part"))
    own = F.col("__own").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.withColumn("idx", (base + own).cast("long")).drop("__own", "__part")


def abbreviated(c: Column, table: dict[str, str]) -> Column:
    """Replace bracketed IRIs outside string literals by their compact names."""
    parts = F.regexp_extract_all(c, F.lit(r'"(?:[^"\\]|\\.)*"|<[^<>" ]*>|[^"<]+'), F.lit(0))
    own = F.transform(parts, lambda p: F.when(p.startswith("<"), names.written(F.substr(p, F.lit(2), F.length(p) - 2), table)).otherwise(p))
    return F.array_join(own, "")
