"""Queries of the ontology operators over ontologies derived from the driver's tables.

Every query comes with DuckDB SQL that states the same result over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomata import builders
from axiomata.functions import names
from axiomata.functions import terms as t
from axiomata.functions.terms import cat
from axiomata.model import Ontology
from axiomata.operators import asserted, conform, diff, el, icv, lint, profiles, rdfmap, reports, shapes, vocabulary
from axiomata.plans.fixpoint import components
from axiomata.sources import ofn, rdf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
U = "urn:x:"


def query(sql: str | None = None):
    """Register a query, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def iri(kind: str, c: str | Column) -> Column:
    """``urn:x:kind/value``."""
    c = F.col(c) if isinstance(c, str) else c
    return cat(f"{U}{kind}/", c.cast("string"))


def cls(kind: str, c) -> t.Term:
    return t.cls(iri(kind, c))


def ind(kind: str, c) -> t.Term:
    return t.ind(iri(kind, c))


def _p(name: str) -> t.Term:
    return t.obj(f"{U}{name}")


def _id() -> Column:
    return F.monotonically_increasing_id()


STEP = 1 << 50  # parts are numbered apart; ids of any part stay below


def places(spark: SparkSession, d: str) -> Ontology:
    """supplier < nation < region."""
    nation, supplier = table(spark, d, "nation"), table(spark, d, "supplier")
    a = Ontology.from_columns(nation, F.col("n_nationkey"), t.make("SubClassOf", cls("nation", "n_nationkey"), cls("region", "n_regionkey")))
    b = Ontology.from_columns(supplier, F.col("s_suppkey"), t.make("SubClassOf", cls("supplier", "s_suppkey"), cls("nation", "s_nationkey")))
    return a.add(b, step=STEP)


def halving(spark: SparkSession, d: str, term=None) -> Ontology:
    """Each part below the part of half its key."""
    part = table(spark, d, "part").filter("p_partkey > 0")
    half = F.floor(F.col("p_partkey") / 2).cast("long")
    return Ontology.from_columns(part, F.col("p_partkey"), term or t.make("SubClassOf", cls("part", "p_partkey"), cls("part", half)))


def ring(spark: SparkSession, d: str) -> Ontology:
    """The nations of a region and the suppliers of a nation, each below the next, the last below the first."""
    from pyspark.sql import Window

    def one(df: DataFrame, kind: str, key: str, group: str) -> Ontology:
        w = Window.partitionBy(group).orderBy(key)  # groups are regions and nations
        nxt = df.withColumn("nxt", F.coalesce(F.lead(key).over(w), F.first(key).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
        return Ontology.from_columns(nxt, F.col(key), t.make("SubClassOf", cls(kind, key), cls(kind, "nxt")))

    return one(table(spark, d, "nation"), "nation", "n_nationkey", "n_regionkey").add(one(table(spark, d, "supplier"), "supplier", "s_suppkey", "s_nationkey"), step=STEP)


_PLACES = f"""e AS (SELECT '{U}nation/' || n_nationkey AS sub, '{U}region/' || n_regionkey AS super FROM nation
  UNION SELECT '{U}supplier/' || s_suppkey, '{U}nation/' || s_nationkey FROM supplier)"""
_CLOSURE = "c AS (SELECT sub, super FROM e UNION SELECT c.sub, e.super FROM c JOIN e ON c.super = e.sub)"
_HALF = f"e AS (SELECT '{U}part/' || p_partkey AS sub, '{U}part/' || (p_partkey // 2) AS super FROM part WHERE p_partkey > 0)"
_RING = f"""r AS (SELECT 'nation' AS k, n_nationkey::BIGINT AS id, n_regionkey::BIGINT AS g FROM nation UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier),
e AS (SELECT '{U}' || k || '/' || id AS sub, '{U}' || k || '/' || coalesce(lead(id) OVER (PARTITION BY k, g ORDER BY id), min(id) OVER (PARTITION BY k, g)) AS super FROM r)"""


# == signature and hierarchy


def catalogue(spark: SparkSession, d: str) -> Ontology:
    """Brands below types, suppliers in nations, nations below regions."""
    a = Ontology.from_columns(table(spark, d, "part"), F.col("p_partkey"), t.make("SubClassOf", cls("brand", "p_brand"), cls("type", "p_type")))
    b = Ontology.from_columns(table(spark, d, "supplier"), F.col("s_suppkey"), t.make("ClassAssertion", cls("nation", "s_nationkey"), ind("supplier", "s_suppkey")))
    c = Ontology.from_columns(table(spark, d, "nation"), F.col("n_nationkey"), t.make("SubClassOf", cls("nation", "n_nationkey"), cls("region", "n_regionkey")))
    return a.add(b, c, step=STEP)


_SIGNATURE = f"""SELECT 0 AS kind, '{U}brand/' || p_brand AS iri FROM part UNION SELECT 0, '{U}type/' || p_type FROM part
UNION SELECT 0, '{U}nation/' || s_nationkey FROM supplier UNION SELECT 0, '{U}nation/' || n_nationkey FROM nation
UNION SELECT 0, '{U}region/' || n_regionkey FROM nation UNION SELECT 5, '{U}supplier/' || s_suppkey FROM supplier"""


@query(_SIGNATURE)
def signature(spark, d):
    return catalogue(spark, d).signature()


@query(f"""SELECT 'axioms' AS measure, (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) AS n
UNION ALL SELECT CASE kind WHEN 0 THEN 'Class' ELSE 'NamedIndividual' END, count(*) FROM ({_SIGNATURE}) GROUP BY kind""")
def stats_counts(spark, d):
    return asserted.statistics(catalogue(spark, d))


@query("SELECT 'SubClassOf' AS kind, (SELECT count(*) FROM part) + (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'ClassAssertion', count(*) FROM supplier")
def stats_axiom_kinds(spark, d):
    return asserted.axiom_kinds(catalogue(spark, d))


@query(f"WITH {_PLACES} SELECT sub, super FROM e")
def super_classes(spark, d):
    return asserted.super_classes(places(spark, d))


@query(f"WITH {_PLACES} SELECT super, sub FROM e")
def sub_classes(spark, d):
    return asserted.sub_classes(places(spark, d)).select("super", "sub")


@query(f"WITH RECURSIVE {_PLACES}, {_CLOSURE} SELECT sub AS cls, super AS ancestor FROM c WHERE sub <> super")
def ancestors(spark, d):
    return asserted.ancestors(places(spark, d))


@query(f"WITH RECURSIVE {_HALF}, {_CLOSURE} SELECT sub AS cls, super AS ancestor FROM c WHERE sub <> super")
def ancestors_deep(spark, d):
    return asserted.ancestors(halving(spark, d))


@query(f"WITH RECURSIVE {_RING}, {_CLOSURE} SELECT sub AS cls, super AS ancestor FROM c WHERE sub <> super")
def ancestors_cyclic(spark, d):
    return asserted.ancestors(ring(spark, d))


@query(f"WITH RECURSIVE {_PLACES}, {_CLOSURE} SELECT super AS cls, sub AS descendant FROM c WHERE super LIKE '{U}region/%'")
def descendants(spark, d):
    o = places(spark, d)
    regions = table(spark, d, "region").select(iri("region", "r_regionkey").alias("cls"))
    return asserted.descendants(o, regions)


@query(f"WITH e AS (SELECT DISTINCT '{U}brand/' || p_brand AS a, '{U}type/' || p_type AS b FROM part) SELECT a AS sub, b AS super FROM e UNION SELECT b, a FROM e")
def equivalent_steps(spark, d):
    o = Ontology.from_columns(table(spark, d, "part"), F.col("p_partkey"), t.make("EquivalentClasses", cls("brand", "p_brand"), cls("type", "p_type")))
    return asserted.hierarchy(o)


# == look-ups


def order_types(spark: SparkSession, d: str) -> Ontology:
    return Ontology.from_columns(table(spark, d, "orders"), F.col("o_orderkey"), t.make("ClassAssertion", cls("status", "o_orderstatus"), ind("order", "o_orderkey")))


@query(f"SELECT '{U}order/' || o_orderkey AS individual, '<{U}status/' || o_orderstatus || '>' AS type FROM orders")
def types_of(spark, d):
    return asserted.types(order_types(spark, d)).select("individual", "type")


@query(f"SELECT DISTINCT '{U}order/' || o_orderkey AS individual FROM orders WHERE o_orderstatus = 'F'")
def instances_of(spark, d):
    return asserted.instances(order_types(spark, d), f"<{U}status/F>")


@query(f"SELECT '{U}order/' || o_orderkey AS subject, '<{U}placedBy>' AS property, '{U}customer/' || o_custkey AS object FROM orders")
def object_values(spark, d):
    o = Ontology.from_columns(table(spark, d, "orders"), F.col("o_orderkey"), t.make("ObjectPropertyAssertion", _p("placedBy"), ind("order", "o_orderkey"), ind("customer", "o_custkey")))
    return asserted.object_values(o).select("subject", "property", "object")


@query(f"SELECT '{U}part/' || p_partkey AS subject, '{U}size' AS property, p_size::VARCHAR AS value, '{t.XSD}integer' AS datatype FROM part")
def data_values(spark, d):
    value = t.literal(F.col("p_size").cast("string"), f"{t.XSD}integer")
    o = Ontology.from_columns(table(spark, d, "part"), F.col("p_partkey"), t.make("DataPropertyAssertion", t.dat(f"{U}size"), ind("part", "p_partkey"), value))
    return asserted.data_values(o).select("subject", "property", "value", "datatype")


def brand_labels(spark: SparkSession, d: str) -> Ontology:
    return Ontology.from_columns(table(spark, d, "part"), F.col("p_partkey"), t.make("AnnotationAssertion", t.ann(f"{t.RDFS}label"), t.bare(iri("brand", "p_brand")), t.literal(F.col("p_name"), lang="en")))


@query(f"SELECT '{U}brand/' || p_brand AS iri, arg_min(p_name, p_partkey) AS text FROM part GROUP BY p_brand")
def first_label(spark, d):
    return asserted.labels(brand_labels(spark, d))


@query(f"""SELECT s_suppkey AS idx, 0 AS kind, '{U}nation/' || s_nationkey AS iri FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = (SELECT min(r_name) FROM region)""")
def axioms_referencing(spark, d):
    o = Ontology.from_columns(table(spark, d, "supplier"), F.col("s_suppkey"), t.make("ClassAssertion", cls("nation", "s_nationkey"), ind("supplier", "s_suppkey")))
    first = table(spark, d, "region").orderBy("r_name").limit(1)
    asked = table(spark, d, "nation").join(F.broadcast(first), F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit(0).alias("kind"), iri("nation", "n_nationkey").alias("iri"))
    return asserted.referencing(o, asked).select("idx", "kind", "iri")


# == canonical form, diff


@query(f"""WITH x AS (SELECT '<{U}key/' || l_partkey || '>' AS a, '<{U}key/' || l_suppkey || '>' AS b FROM lineitem)
SELECT 'DisjointClasses(' || least(a, b) || CASE WHEN a = b THEN '' ELSE ' ' || greatest(a, b) END || ')' AS canon, count(*) AS n FROM x GROUP BY ALL""")
def canonical_pairs(spark, d):
    o = Ontology.from_columns(table(spark, d, "lineitem"), _id(), t.make("DisjointClasses", cls("key", "l_partkey"), cls("key", "l_suppkey")))
    return o.axioms.groupBy("canon").agg(F.count("*").alias("n"))


@query(f"""WITH x AS (SELECT '<{U}b/' || p_brand || '>' AS b, '<{U}t/' || p_type || '>' AS ty, '<{U}s/' || p_size || '>' AS s, '<{U}part/' || p_partkey || '>' AS p FROM part)
SELECT 'SubClassOf(' || p || ' ObjectIntersectionOf(' || b || ' ' || s || ' ' || ty || ' ObjectSomeValuesFrom(<{U}has> ' || ty || ')))' AS canon,
  'SubClassOf(' || p || ' ObjectIntersectionOf(' || ty || ' ObjectIntersectionOf(' || s || ' ' || b || ' ' || ty || ') ObjectSomeValuesFrom(<{U}has> ObjectUnionOf(' || ty || ' ' || ty || '))))' AS text FROM x""")
def canonical_nested(spark, d):
    b, ty, s = cls("b", "p_brand"), cls("t", "p_type"), cls("s", "p_size")
    e = t.conj(ty, t.conj(s, b, ty), t.some(_p("has"), t.disj(ty, ty)))
    return Ontology.from_columns(table(spark, d, "part"), F.col("p_partkey"), t.make("SubClassOf", cls("part", "p_partkey"), e)).axioms.select("canon", "text")


def order_lines(spark: SparkSession, d: str) -> Ontology:
    fact = t.make("ObjectPropertyAssertion", _p("hasLine"), ind("order", "l_orderkey"), ind("line", "l_linenumber"))
    return Ontology.from_columns(table(spark, d, "lineitem"), _id(), fact)


@query(f"""SELECT 'ObjectPropertyAssertion(<{U}hasLine> <{U}order/' || l_orderkey || '> <{U}line/' || l_linenumber || '>)' AS text, count(*) - 1 AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def duplicate_axiom(spark, d):
    return diff.duplicates(order_lines(spark, d)).groupBy("text").agg(F.count("*").alias("n"))


def supply(spark: SparkSession, d: str, flag: str) -> Ontology:
    rows = table(spark, d, "lineitem").filter(F.col("l_returnflag") == flag)
    return Ontology.from_columns(rows, _id(), t.make("ObjectPropertyAssertion", _p("by"), ind("part", "l_partkey"), ind("supplier", "l_suppkey")))


_DIFF = """WITH a AS (SELECT l_partkey p, l_suppkey s, count(*) n FROM lineitem WHERE l_returnflag = '{0}' GROUP BY ALL), b AS (SELECT l_partkey p, l_suppkey s, count(*) n FROM lineitem WHERE l_returnflag = '{1}' GROUP BY ALL)
SELECT 'ObjectPropertyAssertion(<urn:x:by> <urn:x:part/' || a.p || '> <urn:x:supplier/' || a.s || '>)' AS text, a.n - coalesce(b.n, 0) AS n FROM a LEFT JOIN b USING (p, s) WHERE a.n > coalesce(b.n, 0)"""


@query(_DIFF.format("A", "R"))
def diff_removed(spark, d):
    return diff.diff_axioms(supply(spark, d, "A"), supply(spark, d, "R"))[0].groupBy("text").agg(F.count("*").alias("n"))


@query(_DIFF.format("R", "A"))
def diff_added(spark, d):
    return diff.diff_axioms(supply(spark, d, "A"), supply(spark, d, "R"))[1].groupBy("text").agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT 'ObjectPropertyAssertion(<{U}by> <{U}part/' || l_partkey || '> <{U}supplier/' || l_suppkey || '>)' AS text FROM lineitem WHERE l_returnflag IN ('A', 'R')")
def overlay(spark, d):
    return diff.overlay(supply(spark, d, "A"), supply(spark, d, "R"), step=STEP).axioms.select("text")


@query(f"WITH e AS (SELECT 'DisjointClasses(<{U}brand/' || p_brand || '> <{U}part/' || p_partkey || '>)' AS text FROM part) SELECT text, (row_number() OVER (ORDER BY text) - 1)::BIGINT AS idx FROM e")
def sorted_axioms(spark, d):
    o = Ontology.from_columns(table(spark, d, "part"), F.col("p_partkey"), t.make("DisjointClasses", cls("brand", "p_brand"), cls("part", "p_partkey")))
    return o.sort().axioms.select("text", "idx")


# == lint


def _declare(df: DataFrame, idx: Column, entity: t.Term) -> Ontology:
    return Ontology.from_columns(df, idx, t.make("Declaration", entity))


@query(f"""WITH m AS (SELECT DISTINCT l_orderkey AS k FROM lineitem) SELECT '{U}order/' || k AS subject, 'NamedIndividual {U}order/' || k || ' has no declaration' AS message
FROM m WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = k AND o_orderstatus = 'O')""")
def undeclared_entity(spark, d):
    lines = Ontology.from_columns(table(spark, d, "lineitem"), _id(), t.make("ClassAssertion", t.cls(t.THING), ind("order", "l_orderkey")))
    known = _declare(table(spark, d, "orders").filter("o_orderstatus = 'O'"), F.col("o_orderkey"), ind("order", "o_orderkey"))
    return lint.undeclared_entity(lines.add(known, step=STEP)).select("subject", "message")


@query(f"""SELECT DISTINCT '{U}name/' || p_brand AS subject, '{U}name/' || p_brand || ' is at once Class, NamedIndividual' AS message FROM part WHERE p_size > 45""")
def punned_entity(spark, d):
    part = table(spark, d, "part")
    a = _declare(part, F.col("p_partkey"), cls("name", "p_brand"))
    b = _declare(part.filter("p_size > 45"), F.col("p_partkey"), ind("name", "p_brand"))
    return lint.punned_entity(a.add(b, step=STEP)).select("subject", "message")


@query(f"""SELECT '{U}part/' || p_partkey AS subject, 'Class {U}part/' || p_partkey || ' lacks a label' AS message FROM part WHERE p_size <= 25""")
def missing_label(spark, d):
    part = table(spark, d, "part")
    a = _declare(part, F.col("p_partkey"), cls("part", "p_partkey"))
    b = Ontology.from_columns(part.filter("p_size > 25"), F.col("p_partkey"), t.make("AnnotationAssertion", t.ann(f"{t.RDFS}label"), t.bare(iri("part", "p_partkey")), t.literal(F.col("p_name"))))
    return lint.missing_label(a.add(b, step=STEP)).select("subject", "message")


@query(f"""SELECT '{U}supplier/' || l_suppkey AS subject, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal < 0 GROUP BY l_suppkey""")
def deprecated_reference(spark, d):
    uses = Ontology.from_columns(table(spark, d, "lineitem"), _id(), t.make("ObjectPropertyAssertion", _p("by"), ind("part", "l_partkey"), ind("supplier", "l_suppkey")))
    gone = table(spark, d, "supplier").filter("s_acctbal < 0")
    marks = Ontology.from_columns(gone, F.col("s_suppkey"), t.make("AnnotationAssertion", t.ann(f"{t.OWL}deprecated"), t.bare(iri("supplier", "s_suppkey")), t.boolean(True)))
    named = _declare(gone, F.col("s_suppkey"), ind("supplier", "s_suppkey"))
    return lint.deprecated_reference(uses.add(marks, named, step=STEP)).groupBy("subject").agg(F.count("*").alias("n"))


@query(f"""SELECT 'equivalence of less than two classes: EquivalentClasses(<{U}key/' || l_partkey || '> <{U}key/' || l_suppkey || '>)' AS message, count(*) AS n FROM lineitem WHERE l_partkey = l_suppkey GROUP BY ALL""")
def trivial_axiom(spark, d):
    o = Ontology.from_columns(table(spark, d, "lineitem"), _id(), t.make("EquivalentClasses", cls("key", "l_partkey"), cls("key", "l_suppkey")))
    return lint.trivial_axiom(o).groupBy("message").agg(F.count("*").alias("n"))


@query(f"""WITH {_RING}, x AS (SELECT k, g, string_agg('<{U}' || k || '/' || id || '>', ' -> ' ORDER BY '{U}' || k || '/' || id) AS path, min('{U}' || k || '/' || id) AS subject, count(*) AS n FROM r GROUP BY k, g)
SELECT subject, 'classes below each other: ' || path || ' -> <' || subject || '>' AS message FROM x WHERE n > 1""")
def subclass_cycle(spark, d):
    return lint.subclass_cycle(ring(spark, d)).select("subject", "message")


@query(f"SELECT '{U}region/' || r_regionkey AS subject FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey)")
def orphan_class(spark, d):
    return lint.orphan_class(places(spark, d)).select("subject")


@query(f"""SELECT 'orphan-class' AS rule, 0 AS severity, count(DISTINCT n_regionkey) AS n FROM nation UNION ALL
SELECT 'undeclared-entity', 1, (SELECT count(DISTINCT n_regionkey) FROM nation) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier)""")
def lint_run(spark, d):
    return lint.run(places(spark, d)).groupBy("rule", "severity").agg(F.count("*").alias("n"))


@query("""SELECT lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS fold, count(*) AS n FROM part WHERE length(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) >= 3 GROUP BY ALL""")
def standard_terms(spark, d):
    part = table(spark, d, "part")
    own = _declare(part, F.col("p_partkey"), cls("own", F.concat(F.col("p_partkey").cast("string"), F.lit("/"), F.col("p_name"))))
    refs = part.select(F.lit(0).alias("kind"), cat(f"{U}std/", F.col("p_name")).alias("iri"), F.col("p_name").alias("name"), F.lit("").alias("label")).distinct()
    found = lint.prefer_standard_terms(refs).check(own)
    return found.select(names.fold(names.local_name(F.col("subject"))).alias("fold")).groupBy("fold").agg(F.count("*").alias("n"))


# == profiles


def mixed(spark: SparkSession, d: str) -> Ontology:
    """Axioms and expressions in and out of the profiles."""
    part = table(spark, d, "part")
    p, b, ty = cls("part", "p_partkey"), cls("brand", "p_brand"), cls("type", "p_type")
    r, thing = _p("r"), t.cls(t.THING)
    made = [
        t.make("SubClassOf", p, t.some(r, t.conj(b, ty))), t.make("SubClassOf", t.disj(b, ty), p), t.make("SubClassOf", p, t.cardinality("Max", 2, r, b)), t.make("SubClassOf", t.some(r, thing), t.neg(b)),
        t.make("DisjointUnion", p, b, ty), t.make("ClassAssertion", t.one_of(ind("i", "p_size"), ind("j", "p_size")), ind("k", "p_partkey")), t.make("ObjectPropertyDomain", t.inverse(r), t.only(r, b)), t.make("EquivalentClasses", p, thing),
    ]
    parts = [Ontology.from_columns(part, F.col("p_partkey"), ax) for ax in made]
    return parts[0].add(*parts[1:], step=1 << 40)


_PER_PART = [
    ("EL", "EL lacks ObjectUnionOf in position class", 1), ("EL", "EL lacks ObjectMaxCardinality in position class", 1), ("EL", "EL lacks ObjectComplementOf in position class", 1), ("EL", "EL lacks the axiom DisjointUnion", 1),
    ("EL", "one element expected in ObjectOneOf, found 2", 1), ("EL", "EL lacks ObjectInverseOf in position property", 1), ("EL", "EL lacks ObjectAllValuesFrom in position class", 1),
    ("QL", "QL lacks ObjectIntersectionOf in position named", 1), ("QL", "QL lacks ObjectUnionOf in position sub", 1), ("QL", "QL lacks ObjectMaxCardinality in position super", 1), ("QL", "QL lacks the axiom DisjointUnion", 1),
    ("QL", "QL lacks ObjectOneOf in position named", 1), ("QL", "QL lacks ObjectAllValuesFrom in position super", 1),
    ("RL", "RL lacks ObjectSomeValuesFrom in position super", 1), ("RL", "0 or 1 expected in ObjectMaxCardinality, found 2", 1), ("RL", "RL lacks the axiom DisjointUnion", 1), ("RL", "RL lacks ObjectOneOf in position super", 1), ("RL", "RL lacks owl:Thing here", 1),
]


@query("SELECT profile, reason, (SELECT count(*) FROM part) * n AS n FROM (VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in _PER_PART) + ") v(profile, reason, n)")
def profile_violations(spark, d):
    return profiles.check(mixed(spark, d), "EL", "QL", "RL").groupBy("profile", "reason").agg(F.count("*").alias("n"))


def property_tree(spark: SparkSession, d: str) -> Ontology:
    half = F.floor(F.col("p_partkey") / 2).cast("long")
    up = halving(spark, d, t.make("SubObjectPropertyOf", t.obj(iri("p", "p_partkey")), t.obj(iri("p", half))))
    trans = Ontology.from_columns(table(spark, d, "part").filter("p_size = 7"), F.col("p_partkey"), t.make("TransitiveObjectProperty", t.obj(iri("p", "p_partkey"))))
    used = Ontology.from_columns(table(spark, d, "part"), F.col("p_partkey"), t.make("FunctionalObjectProperty", t.inverse(t.obj(iri("p", "p_partkey")))))
    return up.add(trans, used, step=STEP)


_SIMPLE = "WITH RECURSIVE n AS (SELECT p_partkey AS k FROM part WHERE p_size = 7 UNION SELECT k // 2 FROM n WHERE k > 0)"


@query(f"{_SIMPLE} SELECT DISTINCT '{U}p/' || k AS iri FROM n")
def non_simple_properties(spark, d):
    return profiles.non_simple(property_tree(spark, d))


@query(f"{_SIMPLE} SELECT '{U}p/' || k || ' is not simple but used in FunctionalObjectProperty' AS reason FROM (SELECT DISTINCT k FROM n) JOIN part ON k = p_partkey")
def profile_dl(spark, d):
    return profiles.dl_violations(property_tree(spark, d)).select("reason")


# == closed-world checks


def order_facts(spark: SparkSession, d: str) -> Ontology:
    orders = Ontology.from_columns(table(spark, d, "orders"), F.col("o_orderkey"), t.make("ClassAssertion", t.cls(f"{U}Order"), ind("order", "o_orderkey")))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").distinct()
    line = ind("line", F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_returnflag")))
    has_line = Ontology.from_columns(lines, _id(), t.make("ObjectPropertyAssertion", _p("hasLine"), ind("order", "l_orderkey"), line))
    flags = Ontology.from_columns(lines, _id(), t.make("ClassAssertion", cls("flag", "l_returnflag"), line))
    return orders.add(has_line, flags, step=STEP)


def rules(spark: SparkSession, *axioms: t.Term) -> Ontology:
    return Ontology.of(spark, axioms, prefixes=names.prefixes(x=U))


@query(f"SELECT '{U}order/' || o_orderkey AS subject FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def icv_some_values(spark, d):
    check = t.make("SubClassOf", t.cls(f"{U}Order"), t.some(_p("hasLine"), t.cls(t.THING)))
    return icv.validate(order_facts(spark, d), rules(spark, check)).violations.select("subject")


@query(f"SELECT DISTINCT '{U}order/' || l_orderkey AS subject FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R'")
def icv_all_values(spark, d):
    check = t.make("SubClassOf", t.cls(f"{U}Order"), t.only(_p("hasLine"), t.cls(f"{U}flag/R")))
    return icv.validate(order_facts(spark, d), rules(spark, check)).violations.select("subject")


@query(f"""SELECT '{U}customer/' || c_custkey AS subject FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0
AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def icv_disjoint(spark, d):
    africa = table(spark, d, "nation").filter("n_regionkey = 0").select("n_nationkey")
    own = table(spark, d, "customer").join(africa, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    a = Ontology.from_columns(own, F.col("c_custkey"), t.make("ClassAssertion", t.cls(f"{U}African"), ind("customer", "c_custkey")))
    orders = table(spark, d, "orders")
    b = Ontology.from_columns(orders, F.col("o_orderkey"), t.make("ObjectPropertyAssertion", _p("placed"), ind("customer", "o_custkey"), ind("order", "o_orderkey")))
    c = Ontology.from_columns(orders, F.col("o_orderkey"), t.make("ClassAssertion", cls("priority", "o_orderpriority"), ind("order", "o_orderkey")))
    check = t.make("DisjointClasses", t.cls(f"{U}African"), t.some(_p("placed"), t.cls(f"{U}priority/1-URGENT")))
    return icv.validate(a.add(b, c, step=STEP), rules(spark, check)).violations.select("subject")


@query(f"""WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey > 0), c AS (SELECT a, b, 1 AS n FROM e UNION SELECT c.a, e.b, n + 1 FROM c JOIN e ON c.b = e.a)
SELECT '{U}part/' || a AS subject, min(n)::INT AS steps FROM c WHERE b = 0 GROUP BY a""")
def icv_path_length(spark, d):
    """The shortest chain of facts behind a derived transitive fact, for every part that reaches part 0."""
    half = F.floor(F.col("p_partkey") / 2).cast("long")
    o = halving(spark, d, t.make("ObjectPropertyAssertion", _p("half"), ind("part", "p_partkey"), ind("part", half)))
    check = t.make("SubClassOf", t.has(_p("reaches"), t.ind(f"{U}part/0")), t.neg(t.has(_p("reaches"), t.ind(f"{U}part/0"))))
    c = rules(spark, t.make("SubObjectPropertyOf", _p("half"), _p("reaches")), t.make("TransitiveObjectProperty", _p("reaches")), check)
    return icv.validate(o, c).violations.select("subject", F.size("path").alias("steps"))


# == EL


def supplied(spark: SparkSession, d: str) -> Ontology:
    """Parts, their types and suppliers, located in nations and regions; a defined class over them."""
    some = lambda p, c: t.some(_p(p), c)
    part = Ontology.from_columns(table(spark, d, "part"), F.col("p_partkey"), t.make("SubClassOf", cls("part", "p_partkey"), cls("type", "p_type")))
    links = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    by = Ontology.from_columns(links, _id(), t.make("SubClassOf", cls("part", "l_partkey"), some("suppliedBy", cls("supplier", "l_suppkey"))))
    sup = Ontology.from_columns(table(spark, d, "supplier"), F.col("s_suppkey"), t.make("SubClassOf", cls("supplier", "s_suppkey"), some("locatedIn", cls("nation", "s_nationkey"))))
    nat = Ontology.from_columns(table(spark, d, "nation"), F.col("n_nationkey"), t.make("SubClassOf", cls("nation", "n_nationkey"), some("locatedIn", cls("region", "n_regionkey"))))
    first = t.cls(f"{U}type/ECONOMY")
    defined = Ontology.of(spark, [
        t.make("TransitiveObjectProperty", _p("locatedIn")), t.make("SubPropertyChainOf", _p("availableIn"), _p("suppliedBy"), _p("locatedIn")),
        t.make("EquivalentClasses", t.cls(f"{U}Q"), t.conj(first, some("availableIn", t.cls(f"{U}nation/3")))),
    ])
    return part.add(by, sup, nat, defined, step=STEP)


@query(f"""SELECT DISTINCT '{U}part/' || p_partkey AS sub, '{U}Q' AS super FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_type = 'ECONOMY' AND s_nationkey = 3""")
def el_subsumptions(spark, d):
    return el.classify(supplied(spark, d)).subsumptions().filter(F.col("super") == f"{U}Q").filter(F.col("sub").startswith(f"{U}part/"))


@query(f"SELECT '{U}order/' || l_orderkey AS iri FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 2")
def el_unsatisfiable(spark, d):
    flags = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag").distinct()
    a = Ontology.from_columns(flags, _id(), t.make("SubClassOf", cls("order", "l_orderkey"), cls("flag", "l_returnflag")))
    b = Ontology.of(spark, [t.make("DisjointClasses", t.cls(f"{U}flag/A"), t.cls(f"{U}flag/R"))])
    return el.classify(a.add(b, step=STEP)).unsatisfiable()


@query(f"""SELECT '{U}supplier/' || s_suppkey AS sub, '{U}nation/' || s_nationkey AS super FROM supplier UNION SELECT '{U}nation/' || n_nationkey, '{U}region/' || n_regionkey FROM nation
UNION SELECT '{U}region/' || n_regionkey, '{t.THING}' FROM nation""")
def el_direct_supers(spark, d):
    nation = table(spark, d, "nation")
    skip = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    far = Ontology.from_columns(skip, F.col("s_suppkey"), t.make("SubClassOf", cls("supplier", "s_suppkey"), cls("region", "n_regionkey")))
    return el.classify(places(spark, d).add(far, step=STEP)).direct_supers()


@query(f"WITH RECURSIVE {_RING}, {_CLOSURE} SELECT sub AS a, super AS b FROM c WHERE sub <> super")
def el_equivalents(spark, d):
    return el.classify(ring(spark, d)).equivalents()


@query(f"SELECT 'SubClassOf(<{U}part/' || p_partkey || '> ObjectUnionOf(<{U}brand/' || p_brand || '> <{U}type/' || p_type || '>))' AS text FROM part")
def el_unsupported(spark, d):
    ax = t.make("SubClassOf", cls("part", "p_partkey"), t.disj(cls("brand", "p_brand"), cls("type", "p_type")))
    o = Ontology.from_columns(table(spark, d, "part"), F.col("p_partkey"), ax).add(places(spark, d), step=STEP)
    return el.classify(o).unsupported().select("text")


@query(f"""SELECT 'SubClassOf(<{U}supplier/' || s_suppkey || '> <{U}nation/' || s_nationkey || '>)' AS text FROM supplier WHERE s_suppkey = (SELECT min(s_suppkey) FROM supplier)
UNION SELECT 'SubClassOf(<{U}nation/' || n_nationkey || '> <{U}region/' || n_regionkey || '>)' FROM nation JOIN supplier ON n_nationkey = s_nationkey WHERE s_suppkey = (SELECT min(s_suppkey) FROM supplier)""")
def el_explain(spark, d):
    first = table(spark, d, "supplier").agg(F.min("s_suppkey").alias("s_suppkey")).join(table(spark, d, "supplier"), "s_suppkey").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).first()
    c = el.classify(places(spark, d), explanations=True)
    return c.explain(f"{U}supplier/{first['s_suppkey']}", f"{U}region/{first['n_regionkey']}").select("text")


# == vocabularies and names


def brands(spark: SparkSession, d: str) -> vocabulary.Vocabulary:
    part = table(spark, d, "part")
    o = _declare(part, F.col("p_partkey"), cls("part", "p_partkey")).add(
        Ontology.from_columns(part, F.col("p_partkey"), t.make("AnnotationAssertion", t.ann(f"{t.RDFS}label"), t.bare(iri("part", "p_partkey")), t.literal(F.col("p_name")))), step=STEP)
    return vocabulary.Vocabulary.of(o.prefix("x", U), declared_only=True)


@query(f"""WITH n AS (SELECT lower(trim(p_name)) AS k, count(*) AS c, min('{U}part/' || p_partkey) AS iri FROM part GROUP BY 1), q AS (SELECT DISTINCT upper(p_name) AS asked FROM part)
SELECT asked, CASE WHEN c = 1 THEN 0 END AS kind, CASE WHEN c = 1 THEN iri END AS iri, CASE WHEN c = 1 THEN 'found' ELSE 'ambiguous' END AS status FROM q JOIN n ON lower(trim(asked)) = k""")
def vocab_resolve(spark, d):
    asked = table(spark, d, "part").select(F.upper("p_name").alias("name"))
    return brands(spark, d).resolve(asked).select("asked", "kind", "iri", "status")


@query(f"SELECT '<{U}part/' || p_partkey || '>' AS asked, 0 AS kind, '{U}part/' || p_partkey AS iri FROM part")
def vocab_lookup(spark, d):
    asked = table(spark, d, "part").select(F.concat(F.lit(f"<{U}part/"), F.col("p_partkey").cast("string"), F.lit(">")).alias("name"))
    return brands(spark, d).lookup(asked)


@query(f"SELECT DISTINCT 0 AS kind, '{U}part/' || l_orderkey AS iri FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_orderkey)")
def vocab_unknown(spark, d):
    o = Ontology.from_columns(table(spark, d, "lineitem"), _id(), t.make("SubClassOf", cls("part", "l_orderkey"), t.cls(t.THING)))
    return brands(spark, d).unknown(o).select("kind", "iri").distinct()


_HOST = r"regexp_extract(url, '^[a-z]+://[^/]+/', 0)"


@query(f"SELECT page_id, {_HOST} AS prefix FROM pages WHERE {_HOST} <> '' UNION ALL SELECT page_id, NULL FROM pages WHERE {_HOST} = ''")
def owner_prefix(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    ns = F.regexp_extract("url", "^[a-z]+://[^/]+/", 0)
    registry = pages.select(ns.alias("ns"), ns.alias("prefix")).filter("ns <> ''").distinct()
    return vocabulary.owner(pages, "url", registry).select("page_id", "prefix")


@query("""SELECT page_id, url, regexp_extract(url, '[^#/:]*$', 0) AS local, lower(regexp_replace(regexp_extract(url, '[^#/:]*$', 0), '[^A-Za-z0-9]', '', 'g')) AS fold FROM pages""")
def local_names(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", "url", names.local_name(u).alias("local"), names.fold(names.local_name(u)).alias("fold"))


@query(f"SELECT p_partkey, 'x:' || p_partkey AS compact, '{U}part/' || p_partkey AS expanded, '<{U}part/>' AS bare FROM part")
def curies(spark, d):
    table_ = names.prefixes(x=f"{U}part/", y=U)
    full = iri("part", "p_partkey")
    short = names.compact(full, table_)
    return table(spark, d, "part").select("p_partkey", short.alias("compact"), names.expand(short, table_).alias("expanded"), names.written(F.lit(f"{U}part/"), {}).alias("bare"))


# == shapes and components


@query("""WITH f AS (SELECT DISTINCT c_nationkey AS o, c_mktsegment AS i FROM customer), g AS (SELECT o, string_agg(i, ',' ORDER BY i) AS shape FROM f GROUP BY o)
SELECT a.o AS a, b.o AS b, len(list_intersect(string_split(a.shape, ','), string_split(b.shape, ',')))::BIGINT AS shared FROM g a JOIN g b ON a.o < b.o WHERE len(list_intersect(string_split(a.shape, ','), string_split(b.shape, ','))) > 0""")
def shape_overlap(spark, d):
    fields = table(spark, d, "customer").select(F.col("c_nationkey").alias("owner"), F.col("c_mktsegment").alias("item")).distinct()
    return diff.multiset_overlap(fields, "owner", "item")


@query("""WITH f AS (SELECT p_brand AS o, p_type AS i, count(*) AS n FROM part GROUP BY ALL), s AS (SELECT o, string_agg(i || ' x' || n, ', ' ORDER BY i) AS shape FROM f GROUP BY o) SELECT o AS owner, shape FROM s""")
def type_shapes(spark, d):
    return shapes.shapes(table(spark, d, "part").select(F.col("p_brand").alias("owner"), F.col("p_type").alias("field"))).select("owner", "shape")


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS a, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS b FROM supplier) SELECT a AS node, b AS root FROM e WHERE a IN (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(*) > 1))""")
def component_roots(spark, d):
    from pyspark.sql import Window

    s = table(spark, d, "supplier")
    nxt = s.withColumn("nxt", F.lead("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy(F.hash("s_suppkey"), "s_suppkey"))).filter("nxt is not null")
    return components(nxt, "s_suppkey", "nxt")


# == documents


@query(f"""SELECT 'nation/' || n_nationkey AS onto, 0::BIGINT AS idx, 'SubClassOf' AS kind, 'SubClassOf(<{U}nation/' || n_nationkey || '> <{U}region/' || n_regionkey || '>)' AS text FROM nation
UNION ALL SELECT 'nation/' || n_nationkey, 1, 'AnnotationAssertion', 'AnnotationAssertion(<{t.RDFS}label> <{U}nation/' || n_nationkey || '> "' || n_name || '"^^<{t.XSD}string>)' FROM nation""")
def parsed_documents(spark, d):
    """Documents in a text column, parsed on executors."""
    n, r = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    text = F.concat(F.lit(f"Prefix(n:=<{U}nation/>)\nOntology(<urn:o>\n# a comment\nSubClassOf(n:"), n, F.lit(f" <{U}region/"), r, F.lit('>)\nAnnotationAssertion(rdfs:label n:'), n, F.lit(' "'), F.col("n_name"), F.lit('")\n)'))
    docs = table(spark, d, "nation").select(F.concat(F.lit("nation/"), n).alias("key"), text.alias("text"))
    return ofn.parse_column(docs, "key", "text").select("onto", "idx", "kind", "text")


@query(f"SELECT 'SubClassOf(x:part/' || p_partkey || ' <urn:y:' || p_brand || '>)' AS line FROM part" .replace("x:part/", "p:"))
def rendered_lines(spark, d):
    o = Ontology.from_columns(table(spark, d, "part"), F.col("p_partkey"), t.make("SubClassOf", cls("part", "p_partkey"), t.cls(cat("urn:y:", F.col("p_brand")))))
    return ofn.lines(o.prefix("p", f"{U}part/")).select("line")


# == RDF, descriptions, streams


def nation_turtle(spark: SparkSession, d: str) -> DataFrame:
    """A Turtle document for each nation: a class below its region, with a label and a union."""
    n, r = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    text = F.concat(
        F.lit(f"@prefix : <{U}> . @prefix owl: <{t.OWL}> . @prefix rdfs: <{t.RDFS}> .\n<{U}n"), n, F.lit("> a owl:Class ; rdfs:subClassOf <urn:x:r"), r, F.lit("> ; rdfs:label \""), F.col("n_name"),
        F.lit(f"\"@en ; owl:equivalentClass [ a owl:Class ; owl:unionOf ( <{U}n"), n, F.lit(f"> <{U}r"), r, F.lit("> ) ] .\n"),
    )
    return rdf.parse_column(table(spark, d, "nation").select(n.alias("key"), text.alias("text")), "key", "text")


@query(f"""WITH n AS (SELECT n_nationkey::VARCHAR AS doc, n_nationkey AS k, n_regionkey AS r, n_name AS name FROM nation)
SELECT doc, 0 AS which, 'rdf:type' AS p, 'owl:Class' AS o FROM n UNION ALL SELECT doc, 1, 'rdfs:subClassOf', '{U}r' || r FROM n UNION ALL SELECT doc, 2, 'rdfs:label', name FROM n""")
def rdf_triples(spark, d):
    triples = nation_turtle(spark, d).filter("s.tag = 'iri' and o.tag <> 'blank'")
    pretty = lambda c: F.replace(F.replace(F.replace(c, F.lit(t.RDFS), F.lit("rdfs:")), F.lit(t.OWL), F.lit("owl:")), F.lit(t.RDF), F.lit("rdf:"))
    which = F.when(F.col("p").endswith("type"), 0).when(F.col("p").endswith("subClassOf"), 1).otherwise(2)
    return triples.select("doc", which.alias("which"), pretty(F.col("p")).alias("p"), pretty(F.col("o.text")).alias("o"))


@query(f"""SELECT n_nationkey::VARCHAR AS doc, ['{U}n' || n_nationkey, '{U}r' || n_regionkey] AS items FROM nation""")
def rdf_lists(spark, d):
    return rdf.lists(nation_turtle(spark, d)).select("doc", F.transform("items", lambda i: i["text"]).alias("items"))


@query(f"""SELECT 'SubClassOf(<{U}n' || n_nationkey || '> <{U}r' || n_regionkey || '>)' AS text FROM nation
UNION SELECT 'Declaration(Class(<{U}n' || n_nationkey || '>))' FROM nation UNION SELECT 'Declaration(Class(<{U}r' || n_regionkey || '>))' FROM nation
UNION SELECT 'AnnotationAssertion(<{t.RDFS}label> <{U}n' || n_nationkey || '> "' || n_name || '"@en)' FROM nation
UNION SELECT 'EquivalentClasses(<{U}n' || n_nationkey || '> ObjectUnionOf(<{U}n' || n_nationkey || '> <{U}r' || n_regionkey || '>))' FROM nation
UNION SELECT 'Declaration(AnnotationProperty(<{t.RDFS}label>))' FROM nation WHERE 1 = 0""")
def rdf_axioms(spark, d):
    return rdfmap.convert(nation_turtle(spark, d), (U,))[0].axioms.select("text")


def types_as_code(spark: SparkSession, d: str, sizes: str) -> Ontology:
    """Brands as types with a field for each part type; parts chosen by a condition."""
    rows = table(spark, d, "part").filter(sizes).select("p_brand", "p_type").distinct()
    m = f"{U}m#"
    name = F.concat(F.col("p_brand"), F.lit("."), F.col("p_type"))
    owner, field, held = t.cls(cat(m, F.col("p_brand"))), t.obj(cat(m, name)), t.cls(cat(m, F.col("p_type")))
    key = F.xxhash64("p_brand", "p_type")
    parts = [
        Ontology.from_columns(rows.select("p_brand").distinct(), F.xxhash64("p_brand"), t.make("Declaration", owner)), Ontology.from_columns(rows.select("p_type").distinct(), F.xxhash64("p_type"), t.make("Declaration", held)),
        Ontology.from_columns(rows, key, t.make("ObjectPropertyDomain", field, owner)), Ontology.from_columns(rows, key, t.make("ObjectPropertyRange", field, held)),
    ]
    return parts[0].add(*parts[1:], step=0).header(iri=f"{U}m")


_SHAPES = """WITH b AS (SELECT DISTINCT p_brand AS o, p_type AS f FROM part WHERE {0}), a AS (SELECT DISTINCT p_brand AS o, p_type AS f FROM part)"""


@query(_SHAPES.format("p_size <= 2") + """, s AS (SELECT o, string_agg(f, ',' ORDER BY f) AS shape FROM b GROUP BY o), n AS (SELECT o, string_agg(f, ',' ORDER BY f) AS shape, list(f) AS fs FROM a GROUP BY o),
w AS (SELECT o, shape, list(f) AS fs FROM b JOIN s USING (o) GROUP BY o, shape),
c AS (SELECT n.o, n.fs FROM n LEFT JOIN s ON n.o = s.o WHERE s.shape IS DISTINCT FROM n.shape),
p AS (SELECT x.o AS a, y.o AS b, len(list_intersect(x.fs, y.fs)) AS k, len(x.fs) AS na, len(y.fs) AS nb FROM c x JOIN n y ON x.o <> y.o),
q AS (SELECT a, CASE WHEN k = na AND k = nb THEN 'same' WHEN k = nb THEN 'superset' WHEN k = na THEN 'subset' END AS how, b FROM p WHERE k >= 2),
old AS (SELECT x.o AS a, y.o AS b, CASE WHEN k = na AND k = nb THEN 'same' WHEN k = nb THEN 'superset' WHEN k = na THEN 'subset' END AS how FROM
  (SELECT x.o AS xo, y.o AS yo, len(list_intersect(x.fs, y.fs)) AS k, len(x.fs) AS na, len(y.fs) AS nb FROM w x JOIN w y ON x.o <> y.o) z JOIN w x ON x.o = z.xo JOIN w y ON y.o = z.yo WHERE k >= 2)
SELECT DISTINCT 'urn:x:m#' || a AS subject FROM q WHERE how IS NOT NULL AND NOT EXISTS (SELECT 1 FROM old WHERE old.a = q.a AND old.b = q.b AND old.how = q.how)""")
def same_shape(spark, d):
    found = shapes.compare(types_as_code(spark, d, "p_size <= 2"), types_as_code(spark, d, "true"))
    return found.filter("rule = 'same-shape'").select("subject")


@query("""WITH p AS (SELECT DISTINCT p_brand b, p_type f FROM part WHERE p_size = 30), o AS (SELECT DISTINCT p_brand b, p_type f FROM part WHERE p_size = 20), n AS (SELECT DISTINCT p_brand b, p_type f FROM part WHERE p_size IN (19, 20))
SELECT 'missing-field' AS rule, 'urn:x:m#' || b || '.' || f AS subject FROM p WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.b = p.b AND n.f = p.f) AND b IN (SELECT b FROM n)
UNION ALL SELECT 'missing-type', 'urn:x:m#' || b FROM (SELECT DISTINCT b FROM p) WHERE b NOT IN (SELECT b FROM n)
UNION ALL SELECT 'unplanned-type', 'urn:x:m#' || b FROM (SELECT DISTINCT b FROM n) WHERE b NOT IN (SELECT b FROM o) AND b NOT IN (SELECT b FROM p)
UNION ALL SELECT 'unplanned-field', 'urn:x:m#' || b || '.' || f FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.b = n.b AND o.f = n.f) AND NOT EXISTS (SELECT 1 FROM p WHERE p.b = n.b AND p.f = n.f) AND (b IN (SELECT b FROM o) OR b IN (SELECT b FROM p))""")
def conformance(spark, d):
    plan, before, after = (types_as_code(spark, d, c) for c in ("p_size = 30", "p_size = 20", "p_size in (19, 20)"))
    return conform.conform(plan, before, after).select("rule", "subject")


def packages(spark: SparkSession, d: str) -> Ontology:
    """Orders and customers as packages; customers import their orders."""
    m = f"{U}m#"
    orders = table(spark, d, "orders")
    pkg = lambda kind, c: t.ind(cat(f"{m}package.{kind}", F.col(c).cast("string")))
    parts = [
        Ontology.from_columns(orders, F.col("o_orderkey"), t.make("ClassAssertion", t.cls(f"{m}Package"), pkg("o", "o_orderkey"))),
        Ontology.from_columns(orders.select("o_custkey").distinct(), F.col("o_custkey"), t.make("ClassAssertion", t.cls(f"{m}Package"), pkg("c", "o_custkey"))),
        Ontology.from_columns(orders, F.col("o_orderkey"), t.make("ObjectPropertyAssertion", t.obj(f"{m}imports"), pkg("c", "o_custkey"), pkg("o", "o_orderkey"))),
    ]
    return parts[0].add(*parts[1:], step=STEP).header(iri=f"{U}m")


@query(f"""SELECT 'invariant-violated' AS rule, '{U}m#package.c' || o_custkey AS subject FROM orders JOIN supplier ON s_suppkey = o_orderkey GROUP BY o_custkey
UNION ALL SELECT 'empty-term', '{U}m#Ghost'""")
def invariants(spark, d):
    m = f"{U}m#"
    core = Ontology.from_columns(table(spark, d, "supplier"), F.col("s_suppkey"), t.make("ClassAssertion", t.cls(f"{m}Core"), t.ind(cat(f"{m}package.o", F.col("s_suppkey").cast("string")))))
    rule = Ontology.of(spark, [
        t.make("DisjointClasses", t.some(t.obj(f"{m}dependsOn"), t.cls(f"{m}Core")), t.cls(f"{m}Package")), t.make("SubObjectPropertyOf", t.obj(f"{m}imports"), t.obj(f"{m}dependsOn")), t.make("SubClassOf", t.cls(f"{m}Ghost"), t.cls(f"{m}Core")),
    ])
    return conform.check_invariants(core.add(rule, step=STEP), packages(spark, d)).select("rule", "subject")


@query("""SELECT 'urn:x:s#part.p_partkey' AS field, 'urn:x:s#part' AS owner, 'long' AS held UNION ALL SELECT 'urn:x:s#part.p_name', 'urn:x:s#part', 'string' UNION ALL SELECT 'urn:x:s#part.p_brand', 'urn:x:s#part', 'string'
UNION ALL SELECT 'urn:x:s#part.p_type', 'urn:x:s#part', 'string' UNION ALL SELECT 'urn:x:s#part.p_size', 'urn:x:s#part', 'int' UNION ALL SELECT 'urn:x:s#part.p_retailprice', 'urn:x:s#part', 'double'""")
def described_schema(spark, d):
    o = shapes.describe(spark, {"part": table(spark, d, "part").schema}, f"{U}s#")
    return shapes.fields(o).select("field", "owner", F.replace("held", F.lit(t.XSD)).alias("held"))


@query("""SELECT '{"ontology":"urn:x:places","counts":{"Class":' || ((SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) + (SELECT count(DISTINCT n_regionkey) FROM nation)) || ',"axioms":' || ((SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation)) ||
'},"axioms":[{"kind":"SubClassOf","n":' || ((SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation)) || '}]}' AS report""")
def report_stats(spark, d):
    return reports.stats_report(places(spark, d).header(iri=f"{U}places"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors of every supplier, nation and region class."""
    return ancestors(spark, sf_dir)


# == every construct: one axiom of each kind, expression and range over the nations, with its text written out


def constructs(col=F.col) -> list[tuple[t.Term, str, int]]:
    """(axiom, its text written out, its mentions); $a is the nation's IRI, $b and $c names of its own, $n its key, $m its name."""
    key, name = col("n_nationkey").cast("string"), col("n_name")
    at = lambda kind: cat(f"{U}{kind}/", key)
    A, B, C, i, j = t.cls(at("nation")), t.cls(at("b")), t.cls(at("c")), t.ind(at("nation")), t.ind(at("b"))
    p, q, x, y, note = _p("p"), _p("q"), t.dat(f"{U}x"), t.dat(f"{U}y"), t.ann(f"{U}note")
    integer, text = t.datatype(f"{t.XSD}integer"), t.literal(name)
    five = t.literal(key, f"{t.XSD}integer")
    P, Q, X, Y, N, INT = f"<{U}p>", f"<{U}q>", f"<{U}x>", f"<{U}y>", f"<{U}note>", f"<{t.XSD}integer>"
    T, FIVE = f'"$m"^^<{t.XSD}string>', f'"$n"^^{INT}'
    m = t.make
    plain = [
        (m("Declaration", A), "Declaration(Class($a))", 1), (m("Declaration", p), f"Declaration(ObjectProperty({P}))", 1), (m("SubClassOf", A, B), "SubClassOf($a $b)", 2),
        (m("EquivalentClasses", A, B, C), "EquivalentClasses($a $b $c)", 3), (m("DisjointClasses", A, B), "DisjointClasses($a $b)", 2), (m("DisjointUnion", A, B, C), "DisjointUnion($a $b $c)", 3),
        (m("SubObjectPropertyOf", p, q), f"SubObjectPropertyOf({P} {Q})", 2), (m("SubPropertyChainOf", p, q, q), f"SubObjectPropertyOf(ObjectPropertyChain({Q} {Q}) {P})", 3),
        *[(m(f"{k}ObjectProperties", p, q), f"{k}ObjectProperties({P} {Q})", 2) for k in ("Equivalent", "Disjoint", "Inverse")],
        (m("ObjectPropertyDomain", p, A), f"ObjectPropertyDomain({P} $a)", 2), (m("ObjectPropertyRange", p, A), f"ObjectPropertyRange({P} $a)", 2),
        *[(m(f"{k}ObjectProperty", p), f"{k}ObjectProperty({P})", 1) for k in ("Functional", "InverseFunctional", "Reflexive", "Irreflexive", "Symmetric", "Asymmetric", "Transitive")],
        (m("SubDataPropertyOf", x, y), f"SubDataPropertyOf({X} {Y})", 2), *[(m(f"{k}DataProperties", x, y), f"{k}DataProperties({X} {Y})", 2) for k in ("Equivalent", "Disjoint")],
        (m("DataPropertyDomain", x, A), f"DataPropertyDomain({X} $a)", 2), (m("DataPropertyRange", x, integer), f"DataPropertyRange({X} {INT})", 2), (m("FunctionalDataProperty", x), f"FunctionalDataProperty({X})", 1),
        (m("DatatypeDefinition", t.datatype(f"{U}d"), integer), f"DatatypeDefinition(<{U}d> {INT})", 2), (m("HasKey", A, p, x), f"HasKey($a ({P}) ({X}))", 3),
        (m("SameIndividual", i, j), "SameIndividual($a $b)", 2), (m("DifferentIndividuals", i, j), "DifferentIndividuals($a $b)", 2), (m("ClassAssertion", B, i), "ClassAssertion($b $a)", 2),
        *[(m(f"{k}ObjectPropertyAssertion", p, i, j), f"{k}ObjectPropertyAssertion({P} $a $b)", 3) for k in ("", "Negative")],
        *[(m(f"{k}DataPropertyAssertion", x, i, five), f"{k}DataPropertyAssertion({X} $a {FIVE})", 3) for k in ("", "Negative")],
        (m("AnnotationAssertion", note, t.bare(at("nation")), text), f"AnnotationAssertion({N} $a {T})", 2), (m("SubAnnotationPropertyOf", note, t.ann(f"{U}n2")), f"SubAnnotationPropertyOf({N} <{U}n2>)", 2),
        *[(m(f"AnnotationProperty{k}", note, t.bare(f"{U}any")), f"AnnotationProperty{k}({N} <{U}any>)", 1) for k in ("Domain", "Range")],
        (m("ClassAssertion", B, t.anon(key)), "ClassAssertion($b _:$n)", 1), (m("AnnotationAssertion", note, t.bare(f"{U}any"), t.literal(name, lang="en")), f'AnnotationAssertion({N} <{U}any> "$m"@en)', 2),
    ]
    over = lambda e, s, n: (m("SubClassOf", A, e), f"SubClassOf($a {s})", n + 1)
    expressions = [
        over(t.conj(B, C), "ObjectIntersectionOf($b $c)", 2), over(t.disj(B, C), "ObjectUnionOf($b $c)", 2), over(t.neg(B), "ObjectComplementOf($b)", 1), over(t.one_of(i, j), "ObjectOneOf($a $b)", 2),
        over(t.some(p, B), f"ObjectSomeValuesFrom({P} $b)", 2), over(t.only(p, B), f"ObjectAllValuesFrom({P} $b)", 2), over(t.has(p, j), f"ObjectHasValue({P} $b)", 2), over(t.self_(p), f"ObjectHasSelf({P})", 1),
        *[over(t.cardinality(k, 2, p, B), f"Object{k}Cardinality(2 {P} $b)", 2) for k in ("Min", "Max", "Exact")], over(t.cardinality("Min", 1, p), f"ObjectMinCardinality(1 {P})", 1),
        over(m("DataSomeValuesFrom", x, integer), f"DataSomeValuesFrom({X} {INT})", 2), over(m("DataAllValuesFrom", x, integer), f"DataAllValuesFrom({X} {INT})", 2), over(m("DataHasValue", x, five), f"DataHasValue({X} {FIVE})", 2),
        *[over(t.cardinality(k, 3, x, integer), f"Data{k}Cardinality(3 {X} {INT})", 2) for k in ("Min", "Max", "Exact")], over(t.some(t.inverse(p), B), f"ObjectSomeValuesFrom(ObjectInverseOf({P}) $b)", 2),
    ]
    held = lambda r, s, n: (m("DataPropertyRange", x, r), f"DataPropertyRange({X} {s})", n + 1)
    ranges = [
        held(m("DataIntersectionOf", integer, t.datatype(f"{U}d")), f"DataIntersectionOf({INT} <{U}d>)", 2), held(m("DataUnionOf", integer, t.datatype(f"{U}d")), f"DataUnionOf({INT} <{U}d>)", 2),
        held(m("DataComplementOf", integer), f"DataComplementOf({INT})", 1), held(m("DataOneOf", five, text), f"DataOneOf({FIVE} {T})", 2),
        held(t.restrict(integer, t.facet(f"{t.XSD}minInclusive", five)), f"DatatypeRestriction({INT} <{t.XSD}minInclusive> {FIVE})", 2),
    ]
    return plain + expressions + ranges


def _rows(pairs: list[tuple[str, int]]) -> str:
    return ", ".join(f"('{text.replace(chr(39), chr(39) * 2)}', {n})" for text, n in pairs)


class _NoColumn(str):
    """Stands for a column where only the written texts are wanted (no session is needed)."""

    def cast(self, _):
        return self


def _texts() -> str:
    """Rows (template, mentions) of all constructs for the SQL."""
    return _rows([(text, n) for _, text, n in constructs(_NoColumn)])


@query(f"""SELECT replace(replace(replace(replace(replace(tpl, '$a', '<{U}nation/' || n_nationkey || '>'), '$b', '<{U}b/' || n_nationkey || '>'), '$c', '<{U}c/' || n_nationkey || '>'), '$n', n_nationkey::VARCHAR), '$m', n_name) AS text,
  n::BIGINT AS mentions FROM nation, (VALUES {_texts()}) AS v(tpl, n)""")
def all_constructs(spark, d):
    """(text, mentions) of one axiom for each construct and nation."""
    nation = table(spark, d, "nation")
    own = constructs()
    made = [t.columns(a) for a, *_ in own]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), *[m[c].alias(c) for c in m]) for i, m in enumerate(made)]))
    rows = nation.select(F.col("n_nationkey").cast("long").alias("k"), each.alias("a"))
    o = Ontology(rows.select((F.col("k") * len(own) + F.col("a.at")).alias("idx"), *[F.col(f"a.{c}").alias(c) for c in made[0]]))
    counted = o.mentions().groupBy("idx").agg(F.count("*").alias("mentions"))
    return o.axioms.join(counted, "idx", "left").select("text", F.coalesce("mentions", F.lit(0)).cast("long").alias("mentions"))


def defined(spark: SparkSession, d: str) -> Ontology:
    """Nations, regions and a vocabulary by builders."""
    n = builders.Namer(names.prefixes(x=U))
    region, supplier = cls("region", "n_regionkey"), ind("supplier", "s_suppkey")
    nation = builders.define(cls("nation", "n_nationkey")).label(F.col("n_name"), "en").comment("a nation").sub_class_of(region, n.cls("x:Place"))
    nation = nation.disjoint_with(n.cls("x:Part"), n.cls("x:Order")).key(n.obj("x:p")).equivalent_to(t.conj(region, n.cls("x:Land")))
    firm = builders.define(supplier).label(F.col("s_name")).type(cls("nation", "s_nationkey")).fact(n.obj("x:in"), ind("nation", "s_nationkey")).not_fact(n.obj("x:in"), ind("nation", F.col("s_nationkey") + 1))
    firm = firm.data(n.dat("x:key"), t.literal(F.col("s_suppkey").cast("string"), f"{t.XSD}integer")).different_from(ind("supplier", F.col("s_suppkey") + 1))
    prop = builders.define(n.obj("x:in")).domain(n.cls("x:Firm")).range(n.cls("x:Place")).chain(n.obj("x:in"), n.obj("x:part")).transitive().inverse_of(n.obj("x:holds")).sub_property_of(n.obj("x:near"))
    data = builders.define(n.dat("x:key")).domain(n.cls("x:Firm")).range(n.datatype("xsd:integer")).functional().label("key")
    if n.err:
        raise ValueError(n.err)
    parts = [nation.over(table(spark, d, "nation"), F.col("n_nationkey")), firm.over(table(spark, d, "supplier"), F.col("s_suppkey")), prop.build(spark), data.build(spark)]
    return parts[0].add(*parts[1:], step=STEP)


_N, _S = f"<{U}nation/' || n_nationkey || '>", f"<{U}supplier/' || s_suppkey || '>"
_L, _C, _STR = f"<{t.STANDARD['rdfs']}label>", f"<{t.STANDARD['rdfs']}comment>", f"<{t.XSD}string>"
_FIXED = [
    f"Declaration(ObjectProperty(<{U}in>))", f"ObjectPropertyDomain(<{U}in> <{U}Firm>)", f"ObjectPropertyRange(<{U}in> <{U}Place>)", f"SubObjectPropertyOf(ObjectPropertyChain(<{U}in> <{U}part>) <{U}in>)",
    f"TransitiveObjectProperty(<{U}in>)", f"InverseObjectProperties(<{U}in> <{U}holds>)", f"SubObjectPropertyOf(<{U}in> <{U}near>)", f"Declaration(DataProperty(<{U}key>))", f"DataPropertyDomain(<{U}key> <{U}Firm>)",
    f"DataPropertyRange(<{U}key> <{t.XSD}integer>)", f"FunctionalDataProperty(<{U}key>)", f'AnnotationAssertion({_L} <{U}key> "key"^^{_STR})',
]


@query(f"""SELECT unnest(['Declaration(Class({_N}))', 'AnnotationAssertion({_L} {_N} "' || n_name || '"@en)', 'AnnotationAssertion({_C} {_N} "a nation"^^{_STR})', 'SubClassOf({_N} <{U}region/' || n_regionkey || '>)',
  'SubClassOf({_N} <{U}Place>)', 'DisjointClasses({_N} <{U}Part> <{U}Order>)', 'HasKey({_N} (<{U}p>) ())', 'EquivalentClasses({_N} ObjectIntersectionOf(<{U}region/' || n_regionkey || '> <{U}Land>))']) AS text FROM nation
UNION ALL SELECT unnest(['Declaration(NamedIndividual({_S}))', 'AnnotationAssertion({_L} {_S} "' || s_name || '"^^{_STR})', 'ClassAssertion(<{U}nation/' || s_nationkey || '> {_S})',
  'ObjectPropertyAssertion(<{U}in> {_S} <{U}nation/' || s_nationkey || '>)', 'NegativeObjectPropertyAssertion(<{U}in> {_S} <{U}nation/' || (s_nationkey + 1) || '>)',
  'DataPropertyAssertion(<{U}key> {_S} "' || s_suppkey || '"^^<{t.XSD}integer>)', 'DifferentIndividuals({_S} <{U}supplier/' || (s_suppkey + 1) || '>)']) FROM supplier
UNION ALL SELECT unnest([{', '.join(f"'{x}'" for x in _FIXED)}])""")
def built_axioms(spark, d):
    return defined(spark, d).axioms.select("text")


_FILLED = f"""SELECT n_nationkey::VARCHAR AS onto, replace(replace(replace(replace(replace(tpl, '$a', '<{U}nation/' || n_nationkey || '>'), '$b', '<{U}b/' || n_nationkey || '>'), '$c', '<{U}c/' || n_nationkey || '>'), '$n', n_nationkey::VARCHAR), '$m', n_name) AS text
FROM nation, (VALUES {_texts()}) AS v(tpl, n)"""


@query(_FILLED)
def parsed_constructs(spark, d):
    """Every construct read from documents in functional syntax and written again."""
    nation = table(spark, d, "nation")
    key, name = F.col("n_nationkey").cast("string"), F.col("n_name")
    lines = F.array(*[F.lit(text) for _, text, _ in constructs(_NoColumn)])
    filled = F.transform(lines, lambda x: F.replace(F.replace(F.replace(F.replace(F.replace(x, F.lit("$a"), cat(f"<{U}nation/", key, ">")), F.lit("$b"), cat(f"<{U}b/", key, ">")), F.lit("$c"), cat(f"<{U}c/", key, ">")), F.lit("$n"), key), F.lit("$m"), name))
    docs = nation.select(key.alias("onto"), F.concat(F.lit(f"Ontology(<{U}o>\n"), F.array_join(filled, "\n"), F.lit("\n)")).alias("doc"))
    return ofn.parse_column(docs, "onto", "doc").select("onto", "text")


@query(f"""WITH n AS (SELECT n_nationkey::VARCHAR AS doc, n_name AS name, n_regionkey AS r FROM nation)
SELECT doc, '{U}n' || doc AS s, '{t.RDF}type' AS p, '{t.OWL}Class' AS o, NULL AS lang FROM n UNION ALL SELECT doc, '{U}n' || doc, '{t.RDFS}label', name, 'en' FROM n
UNION ALL SELECT doc, '{U}n' || doc, '{U}code', doc, NULL FROM n UNION ALL SELECT doc, '{U}n' || doc, '{t.RDFS}subClassOf', '{U}r' || r, NULL FROM n
UNION ALL SELECT doc, '{U}n' || doc, '{U}in', '{U}p' || doc, NULL FROM n UNION ALL SELECT doc, '{U}p' || doc, '{t.RDF}type', '{U}Place', NULL FROM n UNION ALL SELECT doc, '{U}p' || doc, '{U}name', name, NULL FROM n""")
def rdf_xml_triples(spark, d):
    """RDF/XML with typed nodes, property attributes, nested nodes, languages and datatypes."""
    n, r = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    text = F.concat(
        F.lit(f'<?xml version="1.0"?><rdf:RDF xmlns:rdf="{t.RDF}" xmlns:rdfs="{t.RDFS}" xmlns:owl="{t.OWL}" xmlns:x="{U}"><owl:Class rdf:about="{U}n'), n, F.lit('"><rdfs:label xml:lang="en">'), F.col("n_name"),
        F.lit(f'</rdfs:label><x:code rdf:datatype="{t.XSD}string">'), n, F.lit(f'</x:code><rdfs:subClassOf rdf:resource="{U}r'), r, F.lit(f'"/><x:in><x:Place rdf:about="{U}p'), n, F.lit('" x:name="'), F.col("n_name"), F.lit('"/></x:in></owl:Class></rdf:RDF>'),
    )
    found = rdf.parse_column(table(spark, d, "nation").select(n.alias("key"), text.alias("text")), "key", "text", "xml")
    return found.select("doc", F.col("s.text").alias("s"), "p", F.col("o.text").alias("o"), F.col("o.lang").alias("lang"))


@query(f"""SELECT 'SubClassOf(<{U}nation/' || n_nationkey || '> <{U}region/' || n_regionkey || '>)' AS text FROM nation UNION SELECT 'SubClassOf(<{U}supplier/' || s_suppkey || '> <{U}nation/' || s_nationkey || '>)' FROM supplier
UNION SELECT 'SubClassOf(<{U}part/' || p_partkey || '> <{U}part/' || (p_partkey // 2) || '>)' FROM part WHERE p_partkey > 0""")
def merged(spark, d):
    return diff.merge(f"{U}all", places(spark, d), halving(spark, d), places(spark, d)).axioms.select("text")


def links(spark: SparkSession, d: str) -> Ontology:
    """Suppliers in nations, nations that are empty in region 0; a role below another and one below nothing."""
    a = Ontology.from_columns(table(spark, d, "supplier"), F.col("s_suppkey"), t.make("SubClassOf", cls("supplier", "s_suppkey"), t.some(_p("in"), cls("nation", "s_nationkey"))))
    b = Ontology.from_columns(table(spark, d, "nation").filter("n_regionkey = 0"), F.col("n_nationkey"), t.make("SubClassOf", cls("nation", "n_nationkey"), t.cls(t.NOTHING)))
    c = Ontology.of(spark, [t.make("SubObjectPropertyOf", _p("in"), _p("near")), t.make("SubClassOf", t.some(_p("near"), t.cls(t.THING)), t.cls(f"{U}Placed"))])
    return a.add(b, c, step=STEP)


@query(f"""SELECT '{U}supplier/' || s_suppkey AS iri FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 0 UNION SELECT '{U}nation/' || n_nationkey FROM nation WHERE n_regionkey = 0""")
def el_empty_through_links(spark, d):
    """A class that is linked to an empty one is empty."""
    return el.classify(links(spark, d)).unsatisfiable()


@query(f"SELECT '{U}supplier/' || s_suppkey AS sub, '{U}Placed' AS super FROM supplier")
def el_roles_below_roles(spark, d):
    """Links of a role are links of the roles above it."""
    return el.classify(links(spark, d)).subsumptions().filter(F.col("super") == f"{U}Placed").filter(F.col("sub").startswith(f"{U}supplier/"))


@query(f"""WITH RECURSIVE {_PLACES}, {_CLOSURE}, q AS (SELECT sub, super FROM e UNION SELECT super, sub FROM e UNION SELECT '{U}supplier/' || s_suppkey, '{U}region/0' FROM supplier UNION SELECT '{U}unknown', '{U}region/0' UNION SELECT '{U}unknown', '{t.THING}')
SELECT q.sub, q.super FROM q WHERE super = '{t.THING}' OR EXISTS (SELECT 1 FROM c WHERE c.sub = q.sub AND c.super = q.super)""")
def el_is_subsumed(spark, d):
    o = places(spark, d)
    e = asserted.super_classes(o).select("sub", "super")
    asked = e.unionByName(e.select(F.col("super").alias("sub"), F.col("sub").alias("super"))).unionByName(table(spark, d, "supplier").select(iri("supplier", "s_suppkey").alias("sub"), F.lit(f"{U}region/0").alias("super")))
    asked = asked.unionByName(spark.createDataFrame([(f"{U}unknown", f"{U}region/0"), (f"{U}unknown", t.THING)], "sub string, super string"))
    return el.classify(o).is_subsumed(asked)


@query(f"""SELECT 'SubClassOf(<{U}supplier/' || s_suppkey || '> <{U}nation/' || s_nationkey || '>)' AS text FROM supplier UNION SELECT 'SubClassOf(<{U}nation/' || n_nationkey || '> <{U}region/' || n_regionkey || '>)' FROM nation
UNION SELECT 'SubClassOf(<{U}region/' || n_regionkey || '> <{t.THING}>)' FROM nation UNION SELECT 'EquivalentClasses(<{U}same/' || n_nationkey || '> <{U}twin/' || n_nationkey || '>)' FROM nation
UNION SELECT 'SubClassOf(<{U}' || k || '/' || n_nationkey || '> <{t.THING}>)' FROM nation, (VALUES ('same'), ('twin')) AS v(k)""")
def el_inferred(spark, d):
    twins = Ontology.from_columns(table(spark, d, "nation"), F.col("n_nationkey"), t.make("EquivalentClasses", cls("twin", "n_nationkey"), cls("same", "n_nationkey")))
    return el.classify(places(spark, d).add(twins, step=STEP)).inferred()
