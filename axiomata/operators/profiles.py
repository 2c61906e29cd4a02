"""Profile checks: EL, QL, RL by position rules on expression trees, DL by simple properties.

A profile is a set of tables: which axioms it has, which position a part gets
from the position and construct above it, and what may stand in a position.
Trees are in preorder, so one fold over the nodes of an axiom assigns all
positions without leaving its row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axiomata.functions import terms as t
from axiomata.model import Ontology
from axiomata.operators.asserted import child, parts
from axiomata.plans.fixpoint import fixpoint

_NOTES = {"Declaration", "AnnotationAssertion", "SubAnnotationPropertyOf", "AnnotationPropertyDomain", "AnnotationPropertyRange"}


@dataclass(frozen=True)
class Profile:
    """``steps``: (position, construct, role) -> position of the part; ``allowed``: position -> constructs."""

    name: str
    axioms: frozenset[str]
    steps: dict[tuple[str, str, str], str]
    allowed: dict[str, frozenset[str]]
    single: frozenset[str] = frozenset()  # enumerations of exactly one
    at_most_one: frozenset[str] = frozenset()  # cardinalities of 0 or 1
    no_thing: frozenset[str] = frozenset()  # positions without owl:Thing
    only_thing: frozenset[str] = frozenset()  # positions of owl:Thing alone
    loose_thing: dict[str, str] = field(default_factory=dict)  # owl:Thing passes here, other expressions go on as there


_ALL = frozenset(t.AXIOMS)
_step = lambda pos, role, *ops: {("axiom", op, role): pos for op in ops}

EL = Profile(
    "EL",
    _ALL - {
        "DisjointUnion", "DisjointObjectProperties", "InverseObjectProperties", "FunctionalObjectProperty", "InverseFunctionalObjectProperty", "IrreflexiveObjectProperty",
        "SymmetricObjectProperty", "AsymmetricObjectProperty", "DisjointDataProperties",
    },
    _step("class", "operand", "EquivalentClasses", "DisjointClasses") | _step("class", "sub", "SubClassOf") | _step("class", "super", "SubClassOf")
    | _step("class", "domain", "ObjectPropertyDomain", "DataPropertyDomain") | _step("class", "range", "ObjectPropertyRange") | _step("class", "class", "HasKey", "ClassAssertion")
    | _step("range", "range", "DataPropertyRange", "DatatypeDefinition") | _step("property", "operand", "EquivalentObjectProperties") | _step("property", "chain", "SubPropertyChainOf")
    | _step("property", "sub", "SubObjectPropertyOf") | _step("property", "super", "SubObjectPropertyOf", "SubPropertyChainOf") | _step("property", "key", "HasKey")
    | _step("property", "property", "ObjectPropertyDomain", "ObjectPropertyRange", "ReflexiveObjectProperty", "TransitiveObjectProperty", "ObjectPropertyAssertion", "NegativeObjectPropertyAssertion")
    | {
        ("class", "ObjectIntersectionOf", "operand"): "class", ("class", "ObjectSomeValuesFrom", "property"): "property", ("class", "ObjectSomeValuesFrom", "filler"): "class",
        ("class", "ObjectHasValue", "property"): "property", ("class", "ObjectHasSelf", "property"): "property", ("class", "DataSomeValuesFrom", "filler"): "range", ("range", "DataIntersectionOf", "operand"): "range",
    },
    {
        "class": frozenset({"Class", "ObjectIntersectionOf", "ObjectSomeValuesFrom", "ObjectHasValue", "ObjectHasSelf", "ObjectOneOf", "DataSomeValuesFrom", "DataHasValue"}),
        "range": frozenset({"Datatype", "DatatypeRestriction", "DataIntersectionOf", "DataOneOf"}), "property": frozenset({"ObjectProperty", "DataProperty"}),
    },
    single=frozenset({"ObjectOneOf", "DataOneOf"}),
)
QL = Profile(
    "QL",
    frozenset(_NOTES | {
        "SubClassOf", "EquivalentClasses", "DisjointClasses", "SubObjectPropertyOf", "EquivalentObjectProperties", "DisjointObjectProperties", "InverseObjectProperties", "SymmetricObjectProperty",
        "AsymmetricObjectProperty", "ReflexiveObjectProperty", "IrreflexiveObjectProperty", "SubDataPropertyOf", "EquivalentDataProperties", "DisjointDataProperties", "ObjectPropertyDomain",
        "ObjectPropertyRange", "DataPropertyDomain", "DataPropertyRange", "ClassAssertion", "ObjectPropertyAssertion", "DataPropertyAssertion", "DifferentIndividuals",
    }),
    _step("sub", "sub", "SubClassOf") | _step("super", "super", "SubClassOf") | _step("sub", "operand", "EquivalentClasses", "DisjointClasses") | _step("super", "domain", "ObjectPropertyDomain", "DataPropertyDomain")
    | _step("super", "range", "ObjectPropertyRange") | _step("named", "class", "ClassAssertion")
    | {("sub", "ObjectSomeValuesFrom", "filler"): "thing", ("super", "ObjectIntersectionOf", "operand"): "super", ("super", "ObjectComplementOf", "operand"): "sub", ("super", "ObjectSomeValuesFrom", "filler"): "named"},
    {
        "sub": frozenset({"Class", "ObjectSomeValuesFrom", "DataSomeValuesFrom"}), "thing": frozenset({"Class"}), "named": frozenset({"Class"}),
        "super": frozenset({"Class", "ObjectIntersectionOf", "ObjectComplementOf", "ObjectSomeValuesFrom", "DataSomeValuesFrom"}),
    },
    only_thing=frozenset({"thing"}),
)
RL = Profile(
    "RL",
    _ALL - {"DisjointUnion", "ReflexiveObjectProperty", "DatatypeDefinition"},
    _step("sub", "sub", "SubClassOf") | _step("super", "super", "SubClassOf") | _step("equal", "operand", "EquivalentClasses") | _step("sub", "operand", "DisjointClasses")
    | _step("super", "domain", "ObjectPropertyDomain", "DataPropertyDomain") | _step("super", "range", "ObjectPropertyRange") | _step("super", "class", "ClassAssertion") | _step("sub", "class", "HasKey")
    | {
        ("sub", "ObjectIntersectionOf", "operand"): "sub", ("sub", "ObjectUnionOf", "operand"): "sub", ("sub", "ObjectSomeValuesFrom", "filler"): "loose", ("super", "ObjectIntersectionOf", "operand"): "super",
        ("super", "ObjectComplementOf", "operand"): "sub", ("super", "ObjectAllValuesFrom", "filler"): "super", ("super", "ObjectMaxCardinality", "filler"): "super", ("equal", "ObjectIntersectionOf", "operand"): "equal",
    },
    {
        "sub": frozenset({"Class", "ObjectIntersectionOf", "ObjectUnionOf", "ObjectOneOf", "ObjectSomeValuesFrom", "ObjectHasValue", "DataSomeValuesFrom", "DataHasValue"}),
        "super": frozenset({"Class", "ObjectIntersectionOf", "ObjectComplementOf", "ObjectAllValuesFrom", "ObjectHasValue", "ObjectMaxCardinality", "DataAllValuesFrom", "DataHasValue", "DataMaxCardinality"}),
        "equal": frozenset({"Class", "ObjectIntersectionOf", "ObjectHasValue", "DataHasValue"}),
    },
    at_most_one=frozenset({"ObjectMaxCardinality", "DataMaxCardinality"}), no_thing=frozenset({"sub", "super", "equal"}), loose_thing={"loose": "sub"},
)
PROFILES = (EL, QL, RL)


def _positions(p: Profile) -> Column:
    """An array with the position of each node; null where nothing is asked of it."""

    def rule(acc: Column, n: Column) -> Column:
        above = F.get(acc, n["parent"])
        over = F.get(F.col("nodes"), n["parent"])["op"]
        table = F.create_map(*[F.lit(x) for (pos, op, role), to in p.steps.items() for x in (f"{pos}|{op}|{role}", to)])
        place = F.get(F.array(F.element_at(table, F.concat_ws("|", above, over, n["role"]))), F.lit(0))
        for loose, strict in p.loose_thing.items():
            place = F.when((place == loose) & (n["iri"] == t.THING) & (n["op"] == "Class"), F.lit(None)).when(place == loose, F.lit(strict)).otherwise(place)
        bad = ~F.array_contains(F.element_at(_allowed(p), above), over) if p.allowed else F.lit(False)
        place = F.when(F.coalesce(bad, F.lit(False)), F.lit(None)).otherwise(place)  # nothing below what is refused
        return F.array_append(acc, F.when(n["id"] == 0, F.lit("axiom")).otherwise(place))

    return F.aggregate("nodes", F.array().cast("array<string>"), rule)


def _allowed(p: Profile) -> Column:
    return F.create_map(*[x for pos, ops in p.allowed.items() for x in (F.lit(pos), F.array(*map(F.lit, sorted(ops))))])


def violations(o: Ontology, p: Profile) -> DataFrame:
    """(profile, idx, node, reason): everything an axiom has that the profile lacks."""
    pos, op, n = F.col("pos"), F.col("n.op"), F.col("n")
    count = F.size(F.filter("nodes", lambda m: m["parent"] == n["id"]))
    # a null position asks nothing: its look-up is null, and so is the reason
    fits = F.array_contains(F.element_at(_allowed(p), pos), op)
    reason = F.when((pos == "axiom") & ~op.isin(*sorted(p.axioms)), F.concat(F.lit(f"{p.name} lacks the axiom "), op))
    reason = reason.when(~fits, F.concat(F.lit(f"{p.name} lacks "), op, F.lit(" in position "), pos))
    reason = reason.when(pos.isin("axiom"), F.lit(None))
    if p.single:
        reason = reason.when(pos.isNotNull() & op.isin(*p.single) & (count != 1), F.concat(F.lit("one element expected in "), op, F.lit(", found "), count.cast("string")))
    if p.at_most_one:
        reason = reason.when(pos.isNotNull() & op.isin(*p.at_most_one) & (n["n"] > 1), F.concat(F.lit("0 or 1 expected in "), op, F.lit(", found "), n["n"].cast("string")))
    if p.no_thing:
        reason = reason.when(pos.isin(*p.no_thing) & (op == "Class") & (n["iri"] == t.THING), F.lit(f"{p.name} lacks owl:Thing here"))
    if p.only_thing:
        reason = reason.when(pos.isin(*p.only_thing) & (n["iri"] != t.THING), F.lit("owl:Thing expected"))
    # an axiom the profile lacks is one violation, whatever it holds
    known = F.col("kind").isin(*sorted(p.axioms))
    zipped = F.when(known, F.arrays_zip("nodes", F.col("places"))).otherwise(F.slice(F.arrays_zip("nodes", F.col("places")), 1, 1))
    rows = o.axioms.withColumn("places", _positions(p)).select("idx", "kind", "nodes", F.explode(zipped).alias("z")).select("idx", "nodes", F.col("z.nodes").alias("n"), F.col("z.places").alias("pos"))
    out = rows.select(F.lit(p.name).alias("profile"), "idx", F.col("n.id").alias("node"), reason.alias("reason"))
    return out.filter("reason is not null")


def _property_iri(n: Column) -> Column:
    """A property's IRI, through an inverse."""
    return n["iri"]


def property_edges(o: Ontology) -> DataFrame:
    """(sub, super) between object properties, inverses as their property; no self edges."""
    pair = o.kind("SubObjectPropertyOf").select(child(0)["iri"].alias("sub"), child(1)["iri"].alias("super"))
    one = o.kind("SubPropertyChainOf").filter(F.size(parts()) == 2).select(child(1)["iri"].alias("sub"), child(0)["iri"].alias("super"))
    ops = o.kind("EquivalentObjectProperties", "InverseObjectProperties").select(F.transform(parts(), lambda n: n["iri"]).alias("c"))
    equal = ops.select(F.explode("c").alias("sub"), "c").select("sub", F.explode("c").alias("super"))
    return pair.unionByName(one).unionByName(equal).filter("sub <> super").distinct()


def non_simple(o: Ontology) -> DataFrame:
    """(iri): transitive properties, ends of chains of two or more, and everything above them."""
    seed = o.kind("TransitiveObjectProperty").select(child(0)["iri"].alias("iri"))
    chains = o.kind("SubPropertyChainOf").filter(F.size(parts()) >= 3).select(child(0)["iri"].alias("iri"))
    edges = property_edges(o)
    return fixpoint(seed.unionByName(chains), lambda d, k, n: d.join(edges, d["iri"] == edges["sub"]).select(F.col("super").alias("iri")), ["iri"])


_SIMPLE_AXIOMS = ("FunctionalObjectProperty", "InverseFunctionalObjectProperty", "IrreflexiveObjectProperty", "AsymmetricObjectProperty", "DisjointObjectProperties")
_SIMPLE_IN = ("ObjectHasSelf", "ObjectMinCardinality", "ObjectMaxCardinality", "ObjectExactCardinality")


def dl_violations(o: Ontology) -> DataFrame:
    """Uses of non-simple properties where only simple ones may stand. The other global conditions of DL are not checked."""
    n = o.axioms.select("idx", "nodes", F.explode("nodes").alias("n"))
    over = F.get(F.col("nodes"), F.col("n.parent"))["op"]
    used = n.filter(over.isin(*_SIMPLE_AXIOMS, *_SIMPLE_IN) & F.col("n.op").isin("ObjectProperty", "ObjectInverseOf") & F.col("n.role").isin("property", "operand"))
    used = used.select("idx", F.col("n.id").alias("node"), F.col("n.iri").alias("iri"), over.alias("place"))
    bad = used.join(non_simple(o), "iri", "left_semi")
    return bad.select(F.lit("DL").alias("profile"), "idx", "node", F.concat(F.col("iri"), F.lit(" is not simple but used in "), F.col("place")).alias("reason"))


def check(o: Ontology, *which: str) -> DataFrame:
    """Violations of the named profiles (all four without a name)."""
    which = which or ("EL", "QL", "RL", "DL")
    by = {p.name: p for p in PROFILES}
    return reduce(DataFrame.unionByName, [dl_violations(o) if w == "DL" else violations(o, by[w]) for w in which])


def profiles(o: Ontology) -> list[str]:
    """The profiles without a violation, in the order EL, QL, RL, DL."""
    bad = {r[0] for r in check(o).select("profile").distinct().collect()}
    return [p for p in ("EL", "QL", "RL", "DL") if p not in bad]
