"""Terms, parsing and rendering without Spark jobs, and their column forms."""

import random

import pytest

from axiomata.functions import names
from axiomata.functions import terms as t
from axiomata.model import Ontology
from axiomata.sources import ofn

P = names.prefixes(**{"": "urn:t:"})
EXPRESSIONS = [
    "ObjectIntersectionOf(:K :L)", "ObjectUnionOf(:K ObjectComplementOf(:L))", "ObjectComplementOf(:K)", "ObjectOneOf(:i _:x)", "ObjectSomeValuesFrom(:u :K)", "ObjectAllValuesFrom(ObjectInverseOf(:u) :K)", "ObjectHasValue(:u :i)", "ObjectHasSelf(:u)",
    "ObjectMinCardinality(2 :u)", "ObjectMaxCardinality(1 :u :K)", "ObjectExactCardinality(0 :u :K)", "DataSomeValuesFrom(:d xsd:int)", 'DataAllValuesFrom(:d DatatypeRestriction(xsd:int xsd:minInclusive "1"^^xsd:int))',
    'DataHasValue(:d "v"@en)', "DataMinCardinality(1 :d)", "DataMaxCardinality(1 :d DataUnionOf(xsd:int xsd:string))", 'DataExactCardinality(3 :d DataOneOf("a" "b"))', "DataSomeValuesFrom(:d DataComplementOf(DataIntersectionOf(xsd:int xsd:long)))",
]
AXIOMS = [
    "Declaration(Class(:K))", "Declaration(NamedIndividual(:i))", "SubClassOf(:K :L)", "EquivalentClasses(:K :L :M)", "DisjointClasses(:K :L)", "DisjointUnion(:K :L :M)", "SubObjectPropertyOf(:u :w)",
    "SubObjectPropertyOf(ObjectPropertyChain(:u :w) :r)", "EquivalentObjectProperties(:u :w)", "DisjointObjectProperties(:u :w)", "InverseObjectProperties(:u :w)", "ObjectPropertyDomain(:u :K)", "ObjectPropertyRange(:u :K)",
    *[f"{k}ObjectProperty(:u)" for k in ("Functional", "InverseFunctional", "Reflexive", "Irreflexive", "Symmetric", "Asymmetric", "Transitive")], "SubDataPropertyOf(:d :e)", "EquivalentDataProperties(:d :e)",
    "DisjointDataProperties(:d :e)", "DataPropertyDomain(:d :K)", "DataPropertyRange(:d xsd:int)", "FunctionalDataProperty(:d)", "DatatypeDefinition(:dt xsd:int)", "HasKey(:K (:u) (:d))", "HasKey(:K () ())", "SameIndividual(:i :j)",
    "DifferentIndividuals(:i :j)", "ClassAssertion(:K _:x)", "ObjectPropertyAssertion(:u :i :j)", "NegativeObjectPropertyAssertion(:u :i :j)", 'DataPropertyAssertion(:d :i "1"^^xsd:int)', 'NegativeDataPropertyAssertion(:d :i "1"^^xsd:int)',
    'AnnotationAssertion(rdfs:label :K "x \\"y\\" \\\\ \\n\\t"@de-AT)', "SubAnnotationPropertyOf(:n :m)", "AnnotationPropertyDomain(:n :K)", "AnnotationPropertyRange(:n :K)", 'SubClassOf(Annotation(rdfs:comment "since") :K :L)',
]


def short(iri):
    from axiomata.operators.icv import _short

    return _short(iri, P)


def test_every_construct_is_covered():
    heads = {a.split("(")[0] for a in AXIOMS} | {"SubPropertyChainOf"}
    assert heads == set(t.AXIOMS) and len(t.AXIOMS) == 38
    assert {e.split("(")[0] for e in EXPRESSIONS} == set(t.CLASS_EXPRESSIONS)


@pytest.mark.parametrize("text", EXPRESSIONS)
def test_expressions_render_unchanged(text):
    x = ofn.parse_class(text, P)
    again = t.render(x, short)
    assert again.replace("^^xsd:string", "") == text
    assert t.render(ofn.parse_class(t.render(x))) == t.render(x)


@pytest.mark.parametrize("text", AXIOMS)
def test_axioms_render_unchanged(text):
    ax, notes = ofn.parse_axiom(text, P)
    named = lambda x: t.render(x, short)
    assert t.annotated(named(ax), notes, named).replace("^^xsd:string", "") == text
    assert t.render(t.tree([dict(zip(t.NODE.names, n)) for n in t.nodes(ax)])) == t.render(ax)


@pytest.mark.parametrize(
    ("text", "message"),
    [("SubClassOf(:A", "line 1"), ("SubClassOf(:A :B) :C", "the end"), ("SubClassOf(x:A :B)", "not declared"), ("Nonsense(:A)", "no axiom"), ("SubClassOf(:A\n<a b>)", "line 2"), ('AnnotationAssertion(:n :A "a\\q")', "escape"),
     ("AnnotationAssertion(:n _:x :A)", "anonymous"), ("SubClassOf(:A DataSomeValuesFrom(:d :e xsd:int))", "several"), ("Declaration(Thing(:A))", "kind"), ('AnnotationAssertion(:n :A "open)', "without an end"), ("SubClassOf(:A ObjectMinCardinality(x :p))", "integer")],
)
def test_errors_name_the_line(text, message):
    with pytest.raises(ofn.ParseError, match=message):
        ofn.parse_axiom(text, P)


def test_document_header_and_nested_annotations():
    d = ofn.parse('Prefix(a:=<urn:a#>)\nOntology(<urn:o> <urn:o/1>\nImport(<urn:other>)\nAnnotation(Annotation(a:x "gone") rdfs:label "o"@en)\n# note\nSubClassOf(a:A a:B)\n)')
    assert (d.iri, d.version, d.imports) == ("urn:o", "urn:o/1", ["urn:other"]) and len(d.notes) == 1 and len(d.axioms) == 1
    assert t.render(d.axioms[0][0]) == "SubClassOf(<urn:a#A> <urn:a#B>)"


def canon(text):
    return t.render(ofn.parse_class(t.canonical(ofn.parse_class(text, P))), short)


def test_canonical_forms():
    assert canon("ObjectIntersectionOf(:B ObjectIntersectionOf(:A :B) :A)") == "ObjectIntersectionOf(:A :B)"
    assert canon("ObjectUnionOf(:A ObjectUnionOf(:A))") == ":A"
    assert canon("ObjectIntersectionOf(:C ObjectUnionOf(ObjectIntersectionOf(:B :A)))") == "ObjectIntersectionOf(:A :B :C)"
    assert canon("DataSomeValuesFrom(:d DataUnionOf(xsd:b DataUnionOf(xsd:a xsd:c)))") == "DataSomeValuesFrom(:d DataUnionOf(xsd:b DataUnionOf(xsd:a xsd:c)))"
    key = lambda s: t.canonical(ofn.parse_axiom(s, P)[0])
    assert key("EquivalentClasses(:B :A :B)") == key("EquivalentClasses(:A :B)")
    assert key("SubClassOf(:A :B)") != key("SubClassOf(:B :A)")
    assert key("InverseObjectProperties(:q :p)") == key("InverseObjectProperties(:p :q)")
    assert key("InverseObjectProperties(:p :p)") == "InverseObjectProperties(<urn:t:p> <urn:t:p>)"
    assert key("SubObjectPropertyOf(ObjectPropertyChain(:q :p) :r)") != key("SubObjectPropertyOf(ObjectPropertyChain(:p :q) :r)")
    assert key("HasKey(:A (:q :p) (:e :d))") == key("HasKey(:A (:p :q) (:d :e))")


def random_class(draw, depth=3):
    if depth == 0 or draw.random() < 0.3:
        return t.cls(f"urn:t:{draw.choice('ABC')}")
    kind = draw.randrange(5)
    if kind < 2:
        return (t.conj, t.disj)[kind](*[random_class(draw, depth - 1) for _ in range(draw.randint(1, 3))])
    if kind == 2:
        return t.neg(random_class(draw, depth - 1))
    return (t.some, t.only)[kind - 3](t.obj("urn:t:p"), random_class(draw, depth - 1))


def test_canonical_is_stable_and_columns_agree(spark):
    from pyspark.sql import functions as F

    draw = random.Random(4)
    for _ in range(300):
        x = random_class(draw)
        once = t.canonical(x)
        assert t.canonical(ofn.parse_class(once)) == once

    def with_columns(x):
        return t.Term(x.op, tuple(map(with_columns, x.args)), iri=F.col("c").substr(1, 6) if False else None if x.iri is None else F.concat(F.lit(x.iri[:-1]), F.col(x.iri[-1].lower())) if x.op == "Class" else x.iri, n=x.n)

    one = spark.createDataFrame([("A", "B", "C")], "a string, b string, c string")
    for _ in range(25):
        x = random_class(draw)
        made = t.columns(t.make("SubClassOf", t.cls(F.lit("urn:t:Z")), with_columns(x)), (t.make("Annotation", t.ann("urn:n"), t.literal(F.lit('q"'))),))
        row = one.select(made["text"].alias("text"), made["canon"].alias("canon")).first()
        expected = t.row(0, t.make("SubClassOf", t.cls("urn:t:Z"), x), (t.make("Annotation", t.ann("urn:n"), t.literal('q"')),))
        assert row["text"] == expected[2] and row["canon"] == expected[3]


def test_literals():
    from datetime import datetime, timezone

    assert t.render(t.double(1.0)) == f'"1"^^<{t.XSD}double>' and t.render(t.boolean(False)).startswith('"false"')
    assert t.moment(datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc)).value == "2024-01-02T03:04:05Z" == t.moment(datetime(2024, 1, 2, 3, 4, 5)).value
    assert t.integer(7).value == "7" and t.literal("x", lang="en").datatype == f"{t.RDF}langString"
    with pytest.raises(ValueError):
        t.make("Unknown")


def test_names(spark):
    from pyspark.sql import functions as F

    table = names.prefixes(a="urn:a/", ab="urn:a/b/", **{"": "urn:d#"})
    asked = ["a:x", "bare", "<urn:q>", "http://x/y", "urn:x:y", "nope:z", "", " ", None, "mailto:a@b"]
    rows = spark.createDataFrame([(x,) for x in asked], "n string").select("n", names.expand(F.col("n"), table).alias("e"), names.why_not_expanded(F.col("n"), table).alias("w")).collect()
    got = {r["n"]: (r["e"], r["w"]) for r in rows}
    assert got["a:x"][0] == "urn:a/x" and got["bare"][0] == "urn:d#bare" and got["<urn:q>"][0] == "urn:q" and got["http://x/y"][0] == "http://x/y" and got["urn:x:y"][0] == "urn:x:y"
    assert got["nope:z"] == (None, "unknown prefix nope") and got[""][1] == "empty name" and got[None] == (None, None) and got["mailto:a@b"][0] == "mailto:a@b"
    iris = ["urn:a/b/c", "urn:a/b", "urn:a/", "urn:d#x", "urn:a/x y", "other"]
    short_ = {r[0]: r[1] for r in spark.createDataFrame([(x,) for x in iris], "i string").select("i", names.compact(F.col("i"), table)).collect()}
    assert short_ == {"urn:a/b/c": "ab:c", "urn:a/b": "a:b", "urn:a/": None, "urn:d#x": ":x", "urn:a/x y": None, "other": None}
    b = spark.createDataFrame([(t.THING,), (t.OWL,), ("urn:x",)], "i string").select(names.is_builtin(F.col("i"))).collect()
    assert [r[0] for r in b] == [True, False, False]


def test_round_trip_of_a_document(spark, tmp_path):
    text = "Prefix(:=<urn:t:>)\nOntology(<urn:o>\n" + "\n".join(a for a in AXIOMS) + "\n)"
    o = ofn.ontology(spark, text)
    again = ofn.ontology(spark, ofn.document(o))
    pick = lambda x: [(r["idx"], r["text"], r["canon"]) for r in x.axioms.orderBy("idx").collect()]
    assert pick(o) == pick(again) and o.count() == len(AXIOMS)
    ofn.write(o, f"{tmp_path}/out")
    lines = [r[0] for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert sorted(lines) == sorted(ofn.document(o).splitlines())
    rows = ofn.read(spark, f"{tmp_path}/out", permissive=True).collect()
    assert rows and all(r["onto"].startswith("file:") for r in rows)
    bad = spark.createDataFrame([("x", "Ontology("), ("y", "Ontology(SubClassOf(<a> <b>))")], "k string, v string")
    found = {r["onto"]: r for r in ofn.parse_column(bad, "k", "v", permissive=True).collect()}
    assert found["x"]["error"].startswith("line 1") and found["y"]["kind"] == "SubClassOf"
    gate = ofn.axiom_table(spark.createDataFrame([("SubClassOf(:B :A)",), ("oops",), (None,)], "a string"), "a", P).collect()
    assert [bool(r["error"]) for r in gate] == [False, True, True]
    assert Ontology(o.axioms, prefixes=P).sort().axioms.agg({"idx": "max"}).first()[0] == len(AXIOMS) - 1
