"""Builders, names of entities, the gate for axioms in text, tables of fixpoints."""

import pytest

from axiomata import builders
from axiomata.functions import names
from axiomata.functions import terms as t
from axiomata.model import Ontology
from axiomata.operators.vocabulary import Vocabulary


def test_every_builder_step(spark):
    n = builders.Namer(names.prefixes(x="urn:x:"))
    c, p, q, d, i, j = n.cls("x:C"), n.obj("x:p"), n.obj("<urn:x:q>"), n.dat("x:d"), n.ind("urn:x:i"), n.ind("x:j")
    made = [
        *builders.define(c).label("l", "en").comment("k").annotate(n.ann("x:a"), t.integer(3)).sub_class_of(n.cls("x:D"), n.cls("x:E")).equivalent_to(n.cls("x:F")).disjoint_with(n.cls("x:G"), n.cls("x:H")).disjoint_union_of(c, c).key(p).axioms,
        *builders.define(p).domain(c).range(c).sub_property_of(q).equivalent_to(q).inverse_of(q).chain(q, q).functional().inverse_functional().transitive().symmetric().asymmetric().reflexive().irreflexive().axioms,
        *builders.define(d).domain(c).range(n.datatype("xsd:string")).sub_property_of(d).functional().axioms,
        *builders.define(i).type(c).fact(p, j).not_fact(p, j).data(d, t.boolean(True)).same_as(j).different_from(j).axioms,
        *builders.define(n.ann("x:a")).label("note").axioms,
    ]
    kinds = [a.op for a in made]
    assert kinds.count("Declaration") == 5 and kinds.count("SubClassOf") == 2 and kinds.count("AnnotationAssertion") == 4 and len(made) == 11 + 14 + 5 + 7 + 1
    texts = [r["text"] for r in Ontology.of(spark, made).axioms.orderBy("idx").collect()]
    assert texts[1] == 'AnnotationAssertion(<http://www.w3.org/2000/01/rdf-schema#label> <urn:x:C> "l"@en)' and texts[-3] == "DifferentIndividuals(<urn:x:i> <urn:x:j>)"
    assert len(builders.define(c).disjoint_with().axioms) == 1
    assert n.err is None


def test_the_first_bad_name_is_kept():
    n = builders.Namer()
    assert n.cls("owl:Thing").iri == t.THING and n.err is None
    assert n.cls("no:X").iri == "no:X" and n.err == "unknown prefix no"
    n.cls("bare")
    assert n.err == "unknown prefix no" and builders.Namer({}).cls("bare").iri == "bare"


def test_vocabulary_refuses_texts_with_unknown_terms(spark):
    o = Ontology.of(spark, [t.make("Declaration", t.cls("urn:x:A")), t.make("Declaration", t.obj("urn:x:p"))], prefixes=names.prefixes(x="urn:x:"))
    v = Vocabulary.of(o, declared_only=True)
    assert t.render(v.parse_axiom("SubClassOf(x:A ObjectSomeValuesFrom(x:p owl:Thing))")[0]).startswith("SubClassOf(<urn:x:A>")
    assert v.parse_class("ObjectComplementOf(x:A)").op == "ObjectComplementOf"
    for text in ("SubClassOf(x:A x:B)", "SubClassOf(x:A"):
        with pytest.raises(ValueError):
            v.parse_axiom(text)
    with pytest.raises(ValueError, match="urn:x:q"):
        v.parse_class("ObjectSomeValuesFrom(x:q x:A)")


def test_tables_of_fixpoints_are_forgotten(spark):
    import os

    from axiomata.plans.fixpoint import checkpointed, closure, forget

    kept = checkpointed(spark.range(5))
    folder = os.path.dirname(kept.inputFiles()[0].removeprefix("file://").removeprefix("file:"))
    assert kept.count() == 5 and os.path.isdir(folder)
    forget(kept)
    assert not os.path.exists(folder)
    path = spark.range(40).selectExpr("id as src", "id + 1 as dst")
    assert closure(path, double=False).count() == 41 * 40 // 2


def test_commands_report_and_leave_out_what_was_seen(spark, tmp_path, capsys):
    from axiomata.__main__ import run

    (tmp_path / "o.ofn").write_text("Prefix(x:=<urn:x:>) Ontology(<urn:o> SubClassOf(x:A x:A) SubClassOf(x:A x:B))")
    assert run(spark, ["lint", f"{tmp_path}/o.ofn", "--fail-on", "warning"]) == 1
    shown = capsys.readouterr().out
    assert "trivial-axiom" in shown
    import json

    run(spark, ["lint", f"{tmp_path}/o.ofn", "--json"])
    found = json.loads(capsys.readouterr().out)["findings"]
    (tmp_path / "seen.json").write_text("\n".join(json.dumps(f) for f in found if f["rule"] == "trivial-axiom"))
    run(spark, ["lint", f"{tmp_path}/o.ofn", "--seen", f"{tmp_path}/seen.json"])
    rest = capsys.readouterr().out
    assert "trivial-axiom" not in rest and "undeclared-entity" in rest
