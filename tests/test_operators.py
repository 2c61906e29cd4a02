"""Operators over small ontologies: against naive evaluations on random worlds, and against written-out answers."""

import random

import pytest
from pyspark.sql import functions as F

from axiomata.functions import names
from axiomata.functions import terms as t
from axiomata.model import Ontology
from axiomata.operators import asserted, conform, diff, el, icv, lint, profiles, rdfmap, reports, shapes, vocabulary
from axiomata.plans.fixpoint import closure, components
from axiomata.sources import ofn, rdf
from axiomata.sources.registry import Entry, Registry, skip_summary

HEAD = "Prefix(:=<urn:t:>)\nOntology(<urn:t>\n"


def onto(spark, *axioms, iri="urn:t"):
    return ofn.ontology(spark, f"Prefix(:=<{iri}#>)\nPrefix(t:=<urn:t:>)\nOntology(<{iri}>\n" + "\n".join(a.replace(" :", " t:").replace("(:", "(t:") if iri == "urn:t" else a for a in axioms) + "\n)")


def ns(text):
    """Fill in the standard namespaces."""
    for name in ("OWL", "RDF", "RDFS", "XSD"):
        text = text.replace(f"@{name}@", getattr(t, name))
    return text


def short(iri):
    return iri.removeprefix("urn:t:")


def rules_of(found):
    return sorted((r["rule"], short(r["subject"])) for r in found.collect())


# == asserted


def test_signature_labels_and_values(spark):
    o = onto(
        spark, 'AnnotationAssertion(rdfs:label :A ""@en)', 'AnnotationAssertion(rdfs:label :A "late")', "ClassAssertion(ObjectSomeValuesFrom(:p :A) :i)", "ClassAssertion(:A _:x)", "ObjectPropertyAssertion(:p :i :j)",
        'DataPropertyAssertion(:d :i "1"^^xsd:int)', "Declaration(Class(:A))", 'SubClassOf(Annotation(:note "n"@en) :B :A)', "DatatypeDefinition(:dt DatatypeRestriction(xsd:int :f \"1\"^^xsd:long))",
    ).annotate(t.ann("urn:t:head"), t.bare("urn:t:value"))
    sig = {(r["kind"], short(r["iri"])) for r in o.signature().collect()}
    X = t.XSD
    assert sig == {
        (0, "A"), (0, "B"), (1, f"{X}int"), (1, f"{X}long"), (1, f"{X}string"), (1, f"{t.RDF}langString"), (1, "dt"), (2, "p"), (3, "d"), (4, f"{t.RDFS}label"), (4, "note"), (4, "head"), (5, "i"), (5, "j"),
    }
    assert [(short(r["iri"]), r["text"]) for r in asserted.labels(o).collect()] == [("A", "")]
    assert {r["individual"] for r in asserted.types(o).collect()} == {"urn:t:i", "_:x"}
    assert [r[0] for r in asserted.instances(o, "ObjectSomeValuesFrom(<urn:t:p> <urn:t:A>)").collect()] == ["urn:t:i"]
    assert asserted.object_values(o).first()["object"] == "urn:t:j" and asserted.data_values(o).first()["value"] == "1"
    asked = spark.createDataFrame([(0, "urn:t:A")], "kind int, iri string")
    assert sorted(r["idx"] for r in asserted.referencing(o, asked).collect()) == [2, 3, 6, 7]


def test_hierarchy_against_search(spark):
    draw = random.Random(2)
    for _ in range(3):
        edges = {(draw.randrange(12), draw.randrange(12)) for _ in range(18)}
        o = Ontology.of(spark, [t.make("SubClassOf", t.cls(f"urn:t:{a}"), t.cls(f"urn:t:{b}")) for a, b in edges] + [t.make("EquivalentClasses", t.cls("urn:t:1"), t.cls("urn:t:20"), t.conj(t.cls("urn:t:3"), t.cls("urn:t:4")))])
        steps = edges | {(1, 20), (20, 1)}
        direct = {(int(short(r["sub"])), int(short(r["super"]))) for r in asserted.hierarchy(o).collect()}
        assert direct == steps
        reach = set()
        for start in {x for e in steps for x in e}:
            seen, todo = set(), [start]
            while todo:
                x = todo.pop()
                for a, b in steps:
                    if a == x and b not in seen:
                        seen.add(b)
                        todo.append(b)
            reach |= {(start, b) for b in seen if b != start}
        got = {(int(short(r["cls"])), int(short(r["ancestor"]))) for r in asserted.ancestors(o).collect()}
        assert got == reach and len(reach) > 20
        one = spark.createDataFrame([("urn:t:1",)], "c string")
        assert {(int(short(r["cls"])), int(short(r["descendant"]))) for r in asserted.descendants(o, one).collect()} == {(1, a) for a, b in reach if b == 1}
        plain = closure(asserted.hierarchy(o), "sub", "super", double=False)
        assert plain.count() == len(reach)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (4, 5), (6, 6), (9, 8), (8, 7)], "x int, y int")
    assert {(r["node"], r["root"]) for r in components(edges, "x", "y").collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (7, 7), (8, 7), (9, 7)}


# == diff


def test_diff_is_a_multiset_difference(spark):
    draw = random.Random(8)
    pool = [f"SubClassOf(:{a} :{b})" for a in "AB" for b in "CD"] + ["EquivalentClasses(:A :D)", "EquivalentClasses(:D :A)"]
    key = {p: ("E" if p.startswith("Eq") else p) for p in pool}
    for _ in range(3):
        a, b = [draw.choice(pool) for _ in range(9)], [draw.choice(pool) for _ in range(7)]
        removed, added = diff.diff_axioms(onto(spark, *a), onto(spark, *b))

        def beyond(own, other):
            left = [key[x] for x in other]
            out = []
            for i, x in enumerate(own):
                if key[x] in left:
                    left.remove(key[x])
                else:
                    out.append(i)
            return out

        assert sorted(r["idx"] for r in removed.collect()) == beyond(a, b)
        assert sorted(r["idx"] for r in added.collect()) == beyond(b, a)
    o = onto(spark, *a)
    assert diff.diff(o, o).isEmpty() and diff.summary(o, o) == "no difference"
    changed = o.header(version="v").importing("urn:i").annotate(t.ann("urn:n"), t.literal("x"))
    assert [x[:2] for x in diff.diff_header(o, changed)] == [("+", "version"), ("+", "import"), ("+", "annotation")]
    assert "3 header changes" in diff.summary(o, changed)
    assert diff.distinct_axioms(o).count() == len(set(map(key.get, a))) == o.count() - diff.duplicates(o).count()
    assert diff.overlay(o, o).count() == diff.distinct_axioms(o).count()
    merged = diff.merge("urn:m", o, onto(spark, *b))
    assert merged.iri == "urn:m" and merged.imports == ("urn:t",)
    assert {r["kind"] for r in diff.touched(onto(spark, a[0]), onto(spark)).collect()} == {0}


# == lint, profiles


def test_lint_rules(spark):
    o = onto(
        spark, "Declaration(Class(:A))", "Declaration(ObjectProperty(:p))", "Declaration(Class(:B))", 'AnnotationAssertion(rdfs:label :A "a")', "SubClassOf(:A :B)", *["SubClassOf(:B :A)"], "SubClassOf(:C :C)", "SubClassOf(:A :B)",
        'AnnotationAssertion(owl:deprecated :B "true"^^xsd:boolean)', "EquivalentClasses(:C ObjectIntersectionOf(:C))", "ClassAssertion(:p :i)", "DisjointClasses(:D)", "SameIndividual(:i :i)", "SubClassOf(owl:Thing :D)",
    )
    found = lint.run(o)
    by = {}
    for r in found.collect():
        by.setdefault(r["rule"], []).append((short(r["subject"]), r["idx"]))
    assert sorted(x for x, _ in by["undeclared-entity"]) == ["C", "D", "i", "p"]
    assert by["punned-entity"] == [("p", None)]
    assert sorted(x for x, _ in by["missing-label"]) == ["B", "p"]
    assert sorted(i for _, i in by["deprecated-reference"]) == [4, 5, 7]
    assert by["duplicate-axiom"] == [("", 7)]
    assert sorted(i for _, i in by["trivial-axiom"]) == [6, 9, 11, 12]
    assert by["subclass-cycle"] == [("A", None)]
    assert sorted(x for x, _ in by["orphan-class"]) == ["D", "p"]
    assert lint.worst(found) == lint.ERROR and lint.severity(" Warning") == 1
    kept, unknown = lint.select(lint.DEFAULT, ["orphan-class", "zzz"])
    assert len(kept) == 7 and unknown == ["zzz"]
    assert lint.unseen(found, found).isEmpty()
    assert lint.run(onto(spark), kept).isEmpty()


def test_prefer_standard_terms(spark):
    ref = spark.createDataFrame([(0, "urn:s:Family_Name", "s:Family_Name", ""), (0, "urn:s:Q1", "s:Q1", "Given name"), (2, "urn:s:knows", "s:knows", "")], "kind int, iri string, name string, label string")
    o = onto(spark, "Declaration(Class(:familyName))", "Declaration(Class(:X))", 'AnnotationAssertion(rdfs:label :X "given-name")', "Declaration(Class(:knows))", "Declaration(ObjectProperty(:Knows))", "EquivalentObjectProperties(:Knows <urn:s:knows>)", "Declaration(Class(<urn:s:Q1>))")
    found = lint.prefer_standard_terms(ref).check(o)
    assert sorted(short(r["subject"]) for r in found.collect()) == ["X", "familyName"]


def test_profiles(spark):
    el_only = onto(spark, "SubClassOf(:A ObjectSomeValuesFrom(:p ObjectIntersectionOf(:B :C)))", "TransitiveObjectProperty(:p)")
    assert profiles.profiles(el_only) == ["EL", "DL"]
    assert profiles.profiles(onto(spark, "SubClassOf(:A :B)")) == ["EL", "QL", "RL", "DL"]
    rl = onto(spark, "SubClassOf(ObjectSomeValuesFrom(:p owl:Thing) ObjectMaxCardinality(1 :p :A))", "SubClassOf(ObjectUnionOf(:A :B) ObjectComplementOf(:C))")
    assert profiles.profiles(rl) == ["RL", "DL"]
    assert {r["reason"] for r in profiles.check(onto(spark, "SubClassOf(:A owl:Thing)"), "RL").collect()} == {"RL lacks owl:Thing here"}
    dl = onto(spark, "TransitiveObjectProperty(:p)", "SubObjectPropertyOf(:p :q)", "InverseObjectProperties(:q :r)", "SubClassOf(:A ObjectMinCardinality(2 ObjectInverseOf(:r)))", "FunctionalObjectProperty(:s)", "AsymmetricObjectProperty(:q)")
    assert {short(r["iri"]) for r in profiles.non_simple(dl).collect()} == {"p", "q", "r"}
    assert sorted(r["idx"] for r in profiles.dl_violations(dl).collect()) == [3, 5]
    assert profiles.profiles(dl.rewrite(lambda df: df.filter("idx <> 3 and idx <> 5")))[-1] == "DL"


# == vocabularies


def test_vocabulary_lookup_and_validation(spark):
    o = onto(spark, "Declaration(Class(:Big))", "Declaration(ObjectProperty(:knows))", "Declaration(DataProperty(:age))", 'AnnotationAssertion(rdfs:label :Big "Large Thing")', 'AnnotationAssertion(rdfs:label :knows "same")', 'AnnotationAssertion(rdfs:label :age "Same")', 'AnnotationAssertion(rdfs:comment :Big "a\n b")')
    v = vocabulary.Vocabulary.of(o, declared_only=True)
    asked = spark.createDataFrame([(x,) for x in ("t:Big", "urn:t:Big", "<urn:t:Big>", " large thing ", "SAME", "t:big", "zip", None)], "name string")
    got = {r["asked"]: r for r in v.resolve(asked).collect()}
    assert [got[x]["status"] for x in ("t:Big", "urn:t:Big", "<urn:t:Big>", " large thing ", "SAME", "t:big", "zip")] == ["found"] * 4 + ["ambiguous", "unknown", "unknown"]
    assert got["t:big"]["suggestion"] == "t:Big" and got["zip"]["suggestion"] is None
    assert v.lookup(asked, kind=t.DATA).first()["iri"] == "urn:t:age"
    more = onto(spark, "SubClassOf(:Big :Small)", "SubClassOf(:Big owl:Thing)")
    assert [(r["idx"], short(r["iri"])) for r in v.unknown(more).collect()] == [(0, "Small")]
    assert [r["idx"] for r in v.valid(more).axioms.collect()] == [1]
    with pytest.raises(ValueError, match="Small"):
        v.require(more)
    text = v.prompt()
    assert text.index("Classes:") < text.index("Object properties:") and "- t:Big (Large Thing): a b" in text and text.startswith("t: <urn:t:>")
    assert v.of_kind(t.CLASS).count() == 1 and v.contains(o.signature()).count() == 3


def test_owner_and_registry(spark, tmp_path):
    (tmp_path / "s.ofn").write_text("Ontology(<urn:s> Declaration(Class(<urn:s:A>)))")
    reg = Registry([Entry("s", "urn:s:", str(tmp_path / "s.ofn")), Entry("sx", "urn:s:x")])
    assert reg.owner("urn:s:xy").prefix == "sx" and reg.owner("other") is None and reg.by_prefix("s").namespace == "urn:s:" and len(Registry().all()) > 10
    iris = spark.createDataFrame([("urn:s:xy",), ("urn:s:A",), ("other",), (None,)], "iri string")
    assert {r["iri"]: r["prefix"] for r in vocabulary.owner(iris, "iri", reg.table(spark)).collect()} == {"urn:s:xy": "sx", "urn:s:A": "s", "other": None, None: None}
    assert reg.merge(spark, "urn:m", "s").count() == 1 and reg.by_prefix("s").vocabulary(spark).terms.count() == 1 and reg.prefixes()["sx"] == "urn:s:x"
    with pytest.raises(ValueError):
        reg.by_prefix("sx").ontology(spark)


# == EL


def naive_el(axioms, names_):
    """Saturation over sets, straight from the completion rules, of normalised triples."""
    forms = []
    for i, ax in enumerate(axioms):
        forms += el._Normaliser(i).axiom(ax)
    every = {x for f in forms for x in (f[3], f[4]) if x} | {f[5] for f in forms if f[5] and f[0] not in ("rsub", "chain")} | {t.THING, t.NOTHING}
    S, R = {(a, a) for a in every} | {(a, t.THING) for a in every}, set()
    while True:
        s, r = set(), set()
        for f, p, q, a, a2, b, *_ in forms:
            if f == "sub":
                s |= {(x, b) for x, y in S if y == a}
            elif f == "conj":
                s |= {(x, b) for x, y in S if y == a and (x, a2) in S}
            elif f == "exists":
                r |= {(p, x, b) for x, y in S if y == a}
            elif f == "exleft":
                s |= {(x, b) for w, x, y in R if w == p and (y, a) in S}
            elif f == "rsub":
                r |= {(b, x, y) for w, x, y in R if w == p}
            elif f == "chain":
                r |= {(b, x, z) for w, x, y in R if w == p for v, y2, z in R if v == q and y2 == y}
        s |= {(x, t.NOTHING) for _, x, y in R if (y, t.NOTHING) in S}
        if s <= S and r <= R:
            return {(a, b) for a, b in S if a in names_ and (b in names_ or b == t.NOTHING) and a != b}
        S |= s
        R |= r


def random_el(draw):
    c = lambda: t.cls(f"urn:t:{draw.randrange(9)}")
    r = lambda: t.obj(f"urn:t:r{draw.randrange(3)}")
    out = []
    for _ in range(22):
        k = draw.randrange(9)
        out.append([
            lambda: t.make("SubClassOf", c(), c()), lambda: t.make("SubClassOf", c(), t.some(r(), c())), lambda: t.make("SubClassOf", t.some(r(), c()), c()), lambda: t.make("SubClassOf", t.conj(c(), c(), c()), c()),
            lambda: t.make("EquivalentClasses", c(), t.conj(c(), t.some(r(), t.conj(c(), c())))), lambda: t.make("SubObjectPropertyOf", r(), r()), lambda: t.make("SubPropertyChainOf", r(), r(), r()),
            lambda: t.make("DisjointClasses", c(), c()), lambda: t.make("ObjectPropertyDomain", r(), c()),
        ][k]())
    return out


def test_el_equals_naive_saturation(spark):
    draw = random.Random(13)
    total = 0
    for _ in range(3):
        axioms = random_el(draw)
        o = Ontology.of(spark, axioms)
        c = el.classify(o)
        known = {r["iri"] for r in c.classes().collect()}
        got = {(r["sub"], r["super"]) for r in c.subsumptions().collect()}
        assert got == naive_el(axioms, known)
        total += len(got)
    assert total > 10
    why = el.classify(o, explanations=True)
    same = {(r["sub"], r["super"]) for r in why.subsumptions().collect()}
    assert same == got
    for sub, sup in sorted(got)[:2]:
        support = why.explain(sub, sup)
        again = el.classify(Ontology(support))
        pair = spark.createDataFrame([(sub, sup)], "sub string, super string")
        assert not again.is_subsumed(pair).isEmpty()


def test_el_queries(spark):
    o = onto(
        spark, "SubClassOf(:A :B)", *["SubClassOf(:B :C)"], "SubClassOf(:A :C)", "EquivalentClasses(:B :B2)", "SubClassOf(:X ObjectIntersectionOf(:P :Q))", "DisjointClasses(:P :Q)", "SubClassOf(:Y ObjectSomeValuesFrom(:r :X))",
        "SubClassOf(:A " + "ObjectUnionOf(:B :C))", "ObjectPropertyRange(:r :A)", "FunctionalDataProperty(:d)", "Declaration(Class(:Lone))", 'AnnotationAssertion(rdfs:label :A "a")', "SubClassOf(:A ObjectUnionOf(:C :B))",
    )
    c = el.classify(o, explanations=True)
    assert sorted(short(r[0]) for r in c.unsatisfiable().collect()) == ["X", "Y"] and not c.coherent() and c.consistent()
    direct = {(short(r["sub"]), short(r["super"])) for r in c.direct_supers().collect()}
    assert direct == {("A", "B"), ("A", "B2"), ("B", "C"), ("B2", "C"), ("C", t.THING), ("P", t.THING), ("Q", t.THING), ("Lone", t.THING)}
    assert {(short(r["a"]), short(r["b"])) for r in c.equivalents().collect()} == {("B", "B2"), ("B2", "B")}
    assert sorted(r["idx"] for r in c.unsupported().collect()) == [7, 8, 9]
    assert sorted(r["idx"] for r in c.explain("urn:t:Y", t.NOTHING).collect()) == [4, 5, 6]
    assert c.explain("urn:t:C", "urn:t:A").isEmpty() and c.explain("urn:t:A", "urn:t:A").isEmpty()
    asked = spark.createDataFrame([("urn:t:A", "urn:t:C"), ("urn:t:X", "urn:t:A"), ("urn:t:new", t.THING), ("urn:t:new", "urn:t:A"), ("urn:t:new", "urn:t:new"), ("urn:t:C", "urn:t:A")], "sub string, super string")
    assert sorted((short(r["sub"]), short(r["super"])) for r in c.is_subsumed(asked).collect()) == [("A", "C"), ("X", "A"), ("new", t.THING), ("new", "new")]
    texts = [r["text"] for r in c.inferred().collect()]
    assert "EquivalentClasses(<urn:t:B> <urn:t:B2>)" in texts and f"SubClassOf(<urn:t:X> <{t.NOTHING}>)" in texts
    with pytest.raises(ValueError):
        el.classify(o).explain("a", "b")
    q = spark.createDataFrame([("urn:t:C",)], "q string")
    assert sorted(short(r["member"]) for r in conform.answers(o, q).collect()) == ["A", "B", "B2"]
    assert el.classify(onto(spark)).subsumptions().isEmpty()


# == closed world


def naive_members(e, inds, members, rel):
    if e.op == "Class":
        return set(inds) if e.iri == t.THING else set() if e.iri == t.NOTHING else {i for c, i in members if c == e.iri}
    sub = lambda x: naive_members(x, inds, members, rel)
    if e.op == "ObjectIntersectionOf":
        return set.intersection(*map(sub, e.args))
    if e.op == "ObjectUnionOf":
        return set.union(*map(sub, e.args))
    if e.op == "ObjectComplementOf":
        return set(inds) - sub(e.args[0])
    if e.op == "ObjectOneOf":
        return {a.iri for a in e.args}
    p = e.args[0]
    edges = {(b, a) for q, a, b in rel if q == p.args[0].iri} if p.op == "ObjectInverseOf" else {(a, b) for q, a, b in rel if q == p.iri}
    if e.op == "ObjectHasValue":
        return {a for a, b in edges if b == e.args[1].iri}
    f = sub(e.args[1])
    if e.op == "ObjectSomeValuesFrom":
        return {a for a, b in edges if b in f}
    return {i for i in inds if all(b in f for a, b in edges if a == i)}


def random_check(draw, depth=2):
    k = draw.randrange(8) if depth else 0
    c = t.cls(f"urn:t:{draw.choice('ABC')}")
    p = t.obj(f"urn:t:{draw.choice('pqr')}")
    p = t.inverse(p) if draw.random() < 0.3 else p
    deeper = lambda: random_check(draw, depth - 1)
    i = t.ind(f"urn:t:i{draw.randrange(6)}")
    return [lambda: c, lambda: t.conj(c, deeper()), lambda: t.disj(deeper(), deeper()), lambda: t.neg(deeper()), lambda: t.one_of(i), lambda: t.some(p, deeper()), lambda: t.only(p, deeper()), lambda: t.has(p, i)][k]()


def test_icv_equals_set_semantics(spark):
    draw = random.Random(22)
    hits = 0
    for _ in range(3):
        ids = [f"urn:t:i{i}" for i in range(6)]
        members = {(f"urn:t:{c}", i) for c in "ABC" for i in ids if draw.random() < 0.35}
        rel = {(f"urn:t:{p}", a, b) for p in "pq" for a in ids for b in ids if a != b and draw.random() < 0.15}
        checks = []
        while len(checks) < 5:
            a, b = random_check(draw, 1), random_check(draw)
            if icv._anchored(a):
                checks.append(t.make("SubClassOf", a, b))
        data = Ontology.of(spark, [t.make("ClassAssertion", t.cls(c), t.ind(i)) for c, i in sorted(members)] + [t.make("ObjectPropertyAssertion", t.obj(p), t.ind(a), t.ind(b)) for p, a, b in sorted(rel)])
        rules = [t.make("SubObjectPropertyOf", t.obj("urn:t:p"), t.obj("urn:t:r")), t.make("TransitiveObjectProperty", t.obj("urn:t:r"))]
        report = icv.validate(data, Ontology.of(spark, [*checks, *rules], prefixes=names.prefixes(t="urn:t:")))
        closed = {(a, b) for p, a, b in rel if p == "urn:t:p"}
        while True:
            more = {(a, d) for a, b in closed for c, d in closed if b == c} - closed
            if not more:
                break
            closed |= more
        world = rel | {("urn:t:r", a, b) for a, b in closed}
        inds = {i for _, i in members} | {x for _, a, b in rel for x in (a, b)} | {n[7] for c in checks for n in t.nodes(c) if n[6] == t.INDIVIDUAL}
        text = dict(report.checks)
        expected = set()
        for c in checks:
            expected |= {(t.render(c), x) for x in naive_members(c.args[0], inds, members, world) - naive_members(c.args[1], inds, members, world)}
        rows = report.violations.collect()
        assert {(text[r["check_idx"]], r["subject"]) for r in rows} == expected and not report.refused
        for r in rows:
            for a, b in zip(r["path"], r["path"][1:]):
                assert a["o"] == b["s"]
            assert all((f["p"], f["s"], f["o"]) in rel for f in r["path"]) and r["reason"]
        hits += len(expected)
    assert hits > 3


def test_icv_paths_refusals_and_empty_terms(spark):
    data = onto(spark, *[f"ObjectPropertyAssertion(:imports :{a} :{b})" for a, b in ("ab", "bc", "cd", "ad")], "ClassAssertion(:Core :a)", "ClassAssertion(:Core :b)", "ClassAssertion(:Bad :d)", "Declaration(Class(:Nobody))")
    rules = onto(
        spark, "SubObjectPropertyOf(:imports :dependsOn)", "TransitiveObjectProperty(:dependsOn)", "SubClassOf(:Core ObjectAllValuesFrom(:dependsOn ObjectComplementOf(:Bad)))", "NegativeObjectPropertyAssertion(:dependsOn :b :d)",
        "TransitiveObjectProperty(:imports)", "EquivalentClasses(:Core :Bad)", "SubClassOf(owl:Thing :Core)", "ClassAssertion(:Core :z)", "SubClassOf(:Core ObjectHasSelf(:imports))", "SubClassOf(:Typo :Core)", "SubClassOf(:Nobody :Core)",
        "DisjointClasses(ObjectSomeValuesFrom(:imports :Bad) :Core)", "SubClassOf(ObjectOneOf(:d) :Core)",
    )
    r = icv.validate(data, rules)
    text = dict(r.checks)
    got = {(text[v["check_idx"]].split("(")[0], short(v["subject"])): v for v in r.violations.collect()}
    assert [short(f["o"]) for f in got["SubClassOf", "a"]["path"]] == ["d"]
    assert [short(f["o"]) for f in got["NegativeObjectPropertyAssertion", "b"]["path"]] == ["c", "d"] and "by t:b" in got["NegativeObjectPropertyAssertion", "b"]["reason"]
    assert got["DisjointClasses", "a"]["path"] and ("SubClassOf", "d") in got and len(got) == 5
    assert len(r.refused) == 5 and r.empty == [(0, "urn:t:Typo")]


# == RDF

TTL = ns("""@prefix : <urn:t:> . @prefix owl: <@OWL@> . PREFIX rdfs: <@RDFS@>
@prefix xsd: <@XSD@> . @base <http://b/x/> .
<urn:t> a owl:Ontology ; owl:imports <urn:y> ; owl:versionIRI <urn:v> ; rdfs:label "o"@en .
:A a owl:Class ; rdfs:subClassOf [ owl:onProperty [ owl:inverseOf :r ] ; owl:someValuesFrom [ owl:intersectionOf ( :B [ a owl:Class ; owl:complementOf :C ] ) ] ] , :D ;
 owl:disjointWith [ owl:onProperty :age ; owl:maxCardinality 1 ] .
:r a owl:ObjectProperty , owl:TransitiveProperty ; rdfs:domain :A ; owl:inverseOf :s . :age a owl:DatatypeProperty ;
 rdfs:range [ a rdfs:Datatype ; owl:onDatatype xsd:integer ; owl:withRestrictions ( [ xsd:minInclusive 0 ] ) ] ; a owl:TransitiveProperty .
:i a :A ; rdfs:comment '''x "q" \\u00e9''' , true , 1.5 , 2e3 ; owl:sameAs <rel> . :B rdfs:subClassOf "lit" . _:n :p :q ; .
""")


def test_turtle_terms_and_errors():
    triples, prefixes = rdf.turtle(TTL)
    objects = [o for _, _, o in triples]
    assert rdf.iri("http://b/x/rel") in objects and ("literal", 'x "q" é', f"{t.XSD}string", None) in objects
    assert {o[2].removeprefix(t.XSD) for o in objects if o[0] == "literal" and o[2].startswith(t.XSD)} >= {"boolean", "decimal", "double", "integer"}
    assert prefixes[""] == "urn:t:"
    for bad, where in ((":a :b :c .", "1:1"), ("<a> <b> 'x", "1:"), ("@prefix : <u:> .\n:a :b ( :c .", "2:"), ("<a> <b> <c>", "expected"), ('"x" <b> <c> .', "subject")):
        with pytest.raises(rdf.RdfError, match=where):
            rdf.turtle(bad)


def test_xml_equals_turtle(spark):
    xml = ns("""<rdf:RDF xmlns:rdf="@RDF@" xmlns:owl="@OWL@" xmlns:rdfs="@RDFS@" xmlns:e="http://e/" xml:base="http://b/o">
    <owl:Class rdf:about="#A" rdfs:label="lab"><owl:unionOf rdf:parseType="Collection"><rdf:Description rdf:about="#B"/></owl:unionOf><e:n rdf:datatype="@XSD@int">5</e:n>
    <e:r rdf:parseType="Resource"><e:x xml:lang="de">ü</e:x></e:r><rdf:li>one</rdf:li><e:k rdf:nodeID="z"/></owl:Class></rdf:RDF>""")
    ttl = ns("""@prefix e: <http://e/> . @prefix owl: <@OWL@> . @prefix rdfs: <@RDFS@> . @prefix rdf: <@RDF@> .
    <http://b/o#A> a owl:Class ; rdfs:label "lab" ; owl:unionOf ( <http://b/o#B> ) ; e:n "5"^^<@XSD@int> ; e:r [ e:x "ü"@de ] ; rdf:_1 "one" ; e:k _:z .""")
    flat = lambda ts: sorted((s[0] if s[0] == "blank" else s[1], p, o[0] if o[0] == "blank" else o) for s, p, o in ts if True).__str__()
    assert flat(rdf.rdf_xml(xml)[0]) == flat(rdf.turtle(ttl)[0])
    with pytest.raises(rdf.RdfError):
        rdf.rdf_xml("<a>")
    with pytest.raises(rdf.RdfError, match="Literal"):
        rdf.rdf_xml(ns('<rdf:RDF xmlns:rdf="@RDF@" xmlns:e="http://e/"><rdf:Description rdf:about="a"><e:x rdf:parseType="Literal"><b/></e:x></rdf:Description></rdf:RDF>'))


def test_rdf_to_axioms(spark):
    triples = rdf.parse_column(spark.createDataFrame([("d", TTL)], "k string, v string"), "k", "v")
    o, skipped = rdfmap.convert(triples, ("urn:t:",))
    texts = [r["text"].replace("urn:t:", "").replace(t.XSD, "xsd:") for r in o.axioms.orderBy("idx").collect()]
    assert texts == sorted(texts) and (o.iri, o.version, o.imports) == ("urn:t", "urn:v", ("urn:y",)) and len(o.notes) == 1
    for expected in (
        "SubClassOf(<A> ObjectSomeValuesFrom(ObjectInverseOf(<r>) ObjectIntersectionOf(<B> ObjectComplementOf(<C>))))", "DisjointClasses(<A> DataMaxCardinality(1 <age>))", "TransitiveObjectProperty(<r>)", "InverseObjectProperties(<r> <s>)",
        'DataPropertyRange(<age> DatatypeRestriction(<xsd:integer> <xsd:minInclusive> "0"^^<xsd:integer>))', "ClassAssertion(<A> <i>)", "Declaration(DataProperty(<age>))", "Declaration(Class(<C>))", "SameIndividual(<i> <http://b/x/rel>)",
    ):
        assert expected in texts
    reasons = {r["reason"]: r["n"] for r in skip_summary(skipped).collect()}
    assert reasons["superclass not readable"] == 1 and reasons["characteristic of a data property"] == 1 and reasons["anonymous individual"] >= 1
    items = {r["head"]: [i["text"] for i in r["items"]] for r in rdf.lists(triples).collect()}
    assert len(items) == 2 and ["urn:t:B"] in [x[:1] for x in items.values()]
    assert rdf.objects(triples).count() <= triples.count() and rdf.subjects(triples).filter("not is_blank").count() == 6
    assert rdf.ntriples(triples).filter("line like '%\"o\"@en .'").count() == 1


def test_broken_lists_give_none(spark):
    ttl = ns("@prefix r: <@RDF@> . _:a r:first 1 ; r:rest _:b . _:b r:first 2 ; r:rest _:a . _:c r:first 1 ; r:rest _:d . _:d r:rest r:nil . _:e r:first 9 ; r:rest r:nil .")
    triples = rdf.parse_column(spark.createDataFrame([("d", ttl)], "k string, v string"), "k", "v")
    assert [[i["text"] for i in r["items"]] for r in rdf.lists(triples).collect()] == [["9"]]


# == descriptions


def shop(spark, *more):
    base = ["Declaration(Class(:store.Item))", "Declaration(Class(:store.Stock))"]
    for f, owner, held in (("Name", "Item", "xsd:string"), ("What", "Stock", ":store.Item"), ("Count", "Stock", "xsd:integer")):
        kind = "Data" if held.startswith("xsd") else "Object"
        base += [f"Declaration({kind}Property(:store.{owner}.{f}))", f"{kind}PropertyDomain(:store.{owner}.{f} :store.{owner})", f"{kind}PropertyRange(:store.{owner}.{f} {held})"]
    base += ["ClassAssertion(:Package :package.store)", "ClassAssertion(:ExternalPackage :package.fmt)", "ObjectPropertyAssertion(:imports :package.store :package.fmt)"]
    return onto(spark, *base, *more, iri="urn:m")


def typed(owner, *fields):
    out = [f"Declaration(Class(:{owner}))"]
    for f, held in fields:
        kind = "Data" if held.startswith("xsd") else "Object"
        out += [f"Declaration({kind}Property(:{owner}.{f}))", f"{kind}PropertyDomain(:{owner}.{f} :{owner})", f"{kind}PropertyRange(:{owner}.{f} {held})"]
    return out


def found_of(df):
    return sorted((r["rule"], r["subject"].removeprefix("urn:m#")) for r in df.collect())


def test_shapes_and_comparison(spark):
    before = shop(spark)
    after = shop(spark, *typed("store.Holding", ("What", ":store.Item"), ("Count", "xsd:integer")), *typed("store.Alone", ("X", "xsd:int")))
    assert found_of(shapes.compare(before, after)) == [("new-orphan", "store.Alone"), ("same-shape", "store.Holding")]
    assert shapes.compare(before, before).isEmpty()
    plan = onto(spark, *typed("store.Holding", ("What", ":store.Item"), ("Count", "xsd:integer")), "SubClassOf(:store.Holding :store.Typo)", iri="urn:m")
    assert found_of(conform.review_plan(plan, before)) == [("same-shape", "store.Holding"), ("undeclared-entity", "store.Typo")]


def test_conform_rules(spark):
    before = shop(spark, "Declaration(Class(:store.Priced))", 'AnnotationAssertion(:method :store.Priced "Price(store.Item) int")')
    plan = onto(
        spark, *typed("store.Gone", ("F", "xsd:int")), "Declaration(DataProperty(:store.Item.Size))", "DataPropertyDomain(:store.Item.Size :store.Item)", "Declaration(DataProperty(:store.Item.Name))", "DataPropertyRange(:store.Item.Name xsd:int)",
        "SubClassOf(:store.Item :store.Stock)", "ClassAssertion(:Package :package.api)", "ObjectPropertyAssertion(:imports :package.store :package.os)", 'AnnotationAssertion(:method :store.Priced "Price(of Item) (cents string)")',
        'AnnotationAssertion(:method :store.Priced "Weigh()")', 'AnnotationAssertion(:method :store.Priced "not a method")', "Declaration(Class(:store.Made))", iri="urn:m",
    )
    after = shop(
        spark, "Declaration(Class(:store.Priced))", 'AnnotationAssertion(:method :store.Priced "Price(store.Item) int")', 'AnnotationAssertion(:method :store.Priced "Extra()")', *typed("store.Made"), *typed("store.New", ("Q", "xsd:int")),
        "Declaration(DataProperty(:store.Item.More))", "DataPropertyDomain(:store.Item.More :store.Item)", "DataPropertyRange(:store.Item.More xsd:int)", "ClassAssertion(:Package :package.extra)", "ClassAssertion(:Package :package.two)",
        "ObjectPropertyAssertion(:imports :package.store :package.extra)",
    )
    got = found_of(conform.conform(plan, before, after))
    assert got == sorted([
        ("missing-type", "store.Gone"), ("missing-field", "store.Item.Size"), ("field-mismatch", "store.Item.Name"), ("missing-interface", "store.Item"), ("missing-package", "package.api"), ("missing-import", "package.store"),
        ("method-mismatch", "store.Priced"), ("missing-method", "store.Priced"), ("malformed-method", "store.Priced"), ("unplanned-type", "store.New"), ("unplanned-field", "store.Item.More"), ("unplanned-method", "store.Priced"),
        ("unplanned-package", "package.extra"), ("unplanned-package", "package.two"), ("unplanned-import", "package.store"),
    ])
    assert conform.conform(onto(spark, iri="urn:m"), before, before).isEmpty()
    other = onto(spark, "Declaration(Class(<urn:else>))", iri="urn:m")
    assert [r[0] for r in conform.unchecked(other, before).collect()] == ["urn:else"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("Price(of Item) (cents int, err error)", "Price(store.Item) (int, error)"), ("F(a, b int, c  *Other)", "F(int, int, *store.Other)"), ("G()", "G()"), ("H(map[string]Item, ...byte) []Item", "H(map[string]store.Item, ...byte) []store.Item"), ("K(f func(x int) error)", "K(func(x int) error)"), ("L(time.Time)", "L(time.Time)")],
)
def test_signatures(text, expected):
    assert conform.normal_signature(text, "store") == expected


@pytest.mark.parametrize("text", ["", "Name", "F(", "F(a, b", "F() int, error", "1F()"])
def test_no_signatures(text):
    with pytest.raises(ValueError):
        conform.normal_signature(text)


def test_invariants(spark):
    module = shop(spark, "ClassAssertion(:Package :package.api)", "ObjectPropertyAssertion(:imports :package.api :package.store)", "Declaration(Class(:store.Priced))", 'AnnotationAssertion(:method :store.Priced "Price() int")')
    inv = onto(
        spark, "ClassAssertion(:Core :package.api)", "SubObjectPropertyOf(:imports :dependsOn)", "TransitiveObjectProperty(:dependsOn)", 'SubClassOf(Annotation(rdfs:comment "core stays pure.") :Core ObjectComplementOf(ObjectHasValue(:dependsOn :package.fmt)))',
        "ClassAssertion(:Package :package.zzz)", "ObjectPropertyAssertion(:imports :package.api :package.fmt)", "NegativeObjectPropertyAssertion(:imports :package.store :package.nope)", "SubClassOf(:Ghost :Core)",
        'AnnotationAssertion(:method :store.Priced "Other()")', iri="urn:m",
    )
    rows = conform.check_invariants(inv, module).collect()
    by = sorted((r["rule"], r["subject"].removeprefix("urn:m#")) for r in rows)
    assert by == sorted([
        ("invariant-violated", "package.api"), ("unsupported-invariant", ""), ("unsupported-invariant", ""), ("unknown-package", "package.nope"), ("unknown-package", "package.zzz"), ("empty-term", "Ghost"), ("missing-method", "store.Priced"), ("unplanned-method", "store.Priced"),
    ])
    assert any(r["message"].startswith("core stays pure: ") for r in rows)
    known = spark.createDataFrame([("urn:m#package.nope",), ("urn:m#package.zzz",)], "iri string")
    assert "unknown-package" not in {r["rule"] for r in conform.check_invariants(inv, module, known).collect()}
    plan = onto(spark, "ObjectPropertyAssertion(:imports :package.store :package.nope)", iri="urn:m")
    assert ("invariant-violated", "package.store") in found_of(conform.review_invariants(inv, plan, module))


def test_describe_schemas(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("at", T.StructType([T.StructField("x", T.DoubleType())]))])
    o = shapes.describe(spark, {"events": schema}, "urn:m#", {"events": "what happened"})
    fields = {(short(r["owner"]).removeprefix("urn:m#"), r["field"].removeprefix("urn:m#"), r["is_object"]) for r in shapes.fields(o).collect()}
    assert fields == {("events", "events.id", False), ("events", "events.tags", False), ("events", "events.at", True), ("events.at", "events.at.x", False)}
    assert {r["shape"] for r in shapes.shapes(shapes.fields(o)).collect()} == {"urn:m#events.at x1, urn:m#events.id x1, urn:m#events.tags x1", "urn:m#events.at.x x1"}


# == reports, commands, streams


def test_reports_and_commands(spark, tmp_path, capsys):
    import json

    from axiomata.__main__ import run

    a, b = tmp_path / "a.ofn", tmp_path / "b.ofn"
    a.write_text(HEAD + "SubClassOf(:A :B)\nSubClassOf(:B :A)\nDeclaration(Class(:A))\n)")
    b.write_text(HEAD + "SubClassOf(:A :B)\nSubClassOf(:A ObjectUnionOf(:B :C))\n)")

    def told(*argv):
        capsys.readouterr()
        status = run(spark, list(argv))
        return status, capsys.readouterr().out

    status, out = told("lint", str(a), "--json")
    doc = json.loads(out)
    assert status == 1 and doc["summary"]["error"] == 1 and {f["rule"] for f in doc["findings"]} >= {"subclass-cycle", "undeclared-entity"}
    assert told("lint", str(a), "--disable", "subclass-cycle")[0] == 0 and told("lint", str(a), "--disable", "nope")[0] == 2
    status, out = told("diff", str(a), str(b), "--exit-code", "--json")
    doc = json.loads(out)
    assert status == 1 and (doc["added"], doc["removed"]) == (1, 2) and len(doc["axioms"]) == 3
    assert told("diff", str(a), str(a), "--summary") == (0, "no difference\n")
    assert json.loads(told("profile", str(b), "--json")[1])["profiles"][0]["ok"] is False and told("profile", str(b), "--verbose")[1].startswith("EL:no QL:no RL:no DL:yes")
    doc = json.loads(told("stats", str(a))[1])
    assert doc["axioms"][0] == {"kind": "SubClassOf", "n": 2} and doc["counts"]["Class"] == 2
    doc = json.loads(told("classify", str(b), "--json", "--axioms")[1])
    assert doc["consistent"] and len(doc["unsupported"]) == 1 and "SubClassOf(<urn:t:A> <urn:t:B>)" in doc["axioms"]
    assert json.loads(told("classify", str(a), "--explain", "urn:t:A", "urn:t:B")[1])["axioms"] == ["SubClassOf(<urn:t:A> <urn:t:B>)"]
    assert told("classify", str(a))[1].startswith("EquivalentClasses(")
    assert ofn.parse(told("fmt", str(a), "--canonical")[1]).iri == "urn:t" and len(json.loads(told("rules", "--json")[1])["rules"]) == 8
    (tmp_path / "x.ttl").write_text("<urn:a> <urn:b> 'c' .")
    assert told("triples", str(tmp_path / "x.ttl"))[1] == '<urn:a> <urn:b> "c" .\n'
    (tmp_path / "bad.ofn").write_text("Ontology(")
    with pytest.raises(SystemExit, match="line 1"):
        run(spark, ["stats", str(tmp_path / "bad.ofn")])
    o = onto(spark, "SubClassOf(:A :B)")
    assert json.loads(reports.findings_report(o, lint.run(o), base="main").first()["report"])["base"] == "main"


def test_stream_of_documents(spark, tmp_path):
    from axiomata.streaming import feed

    docs = tmp_path / "in"
    docs.mkdir()
    (docs / "1.ofn").write_text(HEAD + "SubClassOf(:A :B)\n)")
    (docs / "2.ofn").write_text("broken(")
    seen = []
    go = lambda: feed.append(spark, str(docs), str(tmp_path / "t"), str(tmp_path / "c"), lambda o, n: seen.append(asserted.ancestors(o).count())).awaitTermination()
    go()
    (docs / "3.ofn").write_text(HEAD + "SubClassOf(:B :C)\n)")
    go()
    assert seen == [1, 3]


def test_ontology_building(spark):
    o = onto(spark, "SubClassOf(:B :A)", "SubClassOf(:A :C)").declare(t.cls("urn:t:A"), t.ind("urn:t:i"))
    assert o.count() == 4 and {r["kind"] for r in o.declared().collect()} == {0, 5} and o.prefix("q:", "urn:q").prefixes["q"] == "urn:q"
    assert [r["idx"] for r in o.axioms.orderBy("idx").collect()] == [0, 1, 2, 3]
    assert o.sort().axioms.filter("idx = 3").first()["text"] == "SubClassOf(<urn:t:B> <urn:t:A>)"
    assert o.walk().filter(F.col("role") == "sub").count() == 2
    assert onto(spark).sort().count() == 0 and onto(spark).signature().isEmpty()
