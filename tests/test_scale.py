"""What queries write, carry and repeat, on small inputs that stand for large ones."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from axiomata.functions import terms as t
from axiomata.model import Ontology, ranked
from axiomata.operators import asserted, diff, el, icv, lint
from axiomata.plans import fixpoint


@pytest.fixture
def written(monkeypatch):
    """Rows of every table that fixpoints write."""
    sizes, keep = [], fixpoint.checkpointed

    def counted(df):
        out = keep(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(fixpoint, "checkpointed", counted)
    monkeypatch.setattr(lint, "checkpointed", counted, raising=False)
    return sizes


def below(spark, pairs) -> Ontology:
    return Ontology.of(spark, [t.make("SubClassOf", t.cls(f"urn:t:{a}"), t.cls(f"urn:t:{b}")) for a, b in pairs])


RING = [(f"r{i:02}", f"r{(i + 1) % 40:02}") for i in range(40)]


def test_ring_closure_is_not_written(spark, written):
    got = {(r["cls"], r["ancestor"]) for r in asserted.ancestors(below(spark, RING + [("r03", "top"), ("low", "r20")])).collect()}
    ring = {f"urn:t:r{i:02}" for i in range(40)}
    expected = {(a, b) for a in ring for b in ring if a != b} | {(a, "urn:t:top") for a in ring | {"urn:t:low"}} | {("urn:t:low", b) for b in ring}
    assert got == expected
    assert max(written) <= 3 * 42  # the pairs are 1682


@pytest.mark.parametrize("local", [0, 100_000])
def test_components_by_rounds_and_on_the_driver(spark, monkeypatch, local):
    monkeypatch.setattr(fixpoint, "LOCAL", local)
    dense = [(a, b) for a in "abcd" for b in "abcd" if a != b]
    edges = [("x", "y"), ("y", "z"), ("z", "x"), ("z", "a"), ("d", "end"), ("p", "q"), ("q", "p"), *dense]
    got = fixpoint.strong_components(spark.createDataFrame(edges, "src string, dst string")).collect()
    groups: dict = {}
    for r in got:
        groups.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == [["a", "b", "c", "d"], ["p", "q"], ["x", "y", "z"]]

def test_cycle_findings_without_pairs(spark, written):
    found = lint.subclass_cycle(below(spark, RING)).collect()
    assert [r["subject"] for r in found] == ["urn:t:r00"]
    assert found[0]["message"].count(" -> ") == 40 and written and max(written) <= 2 * 40  # the pairs are 1560


def test_ranks_fit_one_sort(spark):
    n = 150_000
    got = ranked(spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("text"), F.col("id").alias("idx")).repartition(16), "text", "idx").select("text", "idx").collect()
    assert [r["text"] for r in sorted(got, key=lambda r: r["idx"])] == sorted(r["text"] for r in got)
    assert sorted(r["idx"] for r in got) == list(range(n))


def test_merge_carries_only_what_is_read(spark):
    o = below(spark, [("a", "b"), ("a", "b"), ("b", "c")])
    texts = diff.merge("urn:t:all", o, o).axioms.select("text")
    assert "nodes" not in texts._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[1].split("\n")[0]
    assert sorted(r["text"] for r in texts.collect()) == ["SubClassOf(<urn:t:a> <urn:t:b>)", "SubClassOf(<urn:t:b> <urn:t:c>)"]


def chain_facts(spark, n: int) -> Ontology:
    return Ontology.of(spark, [t.make("ObjectPropertyAssertion", t.obj("urn:t:half"), t.ind(f"urn:t:{i}"), t.ind(f"urn:t:{i - 1}")) for i in range(1, n)])


def test_chains_are_derived_only_to_what_is_asked(spark, monkeypatch):
    sizes, keep = [], icv.checkpointed

    def counted(df):
        out = keep(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(icv, "checkpointed", counted)
    end = t.has(t.obj("urn:t:reaches"), t.ind("urn:t:0"))
    rules = [t.make("SubObjectPropertyOf", t.obj("urn:t:half"), t.obj("urn:t:reaches")), t.make("TransitiveObjectProperty", t.obj("urn:t:reaches")), t.make("SubClassOf", end, t.neg(end))]
    found = icv.validate(chain_facts(spark, 41), Ontology.of(spark, rules)).violations.collect()
    assert {r["subject"]: [f["o"] for f in r["path"]] for r in found} == {f"urn:t:{i}": [f"urn:t:{k}" for k in range(i - 1, -1, -1)] for i in range(1, 41)}
    assert max(sizes) <= 40 and sum(sizes) <= 40 * 10  # all pairs are 820


def test_stated_rings_take_no_rounds(spark):
    n = 60
    o = below(spark, [(f"r{i:02}", f"r{(i + 1) % n:02}") for i in range(n)] + [("low", "r07"), ("r09", "top")])
    c = el.classify(o, max_rounds=5)  # a ring took one round for each class
    ring = {f"urn:t:r{i:02}" for i in range(n)}
    assert {(r["a"], r["b"]) for r in c.equivalents().collect()} == {(a, b) for a in ring for b in ring if a != b}
    above = {(r["sub"], r["super"]) for r in c.subsumptions().collect()}
    assert above == {(a, b) for a in ring | {"urn:t:low"} for b in ring if a != b} | {(a, "urn:t:top") for a in ring | {"urn:t:low"}}


def test_unsupported_axioms_need_no_saturation(spark):
    union = t.make("SubClassOf", t.cls("urn:t:a"), t.disj(t.cls("urn:t:b"), t.cls("urn:t:c")))
    deep = [t.make("SubClassOf", t.cls(f"urn:t:{i}"), t.cls(f"urn:t:{i + 1}")) for i in range(5)]
    c = el.classify(Ontology.of(spark, [union, *deep]), max_rounds=1)
    assert [r["kind"] for r in c.unsupported().select("kind").collect()] == ["SubClassOf"]
