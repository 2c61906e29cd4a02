"""Closed-world checks of facts against constraints, with the facts to blame.

Facts are a distributed ontology; constraints are a few axioms that the driver
reads and turns into plans: every class expression becomes a table of its
members (semi and anti joins), derivation rules run as a fixpoint that keeps
for each derived fact its shortest proof.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axiomata.functions import names
from axiomata.functions import terms as t
from axiomata.functions.terms import Term
from axiomata.model import Ontology
from axiomata.operators.asserted import child
from axiomata.plans.fixpoint import checkpointed, loop_settings

PATH = "array<struct<p:string,s:string,o:string>>"
VIOLATION = "check_idx int, subject string, path array<struct<p:string,s:string,o:string>>, reason string"


@dataclass(frozen=True)
class Report:
    """``checks``: (check_idx, axiom text) of what was evaluated; ``refused``: (axiom text, reason); ``empty``: terms nothing defines."""

    checks: list[tuple[int, str]]
    violations: DataFrame
    refused: list[tuple[str, str]]
    empty: list[tuple[int, str]]


def _unwritten(x: Term) -> str | None:
    """Why an expression cannot be checked; None where it can."""
    if x.op == "Class":
        return None
    if x.op in ("ObjectIntersectionOf", "ObjectUnionOf"):
        return next((why for a in x.args if (why := _unwritten(a))), None)
    if x.op == "ObjectComplementOf":
        return _unwritten(x.args[0])
    if x.op == "ObjectOneOf":
        return None if all(a.op == "NamedIndividual" for a in x.args) else "an enumeration needs named individuals"
    if x.op in ("ObjectSomeValuesFrom", "ObjectAllValuesFrom"):
        return _unwritten(x.args[1])
    if x.op == "ObjectHasValue":
        return None if x.args[1].op == "NamedIndividual" else "a value needs a name"
    return f"{x.op} is not checked"


def _anchored(x: Term) -> bool:
    """Do the facts alone bound the members, whatever else has a name?"""
    if x.op == "Class":
        return x.iri != t.THING
    if x.op == "ObjectIntersectionOf":
        return any(map(_anchored, x.args))
    if x.op == "ObjectUnionOf":
        return bool(x.args) and all(map(_anchored, x.args))
    return x.op in ("ObjectOneOf", "ObjectHasValue", "ObjectSomeValuesFrom")


class Model:
    """Members, derived facts with proofs, and all individuals, as DataFrames."""

    def __init__(self, members: DataFrame, facts: DataFrame, individuals: DataFrame, table: dict[str, str]):
        self.members, self.facts, self.individuals, self.table = members, facts, individuals, table

    def edges(self, p: Term) -> DataFrame:
        """(x, y, proof) of a property; swapped for an inverse, whose proofs keep their direction."""
        rows = self.facts.filter(F.col("p") == (p.args[0].iri if p.op == "ObjectInverseOf" else p.iri))
        a, b = ("o", "s") if p.op == "ObjectInverseOf" else ("s", "o")
        return rows.select(F.col(a).alias("x"), F.col(b).alias("y"), "proof")

    def extension(self, e: Term) -> DataFrame:
        """(x): the members of an expression over the closed domain."""
        if e.op == "Class":
            if e.iri == t.THING:
                return self.individuals
            return self.members.filter(F.lit(e.iri != t.NOTHING) & (F.col("class") == e.iri)).select(F.col("ind").alias("x")).distinct()
        if e.op == "ObjectIntersectionOf":
            parts = sorted(e.args, key=lambda a: not _anchored(a))  # bounded ones first
            return reduce(lambda a, b: a.join(b, "x", "left_semi"), map(self.extension, parts)) if parts else self.individuals
        if e.op == "ObjectUnionOf":
            return reduce(DataFrame.unionByName, map(self.extension, e.args)).distinct() if e.args else self.individuals.limit(0)
        if e.op == "ObjectComplementOf":
            return self.individuals.join(self.extension(e.args[0]), "x", "left_anti")
        if e.op == "ObjectOneOf":
            own = self.individuals.sparkSession.createDataFrame([(a.iri,) for a in e.args], "x string").distinct()
            return self.individuals.join(own, "x", "left_semi")
        if e.op == "ObjectSomeValuesFrom":
            return self._related(e, "left_semi").select("x").distinct()
        if e.op == "ObjectAllValuesFrom":
            return self.individuals.join(self._related(e, "left_anti").select("x"), "x", "left_anti")
        if e.op == "ObjectHasValue":
            return self.edges(e.args[0]).filter(F.col("y") == e.args[1].iri).select("x").distinct()
        raise ValueError(f"{e.op} is not checked")

    def _related(self, e: Term, how: str) -> DataFrame:
        if e.args[1].op == "Class" and e.args[1].iri == t.THING:  # whatever a fact names is in the domain
            return self.edges(e.args[0]).filter(F.lit(how == "left_semi"))
        return self.edges(e.args[0]).join(self.extension(e.args[1]).select(F.col("x").alias("y")), "y", how)

    def show(self, c: Column) -> Column:
        return names.written(c, self.table)

    def said(self, x: Term) -> str:
        """An expression of the constraints as text with prefixes."""
        return t.render(x, lambda iri: _short(iri, self.table))

    # reasons: every function takes (x) rows and returns (x, why, path) for each

    def _plain(self, xs: DataFrame, text: Column) -> DataFrame:
        return xs.select("x", text.alias("why"), F.array().cast(PATH).alias("path"))

    def _witness(self, xs: DataFrame, e: Term, inside: bool) -> DataFrame:
        """The related individual with the shortest proof, ties by name."""
        rows = self._related(e, "left_semi" if inside else "left_anti").join(xs, "x", "left_semi")
        best = rows.groupBy("x").agg(F.min_by(F.struct("y", "proof"), F.struct(F.size("proof"), "y")).alias("w"))
        what = "is" if inside else "is not"
        why = F.concat(self.show(F.col("x")), F.lit(f" {self.said(e.args[0])} "), self.show(F.col("w.y")), F.lit(f", which {what} {self.said(e.args[1])}"), self._via(F.col("w.proof")))
        return best.select("x", why.alias("why"), F.col("w.proof").alias("path"))

    def _via(self, path: Column) -> Column:
        steps = F.array_join(F.transform(path, lambda f: F.concat(F.lit(" -"), self.show(f["p"]), F.lit("-> "), self.show(f["o"]))), "")
        return F.when(F.size(path) > 1, F.concat(F.lit(" (by "), self.show(F.get(path, F.lit(0))["s"]), steps, F.lit(")"))).otherwise(F.lit(""))

    def why_in(self, xs: DataFrame, e: Term) -> DataFrame:
        x = self.show(F.col("x"))
        if e.op == "ObjectSomeValuesFrom":
            return self._witness(xs, e, True)
        if e.op == "ObjectHasValue":
            rows = self.edges(e.args[0]).filter(F.col("y") == e.args[1].iri).join(xs, "x", "left_semi")
            return rows.select("x", F.concat(x, F.lit(f" {self.said(e.args[0])} {self.said(e.args[1])}"), self._via(F.col("proof"))).alias("why"), F.col("proof").alias("path"))
        if e.op == "ObjectComplementOf":
            return self.why_not(xs, e.args[0])
        if e.op in ("ObjectIntersectionOf", "ObjectUnionOf") and e.args:
            plain = self._plain(xs, F.concat(x, F.lit(f" is {self.said(e)}"))).withColumn("rank", F.lit(len(e.args)))
            parts = []
            for i, a in enumerate(e.args):  # the first operand that holds (or, of an intersection, that has a path)
                own = xs if e.op == "ObjectIntersectionOf" else xs.join(self.extension(a), "x", "left_semi")
                got = self.why_in(own, a).withColumn("rank", F.lit(i))
                parts.append(got.filter(F.size("path") > 0) if e.op == "ObjectIntersectionOf" else got)
            return _first([*parts, plain])
        return self._plain(xs, F.concat(x, F.lit(f" is {self.said(e)}")))

    def why_not(self, xs: DataFrame, e: Term) -> DataFrame:
        x = self.show(F.col("x"))
        if e.op == "ObjectAllValuesFrom":
            return self._witness(xs, e, False)
        if e.op == "ObjectComplementOf":
            return self.why_in(xs, e.args[0])
        if e.op == "ObjectIntersectionOf" and e.args:
            parts = [self.why_not(xs.join(self.extension(a), "x", "left_anti"), a).withColumn("rank", F.lit(i)) for i, a in enumerate(e.args)]
            return _first(parts)
        if e.op == "ObjectSomeValuesFrom":
            return self._plain(xs, F.concat(x, F.lit(f" has no {self.said(e.args[0])} that is {self.said(e.args[1])}")))
        if e.op == "ObjectHasValue":
            return self._plain(xs, F.concat(x, F.lit(f" lacks {self.said(e.args[0])} {self.said(e.args[1])}")))
        return self._plain(xs, F.concat(x, F.lit(f" is not {self.said(e)}")))

    def check(self, i: int, ax: Term) -> DataFrame:
        """Violations of one check, one for each individual."""
        if ax.op == "SubClassOf":
            sub, sup = ax.args
            if sup.op == "ObjectAllValuesFrom" and sub.op != "ObjectOneOf":
                bad = self.extension(sub)  # those with a witness, without need of the domain
            else:
                bad = self.extension(sub).join(self.extension(sup), "x", "left_anti")
            why = self.why_not(bad, sup)
            head = F.lit("") if sub.op == "ObjectOneOf" else F.concat(self.show(F.col("x")), F.lit(f" is {self.said(sub)}; "))
            return why.select(F.lit(i).alias("check_idx"), F.col("x").alias("subject"), F.col("path").cast(PATH).alias("path"), F.concat(head, F.col("why")).alias("reason"))
        if ax.op == "DisjointClasses":
            found, rank = [], 0
            for a in range(len(ax.args)):
                for b in range(a + 1, len(ax.args)):
                    both = self.extension(ax.args[a]).join(self.extension(ax.args[b]), "x", "left_semi")
                    l, r = self.why_in(both, ax.args[a]), self.why_in(both, ax.args[b])
                    j = l.join(r.select("x", F.col("why").alias("why2"), F.col("path").alias("path2")), "x")
                    path = F.when(F.size("path") > 0, F.col("path")).otherwise(F.col("path2"))
                    found.append(j.select("x", F.concat("why", F.lit("; "), "why2").alias("why"), path.alias("path"), F.lit(rank).alias("rank")))
                    rank += 1
            one = _first(found)
            return one.select(F.lit(i).alias("check_idx"), F.col("x").alias("subject"), F.col("path").cast(PATH).alias("path"), F.col("why").alias("reason"))
        p, s, o = ax.args
        rows = self.edges(p).filter((F.col("x") == s.iri) & (F.col("y") == o.iri))
        why = F.concat(F.lit(f"{self.said(s)} {self.said(p)} {self.said(o)}"), self._via(F.col("proof")))
        return rows.select(F.lit(i).alias("check_idx"), F.col("x").alias("subject"), F.col("proof").cast(PATH).alias("path"), why.alias("reason"))


def _first(parts: list[DataFrame]) -> DataFrame:
    """For each x the row of the lowest rank."""
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("x").agg(F.min_by(F.struct("why", "path"), "rank").alias("r")).select("x", "r.why", "r.path")


def _short(iri: str, table: dict[str, str]) -> str:
    import re

    for prefix, ns in sorted(table.items(), key=lambda kv: (-len(kv[1]), kv[0].encode())):
        local = iri[len(ns) :]
        if iri.startswith(ns) and local and not re.search(r'[\s()<>"@^#/?,;]', local):
            return f"{prefix}:{local}"
    return f"<{iri}>"


def derive(facts: DataFrame, rules: list[tuple[str, str, str]], max_rounds: int = 10_000, goals: dict[str, set[str]] | None = None) -> DataFrame:
    """(p, s, o, proof): facts closed under rules ``("sub", p, q)`` and ``("transitive", p, p)``.

    Every round derives from the facts of earlier rounds; of the derivations of one fact the
    one with the fewest assertions stays, ties by the order of the rules, then
    by the individual in the middle. Of a transitive property in ``goals`` only
    the facts that end in one of its individuals are derived.
    """
    ends = []
    for p, targets in (goals or {}).items():
        if (pos := _steps_only(p, rules)) is not None:
            ends.append(_ending(facts, p, [(i, rules[i][1]) for i in pos], targets))
            rules = [(k, a, b) if b != p else ("none", a, b) for k, a, b in rules]  # places stay: they break ties
    parts = [facts]
    with loop_settings(facts.sparkSession):
        delta = facts
        for _ in range(max_rounds if any(k != "none" for k, _, _ in rules) else 0):
            known = reduce(DataFrame.unionByName, parts)
            found = []
            for i, (kind, p, q) in enumerate(rules):
                if kind == "sub":
                    new = delta.filter(F.col("p") == p)
                    found.append(new.select(F.lit(q).alias("p"), "s", "o", "proof", F.lit(i).alias("rule"), F.lit("").alias("mid")))
                elif kind == "transitive":
                    old, new = known.filter(F.col("p") == p), delta.filter(F.col("p") == p)
                    for left, right in ((new, old), (old, new)):
                        l = left.select("s", F.col("o").alias("mid"), F.col("proof").alias("l"))
                        r = right.select(F.col("s").alias("mid"), "o", F.col("proof").alias("r"))
                        found.append(l.join(r, "mid").select(F.lit(p).alias("p"), "s", "o", F.concat("l", "r").alias("proof"), F.lit(i).alias("rule"), "mid"))
            new = reduce(DataFrame.unionByName, found).join(known.select("p", "s", "o"), ["p", "s", "o"], "left_anti")
            best = new.groupBy("p", "s", "o").agg(F.min_by("proof", F.struct(F.size("proof"), "rule", "mid")).alias("proof"))
            delta = checkpointed(best.select("p", "s", "o", "proof"))
            if delta.isEmpty():
                break
            parts.append(delta)
    return reduce(DataFrame.unionByName, parts + ends)


def _steps_only(p: str, rules: list[tuple[str, str, str]]) -> list[int] | None:
    """The places of the rules into a transitive property that nothing else builds on and whose steps are stated; None for others."""
    made = {q for _, _, q in rules}
    if ("transitive", p, p) not in rules or any(k == "sub" and a == p for k, a, _ in rules):
        return None
    pos = [i for i, (k, _, q) in enumerate(rules) if k == "sub" and q == p]
    return pos if all(rules[i][1] not in made for i in pos) else None


def _ending(facts: DataFrame, p: str, steps: list[tuple[int, str]], targets: set[str]) -> DataFrame:
    """(p, s, o, proof): shortest chains of steps that end in ``targets``.

    Round k puts the chains of just 2^k steps before those that end in a
    target after fewer, so a chain of any length takes a logarithm of rounds and
    its other ends are never paired.
    """
    spark = facts.sparkSession
    goal = spark.createDataFrame([(x,) for x in sorted(targets)], "o string")
    short = lambda df: df.groupBy("s", "o").agg(F.min_by("proof", F.struct(F.size("proof"), "rule", "mid")).alias("proof"))
    none = spark.createDataFrame([], "s string, o string, proof " + PATH + ", rule int, mid string")
    first = [facts.filter(F.col("p") == q).select("s", "o", "proof", F.lit(i).alias("rule"), F.lit("").alias("mid")) for i, q in steps]
    hop = lambda l, r: l.select("s", F.col("o").alias("mid"), F.col("proof").alias("l")).join(r.select(F.col("s").alias("mid"), "o", F.col("proof").alias("r")), "mid").select("s", "o", F.concat("l", "r").alias("proof"), F.lit(0).alias("rule"), "mid")
    with loop_settings(spark):
        exact, parts = checkpointed(short(reduce(DataFrame.unionByName, first, none))), []
        while not exact.isEmpty():
            new = exact.join(F.broadcast(goal), "o", "left_semi").select("s", "o", "proof", F.lit(0).alias("rule"), F.lit("").alias("mid"))
            if parts:
                known = reduce(DataFrame.unionByName, parts)
                new = new.unionByName(hop(exact, known)).join(known.select("s", "o"), ["s", "o"], "left_anti")
            more = checkpointed(short(new))
            if more.isEmpty():
                break  # whatever is farther would have a chain of this length behind it
            parts.append(more)
            exact = checkpointed(short(hop(exact, exact)))
    found = reduce(DataFrame.unionByName, parts) if parts else none.select("s", "o", "proof")
    return found.select(F.lit(p).alias("p"), "s", "o", "proof")


def _goals(checks: list[Term]) -> dict[str, set[str]]:
    """For the properties that checks ask only for facts that end in given individuals, these."""
    ends: dict[str, set[str]] = {}
    free: set[str] = set()

    def visit(x: Term) -> None:
        if x.op in ("ObjectHasValue", "NegativeObjectPropertyAssertion") and x.args[0].op == "ObjectProperty":
            ends.setdefault(x.args[0].iri, set()).add(x.args[-1].iri)
        elif x.op == "ObjectProperty":
            free.add(x.iri)
        else:
            for a in x.args:
                if isinstance(a, Term):
                    visit(a)

    for ax in checks:
        visit(ax)
    return {p: x for p, x in ends.items() if p not in free}


def validate(data: Ontology, constraints: Ontology) -> Report:
    """Check the facts of ``data`` against ``constraints``, which must be few enough for the driver."""
    spark = data.axioms.sparkSession
    members = data.kind("ClassAssertion").select(child(0).alias("c"), child(1).alias("i")).filter(f"c.kind = {t.CLASS} and i.kind = {t.INDIVIDUAL}")
    members = members.select(F.col("c.iri").alias("class"), F.col("i.iri").alias("ind"))
    facts = data.kind("ObjectPropertyAssertion").select(child(0).alias("p"), child(1).alias("s"), child(2).alias("o"))
    facts = facts.filter(f"p.kind = {t.OBJECT} and s.kind = {t.INDIVIDUAL} and o.kind = {t.INDIVIDUAL}").select(F.col("p.iri").alias("p"), F.col("s.iri").alias("s"), F.col("o.iri").alias("o")).distinct()
    facts = checkpointed(facts).withColumn("proof", F.array(F.struct("p", "s", "o")))
    stated = {r["p"] for r in facts.select("p").distinct().collect()}
    declared = {(r["kind"], r["iri"]) for r in data.declared().filter(F.col("kind").isin(t.CLASS, t.OBJECT)).collect()}

    rows = constraints.axioms.groupBy("canon").agg(F.min_by(F.struct("text", "nodes"), "idx").alias("r")).orderBy("canon").collect()
    rules, checks, refused = [], [], []
    for r in rows:
        ax, text = t.tree(r["r"]["nodes"]), r["r"]["text"]
        why = None
        if ax.op == "SubObjectPropertyOf":
            if any(a.op != "ObjectProperty" for a in ax.args):
                why = "a rule needs named properties"
            elif ax.args[1].iri in stated:
                why = "a rule must not add to a property that the data states"
            else:
                rules.append(("sub", ax.args[0].iri, ax.args[1].iri))
        elif ax.op == "TransitiveObjectProperty":
            if ax.args[0].op != "ObjectProperty":
                why = "a rule needs named properties"
            elif ax.args[0].iri in stated:
                why = "a rule must not add to a property that the data states"
            else:
                rules.append(("transitive", ax.args[0].iri, ax.args[0].iri))
        elif ax.op == "SubClassOf":
            why = _unwritten(ax.args[0]) or _unwritten(ax.args[1]) or (None if _anchored(ax.args[0]) else "the left side is not bounded by facts")
        elif ax.op == "DisjointClasses":
            why = "two operands are needed" if len(ax.args) < 2 else next((w for a in ax.args if (w := _unwritten(a) or (None if _anchored(a) else "an operand is not bounded by facts"))), None)
        elif ax.op == "NegativeObjectPropertyAssertion":
            why = None if all(a.op == "NamedIndividual" for a in ax.args[1:]) else "individuals need names"
        elif ax.op == "EquivalentClasses":
            why = "it defines instead of checking; write two inclusions"
        elif ax.op in ("ClassAssertion", "ObjectPropertyAssertion"):
            why = "a fact belongs to the data"
        elif ax.op not in ("Declaration", "AnnotationAssertion", "SubAnnotationPropertyOf", "AnnotationPropertyDomain", "AnnotationPropertyRange"):
            why = f"{ax.op} is not checked"
        if why:
            refused.append((text, why))
        elif ax.op in ("SubClassOf", "DisjointClasses", "NegativeObjectPropertyAssertion"):
            checks.append((ax, text))

    named = {n[7] for ax, _ in checks for n in t.nodes(ax) if n[6] == t.INDIVIDUAL}
    extra = spark.createDataFrame([(x,) for x in sorted(named)], "x string")
    individuals = members.select(F.col("ind").alias("x")).unionByName(facts.select(F.col("s").alias("x"))).unionByName(facts.select(F.col("o").alias("x"))).unionByName(extra).distinct()
    derived = derive(facts, rules, goals=_goals([ax for ax, _ in checks]))
    model = Model(members, derived, individuals, constraints.prefixes)
    parts = [model.check(i, ax) for i, (ax, _) in enumerate(checks)]
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], VIOLATION)

    made = {q for _, _, q in rules}
    filled = {r["p"] for r in derived.select("p").distinct().collect()}
    asked = {(n[6], n[7]) for ax, _ in checks for n in t.nodes(ax) if n[6] in (t.CLASS, t.OBJECT)} | {(t.OBJECT, p) for k, p, _ in rules if k == "sub"}
    asked |= {(t.OBJECT, n[7]) for ax, _ in checks for n in t.nodes(ax) if n[5] == "ObjectInverseOf"}
    classes = [iri for k, iri in asked if k == t.CLASS]
    populated = {r["class"] for r in members.filter(F.col("class").isin(*classes)).select("class").distinct().collect()} if classes else set()
    empty = [(k, iri) for k, iri in asked if (k, iri) not in declared and iri not in (t.THING, t.NOTHING) and not (iri in populated if k == t.CLASS else iri in filled or iri in made)]
    return Report([(i, text) for i, (_, text) in enumerate(checks)], found, refused, sorted(empty, key=lambda e: e[1]))
