"""Commands over documents: ``python -m axiomata COMMAND FILE...``. Exit 0: fine, 1: a check failed, 2: usage or input."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from axiomata.model import Ontology
from axiomata.operators import conform, diff, el, lint, profiles, reports
from axiomata.sources import ofn, rdf


def _load(spark: SparkSession, path: str) -> Ontology:
    text = spark.read.text(path, wholetext=True).first()[0]
    try:
        return ofn.ontology(spark, text)
    except ofn.ParseError as e:
        raise SystemExit(f"{path}: {e}") from None


def _show(o: Ontology, found, a) -> int:
    """Print the findings, as text or JSON; those in the table ``--seen`` are left out. The exit status."""
    if a.seen:
        found = lint.unseen(found, found.sparkSession.read.schema("rule string, subject string, message string").json(a.seen))
    if a.json:
        print(reports.findings_report(o, found).first()["report"])
        highest = lint.worst(found)
        return int(highest is not None and highest >= lint.severity(a.fail_on))
    rows = lint.sort_findings(found).collect()
    for r in rows:
        print(f"{lint.SEVERITIES[r['severity']]}: {r['rule']}: {r['message']}")
    return int(any(r["severity"] >= lint.severity(a.fail_on) for r in rows))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="axiomata", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *files: str, **flags):
        own = sub.add_parser(name)
        for f in files:
            own.add_argument(f)
        own.add_argument("--json", action="store_true")
        for k, v in flags.items():
            own.add_argument(f"--{k.replace('_', '-')}", **v)

    level = {"default": "error", "choices": lint.SEVERITIES}
    yes = {"action": "store_true"}
    seen = {"default": "", "metavar": "FILE"}
    command("lint", "file", disable={"default": ""}, fail_on=level, seen=seen)
    command("rules")
    command("diff", "before", "after", summary=yes, exit_code=yes)
    command("profile", "file", verbose=yes)
    command("fmt", "file", canonical=yes)
    command("stats", "file")
    command("classify", "file", axioms=yes, explain={"nargs": 2, "metavar": ("SUB", "SUPER")}, unsatisfiable=yes, fail_on_incoherent=yes)
    command("plan", "plan", "before", invariants={"default": ""}, fail_on=level, seen=seen)
    command("conform", "plan", "before", "after", fail_on=level, seen=seen)
    command("invariants", "invariants", "module", fail_on=level, seen=seen)
    command("triples", "file", syntax={"default": "turtle", "choices": tuple(rdf.PARSERS)}, base={"default": ""})
    return p


def run(spark: SparkSession, argv: list[str]) -> int:
    """One command; the exit status."""
    a = parser().parse_args(argv)
    tell = lambda df: print(df.first()["report"]) or 0
    if a.command == "rules":
        if a.json:
            return tell(reports.rules_report(spark))
        for r in lint.DEFAULT:
            print(f"{r.name} ({lint.SEVERITIES[r.severity]}): {r.description}")
        return 0
    if a.command == "lint":
        rules, unknown = lint.select(lint.DEFAULT, [x for x in a.disable.split(",") if x])
        if unknown:
            print("no such rule: " + ", ".join(unknown), file=sys.stderr)
            return 2
        o = _load(spark, a.file)
        found = lint.run(o, rules)
        if a.json and not a.seen:
            tell(reports.lint_report(o, found))
            worst = lint.worst(found)
            return int(worst is not None and worst >= lint.severity(a.fail_on))
        return _show(o, found, a)
    if a.command == "diff":
        x, y = _load(spark, a.before), _load(spark, a.after)
        if a.json:
            tell(reports.diff_report(x, y, not a.summary))
        elif a.summary:
            print(diff.summary(x, y))
        else:
            for sign, name, text in diff.diff_header(x, y):
                print(f"{sign} {name} {text}")
            for r in diff.diff(x, y).orderBy("change", "idx").collect():
                print(f"{r['change']} {r['text']}")
        changed = bool(diff.diff_header(x, y)) or not diff.diff(x, y).isEmpty()
        return int(a.exit_code and changed)
    if a.command == "profile":
        o = _load(spark, a.file)
        if a.json:
            return tell(reports.profile_report(o))
        held = profiles.profiles(o)
        print(" ".join(f"{p}:{'yes' if p in held else 'no'}" for p in ("EL", "QL", "RL", "DL")))
        if a.verbose:
            for r in profiles.check(o).orderBy("profile", "idx", "node").collect():
                print(f"{r['profile']}: {r['idx']}: {r['reason']}")
        return 0
    if a.command == "fmt":
        o = _load(spark, a.file)
        print(ofn.document(ofn.formatted(o) if a.canonical else o), end="")
        return 0
    if a.command == "stats":
        return tell(reports.stats_report(_load(spark, a.file)))
    if a.command == "classify":
        o = _load(spark, a.file)
        c = el.classify(o, explanations=bool(a.explain))
        if a.explain:
            return tell(reports.explain_report(c, *a.explain))
        if a.json:
            tell(reports.classify_report(c, a.axioms))
        else:
            for r in (c.unsatisfiable().orderBy("iri") if a.unsatisfiable else c.inferred().orderBy("text")).collect():
                print(r[0])
        return int(a.fail_on_incoherent and not c.coherent())
    if a.command == "plan":
        plan, before = _load(spark, a.plan), _load(spark, a.before)
        found = conform.review_plan(plan, before)
        if a.invariants:
            found = found.unionByName(conform.review_invariants(_load(spark, a.invariants), plan, before))
        return _show(before, found, a)
    if a.command == "conform":
        after = _load(spark, a.after)
        return _show(after, conform.conform(_load(spark, a.plan), _load(spark, a.before), after), a)
    if a.command == "invariants":
        module = _load(spark, a.module)
        return _show(module, conform.check_invariants(_load(spark, a.invariants), module), a)
    for r in rdf.ntriples(rdf.read(spark, a.file, a.syntax, a.base)).orderBy("doc", "pos").collect():
        print(r["line"])
    return 0


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.getOrCreate(), sys.argv[1:]))
