"""Expression trees whose leaves are Python values or Spark columns.

A :class:`Term` is an entity, a literal, a class expression, a data range or an
axiom. Where all leaves are Python values (parsed documents), rendering gives
Python strings; where a leaf is a column (ontologies built from tables), the
same code gives column expressions, so whole tables become axioms inside the
JVM, without Python workers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_W3 = "http://www.w3.org/"
OWL, RDF, RDFS, XSD = f"{_W3}2002/07/owl#", f"{_W3}1999/02/22-rdf-syntax-ns#", f"{_W3}2000/01/rdf-schema#", f"{_W3}2001/XMLSchema#"
STANDARD = {"owl": OWL, "rdf": RDF, "rdfs": RDFS, "xsd": XSD}
THING, NOTHING = f"{OWL}Thing", f"{OWL}Nothing"

#: Entity kinds in their sort order; the position is the kind's number.
KINDS = ("Class", "Datatype", "ObjectProperty", "DataProperty", "AnnotationProperty", "NamedIndividual")
CLASS, DATATYPE, OBJECT, DATA, ANNOTATION, INDIVIDUAL = range(6)

Text = str | Column


@dataclass(frozen=True, eq=False)
class Term:
    """One construct: ``op`` names it, ``args`` are its parts in order."""

    op: str
    args: tuple[Term, ...] = ()
    iri: Text | None = None
    n: int | Column | None = None
    value: Text | None = None
    datatype: Text | None = None
    lang: Text | None = None


#: The roles of the parts; a role ending in * repeats.
SHAPES: dict[str, tuple[str, ...]] = {
    "Declaration": ("entity",),
    "SubClassOf": ("sub", "super"), "EquivalentClasses": ("operand*",), "DisjointClasses": ("operand*",), "DisjointUnion": ("class", "operand*"),
    "SubObjectPropertyOf": ("sub", "super"), "SubPropertyChainOf": ("super", "chain*"), "EquivalentObjectProperties": ("operand*",), "DisjointObjectProperties": ("operand*",),
    "InverseObjectProperties": ("operand*",), "ObjectPropertyDomain": ("property", "domain"), "ObjectPropertyRange": ("property", "range"),
    **{f"{k}ObjectProperty": ("property",) for k in ("Functional", "InverseFunctional", "Reflexive", "Irreflexive", "Symmetric", "Asymmetric", "Transitive")},
    "SubDataPropertyOf": ("sub", "super"), "EquivalentDataProperties": ("operand*",), "DisjointDataProperties": ("operand*",), "DataPropertyDomain": ("property", "domain"),
    "DataPropertyRange": ("property", "range"), "FunctionalDataProperty": ("property",), "DatatypeDefinition": ("datatype", "range"), "HasKey": ("class", "key*"),
    "SameIndividual": ("operand*",), "DifferentIndividuals": ("operand*",), "ClassAssertion": ("class", "individual"),
    **{f"{k}ObjectPropertyAssertion": ("property", "subject", "object") for k in ("", "Negative")}, **{f"{k}DataPropertyAssertion": ("property", "subject", "value") for k in ("", "Negative")},
    "AnnotationAssertion": ("property", "subject", "value"), "SubAnnotationPropertyOf": ("sub", "super"), "AnnotationPropertyDomain": ("property", "domain"), "AnnotationPropertyRange": ("property", "range"),
    "Annotation": ("property", "value"), "ObjectIntersectionOf": ("operand*",), "ObjectUnionOf": ("operand*",), "ObjectComplementOf": ("operand",), "ObjectOneOf": ("operand*",),
    "ObjectSomeValuesFrom": ("property", "filler"), "ObjectAllValuesFrom": ("property", "filler"), "ObjectHasValue": ("property", "value"), "ObjectHasSelf": ("property",),
    **{f"Object{k}Cardinality": ("property", "filler") for k in ("Min", "Max", "Exact")}, "DataSomeValuesFrom": ("property", "filler"), "DataAllValuesFrom": ("property", "filler"), "DataHasValue": ("property", "value"),
    **{f"Data{k}Cardinality": ("property", "filler") for k in ("Min", "Max", "Exact")}, "ObjectInverseOf": ("property",), "DataIntersectionOf": ("operand*",), "DataUnionOf": ("operand*",),
    "DataComplementOf": ("operand",), "DataOneOf": ("operand*",), "DatatypeRestriction": ("datatype", "facet*"), "FacetRestriction": ("value",),
}
AXIOMS = tuple(SHAPES)[: tuple(SHAPES).index("Annotation")]
_CARDINALITIES = tuple(f"{side}{which}Cardinality" for side in ("Object", "Data") for which in ("Min", "Max", "Exact"))
CLASS_EXPRESSIONS = (
    "ObjectIntersectionOf", "ObjectUnionOf", "ObjectComplementOf", "ObjectOneOf", "ObjectSomeValuesFrom", "ObjectAllValuesFrom", "ObjectHasValue", "ObjectHasSelf",
    "DataSomeValuesFrom", "DataAllValuesFrom", "DataHasValue", *_CARDINALITIES,
)
DATA_RANGES = ("DataIntersectionOf", "DataUnionOf", "DataComplementOf", "DataOneOf", "DatatypeRestriction")
#: Axioms and expressions whose parts commute, with the parts that do.
UNORDERED = {"EquivalentClasses", "DisjointClasses", "EquivalentObjectProperties", "DisjointObjectProperties", "InverseObjectProperties", "EquivalentDataProperties", "DisjointDataProperties", "SameIndividual", "DifferentIndividuals", "ObjectOneOf", "DataOneOf"}
COLLAPSING = {"ObjectIntersectionOf", "ObjectUnionOf", "DataIntersectionOf", "DataUnionOf"}


def roles(op: str, count: int) -> list[str]:
    """The role of each of ``count`` parts."""
    shape = SHAPES.get(op, ())
    out = [shape[min(i, len(shape) - 1)] for i in range(count)] if shape else []
    return [r.rstrip("*") for r in out]


# == constructors


def cls(iri: Text) -> Term:
    return Term("Class", iri=iri)


def datatype(iri: Text) -> Term:
    return Term("Datatype", iri=iri)


def obj(iri: Text) -> Term:
    return Term("ObjectProperty", iri=iri)


def dat(iri: Text) -> Term:
    return Term("DataProperty", iri=iri)


def ann(iri: Text) -> Term:
    return Term("AnnotationProperty", iri=iri)


def ind(iri: Text) -> Term:
    return Term("NamedIndividual", iri=iri)


def anon(label: Text) -> Term:
    return Term("Anonymous", iri=label)


def bare(iri: Text) -> Term:
    """An IRI that is no entity (subjects of annotations)."""
    return Term("IRI", iri=iri)


def literal(value: Text, kind: Text = f"{XSD}string", lang: Text | None = None) -> Term:
    return Term("Literal", value=value, datatype=f"{RDF}langString" if lang is not None else kind, lang=lang)


def integer(n: int) -> Term:
    return literal(str(n), f"{XSD}integer")


def double(x: float) -> Term:
    """Shortest text that reads back as the same number."""
    text = repr(float(x))
    return literal(text.removesuffix(".0"), f"{XSD}double")


def boolean(x: bool) -> Term:
    return literal("true" if x else "false", f"{XSD}boolean")


def moment(x) -> Term:
    """RFC 3339 text of a datetime; without a zone it is taken as UTC."""
    text = x.isoformat(timespec="seconds")
    return literal(text.replace("+00:00", "Z") if x.tzinfo else f"{text}Z", f"{XSD}dateTime")


def make(op: str, *args: Term, n: int | Column | None = None) -> Term:
    """Any construct of :data:`SHAPES`; raises ValueError for an unknown one."""
    if op not in SHAPES:
        raise ValueError(f"unknown construct {op}")
    return Term(op, args, n=n)


def conj(*args: Term) -> Term:
    return Term("ObjectIntersectionOf", args)


def disj(*args: Term) -> Term:
    return Term("ObjectUnionOf", args)


def neg(arg: Term) -> Term:
    return Term("ObjectComplementOf", (arg,))


def some(prop: Term, filler: Term) -> Term:
    return Term("ObjectSomeValuesFrom", (prop, filler))


def only(prop: Term, filler: Term) -> Term:
    return Term("ObjectAllValuesFrom", (prop, filler))


def has(prop: Term, value: Term) -> Term:
    return Term("ObjectHasValue", (prop, value))


def one_of(*args: Term) -> Term:
    return Term("ObjectOneOf", args)


def self_(prop: Term) -> Term:
    return Term("ObjectHasSelf", (prop,))


def cardinality(which: str, n: int, prop: Term, filler: Term | None = None) -> Term:
    """``which`` is Min, Max or Exact; object or data by the property."""
    side = "Data" if prop.op == "DataProperty" else "Object"
    return Term(f"{side}{which}Cardinality", (prop,) if filler is None else (prop, filler), n=n)


def inverse(prop: Term) -> Term:
    return Term("ObjectInverseOf", (prop,))


def facet(iri: Text, value: Term) -> Term:
    return Term("FacetRestriction", (value,), iri=iri)


def restrict(base: Term, *facets: Term) -> Term:
    return Term("DatatypeRestriction", (base, *facets))


# == rendering


def cat(*parts: Text) -> Text:
    """Concatenation; Python text where no part is a column."""
    flat: list[Text] = []
    for p in parts:
        if isinstance(p, str) and flat and isinstance(flat[-1], str):
            flat[-1] += p
        elif not (isinstance(p, str) and p == ""):
            flat.append(p)
    if all(isinstance(p, str) for p in flat):
        return "".join(flat)  # type: ignore[arg-type]
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in flat])


def _join(parts: Iterable[Text]) -> Text:
    out: list[Text] = []
    for p in parts:
        out += [" ", p] if out else [p]
    return cat(*out)


def quoted(value: Text) -> Text:
    """A string literal with its five escapes."""
    pairs = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))
    for a, b in pairs:
        value = value.replace(a, b) if isinstance(value, str) else F.replace(value, F.lit(a), F.lit(b))
    return cat('"', value, '"')


def full(iri: Text) -> Text:
    return cat("<", iri, ">")


def render(t: Term, name: Callable[[Text], Text] = full, part: Callable[[Term], Text] | None = None) -> Text:
    """Functional-style text. ``name`` writes IRIs, ``part`` the arguments."""
    own = part or (lambda a: render(a, name))
    if t.op in KINDS or t.op == "IRI":
        return name(t.iri)
    if t.op == "Anonymous":
        return cat("_:", t.iri)
    if t.op == "Literal":
        if t.lang is not None:
            return cat(quoted(t.value), "@", t.lang)
        return cat(quoted(t.value), "^^", name(t.datatype)) if isinstance(t.datatype, Column) or t.datatype else quoted(t.value)
    if t.op == "FacetRestriction":
        return cat(name(t.iri), " ", own(t.args[0]))
    if t.op == "Declaration":
        return cat("Declaration(", t.args[0].op, "(", own(t.args[0]), "))")
    if t.op == "SubPropertyChainOf":
        return cat("SubObjectPropertyOf(ObjectPropertyChain(", _join(map(own, t.args[1:])), ") ", own(t.args[0]), ")")
    if t.op == "HasKey":
        sides = [[a for a in t.args[1:] if (a.op == "DataProperty") == d] for d in (False, True)]
        return cat("HasKey(", own(t.args[0]), " (", _join(map(own, sides[0])), ") (", _join(map(own, sides[1])), "))")
    count = [] if t.n is None else [str(t.n) if isinstance(t.n, int) else t.n.cast("string")]
    return cat(t.op, "(", _join([*count, *map(own, t.args)]), ")")


def _sorted(parts: list[Text]) -> list[str] | Column:
    """Distinct parts in byte order: a list, or an array column."""
    if all(isinstance(p, str) for p in parts):
        return sorted(set(parts), key=lambda s: s.encode("utf-8", "surrogatepass"))  # type: ignore[arg-type]
    return F.array_sort(F.array_distinct(F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts])))


def _flat(t: Term, op: str) -> list[Text] | Column:
    """The canonical operands that ``t`` adds to an enclosing ``op``."""
    if t.op == op:
        return _operands(t)
    if t.op in ("ObjectIntersectionOf", "ObjectUnionOf"):
        inner = _operands(t)
        if isinstance(inner, list):
            if len(inner) == 1:  # it collapses to its only operand, which may be an `op`
                alike = [a for a in t.args if isinstance(c := canonical(a), str) and c == inner[0]]
                return _flat(alike[0], op) if alike else inner
        else:
            first = _flat(t.args[0], op)
            first = F.array(*[F.lit(p) if isinstance(p, str) else p for p in first]) if isinstance(first, list) else first
            return F.when(F.size(inner) == 1, first).otherwise(F.array(canonical(t)))
    return [canonical(t)]


def _operands(t: Term) -> list[str] | Column:
    if t.op.startswith("Object"):
        parts = [_flat(a, t.op) for a in t.args]
    else:
        parts = [[canonical(a)] for a in t.args]
    if all(isinstance(p, list) for p in parts):
        return _sorted([x for p in parts for x in p])
    arrays = [F.array(*[F.lit(x) if isinstance(x, str) else x for x in p]) if isinstance(p, list) else p for p in parts]
    return F.array_sort(F.array_distinct(F.concat(*arrays)))


def _spread(parts: list[str] | Column) -> Text:
    return " ".join(parts) if isinstance(parts, list) else F.array_join(parts, " ")


def canonical(t: Term) -> Text:
    """Text of the canonical form: commuting parts flattened, sorted, distinct; the key for equality."""
    if t.op in COLLAPSING:
        parts = _operands(t)
        if isinstance(parts, list):
            return parts[0] if len(parts) == 1 else f"{t.op}({_spread(parts)})"
        return F.when(F.size(parts) == 1, F.element_at(parts, 1)).otherwise(cat(t.op, "(", _spread(parts), ")"))
    if t.op in UNORDERED:
        ops = [canonical(a) for a in t.args]
        if t.op == "InverseObjectProperties":  # the pair is ordered but keeps both sides
            return cat(t.op, "(", _spread(sorted(ops) if all(isinstance(p, str) for p in ops) else F.array_sort(F.array(*[F.lit(p) if isinstance(p, str) else p for p in ops]))), ")")
        return cat(t.op, "(", _spread(_sorted(ops)), ")")
    if t.op in ("DisjointUnion", "DatatypeRestriction"):
        first, rest = canonical(t.args[0]), _sorted([canonical(a) for a in t.args[1:]])
        empty = isinstance(rest, list) and not rest
        return cat(t.op, "(", first, "" if empty else " ", _spread(rest), ")")
    if t.op == "HasKey":
        sides = [_spread(_sorted([canonical(a) for a in t.args[1:] if (a.op == "DataProperty") == d])) for d in (False, True)]
        return cat("HasKey(", canonical(t.args[0]), " (", sides[0], ") (", sides[1], "))")
    return render(t, part=canonical)


def annotated(text: Text, notes: tuple[Term, ...], part: Callable[[Term], Text] = render) -> Text:
    """An axiom's text with its annotations after the first parenthesis."""
    if not notes:
        return text
    inner = _join(map(part, notes))
    if isinstance(text, str) and isinstance(inner, str):
        head, _, tail = text.partition("(")
        return f"{head}({inner} {tail}"
    text = F.lit(text) if isinstance(text, str) else text
    at = F.instr(text, F.lit("("))
    return F.concat(F.substring(text, F.lit(1), at), F.lit(inner) if isinstance(inner, str) else inner, F.lit(" "), F.substr(text, at + 1))


# == rows

_TYPES = {"id": T.IntegerType(), "parent": T.IntegerType(), "pos": T.IntegerType(), "depth": T.IntegerType(), "kind": T.IntegerType(), "n": T.IntegerType(), "inverse": T.BooleanType()}
NODE = T.StructType([T.StructField(f, _TYPES.get(f, T.StringType())) for f in "id parent pos depth role op kind iri inverse n value datatype lang text canon".split()])
AXIOM = T.StructType([
    T.StructField("idx", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("canon", T.StringType()),
    T.StructField("notes", T.ArrayType(NODE)), T.StructField("nodes", T.ArrayType(NODE)),
])


def nodes(t: Term) -> list[tuple]:
    """The tree in preorder, one tuple of :data:`NODE` for each construct; the axiom itself is node 0."""
    out: list[tuple] = []

    def visit(x: Term, parent: int | None, pos: int, depth: int, role: str) -> None:
        own = len(out)
        named = x.args[0].iri if x.op == "ObjectInverseOf" else x.iri
        kind = KINDS.index(x.op) if x.op in KINDS else None
        out.append((own, parent, pos, depth, role, x.op, kind, named, x.op == "ObjectInverseOf", x.n, x.value, x.datatype, x.lang, render(x), canonical(x)))
        for i, (a, r) in enumerate(zip(x.args, roles(x.op, len(x.args)))):
            visit(a, own, i, depth + 1, r)

    visit(t, None, 0, 0, "axiom")
    return out


def row(idx: int, t: Term, notes: tuple[Term, ...] = ()) -> tuple:
    """A row of :data:`AXIOM` for a term of Python values."""
    key = annotated(canonical(t), notes)
    return (idx, t.op, annotated(render(t), notes), key, [n for a in notes for n in nodes(a)], nodes(t))


@cache
def _fields() -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in NODE]


def columns(t: Term, notes: tuple[Term, ...] = ()) -> dict[str, Column]:
    """The columns kind, text, canon, notes and nodes of an axiom whose leaves may be columns."""

    def struct(n: tuple) -> Column:
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast(kind).alias(name) for v, (name, kind) in zip(n, _fields())])

    def array(rows: list[tuple]) -> Column:
        return F.array(*map(struct, rows)) if rows else F.array().cast(T.ArrayType(NODE))

    col = lambda x: F.lit(x) if isinstance(x, str) else x
    return {
        "kind": F.lit(t.op), "text": col(annotated(render(t), notes)), "canon": col(annotated(canonical(t), notes)),
        "notes": array([n for a in notes for n in nodes(a)]), "nodes": array(nodes(t)),
    }


def tree(rows: list) -> Term:
    """The term of a ``nodes`` array (rows or dictionaries) with Python values."""
    own: dict[int, list[int]] = {}
    by = {}
    for r in rows:
        by[r["id"]] = r
        own.setdefault(r["parent"], []).append(r["id"])

    def build(i: int) -> Term:
        r = by[i]
        args = tuple(build(c) for c in sorted(own.get(i, ()), key=lambda c: by[c]["pos"]))
        return Term(r["op"], args, iri=None if r["op"] == "ObjectInverseOf" else r["iri"], n=r["n"], value=r["value"], datatype=r["datatype"], lang=r["lang"])

    return build(min(by))
