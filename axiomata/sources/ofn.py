"""Functional-style documents: a parser that runs on executors, a reader and a writer.

Each document is parsed by one task; documents are read in parallel. The
writer orders axioms by ``idx`` and writes text lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axiomata.functions import names
from axiomata.functions import terms as t
from axiomata.functions.terms import AXIOM, Term
from axiomata.model import Ontology, abbreviated, ranked


class ParseError(ValueError):
    """Malformed text; ``line`` counts from 1."""

    def __init__(self, line: int, what: str):
        super().__init__(f"line {line}: {what}")
        self.line = line


_TOKEN = re.compile(
    r"""(?P<space>[ \t\r]+|\#[^\n]*)|(?P<line>\n)|(?P<open>\()|(?P<close>\))|(?P<eq>=)|(?P<iri><[^>]*>)|(?P<string>"(?:[^"\\]|\\.)*")
    |(?P<lang>@[A-Za-z0-9-]+)|(?P<caret>\^\^)|(?P<node>_:[A-Za-z0-9_.%~+\-\u0080-\U0010ffff]+)|(?P<name>[A-Za-z0-9_\-.:%~+\u0080-\U0010ffff]+)""",
    re.X | re.S,
)
_ESCAPES = {'"': '"', "\\": "\\", "n": "\n", "r": "\r", "t": "\t"}


def tokens(text: str) -> list[tuple[str, str, int]]:
    """(kind, value, line); kinds: open close eq iri string lang caret node int pname word end."""
    out, at, line = [], 0, 1
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            c = text[at]
            raise ParseError(line, {"<": "IRI without an end", '"': "string without an end", "@": "language tag without a name"}.get(c, f"unexpected {c!r}"))
        kind, value, at = m.lastgroup, m[0], m.end()
        if kind == "line":
            line += 1
        elif kind == "iri":
            if re.search(r"[\s<]", value[1:-1]):
                raise ParseError(line, f"IRI {value} holds white space or a bracket")
            out.append((kind, value[1:-1], line))
        elif kind == "string":
            def escape(e: re.Match, line: int = line) -> str:
                if e[1] not in _ESCAPES:
                    raise ParseError(line, f"escape \\{e[1]} is not known")
                return _ESCAPES[e[1]]

            out.append((kind, re.sub(r"\\(.)", escape, value[1:-1], flags=re.S), line))
            line += value.count("\n")
        elif kind == "name":
            kind = "int" if value.isascii() and value.isdigit() else "pname" if ":" in value else "word"
            out.append((kind, value, line))
        elif kind == "lang":
            out.append((kind, value[1:], line))
        elif kind == "node":
            out.append((kind, value[2:], line))
        elif kind != "space":
            out.append((kind, value, line))
    out.append(("end", "", line))
    return out


@dataclass
class Document:
    """A parsed document."""

    iri: str = ""
    version: str = ""
    imports: list[str] = field(default_factory=list)
    notes: list[Term] = field(default_factory=list)
    axioms: list[tuple[Term, tuple[Term, ...]]] = field(default_factory=list)
    prefixes: dict[str, str] = field(default_factory=names.prefixes)




class Parser:
    """Recursive descent over the tokens; one method for each sort of part."""

    def __init__(self, text: str, prefixes: dict[str, str] | None = None):
        self.tokens, self.at = tokens(text), 0
        self.prefixes = dict(prefixes) if prefixes is not None else names.prefixes()

    def peek(self) -> tuple[str, str, int]:
        return self.tokens[self.at]

    def fail(self, wanted: str):
        kind, value, line = self.peek()
        raise ParseError(line, f"{wanted} expected, found {value or kind!r}")

    def take(self, kind: str) -> str:
        own, value, _ = self.peek()
        if own != kind:
            self.fail({"open": "(", "close": ")", "int": "an integer", "string": "a string", "end": "the end"}.get(kind, kind))
        self.at += 1
        return value

    def opens(self, word: str) -> bool:
        return self.peek()[:2] == ("word", word) and self.tokens[self.at + 1][0] == "open"

    def keyword(self) -> str:
        word = self.take("word")
        self.take("open")
        return word

    def iri(self) -> str:
        kind, value, line = self.peek()
        if kind == "iri":
            self.at += 1
            return value
        if kind != "pname":
            self.fail("an IRI")
        self.at += 1
        prefix, _, local = value.partition(":")
        if prefix not in self.prefixes:
            raise ParseError(line, f"prefix {prefix!r} is not declared")
        return self.prefixes[prefix] + local

    def at_iri(self) -> bool:
        return self.peek()[0] in ("iri", "pname")

    def many(self, read) -> tuple[Term, ...]:
        out = []
        while self.peek()[0] != "close":
            if self.peek()[0] == "end":
                self.fail(")")
            out.append(read())
        return tuple(out)

    def lit(self) -> Term:
        value = self.take("string")
        if self.peek()[0] == "lang":
            return t.literal(value, lang=self.take("lang"))
        if self.peek()[0] == "caret":
            self.at += 1
            return t.literal(value, self.iri())
        return t.literal(value)

    def ind(self) -> Term:
        if self.peek()[0] == "node":
            return t.anon(self.take("node"))
        return t.ind(self.iri())

    def op(self) -> Term:
        if self.at_iri():
            return t.obj(self.iri())
        line = self.peek()[2]
        if self.keyword() != "ObjectInverseOf":
            raise ParseError(line, "a property expected")
        out = t.inverse(t.obj(self.iri()))
        self.take("close")
        return out

    def dp(self) -> Term:
        return t.dat(self.iri())

    def data_range(self) -> Term:
        if self.at_iri():
            return t.datatype(self.iri())
        line = self.peek()[2]
        word = self.keyword()
        if word in ("DataIntersectionOf", "DataUnionOf"):
            out = Term(word, self.many(self.data_range))
        elif word == "DataComplementOf":
            out = Term(word, (self.data_range(),))
        elif word == "DataOneOf":
            out = Term(word, self.many(self.lit))
        elif word == "DatatypeRestriction":
            base = t.datatype(self.iri())
            out = t.restrict(base, *self.many(lambda: t.facet(self.iri(), self.lit())))
        else:
            raise ParseError(line, f"{word} is no data range")
        self.take("close")
        return out

    def cls(self) -> Term:
        if self.at_iri():
            return t.cls(self.iri())
        line = self.peek()[2]
        word = self.keyword()
        if word not in t.CLASS_EXPRESSIONS:
            raise ParseError(line, f"{word} is no class expression")
        data, n = word.startswith("Data"), None
        if word.endswith("Cardinality"):
            n = int(self.take("int"))
        if word in ("ObjectIntersectionOf", "ObjectUnionOf"):
            args = self.many(self.cls)
        elif word == "ObjectComplementOf":
            args = (self.cls(),)
        elif word == "ObjectOneOf":
            args = self.many(self.ind)
        else:
            args = (self.dp() if data else self.op(),)
            if word == "ObjectHasValue":
                args += (self.ind(),)
            elif word == "DataHasValue":
                args += (self.lit(),)
            elif word != "ObjectHasSelf" and (n is None or self.peek()[0] != "close"):
                args += (self.data_range() if data else self.cls(),)
        if self.peek()[0] != "close" and data and not word.endswith("Value"):
            raise ParseError(line, f"{word} over several properties is not supported")
        self.take("close")
        return Term(word, args, n=n)

    def note(self) -> Term:
        """An annotation; annotations on it are read and dropped."""
        self.keyword()
        self.notes()
        out = t.make("Annotation", t.ann(self.iri()), self.note_value())
        self.take("close")
        return out

    def notes(self) -> tuple[Term, ...]:
        out = []
        while self.opens("Annotation"):
            out.append(self.note())
        return tuple(out)

    def note_value(self) -> Term:
        kind = self.peek()[0]
        if kind == "string":
            return self.lit()
        if kind == "node":
            return t.anon(self.take("node"))
        if kind in ("iri", "pname"):
            return t.bare(self.iri())
        self.fail("the value of an annotation")

    def axiom(self) -> tuple[Term, tuple[Term, ...]]:
        line = self.peek()[2]
        word = self.keyword()
        notes = self.notes()
        body = self.body(word, line)
        self.take("close")
        return body, notes

    def body(self, word: str, line: int) -> Term:
        if word not in t.AXIOMS or word == "SubPropertyChainOf":
            raise ParseError(line, f"{word} is no axiom")
        if word == "Declaration":
            kind = self.keyword()
            if kind not in t.KINDS:
                raise ParseError(line, f"{kind} is no kind of entity")
            own = Term(kind, iri=self.iri())
            self.take("close")
            return Term(word, (own,))
        if word in ("SubClassOf",):
            return Term(word, (self.cls(), self.cls()))
        if word in ("EquivalentClasses", "DisjointClasses"):
            return Term(word, self.many(self.cls))
        if word == "DisjointUnion":
            return Term(word, (t.cls(self.iri()), *self.many(self.cls)))
        if word == "SubObjectPropertyOf":
            if self.opens("ObjectPropertyChain"):
                self.keyword()
                chain = self.many(self.op)
                self.take("close")
                return Term("SubPropertyChainOf", (self.op(), *chain))
            return Term(word, (self.op(), self.op()))
        if word in ("EquivalentObjectProperties", "DisjointObjectProperties"):
            return Term(word, self.many(self.op))
        if word == "InverseObjectProperties":
            return Term(word, (self.op(), self.op()))
        if word in ("ObjectPropertyDomain", "ObjectPropertyRange"):
            return Term(word, (self.op(), self.cls()))
        if word in ("SubDataPropertyOf",):
            return Term(word, (self.dp(), self.dp()))
        if word in ("EquivalentDataProperties", "DisjointDataProperties"):
            return Term(word, self.many(self.dp))
        if word == "DataPropertyDomain":
            return Term(word, (self.dp(), self.cls()))
        if word == "DataPropertyRange":
            return Term(word, (self.dp(), self.data_range()))
        if word == "FunctionalDataProperty":
            return Term(word, (self.dp(),))
        if word == "DatatypeDefinition":
            return Term(word, (t.datatype(self.iri()), self.data_range()))
        if word == "HasKey":
            own = self.cls()
            self.take("open")
            keys = self.many(self.op)
            self.take("close")
            if self.peek()[0] != "close":
                self.take("open")
                keys += self.many(self.dp)
                self.take("close")
            return Term(word, (own, *keys))
        if word in ("SameIndividual", "DifferentIndividuals"):
            return Term(word, self.many(self.ind))
        if word == "ClassAssertion":
            return Term(word, (self.cls(), self.ind()))
        if word.endswith("ObjectPropertyAssertion"):
            return Term(word, (self.op(), self.ind(), self.ind()))
        if word.endswith("DataPropertyAssertion"):
            return Term(word, (self.dp(), self.ind(), self.lit()))
        if word == "AnnotationAssertion":
            prop = t.ann(self.iri())
            if self.peek()[0] == "node":
                raise ParseError(line, "an annotation of an anonymous individual is not supported")
            return Term(word, (prop, t.bare(self.iri()), self.note_value()))
        if word == "SubAnnotationPropertyOf":
            return Term(word, (t.ann(self.iri()), t.ann(self.iri())))
        if word in ("AnnotationPropertyDomain", "AnnotationPropertyRange"):
            return Term(word, (t.ann(self.iri()), t.bare(self.iri())))
        return Term(word, (self.op(),))  # the seven characteristics

    def document(self) -> Document:
        out = Document(prefixes=self.prefixes)
        while self.opens("Prefix"):
            self.keyword()
            name = self.take("pname")
            self.take("eq")
            self.prefixes[name.rstrip(":")] = self.take("iri")
            self.take("close")
        if not self.opens("Ontology"):
            self.fail("Ontology(")
        self.keyword()
        if self.at_iri():
            out.iri = self.iri()
            if self.at_iri():
                out.version = self.iri()
        while self.peek()[0] != "close":
            if self.peek()[0] == "end":
                self.fail(")")
            if self.opens("Import"):
                self.keyword()
                out.imports.append(self.iri())
                self.take("close")
            elif self.opens("Annotation"):
                out.notes.append(self.note())
            else:
                out.axioms.append(self.axiom())
        self.take("close")
        self.take("end")
        return out


def parse(text: str) -> Document:
    """A whole document; raises :class:`ParseError`."""
    return Parser(text).document()


def parse_axiom(text: str, prefixes: dict[str, str] | None = None) -> tuple[Term, tuple[Term, ...]]:
    """One axiom and nothing after it."""
    p = Parser(text, prefixes)
    out = p.axiom()
    p.take("end")
    return out


def parse_class(text: str, prefixes: dict[str, str] | None = None) -> Term:
    """One class expression and nothing after it."""
    p = Parser(text, prefixes)
    out = p.cls()
    p.take("end")
    return out


def ontology(spark: SparkSession, text: str) -> Ontology:
    """An ontology from one document on the driver."""
    d = parse(text)
    return Ontology.of(spark, d.axioms, iri=d.iri, version=d.version, imports=tuple(d.imports), notes=tuple(d.notes), prefixes=d.prefixes)


DOCUMENT_ROW = T.StructType([T.StructField("onto", T.StringType()), *AXIOM.fields, T.StructField("error", T.StringType())])


def read(spark: SparkSession, path: str, permissive: bool = False) -> DataFrame:
    """(onto, the axiom columns, error) of all documents at ``path``; ``onto`` is the file.

    Files are parsed on executors, each by one task. A malformed file raises,
    or gives one row with its error when ``permissive``.
    """
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("onto"), "value")
    return parse_column(texts, "onto", "value", permissive)


def parse_column(df: DataFrame, key: str, text: str, permissive: bool = False) -> DataFrame:
    """As :func:`read`, for documents in a column."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for onto, source in zip(frame["onto"], frame["value"]):
                try:
                    rows = [(onto, *t.row(i, *a), None) for i, a in enumerate(parse(source).axioms)]
                except ParseError as e:
                    if not permissive:
                        raise ParseError(e.line, f"{onto}: {e}") from None
                    rows = [(onto, None, None, None, None, None, None, str(e))]
                for at in range(0, len(rows), 2000):
                    out = pd.DataFrame(rows[at : at + 2000], columns=DOCUMENT_ROW.names)
                    for c in ("notes", "nodes"):
                        out[c] = out[c].map(lambda ns: None if ns is None else [dict(zip(t.NODE.names, n)) for n in ns])
                    yield out

    return df.select(F.col(key).cast("string").alias("onto"), F.col(text).alias("value")).mapInPandas(run, DOCUMENT_ROW)


def axiom_table(df: DataFrame, text: str, prefixes: dict[str, str]) -> DataFrame:
    """``df`` with kind, canon and error of the axiom in a text column; nothing raises."""

    @F.pandas_udf("kind string, canon string, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for x in texts:
            try:
                ax, notes = parse_axiom(x or "", prefixes)
                out.append((ax.op, t.annotated(t.canonical(ax), notes), None))
            except ParseError as e:
                out.append((None, None, str(e)))
        return pd.DataFrame(out, columns=["kind", "canon", "error"])

    return df.withColumn("__p", run(F.col(text))).select(*df.columns, "__p.*")


def lines(o: Ontology, canonical: bool = False) -> DataFrame:
    """(idx, line): the axioms as text with the ontology's prefixes, in order."""
    body: Column = abbreviated(F.col("canon" if canonical else "text"), o.prefixes)
    return o.axioms.select("idx", body.alias("line")).orderBy("idx")


def head(o: Ontology) -> list[str]:
    """The lines before the axioms: prefixes sorted by name, header, imports, annotations."""
    from axiomata.operators.icv import _short

    name = lambda iri: _short(iri, o.prefixes)
    out = [f"Prefix({p}:=<{ns}>)" for p, ns in sorted(o.prefixes.items(), key=lambda kv: kv[0].encode())]
    out.append(" ".join(["Ontology(" + (f"<{o.iri}>" if o.iri else ""), *([f"<{o.version}>"] if o.version else [])]))
    out += [f"Import(<{i}>)" for i in o.imports]
    out += [t.render(n, name) for n in o.notes]
    return out


def document(o: Ontology, canonical: bool = False) -> str:
    """The whole document on the driver; for ontologies that fit there."""
    return "\n".join([*head(o), *(r["line"] for r in lines(o, canonical).collect()), ")"]) + "\n"


def write(o: Ontology, path: str, canonical: bool = False) -> None:
    """Write the document as text part files whose names follow the order of the axioms."""
    spark = o.axioms.sparkSession
    framed = [(-2, i, x) for i, x in enumerate(head(o))] + [(1 << 62, 0, ")")]
    edge = spark.createDataFrame([(a * 1_000_000 + i if a < 0 else a, x) for a, i, x in framed], "idx long, line string")
    body = o.axioms.select("idx", abbreviated(F.col("canon" if canonical else "text"), o.prefixes).alias("line"))
    edge.unionByName(body).repartitionByRange("idx").sortWithinPartitions("idx").select("line").write.text(path)


def formatted(o: Ontology) -> Ontology:
    """Canonical axioms in the order of their text."""
    return o.rewrite(lambda df: ranked(df.withColumn("text", F.col("canon")), "text", "idx"))


