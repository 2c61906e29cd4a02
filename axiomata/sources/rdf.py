"""RDF documents: Turtle and RDF/XML to rows of triples, parsed on executors, a document a task.

A triple is (doc, pos, s, p, o): ``s`` is struct(tag, text), ``o`` struct(tag,
text, datatype, lang); tags are iri, blank and literal. Labels of blank nodes are
unique to their document.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axiomata.functions.terms import RDF, XSD
from axiomata.plans.fixpoint import fixpoint

SUBJECT = T.StructType([T.StructField("tag", T.StringType()), T.StructField("text", T.StringType())])
OBJECT = T.StructType([*SUBJECT.fields, T.StructField("datatype", T.StringType()), T.StructField("lang", T.StringType())])
TRIPLE = T.StructType([T.StructField("doc", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("s", SUBJECT), T.StructField("p", T.StringType()), T.StructField("o", OBJECT)])
Object = tuple[str, str, str | None, str | None]
FIRST, REST, NIL, TYPE = f"{RDF}first", f"{RDF}rest", f"{RDF}nil", f"{RDF}type"


class RdfError(ValueError):
    """Malformed RDF; the message starts with line and column for Turtle."""


def iri(text: str) -> Object:
    return ("iri", text, None, None)


def blank(label: str) -> Object:
    return ("blank", label, None, None)


def literal(value: str, datatype: str = f"{XSD}string", lang: str | None = None) -> Object:
    return ("literal", value, f"{RDF}langString" if lang else datatype, lang)


class _Sink:
    """Triples of one document with fresh blank nodes."""

    def __init__(self):
        self.triples: list[tuple[Object, str, Object]] = []
        self.labels: dict[str, str] = {}
        self.fresh = 0

    def node(self, label: str | None = None) -> Object:
        if label is not None and label in self.labels:
            return blank(self.labels[label])
        own = f"b{self.fresh}"
        self.fresh += 1
        if label is not None:
            self.labels[label] = own
        return blank(own)

    def emit(self, s: Object, p: str, o: Object) -> None:
        self.triples.append((s, p, o))

    def chain(self, items: list[Object]) -> Object:
        """Items as a first/rest list; the head."""
        cells = [self.node() for _ in items]
        for i, x in enumerate(items):
            self.emit(cells[i], FIRST, x)
            self.emit(cells[i], REST, cells[i + 1] if i + 1 < len(cells) else iri(NIL))
        return cells[0] if cells else iri(NIL)


_NAME = "A-Za-z0-9_\\-·\u0080-\U0010ffff"
_TTL = re.compile(
    rf"""(?P<space>[ \t\r\n]+|\#[^\n]*)|(?P<iri><[^<>"{{}}|^`\\\s]*(?:\\u[0-9A-Fa-f]{{4}}[^<>"{{}}|^`\\\s]*|\\U[0-9A-Fa-f]{{8}}[^<>"{{}}|^`\\\s]*)*>)
    |(?P<long>\"\"\"(?:(?:"|"")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')|(?P<short>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<caret>\^\^)|(?P<node>_:[{_NAME}]+(?:\.+[{_NAME}]+)*)
    |(?P<number>[+-]?(?:[0-9]+\.[0-9]*[eE][+-]?[0-9]+|\.?[0-9]+[eE][+-]?[0-9]+|[0-9]*\.[0-9]+|[0-9]+))
    |(?P<name>(?:[A-Za-z\u0080-\U0010ffff](?:[{_NAME}.]*[{_NAME}])?)?:(?:(?:[{_NAME}:]|%[0-9A-Fa-f]{{2}}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[{_NAME}:.]|%[0-9A-Fa-f]{{2}}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[{_NAME}:]|%[0-9A-Fa-f]{{2}}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
    |(?P<word>[A-Za-z]+)|(?P<mark>[.;,\[\]()])""",
    re.X | re.S,
)
_CONTROL = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


class _Turtle:
    def __init__(self, text: str, base: str):
        self.text, self.base, self.prefixes, self.sink = text, base, {}, _Sink()
        self.tokens: list[tuple[str, str, int]] = []
        at = 0
        while at < len(text):
            m = _TTL.match(text, at)
            if not m:
                self.error(at, f"unexpected {text[at]!r}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0], at))
            at = m.end()
        self.tokens.append(("end", "", len(text)))
        self.at = 0

    def error(self, at: int, what: str):
        line = self.text.count("\n", 0, at) + 1
        raise RdfError(f"{line}:{at - (self.text.rfind(chr(10), 0, at) + 1) + 1}: {what}")

    def peek(self) -> tuple[str, str, int]:
        return self.tokens[self.at]

    def next(self) -> tuple[str, str, int]:
        self.at += 1
        return self.tokens[self.at - 1]

    def mark(self, c: str) -> bool:
        if self.peek()[:2] == ("mark", c):
            self.at += 1
            return True
        return False

    def need(self, c: str) -> None:
        if not self.mark(c):
            self.error(self.peek()[2], f"{c!r} expected, found {self.peek()[1]!r}")

    def unescape(self, raw: str, at: int) -> str:
        def one(m: re.Match) -> str:
            if m[1]:
                return chr(int(m[1], 16))
            if m[2]:
                return chr(int(m[2], 16))
            if m[3] not in _CONTROL:
                self.error(at, f"escape \\{m[3]} is not known")
            return _CONTROL[m[3]]

        return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", one, raw, flags=re.S)

    def resolved(self, raw: str, at: int) -> str:
        ref = self.unescape(raw, at)
        if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", ref):
            return ref
        if not self.base:
            return ref
        if ref == "":
            return self.base.partition("#")[0]
        return urljoin(self.base, ref) if ref[0] != "#" else self.base.partition("#")[0] + ref

    def document(self) -> None:
        while self.peek()[0] != "end":
            kind, value, at = self.peek()
            if kind == "lang" and value in ("@prefix", "@base"):
                self.at += 1
                self.directive(value[1:])
                self.need(".")
            elif kind == "word" and value.lower() in ("prefix", "base"):
                self.at += 1
                self.directive(value.lower())
            else:
                self.statement()

    def directive(self, what: str) -> None:
        name = ""
        if what == "prefix":
            kind, name, at = self.next()
            if kind != "name" or not name.endswith(":"):
                self.error(at, "a prefix expected")
        kind, value, at = self.next()
        if kind != "iri":
            self.error(at, "an IRI expected")
        target = self.resolved(value[1:-1], at)
        if what == "prefix":
            self.prefixes[name[:-1]] = target
        else:
            self.base = target

    def statement(self) -> None:
        kind, value, at = self.peek()
        if (kind, value) == ("mark", "["):
            s = self.inner()
            if self.mark("."):
                return
        else:
            s = self.term()
            if s[0] == "literal":
                self.error(at, "a literal cannot be a subject")
        self.properties(s)
        self.need(".")

    def properties(self, s: Object) -> None:
        while True:
            kind, value, at = self.peek()
            if kind == "word" and value in ("a", "A"):
                self.at += 1
                p = TYPE
            else:
                verb = self.term()
                if verb[0] != "iri":
                    self.error(at, "a predicate expected")
                p = verb[1]
            while True:
                self.sink.emit(s, p, self.term())
                if not self.mark(","):
                    break
            if not self.mark(";"):
                return
            while self.mark(";"):
                pass
            if self.peek()[:2] in (("mark", "."), ("mark", "]"), ("end", "")):
                return

    def inner(self) -> Object:
        self.need("[")
        node = self.sink.node()
        if not self.mark("]"):
            self.properties(node)
            self.need("]")
        return node

    def term(self) -> Object:
        kind, value, at = self.peek()
        if (kind, value) == ("mark", "["):
            return self.inner()
        self.at += 1
        if (kind, value) == ("mark", "("):
            items = []
            while not self.mark(")"):
                if self.peek()[0] == "end":
                    self.error(self.peek()[2], "')' expected")
                items.append(self.term())
            return self.sink.chain(items)
        if kind == "iri":
            return iri(self.resolved(value[1:-1], at))
        if kind == "node":
            return self.sink.node(value[2:])
        if kind == "name":
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                self.error(at, f"prefix {prefix!r} is not declared")
            return iri(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))
        if kind in ("short", "long"):
            cut = 3 if kind == "long" else 1
            text = self.unescape(value[cut:-cut], at)
            if self.peek()[0] == "lang":
                return literal(text, lang=self.next()[1][1:])
            if self.peek()[0] == "caret":
                self.at += 1
                own = self.term()
                if own[0] != "iri":
                    self.error(at, "a datatype expected")
                return literal(text, own[1])
            return literal(text)
        if kind == "number":
            shape = "double" if "e" in value.lower() else "decimal" if "." in value else "integer"
            return literal(value, f"{XSD}{shape}")
        if kind == "word" and value in ("true", "false"):
            return literal(value, f"{XSD}boolean")
        self.error(at, f"a term expected, found {value!r}")


def turtle(text: str, base: str = "") -> tuple[list[tuple[Object, str, Object]], dict[str, str]]:
    """Triples and prefixes of a Turtle document; raises :class:`RdfError`."""
    p = _Turtle(text, base)
    p.document()
    return p.sink.triples, p.prefixes


_XML = "{http://www.w3.org/XML/1998/namespace}"


def rdf_xml(text: str, base: str = "") -> tuple[list[tuple[Object, str, Object]], dict[str, str]]:
    """Triples and prefixes of a striped RDF/XML document; raises :class:`RdfError`."""
    import io

    prefixes: dict[str, str] = {}
    root = None
    try:
        for event, x in ET.iterparse(io.BytesIO(text.encode()), events=("start-ns", "end")):
            if event == "start-ns":
                prefixes.setdefault(x[0] or "", x[1])
            else:
                root = x
    except ET.ParseError as e:
        raise RdfError(str(e)) from None
    sink = _Sink()
    R = f"{{{RDF}}}"

    def name(tag: str) -> str:
        return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag

    def scope(x: ET.Element, env: tuple[str, str | None]) -> tuple[str, str | None]:
        lang = x.get(f"{_XML}lang", env[1])
        return urljoin(env[0], x.get(f"{_XML}base", env[0])), lang or None

    def ref(env, text: str) -> Object:
        return iri(env[0].partition("#")[0] if text == "" else urljoin(env[0], text) if env[0] else text)

    def subject(x: ET.Element, env) -> Object:
        if x.get(f"{R}about") is not None:
            return ref(env, x.get(f"{R}about"))
        if x.get(f"{R}ID") is not None:
            return ref(env, f"#{x.get(f'{R}ID')}")
        return sink.node(x.get(f"{R}nodeID"))

    def attributes(x: ET.Element, s: Object, env) -> bool:
        found = False
        for k, v in x.attrib.items():
            if k.startswith(_XML) or not k.startswith("{") or k in {f"{R}{n}" for n in ("ID", "about", "datatype", "nodeID", "parseType", "resource")}:
                continue
            found = True
            if k == f"{R}type":
                sink.emit(s, TYPE, ref(env, v))
            else:
                sink.emit(s, name(k), literal(v, lang=env[1]))
        return found

    def node(x: ET.Element, env) -> Object:
        env = scope(x, env)
        s = subject(x, env)
        if x.tag != f"{R}Description":
            sink.emit(s, TYPE, iri(name(x.tag)))
        attributes(x, s, env)
        numbered = 0
        for child in x:
            if child.tag == f"{R}li":
                numbered += 1
            prop(child, s, env, numbered)
        return s

    def prop(x: ET.Element, s: Object, env, numbered: int) -> None:
        env = scope(x, env)
        p = f"{RDF}_{numbered}" if x.tag == f"{R}li" else name(x.tag)
        how = x.get(f"{R}parseType")
        if how == "Resource":
            o = sink.node()
            sink.emit(s, p, o)
            count = 0
            for child in x:
                count += child.tag == f"{R}li"
                prop(child, o, env, count)
        elif how == "Collection":
            sink.emit(s, p, sink.chain([node(child, env) for child in x]))
        elif how is not None:
            raise RdfError(f"parseType {how} is not supported")
        elif x.get(f"{R}resource") is not None or x.get(f"{R}nodeID") is not None:
            o = ref(env, x.get(f"{R}resource")) if x.get(f"{R}resource") is not None else sink.node(x.get(f"{R}nodeID"))
            sink.emit(s, p, o)
            attributes(x, o, env)
        elif len(x):
            if len(x) > 1:
                raise RdfError(f"{p} holds more than one node")
            sink.emit(s, p, node(x[0], env))
        elif x.get(f"{R}datatype") is None and not (x.text or "").strip() and any(k.startswith("{") and not k.startswith((_XML, R)) for k in x.attrib):
            o = sink.node()
            sink.emit(s, p, o)
            attributes(x, o, env)
        else:
            value = x.text or ""
            kind = x.get(f"{R}datatype")
            sink.emit(s, p, literal(value, ref(env, kind)[1]) if kind is not None else literal(value, lang=env[1]))

    start = (base, None)
    if root is None:
        raise RdfError("no element")
    if root.tag == f"{R}RDF":
        env = scope(root, start)
        for child in root:
            node(child, env)
    else:
        node(root, start)
    return sink.triples, prefixes


PARSERS: dict[str, Callable] = {"turtle": turtle, "xml": rdf_xml}


def parse_column(df: DataFrame, key: str, text: str, syntax: str = "turtle", base: str = "") -> DataFrame:
    """Triples of the documents in a column; a malformed one raises :class:`RdfError` with its key."""
    parse = PARSERS[syntax]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dic = lambda names, values: dict(zip(names, values))
        for frame in frames:
            for doc, source in zip(frame["doc"], frame["value"]):
                try:
                    triples, _ = parse(source, base)
                except RdfError as e:
                    raise RdfError(f"{doc}: {e}") from None
                for at in range(0, len(triples), 5000):
                    part = triples[at : at + 5000]
                    yield pd.DataFrame({
                        "doc": [doc] * len(part), "pos": range(at, at + len(part)), "s": [dic(SUBJECT.names, s) for s, _, _ in part],
                        "p": [p for _, p, _ in part], "o": [dic(OBJECT.names, o) for _, _, o in part],
                    })

    return df.select(F.col(key).cast("string").alias("doc"), F.col(text).alias("value")).mapInPandas(run, TRIPLE)


def read(spark: SparkSession, path: str, syntax: str = "turtle", base: str = "") -> DataFrame:
    """Triples of all documents at ``path``; ``doc`` is the file."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc"), "value")
    return parse_column(texts, "doc", "value", syntax, base)


def ntriples(triples: DataFrame) -> DataFrame:
    """(doc, pos, line): the triples as text."""
    def term(c: str):
        x = F.col(c)
        esc = x["text"]
        for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            esc = F.replace(esc, F.lit(a), F.lit(b))
        out = F.when(x["tag"] == "iri", F.concat(F.lit("<"), x["text"], F.lit(">"))).when(x["tag"] == "blank", F.concat(F.lit("_:"), x["text"]))
        if c == "s":
            return out
        plain = F.concat(F.lit('"'), esc, F.lit('"'))
        return out.when(x["lang"].isNotNull(), F.concat(plain, F.lit("@"), x["lang"])).when(x["datatype"] == f"{XSD}string", plain).otherwise(F.concat(plain, F.lit("^^<"), x["datatype"], F.lit(">")))

    return triples.select("doc", "pos", F.concat(term("s"), F.lit(" <"), F.col("p"), F.lit("> "), term("o"), F.lit(" .")).alias("line"))


def objects(triples: DataFrame) -> DataFrame:
    """(doc, s, p, first): the first object of each subject and predicate."""
    return triples.groupBy("doc", "s", "p").agg(F.min_by("o", "pos").alias("first"))


def subjects(triples: DataFrame) -> DataFrame:
    """(doc, s, is_blank): distinct subjects; IRIs come before blank nodes when ordered by is_blank, s.text."""
    return triples.select("doc", "s", (F.col("s.tag") == "blank").alias("is_blank")).distinct()


def lists(triples: DataFrame) -> DataFrame:
    """(doc, head, items): every well-formed list that no other cell continues; cycles and gaps give none."""
    first = triples.filter(F.col("p") == FIRST).select("doc", F.col("s.text").alias("cell"), F.col("o").alias("item"))
    rest = triples.filter(F.col("p") == REST).select("doc", F.col("s.text").alias("cell"), F.col("o.text").alias("next"))
    inner = rest.select("doc", F.col("next").alias("cell"))
    heads = first.select("doc", "cell").join(inner, ["doc", "cell"], "left_anti").distinct()
    seed = heads.select("doc", F.col("cell").alias("head"), "cell", F.lit(0).alias("n"))
    step = lambda d, k, i: d.join(rest, ["doc", "cell"]).filter(F.col("next") != NIL).select("doc", "head", F.col("next").alias("cell"), (F.col("n") + 1).alias("n"))
    cells = fixpoint(seed, step, ["doc", "head", "cell"])
    whole = cells.join(first, ["doc", "cell"], "left").join(rest, ["doc", "cell"], "left")
    out = whole.groupBy("doc", "head").agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("x"), F.count("item").alias("items"), F.count("*").alias("cells"), F.max(F.col("next") == NIL).alias("ends"))
    return out.filter("items = cells and ends").select("doc", "head", F.transform("x", lambda i: i["item"]).alias("items"))
