"""Turtle: a parser and a writer. parse() gives triples in the order of the text, which is what stands for order wherever a graph needs one.

Terms are (value, kind, datatype, language), kinds iri, literal, bnode. Blank nodes are named b1, b2, ... in the order of the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from graphloom.functions.vocab import PREFIXES, RDF, XSD
from graphloom.session import give_back, ship

#: Triples, and characters of graphs, that leave a worker at once.
AT_ONCE, TEXT_AT_ONCE = 10_000, 2 << 20

_TOKEN = re.compile(
    r"""(?P<ws>\s+|\#[^\n]*)
    |(?P<iri><[^<>"{}|^`\\\x00-\x20]*(?:\\[uU][0-9A-Fa-f]+[^<>"{}|^`\\\x00-\x20]*)*>)
    |(?P<long>\"\"\"(?:(?:\"|\"\")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
    |(?P<str>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<dt>\^\^)
    |(?P<bnode>_:[\w\-·]+(?:\.+[\w\-·]+)*)
    |(?P<num>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<name>(?:[^\W\d_][\w\-]*(?:\.[\w\-]+)*)?:(?:(?:[\w:\-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w:\-.]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:\-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
    |(?P<word>[A-Za-z]+)
    |(?P<punct>[.;,\[\]()])""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_CHAR = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}
TRIPLE_TYPE = "array<struct<triple_ord:bigint,s:string,s_kind:string,p:string,o:string,o_kind:string,o_dt:string,o_lang:string>>"


class TurtleError(ValueError):
    pass


def _unescape(s: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _CHAR.get(m[3], m[3]), s)


END = ("end", "")


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    """Kinds and texts of the tokens, one at a time: all of a large graph's would take many times its bytes."""
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise TurtleError(f"unreadable at {at}: {text[at : at + 30]!r}")
        if m.lastgroup != "ws":
            yield m.lastgroup, m.group()
        at = m.end()


class Parser:
    def __init__(self, text: str, base: str = "", prefixes: dict[str, str] | None = None, tag: str = ""):
        self.tokens = _tokens(text)
        self.ahead = next(self.tokens, END)
        self.base, self.tag, self.prefixes = base, tag, dict(PREFIXES if prefixes is None else prefixes)
        self.named: dict[str, str] = {}
        self.blanks = 0
        self.triples: list[tuple] = []

    def peek(self) -> tuple[str, str]:
        return self.ahead

    def next(self, want: str | None = None) -> tuple[str, str]:
        t = self.peek()
        if want is not None and t[1] != want:
            raise TurtleError(f"{want!r} expected, not {t[1]!r}")
        self.ahead = next(self.tokens, END)
        return t

    def blank(self, label: str | None = None) -> tuple:
        if label is None or label not in self.named:
            self.blanks += 1
            name = f"_:{self.tag}b{self.blanks}"
            if label is None:
                return name, "bnode", None, None
            self.named[label] = name
        return self.named[label], "bnode", None, None

    def iri(self) -> str:
        kind, t = self.next()
        if kind == "iri":
            return urljoin(self.base, _unescape(t[1:-1])) if self.base else _unescape(t[1:-1])
        if kind == "name":
            prefix, _, local = t.partition(":")
            if prefix not in self.prefixes:
                raise TurtleError(f"no such prefix: {prefix!r}")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise TurtleError(f"an IRI expected, not {t!r}")

    def parse(self) -> list[tuple]:
        while self.peek()[0] != "end":
            kind, t = self.peek()
            word = t.lstrip("@").lower()
            if kind in ("lang", "word") and word in ("prefix", "base"):
                self.next()
                if word == "prefix":
                    name = self.next()
                    if name[0] != "name" or not name[1].endswith(":"):
                        raise TurtleError(f"a prefix expected, not {name[1]!r}")
                    self.prefixes[name[1][:-1]] = self.iri()
                else:
                    self.base = self.iri()
                if kind == "lang":
                    self.next(".")
                continue
            if t == "[":
                s = self.property_list()
                if self.peek()[1] != ".":
                    self.predicates(s)
            else:
                self.predicates(self.subject())
            self.next(".")
        return self.triples

    def subject(self) -> tuple:
        kind, t = self.peek()
        if t == "(":
            return self.collection()
        if kind == "bnode":
            self.next()
            return self.blank(t)
        return self.iri(), "iri", None, None

    def predicates(self, s: tuple) -> None:
        while True:
            if self.peek()[1] == "a" and self.peek()[0] == "word":
                self.next()
                p = RDF + "type"
            else:
                p = self.iri()
            while True:
                self.emit(s, p, self.object())
                if self.peek()[1] != ",":
                    break
                self.next()
            if self.peek()[1] != ";":
                return
            while self.peek()[1] == ";":
                self.next()
            if self.peek()[1] in (".", "]"):
                return

    def emit(self, s: tuple, p: str, o: tuple) -> None:
        self.triples.append((s[0], s[1], p, *o))

    def object(self) -> tuple:
        kind, t = self.peek()
        if t == "[" and kind == "punct":
            return self.property_list()
        if t == "(" and kind == "punct":
            return self.collection()
        if kind == "bnode":
            self.next()
            return self.blank(t)
        if kind in ("str", "long"):
            self.next()
            value = _unescape(t[3:-3] if kind == "long" else t[1:-1])
            if self.peek()[0] == "lang":
                return value, "literal", None, self.next()[1][1:].lower()
            if self.peek()[0] == "dt":
                self.next()
                return value, "literal", self.iri(), None
            return value, "literal", None, None
        if kind == "num":
            self.next()
            return t, "literal", XSD + ("double" if "e" in t.lower() else "decimal" if "." in t else "integer"), None
        if kind == "word" and t in ("true", "false"):
            self.next()
            return t, "literal", XSD + "boolean", None
        return self.iri(), "iri", None, None

    def property_list(self) -> tuple:
        self.next("[")
        s = self.blank()
        if self.peek()[1] != "]":
            self.predicates(s)
        self.next("]")
        return s

    def collection(self) -> tuple:
        self.next("(")
        items = []
        while self.peek()[1] != ")":
            items.append(self.object())
        self.next(")")
        nil = (RDF + "nil", "iri", None, None)
        if not items:
            return nil
        nodes = [self.blank() for _ in items]
        for node, item, after in zip(nodes, items, [*nodes[1:], nil], strict=True):
            self.emit(node, RDF + "first", item)
            self.emit(node, RDF + "rest", after)
        return nodes[0]


def parse(text: str, escapes: bool = False, tag: str = "") -> list[tuple]:
    """Distinct triples (s, s_kind, p, o, o_kind, o_dt, o_lang) in order. escapes: first expand backslash escapes of the whole text
    as Latin-1, for texts that a model or a state file quotes twice. tag: in the names of blank nodes."""
    if escapes:
        text = text.encode().decode("unicode_escape")
    return list(dict.fromkeys(Parser(text, tag=tag).parse()))


def _quoted(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'


def render(triples: Iterable[tuple], prefixes: dict[str, str] | None = None) -> str:
    """Turtle of triples, ordered by subject, predicate, object."""
    prefixes = dict(PREFIXES if prefixes is None else prefixes)
    used: set[str] = set()

    def iri(x: str) -> str:
        for p, u in prefixes.items():
            if x.startswith(u) and re.fullmatch(r"[A-Za-z_][\w\-]*", x[len(u) :], re.A):
                used.add(p)
                return f"{p}:{x[len(u) :]}"
        return "<" + re.sub(r'[<>"{}|^`\\\x00-\x20]', lambda m: f"\\u{ord(m[0]):04X}", x) + ">"

    def term(v: str, kind: str, dt: str | None, lang: str | None) -> str:
        if kind == "literal":
            return _quoted(v) + (f"@{lang}" if lang else f"^^{iri(dt)}" if dt else "")
        return v if kind == "bnode" else iri(v)

    of: dict[tuple, dict[str, set[str]]] = {}
    for s, sk, p, o, ok, dt, lang in triples:
        of.setdefault((s, sk), {}).setdefault(p, set()).add(term(o, ok, dt, lang))
    body = []
    for (s, sk), ps in sorted(of.items()):
        lines = [f"    {'a' if p == RDF + 'type' else iri(p)} {', '.join(sorted(os))}" for p, os in sorted(ps.items())]
        body.append(term(s, sk, None, None) + "\n" + " ;\n".join(lines) + " .\n")
    head = "".join(f"@prefix {p}: <{prefixes[p]}> .\n" for p in sorted(used))
    return head + ("\n" if head else "") + "\n".join(body)


def _read(t: str | None, escapes: bool) -> list[tuple] | None:
    try:
        return None if t is None else [(i, *x) for i, x in enumerate(parse(t, escapes, "g" + hashlib.sha256(t.encode()).hexdigest()[:12]))]
    except (TurtleError, UnicodeDecodeError):
        return None


def parsed(text: Column, escapes: bool = False) -> Column:
    """Triples of a Turtle column; null where it can't be read. Blank nodes are named by the text too, so those of different graphs stay apart."""
    return F.udf(lambda t: _read(t, escapes), TRIPLE_TYPE, useArrow=True)(text)


def triples_of(graphs: DataFrame, text: str, escapes: bool = False) -> DataFrame:
    """The triples of parsed(), a row for each, beside the other columns. A worker holds one graph at a time, and sends AT_ONCE rows."""
    ship(graphs.sparkSession)
    keys = [c for c in graphs.columns if c != text]
    fields = DataType.fromDDL(TRIPLE_TYPE).elementType.fields
    kinds = pa.struct([(f.name, pa.int64() if f.name == "triple_ord" else pa.string()) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, rows = [], []
            for i, t in enumerate(b.column(text)):
                found = _read(t.as_py(), escapes) or []
                for a in range(0, len(found), AT_ONCE):
                    rows += found[a : a + AT_ONCE]
                    of += [i] * (len(rows) - len(of))
                    if len(rows) >= AT_ONCE:
                        yield out(b, of, rows)
                        of, rows = [], []
                found = None
            if rows:
                yield out(b, of, rows)
            b = t = rows = None
            give_back()

    def out(b: pa.RecordBatch, of: list[int], rows: list[tuple]) -> pa.RecordBatch:
        at = pa.array(of, pa.int64())
        return pa.record_batch([*(b.column(k).take(at) for k in keys), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True))], names=[*keys, *(f.name for f in kinds)])

    return graphs.mapInArrow(run, StructType([*(graphs.schema[k] for k in keys), *fields]))


def rendered(triples: DataFrame, *keys: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    """A row of keys and turtle for each graph; prefixes are known beside those that every text has. A worker renders one graph at a time."""
    ship(triples.sparkSession)
    known = PREFIXES | (prefixes or {})
    cols = ("s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, texts, size = 0, [], 0
            for i, graph in enumerate(b.column("t")):
                texts.append(render(zip(*(c.to_pylist() for c in graph.values.flatten()), strict=True), known))
                size += len(texts[-1])
                if size >= TEXT_AT_ONCE or i == b.num_rows - 1:
                    yield pa.record_batch([*(b.column(k).slice(first, len(texts)) for k in keys), pa.array(texts, pa.string())], names=[*keys, "turtle"])
                    first, texts, size = i + 1, [], 0
            b = graph = None
            give_back()

    of = triples.groupBy(*keys).agg(F.collect_set(F.struct(*(F.coalesce(c, F.lit("")).alias(c) if c[1:] not in ("_dt", "_lang") else F.col(c) for c in cols))).alias("t"))
    return of.mapInArrow(run, StructType([*(of.schema[k] for k in keys), StructField("turtle", StringType())]))
