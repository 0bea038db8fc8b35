"""Turtle files: a reader that gives triples or says where and why a text is none, and a writer."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.names import fresh
from loomgraph.sources.named_files import register

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
#: The prefixes of exported files; a vocabulary of one's own is added by the caller.
PREFIXES = {
    "schema": "https://schema.org/",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "xsd": XSD,
    "prov": "http://www.w3.org/ns/prov#",
    "repro": "https://w3id.org/reproduceme#",
    "pplan": "http://purl.org/net/p-plan#",
    "dcterms": "http://purl.org/dc/terms/",
}
DEEPEST = 200  # nested lists and blank nodes

_NAME = r"[^\W_](?:[\w.\-·]*[\w\-·])?"
_LOCAL = r"(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%])(?:(?:[\w:.\-·]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%])*(?:[\w:\-·]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%]))?"
_TOKEN = re.compile(
    "|".join(
        f"(?P<{name}>{rule})"
        for name, rule in (
            ("skip", r"(?:\s+|#[^\n\r]*)+"),
            ("iri", r"<(?:[^\x00-\x20<>\"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>"),
            ("text", r'"""(?:"{0,2}(?:[^"\\]|\\.))*"""|\'\'\'(?:\'{0,2}(?:[^\'\\]|\\.))*\'\'\'|"(?:[^"\\\n\r]|\\.)*"|\'(?:[^\'\\\n\r]|\\.)*\''),
            ("blank", r"_:[\w](?:[\w.\-·]*[\w\-·])?"),
            ("prefixed", rf"(?:{_NAME})?:(?:{_LOCAL})?"),
            ("directive", r"@prefix\b|@base\b"),
            ("language", r"@[A-Za-z]+(?:-[A-Za-z0-9]+)*"),
            ("number", r"[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+)"),
            ("word", r"[A-Za-z]+"),
            ("mark", r"\^\^|[.;,\[\]()]"),
        )
    ),
    re.S,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_SHORT = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


class TurtleError(ValueError):
    """line, reason."""

    def __init__(self, line: int, reason: str):
        super().__init__(f"line {line}: {reason}")
        self.line, self.reason = line, reason


class _Reader:
    def __init__(self, text: str):
        self.text, self.at, self.base = text, 0, ""
        self.prefixes: dict[str, str] = {}
        self.triples: list[tuple[str, str, str]] = []
        self.made = self.depth = 0
        self.move()

    def fail(self, reason: str):
        raise TurtleError(self.text.count("\n", 0, self.begin) + 1, reason)

    def move(self):
        """The next token: kind and value."""
        while True:
            self.begin = self.at
            if self.at >= len(self.text):
                self.kind, self.value = "end", ""
                return
            m = _TOKEN.match(self.text, self.at)
            if m is None:
                self.fail(f"unexpected {self.text[self.at : self.at + 20]!r}")
            self.at = m.end()
            if m.lastgroup != "skip":
                self.kind, self.value = m.lastgroup, m[0]
                return

    def take(self, value: str):
        if self.value != value or self.kind not in ("mark", "word"):
            self.fail(f"{value!r} expected, not {self.value!r}" if self.kind != "end" else f"{value!r} expected at the end")
        self.move()

    def unescape(self, raw: str, short: bool) -> str:
        def one(m):
            if m[3] is not None and not (short and m[3] in _SHORT):
                self.fail(f"bad escape \\{m[3]}")
            if m[3] is not None:
                return _SHORT[m[3]]
            code = int(m[1] or m[2], 16)
            if code > 0x10FFFF or 0xD800 <= code < 0xE000:
                self.fail("bad code point")
            return chr(code)

        return _ESCAPE.sub(one, raw) if "\\" in raw else raw

    def iri(self) -> str:
        if self.kind == "iri":
            got = self.unescape(self.value[1:-1], False)
            got = urljoin(self.base, got) if self.base else got
        elif self.kind == "prefixed":
            prefix, _, local = self.value.partition(":")
            if prefix not in self.prefixes:
                self.fail(f"prefix {prefix + ':'!r} isn't declared")
            got = self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        else:
            self.fail(f"an IRI expected, not {self.value!r}")
        self.move()
        return f"<{got}>"

    def blank(self) -> str:
        self.made += 1
        return f"_:g{self.made}"

    def document(self):
        while self.kind != "end":
            if self.kind == "directive" or (self.kind == "word" and self.value.lower() in ("prefix", "base")):
                self.directive()
            else:
                self.statement()

    def directive(self):
        word, dotted = self.value.lstrip("@").lower(), self.kind == "directive"
        self.move()
        name = None
        if word == "prefix":
            if self.kind != "prefixed" or not self.value.endswith(":") or self.value.count(":") != 1:
                self.fail(f"a prefix expected, not {self.value!r}")
            name = self.value[:-1]
            self.move()
        if self.kind != "iri":
            self.fail(f"an IRI expected, not {self.value!r}")
        target = self.iri()[1:-1]
        if name is None:
            self.base = target
        else:
            self.prefixes[name] = target
        if dotted:
            self.take(".")

    def statement(self):
        if self.value == "[" and self.kind == "mark":
            subject = self.node()
            if self.value != ".":
                self.properties(subject)
        else:
            if self.kind in ("text", "number"):
                self.fail("a literal can't be a subject")
            subject = self.node()
            self.properties(subject)
        self.take(".")

    def properties(self, subject: str):
        while True:
            if self.kind == "word" and self.value == "a":
                predicate = f"<{RDF}type>"
                self.move()
            else:
                predicate = self.iri()
            while True:
                self.triples.append((subject, predicate, self.node()))
                if self.value != "," or self.kind != "mark":
                    break
                self.move()
            if self.value != ";" or self.kind != "mark":
                return
            while self.value == ";" and self.kind == "mark":
                self.move()
            if self.kind == "mark" and self.value in (".", "]"):
                return

    def node(self) -> str:
        """A subject or an object."""
        if self.kind in ("iri", "prefixed"):
            return self.iri()
        if self.kind == "blank":
            name = "_:l" + self.value[2:]
            self.move()
            return name
        if self.kind == "text":
            return self.literal()
        if self.kind == "number":
            raw = self.value
            self.move()
            return f'"{raw}"^^<{XSD}{"double" if "e" in raw.lower() else "decimal" if "." in raw else "integer"}>'
        if self.kind == "word" and self.value in ("true", "false"):
            raw = self.value
            self.move()
            return f'"{raw}"^^<{XSD}boolean>'
        if self.kind == "mark" and self.value in "[(":
            self.depth += 1
            if self.depth > DEEPEST:
                self.fail(f"nested deeper than {DEEPEST}")
            got = self.bracket() if self.value == "[" else self.list()
            self.depth -= 1
            return got
        self.fail(f"a term expected, not {self.value!r}" if self.kind != "end" else "a term expected at the end")

    def bracket(self) -> str:
        self.move()
        name = self.blank()
        if self.value != "]":
            self.properties(name)
        self.take("]")
        return name

    def list(self) -> str:
        self.move()
        items = []
        while not (self.kind == "mark" and self.value == ")"):
            items.append(self.node())
        self.move()
        head = f"<{RDF}nil>"
        for item in reversed(items):
            cell = self.blank()
            self.triples += [(cell, f"<{RDF}first>", item), (cell, f"<{RDF}rest>", head)]
            head = cell
        return head

    def literal(self) -> str:
        raw = self.value
        raw = raw[3:-3] if raw[:3] in ('"""', "'''") and len(raw) >= 6 else raw[1:-1]
        text = quoted(self.unescape(raw, True))
        self.move()
        if self.kind == "language":
            text += self.value.lower()
            self.move()
        elif self.kind == "mark" and self.value == "^^":
            self.move()
            text += f"^^{self.iri()}"
        return text


def quoted(text: str) -> str:
    """A text as a literal in its one canonical form."""
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'


def parse(text: str | None) -> list[tuple[str, str, str]]:
    """The triples of a Turtle text as full terms, in order; TurtleError where it is none. Null is an empty text.

    Blank nodes are named within the text: those it labels _:l and the label, the others _:g and a number.
    """
    reader = _Reader(text or "")
    reader.document()
    return reader.triples


def read(texts: DataFrame, text: str = "turtle") -> DataFrame:
    """The other columns with s, p, o and ord (from 0) for each triple, or one row with line and error for a bad text.

    A bad text gives none of its triples, an empty or null one no row. A text is read whole, in one task. Where a name
    clashes, the added column gets an underscore.
    """
    rest = [c for c in texts.columns if c != text]
    kept = texts.select(*[F.col(f"`{c}`") for c in rest])
    names = fresh(kept, "ord", "s", "p", "o", "line", "error")
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []

            def out():
                cols = [b.column(i).take(pa.array(at, pa.int64())) for i in range(1, b.num_columns)]
                return pa.RecordBatch.from_arrays([*cols, *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], [*rest, *names])

            for i, value in enumerate(b.column(0)):
                try:
                    found = [(j, *t, None, None) for j, t in enumerate(parse(value.as_py()))]
                except TurtleError as e:
                    found = [(None, None, None, None, e.line, e.reason)]
                at += [i] * len(found)
                rows += found
                if len(rows) >= 20_000:
                    yield out()
                    at, rows = [], []
            if rows:
                yield out()

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"`{n}` {k}" for n, k in zip(names, ("bigint", "string", "string", "string", "int", "string"), strict=True)]
    return texts.select(F.col(f"`{text}`").cast("string"), *[F.col(f"`{c}`") for c in rest]).mapInArrow(run, ", ".join(fields))


@F.udtf(returnType="ord int, s string, p string, o string, line int, error string")
class turtle_triples:
    """read() for SQL, once registered: `FROM files, LATERAL turtle_triples(value)`."""

    def eval(self, text: str):
        try:
            for i, t in enumerate(parse(text)):
                yield (i, *t, None, None)
        except TurtleError as e:
            yield None, None, None, None, e.line, e.reason


def is_valid(text: Column) -> Column:
    """Whether a text is Turtle; null counts as an empty one."""

    @F.pandas_udf("boolean")
    def run(x):
        def one(v):
            try:
                parse(v)
            except TurtleError:
                return False
            return True

        return x.map(one).astype(bool)

    return run(text)


def header(title: Column, source: Column, license: Column, at: Column, prefixes: dict[str, str] = PREFIXES) -> Column:
    """What an exported file begins with: comments, prefixes and its base."""
    lines = [F.concat(F.lit("# RDF Knowledge Graph: "), title), F.concat(F.lit("# Source: "), source), F.concat(F.lit("# License: "), license), F.concat(F.lit("# Generated: "), at), F.lit("")]
    lines += [F.lit(f"@prefix {p}: <{ns}> .") for p, ns in prefixes.items()]
    return F.concat_ws("\n", *lines, F.concat(F.lit("@base <"), source, F.lit("> .\n\n\n# === Triples ===\n\n")))


def save(files: DataFrame, by: str, path: str) -> None:
    """files: by, value. A folder for each file, with its text; folders of others stay."""
    spark = files.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        files.select(by, "value").write.mode("overwrite").partitionBy(by).text(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def write_files(files: DataFrame, folder: str, index: str) -> None:
    """files: path, value. One .ttl a row below a folder, all of them or none, listed in an index for named_files.read_named()."""
    register(files.sparkSession)
    files.write.format("named_files").mode("append").option("suffix", ".ttl").option("index", index).save(folder)
