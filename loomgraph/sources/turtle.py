"""A Spark data source of RDF in Turtle: spark.read.format("turtle"), df.write.format("turtle").

A file is a partition, as its prefixes hold from their place on and long literals may hold anything; it is
read through a buffer, so that a task holds a statement and not the file. Paths are those that pyarrow's file
systems open (file://, hdfs://, s3:// and so on). The reader knows prefixes and bases in both spellings,
predicate and object lists, blank nodes with and without labels, collections, all literal forms with language
or type, numbers and booleans, comments and escapes. Blank nodes get names that differ between files.
Statements of plain IRIs, names and literals without escapes are read many at once by patterns and Arrow
functions; all others go through the parser, one at a time.

Columns: s, p, o, o_kind (iri, blank or literal), o_type (a literal's datatype, or @ and its language; null
for plain ones). The writer puts the triples of consecutive equal subjects together, so triples sorted by
subject within partitions give short files, and a triple equal to the one before it is written once, as a
graph is a set; options prefix.<name> name namespaces.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urljoin

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "s string, p string, o string, o_kind string, o_type string"
RDF, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2001/XMLSchema#"
BUFFER, BATCH = 1 << 20, 10_000

_TOKEN = re.compile(
    r"""
    (?P<space>\s+|\#[^\n\r]*)
  | (?P<iri><(?:[^<>"{}|^`\\\x00-\x20]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
  | (?P<long>\"{3}(?:(?:"|"")?(?:[^"\\]|\\.))*\"{3}|'{3}(?:(?:'|'')?(?:[^'\\]|\\.))*'{3})
  | (?P<text>"(?!"")(?:[^"\\\n\r]|\\.)*"|'(?!'')(?:[^'\\\n\r]|\\.)*'|""(?!")|''(?!'))
  | (?P<directive>@(?:prefix|base)\b)
  | (?P<lang>@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)
  | (?P<blank>_:[\w](?:[\w.\-·]*[\w\-·])?)
  | (?P<number>[+-]?(?:\d+(?:\.\d*)?[eE][+-]?\d+|\.\d+(?:[eE][+-]?\d+)?|\d*\.\d+|\d+))
  | (?P<name>(?:[^\W\d_](?:[\w.\-·]*[\w\-·])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w:.\-·]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:\-·]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
  | (?P<word>[A-Za-z]+)
  | (?P<mark>\^\^|[.;,\[\]()])
    """,
    re.X | re.S,
)
# Statements of absolute IRIs, plain names and literals without escapes, each ended by a mark and white space.
_IRI, _NAME = r'<[A-Za-z][A-Za-z0-9+.\-]*+:[^<>"{}|^`\\\x00-\x20]*+>', r"(?:[A-Za-z][A-Za-z0-9_\-]*+)?:[A-Za-z_][A-Za-z0-9_\-]*+"
_OBJECT, _SUFFIX = rf'{_IRI}|{_NAME}|"(?!"")[^"\\\n\r]*+"', rf"(?:@[a-zA-Z]++(?:-[a-zA-Z0-9]++)*+|\^\^(?:{_IRI}|{_NAME}))?+"
_PAIR = rf"(?:a|{_IRI}|{_NAME})\s++(?:{_OBJECT}){_SUFFIX}\s*+"
_PLAIN = re.compile(rf"(?:\s*+(?:{_IRI}|{_NAME})\s++{_PAIR}(?:;(?=\s)\s*+{_PAIR})*+\.(?=\s))*+")
# A triple of what _PLAIN has found: a subject or the mark after the triple before opens it.
_TRIPLE = re.compile(rf"(?:;\s*+|\s*+({_IRI}|{_NAME})\s++)(a|{_IRI}|{_NAME})\s++({_OBJECT})({_SUFFIX})\s*+\.?")
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
# Escapes of literals.
_SIGNS = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


class TurtleError(ValueError):
    pass


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else _SIGNS.get(m[1], m[1]), text) if "\\" in text else text


class Tokens:
    """(kind, text) of the tokens; a token that may go on in the next piece waits for it. start: where the last one begins in text."""

    def __init__(self, pieces: Iterator[str]):
        self.pieces, self.text, self.at, self.start, self.more = pieces, "", 0, 0, True

    def next(self) -> tuple[str, str]:
        while True:
            m = _TOKEN.match(self.text, self.at) if self.at < len(self.text) else None
            # The longest mark to look ahead for is that of a long literal.
            if self.more and (m is None or m.end() + 3 > len(self.text)):
                piece = next(self.pieces, None)
                self.more = piece is not None
                self.text, self.at = self.text[self.at :] + (piece or ""), 0
                continue
            self.start = self.at
            if m is None:
                if self.at < len(self.text):
                    raise TurtleError(f"no token at {self.text[self.at : self.at + 40]!r}")
                return "end", ""
            self.at = m.end()
            if m.lastgroup != "space":
                return m.lastgroup, m[0]

    def plain(self) -> list[tuple[str, str, str, str]]:
        """Subject (or ''), predicate, object and suffix of the plain statements from the last token on, which are passed over."""
        end = _PLAIN.match(self.text, self.start).end()
        found = _TRIPLE.findall(self.text, self.start, end) if end > self.start else []
        if found:
            self.at = end
        return found


Term = tuple[str, str, str | None]


class Parser:
    """Triples of one document; a recursive descent over its tokens."""

    def __init__(self, pieces: Iterator[str], label: str, base: str = ""):
        self.tokens = Tokens(pieces)
        self.label, self.base, self.prefixes, self.made = label, base, {}, 0
        self.found: list[tuple[str, str, str, str, str | None]] = []
        self.step()

    def step(self) -> None:
        self.kind, self.text = self.tokens.next()

    def take(self, mark: str) -> None:
        if self.text != mark or self.kind != "mark":
            raise TurtleError(f"{mark!r} expected, {self.text!r} found")
        self.step()

    def at(self, mark: str) -> bool:
        return self.kind == "mark" and self.text == mark

    def triples(self) -> Iterator[tuple[str, str, str, str, str | None]]:
        for batch in self.batches():
            yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

    def batches(self) -> Iterator[pa.RecordBatch]:
        while self.kind != "end":
            if plain := self.tokens.plain():
                if self.found:
                    yield self.told()
                yield self.columns(plain)
                self.step()
                continue
            self.statement()
            if len(self.found) >= BATCH:
                yield self.told()
        if self.found:
            yield self.told()

    def told(self) -> pa.RecordBatch:
        out = _batch(self.found)
        self.found = []
        return out

    def columns(self, plain: list[tuple[str, str, str, str]]) -> pa.RecordBatch:
        """The triples of plain statements."""
        s, p, o, suffix = [pa.array(c, pa.string()) for c in zip(*plain, strict=True)]
        s = pc.fill_null_forward(pc.if_else(pc.equal(s, ""), pa.scalar(None, pa.string()), self.full(s)))
        literal = pc.starts_with(o, '"')
        inner = pc.utf8_slice_codeunits(o, 1, -1)
        o = pc.if_else(literal, inner, self.full(o, inner))
        kind = pc.if_else(literal, "literal", "iri")
        typed = _mapped(suffix, lambda x: None if not x else x if x[0] == "@" else self.named(x[2:]))
        return pa.RecordBatch.from_arrays([s, _mapped(p, lambda x: RDF + "type" if x == "a" else self.named(x)), o, kind, typed], ["s", "p", "o", "o_kind", "o_type"])

    def full(self, terms: pa.Array, inner: pa.Array | None = None) -> pa.Array:
        """Whole IRIs of plain IRIs and names; others stay."""
        whole = pc.starts_with(terms, "<")
        named = pc.and_not(pc.invert(whole), pc.or_(pc.equal(terms, ""), pc.starts_with(terms, '"')))
        out = pc.if_else(whole, pc.utf8_slice_codeunits(terms, 1, -1) if inner is None else inner, terms)
        return _replaced(out, named, terms, self.named)

    def named(self, text: str) -> str:
        """The IRI that a plain IRI or name stands for."""
        if text[0] == "<":
            return text[1:-1]
        prefix, local = text.split(":", 1)
        if prefix not in self.prefixes:
            raise TurtleError(f"prefix {prefix!r} is not defined")
        return self.prefixes[prefix] + local

    def statement(self) -> None:
        directive = self.text.lstrip("@").lower()
        if self.kind == "directive" or (self.kind == "word" and directive in ("prefix", "base")):
            old_style = self.kind == "directive"
            self.step()
            name = ""
            if directive == "prefix":
                if self.kind != "name" or not self.text.endswith(":"):
                    raise TurtleError(f"a prefix expected, {self.text!r} found")
                name = self.text[:-1]
                self.step()
            iri = self.iri()
            if directive == "prefix":
                self.prefixes[name] = iri
            else:
                self.base = iri
            if old_style:
                self.take(".")
            return
        if self.at("["):
            subject = self.properties()
            if not self.at("."):
                self.predicates(subject)
        else:
            subject = self.term()
            if subject[1] == "literal":
                raise TurtleError("a literal can't be a subject")
            self.predicates(subject)
        self.take(".")

    def predicates(self, subject: Term) -> None:
        while True:
            if self.kind == "word" and self.text == "a":
                self.step()
                predicate = RDF + "type"
            else:
                predicate = self.iri()
            while True:
                o = self.term()
                self.found.append((subject[0], predicate, *o))
                if not self.at(","):
                    break
                self.step()
            if not self.at(";"):
                return
            while self.at(";"):
                self.step()
            if self.at(".") or self.at("]"):
                return

    def fresh(self) -> Term:
        self.made += 1
        return f"_:{self.label}.{self.made}", "blank", None

    def properties(self) -> Term:
        self.take("[")
        node = self.fresh()
        if not self.at("]"):
            self.predicates(node)
        self.take("]")
        return node

    def collection(self) -> Term:
        self.take("(")
        items = []
        while not self.at(")"):
            items.append(self.term())
        self.take(")")
        head: Term = (RDF + "nil", "iri", None)
        for item in reversed(items):
            node = self.fresh()
            self.found += [(node[0], RDF + "first", *item), (node[0], RDF + "rest", *head)]
            head = node
        return head

    def iri(self) -> str:
        kind, text = self.kind, self.text
        self.step()
        if kind == "iri":
            found = unescape(text[1:-1])
            return found if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", found) or not self.base else urljoin(self.base, found)
        if kind == "name":
            prefix, local = text.split(":", 1)
            if prefix not in self.prefixes:
                raise TurtleError(f"prefix {prefix!r} is not defined")
            return self.prefixes[prefix] + (re.sub(r"\\(.)", r"\1", local) if "\\" in local else local)
        raise TurtleError(f"an IRI expected, {text!r} found")

    def term(self) -> Term:
        kind, text = self.kind, self.text
        if kind in ("iri", "name"):
            return self.iri(), "iri", None
        if self.at("["):
            return self.properties()
        if self.at("("):
            return self.collection()
        self.step()
        if kind == "blank":
            return f"_:{self.label}-{text[2:]}", "blank", None
        if kind in ("text", "long"):
            plain = unescape(text[3:-3] if kind == "long" else text[1:-1])
            if self.kind == "lang":
                tag = self.text
                self.step()
                return plain, "literal", tag
            if self.at("^^"):
                self.step()
                return plain, "literal", self.iri()
            return plain, "literal", None
        if kind == "number":
            return text, "literal", XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer")
        if kind == "word" and text in ("true", "false"):
            return text, "literal", XSD + "boolean"
        raise TurtleError(f"a term expected, {text!r} found")


@dataclass
class File(InputPartition):
    path: str
    number: int


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if re.match(r"[a-z0-9]+:", path) else f"file://{path}")


def _pieces(path: str) -> Iterator[str]:
    import codecs

    system, own = _opened(path)
    decoder = codecs.getincrementaldecoder("utf-8")()
    with system.open_input_stream(own) as stream:
        while data := stream.read(BUFFER):
            yield decoder.decode(data)
    yield decoder.decode(b"", final=True)


class TurtleReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[File]:
        system, own = _opened(self.path)
        at = self.path[: len(self.path) - len(own)] if self.path.endswith(own) else ""
        info = system.get_file_info(own)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(own, recursive=True))
        names = sorted(f.path for f in files if f.type == fs.FileType.File and f.path.endswith((".ttl", ".nt")) and not f.base_name.startswith((".", "_")))
        return [File(at + name, i) for i, name in enumerate(names)]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        yield from Parser(_pieces(partition.path), f"f{partition.number}").batches()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["s", "p", "o", "o_kind", "o_type"])


def _mapped(column: pa.Array, f: Callable[[str], str | None]) -> pa.Array:
    """f of each value, called once for equal ones."""
    of = column.dictionary_encode()
    return pa.array([f(x) for x in of.dictionary.to_pylist()], pa.string()).take(of.indices)


def _replaced(column: pa.Array, odd: pa.Array, given: pa.Array, f: Callable[[str], str | None]) -> pa.Array:
    """column, and f of the given value where it is odd."""
    return pc.replace_with_mask(column, odd, _mapped(given.filter(odd), f)) if pc.any(odd).as_py() else column


@dataclass
class Written(WriterCommitMessage):
    path: str | None


_BARE = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*\Z")
_NOT_IN_IRI = re.compile(r'[<>"{}|^`\\\x00-\x20]')
_NOT_IN_TEXT = re.compile(r'["\\\x00-\x1f]')
_COLUMNS = ["s", "p", "o", "o_kind", "o_type"]
_NAMES = {v: k for k, v in _SIGNS.items()} | {'"': '"', "\\": "\\"}


class TurtleWriter(DataSourceArrowWriter):
    """Each task writes a file under a name of its own; the commit gives the names that readers take."""

    def __init__(self, path: str, prefixes: dict[str, str], overwrite: bool):
        self.path, self.prefixes, self.overwrite = path, prefixes, overwrite
        self.job = uuid.uuid4().hex[:12]

    def iri(self, text: str) -> str:
        if text.startswith("_:"):
            return "_:" + re.sub(r"[^A-Za-z0-9]", "-", text[2:])
        for name, space in self.prefixes.items():
            if text.startswith(space) and _BARE.match(text[len(space) :]):
                return f"{name}:{text[len(space) :]}"
        return "<" + _NOT_IN_IRI.sub(lambda m: f"\\u{ord(m[0]):04X}", text) + ">"

    def literal(self, text: str) -> str:
        return '"' + _NOT_IN_TEXT.sub(lambda m: "\\" + _NAMES[m[0]] if m[0] in _NAMES else f"\\u{ord(m[0]):04X}", text) + '"'

    def iris(self, column: pa.Array) -> pa.Array:
        """self.iri of each value; one at a time only where it escapes, shortens or renames."""
        odd = pc.or_(pc.match_substring_regex(column, _NOT_IN_IRI.pattern), pc.starts_with(column, "_:"))
        for space in self.prefixes.values():
            odd = pc.or_(odd, pc.match_substring_regex(column, rf"^{re.escape(space)}[A-Za-z_][A-Za-z0-9_-]*$"))
        return _replaced(pc.binary_join_element_wise("<", column, ">", ""), odd, column, self.iri)

    def literals(self, column: pa.Array) -> pa.Array:
        return _replaced(pc.binary_join_element_wise('"', column, '"', ""), pc.match_substring_regex(column, _NOT_IN_TEXT.pattern), column, self.literal)

    def objects(self, o: pa.Array, kind: pa.Array, typed: pa.Array) -> pa.Array:
        literal = pc.fill_null(pc.equal(kind, "literal"), False)
        out = pc.replace_with_mask(o, literal, self.literals(o.filter(literal)))
        out = pc.replace_with_mask(out, pc.invert(literal), self.iris(o.filter(pc.invert(literal))))
        suffix = _mapped(pc.if_else(literal, pc.fill_null(typed, ""), ""), lambda x: x if not x or x[0] == "@" else f"^^{self.iri(x)}")
        return pc.binary_join_element_wise(out, suffix, "")

    def lines(self, batch: pa.RecordBatch, last: list[str | None] | None) -> bytes:
        """The triples of a batch; last: the one before it. The mark that ends a statement opens the next one."""
        given = {n: batch.column(n).cast(pa.string()) if n in batch.schema.names else pa.nulls(len(batch), pa.string()) for n in _COLUMNS}
        if any(given[n].null_count for n in ("s", "p", "o")):
            raise ValueError("a triple with a null")
        before = {n: pa.concat_arrays([pa.array([last[i] if last else None], pa.string()), c.slice(0, len(c) - 1)]) for i, (n, c) in enumerate(given.items())}
        equal = {n: pc.or_(pc.fill_null(pc.equal(c, before[n]), False), pc.and_(pc.is_null(c), pc.is_null(before[n]))) for n, c in given.items()}
        again = equal["s"]
        for n in _COLUMNS[1:]:
            again = pc.and_(again, equal[n])
        new = pc.invert(again)
        s, p, o, kind, typed = (c.filter(new) for c in given.values())
        same = equal["s"].filter(new)
        heads = pc.binary_join_element_wise(" .\n", self.iris(s.filter(pc.invert(same))), "")
        head = pc.replace_with_mask(pa.array([" ;\n "]).take(pa.array([0] * len(s), pa.int32())), pc.invert(same), heads)
        predicate = _mapped(p, lambda x: "a" if x == RDF + "type" else self.iri(x))
        pairs = pc.binary_join_element_wise(head, predicate, self.objects(o, kind, typed), " ")
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pairs), "")[0].as_buffer().to_pybytes()
        return text.removeprefix(b" .") if last is None else text

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, own = _opened(self.path)
        system.create_dir(own)
        name = f"{own}/_{self.job}-{context.partitionId():05d}-{context.taskAttemptId()}.ttl"
        last = None
        with system.open_output_stream(name) as out:
            out.write("".join(f"@prefix {n}: {self.iri(s)} .\n" for n, s in self.prefixes.items()).encode())
            for batch in iterator:
                if len(batch):
                    out.write(self.lines(batch, last))
                    last = [batch.column(n)[-1].as_py() if n in batch.schema.names else None for n in _COLUMNS]
            out.write(b" .\n" if last is not None else b"")
        return Written(name)

    def commit(self, messages: list[Written]) -> None:
        system, own = _opened(self.path)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(own, recursive=False)):
                if not f.base_name.startswith("_"):
                    system.delete_file(f.path)
        for i, m in enumerate(messages):
            if m and m.path:
                system.move(m.path, f"{own}/part-{self.job}-{i:05d}.ttl")

    def abort(self, messages: list[Written]) -> None:
        for m in messages:
            if m and m.path:
                system, _ = _opened(self.path)
                system.delete_file(m.path)


class TurtleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "turtle"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TurtleReader:
        return TurtleReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> TurtleWriter:
        prefixes = {k.split(".", 1)[1]: v for k, v in self.options.items() if k.startswith("prefix.")}
        return TurtleWriter(self.options["path"], prefixes, overwrite)


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """The triples of a file, or of all .ttl and .nt files below a folder."""
    spark.dataSource.register(TurtleSource)
    return spark.read.format("turtle").load(path)


def write_turtle(triples: DataFrame, path: str, prefixes: dict[str, str] | None = None) -> None:
    """Triples with their subjects' rows together, repeats once, in as many files as partitions. Option names are lower case."""
    triples.sparkSession.dataSource.register(TurtleSource)
    rows = triples if "o_type" in triples.columns else triples.withColumn("o_type", F.lit(None).cast("string"))
    rows = rows.select("s", "p", "o", "o_kind", "o_type").repartition("s").sortWithinPartitions(*_COLUMNS)
    rows.write.format("turtle").mode("overwrite").options(**{f"prefix.{k}": v for k, v in (prefixes or {}).items()}).save(path)
