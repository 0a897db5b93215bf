"""Operator 7, secret scans: character Markov models compared by log-likelihood ratio.

Base rules find assignments, access keys and long hexadecimal runs. The method adds spans of
other strings: every run of at least `LEAST` key characters, or what base spans and drawn
lines leave of it, is scored by two order-1 Markov models over characters, one of random
strings and one of ordinary identifiers, and is a secret when the log-likelihood ratio a character and in
all is over its threshold. `train` fits both models on labelled samples: random strings
(drawn here by rule, together with what the base rules found in a bounded sample of
documents) and ordinary words and identifiers (from the same documents and by rule). A part in the form of a
UUID is an identifier and not scored (base rules still find one that is assigned to a keyword).

Defined results: a null or empty text has no spans; offsets are code points, ends exclusive;
rows are scanned one by one (repeated rows and null ids give the same); texts of any length
are read whole; with no documents to train on, the rule-made samples alone are used.
"""

from __future__ import annotations

import base64
import hashlib
import re
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import picked, slices, text_or_empty

KINDS = ["assign", "access", "hex", "markov"]
_KEYWORD = re.compile("passw|secret|token|api_?key", re.I | re.A)
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")
#: Characters that a candidate has at least: shorter ones look random without being keys (colours, sizes).
LEAST = 12
#: Runs of key characters; '=' is a border before one and padding after it.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?" % LEAST)
#: Drawn lines, which are borders too.
_LINE = re.compile(r"([+/_=-])\1{3,}")
#: UUIDs name things and are no keys. Their form tells them: their characters follow each other as a hexadecimal key's do.
_UUID = re.compile("[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I | re.A)
#: Documents that `train` reads at most.
TRAIN_DOCS = 2000
#: Distinct strings of either kind that it learns from.
TRAIN_STRINGS = 100_000
#: Log-likelihood ratio (nats): a character, and in all.
PER_CHAR, IN_ALL = 0.5, 12.0

#: Ordinary words that identifiers are made of, beside those of the documents.
ORDINARY = [
    "account", "action", "address", "album", "amount", "android", "answer", "apple", "archive", "array", "article", "asset", "author", "average",
    "backup", "balance", "banner", "batch", "beach", "binary", "block", "board", "body", "border", "branch", "bridge", "browser", "bucket", "buffer",
    "build", "button", "cache", "calendar", "camera", "candidate", "catalog", "center", "chain", "change", "channel", "chapter", "chart", "check",
    "child", "city", "class", "client", "cloud", "cluster", "code", "collection", "color", "column", "command", "comment", "common", "company",
    "config", "connection", "content", "context", "control", "copy", "count", "country", "create", "current", "customer", "dashboard", "data",
    "database", "date", "default", "delete", "design", "detail", "device", "digital", "directory", "document", "domain", "download", "driver",
    "email", "energy", "engine", "entry", "error", "event", "example", "export", "family", "feature", "field", "file", "filter", "final", "find",
    "folder", "format", "frame", "function", "garden", "gateway", "general", "global", "graph", "green", "group", "handler", "header", "health",
    "height", "history", "home", "host", "image", "import", "index", "info", "input", "instance", "internal", "item", "java", "key", "kernel",
    "label", "language", "last", "layer", "layout", "level", "library", "license", "light", "limit", "line", "link", "list", "local", "location",
    "login", "machine", "mail", "main", "manager", "map", "market", "master", "matrix", "media", "member", "memory", "menu", "message", "method",
    "metric", "mobile", "mode", "model", "module", "money", "month", "mountain", "movie", "music", "name", "network", "node", "note", "number",
    "object", "office", "online", "operation", "option", "orange", "order", "output", "owner", "package", "page", "parent", "parser", "part",
    "partner", "path", "payment", "people", "phone", "photo", "picture", "place", "plan", "player", "plugin", "point", "policy", "power", "price",
    "print", "private", "process", "product", "profile", "program", "project", "property", "protocol", "provider", "public", "query", "queue",
    "random", "range", "record", "region", "release", "remote", "report", "request", "resource", "response", "result", "review", "road", "role",
    "root", "route", "rule", "sample", "school", "score", "screen", "script", "search", "section", "security", "select", "sensor", "series",
    "server", "service", "session", "setting", "shape", "share", "shop", "simple", "size", "snapshot", "source", "space", "speed", "spring", "stage",
    "standard", "start", "state", "static", "station", "status", "storage", "store", "story", "stream", "street", "string", "style", "subject",
    "summer", "support", "system", "table", "target", "task", "team", "template", "test", "text", "theme", "thread", "time", "title", "token",
    "total", "track", "traffic", "transfer", "tree", "type", "update", "upload", "user", "utility", "value", "version", "video", "view", "water",
    "weather", "week", "weight", "wheel", "white", "width", "window", "winter", "word", "worker", "world", "writer",
]

Span = tuple[int, int, str]


class Markov:
    """Order-1 character model with add-half smoothing; other characters share one symbol."""

    ALPHABET = string.ascii_letters + string.digits + "+/_=-"

    def __init__(self, samples: Iterable[str]):
        n = len(self.ALPHABET) + 2  # any other character, and the border
        counts = np.full((n, n), 0.5)
        for s in samples:
            x = self.codes(s)
            np.add.at(counts, (x[:-1], x[1:]), 1)
        self.log = np.log(counts / counts.sum(axis=1, keepdims=True))

    @classmethod
    def codes(cls, s: str) -> np.ndarray:
        table = np.full(128, len(cls.ALPHABET))
        table[[ord(c) for c in cls.ALPHABET]] = np.arange(len(cls.ALPHABET))
        border = len(cls.ALPHABET) + 1
        points = np.frombuffer(s.encode("utf-32-le"), np.uint32)
        return np.concatenate([[border], table[np.minimum(points, 127)], [border]])


def ratio_table(random_strings: Iterable[str], ordinary: Iterable[str]) -> np.ndarray:
    """Log-likelihood ratio of each character transition."""
    return Markov(random_strings).log - Markov(ordinary).log


def score(s: str, table: np.ndarray) -> float:
    x = Markov.codes(s)
    return float(table[x[:-1], x[1:]].sum())


def random_samples(n: int = 3000) -> list[str]:
    """Random strings by rule: base64, base62, base32, lower-case alphanumeric and hexadecimal."""
    out = []
    for i in range(n):
        raw = hashlib.sha512(f"random {i}".encode()).digest()
        size = 20 + raw[63] % 25
        alphabets = {1: string.ascii_letters + string.digits, 2: string.ascii_uppercase + string.digits, 3: string.ascii_lowercase + string.digits}
        letters = alphabets.get(i % 5)
        coded = base64.b64encode(raw[:48]).decode() if i % 5 == 0 else raw.hex() if letters is None else "".join(letters[b % len(letters)] for b in raw)
        out.append(coded[:size])
    return out


def identifier_samples(vocabulary: list[str], n: int = 3000) -> list[str]:
    """Ordinary identifiers by rule: words joined as code, paths, slugs, dates and versions do."""
    vocabulary = [w for pair in zip([w for w in vocabulary if re.fullmatch("[A-Za-z]{2,20}", w)] or ORDINARY, ORDINARY * (1 + len(vocabulary) // len(ORDINARY)), strict=False) for w in pair]
    out = []
    for i in range(n):
        a, b, c = (vocabulary[(i * k + k) % len(vocabulary)] for k in (7, 31, 101))
        forms = [f"{a}_{b}_{i}", f"{a}{b.title()}{c.title()}{i % 100}", f"{a}-{b}-{c}-{i}", f"{a.upper()}_{b.upper()}_{i % 10}", f"{a}/{b}/{c}{i % 10}", f"2{i % 1000:03d}-{i % 12 + 1:02d}-{i % 28 + 1:02d}_{a}-{b}", f"v{i % 9}_{i % 20}_{i % 7}-{a}{b}", f"{i:08d}-{i * 7 % 10000:04d}-{a}"]
        out.append(forms[i % len(forms)])
        names = [f"__{a.lower()}_{b.lower()}__", f"_{a.upper()}_{b.upper()}_{c.upper()}", f"/{a.lower()}/{b.lower()}/{c.lower()}", f"{a.upper()}_{b.upper()}"]
        out.append(names[i % len(names)])
    return out


def base_spans(text: str) -> list[Span]:
    out = []
    if _KEYWORD.search(text):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def _parts(text: str, base: list[Span]) -> Iterator[tuple[int, int]]:
    """The candidates: parts of runs between base spans and drawn lines."""
    for m in _RUN.finditer(text):
        at = m.start()
        cuts = [(a, b) for a, b, _ in base if a < m.end() and m.start() < b]
        cuts += [x.span() for x in _LINE.finditer(text, m.start(), m.end())]
        for a, b in [*sorted(cuts), (m.end(), m.end())]:
            if a - at >= LEAST and not _UUID.fullmatch(text, at, a):
                yield at, a
            at = max(at, b)


def added_spans(text: str, base: list[Span], table: np.ndarray) -> list[Span]:
    """What the models find beside the base spans."""
    out = []
    for start, end in _parts(text, base):
        ratio = score(text[start:end], table)
        if ratio >= IN_ALL and ratio >= PER_CHAR * (end - start):
            out.append((start, end, "markov"))
    return out


def shown(spans: Iterable[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_DOCS) -> np.ndarray:
    """The transition ratios, from at most `most` documents (those whose ids hash lowest).

    From these the labelled samples are distinct values and words: at most `TRAIN_STRINGS` of each
    kind (again those that hash lowest), so what comes to the driver is bounded.
    """
    ids = picked(docs, doc_id=id_col).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = picked(docs, doc_id=id_col, text=text_col).join(F.broadcast(ids), "doc_id").select(text_or_empty(F.col("text")).alias("text"))

    def strings(pattern: str, group: int, wanted: Column) -> list[str]:
        found = sample.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(group))).alias("s")).filter(wanted).distinct()
        return sorted(r.s for r in found.orderBy(F.xxhash64("s"), "s").limit(TRAIN_STRINGS).collect())

    length = F.length("s")
    values = strings("(?i)" + _ASSIGN.pattern, 2, length.between(6, 512))
    ordinary = strings("[A-Za-z0-9_-]+", 0, ~F.col("s").rlike("[0-9]") & (length <= 64))
    return ratio_table(random_samples() + values, ordinary + identifier_samples(ordinary))


SCHEMA = "doc_id bigint, spans array<struct<start:bigint,end:bigint,kind:string>>"


def scan(docs: DataFrame, table: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: every secret of every document, in order."""

    def scanned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = []
                for text in part.column("text").to_pylist():
                    base = base_spans(text or "")
                    out.append([{"start": a, "end": b, "kind": k} for a, b, k in in_order(base + added_spans(text or "", base, table))])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, kind)], ["doc_id", "spans"])

    return picked(docs, doc_id=id_col, text=text_col).mapInArrow(scanned, SCHEMA)


def redacted(text: str, table: np.ndarray) -> str:
    """The text with each secret (overlapping ones as one) replaced by a mark."""
    base = base_spans(text)
    out, at = [], 0
    for start, end, kind in in_order(base + added_spans(text, base, table)):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, table: np.ndarray, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with their secrets replaced in the text (a null text stays null), and n_chars anew."""
    schema = docs.schema

    def cleaned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(text_col)
            for part in slices(batch, text_col):
                out = [None if t is None else redacted(t, table) for t in part.column(i).to_pylist()]
                yield part.set_column(i, part.schema.field(i), pa.array(out, part.schema.field(i).type))

    out = docs.mapInArrow(cleaned, schema)
    return out.withColumn(chars_col, F.length(text_col).cast(schema[chars_col].dataType)) if chars_col in docs.columns else out


def secret_digest(found: DataFrame) -> DataFrame:
    """The contract's columns: counts by kind, the digest of the base spans, all spans as text."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(text(F.filter("spans", lambda s: s["kind"] != "markov")), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), of("markov").alias("n_markov"))
