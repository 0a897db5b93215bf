"""Operator 9, HTML extraction by consensus host paths.

Each page is tokenised once into text segments and the block containers they lie in. A
container's generalised path is the chain of its and its ancestors' tags with their class (or
id) names, digits masked, so that pages of one template share it. Paragraph-like blocks score
for their container, and half for the one above, by length and commas, less for link text.
Every page votes for its containers; Spark sums the votes per host and path and ranks
them; each page is then extracted again from the best-ranked path that it has, or from its
own best container where it has none of them (or no host). Menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and comments are left out in both passes.

A name says that a container is left out only if all its words do ("cookie-banner"). One that has
other words besides ("cookie-recipes"), or a section of an article under a word of two meanings
("discussion"), is doubtful: pages judge it by its text (little of it links, no controls and nothing
left out inside), the host by the majority of its pages, and text that most of them repeat is no
article. A page without host goes by its own judgement.

Parsing takes time and memory in proportion to the page, however deep or unclosed its elements are:
paths are digests of the parent's digest and the own step.

Defined results: a null or empty html has the empty text; a null url has no host and uses the
page's own best container; repeated rows give repeated results; markup that never closes is
closed by its container; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, picked, slices

#: Paths that a host keeps: the winners of its vote.
HOST_PATHS = 3
#: A doubtful container's text is the host's own if at least so many pages have it, on average over its texts.
REPEATED = 3
#: A doubtful container's part of text in links, at most.
LINKED = 0.3

# Element kinds of HTML.
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
RAW = frozenset(["script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select", "option", "button", "object", "canvas", "audio", "video"])
#: Those of RAW that are controls.
CONTROLS = frozenset(["select", "button", "textarea"])
#: Those of RAW whose content is no markup, and those that run to the end of the page if they never close.
PLAIN, ENDLESS = frozenset(["script", "style", "textarea", "title", "iframe"]), frozenset(["script", "style"])
#: Never left out by an id alone, and not so inside an article either.
TEXT_TAGS, ARTICLE_TAGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6", "p", "li"]), frozenset(["section"])
CONTAINERS = frozenset(["html", "body", "div", "section", "article", "main", "aside", "nav", "header", "footer", "form", "table", "tbody", "tr", "td", "ul", "ol", "dl", "figure", "blockquote", "details", "fieldset", "center", "dialog", "menu", "search"])
BLOCKS = CONTAINERS | frozenset(["p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "hr", "br", "address", "figcaption", "summary", "thead", "tfoot", "th", "caption", "hgroup", "legend"])
PARAGRAPHS = frozenset(["p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dd", "dt", "pre", "blockquote", "td"])
LEFT_OUT_TAGS = frozenset(["nav", "aside", "footer", "form", "menu", "dialog", "search", "head"])
LEFT_OUT_ROLES = frozenset(["navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"])
#: Words of class and id names that mark what is no article text.
LEFT_OUT_WORDS = frozenset(
    [
        "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "popup",
        "modal", "overlay", "cookie", "cookies", "consent", "gdpr", "notice", "notification", "alert", "menu", "nav", "navbar", "navigation",
        "breadcrumb", "breadcrumbs", "pagination", "pager", "sidebar", "aside", "widget", "footer", "masthead", "comment", "comments", "respond",
        "reply", "replies", "disqus", "discussion", "related", "recommended", "recommendations", "share", "sharing", "social", "newsletter",
        "subscribe", "subscription", "signup", "login", "search", "toolbar", "skip", "hidden", "sr", "outbrain", "taboola",
    ]
)
#: As above, for whole names.
LEFT_OUT_NAMES = frozenset(["header", "site-header", "page-header", "top-bar", "topbar", "sr-only", "visually-hidden", "screen-reader-text", "comment-list", "comments-area"])

#: Words that may stand beside those above without changing what a name says.
PLAIN_WORDS = frozenset(
    [
        "list", "box", "area", "wrap", "wrapper", "container", "bar", "block", "section", "inner", "outer", "site", "main", "page", "top", "bottom",
        "left", "right", "links", "link", "buttons", "button", "posts", "post", "articles", "items", "item", "form", "icons", "icon", "content", "header",
        "head", "title", "body", "row", "col", "group", "panel", "primary", "secondary", "global", "mobile", "desktop", "fixed", "sticky", "reader",
        "readers", "user", "users", "policy", "us", "js", "no", "only", "the", "more", "slot", "unit", "space", "google", "media", "count", "thread",
    ]
)
#: Of these, a section of an article can be the subject.
TWO_MEANINGS = frozenset(["discussion", "related", "notice", "alert", "search", "share", "sharing", "recommended", "recommendations", "promotion", "navigation", "subscription", "social"])

_OPEN = re.compile(r"(<!--.*?(?:-->|\Z))|<[!?]|<(/?)([a-zA-Z][^\s/>]*)", re.S)
#: The rest of a tag: a quote opens a value only after "=".
_REST = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_LABEL = re.compile("[^<]*")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+")
_CLOSED_BY_BLOCK = frozenset(["p", "h1", "h2", "h3", "h4", "h5", "h6"])
_SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Container:
    """A block container of a page: its generalised path as a digest, and its place in page.containers."""

    __slots__ = ("at", "digest", "doubtful", "inside_article", "left_out", "parent", "score", "step")

    def __init__(self, at: int, parent: Container | None, step: str, left_out: bool, doubtful: bool, inside_article: bool):
        self.at, self.parent, self.step, self.left_out, self.doubtful, self.inside_article = at, parent, step, left_out, doubtful, inside_article
        self.digest = hashlib.blake2b((parent.digest if parent else b"") + b">" + step.encode(), digest_size=8).digest()
        self.score = 0.0

    @property
    def path(self) -> str:
        return f"{self.digest.hex()}>{self.step}"


@dataclass
class Page:
    containers: list[Container] = field(default_factory=list)  # parents first; the root is none of them
    segments: list[tuple[Container, str]] = field(default_factory=list)  # text with " " at block borders
    facts: list[tuple[int, bool]] = field(default_factory=list)  # of each segment: characters in links, in a paragraph
    marks: list[Container] = field(default_factory=list)  # where controls or left-out elements are


class Token(NamedTuple):
    """A tag, or with no name a comment or declaration."""

    start: int
    end: int
    closing: bool
    name: str | None
    rest: str


class Tokens:
    """The tags of a text, in one pass: where a quoted value never ends, tags end at the next > from there on."""

    def __init__(self, text: str):
        self.text, self.final, self.broken = text, text.rfind(">"), False

    def search(self, at: int) -> Token | None:
        text = self.text
        m = _OPEN.search(text, at)
        if m is None:
            return None
        if m[1]:
            return Token(m.start(), m.end(), False, None, "")
        if m.end() > self.final:  # no > is left: all text
            return None if "<!--" not in text[m.end() :] else self._comment(m.end())
        rest = _REST.match(text, m.end()) if m[3] and not self.broken else None
        if rest:
            return Token(m.start(), rest.end(), bool(m[2]), m[3], rest[1])
        self.broken = self.broken or bool(m[3])
        end = text.index(">", m.end())
        return Token(m.start(), end + 1, bool(m[2]), m[3], text[m.end() : end])

    def _comment(self, at: int) -> Token:
        return Token(self.text.index("<!--", at), len(self.text), False, None, "")


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" /\t\n\r") else {}


def _left_out(tag: str, attributes: dict[str, str], inside_article: bool) -> tuple[bool, bool]:
    """Whether an element is left out, and whether that is in doubt."""
    if tag in LEFT_OUT_TAGS or (tag == "header" and not inside_article) or "hidden" in attributes:
        return True, False
    if attributes.get("role", "").lower() in LEFT_OUT_ROLES or attributes.get("aria-hidden", "").lower() == "true":
        return True, False
    if "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True, False
    if tag in ("html", "body", "article", "main"):
        return False, False
    names = attributes.get("class", "").split()
    if tag not in TEXT_TAGS and not (inside_article and tag in ARTICLE_TAGS):
        names += attributes.get("id", "").split()
    found = doubtful = False
    for name in names:
        words = {w.lower() for w in _NAME_WORD.findall(name)}
        if name.lower() not in LEFT_OUT_NAMES and not LEFT_OUT_WORDS & words:
            continue
        unsure = name.lower() not in LEFT_OUT_NAMES and (not words <= LEFT_OUT_WORDS | PLAIN_WORDS or (inside_article and tag in ARTICLE_TAGS and LEFT_OUT_WORDS & words <= TWO_MEANINGS))
        if not (unsure and tag in CONTAINERS):
            return True, False
        found = doubtful = True
    return found, doubtful


def _step(tag: str, attributes: dict[str, str]) -> str:
    names = sorted({re.sub(r"\d+", "#", n.lower()) for n in attributes.get("class", "").split()})
    return tag + "".join(f".{n}" for n in names) if names else f"{tag}#{re.sub('[0-9]+', '#', attributes['id'].lower())}" if attributes.get("id") else tag


def _raw_end(tokens: Tokens, tag: str, at: int, last: dict[str, int], lost: dict[str, int]) -> int:
    """Where the content of a RAW element that begins at `at` ends: after its end tag, if that comes
    before its container's; else before the next tag, as if it were void."""
    text = tokens.text
    if tag == "option":
        return at + len(_LABEL.match(text, at)[0])
    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I)
    if tag not in last:
        last[tag] = max((m.start() for m in end.finditer(text)), default=-1)
    if tag in PLAIN:
        found = end.search(text, at) if at <= last[tag] else None
        return found.end() if found else len(text) if tag in ENDLESS else at
    bare = at + len(_LABEL.match(text, at)[0]) if tag == "button" else at
    if at <= lost.get(tag, -1):  # a search from before found no end up to there
        return bare
    depth, i, m = 0, at, None
    while i <= last[tag] and (m := tokens.search(i)):
        i = m.end
        if m.name is None:
            continue
        inner = m.name.lower()
        if m.closing and inner == tag:
            return i
        if inner in PLAIN and not m.closing:
            i = _raw_end(tokens, inner, i, last, lost)
        elif inner in CONTAINERS:
            depth += -1 if m.closing else 1
            if depth < 0:
                break
    lost[tag] = m.start if depth < 0 and m else len(text)
    return bare


class _Element:
    __slots__ = ("alive", "container", "left_out", "tag")

    def __init__(self, tag: str, container: Container, left_out: bool):
        self.tag, self.container, self.left_out, self.alive = tag, container, left_out, True


class _Stack:
    """Open elements. Elements are found by name, so that no tag costs a walk through the stack."""

    def __init__(self) -> None:
        self.open: list[_Element] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.boxes: list[int] = []

    def push(self, element: _Element) -> None:
        self.places[element.tag].append(len(self.open))
        if element.tag in CONTAINERS:
            self.boxes.append(len(self.open))
        self.open.append(element)

    def nearest(self, tags: Iterable[str], any_depth: bool = False) -> int:
        """The place of the nearest open element of these names in its container (or at any depth), else -1."""
        at = max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)
        return at if any_depth or not self.boxes or at >= self.boxes[-1] else -1

    def remove(self, at: int) -> str:
        """Take one element out from between the others."""
        element = self.open[at]
        element.alive = False
        self.places[element.tag].pop()
        while self.open and not self.open[-1].alive:
            self.open.pop()
        return element.tag

    def cut(self, at: int) -> Iterator[str]:
        """Take out all elements from this one on."""
        while len(self.open) > at:
            element = self.open.pop()
            if element.alive:
                self.places[element.tag].pop()
                if element.tag in CONTAINERS:
                    self.boxes.pop()
                yield element.tag


def parse(text: str) -> Page:
    """Segments and containers of a page, with the scores that its own judgement gives."""
    page = Page()
    root = Container(-1, None, "", False, False, False)
    stack = _Stack()
    block: list[str] = []
    links = depth_of_link = 0
    in_paragraph = False

    def where() -> tuple[Container, bool]:
        return (stack.open[-1].container, stack.open[-1].left_out) if stack.open else (root, False)

    def close_block() -> None:
        nonlocal links
        found = " ".join("".join(block).split())
        if found:
            page.segments.append((where()[0], found))
            page.facts.append((links, in_paragraph))
        block.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        if raw and not where()[1]:
            plain = html.unescape(raw)
            block.append(plain)
            if depth_of_link:
                links += len(plain.strip())

    def close_until(at: int) -> None:
        nonlocal depth_of_link
        close_block()
        depth_of_link -= sum(tag == "a" for tag in stack.cut(at))

    last: dict[str, int] = {}
    lost: dict[str, int] = {}
    tokens, at, n = Tokens(text), 0, len(text)
    while at < n:
        m = tokens.search(at)
        if m is None:
            add(text[at:])
            break
        add(text[at : m.start])
        at = m.end
        if m.name is None:
            continue
        tag = m.name.lower()
        if m.closing:
            found = stack.nearest((tag,), tag in CONTAINERS)
            if found >= 0 and tag in BLOCKS:
                close_until(found)
            elif found >= 0:
                depth_of_link -= stack.remove(found) == "a"
            if tag in BLOCKS:
                in_paragraph = False
            continue
        if tag in RAW:
            if tag in CONTROLS:
                page.marks.append(where()[0])
            if tag in PLAIN or not m.rest.rstrip().endswith("/"):
                at = _raw_end(tokens, tag, at, last, lost)
            continue
        if tag in BLOCKS:
            close_block()
            closes = _SAME_CLOSES.get(tag, set()) | (_CLOSED_BY_BLOCK & {"p"} if tag != "br" else set())
            found = stack.nearest(closes)
            if found >= 0:
                close_until(found)
            in_paragraph = tag in PARAGRAPHS
        if tag in VOID:
            continue
        container, out = where()
        attributes = _attributes(m.rest)
        inside, doubtful = container.inside_article, False
        if not out and (attributes or tag in LEFT_OUT_TAGS or tag == "header"):
            out, doubtful = _left_out(tag, attributes, inside)
            if out and not doubtful:
                page.marks.append(container)
        if tag in CONTAINERS:
            container = Container(len(page.containers), container, _step(tag, attributes), out and not doubtful, doubtful, inside or tag in ("article", "main") or attributes.get("role", "").lower() in ("main", "article"))
            page.containers.append(container)
        stack.push(_Element(tag, container, out and not doubtful))
        depth_of_link += tag == "a"
    close_until(0)
    scored(page, {})
    return page


def judged(page: Page) -> list[tuple[Container, bool, str]]:
    """Each doubtful container with the page's own judgement and its text."""
    doubtful = [c for c in page.containers if c.doubtful]
    if not doubtful:
        return []
    # What lies in a doubtful container is summed up from the innermost one outwards.
    inner = {c.at: c for c in doubtful}
    nearest: list[Container | None] = []
    for c in page.containers:
        nearest.append(inner.get(c.at) or (nearest[c.parent.at] if c.parent is not None and c.parent.at >= 0 else None))
    held = lambda c: nearest[c.at] if c.at >= 0 else None
    chars, linked, marks, texts = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(list)
    for (container, text), (links, _) in zip(page.segments, page.facts, strict=True):
        if (own := held(container)) is not None:
            chars[own.at] += len(text)
            linked[own.at] += links
            texts[own.at].append(text)
    for container in page.marks:
        if (own := held(container)) is not None:
            marks[own.at] += 1
    out = []
    for c in reversed(doubtful):
        good = marks[c.at] == 0 and 0 < chars[c.at] and linked[c.at] <= LINKED * chars[c.at]
        out.append((c, good, " ".join(texts[c.at])))
        if c.parent is not None and (own := held(c.parent)) is not None:
            for sums in (chars, linked, marks):
                sums[own.at] += sums[c.at]
    return out


def rejected(page: Page, verdicts: dict[str, bool]) -> list[bool]:
    """Of each container, whether it lies in a doubtful one that the host (else the page) takes for no text."""
    own = {c.at: not verdicts.get(c.path, good) for c, good, _ in judged(page)}
    out: list[bool] = []
    for c in page.containers:
        out.append(own.get(c.at, False) or (c.parent is not None and c.parent.at >= 0 and out[c.parent.at]))
    return out


def scored(page: Page, verdicts: dict[str, bool]) -> None:
    """Give each container the points of its text."""
    gone = rejected(page, verdicts)
    for c in page.containers:
        c.score = 0.0
    for (container, found), (links, paragraph) in zip(page.segments, page.facts, strict=True):
        if container.at >= 0 and gone[container.at]:
            continue
        share = max(0.0, 1 - links / len(found))
        points = share * share * (min(len(found) / 100, 30) + found.count(",") * 0.2 + (1 if paragraph else 0))
        container.score += points
        if container.parent is not None:
            container.parent.score += points / 2


def _rated(c: Container) -> float:
    weight = 3.0 if re.match(r"article|main", c.step) else 1.5 if re.search(r"article|content|entry|post|story|text|body-", c.step) else 0.5 if c.step in ("html", "body") else 1.0
    return c.score * weight


def votes(page: Page) -> list[tuple[str, float]]:
    """The page's paths, best first, their shares summing to 1."""
    by: dict[str, tuple[float, int]] = {}
    depth: list[int] = []
    for c in page.containers:
        depth.append(depth[c.parent.at] + 1 if c.parent is not None and c.parent.at >= 0 else 0)
        if not c.left_out and c.score > 0:
            by[c.path] = max(by.get(c.path, (0.0, 0)), (_rated(c), -depth[c.at]))
    total = sum(s for s, _ in by.values())
    return [(p, s / total) for p, (s, _) in sorted(by.items(), key=lambda x: (-x[1][0], -x[1][1], x[0]))]


def extract(page: Page, paths: list[str], verdicts: dict[str, bool] | None = None) -> str:
    """Text under the first of the paths that has any, else under the page's own best container."""
    if verdicts:
        scored(page, verdicts)
    gone = rejected(page, verdicts or {})
    kept = [(c, found) for c, found in page.segments if c.at < 0 or not gone[c.at]]
    have = {c.path for c in page.containers}
    for path in [*(p for p in paths if p in have), *(p for p, _ in votes(page)[:1])]:
        under: list[bool] = []
        for c in page.containers:
            under.append(c.path == path or (c.parent is not None and c.parent.at >= 0 and under[c.parent.at]))
        out = [found for c, found in kept if c.at >= 0 and under[c.at]]
        if out:
            return " ".join(out)
    return " ".join(found for _, found in kept)


def host_of(url):
    return F.lower(F.nullif(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


_BALLOTS = "host string, path string, votes bigint, doubt int, digest binary"


def ballots(pages: DataFrame) -> DataFrame:
    """What every page of a host says: votes for paths (in thousandths, so that sums are exact), and of each
    doubtful container's path 1 or 0 (text or not) with a digest of its text."""

    def voted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                rows: list[tuple[str, str, int | None, int | None, bytes | None]] = []
                for host, text in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                    if host:
                        page = parse(text or "")
                        rows += [(host, path, round(1000 * share), None, None) for path, share in votes(page)]
                        rows += [(host, c.path, None, int(good), hashlib.blake2b(said.encode(), digest_size=16).digest()) for c, good, said in judged(page)]
                columns = zip(*rows, strict=True) if rows else ([],) * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["host", "path", "votes", "doubt", "digest"])

    return pages.select("host", "html").mapInArrow(voted, _BALLOTS)


def host_paths(cast: DataFrame, most: int = HOST_PATHS) -> DataFrame:
    """host, paths and doubts of ballots: the best-ranked paths, and (path, good) of the doubtful ones."""
    summed = cast.filter("votes IS NOT NULL").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    ranked = summed.withColumn("r", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))).filter(F.col("r") <= most)
    best = ranked.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "path"))), lambda x: x["path"]).alias("paths"))
    texts = cast.filter("doubt IS NOT NULL").groupBy("host", "path", "digest").agg(F.count("*").alias("n"), F.sum("doubt").alias("yes"))
    by_path = texts.groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("yes").alias("yes"), F.count("*").alias("texts"))
    good = (2 * F.col("yes") >= F.col("n")) & (F.col("n") < REPEATED * F.col("texts"))
    doubts = by_path.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("path", good.alias("good")))).alias("doubts"))
    return best.join(doubts, "host", "full_outer")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    scratch = Scratch(pages.sparkSession)
    rows = picked(pages, page_id=id_col, url=url_col, html=html_col).withColumn("host", host_of(F.col("url")))
    # Written first, so that pages are parsed once for both counts, and the join is planned by the table's real size.
    cast = scratch.keep(ballots(rows))
    winners = scratch.keep(host_paths(cast))
    scratch.drop(cast)
    with_paths = rows.join(winners, "host", "left").select("page_id", "url", "html", "paths", "doubts")

    def extracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                columns = (part.column(c).to_pylist() for c in ("html", "paths", "doubts"))
                out = [extract(parse(text or ""), paths or [], {d["path"]: d["good"] for d in doubts or []}) for text, paths, doubts in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return with_paths.mapInArrow(extracted, "page_id bigint, url string, text string, n_chars bigint")
