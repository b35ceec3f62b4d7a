"""Sections of HTML documents by their headings: elements that are headings by tag, by style or as a question.

One pass per document builds a light tree with text offsets; what is a heading, a line of a table of contents or a cover page's line
is decided by rules on that tree. Documents stream through in Arrow batches, nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.workspace import in_workers

_VOID = {"br", "hr", "img", "input", "meta", "link", "col", "area", "base", "wbr"}
#: What an open element of these is closed by.
_CLOSES = {"p": {"p"}, "div": {"p"}, "table": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "li": {"li"}, **{f"h{i}": {"p"} for i in range(1, 7)}}

# How style marks a heading, questions that head a passage, and lines of a cover page.
BOLD = re.compile(r"font-weight:\s*(?:bold|700)", re.I)
FONT_SIZE = re.compile(r"font-size:\s*(\d+(?:\.\d+)?)\s*pt")
LARGE_FONT = 10
QUESTION = re.compile(r"Q:\s*|Question:\s*|What\s+(?:is|are)\s+|How\s+(?:do|does|can)\s+|Who\s+(?:is|are)\s+|Is\s+there\s+|Will\s+(?:I|you|the)\s+|Can\s+(?:I|you|shareholders)\s+|When\s+(?:will|can|do)\s+|Where\s+(?:can|will)\s+", re.I)
COVER_LINE = re.compile(r"REGISTRATION\s+STATEMENT|SECURITIES\s+AND\s+EXCHANGE\s+COMMISSION|UNITED\s+STATES$|FORM\s*N-|TABLE\s+OF\s+CONTENTS$|PROSPECTUS$|STATEMENT\s+OF\s+ADDITIONAL\s+INFORMATION|PART\s+[A-C]", re.I)
#: Font sizes from which on a heading is of level 1, 2 and 3.
LEVEL_SIZES = (16, 14, 12)
#: Characters of documents after whose sections a batch is handed on.
BATCH_CHARS = 4_000_000
SECTIONS = "ord int, title string, tag string, level int, char_start int, content string, content_type string"


class Node:
    """An element: its place among all elements, its attributes, parent, child elements, and the texts before its start and end."""

    __slots__ = ("tag", "attrs", "parent", "children", "start", "end")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, start: int) -> None:
        self.tag, self.attrs, self.parent, self.children, self.start, self.end = tag, attrs, parent, [], start, start

    def up(self, tag: str) -> Node | None:
        """The nearest element around this one with a tag."""
        x = self.parent
        while x is not None and x.tag != tag:
            x = x.parent
        return x

    def below(self) -> Iterator[Node]:
        """All elements in this one, in document order."""
        todo = list(reversed(self.children))
        while todo:
            x = todo.pop()
            yield x
            todo.extend(reversed(x.children))


class Tree(HTMLParser):
    """The elements of a document and its texts in order. A node's text is texts[start:end]."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.contents: dict[int, bool] = {}
        self.root = self.at = Node("", {}, None, 0)
        self.feed(html)
        self.close()
        while self.at is not None:
            self._leave()
        self.offsets = [0]
        for t in self.texts:
            self.offsets.append(self.offsets[-1] + len(t))

    def _leave(self) -> None:
        self.at.end = len(self.texts)
        self.at = self.at.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # An element that cannot hold this one ends here, unless a table or a cell lies between.
        x = self.at
        while x.tag not in ("", "table", "body") and x.tag not in _CLOSES.get(tag, ()):
            x = x.parent
        if x.tag in _CLOSES.get(tag, ()):
            while self.at is not x.parent:
                self._leave()
        node = Node(tag, {k.lower(): v or "" for k, v in attrs}, self.at, len(self.texts))
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        x = self.at
        while x is not None and x.tag != tag:
            x = x.parent
        if x is not None:
            while self.at is not x.parent:
                self._leave()

    def handle_data(self, data: str) -> None:
        if self.at.tag not in ("script", "style"):
            self.texts.append(data)

    def joined(self, node: Node) -> str:
        """An element's texts, each without white space at its ends, put together."""
        return "".join(t.strip() for t in self.texts[node.start : node.end])

    def short(self, node: Node, most: int) -> str | None:
        """`joined` if it is shorter than `most` characters, else None, without going through all of it."""
        parts, n = [], 0
        for i in range(node.start, node.end):
            parts.append(self.texts[i].strip())
            n += len(parts[-1])
            if n >= most:
                return None
        return "".join(parts)

    def spaced(self, start: int, end: int) -> str:
        """Texts with a blank between, runs of white space as one."""
        return re.sub(r"\s+", " ", " ".join(self.texts[start:end])).strip()


def font_size(node: Node) -> float | None:
    """The font size in points that an element's own style states."""
    m = FONT_SIZE.search(node.attrs.get("style", ""))
    return float(m.group(1)) if m else None


def styled_heading(tree: Tree, node: Node) -> bool:
    """Bold and not small, in capitals, or short with something bold in it (SEG-10)."""
    text = tree.joined(node)
    bold = BOLD.search(node.attrs.get("style", "")) is not None
    if bold and (font_size(node) or 0) >= LARGE_FONT or text.isupper() and len(text) > 5:
        return True
    return len(text) < 150 and any(x.tag in ("b", "strong") for x in node.below())


def heading_level(tree: Tree, node: Node) -> int:
    """A heading's level by its font size; without one, 2 in capitals and 3 else (SEG-11)."""
    size = font_size(node)
    if size is not None:
        return next((i for i, least in enumerate(LEVEL_SIZES, 1) if size >= least), 4)
    return 2 if tree.joined(node).isupper() else 3


def contents_entry(tree: Tree, node: Node) -> bool:
    """An element lies in a table of contents (SEG-12): a table of five rows or more with page numbers, that heading, or many inner links."""
    table = node.up("table")
    if table is None:
        return False
    if id(table) not in tree.contents:
        tree.contents[id(table)] = _lists_contents(tree, table)
    return tree.contents[id(table)]


def _lists_contents(tree: Tree, table: Node) -> bool:
    body = next((x for x in table.below() if x.tag == "tbody"), table)
    rows = [x for x in body.children if x.tag == "tr"]
    if len(rows) < 5:
        return False
    cells = [[c for c in r.children if c.tag == "td"] for r in rows[:10]]
    if sum(len(c) >= 2 and re.match(r"\d{1,4}$", tree.joined(c[-1])) is not None for c in cells) >= 3:
        return True
    head = " ".join(t.strip() for t in tree.texts[table.start : table.end] if t.strip())[:500].upper()
    return "TABLE OF CONTENTS" in head or head.startswith("CONTENTS") or sum(x.tag == "a" and x.attrs.get("href", "").startswith("#") for x in table.below()) > 10


def cover_line(node: Node, text: str) -> bool:
    """A line of the cover page (SEG-13): one of its usual headings, or a short one in capitals that stands directly in the body."""
    return COVER_LINE.match(text.strip()) is not None or node.parent is not None and node.parent.tag == "body" and len(text) < 100 and text.strip().isupper()


def headings(tree: Tree) -> list[tuple[Node, int, str]]:
    """Headings in document order as (element, level, text) (SEG-09): by tag, then by style, then questions; the latter two once per text."""
    found: list[tuple[Node, int, str]] = []
    nodes = list(tree.root.below())
    place = {id(x): i for i, x in enumerate(nodes)}
    for x in nodes:
        if re.fullmatch("h[1-6]", x.tag) and len(tree.joined(x)) > 2:
            found.append((x, int(x.tag[1]), tree.joined(x)))
    seen = {t for _, _, t in found}

    def add(x: Node, level: int, text: str) -> None:
        if text not in seen and not contents_entry(tree, x) and not cover_line(x, text):
            seen.add(text)
            found.append((x, level, text))

    for x in nodes:
        if x.tag in ("p", "div", "span", "td") and (text := tree.short(x, 200)) is not None and len(text) > 2 and styled_heading(tree, x):
            add(x, heading_level(tree, x), text)
    for x in nodes:
        if x.tag in ("p", "div", "span", "td", "tr") and (text := tree.short(x, 200)) is not None and len(text) > 10 and QUESTION.match(text):
            if BOLD.search(x.attrs.get("style", "")) or text.startswith(("Q:", "Question:")):
                add(x, 4, text)
    return sorted(found, key=lambda f: (f[0].start, place[id(f[0])]))


def _after(tree: Tree, node: Node, until: Node | None) -> int:
    """Where the siblings after an element end: at the one that holds `until`, else with their parent."""
    siblings = node.parent.children
    for x in siblings[next(i for i, s in enumerate(siblings) if s is node) + 1 :]:
        if until is not None and (x is until or x.start <= until.start and until.end <= x.end and any(y is until for y in x.below())):
            return x.start
    return node.parent.end


def _content_type(nodes: list[Node]) -> str:
    tags = {t for x in nodes for t in (x.tag, *[y.tag for y in x.below()])}
    table, items = "table" in tags, bool(tags & {"ul", "ol"})
    return "mixed" if table and items else "table" if table else "list" if items else "text"


def sections_of(html: str | None, least: int = 100) -> list[tuple[int, str, str, int, int, str, str]]:
    """The heading sections of a document in the order of SECTIONS (SEG-14..17).

    A section is its heading and the siblings after it up to the next heading. If that is under `least` characters and the
    heading lies in a table, and the next one does not, what follows the table counts instead if it is more. Shorter ones are left out.
    """
    if not html:
        return []
    tree = Tree(html)
    found = headings(tree)
    out = []
    for i, (node, level, text) in enumerate(found):
        until = found[i + 1][0] if i + 1 < len(found) else None
        head = tree.spaced(node.start, node.end)
        end = _after(tree, node, until)
        content = f"{head} {tree.spaced(node.end, end)}".strip()
        table = node.up("table")
        if len(content) < least and table is not None and not (until is not None and table.start <= until.start and until.end <= table.end):
            after = _after(tree, table, until)
            beyond = f"{head} {tree.spaced(table.end, after)}".strip()
            if len(beyond) > len(content):
                content, node, end = beyond, table, after
        if len(content) >= least:
            own = [x for x in node.parent.children if node.start <= x.start and x.end <= max(end, node.end)]
            out.append((len(out) + 1, text, found[i][0].tag, level, tree.offsets[found[i][0].start], content, _content_type(own)))
    return out


def heading_sections(filings: DataFrame, key: str = "filing_id", html: str = "html", least: int = 100) -> DataFrame:
    """The heading sections of HTML documents: key and SECTIONS. Null and empty documents have none; markup that is not closed is read as it is."""
    columns = [key, *[c.split()[0] for c in SECTIONS.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            size = 0
            for k, text in zip(b["key"], b["html"]):
                rows += [(k, *r) for r in sections_of(text, least)]
                size += len(text or "")
                if size > BATCH_CHARS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=columns)

    return in_workers(filings.select(F.col(key).cast("string").alias("key"), F.col(html).alias("html"))).mapInPandas(run, f"`{key}` string, {SECTIONS}")


def plain_text(filings: DataFrame, key: str = "filing_id", html: str = "html") -> DataFrame:
    """The text of HTML documents as the offsets of `heading_sections` count it: key, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b["key"], "text": ["".join(Tree(t).texts) if t else None for t in b["html"]]})

    return in_workers(filings.select(F.col(key).cast("string").alias("key"), F.col(html).alias("html"))).mapInPandas(run, f"`{key}` string, text string")
