"""Tables, pagers and main texts of pages of many component libraries.

A page is parsed into a small tree inside an Arrow batch; what counts as a table, row, cell or header in each library is
an ``Adapter``, and a registry of these is a parameter. Texts are cleaned, aligned and described by column functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from .html_tables import _ENDS, _HIDDEN, _VOID, MAX_CELLS, align_cells, columns_of


class Node:
    """An element. ``classes`` and what ``attrs`` holds may be shared by elements with equal tags, so nothing changes them."""

    __slots__ = ("tag", "attrs", "parent", "number", "parts", "children", "classes", "role", "page", "last")

    def __init__(self, tag: str, attrs: dict[str, str], classes: frozenset[str], role: str, parent: Node | None, page: list[Node]):
        self.tag, self.attrs, self.classes, self.role, self.parent, self.page = tag, attrs, classes, role, parent, page
        self.number = self.last = len(page)  # in the page's order; the last one within
        self.parts: list = []  # texts and nodes
        self.children: list[Node] = []
        page.append(self)
        if parent is not None:
            parent.parts.append(self)
            parent.children.append(self)

    def walk(self) -> list[Node]:
        """What lies within stands together in the page's order."""
        return self.page[self.number + 1 : self.last + 1]

    def up(self) -> Iterator[Node]:
        node = self
        while node is not None:
            yield node
            node = node.parent

    def within(self, test: Callable[[Node], bool]) -> Node | None:
        node = self
        while node is not None and not test(node):
            node = node.parent
        return node

    def text(self, without: str = "") -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in _HIDDEN and not (without and without in node.attrs):
                if node.tag == "br":
                    out.append("\n")
                if node.children:
                    todo += node.parts[::-1]
                else:
                    out += node.parts
        return "".join(out)

    @property
    def hidden(self) -> bool:
        return self.tag in _HIDDEN or "display:none" in (self.attrs.get("style") or "").replace(" ", "")


#: Further elements whose end tags may be left out: what ends them, and what they can't reach beyond.
_LOOSE = {"li": ("li", "ul", "ol"), "p": ("p", "div", "td", "li"), "option": ("option", "select")}


class _Tree:
    """A page that grows by tags and texts."""

    def __init__(self):
        self.nodes: list[Node] = []
        self.now = Node("#page", {}, frozenset(), "", None, self.nodes)

    def start(self, tag: str, attrs: dict[str, str], classes: frozenset[str], role: str) -> None:
        if around := _LOOSE.get(tag):
            node = self.now
            while node is not None and node.tag not in around:
                node = node.parent
            if node is not None and node.tag == around[0]:
                self.now = node.parent
        for left_open in _ENDS.get(tag, ()):  # end tags that may be left out
            node = self.now
            while node is not None and node.tag != left_open and node.tag != "table":
                node = node.parent
            if node is not None and node.tag == left_open:
                self.now = node.parent
        node = Node(tag, attrs, classes, role, self.now, self.nodes)
        if tag not in _VOID:
            self.now = node

    def end(self, tag: str) -> None:
        node = self.now
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None:
            self.now = node.parent

    def done(self) -> Node:
        for node in reversed(self.nodes):
            if node.parent is not None and node.last > node.parent.last:
                node.parent.last = node.last
        return self.nodes[0]


def _element(tag: str, attrs: dict[str, str]) -> tuple:
    return tag, attrs, frozenset((attrs.get("class") or "").split()), attrs.get("role") or ""


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tree = _Tree()

    def handle_starttag(self, tag, attrs):
        self.tree.start(*_element(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        self.tree.end(tag)

    def handle_data(self, data):
        self.tree.now.parts.append(data)

    def updatepos(self, i, j):  # lines aren't counted
        return j

    def parse_marked_section(self, i, report=1):  # as browsers: a comment, where the library may raise
        return self.parse_bogus_comment(i)


# Plain marks, which the library reads in one way only: an end tag, a start tag whose values hold no references, a text.
_MARK = re.compile(
    r"""</([a-zA-Z][a-zA-Z0-9]*)>|<([a-zA-Z][a-zA-Z0-9]*((?:[ \t\r\n\f]+[a-zA-Z_][-a-zA-Z0-9_:.]*(?:=(?:"[^"&<>]*"|'[^'&<>]*'|[^\s"'<>=`&]+))?)*))[ \t\r\n\f]*>|([^<]+)"""
)
_ATTR = re.compile(r"""([a-zA-Z_][-a-zA-Z0-9_:.]*)(?:=(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""")
#: Elements that hold texts only, and such texts of them as are plain.
_SCRIPT, _TITLE, _FRAME = (re.compile(p + r"</([a-zA-Z]+)>") for p in (r"([^<]*(?:<(?![/!])[^<]*)*)", r"([^<]*)", r"([^<&]*)"))
_TEXT_ONLY = {"script": _SCRIPT, "style": _SCRIPT, "title": _TITLE, "textarea": _TITLE, **dict.fromkeys(("xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"), _FRAME)}
#: Start tags that were read before, at most so many, each of at most so many characters.
_TAGS: dict[str, tuple] = {}
_MOST_TAGS, _TAG_CHARS = 5000, 200


def _start_tag(mark: str, attrs: str) -> tuple:
    held = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)} if attrs else {}
    found = _element(mark[: len(mark) - len(attrs)].lower(), held)
    if len(mark) <= _TAG_CHARS:
        if len(_TAGS) >= _MOST_TAGS:
            _TAGS.clear()
        _TAGS[mark] = found
    return found


def _parse_plain(html: str) -> Node | None:
    """The same tree as the library's, of a page that has plain marks only; else None."""
    tree, at, n, match = _Tree(), 0, len(html), _MARK.match
    while at < n:
        m = match(html, at)
        if m is None:
            return None
        at, kind = m.end(), m.lastindex
        if kind == 4:
            text = m[4]
            tree.now.parts.append(unescape(text) if "&" in text else text)
        elif kind == 1:
            tree.end(m[1].lower())
        else:
            element = _TAGS.get(m[2]) or _start_tag(m[2], m[3])
            tree.start(*element)
            tag = element[0]
            if tag in _TEXT_ONLY:
                m = _TEXT_ONLY[tag].match(html, at)
                if m is None or m[2].lower() != tag:
                    return None
                if m[1]:
                    tree.now.parts.append(m[1] if _TEXT_ONLY[tag] is _SCRIPT else unescape(m[1]))
                tree.end(tag)
                at = m.end()
    return tree.done()


def parse(html: str | None) -> Node:
    found = _parse_plain(html or "")
    if found is None:
        builder = _Builder()
        builder.feed(html or "")
        builder.close()
        found = builder.tree.done()
    return found


# fixed values: what marks the parts of tables in the component libraries
_TABLE_ROLES, _CELL_ROLES, _HEAD_ROLES = ("table", "grid", "treegrid"), ("cell", "gridcell", "columnheader", "rowheader"), ("columnheader", "rowheader")
_ROW_CLASSES, _CELL_CLASSES = {"art-table-row", "ant-table-row", "arco-table-tr"}, {"art-table-cell", "ant-table-cell", "arco-table-td"}
_FOOT_CLASSES = {"art-table-footer", "ant-table-summary", "ant-table-footer", "arco-table-footer", "arco-table-summary"}
_HEAD_CLASSES, _HEAD_AREA = {"art-table-header-cell", "arco-table-th"}, re.compile(r"table-head(?:er)?")
_JT_HEAD, _JT_BODY, _JT = "_jt_row_head", "_jt_body", "_jt"


@dataclass(frozen=True)
class Adapter:
    """``root``: whether a node is such a table. The others, where given, take over from the general rules."""

    name: str
    root: Callable[[Node], bool]
    rows: Callable[[Node], list[Node]] | None = None
    cells: Callable[[Node], list[Node] | None] | None = None
    heads: Callable[[Node], list[Node]] | None = None


def _by_id(node: Node, name: str) -> Node | None:
    return next((n for n in node.walk() if n.attrs.get("id") == name), None)


def _jt_rows(table: Node) -> list[Node]:
    body = _by_id(table, _JT_BODY)
    return [n for n in body.walk() if {"_jt_row", "_jt_rh"} <= n.classes] if body else []


def _jt_cells(row: Node) -> list[Node] | None:
    if not {"_jt_row", "_jt_rh"} <= row.classes:
        return None
    box = lambda c: not c.text().strip() and any(n.tag == "input" and n.attrs.get("type") in ("checkbox", "radio") for n in c.walk())
    return [c for c in row.children if not c.hidden and "_jt_cell_index" not in c.classes and not box(c)]


def _jt_heads(table: Node) -> list[Node]:
    head = _by_id(table, _JT_HEAD)
    shown = [n for n in head.walk() if "_jt_cell_head" in n.classes] if head else []
    return [n for n in shown if not n.hidden and not {"_jt_cell_head_index", "_jt_cbx"} & n.classes and n.text().strip()]


def _jt_root(node: Node) -> bool:
    for c in node.children:
        if c.attrs and c.attrs.get("id") == _JT_HEAD:
            return True
    return False


def _class_root(name: str) -> Callable[[Node], bool]:
    return lambda n: name in n.classes


#: The first that fits a node is its adapter.
ADAPTERS = (
    Adapter("ant", _class_root("ant-table-wrapper")),
    Adapter("arco", _class_root("arco-table")),
    Adapter("art-table", _class_root("art-table")),
    Adapter("aria", lambda n: n.role in _TABLE_ROLES),
    Adapter("generic", _jt_root, _jt_rows, _jt_cells, _jt_heads),
    Adapter("native", lambda n: n.tag == "table"),
)


def _is_head(row: Node, injected: str) -> bool:
    for n in row.walk():
        if (n.tag == "th" or n.role in _HEAD_ROLES or n.tag == "td" and n.attrs.get("scope") in ("col", "row")) and injected not in n.attrs:
            return True
    return False


@lru_cache(1000)
def _is_head_area(classes: frozenset[str]) -> bool:
    return any(_HEAD_AREA.search(c) for c in classes)


class Page:
    """The tables of a parsed page."""

    def __init__(self, root: Node, adapters: tuple[Adapter, ...] = ADAPTERS, injected: str = "data-derived-column"):
        self.root, self.adapters, self.injected = root, adapters, injected
        self.own_cells = [a.cells for a in adapters if a.cells]
        self.feet: dict[int, bool] = {}
        self.titles: dict[int, str] = {}

    @cached_property
    def tables(self) -> list[Node]:
        general = [a.root for a in self.adapters if a.rows is None]
        own = [a for a in self.adapters if a.rows is not None]
        own_roots = [a.root for a in own]
        found, special = [], []
        for n in self.root.walk():
            for fits in general:
                if fits(n):
                    found.append(n)
                    break
            else:
                for fits in own_roots:
                    if fits(n):
                        special.append(n)
                        break
                else:
                    if n.attrs and n.attrs.get("id") == _JT:
                        special.append(n)
        taken = {n.number for n in found}
        holds = {n.number for n in found + special if any(a.rows(n) or a.heads(n) for a in own)}
        return [n for n in found + special if n.number in holds or not any(p.number in taken for p in n.up() if p is not n)]

    def is_foot(self, row: Node) -> bool:
        """Whether a row or what is around it is a table's foot; told once for each element."""
        path, node = [], row
        while node is not None and node.number not in self.feet:
            path.append(node.number)
            if node.tag == "tfoot" or not _FOOT_CLASSES.isdisjoint(node.classes) or node.role == "rowgroup" and "summary" in (node.attrs.get("aria-label") or "").lower():
                self.feet[node.number] = True
                break
            node = node.parent
        known = node is not None and self.feet[node.number]
        self.feet.update(dict.fromkeys(path, known))
        return known

    def adapter(self, table: Node) -> Adapter | None:
        return next((a for a in self.adapters if a.root(table)), None)

    def cells(self, row: Node) -> list[Node]:
        """The adapter's, table cells, cells by role, any cell by meaning, else what lies directly within."""
        for own in self.own_cells:
            if (found := own(row)) is not None:
                return [c for c in found if self.injected not in c.attrs]
        inner = row.walk()
        if row.tag == "tr":
            found = [n for n in inner if n.tag in ("td", "th")]
        else:
            found = [n for n in inner if n.role in _CELL_ROLES] if row.role == "row" else []
            found = found or [n for n in inner if n.tag in ("td", "th") or n.role in _CELL_ROLES or "scope" in n.attrs]
            found = found or [n for n in row.children if not n.hidden]
        return [c for c in found if self.injected not in c.attrs]

    def rows(self, table: Node) -> list[Node]:
        a = self.adapter(table)
        if a and a.rows:
            found = a.rows(table)
        else:
            inner = table.walk()
            found = [
                n for n in inner
                if n.tag == "tr" and n.within(lambda p: p.tag == "tbody") or n.role == "row"
                or n.classes and (not _ROW_CLASSES.isdisjoint(n.classes) or "_jt_row" in n.classes and "_jt_rh" in n.classes)
            ]
            if not found and table.tag == "table":  # parsers of browsers put in a body
                found = [n for n in inner if n.tag == "tr" and n.parent.tag not in ("thead", "tfoot")]
            owner = lambda r: r.within(lambda n: n.tag == "table" or n.role in _TABLE_ROLES)
            direct = [r for r in found if (o := owner(r)) is None or o is table or not table.number < o.number <= table.last]
            found = direct or found
        return [r for r in found if not _is_head(r, self.injected) and not self.is_foot(r)]

    def heads(self, table: Node) -> list[Node]:
        """A whole header area, the adapter's, the header row that belongs to the first data row, else the first row."""
        found = [
            n for n in table.walk()
            if n.tag == "th" and (n.within(lambda p: p.tag == "thead" or "ant-table-thead" in p.classes) or n.attrs.get("scope") == "col") or n.role == "columnheader"
            or n.classes and (not _HEAD_CLASSES.isdisjoint(n.classes) or "cell" in n.attrs["class"] and any(_is_head_area(p.classes) for p in n.parent.up() if p.number > table.number))
        ]
        a = self.adapter(table)
        if not found and a and a.heads:
            found = a.heads(table)
        if not found:
            rows = [n for n in table.walk() if n.tag == "tr" or n.role == "row" or not _ROW_CLASSES.isdisjoint(n.classes)]
            data = next((r for r in rows if not _is_head(r, self.injected) and self.cells(r)), None)
            head = self.head_above(data) if data is not None else next((r for r in rows if _is_head(r, self.injected)), None)
            if head is not None:
                found = self.cells(head)
            elif rows:
                found = [n for n in rows[0].walk() if n.tag in ("td", "th") or n.role in ("cell", "gridcell") or _CELL_CLASSES & n.classes]
        return [c for c in found if self.injected not in c.attrs]

    def head_above(self, row: Node) -> Node | None:
        """Of its own table, of what stands beside it or its ancestors (before it first), of its region."""
        table = row.within(lambda n: n.tag == "table") if row.tag == "tr" else None
        if table is not None and (found := self.head_in(table, row)) is not None:
            return found
        for node in row.up():
            if node.parent is None:
                break
            beside = [c for c in node.parent.children if c is not node]
            for c in [*(c for c in beside if c.number < node.number), *(c for c in beside if c.number > node.number)]:
                if (found := self.head_in(c)) is not None:
                    return found
        region = row.within(lambda n: n.tag in ("#page", "body", "dialog") or n.role in ("dialog", "tabpanel", "region"))
        return self.head_in(region, row) if region is not None else None

    def head_in(self, node: Node, before: Node | None = None) -> Node | None:
        if node.hidden:
            return None
        rows = [n for n in node.walk() if n.tag == "tr" or n.role == "row"]
        if not rows:
            return None
        early = [r for r in rows if before is None or r.number < before.number]
        first = next((r for r in rows if r.parent.tag == "thead"), None)
        if first is not None and _is_head(first, self.injected):
            return first
        return next((r for kind in ("tr", "row") for r in early if (r.tag == "tr") == (kind == "tr") and _is_head(r, self.injected)), None)

    def title(self, table: Node) -> str:
        if table.number not in self.titles:
            self.titles[table.number] = self.find_title(table)
        return self.titles[table.number]

    def find_title(self, table: Node) -> str:
        caption = next((n.text() for n in table.walk() if n.tag == "caption"), "")
        found = [caption, table.attrs.get("aria-label", ""), table.attrs.get("data-title", "")]
        named = lambda n: any(w in (n.attrs.get("class") or "").lower() for w in ("card-title", "header-title", "table-title"))
        for node, _ in zip(table.up(), range(4)):
            near = [c for c in node.children if c.tag in ("h1", "h2", "h3", "h4") or named(c)] + [g for c in node.children for g in c.children if named(g)]
            near = [n for n in near if n.within(lambda p: p.tag in ("thead", "tr") or p.role == "row") is None]
            found += [min(near, key=lambda n: n.number).text()] if near else []
        clean = (" ".join(t.split()) for t in found)
        return next((t for t in clean if t and len(t) <= 40), "")

    def kind(self, table: Node) -> str:
        for a in self.adapters:
            if a.name not in ("aria", "native", "generic") and table.within(a.root) is not None:
                return a.name
        return "aria" if table.role in _TABLE_ROLES else "native" if table.tag == "table" else "generic"

    def signature(self, table: Node) -> str:
        out = []
        for node, _ in zip(table.up(), range(4)):
            for name, value in (("id", node.attrs.get("id")), ("test", node.attrs.get("data-testid") or node.attrs.get("data-test-id")), ("aria", node.attrs.get("aria-label"))):
                if value and value.strip():
                    out.append(f"{name}:{' '.join(value.split())}")
        title = self.title(table)
        return "|".join([*out, *([f"title:{title}"] if title else [])][:5])

    @staticmethod
    def selector(table: Node) -> str:
        """By the nearest id, else by places from the page down."""
        steps = []
        for node in table.up():
            if node.attrs.get("id"):
                return " > ".join([f"#{node.attrs['id']}", *steps])
            if node.parent is None:
                break
            same = [c for c in node.parent.children if c.tag == node.tag]
            steps.insert(0, f"{node.tag}:nth-of-type({same.index(node) + 1})")
        return " > ".join(steps)

    def raw_rows(self, table: Node) -> list[list[str]]:
        out = []
        for row in self.rows(table):
            cells: list[str] = []
            for c in self.cells(row)[:MAX_CELLS]:
                span = c.attrs.get("colspan") or "1"
                cells += [c.text(self.injected), *[""] * (columns_of(span) - 1)]
            out.append(cells)
        return out


_S, _LIST = T.StringType(), T.ArrayType(T.StringType())
_TABLE = T.StructType([
    T.StructField("table_index", T.IntegerType()), T.StructField("component_type", _S), T.StructField("selector", _S), T.StructField("table_title", _S),
    T.StructField("container_signature", _S), T.StructField("headers", _LIST), T.StructField("rows", T.ArrayType(_LIST)), T.StructField("ancestors", T.ArrayType(T.IntegerType())),
])
_TEXTS, _GRID = pa.list_(pa.string()), pa.list_(pa.list_(pa.string()))
_ARROW = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), _TEXTS, _GRID, pa.list_(pa.int32())]


def _each_page(pages: DataFrame, html: str, schema: T.StructType, types: list, read: Callable[[Node], list[tuple]]) -> DataFrame:
    """Columns of ``pages`` but the html, with the rows that ``read`` makes of each page. Pages don't shuffle."""
    keep = [c for c in pages.columns if c != html and c not in schema.names]
    n, names = len(keep), [*keep, *schema.names]

    def run(batches):
        for batch in batches:
            owner, found = [], []
            for i, text in enumerate(batch.column(n).to_pylist()):
                for row in read(parse(text)):
                    owner.append(i)
                    found.append(row)
            columns = list(zip(*found)) or [()] * len(types)
            kept = batch.take(pa.array(owner, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(kept.column(i) for i in range(n)), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    return pages.select(*(F.col(f"`{c}`") for c in [*keep, html])).mapInArrow(run, T.StructType([*(pages.schema[c] for c in keep), *schema.fields]))


def page_tables(pages: DataFrame, html: str = "html", adapters: tuple[Adapter, ...] = ADAPTERS, injected: str = "data-derived-column") -> DataFrame:
    """The tables of each page as they are described when they are bound: ``table_index, component_type, selector,
    selector_strength, table_title, container_signature, headers`` (blank ones go, 80 at most), ``header_fingerprint,
    preview``, and ``rows`` (aligned to the headers, empty ones without), ``ancestors`` (numbers of the nodes above). A null or
    broken html has the tables that can be read in it."""

    def read(root):
        page, out = Page(root, adapters, injected), []
        for k, t in enumerate(page.tables):
            heads = [h.text(injected) for h in page.heads(t)]
            out.append((k, page.kind(t), page.selector(t), page.title(t), page.signature(t), heads, page.raw_rows(t), [n.number for n in t.up()]))
        return out

    raw = _each_page(pages, html, _TABLE, _ARROW, read)
    headers = F.slice(F.filter(F.transform("headers", tx.business_text), lambda h: h != ""), 1, MAX_CELLS)
    clean = raw.withColumn("headers", headers)
    rows = F.filter(F.transform("rows", lambda r: align_cells(F.transform(r, tx.business_text), F.size("headers"))), lambda r: F.exists(r, lambda c: c != ""))
    strength = F.when(F.contains("selector", F.lit("#")), "stable-id").otherwise("positional")
    preview = F.coalesce(F.nullif(F.array_join("headers", "、"), F.lit("")), F.lit("未识别到数据源字段"))
    return clean.withColumn("rows", rows).withColumns({"selector_strength": strength, "header_fingerprint": F.array_join(F.transform("headers", tx.norm_header), "|"), "preview": preview})


def swap_bodies(tables: DataFrame, key: str) -> DataFrame:
    """Tables (from ``page_tables``) without rows get those of the table on their page whose headers fit best, if these
    cover 0.9 of theirs: it then is their ``body_index``. A table with rows is its own body."""
    c = F.col
    mine = F.struct(c("table_index").alias("i"), F.transform("headers", tx.norm_header).alias("names"), c("ancestors").alias("above"), F.size("rows").alias("n"))
    described = tables.withColumn("__t", mine).withColumn("__empty", c(key).isNotNull() & (c("__t.n") == 0))
    # a page's tables are read once: each of them sees what describes those with rows
    page = Window.partitionBy(key)
    beside = F.collect_list(F.when(c("__t.n") > 0, c("__t"))).over(page)
    held = described.withColumn("__full", F.when(c("__empty"), beside))

    def fit(o):
        cover = tx.coverage_of(c("__t.names"), o["names"])
        apart = F.array_position(F.transform(F.slice(c("__t.above"), 1, 9), lambda x: F.array_contains(o["above"], x)), True) - 1
        parent = F.coalesce(F.get(c("__t.above"), F.lit(1)) == F.get(o["above"], F.lit(1)), F.lit(False))
        near = F.when(parent, 3).otherwise(0) + F.when(apart >= 0, F.greatest(F.lit(0), 4 - apart)).otherwise(0)
        return tx.let(cover, lambda v: F.struct((-(v * 10 + near)).alias("score"), (-v).alias("cover"), (-o["n"]).alias("n"), o["i"].alias("i")))

    best = F.array_min(F.transform("__full", fit))
    swapped = tx.let(best, lambda x: F.when(x["cover"] <= -0.9, x["i"]))
    return held.withColumn("body_index", F.coalesce(F.when(c("__empty"), swapped), "table_index")).drop("__t", "__empty", "__full")


def table_diagnostics(tables: DataFrame, key: str) -> DataFrame:
    """``(key, table_index, rows, different, filled)``: rows of each table, different ones, and filled cells in all."""
    rows = tables.select(key, "table_index", F.explode("rows").alias("r"))
    filled = F.size(F.filter("r", lambda x: x != ""))
    return rows.groupBy(key, "table_index").agg(F.count("*").alias("rows"), F.countDistinct("r").alias("different"), F.sum(filled).alias("filled"))


_PAGER = T.StructType([T.StructField("pager_index", T.IntegerType()), T.StructField("active", T.IntegerType()), T.StructField("labels", T.ArrayType(T.IntegerType()))])
#: How a pager and its active page are marked.
_PAGERS, _ACTIVE = {"ant-pagination", "arco-pagination", "el-pagination", "pagination", "art-pagination"}, re.compile(r"(?:^|-)(?:active|current)$")


def page_pagers(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pager_index, active, labels``: the pagers of each page, with the numbers that they show."""

    def read(root):
        out = []
        for k, pager in enumerate(n for n in root.walk() if _PAGERS & n.classes or n.role == "navigation" and "paginat" in (n.attrs.get("aria-label") or "").lower()):
            leaves = [n for n in pager.walk() if n.tag in ("li", "button", "a", "span") and n.text().strip().isdecimal() and len(n.text().strip()) < 7]
            marked = [n for n in leaves if n.attrs.get("aria-current") in ("page", "true") or any(_ACTIVE.search(c) for p in n.up() if p.number > pager.number for c in p.classes)]
            out.append((k, int(marked[0].text()) if marked else None, sorted({int(n.text()) for n in leaves})))
        return out

    return _each_page(pages, html, _PAGER, [pa.int32(), pa.int32(), pa.list_(pa.int32())], read)


def pager_state(pagers: DataFrame, key: str, expected: Column | None = None) -> DataFrame:
    """``(key, current, last, is_last, is_first, multiple)`` by a page's pager: that whose active page is the expected one,
    else the first with an active page."""
    c = F.col
    fits = F.lit(False) if expected is None else F.coalesce(c("active") == expected, F.lit(False))
    best = pagers.groupBy(key).agg(F.min_by(F.struct("active", "labels"), F.struct((~fits).alias("a"), c("active").isNull().alias("b"), "pager_index")).alias("p"))
    current, last = c("p.active"), F.greatest(F.coalesce(F.array_max("p.labels"), F.lit(1)), F.coalesce("p.active", F.lit(1)))
    return best.select(key, current.alias("current"), last.alias("last"), F.coalesce(current >= last, F.lit(False)).alias("is_last"), F.coalesce(current <= 1, F.lit(False)).alias("is_first"), (last > 1).alias("multiple"))


_MAIN = T.StructType([T.StructField("title", _S), T.StructField("main", _S)])


def page_texts(pages: DataFrame, html: str = "html", url: str = "url", most: int = 12_000) -> DataFrame:
    """``text`` of each page: title, address, and the longest of its articles, mains and body, cut to ``most``."""

    def read(root):
        title = next((n.text() for n in root.walk() if n.tag == "title"), "")
        parts = [n for n in root.walk() if n.tag in ("article", "main", "body") or n.role == "main"] or [root]
        return [(title, max((n.text() for n in parts), key=lambda t: len(t.strip())))]

    found = _each_page(pages, html, _MAIN, [pa.string(), pa.string()], read)
    whole = F.concat(F.lit("Title: "), tx.one_line(F.col("title")), F.lit("\nURL: "), F.coalesce(url, F.lit("")), F.lit("\n\n"), tx.normalize_text(F.col("main")))
    return found.withColumn("text", tx.truncate_text(whole, most)).drop("title", "main")


_TAB = T.StructType([T.StructField("tab_index", T.IntegerType()), T.StructField("kind", _S), T.StructField("title", _S), T.StructField("active", T.BooleanType())])


def page_tabs(pages: DataFrame, html: str = "html") -> DataFrame:
    """``tab_index, kind, title, active``: the business tabs of each page. Tabs of the frame's own kind count alone; the
    general ones only on pages of that frame (its tables, or frames of its pages)."""

    def read(root):
        nodes = root.walk()
        own = [n for n in nodes if any(c.endswith("-realTab") for c in n.classes)]
        if own:
            on = lambda n: "true" in (n.attrs.get("aria-selected"), n.attrs.get("data-active"))
            return [(k, "realTab", " ".join(n.text().split()), on(n)) for k, n in enumerate(own)]
        framed = lambda n: n.tag == "iframe" and (".aspx" in n.attrs.get("src", "") or n.attrs.get("id", "").startswith("epaas-tab-"))
        if not any(n.attrs.get("id") == _JT or framed(n) for n in nodes):
            return []
        general = [n for n in nodes if "ant-tabs-tab-btn" in n.classes or n.role == "tab" and "aria-controls" in n.attrs]
        titled = [(n, " ".join(next((c for c in n.walk() if "title" in (c.attrs.get("class") or "")), n).text().split())) for n in general]
        return [(k, "ant", t, n.attrs.get("aria-selected") == "true") for k, (n, t) in enumerate(x for x in titled if x[1])]

    return _each_page(pages, html, _TAB, [pa.int32(), pa.string(), pa.string(), pa.bool_()], read)


def tab_titles(tabs: DataFrame, key: str, confirmed: Column | None = None) -> DataFrame:
    """``(key, titles, active_title)``: different titles in order, and the active tab's: the one marked, else the confirmed
    one, else the last."""
    c = F.col
    first = tabs.where("title <> ''").groupBy(key, "title").agg(F.min("tab_index").alias("i"))
    titles = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "title"))).alias("t"))
    marked = tabs.groupBy(key).agg(F.min_by("title", F.when(c("active"), c("tab_index"))).alias("__on"), F.max_by("title", "tab_index").alias("__last"))
    sure = F.lit(None).cast("string") if confirmed is None else confirmed
    named = F.coalesce(F.nullif(c("__on"), F.lit("")), F.when(F.array_contains(F.transform("t", lambda x: x["title"]), sure), sure), c("__last"))
    return titles.join(marked, key).select(key, F.transform("t", lambda x: x["title"]).alias("titles"), named.alias("active_title"))


# fixed values: how elements read in Markdown
_AROUND = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~", "strike": "~~"}
_GONE = {"script", "style", "iframe", "object", "embed"}
_KNOWN = re.compile(r"<(?:br|p|div|strong|b|em|i|h[1-6]|ul|ol|li|a|code|pre|blockquote|del|s|strike|hr|table|thead|tbody|tr|th|td|img|script|style|iframe|object|embed)\b", re.I)
_CODE = re.compile(r"```[\s\S]*?```|`[^`\n]*`")


def _table_markdown(table: Node) -> str:
    texts = {c.number: c.text().strip().replace("|", "\\|") for c in table.walk() if c.tag in ("td", "th")}  # cells of nested tables count for every row around them
    rows = [[texts[c.number] for c in r.walk() if c.number in texts] for r in table.walk() if r.tag == "tr"]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join([*r, *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def _styled(node: Node, own: list[str]) -> str:
    """An element around the Markdown of what it holds; a list is given the Markdown of each item."""
    tag = node.tag
    if tag in ("ul", "ol"):
        return "\n" + "\n".join(f"{f'{k}.' if tag == 'ol' else '-'} {item.strip()}" for k, item in enumerate(own, 1)) + "\n"
    inner = "".join(own)
    if tag in _AROUND:
        return _AROUND[tag] + inner + _AROUND[tag]
    if tag in ("p", "div"):
        return f"\n\n{inner}\n\n"
    if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        return f"\n\n{'#' * min(3, int(tag[1]))} {inner.strip()}\n\n"
    if tag == "blockquote":
        return "\n\n" + "\n".join(f"> {line}" for line in inner.strip().split("\n")) + "\n\n"
    if tag == "a":
        href = node.attrs.get("href", "")
        label = inner.strip() or href
        return f"[{label}]({href})" if re.match("https?://", href, re.I) else label
    return inner


#: Elements that read as a whole.
_WHOLE = {
    "br": lambda n: "\n", "hr": lambda n: "\n\n---\n\n", "pre": lambda n: f"\n\n```\n{n.text().strip()}\n```\n\n", "code": lambda n: f"`{n.text()}`",
    "img": lambda n: n.attrs.get("alt", ""), "table": lambda n: f"\n\n{_table_markdown(n)}\n\n",
}


def _markdown(parts: list) -> str:
    """Elements of any depth: what is open stands on a list, not on the stack."""
    top: list[str] = []
    opened: list[tuple] = [(None, iter(parts), top)]
    while opened:
        node, rest, own = opened[-1]
        part = next(rest, None)
        if part is None:
            opened.pop()
            if node is not None:
                opened[-1][2].append(_styled(node, own))
        elif isinstance(part, str):
            own.append(part)
        elif part.tag in _WHOLE:
            own.append(_WHOLE[part.tag](part))
        elif part.tag not in _GONE:
            held = [c for c in part.children if c.tag == "li"] if part.tag in ("ul", "ol") else part.parts
            opened.append((part, iter(held), []))
    return "".join(top)


def to_markdown(text: str | None) -> str:
    """Markdown of a text with HTML in it; a text without known tags stays, and so does code."""
    text = text or ""
    if not _KNOWN.search(text):
        return text
    held: list[str] = []
    plain_too = unescape(text)
    mark = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in text and c not in plain_too)  # stands around a code's number

    def hold(found):
        held.append(found[0])
        return f"{mark}{len(held) - 1}{mark}"

    root = parse(_CODE.sub(hold, text))
    body = next((n for n in root.walk() if n.tag == "body"), root)
    plain = re.sub(r"\n{3,}", "\n\n", re.sub(r"(?<![ \t])[ \t]+\n", "\n", _markdown(body.parts))).strip()
    return re.sub(f"{mark}([0-9]+){mark}", lambda m: held[int(m[1])], plain)


def html_markdown(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` columns without the html, and ``markdown``. Unsafe elements go, unknown ones leave their text, only http(s)
    links stay."""
    keep = [c for c in pages.columns if c not in (html, "markdown")]
    n = len(keep)

    def run(batches):
        for batch in batches:
            made = pa.array([to_markdown(t) for t in batch.column(n).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), made], names=[*keep, "markdown"])

    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField("markdown", _S)])
    return pages.select(*(F.col(f"`{c}`") for c in [*keep, html])).mapInArrow(run, schema)


# fixed values: what a page's outline holds
_HEADINGS, _CONTROLS, _TABLES, _SAMPLES = 18, 26, 4, 3
_OUTLINE = T.StructType([T.StructField("title", _S), T.StructField("headings", _LIST), T.StructField("controls", _LIST), T.StructField("tables", T.ArrayType(T.StructType([T.StructField("headers", _LIST), T.StructField("samples", T.ArrayType(_LIST))]))), T.StructField("main", _S)])
_OUTLINE_ARROW = [pa.string(), _TEXTS, _TEXTS, pa.list_(pa.struct([("headers", _TEXTS), ("samples", _GRID)])), pa.string()]


def page_outlines(pages: DataFrame, html: str = "html", url: str = "url", most: int = 8000) -> DataFrame:
    """``outline`` of each page: title, address, headings, different controls in the page's order, first tables with sample
    rows, and the beginning of its text."""

    def control(n: Node) -> str:
        kind = n.tag + (f"[role={n.role}]" if n.role else "") + (f"[type={n.attrs['type']}]" if n.attrs.get("type") else "")
        off = " disabled" if "disabled" in n.attrs or n.attrs.get("aria-disabled") == "true" else ""
        label = next((t for t in (" ".join(x.split()) for x in (n.attrs.get("aria-label", ""), n.text(), n.attrs.get("placeholder", ""), n.attrs.get("title", ""), n.attrs.get("name", ""))) if t), "")
        return f"{kind}{off}: {label[:80] or '(no text)'}"

    def read(root):
        nodes = [n for n in root.walk() if not n.hidden]
        page = Page(root)
        headings = [n.text() for n in nodes if n.tag in ("h1", "h2", "h3") or n.role == "heading"]
        controls = [control(n) for n in nodes if n.tag in ("button", "a", "input", "select", "textarea") or n.role in ("button", "tab", "menuitem")]
        tables = []
        for t in [n for n in nodes if n.tag == "table"][:_TABLES]:
            heads = [n.text() for n in t.walk() if n.tag in ("th", "td") and n.within(lambda p: p.tag == "thead") or n.attrs.get("scope") == "col" or n.role == "columnheader"]
            body = [r for r in t.walk() if r.tag == "tr" and not _is_head(r, page.injected)]
            tables.append({"headers": heads, "samples": [c for c in ([x.text() for x in page.cells(r)] for r in body) if c][:_SAMPLES]})
        title = next((n.text() for n in root.walk() if n.tag == "title"), "")
        parts = [n for n in root.walk() if n.tag in ("article", "main", "body") or n.role == "main"] or [root]
        return [(title, headings, list(dict.fromkeys(controls))[:_CONTROLS], tables, max((n.text() for n in parts), key=lambda t: len(t.strip())))]

    c = F.col
    found = _each_page(pages, html, _OUTLINE, _OUTLINE_ARROW, read)
    clean = lambda x: F.filter(F.transform(x, lambda t: tx.one_line(t)), lambda t: t != "")
    block = lambda name, lines: F.when(F.size(lines) > 0, F.concat(F.lit(f"\n{name}:\n"), F.array_join(lines, "\n")))
    listed = lambda x: F.transform(x, lambda t: F.concat(F.lit("- "), F.left(t, F.lit(120))))
    rows = lambda s: F.transform(s["samples"], lambda r: F.concat(F.lit("\n  - row: "), F.left(tx.one_line(tx.row_text(F.transform(r, tx.business_text))), F.lit(220))))
    heads = lambda s: F.left(F.coalesce(F.nullif(F.array_join(clean(s["headers"]), " | "), F.lit("")), F.lit("(no headers found)")), F.lit(320))
    tables = F.transform("tables", lambda s, i: F.concat(F.lit("- Table "), (i + 1).cast("string"), F.lit(": columns: "), heads(s), F.array_join(rows(s), "")))
    main = F.nullif(tx.normalize_text(c("main")), F.lit(""))
    text = F.concat_ws(
        "\n", F.lit("PAGE_SNAPSHOT v1"), F.concat(F.lit("Title: "), tx.one_line(c("title"))), F.concat(F.lit("URL: "), F.coalesce(url, F.lit(""))), block("HEADINGS", listed(F.slice(clean(c("headings")), 1, _HEADINGS))),
        block("ACTIONS_AND_FIELDS", F.transform("controls", lambda t: F.concat(F.lit("- "), t))), block("TABLES", tables), F.concat(F.lit("\nPAGE_TEXT_SNIPPET:\n"), F.left(main, F.lit(1600))),
    )
    return found.withColumn("outline", tx.truncate_text(text, most)).drop(*_OUTLINE.names)
