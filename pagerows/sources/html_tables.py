"""Tables of web pages as rows of cells."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import UNIT_SEPARATOR, business_text, let
from ..operators.rows import first_seen

#: Cells of a row at most (a fixed value).
MAX_CELLS = 80
_TABLE_ROLES, _CELL_ROLES = {"table", "grid", "treegrid"}, {"cell", "gridcell", "columnheader", "rowheader"}
_HIDDEN, _VOID = {"script", "style", "template", "noscript"}, set("area base br col embed hr img input link meta source track wbr".split())
#: What a start tag ends in its table.
_ENDS = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "thead": ("tr",), "tbody": ("tr", "thead"), "tfoot": ("tr", "tbody")}


def columns_of(span: str) -> int:
    """Of a colspan, whatever stands there."""
    if not (span.isascii() and span.isdigit()):
        return 1
    return max(1, min(int(span), MAX_CELLS)) if len(span) < 10 else MAX_CELLS


class _Tables(HTMLParser):
    """Collects ``[title, header cells, [body rows]]`` of each table that lies in no other; a cell is (text, span)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list = []
        self.open: list = []  # (tag, what it is) of the elements that are open
        self.row: list | None = None
        self.text: list | None = None
        self.caption = False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        for left_open in _ENDS.get(tag, ()):  # end tags that may be left out
            within = [t for t, _ in self.open]
            within = within[len(within) - within[::-1].index("table") :] if "table" in within else []
            if left_open in within:
                self.handle_endtag(left_open)
        role, kinds = a.get("role") or "", [k for _, k in self.open]
        kind = ""
        if tag in _HIDDEN or "display:none" in (a.get("style") or "").replace(" ", ""):
            kind = "hidden"
        elif tag == "table" or role in _TABLE_ROLES:
            kind = "nested" if "table" in kinds else "table"
            if kind == "table":
                self.tables.append([a.get("aria-label") or a.get("data-title") or "", None, []])
        elif "table" in kinds and "nested" not in kinds:
            if tag in ("thead", "tfoot", "caption"):
                kind = tag
                self.caption = tag == "caption"
            elif tag == "tr" or role == "row":
                kind, self.row, self.head = "row", [], False
            elif self.row is not None and self.text is None and (tag in ("td", "th") or role in _CELL_ROLES):
                kind, self.text = "cell", []
                span = a.get("colspan") or "1"
                self.span = columns_of(span)
                self.head = self.head or tag == "th" or role in ("columnheader", "rowheader") or "scope" in a
        if tag == "br" and self.text is not None:
            self.text.append("\n")
        if tag not in _VOID:
            self.open.append((tag, kind))

    def handle_endtag(self, tag):
        if tag not in (t for t, _ in self.open):
            return
        while self.open:
            name, kind = self.open.pop()
            if kind == "cell":
                self.row.append(("".join(self.text), self.span))
                self.text = None
            elif kind == "row":
                self.close_row([k for _, k in self.open])
            elif kind == "caption":
                self.caption = False
            if name == tag:
                return

    def parse_marked_section(self, i, report=1):  # as browsers: a comment, where the library may raise
        return self.parse_bogus_comment(i)

    def close_row(self, kinds):
        table, row, self.row = self.tables[-1], self.row, None
        if not row or "tfoot" in kinds:
            return
        if self.head or "thead" in kinds:
            if table[1] is None and not table[2]:
                table[1] = row
        else:
            table[2].append(row)

    def handle_data(self, data):
        kinds = {k for _, k in self.open}
        if "hidden" in kinds or "nested" in kinds:
            return
        if self.text is not None:
            self.text.append(data)
        elif self.caption and not self.tables[-1][0].strip():
            self.tables[-1][0] = data


def _spread(row: list) -> list[str]:
    out: list[str] = []
    for text, span in row:
        out += [text, *[""] * (span - 1)]
    return out[:MAX_CELLS]


_RAW = T.StructType([T.StructField("table_index", T.IntegerType()), T.StructField("title", T.StringType()), T.StructField("headers", T.ArrayType(T.StringType())), T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType())))])
_ARROW = [pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.list_(pa.string()))]


def extract_tables(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` columns without the html, and for each outer table ``table_index``, ``title`` (at most 40 characters),
    ``headers`` (blank ones go; without a header row the first row names the columns) and ``rows``, as they are. A null
    or broken html has the tables that can be read in it. Pages don't shuffle."""
    keep = [c for c in pages.columns if c != html]
    n = len(keep)
    names = [*keep, *_RAW.names]

    def run(batches):
        for batch in batches:
            owner, found = [], []
            for i, text in enumerate(batch.column(n).to_pylist()):
                parser = _Tables()
                parser.feed(text or "")
                parser.close()
                for k, (title, head, body) in enumerate(parser.tables):
                    rows = [_spread(r) for r in body]
                    if head is None and rows:
                        head, rows = [(c, 1) for c in rows[0]], rows[1:]
                    owner.append(i)
                    found.append((k, title.strip()[:40], _spread(head or []), rows))
            columns = list(zip(*found)) or [()] * 4
            kept = batch.take(pa.array(owner, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(kept.column(i) for i in range(n)), *(pa.array(c, t) for c, t in zip(columns, _ARROW))], names=names)

    source = pages.select(*(F.col(f"`{c}`") for c in [*keep, html]))
    raw = source.mapInArrow(run, T.StructType([*(pages.schema[c] for c in keep), *_RAW.fields]))
    clean = F.filter(F.transform("headers", business_text), lambda h: h != "")
    return raw.withColumn("headers", clean)


def align_cells(cells: Column, width: Column) -> Column:
    """Cells as wide as the headers: while too many, blank ones at the front go, then those at the end; what is still
    too long is cut, what is too short gets empty cells."""

    def aligned(held: Column) -> Column:
        extra = F.greatest(F.size(held) - width, F.lit(0))
        lead = F.coalesce(F.nullif(F.array_position(F.transform(held, lambda c: c == ""), False), F.lit(0)) - 1, F.size(held)).cast("int")
        from_front = F.slice(held, F.least(lead, extra) + 1, F.greatest(F.size(held), F.lit(1)))
        padded = lambda f: F.concat(f, F.array_repeat(F.lit(""), F.greatest(width - F.size(f), F.lit(0))))
        return F.slice(let(from_front, padded), F.lit(1), F.greatest(width, F.lit(1)))

    return F.when(width > 0, let(cells, aligned)).otherwise(cells)


def extract_table_rows(pages: DataFrame, key: str, html: str = "html", dedupe: bool = True) -> DataFrame:
    """``(key, table_index, row_pos, cells)``: cleaned body rows as wide as their headers; empty rows go and, with
    ``dedupe``, repeats of a row in its table."""
    tables = extract_tables(pages.select(key, html), html)
    long = tables.select(key, "table_index", F.size("headers").alias("__w"), F.posexplode("rows").alias("row_pos", "__r"))
    cells = align_cells(F.transform("__r", business_text), F.col("__w"))
    rows = long.select(key, "table_index", "row_pos", cells.alias("cells")).where(F.exists("cells", lambda c: c != ""))
    return first_seen(rows, [key, "table_index"], F.array_join("cells", UNIT_SEPARATOR), [F.col("row_pos")]) if dedupe else rows
