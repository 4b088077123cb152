"""Column functions over texts, headers, cells and budgets. Null counts as the empty text unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators of cells in a row's text and in a row's fingerprint (fixed values).
CELL_SEPARATOR, UNIT_SEPARATOR = " ||| ", "␟"
_SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it: an expression inside a lambda would be
    evaluated again for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def business_text(c: Column) -> Column:
    """No-break spaces become spaces, zero-width characters go, white space shrinks to one space, ends are trimmed."""
    plain = F.regexp_replace(F.regexp_replace(_text(c), r"\x{00A0}", " "), r"[\x{200B}-\x{200D}\x{FEFF}]", "")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def normalize_text(c: Column) -> Column:
    """Blanks before line ends go, three or more line ends become two, ends are trimmed."""
    plain = F.regexp_replace(F.regexp_replace(_text(c), r"\x{00A0}", " "), r"(?<![ \t])[ \t]+\n", "\n")
    return F.regexp_replace(F.regexp_replace(plain, r"\n{3,}", "\n\n"), r"^\s+|(?<!\s)\s+$", "")


def truncate_text(c: Column, limit: int) -> Column:
    def cut(whole: Column) -> Column:
        rest = F.length(whole) - limit
        return F.when(rest > 0, F.concat(F.left(whole, F.lit(limit)), F.lit("\n\n[Truncated: "), rest.cast("string"), F.lit(" chars]"))).otherwise(whole)

    return let(normalize_text(c), cut)


def one_line(c: Column, limit: int | None = None) -> Column:
    line = F.trim(F.regexp_replace(_text(c), r"\s+", " "))
    return line if limit is None else F.when(F.length(line) > limit, F.concat(F.left(line, F.lit(limit)), F.lit("…"))).otherwise(line)


def norm_header(c: Column) -> Column:
    return F.lower(F.regexp_replace(_text(c), _SPACE, ""))


def row_text(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda x: F.when(_text(x) == "", "-").otherwise(x)), CELL_SEPARATOR)


def split_cells(text: Column) -> Column:
    return F.transform(F.split(text, r" \|\|\| "), lambda x: F.trim(x))


def fingerprint_text(c: Column) -> Column:
    """As ``normalize_text``, but without zero-width characters and carriage returns at line ends."""
    whole = normalize_text(F.regexp_replace(F.regexp_replace(_text(c), r"[\x{200B}-\x{200D}\x{FEFF}]", ""), "\r\n?", "\n"))
    return F.when(_text(c).rlike("[^!-~]"), whole).otherwise(_text(c))  # ASCII without white space stays


def row_fingerprint(cells: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.transform(cells, fingerprint_text), UNIT_SEPARATOR), 256))


def leading_fingerprint(text: Column, columns: int = 3) -> Column:
    """Number and 32-bit FNV-1a hash (base 36) of a row text's first cells that aren't empty or a dash."""
    cells = F.filter(F.transform(F.split(text, r"\s*\|\|\|\s*"), business_text), lambda x: (x != "") & (x != "-"))
    first = F.slice(cells, 1, columns)
    # fixed values: offset and prime of 32-bit FNV-1a; a character beyond 16 bits counts by its first UTF-16 unit
    code = lambda ch: F.when(F.ascii(ch) < 65536, F.ascii(ch)).otherwise(55296 + F.shiftright(F.ascii(ch) - 65536, 10))
    step = lambda h, ch: (h.bitwiseXOR(code(ch).cast("long")) * 16777619).bitwiseAND(4294967295)
    chars = F.filter(F.split(F.array_join(first, "\x1f"), ""), lambda ch: ch != "")
    hashed = F.lower(F.conv(F.aggregate(chars, F.lit(2166136261), step).cast("string"), 10, 36))
    return F.when(F.size(first) > 0, F.concat(F.size(first).cast("string"), F.lit(":"), hashed)).otherwise("")


def row_identity(table: Column, business_key: Column, virtual_index: Column, row_text: Column, index: Column) -> Column:
    """The best name that a row has: business key, virtual index, leading fingerprint with its index, or index."""
    leading = F.nullif(leading_fingerprint(row_text), F.lit(""))
    named = F.coalesce(
        F.concat(F.lit("business:"), F.nullif(F.trim(business_key), F.lit(""))),
        F.concat(F.lit("virtual:"), virtual_index.cast("string")),
        F.concat(F.lit("fingerprint:"), leading, F.lit(":row:"), index.cast("string")),
        F.concat(F.lit("row:"), index.cast("string")),
    )
    return F.concat(table, F.lit("::"), named)


def cache_key(prefix: str, analysis: Column, row: Column) -> Column:
    return F.concat_ws(":", F.lit(prefix), analysis, row)


def cache_key_row(key: Column) -> Column:
    """A row's fingerprint holds a colon itself, so it is the key's last two parts."""
    return F.array_join(F.slice(F.split(key, ":"), -2, 2), ":")


def request_budget(window: Column, max_output: Column, sources: Column) -> tuple[Column, Column]:
    """Characters of a request, and of each source's section."""
    free = F.greatest(window, F.lit(8192)) - F.greatest(max_output, F.lit(512)) - 1024
    chars = F.greatest(F.lit(2000), F.floor(free * 0.9))
    return chars, F.greatest(F.lit(600), F.floor(chars / F.greatest(sources, F.lit(1))))


def markdown_cell(c: Column) -> Column:
    return F.replace(F.regexp_replace(_text(c), "\r?\n", " "), F.lit("|"), F.lit("\\|"))


def markdown_table_row(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))


def strip_json_fence(text: Column) -> Column:
    """The inside of one fence around the whole text, else the trimmed text."""
    inside = lambda t: F.regexp_extract(t, r"(?is)^```(?:json)?\s*(.*?)\s*```$", 1)
    return let(F.regexp_replace(_text(text), r"^\s+|(?<!\s)\s+$", ""), lambda t: let(inside(t), lambda x: F.when(x != "", x).otherwise(t)))


def delta_text(event: Column) -> Column:
    """Text of one answer event; no JSON, no text."""
    at = lambda path: F.get_json_object(event, f"$.choices[0].{path}")
    return F.coalesce(at("delta.content"), at("message.content"), at("text"), F.lit(""))


def reasoning_text(event: Column) -> Column:
    """What one answer event says of the model's reasoning; no JSON, no text."""
    at = lambda path: F.get_json_object(event, f"$.choices[0].{path}")
    return F.coalesce(at("delta.reasoning_content"), at("delta.reasoning"), at("message.reasoning_content"), F.lit(""))


def result_clean(conclusion: Column, max_chars: Column, attention: Column) -> Column:
    """``(conclusion, truncated, needs_attention)``: trimmed and cut; attention only where it is said."""
    text = F.regexp_replace(_text(conclusion), r"^\s+|(?<!\s)\s+$", "")
    return F.struct(F.left(text, max_chars).alias("conclusion"), (F.length(text) > max_chars).alias("truncated"), F.coalesce(attention, F.lit(False)).alias("needs_attention"))


def csv_row(cells: Column) -> Column:
    quoted = lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.array_join(F.transform(cells, lambda x: F.when(_text(x).rlike('[",\r\n]'), quoted(_text(x))).otherwise(_text(x))), ",")


def markdown_row(cells: Column) -> Column:
    clean = lambda x: F.regexp_replace(F.replace(_text(x), F.lit("|"), F.lit("\\|")), "\r?\n", "<br>")
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, clean), " | "), F.lit(" |"))


def estimate_tokens(text: Column) -> Column:
    """One token for each non-ASCII character, and one for each four (begun) characters of an ASCII run."""
    ascii_runs = F.regexp_extract_all(text, F.lit(r"([\x00-\x7F]+)"), F.lit(1))
    others = F.length(F.regexp_replace(text, r"[\x00-\x7F]+", ""))
    return (others + F.aggregate(ascii_runs, F.lit(0), lambda a, r: a + F.ceil(F.length(r) / 4).cast("int"))).cast("long")


def context_budget(window: Column, max_output: Column, history: Column, reserve: int = 512) -> Column:
    return F.greatest(F.lit(0), window - max_output - history - reserve)


def page_key(url: Column) -> Column:
    """Origin and path, host in lower case, default port dropped; what is no http(s) url stays as it is."""
    origin = F.regexp_extract(url, r"^([A-Za-z]+://[^/?#]+)", 1)
    host = F.regexp_replace(F.lower(origin), r"^(http://.*):80$|^(https://.*):443$", "$1$2")
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1)
    return F.when(origin == "", url).otherwise(F.concat(host, F.when(path == "", "/").otherwise(path)))


def coverage(expected: Column, actual: Column) -> Column:
    """Share of the distinct normalised expected headers that are there; 1 if none is expected, 0 if there are none."""
    return coverage_of(F.transform(expected, norm_header), F.transform(actual, norm_header))


def coverage_of(expected: Column, actual: Column) -> Column:
    """The same of headers that are normalised."""
    want = F.array_distinct(F.filter(expected, lambda h: h != ""))
    return let(want, lambda w: F.when(F.size(w) == 0, 1.0).otherwise(F.size(F.array_intersect(w, actual)) / F.size(w)))


def context_identity(row_key: Column, url: Column, table: Column, kind: Column, anchor: Column, text: Column) -> Column:
    """What makes a context of a table the same as another; empty for other kinds."""
    parts = F.array_join(F.array(F.lit("table-dom"), *(_text(c) for c in (url, table, kind, anchor, text))), "::")
    named = F.when(_text(row_key) != "", F.concat(F.lit("row-key:"), row_key)).otherwise(parts)
    return F.when(kind.isin("table-row", "table-header"), named).otherwise("")


def virtual_position(table: Column, page: Column, index: Column) -> Column:
    return F.concat(_text(table), F.lit("::page:"), page.cast("string"), F.lit("::virtual-index:"), index.cast("string"))


def row_markdown(headers: Column, values: Column) -> Column:
    """A row's selected values as a Markdown table of two columns."""
    line = lambda h, v: F.concat(F.lit("| "), markdown_cell(h), F.lit(" | "), markdown_cell(v), F.lit(" |"))
    return F.array_join(F.concat(F.array(F.lit("| 字段 | 值 |"), F.lit("| --- | --- |")), F.zip_with(headers, values, line)), "\n")


def direct_url(url: Column, title: Column) -> Column:
    """Where a page's tab opens directly; empty for other pages or without a title."""
    origin, name = F.lower(F.regexp_extract(_text(url), r"^(https?://[^/?#]+)/epaas/?(?:[?#].*)?$", 1)), one_line(title)
    return F.when((origin == "") | (name == ""), "").otherwise(F.concat(origin, F.lit("/epaas?n="), F.url_encode(name)))


def whole_number(c: Column, default: int, low: int, high: int) -> Column:
    """A text or number as a whole number within bounds; the default where it is none."""
    return F.least(F.greatest(F.coalesce(c.try_cast("double").cast("long"), F.lit(default)), F.lit(low)), F.lit(high))


def insert_index(indexes: Column, position: Column, position_index: Column) -> Column:
    """Where a derived column goes: at an index, after the last selected column, or before the first (0 without any)."""
    held = F.filter(indexes, lambda i: i >= 0)
    at = F.when(position == "after-last-selected-column", F.array_max(held) + 1).otherwise(F.array_min(held))
    return F.when((position == "at-column") & (position_index >= 0), position_index).otherwise(F.coalesce(at, F.lit(0)))


def list_signature(fingerprints: Column) -> Column:
    """A list's row fingerprints in order, blank ones left out, in one text. See ``list_digest`` for long lists."""
    return F.array_join(F.filter(F.transform(fingerprints, lambda f: F.trim(F.coalesce(f, F.lit("")))), lambda f: f != ""), "|")


def list_digest(fingerprints: Column) -> Column:
    """Equal where the signature is, with a size that doesn't grow with the list."""
    return F.sha2(list_signature(fingerprints), 256)
