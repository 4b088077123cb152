"""Workbooks (.xlsx) as rows of cells, files of a request, and catalogs in JSON."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .delimited import MAX_COLUMNS, parse_delimited

#: Fixed limits: bytes of a file, of an unpacked part and of all parts; files of a request; a catalog's size and items.
MAX_FILE, MAX_PART, MAX_UNPACKED, MAX_FILES = 10 << 20, 32 << 20, 64 << 20, 5
MAX_CATALOG_CHARS, MAX_CATALOG_ITEMS = 5 << 20, 500
_REFERENCE = re.compile(r"[A-Za-z]+")


def _local(node, name: str):
    """Descendants by name, whatever their namespace."""
    return (n for n in node.iter() if n.tag.rpartition("}")[2] == name)


def column_index(reference: str) -> int:
    """Of a cell reference such as ``AB12``, from 0; without letters 0."""
    found, n = _REFERENCE.match(reference or ""), 0
    for letter in found[0].upper() if found else "":
        n = 26 * n + ord(letter) - 64
    return max(0, n - 1)


def read_workbook(content: bytes) -> list[tuple[int, str, int, list[str]]]:
    """``(number from 1, sheet, row, cells)`` of all sheets. Raises ValueError for what can't be read."""
    if len(content) > MAX_FILE:
        raise ValueError("a file has 10 MB at most")
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        infos = book.infolist()
    except Exception as e:  # damaged bytes make the reader fail in any way
        raise ValueError("not a workbook") from e
    if any(i.flag_bits & 1 for i in infos):
        raise ValueError("the workbook is encrypted")
    if any(i.file_size > MAX_PART for i in infos) or sum(i.file_size for i in infos) > MAX_UNPACKED:
        raise ValueError("the workbook is too large when unpacked")
    names = {i.filename.lstrip("/"): i for i in infos}

    def part(name: str):
        if name not in names:
            return None
        try:
            return ElementTree.fromstring(book.read(names[name]))
        except Exception as e:  # of the archive, its compression, or the parser
            raise ValueError(f"{name} is damaged") from e

    workbook, links = part("xl/workbook.xml"), part("xl/_rels/workbook.xml.rels")
    if workbook is None or links is None:
        raise ValueError("the workbook has no index")
    targets = {n.get("Id"): n.get("Target") for n in _local(links, "Relationship")}
    shared = part("xl/sharedStrings.xml")
    texts = ["".join(t.text or "" for t in _local(s, "t")) for s in _local(shared, "si")] if shared is not None else []
    out, sheets = [], 0
    for sheet in _local(workbook, "sheet"):
        target = targets.get(next((v for k, v in sheet.attrib.items() if k.rpartition("}")[2] == "id" and k != "sheetId"), None))
        page = part(posixpath.normpath(f"xl/{target}")) if target else None
        if page is None:
            continue
        sheets += 1
        name = sheet.get("name") or f"Sheet{sheets}"
        for r, row in enumerate(_local(page, "row")):
            cells: list[str] = []
            for c in _local(row, "c"):
                at = column_index(c.get("r") or "")
                if at >= MAX_COLUMNS:
                    continue
                raw = next((v.text or "" for v in _local(c, "v")), "")
                inline = "".join(t.text or "" for t in _local(c, "t"))
                kind = c.get("t") or ""
                if kind == "s":
                    value = texts[int(raw)] if raw.isdecimal() and len(raw) < 10 and int(raw) < len(texts) else ""
                else:
                    value = inline if kind == "inlineStr" else ("TRUE" if raw == "1" else "FALSE") if kind == "b" else raw or inline
                cells += [""] * (at + 1 - len(cells))
                cells[at] = value
            if any(c.strip() for c in cells):
                out.append((sheets, name, r, cells))
    if not sheets:
        raise ValueError("the workbook has no sheet")
    return out


_SHEETS = T.StructType([T.StructField("sheet_no", T.IntegerType()), T.StructField("sheet", T.StringType()), T.StructField("row_pos", T.IntegerType()), T.StructField("cells", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])
_ARROW = [pa.int32(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string()]


def parse_workbooks(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` columns without the content, with a row for each sheet's row that isn't blank: ``sheet_no`` (from 1), ``sheet, row_pos, cells`` and
    a null ``error``. A file that can't be read has one row with only an error; the others go on. A null content is an
    error. Files (10 MB at most) are spread over tasks."""
    keep = [c for c in files.columns if c != content and c not in _SHEETS.names]
    n, names = len(keep), [*keep, *_SHEETS.names]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # a file may give many rows
                try:
                    rows = [(*r, None) for r in read_workbook(batch.column(n)[i].as_py() or b"")]
                except ValueError as e:
                    rows = [(None, None, None, None, str(e))]
                kept = batch.take(pa.array([i] * len(rows), pa.int32()))
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([*(kept.column(k) for k in range(n)), *(pa.array(c, t) for c, t in zip(columns, _ARROW))], names=names)

    return files.select(*(F.col(f"`{c}`") for c in [*keep, content])).mapInArrow(run, T.StructType([*(files.schema[c] for c in keep), *_SHEETS.fields]))


def read_workbooks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(path, sheet_no, sheet, row_pos, cells, error)`` of workbook files; larger ones than allowed are known by their size and
    aren't read."""
    found = spark.read.format("binaryFile").load(paths)
    small = parse_workbooks(found.where(F.col("length") <= MAX_FILE).select("path", "content"))
    large = found.where(F.col("length") > MAX_FILE).select("path", *(F.lit(None).cast(f.dataType).alias(f.name) for f in _SHEETS.fields[:4]), F.lit("a file has 10 MB at most").alias("error"))
    return small.unionByName(large)


def load_files(files: DataFrame, request: str, order: str, name: str = "name", content: str = "content", answer: str = "sheet_answer", used: str | None = None) -> DataFrame:
    """Files of requests, ``(request, order, name, sheet, row_pos, cells, error)``: as many as a request has free slots (five
    less ``used``), of each workbook the sheet that is answered (its number from 1, or its name; the first without an
    answer; none if there is no such sheet). Other kinds of files, and those that can't be read, give an error row."""
    slots = F.lit(MAX_FILES) - (F.coalesce(used, F.lit(0)) if used else F.lit(0))
    w = Window.partitionBy(request).orderBy(order)
    taken = files.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= slots).drop("__k")
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    keys = [request, order, name]
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in _SHEETS.fields[1:4]]
    good = F.lit(None).cast("string").alias("error")
    books = parse_workbooks(taken.where(kind == "xlsx").select(*keys, answer, content), content)
    said = F.trim(F.coalesce(answer, F.lit("")))
    picked = F.when(said == "", F.col("sheet_no") == 1).otherwise(F.coalesce(said.try_cast("int") == F.col("sheet_no"), F.lit(False)) | (said == F.col("sheet")))
    out = books.where(F.col("error").isNotNull() | picked).select(*keys, "sheet", "row_pos", "cells", "error")
    out = out.unionByName(taken.where(~kind.isin("csv", "tsv", "xlsx")).select(*keys, *none, F.lit("only CSV, TSV and XLSX files").alias("error")))
    for k, d in (("csv", None), ("tsv", "\t")):
        texts = taken.where(kind == k).select(*keys, F.decode(content, "UTF-8").alias("text"))
        out = out.unionByName(parse_delimited(texts, delimiter=d).select(*keys, F.lit("").alias("sheet"), "row_pos", "cells", good))
    return out


def read_catalog(texts: DataFrame, text: str = "text", item: str = "struct<id:string,name:string>") -> DataFrame:
    """Catalogs in JSON (a list, or an object with ``skills`` and ``pageNames``): columns of ``texts`` but the text, ``seq``,
    ``item`` of the type asked for, and ``error`` of a catalog that is too large, no JSON, empty, or has too many items."""
    keep = [F.col(f"`{c}`") for c in texts.columns if c != text]
    body = F.trim(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    listed = F.when(body.startswith("["), F.from_json(body, f"array<{item}>")).otherwise(F.from_json(body, f"struct<skills:array<{item}>>")["skills"])
    error = (
        F.when(F.length(body) > MAX_CATALOG_CHARS, "too large").when(F.try_parse_json(body).isNull(), "not JSON")
        .when(F.coalesce(F.size(listed), F.lit(0)) < 1, "no items").when(F.size(listed) > MAX_CATALOG_ITEMS, "too many items")
    )
    found = texts.select(*keep, listed.alias("__l"), error.alias("error"))
    own = [F.col(f"`{c}`") for c in texts.columns if c != text]
    good = found.where("error is null").select(*own, F.posexplode("__l").alias("seq", "item"), "error")
    bad = found.where("error is not null").select(*own, F.lit(None).cast("int").alias("seq"), F.lit(None).cast(item).alias("item"), "error")
    return good.unionByName(bad)


def catalog_names(texts: DataFrame, text: str = "text") -> DataFrame:
    """The page names of catalogs: columns of ``texts`` but the text, ``page_key, name``."""
    keep = [F.col(f"`{c}`") for c in texts.columns if c != text]
    names = F.from_json(F.col(f"`{text}`"), "struct<pageNames:map<string,string>>")["pageNames"]
    return texts.select(*keep, F.explode(names).alias("page_key", "name")).where("page_key <> '' and name is not null")


def catalog_json(items: DataFrame, key: str, order: str, exported_at: Column, form: str, names: DataFrame | None = None) -> DataFrame:
    """``(key, text)``: each catalog's items (columns but the key, in order) as one JSON text with its format and time; a
    catalog's size is bounded as above. Names are (key, page_key, name)."""
    fields = [c for c in items.columns if c != key]
    held = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, F.struct(*(c for c in fields if c != order)).alias("i")))).alias("__l"))
    if names is not None:
        own = names.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("page_key", "name")))).alias("__names"))
        held = held.join(own, key, "left")
    empty = F.create_map().cast("map<string,string>")
    pages = F.coalesce("__names", empty) if names is not None else empty
    whole = F.struct(
        F.lit(form).alias("format"), F.lit(1).alias("version"), exported_at.alias("exportedAt"), F.transform("__l", lambda x: x["i"]).alias("skills"), pages.alias("pageNames")
    )
    return held.select(key, F.to_json(whole).alias("text"))


def write_catalog_json(catalogs: DataFrame, path: str) -> None:
    """One line a catalog, as text files."""
    catalogs.select("text").write.text(path)
