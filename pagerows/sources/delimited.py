"""Delimited text files as rows of cells, and sheets with headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed limits of one sheet.
MAX_COLUMNS, MAX_ROWS, MAX_CELLS = 500, 10_000, 1_000_000
_DELIMITERS = (",", "\t", ";")


def _cell(d: Column) -> Column:
    """Pattern of a cell: an optional quoted part at its beginning, then anything up to a delimiter or line end."""
    return F.concat(F.lit(r'(?:"(?:[^"]++|"")*+"?)?[^'), d, F.lit(r"\r\n]*+"))


def sniff_delimiter(text: Column) -> Column:
    """The delimiter that splits the first line most; comma before tab before semicolon if equal."""
    line = F.split(text, "\r?\n", 2)[0]
    count = lambda d: F.length(line) - F.length(F.replace(line, F.lit(d), F.lit("")))
    comma, tab, semicolon = map(count, _DELIMITERS)
    return F.when((comma >= tab) & (comma >= semicolon), ",").when(tab >= semicolon, "\t").otherwise(";")


def _plain(cell: Column) -> Column:
    inner, rest = (F.regexp_extract(cell, r'(?s)^"((?:[^"]++|"")*+)"?(.*)$', k) for k in (1, 2))
    return F.when(cell.startswith('"'), F.concat(F.replace(inner, F.lit('""'), F.lit('"')), rest)).otherwise(cell)


def is_blank(cells: Column) -> Column:
    return ~F.exists(cells, lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")) != "")


def parse_delimited(files: DataFrame, text: str = "text", delimiter: str | None = None) -> DataFrame:
    """``files`` columns without the text, plus ``row_pos`` and ``cells``. Quotes count at a cell's beginning, ``""``
    stands for a quote in them; lines end in CR, LF or CRLF; blank rows go. A null or empty text has no rows."""
    keep = [c for c in files.columns if c != text]
    body = F.regexp_replace(F.col(f"`{text}`"), r"^\x{FEFF}", "")
    known = files.select(*(F.col(f"`{c}`") for c in keep), body.alias("__text"))
    known = known.withColumn("__d", F.lit(delimiter) if delimiter else sniff_delimiter(F.col("__text")))
    cell = _cell(F.col("__d"))
    record = F.concat(F.lit("("), cell, F.lit("(?:"), F.col("__d"), cell, F.lit(r")*+)(?:\r\n|\r|\n|\z)"))
    lines = known.select(*(F.col(f"`{c}`") for c in keep), "__d", F.posexplode(F.regexp_extract_all("__text", record, F.lit(1))).alias("row_pos", "__line"))
    # each cell follows a delimiter once one is put before the line
    found = F.regexp_extract_all(F.concat("__d", "__line"), F.concat(F.col("__d"), F.lit("("), _cell(F.col("__d")), F.lit(")")), F.lit(1))
    cells = lines.withColumn("cells", F.transform(found, _plain)).drop("__d", "__line")
    return cells.where(~is_blank(F.col("cells")))


def read_delimited(spark: SparkSession, paths: str | list[str], delimiter: str | None = None) -> DataFrame:
    """``(path, row_pos, cells)``; each file is one task's value at most, files ending in .tsv take tabs."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    if delimiter:
        return parse_delimited(files, delimiter=delimiter)
    tabs = F.lower("path").endswith(".tsv")
    return parse_delimited(files.where(~tabs)).unionByName(parse_delimited(files.where(tabs), delimiter="\t"))


def normalize_sheet(rows: DataFrame, key: str, pos: str = "row_pos", cells: str = "cells") -> DataFrame:
    """The first row of a sheet names its columns (``列N`` where blank); the other rows are as wide as the widest, at
    most 500, and at most 10,000. ``total_rows`` counts all; a sheet of over 1,000,000 cells only has an ``error``."""
    filled = rows.where(~is_blank(F.col(cells)))
    sheet = filled.groupBy(key).agg(
        F.least(F.max(F.size(cells)), F.lit(MAX_COLUMNS)).alias("width"), F.count("*").alias("n"), F.min_by(cells, pos).alias("__head"), F.min(pos).alias("__first")
    )
    name = lambda i: F.trim(F.regexp_replace(F.coalesce(F.try_element_at("__head", i), F.lit("")), r"\s+", " "))
    headers = F.transform(F.sequence(F.lit(1), F.col("width")), lambda i: F.coalesce(F.nullif(name(i), F.lit("")), F.concat(F.lit("列"), i.cast("string"))))
    error = F.when(F.col("n") * F.col("width") > MAX_CELLS, "too many cells")
    sheet = sheet.select(key, "width", "__first", headers.alias("headers"), (F.col("n") - 1).alias("total_rows"), error.alias("error"))
    joined = filled.join(sheet, key).where((F.col(pos) > F.col("__first")) & F.col("error").isNull())
    ranked = joined.withColumn("row", F.row_number().over(Window.partitionBy(key).orderBy(pos))).where(F.col("row") <= MAX_ROWS)
    padded = F.transform(F.sequence(F.lit(1), F.col("width")), lambda i: F.coalesce(F.try_element_at(cells, i), F.lit("")))
    body = ranked.select(key, "row", padded.alias("cells"))
    return sheet.drop("width", "__first").join(body, key, "left")
