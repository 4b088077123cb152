"""Tables and messages as text blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_row, markdown_row


def _held(rows: DataFrame, key: str, order: list[str], cells: Column) -> DataFrame:
    """``(key, __rows, __width)``: each table's rows of cells in order, and the length of the longest."""
    own = rows.select(key, F.struct(*order, cells.alias("__c")).alias("__s"), F.size(cells).alias("__n"))
    held = own.groupBy(key).agg(F.array_sort(F.collect_list("__s")).alias("__all"), F.max("__n").alias("__width"))
    return held.select(key, F.transform("__all", lambda s: s["__c"]).alias("__rows"), "__width")


def to_csv_text(rows: DataFrame, key: str, order: list[str], cells: Column, header: list[str] | None) -> DataFrame:
    """A CSV text for each table; without a header its columns are ``列1``, ``列2`` and so on. Rows keep their lengths. A
    table's text is one value, so tables have bounded rows; whole data sets are written with ``df.write.csv``."""
    numbered = F.transform(F.sequence(F.lit(1), F.greatest("__width", F.lit(1))), lambda i: F.concat(F.lit("列"), i.cast("string")))
    head = numbered if header is None else F.array(*(F.lit(h) for h in header))
    lines = F.concat(F.array(csv_row(head)), F.transform("__rows", csv_row))
    return _held(rows, key, order, cells).select(key, F.array_join(lines, "\r\n").alias("csv"))


def to_markdown_text(rows: DataFrame, key: str, order: list[str], cells: Column, header: list[str]) -> DataFrame:
    """A Markdown table for each table, as wide as its header or longest row; shorter rows are filled up."""
    width = F.greatest("__width", F.lit(len(header)), F.lit(1))
    wide = lambda c: F.concat(c, F.array_repeat(F.lit(""), width - F.size(c)))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.concat(F.array(markdown_row(wide(F.array(*(F.lit(h) for h in header)))), rule), F.transform("__rows", lambda c: markdown_row(wide(c))))
    return _held(rows, key, order, cells).select(key, F.array_join(lines, "\n").alias("markdown"))
