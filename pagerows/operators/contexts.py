"""Contexts that a user has picked: which count, how many there are, in which order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def enabled_contexts(contexts: DataFrame, enabled: str = "enabled") -> DataFrame:
    """All but those switched off; no mark counts as on."""
    return contexts.where(F.coalesce(F.col(enabled), F.lit(True)))


def enabled_groups(contexts: DataFrame, session: str = "session", group: str = "group_id") -> DataFrame:
    """``(session, group, has_header, rows)`` of the groups of which something is on."""
    on = enabled_contexts(contexts)
    return on.groupBy(session, group).agg(F.bool_or(F.col("kind") == "table-header").alias("has_header"), F.count_if(F.col("kind") == "table-row").alias("rows"))


def newest_first(contexts: DataFrame, session: str = "session", seq: str = "seq") -> DataFrame:
    """Adds ``place``: 0 for a session's newest context (the greatest ``seq``), and so on."""
    return contexts.withColumn("place", F.row_number().over(Window.partitionBy(session).orderBy(F.desc(seq))) - 1)


def preferred_frames(frames: DataFrame, page: str, url: str, preferred: str, order: str) -> DataFrame:
    """Adds ``place`` of each frame of a page: frames with the preferred address first, else in their own order."""
    w = Window.partitionBy(page).orderBy((F.col(url) == F.col(preferred)).desc_nulls_last(), F.col(order))
    return frames.withColumn("place", F.row_number().over(w) - 1)


def added_counts(contexts: DataFrame, table: str = "table_id", page: str = "page_index") -> DataFrame:
    """``(table, page, added)``: the rows picked on each page that is named; rows without a page count on every one, and
    ``page`` null stands for a table as a whole."""
    rows = contexts.where("kind = 'table-row'").groupBy(table, page).agg(F.count("*").alias("n"))
    whole = rows.groupBy(table).agg(F.sum("n").alias("all"), F.coalesce(F.sum(F.when(F.col(page).isNull(), F.col("n"))), F.lit(0)).alias("loose"))
    named = rows.where(F.col(page).isNotNull()).join(whole, table).select(table, page, (F.col("n") + F.col("loose")).alias("added"))
    return named.unionByName(whole.select(table, F.lit(None).cast(contexts.schema[page].dataType).alias(page), F.col("all").alias("added")))


def select_page_rows(header: DataFrame, rows: DataFrame, picked: DataFrame, table: str = "table_id", page: str = "page_index", most: int = 20) -> DataFrame:
    """What a user adds by picking whole pages of tables: rows (table, page, row_key, url, anchor, text, cells) of pages
    up to ``most``, and a table's header (the same columns) where its cells are as many as its rows'; what is picked
    already (``identity``) isn't added again, and equal contexts are added once."""
    shown = rows.where(F.col(page) <= most).withColumn("kind", F.lit("table-row"))
    width = shown.groupBy(table).agg(F.max(F.size("cells")).alias("__w"))
    heads = header.join(width, table).where(F.size("cells") == F.col("__w")).drop("__w").withColumn("kind", F.lit("table-header"))
    both = shown.unionByName(heads.select(shown.columns))
    c = F.col
    named = both.withColumn("identity", tx.context_identity(c("row_key"), c("url"), c(table).cast("string"), c("kind"), c("anchor"), c("text")))
    fresh = named.join(picked.select("identity").distinct(), "identity", "left_anti")
    rest = [x for x in fresh.columns if x != "identity"]
    first = fresh.groupBy("identity").agg(F.min_by(F.struct(*rest), F.struct(page, "anchor", "text")).alias("__r"))
    return first.select("identity", "__r.*")


def retry_signature(status: Column, ambiguous: Column, candidates: Column, headers: Column) -> Column:
    """By which a changed source is told from how it was when an attempt failed."""
    named = F.filter(F.transform(headers, tx.norm_header), lambda h: h != "")
    return F.concat_ws(
        "::", F.coalesce(F.nullif(status, F.lit("")), F.lit("missing")), F.when(F.coalesce(ambiguous, F.lit(False)), "1").otherwise("0"), F.coalesce(candidates, F.lit(0)).cast("string"), F.array_join(named, "|")
    )
