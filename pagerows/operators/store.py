"""Results that come too late, readiness of tables, collections of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import first_seen

def stale_results(results: DataFrame, sessions: DataFrame, key: str, analysis: str = "analysis_fp", seq: str = "session_seq") -> DataFrame:
    """Adds ``shown``: a result shows only while its analysis is its table's newest session; every result is cached."""
    newest = sessions.groupBy(key).agg(F.max_by(analysis, seq).alias("__now"))
    return results.join(newest, key, "left").withColumn("shown", F.coalesce(F.col(analysis) == F.col("__now"), F.lit(False))).drop("__now")


def readiness(polls: DataFrame, key: str, order: list[str], rows: str, content: str, loading: str, elapsed: str, samples: int = 3, least: int = 2000, most: int = 12_000) -> DataFrame:
    """``(key, ..order, rows, timed_out)``: the first poll that shows what ``samples`` comparisons before it, in a row, have
    shown (rows, and not loading), once ``least`` has passed; or the first at ``most``, whatever it shows."""
    w = Window.partitionBy(key).orderBy(*order)
    same = ~F.coalesce(F.col(loading), F.lit(False)) & (F.col(rows) > 0) & (F.col(rows) == F.lag(rows).over(w)) & (F.coalesce(content, F.lit("")) == F.coalesce(F.lag(content).over(w), F.lit("")))
    marked = polls.withColumn("__same", F.coalesce(same, F.lit(False)))
    marked = marked.withColumn("__run", F.sum((~F.col("__same")).cast("int")).over(w))
    counted = marked.withColumn("__n", F.sum(F.col("__same").cast("int")).over(Window.partitionBy(key, "__run").orderBy(*order)))
    ready = (F.col("__n") >= samples) & F.col("__same") & (F.col(elapsed) >= least)
    ended = counted.where(ready | (F.col(elapsed) >= most)).withColumn("timed_out", ~ready)
    first = ended.groupBy(key).agg(F.min_by(F.struct(*order, rows, "timed_out"), F.struct(*order)).alias("__r"))
    return first.select(key, "__r.*")


def collect(snapshots: DataFrame, pages: DataFrame, key: str, signature: Column, order: list, page: str = "page", max_rows: int = 1000, max_pages: int = 30) -> tuple[DataFrame, DataFrame]:
    """A paged collection: ``(rows, ends)``.

    Each row counts where it is first seen. Collecting ends on the first page on which one of these holds, the first that
    does being the reason: ``stopped``, ``row-limit`` (as many different rows), ``page-limit``, ``last-page``, or the page's own
    ``outcome`` (next-click-failed, page-timeout); later pages don't count. ``ends``: (key, reason, pages, rows, truncated)."""
    c = F.col
    first = first_seen(snapshots.where(c(page) <= max_pages), [key], signature, order)
    per_page = pages.where(c(page) <= max_pages).join(first.groupBy(key, page).agg(F.count("*").alias("__new")), [key, page], "left")
    w = Window.partitionBy(key).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)  # at most max_pages rows
    seen = per_page.withColumn("__seen", F.sum(F.coalesce("__new", F.lit(0))).over(w))
    reason = (
        F.when(F.coalesce("stopped", F.lit(False)), "stopped").when(c("__seen") >= max_rows, "row-limit").when(c(page) >= max_pages, "page-limit")
        .when(F.coalesce("is_last", F.lit(False)), "last-page").when(c("outcome").isin("next-click-failed", "page-timeout"), c("outcome"))
    )
    judged = seen.withColumn("reason", reason)
    stop = judged.where("reason is not null").groupBy(key).agg(F.min_by(F.struct("reason", c(page).alias("pages"), "__seen"), page).alias("s"))
    whole = judged.groupBy(key).agg(F.max(page).alias("__pages"), F.max("__seen").alias("__all"))
    ends = whole.join(stop, key, "left").select(
        key, F.coalesce("s.reason", F.lit("no-progress")).alias("reason"), F.coalesce("s.pages", "__pages").alias("pages"), F.least(F.lit(max_rows), F.coalesce("s.__seen", "__all")).alias("rows")
    )
    ends = ends.withColumn("truncated", c("reason").isin("row-limit", "page-limit"))
    kept = first.join(ends.select(key, c("pages").alias("__end")), key).where(c(page) <= c("__end"))
    ranked = kept.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(c("__k") <= max_rows)
    return ranked.drop("__k", "__end"), ends
