"""States of data sources, what they mean for an analysis, and contexts that go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: States of a source, and what is shown for them.
LABELS = {
    "checking": "校验中", "available": "可用", "deferred": "执行时校验",
    "changed": "数据源已变化", "ambiguous": "数据源位置不明确", "missing": "数据源失效",
}
#: States that bar a run, the gravest first, and those in which a draft may use the source again.
BLOCKING, REUSABLE = ("changed", "ambiguous", "missing", "checking"), ("available", "deferred")


def _status(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("checking"))


def unavailable_sources(sources: DataFrame, status: str = "status") -> DataFrame:
    """Sources in a state that bars a run; no state means ``checking``."""
    return sources.withColumn(status, _status(F.col(status))).where(F.col(status).isin(*BLOCKING))


def recovery_status(sources: DataFrame, key: str, order: str, name: str, status: str = "status") -> DataFrame:
    """``(key, worst, labels, names)`` of each analysis with unavailable sources: its gravest state, the labels of all
    (each once, as first met) and the sources' names, in order. Labels come from a partial aggregate."""
    bad = unavailable_sources(sources, status)
    label = F.coalesce(*(F.when(F.col(status) == s, F.lit(text)) for s, text in LABELS.items()))
    rank = F.coalesce(*(F.when(F.col(status) == s, F.lit(k)) for k, s in enumerate(BLOCKING)))
    by_state = bad.groupBy(key, status).agg(
        F.min(rank).alias("rank"), F.min(F.struct(order, label.alias("label"))).alias("first"), F.collect_list(F.struct(order, F.col(name).alias("name"))).alias("own")
    )
    joined = lambda c, field: F.array_join(F.transform(F.array_sort(c), lambda s: s[field]), "、")
    return by_state.groupBy(key).agg(
        F.get(F.array(*map(F.lit, BLOCKING)), F.min("rank")).alias("worst"),
        joined(F.collect_list("first"), "label").alias("labels"),
        joined(F.flatten(F.collect_list("own")), "name").alias("names"),
    )


def incomplete_sources(sources: DataFrame, rows: str = "row_count", complete: str = "complete_for_request") -> DataFrame:
    """Sources without data, or whose data are marked as incomplete; no mark counts as complete."""
    return sources.where(F.col(rows).isNull() | ~F.coalesce(F.col(complete), F.lit(True)))


def all_sources_ready(sources: DataFrame, key: str, rows: str = "row_count", complete: str = "complete_for_request") -> DataFrame:
    """``(key, ready, loaded, total_rows)``: whether all its sources are complete, how many have data, and their rows."""
    has = F.col(rows).isNotNull()
    return sources.groupBy(key).agg(
        F.bool_and(has & F.coalesce(F.col(complete), F.lit(True))).alias("ready"), F.count_if(has).alias("loaded"), F.sum(F.coalesce(F.col(rows), F.lit(0))).alias("total_rows")
    )


def reusable_sources(sources: DataFrame, draft: DataFrame, keys: list[str], order: str, status: str = "status") -> DataFrame:
    """Of sources that a draft may use and doesn't yet hold, the first with each key."""
    able = sources.where(_status(F.col(status)).isin(*REUSABLE)).join(draft.select(*keys).distinct(), keys, "left_anti")
    rest = [c for c in able.columns if c not in keys]
    return able.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*")


def learn_tabs(sources: DataFrame, learned: DataFrame, key: str, tab: str = "tab", order: str = "seq") -> DataFrame:
    """Sources with tab titles filled in where they have none: by the first learned one that isn't blank."""
    named = learned.withColumn("__tab", F.trim(tab)).where("__tab <> ''").groupBy(key).agg(F.min_by("__tab", order).alias("__tab"))
    return sources.join(named, key, "left").withColumn(tab, F.coalesce(F.nullif(F.col(tab), F.lit("")), "__tab", F.col(tab))).drop("__tab")


def page_names(pages: DataFrame, names: DataFrame, key: str, title: str, name: str = "name") -> DataFrame:
    """Adds ``label``: the page's own name, else its title, else its key."""
    filled = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    own = names.select(key, F.col(name).alias("__name"))
    return pages.join(own, key, "left").withColumn("label", F.coalesce(filled("__name"), filled(title), F.col(key).cast("string"))).drop("__name")


def delete_contexts(contexts: DataFrame, gone: DataFrame, key: str = "session", ref: str = "ref", header_ref: str = "header_ref") -> DataFrame:
    """Contexts without those deleted, the rows of deleted headers, and headers that lost their last row so. A header
    that had no rows stays."""
    dead = gone.select(key, ref).distinct()
    marked = contexts.join(dead.withColumn("__dead", F.lit(True)), [key, ref], "left")
    rest = marked.where("__dead is null").drop("__dead")
    heads = dead.select(key, F.col(ref).alias(header_ref))
    kept = rest.join(heads, [key, header_ref], "left_anti").select(contexts.columns)
    rows = marked.where((F.col("kind") == "table-row") & F.col(header_ref).isNotNull())
    left = rows.groupBy(key, F.col(header_ref).alias(ref)).agg(F.count_if(F.col("__dead").isNull()).alias("__left")).where("__left = 0")
    emptied = kept.join(left.select(key, ref, F.lit(True).alias("__gone")), [key, ref], "left")
    return emptied.where(F.col("__gone").isNull() | (F.col("kind") != "table-header")).select(contexts.columns)


def clear_group(contexts: DataFrame, cleared: DataFrame, table: str = "table_id", page: str = "page_index") -> DataFrame:
    """Contexts without the rows of cleared (table, page); a null page on either side stands for every page."""
    whole = cleared.groupBy(table).agg(F.bool_or(F.col(page).isNull()).alias("__all"))
    pages = cleared.where(F.col(page).isNotNull()).select(table, page).distinct().withColumn("__hit", F.lit(True))
    marked = contexts.join(whole, table, "left").join(pages, [table, page], "left")
    hit = F.col("__all").isNotNull() & (F.col("__all") | F.col(page).isNull() | F.coalesce("__hit", F.lit(False)))
    return marked.where(~(hit & (F.col("kind") == "table-row"))).select(contexts.columns)


def overview(contexts: DataFrame, session: str = "session", page: str = "url") -> DataFrame:
    """Tables, rows, pages (one at least) and tables without a header of each session, from ``assign_groups``."""
    head, row = F.col("kind") == "table-header", F.col("kind") == "table-row"
    groups = contexts.groupBy(session, "group_id").agg(F.bool_or(head).alias("has_header"), F.count_if(row).alias("n"))
    tables = groups.groupBy(session).agg(F.count("*").alias("tables"), F.sum("n").alias("rows"), F.count_if(~F.col("has_header")).alias("headerless"))
    pages = contexts.where(row).select(session, page).distinct().groupBy(session).agg(F.count(page).alias("__pages"))
    return tables.join(pages, session, "left").withColumn("pages", F.greatest(F.coalesce("__pages", F.lit(0)), F.lit(1))).drop("__pages")


def legacy_groups(contexts: DataFrame, session: str = "session", order: str = "seq", ref: str = "ref") -> DataFrame:
    """Groups of contexts that name neither table nor header: from the oldest (greatest ``order``) on, each header opens
    one; rows before any header share one."""
    w = Window.partitionBy(session).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    head = F.last(F.when(F.col("kind") == "table-header", F.col(ref)), ignorenulls=True).over(w)
    return contexts.withColumn("group_id", F.concat(F.lit("TG:legacy:"), F.coalesce(head, F.lit("headerless"))))


def no_progress_stop(steps: DataFrame, key: str, order: list[str], added: str, limit: int = 2) -> DataFrame:
    """For each key the first step that ends ``limit`` steps in a row without new rows."""
    w = Window.partitionBy(key).orderBy(*order)
    empty = F.coalesce(F.col(added), F.lit(0)) == 0
    run = F.sum(empty.cast("int")).over(w.rowsBetween(1 - limit, 0))
    marked = steps.withColumn("__run", run).where(F.col("__run") == limit)
    return marked.groupBy(key).agg(F.min(F.struct(*order)).alias("__r")).select(key, "__r.*")


def table_digest(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """``count|t1||t2||t3`` of each table: its rows' texts without leading numbers, marks and white space, 30
    characters each; blank ones don't count. Only the first three are ever gathered."""
    bare = F.left(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"^\d+\s*[✓✗]?\s*\|?\s*", ""), r"\s+", ""), F.lit(30))
    shown = rows.select(key, order, bare.alias("__t")).where("__t <> ''")
    ranked = shown.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    first = ranked.where("__k <= 3").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__k", "__t"))), lambda s: s["__t"]), "||").alias("__first"))
    counts = shown.groupBy(key).agg(F.count("*").alias("__n"))
    named = rows.select(key).distinct().join(counts, key, "left").join(first, key, "left")
    return named.select(key, F.concat(F.coalesce("__n", F.lit(0)).cast("string"), F.lit("|"), F.coalesce("__first", F.lit(""))).alias("digest"))


def failure_map(failures: DataFrame, keys: list[str], order: str, error: str = "error") -> DataFrame:
    """The first failure of each key; a blank one reads ``分析失败``."""
    said = F.coalesce(F.nullif(F.trim(error), F.lit("")), F.lit("分析失败"))
    return failures.groupBy(*keys).agg(F.min_by(said, order).alias(error))


def recent_result(requests: DataFrame, keys: list[str], ts: str, tie: str, within_ms: int = 60_000) -> DataFrame:
    """Adds ``reused``: whether the same request was made at most so long before."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    past = F.unix_millis(F.lag(F.col(ts).cast("timestamp")).over(w))
    return requests.withColumn("reused", F.coalesce(F.unix_millis(F.col(ts).cast("timestamp")) - past <= within_ms, F.lit(False)))
