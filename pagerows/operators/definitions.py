"""Saved analyses: their defaults, sources, validity, what makes two the same, and where they belong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..shared import cut
from .derive import distinct_selections

#: Types, output defaults and positions, execution bounds, headers that name no source, legacy sections.
DERIVED, ANALYSIS = "derived-column", "table-analysis"
COLUMN_NAME, MAX_CHARS, BEFORE, AT_COLUMN = "分析结论", 1000, "before-first-selected-column", "at-column"
POSITIONS = (BEFORE, "after-last-selected-column", AT_COLUMN)
MAX_ROWS, MAX_BATCH_ROWS = 100, 20
_IGNORED = r"^(?i:序号|操作|选择|全选|checkbox)$"
SECTIONS = (("objective", "分析目标"), ("focus", "关注重点"), ("rules", "判断规则"), ("output_format", "输出要求"), ("notes", "补充说明"))


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(F.coalesce(c.cast("string"), F.lit(""))), F.lit(""))


def bounded(c: Column, default: int, high: int) -> Column:
    """A whole number from 1 to ``high``; the default where it is none or not positive."""
    n = c.try_cast("double").cast("long")
    return F.least(F.lit(high), F.when(n > 0, n).otherwise(default)).cast("int")


def normalize_output(name: Column, position: Column, index: Column, max_chars: Column) -> Column:
    """``(column_name, position, position_index, max_chars)`` with defaults; an index counts only at a column."""
    place = F.when(position.isin(*POSITIONS), position).otherwise(BEFORE)
    number = index.try_cast("double").cast("long")
    return F.struct(
        F.coalesce(_filled(name), F.lit(COLUMN_NAME)).alias("column_name"), place.alias("position"),
        F.when((place == AT_COLUMN) & (number >= 0), number).otherwise(-1).cast("int").alias("position_index"), bounded(max_chars, MAX_CHARS, 1000).alias("max_chars"),
    )


def normalize_definition(kind: Column, output: Column, max_rows: Column, max_batch_rows: Column) -> Column:
    """Type, output (from ``normalize_output``) and execution bounds of an analysis, as they count."""
    return F.struct(
        F.when(kind == DERIVED, DERIVED).otherwise(ANALYSIS).alias("type"), output.alias("output"),
        bounded(max_rows, MAX_ROWS, 1000).alias("max_rows"), bounded(max_batch_rows, MAX_BATCH_ROWS, 20).alias("max_batch_rows"),
    )


#: Fixed value: when a derived column runs.
TRIGGER = "page-load"


def normalize_trigger(mode: Column, auto_run: Column) -> Column:
    """``(mode, auto_run_enabled)``: there is one mode, and only a true says that it runs by itself."""
    return F.struct(F.when(mode == TRIGGER, mode).otherwise(TRIGGER).alias("mode"), F.coalesce(auto_run, F.lit(False)).alias("auto_run_enabled"))


def normalize_method(stored: Column) -> Column:
    """The description of a method that is stored as a text, or as JSON of one or of an object: without white space around; an
    object's line ends are one kind, and one without description is blank."""
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|(?<!\s)\s+$", "")
    body = clean(stored)
    inner = F.regexp_replace(F.get_json_object(body, "$.description"), "\r\n?", "\n")
    text = F.get(F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<string>"), 0)
    return clean(F.when(body.rlike(r"(?s)^\{.*\}$") & F.try_parse_json(body).isNotNull(), inner).when(body.rlike('(?s)^".*"$') & F.try_parse_json(body).isNotNull(), text).otherwise(stored))


def merge_legacy_method(description: Column, sections: dict[str, Column]) -> Column:
    """The description; where it is blank, the filled legacy sections as ``title：text``, one a line."""
    lines = [F.when(_filled(sections[k]).isNotNull(), F.concat(F.lit(f"{title}："), F.trim(sections[k]))) for k, title in SECTIONS if k in sections]
    return F.when(_filled(description).isNotNull(), description).otherwise(F.concat_ws("\n", *lines))


def source_name(stored: Column, title: Column, tab: Column, headers: Column, number: Column) -> Column:
    """A source's name: the one stored, its table's title, its tab's, its first two telling headers, or its number."""
    named = lambda c: F.nullif(tx.one_line(c), F.lit(""))
    telling = F.slice(F.filter(F.transform(headers, lambda h: tx.one_line(h)), lambda h: (h != "") & ~h.rlike(_IGNORED)), 1, 2)
    by_headers = F.when(F.size(telling) > 0, F.concat(F.array_join(telling, "、"), F.when(F.size(telling) > 1, "等数据").otherwise("数据")))
    return F.coalesce(named(stored), named(title), named(tab), by_headers, F.concat(F.lit("数据源 "), number.cast("string")))


def normalize_sources(sources: DataFrame, skill: str = "skill", order: str = "seq") -> DataFrame:
    """Sources (frame_id, frame_url, page_key, page_url, legacy, stored_name, title, tab, headers) with their page put
    right and ``name``. A top frame's address is its page, unless the record is a legacy one; a source without a page has
    the page of its address."""
    k = F.row_number().over(Window.partitionBy(skill).orderBy(order))
    own = F.when(_filled(F.col("frame_url")).isNotNull(), tx.page_key(F.col("frame_url"))).otherwise("")
    repair = (F.coalesce("frame_id", F.lit(0)) == 0) & ~F.coalesce("legacy", F.lit(False)) & own.rlike("^https?://")
    url = F.when(repair, F.col("frame_url")).otherwise(F.coalesce(_filled(F.col("page_url")), _filled(F.col("frame_url")), F.lit("")))
    page = F.when(repair, own).otherwise(F.coalesce(_filled(F.col("page_key")), tx.page_key(url)))
    named = sources.withColumn("__k", k).withColumn("name", source_name(F.col("stored_name"), F.col("title"), F.col("tab"), F.col("headers"), F.col("__k")))
    return named.withColumn("__page", page).withColumn("page_url", url).withColumn("page_key", F.col("__page")).drop("__k", "__page")


def stored_sources(skills: DataFrame, sources: DataFrame, skill: str = "skill", order: str = "seq") -> DataFrame:
    """Sources as ``normalize_sources`` takes them, with ``id``, of stored analyses ``skills`` (skill, page_key, page_url): a source
    without an id is named after its analysis and place, and one of that name is a legacy one, which has the analysis'
    own page where that is known. Adds ``main_page``: the analysis' page, or its first source's if none of them lies there."""
    c = F.col
    place = F.row_number().over(Window.partitionBy(skill).orderBy(order))
    made = F.concat(F.lit("source_"), c(skill).cast("string"), F.lit("_"), place.cast("string"))
    named = sources.withColumn("__made", made).withColumn("id", F.coalesce(_filled(c("id")), "__made"))
    read = normalize_sources(named, skill, order).withColumn("legacy", F.coalesce(c("id") == c("__made"), F.lit(False)))
    own = skills.select(skill, c("page_key").alias("__page"), c("page_url").alias("__url"))
    placed = read.join(own, skill)
    for name, stored in (("page_key", "__page"), ("page_url", "__url")):
        placed = placed.withColumn(name, F.when(c("legacy"), F.coalesce(_filled(c(stored)), c(name))).otherwise(c(name)))
    pages = placed.groupBy(skill).agg(F.min_by("page_key", order).alias("__first"), F.bool_or(F.coalesce(c("page_key") == c("__page"), F.lit(False))).alias("__held"))
    moved = (F.coalesce("__first", F.lit("")) != "") & ~(c("__held") & (F.coalesce("__page", F.lit("")) != ""))
    return placed.join(pages, skill).withColumn("main_page", F.when(moved, c("__first")).otherwise(c("__page"))).drop("__made", "__page", "__url", "__first", "__held")


def definition_errors(kind: Column, name: Column, n_sources: Column, n_bad_sources: Column, n_columns: Column) -> Column:
    """Why a definition can't be used, in order; empty for a good one. A source is bad without a page, headers, or a
    selector or index."""
    derived = kind == DERIVED
    found = F.array(
        F.when(_filled(name).isNull(), "缺少技能名称"), F.when(n_sources < 1, "没有数据源"), F.when(n_bad_sources > 0, "包含无效的数据源绑定"),
        F.when(derived & (n_columns < 1), "请至少选择一列"), F.when(derived & (n_columns > 10), "最多选择 10 列"),
    )
    return F.filter(found, lambda e: e.isNotNull())


def bad_source(page_key: Column, headers: Column, selector: Column, index: Column) -> Column:
    return _filled(page_key).isNull() | (F.coalesce(F.size(headers), F.lit(0)) < 1) | (_filled(selector).isNull() & index.isNull())


def content_fingerprint(kind: Column, sources: Column, method: Column, selected: Column, version: Column, output: Column) -> Column:
    """What an analysis does, as a digest; its name, id and times don't count. Sources are an array of (page_key,
    frame_url, selector, table_index, headers), ``output`` comes from ``normalize_output``."""
    identity = F.transform(
        sources,
        lambda s: F.struct(
            F.trim(F.coalesce(s["page_key"], F.lit(""))).alias("pageKey"), F.trim(F.coalesce(s["frame_url"], F.lit(""))).alias("frameUrl"),
            F.trim(F.coalesce(s["selector"], F.lit(""))).alias("selector"), s["table_index"].alias("tableIndex"),
            F.transform(F.coalesce(s["headers"], F.array().cast("array<string>")), tx.norm_header).alias("headers"),
        ),
    )
    text = F.regexp_replace(F.regexp_replace(F.coalesce(method, F.lit("")), "\r\n?", "\n"), r"^\s+|(?<!\s)\s+$", "")
    columns = F.transform(distinct_selections(selected), lambda s: F.struct(s["name"].alias("normalizedHeader"), s["occurrence"].alias("occurrence")))
    plain = F.struct(identity.alias("sources"), text.alias("analysisMethod"))
    derived = F.struct(
        F.lit(DERIVED).alias("type"), identity.alias("sources"), columns.alias("selectedColumns"), text.alias("analysisMethod"),
        F.when(text == "", F.greatest(F.coalesce(version, F.lit(1)), F.lit(1))).alias("defaultMethodVersion"),
        F.struct(output["column_name"].alias("columnName"), output["position"].alias("position"), output["max_chars"].alias("maxChars")).alias("output"),
    )
    options = {"ignoreNullFields": "false"}
    return F.sha2(F.when(kind == DERIVED, F.to_json(derived, options)).otherwise(F.to_json(plain, options)), 256)


def page_skills(skills: DataFrame, sources: DataFrame, current: DataFrame, skill: str = "skill", page: str = "page_key") -> DataFrame:
    """The analyses that belong to each current page: their own page, or that of one of their sources. Sources are
    matched by their pages first, so that a page with very many is no hot join of all of them."""
    by_source = sources.select(skill, page).distinct()
    both = skills.select(skill, page).unionByName(by_source).distinct()
    return both.join(current.select(page).distinct(), page, "left_semi")


def tab_skills(skills: DataFrame, sources: DataFrame, active: str, opened: list[str], page: str, skill: str = "skill", tab: str = "tab") -> DataFrame:
    """The analyses on a page of tabs: a source's tab is the active one and open, or, without a tab, its page is the
    current one; an analysis without any tab also by its own page."""
    title = tx.one_line(F.col(tab))
    here = F.when(title != "", (title == active) & title.isin(*opened)).otherwise(F.col("page_key") == page)
    found = sources.where(here).select(skill)
    tabbed = sources.where(title != "").select(skill)
    own = skills.where(F.col("page_key") == page).select(skill).join(tabbed, skill, "left_anti")
    return found.unionByName(own).distinct()


def frame_matches(sources: DataFrame, key: str, frame_url: str = "frame_url", current: str = "current") -> DataFrame:
    """``(key, matches)``: whether any source names no frame, or the current one."""
    expected = F.when(_filled(F.col(frame_url)).isNotNull(), tx.page_key(F.col(frame_url))).otherwise("")
    return sources.groupBy(key).agg(F.bool_or((expected == "") | (expected == tx.page_key(F.col(current)))).alias("matches"))


def duplicate_sources(incoming: DataFrame, bound: DataFrame, keys: tuple[str, ...] = ("page_key", "frame_url", "selector", "table_index")) -> DataFrame:
    """Incoming sources that are bound already: the same page, frame, selector and index, empty ones included."""
    plain = lambda df: df.select("*", *(F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"__{k}") for k in keys))
    names = [f"__{k}" for k in keys]
    return plain(incoming).join(plain(bound).select(*names).distinct(), names, "left_semi").drop(*names)


def deferred_status(status: Column, source_page: Column, current_page: Column) -> Column:
    """A source on another page is ``deferred``: it isn't checked here."""
    return F.when(source_page != current_page, "deferred").otherwise(F.coalesce(F.nullif(status, F.lit("")), F.lit("checking")))


def global_numbers(skills: DataFrame, order: str) -> DataFrame:
    """Adds ``number``, 1-based in the catalog's order, whatever is shown later. Rows are dealt by ranges of a sample of the order,
    however sparse it is, and sorted there; what is summed up over the whole is one count for each range."""
    placed = cut(skills.repartitionByRange(order).sortWithinPartitions(order).withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))  # as many as partitions
    base = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = counts.select("__part", (base - F.col("__first") + 1).alias("__shift"))
    return placed.join(F.broadcast(shift), "__part").withColumn("number", F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")


def page_catalog(skills: DataFrame, sources: DataFrame, current: str | None = None) -> DataFrame:
    """``(group_key, label, n_skills, skills, n_focus, first_focus)`` of pages and tabs.

    Skills: (skill, seq, page_key, page_title). Sources: (skill, pos, page_key, tab, frame_url, selector, table_index,
    headers). A source with a tab title belongs to the tab; a skill with such a source has no entry for its own page.
    ``current`` is the page that isn't listed. ``skills`` are the members in catalog order, each once; focus sources are
    the different ones of the group, of which the first is named by its selector."""
    title = tx.one_line(F.col("tab"))
    by_source = sources.withColumn("group_key", F.when(title != "", F.concat(F.lit("tab:"), title)).otherwise(_filled(F.col("page_key"))))
    focus = F.array_join(
        F.array(*(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) for c in ("page_key", "frame_url", "selector")), F.coalesce("table_index", F.lit(0)).cast("string"), F.array_join(F.transform("headers", lambda h: F.trim(h)), "|")), "::"
    )
    numbered = by_source.join(skills.select("skill", "seq"), "skill")
    # of a skill's sources in one group the first speaks for it
    once = numbered.where("group_key is not null").groupBy("group_key", "skill", "seq").agg(F.min_by(F.struct(focus.alias("focus"), "selector", "pos"), "pos").alias("s"))
    tabbed = by_source.where(title != "").select("skill").distinct()
    own = skills.join(tabbed, "skill", "left_anti").where(_filled(F.col("page_key")).isNotNull()).select(F.col("page_key").alias("group_key"), "skill", "seq")
    both = once.select("group_key", "skill", "seq", "s").unionByName(own.join(once.select("group_key", "skill"), ["group_key", "skill"], "left_anti").withColumn("s", F.lit(None).cast(once.schema["s"].dataType)))
    both = both if current is None else both.where(F.col("group_key") != current)
    order = F.struct("seq", F.col("s.pos"))
    members = both.groupBy("group_key").agg(F.count("*").alias("n_skills"), F.array_sort(F.collect_list(F.struct("seq", "skill"))).alias("m"), F.min_by("s.selector", F.when(F.col("s").isNotNull(), order)).alias("first_focus"), F.countDistinct("s.focus").alias("n_focus"))
    label = F.when(F.col("group_key").startswith("tab:"), F.substring("group_key", 5, 1 << 20)).otherwise(F.coalesce(F.nullif(F.trim("page_title"), F.lit("")), "group_key"))
    titles = skills.groupBy(F.col("page_key").alias("group_key")).agg(F.min_by("page_title", "seq").alias("page_title"))
    return members.join(titles, "group_key", "left").select("group_key", label.alias("label"), "n_skills", F.array_join(F.transform("m", lambda x: x["skill"].cast("string")), ",").alias("skills"), "n_focus", "first_focus")
