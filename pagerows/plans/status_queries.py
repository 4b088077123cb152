"""Queries of source states, deletions, overviews and the catalog's fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import catalog_log, folds, status
from .fold_queries import _CONTEXTS_SQL, _contexts
from .registry import register, table

_STATES = ("available", "deferred", "changed", "ambiguous", "missing", "")
_SOURCES_SQL = f"s as (select *, {list(_STATES)}[o_orderkey % 6 + 1] as status, case when o_orderkey % 11 > 0 then o_orderkey % 50 end as row_count, case when o_orderkey % 3 > 0 then o_orderkey % 7 > 0 end as complete from orders)"


def _sources(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "*", F.get(F.array(*map(F.lit, _STATES)), (k % 6).cast("int")).alias("status"), F.when(k % 11 > 0, k % 50).alias("row_count"), F.when(k % 3 > 0, k % 7 > 0).alias("complete_for_request")
    )


@register("f6_unavailable_sources", f"with {_SOURCES_SQL} select o_orderkey, case status when '' then 'checking' else status end as status from s where status not in ('available', 'deferred')")
def unavailable_sources(spark, sf_dir):
    return status.unavailable_sources(_sources(spark, sf_dir)).select("o_orderkey", "status")


@register("f7_recovery_status", f"""with {_SOURCES_SQL}, b as (select *, case status when 'changed' then 0 when 'ambiguous' then 1 when 'missing' then 2 else 3 end as r,
    case status when 'changed' then '数据源已变化' when 'ambiguous' then '数据源位置不明确' when 'missing' then '数据源失效' else '校验中' end as label from s where status not in ('available', 'deferred')),
    l as (select o_custkey, label, min(o_orderkey) as first from b group by o_custkey, label)
    select o_custkey, ['changed', 'ambiguous', 'missing', 'checking'][min(r) + 1] as worst, (select string_agg(label, '、' order by first) from l where l.o_custkey = b.o_custkey) as labels,
    string_agg(o_orderpriority, '、' order by o_orderkey) as names from b group by o_custkey""")
def recovery_status(spark, sf_dir):
    return status.recovery_status(_sources(spark, sf_dir), "o_custkey", "o_orderkey", "o_orderpriority")


@register("f4_incomplete_sources", f"with {_SOURCES_SQL} select o_orderkey from s where row_count is null or complete = false")
def incomplete_sources(spark, sf_dir):
    return status.incomplete_sources(_sources(spark, sf_dir)).select("o_orderkey")


@register("f5_all_sources_ready", f"with {_SOURCES_SQL} select o_custkey, bool_and(row_count is not null and coalesce(complete, true)) as ready, count(row_count) as loaded, cast(coalesce(sum(row_count), 0) as bigint) as total_rows from s group by o_custkey")
def all_sources_ready(spark, sf_dir):
    return status.all_sources_ready(_sources(spark, sf_dir), "o_custkey")


@register("j15_reusable_sources", f"""with {_SOURCES_SQL} select o_custkey, o_orderpriority, min(o_orderkey) as o_orderkey from s where status in ('available', 'deferred')
    and (o_custkey, o_orderpriority) not in (select (o_custkey, o_orderpriority) from s where row_count > 40) group by o_custkey, o_orderpriority""")
def reusable_sources(spark, sf_dir):
    keys, all_ = ["o_custkey", "o_orderpriority"], _sources(spark, sf_dir)
    return status.reusable_sources(all_, all_.where("row_count > 40"), keys, "o_orderkey").select(*keys, "o_orderkey")


@register("j16_learn_tabs", """select c_custkey, case when c_custkey % 2 = 0 then c_mktsegment else coalesce(o.tab, '') end as tab from customer left join
    (select o_custkey, min_by(o_orderpriority, o_orderkey) as tab from orders where o_orderstatus <> 'P' group by o_custkey) o on o_custkey = c_custkey""")
def learn_tabs(spark, sf_dir):
    sources = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("tab"))
    said = F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.concat(F.lit(" "), "o_orderpriority"))
    return status.learn_tabs(sources, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), said.alias("tab"), F.col("o_orderkey").alias("seq")), "c_custkey")


@register("j12_page_names", """select c_custkey, coalesce(nullif(trim(n_name), ''), case when c_custkey % 3 > 0 then c_name end, cast(c_custkey as varchar)) as label
    from customer left join nation on n_nationkey * 7 = c_custkey""")
def page_names(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 7).cast("long").alias("c_custkey"), F.col("n_name").alias("name"))
    pages = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).otherwise(" ").alias("title"))
    return status.page_names(pages, names, "c_custkey", "title").select("c_custkey", "label")


def _lines(spark, sf_dir):
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("session"), n.cast("string").alias("ref"), F.when(n % 4 == 1, "table-header").otherwise("table-row").alias("kind"),
        F.col("l_suppkey").alias("table_id"), F.when(n % 3 > 0, n % 3).alias("page_index"),
    )


@register("f20_delete_contexts", """with c as (select o_orderkey // 40 as session, o_orderkey as n, o_orderkey % 4 = 0 as is_head, o_orderkey - o_orderkey % 4 as head, o_totalprice > 200000 as gone from orders),
    h as (select session, head, bool_or(gone and is_head) as dead, count(*) filter (not is_head) as rows, count(*) filter (not is_head and not gone) as live from c group by session, head)
    select session, cast(n as varchar) as ref from c join h using (session, head) where not gone and not dead and not (is_head and rows > 0 and live = 0)""")
def delete_contexts(spark, sf_dir):
    n = F.col("o_orderkey")
    contexts = table(spark, sf_dir, "orders").select(
        F.floor(n / 40).alias("session"), n.cast("string").alias("ref"), F.when(n % 4 == 0, "table-header").otherwise("table-row").alias("kind"),
        F.when(n % 4 != 0, (n - n % 4).cast("string")).alias("header_ref"), (F.col("o_totalprice") > 200000).alias("gone"),
    )
    return status.delete_contexts(contexts, contexts.where("gone")).select("session", "ref")


@register("f20_clear_group", """with c as (select l_orderkey, l_linenumber, l_suppkey, case when l_linenumber % 3 > 0 then l_linenumber % 3 end as p, l_linenumber % 4 = 1 as head from lineitem)
    select l_orderkey as session, cast(l_linenumber as varchar) as ref from c where head or not (s_cleared(l_suppkey, p))""".replace("s_cleared(l_suppkey, p)", "l_suppkey % 5 = 0 or (l_suppkey % 5 = 1 and (p is null or p = 2))"))
def clear_group(spark, sf_dir):
    key = F.col("s_suppkey")
    cleared = table(spark, sf_dir, "supplier").where("s_suppkey % 5 < 2").select(key.alias("table_id"), F.when(key % 5 == 1, 2).alias("page_index"))
    return status.clear_group(_lines(spark, sf_dir), cleared).select("session", "ref")


@register("ag5_overview", f"""with {_CONTEXTS_SQL}, t as (select session, group_id, bool_or(head) as h, count(*) filter (not head) as n from g group by session, group_id)
    select session, count(*) as tables, cast(sum(n) as bigint) as rows, count(*) filter (not h) as headerless,
    greatest(1, (select count(distinct created_at % 3) from g where g.session = t.session and not head)) as pages from t group by session""")
def overview(spark, sf_dir):
    contexts = folds.assign_groups(_contexts(spark, sf_dir)).withColumn("url", F.col("created_at") % 3)
    return status.overview(contexts)


@register("w18_legacy_groups", """select l_suppkey as session, l_orderkey * 10 + l_linenumber as seq, 'TG:legacy:' || coalesce(last_value(case when l_linenumber = 1 then 'H' || l_orderkey end ignore nulls)
    over (partition by l_suppkey order by l_orderkey * 10 + l_linenumber desc rows unbounded preceding), 'headerless') as group_id from lineitem""")
def legacy_groups(spark, sf_dir):
    return status.legacy_groups(_contexts(spark, sf_dir)).select("session", "seq", "group_id")


@register("w15_no_progress_stop", """select user_id, min(struct_pack(ts := ts, event_id := event_id)).event_id as event_id from (select *, sum(case when value < 60 then 1 else 0 end)
    over (partition by user_id order by ts, event_id rows 1 preceding) as run from events) where run = 2 group by user_id""")
def no_progress_stop(spark, sf_dir):
    steps = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(F.col("value") < 60, 0).otherwise(1).alias("added"))
    return status.no_progress_stop(steps, "user_id", ["ts", "event_id"], "added").select("user_id", "event_id")


_BARE = r"left(regexp_replace(regexp_replace(trim(p_size || ' ✓ | ' || p_name), '^\d+\s*[✓✗]?\s*\|?\s*', ''), '\s+', '', 'g'), 30)"


@register("ag12_table_digest", f"""select p_brand, count(*) || '|' || array_to_string(list(t order by p_partkey)[1:3], '||') as digest from (select p_brand, p_partkey, {_BARE} as t from part) group by p_brand""")
def table_digest(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.concat(F.col("p_size").cast("string"), F.lit(" ✓ | "), "p_name").alias("t"))
    return status.table_digest(rows, "p_brand", "p_partkey", "t")


@register("ag14_failure_map", """select user_id, event_type, min_by(case when value < 100 then '分析失败' else props end, event_id) as error from events group by user_id, event_type""")
def failure_map(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("error", F.when(F.col("value") < 100, " ").otherwise(F.col("props")))
    return status.failure_map(events, ["user_id", "event_type"], "event_id")


@register("st8_recent_result", """select event_id, coalesce(epoch_ms(ts) - epoch_ms(lag(ts) over (partition by user_id, event_type order by ts, event_id)) <= 86400000, false) as reused from events""")
def recent_result(spark, sf_dir):
    return status.recent_result(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id", 86_400_000).select("event_id", "reused")


_KINDS = {"signup": "UPSERT_SKILL", "click": "UPDATE_ANALYSIS_METHOD", "error": "DELETE_SKILL", "purchase": "LEARN_SOURCE_BUSINESS_TAB", "view": "UPSERT_SKILL"}
_KIND_SQL = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in _KINDS.items()) + " end"


@register("job3_catalog_apply", f"""with recursive c as (select user_id, event_id, {_KIND_SQL} as what, case when event_id % 2 = 0 then event_id % 4 end as wanted, row_number() over (partition by user_id order by event_id) as k from events),
    f as (select user_id, cast(0 as bigint) as event_id, cast(0 as bigint) as k, cast(null as bigint) as revision, '' as outcome from (select distinct user_id from events) union all
    select user_id, event_id, k, case when error <> '' then revision when what = 'DELETE_SKILL' then null when what like 'LEARN%' then revision else coalesce(revision, 0) + 1 end,
    case when error <> '' then error when what = 'DELETE_SKILL' then 'deleted' when what like 'LEARN%' then cast(revision as varchar) else cast(coalesce(revision, 0) + 1 as varchar) end from
    (select c.*, f.revision, case when f.revision is null and what = 'UPSERT_SKILL' then case when coalesce(wanted, 0) > 0 then 'SKILL_CONFLICT' else '' end when f.revision is null then 'SKILL_NOT_FOUND'
    when what like 'LEARN%' or wanted is null or wanted = f.revision then '' else 'SKILL_CONFLICT' end as error from f join c on c.user_id = f.user_id and c.k = f.k + 1))
    select user_id, event_id, outcome from f where k > 0""")
def catalog_apply(spark, sf_dir):
    """Catalogs of one analysis with one source."""
    c, n = F.col, F.col("event_id")
    kind = F.coalesce(*(F.when(c("event_type") == k, v) for k, v in _KINDS.items()))
    source = F.struct(F.lit("a").alias("id"), *(F.lit(None).cast(t).alias(k) for k, t in (("place", "string"), ("headers", "array<string>"), ("tab", "string"), ("confirmed", "boolean"), ("captured_at", "bigint"))))
    skill = F.struct(F.lit("s").alias("id"), *(F.lit(None).cast(t).alias(k) for k, t in (("name", "string"), ("revision", "bigint"), ("created_at", "bigint"), ("method", "string"), ("content", "string"), ("version", "int"))), F.array(source).alias("sources"))
    events = table(spark, sf_dir, "events").select(
        c("user_id").alias("catalog"), n.alias("seq"), kind.alias("type"), F.lit("s").alias("skill_id"), F.lit("a").alias("source_id"), F.when(n % 2 == 0, n % 4).alias("expected_revision"), n.alias("now"), F.lit(None).cast("string").alias("page_key"),
        F.lit("v").alias("value"), F.lit(None).cast("array<string>").alias("headers"), F.array(skill).alias("skills"), F.lit(None).cast("map<string,string>").alias("page_names"),
    )
    return catalog_log.outcomes(events).select(c("catalog").alias("user_id"), c("seq").alias("event_id"), "outcome")


@register("sf12_context_identity", """select p_partkey, case when p_size % 3 = 0 then '' when p_size % 3 = 1 then 'row-key:' || p_name else 'table-dom::' || p_type || '::' || p_brand || '::table-row::::' || p_name end as identity from part""")
def context_identity(spark, sf_dir):
    kind = F.when(F.col("p_size") % 3 == 0, "snippet").otherwise("table-row")
    key = F.when(F.col("p_size") % 3 == 1, F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.context_identity(key, F.col("p_type"), F.col("p_brand"), kind, F.lit(None).cast("string"), F.col("p_name")).alias("identity"))


@register("sf13_virtual_position", "select l_orderkey, l_linenumber, l_suppkey || '::page:' || l_linenumber || '::virtual-index:' || l_partkey as position from lineitem")
def virtual_position(spark, sf_dir):
    position = tx.virtual_position(F.col("l_suppkey").cast("string"), F.col("l_linenumber"), F.col("l_partkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", position.alias("position"))


@register("sf18_row_markdown", r"""select p_partkey, '| 字段 | 值 |' || chr(10) || '| --- | --- |' || chr(10) || '| 名称 | ' || p_name || ' |' || chr(10) || '| a\|b | ' || p_brand || '\|' || p_type || ' |' as text from part""")
def row_markdown(spark, sf_dir):
    headers = F.array(F.lit("名称"), F.lit("a|b"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.row_markdown(headers, F.array("p_name", F.concat_ws("|", "p_brand", "p_type"))).alias("text"))


@register("sf21_direct_url", """select p_partkey, case when p_size % 4 < 2 then 'https://h' || p_size || '.test/epaas?n=' || replace(url_encode(p_name), '%20', '+') else '' end as direct from part""")
def direct_url(spark, sf_dir):
    tail = F.get(F.array(*map(F.lit, ("/epaas", "/epaas/?x=1#y", "/epaas/a", "/"))), F.col("p_size") % 4)
    url = F.concat(F.lit("https://H"), F.col("p_size").cast("string"), F.lit(".test"), tail)
    return table(spark, sf_dir, "part").select("p_partkey", tx.direct_url(url, F.concat(F.lit(" "), "p_name")).alias("direct"))


@register("sf24_whole_number", """select event_id, case when event_id % 3 = 0 then 20 else least(greatest(cast(trunc(value) as bigint), 5), 100) end as n from events""")
def whole_number(spark, sf_dir):
    said = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("value").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", tx.whole_number(said, 20, 5, 100).alias("n"))


@register("snk7_insert_index", """select p_partkey, case when p_size % 4 = 0 then p_size when p_size % 4 = 1 then p_size + 4 when p_size % 4 = 2 then p_size else 0 end as at from part""")
def insert_index(spark, sf_dir):
    n = F.col("p_size")
    held = F.when(n % 4 == 3, F.array(F.lit(-1))).otherwise(F.array(n + 3, n, F.lit(-1)))
    position = F.get(F.array(*map(F.lit, ("at-column", "after-last-selected-column", "", ""))), n % 4)
    return table(spark, sf_dir, "part").select("p_partkey", tx.insert_index(held, position, n).alias("at"))


@register("ag11_list_signature", "select l_orderkey, string_agg(l_partkey, '|' order by l_linenumber, cast(l_partkey as varchar)) as signature, sha256(string_agg(l_partkey, '|' order by l_linenumber, cast(l_partkey as varchar))) as digest from lineitem group by l_orderkey")
def list_signature(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").cast("string").alias("fp"))))
    fps = F.transform(rows, lambda r: r["fp"])
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(tx.list_signature(fps).alias("signature"), tx.list_digest(fps).alias("digest"))
