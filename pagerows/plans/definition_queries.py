"""Queries of saved analyses: defaults, sources, validity, contents, where they belong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import definitions as d
from .registry import register, table

_POSITIONS = ("at-column", "after-last-selected-column", "elsewhere")


@register("f12_normalize_definition", f"""with o as (select *, {list(_POSITIONS)}[o_orderkey % 3 + 1] as p from orders)
    select o_orderkey, case when o_custkey % 2 = 0 then 'derived-column' else 'table-analysis' end as type, case when o_custkey % 4 = 0 then '分析结论' else o_orderpriority end as column_name,
    case when p = 'elsewhere' then 'before-first-selected-column' else p end as position, cast(case when p = 'at-column' and o_custkey % 7 < 5 then o_custkey % 7 else -1 end as integer) as position_index,
    cast(least(1000, case when o_orderkey % 1500 > 0 then o_orderkey % 1500 else 1000 end) as integer) as max_chars,
    cast(case when o_custkey % 5 = 0 then 100 else least(1000, 1 + o_custkey % 1200) end as integer) as max_rows, cast(least(20, case when o_orderkey % 30 > 5 then o_orderkey % 30 - 5 else 20 end) as integer) as max_batch_rows from o""")
def normalize_definition(spark, sf_dir):
    c = F.col
    position = F.get(F.array(*map(F.lit, _POSITIONS)), (c("o_orderkey") % 3).cast("int"))
    name = F.when(c("o_custkey") % 4 == 0, " ").otherwise(F.concat(F.lit(" "), "o_orderpriority"))
    index = F.when(c("o_custkey") % 7 < 5, (c("o_custkey") % 7).cast("string")).otherwise("x")
    output = d.normalize_output(name, position, index, (c("o_orderkey") % 1500).cast("string"))
    rows = F.when(c("o_custkey") % 5 == 0, "many").otherwise((1 + c("o_custkey") % 1200).cast("string"))
    whole = d.normalize_definition(F.when(c("o_custkey") % 2 == 0, "derived-column"), output, rows, (c("o_orderkey") % 30 - 5).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", whole.alias("w")).select("o_orderkey", "w.type", "w.output.*", "w.max_rows", "w.max_batch_rows")


@register("f14_merge_legacy_method", """select o_orderkey, case when o_orderkey % 3 = 0 then 'as it is' else array_to_string(list_filter([case when o_custkey % 2 = 0 then '分析目标：' || o_orderpriority end,
    case when o_custkey % 5 > 0 then '判断规则：' || o_orderstatus end, '补充说明：' || o_custkey], lambda x: x is not null), chr(10)) end as method from orders""")
def merge_legacy_method(spark, sf_dir):
    c = F.col
    parts = {"objective": F.when(c("o_custkey") % 2 == 0, c("o_orderpriority")), "rules": F.when(c("o_custkey") % 5 > 0, F.concat(F.lit(" "), "o_orderstatus")).otherwise(" "), "notes": c("o_custkey").cast("string")}
    return table(spark, sf_dir, "orders").select("o_orderkey", d.merge_legacy_method(F.when(c("o_orderkey") % 3 == 0, "as it is").otherwise(" "), parts).alias("method"))


def _sources(spark, sf_dir) -> DataFrame:
    """A customer's orders are the sources of an analysis."""
    c = F.col
    k = c("o_orderkey")
    page = F.concat(F.lit("https://Shop.example:443/p"), (c("o_custkey") % 50).cast("string"))
    return table(spark, sf_dir, "orders").select(
        c("o_custkey").alias("skill"), k.alias("seq"), (k % 2).cast("int").alias("frame_id"), F.when(k % 3 > 0, F.concat(page, F.lit("/f?x=1#y"))).alias("frame_url"),
        F.when(k % 5 == 0, "").otherwise(F.lit("https://old.example/q")).alias("page_key"), F.when(k % 7 == 0, F.concat(page, F.lit("?z"))).alias("page_url"), (k % 11 == 0).alias("legacy"),
        F.when(k % 4 == 0, F.concat(F.lit(" "), "o_orderstatus", F.lit("  x"))).alias("stored_name"), F.when(k % 4 == 1, c("o_orderpriority")).alias("title"), F.lit("").alias("tab"),
        F.when(k % 4 == 2, F.array(F.lit("序号"), F.lit(" "), c("o_orderpriority"), F.lit("CheckBox"), c("o_orderstatus"))).otherwise(F.array(F.lit("操作"))).alias("headers"),
    )


@register("f13_normalize_sources", """with s as (select o_custkey as skill, o_orderkey as seq, o_orderkey as k, row_number() over (partition by o_custkey order by o_orderkey) as n, 'https://Shop.example:443/p' || (o_custkey % 50) as page, * from orders),
    r as (select *, k % 2 = 0 and k % 11 <> 0 and k % 3 > 0 as repair, case when k % 3 > 0 then page || '/f?x=1#y' end as frame, case when k % 7 = 0 then page || '?z' end as url from s),
    u as (select *, case when repair then frame else coalesce(url, frame, '') end as page_url from r)
    select skill, seq, page_url, case when repair then 'https://shop.example/p' || (o_custkey % 50) || '/f' when k % 5 <> 0 then 'https://old.example/q' when page_url = '' then ''
    else 'https://shop.example/p' || (o_custkey % 50) || case when page_url like '%/f?%' then '/f' else '' end end as page_key,
    case k % 4 when 0 then o_orderstatus || ' x' when 1 then o_orderpriority when 2 then o_orderpriority || '、' || o_orderstatus || '等数据' else '数据源 ' || n end as name from u""")
def normalize_sources(spark, sf_dir):
    return d.normalize_sources(_sources(spark, sf_dir)).select("skill", "seq", "page_url", "page_key", "name")


@register("f13_stored_sources", """with s as (select o_custkey as skill, o_orderkey as seq, o_orderkey as k, row_number() over (partition by o_custkey order by o_orderkey) as n, 'https://Shop.example:443/p' || (o_custkey % 50) as page, * from orders),
    r as (select *, k % 2 = 0 and k % 11 <> 0 and k % 3 > 0 as repair, case when k % 3 > 0 then page || '/f?x=1#y' end as frame, case when k % 7 = 0 then page || '?z' end as url from s),
    u as (select *, case when repair then frame else coalesce(url, frame, '') end as page_url from r),
    v as (select *, case when repair then 'https://shop.example/p' || (o_custkey % 50) || '/f' when k % 5 <> 0 then 'https://old.example/q' when page_url = '' then ''
      else 'https://shop.example/p' || (o_custkey % 50) || case when page_url like '%/f?%' then '/f' else '' end end as page_key from u),
    w as (select *, k % 4 > 0 as made, case when skill % 3 = 0 then 'https://old.example/q' when skill % 3 = 1 then 'https://own.example/' end as own from v),
    x as (select skill, seq, n, case when made then 'source_' || skill || '_' || n else 'id' || k end as id, own, case when made and own is not null then own else page_key end as page_key from w)
    select skill, seq, id, page_key, case when coalesce(min_by(page_key, seq) over y, '') <> '' and not coalesce(bool_or(page_key = own) over y, false) then min_by(page_key, seq) over y else own end as main_page from x window y as (partition by skill)""")
def stored_sources(spark, sf_dir):
    """Some sources have ids of their own, the others those that a migration made."""
    c = F.col
    sources = _sources(spark, sf_dir).withColumn("id", F.when(c("seq") % 4 == 0, F.concat(F.lit("id"), c("seq").cast("string"))))
    own = F.when(c("skill") % 3 == 0, "https://old.example/q").when(c("skill") % 3 == 1, "https://own.example/")
    skills = sources.select("skill").distinct().select("skill", own.alias("page_key"), F.lit("").alias("page_url"))
    return d.stored_sources(skills, sources).select("skill", "seq", "id", "page_key", "main_page")


@register("f12_method_and_trigger", """select o_orderkey, case o_orderkey % 6 when 0 then o_orderpriority when 1 then 'a' || chr(10) || o_orderpriority when 2 then '' when 3 then '{x' when 4 then 'q "1"' else '' end as method, 'page-load' as mode, o_orderkey % 5 = 0 as auto_run_enabled from orders""")
def method_and_trigger(spark, sf_dir):
    c, lit = F.col, F.lit
    k = c("o_orderkey")
    stored = (
        F.when(k % 6 == 0, F.concat(lit(" \n"), "o_orderpriority", lit(" "))).when(k % 6 == 1, F.to_json(F.struct(F.concat(lit(" a\r\n"), "o_orderpriority").alias("description"))))
        .when(k % 6 == 2, '{"other": 1}').when(k % 6 == 3, "{x ").when(k % 6 == 4, '" q \\"1\\" "')
    )
    trigger = d.normalize_trigger(F.when(k % 2 == 0, "page-load").when(k % 3 == 0, "never"), F.when(k % 5 == 0, True).when(k % 5 == 1, False))
    return table(spark, sf_dir, "orders").select("o_orderkey", d.normalize_method(stored).alias("method"), trigger.alias("t")).select("o_orderkey", "method", "t.*")


@register("f11_valid_definition", """with s as (select o_custkey, count(*) filter (o_orderkey % 9 = 0) as bad, count(*) as n from orders group by o_custkey)
    select c_custkey, array_to_string(list_filter([case when c_custkey % 6 = 0 then '缺少技能名称' end, case when n is null then '没有数据源' end, case when bad > 0 then '包含无效的数据源绑定' end,
    case when c_custkey % 2 = 0 and c_custkey % 13 = 0 then '请至少选择一列' end, case when c_custkey % 2 = 0 and c_custkey % 13 > 10 then '最多选择 10 列' end], lambda x: x is not null), ',') as errors from customer left join s on o_custkey = c_custkey""")
def valid_definition(spark, sf_dir):
    c = F.col
    k = c("o_orderkey")
    bad = d.bad_source(F.when(k % 9 > 0, "p"), F.when(k % 9 >= 0, F.array(F.lit("h"))), F.when(k % 4 > 0, "#t"), F.when(k % 4 == 0, 0))
    sources = table(spark, sf_dir, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    both = table(spark, sf_dir, "customer").join(sources, "c_custkey", "left")
    kind = F.when(c("c_custkey") % 2 == 0, "derived-column")
    errors = d.definition_errors(kind, F.when(c("c_custkey") % 6 > 0, c("c_name")), F.coalesce("n", F.lit(0)), F.coalesce("bad", F.lit(0)), c("c_custkey") % 13)
    return both.select("c_custkey", F.array_join(errors, ",").alias("errors"))


@register("sf9_content_fingerprint", """select o_orderkey, sha256(case when o_custkey % 2 = 0 then '{"type":"derived-column","sources":[{"pageKey":"p' || o_custkey || '","frameUrl":"","selector":"#t","tableIndex":' || case when o_orderkey % 3 = 0 then 'null' else cast(o_orderkey % 3 as varchar) end ||
    ',"headers":["' || lower(o_orderstatus) || 'x",""]}],"selectedColumns":[{"normalizedHeader":"' || lower(o_orderstatus) || '","occurrence":1}],"analysisMethod":"' || m || '","defaultMethodVersion":' || case when m = '' then '3' else 'null' end || ',"output":{"columnName":"c","position":"at-column","maxChars":7}}'
    else '{"sources":[{"pageKey":"p' || o_custkey || '","frameUrl":"","selector":"#t","tableIndex":' || case when o_orderkey % 3 = 0 then 'null' else cast(o_orderkey % 3 as varchar) end || ',"headers":["' || lower(o_orderstatus) || 'x",""]}],"analysisMethod":"' || m || '"}' end) as fingerprint
    from (select *, case when o_orderkey % 2 = 0 then 'look at ' || o_orderpriority else '' end as m from orders)""")
def content_fingerprint(spark, sf_dir):
    c = F.col
    source = F.struct(
        F.concat(F.lit(" p"), c("o_custkey").cast("string")).alias("page_key"), F.lit(None).cast("string").alias("frame_url"), F.lit("#t ").alias("selector"),
        F.when(c("o_orderkey") % 3 > 0, c("o_orderkey") % 3).alias("table_index"), F.array(F.concat("o_orderstatus", F.lit(" X")), F.lit(None).cast("string")).alias("headers"),
    )
    selected = F.array(*(F.struct(h.alias("header"), F.lit(0).alias("occurrence")) for h in (c("o_orderstatus"), F.lower("o_orderstatus"))))
    method = F.when(c("o_orderkey") % 2 == 0, F.concat(F.lit("\nlook at "), "o_orderpriority"))
    output = d.normalize_output(F.lit("c "), F.lit("at-column"), F.lit("2"), F.lit("7"))
    fp = d.content_fingerprint(F.when(c("o_custkey") % 2 == 0, "derived-column"), F.array(source), method, selected, F.lit(3), output)
    return table(spark, sf_dir, "orders").select("o_orderkey", fp.alias("fingerprint"))


def _page(c):
    return F.concat(F.lit("p"), (c % 40).cast("string"))


def _skills(spark, sf_dir) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "customer").select(c("c_custkey").alias("skill"), c("c_custkey").alias("seq"), _page(c("c_custkey")).alias("page_key"), F.when(c("c_custkey") % 3 > 0, F.concat(F.lit("T"), (c("c_custkey") % 40).cast("string"))).alias("page_title"))


def _bound(spark, sf_dir) -> DataFrame:
    c = F.col
    k = c("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        c("o_custkey").alias("skill"), k.alias("pos"), F.when(k % 6 > 0, _page(k)).alias("page_key"), F.when(c("o_custkey") % 5 == 0, F.when(k % 4 == 0, F.concat(F.lit(" tab "), (k % 9).cast("string")))).alias("tab"),
        F.lit("").alias("frame_url"), F.concat(F.lit("#s"), (k % 3).cast("string")).alias("selector"), (k % 2).cast("int").alias("table_index"), F.array(F.lit("a"), c("o_orderstatus")).alias("headers"),
    )


@register("f8_page_skills", """select distinct skill, page_key from (select c_custkey as skill, 'p' || (c_custkey % 40) as page_key from customer union all select o_custkey, 'p' || (o_orderkey % 40) from orders where o_orderkey % 6 > 0)
    where page_key in ('p3', 'p17', 'p39')""")
def page_skills(spark, sf_dir):
    shown = table(spark, sf_dir, "nation").where("n_nationkey in (3, 17) or n_nationkey = 24").select(F.concat(F.lit("p"), F.when(F.col("n_nationkey") == 24, 39).otherwise(F.col("n_nationkey")).cast("string")).alias("page_key"))
    return d.page_skills(_skills(spark, sf_dir), _bound(spark, sf_dir), shown)


@register("f8_tab_skills", """with s as (select o_custkey as skill, case when o_orderkey % 6 > 0 then 'p' || (o_orderkey % 40) end as page_key, case when o_custkey % 5 = 0 and o_orderkey % 4 = 0 then 'tab ' || (o_orderkey % 9) else '' end as tab from orders)
    select skill from s where tab = 'tab 2' or tab = '' and page_key = 'p7' union select c_custkey from customer where c_custkey % 40 = 7 and c_custkey not in (select skill from s where tab <> '')""")
def tab_skills(spark, sf_dir):
    return d.tab_skills(_skills(spark, sf_dir), _bound(spark, sf_dir), "tab 2", ["tab 1", "tab 2"], "p7")


@register("f9_frame_matches", """select o_custkey, bool_or(o_orderkey % 10 = 0 or o_orderkey % 4 = o_custkey % 4) as matches from orders where o_orderkey % 3 > 0 group by o_custkey""")
def frame_matches(spark, sf_dir):
    frame = F.when(F.col("o_orderkey") % 10 > 0, F.concat(F.lit("http://H.example:80/f"), (F.col("o_orderkey") % 4).cast("string"), F.lit("?q")))
    now = F.concat(F.lit("http://h.example/f"), (F.col("o_custkey") % 4).cast("string"), F.lit("#x"))
    rows = table(spark, sf_dir, "orders").where("o_orderkey % 3 > 0").select("o_custkey", frame.alias("frame_url"), now.alias("current"))
    return d.frame_matches(rows, "o_custkey")


@register("f10_headers_match", "select o_orderkey, o_orderkey % 3 = 0 as matches from orders")
def headers_match(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    stored = F.array(F.lit("Order Key"), F.col("o_orderpriority"))
    shown = F.when(k == 0, F.array(F.lit("ORDER\tkey "), F.lower("o_orderpriority"))).when(k == 1, F.array(F.col("o_orderpriority"), F.lit("Order Key"))).otherwise(F.array(F.lit("Order Key"), F.col("o_orderpriority"), F.lit("more")))
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.transform(stored, tx.norm_header) == F.transform(shown, tx.norm_header)).alias("matches"))


@register("f21_status_deferred", """select o_orderkey, case when o_custkey % 4 <> o_orderkey % 4 then 'deferred' when o_orderstatus = 'P' then 'checking' else o_orderstatus end as status from orders""")
def status_deferred(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", d.deferred_status(status, F.col("o_orderkey") % 4, F.col("o_custkey") % 4).alias("status"))


@register("j17_dup_source", """select l_orderkey, l_linenumber from lineitem where exists (select 1 from orders where o_orderkey = l_orderkey % 5000 and o_orderstatus = l_linestatus and o_custkey % 3 = l_linenumber % 3)""")
def dup_source(spark, sf_dir):
    bound = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_key"), F.lit(None).cast("string").alias("frame_url"), F.col("o_orderstatus").alias("selector"), (F.col("o_custkey") % 3).alias("table_index"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 5000).alias("page_key"), F.lit("").alias("frame_url"), F.col("l_linestatus").alias("selector"), (F.col("l_linenumber") % 3).alias("table_index"))
    return d.duplicate_sources(lines, bound).select("l_orderkey", "l_linenumber")


@register("w11_global_numbers", "select o_orderkey, row_number() over (order by hash_key, o_orderkey) as number from (select o_orderkey, o_orderkey * 1000003 % 9999991 as hash_key from orders)")
def global_numbers(spark, sf_dir):
    """The catalog's order is sparse and not the key's."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.struct((F.col("o_orderkey") * 1000003 % 9999991).alias("h"), "o_orderkey").alias("place"))
    return d.global_numbers(orders, "place").select("o_orderkey", "number")


@register("ag10_page_catalog", """with s as (select o_custkey as skill, o_orderkey as pos, case when o_custkey % 5 = 0 and o_orderkey % 4 = 0 then 'tab:tab ' || (o_orderkey % 9) when o_orderkey % 6 > 0 then 'p' || (o_orderkey % 40) end as g,
      case when o_orderkey % 6 > 0 then 'p' || (o_orderkey % 40) else '' end || '::' || '' || '::#s' || (o_orderkey % 3) || '::' || (o_orderkey % 2) || '::a|' || o_orderstatus as focus, '#s' || (o_orderkey % 3) as selector from orders),
    f as (select * from s where g is not null and skill in (select c_custkey from customer) qualify row_number() over (partition by g, skill order by pos) = 1),
    o as (select 'p' || (c_custkey % 40) as g, c_custkey as skill from customer where c_custkey not in (select skill from s where g like 'tab:%')),
    u as (select g, skill, focus, selector, pos from f union all select g, skill, null, null, null from o anti join f using (g, skill)),
    t as (select 'p' || (c_custkey % 40) as g, min_by(case when c_custkey % 3 > 0 then 'T' || (c_custkey % 40) end, c_custkey) filter (c_custkey % 3 > 0 or true) as title, min(c_custkey) as least from customer group by 1)
    select u.g as group_key, case when u.g like 'tab:%' then u.g[5:] else coalesce(case when least % 3 > 0 then 'T' || (least % 40) end, u.g) end as label, count(*) as n_skills, string_agg(cast(skill as varchar), ',' order by skill) as skills,
    count(distinct focus) as n_focus, min_by(selector, (skill, pos)) filter (focus is not null) as first_focus from u left join t on t.g = u.g where u.g <> 'p5' group by u.g, least""")
def page_catalog(spark, sf_dir):
    return d.page_catalog(_skills(spark, sf_dir), _bound(spark, sf_dir), "p5")
