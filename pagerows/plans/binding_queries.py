"""Queries of bindings against the tables of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import binding
from .registry import register, table


def _candidates(spark, sf_dir) -> DataFrame:
    """A customer's page shows a table for each order."""
    c = F.col
    k = c("o_orderkey")
    index = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return table(spark, sf_dir, "orders").select(
        c("o_custkey").alias("page_key"), index.alias("candidate"), F.array(F.lit("Order  Key"), "o_orderstatus", "o_orderpriority").alias("headers"), F.when(c("o_totalprice") > 300_000, "ant").otherwise("native").alias("component_type"),
        F.when(k % 3 == 0, F.lit(" s  1")).otherwise("s").alias("container_signature"), F.when(k % 2 == 0, "T").otherwise("u").alias("title"), F.concat(F.lit("#t"), (k % 5).cast("string")).alias("selector"), (k % 7 > 0).alias("visible"),
    )


def _bindings(spark, sf_dir) -> DataFrame:
    c = F.col
    k = c("c_custkey")
    selected = F.array(*(F.struct(h.alias("header"), F.lit(1).alias("occurrence")) for h in (F.lit("o"), F.lit("1-URGENT"))))
    return table(spark, sf_dir, "customer").select(
        k.alias("binding"), k.alias("page_key"), F.when(k % 6 > 0, F.array(F.lit("orderkey"), F.lit("O"), F.lit("1-urgent"))).alias("headers"), selected.alias("selected"), (k % 4 == 0).alias("derived"), F.when(k % 3 > 0, "native").alias("component_type"),
        F.when(k % 2 == 0, "s 1").alias("container_signature"), F.when(k % 3 == 0, "t").alias("title"), F.concat(F.lit("#t"), (k % 5).cast("string")).alias("selector"), (k % 2 == 0).alias("stable"), (k % 3).cast("int").alias("table_index"),
    )


_MATCH = """c as (select o_custkey as k, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as i, o_orderstatus, o_orderpriority, o_totalprice > 300000 as ant from orders),
    b as (select c.k, i, o_orderstatus, o_orderpriority, case when k % 6 > 0 then (1 + case when o_orderstatus = 'O' then 1 else 0 end + case when o_orderpriority = '1-URGENT' then 1 else 0 end) / 3e0 else 0e0 end as cov,
      (case when o_orderstatus = 'O' then 1 else 0 end + case when o_orderpriority = '1-URGENT' then 1 else 0 end) / 2e0 as picked, k % 6 > 0 and o_orderstatus = 'O' and o_orderpriority = '1-URGENT' as exact, k % 5 = o_orderkey % 5 as sel, k % 3 = i as idx,
      k % 3 = 0 or not ant as same, case when k % 2 = 0 then o_orderkey % 3 = 0 end as sig, case when k % 3 = 0 then o_orderkey % 2 = 0 end as ttl, o_orderkey % 7 > 0 as vis, count(*) over (partition by k) as n from c),
    s as (select *, case when exact then true when k % 4 = 0 then picked = 1 else cov >= 78e-2 end as ok, case when vis then 3e-2 else 0e0 end + case when sel then case when k % 2 = 0 then 22e-2 else 8e-2 end else 0e0 end + case when idx then 3e-2 else 0e0 end + case when same then 8e-2 else -12e-2 end
      + case when sig is null then 0e0 when sig then 18e-2 else -12e-2 end + case when ttl is null then 0e0 when ttl then 8e-2 else -5e-2 end + case when exact then 35e-2 else 0e0 end + cov * 28e-2 + picked * 30e-2 as score from b),
    r as (select *, row_number() over w as place, lead(score) over w as score2, lead(ok) over w as ok2 from s window w as (partition by k order by score desc, picked desc, cov desc, sel desc, i)),
    f as (select *, case when abs(score - score2) < 8e-2 and (ok or ok2 or cov >= 45e-2) then 'ambiguous' when ok then 'available' when cov >= 45e-2 or sel or idx then 'changed' else 'missing' end as status from r where place = 1),
    g as (select c_custkey as binding, coalesce(status, 'missing') as status, case when status in ('available', 'changed') then cast(i as integer) end as candidate, coalesce(n, 0) as candidates, f.* exclude (status) from customer left join f on f.k = c_custkey)"""


@register("j7_match_sources", f"""with {_MATCH} select binding, status, candidate, candidates, case when candidate is not null then case when sel then case when k % 2 = 0 then 'stable-selector' else 'selector' end when idx then 'tableIndex' else 'scored-candidate' end end as method from g""")
def match_sources(spark, sf_dir):
    return binding.match_sources(_bindings(spark, sf_dir), _candidates(spark, sf_dir))


@register("ag9_selected_coverage", """select o_orderkey, 3 as total, (case when o_orderstatus = 'O' then 1 else 0 end + case when o_orderpriority = '1-URGENT' then 1 else 0 end) as matched,
    array_to_string(list_filter([case when o_orderstatus <> 'O' then 'o#1' end, case when o_orderpriority <> '1-URGENT' then '1-urgent#1' end, 'o#2'], lambda x: x is not null), ',') as missing from orders""")
def selected_coverage(spark, sf_dir):
    selected = F.array(*(F.struct(F.lit(h).alias("header"), F.lit(n).alias("occurrence")) for h, n in (("o", 1), ("1-Urgent", 1), ("O ", 1), ("O", 2))))
    found = binding.selected_coverage(selected, F.array("o_orderpriority", "o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", found.alias("f")).select("o_orderkey", "f.total", "f.matched", F.array_join("f.missing", ",").alias("missing"))


@register("job5_bind_and_validate", f"""with {_MATCH} select binding, status, case status when 'available' then '可用' when 'changed' then '数据源已变化' when 'ambiguous' then '数据源位置不明确' else '数据源失效' end as label, candidate, candidates,
    case when candidate is not null then case when k % 6 = 0 then -1 when o_orderstatus <> 'O' then 1 when o_orderpriority <> '1-URGENT' then 2 else -1 end end as first_mismatch,
    case when candidate is not null then case when k % 6 = 0 then 0 else case when o_orderstatus <> 'O' then 1 else 0 end + case when o_orderpriority <> '1-URGENT' then 1 else 0 end end end as missing,
    case when candidate is not null then case when k % 6 = 0 then 3 else case when o_orderstatus <> 'O' then 1 else 0 end + case when o_orderpriority <> '1-URGENT' then 1 else 0 end end end as added from g""")
def bind_and_validate(spark, sf_dir):
    return binding.bind_and_validate(_bindings(spark, sf_dir), _candidates(spark, sf_dir))
