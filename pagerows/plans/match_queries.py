"""Queries of matching, frames and the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, matching
from .registry import register, table


@register("w8_best_match", """with c as (select l_partkey, l_orderkey * 10 + l_linenumber as id, l_returnflag = 'R' as sel, l_linenumber = 1 as idx, l_quantity >= 45 as exact,
    (l_quantity % 10) / 1e1 as cov, (l_quantity % 3) / 2e0 as picked,
    3e-2 + case when l_returnflag = 'R' then case when l_linestatus = 'O' then 22e-2 else 8e-2 end else 0e0 end + case when l_linenumber = 1 then 3e-2 else 0e0 end
    + case when l_discount < 0.05 then 8e-2 else -12e-2 end + case when l_tax < 0.02 then 0e0 when l_tax < 0.05 then 18e-2 else -12e-2 end + 0e0
    + case when l_quantity >= 45 then 35e-2 else 0e0 end + (l_quantity % 10) / 1e1 * 28e-2 + (l_quantity % 3) / 2e0 * 30e-2 as score from lineitem),
    r as (select *, exact or cov >= 78e-2 as ok, row_number() over w as k, lead(score) over w as score2, lead(exact or cov >= 78e-2) over w as ok2
    from c window w as (partition by l_partkey order by score desc, picked desc, cov desc, sel desc, id)),
    s as (select *, case when abs(score - score2) < 8e-2 and (ok or ok2 or cov >= 45e-2) then 'ambiguous' when ok then 'available' when cov >= 45e-2 or sel or idx then 'changed' else 'missing' end as status from r where k = 1)
    select l_partkey, status, case when status in ('available', 'changed') then id end as id from s""")
def best_match(spark, sf_dir):
    c, yes = F.col, F.lit(True)
    signature = F.when(c("l_tax") >= 0.02, c("l_tax") < 0.05)
    coverage, selected = c("l_quantity") % 10 / 10.0, c("l_quantity") % 3 / 2.0
    exact, selector, indexed = c("l_quantity") >= 45, c("l_returnflag") == "R", c("l_linenumber") == 1
    score = matching.match_score(yes, selector, c("l_linestatus") == "O", indexed, c("l_discount") < 0.05, signature, F.lit(None).cast("boolean"), exact, coverage, selected)
    found = table(spark, sf_dir, "lineitem").select(
        "l_partkey", (c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), score.alias("score"), selected.alias("selected"), coverage.alias("coverage"),
        selector.alias("selector"), indexed.alias("indexed"), exact.alias("exact"),
    )
    return matching.best_match(found, "l_partkey", "id")


def _headers(spark, sf_dir):
    """Each order's line states stand for a table's headers."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("h")).alias("s"))
    return lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["h"]).alias("headers"))


_HEADERS_SQL = "select l_orderkey, list(lower(l_returnflag || l_linestatus) order by l_linenumber, l_returnflag || ' ' || l_linestatus) as a from lineitem group by l_orderkey"


@register("j8_header_diff", f"""with t as (select l_orderkey, a, ['ro', 'no', 'af'] as e, range(greatest(3, len(a))) as p from ({_HEADERS_SQL})),
    d as (select *, list_filter(p, lambda i: e[i + 1] <> a[i + 1]) as m, list_filter(p, lambda i: e[i + 1] is not null and a[i + 1] is null) as m1, list_filter(p, lambda i: e[i + 1] is not null and not list_contains(a, e[i + 1])) as m2,
    list_filter(p, lambda i: a[i + 1] is not null and e[i + 1] is null) as a1, list_filter(p, lambda i: a[i + 1] is not null and not list_contains(e, a[i + 1])) as a2 from t)
    select l_orderkey, len(a) = 3 as same_length, a = e as same_sequence, cast(coalesce(m[1], -1) as integer) as first_mismatch, array_to_string(m, ',') as mismatches,
    array_to_string(list_transform(list_concat(m1, list_filter(m2, lambda i: not list_contains(m1, i))), lambda i: i || ':' || e[i + 1]), ',') as missing,
    array_to_string(list_transform(list_concat(a1, list_filter(a2, lambda i: not list_contains(a1, i))), lambda i: i || ':' || a[i + 1]), ',') as added from d""")
def header_diff(spark, sf_dir):
    pairs = _headers(spark, sf_dir).select("l_orderkey", F.array(F.lit("R O"), F.lit("n o"), F.lit("AF")).alias("expected"), F.col("headers").alias("actual"))
    found = matching.header_diff(pairs).drop("expected", "actual")
    return found.select("l_orderkey", "same_length", "same_sequence", "first_mismatch", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("mismatches", "missing", "added")))


@register("j6_resolve_columns", f"""with h as (select l_orderkey, unnest(a) as h, unnest(range(len(a))) as i from ({_HEADERS_SQL})),
    n as (select *, row_number() over (partition by l_orderkey, h order by i) as occurrence from h),
    s as (select o_orderkey as l_orderkey, 'R F' as name, 2 as occurrence from orders union all select o_orderkey, 'NO', 1 from orders)
    select s.l_orderkey, s.name, s.occurrence, cast(i as integer) as index from s left join n on n.l_orderkey = s.l_orderkey and n.h = lower(replace(s.name, ' ', '')) and n.occurrence = s.occurrence""")
def resolve_columns(spark, sf_dir):
    both = F.explode(F.array(F.struct(F.lit("R F").alias("name"), F.lit(2).alias("occurrence")), F.struct(F.lit("NO").alias("name"), F.lit(1).alias("occurrence"))))
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), both.alias("s")).select("l_orderkey", "s.*")
    return matching.resolve_columns(wanted, _headers(spark, sf_dir), "l_orderkey").select("l_orderkey", "name", "occurrence", "index")


_FRAMES_SQL = "select o_custkey, row_number() over (partition by o_custkey order by o_orderkey) as frame_id, o_orderpriority as url from orders"


@register("j13_frame_path", f"""with recursive n as (select *, frame_id // 2 as above, row_number() over (partition by o_custkey, frame_id // 2, url order by frame_id) - 1 as i from ({_FRAMES_SQL})),
    p as (select o_custkey, frame_id, url || '#' || i as path from n where above = 0 union all
    select n.o_custkey, n.frame_id, p.path || ' > ' || n.url || '#' || n.i from p join n on n.o_custkey = p.o_custkey and n.above = p.frame_id)
    select * from p""")
def frame_path(spark, sf_dir):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    frames = table(spark, sf_dir, "orders").select("o_custkey", k.alias("frame_id"), F.col("o_orderpriority").alias("url"))
    frames = frames.withColumn("parent_frame_id", F.floor(F.col("frame_id") / 2).cast("long"))
    return matching.frame_paths(frames, page="o_custkey")


@register("j14_select_frames", """with c as (select o_custkey, count(*) filter (o_orderstatus = 'P') as p, min(o_orderkey) filter (o_orderstatus = 'P') as fp,
    count(*) filter (o_orderpriority = '1-URGENT') as u, min(o_orderkey) filter (o_orderpriority = '1-URGENT') as fu from orders group by o_custkey)
    select c_custkey, case when p = 1 then 'match' when p > 1 then 'ambiguous' when u = 1 then 'fallback' when u > 1 then 'ambiguous' else 'missing' end as status,
    case when p = 1 then fp when coalesce(p, 0) = 0 and u = 1 then fu end as frame_id from customer left join c on o_custkey = c_custkey""")
def select_frames(spark, sf_dir):
    frames = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page_id"), F.col("o_orderkey").alias("frame_id"), F.col("o_orderstatus").alias("path"), F.col("o_orderpriority").alias("url"))
    sources = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("page_id"), F.lit("P").alias("path"), F.lit("1-URGENT").alias("url"))
    return matching.select_frames(sources, frames, "c_custkey")


_REASONS = ("complete", "last-page", "page-limit", "row-limit", "stopped", "page-timeout", "no-progress")


@register("f16_classify_completion", f"""with r as (select event_id, {list(_REASONS)}[event_id % 7 + 1] as reason from events)
    select event_id, case when reason in ('complete', 'last-page') then 'complete' when reason in ('page-limit', 'row-limit') then 'bounded-complete' when reason = 'stopped' then 'cancelled'
    when reason = 'page-timeout' then 'uncertain' else 'incomplete' end as completeness, reason in ('complete', 'last-page', 'page-limit', 'row-limit') as complete_for_request from r""")
def classify_completion(spark, sf_dir):
    reason = F.get(F.array(*(F.lit(r) for r in _REASONS)), (F.col("event_id") % 7).cast("int"))
    kind, complete = catalog.classify_completion(reason)
    return table(spark, sf_dir, "events").select("event_id", kind.alias("completeness"), complete.alias("complete_for_request"))


@register("w12_unique_names", """with p as (select p_partkey, p_brand || case when p_size % 5 = 0 then '（' || (p_size % 3) || '）' else '' end as name from part)
    select p_partkey, name || case when n = 0 then '' else '（' || (n + 1) || '）' end as unique_name from (select p_partkey, name, (select count(*) from p b where b.p_partkey < p.p_partkey and (b.name = p.name or starts_with(b.name, p.name || '（'))) as n from p)""")
def unique_names(spark, sf_dir):
    mark = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("（"), (F.col("p_size") % 3).cast("string"), F.lit("）"))).otherwise("")
    named = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", mark).alias("name"))
    return catalog.unique_names(named, "name", "p_partkey").select("p_partkey", "unique_name")


@register("j10_import_dedupe", """with i as (select p_partkey, p_brand || p_type || p_size as fp, p_size > 3 as ok from part), e as (select distinct p_brand || p_type || (p_size - 1) as fp from part where p_size > 40),
    f as (select *, row_number() over (partition by fp, ok order by p_partkey) as n from i)
    select p_partkey, case when not ok then 'failed' when n > 1 or fp in (select fp from e) then 'duplicate' else 'success' end as outcome from f""")
def import_dedupe(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    content = lambda size: F.concat("p_brand", "p_type", size.cast("string")).alias("fp")
    old = part.where("p_size > 40").select(content(F.col("p_size") - 1))
    new = part.select("p_partkey", "p_size", content(F.col("p_size")))
    return catalog.import_dedupe(new, old, "fp", "p_partkey", F.col("p_size") > 3).select("p_partkey", "outcome")


@register("so5_merge_names", """with n as (select o_custkey, max_by(o_orderpriority, o_orderkey) as name from orders group by o_custkey)
    select coalesce(c_custkey, o_custkey) as key, coalesce(n.name, c_mktsegment) as name from customer full join n on c_custkey = o_custkey""")
def merge_names(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("name"))
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("name"))
    return catalog.merge_names(old, new, "key", "name")


@register("j9_validate_results", """select o_custkey, cast(o_orderkey as varchar) as fingerprint, case when o_orderstatus = 'P' then 'missing' when o_orderpriority like '1%' then 'blank' else 'ok' end as status,
    case when o_orderstatus <> 'P' and o_orderpriority not like '1%' then o_orderpriority[:6] end as conclusion, o_orderstatus <> 'P' and o_orderpriority not like '1%' and length(o_orderpriority) > 6 as truncated,
    o_orderstatus <> 'P' and o_orderpriority not like '1%' and o_totalprice > 200000 as needs_attention from orders
    union all select o_custkey, cast(o_orderkey as varchar), 'duplicate', null, false, false from orders where o_orderstatus = 'O'
    union all select o_custkey, 'x', 'unknown', null, false, false from orders where o_orderstatus <> 'P' group by o_custkey""")
def validate_results(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("fingerprint", F.col("o_orderkey").cast("string"))
    said = F.when(F.col("o_orderpriority").startswith("1"), " ").otherwise(F.concat(F.lit(" "), "o_orderpriority"))
    result = F.struct("fingerprint", said.alias("conclusion"), (F.col("o_totalprice") > 200000).alias("needsAttention"))
    twice = orders.where("o_orderstatus <> 'P'").select("o_custkey", F.explode(F.when(F.col("o_orderstatus") == "O", F.array(result, result)).otherwise(F.array(result))).alias("r"))
    other = F.array(F.struct(F.lit("x").alias("fingerprint"), F.lit("?").alias("conclusion"), F.lit(False).alias("needsAttention")))
    results = F.to_json(F.struct(F.concat(F.collect_list("r"), other).alias("results")))
    answers = twice.groupBy("o_custkey").agg(F.concat(F.lit("```json\n"), results, F.lit("\n```")).alias("answer"))
    return catalog.validate_results(orders, answers, "o_custkey", "answer", max_chars=6)
