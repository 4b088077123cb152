"""Queries of collections and readiness, and of rules that other queries use in passing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import folds, matching, render, rows, status, store
from .fold_queries import _contexts, _CONTEXTS_SQL
from .registry import register, table
from .status_queries import _sources, _SOURCES_SQL


@register("st11_stale_results", """select o_orderkey, o_orderpriority = (select max_by(b.o_orderpriority, b.o_orderkey) from orders b where b.o_custkey = a.o_custkey and b.o_orderkey % 3 = 0) and (select count(*) from orders b where b.o_custkey = a.o_custkey and b.o_orderkey % 3 = 0) > 0 as shown from orders a""".replace("select o_orderkey, o_orderpriority", "select o_orderkey, coalesce(o_orderpriority").replace("% 3 = 0) and (select", "% 3 = 0), false) and (select"))
def stale_results(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("analysis_fp"), F.col("o_orderkey").alias("session_seq"))
    return store.stale_results(orders, orders.where("o_orderkey % 3 = 0"), "o_custkey").select("o_orderkey", "shown")


_POLLS_SQL = """p as (select user_id, event_id, row_number() over w as k, (row_number() over w - 1) * 900 as elapsed, case when value > 150 then 0 else 3 + event_id // 400 % 2 end as rows, event_id // 300 as content, event_id % 23 = 0 as loading from events window w as (partition by user_id order by event_id))"""


def _polls(spark, sf_dir) -> DataFrame:
    n = F.col("event_id")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf_dir, "events").select(
        "user_id", "event_id", ((k - 1) * 900).alias("elapsed"), F.when(F.col("value") > 150, 0).otherwise(3 + F.floor(n / 400) % 2).alias("rows"), F.floor(n / 300).cast("string").alias("content"), (n % 23 == 0).alias("loading")
    )


@register("w14_readiness", f"""with {_POLLS_SQL}, s as (select *, coalesce(not loading and rows > 0 and rows = lag(rows) over w and content = lag(content) over w, false) as same from p window w as (partition by user_id order by event_id)),
    i as (select *, sum(case when same then 0 else 1 end) over (partition by user_id order by event_id) as island from s), n as (select *, sum(case when same then 1 else 0 end) over (partition by user_id, island order by event_id) as run from i),
    e as (select *, same and run >= 3 and elapsed >= 2000 as ready from n) select user_id, event_id, rows, not ready as timed_out from e where ready or elapsed >= 12000 qualify row_number() over (partition by user_id order by event_id) = 1""")
def readiness(spark, sf_dir):
    return store.readiness(_polls(spark, sf_dir), "user_id", ["event_id"], "rows", "content", "loading", "elapsed")


@register("st9_header_settle", """with s as (select *, event_type = lag(event_type) over w and event_type = lag(event_type, 2) over w as hit from events window w as (partition by user_id order by event_id)) select user_id, min(event_id) as event_id from s where hit group by user_id""")
def header_settle(spark, sf_dir):
    """Headers count as changed once three signatures in a row are equal."""
    events = table(spark, sf_dir, "events")
    return rows.stable_point(events, "user_id", [F.col("event_id")], "event_type", 2).select("user_id", "event_id")


_COLLECT_SQL = """s as (select user_id, event_id, 1 + row_number() over (partition by user_id order by event_id) // 4 as page, event_type || '␟' || cast(floor(value) as integer) % 6 as sig from events),
    g as (select user_id, page, max(event_id) as last from s group by user_id, page),
    f as (select * from s where page <= 8 qualify row_number() over (partition by user_id, sig order by page, event_id) = 1),
    n as (select g.user_id, g.page, g.last, sum(coalesce((select count(*) from f where f.user_id = g.user_id and f.page = g.page), 0)) over (partition by g.user_id order by g.page) as seen from g where g.page <= 8),
    r as (select *, case when last % 41 = 0 then 'stopped' when seen >= 12 then 'row-limit' when page >= 8 then 'page-limit' when last % 29 = 0 then 'last-page' when last % 31 = 0 then 'page-timeout' when last % 37 = 0 then 'next-click-failed' end as reason from n),
    e as (select user_id, min_by(reason, page) filter (reason is not null) as reason, min(page) filter (reason is not null) as ended, min_by(seen, page) filter (reason is not null) as at_end, max(page) as pages, max(seen) as seen from r group by user_id),
    z as (select user_id, coalesce(reason, 'no-progress') as reason, coalesce(ended, pages) as pages, least(12, coalesce(at_end, seen)) as rows from e)"""


def _collect_input(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    n = F.col("event_id")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    shots = table(spark, sf_dir, "events").select("user_id", "event_id", (1 + F.floor(k / 4)).alias("page"), F.concat_ws(tx.UNIT_SEPARATOR, "event_type", (F.floor("value").cast("int") % 6).cast("string")).alias("sig"))
    last = shots.groupBy("user_id", "page").agg(F.max("event_id").alias("event_id"))
    outcome = F.when(n % 31 == 0, "page-timeout").when(n % 37 == 0, "next-click-failed")
    pages = last.select("user_id", "event_id", "page", (n % 41 == 0).alias("stopped"), (n % 29 == 0).alias("is_last"), outcome.alias("outcome"))
    return shots, pages


def _collected(spark, sf_dir):
    shots, pages = _collect_input(spark, sf_dir)
    return store.collect(shots, pages.drop("event_id"), "user_id", F.col("sig"), [F.col("page"), F.col("event_id")], max_rows=12, max_pages=8)


@register("job1_collection_ends", f"with {_COLLECT_SQL} select user_id, reason, pages, rows, reason in ('row-limit', 'page-limit') as truncated from z")
def collection_ends(spark, sf_dir):
    return _collected(spark, sf_dir)[1]


@register("job1_collection_rows", f"with {_COLLECT_SQL} select f.user_id, f.event_id from f join z on z.user_id = f.user_id and f.page <= z.pages qualify row_number() over (partition by f.user_id order by f.page, f.event_id) <= 12")
def collection_rows(spark, sf_dir):
    return _collected(spark, sf_dir)[0].select("user_id", "event_id")


_LONG_SQL = """m as (select user_id, event_id, case when event_id % 3 = 0 then 'user' when event_id % 7 = 0 then 'system' else 'assistant' end as role, case when event_id % 17 = 0 then '请求失败：x' when event_id % 19 = 0 then ' ' else repeat('x', cast(user_id % 3 * 2500 as integer) + 1) end as t, event_id % 23 = 0 as local from events),
    s as (select * from m where trim(t) <> '' and not starts_with(t, '请求失败：') and not local), b as (select *, case when role = 'user' or role = 'assistant' and coalesce(lag(role) over (partition by user_id order by event_id), '') <> 'user' then 1 else 0 end as b from s),
    r as (select *, sum(b) over (partition by user_id order by event_id) as n from (select * from b where role <> 'system')), z as (select *, max(n) over (partition by user_id) as last from r),
    y as (select *, sum(case when n > last - 3 then length(t) else 0 end) over (partition by user_id) as chars from z)"""


@register("w10_recent_rounds_long", f"with {_LONG_SQL} select user_id, event_id from y where n > last - case when last >= 5 and chars < 15000 then 5 else 3 end")
def recent_rounds_long(spark, sf_dir):
    n = F.col("event_id")
    said = table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.when(n % 3 == 0, "user").when(n % 7 == 0, "system").otherwise("assistant").alias("role"), (n % 23 == 0).alias("local"),
        F.when(n % 17 == 0, "请求失败：x").when(n % 19 == 0, " ").otherwise(F.repeat(F.lit("x"), (F.col("user_id") % 3 * 2500 + 1).cast("int"))).alias("text"),
    )
    return rows.recent_rounds(said, "user_id", "event_id", local="local").select("user_id", "event_id")


@register("ag2_message_images", """select conv_id, count(*) as messages, cast(sum(length(coalesce(text, ''))) as bigint) as chars, count(*) filter (role = 'system') as n_system, count(*) filter (role = 'user') as n_user, count(*) filter (role = 'assistant') as n_assistant, cast(sum(turn % 3) as bigint) as images from conversations group by conv_id""")
def message_images(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").withColumn("n", F.col("turn") % 3)
    return rows.message_stats(said, "conv_id", images="n")


@register("f3_image_messages", "select conv_id, turn from conversations where turn % 4 <> 3 and (turn % 3 > 0 or turn % 5 > 0 and trim(coalesce(text, '')) <> '')")
def image_messages(spark, sf_dir):
    role, text = F.when(F.col("turn") % 4 == 3, "tool").otherwise("user"), F.when(F.col("turn") % 5 > 0, F.col("text"))
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("turn") % 3).alias("images"))
    return rows.sanitize_messages(said, images="images").select("conv_id", "turn")


@register("j3_pending_contents", "select l_orderkey, l_linenumber from lineitem where l_partkey % 40 not in (select p_size from part)")
def pending_contents(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 40).alias("fp"))
    return rows.pending_rows(lines, table(spark, sf_dir, "part").where("p_size < 1000").select(F.col("p_size").cast("long").alias("fp")), ["fp"]).select("l_orderkey", "l_linenumber")


@register("tx7_order_text", "select o_orderkey, o_orderstatus || ' ||| ' || case when o_custkey % 2 = 0 then '-' else o_orderpriority end || ' ||| ' || o_custkey as row_text from orders")
def order_text(spark, sf_dir):
    cells = F.array("o_orderstatus", F.when(F.col("o_custkey") % 2 == 0, "").otherwise(F.col("o_orderpriority")), F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.row_text(cells).alias("row_text"))


@register("snk1_quoted_csv", """select o_custkey, string_agg(o_orderkey || ',"a ""' || o_orderstatus || '"", b",' || case when o_orderkey % 3 = 0 then '"x' || chr(10) || 'y"' else o_orderpriority end, chr(13) || chr(10) order by o_orderkey) as csv from orders group by o_custkey""".replace("select o_custkey, string_agg", "select o_custkey, '列1,列2,列3' || chr(13) || chr(10) || string_agg"))
def quoted_csv(spark, sf_dir):
    cells = F.array(F.col("o_orderkey").cast("string"), F.concat(F.lit('a "'), "o_orderstatus", F.lit('", b')), F.when(F.col("o_orderkey") % 3 == 0, "x\ny").otherwise(F.col("o_orderpriority")))
    return render.to_csv_text(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"], cells, None)


@register("snk2_ragged_markdown", """with w as (select o_custkey, max(2 + o_orderkey % 3) as w from orders group by o_custkey), r as (select o_custkey, o_orderkey, '| ' || array_to_string(list_resize(list_slice([cast(o_orderkey as varchar), 'a\\|b', '', 'z'], 1, 2 + o_orderkey % 3), w, ''), ' | ') || ' |' as line, w from orders join w using (o_custkey))
    select o_custkey, '| ' || array_to_string(list_resize(['k', 'v'], any_value(w), ''), ' | ') || ' |' || chr(10) || '| ' || array_to_string(list_resize(['---'], any_value(w), '---'), ' | ') || ' |' || chr(10) || string_agg(line, chr(10) order by o_orderkey) as markdown from r group by o_custkey""")
def ragged_markdown(spark, sf_dir):
    cells = F.slice(F.array(F.col("o_orderkey").cast("string"), F.lit("a|b"), F.lit(None).cast("string"), F.lit("z")), F.lit(1), (2 + F.col("o_orderkey") % 3).cast("int"))
    return render.to_markdown_text(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"], cells, ["k", "v"])


@register("ag1_table_groups", f"with {_CONTEXTS_SQL} select session, group_id, min(created_at) as added_at, max(seq) as oldest, count(*) filter (not head) as rows from g group by session, group_id")
def table_groups(spark, sf_dir):
    return folds.number_tables(folds.assign_groups(_contexts(spark, sf_dir))).drop("table_number")


@register("ag15_source_row_totals", f"with {_SOURCES_SQL} select o_custkey, count(row_count) as loaded, cast(coalesce(sum(row_count), 0) as bigint) as total_rows from s group by o_custkey")
def source_row_totals(spark, sf_dir):
    return status.all_sources_ready(_sources(spark, sf_dir), "o_custkey").drop("ready")


@register("ag8_match_score", """select l_orderkey, l_linenumber, 3e-2 + case when l_returnflag = 'R' then case when l_linestatus = 'O' then 22e-2 else 8e-2 end else 0e0 end + case when l_linenumber = 1 then 3e-2 else 0e0 end + case when l_discount < 0.05 then 8e-2 else -12e-2 end
    + case when l_tax < 0.02 then 0e0 when l_tax < 0.05 then 18e-2 else -12e-2 end + 0e0 + case when l_quantity >= 45 then 35e-2 else 0e0 end + (l_quantity % 10) / 1e1 * 28e-2 + (l_quantity % 3) / 2e0 * 30e-2 as score from lineitem""")
def match_score(spark, sf_dir):
    c = F.col
    signature = F.when(c("l_tax") >= 0.02, c("l_tax") < 0.05)
    score = matching.match_score(F.lit(True), c("l_returnflag") == "R", c("l_linestatus") == "O", c("l_linenumber") == 1, c("l_discount") < 0.05, signature, F.lit(None).cast("boolean"), c("l_quantity") >= 45, c("l_quantity") % 10 / 10.0, c("l_quantity") % 3 / 2.0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", score.alias("score"))


@register("w6_sibling_index", "select l_orderkey, l_linenumber, l_suppkey, cast(row_number() over (partition by l_orderkey, l_returnflag order by l_linenumber, l_suppkey) - 1 as integer) as occurrence from lineitem")
def sibling_index(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    return rows.occurrence(lines, ["l_orderkey"], F.col("l_returnflag"), [F.col("l_linenumber"), F.col("l_suppkey")]).drop("l_returnflag")


@register("so3_distinct_fingerprints", "select distinct l_orderkey, 'sha256:' || sha256(l_returnflag || '␟' || l_linestatus) as fingerprint from lineitem")
def distinct_fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", tx.row_fingerprint(F.array("l_returnflag", "l_linestatus")).alias("fingerprint")).distinct()


@register("so4_header_sets", """with h as (select l_orderkey, list_distinct(list(lower(l_returnflag || l_linestatus))) as h from lineitem group by l_orderkey)
    select l_orderkey, array_to_string(list_sort(list_filter(h, lambda x: x in ('ro', 'no'))), ',') as held, array_to_string(list_sort(list_filter(h, lambda x: x not in ('ro', 'no'))), ',') as added, array_to_string(list_filter(['no', 'ro'], lambda x: not list_contains(h, x)), ',') as missing from h""")
def header_sets(spark, sf_dir):
    have = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(tx.norm_header(F.concat_ws(" ", "l_returnflag", "l_linestatus"))).alias("h"))
    want = F.array(F.lit("no"), F.lit("ro"))
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return have.select("l_orderkey", text(F.array_intersect("h", want)).alias("held"), text(F.array_except("h", want)).alias("added"), text(F.array_except(want, "h")).alias("missing"))


@register("sf1_business_text", "select o_orderkey, 'a ' || o_orderpriority || ' b' as text from orders")
def business_text(spark, sf_dir):
    said = F.concat(F.lit("\n​a  "), "o_orderpriority", F.lit("\r\n\t b﻿ "))
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.business_text(said).alias("text"))


@register("sf19_strip_json_fence", """select o_orderkey, case when o_orderkey % 3 = 2 then 'so: ```json {"k":1}```' else '{"k":' || o_custkey || '}' end as json from orders""")
def strip_json_fence(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    bare = F.concat(F.lit('{"k":'), F.col("o_custkey").cast("string"), F.lit("}"))
    said = F.when(k == 0, F.concat(F.lit(" \n"), bare, F.lit(" "))).when(k == 1, F.concat(F.lit(" ```JSON\n"), bare, F.lit("\n``` \n"))).otherwise('so: ```json {"k":1}```')
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.strip_json_fence(said).alias("json"))


@register("sf27_delta_text", """select o_orderkey, case o_orderkey % 5 when 0 then o_orderpriority when 1 then 'm"' || o_orderstatus when 2 then 't' else '' end as content, case o_orderkey % 5 when 0 then 'why' when 3 then o_orderstatus else '' end as reasoning from orders""")
def delta_text(spark, sf_dir):
    c = F.col
    k = c("o_orderkey") % 5
    lit = F.lit
    event = (
        F.when(k == 0, F.to_json(F.struct(F.array(F.struct(F.struct(c("o_orderpriority").alias("content"), lit("why").alias("reasoning_content")).alias("delta"))).alias("choices"))))
        .when(k == 1, F.to_json(F.struct(F.array(F.struct(F.struct(F.concat(lit('m"'), "o_orderstatus").alias("content")).alias("message"))).alias("choices"))))
        .when(k == 2, lit('{"choices":[{"text":"t"}]}')).when(k == 3, F.to_json(F.struct(F.array(F.struct(F.struct(c("o_orderstatus").alias("reasoning")).alias("delta"))).alias("choices")))).otherwise("{oops")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.delta_text(event).alias("content"), tx.reasoning_text(event).alias("reasoning"))


@register("sf28_result_clean", """select o_orderkey, o_orderpriority[:5] as conclusion, length(o_orderpriority) > 5 as truncated, o_orderkey % 3 = 0 as needs_attention from orders""")
def result_clean(spark, sf_dir):
    attention = F.when(F.col("o_orderkey") % 3 == 0, True).when(F.col("o_orderkey") % 3 == 1, False)
    found = tx.result_clean(F.concat(F.lit("\n "), "o_orderpriority", F.lit(" ")), F.lit(5), attention)
    return table(spark, sf_dir, "orders").select("o_orderkey", found.alias("r")).select("o_orderkey", "r.*")


@register("l2_row_limits", "select l_suppkey, l_orderkey, l_linenumber from lineitem qualify row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) <= 200")
def row_limits(spark, sf_dir):
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")]
    return rows.top_rows(table(spark, sf_dir, "lineitem"), ["l_suppkey"], order, 200).select("l_suppkey", "l_orderkey", "l_linenumber")
