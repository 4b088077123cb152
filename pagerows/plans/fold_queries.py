"""Queries of the ordered folds and of table groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import folds
from .registry import register, table

TOKENS = (
    r"""(length(regexp_replace({0}, '[\x00-\x7F]', '', 'g')) + coalesce(list_sum(list_transform("""
    r"""regexp_extract_all({0}, '[\x00-\x7F]+'), lambda r: cast(ceil(length(r) / 4.0) as bigint))), 0))"""
)


@register("gs1_select_within_budget", f"""with recursive c as (select conv_id, turn, cost, row_number() over (partition by conv_id order by role <> 'system', turn desc) as k
    from (select conv_id, turn, role, {TOKENS.format("coalesce(text, '')")} + 24 as cost from conversations) where cost <= 200),
    f as (select conv_id, turn, k, true as taken, 200 - cost as free from c where k = 1 union all
    select c.conv_id, c.turn, c.k, c.cost <= f.free, f.free - case when c.cost <= f.free then c.cost else 0 end from f join c on c.conv_id = f.conv_id and c.k = f.k + 1)
    select conv_id, turn from f where taken""")
def select_within_budget(spark, sf_dir):
    said = table(spark, sf_dir, "conversations")
    taken = folds.select_within_budget(said, "conv_id", [F.desc("turn")], F.col("role") == "system", "text", 200, ["turn"])
    return taken.select("conv_id", "turn")


_DAY = 86_400_000


@register("w16_rate_guard", f"""with recursive c as (select user_id, event_id, epoch_ms(ts) as t, row_number() over (partition by user_id order by ts, event_id) as k from events),
    f as (select user_id, event_id, k, 'allowed' as outcome, [t] as stamps, cast(0 as bigint) as until from c where k = 1 union all
    select user_id, event_id, k, outcome, case when outcome = 'allowed' then list_append(live, t) else live end,
    case outcome when 'allowed' then 0 when 'cooldown' then until else greatest(t, live[1] + {_DAY}) end from
    (select *, case when until > t then 'cooldown' when len(live) >= 2 then 'limit' else 'allowed' end as outcome from
    (select c.user_id, c.event_id, c.k, c.t, f.until, list_filter(f.stamps, lambda x: c.t - x <= {_DAY}) as live from f join c on c.user_id = f.user_id and c.k = f.k + 1)))
    select user_id, event_id, outcome from f""")
def rate_guard(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    found = folds.rate_guard(events, "user_id", F.unix_millis(F.col("ts").cast("timestamp")), ["ts", "event_id"], _DAY, 2)
    return found.select("user_id", "event_id", "outcome")


def _contexts(spark, sf_dir) -> DataFrame:
    head = F.col("l_linenumber") == 1
    order = F.col("l_orderkey").cast("string")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("session"),
        F.when(head, "table-header").otherwise("table-row").alias("kind"),
        F.when(head, F.concat(F.lit("H"), order)).alias("ref"),
        F.when(head | (F.col("l_quantity") > 20), F.concat(F.lit("T"), (F.col("l_orderkey") % 5).cast("string"))).alias("table_id"),
        F.when(~head & (F.col("l_quantity") < 40), F.concat(F.lit("H"), (F.col("l_orderkey") % 50).cast("string"))).alias("header_ref"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.col("l_orderkey").alias("created_at"),
    )


_CONTEXTS_SQL = """x as (select l_suppkey as session, l_linenumber = 1 as head, 'H' || l_orderkey as ref,
    case when l_linenumber = 1 or l_quantity > 20 then 'T' || (l_orderkey % 5) end as table_id,
    case when l_linenumber <> 1 and l_quantity < 40 then 'H' || (l_orderkey % 50) end as header_ref, l_orderkey * 10 + l_linenumber as seq, l_orderkey as created_at from lineitem),
    g as (select x.*, case when not x.head and h.table_id is not null then 'TG:' || h.table_id when x.table_id is not null then 'TG:' || x.table_id else 'TG:header:' || x.header_ref end as group_id
    from x left join (select session, ref, max_by(table_id, seq) as table_id from x where head group by session, ref) h on h.session = x.session and h.ref = x.header_ref)"""


@register("j1_assign_groups", f"with {_CONTEXTS_SQL} select session, seq, group_id from g")
def assign_groups(spark, sf_dir):
    return folds.assign_groups(_contexts(spark, sf_dir)).select("session", "seq", "group_id")


@register("w1_number_tables", f"""with {_CONTEXTS_SQL} select session, group_id, min(created_at) as added_at, max(seq) as oldest, count(*) filter (not head) as rows,
    row_number() over (partition by session order by min(created_at), max(seq) desc, group_id) as table_number from g group by session, group_id""")
def number_tables(spark, sf_dir):
    return folds.number_tables(folds.assign_groups(_contexts(spark, sf_dir)))
