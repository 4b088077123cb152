"""Registered queries of the reference's operators over the given tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import render, rows
from . import binding_queries, catalog_queries, definition_queries, derive_queries, file_queries, fold_queries, match_queries, page_queries, prompt_queries, source_queries, status_queries, store_queries, stream_queries  # noqa: F401 (they register their queries)
from .registry import oracle_sql, queries, register as _register, table as _t  # noqa: F401


_TOKENS = (
    r"""(length(regexp_replace({0}, '[\x00-\x7F]', '', 'g')) + coalesce(list_sum(list_transform("""
    r"""regexp_extract_all({0}, '[\x00-\x7F]+'), lambda r: cast(ceil(length(r) / 4.0) as bigint))), 0))"""
)


@_register("ag3_history_tokens", f"select conv_id, cast(sum({_TOKENS.format('text')} + 4) + 2 as bigint) as tokens from conversations group by conv_id")
def history_tokens(spark, sf_dir):
    return rows.history_tokens(_t(spark, sf_dir, "conversations"), "conv_id")


@_register("sf14_estimate_tokens", f"select doc_id, cast({_TOKENS.format('text')} as bigint) as tokens from documents")
def estimate_tokens(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", tx.estimate_tokens(F.col("text")).alias("tokens"))


@_register(
    "ag2_message_stats",
    """select conv_id, count(*) as messages, cast(sum(length(coalesce(text, ''))) as bigint) as chars,
    count(*) filter (role = 'user') as n_user, count(*) filter (role = 'assistant') as n_assistant from conversations group by conv_id""",
)
def message_stats(spark, sf_dir):
    return rows.message_stats(_t(spark, sf_dir, "conversations"), "conv_id")


@_register("f3_sanitize_messages", "select * from conversations where role in ('system', 'user', 'assistant') and trim(coalesce(text, '')) <> ''")
def sanitize_messages(spark, sf_dir):
    return rows.sanitize_messages(_t(spark, sf_dir, "conversations"))


@_register("ag4_context_chars", "select source, cast(sum(length(text)) as bigint) as chars from documents group by source")
def context_chars(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.length("text")).alias("chars"))


@_register("w2_first_seen_dedupe", "select doc_id, source from documents qualify row_number() over (partition by source, text order by doc_id) = 1")
def first_seen_dedupe(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    # a text's digest stands for it, so only digests are shuffled
    small = docs.select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return rows.first_seen(small, ["source"], F.col("digest"), [F.col("doc_id")]).select("doc_id", "source")


@_register("w3_prefix_char_budget", """select conv_id, turn from (select conv_id, turn, sum(length(text) + 1) over
    (partition by conv_id order by turn rows unbounded preceding) as run from conversations) where run <= 1000""")
def prefix_char_budget(spark, sf_dir):
    return rows.prefix_within(_t(spark, sf_dir, "conversations"), ["conv_id"], F.length("text") + 1, [F.col("turn")], 1000).select("conv_id", "turn")


@_register("w4_prefix_token_batch", f"""select conv_id, turn from (select conv_id, turn, sum({_TOKENS.format('text')} + 8) over w as run,
    row_number() over w as k from conversations window w as (partition by conv_id order by turn rows unbounded preceding)) where (run <= 300 or k = 1) and k <= 20""")
def prefix_token_batch(spark, sf_dir):
    first = rows.top_rows(_t(spark, sf_dir, "conversations"), ["conv_id"], [F.col("turn")], 20)
    return rows.prefix_within(first, ["conv_id"], tx.estimate_tokens(F.col("text")) + 8, [F.col("turn")], 300, at_least=1).select("conv_id", "turn")


@_register("w5_header_occurrence", """select p_partkey, cast(row_number() over (partition by p_brand,
    lower(regexp_replace(p_type, '\\s+', '', 'g')) order by p_partkey) - 1 as integer) as occurrence from part""")
def header_occurrence(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    return rows.occurrence(part, ["p_brand"], tx.norm_header(F.col("p_type")), [F.col("p_partkey")]).select("p_partkey", "occurrence")


@_register("w7_sample_rows", "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) <= 2")
def sample_rows(spark, sf_dir):
    return rows.top_rows(_t(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey")


@_register("w9_prune_cache", "select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id) <= 20")
def prune_cache(spark, sf_dir):
    return rows.prune_newest(_t(spark, sf_dir, "events"), "user_id", "ts", "event_id", 20).select("user_id", "event_id")


@_register("w10_recent_rounds", """with a as (select *, case when role = 'user' or coalesce(lag(role) over (partition by conv_id order by turn), '') <> 'user' then 1 else 0 end as b
    from conversations where role in ('user', 'assistant')), r as (select *, sum(b) over (partition by conv_id order by turn) as n from a)
    select conv_id, turn from r qualify n > max(n) over (partition by conv_id) - 3""")
def recent_rounds(spark, sf_dir):
    return rows.recent_rounds(_t(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn")


@_register("w13_content_changed", "select event_id from events qualify event_type <> lag(event_type) over (partition by user_id order by ts, event_id)")
def content_changed(spark, sf_dir):
    return rows.content_changed(_t(spark, sf_dir, "events"), "user_id", [F.col("ts"), F.col("event_id")], "event_type").select("event_id")


@_register("w14_stable_point", """with a as (select *, coalesce(event_type = lag(event_type) over w, false) as same from events window w as (partition by user_id order by ts, event_id)),
    b as (select *, sum(case when same then 0 else 1 end) over (partition by user_id order by ts, event_id) as island from a),
    c as (select *, row_number() over (partition by user_id, island order by ts, event_id) - 1 as run from b)
    select user_id, event_id from c where run = 2 qualify row_number() over (partition by user_id order by ts, event_id) = 1""")
def stable_point(spark, sf_dir):
    return rows.stable_point(_t(spark, sf_dir, "events"), "user_id", [F.col("ts"), F.col("event_id")], "event_type", 2).select("user_id", "event_id")


_NOW = 1_000_000_000
_CACHE_SQL = f"""(select o_custkey as c_custkey, max_by(o_orderpriority, o_orderkey) as conclusion,
    {_NOW} - (max(o_orderkey) % 20000000) as created_at from orders group by o_custkey)"""


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers' last orders stand for cached conclusions."""
    last = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey"))
    return last.agg(F.max_by("o_orderpriority", "o_orderkey").alias("conclusion"), (F.lit(_NOW) - F.max("o_orderkey") % 20_000_000).alias("created_at"))


@_register("j2_cache_lookup", f"""select c_custkey, k.conclusion, k.conclusion is not null as hit from customer
    left join (select * from {_CACHE_SQL} where {_NOW} - created_at <= 7200000 and trim(conclusion) <> '') k using (c_custkey)""")
def cache_lookup(spark, sf_dir):
    return rows.cache_lookup(_t(spark, sf_dir, "customer"), _cache(spark, sf_dir), ["c_custkey"], _NOW).select("c_custkey", "conclusion", "hit")


@_register("j3_pending_rows", "select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def pending_rows(spark, sf_dir):
    return rows.pending_rows(_t(spark, sf_dir, "customer"), _cache(spark, sf_dir), ["c_custkey"]).select("c_custkey")


@_register("j5_submitted_rows", "select s_suppkey from supplier where s_suppkey in (select l_suppkey from lineitem where l_quantity >= 50)")
def submitted_rows(spark, sf_dir):
    sent = _t(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_suppkey").alias("s_suppkey"))
    return rows.submitted_rows(_t(spark, sf_dir, "supplier"), sent, ["s_suppkey"]).select("s_suppkey")


@_register("j4_fan_out_results", """select l_orderkey, l_linenumber, case when p_size > 10 then 'complete' when p_size is not null then 'error' else 'pending' end as status
    from lineitem left join (select * from part where p_size > 5) on l_partkey = p_partkey""")
def fan_out_results(spark, sf_dir):
    part = _t(spark, sf_dir, "part").where("p_size > 5")
    results = part.select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") > 10, F.col("p_type")).alias("conclusion"), F.when(F.col("p_size") <= 10, F.lit("failed")).alias("error"))
    return rows.fan_out(_t(spark, sf_dir, "lineitem"), results, "l_partkey").select("l_orderkey", "l_linenumber", "status")


@_register("so1_merge_queue", """with u as (select o_custkey as k, 0 as f, o_orderkey as pos from orders where o_orderstatus = 'O' union all
    select o_custkey, 1, o_orderkey from orders where o_orderstatus = 'F'),
    d as (select * from u where k not in (select c_custkey from customer where c_acctbal < 0) qualify row_number() over (partition by k order by f, pos) = 1)
    select k, pos from d order by f, pos, k limit 1000""")
def merge_queue(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("pos"), "o_orderstatus")
    pick = lambda s: orders.where(F.col("o_orderstatus") == s).drop("o_orderstatus")
    done = _t(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("k"))
    return rows.merge_queue(pick("O"), pick("F"), done, "k", "pos", 1000)


def _merged_sql(first: str) -> str:
    return f"""with u as (select o_custkey as k, case when o_orderstatus = '{first}' then 0 else 1 end as f, o_orderkey as pos, o_orderpriority as p from orders where o_orderstatus in ('O', 'F') and o_custkey % 7 > 0),
    d as (select k, min((f, pos)) as place, min_by(p, (f, pos)) as content, string_agg(pos || '/' || (pos + 1), '/' order by f, pos) as instances from u where k not in (select c_custkey from customer where c_acctbal < 0) group by k)
    select k, content, instances from d order by place, k limit 1000"""


def _merged(spark, sf_dir, queued_first: bool) -> DataFrame:
    pos = F.col("o_orderkey")
    orders = _t(spark, sf_dir, "orders").select(F.when(F.col("o_custkey") % 7 > 0, F.col("o_custkey")).alias("k"), pos.alias("pos"), F.col("o_orderpriority").alias("content"), F.array(pos, pos + 1).alias("instances"), "o_orderstatus")
    pick = lambda s: orders.where(F.col("o_orderstatus") == s).drop("o_orderstatus")
    done = _t(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("k"))
    found = rows.merge_instances(pick("O"), pick("F"), done, "k", "pos", "instances", 1000, queued_first)
    return found.select("k", "content", F.array_join(F.col("instances").cast("array<string>"), "/").alias("instances"))


@_register("so1_merge_queued_first", _merged_sql("O"))
def merge_queued_first(spark, sf_dir):
    """Rows that wait and rows of the window, with where they show; a limit is the queue's own."""
    return _merged(spark, sf_dir, True)


@_register("so1_merge_current_first", _merged_sql("F"))
def merge_current_first(spark, sf_dir):
    return _merged(spark, sf_dir, False)


@_register("ag3_part_tokens", f"""select conv_id, cast(sum(case turn % 3 when 0 then {_TOKENS.format("coalesce(text, '')")} when 1 then 2 * {_TOKENS.format("coalesce(text, '')")} + 1 else 0 end + 4) + 2 as bigint) as tokens from conversations group by conv_id""")
def part_tokens(spark, sf_dir):
    """Messages of one text, of three texts and an image, and of an image alone."""
    c = F.col
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    image, text = part("image_url", c("text")), part("text", c("text"))
    parts = F.when(c("turn") % 3 == 1, F.array(text, image, text, part("text", F.lit("abc")))).when(c("turn") % 3 == 2, F.array(image))
    return rows.history_tokens(_t(spark, sf_dir, "conversations").withColumn("parts", parts), "conv_id", parts="parts")


@_register("sf7_row_fingerprint", """select o_orderkey, 'sha256:' || sha256(o_orderstatus || chr(9247) || o_orderpriority || chr(9247) || cast(o_custkey as varchar)) as fingerprint from orders""")
def row_fingerprint(spark, sf_dir):
    cells = F.array("o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", tx.row_fingerprint(cells).alias("fingerprint"))


@_register("tx7_row_text", "select n_nationkey, n_name || ' ||| ' || '-' || ' ||| ' || cast(n_regionkey as varchar) as row_text from nation")
def row_text(spark, sf_dir):
    return _t(spark, sf_dir, "nation").select("n_nationkey", tx.row_text(F.array("n_name", F.lit(""), F.col("n_regionkey").cast("string"))).alias("row_text"))


@_register("sf20_page_key", """select page_id, lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1)) ||
    coalesce(nullif(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), ''), '/') as page_key from pages""")
def page_key(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", tx.page_key(F.col("url")).alias("page_key"))


@_register("sf15_context_budget", f"""select conv_id, cast(greatest(0, 8192 - 4096 - (sum({_TOKENS.format('text')} + 4) + 2) - 512) as bigint) as available from conversations group by conv_id""")
def context_budget(spark, sf_dir):
    used = rows.history_tokens(_t(spark, sf_dir, "conversations"), "conv_id")
    return used.select("conv_id", tx.context_budget(F.lit(8192), F.lit(4096), F.col("tokens")).cast("long").alias("available"))


@_register("ag7_coverage", """with h as (select l_orderkey, list_distinct(list(l_shipdate_m)) as have from (select l_orderkey, lower(l_returnflag || l_linestatus) as l_shipdate_m from lineitem) group by l_orderkey)
    select l_orderkey, len(list_intersect(['ro', 'no', 'af'], have)) / 3.0 as coverage from h""")
def coverage(spark, sf_dir):
    have = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat_ws(" ", "l_returnflag", "l_linestatus")).alias("have"))
    want = F.array(*(F.lit(x) for x in ("R O", "NO", "a F", "NO")))
    return have.select("l_orderkey", tx.coverage(want, F.col("have")).alias("coverage"))


@_register("job1_merge_collection", """with f as (select user_id, ts, event_id, event_type, props from events qualify row_number() over (partition by user_id, event_type, props order by ts, event_id) = 1)
    select user_id, event_id from f qualify row_number() over (partition by user_id order by ts, event_id) <= 50""")
def merge_collection(spark, sf_dir):
    signature = F.concat_ws(tx.UNIT_SEPARATOR, "event_type", F.coalesce("props", F.lit("")))
    return rows.merge_collection(_t(spark, sf_dir, "events"), "user_id", signature, [F.col("ts"), F.col("event_id")], 50).select("user_id", "event_id")


@_register("snk1_to_csv_text", """select n_regionkey, 'key,name' || chr(13) || chr(10) || string_agg(cast(n_nationkey as varchar) || ',' || n_name, chr(13) || chr(10) order by n_nationkey) as csv
    from nation group by n_regionkey""")
def to_csv_text(spark, sf_dir):
    cells = F.array(F.col("n_nationkey").cast("string"), "n_name")
    return render.to_csv_text(_t(spark, sf_dir, "nation"), "n_regionkey", ["n_nationkey"], cells, ["key", "name"])


@_register("snk2_to_markdown_text", """select o_custkey, '| order | priority |' || chr(10) || '| --- | --- |' || chr(10) ||
    string_agg('| ' || cast(o_orderkey as varchar) || ' | ' || o_orderpriority || ' |', chr(10) order by o_orderkey) as markdown from orders group by o_custkey""")
def to_markdown_text(spark, sf_dir):
    cells = F.array(F.col("o_orderkey").cast("string"), "o_orderpriority")
    return render.to_markdown_text(_t(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"], cells, ["order", "priority"])
