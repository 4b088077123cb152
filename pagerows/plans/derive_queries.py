"""Queries of derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import derive
from .registry import register, spread_table, table

_NOW = 1_000_000_000


def _selection(*columns: tuple[str, int]):
    return F.array(*(F.struct(F.lit(h).alias("header"), F.lit(n).alias("occurrence")) for h, n in columns))


def _orders(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each order priority is a table of orders; two analyses on each, one of which lacks a column of the table 5-LOW."""
    orders = spread_table(spark, sf_dir, "orders", "o_orderpriority", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    c = F.col
    band = F.floor(c("o_totalprice") / 50_000).cast("string")
    day = F.dayofweek(c("o_orderdate")).cast("string")
    rows = orders.select(c("o_orderpriority").alias("table"), c("o_orderkey").alias("row_pos"), F.array(c("o_orderkey").cast("string"), "o_orderstatus", band, day).alias("cells"))
    names = table(spark, sf_dir, "orders").select(c("o_orderpriority").alias("table")).distinct()
    heads = F.array(F.lit("Key"), F.lit("Status"), F.lit("Price  band"), F.when(c("table") == "5-LOW", "day").otherwise("STA TUS"))
    tables = names.select("table", heads.alias("headers"))
    kinds = F.array(
        F.struct(F.lit("a").alias("k"), _selection(("Status", 1), ("Price  band", 1)).alias("selected"), F.lit(" ").alias("method"), F.lit(12).alias("max_chars"), F.lit("before-first-selected-column").alias("position")),
        F.struct(F.lit("b").alias("k"), _selection((" status", 2), ("STATUS", 2), ("", 1), ("Key", 0)).alias("selected"), F.lit("look").alias("method"), F.lit(1000).alias("max_chars"), F.lit("after-last-selected-column").alias("position")),
    )
    each = names.select("table", F.explode(kinds).alias("d")).select("table", "d.*")
    definitions = each.select(
        F.concat("k", F.lit("@"), "table").alias("analysis"), "table", "selected", "method", "max_chars", F.lit("结论").alias("column_name"), "position", F.lit(-1).alias("position_index")
    )
    return definitions, tables, rows


def rule_scorer(asked: DataFrame) -> DataFrame:
    """A scorer by rule: how long a content is. It leaves out some contents at first, and some it only gives blanks."""
    last = lambda r: F.right(r["fingerprint"], F.lit(1))
    said = F.filter("rows", lambda r: (F.col("attempt") > 0) | ~last(r).isin("0", "1", "2", "3"))
    result = F.transform(
        said,
        lambda r: F.struct(
            r["fingerprint"].alias("fingerprint"), F.when(last(r).isin("2", "3"), " ").otherwise(F.concat(F.lit("length "), F.length(r["content"]).cast("string"), F.lit(" "), last(r))).alias("conclusion"),
            (F.length(r["content"]) > 60).alias("needsAttention"),
        ),
    )
    return asked.select("batch", F.concat(F.lit("```json\n"), F.to_json(F.struct(result.alias("results"))), F.lit("\n```")).alias("answer"))


def _cache(spark, sf_dir) -> DataFrame:
    """Orders of status P that stand in analysis a of their table as cached, some too long ago."""
    band = F.floor(F.col("o_totalprice") / 50_000)
    kept = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return kept.select(
        F.concat(F.lit("a@"), "o_orderpriority").alias("analysis"), tx.row_fingerprint(F.array("o_orderstatus", band.cast("string"))).alias("fingerprint"),
        F.concat(F.lit("cached "), band.cast("string")).alias("conclusion"), (F.lit(_NOW) - band * 1_000_000).alias("created_at"),
    ).distinct()


_CELLS = """o as (select o_orderpriority as t, o_orderkey as k, o_orderstatus as s, cast(cast(floor(o_totalprice / 50000) as bigint) as varchar) as p, cast(dayofweek(o_orderdate) + 1 as varchar) as d from orders),
    v as (select 'a@' || t as analysis, k, [cast(k as varchar), s, p, d] as cells, 'sha256:' || sha256(s || '␟' || p) as fp, '| 字段 | 值 |' || chr(10) || '| --- | --- |' || chr(10) || '| Status | ' || s || ' |' || chr(10) || '| Price band | ' || p || ' |' as content,
      1 as put, case when s = 'P' and cast(p as bigint) <= 7 then 'cached ' || p end as hit, 12 as most from o
    union all select 'b@' || t, k, [cast(k as varchar), s, p, d], case when t <> '5-LOW' then 'sha256:' || sha256(d || '␟' || k) end,
      '| 字段 | 值 |' || chr(10) || '| --- | --- |' || chr(10) || '| status | ' || d || ' |' || chr(10) || '| Key | ' || k || ' |', 4, null, 1000 from o),
    r as (select *, case when fp is null then null when hit is not null then hit when fp[-1:] not in ('2', '3') then ('length ' || length(content) || ' ' || fp[-1:])[:most] end as conclusion from v)"""


@register("job2_derive_column", f"""with {_CELLS} select analysis, k as row_pos, fp as fingerprint, conclusion, case when fp is null then 'missing-column' when conclusion is null then 'error' else 'complete' end as status,
    array_to_string(list_concat(list_concat(list_slice(cells, 1, put), [coalesce(conclusion, '')]), list_slice(cells, put + 1, 4)), '/') as cells from r where fp is not null
    union all select analysis, k, null, null, 'missing-column', array_to_string([cells[1], '', cells[2], cells[3], cells[4]], '/') from r where fp is null""")
def derive_column(spark, sf_dir):
    found, _ = derive.derive_column(*_orders(spark, sf_dir), _cache(spark, sf_dir), rule_scorer, _NOW)
    # where a column is missing, the empty cell still goes after the last one that is there
    return found.select("analysis", "row_pos", "fingerprint", "conclusion", "status", F.array_join("cells", "/").alias("cells"))


@register("job2_new_entries", f"with {_CELLS} select distinct analysis, fp as fingerprint, conclusion, length(content) > 60 as needs_attention, cast({_NOW} as bigint) as created_at from r where hit is null and conclusion is not null")
def new_entries(spark, sf_dir):
    return derive.derive_column(*_orders(spark, sf_dir), _cache(spark, sf_dir), rule_scorer, _NOW)[1]


@register("job2_analysis_status", f"""with {_CELLS}, n as (select analysis, count(*) filter (conclusion is not null) as n_complete, count(*) as n_rows from r group by analysis)
    select *, case when n_complete = n_rows then 'complete' when n_complete > 0 then 'partial' else 'error' end as status from n""")
def analysis_status(spark, sf_dir):
    return derive.analysis_status(derive.derive_column(*_orders(spark, sf_dir), _cache(spark, sf_dir), rule_scorer, _NOW)[0])


@register("job2b_preview_derive", f"""with {_CELLS}, f as (select * from r where fp is not null qualify row_number() over (partition by analysis order by k) <= 1000),
    u as (select analysis, fp from f group by analysis, fp qualify row_number() over (partition by analysis order by min(k)) <= 20)
    select analysis, k as row_pos, case when fp[-1:] not in ('2', '3') then ('length ' || length(content) || ' ' || fp[-1:])[:most] end as conclusion from f semi join u using (analysis, fp)""")
def preview_derive(spark, sf_dir):
    ready = derive.contents(*_orders(spark, sf_dir)).where(~F.col("missing"))
    shown = derive.preview_rows(ready)
    described = derive.effective_method(F.col("method"), F.lit(1))["description"]
    unique = shown.groupBy("analysis", "fingerprint").agg(F.min("row_pos").alias("first"), F.first("content").alias("content"), F.first(described).alias("method"), F.first("max_chars").alias("max_chars"))
    asked = unique.withColumn("budget", F.lit(50_000)).withColumn("most", F.lit(20))
    first = derive.score_rows(asked, rule_scorer, 0, shards=1)
    good = first.where("status = 'ok'")
    again = derive.score_rows(derive.retry_set(asked, good, ["analysis", "fingerprint"]), rule_scorer, 1, shards=1).where("status = 'ok'")
    results = good.unionByName(again).select("analysis", "fingerprint", "conclusion")
    return shown.join(results, ["analysis", "fingerprint"], "left").select("analysis", "row_pos", "conclusion")


@register("so2_retry_set", """select user_id, event_id from events where event_id % 3 < 2 and event_type not in (select e.event_type from events e where e.user_id = events.user_id and e.value > 99)""")
def retry_set(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    done = events.where("value > 99").select("user_id", "event_type")
    return derive.retry_set(events, done, ["user_id", "event_type"], F.col("event_id") % 3, most=2).select("user_id", "event_id")


@register("l4_distinct_selections", """with h as (select l_orderkey, l_linenumber as n, l_returnflag || l_linestatus as flag, l_suppkey % 4 as o from lineitem),
    k as (select l_orderkey, lower(flag) as name, case when o > 0 then o else 1 end as occurrence, min((n, flag, o)) as first from h group by all),
    t as (select * from k qualify row_number() over (partition by l_orderkey order by first) <= 10)
    select l_orderkey, string_agg(name || '#' || occurrence, ',' order by first) as selected from t group by l_orderkey""")
def distinct_selections(spark, sf_dir):
    line = F.struct("l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("flag"), (F.col("l_suppkey") % 4).alias("o"))
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    wide = F.transform("lines", lambda s: F.struct(F.concat(F.left(s["flag"], F.lit(1)), F.lit(" "), F.right(s["flag"], F.lit(1))).alias("header"), s["o"].alias("occurrence")))
    both = F.concat(F.array(F.struct(F.lit(" ").alias("header"), F.lit(1).cast("bigint").alias("occurrence"))), wide)
    named = F.transform(derive.distinct_selections(both), lambda s: F.concat(s["name"], F.lit("#"), s["occurrence"].cast("string")))
    return lists.select("l_orderkey", F.array_join(named, ",").alias("selected"))


@register("f17_effective_method", f"""select o_orderkey, case when o_orderkey % 3 = 0 then '{derive.DEFAULT_METHOD}' else 'look at ' || o_orderpriority end as description,
    case when o_orderkey % 3 = 0 then cast(greatest(1, o_custkey % 5) as integer) end as version, o_orderkey % 3 = 0 as used_default from orders""")
def effective_method(spark, sf_dir):
    said = F.when(F.col("o_orderkey") % 3 == 0, F.when(F.col("o_orderkey") % 2 == 0, " \n")).otherwise(F.concat(F.lit("\tlook at "), "o_orderpriority", F.lit(" ")))
    return table(spark, sf_dir, "orders").select("o_orderkey", derive.effective_method(said, (F.col("o_custkey") % 5).cast("int")).alias("m")).select("o_orderkey", "m.*")


@register("sf8_analysis_fingerprint", """select o_orderkey, 'sha256:' || sha256('{"analysisMethod":"' || case when o_orderkey % 2 = 0 then 'a \\"b\\" ' || o_orderstatus else '' end || '","defaultMethodVersion":' || case when o_orderkey % 2 = 0 then 'null' else '1' end ||
    ',"modelId":"m' || o_custkey || '","output":{"columnName":"结论","maxChars":' || greatest(1, o_orderkey % 50) || ',"position":"at-column"},"resultSchemaVersion":1,"selectedColumns":[{"normalizedHeader":"' || lower(o_orderpriority[:3]) ||
    '","occurrence":2}],"skillId":"' || o_orderkey || '","skillRevision":' || o_custkey || ',"sourceId":"s"}') as fingerprint from orders""")
def analysis_fingerprint(spark, sf_dir):
    c = F.col
    method = F.when(c("o_orderkey") % 2 == 0, F.concat(F.lit('a "b" '), "o_orderstatus", F.lit(" "))).otherwise(F.lit("​ "))
    selected = derive.distinct_selections(F.array(F.struct(F.left("o_orderpriority", F.lit(3)).alias("header"), F.lit(2).alias("occurrence"))))
    fp = derive.analysis_fingerprint(
        c("o_orderkey").cast("string"), c("o_custkey"), F.lit(" s "), selected, method, F.lit(None).cast("int"), F.concat(F.lit("m"), c("o_custkey").cast("string")), F.lit(0), c("o_orderkey") % 50, F.lit("结论 "), F.lit("at-column")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", fp.alias("fingerprint"))


_TOKENS = """(length(regexp_replace({0}, '[\\x00-\\x7F]', '', 'g')) + coalesce(list_sum(list_transform(regexp_extract_all({0}, '[\\x00-\\x7F]+'), lambda r: cast(ceil(length(r) / 4.0) as bigint))), 0))"""


@register("w4_batch_budget", f"""with a as (select conv_id, turn, greatest(0, greatest(8192, 1000 * (conv_id % 90)) - greatest(512, conv_id * 37 % 5000) - (6 + {_TOKENS.format("coalesce(text, '')")}) - 512) as free,
    greatest(512, conv_id * 37 % 5000) as out, greatest(40, least(160, turn * 30)) as chars from conversations)
    select conv_id, turn, cast(greatest(2000, floor(free * 9e-1)) as bigint) as tokens, cast(least(20, greatest(1, floor((out - 20) / (35 + chars)))) as integer) as most_rows from a""")
def batch_budget(spark, sf_dir):
    said = table(spark, sf_dir, "conversations")
    tokens, rows = derive.batch_budget(F.col("text"), 1000 * (F.col("conv_id") % 90), F.col("conv_id") * 37 % 5000, F.col("turn") * 30)
    return said.select("conv_id", "turn", tokens.cast("long").alias("tokens"), rows.alias("most_rows"))


@register("tx3_derived_prompt", """with r as (select o_custkey, o_orderkey as k, 'sha256:' || sha256(cast(o_orderkey as varchar)) as fp, '| ' || o_orderpriority || ' | "x"' || chr(10) || '\\ | ' as content from orders qualify row_number() over (partition by o_custkey order by o_orderkey) <= 20),
    j as (select o_custkey, string_agg('    {' || chr(10) || '      "fingerprint": "' || fp || '",' || chr(10) || '      "content": ' || cast(to_json(content) as varchar) || chr(10) || '    }', ',' || chr(10) order by k) as rows from r group by o_custkey)
    select o_custkey, array_to_string(['你正在执行按列分析测试预览。', '请逐条阅读输入数据，只输出 JSON，不要输出解释、Markdown、标题或额外文本。', '分析方法：method ' || o_custkey, '单条结论要求：简短明确，不超过 ' || (o_custkey % 100) || ' 个字符。',
    '返回格式必须是：', '{"results":[{"fingerprint":"sha256:...","conclusion":"结论","needsAttention":true}]}', '要求：', '1. 必须按 fingerprint 返回结果；', '2. 不得返回未知 fingerprint；', '3. 每个 fingerprint 只能出现一次；',
    '4. 若无法判断，也请给出简短结论，不要留空；', '5. needsAttention 为 true 表示结论需要用户关注（如风险、异常、待处理），false 表示无需关注；', '输入数据：' || chr(10) || '{' || chr(10) || '  "rows": [' || chr(10) || rows || chr(10) || '  ]' || chr(10) || '}'], chr(10) || chr(10)) as prompt from j""")
def derived_prompt(spark, sf_dir):
    from ..operators.rows import top_rows

    first = top_rows(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderkey")], 20)
    fp = F.concat(F.lit("sha256:"), F.sha2(F.col("o_orderkey").cast("string"), 256))
    content = F.concat(F.lit("| "), "o_orderpriority", F.lit(' | "x"\n\\ | '))
    held = first.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", fp.alias("fingerprint"), content.alias("content")))).alias("rows"))
    method = F.concat(F.lit("method "), F.col("o_custkey").cast("string"))
    return held.select("o_custkey", derive.derived_prompt(F.col("rows"), method, F.col("o_custkey") % 100).alias("prompt"))
