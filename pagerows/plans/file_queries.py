"""Queries of files and streams that Spark makes of the tables and reads back."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog, catalog_log, definitions
from ..sources import page_tree, workbooks
from ..streaming import answers, cache
from ..shared import cut, new_folder
from .page_queries import _pages
from .registry import register, spread_table, table


def _book(sheets: dict[str, list[list[str]]]) -> bytes:
    """A workbook: texts shared or inline by turns, empty cells left out."""
    shared: dict[str, int] = {}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(sheets)
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1)) + "</Relationships>")
        for k, name in enumerate(names, 1):
            lines = []
            for r, row in enumerate(sheets[name], 1):
                cells = []
                for c, v in enumerate(row):
                    at = f"{chr(65 + c)}{r}"
                    if v == "":
                        continue
                    if v in ("TRUE", "FALSE"):
                        cells.append(f'<c r="{at}" t="b"><v>{int(v == "TRUE")}</v></c>')
                    elif v.isdigit():
                        cells.append(f'<c r="{at}"><f>A1</f><v>{v}</v></c>')
                    elif c % 2:
                        cells.append(f'<c r="{at}" t="s"><v>{shared.setdefault(v, len(shared))}</v></c>')
                    else:
                        cells.append(f'<c r="{at}" t="inlineStr"><is><t>{escape(v)}</t></is></c>')
                lines.append(f'<row r="{r}">{"".join(cells)}</row>')
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet><sheetData>{''.join(lines)}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", "<sst>" + "".join(f"<si><r><t>{escape(v)}</t></r></si>" for v in shared) + "</sst>")
    return out.getvalue()


def _books(spark, sf_dir) -> DataFrame:
    """A customer's orders as a workbook of two sheets; one of 13 is damaged."""

    def run(batches):
        for batch in batches:
            made = []
            for key, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = [["Key", "State & <x>", "", "Big"]] + [[str(r["o_orderkey"]), r["o_orderstatus"], "", "TRUE" if r["o_totalprice"] > 200_000 else "FALSE"] for r in rows]
                made.append(b"PK broken" if key % 13 == 0 else _book({"first": lines, "two": [["n"], [""], [str(len(rows))]]}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["o_custkey", "content"])

    row = F.struct("o_orderkey", "o_orderstatus", "o_totalprice")
    held = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return held.mapInArrow(run, "o_custkey bigint, content binary")


_BOOK_ROWS = """o as (select o_custkey, row_number() over (partition by o_custkey order by o_orderkey) as n, o_orderkey || '/' || o_orderstatus || '//' || case when o_totalprice > 200000 then 'TRUE' else 'FALSE' end as cells from orders where o_custkey % 13 > 0),
    s as (select o_custkey, 1 as sheet_no, 'first' as sheet, n as row_pos, cells from o union all select distinct o_custkey, 1, 'first', 0, 'Key/State & <x>//Big' from o union all select distinct o_custkey, 2, 'two', 0, 'n' from o
    union all select o_custkey, 2, 'two', 2, cast(count(*) as varchar) from o group by o_custkey)"""


@register("src4_read_workbooks", f"""with {_BOOK_ROWS} select o_custkey, cast(sheet_no as integer) as sheet_no, sheet, cast(row_pos as integer) as row_pos, cells, null as error from s union all select distinct o_custkey, null, null, null, null, 'not a workbook' from orders where o_custkey % 13 = 0""")
def read_workbooks(spark, sf_dir):
    found = workbooks.parse_workbooks(_books(spark, sf_dir))
    return found.select("o_custkey", "sheet_no", "sheet", "row_pos", F.array_join("cells", "/").alias("cells"), "error")


@register("src6_load_files", f"""with {_BOOK_ROWS}, f as (select distinct o_custkey, case o_custkey % 4 when 0 then 'first' when 1 then 'two' when 2 then 'first' end as want from orders),
    r as (select o_custkey // 6 as request, o_custkey, row_number() over (partition by o_custkey // 6 order by o_custkey) as k from f)
    select r.request, r.o_custkey, case when r.o_custkey % 13 > 0 then sheet end as sheet, case when r.o_custkey % 13 > 0 then cast(row_pos as integer) end as row_pos, case when r.o_custkey % 13 > 0 then cells end as cells,
    case when r.o_custkey % 17 = 0 then 'only CSV, TSV and XLSX files' when r.o_custkey % 13 = 0 then 'not a workbook' end as error from r join f using (o_custkey) left join s on s.o_custkey = r.o_custkey and s.sheet = f.want and r.o_custkey % 17 > 0
    where k <= 5 - (r.request % 3) and (s.o_custkey is not null or r.o_custkey % 13 = 0 or r.o_custkey % 17 = 0)
    """.replace("case when r.o_custkey % 13 > 0 then sheet end", "case when r.o_custkey % 17 > 0 and r.o_custkey % 13 > 0 then sheet end"))
def load_files(spark, sf_dir):
    c = F.col
    key = c("o_custkey")
    answer = F.when(key % 4 == 0, "1").when(key % 4 == 1, "two").when(key % 4 == 3, "9")
    request = F.floor(key / 6)
    files = _books(spark, sf_dir).select("o_custkey", request.alias("request"), F.when(key % 17 == 0, "a.pdf").otherwise("a.b.XLSX").alias("name"), "content", answer.alias("sheet_answer"), (request % 3).cast("int").alias("used"))
    found = workbooks.load_files(files, "request", "o_custkey", used="used")
    return found.select("request", "o_custkey", "sheet", "row_pos", F.array_join("cells", "/").alias("cells"), "error")


def _catalogs(spark, sf_dir) -> DataFrame:
    """A customer's orders as a catalog in JSON, with a name for a page; some damaged."""
    c = F.col
    key = c("o_custkey")
    orders = table(spark, sf_dir, "orders")
    items = orders.select(key, c("o_orderkey").alias("seq"), c("o_orderkey").cast("string").alias("id"), F.when(c("o_orderkey") % 5 > 0, c("o_orderpriority")).otherwise(" ").alias("name"), F.concat("o_orderstatus", F.lit('"')).alias("content"))
    names = orders.groupBy(key).agg(F.min("o_orderpriority").alias("name")).select(key, F.concat(F.lit("p"), key.cast("string")).alias("page_key"), "name")
    made = workbooks.catalog_json(items, "o_custkey", "seq", F.lit("2024-01-01"), "page-analyses", names)
    return made.withColumn("text", F.when(key % 11 == 0, F.concat(F.lit("{"), "text")).otherwise(c("text")))


@register("snk3_catalog_json", """select o_custkey, case when o_custkey % 11 = 0 then '{' else '' end || '{"format":"page-analyses","version":1,"exportedAt":"2024-01-01","skills":[' || string_agg('{"id":"' || o_orderkey || '","name":"' || case when o_orderkey % 5 > 0 then o_orderpriority else ' ' end || '","content":"' || o_orderstatus || '\\""}', ',' order by o_orderkey) ||
    '],"pageNames":{"p' || o_custkey || '":"' || min(o_orderpriority) || '"}}' as text from orders group by o_custkey""")
def write_catalog(spark, sf_dir):
    return _catalogs(spark, sf_dir)


@register("src7_read_catalog_json", """select o_custkey, cast(row_number() over (partition by o_custkey order by o_orderkey) - 1 as integer) as seq, cast(o_orderkey as varchar) as id, case when o_orderkey % 5 > 0 then o_orderpriority else ' ' end as name, null as error from orders where o_custkey % 11 > 0
    union all select distinct o_custkey, null, null, null, 'not JSON' from orders where o_custkey % 11 = 0""")
def read_catalog(spark, sf_dir):
    return workbooks.read_catalog(_catalogs(spark, sf_dir)).select("o_custkey", "seq", "item.id", "item.name", "error")


@register("src7_catalog_names", "select o_custkey, 'p' || o_custkey as page_key, min(o_orderpriority) as name from orders where o_custkey % 11 > 0 group by o_custkey")
def catalog_names(spark, sf_dir):
    return workbooks.catalog_names(_catalogs(spark, sf_dir))


_IMPORT_SQL = """i as (select o_custkey, o_orderkey, o_orderstatus || '"' as content, o_orderkey % 5 > 0 as ok from orders where o_custkey % 11 > 0),
    f as (select *, ok and o_orderkey = min(o_orderkey) filter (ok) over (partition by o_custkey, content) and not (o_custkey % 2 = 0 and content = 'P"') as new from i)"""


@register("job6_import_catalog", f"""with {_IMPORT_SQL} select o_custkey, count(*) as total, count(*) filter (new) as success, count(*) filter (ok and not new) as duplicate, count(*) filter (not ok) as failed, cast(null as varchar) as error from f group by o_custkey
    union all select distinct o_custkey, 0, 0, 0, 0, 'not JSON' from orders where o_custkey % 11 = 0""")
def import_catalog(spark, sf_dir):
    """A damaged catalog has its error and no items."""
    c = F.col
    read = workbooks.read_catalog(_catalogs(spark, sf_dir), item="struct<id:string,name:string,content:string>")
    items = read.where("error is null").select("o_custkey", "seq", "item.*").withColumn("bad", F.size(definitions.definition_errors(F.lit("table-analysis"), c("name"), F.lit(1), F.lit(0), F.lit(0))) > 0)
    fp = F.sha2(F.concat_ws("\x1f", c("o_custkey").cast("string"), "content"), 256)
    held = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.sha2(F.concat_ws("\x1f", c("c_custkey").cast("string"), F.lit('P"')), 256).alias("fp"))
    judged = catalog.import_dedupe(items.withColumn("fp", fp).withColumn("place", c("id").cast("long")), held, "fp", "place", ~c("bad"))
    n = lambda o: F.count_if(c("outcome") == o).alias(o)
    counts = judged.groupBy("o_custkey").agg(F.count("*").alias("total"), n("success"), n("duplicate"), n("failed"))
    damaged = read.where("error is not null").select("o_custkey", *(F.lit(0).cast("bigint").alias(k) for k in ("total", "success", "duplicate", "failed")), "error")
    return counts.withColumn("error", F.lit(None).cast("string")).unionByName(damaged)


@register("job6_import_applied", f"""with {_IMPORT_SQL}, h as (select o_custkey, count(*) as analyses from (select o_custkey from f where new union all select c_custkey from customer where c_custkey % 2 = 0) group by o_custkey),
    k as (select o_custkey from orders union select c_custkey from customer where c_custkey % 2 = 0)
    select k.o_custkey, coalesce(analyses, 0) as analyses, (select 'added ' || count(*) filter (new) from f where f.o_custkey = k.o_custkey having count(*) > 0) as outcome, (select min(o_orderpriority) from orders o where o.o_custkey = k.o_custkey and o.o_custkey % 11 > 0) as page_name from k left join h using (o_custkey)""")
def import_applied(spark, sf_dir):
    """What imports leave in catalogs that hold an analysis each or none: valid items of a file whose content is new, and the
    file's page names. A damaged file leaves its catalog as it was."""
    c = F.col
    files = _catalogs(spark, sf_dir)
    read = workbooks.read_catalog(files, item="struct<id:string,name:string,content:string>")
    items = read.where("error is null").withColumn("bad", F.size(definitions.definition_errors(F.lit("table-analysis"), c("item.name"), F.lit(1), F.lit(0), F.lit(0))) > 0)
    log = catalog_log.import_log(items.where("not bad").select(c("o_custkey").alias("catalog"), "seq", *(c(f"item.{k}").alias(k) for k in ("id", "name", "content"))), workbooks.catalog_names(files).withColumnRenamed("o_custkey", "catalog"), read.where("error is null").select(c("o_custkey").alias("catalog")).distinct())
    owners = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(c("c_custkey").alias("catalog"), F.lit(0).alias("seq"), F.lit("own").alias("id"), F.lit("own").alias("name"), F.lit('P"').alias("content"))
    held = catalog_log.compacted(catalog_log.import_log(owners, None, owners.select("catalog")))
    done = cut(catalog_log.folded(log, held))
    state = done.where("state is not null").select("catalog", "state")
    left = catalog_log.skills_of(state).groupBy("catalog").agg(F.count("*").alias("analyses"))
    names = catalog_log.names_of(state).groupBy("catalog").agg(F.min("name").alias("page_name"))
    said = done.where("outcome is not null").select("catalog", "outcome")
    everyone = files.select(c("o_custkey").alias("catalog")).union(owners.select("catalog")).distinct()
    return everyone.join(left, "catalog", "left").join(names, "catalog", "left").join(said, "catalog", "left").select(c("catalog").alias("o_custkey"), F.coalesce("analyses", F.lit(0)).alias("analyses"), "outcome", "page_name")


def _folder(spark) -> str:
    return new_folder(spark, "files")


def _chunk_files(spark, sf_dir) -> str:
    """The conversations as files of chunks in order of time, a wave of turns each, so that a stream meets them so; every
    fourth never ends. A last file of other streams comes much later."""
    c = F.col
    said = table(spark, sf_dir, "conversations")
    delta = F.to_json(F.struct(F.array(F.struct(F.struct(F.coalesce("text", F.lit("")).alias("content")).alias("delta"))).alias("choices")))
    body = F.concat(F.lit("data: "), delta, F.lit("\r\n\r\n"))
    pieces = said.select("conv_id", "turn", F.posexplode(F.regexp_extract_all(body, F.lit("(?s).{1,70}"), F.lit(0))).alias("p", "chunk"))
    ends = said.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).where("conv_id % 4 > 0").select("conv_id", "turn", F.lit(0).alias("p"), F.lit(": ok\ndata: [DONE]\n\n").alias("chunk"))
    late = said.select((-1 - c("conv_id")).alias("conv_id")).distinct().select("conv_id", F.lit(10_000).cast("bigint").alias("turn"), F.lit(0).alias("p"), F.lit("data: x\n\n").alias("chunk"))
    rows = pieces.unionByName(ends).unionByName(late)
    placed = rows.select("conv_id", (c("turn") * 100_000 + c("p")).alias("seq"), F.timestamp_seconds(1_700_000_000 + c("turn")).alias("ts"), "chunk", F.least(F.floor(c("turn") / 4), F.lit(1000)).alias("wave"))
    folder = _folder(spark)
    placed.repartition("wave").write.partitionBy("wave").parquet(folder)
    return folder


def _fed(spark, sf_dir, make) -> DataFrame:
    """What a stream gives when the waves come one after another: each run takes up the state of the one before."""
    source, base = _chunk_files(spark, sf_dir), _folder(spark)
    inbox, out, progress = f"{base}/inbox", f"{base}/out", f"{base}/progress"
    schema = "conv_id bigint, seq bigint, ts timestamp, chunk string"
    waves = sorted(r["wave"] for r in spark.read.parquet(source).select("wave").distinct().collect())  # a few
    for wave in waves:
        spark.read.schema(schema).parquet(f"{source}/wave={wave}").coalesce(1).write.mode("append").parquet(inbox)
        made = make(spark.readStream.schema(schema).parquet(inbox))
        made.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(out)


@register("st2_answers_stream", """select conv_id, string_agg(coalesce(text, ''), '' order by turn) as answer, case when conv_id % 4 > 0 then 'ended' else 'timeout' end as status, count(*) as events from conversations group by conv_id""")
def answers_stream(spark, sf_dir):
    found = _fed(spark, sf_dir, lambda s: answers.answers_stream(s, "conv_id", "seq", "ts"))
    return found.where("conv_id >= 0")


@register("st1_events_stream", """with e as (select conv_id, turn, '{"choices":[{"delta":{"content":' || cast(to_json(coalesce(text, '')) as varchar) || '}}]}' as data from conversations union all select conv_id, max(turn) + 1, '[DONE]' from conversations where conv_id % 4 > 0 group by conv_id)
    select conv_id, row_number() over (partition by conv_id order by turn) - 1 as event, md5(data) as data from e""")
def events_stream(spark, sf_dir):
    found = _fed(spark, sf_dir, lambda s: answers.events_stream(s, "conv_id", "seq"))
    return found.where("conv_id >= 0").select("conv_id", "event", F.md5("data").alias("data"))


@register("st7_inflight_dedupe", "select user_id, event_type, count(*) as requests from (select distinct user_id, event_type, date_trunc('day', ts) as day from events) group by user_id, event_type")
def inflight_dedupe(spark, sf_dir):
    """The same request of a user within a day is in flight once; days are told apart by the key."""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet")
    asked = events.select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias("day"))
    base = _folder(spark)
    cache.inflight_dedupe(asked, ["user_id", "event_type", "day"], "ts", "1 day").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("user_id", "event_type").agg(F.count("*").alias("requests"))


@register("snk6_cache_drop", "select event_id, user_id from events where user_id % 3 <> 1")
def cache_drop(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    gone = events.where("user_id % 3 = 1").select("user_id").distinct()
    return cache.cache_drop(events, gone, "user_id")


@register("ex18_business_tabs", """select o_custkey, string_agg(p, '/' order by f) as titles, max_by(p, case when p like '2%' then 1000000000 else l end) as active_title from (select o_custkey, o_orderpriority as p, min(o_orderkey) as f, max(o_orderkey) as l from orders where o_custkey % 3 > 0 group by all) group by o_custkey""")
def business_tabs(spark, sf_dir):
    """By key tabs of the frame's own kind, general tabs on its pages, and general tabs on other pages, which don't count."""
    c = F.col
    on = F.when(c("o_orderpriority").startswith("2"), "true").otherwise("false")
    own = F.format_string("<div class='x a-realTab' data-active=%s> %s </div>", on, "o_orderpriority")
    general = F.format_string("<div role=tab aria-controls=p aria-selected=%s><i></i><span class=tab-title>%s</span><b>x</b></div>", on, "o_orderpriority")
    line = F.when(c("o_custkey") % 3 == 1, own).otherwise(general)
    made = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("l")))), lambda s: s["l"]), "").alias("html"))
    pages = made.withColumn("html", F.concat("html", F.when(c("o_custkey") % 3 == 2, "<iframe id=epaas-tab-1></iframe>").otherwise("")))
    return page_tree.tab_titles(page_tree.page_tabs(pages), "o_custkey").select("o_custkey", F.array_join("titles", "/").alias("titles"), "active_title")


@register("ex17_html_markdown", """select o_orderkey, '## ' || o_orderstatus || chr(10) || chr(10) || 'a **' || o_orderpriority || '** [x](http://h/' || o_orderkey || ') js' || chr(10) || chr(10) || '- 1' || chr(10) || '- *2*' || chr(10) || chr(10) || '| k | v |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || o_custkey || '\\| |  |' || chr(10) || chr(10) || '`<b>`' as markdown from orders""")
def html_markdown(spark, sf_dir):
    html = F.format_string(
        "<h2>%s</h2><div>a <b>%s</b> <a href=http://h/%d>x</a> <a href='javascript:1'>js</a><script>no</script></div><ul><li>1<li><i>2</i></ul><p></p><table><tr><th>k<th>v<tr><td>%d|</table>`<b>`", "o_orderstatus", "o_orderpriority", "o_orderkey", "o_custkey"
    )
    return page_tree.html_markdown(spread_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").select("o_orderkey", html.alias("html")))


@register("ex16_page_outlines", """select o_orderkey, 'PAGE_SNAPSHOT v1' || chr(10) || 'Title: T ' || o_custkey || chr(10) || 'URL: u' || chr(10) || chr(10) || 'HEADINGS:' || chr(10) || '- ' || o_orderpriority || chr(10) || chr(10) || 'ACTIONS_AND_FIELDS:' || chr(10) || '- a: go' || chr(10) || '- input[type=text] disabled: find ' || o_orderstatus || chr(10) || '- div[role=button]: (no text)' ||
    chr(10) || chr(10) || 'TABLES:' || chr(10) || '- Table 1: columns: k | v' || chr(10) || '  - row: ' || o_custkey || ' ||| -' || chr(10) || '  - row: 2 ||| x' || chr(10) || '- Table 2: columns: (no headers found)' || chr(10) || chr(10) || 'PAGE_TEXT_SNIPPET:' || chr(10) || o_orderpriority || 'gogokv' || o_custkey || '2xlong text ' || o_orderkey as outline from orders""")
def page_outlines(spark, sf_dir):
    html = F.format_string(
        "<title>T  %d</title><body><h2> %s</h2><h2></h2><a>go</a><a>go</a><input type=text placeholder='find %s' disabled><div role=button></div><table><thead><tr><th>k<th>v<tbody><tr><td>%d<td><tr><td>2<td>x</table><table></table><main>long text %d</main><script>x</script>", "o_custkey", "o_orderpriority", "o_orderstatus", "o_custkey", "o_orderkey"
    )
    pages = spread_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").select("o_orderkey", F.lit("u").alias("url"), html.alias("html"))
    return page_tree.page_outlines(pages).select("o_orderkey", "outline")


@register("snk5_upsert_cache", """with o as (select user_id, event_type, props as conclusion, epoch_ms(ts) as created_at, event_id from events where event_id % 3 > 0), n as (select user_id, event_type, props, epoch_ms(ts), event_id from events where event_id % 3 = 0 and trim(coalesce(props, '')) <> ''),
    u as (select * from (select *, 0 as new from o union all select *, 1 from n) qualify row_number() over (partition by user_id, event_type, conclusion order by new desc, created_at desc, event_id desc) = 1)
    select user_id, event_type, conclusion, event_id from u qualify row_number() over (partition by user_id order by created_at desc, event_id desc) <= 7""")
def upsert_cache(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("props").alias("conclusion"), F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at"), "event_id", F.col("props").alias("row_fp"))
    found = cache.upsert_cache(events.where("event_id % 3 > 0"), events.where("event_id % 3 = 0"), "user_id", ["event_type", "row_fp"], "created_at", "event_id", most=7)
    return found.select("user_id", "event_type", "conclusion", "event_id")


@register("ex17_pages_markdown", None)
def pages_markdown(spark, sf_dir):
    """The given pages; held against a plain reading in the tests."""
    return page_tree.html_markdown(spread_table(spark, sf_dir, "pages", "page_id", "html"))
