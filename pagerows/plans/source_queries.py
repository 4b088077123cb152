"""Queries of the sources: texts and chunks that Spark writes from the tables, read back."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import render
from ..sources import delimited, html_tables, sse
from ..streaming import cache
from ..shared import new_folder
from .registry import register, table


def _parts(spark, sf_dir) -> DataFrame:
    """Parts with the file or page that they stand on: 500 keys of a brand at most, so that none grows with the table."""
    return table(spark, sf_dir, "part").withColumn("page", F.concat_ws("/", "p_brand", F.floor(F.col("p_partkey") / 500).cast("string")))


_PAGE = "(select *, p_brand || '/' || (p_partkey // 500) as page from part)"


def _part_csv(spark, sf_dir) -> DataFrame:
    name = F.concat("p_name", F.lit(', "'), F.col("p_size").cast("string"), F.lit('"'))
    cells = F.array(F.col("p_partkey").cast("string"), name, F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(""))
    return render.to_csv_text(_parts(spark, sf_dir), "page", ["p_partkey"], cells, ["key", " full  name", ""])


_PART_CELLS = """[cast(p_partkey as varchar), p_name || ', "' || p_size || '"', case when p_size > 25 then p_type else '' end]"""


@register("src3_read_delimited", f"""select page, cast(row_number() over (partition by page order by p_partkey) as integer) as row_pos,
    array_to_string({_PART_CELLS}, '/') as cells from {_PAGE} union all select distinct page, 0, 'key/ full  name/' from {_PAGE}""")
def read_delimited(spark, sf_dir):
    found = delimited.parse_delimited(_part_csv(spark, sf_dir), "csv")
    return found.select("page", "row_pos", F.array_join("cells", "/").alias("cells"))


@register("src5_normalize_sheet", f"""select page, 'key/full name/列3' as headers, count(*) over (partition by page) as total_rows,
    row_number() over (partition by page order by p_partkey) as row, array_to_string({_PART_CELLS}, '/') as cells from {_PAGE} qualify row <= 10000""")
def normalize_sheet(spark, sf_dir):
    sheet = delimited.normalize_sheet(delimited.parse_delimited(_part_csv(spark, sf_dir), "csv"), "page")
    join = lambda c: F.array_join(c, "/").alias(c)
    return sheet.select("page", join("headers"), "total_rows", F.col("row").cast("long").alias("row"), join("cells"))


@register("src5_large_sheets", """with l as (select *, l_orderkey // 3000 as page, row_number() over (partition by l_orderkey // 3000 order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) as row from lineitem)
    select page, count(*) as total_rows, count(*) filter (row <= 10000) as kept, cast(sum(l_orderkey * 7 + l_partkey) filter (row <= 10000) as bigint) as keys, cast(max(l_orderkey) filter (row <= 10000) as bigint) as last_key from l group by page""")
def large_sheets(spark, sf_dir):
    """Sheets of some 12,000 lines each, of which 10,000 count."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    lines = table(spark, sf_dir, "lineitem").select(*order, F.floor(F.col("l_orderkey") / 3000).alias("page"))
    files = render.to_csv_text(lines, "page", order, F.array(*(F.col(c).cast("string") for c in order[:3])), ["order", "line", "part"])
    sheet = delimited.normalize_sheet(delimited.parse_delimited(files, "csv"), "page")
    cell = lambda k: F.get("cells", k).cast("bigint")
    return sheet.groupBy("page", "total_rows").agg(F.count("row").alias("kept"), F.sum(cell(0) * 7 + cell(2)).alias("keys"), F.max(cell(0)).alias("last_key"))


def _chunks(events: DataFrame, size: int = 50) -> DataFrame:
    """(conv_id, turn, body) cut into pieces that don't end where lines end."""
    pieces = events.select("conv_id", "turn", F.posexplode(F.regexp_extract_all("body", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))).alias("p", "chunk"))
    return pieces.select(F.col("conv_id").alias("stream_id"), F.struct("turn", "p").alias("seq"), "chunk")


@register("st1_sse_events", """select conv_id, cast(row_number() over (partition by conv_id order by turn) - 1 as integer) as event,
    coalesce(text, '') as data from conversations""")
def sse_events(spark, sf_dir):
    lines = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\ndata: "))
    body = F.concat(F.lit(": ping\r\nevent: turn\r\ndata: "), lines, F.lit("\r\n\r\n"))
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("body"))
    return sse.sse_events(_chunks(said)).withColumnRenamed("stream_id", "conv_id")


@register("st2_assemble_answers", """select conv_id, string_agg(coalesce(text, ''), '' order by turn) as answer,
    case when bool_or(role = 'assistant') then 'ended' else 'disconnected' end as status from conversations group by conv_id""")
def assemble_answers(spark, sf_dir):
    said = table(spark, sf_dir, "conversations")
    delta = F.struct(F.struct(F.coalesce("text", F.lit("")).alias("content")).alias("delta"))
    body = F.concat(F.lit("data: "), F.to_json(F.struct(F.array(delta).alias("choices"))), F.lit("\n\n"))
    done = said.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn")).select("conv_id", F.lit(1 << 30).cast(said.schema["turn"].dataType).alias("turn"), F.lit("data: [DONE]\n\n").alias("body"))
    return sse.assemble_answers(_chunks(said.select("conv_id", "turn", body.alias("body")).unionByName(done))).withColumnRenamed("stream_id", "conv_id")


@register("sf10_leading_fingerprint", """with c as (select p_partkey, list_filter([p_name, '', '-', p_brand, p_type, 'more'], lambda x: x not in ('', '-'))[:3] as f from part)
    select p_partkey, len(f) || ':' || lower(to_base(list_reduce(list_transform(string_split(array_to_string(f, chr(31)), ''), lambda x: cast(unicode(x) as bigint)),
    lambda h, x: (xor(h, x) * 16777619) & 4294967295, cast(2166136261 as bigint)), 36)) as fingerprint from c""")
def leading_fingerprint(spark, sf_dir):
    cells = F.array("p_name", F.lit(""), F.lit("-"), "p_brand", "p_type", F.lit("more"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.leading_fingerprint(tx.row_text(cells)).alias("fingerprint"))


@register("sf16_request_budget", """select c_custkey, cast(greatest(2000, floor((greatest(8192, 1000 * (c_custkey % 70)) - greatest(512, c_custkey % 4096) - 1024) * 9e-1)) as bigint) as chars,
    cast(greatest(600, floor(greatest(2000, floor((greatest(8192, 1000 * (c_custkey % 70)) - greatest(512, c_custkey % 4096) - 1024) * 9e-1)) / (1 + c_custkey % 5))) as bigint) as per_source from customer""")
def request_budget(spark, sf_dir):
    k = F.col("c_custkey")
    chars, each = tx.request_budget(1000 * (k % 70), k % 4096, 1 + k % 5)
    return table(spark, sf_dir, "customer").select(k, chars.cast("long").alias("chars"), each.cast("long").alias("per_source"))


def _part_pages(spark, sf_dir) -> DataFrame:
    """Pages with a table of parts of a brand; every row stands twice."""
    row = F.format_string("<tr><td>%s</td><td>&nbsp;<b>%s</b> &amp; co<br></td><td colspan=2>%s</td></tr>", "p_partkey", "p_name", "p_size")
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("r")))), lambda s: s["r"]), "")
    head = "<p>x</p><table><caption>Parts</caption><thead><tr><th>key</th><th> name </th><th>size</th></tr></thead><tbody>"
    foot = "</tbody><tfoot><tr><td>sum</td></tr></tfoot></table>"
    return _parts(spark, sf_dir).groupBy("page").agg(F.concat(F.lit(head), rows, rows, F.lit(foot)).alias("html"))


@register("src1_extract_tables", f"""select page, 0 as table_index, 'Parts' as title, 'key/name/size' as headers, cast(2 * count(*) as integer) as n_rows from {_PAGE} group by page""")
def extract_tables(spark, sf_dir):
    found = html_tables.extract_tables(_part_pages(spark, sf_dir))
    return found.select("page", "table_index", "title", F.array_join("headers", "/").alias("headers"), F.size("rows").alias("n_rows"))


@register("src2_extract_table_rows", f"""select page, 0 as table_index, cast(row_number() over (partition by page order by p_partkey) - 1 as integer) as row_pos,
    p_partkey || '/' || p_name || ' & co/' || p_size as cells from {_PAGE}""")
def extract_table_rows(spark, sf_dir):
    found = html_tables.extract_table_rows(_part_pages(spark, sf_dir), "page")
    return found.select("page", "table_index", "row_pos", F.array_join("cells", "/").alias("cells"))


@register("snk5_cache_write", """select user_id, event_type, event_id, conclusion from (select user_id, event_type, event_id, trim(props) as conclusion,
    row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as k from events where trim(coalesce(props, '')) <> '') where k = 1""")
def cache_write(spark, sf_dir):
    """The events, read as a stream, are cached results; the newest of each user and type counts."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet").withColumn("conclusion", F.trim("props"))
    folder = new_folder(spark, "cache")
    cache.write_cache_stream(stream, f"{folder}/entries", f"{folder}/progress").awaitTermination()
    entries = spark.read.parquet(f"{folder}/entries")
    return cache.cache_latest(entries, ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "conclusion")
