"""Queries of pages: what Spark writes as pages of several component libraries is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources import page_tree
from .registry import register, table


def _pages(spark, sf_dir) -> DataFrame:
    """A customer's orders as one page: by key an ant, arco, aria or list-of-parts table, with a pager and a title. The arco
    page keeps headers and rows in tables side by side."""
    c = F.col
    row = lambda pattern: F.format_string(pattern, "o_orderkey", "o_orderstatus", "o_orderpriority")
    kind = c("o_custkey") % 4
    line = (
        F.when(kind == 0, row("<tr class=ant-table-row data-row-key=%d><td><input type=checkbox></td><td> %s&nbsp;</td><td data-derived-column>x</td><td><b>%s</b></td></tr>"))
        .when(kind == 1, row("<tr class=arco-table-tr><td>%d<td>%s<td>%s"))
        .when(kind == 2, row("<div role=row><span role=gridcell>%d</span><span role=gridcell>%s</span><span role=gridcell>%s</span></div>"))
        .otherwise(row("<div class='_jt_row _jt_rh' index=1><div class=_jt_cell_index>9</div><div>%d</div><div style='display: none'>h</div><div>%s</div><div>%s</div></div>"))
    )
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("l")))), lambda s: s["l"]), "")
    # pages are parsed where they are made: as many tasks as there are cores, though Spark would join small partitions
    cores = spark.sparkContext.defaultParallelism
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    made = orders.repartition(max(cores, orders.rdd.getNumPartitions()), "o_custkey").groupBy("o_custkey").agg(rows.alias("r"), F.count("*").alias("n"))
    key, r, kind = c("o_custkey"), c("r"), c("o_custkey") % 4
    heads = {
        0: ("<div id=a{k}><h3> Orders&#32; </h3><div class=ant-table-wrapper><table><thead class=ant-table-thead><tr><th> <th>Key<th>State</thead><tbody>", "</tbody><tfoot><tr><td>sum</td></tr></tfoot></table></div></div>"),
        1: ("<section data-testid=g{k}><div class=arco-table aria-label=List><table><tr><th>Key<th>State<th>Pri</table></div><div class=arco-table><table><tbody>", "</tbody></table></div></section>"),
        2: ("<div role=grid data-title=Grid id=g{k}><div role=row><span role=columnheader>Key</span><span role=columnheader>State</span><span role=columnheader>Pri</span></div>", "</div>"),
        3: ("<table><tr><td><div id=j{k}><div id=_jt_row_head><div class='_jt_cell_head _jt_cell_head_index'>#</div><div class=_jt_cell_head>Key</div><div class=_jt_cell_head style='display:none'>h</div><div class=_jt_cell_head>State</div><div class=_jt_cell_head>Pri</div></div><div id=_jt_body>", "</div></div></table>"),
    }
    body = F.lit(None).cast("string")
    for k, (before, after) in heads.items():
        first, second = before.split("{k}") if "{k}" in before else (before, "")
        body = F.when(kind == k, F.concat(F.lit(first), key.cast("string"), F.lit(second), r, F.lit(after))).otherwise(body)
    pager = F.concat(
        F.lit("<ul class=ant-pagination>"), F.array_join(F.transform(F.sequence(F.lit(1), c("n")), lambda i: F.concat(F.lit("<li class='item"), F.when(i == 1 + key % c("n"), "-active").otherwise(""), F.lit("'><a>"), i.cast("string"), F.lit("</a></li>"))), ""), F.lit("</ul>")
    )
    return made.select("o_custkey", F.concat(F.lit("<html><title>P &amp; q</title><body><p>x</p>"), body, pager, F.lit("<script>var t='<table>';</script></body></html>")).alias("html"))


_KIND = "o_custkey % 4"


@register("ex13_describe_tables", f"""with c as (select distinct o_custkey from orders), t as (select *, unnest(case when {_KIND} = 1 then [0, 1] else [0] end) as i from c)
    select o_custkey, case when {_KIND} = 3 then 1 - 1 + i else i end as table_index, ['ant', 'arco', 'aria', 'generic'][{_KIND} + 1] as component_type, case {_KIND} when 0 then '#a' || o_custkey || ' > div:nth-of-type(1)' when 1 then 'html:nth-of-type(1) > body:nth-of-type(1) > section:nth-of-type(1) > div:nth-of-type(' || (i + 1) || ')' when 2 then '#g' || o_custkey else '#j' || o_custkey end as selector,
    case when {_KIND} = 1 then 'positional' else 'stable-id' end as selector_strength, case {_KIND} when 0 then 'Orders' when 1 then case when i = 0 then 'List' else '' end when 2 then 'Grid' else '' end as table_title,
    case {_KIND} when 0 then 'id:a' || o_custkey || '|title:Orders' when 1 then case when i = 0 then 'aria:List|test:g' || o_custkey || '|title:List' else 'test:g' || o_custkey end when 2 then 'id:g' || o_custkey || '|title:Grid' else 'id:j' || o_custkey end as container_signature,
    case when {_KIND} = 0 then 'key|state' else 'key|state|pri' end as header_fingerprint, case when {_KIND} = 0 then 'Key、State' else 'Key、State、Pri' end as preview from t""")
def describe_tables(spark, sf_dir):
    return _business(page_tree.page_tables(_pages(spark, sf_dir))).drop("headers", "rows", "ancestors")


def _business(found: DataFrame) -> DataFrame:
    """Without the layout tables that hold the tables of the list-of-parts pages, numbered anew."""
    inner = found.where((F.col("o_custkey") % 4 != 3) | (F.col("component_type") == "generic"))
    return inner.withColumn("table_index", F.when(F.col("o_custkey") % 4 == 3, 0).otherwise(F.col("table_index")))


@register("ex10_adapter_rows", f"""select o_custkey, case when {_KIND} = 1 then 1 else 0 end as table_index, row_number() over (partition by o_custkey order by o_orderkey) - 1 as row_pos,
    case when {_KIND} = 0 then o_orderstatus || '/' || o_orderpriority else o_orderkey || '/' || o_orderstatus || '/' || o_orderpriority end as cells from orders""")
def adapter_rows(spark, sf_dir):
    rows = _business(page_tree.page_tables(_pages(spark, sf_dir))).select("o_custkey", "table_index", F.posexplode("rows").alias("row_pos", "c"))
    return rows.select("o_custkey", "table_index", F.col("row_pos").cast("long").alias("row_pos"), F.array_join("c", "/").alias("cells"))


@register("ex8_swap_bodies", f"select o_custkey, unnest(case when {_KIND} = 1 then [0, 1] else [0] end) as table_index, unnest(case when {_KIND} = 1 then [1, 1] else [0] end) as body_index from (select distinct o_custkey from orders)")
def swap_bodies(spark, sf_dir):
    return page_tree.swap_bodies(_business(page_tree.page_tables(_pages(spark, sf_dir))), "o_custkey").select("o_custkey", "table_index", "body_index")


@register("ex14_table_diagnostics", f"""select o_custkey, case when {_KIND} = 1 then 1 else 0 end as table_index, count(*) as rows, count(distinct case when {_KIND} = 0 then o_orderstatus || '/' || o_orderpriority else o_orderkey || o_orderpriority end) as different,
    cast(count(*) * case when {_KIND} = 0 then 2 else 3 end as bigint) as filled from orders group by o_custkey""")
def table_diagnostics(spark, sf_dir):
    return page_tree.table_diagnostics(_business(page_tree.page_tables(_pages(spark, sf_dir))), "o_custkey")


@register("src10_pager_state", """with n as (select o_custkey, count(*) as n from orders group by o_custkey) select o_custkey, cast(1 + o_custkey % n as integer) as current, cast(n as integer) as last, o_custkey % n + 1 >= n as is_last, o_custkey % n = 0 as is_first, n > 1 as multiple from n""")
def pager_state(spark, sf_dir):
    return page_tree.pager_state(page_tree.page_pagers(_pages(spark, sf_dir)), "o_custkey")


@register("ex15_page_texts", f"""select o_custkey, 'Title: P & q' || chr(10) || 'URL: u' || o_custkey || chr(10) || chr(10) || 'x' || case {_KIND} when 0 then ' Orders   KeyState' when 1 then 'KeyStatePri' when 2 then 'KeyStatePri' else '#KeyhStatePri' end ||
    string_agg(case {_KIND} when 0 then ' ' || o_orderstatus || ' x' || o_orderpriority when 1 then o_orderkey || o_orderstatus || o_orderpriority when 2 then o_orderkey || o_orderstatus || o_orderpriority else '9' || o_orderkey || 'h' || o_orderstatus || o_orderpriority end, '' order by o_orderkey) || case when {_KIND} = 0 then 'sum' else '' end ||
    array_to_string(range(1, count(*) + 1), '') as text from orders group by o_custkey""")
def page_texts(spark, sf_dir):
    pages = _pages(spark, sf_dir).withColumn("url", F.concat(F.lit("u"), F.col("o_custkey").cast("string")))
    return page_tree.page_texts(pages).select("o_custkey", "text")


@register("sf2_normalize_text", r"select o_orderkey, 'a' || chr(10) || 'b ' || o_orderstatus || chr(10) || chr(10) || 'c' as text from orders")
def normalize_text(spark, sf_dir):
    said = F.concat(F.lit(" \na \t\nb "), "o_orderstatus", F.lit("\n\n\n\nc\n "))
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.normalize_text(said).alias("text"))


@register("sf3_truncate_text", r"""select doc_id, case when length(t) > 200 then t[:200] || chr(10) || chr(10) || '[Truncated: ' || (length(t) - 200) || ' chars]' else t end as text
    from (select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\x{00A0}', ' ', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as t from documents)""")
def truncate_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.truncate_text(F.col("text"), 200).alias("text"))


@register("sf4_one_line", r"""select doc_id, case when length(t) > 80 then t[:80] || '…' else t end as line from (select doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) as t from documents)""")
def one_line(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.one_line(F.col("text"), 80).alias("line"))


@register("sf11_row_identity", """with r as (select o_orderkey, o_custkey, o_orderpriority || chr(31) || o_orderstatus as t from orders)
    select o_orderkey, 'T' || o_custkey || '::' || case when o_orderkey % 4 = 0 then 'business:k' || o_orderkey when o_orderkey % 4 = 1 then 'virtual:' || (o_orderkey % 100) when o_orderkey % 4 = 2 then 'fingerprint:2:' ||
    lower(to_base(list_reduce(list_transform(string_split(t, ''), lambda x: cast(unicode(x) as bigint)), lambda h, x: (xor(h, x) * 16777619) & 4294967295, cast(2166136261 as bigint)), 36)) || ':row:' || (o_orderkey % 7) else 'row:' || (o_orderkey % 7) end as identity from r""")
def row_identity(spark, sf_dir):
    c = F.col
    k = c("o_orderkey")
    cells = F.when(k % 4 == 2, F.concat_ws(" ||| ", "o_orderpriority", F.lit("-"), "o_orderstatus")).otherwise(" - ||| ")
    found = tx.row_identity(F.concat(F.lit("T"), c("o_custkey").cast("string")), F.when(k % 4 == 0, F.concat(F.lit(" k"), k.cast("string"))).otherwise(" "), F.when(k % 4 == 1, k % 100), cells, k % 7)
    return table(spark, sf_dir, "orders").select("o_orderkey", found.alias("identity"))


@register("sf17_markdown_cell", r"select o_orderkey, 'a\|' || o_orderpriority || ' b' as cell from orders")
def markdown_cell(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.markdown_cell(F.concat(F.lit("a|"), "o_orderpriority", F.lit("\r\nb"))).alias("cell"))


@register("sf23_cache_key", "select o_orderkey, 'p:a:' || o_custkey || ':sha256:' || o_orderkey as key, 'sha256:' || o_orderkey as row from orders")
def cache_key(spark, sf_dir):
    key = tx.cache_key("p", F.concat(F.lit("a:"), F.col("o_custkey").cast("string")), F.concat(F.lit("sha256:"), F.col("o_orderkey").cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", key.alias("key"), tx.cache_key_row(key).alias("row"))


@register("sf25_split_cells", "select o_orderkey, o_orderstatus || '/' || '-' || '/' || o_orderpriority as cells from orders")
def split_cells(spark, sf_dir):
    text = tx.row_text(F.array(F.concat("o_orderstatus", F.lit(" ")), F.lit(None).cast("string"), F.col("o_orderpriority")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(tx.split_cells(text), "/").alias("cells"))


@register("sf26_markdown_table_row", "select o_orderkey, o_orderstatus || '/' || '' || '/' || o_orderpriority as cells from orders")
def markdown_table_row(spark, sf_dir):
    line = F.concat(F.lit(" | "), "o_orderstatus", F.lit(" || "), "o_orderpriority", F.lit("|"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(tx.markdown_table_row(line), "/").alias("cells"))
