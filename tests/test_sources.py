from pagerows.operators import folds, matching
from pagerows.sources import delimited, html_tables, sse
from pyspark.sql import functions as F


def parsed(spark, text):
    found = delimited.parse_delimited(spark.createDataFrame([(1, text)], "id int, text string"))
    return [r.cells for r in found.orderBy("row_pos").collect()]


def test_delimited(spark):
    assert parsed(spark, '﻿a;b;c\r\n"x;""y""\nz";2;\r\n ; ;\r1;"q"r;s"t') == [["a", "b", "c"], ['x;"y"\nz', "2", ""], ["1", "qr", 's"t']]
    assert parsed(spark, "a\tb\n,\t") == [["a", "b"], [",", ""]]
    assert parsed(spark, "") == [] and parsed(spark, None) == []
    assert parsed(spark, ",x\n,,") == [["", "x"]]


def test_events(spark):
    body = "data: a\r\ndata:b\r\n\r\n\r\n: no\nevent: x\n\ndata\n\ndata:  c"
    chunks = spark.createDataFrame([(1, k, c) for k, c in enumerate(body)], "stream_id int, seq int, chunk string")
    assert [r.data for r in sse.sse_events(chunks).orderBy("event").collect()] == ["a\nb", "", " c"]


def test_tables(spark):
    page = """<table aria-label=T><tr><th>a<th>b</tr><tr><td>1</td><td>2<table><tr><td>in</td></tr></table></td></tr>
        <tr><td></td><td>1</td><td>2</td></tr><tr><td> </td></tr><tr><td>3</td></tr></table>
        <div role=grid><div role=row><span role=gridcell>h</span></div><div role=row><span role=gridcell>v<script>no</script></span></div></div>"""
    pages = spark.createDataFrame([(1, page), (2, None), (3, "<td>loose")], "page_id int, html string")
    found = html_tables.extract_table_rows(pages, "page_id").orderBy("page_id", "table_index", "row_pos").collect()
    assert [(r.page_id, r.table_index, r.cells) for r in found] == [(1, 0, ["1", "2"]), (1, 0, ["3", ""]), (1, 1, ["v"])]


def test_frames_on_a_cycle_have_no_path(spark):
    frames = spark.createDataFrame([(1, 0, None, "u"), (1, 1, 0, "v"), (1, 2, 0, "v"), (1, 3, 4, "x"), (1, 4, 3, "y")], "page_id int, frame_id int, parent_frame_id int, url string")
    assert {r.frame_id: r.path for r in matching.frame_paths(frames).collect()} == {0: "u#0", 1: "u#0 > v#0", 2: "u#0 > v#1", 3: None, 4: None}


def test_budget_skips_what_does_not_fit(spark):
    rows = spark.createDataFrame([("s", 1, "aaaa"), ("s", 2, "a" * 400), ("s", 3, "b"), ("s", 4, "b")], "k string, n int, text string")
    taken = folds.select_within_budget(rows, "k", [F.col("n")], F.lit(False), "text", 60, ["n"])
    assert sorted(r.n for r in taken.collect()) == [1, 3]
