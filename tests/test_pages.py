"""Pages, workbooks and answers: small cases of what the queries' texts don't hold."""

import cProfile
import io
import random
import zipfile

import pytest
from pagerows.operators import binding, contexts, derive, matching, rows, store
from pagerows.plans.file_queries import _book
from pagerows.sources import html_tables, page_tree, workbook_source, workbooks
from pagerows.streaming import answers
from pyspark.sql import functions as F


def tables(html, **options):
    page = page_tree.Page(page_tree.parse(html), **options)
    return [(page.kind(t), [h.text().strip() for h in page.heads(t)], page.raw_rows(t)) for t in page.tables]


def test_nested_and_broken_tables():
    assert tables("<table><tr><th>A<th>B<tr><td>1<td><table><tr><td>in</table></table>") == [("native", ["A", "B"], [["1", "in", "in"]])]
    assert tables("") == tables(None) == tables("<p>no</p>") == []
    assert tables("<table><tbody><tr><td>1<td colspan=3>2") == [("native", ["1", "2"], [["1", "2", "", ""]])]
    assert tables("<table><thead><tr><th>H</thead><tbody><tr><td>x</td><td data-derived-column>d</td></tr></tbody></table>") == [("native", ["H"], [["x"]])]


def test_headers_beside_a_table_and_summaries():
    html = "<div><div role=row><b role=columnheader>K</b><b role=columnheader>V</b></div><section><div class=ant-table-wrapper><div class=ant-table-row><i>1</i><i>2</i></div><div class=ant-table-summary><div class=ant-table-row><i>s</i></div></div></div></section></div>"
    assert tables(html) == [("ant", ["K", "V"], [["1", "2"]])]


def test_own_adapter():
    grid = page_tree.Adapter("cards", lambda n: "cards" in n.classes, lambda t: [c for c in t.children if "card" in c.classes], lambda r: r.children if "card" in r.classes else None, lambda t: [c for c in t.children if c.tag == "b"])
    assert tables("<div class=cards><b>N</b><b>V</b><p class=card><i>1</i><i>2</i></p></div>", adapters=(grid, *page_tree.ADAPTERS)) == [("cards", ["N", "V"], [["1", "2"]])]


def test_markdown_of_html():
    md = page_tree.to_markdown
    assert md("plain <unknown>") == "plain <unknown>" and md(None) == ""
    assert md("<p>a<br>b</p><ol><li>x<li>y</ol>") == "a\nb\n\n1. x\n2. y"
    assert md("<blockquote>q<br>r</blockquote><pre>\nz </pre><hr><img alt=pic><s>o</s>") == "> q\n> r\n\n```\nz\n```\n\n---\n\npic~~o~~"
    assert md("<b>x</b> ```<b>kept</b>``` <iframe>no</iframe>") == "**x** ```<b>kept</b>```"


def test_given_pages_as_markdown(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.markdown for r in page_tree.html_markdown(pages.select("page_id", "html")).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        assert "<script" not in got[r.page_id] and "\n\n\n" not in got[r.page_id]
        title = r.html.split("<h1>")[1].split("</h1>")[0] if "<h1>" in r.html else ""
        assert "<" in title or "&" in title or title.strip() in got[r.page_id]


def test_workbooks_that_cannot_be_read(spark):
    hollow = io.BytesIO()
    with zipfile.ZipFile(hollow, "w") as z:
        z.writestr("xl/workbook.xml", "<workbook><sheets/></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships/>")
    bad = io.BytesIO()
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("xl/workbook.xml", "<workbook")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships/>")
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", b"0" * (workbooks.MAX_PART + 1))
    files = [None, b"", b"PK", hollow.getvalue(), bad.getvalue(), bomb.getvalue(), _book({"s": [["a"], ["", "b"]]})]
    frame = spark.createDataFrame(list(enumerate(files)), "k int, content binary")
    got = {}
    for r in workbooks.parse_workbooks(frame).collect():
        got.setdefault(r.k, []).append((r.cells, r.error))
    assert [got[k][0][1] for k in range(6)] == ["not a workbook"] * 3 + ["the workbook has no sheet", "xl/workbook.xml is damaged", "the workbook is too large when unpacked"]
    assert got[6] == [(["a"], None), (["", "b"], None)]
    assert [workbooks.column_index(x) for x in ("A1", "Z2", "AA3", "", "9")] == [0, 25, 26, 0, 0]


def test_events_over_chunk_borders():
    whole = ": c\r\nevent: x\r\ndata: a\r\ndata:b\r\n\r\ndata\n\ndata: [DONE]\n\n"
    for size in range(1, len(whole) + 1):
        rest, lines, events = "", [], []
        for i in range(0, len(whole), size):
            rest, lines, more = answers.feed(rest, lines, whole[i : i + size])
            events += more
        assert (rest, lines, events) == ("", [], ["a\nb", "", "[DONE]"])
    assert [answers.delta(e) for e in ('{"choices":[{"delta":{"content":"x"}}]}', '{"choices":[]}', "{", '{"choices":[{"message":{"content":"m"}}]}', "[]")] == ["x", "", "", "m", ""]


def test_frames_of_any_depth_and_cycles(spark):
    chain = [(1, k, k - 1, "u") for k in range(1, 201)]
    cycle = [(2, 1, 2, "a"), (2, 2, 1, "b"), (2, 3, 2, "c"), (2, 4, 9, "d"), (3, 1, None, "e")]
    got = {(r.page_id, r.frame_id): r.path for r in matching.frame_paths(spark.createDataFrame(chain + cycle, "page_id int, frame_id int, parent_frame_id int, url string")).collect()}
    assert got[1, 200] == " > ".join(["u#0"] * 200)
    assert (got[2, 1], got[2, 2], got[2, 3], got[2, 4], got[3, 1]) == (None, None, None, "d#0", "e#0")


def test_derived_columns_without_rows_or_columns(spark):
    none = spark.createDataFrame([], "table string, row_pos int, cells array<string>")
    some = spark.createDataFrame([("t", 1, ["a", "b"]), ("t", 2, ["a"]), ("t", 3, None)], none.schema)
    tables_ = spark.createDataFrame([("t", ["H", "I"])], "table string, headers array<string>")
    cache = spark.createDataFrame([], "analysis string, fingerprint string, conclusion string, created_at long")
    definition = [("x", "t", [("H", 1)], None, 5, "D", "at-column", 0), ("y", "t", [("nope", 1)], "m", 5, "D", "before-first-selected-column", -1)]
    kinds = "analysis string, table string, selected array<struct<header:string,occurrence:int>>, method string, max_chars int, column_name string, position string, position_index int"
    definitions = spark.createDataFrame(definition, kinds)

    def scorer(asked):
        said = F.transform("rows", lambda r: F.struct(r["fingerprint"].alias("fingerprint"), F.lit("  seven ").alias("conclusion"), F.lit(True).alias("needsAttention")))
        return asked.select("batch", F.to_json(F.struct(said.alias("results"))).alias("answer"))

    found, new = derive.derive_column(definitions, tables_, some, cache, scorer, now=10**9)
    got = {(r.analysis, r.row_pos): (r.status, r.conclusion, r.cells) for r in found.collect()}
    assert got["x", 1] == ("complete", "seven", ["seven", "a", "b"]) and got["x", 2] == ("complete", "seven", ["seven", "a", ""])
    assert got["y", 1][:2] == ("missing-column", None)
    assert {r.conclusion for r in new.collect()} == {"seven"}
    assert derive.derive_column(definitions, tables_, none, cache, scorer, now=10**9)[0].count() == 0


def test_batches_keep_to_their_budgets(spark):
    rows_ = [("a", f"{k:03d}", "x" * (k % 50 * 20), k, 60, 4) for k in range(300)]
    frame = spark.createDataFrame(rows_, "analysis string, fingerprint string, content string, first int, budget int, most int")
    got = derive.batches(frame, "analysis", ["first"], shards=3).withColumn("cost", derive.row_cost(F.col("fingerprint"), F.col("content"))).groupBy("batch").agg(F.count("*").alias("n"), F.sum("cost").alias("c")).collect()
    assert sum(r.n for r in got) == 300 and all(r.n <= 4 and (r.c <= 60 or r.n == 1) for r in got) and max(r.n for r in got) > 1


def test_bindings_on_pages_without_tables(spark):
    kinds = "page_key int, candidate int, headers array<string>, component_type string, container_signature string, title string, selector string, visible boolean"
    shown = spark.createDataFrame([(1, 0, ["A", "B"], "native", None, None, "#t", None)], kinds)
    stored = "binding int, page_key int, headers array<string>, selected array<struct<header:string,occurrence:int>>, derived boolean, component_type string, container_signature string, title string, selector string, stable boolean, table_index int"
    bound = spark.createDataFrame([(1, 1, ["a", "b "], None, None, None, None, None, None, None, None), (2, 2, ["a"], None, None, None, None, None, None, None, None), (3, 1, ["z"], None, None, None, None, None, None, None, 7)], stored)
    got = {r.binding: (r.status, r.candidate) for r in binding.match_sources(bound, shown).collect()}
    assert got == {1: ("available", 0), 2: ("missing", None), 3: ("missing", None)}


def test_readiness_by_a_plain_loop(spark):
    import random

    rnd = random.Random(3)
    polls = [(k, t, t * 700, rnd.choice([0, 2, 2, 2]), rnd.choice("aab"), rnd.random() < 0.1) for k in range(60) for t in range(25)]
    want = {}
    for k in range(60):
        last, n = None, 0
        for _, t, elapsed, count, text, loading in (p for p in polls if p[0] == k):
            n = n + 1 if not loading and count > 0 and last == (count, text) else 0
            last = (count, text)
            if n >= 3 and elapsed >= 2000 or elapsed >= 12_000:
                want[k] = (t, not (n >= 3 and elapsed >= 2000))
                break
    frame = spark.createDataFrame(polls, "k int, t int, elapsed int, rows int, content string, loading boolean")
    assert {r.k: (r.t, r.timed_out) for r in store.readiness(frame, "k", ["t"], "rows", "content", "loading", "elapsed").collect()} == want


def test_rows_added_on_pages(spark):
    frame = spark.createDataFrame([("t", 1, "table-row"), ("t", None, "table-row"), ("t", 2, "table-header")], "table_id string, page_index int, kind string")
    assert sorted((r.page_index or 0, r.added) for r in contexts.added_counts(frame).collect()) == [(0, 2), (1, 2)]


@pytest.mark.parametrize("limit", [1, 3])
def test_first_seen_rows(spark, limit):
    frame = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (1, "b", 0), (2, None, 5), (2, None, 4)], "k int, v string, o int")
    got = rows.first_seen(frame, ["k"], F.coalesce("v", F.lit("")), [F.col("o")])
    assert sorted((r.k, r.o) for r in got.collect()) == [(1, 0), (1, 1), (2, 4)]


def test_any_byte_of_a_workbook_may_be_damaged(spark):
    whole = _book({"s": [["a", "b"], ["1", "x" * 40]], "t": [["c"]]})
    files = [whole] + [whole[:i] + bytes([b ^ 0xFF]) + whole[i + 1 :] for i, b in enumerate(whole)] + [whole[:i] for i in range(0, len(whole), 7)]
    frame = spark.createDataFrame(list(enumerate(files)), "k int, content binary")
    found = workbooks.parse_workbooks(frame).groupBy("k").agg(F.count("error").alias("errors"), F.count("*").alias("n")).collect()
    assert len(found) == len(files)  # a file gives rows, or one error
    assert all(r.errors == 0 or r.n == 1 for r in found)
    assert {r.k: (r.errors, r.n) for r in found}[0] == (0, 3)
    assert sum(r.errors for r in found) > len(whole) // 2


DEEP = 10_000


def test_deep_and_broken_pages_beside_good_ones(spark):
    pages = {
        0: "<p>good <b>one</b></p><table><tr><th>h<tr><td>v</table>", 1: "<div>" * DEEP + "deep" + "</div>" * DEEP, 2: "<b>" * DEEP + "open", 3: "<ul><li>" * 1200 + "x",
        4: "<![foo[ x ]]><p>y</p>", 5: "<table><tr><td colspan=²>a<td colspan=99999999999>b</table>", 6: "<p>" + " " * 200_000 + "z</p>", 7: "<blockquote>" * 1200 + "q", 8: None,
        9: "<table><tr><td>" * 300 + "in",
    }
    frame = spark.createDataFrame([(k, "u", h) for k, h in pages.items()], "page_id int, url string, html string")
    md = {r.page_id: r.markdown for r in page_tree.html_markdown(frame.select("page_id", "html")).collect()}
    assert md[0] == "good **one**\n\n| h |\n| --- |\n| v |" and md[1] == "deep" and md[4] == "y" and md[8] == ""
    assert md[2] == "**" * DEEP + "open" + "**" * DEEP and md[7].count(">") == 1200 and len(md) == len(pages)
    outlines = page_tree.page_outlines(frame).select("page_id", "outline").collect()
    texts = page_tree.page_texts(frame).select("page_id", "text").collect()
    assert len(outlines) == len(texts) == len(pages)
    tables_ = {r.page_id: r.rows for r in page_tree.page_tables(frame).collect() if r.table_index == 0}
    assert tables_[0] == [["v"]] and 5 in tables_
    assert html_tables.extract_table_rows(frame, "page_id").where("page_id = 0").count() == 1
    for read in (page_tree.page_pagers, page_tree.page_tabs):
        assert read(frame).count() >= 0


def test_marks_of_held_code_may_stand_in_the_text():
    md = page_tree.to_markdown
    assert md("<b>0</b> `c` &#57344;0&#57344;") == "**0** `c` 0"


def test_pages_of_any_marks_are_read():
    rnd = random.Random(8)
    bits = ["<table>", "</table>", "<tr>", "<td>", "</td>", "<th scope=col>", "<thead>", "<tfoot>", "<div role=row>", "<i role=gridcell>", "<b role=columnheader>", "</div>", "<caption>", "<li>", "<ul>", "</ul>", "<!--", "-->", "<![CDATA[", "]]>", "<!x", "<?p", "&#0;", "&#x110000;", "<a href=", ">", "t", "`", "<select><option>", "<td colspan=0 style='display:none'>", "<div class='ant-pagination'><li class=active>1", "<script>", "</script>", "<div class='_jt_row _jt_rh'>", "<div id=_jt_body>", "<div id=_jt_row_head>", "<svg/>", "\0"]
    for _ in range(1500):
        html = "".join(rnd.choices(bits, k=rnd.randrange(30)))
        page_tree.to_markdown(html)
        tables(html)
        html_tables._Tables().feed(html)


def test_a_folder_of_workbooks_as_a_source(spark, tmp_path):
    (tmp_path / "in").mkdir()
    whole = _book({"s": [["a", "b"], ["1", "x" * 40]], "t": [["c"]]})
    for k in range(12):
        (tmp_path / f"{k}.xlsx").write_bytes(whole)
        (tmp_path / "in" / f"bad{k}.XLSX").write_bytes(whole[: 40 * k] + b"?" * 9 + whole[40 * k + 9 :])
    (tmp_path / "note.txt").write_text("no workbook")
    (tmp_path / "large.xlsx").write_bytes(b"0" * (workbooks.MAX_FILE + 1))
    workbook_source.register(spark)
    read = spark.read.format("workbooks").option("partitionBytes", 1 << 20).load(str(tmp_path))
    assert read.rdd.getNumPartitions() > 3
    name = F.regexp_replace("path", "^(file:)?/+", "")
    want = workbooks.read_workbooks(spark, [f"{tmp_path}/*.xlsx", f"{tmp_path}/in/*"])
    text = lambda df: sorted(map(str, df.withColumn("path", name).select(*read.columns).collect()))
    assert text(read) == text(want)
    assert read.where("error is not null").count() >= 10 and read.where("path like '%/3.xlsx' and error is null").count() == 3
    with pytest.raises(Exception, match="which folder"):
        spark.read.format("workbooks").load().count()
    (tmp_path / "none").mkdir()
    assert spark.read.format("workbooks").load(str(tmp_path / "none")).count() == 0


def flat(root):
    out, todo = [], [(root, 0)]
    while todo:
        part, depth = todo.pop()
        if isinstance(part, str):
            out.append((depth, part))
        else:
            out.append((depth, part.tag, part.attrs, part.number, part.classes, part.role, [n.number for n in part.walk()]))
            todo += [(p, depth + 1) for p in part.parts[::-1]]
    return out


def test_plain_pages_have_the_trees_of_the_library():
    rnd, plain = random.Random(4), 0
    bits = ["<table class='a b'>", "</table>", "<tr>", "<td COLSPAN=2>", "</td>", "<thead>", "<p>", "<li>", "<ul>", "<br>", "<input disabled>", "</div>", '<div role="row" a:b.c=\'d e\'>', "<A href=http://x/>", "t &amp; u", "&lt", " ", "<script>a<b&amp;</script>", "<title>x&#32;</title>", "<iframe></iframe>"]
    odd = ["<", "&", "<b/>", "<!--x-->", "<b a='&amp;'>", "<b a=b'c>", "<b a='x", "</ b>", "<title><b>", "<script></b>", "<b\x1ca=b>", "<é>"]
    for k in range(3000):
        html = "".join(rnd.choices(bits + (odd if k % 3 == 0 else []), k=rnd.randrange(25)))
        library = page_tree._Builder()
        library.feed(html)
        library.close()
        want, got = flat(library.tree.done()), page_tree._parse_plain(html)
        assert flat(page_tree.parse(html)) == want, html
        assert got is None or flat(got) == want, html
        plain += got is not None
        assert got is not None or k % 3 == 0, html
    assert plain > 2000


def calls(work):
    watch = cProfile.Profile()
    watch.runcall(work)
    return sum(e.callcount for e in watch.getstats())


def test_a_page_of_rows_takes_few_calls():
    """A thousand rows of three cells: what reading them costs is told by calls, which don't depend on the machine."""
    html = "<body><div class=ant-table-wrapper><table><thead><tr><th>a<th>b<th>c<tbody>" + "<tr class=ant-table-row><td>1</td><td>2</td><td><b>3</b></td></tr>" * 1000 + "</table></div>"
    assert tables(html) == [("ant", ["a", "b", "c"], [["1", "2", "3"]] * 1000)]
    assert calls(lambda: page_tree.parse(html)) < 120_000  # 309,000 through the library
    assert calls(lambda: tables(html)) < 300_000  # 770,000 before


def test_tables_are_read_once_to_swap_their_bodies(spark, sf):
    from pagerows.plans.page_queries import swap_bodies

    assert swap_bodies(spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_bodies_by_headers_and_nearness(spark):
    kinds = "k int, table_index int, headers array<string>, rows array<array<string>>, ancestors array<int>"
    full, none = [["x"]], []
    frame = spark.createDataFrame(
        [
            (1, 0, ["A", "B"], none, [3, 2, 1]), (1, 1, ["a", " b", "c"], full, [9, 8, 1]), (1, 2, ["B", "A"], full, [4, 2, 1]), (1, 3, ["A"], none, [7, 6, 1]),  # the nearer of two that fit
            (2, 0, [f"h{i}" for i in range(10)], none, [1]), (2, 1, [f"h{i}" for i in range(9)], full, [2]), (2, 2, [f"h{i}" for i in range(8)], full * 5, [3]),  # 0.9 is enough
            (6, 0, [f"h{i}" for i in range(10)], none, [1]), (6, 1, [f"h{i}" for i in range(9)], full, [2]), (6, 2, [f"h{i}" for i in range(8)], full, [1]),  # the nearer has too few
            (3, 0, ["A", "B"], none, [2, 1]), (3, 1, ["A"], full, [3, 1]), (4, 0, [], none, [1]), (4, 1, ["q"], full, [2]), (5, 0, ["A"], none, [1]),  # none fits; no headers fit any
            (None, 0, ["A"], none, [1]), (None, 1, ["A"], full, [1]),
        ],
        kinds,
    )
    got = {(r.k, r.table_index): r.body_index for r in page_tree.swap_bodies(frame, "k").collect()}
    assert got == {(1, 0): 2, (1, 1): 1, (1, 2): 2, (1, 3): 1, (2, 0): 1, (2, 1): 1, (2, 2): 2, (3, 0): 0, (3, 1): 1, (4, 0): 1, (4, 1): 1, (5, 0): 0, (6, 0): 0, (6, 1): 1, (6, 2): 2, (None, 0): 0, (None, 1): 1}


def test_tables_are_searched_when_they_are_asked_for():
    """Outlines need the cells of a page, not its tables."""
    asked = []
    page = page_tree.Page(page_tree.parse("<p>a<b>c"), adapters=(page_tree.Adapter("none", lambda n: bool(asked.append(n))),))
    assert not asked
    assert page.tables == page.tables == [] and len(asked) == 2
