"""Contexts of sessions: where they stand, and the text of their blocks."""

import random

from pagerows.operators import folds, prompts
from pagerows.plans.prompt_queries import context_block
from pyspark.sql import functions as F


def test_contexts_are_dealt_twice_for_their_blocks(spark, sf):
    """Once to be placed, once for the text of a session; tables weren't read for counts, headers and numbers again."""
    plan = context_block(spark, sf)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange ") == plan.count("REPARTITION_BY") == 2 and plan.count("FileScan") == 2


def _contexts(spark, n=400):
    rnd = random.Random(6)
    pick = lambda *of: rnd.choice(of)
    rows = [
        (rnd.randrange(6), pick("table-header", "table-row", "table-row", "snippet", None), pick(None, "", "H1", "H2", "H3"), pick(None, "", "T1", "T2"), pick(None, "", "H1", "H2", "H9"), k, pick(None, 1, 2, 3))
        for k in rnd.sample(range(10_000), n)
    ]
    return spark.createDataFrame(rows, "session int, kind string, ref string, table_id string, header_ref string, seq int, created_at int")


def test_placed_contexts_have_their_groups_and_numbers(spark):
    contexts = _contexts(spark)
    for parts in (None, 3):
        got = folds.place_contexts(contexts, parts=parts)
        grouped = folds.assign_groups(contexts)
        numbers = folds.number_tables(grouped).select("session", "group_id", "table_number")
        want = grouped.join(numbers, ["session", "group_id"]).select(got.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_blocks_by_a_plain_loop(spark):
    rnd = random.Random(2)
    pick = lambda *of: rnd.choice(of)
    rows = []
    for seq in rnd.sample(range(10_000), 300):
        group = pick(None, "a", "b", "c", "d")
        number = {"a": 1, "b": 2, "c": 2, "d": 3}.get(group)
        number = 9 if group == "d" and seq % 2 else number  # of one group, with two numbers
        rows.append((rnd.randrange(5), seq, pick("table-header", "table-row", "table-row", "snippet", "image", None), group, number, pick(None, "", "r"), f"k{seq % 7} ||| v ||| ", pick(None, "t"), "u", pick(None, 0, 3), 4))
    rows.append((7, 1, "snippet", None, None, None, "s", None, None, None, None))
    columns = ["session", "seq", "kind", "group_id", "table_number", "ref", "text", "title", "url", "first_line", "last_line"]
    frame = spark.createDataFrame(rows, "session int, seq int, kind string, group_id string, table_number int, ref string, text string, title string, url string, first_line int, last_line int")

    def line(r, headed):
        lines = f" | L{r['first_line']}-{r['last_line']}" if r["first_line"] else ""
        text = r["text"] if headed or r["kind"] != "table-row" else "\n".join(f"  [列{i}] {t}" for i, t in enumerate(r["text"].split(" ||| "), 1))
        return f"[[{r['ref'] or 'CTX?'}]] {r['kind'].upper()}{lines} | {r['title'] or '(no title)'} | {r['url'] or ''}\n{text}"

    for compact in (False, True):
        want = {}
        for session in {r[0] for r in rows}:
            mine = sorted((dict(zip(columns, r)) for r in rows if r[0] == session and r[2] is not None), key=lambda r: r["seq"])
            heads = {r["group_id"]: r for r in mine if r["kind"] == "table-header" and r["group_id"]}  # the last one stays
            held, loose = {}, []
            for r in mine:
                if r["kind"] not in ("table-header", "table-row"):
                    loose.append(r["text"] if compact else line(r, True))
                elif r["kind"] == "table-row" or heads.get(r["group_id"]) is r:
                    head = heads.get(r["group_id"])
                    held.setdefault((r["table_number"], head and head["text"]), []).append((r["kind"] != "table-header", r["seq"], r["text"] if compact else line(r, head is not None)))
            texts = []
            if held:
                label = lambda n, h: f"[TABLE {n} - Columns: {h}]" if h is not None else f"[TABLE {n} - (无列名，每行按 ||| 分隔列，列序号已标注)]"
                chunks = sorted((-n, f"{label(n, h)}\n" + "\n\n".join(x[2] for x in sorted(held[n, h]))) for n, h in held if n is not None)
                texts.append(prompts._TABLES[0] + str(len(held)) + prompts._TABLES[1] + prompts.BREAK.join(t for _, t in chunks))
            if loose:
                texts.append(prompts._SNIPPETS + prompts.BREAK.join(loose))
            want[session] = prompts.BREAK.join(texts)
        got = {r.session: r.block for r in prompts.context_block(frame, compact, parts=2 if compact else None).collect()}
        assert got == want


def test_partitions_grow_with_tables(spark, sf, tmp_path):
    from pagerows.plans.registry import growing_parts

    spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("t")).repartition(40).write.parquet(f"{tmp_path}/wide.parquet")
    spark.range(9).write.parquet(f"{tmp_path}/thin.parquet")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert growing_parts(spark, str(tmp_path), "wide") >= 4 * 13 > growing_parts(spark, str(tmp_path), "thin") >= 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
