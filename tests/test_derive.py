"""Derived columns: how their rows are dealt, and what answers of any kind leave."""

import json

import pytest
from pagerows.operators import derive
from pagerows.plans import derive_queries
from pyspark.sql import functions as F


@pytest.fixture
def unsized(spark):
    """As with tables that are too large to be sent to all executors by their size."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_rows_of_few_tables_are_not_dealt_by_table(unsized, sf):
    args = derive_queries._orders(unsized, sf)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(derive.contents(*args)).count("SortMergeJoin [table") == 1  # of definitions and tables
    many = derive.contents(*args, few=False)
    assert plan(many).count("SortMergeJoin [table") == 2
    assert sorted(map(str, many.collect())) == sorted(map(str, derive.contents(*args).collect()))


def test_rows_without_a_column_are_dealt_over_all_tasks(unsized):
    """They have no fingerprint; one value for all of them would make them one task's work."""
    rows = unsized.range(4000).select(F.lit("t").alias("table"), F.col("id").alias("row_pos"), F.array(F.col("id").cast("string")).alias("cells"))
    tables = unsized.createDataFrame([("t", ["H"])], "table string, headers array<string>")
    kinds = "analysis string, table string, selected array<struct<header:string,occurrence:int>>, method string, max_chars int, column_name string, position string, position_index int"
    definitions = unsized.createDataFrame([("x", "t", [("nope", 1)], "m", 5, "D", "at-column", 0)], kinds)
    cache = unsized.createDataFrame([], "analysis string, fingerprint string, conclusion string, created_at long")
    unsized.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found, _ = derive.derive_column(definitions, tables, rows, cache, lambda asked: asked.select("batch", F.lit("").alias("answer")), now=0)
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        unsized.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 4000 and max(sizes) < 2000


def test_answers_of_any_kind(spark):
    """By content: several results for it, blank ones, none, too long ones, results for others; answers that are no JSON."""
    said = {
        "many": [("many", " first ", True), ("many", "second", False)], "blank": [("blank", " ", True), ("blank", "later", True)], "none": [], "long": [("long", "é" * 1500, None)], "other": [("sha256:x", "stray", True), (None, "n", None)],
        "null": [("null", None, True)], "broken": None, "fenced": [("fenced", "f", False)], "silent": None, "twice": [("twice", "one", True)],
    }
    pending = spark.createDataFrame([(f"a{k % 2}", name, "c", k, "m", 1200 if name == "long" else 4, 10_000, 1) for k, name in enumerate(said)], "analysis string, fingerprint string, content string, first int, method string, max_chars int, budget int, most int")
    text = lambda results: json.dumps({"results": [{"fingerprint": f, "conclusion": c, "needsAttention": a} for f, c, a in results]})
    answers = [(n, text(r)) if r is not None else (n, '{"results": [') for n, r in said.items() if n != "silent"] + [("twice", None), ("fenced", " \n")]
    answers = [(n, f"\n```json\n{t}\n```  ") if n == "fenced" and t.strip() else (n, t) for n, t in answers]
    given = spark.createDataFrame(answers, "name string, answer string")
    scorer = lambda asked: asked.select("batch", F.col("rows")[0]["fingerprint"].alias("name")).join(given, "name").select("batch", "answer")
    got = {r.fingerprint: (r.analysis, r.status, r.conclusion, r.truncated, r.needs_attention) for r in derive.score_rows(pending, scorer, 0, shards=3).collect()}
    assert got == {
        "many": ("a0", "ok", "firs", True, True), "blank": ("a1", "blank", None, None, False), "none": ("a0", "missing", None, None, False), "long": ("a1", "ok", "é" * 1000, True, False), "other": ("a0", "missing", None, None, False),
        "null": ("a1", "blank", None, None, False), "broken": ("a0", "missing", None, None, False), "fenced": ("a1", "ok", "f", False, False), "silent": ("a0", "missing", None, None, False), "twice": ("a1", "ok", "one", False, True),
    }


def test_a_scorer_is_asked_once_for_each_attempt(spark, sf):
    asked = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            asked.add(batch.num_rows)
            yield batch

    scorer = lambda frame: derive_queries.rule_scorer(frame).mapInArrow(counted, "batch string, answer string")
    found, new = derive.derive_column(*derive_queries._orders(spark, sf), derive_queries._cache(spark, sf), scorer, derive_queries._NOW)
    before = asked.value
    assert before > 0 and found.count() == 2 * spark.read.parquet(f"{sf}/orders.parquet").count() and new.count() > 0
    assert asked.value == before  # by then its answers are written
