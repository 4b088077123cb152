from pagerows.functions import text as tx
from pyspark.sql import functions as F


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_texts(spark):
    assert one(spark, "a\u00a0 b\u200b\n c ", "string", tx.business_text) == "a b c"
    assert one(spark, " a  \n\n\n\nb ", "string", tx.normalize_text) == "a\n\nb"
    assert one(spark, "abcdef", "string", lambda c: tx.truncate_text(c, 4)) == "abcd\n\n[Truncated: 2 chars]"
    assert one(spark, "SKU 信息", "string", tx.norm_header) == "sku信息"
    assert one(spark, "你好abcd", "string", tx.estimate_tokens) == 3
    assert one(spark, None, "string", tx.business_text) == ""


def test_cells(spark):
    assert one(spark, ["a", "", None, "b"], "array<string>", tx.row_text) == "a ||| - ||| - ||| b"
    assert one(spark, ['x"y', "1,2", "z"], "array<string>", tx.csv_row) == '"x""y","1,2",z'
    assert one(spark, ["a|b", "c\nd"], "array<string>", tx.markdown_row) == "| a\\|b | c<br>d |"


def test_page_key(spark):
    assert one(spark, "https://A.example/p/q?x", "string", tx.page_key) == "https://a.example/p/q"
    assert one(spark, "nothing", "string", tx.page_key) == "nothing"
