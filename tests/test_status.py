"""Small cases of source states, deletions, the catalog's fold and stateful streams."""

from pagerows.operators import status


def test_no_state_means_checking(spark):
    rows = [(1, 0, "a", None), (1, 1, "b", "missing"), (1, 2, "c", "available"), (2, 0, "d", "deferred")]
    got = status.recovery_status(spark.createDataFrame(rows, "k int, n int, name string, status string"), "k", "n", "name").collect()
    assert [tuple(r) for r in got] == [(1, "missing", "校验中、数据源失效", "a、b")]


def test_deleting_headers_and_last_rows(spark):
    rows = [("s", "H1", "table-header", None), ("s", "R1", "table-row", "H1"), ("s", "R2", "table-row", "H1"), ("s", "H2", "table-header", None), ("s", "R3", "table-row", "H2"), ("s", "H3", "table-header", None)]
    contexts = spark.createDataFrame(rows, "session string, ref string, kind string, header_ref string")

    def left(*gone):
        refs = spark.createDataFrame([("s", g) for g in gone], "session string, ref string")
        return sorted(r["ref"] for r in status.delete_contexts(contexts, refs).collect())

    assert left("H1") == ["H2", "H3", "R3"]
    assert left("R3") == ["H1", "H3", "R1", "R2"]
    assert left("R1") == ["H1", "H2", "H3", "R2", "R3"]
    assert left() == ["H1", "H2", "H3", "R1", "R2", "R3"]
