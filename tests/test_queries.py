"""Every registered query of the reference's operators against its SQL."""

import os
import random
import re
import subprocess
import sys

import duckdb
import pytest
from pagerows.operators import rows
from pagerows.plans import queries as plans
from verify import TABLES, canonical

NAMES = sorted(plans.oracle_sql())


@pytest.fixture(scope="module")
def db(sf):
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return found


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, db, name):
    got, want = plans.queries()[name](spark, sf).toPandas(), db.execute(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_few_queries_lack_sql():
    assert set(plans.queries()) - set(NAMES) == {"ex17_pages_markdown"}  # held against a plain reading in test_pages


def test_entry_imports_without_the_optional_part():
    """In a process of its own, in which neither the operators nor the pipeline can be imported."""
    code = """
import importlib.abc, sys
class Block(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == 'pagerows.llm' or name.startswith('pagerows.llm.') or name == 'corpus_pipeline':
            raise ImportError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as entry
names = set(entry.queries())
assert names and set(entry.oracle_sql()) <= names
assert not any(n == 'pipeline' or n.startswith('op') for n in names), names
assert not any(m.startswith('pagerows.llm') for m in sys.modules)
print(len(names))
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) == len(plans.queries())


def test_recent_rounds_against_a_backward_scan(spark):
    rnd, convs = random.Random(5), {}
    texts = ["hi", "", " \n\u00a0", "请求失败：x", " 请求失败：y", None, "a" * 2600, "é😀" * 900]
    for k in range(300):
        convs[k] = [(rnd.choices(["user", "assistant", "system"], [5, 5, 1])[0], rnd.choices(texts, [9, 1, 1, 1, 1, 1, 3, 3])[0], rnd.choice([None, False, False, True])) for _ in range(rnd.randrange(20))]
    convs[300] = [("user", "a" * 4999, None), ("assistant", "b", None)] * 6  # 15,000 in the last 3
    convs[301] = [("user", "a" * 4999, None)] * 5  # under 15,000

    def normal(t):
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", (t or "").replace("\u00a0", " "))).strip()

    def scan(messages):
        m = [(i, r, t) for i, (r, t, own) in enumerate(messages) if not own and normal(t) and not normal(t).startswith("请求失败：")]
        rounds, i = [], len(m) - 1
        while i >= 0:
            pair = m[i][1] == "assistant" and i > 0 and m[i - 1][1] == "user"
            if m[i][1] in ("user", "assistant"):
                rounds.insert(0, m[i - pair : i + 1])
            i -= 1 + pair
        few = sum(len(t.encode("utf-16-le")) // 2 for r in rounds[-3:] for _, _, t in r) < 15_000
        return [i for r in rounds[-5 if few and len(rounds) >= 5 else -3 :] for i, _, _ in r]

    rows_ = [(k, i, *m) for k, c in convs.items() for i, m in enumerate(c)]
    messages = spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string, localOnly boolean")
    got = {k: [] for k in convs}
    for r in rows.recent_rounds(messages, "conv_id", "turn", local="localOnly").orderBy("conv_id", "turn").collect():
        got[r.conv_id].append(r.turn)
    assert got == {k: scan(c) for k, c in convs.items()}
    assert len(got[300]) == 6 and len(got[301]) == 5
