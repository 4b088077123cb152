"""Periodic runs, Merkle manifests and mixing against brute force, SQL and edge rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pagerows.llm import base, manifest, mixing, periodic, queries
from pyspark.sql import functions as F

SQL = queries.oracle_sql()
ODD = [None, "", " \t\n", "a", "a " * 30, "x y\nz " * 40, "a b " * 40, "é ñ " * 30, "\x1f \x0b\x0c" * 30, "w " * 23, "w " * 24]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 3 == 0 else f"s{i % 2}", "en" if i % 4 else None, None if i == 2 else 7, "x") for i, t in enumerate(ODD)]
    rows += [(None, "null id " * 20, "s0", "en", 1, "y"), (4, ODD[4], "s0", "en", 7, "z"), (4, ODD[4], "s0", "en", 7, "z")]  # repeated ids and rows
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_chars bigint, n_runs string")


def runs_of(words):
    """All runs by comparing all words q apart, for each q."""
    found, n = {}, len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)  # the least q first
            i = max(i + 1, j)
    return sorted((s, n, q) for (s, n), q in found.items())


def report(doc_id, text, order):
    words = (text or "").encode().split()
    way = order(doc_id, len(words)) if order else None
    words = words if way is None else [words[i] for i in way]
    runs = sorted(runs_of(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def rows_of(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_periodic_runs_by_brute_force(spark, odd):
    rnd, texts = random.Random(2), []
    for k in range(160):
        n = rnd.choice([5, 30, 80, 300, 700])
        w = [f"w{rnd.randrange(rnd.choice([1, 2, 3, 40]))}" for _ in range(n)]
        for _ in range(rnd.randrange(4)):
            a = rnd.randrange(n)
            p, e = rnd.randrange(1, max(2, (n - a) // 3 + 1)), rnd.randrange(a, n)
            for i in range(a + p, e):
                w[i] = w[i - p]
        texts.append((1000 + k, " ".join(w)))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").unionByName(odd.select("doc_id", "text"))
    for order in (None, queries.planted_order):
        got = periodic.periodic_runs(docs, order)
        assert got.schema.simpleString() == "struct<" + ",".join(f.replace(" ", ":") for f in periodic.RESULT.split(", ")) + ">"
        assert rows_of(got) == sorted(str(report(r.doc_id, r.text, order)) for r in docs.collect())
    assert periodic.periodic_runs(odd).count() == odd.count()  # another column of a result's name is ignored
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_periodic_runs_of_very_long_texts(spark):
    """One word 300,000 times; a period of 70,001 words four times; no repetition in 200,000 words."""
    rnd = random.Random(3)
    block = [f"v{rnd.randrange(1 << 40)}" for _ in range(70_001)]
    texts = [(1, "a " * 300_000), (2, " ".join(["b", *block * 4, *block[:9]])), (3, " ".join(f"u{i}" for i in range(200_000)))]
    got = {r.doc_id: r for r in periodic.periodic_runs(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert (got[1].n_runs, got[1].start, got[1].length, got[1].period, got[1].exponent_milli) == (1, 0, 300_000, 1, 300_000_000)
    assert got[1].collapsed_sha256 == hashlib.sha256(b"a").hexdigest()
    assert (got[2].n_runs, got[2].start, got[2].length, got[2].period) == (1, 1, 4 * 70_001 + 9, 70_001)
    assert got[2].collapsed_sha256 == hashlib.sha256(" ".join(["b", *block]).encode()).hexdigest()
    assert got[3].n_runs == 0


def merkle(rows):
    """Trees of lists: per source, then over the sources."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(field, (r.doc_id, r.source, r.lang, r.n_chars, text))))

    def tree(leaves):
        """The root, and for each leaf its siblings level by level, as (left, right)."""
        paths, owners, now = [[] for _ in leaves], [[i] for i in range(len(leaves))], leaves
        while len(now) > 1:
            nxt, held = [], []
            for k in range(0, len(now), 3):
                part = now[k : k + 3]
                for j in range(len(part)):
                    for i in owners[k + j]:
                        paths[i].append(("".join(part[:j]), "".join(part[j + 1 :])))
                nxt.append(sha("".join(part)))
                held.append([i for o in owners[k : k + 3] for i in o])
            now, owners = nxt, held
        return now[0], paths

    groups = defaultdict(list)
    for r in rows:
        even = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
        groups[r.source].append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), leaf(r, r.text.replace("\n", "") if even and r.text is not None else r.text), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names]
    root, upper = tree([t[0] for t in trees])
    out = []
    for s, (sub, paths), above in zip(names, trees, upper):
        for x, path in zip(sorted(groups[s], key=lambda x: x[:3]), paths):
            folded = x[3]
            for left, right in path + above:
                folded = sha(left + folded + right)
            out.append((x[4].doc_id, x[2], sub, root, sha("".join(a + b for a, b in path + above)), folded, folded == root))
    return sorted(map(str, out))


def tampered():
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return {"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def test_manifest_by_brute_force(spark, odd):
    rnd = random.Random(4)
    rows = [(k, f"t{k % 7}\n", None if k % 11 == 0 else "hot" if k % 3 else f"s{rnd.randrange(90)}", "en", k) for k in range(1000)]
    many = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_chars bigint").repartition(7)
    for docs in (many, odd, odd.where("doc_id = 1"), odd.where("source is null")):  # bands of several levels; odd rows; one leaf; one tree
        assert rows_of(manifest.manifest(docs, COLUMNS, altered=tampered())) == merkle(docs.collect())
    assert manifest.manifest(odd, COLUMNS).where("not verified").count() == 0
    assert manifest.manifest(odd.limit(0), COLUMNS).count() == 0


def test_ranks_over_ranges(spark):
    rows = [(None if k % 5 == 0 else f"g{k % 3}", k // 2, k) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, a bigint, b bigint").repartition(6)
    got = base.ranked(df, "g", ["a", "b"]).collect()
    for g in {r[0] for r in rows}:
        own = sorted((r.a, r.b, r["rank"], r.n) for r in got if r.g == g)
        assert [r[2] for r in own] == list(range(len(own))) and {r[3] for r in own} == {len(own)}


def test_mixing_equals_its_sql_and_keeps_its_promises(spark, odd):
    rnd = random.Random(6)
    rows = [(k, "w " * rnd.choice([0, 1, 3, 10, 40, 41, 900]), None if k % 13 == 0 else "hot" if k % 3 else f"s{rnd.randrange(8)}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    got = mixing.mix(docs).cache()
    documents = docs.toPandas()  # noqa: F841 (DuckDB reads it by name)
    want = duckdb.sql(SQL["op13_source_mixing"]).fetchall()
    assert sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in got.collect()) == sorted(want)
    assert rows_of(mixing.mix(docs)) == rows_of(got)
    sums = got.join(docs, "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("source_size").alias("s"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    assert all(abs(r.t - r.g) < 900 and abs(r.t - r.g) < 0.02 * r.g + 3 and r.over <= 0 for r in sums)
    assert abs(sum(r.g for r in sums) - 1.5 * sum(r.s for r in sums)) < 1e-6
    took = {r.doc_id: r.taken / r["size"] for r in got.collect() if r["size"]}
    assert set(took.values()) <= {0, 1, 2}
    # inclusion probabilities are unequal: a longer document of a source is likelier to be taken
    mean = lambda low, high: (lambda x: sum(x) / len(x))([took[k] for k, t, s in rows if s == "hot" and low <= len(t) / 2 <= high])
    assert mean(900, 900) > mean(10, 10) > mean(1, 1)


def test_mixing_of_odd_rows(spark, odd):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert {r.target for r in mixing.mix(odd.where("doc_id < 3")).collect()} == {0.0}  # no words
    assert mixing.mix(odd.limit(0)).count() == 0
    same = spark.createDataFrame([(None, "a b c", "s")] * 500 + [(7, "a b c", "t")] * 500, "doc_id bigint, text string, source string")
    for r in mixing.mix(same).groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect():
        assert abs(r.t - r.target) <= 3
