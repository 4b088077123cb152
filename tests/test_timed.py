"""Streams in event time against the batch forms, for files in which rows lie in any order within the watermark."""

import random

import pytest
from pagerows.operators import folds, store
from pagerows.streaming import cache, timed
from pyspark.sql import functions as F

END = 10**12


def streamed(spark, folder, rows, schema, slice_ms, rnd):
    """One file a slice; a row may come a slice late. The last file's row lies far ahead and lets all timers fire."""
    timed.use_rocks(spark)
    names = [c.split()[0] for c in schema.split(", ")]
    at = names.index("ts")
    files = {}
    for r in rows:
        files.setdefault((r[at] + rnd.randrange(slice_ms)) // slice_ms, []).append(r)
    last = [(-1 if n == "key" else END if n == "ts" else None) for n in names]
    for k, part in enumerate([*(files[f] for f in sorted(files)), [tuple(last)]]):
        rnd.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/in/{k:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def rows_of(spark, folder, stream):
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress")
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").where("key >= 0")


@pytest.mark.parametrize("seed", [1, 2])
def test_request_limits(spark, tmp_path, seed):
    rnd = random.Random(seed)
    schema, rows = "key bigint, ts bigint, n bigint", [(k % 3, 1000 + 400 * k + rnd.randrange(300), k) for k in range(60)]
    stream = streamed(spark, str(tmp_path), rows, schema, 8000, rnd)
    got = rows_of(spark, str(tmp_path), timed.rate_guard(stream, "key", "ts", "n", "16 seconds", 6000, 3))
    want = folds.rate_guard(spark.createDataFrame(rows, schema), "key", F.col("ts"), ["ts", "n"], 6000, 3)
    assert sorted((r.key, r.n, r.outcome) for r in got.collect()) == sorted((r.key, r.n, r.outcome) for r in want.collect())


def test_readiness_with_a_time_out(spark, tmp_path):
    rnd = random.Random(3)
    schema, rows = "key bigint, ts bigint, n bigint, shown bigint, content string, loading boolean", []
    for key in range(12):
        for k in range(18 if key < 9 else 5):
            rows.append((key, 5000 + 900 * k, 100 * key + k, 0 if key == 4 else 3 + (k // 4 % 2 if key % 3 else 0), str(k if key % 4 == 3 else k // 6), key == 5 or k % 7 == key))
    stream = streamed(spark, str(tmp_path), rows, schema, 4000, rnd)
    got = {(r.key, r.n, r.rows, r.timed_out) for r in rows_of(spark, str(tmp_path), timed.readiness(stream, "key", "ts", "n", "shown", "content", "loading", "8 seconds")).collect()}
    polls = spark.createDataFrame(rows, schema).withColumn("elapsed", F.col("ts") - 5000)
    want = {(r.key, r.n, r.shown, r.timed_out) for r in store.readiness(polls, "key", ["n"], "shown", "content", "loading", "elapsed").collect()}
    silent = {r for r in got if r[1] is None}
    assert got - silent == want and {r[0] for r in silent} == set(range(12)) - {r[0] for r in want} and all(r[3] for r in silent) and silent
    assert {r[3] for r in want} == {True, False}


def test_collections_end_once(spark, tmp_path):
    rnd = random.Random(5)
    schema = "key bigint, ts bigint, n bigint, page bigint, signature string, stopped boolean, is_last boolean, outcome string"
    rows, n = [], 0
    for key in range(10):
        for page in range(1, 7):
            for _ in range(rnd.randrange(1, 6)):
                n += 1
                rows.append((key, 1000 * page + n % 500, n, page, f"r{rnd.randrange(14)}", None, None, None))
            n += 1
            rows.append((key, 1000 * page + 900, n, page, None, key == 1 and page == 2, key == 2 and page == 3, "page-timeout" if key == 3 and page == 2 else "x"))
    shots = spark.createDataFrame([r for r in rows if r[4] is not None], schema)
    pages = spark.createDataFrame([r for r in rows if r[4] is None], schema)
    for most, last in ((1000, 30), (9, 30), (1000, 4)):
        folder = f"{tmp_path}/{most}-{last}"
        stream = streamed(spark, folder, list(rows), schema, 1500, rnd)
        got = rows_of(spark, folder, timed.collect(stream, "key", "ts", "n", "3 seconds", most, last)).cache()
        kept, ends = store.collect(shots, pages, "key", F.col("signature"), [F.col("ts"), F.col("n")], max_rows=most, max_pages=last)
        assert sorted(r.tie for r in got.where("phase = 'row'").collect()) == sorted(r.n for r in kept.collect())
        assert sorted((r.key, r.reason, r.pages, r.rows) for r in got.where("phase = 'end'").collect()) == sorted((r.key, r.reason, r.pages, r.rows) for r in ends.collect())


def test_cache_hits_against_a_replay(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(k % 2, 1000 + 100 * k, k, f"f{rnd.randrange(9)}") for k in range(200)]
    schema = "key bigint, ts bigint, n bigint, fp string"
    stream = streamed(spark, str(tmp_path), list(rows), schema, 5000, rnd)
    got = {r.n: r.hit for r in rows_of(spark, str(tmp_path), timed.cache_hits(stream, "key", "fp", "ts", "n", "10 seconds", 1500, 4)).collect()}
    held, want = {0: [], 1: []}, {}
    for key, ts, n, fp in rows:
        own = held[key]
        want[n] = any(f == fp and ts - t <= 1500 for f, t in own)
        if not want[n]:
            held[key] = sorted([(f, t) for f, t in own if f != fp] + [(fp, ts)], key=lambda e: e[1])[-4:]
    assert got == want and {True, False} == set(want.values())


def test_results_of_sessions(spark, tmp_path):
    rnd = random.Random(7)
    rows = [(k % 3, 1000 + 100 * k, k, rnd.random() < 0.3, f"a{rnd.randrange(3)}") for k in range(120)]
    schema = "key bigint, ts bigint, n bigint, opens boolean, analysis_fp string"
    stream = streamed(spark, str(tmp_path), list(rows), schema, 3000, rnd)
    got = {r.n: r.shown for r in rows_of(spark, str(tmp_path), timed.shown_results(stream, "key", "ts", "n", "6 seconds")).collect()}
    now, want = {}, {}
    for key, _, n, opens, a in rows:
        if opens:
            now[key] = a
        else:
            want[n] = now.get(key) == a
    assert got == want


def test_a_batch_merged_twice_leaves_the_same_cache(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(k % 5, f"r{rnd.randrange(6)}", f"c{k}" if k % 7 else " ", k, k) for k in range(120)]
    frames = [spark.createDataFrame(rows[i : i + 40], "analysis bigint, fp string, conclusion string, created bigint, n bigint") for i in (0, 40, 80)]
    want = cache.upsert_cache(frames[0].limit(0), frames[0].union(frames[1]).union(frames[2]), "analysis", ["fp"], "created", "n", 4)
    merge = cache.merge_writer(f"{tmp_path}/cache", "analysis", ["fp"], "created", "n", 4, buckets=3)
    for k, f in enumerate([frames[0], frames[0], frames[1], frames[1].limit(0), frames[2], frames[2]]):
        merge(f, k)
        merge(f, k)
    got = spark.read.parquet(f"{tmp_path}/cache")
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect())) and got.count() == 20


def test_all_who_wait_get_the_one_response(spark, tmp_path):
    timed.use_rocks(spark)
    at = lambda s: F.timestamp_seconds(s)
    asked = [(1, 100, 1), (1, 105, 2), (2, 100, 3), (1, 300, 4), (None, 100, 5), (9, 10_000, 6)]
    given = [(1, 110, "a"), (None, 100, "n"), (2, 99, "early"), (9, 20_000, "late")]
    spark.createDataFrame(asked, "k bigint, s bigint, n bigint").withColumn("ts", at("s")).write.parquet(f"{tmp_path}/asked")
    spark.createDataFrame(given, "k bigint, s bigint, answer string").withColumn("ts", at("s")).write.parquet(f"{tmp_path}/given")
    streams = [spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{x}").schema).parquet(f"{tmp_path}/{x}") for x in ("asked", "given")]
    made = cache.awaited(*(s.drop("s") for s in streams), ["k"], "ts", "answer", "1 minute", "20 seconds")
    made.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/p").trigger(availableNow=True).start().awaitTermination()
    assert {r.n: r.answer for r in spark.read.parquet(f"{tmp_path}/out").where("k is null or k < 9").collect()} == {1: "a", 2: "a", 3: None, 4: None, 5: "n"}
