"""Queries of stateful streams in event time: rows come in files of a slice of time each, many a slice late."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import cut, new_folder
from ..streaming import cache, timed
from .fold_queries import _DAY
from .registry import oracle_sql, register, table
from .store_queries import _COLLECT_SQL, _collect_input, _polls, _POLLS_SQL

SLICES = 4
_BASE = 1_700_000_000_000


def _streamed(rows: DataFrame, key: str, ts: str, tie: str, make) -> DataFrame:
    """What the stream that ``make(stream, late)`` builds gives for rows that come in files of one slice of time; each row by
    its hash up to a slice late, in no order within a file. A last file's row, far ahead, lets all timers fire."""
    spark = rows.sparkSession
    timed.use_rocks(spark)
    rows = cut(rows)
    low, high = rows.agg(F.min(ts), F.max(ts)).first()
    low, high = low or 0, high or 0
    width = (high - low) // SLICES + 1
    base, names, files = new_folder(spark, "stream"), rows.columns, spark.sparkContext.defaultParallelism
    late = F.floor((F.col(ts) - low + F.pmod(F.xxhash64(tie), F.lit(width))) / width)
    for k in range(SLICES + 1):
        rows.where(late == k).repartition(files).write.parquet(f"{base}/in/{k}")
    end = {key: F.lit(-1), ts: F.lit(high + 10 * timed.IDLE_MS)}
    rows.sparkSession.range(1).select(*(end.get(c, F.lit(None)).cast(rows.schema[c].dataType).alias(c) for c in names)).write.parquet(f"{base}/in/{SLICES + 1}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in/*")
    made = make(stream, f"{2 * width} milliseconds")
    made.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{base}/rows").where(F.col(key) >= 0)


def _timed_events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts_ms", F.unix_millis(F.col("ts").cast("timestamp")))


@register("st3_rate_guard_stream", oracle_sql()["w16_rate_guard"])
def rate_guard_stream(spark, sf_dir):
    events = _timed_events(spark, sf_dir).select("user_id", "ts_ms", "event_id")
    return _streamed(events, "user_id", "ts_ms", "event_id", lambda s, late: timed.rate_guard(s, "user_id", "ts_ms", "event_id", late, _DAY, 2))


@register("st4_readiness_stream", f"""with {_POLLS_SQL}, s as (select *, coalesce(not loading and rows > 0 and rows = lag(rows) over w and content = lag(content) over w, false) as same from p window w as (partition by user_id order by event_id)),
    i as (select *, sum(case when same then 0 else 1 end) over (partition by user_id order by event_id) as island from s), n as (select *, sum(case when same then 1 else 0 end) over (partition by user_id, island order by event_id) as run from i),
    e as (select *, same and run >= 3 and elapsed >= 2000 as ready from n), f as (select user_id, event_id, rows, not ready as timed_out from e where ready or elapsed >= 12000 qualify row_number() over (partition by user_id order by event_id) = 1)
    select * from f union all select user_id, null, max_by(rows, event_id), true from p where user_id not in (select user_id from f) group by user_id""")
def readiness_stream(spark, sf_dir):
    """As ``w14_readiness``, and tables that are no longer polled time out without a poll."""
    polls = _polls(spark, sf_dir).withColumn("ts_ms", F.lit(_BASE) + F.col("elapsed").cast("bigint"))
    return _streamed(polls, "user_id", "ts_ms", "event_id", lambda s, late: timed.readiness(s, "user_id", "ts_ms", "event_id", "rows", "content", "loading", late))


def _collected(spark, sf_dir) -> DataFrame:
    """The rows of each page, then the page, in one stream: an event a second of each user."""
    shots, pages = _collect_input(spark, sf_dir)
    none = lambda kind: F.lit(None).cast(kind)
    at = lambda last: (F.lit(_BASE) + F.col("event_id") * 2000 + (1000 if last else 0)).alias("ts_ms")
    rows = shots.select("user_id", at(False), (F.col("event_id") * 2).alias("tie"), "page", F.col("sig").alias("signature"), none("boolean").alias("stopped"), none("boolean").alias("is_last"), none("string").alias("outcome"))
    ends = pages.select("user_id", at(True), (F.col("event_id") * 2 + 1).alias("tie"), "page", none("string").alias("signature"), "stopped", "is_last", "outcome")
    return _streamed(rows.unionByName(ends), "user_id", "ts_ms", "tie", lambda s, late: timed.collect(s, "user_id", "ts_ms", "tie", late, 12, 8))


@register("st5_collect_stream", oracle_sql()["job1_collection_rows"])
def collect_stream(spark, sf_dir):
    return _collected(spark, sf_dir).where("phase = 'row'").select("user_id", F.floor(F.col("tie") / 2).alias("event_id"))


@register("st5_collect_progress", f"with {_COLLECT_SQL} select user_id, reason, pages, rows from z")
def collect_progress(spark, sf_dir):
    """How each collection ended."""
    return _collected(spark, sf_dir).where("phase = 'end'").select("user_id", "reason", "pages", "rows")


def _cache_sql(most: int) -> str:
    """A replay: entries in order of age; a miss writes one and drops the oldest beyond ``most``."""
    return f"""with recursive c as (select user_id, event_id, epoch_ms(ts) as t, event_type as fp, row_number() over (partition by user_id order by epoch_ms(ts), event_id) as k from events),
    f as (select distinct user_id, cast(0 as bigint) as k, cast(null as bigint) as event_id, false as hit, cast([] as STRUCT(fp VARCHAR, t BIGINT)[]) as held from c union all
    select user_id, k, event_id, hit, case when hit then held else list_slice(kept, greatest(1, len(kept) - {most - 1}), len(kept)) end from
    (select *, list_filter(held, lambda x: x.fp <> fp) || [struct_pack(fp := fp, t := t)] as kept from
    (select c.*, f.held, len(list_filter(f.held, lambda x: x.fp = c.fp and c.t - x.t <= {3 * _DAY})) > 0 as hit from f join c on c.user_id = f.user_id and c.k = f.k + 1)))
    select user_id, event_id, hit from f where k > 0"""


def _hits(spark, sf_dir, most: int) -> DataFrame:
    events = _timed_events(spark, sf_dir).select("user_id", "ts_ms", "event_id", "event_type")
    return _streamed(events, "user_id", "ts_ms", "event_id", lambda s, late: timed.cache_hits(s, "user_id", "event_type", "ts_ms", "event_id", late, 3 * _DAY, most))


@register("st6_cache_ttl_stream", _cache_sql(2000))
def cache_ttl_stream(spark, sf_dir):
    """A request finds what the same request has left in the cache within three days."""
    return _hits(spark, sf_dir, 2000)


@register("st6_cache_capacity_stream", _cache_sql(2))
def cache_capacity_stream(spark, sf_dir):
    """Of an analysis only the two newest entries stay."""
    return _hits(spark, sf_dir, 2)


@register("st11_results_stream", """select user_id, event_id, coalesce(kind = (select max_by(b.event_type, b.event_id) from events b where b.user_id = a.user_id and b.event_id % 3 = 0 and b.event_id < a.event_id), false) as shown
    from (select *, event_type as kind from events where event_id % 3 > 0) a""")
def results_stream(spark, sf_dir):
    """Every third event opens a session of its user's table; the others are results."""
    n = F.col("event_id")
    events = table(spark, sf_dir, "events").select("user_id", (F.lit(_BASE) + n * 1000).alias("ts_ms"), "event_id", (n % 3 == 0).alias("opens"), F.col("event_type").alias("analysis_fp"))
    return _streamed(events, "user_id", "ts_ms", "event_id", lambda s, late: timed.shown_results(s, "user_id", "ts_ms", "event_id", late))


@register("st7_awaited_responses", """with e as (select user_id, event_type, event_id, ts, date_trunc('day', ts) as day from events), r as (select user_id, event_type, day, min(ts) + interval 6 hour as done, min(event_id) as answer from e group by all)
    select e.event_id, r.answer from e left join r on r.user_id = e.user_id and r.event_type = e.event_type and r.day = e.day and r.done >= e.ts and r.done <= e.ts + interval 6 hour""")
def awaited_responses(spark, sf_dir):
    """The first request of a user, type and day is answered six hours later; all who ask until then share the answer."""
    base = new_folder(spark, "awaited")
    asked = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("day", F.to_date("ts"))
    given = asked.groupBy("user_id", "event_type", "day").agg((F.min("ts") + F.expr("interval 6 hours")).alias("ts"), F.min("event_id").alias("answer"))
    high = asked.agg(F.max("ts")).first()[0]
    ahead = lambda df: spark.range(1).select(*((F.lit(high) + F.expr("interval 90 days") if c == "ts" else F.lit(-1 if c == "user_id" else None)).cast(k).alias(c) for c, k in df.dtypes))
    streams = []
    for name, rows in (("asked", asked), ("given", given)):
        rows.write.parquet(f"{base}/{name}/0")
        if high is not None:
            ahead(rows).write.parquet(f"{base}/{name}/1")
        streams.append(spark.readStream.schema(rows.schema).parquet(f"{base}/{name}/*"))
    timed.use_rocks(spark)
    made = cache.awaited(*streams, ["user_id", "event_type", "day"], "ts", "answer", "40 days", "6 hours")
    made.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{base}/rows").where("user_id >= 0").select("event_id", "answer")


@register("snk5_merged_cache", """with r as (select user_id, event_type, props, epoch_ms(ts) as created_at, event_id from events where trim(coalesce(props, '')) <> '' qualify row_number() over (partition by user_id, event_type, props order by epoch_ms(ts) desc, event_id desc) = 1)
    select user_id, event_type, props as conclusion, event_id from r qualify row_number() over (partition by user_id order by created_at desc, event_id desc) <= 7""")
def merged_cache(spark, sf_dir):
    """Results come as a stream in four batches of time, each merged into the files of the buckets that it meets."""
    base = new_folder(spark, "merged")
    events = _timed_events(spark, sf_dir).select("user_id", "event_type", F.col("props").alias("conclusion"), F.col("ts_ms").alias("created_at"), "event_id", F.col("props").alias("row_fp"))
    low, high = events.agg(F.min("created_at"), F.max("created_at")).first()
    width = ((high or 0) - (low or 0)) // SLICES + 1
    merge = cache.merge_writer(f"{base}/cache", "user_id", ["event_type", "row_fp"], "created_at", "event_id", most=7)
    for k in range(SLICES):
        events.where(F.floor((F.col("created_at") - (low or 0)) / width) == k).write.parquet(f"{base}/in/{k}")
        stream = spark.readStream.schema(events.schema).parquet(f"{base}/in/*")
        stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{base}/cache").select("user_id", "event_type", "conclusion", "event_id")
