"""Streams of model results into a cache, and requests in flight."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..shared import cut


def cache_writer(folder: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch is one folder, written over if the batch is repeated, so a restart leaves no
    entry twice. Entries without a conclusion are left out."""

    def write(batch: DataFrame, number: int) -> None:
        batch.where(F.trim(F.coalesce("conclusion", F.lit(""))) != "").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def cache_latest(cache: DataFrame, keys: list[str], created: str, tie: str) -> DataFrame:
    """The newest entry of each key; a partial aggregate, so a key that is written often is no hot spot."""
    names = [c for c in cache.columns if c not in keys]
    newest = cache.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct(created, tie)).alias("__r"))
    return newest.select(*keys, "__r.*")


def write_cache_stream(results: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """All results there are now, then stop; called again, those that have come since."""
    return results.writeStream.foreachBatch(cache_writer(folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def inflight_dedupe(requests: DataFrame, keys: list[str], ts: str, within: str = "1 minute") -> DataFrame:
    """Requests without those that repeat a key within the time; state older than that is dropped."""
    return requests.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def awaited(requests: DataFrame, responses: DataFrame, keys: list[str], ts: str, answer: str, late: str = "1 minute", most: str = "1 minute") -> DataFrame:
    """Requests with the ``answer`` of the one response that all waiters of their keys share: it comes at a request's time or up
    to ``most`` after it. A request without one has a null answer, once it can no longer come. A key has one response in
    such a span; state on both sides goes as the watermarks pass."""
    asked = requests.withWatermark(ts, late)
    given = responses.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(ts).alias("__ts"), F.col(answer).alias(answer)).withWatermark("__ts", late)
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    within = (F.col("__ts") >= F.col(ts)) & (F.col("__ts") <= F.col(ts) + F.expr(f"interval {most}"))
    for s in same:
        within = within & s
    return asked.join(given, within, "leftOuter").drop("__ts", *(f"__{k}" for k in keys))


BUCKETS = 64


def merge_writer(folder: str, analysis: str, keys: list[str], created: str, tie: str, most: int = 2000, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: merges a batch of results into the cache at ``folder``, whose entries lie in buckets of analyses. Only the
    buckets that a batch meets are read and written over, as one commit; the same batch again changes nothing, so a
    restart in between leaves the same content."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = cut(batch.withColumn("bucket", F.pmod(F.xxhash64(analysis), F.lit(buckets)).cast("int")))
        met = [r.bucket for r in new.select("bucket").distinct().collect()]  # 64 at most
        if not met:
            return
        held = new.limit(0)
        if _exists(spark, folder):
            held = spark.read.schema(new.schema).parquet(folder).where(F.col("bucket").isin(met))
        merged = cut(upsert_cache(held, new, analysis, [*keys, "bucket"], created, tie, most))  # read before it is written over
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)

    return write


def _exists(spark, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def cache_drop(cache: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The cache without the entries of analyses that are gone."""
    return cache.join(gone.select(key).distinct(), key, "left_anti").select(cache.columns)


def upsert_cache(cache: DataFrame, results: DataFrame, analysis: str, keys: list[str], created: str, tie: str, most: int = 2000) -> DataFrame:
    """The cache with the results in it: a result takes the place of an entry with its keys, one without a conclusion is left
    out; of each analysis the newest ``most`` entries stay. What an analysis keeps is first picked in 64 buckets."""
    new = results.where(F.trim(F.coalesce("conclusion", F.lit(""))) != "").withColumn("__new", F.lit(1))
    both = cache.withColumn("__new", F.lit(0)).unionByName(new)
    names = [c for c in cache.columns if c not in (analysis, *keys)]
    once = both.groupBy(analysis, *keys).agg(F.max_by(F.struct(*names), F.struct("__new", created, tie)).alias("__r")).select(analysis, *keys, "__r.*")
    newest = [F.desc(created), F.desc(tie)]
    near = once.withColumn("__b", F.pmod(F.xxhash64(tie), F.lit(64)))
    near = near.withColumn("__k", F.row_number().over(Window.partitionBy(analysis, "__b").orderBy(*newest))).where(F.col("__k") <= most)
    ranked = near.withColumn("__k", F.row_number().over(Window.partitionBy(analysis).orderBy(*newest))).where(F.col("__k") <= most)
    return ranked.select(cache.columns)
