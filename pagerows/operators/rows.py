"""Windows, joins and set operations over rows, messages and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, normalize_text


def sanitize_messages(messages: DataFrame, role: str = "role", text: str = "text", images: str | None = None) -> DataFrame:
    """Messages of the system, the user or the assistant that hold text, or images (their number)."""
    held = F.trim(F.coalesce(text, F.lit(""))) != ""
    held = held if images is None else held | (F.coalesce(images, F.lit(0)) > 0)
    return messages.where(F.col(role).isin("system", "user", "assistant") & held)


def message_stats(messages: DataFrame, key: str, role: str = "role", text: str = "text", images: str | None = None, roles: tuple[str, ...] = ("user", "assistant")) -> DataFrame:
    """Messages, characters and messages of each role; with ``images`` (a number) those of the system and images, too."""
    shown = roles if images is None else ("system", *roles)
    counts = [F.count_if(F.col(role) == r).alias(f"n_{r}") for r in shown]
    more = [] if images is None else [F.sum(F.coalesce(images, F.lit(0))).alias("images")]
    return messages.groupBy(key).agg(F.count("*").alias("messages"), F.sum(F.length(F.coalesce(text, F.lit("")))).alias("chars"), *counts, *more)


def history_tokens(messages: DataFrame, key: str, text: str = "text", parts: str | None = None) -> DataFrame:
    """Tokens of each conversation. A message of several ``parts`` (type, text), where it has them, costs what those of type
    ``text`` do, each rounded up by itself."""
    if parts is not None:
        told = F.filter(parts, lambda p: F.coalesce(p["type"] == "text", F.lit(False)))
        several = F.aggregate(F.transform(told, lambda p: estimate_tokens(F.coalesce(p["text"], F.lit("")))), F.lit(0).cast("long"), lambda a, x: a + x)
        cost = F.when(F.col(parts).isNotNull(), several).otherwise(estimate_tokens(F.coalesce(text, F.lit(""))))
        return messages.groupBy(key).agg((F.sum(cost + 4) + 2).alias("tokens"))
    return messages.groupBy(key).agg((F.sum(estimate_tokens(F.coalesce(text, F.lit(""))) + 4) + 2).alias("tokens"))


def first_seen(rows: DataFrame, keys: list[str], signature: Column, order: list) -> DataFrame:
    """The first of the rows with one signature under each key. The signature is part of the partition, and the first
    is picked by a partial aggregate, so a much repeated row is no hot spot."""
    whole = rows.withColumn("__sig", F.xxhash64(signature)).withColumn("__text", signature)
    names = [f"__o{k}" for k in range(len(order))]
    first = whole.groupBy(*keys, "__sig", "__text").agg(F.min_by(F.struct(*rows.columns), F.struct(*(o.alias(n) for o, n in zip(order, names)))).alias("r"))
    return first.select("r.*")


def top_rows(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    ranked = rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__k") <= n).drop("__k")


def occurrence(rows: DataFrame, keys: list[str], value: Column, order: list, name: str = "occurrence") -> DataFrame:
    """Which repeat of its value a row is, from 0."""
    w = Window.partitionBy(*keys, value).orderBy(*order)
    return rows.withColumn(name, (F.row_number().over(w) - 1).cast("int"))


def prefix_within(rows: DataFrame, keys: list[str], cost: Column, order: list, budget: int, at_least: int = 0) -> DataFrame:
    """Rows while the running cost keeps within the budget; costs are not negative, so the running sum tells. The
    first ``at_least`` rows stay in any case."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("__run", F.sum(cost).over(w)).withColumn("__k", F.count("*").over(w))
    return run.where((F.col("__run") <= budget) | (F.col("__k") <= at_least)).drop("__run", "__k")


def recent_rounds(messages: DataFrame, key: str, seq: str, n: int = 3, role: str = "role", content: str = "text", local: str | None = None) -> DataFrame:
    """Messages of the last ``n`` rounds, or ``n`` + 2 where there are so many and the last ``n`` hold under 15,000
    UTF-16 units. A round begins at a user's message, or an assistant's that follows none; another role between the two
    parts them. Blank, failed and ``local`` only messages don't count."""
    w, whole = Window.partitionBy(key).orderBy(seq), Window.partitionBy(key)
    said = normalize_text(F.col(content))
    shown = messages.where((said != "") & ~said.startswith("请求失败："))
    shown = shown if local is None else shown.where(~F.coalesce(F.col(local), F.lit(False)))
    begins = (F.col(role) == "user") | ((F.col(role) == "assistant") & (F.coalesce(F.lag(role).over(w), F.lit("")) != "user"))
    own = shown.withColumn("__begin", begins.cast("int")).where(F.col(role).isin("user", "assistant"))
    rounds = own.withColumn("__round", F.sum("__begin").over(w)).withColumn("__last", F.max("__round").over(whole))
    size = F.sum(F.when(F.col("__round") > F.col("__last") - n, F.length(F.encode(F.col(content), "UTF-16BE")) / 2)).over(whole)
    take = F.when((size < 15_000) & (F.col("__last") >= n + 2), n + 2).otherwise(n)
    return rounds.withColumn("__take", take).where(F.col("__round") > F.col("__last") - F.col("__take")).drop("__begin", "__round", "__last", "__take")


def cache_lookup(rows: DataFrame, cache: DataFrame, keys: list[str], now: int, ttl_ms: int = 7_200_000) -> DataFrame:
    """Rows with ``hit`` and the cached ``conclusion``; entries without one, or older than the TTL, are no hits."""
    ttl = max(60_000, ttl_ms)
    live = cache.where(F.col("created_at").isNotNull() & (F.lit(now) - F.col("created_at") <= ttl) & (F.trim("conclusion") != ""))
    return rows.join(live.select(*keys, "conclusion"), keys, "left").withColumn("hit", F.col("conclusion").isNotNull())


def pending_rows(rows: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(cache.select(*keys).distinct(), keys, "left_anti")


def submitted_rows(rows: DataFrame, submitted: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(submitted.select(*keys), keys, "left_semi")


def fan_out(rows: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Each row with its fingerprint's result: ``complete``, ``error`` or ``pending``."""
    joined = rows.join(results, key, "left")
    status = F.when(F.col("conclusion").isNotNull(), "complete").when(F.col("error").isNotNull(), "error").otherwise("pending")
    return joined.withColumn("status", status)


def prune_newest(cache: DataFrame, key: str, created: str, tie: str, n: int = 2000) -> DataFrame:
    return top_rows(cache, [key], [F.desc(created), F.col(tie)], n)


def merge_queue(queued: DataFrame, current: DataFrame, done: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """Queued rows before current ones, without those done, each key once, the first ``n``."""
    both = queued.withColumn("__from", F.lit(0)).unionByName(current.withColumn("__from", F.lit(1)))
    once = first_seen(both.join(done.select(key), key, "left_anti"), [], F.col(key).cast("string"), [F.col("__from"), F.col(order)])
    return once.orderBy("__from", order, key).limit(n).drop("__from")


def merge_instances(queued: DataFrame, current: DataFrame, done: DataFrame, key: str, order: str, instances: str, n: int = 1000, queued_first: bool = False) -> DataFrame:
    """Current rows before queued ones, or the other way round: each key once with all columns of its first row, without those
    done or blank, the first ``n``; the ``instances`` (an array) of a key's rows follow each other in the same order."""
    places = (0, 1) if queued_first else (1, 0)
    both = queued.withColumn("__from", F.lit(places[0])).unionByName(current.withColumn("__from", F.lit(places[1])))
    live = both.where(F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) != "").join(done.select(key).distinct(), key, "left_anti")
    at = F.struct("__from", order)
    names = [c for c in both.columns if c not in (key, instances, "__from")]
    shown = F.coalesce(F.col(instances), F.array().cast(both.schema[instances].dataType))
    once = live.groupBy(key).agg(F.min_by(F.struct(*names), at).alias("__r"), F.min(at).alias("__at"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__from", order, shown.alias("__i")))), lambda x: x["__i"])).alias(instances))
    return once.orderBy("__at", key).limit(n).select(key, "__r.*", instances)


def content_changed(polls: DataFrame, key: str, ts: list, value: str) -> DataFrame:
    """Polls whose value differs from the one before, both being there."""
    w = Window.partitionBy(key).orderBy(*ts)
    return polls.withColumn("__past", F.lag(value).over(w)).where(F.col("__past").isNotNull() & (F.col(value) != F.col("__past"))).drop("__past")


def stable_point(polls: DataFrame, key: str, order: list, value: str, n: int) -> DataFrame:
    """For each key the first poll at which the value has been equal for ``n`` comparisons in a row."""
    w = Window.partitionBy(key).orderBy(*order)
    same = F.coalesce(F.col(value) == F.lag(value).over(w), F.lit(False))
    marked = polls.withColumn("__same", same).withColumn("__island", F.sum((~F.col("__same")).cast("int")).over(w))
    inside = marked.withColumn("__run", F.row_number().over(Window.partitionBy(key, "__island").orderBy(*order)) - 1)
    hit = inside.where(F.col("__run") == n)
    return top_rows(hit, [key], order, 1).drop("__same", "__island", "__run")


def merge_collection(snapshots: DataFrame, key: str, signature: Column, order: list, max_rows: int = 1000) -> DataFrame:
    """Snapshots that overlap, merged: each row's first sight, in order, at most ``max_rows`` for each collection."""
    return top_rows(first_seen(snapshots, [key], signature, order), [key], order, max_rows)
