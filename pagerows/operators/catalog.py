"""Saved analyses and model results: names, imports, completion, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_json_fence

RESULTS = "struct<results: array<struct<fingerprint: string, conclusion: string, needsAttention: boolean>>>"


def classify_completion(reason: Column) -> tuple[Column, Column]:
    """``(completeness, complete for the request)`` of why a collection ended."""
    kind = (
        F.when(reason.isin("complete", "last-page"), "complete").when(reason.isin("page-limit", "row-limit"), "bounded-complete")
        .when(reason == "stopped", "cancelled").when(reason == "page-timeout", "uncertain").otherwise("incomplete")
    )
    return kind, kind.isin("complete", "bounded-complete")


def unique_names(items: DataFrame, name: str, order: str) -> DataFrame:
    """Adds ``unique_name``: the name, or with ``（n+1）`` where n items before have the same name or one that begins with it
    and ``（``. Every item counts for its whole name and for each beginning of it before a ``（``."""
    parts = F.split(name, "（")
    cuts = F.sequence(F.lit(1), F.size(parts))
    bases = F.transform(cuts, lambda k: F.array_join(F.slice(parts, F.lit(1), k), "（"))
    counted = items.select(F.explode(F.array_distinct(bases)).alias("__base"), F.col(order).alias("__at"), F.lit(0).alias("__own"))
    asked = items.select(F.col(name).alias("__base"), F.col(order).alias("__at"), F.lit(1).alias("__own"))
    w = Window.partitionBy("__base").orderBy("__at", F.desc("__own")).rowsBetween(Window.unboundedPreceding, -1)
    # an item asks before it counts itself
    before = counted.unionByName(asked).withColumn("__n", F.coalesce(F.sum(1 - F.col("__own")).over(w), F.lit(0))).where("__own = 1")
    joined = items.join(before.select(F.col("__at").alias(order), F.col("__n")), order)
    return joined.withColumn("unique_name", F.when(F.col("__n") == 0, F.col(name)).otherwise(F.concat(name, F.lit("（"), (F.col("__n") + 1).cast("string"), F.lit("）")))).drop("__n")


def import_dedupe(incoming: DataFrame, existing: DataFrame, fingerprint: str, order: str, valid: Column) -> DataFrame:
    """Each incoming item with ``outcome``: ``failed`` (not valid), ``duplicate`` (its content is there, or came before in
    the file) or ``success``. The first of each content comes from a partial aggregate, so no sort holds a content."""
    judged = incoming.withColumn("__ok", F.coalesce(valid, F.lit(False)))
    first = judged.where("__ok").groupBy(fingerprint).agg(F.min(order).alias("__first"))
    new = first.join(existing.select(fingerprint).distinct(), fingerprint, "left_anti").select(F.col("__first").alias(order), F.lit(True).alias("__new"))
    outcome = F.when(~F.col("__ok"), "failed").when(F.col("__new"), "success").otherwise("duplicate")
    return judged.join(new, order, "left").withColumn("outcome", outcome).drop("__ok", "__new")


def merge_names(old: DataFrame, new: DataFrame, key: str, name: str) -> DataFrame:
    """Names of both; the new one wins."""
    fresh = new.select(key, F.col(name).alias("__new"), F.lit(True).alias("__is"))
    return old.join(fresh, key, "full").select(key, F.when(F.col("__is"), F.col("__new")).otherwise(F.col(name)).alias(name))


def results_of(answer: Column) -> Column:
    """The results in an answer's JSON; null where it is no such JSON."""
    return F.from_json(strip_json_fence(answer), RESULTS)["results"]


def validate_results(expected: DataFrame, answers: DataFrame, batch: str, answer: str, fingerprint: str = "fingerprint", max_chars: int = 1000) -> DataFrame:
    """Expected (batch, fingerprint) against the results in the answers' JSON: ``status`` ok, blank, missing, unknown or
    duplicate (a fingerprint's later results), the trimmed ``conclusion`` of ok ones, whether it was ``truncated``, and
    ``needs_attention``. An answer that is no such JSON leaves its batch missing."""
    listed = answers.select(batch, F.posexplode(results_of(F.col(answer))).alias("__pos", "__r"))
    flat = listed.select(batch, "__pos", F.col("__r.fingerprint").alias(fingerprint), F.trim("__r.conclusion").alias("__c"), F.col("__r.needsAttention").alias("__n"))
    numbered = flat.withColumn("__k", F.row_number().over(Window.partitionBy(batch, fingerprint).orderBy("__pos")))
    asked = expected.select(batch, fingerprint).distinct().withColumn("__asked", F.lit(True))
    both = asked.join(numbered, [batch, fingerprint], "full")
    status = (
        F.when(F.col("__asked").isNull(), "unknown").when(F.col("__k").isNull(), "missing")
        .when(F.col("__k") > 1, "duplicate").when(F.coalesce("__c", F.lit("")) == "", "blank").otherwise("ok")
    )
    ok = status == "ok"
    return both.select(
        batch, fingerprint, status.alias("status"), F.when(ok, F.left("__c", F.lit(max_chars))).alias("conclusion"),
        (ok & (F.length("__c") > max_chars)).alias("truncated"), (ok & F.coalesce("__n", F.lit(False))).alias("needs_attention"),
    )
