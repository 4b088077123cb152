"""Ordered folds: a running state along each key's rows, for what no window frame expresses.

Rows are dealt by key and sorted inside partitions; a task streams them with one small state, so a long key needs time
but no memory. What can never matter is filtered before.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import estimate_tokens


def ordered_fold(rows: DataFrame, key: str, order: list, inputs: dict[str, Column], name: str, kind: str, start: Callable[[], Any], step: Callable) -> DataFrame:
    """Adds column ``name`` of Arrow type ``kind``: ``step(state, *inputs)`` returns the new state and the value."""
    columns = rows.columns
    prepared = rows.select("*", *(c.alias(f"__i{k}") for k, c in enumerate(inputs.values())))
    placed = prepared.repartition(F.col(key)).sortWithinPartitions(key, *order)
    n, at = len(columns), columns.index(key)

    def run(batches):
        last, state = object(), None
        for batch in batches:
            keys, values, out = batch.column(at).to_pylist(), [batch.column(n + k).to_pylist() for k in range(batch.num_columns - n)], []
            for k, *v in zip(keys, *values):
                if k != last:
                    last, state = k, start()
                state, made = step(state, *v)
                out.append(made)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(out, pa.type_for_alias(kind))], names=[*columns, name])

    spark_kind = {"bool": T.BooleanType(), "string": T.StringType(), "int64": T.LongType()}[kind]
    return placed.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, spark_kind)]))


def select_within_budget(items: DataFrame, key: str, order: list, header: Column, text: str, budget: int, identity: list[str]) -> DataFrame:
    """Headers first, then the others in order: each is taken if it still fits, else skipped. An item costs its tokens
    and 24. Of equal identities the first that fits is taken; what costs more than the whole budget is left out at
    once, so at most budget / 24 items of a key are ever taken."""
    cost = estimate_tokens(F.coalesce(text, F.lit(""))) + 24
    able = items.withColumn("__cost", cost).where(F.col("__cost") <= budget).withColumn("__head", (~header).cast("int"))

    def step(state, price, name):
        left, taken = state
        if price > left or name in taken:
            return state, False
        taken.add(name)
        return (left - price, taken), True

    name = F.concat_ws("\x1f", *identity)
    done = ordered_fold(able, key, ["__head", *order], {"cost": F.col("__cost"), "name": name}, "__taken", "bool", lambda: (budget, set()), step)
    return done.where("__taken").drop("__taken", "__cost", "__head")


def select_while_budget(items: DataFrame, key: str, budget: str, kind: str = "kind", seq: str = "seq", ref: str = "ref", text: str = "text") -> DataFrame:
    """As ``select_within_budget``, where each key has a budget of its own (a column): headers first, then the newest
    (least ``seq``); what no longer fits is skipped, of one ``ref`` the first that fits is taken."""
    cost = estimate_tokens(F.coalesce(text, F.lit(""))) + 24
    able = items.withColumn("__cost", cost).where(F.col("__cost") <= F.col(budget)).withColumn("__row", F.col(kind) != "table-header")

    def step(state, price, name, most):
        left, taken = state if state else (most, set())
        if price > left or name in taken:
            return (left, taken), False
        taken.add(name)
        return (left - price, taken), True

    inputs = {"price": F.col("__cost"), "name": F.col(ref), "budget": F.col(budget).cast("long")}
    done = ordered_fold(able, key, ["__row", seq], inputs, "__taken", "bool", lambda: None, step)
    return done.where("__taken").drop("__taken", "__cost", "__row")


def rate_guard(requests: DataFrame, key: str, ts_ms: Column, order: list, window_ms: int = 60_000, most: int = 5) -> DataFrame:
    """``outcome`` of each request: ``allowed``, ``limit`` (as many allowed ones lie in the window, both ends counted) or
    ``cooldown`` (the oldest of them hasn't left since the limit was met). Only allowed requests count."""

    def step(state, now):
        stamps, until = state
        stamps = [t for t in stamps if now - t <= window_ms]
        if until > now:
            return (stamps, until), "cooldown"
        if len(stamps) >= most:
            return (stamps, max(now, stamps[0] + window_ms)), "limit"
        return ([*stamps, now], 0), "allowed"

    return ordered_fold(requests, key, order, {"now": ts_ms.cast("long")}, "outcome", "string", lambda: ([], 0), step)


def assign_groups(contexts: DataFrame, session: str = "session") -> DataFrame:
    """Rows and headers of tables (kind, ref, table_id, header_ref, seq: newest first) with their ``group_id``: the group
    of the header that a row refers to, else that of its table, else one named after the header. Header references and
    tables are made unique before the joins."""
    named = lambda c: F.nullif(F.col(c), F.lit(""))
    rows = contexts.where(F.col("kind").isin("table-header", "table-row"))
    heads = rows.where((F.col("kind") == "table-header") & named("table_id").isNotNull() & named("ref").isNotNull())
    refs = heads.groupBy(session, F.col("ref").alias("header_ref")).agg(F.max_by("table_id", "seq").alias("__table"))
    joined = rows.join(refs, [session, "header_ref"], "left")
    by_header = F.when(F.col("kind") == "table-row", F.col("__table"))
    group = F.coalesce(F.concat(F.lit("TG:"), F.coalesce(by_header, named("table_id"))), F.concat(F.lit("TG:header:"), named("header_ref")))
    return joined.withColumn("group_id", group).drop("__table")


def place_contexts(contexts: DataFrame, session: str = "session", parts: int | None = None) -> DataFrame:
    """Rows and headers with their ``group_id`` (as ``assign_groups``) and its ``table_number`` (as ``number_tables``). Rows
    are dealt once, by session, to ``parts`` partitions (the session's number if none is given), and sorted there; a header
    counts twice then, for itself and for the rows that name it."""
    c = F.col
    named = lambda x: F.nullif(c(x), F.lit(""))
    head = (c("kind") == "table-header") & named("table_id").isNotNull() & named("ref").isNotNull()
    rows = contexts.where(c("kind").isin("table-header", "table-row"))
    dealt = rows.repartition(session) if parts is None else rows.repartition(parts, session)
    twice = dealt.withColumn("__named", F.explode(F.when(head, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    keyed = twice.withColumn("__ref", F.when(c("__named"), c("ref")).when(c("kind") == "table-row", c("header_ref")))
    told = F.max_by("table_id", F.when(c("__named"), c("seq"))).over(Window.partitionBy(session, "__ref"))
    own = keyed.withColumn("__table", told).where(~c("__named"))
    group = F.coalesce(F.concat(F.lit("TG:"), F.coalesce(F.when(c("kind") == "table-row", c("__table")), named("table_id"))), F.concat(F.lit("TG:header:"), named("header_ref")))
    same = Window.partitionBy(session, "group_id")
    dated = own.withColumn("group_id", group).withColumns({"__added": F.min("created_at").over(same), "__oldest": F.max("seq").over(same)})
    w = Window.partitionBy(session).orderBy(c("__added").asc_nulls_last(), F.desc("__oldest"), "group_id")
    numbered = dated.withColumn("table_number", F.dense_rank().over(w))
    return numbered.where(c("group_id").isNotNull()).drop("__named", "__ref", "__table", "__added", "__oldest")


def number_tables(contexts: DataFrame, session: str = "session") -> DataFrame:
    """``(session, group_id, added_at, oldest, rows, table_number)``: tables by the time they were first added."""
    groups = contexts.groupBy(session, "group_id").agg(
        F.min("created_at").alias("added_at"), F.max("seq").alias("oldest"), F.count_if(F.col("kind") == "table-row").alias("rows")
    )
    w = Window.partitionBy(session).orderBy(F.col("added_at").asc_nulls_last(), F.desc("oldest"), "group_id")
    return groups.withColumn("table_number", F.row_number().over(w))
