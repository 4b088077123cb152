"""Where queries register, each with its SQL if SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(query: Query) -> Query:
        _QUERIES[name] = query
        if sql is not None:
            _SQL[name] = sql
        return query

    return put


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def growing_parts(spark: SparkSession, sf_dir: str, *names: str) -> int:
    """Partitions for a shuffle of whole tables: the session's number, or more where so many are read that sorts of a fixed
    number would no longer fit their memory."""
    read = sum(table(spark, sf_dir, name).rdd.getNumPartitions() for name in names)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * read)


def spread_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Narrow columns of a table for work that is bound by CPU: a table of fewer partitions than the session has cores (one
    row group, say) is dealt over all of them; a larger one stays as it is read."""
    found = table(spark, sf_dir, name).select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return found.repartition(cores) if found.rdd.getNumPartitions() < cores else found
