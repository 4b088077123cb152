"""What the operators of this subpackage share: reading tables, Arrow batches over a text column, checkpoints."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows and bytes of one Arrow batch at most, so that a batch of very long texts still fits a worker.
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text is divisible by 5; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where the session names none (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder: computed once, and still there when an executor is lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession) -> None:
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def split_words(texts: pa.Array, at: str | None = None) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """As ``split_arrow``, with the distinct words as a list."""
    begin, codes, words = split_arrow(texts, at)
    return begin, codes, words.to_numpy(zero_copy_only=False).tolist()


def split_arrow(texts: pa.Array, at: str | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Where each text's words begin (one entry more than texts), the words as numbers, and the distinct words.
    Words lie between ASCII white space, or between single ``at``; empty ones occur. A null text has no words."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(texts) if at is None else pc.split_pattern(texts, at)
    begin = lists.offsets.to_numpy().astype("int64")
    coded = lists.flatten().dictionary_encode()
    return begin - begin[0], coded.indices.to_numpy(), coded.dictionary


def sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sum of values in each of the runs that ``begin`` bounds; runs may be empty."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[begin[1:]] - total[begin[:-1]]


def tidy() -> None:
    """Give back what a task has let go: Python workers are used again, for other stages too, and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def map_texts(
    df: DataFrame,
    text_col: str,
    keep: list[str],
    fields: list[T.StructField],
    start: Callable[[], Callable[[pa.Array], Iterable]],
) -> DataFrame:
    """``keep`` columns plus new ``fields``; a kept column with the name of a new one gives way. ``start`` runs once a
    task; what it returns maps a batch's column of texts to a list or array for each field."""
    small_batches(df.sparkSession)
    taken = {f.name.lower() for f in fields}
    keep = [c for c in keep if c.lower() not in taken]
    source = df.select(*(F.col(f"`{c}`") for c in ([*keep] if text_col in keep else [*keep, text_col])))
    names = [*keep, *(f.name for f in fields)]
    types = [to_arrow_type(f.dataType) for f in fields]
    n = len(keep)
    at = keep.index(text_col) if text_col in keep else n

    def run(batches):
        work = start()
        for batch in batches:
            new = work(batch.column(at))
            made = [c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, t in zip(new, types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), *made], names=names)
            del batch, new, made
        del work
        tidy()

    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in keep), *fields])
    return source.mapInArrow(run, schema)


def ranked(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` with ``rank`` within the group, from 0 on in ascending order (nulls first), and ``n``, the group's rows. One shuffle
    by range, so that a group of any size is many tasks' work; ties are ranked as they lie. What follows is counted for
    each range and group, and reads the ranges from the shared folder."""
    spots = cut(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("__at", F.monotonically_increasing_id()))
    spots = spots.withColumn("__part", F.shiftright("__at", 33))
    counts = spots.groupBy(F.col(group).alias("__group"), "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    whole = Window.partitionBy("__group")
    before = F.coalesce(F.sum("__n").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("__group", F.col("__part").alias("__p"), (before - F.col("__first")).alias("__shift"), F.sum("__n").over(whole).alias("n"))
    joined = spots.join(base, spots[group].eqNullSafe(base["__group"]) & (spots["__part"] == base["__p"]))
    return joined.withColumn("rank", F.col("__at") + F.col("__shift")).select(*df.columns, "rank", "n")


#: A table of so many bytes at most is sent whole to every executor.
BROADCAST_BYTES = 8 << 20


def small(df: DataFrame) -> DataFrame:
    """``df``, a checkpointed table, to be broadcast in a join if it has ``BROADCAST_BYTES`` at most, which is measured; else as it is."""
    texts = [F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    size = df.agg(F.sum(sum(texts, F.lit(16 + 16 * len(df.columns)))).alias("b")).first().b or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df
