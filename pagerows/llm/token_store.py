"""Token-id tables on disk, in ascending document order, and reading them back.

A stored row is a segment: some whole documents, their lengths, and a payload of independently reset, checksummed
blocks (``token_codec``). Segments are the rows of Parquet files, so writing is committed as Spark commits any table
(a lost executor's half-written files are never seen) and works on every file system that Spark reads.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import shared_dir, small_batches, tidy
from .token_codec import BLOCK_IDS, GROUP, decode_blocks, encode_blocks, split_blocks
from .tokenize import unit_encoder

#: Ids of a segment, unless one document has more: one block.
SEGMENT_IDS = BLOCK_IDS
SEGMENT = "part int, segment int, doc_ids array<bigint>, first bigint, lengths array<bigint>, payload binary"


def _blocks(ids: np.ndarray) -> list[np.ndarray]:
    return [ids[i : i + BLOCK_IDS] for i in range(0, len(ids), BLOCK_IDS)]


def write_tokens(documents: DataFrame, folder: str, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text (null: empty), end it with ``end_id``, and write ``folder`` in ascending id order: files are
    ranges of ids, segments within a file follow each other. Equal ids stay together, ordered by text; a null id
    comes first. One shuffle by range; no task holds more than a batch of texts and one round of blocks."""
    small_batches(documents.sparkSession)

    def run(batches):
        encoder, part = unit_encoder(path), TaskContext.get().partitionId()
        segment = first = 0
        held: list = []  # (doc ids, lengths, ids) of segments that wait for their round
        waiting = 0
        docs, lengths, parts, size = [], [], [], 0

        def close():
            nonlocal docs, lengths, parts, size, waiting
            if docs:
                held.append((docs, lengths, np.concatenate(parts)))
                waiting += -(-size // BLOCK_IDS)
                docs, lengths, parts, size = [], [], [], 0

        def emit():
            nonlocal held, waiting, segment, first
            blocks = [_blocks(ids) for _, _, ids in held]
            coded, at, rows = encode_blocks([b for bs in blocks for b in bs]), 0, []
            for (d, n, _), bs in zip(held, blocks):
                rows.append((part, segment, d, first, n, b"".join(coded[at : at + len(bs)])))
                at, segment, first = at + len(bs), segment + 1, first + sum(n)
            held, waiting = [], 0
            names = ("part", "segment", "doc_ids", "first", "lengths", "payload")
            types = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            ids, counts = encoder.batch(batch.column(1))
            ends = np.cumsum(counts)
            # the end id goes after each document's ids
            ids = np.insert(ids, ends, end_id)
            ends = ends + np.arange(1, len(ends) + 1)
            starts = ends - counts - 1
            for d, s, e in zip(batch.column(0).to_pylist(), starts.tolist(), ends.tolist()):
                if docs and size + e - s > SEGMENT_IDS:
                    close()
                    if waiting >= GROUP:
                        yield emit()
                docs.append(d)
                lengths.append(e - s)
                parts.append(ids[s:e])
                size += e - s
        close()
        if held:
            yield emit()
        tidy()

    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    ordered.mapInArrow(run, SEGMENT).write.parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each stored document, decoded from the files; ``start`` counts the
    ids of all documents before. A damaged block raises. Only one number a file is gathered to place the files."""
    small_batches(spark)
    stored = spark.read.parquet(folder)
    sizes = stored.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("part")
    bases, total = [], 0
    for part, n in sizes.toLocalIterator():  # as many rows as files
        bases.append((part, total))
        total += n
    base = spark.createDataFrame(bases, "part int, base bigint")

    def run(batches):
        for batch in batches:
            payloads = batch.column(3)
            todo: list[int] = []
            blocks: list = []
            for k in range(batch.num_rows):
                todo.append(k)
                blocks.append(split_blocks(payloads[k].as_py()))
                if sum(map(len, blocks)) >= GROUP or k == batch.num_rows - 1:
                    yield decoded(batch, todo, blocks)
                    todo, blocks = [], []
        tidy()

    def decoded(batch, rows, blocks):
        ids = decode_blocks([b for bs in blocks for b in bs])
        flat = np.concatenate([*ids, np.zeros(0, "uint16")]).astype("<u4")
        part = batch.slice(rows[0], len(rows))
        lengths = pc.list_flatten(part.column(2)).to_numpy()
        ends = np.cumsum(lengths)
        if len(flat) != (ends[-1] if len(ends) else 0):
            raise ValueError("a segment's blocks and its documents differ in length")
        begins = ends - lengths
        counts = pc.list_value_length(part.column(2)).to_numpy()
        owner = np.repeat(np.arange(len(rows)), counts)
        opening = begins[np.cumsum(counts) - counts]
        start = part.column(1).to_numpy()[owner] + begins - opening[owner] + part.column(4).to_numpy()[owner]
        view = memoryview(np.ascontiguousarray(flat)).cast("B")
        crc = [zlib.crc32(view[4 * b : 4 * e]) for b, e in zip(begins.tolist(), ends.tolist())]
        return pa.RecordBatch.from_arrays(
            [pc.list_flatten(part.column(0)), pa.array(start, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )

    return (
        stored.join(F.broadcast(base), "part")
        .select("doc_ids", "first", "lengths", "payload", "base")
        .mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    )


def store_round_trip(documents: DataFrame, path: str, folder: str | None = None, **columns) -> DataFrame:
    """Write, then read back. The folder (by default a new one in the shared folder) stays for later readers."""
    spark = documents.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(documents, folder, path, **columns)
    return read_tokens(spark, folder)
