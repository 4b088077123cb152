"""Server-sent events out of arbitrary network chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import delta_text


def event_texts(body: Column) -> Column:
    """Data texts of the events in a whole stream: a blank line ends an event, ``data`` lines are joined by line ends,
    comments and other fields don't count; an end without a blank line ends the last event too."""
    blocks = F.split(F.regexp_replace(F.regexp_replace(body, "\r\n", "\n"), "^\n+", ""), "\n{2,}")
    lines = lambda b: F.transform(F.split(b, "\n"), lambda x: F.regexp_replace(x, "\r$", ""))
    data = lambda b: F.filter(lines(b), lambda x: (x == "data") | x.startswith("data:"))
    joined = lambda d: F.array_join(F.transform(d, lambda x: F.regexp_replace(x, "^data(: ?)?", "")), "\n")
    return F.transform(F.filter(F.transform(blocks, data), lambda d: F.size(d) > 0), joined)


def _bodies(chunks: DataFrame, stream: str, seq: str, chunk: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(seq, F.coalesce(chunk, F.lit("")).alias("__c"))))
    return chunks.groupBy(stream).agg(parts.alias("__p")).select(stream, F.array_join(F.transform("__p", lambda p: p["__c"]), "").alias("__body"))


def sse_events(chunks: DataFrame, stream: str = "stream_id", seq: str = "seq", chunk: str = "chunk") -> DataFrame:
    """``(stream, event, data)``. A stream is one answer, so its chunks are one value; streams spread over tasks."""
    return _bodies(chunks, stream, seq, chunk).select(stream, F.posexplode(event_texts(F.col("__body"))).alias("event", "data"))


def assemble_answers(chunks: DataFrame, stream: str = "stream_id", seq: str = "seq", chunk: str = "chunk") -> DataFrame:
    """``(stream, answer, status)``: the deltas up to ``[DONE]``; without it the answer so far is ``disconnected``."""
    events = event_texts(F.col("__body"))
    done = F.array_position("__e", "[DONE]")
    live = F.when(done > 0, F.slice("__e", F.lit(1), (done - 1).cast("int"))).otherwise(F.col("__e"))
    answer = F.array_join(F.transform(live, delta_text), "")
    found = _bodies(chunks, stream, seq, chunk).select(stream, events.alias("__e"))
    return found.select(stream, answer.alias("answer"), F.when(done > 0, "ended").otherwise("disconnected").alias("status"))
