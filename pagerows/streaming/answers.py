"""Answers out of streams of chunks, with state: lines over chunk borders, and a time after which silence ends them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Silence after which an answer is given up (a fixed value).
IDLE_MS = 90_000


def feed(buffer: str, lines: list[str], chunk: str) -> tuple[str, list[str], list[str]]:
    """A chunk after what is left of those before: the new rest, open data lines, and the data of events that ended."""
    *whole, rest = (buffer + chunk).split("\n")
    events = []
    for line in whole:
        line = line.removesuffix("\r")
        if not line:
            if lines:
                events.append("\n".join(lines))
            lines = []
        elif line == "data":
            lines = [*lines, ""]
        elif line.startswith("data:"):
            lines = [*lines, line[5:].removeprefix(" ")]
    return rest, lines, events


def delta(event: str) -> str:
    """Text of one answer event; no JSON, no text."""
    try:
        first = json.loads(event)["choices"][0]
        parts = (first.get("delta") or {}).get("content"), (first.get("message") or {}).get("content"), first.get("text")
    except (ValueError, LookupError, TypeError, AttributeError):
        return ""
    return next((str(p) for p in parts if p is not None), "")


def answers_stream(chunks: DataFrame, stream: str, seq: str, ts: str, chunk: str = "chunk", idle_ms: int = IDLE_MS) -> DataFrame:
    """``(stream, answer, status, events)``, once for each stream: ``ended`` at ``[DONE]``; ``timeout`` where no chunk came for
    ``idle_ms`` of event time, with the answer so far. Chunks that come after the end are dropped. State is one answer;
    a stream that ended keeps a mark until it has been idle as long."""

    def run(name, frames, state: GroupState):
        if state.hasTimedOut:
            _, _, answer, n, done = state.get
            state.remove()
            if not done:
                yield pd.DataFrame({stream: [name[0]], "answer": [answer], "status": ["timeout"], "events": [n]})
            return
        rows = pd.concat(list(frames)).sort_values([seq], kind="stable")
        buffer, lines, answer, n, done = state.get if state.exists else ("", "", "", 0, False)
        held, out = json.loads(lines) if lines else [], []
        for text in rows[chunk].tolist():
            if done:
                break
            buffer, held, events = feed(buffer, held, text or "")
            for event in events:
                if event == "[DONE]":
                    done = True
                    out.append((answer, "ended", n))
                    break
                answer, n = answer + delta(event), n + 1
        state.update((buffer, json.dumps(held), "" if done else answer, n, done))
        state.setTimeoutTimestamp(max(int(rows["__ms"].max()), state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({stream: [name[0]] * len(out), "answer": [o[0] for o in out], "status": [o[1] for o in out], "events": [o[2] for o in out]})

    timed = chunks.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, "0 seconds")
    rows = timed.select(F.col(stream).cast("long").alias(stream), F.col(seq).cast("long").alias(seq), ts, F.unix_millis(ts).alias("__ms"), F.col(chunk).cast("string").alias(chunk))
    schema = f"{stream} bigint, answer string, status string, events bigint"
    return rows.groupBy(stream).applyInPandasWithState(run, schema, "buffer string, lines string, answer string, n bigint, done boolean", "append", GroupStateTimeout.EventTimeTimeout)


def events_stream(chunks: DataFrame, stream: str, seq: str, chunk: str = "chunk") -> DataFrame:
    """``(stream, event, data)`` of each event that has ended, numbered from 0. State is the open line and data lines."""

    def run(name, frames, state: GroupState):
        rows = pd.concat(list(frames)).sort_values([seq], kind="stable")
        buffer, lines, n = state.get if state.exists else ("", "", 0)
        held, out = json.loads(lines) if lines else [], []
        for text in rows[chunk].tolist():
            buffer, held, events = feed(buffer, held, text or "")
            out += events
        state.update((buffer, json.dumps(held), n + len(out)))
        yield pd.DataFrame({stream: [name[0]] * len(out), "event": range(n, n + len(out)), "data": out})

    rows = chunks.select(F.col(stream).cast("long").alias(stream), F.col(seq).cast("long").alias(seq), F.col(chunk).cast("string").alias(chunk))
    return rows.groupBy(stream).applyInPandasWithState(run, f"{stream} bigint, event bigint, data string", "buffer string, lines string, n bigint", "append", GroupStateTimeout.NoTimeout)
