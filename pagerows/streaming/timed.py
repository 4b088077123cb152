"""Stateful streams in event time: what comes out does not depend on how the rows are split into files and batches.

Rows wait in keyed list state until the watermark has passed their time, so all that may still come before them has
come. A timer then takes those whose time it is, in order of time and tie, through the same rules as the batch forms.
Rows later than the watermark are dropped by Spark. A key's state goes once nothing waits and ``idle_ms`` of event time have
passed since its last row. The session's state store must be RocksDB (``use_rocks``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

IDLE_MS = 7 * 86_400_000


def use_rocks(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """``take`` says what a key's rows do. A row is (time, tie, inputs..); state is whatever JSON holds."""

    #: What is put out after the key, as DDL.
    schema = ""

    def __init__(self, idle_ms: int = IDLE_MS):
        self.idle_ms = idle_ms

    def start(self) -> Any:
        return None

    def take(self, state: Any, rows: list[tuple], now: int) -> tuple[Any, list[tuple], int | None]:
        """State, rows and the watermark -> new state, rows to put out, and when to be called again though no row comes."""
        raise NotImplementedError

    def idle(self, state: Any) -> list[tuple]:
        """What is put out when the key's state goes."""
        return []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts bigint, row string")
        self.held = handle.getValueState("held", "state string, last bigint")
        self.alarm = handle.getValueState("alarm", "at bigint")

    def wake(self, at: int) -> None:
        """A key has one timer, the earliest that it needs: when it fires, all is done whose time has come."""
        if self.alarm.exists():
            (held,) = self.alarm.get()
            if held <= at:
                return
            self.handle.deleteTimer(held)
        self.handle.registerTimer(at)
        self.alarm.update((at,))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = [(row["__ts"], row["__row"]) for row in rows]  # a key's rows of one batch, which the source bounds
        self.waiting.appendList(new)
        self.wake(min(ts for ts, _ in new) + 1)  # the first moment at which the watermark is beyond a row
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.alarm.clear()
        now = timerValues.getCurrentWatermarkInMs()
        kept, due = [], []
        for ts, row in self.waiting.get() if self.waiting.exists() else ():
            (due if ts < now else kept).append((ts, row))
        state, last = self.held.get() if self.held.exists() else (None, 0)
        state = self.start() if state is None else json.loads(state)
        rows = sorted(((ts, *json.loads(row).values()) for ts, row in due), key=lambda r: r[:2])
        state, out, again = self.take(state, rows, now)
        if due:
            self.waiting.put(kept) if kept else self.waiting.clear()
            last = max(last, rows[-1][0])
        if not kept and again is None and now > last + self.idle_ms:
            out = [*out, *self.idle(state)]
            self.clear()
        else:
            self.held.update((json.dumps(state, ensure_ascii=False), last))
            rest = [ts + 1 for ts, _ in kept] + ([] if again is None else [again])
            self.wake(max(now + 1, min(rest, default=last + self.idle_ms + 1)))
        return iter([Row(**dict(zip(self.names, (*key, *o)))) for o in out])

    def clear(self) -> None:
        self.held.clear()


def in_order(rows: DataFrame, key: str, ts_ms: str, inputs: list[str], late: str, processor: InOrder) -> DataFrame:
    """The processor over each key's rows; ``inputs`` are a tie and what ``take`` needs, ``late`` how late a row may come."""
    millis = F.col(ts_ms).cast("long")
    packed = F.to_json(F.struct(*(F.col(c).alias(f"c{k}") for k, c in enumerate(inputs))), {"ignoreNullFields": "false"})
    timed = rows.select(F.col(key).cast("long").alias(key), millis.alias("__ts"), F.timestamp_millis(millis).alias("__time"), packed.alias("__row"))
    whole = T.StructType.fromDDL(f"{key} bigint, {processor.schema}")
    processor.names = whole.names
    return timed.withWatermark("__time", late).groupBy(key).transformWithState(processor, whole, "Append", "EventTime")


class _RateGuard(InOrder):
    schema = "{tie} bigint, outcome string"

    def __init__(self, tie: str, window_ms: int, most: int, idle_ms: int):
        super().__init__(idle_ms)
        self.schema, self.window_ms, self.most = self.schema.format(tie=tie), window_ms, most

    def start(self):
        return [[], 0]

    def take(self, state, rows, now):
        (stamps, until), out = state, []
        for ts, tie in rows:
            stamps = [t for t in stamps if ts - t <= self.window_ms]
            if until > ts:
                out.append((tie, "cooldown"))
            elif len(stamps) >= self.most:
                until = max(ts, stamps[0] + self.window_ms)
                out.append((tie, "limit"))
            else:
                stamps, until = [*stamps, ts], 0
                out.append((tie, "allowed"))
        return [stamps, until], out, None


def rate_guard(requests: DataFrame, key: str, ts_ms: str, tie: str, late: str, window_ms: int = 60_000, most: int = 5) -> DataFrame:
    """``(key, tie, outcome)`` of each request, as ``folds.rate_guard`` says of all of them in order of time and tie. State is ``most``
    times a key, and goes after a window without requests."""
    return in_order(requests, key, ts_ms, [tie], late, _RateGuard(tie, window_ms, most, 2 * window_ms))


class _Readiness(InOrder):
    schema = "{tie} bigint, rows bigint, timed_out boolean"

    def __init__(self, tie: str, samples: int, least: int, most: int, patience: int):
        super().__init__(patience)
        self.schema, self.samples, self.least, self.most, self.patience = self.schema.format(tie=tie), samples, least, most, patience

    def start(self):
        return {"since": None, "rows": None, "content": None, "run": 0, "done": False}

    def take(self, s, rows, now):
        out = []
        for ts, tie, n, content, loading in rows:
            if s["done"]:
                break
            s["since"] = ts if s["since"] is None else s["since"]
            elapsed, content = ts - s["since"], content or ""
            same = not loading and (n or 0) > 0 and n == s["rows"] and content == s["content"]
            s["run"] = s["run"] + 1 if same else 0
            s["rows"], s["content"] = n, content
            ready = same and s["run"] >= self.samples and elapsed >= self.least
            if ready or elapsed >= self.most:
                out.append((tie, n, not ready))
                s["done"] = True
        if s["done"] or s["since"] is None:
            return s, out, None
        end = s["since"] + self.most + self.patience
        if now > end:  # no poll came in time
            return {**s, "done": True}, [*out, (None, s["rows"], True)], None
        return s, out, end + 1


def readiness(polls: DataFrame, key: str, ts_ms: str, tie: str, rows: str, content: str, loading: str, late: str, samples: int = 3, least: int = 2000, most: int = 12_000, patience: int = 12_000) -> DataFrame:
    """``(key, tie, rows, timed_out)`` once a key: the poll that ``store.readiness`` finds, time counting from the key's first poll.
    Where no poll comes within ``patience`` after ``most``, a timer gives the rows last seen, without a tie."""
    return in_order(polls, key, ts_ms, [tie, rows, content, loading], late, _Readiness(tie, samples, least, most, patience))


class _Collection(InOrder):
    """Rows seen are a map of their own, so what a batch costs doesn't grow with the collection."""

    schema = "phase string, tie bigint, reason string, pages bigint, rows bigint"

    def __init__(self, max_rows: int, max_pages: int, idle_ms: int):
        super().__init__(idle_ms)
        self.max_rows, self.max_pages = max_rows, max_pages

    def init(self, handle):
        super().init(handle)
        self.seen = handle.getMapState("seen", "signature string", "page bigint")

    def start(self):
        return {"rows": 0, "pages": 0, "done": False}

    def take(self, s, rows, now):
        out = []
        for _, tie, page, signature, stopped, is_last, outcome in rows:
            if s["done"] or page > self.max_pages:
                continue  # a page that comes later doesn't count
            s["pages"] = max(s["pages"], page)
            if signature is not None:
                if not self.seen.containsKey((signature,)):
                    self.seen.updateValue((signature,), (page,))
                    s["rows"] += 1
                    if s["rows"] <= self.max_rows:
                        out.append(("row", tie, None, page, s["rows"]))
                continue
            reason = (
                "stopped" if stopped else "row-limit" if s["rows"] >= self.max_rows else "page-limit" if page >= self.max_pages
                else "last-page" if is_last else outcome if outcome in ("next-click-failed", "page-timeout") else None
            )
            if reason:
                out.append(("end", None, reason, page, min(s["rows"], self.max_rows)))
                s["done"] = True
        return s, out, None

    def idle(self, s):
        return [] if s["done"] else [("end", None, "no-progress", s["pages"], min(s["rows"], self.max_rows))]

    def clear(self):
        super().clear()
        self.seen.clear()


def collect(events: DataFrame, key: str, ts_ms: str, tie: str, late: str, max_rows: int = 1000, max_pages: int = 30, idle_ms: int = IDLE_MS) -> DataFrame:
    """A paged collection: ``(key, phase, tie, reason, pages, rows)``, a row for each different row where it is first seen (phase
    ``row``, with its page and place), and one ``end`` with its reason, as ``store.collect`` gives them. ``events`` are rows (page,
    signature) and, after a page's rows, the page itself (page, null signature, stopped, is_last, outcome). A collection
    that just stops ends as no-progress when its state goes."""
    return in_order(events, key, ts_ms, [tie, "page", "signature", "stopped", "is_last", "outcome"], late, _Collection(max_rows, max_pages, idle_ms))


class _Cache(InOrder):
    schema = "{tie} bigint, hit boolean"

    def __init__(self, tie: str, ttl_ms: int, most: int):
        super().__init__(ttl_ms)
        self.schema, self.ttl_ms, self.most = self.schema.format(tie=tie), ttl_ms, most

    def start(self):
        return {}

    def take(self, held, rows, now):
        out = []
        for ts, tie, fingerprint in rows:
            hit = fingerprint in held and ts - held[fingerprint] <= self.ttl_ms
            if not hit:
                held.pop(fingerprint, None)
                held[fingerprint] = ts  # entries stand in order of age
                if len(held) > self.most:
                    del held[next(iter(held))]
            out.append((tie, hit))
        return held, out, None


def cache_hits(requests: DataFrame, analysis: str, fingerprint: str, ts_ms: str, tie: str, late: str, ttl_ms: int = 7_200_000, most: int = 2000) -> DataFrame:
    """``(analysis, tie, hit)`` of each request: a miss writes an entry, which lives ``ttl_ms``; of each analysis the newest ``most``
    entries stay. A hit leaves the entry's age as it is."""
    return in_order(requests, analysis, ts_ms, [tie, fingerprint], late, _Cache(tie, ttl_ms, most))


class _Sessions(InOrder):
    schema = "{tie} bigint, shown boolean"

    def __init__(self, tie: str, idle_ms: int):
        super().__init__(idle_ms)
        self.schema = self.schema.format(tie=tie)

    def take(self, current, rows, now):
        out = []
        for _, tie, opens, analysis in rows:
            if opens:
                current = analysis
            else:
                out.append((tie, current is not None and analysis == current))
        return current, out, None


def shown_results(events: DataFrame, key: str, ts_ms: str, tie: str, late: str, opens: str = "opens", analysis: str = "analysis_fp", idle_ms: int = IDLE_MS) -> DataFrame:
    """``(key, tie, shown)`` of each result: sessions (``opens``) and results of tables in one stream; a result shows while its
    analysis is that of its table's newest session at its time. All of them may be cached."""
    return in_order(events, key, ts_ms, [tie, opens, analysis], late, _Sessions(tie, idle_ms))
