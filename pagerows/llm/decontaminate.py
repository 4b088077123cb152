"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark items. Those of one length make one matcher: its shift table says for a
block of two words how far the search may move on, suffix buckets list the windows that end in a block, and a direct
comparison of all words confirms.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import cut, map_texts

WINDOW = 13
#: Benchmark text that goes into one set of tables (some 60 bytes of memory for each of its bytes); more makes further
#: sets, each applied in a pass of its own.
BLOCK_BYTES = 4 << 20
#: Words are runs of digits, a-z and characters from U+0080 on, after A-Z are lower-cased.
_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
RESULT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


class WuManber:
    """All patterns have ``m`` words, given as numbers below ``kinds``; a pattern is its place in ``items``. A block is
    two words, or one where the patterns have one."""

    def __init__(self, m: int, items: list[int], kinds: int):
        self.m, self.b, self.items, self.kinds = m, min(2, m), items, kinds
        self.far = m - self.b + 1
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, list[int]] = {}

    def block(self, text: list[int], end: int) -> int:
        return text[end - 1] if self.b == 1 else text[end - 2] * self.kinds + text[end - 1]

    def add(self, at: int) -> int:
        """The place of the pattern at ``at``: that of an equal one, if it is there already."""
        m, items = self.m, self.items
        bucket = self.buckets.setdefault(self.block(items, at + m) * self.kinds + items[at], [])
        for known in bucket:
            if items[known : known + m] == items[at : at + m]:
                return known
        bucket.append(at)
        for end in range(self.b, m + 1):
            block = self.block(items, at + end)
            if self.shift.get(block, self.far) > m - end:
                self.shift[block] = m - end
        return at

    def search(self, text: list[int]) -> Iterator[tuple[int, int]]:
        """``(start, pattern)`` of each occurrence."""
        m, n, far, kinds, items, two = self.m, len(text), self.far, self.kinds, self.items, self.b == 2
        shift, buckets, at = self.shift.get, self.buckets.get, self.m
        while at <= n:
            block = text[at - 2] * kinds + text[at - 1] if two else text[at - 1]
            step = shift(block, far)
            if step:
                at += step
                continue
            for p in buckets(block * kinds + text[at - m], ()):
                if items[p : p + m] == text[at - m : at]:
                    yield at - m, p
                    break  # patterns are distinct
            at += 1


class Matchers:
    """The items' words as numbers in a row, and a matcher for each window length that occurs."""

    def __init__(self, items: Iterable[tuple[str | None, str | None]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        flat: list[int] = []
        places = []
        for item, text in items:
            w = words(text)
            if w:
                places.append((item, len(flat), len(w)))
                flat += [self.number.setdefault(x, len(self.number)) for x in w]
        self.unknown = len(self.number)
        self.matchers: dict[int, WuManber] = {}
        self.owners: dict[tuple[int, int], str | None] = {}
        self.others: dict[tuple[int, int], set] = defaultdict(set)  # further items that hold the same window
        for item, at, n in places:
            m = min(n, window)
            if m not in self.matchers:
                self.matchers[m] = WuManber(m, flat, self.unknown + 1)
            for i in range(at, at + n - m + 1):
                p = self.matchers[m].add(i)
                if p == i:
                    self.owners[p, m] = item
                elif self.owners[p, m] != item:
                    self.others[p, m].add(item)

    def hits(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged ``(start, end)`` runs of hit words, and the items found."""
        get, unknown = self.number.get, self.unknown
        numbers = [get(w, unknown) for w in text]
        found, items = [], set()
        for m, matcher in self.matchers.items():
            for start, p in matcher.search(numbers):
                found.append((start, start + m))
                items.add(self.owners[p, m])
                items.update(self.others.get((p, m), ()))
        items.discard(None)
        return merge(found), items


def merge(runs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list]:
    """Rows of the benchmark, some at a time; at least one list, which may be empty."""
    block, size = [], 0
    for row in benchmark.select(F.col(id_col).cast("string"), text_col).toLocalIterator():
        own = len((row[1] or "").encode())
        if block and size + own > block_bytes:
            yield block
            block, size = [], 0
        block.append(tuple(row))
        size += own
    yield block


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    keep: list[str] = ("doc_id",),
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``keep`` columns, ``n_words, n_hit, n_items, items_sha256, contaminated``, a row for each document; a kept column
    with one of these names gives way.

    A null or wordless text has no words and is clean; a wordless item has no window; an item with a null id marks
    words but isn't listed. Repeated items count once, repeated documents stay. An empty benchmark hits nothing.
    The benchmark is a query set, read in blocks of ``block_bytes`` (or one item, if that is longer). One block, as a rule:
    the documents pass it without a shuffle. Of more, each makes a pass, and what has been found so far is written to the
    shared folder with the documents before the next begins; the driver and a worker hold one block at a time."""
    spark = documents.sparkSession
    keep = [c for c in keep if c.lower() not in RESULT]
    row = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.lit(0)
    state = F.struct(
        F.expr("cast(array() as array<struct<s:int,e:int>>)").alias("runs"), F.expr("cast(array() as array<string>)").alias("items"), F.lit(0).cast("long").alias("n")
    )
    now = documents.select(row.alias("row"), F.col(f"`{text_col}`").alias("text"), state.alias("state"))
    fields = [T.StructField("runs", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("n", T.LongType())]
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    block, first = next(blocks), True
    while block is not None:
        tables, more = spark.sparkContext.broadcast(block), next(blocks, None)

        def start(tables=tables):
            found = Matchers(tables.value, window)

            def work(texts):
                runs, items, counts = [], [], []
                for t in texts.to_pylist():
                    w = words(t)
                    r, i = found.hits(w)
                    runs.append([x for run in r for x in run])
                    items.append(sorted(i))
                    counts.append(len(w))
                return runs, items, counts

            return work

        passed = map_texts(now, "text", ["row", "text", "state"] if more is not None or not first else ["row"], fields, start)
        if first:
            runs, items = _pairs(F.col("runs")), F.col("items")
        else:
            runs, items = F.concat("state.runs", _pairs(F.col("runs"))), F.array_union("state.items", "items")
        state = F.struct(runs.alias("runs"), items.alias("items"), F.col("n").alias("n")).alias("state")
        now = passed.select("row", "text", state) if more is not None else passed.select("row", state)
        if more is not None:
            now = cut(now)
            tables.unpersist()
        block, first = more, False
    # runs of one block are apart already; those of several are merged in order
    covered = F.aggregate(
        F.array_sort("state.runs"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, r: F.struct(
            (a["n"] + F.greatest(F.lit(0), r["e"] - F.greatest(a["end"], r["s"]))).alias("n"), F.greatest(a["end"], r["e"]).alias("end")
        ),
    )["n"]
    out = now.select("row", F.col("state.n").alias("n_words"), covered.alias("n_hit"), F.array_sort("state.items").alias("items"))
    return out.select(
        *(F.col("row")[c].alias(c) for c in keep),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def _pairs(flat):
    return F.transform(
        F.filter(flat, lambda _, i: i % 2 == 0), lambda s, i: F.struct(s.alias("s"), F.element_at(flat, (2 * i + 2).cast("int")).alias("e"))
    )

