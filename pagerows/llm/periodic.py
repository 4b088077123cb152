"""Runs of repeated word sequences in whole texts, found by tiles of many scales.

A run is a stretch of consecutive words with smallest period q and at least ``max(24, 3 * q)`` words that no neighbour
extends. Its words match those q further on in an interval of at least ``max(24 - q, 2 * q)`` places.

Periods are taken by octaves [P, 2P) (the first: all under 8), each with boundaries every S = max(8, P) words. A run of
the octave holds two boundaries or more, and S words from the first of them on equal those q further on. So each
document is exploded, for each octave, into overlapping tiles of 5 S words, one around each boundary; of these only
tiles are written in which some window of S words has the hash of its boundary's window (equal windows always have:
no run is lost, and what merely collides is found out below). Tiles are rows of a table of their own, solved
independently: the Z-function from the boundary forwards, and the one backwards, give for each period of the octave how
far words match around the boundary. Fragments of a period that is itself made of a shorter one are left out. Then a
shuffle by document and period stitches the fragments that meet, and what is long enough is a run.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import shared_dir, small_batches, split_words, tidy

#: A run has so many words and so many periods at least.
MIN_WORDS, MIN_POWER = 24, 3
#: Boundaries of the shortest periods lie so many words apart.
FIRST = 8
#: Pairs of windows compared at once, and bytes of one batch of tiles.
PAIRS, TILE_BYTES = 1 << 20, 4 << 20

#: Gives the order in which a document's words are read (None: as they are) from its id and its number of words.
Order = Callable[["int | None", int], "np.ndarray | None"]

_ROW = "row bigint, doc_id bigint, text string, plain string, low int, at bigint, c int, words binary"


def octaves(n: int) -> Iterator[tuple[int, int, int]]:
    """(least period, least period of the next octave, words between boundaries) for a text of n words."""
    low, high = 1, FIRST
    while max(MIN_WORDS, MIN_POWER * low) <= n:
        yield low, high, max(FIRST, low)
        low, high = high, 2 * high


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, "uint64")
    out[:1] = 1
    return np.cumprod(out, dtype="uint64")


def _values(codes: np.ndarray) -> np.ndarray:
    """64 mixed bits for each number."""
    x = (codes.astype("uint64") + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Windows:
    """Hashes of windows over several texts laid end to end, a number of its own after each."""

    BASE = 0x5851F42D4C957F2D

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.undo = _powers(self.n, pow(self.BASE, -1, 1 << 64))
        self.sums = np.concatenate([np.zeros(1, "uint64"), np.cumsum(_values(codes) * _powers(self.n, self.BASE), dtype="uint64")])

    def hashes(self, size: int) -> np.ndarray:
        """Of the window at each place where one fits."""
        return (self.sums[size:] - self.sums[: self.n - size + 1]) * self.undo[: self.n - size + 1]


def boundaries(begin: np.ndarray, lengths: np.ndarray, low: int, high: int, step: int, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(text, boundary in the text) of each boundary whose window of ``step`` words may occur again a period later."""
    many = np.where(lengths >= max(MIN_WORDS, MIN_POWER * low), (lengths - step - low) // step + 1, 0).clip(0)
    owner = np.repeat(np.arange(len(many)), many)
    places = (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)) * step
    if not len(owner):
        return owner, places
    found = np.concatenate([windows.hashes(step), np.zeros(high, "uint64")])
    view = np.lib.stride_tricks.sliding_window_view(found, high - low)
    hit = np.zeros(len(owner), bool)
    chunk = max(1, PAIRS // (high - low))
    for i in range(0, len(owner), chunk):
        c = begin[owner[i : i + chunk]] + places[i : i + chunk]
        hit[i : i + chunk] = (view[c + low] == found[c][:, None]).any(axis=1)
    return owner[hit], places[hit]


def z_function(s: list[int]) -> list[int]:
    """For each place how many items from there on equal those from the start on."""
    n = len(s)
    z = [n] + [0] * (n - 1)
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _prime_factors(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return [*out, q] if q > 1 else out


def solve_tile(words: list[int], c: int, low: int, high: int, step: int) -> list[tuple[int, int, int]]:
    """(period, first place, end) of the matches around place c, for each smallest period of the octave that matches
    ``step`` words from c on. Places count from the tile's start."""
    ahead = z_function(words[c:])
    found = [q for q in range(low, min(high, len(ahead))) if ahead[q] >= step and all(ahead[q // p] < q - q // p for p in _prime_factors(q))]
    if not found:
        return []
    top = found[-1]
    behind = z_function([*words[:c][::-1], -1, *words[: c + top][::-1]])
    out = []
    for q in found:
        back = behind[c + 1 + top - q]
        out.append((q, c - back, c + ahead[q]))
    return out


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _read(text: str | None, doc_id: int | None, order: Order | None) -> list[bytes]:
    words = (text or "").encode().split()  # bytes split at ASCII white space only
    way = order(doc_id, len(words)) if order is not None else None
    return words if way is None else [words[i] for i in way.tolist()]


def _tiles(documents: DataFrame, order: Order | None, id_col: str, text_col: str) -> DataFrame:
    """A row for each document (its text only where it has tiles, else the digest of its words), and one for each tile."""
    small_batches(documents.sparkSession)
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
    names = ("row", "doc_id", "text", "plain", "low", "at", "c", "words")

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            begin, codes, distinct = split_words(texts)
            if "" in distinct:  # stands where a text is empty, or begins or ends with white space
                words = codes != distinct.index("")
                begin, codes = np.concatenate([[0], np.cumsum(words)])[begin], codes[words]
            lengths = np.diff(begin)
            codes = codes.astype("int64")
            for k, (d, n) in enumerate(zip(ids, lengths.tolist())):
                way = order(d, n) if order is not None and n else None
                if way is not None:
                    codes[begin[k] : begin[k + 1]] = codes[begin[k] : begin[k + 1]][way]
            codes = np.insert(codes, begin[1:], len(distinct) + np.arange(len(lengths)))
            begin = begin[:-1] + np.arange(len(lengths))
            windows, tiled = Windows(codes), np.zeros(len(lengths), bool)
            held, size = [], 0
            for low, high, step in octaves(int(lengths.max(initial=0))):
                owner, places = boundaries(begin, lengths, low, high, step, windows)
                tiled[owner] = True
                for k, c in zip(owner.tolist(), places.tolist()):
                    at, end = max(0, c - step), min(int(lengths[k]), c + 2 * step + high)
                    part = codes[begin[k] + at : begin[k] + end].astype("<i4").tobytes()
                    held.append((row + k, None, None, None, low, at, c - at, part))
                    size += len(part)
                    if size > TILE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), types)], names=names)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), types)], names=names)
            n = len(lengths)
            plain = [None if tiled[k] else _digest(_read(texts[k].as_py(), ids[k], order)) for k in range(n)]
            kept = pc.if_else(pa.array(tiled), pc.fill_null(texts, ""), pa.scalar(None, pa.string()))
            numbers = pa.array(np.arange(row, row + n))
            yield pa.RecordBatch.from_arrays([numbers, batch.column(0), kept, pa.array(plain, pa.string()), *(pa.nulls(n, t) for t in types[4:])], names=names)
            row += n
            del windows, codes
        tidy()

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _ROW)


def _fragments(tiles: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = []
            for row, low, at, c, words in zip(*(col.to_pylist() for col in batch.columns)):
                high, step = (FIRST, FIRST) if low < FIRST else (2 * low, low)
                out += [(row, q, at + a, at + b) for q, a, b in solve_tile(np.frombuffer(words, "<i4").tolist(), c, low, high, step)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else ((),) * 4)], names=("row", "q", "lo", "hi"))
        tidy()

    return tiles.select("row", "low", "at", "c", "words").mapInArrow(run, "row bigint, q bigint, lo bigint, hi bigint")


def stitched(fragments: DataFrame) -> DataFrame:
    """``(row, q, lo, hi)`` -> runs ``(row, start, length, period)``: intervals of one document and period that overlap or
    touch become one. One shuffle, by document and period."""
    by = Window.partitionBy("row", "q").orderBy("lo", "hi")
    reach = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    opened = fragments.withColumn("new", F.when(F.col("lo") <= reach, 0).otherwise(1))
    islands = opened.withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("row", "q", "island").agg(F.min("lo").alias("start"), F.max("hi").alias("hi"))
    enough = F.greatest((MIN_POWER - 1) * F.col("q"), MIN_WORDS - F.col("q"))
    return merged.where(F.col("hi") - F.col("start") >= enough).select("row", "start", (F.col("hi") - F.col("start") + F.col("q")).alias("length"), F.col("q").alias("period"))


RESULT = (
    "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
    "runs_sha256 string, collapsed_sha256 string"
)


def _collapsed(rows: DataFrame, order: Order | None) -> DataFrame:
    """``(doc_id, text, runs)`` with runs in order of start and period -> ``RESULT``."""
    names = [f.split()[0] for f in RESULT.split(", ")]

    def run(batches):
        for batch in batches:
            out = []
            for d, text, runs in zip(*(col.to_pylist() for col in batch.columns)):
                words, runs = _read(text, d, order), [(r["start"], r["length"], r["period"]) for r in runs or ()]
                dropped = np.zeros(len(words) + 1, "int64")
                for s, n, q in runs:
                    dropped[s + q] += 1
                    dropped[s + n] -= 1
                kept = np.flatnonzero(np.cumsum(dropped)[:-1] == 0).tolist()
                best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                out.append((
                    d, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                    hashlib.sha256(listed.encode()).hexdigest(), _digest([words[i] for i in kept]),
                ))
            kinds = (pa.int64(),) * 6 + (pa.string(),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else ((),) * 8, kinds)], names=names)
        tidy()

    return rows.select("doc_id", "text", "runs").mapInArrow(run, RESULT)


def periodic_runs(documents: DataFrame, order: Order | None = None, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """``RESULT``, a row for each document: how many runs it has, the one with the most periods (ties: least start, then
    period; four nulls without a run), and digests of all runs and of the text without the repetitions.

    Null, empty and wordless texts have no run. Each row stands for itself, so null ids, repeated ids and repeated rows
    are nothing special; other columns are ignored. A text may have any length: what is held at once are the words of an
    Arrow batch of texts, one batch of tiles, and one document's runs. The folder (by default a new one in the
    shared folder) holds the tiles, and the texts of the documents that have any; a lost executor's share is read
    again from there."""
    spark = documents.sparkSession
    folder = folder or f"{shared_dir(spark)}/tiles-{uuid.uuid4().hex}"
    _tiles(documents, order, id_col, text_col).write.parquet(folder)
    stored = spark.read.schema(_ROW).parquet(folder)
    runs = stitched(_fragments(stored.where("low is not null")))
    # in order of start, then period
    listed = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    texts = stored.where("low is null and text is not null").select("row", "doc_id", "text")
    repeated = _collapsed(texts.join(listed, "row", "left"), order)
    empty, none = hashlib.sha256(b"").hexdigest(), F.lit(None).cast("long")
    plain = stored.where("low is null and text is null").select(
        "doc_id", F.lit(0).cast("long").alias("n_runs"), none.alias("start"), none.alias("length"), none.alias("period"),
        none.alias("exponent_milli"), F.lit(empty).alias("runs_sha256"), F.col("plain").alias("collapsed_sha256"),
    )
    return plain.unionByName(repeated)
