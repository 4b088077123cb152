"""Interpolated Kneser-Ney models over the letters of words.

A word is a run of letters in lower case. Its letters and an end mark are each predicted from up to ``ORDER - 1``
letters before them in the word. Grams are 16 bits a letter, packed to one 64-bit number; a model keeps, for each
length, the sorted numbers and a row of values for each class (language), found by binary search.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import small_batches, split_words, sums, tidy

ORDER = 4
END, ASTRAL = 1, 0xFFFF
_LETTER: np.ndarray | None = None


def letters(text: str) -> np.ndarray:
    """The text's characters in lower case as numbers, 0 for all that is no letter, line feeds kept as 10."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([i if chr(i).isalpha() else 0 for i in range(1 << 16)], "uint32")
        _LETTER[10] = 10
    x = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
    high = x > 0xFFFF
    if not high.any():
        return _LETTER[x]
    out = _LETTER[np.where(high, 0, x)]
    known = {int(c): ASTRAL if chr(int(c)).isalpha() else 0 for c in np.unique(x[high])}
    out[high] = [known[int(c)] for c in x[high]]
    return out


def grams(words: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The packed grams of all predictions, and the number of the word that each belongs to."""
    x = letters("\n".join(words) + "\n").astype("uint64")
    owner = np.cumsum(x == 10) - (x == 10)
    x[x == 10] = 0
    before = np.concatenate([np.zeros(1, "uint64"), x[:-1]])
    asked = (x > 0) | (before > 0)  # a letter, or the end of a run of letters
    key, live = np.where(x > 0, x, np.uint64(END)), np.ones(len(x), bool)
    for k in range(1, order):
        past = np.concatenate([np.zeros(k, "uint64"), x[:-k]]) if k <= len(x) else np.zeros(len(x), "uint64")
        live &= past > 0
        key = key | np.where(live, past, np.uint64(0)) << np.uint64(16 * k)
    return key[asked], owner[asked]


def count_grams(rows: DataFrame, text_col: str = "text", class_col: str | None = None, order: int = ORDER) -> DataFrame:
    """``(class, gram, n)`` over all rows: counted in each batch, summed once. Null texts and classes count nothing;
    without ``class_col`` there is one class, ''."""
    small_batches(rows.sparkSession)
    kind = F.lit("") if class_col is None else F.col(class_col)

    def run(batches):
        for batch in batches:
            begin, codes, words = split_words(batch.column(1))
            key, owner = grams(words, order)
            unique, at = np.unique(key, return_inverse=True)
            doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
            classes = batch.column(0).dictionary_encode()
            which = classes.indices.to_numpy()[doc] if len(doc) else doc
            for k, name in enumerate(classes.dictionary.to_pylist()):
                times = np.bincount(codes[which == k], minlength=len(words))
                n = np.bincount(at, weights=times[owner], minlength=len(unique)).astype("int64")
                some = n > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * int(some.sum()), pa.string()), pa.array(unique[some].view("int64")), pa.array(n[some])], names=["class", "gram", "n"]
                )
        tidy()

    source = rows.select(kind.cast("string").alias("class"), F.col(text_col).alias("text")).where("class is not null and text is not null")
    return source.mapInArrow(run, "class string, gram bigint, n bigint").groupBy("class", "gram").agg(F.sum("n").alias("n"))


class KneserNey:
    """Models of all classes. ``order`` k has ``keys[k]`` (last k letters) with discounted probabilities, and
    ``contexts[k]`` with the weight that a context leaves to the shorter one."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        self.classes = sorted(counts)
        self.order = order
        self.keys, self.values, self.contexts, self.left = {}, {}, {}, {}
        shapes: dict = {k: [] for k in range(1, order + 1)}
        #: Mean and variance, over a class's own predictions, of minus the log probability.
        self.mean, self.var = np.zeros(len(self.classes)), np.zeros(len(self.classes))
        #: Set where the model is calibrated: each class' limit of rejection, and the curve of the score.
        self.limit, self.curve = np.full(len(self.classes), np.inf), (0.5, 1.0)
        for c in self.classes:
            key, n = (np.asarray(x) for x in counts[c])
            key, n = key.astype("uint64"), n.astype("float64")
            for k in range(order, 0, -1):
                shapes[k].append((key, n))
                mask = np.uint64((1 << 16 * (k - 1)) - 1)
                if k > 1:  # below the top, a gram counts the different letters seen before it
                    key, n = np.unique(key & mask, return_counts=True)
                    n = n.astype("float64")
        size = len(np.unique(np.concatenate([key for key, _ in shapes[1]] or [np.zeros(0, "uint64")]))) + 1
        self.floor = 1.0 / size
        for k in range(1, order + 1):
            keys = np.unique(np.concatenate([key for key, _ in shapes[k]] or [np.zeros(0, "uint64")]))
            values = np.zeros((len(keys), len(self.classes)))
            contexts = np.unique(keys >> np.uint64(16)) if k > 1 else np.zeros(1, "uint64")
            left = np.ones((len(contexts), len(self.classes)))
            for j, (key, n) in enumerate(shapes[k]):
                ones, twos = (n == 1).sum(), (n == 2).sum()
                discount = min(0.95, max(0.1, ones / (ones + 2 * twos) if ones else 0.5))
                at = np.searchsorted(contexts, key >> np.uint64(16)) if k > 1 else np.zeros(len(key), "int64")
                total = np.bincount(at, n, len(contexts))
                kinds = np.bincount(at, minlength=len(contexts))
                values[np.searchsorted(keys, key), j] = np.maximum(n - discount, 0) / total[at]
                left[total > 0, j] = np.minimum(1.0, (np.minimum(n, discount).sum() if k == 1 else discount * kinds[total > 0]) / total[total > 0])
            self.keys[k], self.values[k], self.contexts[k], self.left[k] = keys, values, contexts, left
        for j, c in enumerate(self.classes):
            key, n = (np.asarray(x) for x in counts[c])
            if len(key):
                bits = -self.log_p(key.astype("uint64"))[:, j]
                self.mean[j] = np.average(bits, weights=n)
                self.var[j] = np.average((bits - self.mean[j]) ** 2, weights=n)

    @staticmethod
    def _row(table: np.ndarray, values: np.ndarray, key: np.ndarray, other: float) -> np.ndarray:
        if not len(table):
            return np.full((len(key), values.shape[1]), other)
        at = np.minimum(np.searchsorted(table, key), len(table) - 1)
        return np.where((table[at] == key)[:, None], values[at], other)

    def log_p(self, key: np.ndarray) -> np.ndarray:
        """Log probabilities of grams of the top order, a column for each class."""
        p = np.full((len(key), len(self.classes)), self.floor)
        for k in range(1, self.order + 1):
            own = key & np.uint64((1 << 16 * k) - 1)
            context = own >> np.uint64(16) if k > 1 else np.zeros(len(key), "uint64")
            p = self._row(self.keys[k], self.values[k], own, 0.0) + self._row(self.contexts[k], self.left[k], context, 1.0) * p
        return np.log(p)

    def score_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log probabilities of each word (a column for each class), and its number of predictions."""
        key, owner = grams(words, self.order)
        unique, at = np.unique(key, return_inverse=True)
        n = np.bincount(owner, minlength=len(words))
        return sums(self.log_p(unique)[at], np.concatenate([[0], np.cumsum(n)])), n


def train(rows: DataFrame, text_col: str = "text", class_col: str | None = None, order: int = ORDER) -> KneserNey:
    """Counts of all rows, then the model from all their grams; see ``share`` for how tasks get it. Texts are counted
    where they lie; what the driver gathers is the distinct grams, 8 bytes each and a count, which grow with the
    corpus as its vocabulary does."""
    found = count_grams(rows, text_col, class_col, order).toArrow()
    classes = found.column("class").combine_chunks().dictionary_encode()
    which = classes.indices.to_numpy()
    gram, n = found.column("gram").to_numpy().view("uint64"), found.column("n").to_numpy()
    names = classes.dictionary.to_pylist()
    counts = {}
    for k in range(len(names)):
        own = np.flatnonzero(which == k)
        own = own[np.argsort(gram[own])]
        counts[names[k]] = gram[own], n[own]
    return KneserNey({c: counts[c] for c in sorted(counts)}, order)


#: Bytes of a model's arrays up to which it is broadcast.
BROADCAST_BYTES = 256 << 20
_TABLES = ("keys", "values", "contexts", "left")


class Shared:
    """A model of any size for tasks: ``value`` is the object, its arrays broadcast within it or mapped from files."""

    def __init__(self, broadcast, files: dict | None = None):
        self._broadcast, self._files, self._value = broadcast, files, None

    def __getstate__(self):
        return self._broadcast, self._files

    def __setstate__(self, state):
        (self._broadcast, self._files), self._value = state, None

    @property
    def value(self) -> KneserNey:
        if self._value is None:
            model = self._broadcast.value
            for (table, k), name in (self._files or {}).items():
                getattr(model, table)[k] = np.load(SparkFiles.get(name), mmap_mode="r")
            self._value = model
        return self._value


def share(spark: SparkSession, model: KneserNey, most: int = BROADCAST_BYTES) -> Shared:
    """Broadcast up to ``most`` bytes. Beyond, the sorted arrays go to the executors as files, which the workers of a
    machine map into memory together; results are the same."""
    arrays = {(t, k): x for t in _TABLES for k, x in getattr(model, t).items()}
    sc = spark.sparkContext
    if sum(x.nbytes for x in arrays.values()) <= most:
        return Shared(sc.broadcast(model))
    folder, own = tempfile.mkdtemp(prefix="letters-"), uuid.uuid4().hex
    files = {(t, k): f"{own}-{t}-{k}.npy" for t, k in arrays}
    for at, name in files.items():
        np.save(os.path.join(folder, name), arrays[at])
        sc.addFile(os.path.join(folder, name))
    shell = KneserNey.__new__(KneserNey)
    shell.__dict__ = model.__dict__ | {t: {} for t in _TABLES}
    return Shared(sc.broadcast(shell), files)
