"""Toxicity behind disguise: noisy-channel restoration, then a lexicon of words and word beginnings.

A word that holds look-alike signs (leetspeak), separators or long repetitions, or letters that stand apart, is a
lattice: each sign may stand for some letters at a cost, for nothing, or for the end of a word; between letters that
stand apart a word may end, too. The Viterbi path under a character language model of the corpus gives the restored
words; plain words are their own. Weights of words and beginnings come from
labelled documents; a text's score is the logistic of the prior and its distinct words' weights. Words of weight are found, too, where spaces
cut them into parts.
"""

from __future__ import annotations

import math
import os.path
import re
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import held_out, map_texts, small_batches, split_words, tidy
from .charlm import END, KneserNey, share, train

#: Labelled rows that the lexicon is learned from, at most (by hash of their id).
TRAIN_ROWS = 50_000
#: Least log-likelihood ratio (G squared) of a word or beginning; about one chance in 10^7.
EVIDENCE = 30.0
BEGINNINGS = (4, 5, 6)
#: Different words that must follow a feature in toxic texts: so many, and this share of those texts.
LEAST_VARIED, VARIED_SHARE = 5, 0.08
#: What a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
_SWAP, _DROP_SIGN, _DROP_REPEAT, _KEEP_REPEAT = -1.5, -1.0, -0.2, -1.0
_EDGES = re.compile(r"^[^\w@$!|+(€£]+|[^\w@$+€£]+$")
_THRICE = re.compile(r"(.)\1\1")
_APART = 4
#: Steps after which what all paths share is let go, and characters of a unit that is remembered.
_FLUSH, _REMEMBERED = 256, 64
#: What a worker has found out under each model: log probabilities, restored units.
_FOUND: WeakKeyDictionary[KneserNey, tuple[dict[str, float], dict[str, str]]] = WeakKeyDictionary()


class Restorer:
    def __init__(self, model: KneserNey):
        self.model = model
        self.known, self.restored = _FOUND.setdefault(model, ({}, {}))

    def _log_p(self, before: str, c: str) -> float:
        gram = before + (c or "\x01")
        found = self.known.get(gram)
        if found is None:
            key = END if c == "" else ord(c) & 0xFFFF
            for k, b in enumerate(reversed(before[-(self.model.order - 1) :]), 1):
                key |= (ord(b) & 0xFFFF) << 16 * k
            if len(self.known) > 200_000:
                self.known.clear()
            found = self.known[gram] = float(self.model.log_p(np.array([key], "uint64"))[0, 0]) if self.model.classes else -4.0
        return found

    def restore(self, unit: str) -> str:
        """The most likely words, with spaces between; '' where nothing is a letter or could stand for one."""
        word = unit.lower()
        if word.isalpha() and not _THRICE.search(word):
            return word
        found = self.restored.get(word)
        if found is None:
            bare = _EDGES.sub("", word)
            if bare.isalpha() and not _THRICE.search(bare):
                found = bare
            else:
                found = self.decode(bare) if any(c.isalpha() for c in bare) else ""
            if len(word) <= _REMEMBERED:
                if len(self.restored) > 50_000:
                    self.restored.clear()
                self.restored[word] = found
        return found

    def decode(self, word: str, apart: bool = False) -> str:
        """Viterbi over the lattice. A state is the last letters of the word that the model looks at; of paths that
        meet in one, the best stays. Where all paths agree, their letters are settled, so any length streams through.
        ``apart``: a word may end before each character."""
        states = {"": (0.0, "")}
        keep = self.model.order - 1 if self.model.classes else 1
        log_p, settled = self._log_p, []
        for i, c in enumerate(word):
            run = i and word[i - 1] == c
            tripled = run and (i > 1 and word[i - 2] == c or word[i + 1 : i + 2] == c)
            ways = [(c, _KEEP_REPEAT if tripled else 0.0)] if c.isalpha() else []
            ways += [(x, _SWAP) for x in LOOKALIKES.get(c, "")]
            ends = None
            if not c.isalpha():
                ends = _DROP_SIGN if c not in LOOKALIKES else 2 * _SWAP
                ways.append(("", ends))
            elif tripled:
                ways.append(("", _DROP_REPEAT))
            if apart:
                self._end(states, states, 0.0)
            after: dict[str, tuple[float, str]] = {}
            for past, (value, out) in states.items():
                for x, cost in ways:
                    v = value + cost + (log_p(past, x) if x else 0.0)
                    s = (past + x)[-keep:]
                    if s not in after or v > after[s][0]:
                        after[s] = (v, out + x)
            if ends is not None:
                self._end(states, after, ends)
            states = after
            if i % _FLUSH == _FLUSH - 1 and (same := len(os.path.commonprefix([out for _, out in states.values()]))):
                settled.append(next(iter(states.values()))[1][:same])
                states = {s: (v, out[same:]) for s, (v, out) in states.items()}
        best = max((v + (self._log_p(s, "") if s else 0.0), out) for s, (v, out) in states.items())[1]
        return ("".join(settled) + best).strip(" ")

    def _end(self, states: dict[str, tuple[float, str]], after: dict[str, tuple[float, str]], cost: float) -> None:
        """The best path whose word ends here joins ``after``."""
        ended = [(value + cost + self._log_p(past, ""), out + " ") for past, (value, out) in states.items() if past]
        if ended and ((best := max(ended))[0] > after.get("", (-math.inf,))[0]):
            after[""] = best

    def log_p(self, word: str) -> float:
        """Of a whole word, its end included."""
        keep = self.model.order - 1 if self.model.classes else 1
        return sum(self._log_p(word[max(0, i - keep) : i], c) for i, c in enumerate(word)) + self._log_p(word[-keep:], "")

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Documents and words, one entry for each occurrence, and the restored words. Runs of single letters that
        stand apart also make words."""
        begin, codes, units = split_words(texts)
        doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        number: dict[str, int] = {}
        own = [[number.setdefault(w, len(number)) for w in self.restore(u).split(" ")] for u in units]
        single = np.array([len(u) == 1 and u not in ",;:&" for u in units], bool)[codes] if len(codes) else np.zeros(0, bool)
        more, more_doc = [], []
        if single.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], single * (doc + 1), [0]])))
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if single[s] and e - s >= _APART:
                    joined = _EDGES.sub("", "".join(units[c] for c in codes[s:e]).lower())
                    if any(c.isalpha() for c in joined):
                        found = self.decode(joined, apart=True).split(" ")
                        more += [number.setdefault(w, len(number)) for w in found]
                        more_doc += [doc[s]] * len(found)
        size = np.fromiter(map(len, own), "int64", len(own))
        flat = np.array([k for x in own for k in x], "int64")
        per = size[codes] if len(codes) else np.zeros(0, "int64")
        at = np.repeat((np.cumsum(size) - size)[codes] - (np.cumsum(per) - per), per) + np.arange(int(per.sum())) if len(codes) else per
        return np.append(np.repeat(doc, per), np.array(more_doc, "int64")), np.append(flat[at], np.array(more, "int64")), list(number)


def features(word: str) -> list[str]:
    return [word + "$", *(word[:k] for k in BEGINNINGS if len(word) >= k)] if len(word) > 2 else []


class Lexicon:
    """The language model, the weights and the prior. ``fit`` bounds the weights; tasks get the model by ``share``."""

    def __init__(self, model: KneserNey, weights: dict[str, float], prior: float):
        self.model, self.weights, self.prior = model, weights, prior

    def weight(self, word: str) -> float:
        get = self.weights.get
        return max((get(f, 0.0) for f in features(word)), default=0.0)

    def whole(self) -> set[str]:
        """The words that weigh something as they stand."""
        return {f[:-1] for f in self.weights if f.endswith("$")}

    def without_model(self) -> Lexicon:
        return Lexicon(None, self.weights, self.prior)


def rejoined(restorer: Restorer, wanted: set[str], parts: set[str], doc: np.ndarray, codes: np.ndarray, names: list[str]) -> list[tuple[int, str]]:
    """``(document, word)`` of wanted words that spaces cut into parts: neighbouring words that lie within wanted ones, as
    long as together they begin one, where the letter model likes the whole word, less the cost of its signs, better
    than the words that stand there."""
    small = np.flatnonzero(np.fromiter((w in parts for w in names), bool, len(names))[codes]) if len(codes) and parts else np.zeros(0, "int64")
    begins = {w[:k] for w in wanted for k in range(1, len(w))} if len(small) > 1 else set()
    held, found = set(small.tolist()), []
    for i in small.tolist():
        word, j, apart = names[codes[i]], i, 0.0
        while word in begins and j + 1 in held and doc[j + 1] == doc[i]:
            if j == i:
                apart = restorer.log_p(word)
            j += 1
            word += names[codes[j]]
            apart += restorer.log_p(names[codes[j]])
            if word in wanted and restorer.log_p(word) + _DROP_SIGN * (j - i) > apart:
                found.append((int(doc[i]), word))
    return found


def fit(
    documents: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic",
    train_rows: int = TRAIN_ROWS, only_trained: bool = True,
) -> Lexicon:
    """The language model reads all documents (but the held-out ones), the lexicon those with one of ``train_rows``
    labels, which bounds the features and so the broadcast. Rows with a null id or label teach nothing; without labels of both kinds the
    lexicon is empty."""
    own = documents.where(~held_out(F.col(id_col))) if only_trained else documents
    model = train(own, text_col)
    taught = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    taught = taught.where(~held_out(F.col(id_col))) if only_trained else taught
    taught = taught.groupBy(id_col).agg(F.max(label_col).cast("int").alias("__label"))
    taught = taught.orderBy(F.xxhash64(id_col), id_col).limit(train_rows)
    spark = documents.sparkSession
    small_batches(spark)
    sizes = dict(taught.groupBy("__label").count().collect())
    n_neg, n_pos = sizes.get(0, 0), sizes.get(1, 0)
    if not n_neg or not n_pos:
        return Lexicon(model, {}, 0.0 if n_pos else -4.0)
    shared = share(spark, model)

    def run(batches):
        restorer = Restorer(shared.value)
        for batch in batches:
            doc, codes, names = restorer.words(batch.column(1))
            label = batch.column(0).to_numpy()
            number: dict[str, int] = {}
            own = [[number.setdefault(f, len(number)) for f in features(w)] for w in names]
            size = np.fromiter(map(len, own), "int64", len(own))
            flat = np.array([f for x in own for f in x], "int64")
            if not len(flat) or not len(codes):
                continue
            pair = np.unique(doc * len(names) + codes)
            d, c = np.divmod(pair, len(names))
            per = size[c]
            at = np.repeat((np.cumsum(size) - size)[c] - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
            d, f = np.divmod(np.unique(np.repeat(d, per) * len(number) + flat[at]), len(number))
            pos = np.bincount(f, label[d] == 1, len(number)).astype("int64")
            neg = np.bincount(f, label[d] == 0, len(number)).astype("int64")
            yield pa.RecordBatch.from_arrays([pa.array(list(number), pa.string()), pa.array(pos), pa.array(neg)], names=["feature", "pos", "neg"])
        tidy()

    rows = documents.join(F.broadcast(taught), id_col).select("__label", F.col(text_col).alias("text"))
    counted = rows.mapInArrow(run, "feature string, pos bigint, neg bigint").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # a feature must be unlikely by chance, and most texts that hold it toxic: long texts hold many words that lean a
    # little to one side, and their sum would outweigh the prior
    rate = n_pos / (n_pos + n_neg)
    g2 = F.expr(f"2 * (pos * ln(greatest(pos, 1) / ((pos + neg) * {rate!r}D)) + neg * ln(greatest(neg, 1) / ((pos + neg) * {1 - rate!r}D)))")
    chosen = counted.where(f"pos >= 9 * neg and pos > (pos + neg) * {rate!r}D").where(g2 >= EVIDENCE).withColumn("g2", g2)
    chosen = sorted(chosen.collect(), key=lambda r: r["feature"])
    wanted = spark.sparkContext.broadcast({r["feature"] for r in chosen})

    def neighbours(batches):
        restorer, some = Restorer(shared.value), wanted.value
        for batch in batches:
            doc, codes, names = restorer.words(batch.column(1))
            own = [[f for f in features(w) if f in some] for w in names]
            hit = np.flatnonzero(np.array([bool(x) for x in own], bool)[codes]) if len(codes) else codes
            found = set()
            for i in hit.tolist():
                last = i + 1 == len(codes) or doc[i + 1] != doc[i]
                found.update((f, "" if last else names[codes[i + 1]]) for f in own[codes[i]])
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], names=["feature", "next"])
        tidy()

    # copies of one toxic text make all its words look toxic: a feature counts as often as different words follow it
    followed = rows.where("__label = 1").mapInArrow(neighbours, "feature string, next string").distinct().groupBy("feature").count()
    varied = dict(followed.collect())  # of the features chosen
    chosen = [r for r in chosen if varied.get(r["feature"], 0) >= LEAST_VARIED + VARIED_SHARE * r["pos"]]
    weights = {
        r["feature"]: math.log((r["pos"] + 0.5) / (n_pos + 1)) - math.log((r["neg"] + 0.5) / (n_neg + 1)) for r in chosen
    }
    return Lexicon(model, weights, math.log(n_pos / n_neg))


def score(documents: DataFrame, lexicon: Lexicon, text_col: str = "text", keep: list[str] = ("doc_id",), name: str = "score") -> DataFrame:
    """``keep`` columns and the score, a row for each document; no shuffle. A null or empty text has the prior's
    score. Whole texts are read; repeated rows stay, a repeated word counts once in a text."""
    spark = documents.sparkSession
    letters, shared = share(spark, lexicon.model), spark.sparkContext.broadcast(lexicon.without_model())

    def start():
        lex = shared.value
        restorer = Restorer(letters.value)
        wanted = lex.whole()
        parts = {w[i:j] for w in wanted for i in range(len(w)) for j in range(i + 1, len(w) + 1)} - wanted

        def work(texts):
            doc, codes, names = restorer.words(texts)
            if more := rejoined(restorer, wanted, parts, doc, codes, names):
                number = {w: k + len(names) for k, w in enumerate(dict.fromkeys(w for _, w in more))}
                doc = np.append(doc, [d for d, _ in more])
                codes, names = np.append(codes, [number[w] for _, w in more]), [*names, *number]
            total = np.full(len(texts), lex.prior)
            weight = np.array([lex.weight(w) for w in names])
            if len(codes) and len(weight):
                hit = weight[codes] > 0
                number = {w: k for k, w in enumerate(dict.fromkeys(names))}
                same = np.array([number[w] for w in names])
                value = np.zeros(len(number))
                value[same] = weight
                d, w = np.divmod(np.unique(doc[hit] * len(number) + same[codes[hit]]), len(number))
                total += np.bincount(d, value[w], len(texts))
            return (1 / (1 + np.exp(-np.clip(total, -30, 30))),)

        return work

    return map_texts(documents, text_col, list(keep), [T.StructField(name, T.DoubleType())], start)
