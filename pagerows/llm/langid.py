"""Language identification by interpolated Kneser-Ney character models, one a language."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import map_texts, split_words, sums
from .charlm import KneserNey, share, train

#: A text of one of the learned languages is rejected so often, as measured on the calibration fold.
FALSE_REJECTION = 0.002
#: Bins of log margin by which the score is calibrated.
_BINS, _LOW, _HIGH = 48, -6.0, 6.0


def _fold(id_col: str) -> Column:
    """0: held out, 1: calibration, 2 to 4: training; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def _excess(least: np.ndarray, count: np.ndarray, best: np.ndarray, m: KneserNey) -> np.ndarray:
    """How far a text's cross-entropy lies above its language's own mean, in standard errors. Letters in a row depend on
    each other and texts have topics, so the error has a part that doesn't shrink with length."""
    return (least - m.mean[best]) / np.sqrt(m.var[best] / np.maximum(count, 1) + (0.05 * m.mean[best]) ** 2)


def _margin(entropy: np.ndarray, best: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Log of how much likelier the best language is than the next, in all (natural logarithms, at least 1/400)."""
    if entropy.shape[1] < 2:
        return np.full(len(best), _HIGH)
    others = entropy.copy()
    others[np.arange(len(best)), best] = np.inf
    lead = (others.min(axis=1) - entropy[np.arange(len(best)), best]) * np.maximum(count, 1)
    return np.log(np.clip(lead, math.exp(_LOW), math.exp(_HIGH)))


def _judge(m: KneserNey, texts) -> tuple[np.ndarray, ...]:
    """Of each text: number of predictions, the best class, its cross-entropy, excess and margin."""
    begin, codes, words = split_words(texts)
    size = len(begin) - 1
    if not m.classes or not len(codes):
        return np.zeros(size, "int64"), np.zeros(size, "int64"), *(np.zeros(size) for _ in range(3))
    value, n = m.score_words(words)
    total, count = sums(value[codes], begin), sums(n[codes], begin)
    entropy = -total / np.maximum(count, 1)[:, None]
    best = entropy.argmin(axis=1)
    least = entropy[np.arange(size), best]
    return count, best, least, _excess(least, count, best, m), _margin(entropy, best, count)


def fit(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", false_rejection: float = FALSE_REJECTION) -> KneserNey:
    """From all rows with a language whose id isn't held out: three folds of four train the models; on the fourth, kept
    apart, each language's limit of rejection is the quantile that rejects ``false_rejection`` of its texts (of few texts,
    that of a normal distribution like theirs, if it is higher), and a logistic curve over the margin says how often the best language is right. Without texts there, nothing is
    rejected. Counts of bins and one quantile a language reach the driver."""
    known = documents.where(F.col(lang_col).isNotNull())
    model = train(known.where(_fold(id_col) > 1), text_col, lang_col)
    shared = share(documents.sparkSession, model)

    def start():
        m = shared.value
        names = np.array([*m.classes, ""], dtype=object)

        def work(texts):
            count, best, _, excess, margin = _judge(m, texts)
            return names[np.where(count > 0, best, len(m.classes))], excess, margin

        return work

    fields = [T.StructField("__best", T.StringType()), T.StructField("__excess", T.DoubleType()), T.StructField("__margin", T.DoubleType())]
    tried = map_texts(known.where(_fold(id_col) == 1), text_col, [lang_col], fields, start).where("__best <> ''")
    place = F.floor((F.col("__margin") - _LOW) / (_HIGH - _LOW) * _BINS)
    right = F.col("__best") == F.col(lang_col).cast("string")
    rows = tried.select(F.least(place, F.lit(_BINS - 1)).cast("int").alias("bin"), right.alias("right"), F.col("__best"), F.col("__excess"))
    z = NormalDist().inv_cdf(1 - false_rejection)
    seen = F.percentile_approx("__excess", F.lit(1 - false_rejection), F.lit(20_000))
    limits = rows.where("right").groupBy("__best").agg(F.greatest(seen, F.avg("__excess") + z * F.coalesce(F.stddev("__excess"), F.lit(1.0))).alias("q"))
    found = dict(limits.collect())  # a row a language
    model.limit = np.array([found.get(c, math.inf) for c in model.classes])
    bins = [(r["bin"], r["n"], r["k"]) for r in rows.groupBy("bin").agg(F.count("*").alias("n"), F.count_if("right").alias("k")).collect()]
    model.curve = _logistic(bins)
    return model


def _logistic(bins: list[tuple[int, int, int]]) -> tuple[float, float]:
    """Intercept and slope of how often a bin's texts are right, by Newton's method with a light prior."""
    x = np.array([_LOW + (b + 0.5) * (_HIGH - _LOW) / _BINS for b, _, _ in bins])
    n, k = np.array([n for _, n, _ in bins], "float64"), np.array([k for _, _, k in bins], "float64")
    start = np.array([0.5, 1.0])
    theta = start.copy()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(theta[0] + theta[1] * x, -30, 30)))
        step = np.array([(k - n * p).sum(), ((k - n * p) * x).sum()]) - (theta - start)
        w = n * p * (1 - p)
        curvature = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum()]]) + np.eye(2)
        theta = theta + np.clip(np.linalg.solve(curvature, step), -2, 2)
    return float(theta[0]), float(max(theta[1], 0.0))


def identify(documents: DataFrame, model: KneserNey, text_col: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred, score, cross_entropy, rejected``, a row for each document; no shuffle.

    The language of the least cross-entropy for each prediction wins (the first by name on a tie). A null text, one
    without letters, or a model without languages gives ``und`` with score 0 and is rejected. ``rejected`` also marks
    texts whose cross-entropy lies above the limit of the language that fits best; their score, else the calibrated
    chance to be right, falls with the excess. Whole texts are read; repeated rows stay."""
    shared = share(documents.sparkSession, model)

    def start():
        m = shared.value
        names = np.array([*m.classes, "und"], dtype=object)

        def work(texts):
            count, best, least, excess, margin = _judge(m, texts)
            none = count == 0
            limit = m.limit[best] if len(m.classes) else np.zeros(len(best))
            beyond = np.where(np.isfinite(limit), np.maximum(excess - np.where(np.isfinite(limit), limit, 0.0), 0.0), 0.0)
            chance = np.exp(-beyond) / (1 + np.exp(-np.clip(m.curve[0] + m.curve[1] * margin, -30, 30)))
            return (
                names[np.where(none, len(m.classes), best)],
                np.where(none, 0.0, chance),
                [None if z else e for z, e in zip(none.tolist(), least.tolist())],
                none | (beyond > 0),
            )

        return work

    fields = [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType()),
    ]
    return map_texts(documents, text_col, list(keep), fields, start)
