"""Quality classifier by positive-unlabelled learning.

The minimised risk is the non-negative unbiased one: prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)),
with logistic loss and a linear model, so that the score is an estimate of the probability of label 1. Trusted positives
are the labelled rows of quality 1, unlabelled web text is what the same split of documents holds, labelled or not. Rows
labelled 0 aren't used. The class prior is estimated from positives and unlabelled text: a first classifier tells the one
from the other, and of its thresholds the one is taken at which the share of unlabelled text above is the least multiple of
the share of positives above (no prior above that multiple is possible; where labels can be told apart it is the prior).

Features are of a text's form alone: shares of its kinds of characters and of single bytes, lengths of words and lines,
repetition of words and lines. Labels, lang, source and doc_id are no features.

MAX_ROWS bounds the sample that is fitted (of positives and of unlabelled rows each, in expectation; chosen by a hash of
doc_id); scoring and everything else covers all rows. Null and empty texts have the features zero and are scored. Rows
whose doc_id is null are scored and never learned from. With too few labelled positives the prior is 0.5, and with none the score is the prior. Repeated rows
are scored alike. Other columns than doc_id, text and quality aren't read.
"""

from __future__ import annotations

import math
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from .common import bounded_batches, crc_mod, text_of

MAX_ROWS = 4000
N_FEATURES = 16 + 129
_UPPER, _LOWER, _DIGIT = np.arange(65, 91), np.arange(97, 123), np.arange(48, 58)
_SYMBOL = np.frombuffer(b"#$%&*+<=>@\\^_`{|}~", dtype="u1")


def features(raw: bytes | None) -> np.ndarray:
    """Of a text in UTF-8."""
    x = np.zeros(N_FEATURES, dtype="f4")
    if not raw:
        return x
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, dtype="u1"), minlength=256)
    words = raw.split()
    lines = raw.split(b"\n")
    m = max(1, len(words))
    distinct = len(set(words))
    same = sum(map(operator.eq, words, words[1:]))
    letters = counts[_UPPER].sum() + counts[_LOWER].sum() + counts[128:].sum()
    x[:16] = (
        math.log1p(n) / 10, counts[_UPPER].sum() / n, counts[_DIGIT].sum() / n, counts[_SYMBOL].sum() / n, counts[33] / n, counts[124] / n, letters / n,
        counts[32] / n, math.log1p(n / m) / 4, same / m, distinct / m, math.log1p(m / max(1, distinct)) / 3, math.log1p(n / len(lines)) / 8,
        1 - len(set(lines)) / len(lines), counts[9:14].sum() / n, math.sqrt(counts[_SYMBOL].sum() / n),
    )
    x[16:144] = np.sqrt(counts[:128] / n)
    x[144] = math.sqrt(counts[128:].sum() / n)
    return x


def feature_column(text: Column) -> Column:
    @F.arrow_udf(ArrayType(FloatType()))
    def of(raw: pa.Array) -> pa.Array:
        rows = [features(r) for r in raw.to_pylist()]
        return pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(rows or [np.zeros(0, "f4")])), N_FEATURES).cast(pa.list_(pa.float32()))

    return of(text.cast("binary"))


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, b: float, prior: float):
        self.mean, self.scale, self.w, self.b, self.prior = mean, scale, w, b, prior

    def standard_scores(self, x: np.ndarray) -> np.ndarray:
        """Of features as they are; far outliers are drawn in, as in the fit."""
        return self.scores(self.mean + np.clip((x - self.mean) / self.scale, -8, 8) * self.scale)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.w + self.b
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 800, rate: float = 0.05, decay: float = 1e-3) -> Model:
    """Minimise the non-negative risk with Adam over whole batches."""
    both = np.concatenate((positive, unlabelled)) if len(positive) else unlabelled
    mean, scale = (both.mean(axis=0), both.std(axis=0) + 1e-3) if len(both) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    w, b = np.zeros(N_FEATURES), math.log(prior / (1 - prior))
    if not len(positive) or not len(unlabelled):
        return Model(mean, scale, w, b, prior)
    xp, xu = ((x - mean) / scale for x in (positive.astype("f8"), unlabelled.astype("f8")))
    xp, xu = (np.hstack((np.clip(x, -8, 8), np.ones((len(x), 1)))) for x in (xp, xu))
    theta = np.append(w, b)
    m = v = np.zeros_like(theta)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    soft = lambda z: np.logaddexp(0, z)
    for t in range(1, steps + 1):
        zp, zu = xp @ theta, xu @ theta
        negative = soft(zu).mean() - prior * soft(zp).mean()
        g_pos = -prior * ((1 - sigmoid(zp)) @ xp) / len(xp)
        g_neg = (sigmoid(zu) @ xu) / len(xu) - prior * (sigmoid(zp) @ xp) / len(xp)
        g = g_pos + g_neg if negative >= 0 else -g_neg
        g = g + decay * np.append(theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate / math.sqrt(1 + t / 100) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, theta[:-1], float(theta[-1]), prior)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The least ratio of unlabelled to positive rows above a score, over scores that a quarter of the positives reach;
    half of the positives fit the first classifier, the other half are compared."""
    if len(positive) < 4 or not len(unlabelled):
        return 0.5
    first = fit(positive[::2], unlabelled[::2], 0.5, steps=300)
    p, u = (np.sort(first.standard_scores(x)) for x in (positive[1::2], unlabelled[1::2] if len(unlabelled) > 1 else unlabelled))
    at = p[: max(1, 3 * len(p) // 4)]
    above_p, above_u = 1 - np.searchsorted(p, at) / len(p), 1 - np.searchsorted(u, at) / len(u)
    # smoothed by one standard error, lest a chance gap in few rows decide
    return float(np.min((above_u + np.sqrt(above_u * (1 - above_u) / len(u))) / above_p))


def _sampled(rows: DataFrame, n: int, most: int, salt: int) -> DataFrame:
    """About `most` of n rows, by a hash of doc_id."""
    share = min(1.0, most / max(1, n))
    return rows if share >= 1 else rows.filter(F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, max_rows: int = MAX_ROWS) -> Model:
    """Fit on rows for which `learnable`, an expression of doc_id, holds."""
    bounded_batches(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).filter(F.col("doc_id").isNotNull() & learnable)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("q")).filter((F.col("q") == 1) & F.col("doc_id").isNotNull() & learnable).select("doc_id").distinct()
    good = F.broadcast(_sampled(known, known.count(), max_rows, 1))  # bounded by max_rows
    n_text = text.count()
    take = lambda df: np.array([r[0] for r in df.select(feature_column(F.col("text")).alias("x")).collect()], dtype="f4").reshape(-1, N_FEATURES)
    positive = take(text.join(good, "doc_id", "left_semi"))
    unlabelled = take(_sampled(text, n_text, max_rows, 2))
    return fit(positive, unlabelled, min(max(class_prior(positive, unlabelled), 0.01), 0.99))


def score_column(model: Model, text: Column) -> Column:
    @F.arrow_udf(DoubleType())
    def of(raw: pa.Array) -> pa.Array:
        x = np.array([features(r) for r in raw.to_pylist()], dtype="f8").reshape(-1, N_FEATURES)
        return pa.array(model.standard_scores(x))

    return of(text.cast("binary"))


def scored(docs: DataFrame, labels: DataFrame, learn_when=lambda: crc_mod(4) != 2, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    model = learn(docs, labels, learn_when())
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_column(model, text_of()).alias("score"))
    return out.select("doc_id", F.coalesce(~learn_when(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
