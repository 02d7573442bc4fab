"""A quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; the unlabelled are web texts of any kind, good ones among them.
The class prior is estimated from both samples: for scores of a classifier that tells them apart, the share of
the unlabelled above a threshold is at least prior times the share of the positives, and the best bound over
all thresholds estimates it. A small network then minimises the non-negative unbiased risk, in which the
positives' share of the unlabelled loss is taken off and what would be a negative loss of the negatives is not
followed further. With the logistic loss the output is a probability.

Features are shares of character classes and of their pairs over the whole text, and how often words, pairs of
neighbours and lines repeat.

Null and empty texts have all features zero and get a score like any other. Documents without label are
unlabelled; of labels that disagree the lowest counts; a label without document does nothing. Without positives
every score is 0.5. Repeated rows are scored each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.arrow import bound_batches, text_pieces

SPAN = 1 << 18
THRESHOLD = 0.3
#: Classes of characters: letters by case, digits, white space by kind, single marks, other ASCII, other.
MARKS = ".,;:!?|#$%&*\"'()-_/<>=+@"
LOWER, UPPER, DIGIT, SPACE, LINE, FIRST_MARK = range(6)
OTHER = FIRST_MARK + len(MARKS)
CLASSES = OTHER + 2


def _class_table() -> np.ndarray:
    table = np.full(0x10000, OTHER + 1, np.uint8)
    for c in range(0x10000):
        s = chr(c)
        if s.isupper():
            table[c] = UPPER
        elif s.isalpha():
            table[c] = LOWER
        elif s.isdigit():
            table[c] = DIGIT
        elif s.isspace():
            table[c] = LINE if s in "\n\r" else SPACE
        elif c < 128:
            table[c] = FIRST_MARK + MARKS.index(s) if s in MARKS else OTHER
    return table


TABLE = _class_table()
SHAPE = 6
FEATURES = CLASSES + CLASSES * CLASSES + SHAPE


def _repeats(text: str) -> list[float]:
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    same = sum(map(str.__eq__, words, words[1:]))
    long_lines = [x for x in lines if x]
    return [
        len(set(words)) / n,
        same / n,
        1 - len(set(zip(words, words[1:], words[2:]))) / max(1, len(words) - 2) if len(words) > 2 else 0.0,
        1 - len(set(long_lines)) / max(1, len(long_lines)),
        min(1.0, sum(map(len, words)) / n / 20),
        min(1.0, np.log1p(len(words)) / 12),
    ]


def features(texts: list[str | None]) -> np.ndarray:
    """One row of shares for each text, as square roots so that rare classes weigh too."""
    pairs = np.zeros((len(texts), CLASSES * CLASSES))
    shape = np.zeros((len(texts), SHAPE))
    for pieces in text_pieces(texts, SPAN):
        rows = np.array([r for r, _ in pieces])
        cp = np.frombuffer("".join(p + "\n" for _, p in pieces).encode("utf-32-le", "replace"), "<u4")  # each ends a line, whatever follows
        k = TABLE[np.minimum(cp, 0xFFFF)].astype(np.int64)
        k[cp > 0xFFFF] = OTHER + 1
        ends = np.cumsum([len(p) + 1 for _, p in pieces])
        of = np.repeat(np.arange(len(pieces)), np.diff(np.concatenate([[0], ends])))[: len(k)]
        code = k[:-1] * CLASSES + k[1:]
        inner = of[:-1] == of[1:]
        counts = np.bincount(of[:-1][inner] * CLASSES * CLASSES + code[inner], minlength=len(pieces) * CLASSES * CLASSES)
        np.add.at(pairs, rows, counts.reshape(len(pieces), -1))
    for i, t in enumerate(texts):
        if t:
            shape[i] = _repeats(t)
    total = np.maximum(pairs.sum(axis=1, keepdims=True), 1)
    share = pairs / total
    single = share.reshape(len(texts), CLASSES, CLASSES).sum(axis=2)
    return np.concatenate([np.sqrt(single), np.sqrt(share), shape], axis=1).astype("f4")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class QualityModel:
    prior: float
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def _raw(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w1, b1, w2, b2 = self.weights
        hidden = np.tanh((x - self.mean) / self.scale @ w1 + b1)
        return hidden, hidden @ w2 + b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self._raw(x)[1])


def _fit(x: np.ndarray, loss_gradient, hidden: int, steps: int, seed: int, decay: float = 1e-4) -> QualityModel:
    """A network with one hidden layer, by Adam; ``loss_gradient`` gives dloss/doutput for a batch of outputs."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 0.02
    model = QualityModel(0.0, mean, scale, [rng.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), np.zeros(hidden), np.zeros(1)])
    z = (x - mean) / scale
    m, v = [np.zeros_like(w) for w in model.weights], [np.zeros_like(w) for w in model.weights]
    for t in range(1, steps + 1):
        rows = loss_gradient.rows(rng)
        h, out = model._raw(x[rows])
        g = loss_gradient(out, rows)
        back = np.outer(g, model.weights[2]) * (1 - h * h)
        grads = [z[rows].T @ back + decay * model.weights[0], back.sum(0), h.T @ g + decay * model.weights[2], np.array([g.sum()])]
        for i, d in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.999 * v[i] + 0.001 * d * d
            model.weights[i] -= 0.01 * (1 - t / (steps + 1)) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return model


class _Told:
    """Logistic loss of telling positives from unlabelled, both sides with the same weight."""

    def __init__(self, n_pos: int, n_unl: int, batch: int = 512):
        self.n_pos, self.n_unl, self.batch = n_pos, n_unl, batch

    def rows(self, rng) -> np.ndarray:
        return np.concatenate([rng.integers(0, self.n_pos, self.batch), self.n_pos + rng.integers(0, self.n_unl, self.batch)])

    def __call__(self, out: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return (_sigmoid(out) - (rows < self.n_pos)) / self.batch / 2


class _NonNegative(_Told):
    """The non-negative unbiased risk with the logistic loss: prior * R+(P) + max(0, R-(U) - prior * R-(P))."""

    def __init__(self, prior: float, n_pos: int, n_unl: int):
        super().__init__(n_pos, n_unl)
        self.prior = prior

    def __call__(self, out: np.ndarray, rows: np.ndarray) -> np.ndarray:
        pos, s, n = rows < self.n_pos, _sigmoid(out), self.batch
        as_negative = np.logaddexp(0, out)
        negative_risk = as_negative[~pos].mean() - self.prior * as_negative[pos].mean()
        g_neg = np.where(pos, -self.prior * s, s) / n
        if negative_risk < 0:
            return -g_neg
        return np.where(pos, self.prior * (s - 1) / n, 0.0) + g_neg


def estimated_prior(pos: np.ndarray, unl: np.ndarray, delta: float = 0.1) -> float:
    """The share of positives among the unlabelled, from held-back scores of both.

    The least bound over thresholds of (share of unlabelled above + its error) / share of positives above.
    """
    grid = np.unique(np.concatenate([pos, unl]))
    above_p = 1 - np.searchsorted(np.sort(pos), grid, "left") / len(pos)
    above_u = 1 - np.searchsorted(np.sort(unl), grid, "left") / len(unl)
    error = np.sqrt(np.log(4 / delta) / 2 / len(pos)) + np.sqrt(np.log(4 / delta) / 2 / len(unl))
    bound = (above_u + error) / np.maximum(above_p, 1e-9)
    k = int(np.argmin(np.where(above_p > 0.05, bound, np.inf)))
    return float(np.clip(above_u[k] / max(above_p[k], 1e-9), 0.05, 0.97))


def train(pos: np.ndarray, unl: np.ndarray, hidden: int = 16, steps: int = 500, seed: int = 1) -> QualityModel | None:
    """Feature rows of positives and unlabelled; None without both."""
    if len(pos) < 4 or len(unl) < 4:
        return None
    pos, unl = (x[np.lexsort(x.T[-SHAPE:])] for x in (pos, unl))
    fit_p, fit_u, held_p, held_u = pos[::2], unl[::2], pos[1::2], unl[1::2]
    teller = _fit(np.concatenate([fit_p, fit_u]), _Told(len(fit_p), len(fit_u)), hidden, steps, seed, decay=1e-2)
    prior = estimated_prior(teller.score(held_p), teller.score(held_u))
    model = _fit(np.concatenate([pos, unl]), _NonNegative(prior, len(pos), len(unl)), hidden, steps, seed)
    model.prior = prior
    return model


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of about so many positives and unlabelled documents that aren't held out, chosen by a hash of doc_id.

    Of rows that share a doc_id that with the least text is taken.
    """
    bound_batches(docs.sparkSession)
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("doc_id is not null and quality = 1")
    good = good.where(~held_out()).select(F.col("doc_id").alias("_id"))
    rows = docs.where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    part = lambda salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_000)) / 1e6
    n_good, n_rows = good.count(), rows.count()
    chosen = good.where(F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(1_000_000)) / 1e6 < positives / max(1, n_good))
    few = F.broadcast(chosen)  # about ``positives`` ids, as each is there once
    one = lambda df, pos: df.groupBy("doc_id").agg(F.min("text").alias("text")).select(F.lit(pos).alias("pos"), "text", "doc_id")
    p = one(rows.join(few, rows.doc_id == F.col("_id"), "left_semi"), True)
    u = one(rows.where(part(2) < unlabelled / max(1, n_rows)), False)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column(1).to_pylist())
            yield pa.record_batch([b.column(0), pa.array([r.tobytes() for r in x], pa.binary()), b.column(2)], ["pos", "x", "doc_id"])

    rows = p.union(u).withColumn("doc_id", F.col("doc_id").cast("string"))
    got = sorted(rows.mapInArrow(count, "pos boolean, x binary, doc_id string").collect(), key=lambda r: r.doc_id)
    as_rows = lambda pos: np.array([np.frombuffer(bytes(r.x), "f4") for r in got if r.pos == pos]).reshape(-1, FEATURES)
    return as_rows(True), as_rows(False)


def score_quality(docs: DataFrame, labels: DataFrame, positives: int = 1500, unlabelled: int = 3000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; the sample's size is bounded by the two parameters."""
    score = _scorer(docs, labels, positives, unlabelled)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def _scorer(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> Column:
    model = docs.sparkSession.sparkContext.broadcast(train(*sample(docs, labels, positives, unlabelled)))  # a few thousand weights

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(np.full(len(texts), 0.5) if model.value is None else model.value.score(features(texts.tolist())))

    return score(F.col("text").cast("string"))


def keep_good(docs: DataFrame, labels: DataFrame, positives: int = 1500, unlabelled: int = 3000) -> DataFrame:
    """``docs`` without the rows that the classifier rejects."""
    return docs.where(_scorer(docs, labels, positives, unlabelled) >= THRESHOLD)
