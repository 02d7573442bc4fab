"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

Subwords are the runs of two to four characters of the lower-cased text that hold no inner gap between words;
what isn't a letter counts as a gap, as do a text's ends. Each is hashed to a row of an embedding table; a text is the mean of its
subwords' rows, and a linear softmax over it gives the languages. Both are trained by stochastic gradient
descent in numpy, on a bounded sample. A temperature, fitted on a part of the sample that training doesn't
see, makes the probabilities honest, and the same part gives the least probability to accept.

At prediction table and softmax are one linear map, so a text costs one look-up for each subword.

Null texts and texts without a letter are ``und`` with score 0. Ties go to the language first in the alphabet.
Without any labelled text all is ``und``; with one language all texts with a letter are that one. Repeated rows
are predicted each; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.arrow import bound_batches, text_pieces

UND = "und"
BUCKETS = 1 << 15
#: Characters that are handled at a time.
SPAN = 1 << 18


@functools.cache
def letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def subwords(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, places) of the subwords of a text; a place is the index of the subword's first character."""
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    letter = letter_table()[np.minimum(cp, 0x10FFFF)]
    c = np.where(letter, cp, 32).astype(np.uint64)
    buckets, places = [], []
    h = c * np.uint64(0x9E3779B97F4A7C15)
    for n in (2, 3, 4):
        if len(cp) < n:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + c[n - 1 :] * np.uint64(0x9E3779B97F4A7C15)
        ok = letter[:-1] | letter[1:] if n == 2 else letter[1:-1] if n == 3 else letter[1:-2] & letter[2:-1]
        at = np.flatnonzero(ok)
        x = h[at]
        buckets.append(((x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - 15)).astype(np.int64))
        places.append(at)
    return np.concatenate([np.zeros(0, np.int64), *buckets]), np.concatenate([np.zeros(0, np.int64), *places])


def padded(text: str) -> str:
    """Lower case between gaps: so texts that are joined share no subword, and each has those that it has alone."""
    return f" {text.lower()} "


def row_sums(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sum of the table's rows over its subwords, number of subwords, has a letter) of each text."""
    sums, n, some = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts)), np.zeros(len(texts), bool)
    for pieces in text_pieces(texts, SPAN):
        lowered = [padded(p) for _, p in pieces]
        rows = np.array([r for r, _ in pieces])
        ends = np.cumsum([len(p) for p in lowered])
        b, at = subwords("".join(lowered))
        of = np.searchsorted(ends, at, "right")
        for k in range(table.shape[1]):
            sums[:, k] += np.bincount(rows[of], table[b, k], len(texts))
        n += np.bincount(rows[of], minlength=len(texts))
        for r, p in pieces:
            some[r] |= any(map(str.isalpha, p))
    return sums, n, some


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # buckets x languages: embeddings times softmax weights
    bias: np.ndarray
    temperature: float
    least: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, calibrated probability, rejected) of each text."""
        if not self.languages:
            return [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        sums, n, some = row_sums(texts, self.table)
        p = _softmax((sums / np.maximum(n, 1)[:, None] + self.bias) / self.temperature)
        best = p.argmax(axis=1)
        score = np.where(some, p[np.arange(len(p)), best], 0.0)
        return [self.languages[k] if s else UND for k, s in zip(best, some)], score, score < self.least


def train(samples: list[tuple[str, np.ndarray, np.ndarray]], dim: int = 16, epochs: int = 6, rate: float = 0.5, accept: float = 0.99, seed: int = 1) -> LanguageModel:
    """``samples``: (language, buckets, counts). Every fifth sample of each language, from its second, calibrates only."""
    samples = sorted((s for s in samples if len(s[1])), key=lambda s: (s[0], len(s[1]), s[1].tobytes(), s[2].tobytes()))
    languages = sorted({s[0] for s in samples})
    rng, k = np.random.default_rng(seed), len(languages)
    if k < 2:
        return LanguageModel(languages, np.zeros((BUCKETS, max(1, k))), np.zeros(max(1, k)), 1.0, 0.0)
    place = {lang: i for i, (lang, *_) in reversed(list(enumerate(samples)))}  # of each language's first sample
    held = [s for i, s in enumerate(samples) if (i - place[s[0]]) % 5 == 1]
    fit = [s for i, s in enumerate(samples) if (i - place[s[0]]) % 5 != 1]
    e, w, bias = rng.uniform(-1, 1, (BUCKETS, dim)) / dim, np.zeros((dim, k)), np.zeros(k)
    steps, step = epochs * len(fit), 0
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            lang, b, c = fit[i]
            share = c / c.sum()
            x = share @ e[b]
            z = x @ w + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[languages.index(lang)] -= 1
            lr = rate * (1 - step / steps)
            e[b] -= (lr * share[:, None] * 20) * (w @ g)
            w -= lr * np.outer(x, g)
            bias -= 0.1 * lr * g
            step += 1
    table = e @ w
    if not held:  # one sample of each language: nothing to calibrate with
        return LanguageModel(languages, table.astype("f4"), bias, 1.0, 0.0)
    logits = np.array([(c / c.sum()) @ table[b] + bias for _, b, c in held])
    truth = np.array([languages.index(s[0]) for s in held])
    loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()
    temperature = min(np.geomspace(0.02, 5, 60), key=loss)
    p = _softmax(logits / temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == truth
    order = np.argsort(-score, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(share >= accept)
    least = float(score[order][good[-1]]) if len(good) else 1.0
    return LanguageModel(languages, table.astype("f4"), bias, float(temperature), least)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, rows_per_language: int, max_languages: int = 1000) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Subword counts of about ``rows_per_language`` labelled documents of each language, chosen by a hash of doc_id.

    Of rows that share doc_id and language, that with the least text is taken.

    Of more than ``max_languages`` languages only the most frequent are learnt: the model's size grows with them.
    Counting languages is one grouped count; what comes to the driver is bounded by the rows and BUCKETS.
    """
    bound_batches(docs.sparkSession)
    known = docs.where(~held_out()).where("lang is not null and text is not null and doc_id is not null")
    known = known.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()}
    if not sizes:
        return []
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6
    share = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(float(rows_per_language / n)))))
    chosen = known.where(part < share[F.col("lang")]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                total = np.zeros(BUCKETS, np.int64)
                for pieces in text_pieces([t], SPAN):
                    for _, p in pieces:
                        total += np.bincount(subwords(padded(p))[0], minlength=BUCKETS)
                used = np.flatnonzero(total)
                out.append((used.astype("<i4").tobytes(), total[used].astype("<f8").tobytes()))
            yield pa.record_batch([b.column(0), *(pa.array([o[k] for o in out], pa.binary()) for k in (0, 1))], ["lang", "b", "c"])

    rows = chosen.mapInArrow(count, "lang string, b binary, c binary").collect()
    return [(r.lang, np.frombuffer(bytes(r.b), "<i4").astype(np.int64), np.frombuffer(bytes(r.c), "<f8")) for r in rows]


def identify(docs: DataFrame, rows_per_language: int = 400, max_languages: int = 1000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row, learnt from the rows not held out.

    The model is fitted on about ``rows_per_language`` rows of each of the ``max_languages`` most frequent
    languages; rows of rarer ones get one of those.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(sample(docs, rows_per_language, max_languages)))  # BUCKETS x languages

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, rejected = model.value.predict(b.column("text").to_pylist())
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                                  ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
