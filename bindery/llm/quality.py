"""Quality classifier from weak labels.

Heuristic labellers vote for or against each document or abstain. Expectation-maximisation over the counts of all vote patterns
estimates each labeller's accuracy without any true label, and with it the posterior that a document is good. A linear model over
hashed features learns the posterior of a bounded sample (``sample`` documents of ``sample_bytes`` in all, those with the least hash of id), in one task, and
scores every document; below ``threshold`` a document is rejected.

Vote patterns are at most 3 to the number of labellers, at any size of the corpus.

Defined results: a null text counts as empty; a text without words gets score 0 and is rejected; equal texts get equal scores;
repeated rows stay rows; an empty table gives an empty result. Where no document votes, everything with words is kept. ``classify``
ignores other columns, ``keep`` keeps all, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import U, mix, slices, word_hashes
from .scratch import Scratch


@dataclass(frozen=True)
class Quality:
    """bits: log2 of the hashed features; sample: documents the scorer is fitted on; sample_bytes: bound of their texts, so that a larger
    document, and what comes after the bound, is not fitted on; rounds: of expectation-maximisation;
    epochs, rate, decay: of the scorer's gradient descent; threshold: least score that is kept."""

    bits: int = 14
    sample: int = 8000
    sample_bytes: int = 1 << 28
    rounds: int = 60
    epochs: int = 12
    rate: float = 0.5
    decay: float = 1e-5
    threshold: float = 0.5


#: name -> (statistic, votes bad from here on, votes good up to here). Statistics are shares; see ``statistics``.
LABELLERS = {
    "signs": ("sign_share", 0.12, 0.06),
    "signed_words": ("signed_words", 0.35, 0.12),
    "capitals": ("capital_share", 0.4, 0.15),
    "shouted_words": ("shouted_words", 0.3, 0.05),
    "bars": ("bar_words", 0.12, 0.01),
    "repeats": ("repeated_next", 0.25, 0.06),
    "sameness": ("least_variety", 0.75, 0.55),
    "phrases": ("repeated_triples", 0.4, 0.15),
}
STATISTICS = ("sign_share", "signed_words", "capital_share", "shouted_words", "bar_words", "repeated_next", "least_variety", "repeated_triples")

_KIND = np.zeros(256, np.uint8)  # 0 space, 1 small letter or other byte of a letter, 2 capital, 3 digit, 4 usual sign, 5 other sign
for _i in range(256):
    _c = chr(_i)
    _KIND[_i] = 0 if _i in (9, 10, 11, 12, 13, 32) else 2 if "A" <= _c <= "Z" else 3 if "0" <= _c <= "9" else 1 if "a" <= _c <= "z" or _i >= 128 else 4 if _c in ".,;:?'\"()-" else 5


#: Words at which features count by half.
SHRINK = 12


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


class Words:
    """Of a slice of texts: words, each one's document and kinds of bytes."""

    def __init__(self, texts: list[bytes]) -> None:
        self.n = len(texts)
        buf = np.frombuffer(b" ".join(texts), np.uint8)
        self.hashes, self.start, self.end = word_hashes(buf)
        ends = np.cumsum([len(x) + 1 for x in texts])
        self.doc = np.searchsorted(ends, self.start, side="right")
        self.words = np.bincount(self.doc, minlength=self.n)
        kind = _KIND[buf]
        self.of = {}
        for k in range(1, 6):
            total = np.concatenate(([0], np.cumsum(kind == k)))
            self.of[k] = total[self.end] - total[self.start]
        # beyond ASCII, é is C3 A9 and É is C3 89: capitals of Latin-1 have a second byte below A0
        wide = np.zeros(len(buf), bool)
        wide[1:] = (buf[:-1] == 0xC3) & (buf[1:] < 0xA0) & (buf[1:] != 0x9F)
        total = np.concatenate(([0], np.cumsum(wide)))
        extra = total[self.end] - total[self.start]
        self.of[2] = self.of[2] + extra
        self.of[1] = self.of[1] - 2 * extra
        self.last = buf[self.end - 1] if len(self.end) else buf[:0]
        self.first = buf[self.start] if len(self.start) else buf[:0]

    def per(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, weights=x, minlength=self.n)

    def statistics(self) -> dict[str, np.ndarray]:
        size = self.end - self.start
        letters = self.of[1] + self.of[2]
        same = np.zeros(len(self.doc), bool)
        same[1:] = (self.doc[1:] == self.doc[:-1]) & (self.hashes[1:] == self.hashes[:-1])
        out = {
            "sign_share": _share(self.per(self.of[5]), self.per(size)),
            "signed_words": _share(self.per((self.of[5] > 0) & (letters > 0)), self.words),
            "capital_share": _share(self.per(self.of[2]), self.per(letters)),
            "shouted_words": _share(self.per((self.of[2] > 1) & (self.of[1] == 0)), self.words),
            "bar_words": _share(self.per((size == self.of[5]) & (size > 0)), self.words),
            "repeated_next": _share(self.per(same), self.words),
        }
        distinct, triples = np.zeros(self.n), np.zeros(self.n)
        cuts = np.concatenate(([0], np.cumsum(self.words)))
        joined = self.hashes.copy()
        joined[:-2] = mix(mix(joined[:-2] * U(0xD6E8FEB86659FD93) + self.hashes[1:-1]) * U(0xD6E8FEB86659FD93) + self.hashes[2:]) if len(joined) > 2 else joined[:-2]
        for i in range(self.n):
            a, b = cuts[i], cuts[i + 1]
            # variety of the first and further hundreds of words alike, so that long texts are not held to be monotonous
            parts = range(a, b, 100)
            distinct[i] = sum(len(np.unique(self.hashes[x : min(x + 100, b)])) for x in parts)
            triples[i] = len(np.unique(joined[a : b - 2])) if b - a > 2 else 0
        out["least_variety"] = np.where(self.words >= 20, 1 - _share(distinct, self.words), np.nan)
        out["repeated_triples"] = np.where(self.words >= 20, 1 - _share(triples, self.words - 2), np.nan)
        return out

    def features(self, p: Quality) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, feature, value): hashed shapes of words and pairs of shapes, as shares of the document's words."""
        grade = lambda x: np.minimum(x, 3).astype(np.uint64)
        same = np.zeros(len(self.doc), np.uint64)
        same[1:] = (self.doc[1:] == self.doc[:-1]) & (self.hashes[1:] == self.hashes[:-1])
        shape = grade(self.of[1]) + U(4) * grade(self.of[2]) + U(16) * grade(self.of[3]) + U(64) * grade(self.of[4]) + U(256) * grade(self.of[5])
        shape = shape * U(2) + same
        last = shape * U(256) + self.last
        pair = np.zeros_like(shape)
        pair[1:] = np.where(self.doc[1:] == self.doc[:-1], shape[:-1] + U(1), U(0))
        pair = pair * U(1 << 20) + shape
        mask = U((1 << p.bits) - 1)
        keys = [mix(x + U(k << 56)) & mask for k, x in enumerate((shape, last, pair), 1)]
        cell = np.concatenate([self.doc.astype(np.uint64) << U(32) | k for k in keys])
        cell, count = np.unique(cell, return_counts=True)
        doc = (cell >> U(32)).astype(np.int64)
        # a few words say little: their features shrink towards what holds for documents in general
        trust = self.words / (self.words + SHRINK)
        return doc, (cell & U(0xFFFFFFFF)).astype(np.int64), np.sqrt(count / np.maximum(self.words[doc], 1)) * trust[doc]


def votes(stats: dict[str, np.ndarray], words: np.ndarray) -> np.ndarray:
    """Pattern of each document: base 3 digits, 0 abstains, 1 bad, 2 good."""
    out = np.zeros(len(words), np.int64)
    for name, bad, good in LABELLERS.values():
        v = np.where(stats[name] >= bad, 1, np.where(stats[name] <= good, 2, 0))
        out = out * 3 + np.where(words > 0, v, 0)
    return out


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in slices(batch.column(1)):
            w = Words(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(votes(w.statistics(), w.words)), pa.array(w.words), pa.array([len(x) for x in texts], pa.int64())], names=["doc_id", "votes", "n_words", "n_bytes"])


def digits(pattern: np.ndarray) -> np.ndarray:
    """patterns x labellers of 0, 1, 2."""
    n = len(LABELLERS)
    return np.stack([pattern // 3 ** (n - 1 - k) % 3 for k in range(n)], axis=1)


@dataclass(frozen=True)
class WeakModel:
    """prior of good; accuracy[class, labeller, vote] for the classes bad and good."""

    prior: float
    tables: np.ndarray

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        seen = digits(np.asarray(pattern))
        logs = np.log(self.tables)[:, np.arange(seen.shape[1]), seen].sum(axis=2)
        odds = np.log(self.prior / (1 - self.prior)) + logs[1] - logs[0]
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def maximise(counts: dict[int, int], rounds: int) -> WeakModel:
    """Expectation-maximisation from patterns and their counts. One vote for bad against none for good starts a pattern as bad:
    labellers are precise on what they reject, and blind to most other faults."""
    pattern = np.array(sorted(counts), np.int64)
    n = np.array([counts[x] for x in pattern.tolist()], float)
    seen = digits(pattern)
    q = np.where((seen == 1).any(axis=1), 0.1, 0.95)
    model = WeakModel(0.5, np.full((2, seen.shape[1], 3), 1 / 3))
    for _ in range(rounds):
        tables = np.empty_like(model.tables)
        for c, weight in enumerate((n * (1 - q), n * q)):
            for v in range(3):
                tables[c, :, v] = ((seen == v) * weight[:, None]).sum(axis=0) + 1.0
            tables[c] /= tables[c].sum(axis=1, keepdims=True)
        prior = float(np.clip((n * q).sum() / max(n.sum(), 1), 0.01, 0.99))
        model = WeakModel(prior, tables)
        q = model.posterior(pattern)
    return model


def fit_linear(texts: list[bytes], target: np.ndarray, p: Quality) -> np.ndarray:
    """Weights and, last, the bias: logistic regression on soft labels by gradient descent with momentum-free Adagrad."""
    docs, keys, values, at = [], [], [], 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size < 1 << 20):
            size += len(texts[stop])
            stop += 1
        d, k, v = Words(texts[at:stop]).features(p)
        docs.append(d + at)
        keys.append(k)
        values.append(v)
        at = stop
    weights, seen = np.zeros((1 << p.bits) + 1), np.full((1 << p.bits) + 1, 1e-3)
    if not docs:
        return weights
    d, k, v = np.concatenate(docs), np.concatenate(keys), np.concatenate(values)
    for _ in range(p.epochs * 10):
        z = np.bincount(d, weights=weights[k] * v, minlength=len(texts)) + weights[-1]
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(texts)
        grad = np.append(np.bincount(k, weights=err[d] * v, minlength=1 << p.bits), err.sum()) + p.decay * weights
        seen += grad**2 * 100
        weights -= p.rate * grad / np.sqrt(seen)
    return weights


def _scores(texts: list[bytes], weights: np.ndarray, p: Quality) -> tuple[np.ndarray, np.ndarray]:
    w = Words(texts)
    d, k, v = w.features(p)
    z = np.bincount(d, weights=weights[k] * v, minlength=len(texts)) + weights[-1]
    return w.words, np.where(w.words > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0).round(6)


def _scorer(p: Quality, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                words, score = _scores(texts, weights, p)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(words), pa.array(score), pa.array(score >= p.threshold)], names=["doc_id", "n_words", "score", "kept"])

    return run


def _filter(p: Quality, weights: np.ndarray, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_scores(texts, weights, p)[1] >= p.threshold for _, texts in slices(batch.column(text_col))]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return run


def _fitter(p: Quality, weak: WeakModel):
    """Fits in the one task that has the sample, so that its texts never come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, target = [], [np.empty(0)]
        for batch in batches:
            for _, part in slices(batch.column(0)):
                w = Words(part)
                some = np.flatnonzero(w.words)
                texts.extend(part[i] for i in some)
                target.append(weak.posterior(votes(w.statistics(), w.words)[some]))
        weights = fit_linear(texts, np.concatenate(target), p)
        yield pa.RecordBatch.from_arrays([pa.array([weights], pa.list_(pa.float64()))], names=["weights"])

    return run


def _narrow(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Quality = Quality()) -> np.ndarray:
    """The scorer's weights: votes of all documents, posteriors, and a bounded sample's texts with their posteriors."""
    p, docs = params, _narrow(df, id_col, text_col)
    voted = Scratch(df.sparkSession, "quality").save(docs.mapInArrow(_vote, "doc_id long, votes long, n_words long, n_bytes long"))
    counts = {r.votes: r.n for r in voted.filter("n_words > 0").groupBy("votes").agg(F.count("*").alias("n")).collect()}  # 3^8 rows at most
    weak = maximise(counts, p.rounds) if counts else WeakModel(0.5, np.full((2, len(LABELLERS), 3), 1 / 3))
    chosen = voted.filter("n_words > 0 and doc_id is not null").select("doc_id", "n_bytes", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id", "n_bytes").limit(p.sample)
    up_to = Window.partitionBy().orderBy("h", "doc_id", "n_bytes").rowsBetween(Window.unboundedPreceding, 0)  # p.sample rows of numbers
    chosen = chosen.filter(F.col("n_bytes") <= p.sample_bytes // 4).withColumn("n_bytes", F.sum("n_bytes").over(up_to)).filter(F.col("n_bytes") <= p.sample_bytes).select("doc_id").distinct()
    rows = docs.join(F.broadcast(chosen), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(p.sample)  # at most p.sample ids are broadcast
    found = rows.select(F.col("text").cast("binary").alias("text")).mapInArrow(_fitter(p, weak), "weights array<double>").collect()  # one row of 2^bits + 1 numbers
    return np.array(found[0].weights) if found else np.zeros((1 << p.bits) + 1)


def classify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Quality = Quality()) -> DataFrame:
    """doc_id, n_words, score, kept for every row of ``df``."""
    return _narrow(df, id_col, text_col).mapInArrow(_scorer(params, fit(df, id_col, text_col, params)), "doc_id long, n_words long, score double, kept boolean")


def keep(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Quality = Quality()) -> DataFrame:
    """The rows of ``df``, with all columns, that are not rejected."""
    return df.mapInArrow(_filter(params, fit(df, id_col, text_col, params), text_col), df.schema)
