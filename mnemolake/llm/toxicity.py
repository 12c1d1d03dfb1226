"""Toxicity by non-negative positive-unlabelled learning on hashed word presence.

Positives are documents that labels mark toxic; everything else of the training part is unlabelled text, also what
labels mark clean. With class prior p, the risk of a linear model is p R+(positives) + max(0, R-(unlabelled) -
p R-(positives)): where the corrected negative part falls below zero, its gradient is reversed. The prior is the toxic
share of labelled training rows, or a parameter.

The classifier is fitted in numpy on a bounded sample (``max_positive`` and ``max_unlabelled`` documents, chosen by a
hash of the id). Features are words and stems that a share of ``min_share`` of the sampled positives have. Scoring covers all rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import WordHasher, byte_class, mix
from mnemolake.llm.tokens import map_texts

MAX_POSITIVE, MAX_UNLABELLED = 3000, 9000
#: A feature must occur in this share of the sampled positives, and in 3 of them (or all, if there are fewer).
MIN_SHARE = 0.01
PREDICTED_FROM = 0.7
#: Letters, and every character beyond ASCII.
LETTER_WORDS = byte_class(lambda i: i >= 0x80 or chr(i).isalpha())


class Features(WordHasher):
    """Hashes of each word and of its first 4 and 5 bytes (so that endings don't hide a stem): three for a word."""

    def segment(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, ends, hashes = super().segment(data)
        raw = np.frombuffer(data, np.uint8)
        out = np.empty((len(starts), 3), np.uint64)
        out[:, 0] = hashes
        reach = np.zeros(len(starts), np.uint64)
        for k in range(5):
            at = np.minimum(starts + k, len(raw) - 1)
            reach = reach * np.uint64(257) + np.where(starts + k < ends, self.lower[raw[at]].astype(np.uint64) + np.uint64(1), np.uint64(0))
            if k > 2:
                out[:, k - 2] = mix(reach + np.uint64(k << 56))
        return starts, ends, out.ravel()

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        hashes, first = super().texts(texts)
        return hashes, first * 3


@cache
def features() -> Features:
    """One for each process."""
    return Features(LETTER_WORDS)


@dataclass
class Model:
    """Weights of words by hash (sorted), and the bias."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probabilities for texts given as word hashes; ``first`` has where each text's words begin."""
        total = np.full(len(first) - 1, self.bias)
        if len(self.words) and len(hashes):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            spot = np.flatnonzero(self.words[at] == hashes)
            doc = np.searchsorted(first, spot, "right") - 1
            pairs = np.unique(doc * len(self.words) + at[spot])
            np.add.at(total, pairs // len(self.words), self.weights[pairs % len(self.words)])
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, min_share: float = MIN_SHARE, rounds: int = 1500, rate: float = 0.05, l2: float = 3e-5) -> Model:
    """Non-negative PU risk, logistic loss, full-batch Adam. Each document: its distinct word hashes."""
    if not positive or not 0 < prior < 1:
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))
    words, counts = np.unique(np.concatenate(positive), return_counts=True)
    words = words[counts >= max(min(3, len(positive)), min_share * len(positive))]
    seen = np.concatenate([np.zeros(0, np.uint64), *unlabelled])
    at = np.searchsorted(words, seen)
    at = at[(at < len(words)) & (words[np.minimum(at, len(words) - 1)] == seen)] if len(words) else np.zeros(0, np.int64)
    share_u = np.bincount(at, minlength=len(words)) / max(1, len(unlabelled))
    share_p = np.bincount(np.searchsorted(words, w := np.concatenate(positive))[np.isin(w, words)], minlength=len(words)) / len(positive)
    # Words that positives have no more often than other text, or only by chance (four deviations), add noise.
    floor = np.maximum(share_u, 1 / max(1, len(unlabelled)))
    words = words[(share_p > 2 * share_u) & (share_p - share_u > 4 * np.sqrt(floor * (1 - np.minimum(floor, 0.999)) / len(positive)))]

    def matrix(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate([np.zeros(0, np.uint64), *docs])
        at = np.minimum(np.searchsorted(words, flat), max(len(words) - 1, 0))
        ok = words[at] == flat if len(words) else np.zeros(len(flat), bool)
        return np.repeat(np.arange(len(docs)), [len(d) for d in docs])[ok], at[ok]

    (pr, pc), (ur, uc) = matrix(positive), matrix(unlabelled)
    n, m, k = len(positive), max(1, len(unlabelled)), len(words)
    theta, mean, var = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    theta[k] = np.log(prior / (1 - prior))

    def margin(rows: np.ndarray, cols: np.ndarray, count: int) -> np.ndarray:
        return theta[k] + np.bincount(rows, theta[cols], count)

    def back(rows: np.ndarray, cols: np.ndarray, g: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(cols, g[rows], k) if k else np.zeros(0), g.sum())

    for step in range(1, rounds + 1):
        zp, zu = margin(pr, pc, n), margin(ur, uc, m)
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        rest = back(ur, uc, su / m) - prior * back(pr, pc, sp / n)
        grad = prior * back(pr, pc, (sp - 1) / n) + rest if negative >= 0 else -rest
        grad[:k] += l2 * theta[:k] / max(1, k) ** 0.5
        mean, var = 0.9 * mean + 0.1 * grad, 0.999 * var + 0.001 * grad**2
        theta -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.999**step)) + 1e-8)
    return Model(words, theta[:k], float(theta[k]))


def _sample(docs: DataFrame, id_col: str, text_col: str, count: int, most: int) -> list[np.ndarray]:
    """Distinct word hashes of about ``most`` documents at most, by a hash of the id."""
    hashed = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30))
    some = docs.where(hashed < int((1 << 30) * min(1.0, 0.9 * most / max(1, count)))) if count > most else docs

    def work(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        hashes, first = features().texts(texts)
        each = [np.unique(hashes[a:b]).tobytes() for a, b in zip(first, first[1:])]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(each, pa.binary())], names=[id_col, "words"])

    got = map_texts(some, work, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, words binary", [id_col], text_col)
    rows = sorted((str(r[0]), bytes(r[1])) for r in got.limit(most).collect())
    return [np.frombuffer(w, np.uint64) for _, w in rows]


def learn(docs: DataFrame, labels: DataFrame, train: Column, prior: float | None = None, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Fit on the documents for which ``train`` (of the id column) is true. A document is positive if any label says so."""
    said = labels.where(F.col(id_col).isNotNull() & train).groupBy(F.col(id_col)).agg(F.max(F.col(toxic_col).cast("int")).alias("_toxic"))
    known, toxic = said.where("_toxic is not null").agg(F.count("*"), F.coalesce(F.sum("_toxic"), F.lit(0))).first()
    own = docs.where(train).select(id_col, text_col)
    total = own.count()
    prior = prior if prior is not None else min(0.9, max(1e-4, toxic / known)) if known else 0.0
    marked = said.where("_toxic = 1").select(id_col)
    positive = _sample(own.join(marked, id_col, "left_semi"), id_col, text_col, toxic, max_positive) if toxic else []
    # Positives are part of the unlabelled text too, at their own rate.
    unlabelled = _sample(own, id_col, text_col, total, max_unlabelled)
    return fit(positive, unlabelled, prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", at_least: float = PREDICTED_FROM) -> DataFrame:
    """Rows (id, score, predicted): score in 0 to 1, predicted 1 from ``at_least`` on. Null and empty texts get the bias."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        hashes, first = features().texts(texts)
        s = shared.value.scores(hashes, first)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= at_least).astype(np.int32))], names=[id_col, "score", "predicted"])

    return map_texts(docs, work, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double, predicted int", [id_col], text_col)


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part`` (a null id: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))
