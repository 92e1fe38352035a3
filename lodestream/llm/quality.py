"""Quality classifier (operator 1): a factorisation machine.

Features of a text are hashed words (square roots of their shares, so that the
words of a text have unit length), statistics of its structure, and metadata
(its length). The machine adds to a linear score the pairwise interactions of
all features through vectors of rank ``RANK``, by the identity

    sum_{i<j} <v_i, v_j> x_i x_j = (|sum_i v_i x_i|^2 - sum_i |v_i|^2 x_i^2) / 2,

so scoring is linear in the number of features. It is fitted with Adam on a
bounded sample of labelled rows and then scores every whole text in one pass
without a shuffle. Labels, language, source and id are never features.

A null text counts as empty and gets a score as any other; without labels of
both classes every score is 0.5. Repeated rows each get their row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm import textbatch as tb
from lodestream.llm.labelled import held_out, sigmoid, training_sample
from lodestream.llm.store import bounded_batches

BUCKETS = 2048
RANK = 8
#: Bound of the training sample: documents of each class, and characters of each.
PER_CLASS = 4000
MAX_CHARS = 20_000

_UPPER, _DIGIT, _ALPHA, _MARK, _SYMBOL, _HIGH = (np.zeros(256, np.float32) for _ in range(6))
_UPPER[65:91] = 1
_DIGIT[48:58] = 1
_ALPHA[65:91] = _ALPHA[97:123] = 1
_HIGH[128:] = 1
for _c in b".,;:!?'\"()-":
    _MARK[_c] = 1
for _c in b"#*$%&@~^|<>{}[]\\/_=+`":
    _SYMBOL[_c] = 1
_CLASSES = [_UPPER, _DIGIT, _ALPHA, _MARK, _SYMBOL, _HIGH]
_SINGLE = [ord(c) for c in ".,!?|\n"]
N_STRUCTURE = len(_CLASSES) + len(_SINGLE) + 12


@dataclass
class Features:
    """Present words as (text, bucket, value), by text, and ``N_STRUCTURE`` statistics of each text (not yet standardised)."""

    text: np.ndarray
    bucket: np.ndarray
    value: np.ndarray
    stats: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros((len(self.stats), BUCKETS + N_STRUCTURE), np.float32)
        out[self.text, self.bucket] = self.value
        out[:, BUCKETS:] = self.stats
        return out


def features(data: np.ndarray, offsets: np.ndarray) -> Features:
    n = len(offsets) - 1
    starts, ends, first = tb.words(data, offsets)
    hashes = tb.hash_words(data, starts, ends)
    many = np.diff(first)
    doc = np.repeat(np.arange(n), many)
    spots, counts = np.unique(doc * BUCKETS + (hashes >> np.uint64(20)).astype(np.int64) % BUCKETS, return_counts=True)
    text, bucket = spots // BUCKETS, spots % BUCKETS
    some = np.maximum(many, 1).astype(np.float32)
    value = np.sqrt(counts / some[text]).astype(np.float32)
    size = np.maximum(np.diff(offsets), 1).astype(np.float32)

    def per_byte(values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.float64)])[offsets])

    def per_word(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc, values, minlength=n) / some

    columns = [per_byte(t[data]) / size for t in _CLASSES] + [per_byte(data == c) / size for c in _SINGLE]
    length = (ends - starts).astype(np.float32)
    same = np.zeros(len(starts), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    last, head = data[ends - 1], data[starts]
    lines = per_byte(data == 10) + 1
    most = np.zeros(n)
    np.maximum.at(most, text, counts)
    columns += [
        np.log1p(size), np.log1p(many), per_word(length), np.log1p(size / lines),
        per_word(length == 1), per_word(length > 16), per_word(same), per_word(_SYMBOL[last]), per_word(_MARK[last]), per_word(_UPPER[head]),
        np.bincount(text, minlength=n) / np.minimum(some, BUCKETS), most / some,
    ]
    return Features(text, bucket, value, np.stack(columns, 1).astype(np.float32))


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def prepare(self, x: np.ndarray) -> np.ndarray:
        x[:, BUCKETS:] = np.clip((x[:, BUCKETS:] - self.mean) / self.scale, -4, 4) / 2
        return x

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Score of prepared rows in time linear in the features."""
        return self.bias + x @ self.linear + 0.5 * (((x @ self.factors) ** 2).sum(1) - (x * x) @ (self.factors**2).sum(1))

    def margin_of(self, f: Features) -> np.ndarray:
        """The same from the words that are present alone: their rows are gathered and summed by text."""
        s = np.clip((f.stats - self.mean) / self.scale, -4, 4) / 2
        linear, factors, n = self.linear[BUCKETS:], self.factors[BUCKETS:], len(s)
        known, squares = self.factors[f.bucket] * f.value[:, None], (self.factors**2).sum(1)
        sums = np.stack([np.bincount(f.text, known[:, r], minlength=n) for r in range(known.shape[1])], 1) + s @ factors
        own = np.bincount(f.text, squares[f.bucket] * f.value**2, minlength=n) + (s * s) @ squares[BUCKETS:]
        return self.bias + np.bincount(f.text, self.linear[f.bucket] * f.value, minlength=n) + s @ linear + 0.5 * ((sums**2).sum(1) - own)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin_of(features(data, offsets)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 25, batch: int = 256, rate: float = 0.01, decay: float = 1e-4) -> FactorisationMachine:
    """Weighted logistic loss, Adam, fixed seed. ``x`` holds dense :class:`Features` and is standardised in place."""
    rng = np.random.default_rng(11)
    if len(set(y.tolist())) < 2:
        width = BUCKETS + N_STRUCTURE
        return FactorisationMachine(0.0, np.zeros(width, np.float32), np.zeros((width, RANK), np.float32), np.zeros(N_STRUCTURE, np.float32), np.ones(N_STRUCTURE, np.float32))
    rows = x[:, BUCKETS:]
    fm = FactorisationMachine(
        float(np.log(np.average(y, weights=weight) / (1 - np.average(y, weights=weight)))),
        np.zeros(x.shape[1], np.float32), rng.normal(0, 0.02, (x.shape[1], RANK)).astype(np.float32),
        rows.mean(0), rows.std(0) + 1e-3,
    )
    fm.prepare(x)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (fm.linear, fm.factors)]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            pick = order[at : at + batch]
            xb, step = x[pick], step + 1
            g = (weight[pick] * (sigmoid(fm.margin(xb).astype(np.float64)) - y[pick]) / len(pick)).astype(np.float32)
            fm.bias -= rate * float(g.sum())
            grads = (xb.T @ g + decay * fm.linear, xb.T @ (g[:, None] * (xb @ fm.factors)) - ((xb * xb).T @ g)[:, None] * fm.factors + decay * fm.factors)
            now = rate * (1 - epoch / epochs) + 1e-4
            for p, grad, (m, v) in zip((fm.linear, fm.factors), grads, state, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return fm


def train(docs: DataFrame, labels: DataFrame) -> FactorisationMachine:
    texts, y, weight = training_sample(docs, labels, "quality", PER_CLASS, MAX_CHARS)
    rows = [features(d, o).dense() for _, d, o in tb.pieces(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]), "text")]
    return fit(np.concatenate(rows) if rows else np.zeros((0, BUCKETS + N_STRUCTURE), np.float32), y, weight)


def score_quality(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.3) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> (doc_id, held_out, score, predicted), one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in tb.pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(model.score(data, offsets))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    bounded_batches(docs.sparkSession)
    scored = docs.select("doc_id", "text").mapInArrow(tb.task(run), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.3) -> DataFrame:
    """Rows of ``docs``, all columns, whose score reaches ``threshold``; in one pass, without a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in tb.pieces(batch, "text"):
                yield rows.filter(pa.array(model.score(data, offsets) >= threshold))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(tb.task(run), docs.schema)
