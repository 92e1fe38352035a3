"""Toxicity (operator 5): a support vector machine on a gap-weighted subsequence kernel, with Nystroem landmarks.

The unit of a sentence that is judged is the word, folded: case and accents of
letters go, digits that stand for letters become letters, marks inside a word
vanish, and runs of single letters ("i d i o t") are one word. A mark stands
before its first letter, so that how a word begins counts. The kernel of two
words is the sum over common subsequences of three letters, each weighted by
``DECAY`` to the power of the stretch it covers in either word (up to ``SPAN``
letters), so that gaps and inserted letters lower it only a little. The kernel
is divided by a norm that depends on the words' lengths.

Landmark words span the feature space (Nystroem); a linear machine with squared
hinge loss is trained on the landmark features of words from labelled sentences.
A labelled text only says that *some* word in it is toxic, so each toxic text
gives the words that the statistics of its letter runs tell apart, and in later
rounds the word that the machine itself finds toxic; a text without either gives
none. Words of clean texts are all negative, the hardest are mined again in each
round. As the decision is linear in the kernel, all landmarks fold into one
table over letter triples, and a text is scored in one pass over its letters.

A text's margin is that of its most toxic word; a logistic map above a floor,
fitted on the training texts, makes it a score. Words over ``STRETCH`` letters are judged in
overlapping stretches, so whole texts count. A null or empty text, or one
without letters, gets the score of the lowest margin. Without labels of both
classes every score is the base rate.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm import textbatch as tb
from lodestream.llm.labelled import held_out, sigmoid, training_sample

#: Bound of the training sample: documents of each class, and characters of each.
PER_CLASS = 4000
MAX_CHARS = 20_000
LANDMARKS = 256
#: Rounds of mining at most; it ends when the words found toxic and the hardest clean ones stand still.
ROUNDS = 10
#: Clean words drawn at first, kept and mined in each round.
HARD = 4000
#: Texts of either class that the map from margins to scores is fitted on at least; else it is fitted on all.
CALIBRATE = 30
DECAY = 0.7
SPAN = 5
STRETCH = 24
RUN = 5
#: How much less telling than the most telling run of all a run may be.
TOLD = 30

_FOLD = np.zeros(256, np.int32)
_FOLD[97:123] = _FOLD[65:91] = np.arange(1, 27)
_FOLD[128:192] = 27 + (np.arange(128, 192) & 31) % 5
for _a, _b in ("0o", "1i", "3e", "4a", "5s", "7t", "@a", "$s"):
    _FOLD[ord(_a)] = ord(_b) - 96
_STEPS = [(d, t) for t in range(2, SPAN) for d in range(1, t)]
_WEIGHT = {t: DECAY ** (t + 1) for t in range(2, SPAN)}
#: Norm of a word by its number of letters.
_NORM = np.sqrt([max(1e-9, sum(_WEIGHT[t] ** 2 * max(0, n - t) for _, t in _STEPS)) for n in range(STRETCH + 1)])


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters with a mark before each unit (folded word), the unit of each, the place where each unit begins, and its text."""
    starts, ends, first = tb.words(data, offsets)
    flag = np.zeros(len(data), np.int32)
    flag[starts] = 1
    letters = _FOLD[data]
    at = np.flatnonzero(letters)
    word = np.cumsum(flag)[at] - 1
    count = np.bincount(word, minlength=len(starts))
    full = np.flatnonzero(count)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))[full]
    single = count[full] == 1
    opens = np.ones(len(full), bool)
    opens[1:] = ~(single[1:] & single[:-1] & (doc[1:] == doc[:-1]))
    unit_of_word = np.cumsum(opens) - 1
    unit = np.repeat(unit_of_word, count[full])
    begin = np.concatenate([[0], np.cumsum(count[full])])[:-1][opens].astype(np.int64)
    # The mark of a unit is 0, which no letter is.
    marks = np.arange(len(begin))
    return np.insert(letters[at], begin, 0), np.insert(unit, begin, marks), begin + marks, doc[opens]


def contributions(letters: np.ndarray, unit: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Per letter the weighted table entries of the triples that begin there."""
    out = np.zeros(len(letters), np.float64)
    n = len(letters)
    for t in range(2, SPAN):
        if n <= t:
            break
        inside = unit[: n - t] == unit[t:]
        ends = (letters[: n - t] << 10) | letters[t:]
        found = np.zeros(n - t, table.dtype)
        for d in range(1, t):
            found += table[ends | (letters[d : n - t + d] << 5)]
        out[: n - t] += _WEIGHT[t] * found * inside
    return out


def stretches(begin: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and unit of the stretches that units are judged in."""
    end = np.append(begin[1:], total)
    size = end - begin
    many = np.where(size <= STRETCH, 1, -(-(size - STRETCH) // (STRETCH // 2)) + 1)
    unit = np.repeat(np.arange(len(begin)), many)
    nth = np.arange(len(unit)) - np.repeat(np.cumsum(many) - many, many)
    start = begin[unit] + nth * (STRETCH // 2)
    return start, np.minimum(start + STRETCH, end[unit]), unit


@dataclass
class Machine:
    table: np.ndarray
    bias: float
    slope: float
    offset: float
    lowest: float
    floor: float = 0.0

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per text the largest margin of its words."""
        out = np.full(len(offsets) - 1, self.lowest)
        letters, unit, begin, doc = fold(data, offsets)
        if len(begin):
            sums = np.concatenate([[0.0], np.cumsum(contributions(letters, unit, self.table))])
            start, end, of = stretches(begin, len(letters))
            value = (sums[end] - sums[start]) / _NORM[end - start] + self.bias
            _max_by(out, doc[of], np.where(end - start > 3, value, self.lowest))
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.floor + (1 - self.floor) * sigmoid(self.slope * self.margins(data, offsets) + self.offset)


def _max_by(out: np.ndarray, key: np.ndarray, value: np.ndarray) -> None:
    """Maximum by ascending keys."""
    at = np.flatnonzero(np.diff(key, prepend=-1))
    out[key[at]] = np.maximum(out[key[at]], np.maximum.reduceat(value, at))


def _vector(word: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Triple codes of a folded word, and their weights over its norm."""
    s = np.frombuffer(word, np.uint8).astype(np.int32)
    codes = [(s[: len(s) - t] << 10) | (s[d : len(s) - t + d] << 5) | s[t:] for d, t in _STEPS if len(s) > t]
    weights = [np.full(len(s) - t, _WEIGHT[t]) for _, t in _STEPS if len(s) > t]
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(codes), np.concatenate(weights) / _NORM[min(len(s), STRETCH)]


def _kernel(words: list[bytes], landmarks: np.ndarray) -> np.ndarray:
    """Kernel of each word with each landmark (rows of triple weights)."""
    out = np.zeros((len(words), len(landmarks)))
    columns = np.ascontiguousarray(landmarks.T)
    for k, word in enumerate(words):
        codes, weights = _vector(word)
        if len(codes):
            out[k] = weights @ columns[codes]
    return out


def _dense(words: list[bytes]) -> np.ndarray:
    out = np.zeros((len(words), 1 << 15))
    for k, word in enumerate(words):
        codes, weights = _vector(word)
        np.add.at(out[k], codes, weights)
    return out


def _hinge(z: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 20.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps on the active set, halved until the loss falls."""
    x = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w)) / c
    ridge[-1, -1] = 1e-6
    loss = lambda w: float((weight * np.maximum(1 - y * (x @ w), 0) ** 2).sum() + w @ ridge @ w)
    now = loss(w)
    for _ in range(60):
        active = y * (x @ w) < 1
        xa = x[active] * weight[active, None]
        step = np.linalg.solve(xa.T @ x[active] + ridge, xa.T @ y[active]) - w
        size, then = 1.0, loss(w + step)
        while then > now and size > 1e-4:
            size /= 2
            then = loss(w + size * step)
        if then >= now - 1e-9 * now:
            break
        w, now = w + size * step, then
    return w[:-1], float(w[-1])


def _units(text: str) -> list[bytes]:
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    letters, _, begin, _ = fold(raw, np.array([0, len(raw)]))
    start, end, _ = stretches(begin, len(letters)) if len(begin) else ([], [], None)
    data = letters.astype(np.uint8).tobytes()
    return sorted({data[a:b] for a, b in zip(start, end, strict=True) if b - a > 3})


def _runs(word: bytes) -> set[bytes]:
    return {word[i : i + RUN] for i in range(max(1, len(word) - RUN + 1))}


def _inserted(word: bytes) -> bytes:
    """The word with one letter put in, as in disguised insults; which and where follows from the word alone."""
    h = zlib.crc32(word)
    at = 2 + h % (len(word) - 2)
    return word[:at] + bytes([1 + h // 64 % 26]) + word[at:]


def fit(texts: list[str], y: np.ndarray, weight: np.ndarray) -> Machine:
    """Train on labelled texts; deterministic."""
    rate = float(np.average(y, weights=weight)) if len(y) else 0.5
    if len(set(y.tolist())) < 2:
        return Machine(np.zeros(1 << 15, np.float32), 0.0, 0.0, float(np.log((rate + 1e-3) / (1 - rate + 1e-3))), 0.0)
    # A fifth of the texts is kept for the map from margins to scores, if it holds enough of either class.
    aside = np.array([zlib.crc32(t.encode("utf-8", "replace")) % 5 == 0 for t in texts])
    kept: list[str] = []
    if min((y[aside] == c).sum() for c in (0, 1)) >= CALIBRATE and min((y[~aside] == c).sum() for c in (0, 1)) >= CALIBRATE:
        kept, kept_y, kept_weight = [t for t, out in zip(texts, aside, strict=True) if out], y[aside], weight[aside]
        texts, y, weight = [t for t, out in zip(texts, aside, strict=True) if not out], y[~aside], weight[~aside]
    bags = [_units(t) for t in texts]
    seen = [Counter(), Counter()]
    for bag, label in zip(bags, y, strict=True):
        seen[int(label)].update({r for u in bag for r in _runs(u)})
    n = [float((y == c).sum()) for c in (0, 1)]

    # Runs of a toxic text that clean texts hardly have, and that other toxic texts share.
    run_odds = {r: math.log((c + 0.1) / (n[1] + 1)) - math.log((seen[0][r] + 0.5) / (n[0] + 1)) for r, c in seen[1].items()}
    toxic = [bag for bag, label in zip(bags, y, strict=True) if label == 1 and bag]
    odds = {u: max(run_odds[r] for r in _runs(u)) for u in {u for bag in toxic for u in bag}}
    most = max(odds.values(), default=0.0)

    def told(bag: list[bytes]) -> set[bytes]:
        """Words nearly as telling as the most telling one of the text, if that is among the best of all; else none."""
        least = max(max(odds[u] for u in bag) - math.log(1.5), most - math.log(TOLD))
        return {u for u in bag if odds[u] >= least}

    positive = Counter(u for bag in toxic for u in told(bag))
    if not positive:  # nothing is told apart: the best word of each
        positive = Counter(max(bag, key=lambda u: (odds[u], u)) for bag in toxic) or Counter([b"\0\1\1\1"])
    common = Counter(u for bag, label in zip(bags, y, strict=True) if label == 0 for u in bag)
    clean = sorted(common)
    drawn = sorted(clean, key=lambda u: (zlib.crc32(u), u))  # an order that neither training nor Python's hashes change
    hard = sorted(drawn[:HARD])
    every = sorted({u for bag in bags for u in bag})
    place = {u: k for k, u in enumerate(every)}
    lengths = np.array([len(u) for u in every])
    flat = np.frombuffer(b"".join(every), np.uint8).astype(np.int32)
    owner = np.repeat(np.arange(len(every)), lengths)
    edges = np.concatenate([[0], np.cumsum(lengths)])

    def all_margins(table: np.ndarray, bias: float) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(contributions(flat, owner, table))])
        return (sums[edges[1:]] - sums[edges[:-1]]) / _NORM[lengths] + bias

    for _ in range(ROUNDS):
        ranked = sorted(positive, key=lambda u: (-positive[u], u))
        marks = ranked[: LANDMARKS // 2]
        marks += sorted(hard, key=lambda u: (zlib.crc32(u, 1), u))[: LANDMARKS - len(marks)]
        rows = _dense(sorted(set(marks)))
        value, vector = np.linalg.eigh(rows @ rows.T)
        keep = value > 1e-6 * value[-1]
        root = vector[:, keep] / np.sqrt(value[keep])
        words = [*ranked, *map(_inserted, ranked), *hard]
        sure = 2 * len(ranked)
        label = np.array([1.0] * sure + [-1.0] * len(hard))
        weights = np.sqrt([positive[u] for u in ranked])
        each = np.array([*weights * 2, *weights, *np.sqrt([common[u] for u in hard])])  # words of many clean texts weigh as much
        each[:sure] *= each[sure:].sum() / each[:sure].sum()
        w, bias = _hinge(_kernel(words, rows) @ root, label, each)
        table = (rows.T @ (root @ w)).astype(np.float32)
        margin = all_margins(table, bias)
        best_word = [max(bag, key=lambda u: (margin[place[u]], u)) for bag in toxic]
        before = set(positive)
        positive = Counter(u for bag, best in zip(toxic, best_word, strict=True) for u in told(bag) | ({best} if margin[place[best]] > 0 else set())) or positive
        worst = sorted(clean, key=lambda u: (-margin[place[u]], u))[:HARD]
        if set(positive) == before and set(worst) <= set(hard):
            break
        hard = sorted({*sorted(hard, key=lambda u: (zlib.crc32(u, 2), u))[:HARD], *worst})
    lowest = float(margin.min())
    best = np.array([max((margin[place[u]] for u in bag), default=lowest) for bag in bags])
    if len(kept):  # margins of texts that the machine was not trained on are the honest ones
        machine = Machine(table, bias, 1.0, 0.0, lowest)
        raw = [t.encode("utf-8", "replace") for t in kept]
        best = machine.margins(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        y, weight = kept_y, kept_weight
    # Some toxic texts have no word that tells, whatever their margin: a floor below which no score falls. The logistic map
    # is fitted to the others, each toxic text counting by how likely its word told.
    low = best <= np.median(best[y == 0])
    floor = float(np.clip(np.average(y[low], weights=weight[low]), 0, 0.4))
    slope, offset = 1.0, 0.0
    for _ in range(120):
        p = sigmoid(slope * best + offset)
        told_by = y * (1 - floor) * p / (floor + (1 - floor) * p)
        g, h = weight * (p - told_by), weight * np.maximum(p * (1 - p), 1e-6)
        m = np.array([[(h * best * best).sum() + 1e-1, (h * best).sum()], [(h * best).sum(), h.sum() + 1e-6]])
        ds, do = np.linalg.solve(m, [(g * best).sum() + 1e-1 * (slope - 4), g.sum()])
        slope, offset = slope - np.clip(ds, -1, 1), offset - np.clip(do, -1, 1)
    return Machine(table, bias, float(slope), float(offset), lowest, floor)


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    return fit(*training_sample(docs, labels, "toxic", PER_CLASS, MAX_CHARS))


def score_toxicity(docs: DataFrame, model: Machine, threshold: float = 0.5) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> (doc_id, held_out, score, predicted), one row per input row, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in tb.pieces(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(model.score(data, offsets))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(tb.task(run), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
