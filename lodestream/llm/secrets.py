"""Secret scans (operator 9): base patterns plus a character convolutional network in numpy.

Three base patterns always count. Every other token that could be a secret (16
characters or more with letters and digits) goes with its context to a small
convolutional network: character embeddings, one convolution, maxima over the
token and over the context before it, and a logistic output. The network is
trained here on labelled findings drawn from a seeded generator of secret and
harmless shapes (:func:`labelled_findings`); a logistic map fitted on findings
that training has not seen calibrates it, and the threshold is the largest one
that still recalls ``RECALL`` of the secrets among them. That recall is of the
generator's shapes; for other corpora, train on findings of their own.

Tokens longer than the network's view are scored in overlapping views. Texts are
scanned whole; null and empty texts have no findings. Spans are in code points,
end exclusive, those of whole matches. A first pass over the bytes of a piece
only finds texts that can match at all; the patterns then run on those texts.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lodestream.llm import textbatch as tb
from lodestream.llm.labelled import sigmoid
from lodestream.llm.store import bounded_batches

KINDS = ("assign", "access", "hex", "cnn")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so this keeps the runs of 24 and more
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_LETTER, _DIGIT = re.compile(r"[A-Za-z]"), re.compile(r"[0-9]")
LEFT, VIEW, RIGHT = 24, 48, 8
WIDTH = LEFT + VIEW + RIGHT
#: Views that are held and scored at a time.
VIEWS = 512
#: Share of labelled secrets that the threshold must recall.
RECALL = 0.97

_SYMBOLS = np.zeros(128, np.int64)
for _k, _c in enumerate("abcdefghijklmnopqrstuvwxyz", 1):
    _SYMBOLS[ord(_c)] = _k
    _SYMBOLS[ord(_c.upper())] = 26 + _k
for _k, _c in enumerate("0123456789", 53):
    _SYMBOLS[ord(_c)] = _k
for _k, _c in enumerate(" \n\"'=:+/_-.,@#()[]{}<>&?;", 63):
    _SYMBOLS[ord(_c)] = _k
N_SYMBOLS = 63 + 25 + 1
_OTHER = N_SYMBOLS - 1


def _view(text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a view (0 beyond the text) and the flags of the token's own places."""
    left = text[max(0, start - LEFT) : start]
    body = text[start : min(end, start + VIEW)]
    right = text[end : end + RIGHT] if end <= start + VIEW else ""
    codes = np.zeros(WIDTH, np.int64)
    for at, part in ((LEFT - len(left), left), (LEFT, body), (LEFT + len(body), right)):
        for k, c in enumerate(part):
            n = ord(c)
            codes[at + k] = (_SYMBOLS[n] or _OTHER) if n < 128 else _OTHER
    inside = np.zeros(WIDTH, bool)
    inside[LEFT : LEFT + len(body)] = True
    return codes, inside


def view_starts(start: int, end: int) -> range:
    """Where the views of a token begin; each half overlaps the next."""
    return range(start, max(start + 1, end - VIEW // 2), VIEW // 2)


def _token(rng: np.random.Generator, alphabet: str, low: int, high: int) -> str:
    return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), int(rng.integers(low, high + 1))))


def labelled_findings(n: int, seed: int) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """``n`` findings (text, start, end) and their labels: secret shapes in key-like and plain contexts, and harmless look-alikes."""
    rng = np.random.default_rng(seed)
    low, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alnum, hexa = low + low.upper() + digits, digits + "abcdef"
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    word = lambda: "".join(pick(["th", "er", "on", "an", "re", "in", "ed", "nd", "ha", "en", "of", "st", "to", "la", "ci", "sch", "ung"]) for _ in range(int(rng.integers(1, 5))))
    secret = [
        lambda: _token(rng, hexa, 16, 23), lambda: _token(rng, alnum, 20, 44), lambda: _token(rng, alnum + "+/", 30, 60) + pick(["", "=", "=="]),
        lambda: pick(["ghp_", "gho_", "xoxb-", "sk_live_", "sk-", "glpat-", "npm_", "pk_live_"]) + _token(rng, alnum, 16, 40),
        lambda: "eyJ" + _token(rng, alnum + "_-", 30, 90), lambda: _token(rng, hexa.upper(), 32, 64), lambda: "AIza" + _token(rng, alnum + "_-", 30, 36),
    ]
    harmless = [
        lambda: word() + word() + word() + word() + pick(digits), lambda: "_".join(word() for _ in range(4)) + "_v" + pick(digits),
        lambda: "-".join(word() for _ in range(4)) + "-" + _token(rng, digits, 1, 4), lambda: "/".join(["", word(), word(), _token(rng, digits, 4, 4), word(), word()]),
        lambda: f"{2000 + int(rng.integers(30))}-{int(rng.integers(10, 13))}-{int(rng.integers(10, 29))}T{_token(rng, digits, 6, 6)}Z",
        lambda: "".join(word().capitalize() for _ in range(4)) + _token(rng, digits, 1, 3), lambda: pick(alnum) * int(rng.integers(12, 30)) + "1a",
        lambda: word() + "=" + word() + word() + word() + "=" + _token(rng, digits, 1, 3), lambda: "-" * int(rng.integers(8, 20)) + word() + _token(rng, digits, 1, 3) + "=" * 9,
        lambda: word() + _token(rng, digits, 12, 18), lambda: _token(rng, digits, 4, 4) + "-" + _token(rng, digits, 4, 4) + "-" + word() + word() + word(),
    ]
    found, labels = [], []
    for _ in range(n):
        y = int(rng.random() < 0.5)
        token = pick(secret if y else harmless)()
        token = token if len(token) >= 16 else token + word() * 4 if not y else token + _token(rng, hexa, 16, 16)
        before = " ".join(word() for _ in range(int(rng.integers(0, 5))))
        if y and rng.random() < 0.6:
            before += " " + pick(["Bearer ", "key=", "auth: ", "credential = \"", "access_key: ", "private_key=", "export KEY=", "Authorization: ", "client id "])
        else:
            before += pick([" ", " ", ": ", " \"", "(", "\n", " id=", " see "])
        after = pick([" ", "\"", "\n", ".", ", ", ")###", ""]) + word()
        found.append((before + token + after, len(before), len(before) + len(token)))
        labels.append(y)
    return found, np.array(labels, np.float64)


@dataclass
class CharCnn:
    """Embedding, convolution of width ``SPAN``, two maxima, logistic output; then a calibrated threshold."""

    embed: np.ndarray
    kernel: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5

    SPAN, FILTERS, DEPTH = 5, 32, 8

    @staticmethod
    def fresh(seed: int = 3) -> CharCnn:
        rng, s = np.random.default_rng(seed), CharCnn
        return CharCnn(rng.normal(0, 0.5, (N_SYMBOLS, s.DEPTH)), rng.normal(0, 0.15, (s.SPAN * (s.DEPTH + 1), s.FILTERS)), np.zeros(s.FILTERS), rng.normal(0, 0.1, 3 * s.FILTERS), 0.0)

    def forward(self, codes: np.ndarray, inside: np.ndarray) -> dict:
        n, places = len(codes), WIDTH - self.SPAN + 1
        x = np.concatenate([self.embed[codes] * (codes > 0)[..., None], inside[..., None]], 2)
        columns = np.stack([x[:, k : k + places] for k in range(self.SPAN)], 2).reshape(n * places, -1)
        h = np.maximum(columns @ self.kernel + self.shift, 0).reshape(n, places, -1)
        own = inside[:, self.SPAN // 2 : self.SPAN // 2 + places, None]
        top, before = np.where(own, h, -1).argmax(1), np.where(own, -1, h).argmax(1)
        share = (h * own).sum(1) / np.maximum(own.sum(1), 1)
        rows, f = np.arange(n)[:, None], np.arange(self.FILTERS)[None]
        pooled = np.concatenate([h[rows, top, f], h[rows, before, f], share], 1)
        return {"columns": columns, "h": h, "own": own, "top": top, "before": before, "pooled": pooled, "z": pooled @ self.out + self.bias}

    def margins(self, codes: np.ndarray, inside: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(codes[k : k + 512], inside[k : k + 512])["z"] for k in range(0, len(codes), 512)] or [np.zeros(0)])

    def probabilities(self, codes: np.ndarray, inside: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.margins(codes, inside) + self.offset)

    def step(self, codes: np.ndarray, inside: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Gradients of the logistic loss: embedding, kernel, shift, output, bias."""
        c, n, f = self.forward(codes, inside), len(codes), self.FILTERS
        g = (sigmoid(c["z"]) - y) / n
        gp = g[:, None] * self.out
        gh = np.zeros_like(c["h"])
        rows, cols = np.arange(n)[:, None], np.arange(f)[None]
        np.add.at(gh, (rows, c["top"], cols), gp[:, :f])
        np.add.at(gh, (rows, c["before"], cols), gp[:, f : 2 * f])
        gh += c["own"] * (gp[:, 2 * f :] / np.maximum(c["own"].sum(1), 1))[:, None, :]
        gh = (gh * (c["h"] > 0)).reshape(-1, f)
        gx = (gh @ self.kernel.T).reshape(n, WIDTH - self.SPAN + 1, self.SPAN, -1)
        spread = np.zeros((n, WIDTH, self.DEPTH))
        for k in range(self.SPAN):
            spread[:, k : k + WIDTH - self.SPAN + 1] += gx[:, :, k, : self.DEPTH]
        ge = np.zeros_like(self.embed)
        np.add.at(ge, codes[codes > 0], spread[codes > 0])
        return [ge, c["columns"].T @ gh, gh.sum(0), c["pooled"].T @ g, np.array(g.sum())]


def _encode(found: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    made = [_view(*f) for f in found]
    return np.array([m[0] for m in made]), np.array([m[1] for m in made])


@lru_cache(maxsize=2)
def train(findings: int = 4000, epochs: int = 8) -> CharCnn:
    """Fit, calibrate and set the threshold; deterministic, a few seconds on one core, once in a driver process."""
    net = CharCnn.fresh()
    found, y = labelled_findings(findings, 1)
    codes, inside = _encode(found)
    rng, step = np.random.default_rng(9), 0
    params = [net.embed, net.kernel, net.shift, net.out, np.array(0.0)]
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 64):
            pick, step = order[at : at + 64], step + 1
            net.bias = float(params[4])
            for p, g, (m, v) in zip(params, net.step(codes[pick], inside[pick], y[pick]), state, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.004 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.bias = float(params[4])
    found, y = labelled_findings(findings // 2, 2)
    z = net.margins(*_encode(found))
    for _ in range(30):
        p = sigmoid(net.slope * z + net.offset)
        w = np.maximum(p * (1 - p), 1e-6)
        hess = np.array([[(w * z * z).sum() + 1.0, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        ds, do = np.linalg.solve(hess, [((p - y) * z).sum() + (net.slope - 1), (p - y).sum()])
        net.slope, net.offset = net.slope - float(np.clip(ds, -1, 1)), net.offset - float(np.clip(do, -1, 1))
    secrets = np.sort(sigmoid(net.slope * z + net.offset)[y == 1])
    net.threshold = float(secrets[int((1 - RECALL) * len(secrets))])
    return net


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Tokens that may be secrets and overlap no base finding."""
    starts, ends = [], []  # of the base findings, joined where they overlap
    for start, _, end in base:
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    out = []
    for m in TOKEN.finditer(text):
        if _LETTER.search(m[0]) and _DIGIT.search(m[0]):
            k = bisect_left(starts, m.end()) - 1  # the last finding that begins before the token ends
            if k < 0 or ends[k] <= m.start():
                out.append(m.span())
    return out


def _run_of(data: np.ndarray, offsets: np.ndarray, members: np.ndarray, least: int) -> np.ndarray:
    """Which texts hold a run of at least ``least`` member bytes."""
    stops = np.concatenate([[-1], np.flatnonzero(~members[data]), [len(data)]])
    wide = np.flatnonzero(np.diff(stops) > least)
    out = np.zeros(len(offsets) - 1, bool)
    for k in wide:  # a run may go on over the edge of a text: then both sides are looked at
        a, b = stops[k] + 1, stops[k + 1]
        first, last = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b, "left")
        out[first:last] = True
    return out


_HEX_BYTES, _TOKEN_BYTES = np.zeros(256, bool), np.zeros(256, bool)
_HEX_BYTES[list(b"0123456789abcdef")] = True
_TOKEN_BYTES[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-")] = True


def find(batch: pa.RecordBatch, net: CharCnn) -> Iterator[tuple[pa.RecordBatch, list[str], list[list[tuple[int, int, int]]]]]:
    """Per piece of a batch its texts and the findings of each text in order."""
    for rows, data, offsets in tb.pieces(batch, "text"):
        texts = pc.fill_null(rows.column("text"), "").to_pylist()
        signs = np.concatenate([[0], np.cumsum((data == 58) | (data == 61))])
        may = (np.diff(signs[offsets]) > 0) | _run_of(data, offsets, _TOKEN_BYTES, 16) | _run_of(data, offsets, _HEX_BYTES, 24)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        held: list[tuple[tuple[int, int, int], np.ndarray, np.ndarray]] = []
        secret: set[tuple[int, int, int]] = set()

        def judge() -> None:
            if held:
                sure = net.probabilities(np.array([h[1] for h in held]), np.array([h[2] for h in held])) >= net.threshold
                secret.update(h[0] for h, s in zip(held, sure, strict=True) if s)
                held.clear()

        for k in np.flatnonzero(may).tolist():
            found[k] = base_spans(texts[k])
            for start, end in candidates(texts[k], found[k]):
                for at in view_starts(start, end):
                    held.append(((k, start, end), *_view(texts[k], at, end)))
                    if len(held) == VIEWS:
                        judge()
        judge()
        for k, start, end in secret:
            found[k].append((start, 3, end))
        yield rows, texts, [sorted(f) for f in found]


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, net: CharCnn) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> (doc_id, n_assign, n_access, n_hex, n_cnn, base_sha256, spans), one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, found in find(batch, net):
                counts = [[sum(kind == k for _, kind, _ in f) for f in found] for k in range(4)]
                digest = [hashlib.sha256(_said([s for s in f if s[1] < 3]).encode()).hexdigest() for f in found]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digest, pa.string()), pa.array([_said(f) for f in found], pa.string())],
                    ["doc_id", "n_assign", "n_access", "n_hex", "n_cnn", "base_sha256", "spans"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(tb.task(run), f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_cnn long, base_sha256 string, spans string")


def redact(docs: DataFrame, net: CharCnn, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every finding in ``text`` replaced by ``mark``; ``n_chars``, if present, follows. No row goes."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts, found in find(batch, net):
                was_null = rows.column("text").is_null().to_pylist()
                new = []
                for text, spans in zip(texts, found, strict=True):
                    out, at = [], 0
                    for start, _, end in spans:
                        if start >= at:
                            out += [text[at:start], mark]
                        at = max(at, end)
                    new.append("".join([*out, text[at:]]))
                columns = {n: rows.column(n) for n in names}
                columns["text"] = pa.array([None if null else t for t, null in zip(new, was_null, strict=True)], pa.string())
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([None if null else len(t) for t, null in zip(new, was_null, strict=True)]).cast(columns["n_chars"].type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(tb.task(run), docs.schema)
