"""SentencePiece encoding and decoding (operator 2): shared-prefix Viterbi over a trie of distinct words.

A text is escaped as the model asks (blanks become the mark U+2581, one mark in
front) and cut before each run of marks; no piece of the model crosses such a
cut, which loading the vocabulary verifies. The distinct marked words of a batch
are sorted, which lays them out as a depth-first traversal of their trie: each
word keeps the forward states of the prefix that it shares with the word before
it, and only extends them. Known words come from a bounded cache.

The forward state of a prefix is its best last piece.

* For a unigram model it is the piece that maximises the sum of scores.
* For a byte-pair model sums of scores do not give the model's segmentation.
  There a step has weight 0 where the two adjacent pieces are stable (merging
  their joined text gives back just these two) and minus infinity otherwise;
  exactly one path survives for every prefix, and it is what greedy merging
  gives. Whether two pieces are stable is found by merging once and remembered.

Characters that the vocabulary lacks become byte pieces. Decoding joins the
pieces' bytes and drops the mark in front. A literal U+2581 in a text reads as a
blank afterwards, as in the model's own library; every other text returns
exactly. Null and empty texts have no pieces. Texts are never cut short; the
work needs no shuffle, and a lost task is simply run again.
"""

from __future__ import annotations

import math
import re
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm import textbatch as tb
from lodestream.llm.store import bounded_batches

MARK = "▁"
#: Words that a worker remembers; longer words than this many characters are never kept.
CACHE_WORDS, CACHE_CHARS, CACHE_PAIRS = 150_000, 48, 500_000
UNIGRAM, BPE = 1, 2
_UNKNOWN, _NOTHING = -1, -2
_SHORT = (2, 1)
_WORD = re.compile(f"{MARK}+[^{MARK}]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Vocabulary:
    """Pieces of a model by id, with scores; ``byte_ids`` are the pieces that stand for bytes."""

    kind: int
    ids: dict[str, int]
    scores: list[float]
    byte_ids: list[int]
    surface: list[bytes]
    #: Lengths of the pieces that end with some three characters, with 2 and 1, falling.
    ends: dict[str, tuple[int, ...]] = field(default_factory=dict)
    name: str = ""

    @staticmethod
    def load(model: str | bytes, kind: int = BPE) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(**({"model_proto": model} if isinstance(model, bytes) else {"model_file": model}))
        ids, scores, byte_ids, surface = {}, [], [0] * 256, []
        for k in range(sp.vocab_size()):
            piece = sp.id_to_piece(k)
            scores.append(sp.get_score(k))
            surface.append(b"")
            if sp.is_byte(k):
                byte_ids[int(piece[3:5], 16)] = k
                surface[-1] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)):
                if re.search(f"[^{MARK}]{MARK}", piece):
                    raise ValueError(f"piece {piece!r} crosses a word")
                ids[piece] = k
                surface[-1] = piece.replace(MARK, " ").encode()
        ends: dict[str, set[int]] = {}
        for piece in ids:
            if len(piece) > 2:
                ends.setdefault(piece[-3:], set()).add(len(piece))
        return Vocabulary(kind, ids, scores, byte_ids, surface, {k: tuple(sorted(v | {1, 2}, reverse=True)) for k, v in ends.items()}, uuid.uuid4().hex)


class Encoder:
    """Forward states over sorted words; one for each worker, with its caches."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known: dict[str, bytes] = {}
        self.stable: dict[int, bool] = {}
        self.edge: dict[int, tuple | bool | None] = {}
        self.text = {k: p for p, k in vocabulary.ids.items()}
        self.low = min(vocabulary.scores[k] for k in vocabulary.ids.values()) - 10 if vocabulary.ids else 0.0

    def merged(self, text: str) -> list[tuple]:
        """Greedy pair merging of a short text, the best score first, then the leftmost: (text, score, left, right) trees."""
        ids, scores = self.v.ids, self.v.scores
        parts: list[tuple] = [(c, math.inf, None, None) for c in text]
        while len(parts) > 1:
            best = max(((scores[k], -i) for i in range(len(parts) - 1) if (k := ids.get(parts[i][0] + parts[i + 1][0])) is not None), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [(parts[i][0] + parts[i + 1][0], best[0], parts[i], parts[i + 1])]
        return parts

    def edges(self, piece: int) -> tuple | None:
        """Right and left edge of a piece's merge tree, each node with its score and its parent's.

        None if merging does not give the piece itself; False if scores rise on the way, so that
        they do not tell the order of merges.
        """
        if piece not in self.edge:
            trees = self.merged(self.text[piece])
            found: tuple | bool | None = None
            if len(trees) == 1:
                sides = []
                for side in (3, 2):
                    node, parent, out = trees[0], -math.inf, []
                    while node is not None:
                        out.append((node[0], node[1], parent))
                        node, parent = node[side], node[1]
                    sides.append(out)
                falls = all(own > parent for out in sides for _, own, parent in out[1:])
                found = tuple(sides) if falls else False
            self.edge[piece] = found
        return self.edge[piece]

    def fits(self, left: int, piece: int) -> bool:
        """Whether merging the joined text of two pieces gives back just these two (``left`` may be nothing or unknown)."""
        if self.edges(piece) is None:
            return False
        if left < 0:
            return True
        a, b = self.edges(left), self.edges(piece)
        if a is False or b is False:
            return [t[0] for t in self.merged(self.text[left] + self.text[piece])] == [self.text[left], self.text[piece]]
        ids, scores = self.v.ids, self.v.scores
        for x, made_x, gone_x in a[0]:
            for y, made_y, gone_y in b[1]:
                k = ids.get(x + y)
                # Both ends stand side by side at some time, and merging them comes before either merges inwards.
                if k is not None and scores[k] > gone_x and scores[k] >= gone_y and min(made_x, made_y) > max(gone_x, gone_y):
                    return False
        return True

    def traverse(self, words: list[str]) -> None:
        """Encode words in sorted order into ``known``."""
        lookup, scores, ends, stable = self.v.ids, self.v.scores, self.v.ends, self.stable
        bpe, byte_ids, low = self.v.kind == BPE, self.v.byte_ids, self.low
        piece_at, start_at, score_at = [_NOTHING], [0], [0.0]  # by length of the prefix
        before = ""
        for word in words:
            marked = MARK + word
            shared = 0
            for x, y in zip(before, marked, strict=False):
                if x != y:
                    break
                shared += 1
            del piece_at[shared + 1 :], start_at[shared + 1 :], score_at[shared + 1 :]
            for i in range(shared + 1, len(marked) + 1):
                chosen, begin, total = _UNKNOWN, i - 1, score_at[i - 1] + low
                for size in ends.get(marked[i - 3 : i], _SHORT) if i > 2 else _SHORT[-i:]:
                    if size <= i and (piece := lookup.get(marked[i - size : i])) is not None:
                        left = piece_at[i - size]
                        if bpe:
                            key = left * 65536 + piece
                            if (good := stable.get(key)) is None:
                                good = stable[key] = self.fits(left, piece)
                            if good:
                                chosen, begin = piece, i - size
                                break
                        elif chosen == _UNKNOWN or score_at[i - size] + scores[piece] > total:
                            chosen, begin, total = piece, i - size, score_at[i - size] + scores[piece]
                piece_at.append(chosen)
                start_at.append(begin)
                score_at.append(total)
            before = marked
            out: list[int] = []
            i = len(marked)
            while i:
                j = start_at[i]
                if (piece := piece_at[i]) >= 0:
                    out.append(piece)
                else:
                    out.extend([byte_ids[c] for c in reversed(marked[j:i].encode())])
                i = j
            out.reverse()
            self.known[word] = array("i", out).tobytes()

    @staticmethod
    def split(text: str) -> list[str]:
        """Marked words without their first mark; the text has one mark in front."""
        if "  " not in text and text[0] != " " and text[-1] != " " and MARK not in text:
            return text.split(" ")
        return [w[1:] for w in _WORD.findall(MARK + text.replace(" ", MARK))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Piece ids of whole texts, as packed 32-bit integers."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        if len(self.stable) > CACHE_PAIRS:
            self.stable.clear()
        split = [self.split(t) if t else [] for t in texts]
        new = {w for words in split for w in words if w not in self.known}
        self.traverse(sorted(new))
        out = [b"".join(map(self.known.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > CACHE_CHARS:
                del self.known[w]
        return out


def encoder_of(vocabulary: Vocabulary) -> Encoder:
    """This worker's encoder of a vocabulary: a worker that runs several tasks keeps what it knows."""
    if vocabulary.name not in tb.held:
        tb.held.clear()
        tb.held[vocabulary.name] = Encoder(vocabulary)
    return tb.held[vocabulary.name]


def decode_bytes(vocabulary: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """UTF-8 bytes of id lists laid end to end, and the offsets of each text; the mark in front is dropped."""
    lengths = np.array([len(s) for s in vocabulary.surface])
    flat = np.frombuffer(b"".join(vocabulary.surface), np.uint8)
    starts = np.cumsum(lengths) - lengths
    size = lengths[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    out = flat[np.repeat(starts[ids] - ends[:-1], size) + np.arange(ends[-1])]
    at = ends[offsets]
    front = np.zeros(len(out) + 1, bool)
    front[at[:-1][np.diff(at) > 0]] = True
    front = front[:-1] & (out == 32)
    return out[~front].tobytes(), at - np.concatenate([[0], np.cumsum(front)])[at]


def encode(docs: DataFrame, vocabulary: Vocabulary, check: bool = True) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> (doc_id, ids, n_tokens, round_trip), one row per input row.

    ``round_trip`` says whether decoding the ids gives back the text; null if ``check`` is off.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        for batch in batches:
            for rows, data, offsets in tb.pieces(batch, "text"):
                texts = pc.fill_null(rows.column("text"), "").to_pylist()
                packed = encoder.encode(texts)
                many = np.array([len(p) // 4 for p in packed])
                at = np.concatenate([[0], np.cumsum(many)])
                ids = np.frombuffer(b"".join(packed), np.int32)
                same = pa.nulls(len(texts), pa.bool_())
                if check:
                    back, edges = decode_bytes(vocabulary, ids, at)
                    raw = data.tobytes()
                    same = pa.array([back[a:b] == raw[c:d] for a, b, c, d in zip(edges[:-1], edges[1:], offsets[:-1], offsets[1:], strict=True)], pa.bool_())
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), lists, pa.array(many, pa.int32()), same], ["doc_id", "ids", "n_tokens", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tb.task(run, keeps=True), f"doc_id {kind}, ids array<int>, n_tokens int, round_trip boolean")


def decode(tokens: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``tokens(doc_id, ids, ...)`` -> (doc_id, text). Null ids give a null text; bytes that are not UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                lists = rows.column("ids").to_pylist()
                many = np.array([len(x or ()) for x in lists])
                flat = np.array([i for x in lists for i in x or ()], np.int64)
                back, edges = decode_bytes(vocabulary, flat, np.concatenate([[0], np.cumsum(many)]))
                texts = [None if x is None else back[a:b].decode("utf-8", "replace") for x, a, b in zip(lists, edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(tb.task(run), f"doc_id {kind}, text string")
