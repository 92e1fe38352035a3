r"""Token-ID output (operator 12): raw id shards and a minimal perfect hash index over document keys.

Format. A shard is a file of nothing but token ids, little-endian unsigned whole
numbers of 16 bits where the vocabulary has no larger ones and of 32 bits
otherwise, documents one after another in ascending order of their ids, an end
id after each. A key is a document id and the number of the row among rows
of that id (0 for the first), so repeated ids stay apart. Keys are dealt into
buckets by a hash; each bucket has one index file: a minimal perfect hash (levels
of bits: a key sits in the first level where no other key shares its bit, and
its slot is the number of set bits before it) and, a slot, a fingerprint of the
key, the shard's number, the offset and the length in the shard, and the offset
in the whole corpus. A look-up hashes the key to a bit, counts, compares the
fingerprint and reads one range of one shard: constant time whatever the size.

Writing. Rows are dealt out by ranges of (doc_id, hash of the text, row number),
so a third of all rows with one id spreads over tasks, and sorted inside a task,
which streams one shard and reports where each document went. Reports are
written as a table; files of attempts that failed are in no report and are
never read. Offsets before a shard, and rows of its first id in shards before
it, follow from one summary row a shard on the driver. Files go through Arrow's
file systems into the shared folder.

Encoding is that of the ``tokenizers`` library with the given file and
add_special_tokens=False. Its pre-tokenizer cuts texts into pieces that its
model encodes one by one. Here runs of texts are cut at once, on their UTF-8
bytes; Arrow finds the distinct pieces of a run, the library's model encodes
those that a worker does not hold yet, and their ids are gathered into the
texts'. The cut is made for texts whose characters lie in :data:`PLAIN` and
that hold no special token; all other texts go to the library whole.

Null and empty texts are the end id alone. Rows with a null id come first and
have a null id in the result, each a key of its own. Rows equal in all columns
have the same ids in any order. An empty table gives no shard and no row. Extra
columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from lodestream.llm import textbatch as tb
from lodestream.llm.store import bounded_batches, materialize, new_path

END = 2
#: Keys of an index file on average; pieces of either generation that a worker keeps; bytes read at once; bytes of texts encoded at once.
BUCKET_KEYS, PIECES, CHUNK, RUN = 100_000, 500_000, 1 << 22, 1 << 21
MAGIC = b"IDX1"
SLOT = np.dtype([("fingerprint", "<u8"), ("offset", "<u8"), ("start", "<u8"), ("shard", "<u4"), ("length", "<u4")])

#: Characters that the cut below is made for: up to U+024F, general punctuation and the euro sign.
PLAIN = "\x00-ɏ‐-‧‰-›€"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# --- encoding -------------------------------------------------------------------------------------


LETTER, NUMBER, SPACE, OTHER, ODD = range(5)


def _kinds() -> np.ndarray:
    """Kind of each code point below U+0280 in the byte-level pre-tokenizer's pattern (fixed by the tokenizer); odd beyond the plain ones."""
    kinds = np.full(0x280, ODD, np.uint8)
    for c in range(0x250):
        kinds[c] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER)
    kinds[[ord(c) for c in "\t\n\x0b\x0c\r \x85\xa0"]] = SPACE
    return kinds


KINDS = _kinds()
#: Kind of a byte on its own, and the plain characters of three bytes, none of them a letter, number or white space.
BYTES = np.where(np.arange(256) < 0x80, KINDS[:256], ODD).astype(np.uint8)
FAR = np.array([c for c in range(0x250, 0x2100) if re.match(f"[{PLAIN}]", chr(c))])


def _visible() -> np.ndarray:
    """The character by which byte-level vocabularies write each byte."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars = np.arange(256, dtype="<u2")
    chars[[b for b in range(256) if b not in seen]] = 256 + np.arange(256 - len(seen))
    return chars


VISIBLE = _visible()


def kinds_of(data: np.ndarray) -> np.ndarray:
    """Kind of the character of each byte of UTF-8."""
    kinds = BYTES[data]
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        one, two, three = np.append(data, np.zeros(2, np.uint8))[lead + np.arange(3)[:, None]].astype(np.int64)
        short = (one <= 0xC9) & (two >> 6 == 2)
        at = lead[short]
        kinds[at] = kinds[at + 1] = KINDS[(one[short] & 31) << 6 | two[short] & 63]
        at = lead[(one == 0xE2) & (two >> 6 == 2) & (three >> 6 == 2) & np.isin((one & 15) << 12 | (two & 63) << 6 | three & 63, FAR)]
        kinds[at] = kinds[at + 1] = kinds[at + 2] = OTHER
    return kinds


def cut(data: np.ndarray, offsets: np.ndarray, whole: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where the pre-tokenizer's pieces of texts begin in their bytes, and the end of all; a text marked ``whole`` is one piece.

    Its pattern is ``'(?:[stmd]|re|ve|ll)| ?L+| ?N+| ?O+|S+(?!not S)|S+`` for letters, numbers, others and white space, so a piece
    is a run of one kind but for three rules, one below another.
    """
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    cuts = begins.copy()
    cuts[1:-1] |= kinds[1:] != kinds[:-1]
    runs = np.flatnonzero(cuts)
    start, stop = runs[:-1], runs[1:]
    # White space before more text leaves its last character to itself; a blank goes to what follows.
    after = stop[(kinds[start] == SPACE) & ~begins[stop]]
    last = after - 1 - (data[after - 1] >= 0x80)
    cuts[last] = True
    cuts[after[data[last] == 0x20]] = False
    # A lone apostrophe that begins a piece takes an ending with it.
    at = start[(stop - start == 1) & (data[start] == ord("'"))]
    at = at[cuts[at] & ~begins[at + 1]]
    one, two = data[at + 1], np.where(begins[at + 2], 0, data[np.minimum(at + 2, len(data) - 1)])
    size = np.select([np.isin(one, list(b"stmd")), (one == ord("l")) & (two == ord("l")) | np.isin(one, list(b"vr")) & (two == ord("e"))], [2, 3], 0)
    at, size = at[size > 0], size[size > 0]
    cuts[at + 1] = False
    cuts[at + size] = True
    for k in np.flatnonzero(whole):
        cuts[offsets[k] + 1 : offsets[k + 1]] = False
    return np.flatnonzero(cuts)


class Encoder:
    """Ids of texts as little-endian numbers, ``width`` bytes an id."""

    def __init__(self, path: str, most: int = PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        first = self.tokenizer.pre_tokenizer
        #: Whether the cut is this tokenizer's; all texts go to the library whole otherwise.
        self.cuts = self.tokenizer.normalizer is None and isinstance(first, pre_tokenizers.ByteLevel) and first.use_regex and not first.add_prefix_space
        # A second copy for single pieces: these are kept here, so that the model's own cache would only cost time.
        self.model = Tokenizer.from_file(path).model
        self.model._resize_cache(0)
        self.known, self.older, self.most = {}, {}, most

    def _bytes(self, ids: list[int]) -> bytes:
        return array("H" if self.width == 2 else "I", ids).tobytes()

    def _whole(self, texts: list[bytes]) -> list[bytes]:
        return [self._bytes(e.ids) for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _alone(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces by the library's model, which takes each byte as a visible character."""
        text = VISIBLE[np.frombuffer(b"".join(pieces), np.uint8)].tobytes().decode("utf-16-le")
        out, at = [], 0
        for piece in pieces:
            out.append(self._bytes([t.id for t in self.model.tokenize(text[at : at + len(piece)])]))
            at += len(piece)
        return out

    def _odd(self, data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Which texts go to the library whole."""
        odd = np.full(len(offsets) - 1, not self.cuts)
        odd[np.searchsorted(offsets, np.flatnonzero(kinds == ODD), "right") - 1] = True
        raw = data.tobytes()
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                odd[np.searchsorted(offsets, at, "right") - 1] = True
                at = raw.find(token, at + 1)
        return odd

    def _look_up(self, pieces: list[bytes], whole: list[int]) -> list[bytes]:
        """Ids of distinct pieces; those at ``whole`` are odd texts, which are not kept."""
        if len(self.known) > self.most:  # what is used again comes back from the older generation
            self.known, self.older = {}, self.known
        got = list(map(self.known.get, pieces))
        for k, ids in zip(whole, self._whole([pieces[k] for k in whole]), strict=True):
            got[k] = ids
        holes = [k for k, ids in enumerate(got) if ids is None]
        new = []
        for k in holes:
            got[k] = self.older.get(pieces[k])
            if got[k] is None:
                new.append(k)
        for k, ids in zip(new, self._alone([pieces[k] for k in new]), strict=True):
            got[k] = ids
        self.known.update((pieces[k], got[k]) for k in holes)
        return got

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, their number a text) of texts as UTF-8 between offsets; memory is bounded by the texts given."""
        if not len(data):
            return np.zeros(0, f"<u{self.width}"), np.zeros(len(offsets) - 1, np.int64)
        kinds = kinds_of(data)
        odd = self._odd(data, offsets, kinds)
        bounds = cut(data, offsets, odd, kinds)
        found = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        codes = found.indices.to_numpy()
        whole = np.unique(codes[np.searchsorted(bounds, offsets[:-1][odd & (np.diff(offsets) > 0)])]).tolist()
        got = self._look_up(found.dictionary.to_numpy(zero_copy_only=False).tolist(), whole)
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // self.width
        firsts, many = np.cumsum(sizes) - sizes, sizes[codes]
        ends = np.cumsum(many)
        ids = np.frombuffer(b"".join(got), f"<u{self.width}")[np.repeat(firsts[codes] - ends + many, many) + np.arange(ends[-1])]
        return ids, np.diff(np.append(0, ends)[np.searchsorted(bounds, offsets)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes."""
        raw = [t.encode() for t in texts]
        offsets = np.cumsum([0, *map(len, raw)])
        ids, sizes = self.ids(np.frombuffer(b"".join(raw), np.uint8), offsets)
        return [part.tobytes() for part in np.split(ids, np.cumsum(sizes))[:-1]]


# --- the index ------------------------------------------------------------------------------------


def _hash(ids: np.ndarray, nth: np.ndarray, seed: int) -> np.ndarray:
    """64 bits of a key (ids and row numbers as unsigned 64-bit numbers), one function a seed."""
    return tb.mix(tb.mix(ids + np.uint64((seed * 0x9E3779B97F4A7C15) & (1 << 64) - 1)) + nth * np.uint64(0xD6E8FEB86659FD93))


def _keys(ids: pa.Array, nth: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned parts of keys; rows of a null id have odd numbers, all others even ones."""
    null = pc.is_null(ids).to_numpy(zero_copy_only=False)
    number = nth.to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(2) + null.astype(np.uint64)
    return pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), number


FINGERPRINT, BUCKET, LEVEL = 1, 2, 16


class PerfectHash:
    """Distinct keys to 0 .. n - 1: levels of bits, each twice as many as the keys that reach it."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = np.concatenate([[0], np.cumsum([int(x.sum()) for x in levels])])
        self.ranks = [np.concatenate([[0], np.cumsum(x)]) for x in levels]

    @classmethod
    def build(cls, ids: np.ndarray, nth: np.ndarray) -> PerfectHash:
        levels = []
        while len(ids):
            size = 2 * len(ids) + 1
            at = (_hash(ids, nth, LEVEL + len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            rest = ~alone[at]
            ids, nth = ids[rest], nth[rest]
            if len(levels) > 200:
                raise ValueError("keys of an index are not distinct")
        return cls(levels)

    def slots(self, ids: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for keys that no level has (they are not in the index)."""
        out = np.full(len(ids), -1, np.int64)
        open_ = np.arange(len(ids))
        for k, bits in enumerate(self.levels):
            at = (_hash(ids[open_], nth[open_], LEVEL + k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = self.before[k] + self.ranks[k][at[hit]]
            open_ = open_[~hit]
        return out


class IndexFile:
    """One bucket: the hash and a record a slot."""

    def __init__(self, hash_: PerfectHash, slots: np.ndarray, width: int):
        self.hash, self.slots, self.width = hash_, slots, width

    @classmethod
    def build(cls, ids: np.ndarray, nth: np.ndarray, shard: np.ndarray, offset: np.ndarray, start: np.ndarray, length: np.ndarray, width: int = 4) -> IndexFile:
        hash_ = PerfectHash.build(ids, nth)
        slots = np.zeros(len(ids), SLOT)
        at = hash_.slots(ids, nth)
        for name, values in (("fingerprint", _hash(ids, nth, FINGERPRINT)), ("shard", shard), ("offset", offset), ("start", start), ("length", length)):
            slots[name][at] = values
        return cls(hash_, slots, width)

    def dump(self) -> bytes:
        sizes = [len(x) for x in self.hash.levels]
        head = MAGIC + struct.pack(f"<QHH{len(sizes)}Q", len(self.slots), len(sizes), self.width, *sizes)
        return head + b"".join(np.packbits(x, bitorder="little").tobytes() for x in self.hash.levels) + self.slots.tobytes()

    @classmethod
    def load(cls, data: bytes) -> IndexFile:
        if data[:4] != MAGIC:
            raise ValueError("not an index file")
        n, many, width = struct.unpack_from("<QHH", data, 4)
        sizes = struct.unpack_from(f"<{many}Q", data, 16)
        at, levels = 16 + 8 * many, []
        for size in sizes:
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, (size + 7) // 8, at), count=size, bitorder="little").astype(bool))
            at += (size + 7) // 8
        if len(data) != at + n * SLOT.itemsize:
            raise ValueError("the index file is cut short")
        return cls(PerfectHash(levels), np.frombuffer(data, SLOT, n, at), width)

    def find(self, ids: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which keys are there by fingerprint, their records)."""
        at = self.hash.slots(ids, nth)
        there = at >= 0
        there[there] = self.slots["fingerprint"][at[there]] == _hash(ids, nth, FINGERPRINT)[there]
        return there, self.slots[at[there]]


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def _load(path: str) -> bytes:
    fs, at = _open(path)
    with fs.open_input_stream(at, compression=None) as stream:
        return bytes(stream.read())


# --- writing and reading --------------------------------------------------------------------------


def write_shards(docs: DataFrame, folder: str, tokenizer: str, shards: int, end: int = END) -> DataFrame:
    """Write raw ids of all documents; returns where each went: (shard, path, width, pos, doc_id, nth, offset, length), nth within the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if ("ids", tokenizer) not in tb.held:
            tb.held.clear()
            tb.held["ids", tokenizer] = Encoder(tokenizer)
        encoder = tb.held["ids", tokenizer]
        width = encoder.width
        out, path, shard = None, f"{folder}/{uuid.uuid4().hex}.ids", TaskContext.get().partitionId()
        pos = offset = nth = 0
        last = None
        try:
            for batch in batches:
                if out is None:
                    fs, base = _open(path)
                    fs.create_dir(base.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(base, compression=None)
                rows = []
                for part, data, offsets in tb.pieces(batch, "text", RUN):
                    ids, sizes = encoder.ids(data, offsets)
                    out.write(np.insert(ids, np.cumsum(sizes), end).tobytes())  # a run at once
                    for doc_id, size in zip(part.column("doc_id").to_pylist(), (sizes + 1).tolist(), strict=True):
                        nth, last = nth + 1 if pos and doc_id == last else 0, doc_id
                        rows.append((shard, path, width, pos, doc_id, nth, offset, size))
                        pos, offset = pos + 1, offset + size
                names = ["shard", "path", "width", "pos", "doc_id", "nth", "offset", "length"]
                kinds = [pa.int32(), pa.string(), pa.int32(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)
        finally:
            if out is not None:
                out.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    bounded_batches(docs.sparkSession)
    sorted_ = rows.repartitionByRange(shards, "doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row").select("doc_id", "text")
    return materialize(sorted_.mapInArrow(tb.task(run, keeps=True), "shard int, path string, width int, pos long, doc_id long, nth long, offset long, length long"), "ids-places")


def _before(places: DataFrame) -> DataFrame:
    """(shard, ids_before, first_id, rows_before): what lies before each shard, from one summary row of each."""
    summary = places.groupBy("shard").agg(
        F.sum("length").alias("length"), F.min_by("doc_id", "pos").alias("first_id"), F.max_by("doc_id", "pos").alias("last_id"),
        F.max_by("nth", "pos").alias("last_nth"), F.count("*").alias("rows"),
    ).orderBy("shard").collect()
    out, ids, known, run = [], 0, False, 0
    last = None
    for s in summary:
        carried = run if known and s["first_id"] == last else 0
        out.append((s["shard"], ids, s["first_id"], carried))
        # A shard of one id only goes on counting.
        run = s["last_nth"] + 1 + (carried if s["rows"] == s["last_nth"] + 1 else 0)
        ids, last, known = ids + s["length"], s["last_id"], True
    return F.broadcast(places.sparkSession.createDataFrame(out, "shard int, ids_before long, first_id long, rows_before long"))


def _bucketed(keys: DataFrame, buckets: int) -> DataFrame:
    """Keys with the number of their index file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = _hash(*_keys(batch.column("doc_id"), batch.column("nth")), BUCKET) % np.uint64(buckets)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket.astype(np.int32))], [*batch.schema.names, "bucket"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema.fields)
    return keys.mapInArrow(run, f"{kinds}, bucket int")


class TokenFiles:
    """Shards and index below one folder."""

    def __init__(self, places: DataFrame, index: DataFrame, buckets: int):
        #: (shard, path) a shard and (bucket, path) a bucket: few and narrow.
        self.places, self.index, self.buckets = places, index, buckets

    @classmethod
    def write(cls, docs: DataFrame, folder: str, tokenizer: str | None = None, shards: int | None = None, bucket_keys: int = BUCKET_KEYS) -> TokenFiles:
        """Write ``docs(doc_id, text, ...)``; as many shards as the session has shuffle partitions, unless given."""
        spark = docs.sparkSession
        where = tokenizer or default_tokenizer()
        places = write_shards(docs, f"{folder}/shards", where, shards or int(spark.conf.get("spark.sql.shuffle.partitions")))
        buckets = max(1, -(-places.count() // bucket_keys))
        rows = places.join(_before(places), "shard").select(
            "doc_id", (F.col("nth") + F.when(F.col("doc_id").eqNullSafe(F.col("first_id")), F.col("rows_before")).otherwise(0)).alias("nth"),
            "shard", "offset", (F.col("ids_before") + F.col("offset")).alias("start"), "length", "width",
        )

        def run(key: tuple, rows: pa.Table) -> pa.Table:
            rows = rows.combine_chunks()
            ids, nth = _keys(rows.column("doc_id"), rows.column("nth"))
            file = IndexFile.build(ids, nth, *[rows.column(c).to_numpy() for c in ("shard", "offset", "start", "length")], rows.column("width")[0].as_py())
            path = f"{folder}/index/{key[0].as_py()}-{uuid.uuid4().hex}.idx"
            fs, at = _open(path)
            fs.create_dir(at.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(at, compression=None) as out:
                out.write(file.dump())
            return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "path": [path], "keys": pa.array([len(ids)], pa.int64())})

        index = materialize(_bucketed(rows, buckets).groupBy("bucket").applyInArrow(run, "bucket int, path string, keys long"), "ids-index")
        return cls(places, index, buckets)

    def keys(self) -> DataFrame:
        """(doc_id, nth) of all documents."""
        return self.places.join(_before(self.places), "shard").select("doc_id", (F.col("nth") + F.when(F.col("doc_id").eqNullSafe(F.col("first_id")), F.col("rows_before")).otherwise(0)).alias("nth"))

    def locate(self, keys: DataFrame) -> DataFrame:
        """``keys(doc_id, nth)`` -> (doc_id, nth, shard, offset, start, length) of those that the index holds."""
        index = {r["bucket"]: r["path"] for r in self.index.select("bucket", "path").collect()}  # one entry for BUCKET_KEYS keys

        def run(key: tuple, rows: pa.Table) -> pa.Table:
            rows = rows.combine_chunks()
            path = index.get(key[0].as_py())
            if path is None:
                there, slots = np.zeros(rows.num_rows, bool), np.zeros(0, SLOT)
            else:
                there, slots = IndexFile.load(_load(path)).find(*_keys(rows.column("doc_id"), rows.column("nth")))
            kept = rows.select(["doc_id", "nth"]).filter(pa.array(there))
            for name, kind in (("shard", np.int32), ("offset", np.int64), ("start", np.int64), ("length", np.int64)):
                kept = kept.append_column(name, pa.array(slots[name].astype(kind)))
            return kept

        dealt = _bucketed(keys.select("doc_id", "nth"), self.buckets)
        return dealt.groupBy("bucket").applyInArrow(run, "doc_id long, nth long, shard int, offset long, start long, length long")

    def read(self, keys: DataFrame | None = None, ids: bool = False) -> DataFrame:
        """(doc_id, nth, start, n_tokens, ids_crc32[, ids]) of ``keys``, or of all documents, from the shards through the index."""
        shards = {r["shard"]: (r["path"], r["width"]) for r in self.places.select("shard", "path", "width").distinct().collect()}  # one entry a shard

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, file, width = None, None, 0
            for batch in batches:
                columns = [batch.column(c).to_numpy() for c in ("shard", "offset", "length")]
                crcs, payloads, at = [], [], 0
                while at < batch.num_rows:
                    own, offset, length = (c[at] for c in columns)
                    if own != shard:
                        if file is not None:
                            file.close()
                        shard, (path, width) = own, shards[int(own)]
                        fs, where = _open(path)
                        file = fs.open_input_file(where)
                    to, size = at + 1, int(length)  # neighbours in one read
                    while to < batch.num_rows and columns[0][to] == own and columns[1][to] == offset + size and width * (size + int(columns[2][to])) <= CHUNK:
                        size, to = size + int(columns[2][to]), to + 1
                    data = np.frombuffer(file.read_at(width * size, width * int(offset)), f"<u{width}")
                    if len(data) != size:
                        raise ValueError(f"shard {own} is cut short")
                    wide = data.astype("<u4")
                    for k in range(at, to):
                        part = wide[int(columns[1][k] - offset) : int(columns[1][k] - offset + columns[2][k])]
                        crcs.append(zlib.crc32(part))
                        if ids:
                            payloads.append(part.astype(np.int64))
                    at = to
                out = [batch.column(c) for c in ("doc_id", "nth", "start", "length")] + [pa.array(crcs, pa.int64())]
                if ids:
                    out.append(pa.array(payloads, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "nth", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids)
            if file is not None:
                file.close()

        found = materialize(self.locate(self.keys() if keys is None else keys), "ids-found")
        # Ranges of (shard, offset): a task reads on through a shard, and a large shard may go to several tasks.
        dealt = found.repartitionByRange(max(1, len(shards)), "shard", "offset").sortWithinPartitions("shard", "offset")
        return dealt.mapInArrow(tb.task(run), "doc_id long, nth long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write all documents in the shared folder and read them back: (doc_id, start, n_tokens, ids_crc32)."""
    files = TokenFiles.write(docs, new_path(docs.sparkSession, "ids"), tokenizer)
    return files.read().select("doc_id", "start", "n_tokens", "ids_crc32")
