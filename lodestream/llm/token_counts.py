"""Token counts (operator 10): delta-maintained rollups with idempotent batch commits.

A ledger is a folder of committed batches. A batch holds signed rows per
document (one in, one out, or a revised count: the old row out and the new one
in) and their sum by source, language and tokenizer version. Totals are the sum
of the batch rollups, so reading them never touches documents again. Rows lie in
``BUCKETS`` folders by id: a batch looks its ids up in the buckets that they fall
into, by a semi join ahead of any sum. After ``COMPACT`` batches the ledger is
summed into a snapshot (net rows and totals, in the same buckets), which later
commits read in place of the batches that it covers.

A batch is written below a name of its own first and becomes visible by one
rename to its batch id; a batch id that is already there is left alone, so a
retried or repeated commit changes nothing. One writer commits at a time.

Within a batch the rows of one id, source, language and tokenizer are summed
(repeated rows count as often as they occur); an id that the ledger already
holds for a tokenizer is replaced by its new rows. Deletes name ids; unknown ids
delete nothing, and an id both deleted and inserted ends as inserted. Null
sources and languages are groups of their own, rows with a null id count but
cannot be replaced. A null or empty text has no tokens but counts as a document.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import textbatch as tb
from lodestream.llm.store import materialize, new_path

_KEY = ("source", "lang", "tokenizer")
BUCKETS, COMPACT = 64, 16
ROWS = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long"
WORDS = "words"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoding(ranks_path: str):
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(docs: DataFrame, version: str = "byte_bpe_50k", ranks_path: str | None = None) -> DataFrame:
    """``docs(doc_id, source, lang, text, ...)`` -> (doc_id, source, lang, tokenizer, tokens) for ``WORDS`` (runs without
    white space) and for the byte-level tokenizer ``version``; two rows per input row."""
    where = ranks_path or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(where)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = batch.slice(at, 1000)
                texts = pc.fill_null(rows.column("text"), "").to_pylist()
                for name, numbers in ((WORDS, [len(t.split()) for t in texts]), (version, [len(encoding.encode_ordinary(t)) for t in texts])):
                    yield pa.RecordBatch.from_arrays(
                        [*[rows.column(c) for c in ("doc_id", "source", "lang")], pa.array([name] * len(texts)), pa.array(numbers, pa.int64())],
                        ["doc_id", "source", "lang", "tokenizer", "tokens"],
                    )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    return rows.mapInArrow(tb.task(run), "doc_id long, source string, lang string, tokenizer string, tokens long")


class TokenLedger:
    """Batches of one folder (any store that Spark can write and rename in)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._fs = jvm.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[str]:
        top = self._path(f"{self.folder}/{kind}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(top)) if self._fs.exists(top) else []

    def committed(self) -> list[str]:
        """Ids of the committed batches."""
        return self._names("batches")

    def _parts(self) -> list[str]:
        """Folders that hold the ledger: the newest snapshot, if any, and the batches that it does not cover."""
        newest = [f"{self.folder}/snapshots/{n}" for n in self._names("snapshots")[-1:]]
        covered = {r["batch"] for n in newest for r in self.spark.read.schema("batch string").parquet(f"{n}/covers").collect()}
        return newest + [f"{self.folder}/batches/{b}" for b in self.committed() if b not in covered]

    def _read(self, part: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{p}/{part}" for p in self._parts()]
        if buckets is not None:
            every = [f"{p}/{side}/bucket={b}" for p in paths for side in ("in", "out") for b in buckets]
            paths = [p for p in every if self._fs.exists(self._path(p))]
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        """Net rows per document: what is in the ledger now."""
        return _summed(self._read("rows", ROWS), "doc_id", *_KEY)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) from the rollups alone."""
        return _summed(self._read("rollup", ROWS.removeprefix("doc_id long, ")), *_KEY)

    def rows_of(self, ids: DataFrame) -> DataFrame:
        """Net rows of ``ids(doc_id[, tokenizer])``, distinct and not null; other buckets are not read."""
        buckets = [r["bucket"] for r in ids.select(_bucket().alias("bucket")).distinct().collect()]  # BUCKETS at most
        return _summed(self._read("rows", ROWS, buckets).join(ids, ids.columns, "left_semi"), "doc_id", *_KEY)

    def commit(self, batch_id: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """Commit a batch of counted rows (as :func:`count` gives them) and deleted ids; False if its id is already committed."""
        final = self._path(f"{self.folder}/batches/{batch_id}")
        if self._fs.exists(final):
            return False
        pending = f"{self.folder}/pending/{uuid.uuid4().hex}"
        named = None
        if upserts is not None:
            fresh = upserts.groupBy("doc_id", *_KEY).agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
            _write(fresh.select(*_cast()), f"{pending}/rows/in")
            named = materialize(self.spark.read.schema(ROWS).parquet(f"{pending}/rows/in").select("doc_id", "tokenizer").where("doc_id IS NOT NULL").distinct(), "batch-ids")
        if self._parts():
            gone = [] if named is None else [self.rows_of(named).select(*_cast())]
            if deletes is not None:
                ids = materialize(deletes.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct(), "batch-ids")
                left = self.rows_of(ids)
                if named is not None:  # those are out already
                    left = left.join(named, ["doc_id", "tokenizer"], "left_anti")
                gone.append(left.select(*_cast()))
            if gone:
                out = gone[0] if len(gone) == 1 else gone[0].unionByName(gone[1])
                _write(out.withColumns({c: -F.col(c) for c in ("docs", "tokens")}), f"{pending}/rows/out")
        if not self._fs.exists(self._path(f"{pending}/rows")):
            _write(self.spark.createDataFrame([], ROWS), f"{pending}/rows/in")
        rows = self.spark.read.schema(ROWS).option("recursiveFileLookup", "true").parquet(f"{pending}/rows")
        rows.groupBy(*_KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{pending}/rollup")
        self._publish(pending, f"batches/{batch_id}")
        if len(self._parts()) > COMPACT:
            self.compact()
        return True

    def compact(self) -> None:
        """Sum the ledger into a snapshot; it becomes visible by one rename, and the batches keep their ids."""
        pending, covers = f"{self.folder}/pending/{uuid.uuid4().hex}", self.committed()
        _write(self.rows().select(*_cast()), f"{pending}/rows/in")
        self.totals().coalesce(1).write.parquet(f"{pending}/rollup")  # one row a group
        self.spark.createDataFrame([(b,) for b in covers], "batch string").coalesce(1).write.parquet(f"{pending}/covers")
        self._publish(pending, f"snapshots/{len(self._names('snapshots')):08d}")

    def _publish(self, pending: str, name: str) -> None:
        final = self._path(f"{self.folder}/{name}")
        self._fs.mkdirs(final.getParent())
        if not self._fs.rename(self._path(pending), final):
            raise OSError(f"{name} could not be committed")


def _bucket():
    return F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")


def _write(rows: DataFrame, path: str) -> None:
    """Rows by bucket; Spark joins small partitions and splits large ones, so a batch has few files and no bucket is one task."""
    rows.withColumn("bucket", _bucket()).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)


def _summed(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")


def _cast() -> list:
    return [F.col(c).cast(kind).alias(c) for c, kind in (x.split() for x in ROWS.split(", "))]


def corpus_totals(docs: DataFrame) -> DataFrame:
    """Totals of a corpus that is loaded, cleaned of exact copies and of repeated lines, in four commits (one of them repeated).

    1. all documents in; 2. copies of a text with a smaller id out; 3. remaining
    texts with repeated lines revised to the count of their distinct lines; then
    the first batch comes again and must change nothing.
    """
    ledger = TokenLedger(docs.sparkSession, new_path(docs.sparkSession, "token-ledger"))
    ledger.commit("1-load", upserts=count(docs))
    digest = docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha")).where("doc_id IS NOT NULL AND sha IS NOT NULL")
    # Written before it is joined back: then both sides are plain exchanges, and a large group of copies can be split.
    firsts = materialize(digest.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1"), "copy-groups")
    ledger.commit("2-copies", deletes=digest.join(firsts, "sha").where("doc_id <> first_id").select("doc_id"))
    lines = F.array_join(F.array_distinct(F.split("text", "\n")), "\n")
    revised = docs.withColumn("new", lines).where("doc_id IS NOT NULL AND new <> text")
    kept = ledger.rows().select(F.col("doc_id").alias("kept_id")).distinct()
    revised = revised.join(kept, F.col("doc_id") == F.col("kept_id"), "left_semi").select("doc_id", "source", "lang", F.col("new").alias("text"))
    ledger.commit("3-lines", upserts=count(revised))
    ledger.commit("1-load", upserts=count(docs))
    return ledger.totals()
