"""The corpus pipeline: quality, near duplicates, benchmark leaks, secrets, pieces.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; its result is written as Parquet in the shared folder and read
back as the next stage's documents. All stages but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestream.llm import decontam, pieces, quality, secrets
from lodestream.llm.ngram_join import ngram_components
from lodestream.llm.store import keys_hint, materialize
from lodestream.session import table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Rows with a null id are judged like any other, null texts as empty ones."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id. Rows with a null id, and texts without words, stay; so do all rows that repeat the kept id."""
    found = ngram_components(docs).where("component_id <> doc_id").select("doc_id")
    copies = materialize(found.distinct(), "copies")
    return docs.join(keys_hint(copies), "doc_id", "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts and rows with a null id hold none."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; null texts stay null."""
    return secrets.redact(docs, secrets.train())


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) of all documents; a null or empty text has no ids."""
    vocabulary = pieces.Vocabulary.load(pieces.default_model())
    return pieces.encode(docs, vocabulary)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("SentencePiece encoding and decoding", as_pieces),
]

#: SQL cannot express the classifier, the network and the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, "stage")
    return docs
