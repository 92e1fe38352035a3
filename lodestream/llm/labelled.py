"""Bounded samples of labelled documents for fitting a classifier on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's decimal text is divisible by 5; null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, labels and weights of at most ``per_class`` labelled documents of each class.

    Only ids that are not held out count. Of several labels for one id the larger
    holds; null labels and texts are left out, as are texts over ``max_chars``
    characters (of the training sample only). The choice is by a hash of the id; of
    several texts of one id that with the smallest hash counts.
    Weights restore the share of each class among all labelled rows.
    """
    known = (
        labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y"))
        .where("id IS NOT NULL AND y IN (0, 1)").where(~held_out(F.col("id")))
        .groupBy("id").agg(F.max("y").alias("y"))
    )
    order = F.xxhash64("id", F.lit(17))
    ids = [known.where(F.col("y") == y).orderBy(order, "id").limit(per_class) for y in (0, 1)]
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    chosen = F.broadcast(ids[0].union(ids[1]))  # at most 2 * per_class rows
    rows = (
        docs.select(F.col("doc_id").alias("id"), F.col("text").alias("text")).where("text IS NOT NULL").where(F.length("text") <= max_chars)
        .join(chosen, "id").groupBy("id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text")).select("id", "text", "y").toPandas().sort_values("id")
    )
    y = rows["y"].to_numpy(dtype=np.float64)
    taken = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    total = max(1, sum(counts.values()))
    weight = np.array([counts.get(int(c), 0) / taken[int(c)] / total * len(y) for c in y])
    return rows["text"].tolist(), y, weight


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
