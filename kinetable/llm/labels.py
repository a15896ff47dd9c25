"""Choice of training rows and shared rules of the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled documents of each class train a model.
SAMPLE_PER_CLASS = 2000


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def training_labels(labels: DataFrame, column: str, per_class: int = SAMPLE_PER_CLASS) -> tuple[DataFrame, dict[int, int]]:
    """``doc_id, y`` of the sample, and how many rows of each class may be learnt from.

    Repeated ids count once (the larger label wins); null ids and labels are left out.  The sample
    takes the rows of each class with the smallest hash of the id, so it is bounded and repeatable.
    """
    rows = labels.select(F.col("doc_id"), F.col(column).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)")
    rows = rows.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {int(r["y"]): int(r["n"]) for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64(F.col("doc_id"), F.lit(7)), F.col("doc_id")]
    parts = [rows.filter(F.col("y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1]), counts


def training_texts(docs: DataFrame, labels: DataFrame, column: str, per_class: int = SAMPLE_PER_CLASS) -> tuple[DataFrame, dict[int, int]]:
    """``doc_id, text, y`` of the sample's documents.  The broadcast side has at most two classes' rows."""
    sample, counts = training_labels(labels, column, per_class)
    texts = docs.select("doc_id", "text")
    return texts.join(F.broadcast(sample), "doc_id"), counts
