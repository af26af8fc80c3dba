"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.tables import bucket_of


def training_rows(docs: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int], held_out: int, per_class: int) -> DataFrame:
    """(doc_id, text, label) of at most ``per_class`` labelled documents of each class outside the held-out fold.

    ``fold`` is (modulus, remainder) of the crc32 of the id; ``held_out`` is 1 where that remainder is the held-out one and 0
    where it is not. Which rows are taken depends on a digest of the id alone. The two id lists are bounded by the
    parameter, so they may be broadcast. Labels that are null or not 0 or 1, null ids and repeated ids with unlike labels drop out.
    """
    modulus, remainder = fold
    same = bucket_of("doc_id", modulus) == remainder
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).where(~same if held_out else same)
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z")
    digest = F.sha2(F.col("doc_id").cast("string").cast("binary"), 256)
    picked = [rows.where(F.col("y") == c).orderBy(digest).limit(per_class).select("doc_id", "y") for c in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(ids, "doc_id").select("doc_id", "text", F.col("y").cast("int").alias("y"))
