"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

1. toxicity: documents scored at 0.7 or more go.
2. near copies: one text of each class stays, the one with the least id; a row goes only if its own text has an earlier copy.
3. decontamination: documents that hold half of a benchmark item or more go.
4. secrets: every finding in the text is replaced by a mark; all documents stay.
5. mixing: each document's part in the mix of sources; documents of which the mix takes no word go.

A null text passes every filter and takes no word in the mix; a null doc_id is never the copy of another; an empty table stays empty. Rows
that repeat an id are judged each by its own text, rows that repeat id and text stay or go together. Texts of any length are read whole.
Other columns come through all stages as they are; only in the last one do columns named size, source_size, target or taken give way to
those of the mix. Ties are settled by the least doc_id, or in the mix by a digest of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegauge.core.session import scratch_path
from tidegauge.llm import mixing, order_minhash, secret_ledger, tiling, toxicity
from tidegauge.llm.tables import table


def clean_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order_minhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tiling.drop_contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found, _ = secret_ledger.scan(docs)
    return secret_ledger.redact(docs, found)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs, carry=[c for c in docs.columns if c not in ("doc_id", "size", "source_size", "target", "taken")])
    return mixed.where("taken > 0")


STAGES = [
    ("toxicity", clean_toxic), ("near_copies", drop_copies), ("decontamination", decontaminate), ("secrets", redact_secrets), ("mixing", mix_sources),
]
ORACLE_SQL = None  # scores, sketches and alignments have no SQL form; the tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    folder = scratch_path(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{n}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
