"""Table access, stored frames and small shared helpers of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.core.session import cut_lineage, table

__all__ = ["bucket_of", "stored", "table"]


def stored(df: DataFrame) -> DataFrame:
    """The frame written to the shared checkpoint folder and read back: a lost executor re-reads it, nothing runs twice."""
    return cut_lineage(df)


def bucket_of(column: str, modulus: int) -> F.Column:
    """crc32 of a column as text, modulo ``modulus``: the fold of the held-out contracts. A null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def spread(spark: SparkSession, least: int = 8) -> int:
    """Partitions for a frame that Python works on."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
