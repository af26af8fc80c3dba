"""Writers for models, result tables and accepted / rejected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators.vectors import Pca


def write_models(spark: SparkSession, models: dict[str, Pca], thresholds: DataFrame, path: str) -> None:
    """Means, components, variances and thresholds as small Parquet tables partitioned by stream."""
    rows = [
        (stream, int(i), float(m.variances[i]), [float(x) for x in m.components[i]])
        for stream, m in models.items() for i in range(len(m.variances))
    ]
    spark.createDataFrame(rows, "stream string, component int, variance double, weights array<double>").write.mode(
        "overwrite").partitionBy("stream").parquet(f"{path}/components")
    means = [(s, [float(x) for x in m.mean], m.rows) for s, m in models.items()]
    spark.createDataFrame(means, "stream string, mean array<double>, n bigint").write.mode("overwrite").partitionBy("stream").parquet(f"{path}/means")
    thresholds.write.mode("overwrite").partitionBy("stream").parquet(f"{path}/thresholds")


def read_models(spark: SparkSession, path: str) -> dict[str, Pca]:
    """Models back from their tables (a few rows per stream)."""
    import numpy as np

    means = {r["stream"]: r for r in spark.read.parquet(f"{path}/means").collect()}
    out = {}
    for stream, row in means.items():
        comps = spark.read.parquet(f"{path}/components").where(F.col("stream") == stream).orderBy("component").collect()
        out[stream] = Pca(np.array(row["mean"]), np.array([c["weights"] for c in comps]), np.array([c["variance"] for c in comps]), row["n"])
    return out


def write_results(df: DataFrame, path: str, fmt: str = "parquet", by: list[str] | None = None) -> None:
    """Result table as parquet, json or csv (with header), optionally partitioned."""
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(*by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def route_accepted(rows: DataFrame, accepted: Column, truth: str, pseudo: str) -> tuple[DataFrame, DataFrame]:
    """Accepted rows with the answer replaced by the pseudo label, and the rejected ones."""
    ok = F.coalesce(accepted, F.lit(False))
    return rows.where(ok).withColumn(truth, F.col(pseudo)), rows.where(~ok)


def pending(rows: DataFrame, done: DataFrame, uid: str) -> DataFrame:
    """Rows whose uid has no finished result yet."""
    return rows.join(done.select(uid), uid, "left_anti")
