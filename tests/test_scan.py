"""Scans on skewed input: one key with a third of the rows, ties, both paths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.core import scan


def skewed(spark, n=3000):
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 37)
    return spark.range(n).select(key.alias("k"), "id", ((F.col("id") * 7919) % 1009).cast("double").alias("v"))


@pytest.mark.parametrize("rows", [10**9, 100])
def test_positions_and_running_sums(spark, rows):
    spark.conf.set(scan.BUCKET_KEY, str(rows))
    df = skewed(spark)
    out = scan.prefix_scan(
        df, ["k"], ["v", "id"], {"rn": ("count", F.lit(1)), "s": ("sum", F.col("v")), "lo": ("min", F.col("id")), "hi": ("max", F.col("id"))}, axis=F.col("v")
    ).toPandas()
    spark.conf.unset(scan.BUCKET_KEY)
    assert len(out) == 3000
    for _, g in out.groupby("k"):
        g = g.sort_values(["v", "id"])
        assert list(g["rn"]) == list(range(1, len(g) + 1))
        assert np.allclose(g["s"], g["v"].cumsum())
        assert list(g["lo"]) == list(g["id"].cummin())
        assert list(g["hi"]) == list(g["id"].cummax())


def test_no_bucket_holds_the_hot_key(spark):
    spark.conf.set(scan.BUCKET_KEY, "100")
    framed, many = scan.range_bucket(skewed(spark), F.col("v"))
    spark.conf.unset(scan.BUCKET_KEY)
    assert many
    assert framed.groupBy("k", "_b").count().agg(F.max("count")).first()[0] <= 150


@pytest.mark.parametrize("rows", [10**9, 100])
def test_exact_quantiles(spark, rows):
    spark.conf.set(scan.BUCKET_KEY, str(rows))
    out = scan.exact_quantiles(skewed(spark), ["k"], "v", [0.0, 0.25, 0.5, 0.99, 1.0], list("abcde")).toPandas().set_index("k")
    spark.conf.unset(scan.BUCKET_KEY)
    data = skewed(spark).toPandas()
    for k, g in data.groupby("k"):
        assert np.allclose(out.loc[k, list("abcde")].astype(float), np.quantile(g["v"], [0.0, 0.25, 0.5, 0.99, 1.0]))
        assert out.loc[k, "n"] == len(g)


def test_hot_value_ecdf(spark, tiny_buckets):
    from tidegauge.operators.signals import ecdf

    df = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, 5.0).otherwise((F.col("id") % 101).cast("double")).alias("v"))
    out = ecdf(df.where("id < 400"), df, [], "v").toPandas().sort_values("v")
    ref = np.sort(df.where("id < 400").toPandas()["v"])
    assert np.allclose(out["level"], np.searchsorted(ref, out["v"], side="right") / len(ref))
    assert out["level"].between(0, 1).all() and out["level"].is_monotonic_increasing


def test_burst_with_one_time_value(spark):
    """A third of all rows share key and axis value: they are split along the tie column, and positions stay exact."""
    hot = F.col("id") % 3 == 0
    df = spark.range(3000).select(F.when(hot, 0).otherwise(F.col("id") % 11).alias("k"), F.when(hot, 500.0).otherwise((F.col("id") * 31 % 1009).cast("double")).alias("t"), "id")
    spark.conf.set(scan.BUCKET_KEY, "100")
    framed, many = scan.range_bucket(df, F.col("t"), tie=F.col("id"))
    biggest = framed.groupBy("k", "_b").count().agg(F.max("count")).first()[0]
    out = scan.positions(df, ["k"], ["t", "id"], F.col("t"), tie=F.col("id")).toPandas()
    spark.conf.unset(scan.BUCKET_KEY)
    assert many and biggest <= 200
    assert len(out) == 3000
    for _, g in out.groupby("k"):
        assert list(g.sort_values(["t", "id"])["rn"]) == list(range(1, len(g) + 1))
