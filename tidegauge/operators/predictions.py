"""Joins of samples, predictions and labels, and the accuracy tables built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.core.expr import ratio
from tidegauge.core.scan import prefix_scan, range_bucket, settle


class AlignmentError(ValueError):
    """Rows on one side have no partner or disagree."""


def aligned(data: DataFrame, features: DataFrame, uid: str, answer: str | None = None) -> DataFrame:
    """Strict join in feature order: every feature row needs a data row, with the same answer when one is named."""
    absent = features.join(data, uid, "left_anti").count()
    if absent:
        raise AlignmentError(f"{absent} feature rows have no data row")
    if answer:
        clash = data.select(uid, F.col(answer).alias("_a")).join(features.select(uid, F.col(answer).alias("_b")), uid)
        wrong = clash.where(~F.col("_a").eqNullSafe(F.col("_b"))).count()
        if wrong:
            raise AlignmentError(f"{wrong} rows have different answers")
        features = features.drop(answer)
    return features.join(data, uid)


def missing_extra(left: DataFrame, right: DataFrame, key: str, first: int) -> DataFrame:
    """Per side: number of unmatched keys and the first few of them (``first`` is the report's size)."""
    out = None
    for side, a, b in (("missing", left, right), ("extra", right, left)):
        lone = a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")
        head = lone.orderBy(key).limit(first).agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda k: k.cast("string")), ",").alias("first"))
        row = lone.agg(F.count(F.lit(1)).alias("keys")).join(F.broadcast(head)).select(F.lit(side).alias("side"), "keys", "first")  # one row
        out = row if out is None else out.unionByName(row)
    return out


def accuracy_table(scored: DataFrame, keys: Sequence[str], correct: Column, present: Column, with_total: bool = False) -> DataFrame:
    """n, correct, missing and accuracy (0.0 for no rows); missing rows stay in n and are not correct."""
    hit = F.coalesce(correct, F.lit(False)) & present
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(hit.cast("bigint")), F.lit(0)).alias("correct"),
        F.coalesce(F.sum((~present).cast("bigint")), F.lit(0)).alias("missing"),
    ]
    if with_total:  # one pass for the classes and the total
        grouped = scored.groupingSets([[F.col(k) for k in keys], []], *[F.col(k) for k in keys]).agg(*aggs)
    else:
        grouped = scored.groupBy(*keys).agg(*aggs)
    return grouped.withColumn("accuracy", ratio(F.col("correct"), F.col("n"), 0.0))


def nearest_key(rows: DataFrame, value: str, keys: DataFrame, key: str, rel: float, absolute: float) -> DataFrame:
    """Nearest key of each value within max(rel*max(|a|,|b|), absolute), NULL otherwise; ties take the smaller key.

    Keys and distinct values share one order; a running maximum gives the key below and, in reverse, the key above.
    """
    vals = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_x"), F.lit(None).cast("double").alias("_k")).distinct()
    ks = keys.select(F.col(key).cast("double").alias("_x"), F.col(key).cast("double").alias("_k")).distinct()
    both = vals.unionByName(ks).groupBy("_x").agg(F.max("_k").alias("_k"), F.max(F.col("_k").isNull()).alias("_asked"))
    cut = range_bucket(both, F.col("_x"))
    up = prefix_scan(both, [], ["_x"], {"_lo": ("max", F.col("_k"))}, cut, keep=True)
    back = settle(up.withColumn("_b", -F.col("_b")), cut[1])
    down = prefix_scan(up, [], [F.col("_x").desc()], {"_hi": ("min", F.col("_k"))}, back)
    x, lo, hi = F.col("_x"), F.col("_lo"), F.col("_hi")
    pick = F.when(hi.isNull() | (x - lo <= hi - x), lo).otherwise(hi)
    near = down.where("_asked").withColumn("_p", pick)
    p = F.col("_p")
    ok = F.abs(x - p) <= F.greatest(rel * F.greatest(F.abs(x), F.abs(p)), F.lit(absolute))
    table = near.select(F.col("_x").alias(value), F.when(ok, p).alias("matched"))
    return rows.join(table, value, "left")


def nearest_factor(rate: Column, reference: Column, factors: Sequence[float]) -> Column:
    """Load factor whose rate (factor x reference throughput) is closest; the factor list is a fixed parameter."""
    cand = F.array(*[F.struct(F.abs(reference * f - rate).alias("d"), F.lit(float(i)).alias("i"), F.lit(float(f)).alias("f")) for i, f in enumerate(factors)])
    return F.array_min(cand)["f"]


def overlap_counts(rows: DataFrame, uid: str, flags: dict[str, Column]) -> DataFrame:
    """Shared uids of every pair of splits from one aggregation per uid instead of pairwise joins."""
    names = list(flags)
    per = rows.groupBy(uid).agg(*[F.max(flags[n].cast("int")).alias(n) for n in names])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    counts = per.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a, b in pairs])
    rows_ = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"{a}|{b}").alias("shared")) for a, b in pairs])
    return counts.select(F.explode(rows_).alias("r")).select("r.*")


def within_limits(pairs: Column | None, sums: dict[str, tuple[Column, Column]], caps: dict[str, float | None]) -> Column:
    """Summed resource of a pair under each optional cap; a missing cap or a missing value passes."""
    ok = F.lit(True) if pairs is None else pairs
    for name, (a, b) in sums.items():
        cap = caps.get(name)
        if cap is not None:
            ok = ok & F.coalesce(a + b <= cap, F.lit(True))
    return ok
