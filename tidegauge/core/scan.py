"""Running totals, exact positions and exact quantiles that do not put one key into one task.

``Window.partitionBy(key).orderBy(t)`` sends all rows of a key to one task. Here the order axis is cut into
equi-depth buckets first: running values are taken inside (key, bucket), and a small table of bucket totals
carries the rest over. A key that holds a third of all rows is then spread over a third of the buckets.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.core.session import cut_lineage, row_budget

BUCKET_KEY = "spark.tidegauge.scan.bucketRows"
BUCKET_ROWS = 2_000_000
MAX_BUCKETS = 16384

Aggs = dict[str, tuple[str, Column]]

_FOLD = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
_LOCAL = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def range_bucket(
    df: DataFrame, axis: Column, rows: int | None = None, tie: Column | None = None, name: str = "_b"
) -> tuple[DataFrame, bool]:
    """Add an order-preserving bucket number over ``axis``; False when one bucket is enough.

    A large frame is stored first (its later uses read the stored rows, so nothing upstream runs twice), and the cut
    points are fixed values taken once: every use of the bucket agrees, also after a task is re-run. ``rows`` is a known
    count or an upper bound, which saves the counting pass. ``tie`` is the next order column (a number): a single axis
    value that fills several buckets, such as a burst with one timestamp, is split along it.
    """
    budget = row_budget(df.sparkSession, BUCKET_KEY, BUCKET_ROWS)
    n = df.count() if rows is None else rows
    if n <= budget:
        return df.withColumn(name, F.lit(0.0)), False
    shaped = cut_lineage(df.withColumn("_axis", axis.cast("double")))
    buckets = min(MAX_BUCKETS, math.ceil(n / budget))
    probs = [i / buckets for i in range(1, buckets)]
    cuts = shaped.select(F.percentile_approx("_axis", probs, 20 * buckets).alias("c")).first()["c"]
    seen = Counter(float(c) for c in cuts or [])
    hot = {v: m for v, m in seen.items() if m > 1}  # values that reach over a whole bucket
    splits = [-math.inf, *sorted({*seen, *(math.nextafter(v, math.inf) for v in hot)}), math.inf]
    if len(splits) < 3:
        return shaped.drop("_axis").withColumn(name, F.lit(0.0)), False
    cut = Bucketizer(splits=splits, inputCol="_axis", outputCol=name, handleInvalid="keep").transform(shaped)
    if tie is not None and hot:
        cut = _split_hot(cut, hot, tie.cast("double"), name)
    return cut.drop("_axis"), True


def _split_hot(cut: DataFrame, hot: dict[float, int], tie: Column, name: str) -> DataFrame:
    """Fractions of a bucket along ``tie`` for axis values that are alone in their bucket."""
    parts = cut.sparkSession.createDataFrame(list(hot.items()), "_axis double, _m int")
    small = F.broadcast(parts)  # at most half as many rows as there are buckets
    span = cut.join(small, "_axis").groupBy("_axis", "_m").agg(F.min(tie).alias("_lo"), F.max(tie).alias("_hi"))
    at = F.floor((tie - F.col("_lo")) * F.col("_m") / (F.col("_hi") - F.col("_lo") + 1))
    shift = F.coalesce(F.least(at, F.col("_m") - 1) / F.col("_m"), F.lit(0.0))
    return cut.join(F.broadcast(span), "_axis", "left").withColumn(name, F.col(name) + shift).drop("_m", "_lo", "_hi")


def hash_bucket(df: DataFrame, hex_col: str, rows: int | None = None, name: str = "_b") -> tuple[DataFrame, bool]:
    """Bucket rows ordered by a hex digest: its leading digits are already equi-depth."""
    budget = row_budget(df.sparkSession, BUCKET_KEY, BUCKET_ROWS)
    n = df.count() if rows is None else rows
    if n <= budget:
        return df.withColumn(name, F.lit(0.0)), False
    buckets = min(MAX_BUCKETS, math.ceil(n / budget))
    lead = F.conv(F.substring(hex_col, 1, 4), 16, 10).cast("double")
    return cut_lineage(df.withColumn(name, F.floor(lead * buckets / 65536.0).cast("double"))), True


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    out: Aggs,
    bucketed: tuple[DataFrame, bool] | None = None,
    axis: Column | None = None,
    rows: int | None = None,
    keep: bool = False,
    tie: Column | None = None,
) -> DataFrame:
    """Inclusive running sum / count / min / max per key in the given order.

    ``axis`` is the numeric leading order column used for the buckets; ``bucketed`` is a frame that already has them
    (``keep`` leaves the bucket column in place for a following scan over the same order).
    """
    frame, many = bucketed if bucketed is not None else range_bucket(df, axis, rows, tie)
    local = (
        Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ran = frame.select("*", *[_LOCAL[fn](e).over(local).alias(n) for n, (fn, e) in out.items()])
    if not many:
        return ran if keep else ran.drop("_b")
    totals = frame.groupBy(*keys, "_b").agg(*[_LOCAL[fn](e).alias(f"_t_{n}") for n, (fn, e) in out.items()])
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "_b", *[_FOLD[fn](f"_t_{n}").over(before).alias(f"_c_{n}") for n, (fn, _) in out.items()])
    joined = ran.alias("r").join(
        carry.alias("c"), [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "_b"]], "left"
    )

    def merged(n: str, fn: str) -> Column:
        r, c = F.col(f"r.{n}"), F.col(f"c._c_{n}")
        if fn in ("sum", "count"):
            return F.when(c.isNull(), r).when(r.isNull(), c).otherwise(r + c).alias(n)
        return (F.least(r, c) if fn == "min" else F.greatest(r, c)).alias(n)

    kept = [c for c in frame.columns if keep or c != "_b"]
    return joined.select(*[F.col(f"r.{c}") for c in kept], *[merged(n, fn) for n, (fn, _) in out.items()])


def settle(df: DataFrame, many: bool) -> tuple[DataFrame, bool]:
    """Store a scanned frame before it is scanned again, so a chain of scans does not re-run its earlier links."""
    return (cut_lineage(df), True) if many else (df, False)


def positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], axis: Column, name: str = "rn", rows: int | None = None,
    tie: Column | None = None,
) -> DataFrame:
    """Exact 1-based position of every row inside its key; ``order`` must be unique per key."""
    return prefix_scan(df, keys, order, {name: ("count", F.lit(1))}, axis=axis, rows=rows, tie=tie)


def hash_positions(
    df: DataFrame, keys: Sequence[str], hex_col: str, tie: str, name: str = "rn", rows: int | None = None
) -> DataFrame:
    """Exact 1-based position inside the key, ordered by a hex digest column."""
    return prefix_scan(df, keys, [hex_col, tie], {name: ("count", F.lit(1))}, bucketed=hash_bucket(df, hex_col, rows))


def key_sizes(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def with_sizes(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Attach the size of the row's key: counts are combined map-side before the join."""
    sizes = key_sizes(df, keys, name)
    if not keys:
        return df.join(F.broadcast(sizes))  # one row
    return df.join(sizes, list(keys))


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first k rows of each key; Spark cuts every task's rows to k per key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str], rows: int | None = None
) -> DataFrame:
    """Linear-interpolated quantiles without holding a large group's values in one task.

    Up to the bucket budget one ``percentile`` aggregate is enough. Beyond it, equal values are combined first, positions
    come from the bucketed running count, and each quantile needs the two values around (n-1)*p only.
    """
    budget = row_budget(df.sparkSession, BUCKET_KEY, BUCKET_ROWS)
    if (df.count() if rows is None else rows) <= budget:
        q = df.groupBy(*keys).agg(F.count(value).alias("n"), F.percentile(value, [float(p) for p in probs]).alias("_q"))
        return q.select(*keys, "n", *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(names)])
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_m"))
    ran = prefix_scan(counts, keys, [value], {"_cum": ("sum", F.col("_m"))}, axis=F.col(value))
    sized = counts.groupBy(*keys).agg(F.sum("_m").alias("n"))
    spread = ran.join(F.broadcast(sized)) if not keys else ran.join(sized, list(keys))  # keyless: one row
    aggs = []
    for p, name in zip(probs, names):
        h = (F.col("n") - 1) * F.lit(float(p))
        for side, at in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            hit = (F.col("_cum") > at) & (F.col("_cum") - F.col("_m") <= at)
            aggs.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"_{name}_{side}"))
    picked = spread.groupBy(*keys, "n").agg(*aggs)
    cols = []
    for p, name in zip(probs, names):
        h = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return picked.select(*keys, "n", *cols)
