"""Ordered-stream operators: positions, count windows, alarm windows, running detector statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.core.expr import ratio
from tidegauge.core.scan import positions, prefix_scan, range_bucket, settle, with_sizes


def micros(ts: str) -> Column:
    """Event time as a number, also for zone-free timestamps."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def event_positions(events: DataFrame, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """Exact position of each event inside its key by (ts, event_id)."""
    return positions(events, list(keys), ["ts", "event_id"], micros("ts"), tie=F.col("event_id"))


def tumbling(numbered: DataFrame, keys: Sequence[str], size: int, aggs: Sequence[Column]) -> DataFrame:
    """Complete fixed-count windows: one shuffle on (key, window), so a long key spreads over many tasks."""
    window = F.floor((F.col("rn") - 1) / size).alias("window_id")
    return (
        numbered.groupBy(*keys, window)
        .agg(F.count(F.lit(1)).alias("n"), *aggs)
        .where(F.col("n") == size)
    )


def sliding_sums(
    numbered: DataFrame, keys: Sequence[str], size: int, stride: int, sums: dict[str, Column]
) -> DataFrame:
    """Sums over the last ``size`` rows at endpoints size, size+stride, ...

    Rows are first added up in blocks of gcd(size, stride); each block then goes to the windows that cover it, so
    neither the rows nor a key's whole history is replicated per window.
    """
    if not 0 < stride <= size:
        raise ValueError("need 0 < stride <= size")
    block = math.gcd(size, stride)
    per_window, per_step = size // block, stride // block
    blocks = numbered.groupBy(*keys, F.floor((F.col("rn") - 1) / block).alias("_blk")).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(e).alias(n) for n, e in sums.items()]
    )
    # window k covers blocks [k*per_step, k*per_step + per_window)
    first = F.greatest(F.lit(0), F.ceil((F.col("_blk") - per_window + 1) / per_step))
    last = F.floor(F.col("_blk") / per_step)
    spread = blocks.where(first <= last).withColumn("_k", F.explode(F.sequence(first, last)))
    return (
        spread.groupBy(*keys, "_k")
        .agg(F.sum("_rows").alias("_rows"), *[F.sum(n).alias(n) for n in sums])
        .where(F.col("_rows") == size)
        .select(*keys, (F.col("_k") * stride + size).cast("bigint").alias("endpoint"), *sums)
    )


def windows_with_alarm(numbered: DataFrame, keys: Sequence[str], alarm: Column, size: int, stride: int) -> DataFrame:
    """Endpoints whose last ``size`` rows hold at least one alarm."""
    sums = sliding_sums(numbered, keys, size, stride, {"alarms": alarm.cast("int")})
    return sums.withColumn("has_alarm", F.col("alarms") > 0)


def first_alarm(checked: DataFrame, keys: Sequence[str], alarm: Column) -> DataFrame:
    """First checkpoint with an alarm, NULL when none."""
    return checked.groupBy(*keys).agg(
        F.min(F.when(alarm, F.col("endpoint"))).alias("first_alarm"), F.count(F.lit(1)).alias("checkpoints")
    )


def running_moments(events: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Running count, mean and sample variance per key; values are centred on the overall mean before squaring."""
    centre = events.agg(F.avg(value).alias("_mu"))
    shifted = events.join(F.broadcast(centre)).withColumn("_z", F.col(value) - F.col("_mu"))
    ran = prefix_scan(
        shifted,
        keys,
        ["ts", "event_id"],
        {"n": ("count", F.lit(1)), "_s1": ("sum", F.col("_z")), "_s2": ("sum", F.col("_z") * F.col("_z"))},
        axis=micros("ts"),
        tie=F.col("event_id"),
    )
    var = F.when(F.col("n") > 1, (F.col("_s2") - F.col("_s1") * F.col("_s1") / F.col("n")) / (F.col("n") - 1))
    return ran.withColumn("mean", F.col("_mu") + F.col("_s1") / F.col("n")).withColumn(
        "variance", F.greatest(F.coalesce(var, F.lit(0.0)), F.lit(0.0))
    )


def ddm_levels(
    events: DataFrame, keys: Sequence[str], error: Column, warm_start: int = 30, warning: float = 2.0, drift: float = 3.0
) -> DataFrame:
    """Error-rate levels up to the first alarm, as running aggregates: exact while no reset has happened."""
    frame = events.withColumn("_x", error.cast("int"))
    order = ["ts", "event_id"]
    cut = range_bucket(frame, micros("ts"), tie=F.col("event_id"))
    ran = prefix_scan(frame, keys, order, {"n": ("count", F.lit(1)), "_e": ("sum", F.col("_x"))}, cut, keep=True)
    p = F.col("_e") / F.col("n")
    ran = ran.withColumn("p", p).withColumn("s", F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n")))
    best = F.when(
        F.col("n") > warm_start,
        F.struct((F.col("p") + F.col("s")).alias("ps"), (-F.col("n")).alias("late"), F.col("p"), F.col("s")),
    )
    ran = prefix_scan(ran, keys, order, {"_best": ("min", best)}, settle(ran, cut[1]))
    level = F.col("p") + F.col("s")
    return ran.withColumn(
        "drift", F.coalesce(level > F.col("_best.p") + drift * F.col("_best.s"), F.lit(False))
    ).withColumn("warning", F.coalesce(level > F.col("_best.p") + warning * F.col("_best.s"), F.lit(False)) & ~F.col("drift"))


def eddm_levels(
    events: DataFrame, keys: Sequence[str], error: Column, warm_start: int = 30, alpha: float = 0.95, beta: float = 0.9
) -> DataFrame:
    """Distance-between-errors levels up to the first alarm; sums of distances telescope, so only errors are kept."""
    # the time buckets are kept through all scans: positions and error counts grow in the same order
    cut = range_bucket(events, micros("ts"), tie=F.col("event_id"))
    numbered = prefix_scan(events, keys, ["ts", "event_id"], {"rn": ("count", F.lit(1))}, cut, keep=True)
    errors = numbered.where(error).select(*keys, "rn", "_b")
    order = ["rn"]
    lagged = prefix_scan(errors, keys, order, {"k": ("count", F.lit(1))}, settle(errors, cut[1]), keep=True)
    lagged, _ = settle(lagged, cut[1])
    prev = lagged.select(*keys, (F.col("k") + 1).alias("k"), F.col("rn").alias("_prev"))
    dist = lagged.join(prev, [*keys, "k"], "left").withColumn("d", F.col("rn") - F.coalesce("_prev", F.lit(0)))
    ran = prefix_scan(dist, keys, order, {"_s2": ("sum", F.col("d") * F.col("d"))}, settle(dist, cut[1]), keep=True)
    mean = F.col("rn") / F.col("k")
    var = F.when(F.col("k") > 1, (F.col("_s2") - F.col("rn") * F.col("rn") / F.col("k")) / (F.col("k") - 1))
    score = mean + 2.0 * F.sqrt(F.greatest(var, F.lit(0.0)))
    ran = ran.withColumn("score", F.when((F.col("rn") > warm_start) & (F.col("k") >= 2), score))
    ran = prefix_scan(ran, keys, order, {"best": ("max", F.col("score"))}, settle(ran, cut[1]))
    level = ratio(F.col("score"), F.col("best"))
    armed = (F.col("k") > warm_start) & (F.col("score") < F.col("best"))
    return ran.withColumn("drift", F.coalesce(armed & (level < beta), F.lit(False))).withColumn(
        "warning", F.coalesce(armed & (level < alpha), F.lit(False)) & ~F.col("drift")
    )


def ewma_state(numbered: DataFrame, keys: Sequence[str], value: str, lam: float) -> DataFrame:
    """Final EWMA and bound coefficient per key: weights depend on the distance to the end only, so this is one sum."""
    sized = with_sizes(numbered, keys)
    age = (F.col("n") - F.col("rn")).cast("double")
    weight = F.when(F.col("rn") == 1, F.pow(F.lit(1 - lam), age)).otherwise(lam * F.pow(F.lit(1 - lam), age))
    q = (1 - lam) ** 2
    n = F.col("n").cast("double")
    return (
        sized.groupBy(*keys, "n")
        .agg(F.sum(weight * F.col(value)).alias("ewma"))
        .withColumn("ibc", lam**2 * (1 - F.pow(F.lit(q), n)) / (1 - q) + F.pow(F.lit(q), n))
    )


def phase_smooth(
    rows: DataFrame, keys: Sequence[str], pos: str, size: str, value: str, sigma: float = 15.0, truncate: float = 4.0,
    block: int = 2000,
) -> DataFrame:
    """Gaussian smoothing inside each phase with reflected edges; the phase sum is kept.

    A phase is cut into blocks of positions. Each row goes to its own block and, near a border, to the neighbour (its
    halo); mirrored copies (period 2n, so short phases are covered) stand in beyond both ends. A block is a bounded array,
    convolved in an Arrow batch.
    """
    reach = int(truncate * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel = kernel / kernel.sum()
    n, p = F.col(size), F.col(pos)
    turns = F.ceil(F.lit(reach) / (2 * n)) + 1
    images = F.flatten(F.transform(F.sequence(-turns, turns), lambda j: F.array(p + 2 * n * j, 2 * n * j - 1 - p)))
    near = F.filter(images, lambda q: (q >= -reach) & (q < n + reach))
    spread = rows.select(*keys, n.alias("_n"), F.col(value).cast("double").alias("_v"), F.explode(near).alias("_q"))
    lo = F.greatest(F.lit(0), F.floor((F.col("_q") - reach) / block))
    hi = F.least(F.floor((F.col("_n") - 1) / block), F.floor((F.col("_q") + reach) / block))
    homes = spread.where(lo <= hi).withColumn("_blk", F.explode(F.sequence(lo, hi)))
    arrays = homes.groupBy(*keys, "_blk").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_q", "_v"))), lambda r: r["_v"]).alias("_vs")
    )

    @F.pandas_udf("array<double>")
    def smooth(batch):  # noqa: ANN001, ANN202
        return batch.map(lambda v: np.convolve(v, kernel, mode="valid"))

    return arrays.select(*keys, "_blk", F.posexplode(smooth("_vs")).alias("_i", f"{value}_smooth")).select(
        *keys, (F.col("_blk") * block + F.col("_i")).alias(pos), f"{value}_smooth"
    )


def segments(numbered: DataFrame, keys: Sequence[str], value: Column, horizon: int) -> DataFrame:
    """Traces of at most ``horizon`` ordered values: the bounded unit the sequential detectors run on."""
    seg = F.floor((F.col("rn") - 1) / horizon).alias("seg")
    packed = F.array_sort(F.collect_list(F.struct(F.col("rn"), value.cast("double").alias("x"))))
    return numbered.groupBy(*keys, seg).agg(F.transform(packed, lambda r: r["x"]).alias("xs"))


def share_timeline(rows: DataFrame, load: str, start: float, horizon: float) -> DataFrame:
    """Mean inference / training / idle share at every breakpoint, from share changes instead of an interval join.

    ``rows``: inference, residual, ready (NULL without training). Before ``start`` a training row infers at full share.
    """
    trains = F.col("ready").isNotNull()
    change = F.explode(
        F.array(
            _change(F.lit(0.0), F.when(trains, 1.0).otherwise(F.col("inference")), F.lit(0.0)),
            _change(F.lit(start), F.when(trains, F.col("inference") - 1.0).otherwise(0.0), F.when(trains, F.col("residual")).otherwise(0.0)),
            _change(F.least(F.coalesce("ready", F.lit(horizon)), F.lit(horizon)), F.lit(0.0),
                    F.when(trains & (F.col("ready") <= horizon), -F.col("residual")).otherwise(0.0)),
        )
    ).alias("c")
    steps = rows.select(load, change).groupBy(load, F.col("c.t").alias("time_s")).agg(
        F.sum("c.inf").alias("_inf"), F.sum("c.train").alias("_train")
    )
    ran = prefix_scan(steps, [load], ["time_s"], {"_ci": ("sum", F.col("_inf")), "_ct": ("sum", F.col("_train"))}, axis=F.col("time_s"))
    sizes = rows.groupBy(load).agg(F.count(F.lit(1)).alias("_n"))
    inf, train = F.col("_ci") / F.col("_n"), F.col("_ct") / F.col("_n")
    return ran.join(sizes, load).select(
        load, "time_s", inf.alias("inference"), train.alias("retraining"), (1 - inf - train).alias("idle")
    )


def _change(t: Column, inf: Column, train: Column) -> Column:
    return F.struct(t.cast("double").alias("t"), inf.cast("double").alias("inf"), train.cast("double").alias("train"))
